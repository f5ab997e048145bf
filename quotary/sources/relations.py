"""Reading and writing the seven relations (A1)."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quotary.schemas import RELATIONS


def load_relation(spark: SparkSession, root: str, name: str, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """One relation from Parquet with its declared schema; a date range also prunes the yearly folders."""
    df = spark.read.schema(RELATIONS[name]).parquet(f"{root}/{name}")
    for bound, compare in ((start, ">="), (end, "<=")):
        if bound is None:
            continue
        df = df.where(f"date {compare} DATE'{bound}'")
        if "year" in df.columns:
            df = df.where(f"year {compare} {bound[:4]}")
    return df.select(*RELATIONS[name].names)


def load_relations(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: load_relation(spark, root, name) for name in RELATIONS}


def declared(df: DataFrame, name: str) -> DataFrame:
    """The columns of a relation in their declared types, from whatever types a source gives them; JSON text is parsed."""
    given = dict(df.dtypes)

    def column(f: StructField):
        nested = isinstance(f.dataType, (ArrayType, StructType))
        value = F.from_json(f.name, f.dataType) if nested and given[f.name] == "string" else F.col(f.name).cast(f.dataType)
        return value.alias(f.name)

    return df.select(*[column(f) for f in RELATIONS[name].fields])


def load_relation_jdbc(spark: SparkSession, url: str, name: str, properties: dict, bounds: tuple[str, str],
                       partitions: int = 64, column: str = "date") -> DataFrame:
    """One relation over JDBC in its declared types, read by ``partitions`` parallel ranges of a date column."""
    rows = (spark.read.format("jdbc").options(**properties)
            .option("url", url).option("dbtable", name)
            .option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", partitions).load())
    return declared(rows, name)


def save_relation(df: DataFrame, path: str, mode: str = "overwrite", day: str | None = "date") -> None:
    """Write a relation by year of ``day``, clustered by ticker.

    Ranges over (year, ticker, day) are cut by sampling, so a hot ticker is
    spread over several files; their number follows the session's shuffle
    partitions. Date ranges then prune folders and tickers prune row groups.
    """
    if day is None or day not in df.columns:
        df.write.mode(mode).parquet(path)
        return
    out = df.withColumn("year", F.year(day)).repartitionByRange("year", "symbol", day).sortWithinPartitions("symbol", day)
    with _years_side_by_side(df.sparkSession):
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


@contextmanager
def _years_side_by_side(spark: SparkSession, years: int = 100) -> Iterator[None]:
    """While a table is written, a task keeps the files of its years open, so that rows need not be sorted by year.

    A sort that starts with the year compares whole rows, since a range has
    few years; one that starts with the ticker mostly compares its first bytes.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(years))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def summary(df: DataFrame, keys: list[str], day: str | None) -> DataFrame:
    """Rows, distinct keys without a null, first and last ``day`` of a relation.

    Where ``day`` is part of the key, the days of the other key columns in a
    year are six masks of two months each: a stored file is clustered by
    ticker, so tasks send a row per ticker and year, not one per key.
    """
    if day not in keys:
        first_last = [f(F.col(day) if day else F.lit(None).cast("date")) for f in (F.min, F.max)]
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*keys).alias("n_keys"),
                      first_last[0].alias("first_day"), first_last[1].alias("last_day"))
    others = [k for k in keys if k != day]
    place = F.expr(f"shiftleft(1L, (month({day}) - 1) % 2 * 31 + day({day}) - 1)")
    masks = [F.bit_or(F.when(F.month(day).isin(2 * i + 1, 2 * i + 2), place)).alias(f"_m{i}") for i in range(6)]
    years = df.groupBy(*others, F.year(day).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(day).alias("_first"), F.max(day).alias("_last"), *masks)
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in others], F.lit(True))
    n_days = sum((F.coalesce(F.bit_count(f"_m{i}"), F.lit(0)) for i in range(6)), F.lit(0))
    return years.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(whole, n_days)), F.lit(0)).alias("n_keys"),
                     F.min("_first").alias("first_day"), F.max("_last").alias("last_day"))


def upsert_relation(spark: SparkSession, root: str, name: str, incoming: DataFrame,
                    merge: Callable[[DataFrame, DataFrame], DataFrame], day: str = "date") -> DataFrame:
    """Merge incoming rows into a relation that is stored by year, and return the counts by change.

    Only the years that the delivery has rows for are read and written: a list
    of calendar years, known once the delivery is at hand, prunes the folders,
    and the merged years replace theirs. They are written aside first, since
    no path is overwritten while it is read. ``merge`` is one of E1 to E4.
    """
    years = sorted(r[0] for r in incoming.select(F.year(day)).distinct().collect() if r[0] is not None)
    path = f"{root}/{name}"
    old = spark.read.schema(StructType([*RELATIONS[name].fields, StructField("year", IntegerType())])).parquet(path).where(
        F.col("year").isin(years)).select(*RELATIONS[name].names)
    merged = stored(merge(old, incoming))
    save_relation(merged.select(*RELATIONS[name].names), path, day=day)
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints; below the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quotary"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once and read it back, so that what follows neither recomputes it nor depends on its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/quotary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
