"""Helpers of the document operators: written intermediate tables, input columns, slices of Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; below the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quotary_llm"


#: For tables whose rows are a megabyte or so: a writer looks at its size after every row, not after the first hundred, and
#: closes a row group at 4 MB, which is also what a reader holds at once. Packed numbers gain nothing by compression.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
              "parquet.enable.dictionary": "false", "compression": "uncompressed"}


def settled(df: DataFrame, **options: str | int) -> DataFrame:
    """Write a frame to the shared folder and read it back: what follows depends on files, not on lineage.

    Shuffle files that nothing refers to any more are released before and
    after, so that a chain of steps holds one step's shuffles at a time.
    """
    spark = df.sparkSession
    _release(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    _release(spark)
    return out


def _release(spark: SparkSession) -> None:
    """Let go of frames that are done with; Spark drops their shuffle files when its own collector has seen it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under the names that an operator uses; whatever else the table has stays out."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def as_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` with each row as one struct ``row`` and keys computed from it: whatever its columns are called, no name clashes.

    Joins on the keys and ``select("row.*")`` give its columns back.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def text_column(name: str = "text") -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_print(name: str = "text") -> Column:
    """A hash of the text, of an empty one for null: with the id it is the key of a row."""
    return F.xxhash64(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; only one is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def group_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``; a group may run over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key)
        last = keys[-1]
        same = pa.compute.equal(keys, last)
        first = pa.compute.index(same, True).as_py()
        starts = held and held[-1].column(key)[-1].as_py() != keys[0].as_py()
        if starts:
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)
