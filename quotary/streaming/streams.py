"""Structured Streaming jobs."""

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from quotary.operators.clean import normalize_price_rows
from quotary.operators.consensus import majority_close
from quotary.operators.merge import VALUES
from quotary.schemas import KEYS, RELATIONS, TOLERANCE


def stream_upsert_prices(changes: DataFrame, log: str, checkpoint: str, now: Column | None = None):
    """Append arriving price rows, cleaned, to a log of Parquet files by year.

    The file sink commits each batch once, so a batch that runs again after a
    failure adds nothing twice, and a restart goes on where the checkpoint
    stands. Nothing stored is read or written again; `price_table` merges on
    read; what it returns, written elsewhere, is the base of a new log.
    """
    rows = normalize_price_rows(changes, now).select(*RELATIONS["prices"].names).withColumn("year", F.year("date"))
    return (rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
            .partitionBy("year").trigger(availableNow=True).start())


def price_log(spark: SparkSession, log: str) -> DataFrame:
    """The rows of a log; ``year`` prunes its folders."""
    return spark.read.schema(StructType([*RELATIONS["prices"].fields, StructField("year", IntegerType())])).parquet(log)


def price_table(base: DataFrame, log: DataFrame) -> DataFrame:
    """The newest row per (symbol, date) of a base and the rows that arrived since, by one aggregate.

    As in a batch upsert: an arrived row replaces a stored one only if it is
    strictly newer, a stored row without a stamp stays, and of arrived rows
    with one stamp the one with the largest values counts. In what order they
    arrived does not matter.
    """
    key = KEYS["prices"]
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    stored = base.select(*key, F.struct(F.coalesce("last_updated", never).alias("at"), F.lit(1).alias("stored"), *VALUES).alias("r"))
    arrived = log.select(*key, F.struct(F.col("last_updated").alias("at"), F.lit(0).alias("stored"), *VALUES).alias("r"))
    newest = stored.unionByName(arrived).groupBy(*key).agg(F.max("r").alias("r"))
    return newest.select(*key, *[F.col(f"r.{c}").alias(c) for c in VALUES])


class LateRows(StreamingQueryListener):
    """Counts the rows that the stateful operators of a query drop because their time lies before the watermark.

    Add it to ``spark.streams`` before the query starts; ``wait`` returns the
    total once the query has ended. Rows are dropped by the first operator that
    keeps state, so that each counts once.
    """

    def __init__(self) -> None:
        self.dropped, self._ended = 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped += max([op.numRowsDroppedByWatermark for op in event.progress.stateOperators], default=0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def wait(self, seconds: float = 60) -> int:
        if not self._ended.wait(seconds):
            raise TimeoutError("the query's end was not reported")
        return self.dropped


def late_days(rows: DataFrame, newest, delay: str, day: str = "date") -> DataFrame:
    """The rows that a stream with this watermark drops once it has seen the day ``newest``: what the batch refresh is for.

    Spark lets rows in by the watermark of the batch before, so that a row may come one batch later than the delay says.
    """
    return rows.where(F.col(day).cast("timestamp") < F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}"))


def stream_consensus(raw: DataFrame, delay: str = "30 days", tolerance: float = TOLERANCE) -> DataFrame:
    """Consensus per (symbol, date) as sources arrive (update mode).

    The trading day is the event time and part of the key, so a day keeps all
    its sources together and its state is dropped once the newest day seen is
    ``delay`` later. Replayed rows are removed. Rows for older days are
    dropped and counted in the progress reports; the batch refresh repairs them.
    """
    rows = (raw.withColumn("session", F.col("date").cast("timestamp")).withWatermark("session", delay)
            .dropDuplicatesWithinWatermark(["symbol", "session", "source", "fetched_at"]))
    value = F.struct("source", F.col("close").cast("double").alias("close"))
    grouped = rows.groupBy("session", "symbol").agg(F.array_sort(F.collect_set(value)).alias("closes"))
    return grouped.select("symbol", F.col("session").cast("date").alias("date"), "closes",
                          majority_close(F.col("closes"), tolerance).alias("consensus_close"))


def stream_error_counts(errors: DataFrame, kind: Column, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """S3: errors by type in tumbling minutes."""
    rows = errors.withColumn("error_type", kind).withWatermark(at, delay)
    return rows.groupBy(F.window(at, "60 seconds"), "error_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "error_type", "n")


STATE = "spark.sql.streaming.stateStore"
#: A batch's state goes to files of RocksDB, and all stores of an executor share so many MB: state does not have to fit in the heap.
ON_DISK = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.maxMemoryUsageMB": "300",
    # a batch adds what it changed to the checkpoint, not whole files
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    # counting keys costs a read before each write
    f"{STATE}.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile keep their state on disk; a query takes the settings with it when it starts.

    One that goes on from a checkpoint keeps the kind of store that it began with.
    """
    before = {key: spark.conf.get(key, None) for key in ON_DISK}
    for key, value in ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drain_updates(stream: DataFrame, path: str, checkpoint: str):
    """Run an update-mode aggregate over all available input, its state on disk; each batch lands under its own number."""

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with state_on_disk(stream.sparkSession):
        return (stream.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def newest_updates(spark: SparkSession, path: str, key, values) -> DataFrame:
    """The latest landed value per key."""
    rows = spark.read.parquet(path)
    last = F.max(F.struct("batch", *values)).alias("r")
    return rows.groupBy(*key).agg(last).select(*key, *[F.col(f"r.{v}").alias(v) for v in values])
