"""Timing reports and resampling (K1-K3)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.operators.scale import order_statistics, top_k


def _recent(timings: DataFrame, k: int) -> DataFrame:
    return top_k(timings, ["operation"], [F.desc("ts"), F.desc("event_id")], k, "rk")


def latency_report(timings: DataFrame, keep: int = 100, recent: int = 10) -> DataFrame:
    """K1: figures over each operation's last ``keep`` timings, and the mean of its last ``recent``."""
    last = F.avg(F.when(F.col("rk") <= recent, F.col("duration")))
    return _recent(timings, keep).groupBy("operation").agg(
        F.count(F.lit(1)).alias("count"), F.avg("duration").alias("avg"), F.min("duration").alias("min"),
        F.max("duration").alias("max"), last.alias("recent_avg"))


def slowest_operations(timings: DataFrame, recent: int = 10, k: int = 10) -> DataFrame:
    """K1: the slowest of the operations' last ``recent`` timings."""
    return _recent(timings, recent).select("operation", "duration", "event_id").orderBy(
        F.desc("duration"), "operation", "event_id").limit(k)


def load_test_summary(requests: DataFrame) -> DataFrame:
    """K2: per concurrency level the latencies of good requests, errors and throughput.

    p95 is the element at index ``int(0.95 n)`` of the sorted latencies.
    """
    begin, end = F.min(F.unix_micros("started_at")), F.max(F.unix_micros("started_at") + F.col("elapsed_ms") * 1000)
    facts = requests.groupBy("concurrency").agg(
        F.count_if(F.col("ok")).alias("successful"), F.count_if(~F.col("ok")).alias("errors"),
        F.avg(F.when(F.col("ok"), F.col("elapsed_ms"))).alias("avg_latency_ms"), ((end - begin) / 1e6).alias("total_time_s"))
    ranks = order_statistics(requests.where("ok"), ["concurrency"], "elapsed_ms", {
        "lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.floor(n / 2) + 1,
        "p95_latency_ms": lambda n: F.floor(n * 0.95) + 1})
    return facts.join(ranks, "concurrency", "left").select(
        "concurrency", "successful", "errors", "total_time_s", "avg_latency_ms",
        ((F.col("lo") + F.col("hi")) / 2).alias("p50_latency_ms"), "p95_latency_ms",
        (F.col("successful") / F.col("total_time_s")).alias("throughput_rps"))


# Calendar unit of each bar interval.
UNITS = {"1wk": "week", "1mo": "month", "3mo": "quarter"}


def resample_ohlcv(prices: DataFrame, interval: str) -> DataFrame:
    """K3: daily bars to weekly, monthly or quarterly ones."""
    period = F.date_trunc(UNITS[interval], F.col("date").cast("timestamp")).cast("date").alias("period_start")
    return prices.groupBy("symbol", period).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
