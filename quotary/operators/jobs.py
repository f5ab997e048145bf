"""Fetch-job tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.operators.clean import job_request_outcome
from quotary.operators.scale import seek, with_row


def _seconds(start, end) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)


def _wanted(jobs: DataFrame, status: str | None, created_from) -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    if created_from is not None:
        rows = rows.where(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    return rows


def _run_time(now) -> Column:
    return _seconds(F.col("started_at"), F.coalesce("completed_at", now))


def jobs_listing(jobs: DataFrame, now, status: str | None = None, created_from=None, limit: int = 20,
                 offset: int = 0) -> DataFrame:
    """Newest jobs first with their run time so far and the total."""
    rows = _wanted(jobs, status, created_from)
    order = [F.desc("created_at"), F.col("job_id")]
    part = rows.orderBy(*order).offset(offset).limit(limit)
    out = with_row(part, rows.agg(F.count(F.lit(1)).alias("total")))
    return out.withColumn("duration_seconds", _run_time(now)).orderBy(*order)


def jobs_listing_after(jobs: DataFrame, now, after=None, status: str | None = None, created_from=None, limit: int = 20) -> DataFrame:
    """J1 by seek: the page that follows the job with the key ``after`` (created_at, job_id)."""
    part = seek(_wanted(jobs, status, created_from), [("created_at", True), ("job_id", False)], limit, after)
    return part.withColumn("duration_seconds", _run_time(now))


def job_outcome(jobs: DataFrame) -> DataFrame:
    """Counts, percentage and final status from the per-ticker results; anything but success is an error."""
    of = lambda s: F.size(F.filter("results", lambda r: r["status"] == s))
    rows = F.aggregate("results", F.lit(0).cast("bigint"), lambda acc, r: acc + F.coalesce(r["rows_fetched"], F.lit(0)))
    done = F.size("results")
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), done / F.size("symbols") * 100.0))
    out = jobs.where("results is not null").select(
        "job_id", of("success").alias("success_count"), of("failed").alias("failed_count"),
        of("no_data").alias("no_data_count"), rows.alias("fetched_rows"), percent.alias("percent"), done.alias("_done"))
    final = F.when(F.col("success_count") == F.col("_done"), "completed").otherwise("completed_errors")
    return out.withColumn("final_status", final).drop("_done")


def job_queue_status(jobs: DataFrame, now) -> DataFrame:
    """One row per status with the totals of the last 24 hours beside it."""
    by_status = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    took = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    recent = jobs.where(F.col("created_at") >= now - F.expr("interval 24 hours")).agg(
        F.count(F.lit(1)).alias("recent_total"), F.count_if(F.col("status") == "completed").alias("recent_completed"),
        F.count_if(F.col("status") == "failed").alias("recent_failed"),
        F.coalesce(F.avg(took), F.lit(0.0)).cast("bigint").alias("recent_avg_seconds"))
    return with_row(by_status, recent)


def cancel_jobs(jobs: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Requested jobs that have not ended become cancelled; ``cancelled`` is null where nobody asked."""
    asked = requests.select("job_id").distinct().withColumn("_asked", F.lit(True))
    ended = F.col("status").isin("completed", "failed", "cancelled")
    out = jobs.join(asked, "job_id", "left").withColumn("cancelled", F.when(F.col("_asked"), ~ended))
    hit = F.coalesce("cancelled", F.lit(False))
    return out.withColumns({"status": F.when(hit, "cancelled").otherwise(F.col("status")),
                            "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))}).select(
        *jobs.columns, "cancelled")


def purge_jobs(jobs: DataFrame, now, days_old: int = 30, keep_failed: bool = True) -> DataFrame:
    """The table without old completed jobs; ``keep_failed=False`` also drops cancelled ones."""
    states = ["completed"] if keep_failed else ["completed", "cancelled"]
    old = F.col("created_at") < now - F.make_dt_interval(F.lit(days_old))
    return jobs.where(~(old & F.col("status").isin(states)))


def purged_count(jobs: DataFrame, now, days_old: int = 30, keep_failed: bool = True) -> DataFrame:
    """How many jobs of each status ``purge_jobs`` takes away."""
    before, after = (df.groupBy("status").agg(F.count(F.lit(1)).alias(n)) for df, n in (
        (jobs, "before"), (purge_jobs(jobs, now, days_old, keep_failed), "after")))
    return before.join(after, "status", "left").select(
        "status", (F.col("before") - F.coalesce("after", F.lit(0))).alias("purged")).where("purged > 0")


def _per_symbol(results: DataFrame) -> DataFrame:
    """(run_id, symbol, failed): a ticker without rows failed."""
    return results.groupBy("run_id", "symbol").agg((F.coalesce(F.max("rows"), F.lit(0)) <= 0).alias("failed"))


def run_status(results: DataFrame, batch_size: int = 50) -> DataFrame:
    """Outcome of each update run from (run_id, symbol, rows)."""
    runs = _per_symbol(results).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count_if(~F.col("failed")).alias("success_count"),
        F.count_if("failed").alias("failed_count"))
    status = (F.when(F.col("failed_count") == 0, "success").when(F.col("success_count") == 0, "failed")
              .otherwise("completed_with_errors"))
    return runs.select("run_id", "total_symbols", F.ceil(F.col("total_symbols") / batch_size).alias("batch_count"),
                       "success_count", "failed_count", status.alias("status"))


def run_affected(results: DataFrame) -> DataFrame:
    """Every ticker (run_id, symbol) that a run failed on."""
    return _per_symbol(results).where("failed").select("run_id", "symbol")


def create_jobs(requests: DataFrame, today) -> DataFrame:
    """A pending job for each valid request; tickers upper-cased, repeats dropped in order."""
    valid = requests.where(job_request_outcome(today).isNull())
    return valid.select(
        F.concat(F.lit("job_"), F.date_format("created_at", "yyyyMMdd_HHmmss"), F.lit("_"), "request_id").alias("job_id"),
        F.lit("pending").alias("status"), F.array_distinct(F.transform("symbols", F.upper)).alias("symbols"),
        "date_from", "date_to", "interval", F.col("force").alias("force_refresh"), "priority", "created_at")


def next_pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job."""
    return jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(1)
