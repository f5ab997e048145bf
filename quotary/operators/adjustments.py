"""Detection and repair of prices that missed a corporate action."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.numbers import deviation_pct, is_significant
from quotary.operators.prices import closest_price_before
from quotary.operators.scale import next_join, ranked, year_of


@dataclass(frozen=True)
class Thresholds:
    """Percentages and sample sizes of the detection."""

    noise_pct: float = 0.0001
    minimum_pct: float = 0.001
    split_pct: float = 10.0
    special_dividend_pct: float = 2.0
    spinoff_pct: float = 15.0
    sample_points: int = 10
    min_age_days: int = 7


DEFAULTS = Thresholds()

# Wording of recommendations, notes and errors.
ADVICE = {
    "critical": "Immediate data refresh required",
    "high": "Refresh data at earliest convenience",
    "normal": "Schedule data refresh",
    "low": "Monitor for changes",
}
NOTE_SPINOFF = "Possible spinoff or data quality issue"
NOTE_UNKNOWN = "Could not determine cause"
FEW_SAMPLES = "Insufficient historical data (need at least 2 points older than {} days)"


def price_deviation(pairs: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """G1: percent difference of ``stored_close`` and ``reference_close``, and whether it counts."""
    pct = deviation_pct(F.col("stored_close"), F.col("reference_close"))
    both_set = (F.col("stored_close") != 0) & (F.col("reference_close") != 0)
    return pairs.withColumn("pct_difference", pct).withColumn(
        "significant", both_set & is_significant(F.col("pct_difference"), t.noise_pct, t.minimum_pct))


def sample_points(prices: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    """Evenly spread rows of each ticker's history, its end, and two of its last 90 rows."""
    old = prices.where(F.col("date") < F.date_sub(as_of, t.min_age_days)).select("symbol", "date", "close")
    rows = ranked(old, ["symbol"], year_of("date"), ["date"], "i", "n").where("n >= 2")
    k = F.least(F.lit(t.sample_points), F.col("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    i, n = F.col("i"), F.col("n")
    recent = F.greatest(F.lit(0), n - 90)
    regular = (i % step == 0) & (i < step * k)
    late = (n > 20) & ((i == recent) | (i == F.floor((recent + n) / 2)))
    return rows.where(regular | (i == n - 1) | late).select("symbol", "date", "close")


def add_presplit_samples(samples: DataFrame, prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Also the last row before each reference split that falls after the oldest sample."""
    oldest = samples.groupBy("symbol").agg(F.min("date").alias("_first"))
    relevant = (splits.select("symbol", F.col("event_date").alias("target_date")).distinct()
                .join(oldest, "symbol").where("target_date > _first").select("symbol", "target_date"))
    found = closest_price_before(prices, relevant).where("price_date is not null")
    extra = found.select("symbol", F.col("price_date").alias("date"), "close")
    return samples.unionByName(extra).distinct()


def events_after(samples: DataFrame, events: DataFrame, on: str = "check_date") -> DataFrame:
    """Totals of the reference events strictly after each sample.

    ``events`` has (symbol, event_date, kind, value) with kind split, dividend
    or capital_gain. The totals run backwards over one row per ticker and
    event date, then each sample takes those of the next event date.
    """
    v = F.col("value").cast("double")
    # a ticker's events of a day, in order of size, so that products and sums have the same digits however rows arrive
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, v))).alias(kind)
    listed = events.groupBy("symbol", "event_date").agg(of("split"), of("dividend"), of("capital_gain"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    n = lambda c: F.size(c).cast("bigint")
    none = lambda c, x: F.when(F.size(c) > 0, x)
    daily = listed.select(
        "symbol", "event_date", F.aggregate("split", F.lit(1.0), lambda a, x: a * x).alias("p"), n("split").alias("ns"),
        n("dividend").alias("nd"), none("dividend", total("dividend")).alias("sd"), F.array_max("dividend").alias("md"),
        n("capital_gain").alias("ng"), none("capital_gain", total("capital_gain")).alias("sg"))
    w = Window.partitionBy("symbol").orderBy(F.col("event_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = daily.select(
        "symbol", "event_date", F.product("p").over(w).alias("split_factor"), F.sum("ns").over(w).alias("split_count"),
        F.sum("nd").over(w).alias("dividend_count"), F.sum("sd").over(w).alias("dividend_sum"),
        F.max("md").over(w).alias("dividend_max"), F.sum("ng").over(w).alias("gain_count"),
        F.sum("sg").over(w).alias("gain_sum"))
    names = ["split_factor", "split_count", "dividend_count", "dividend_sum", "dividend_max", "gain_count", "gain_sum"]
    return next_join(samples, totals, ["symbol"], on, "event_date", names)


def classify_deviation(samples: DataFrame, events: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Cause and severity of each deviation (symbol, check_date, pct_difference, ...), with its details."""
    rows = events_after(samples, events)
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    pct = F.col("pct_difference")
    split = (pct >= t.split_pct) & some("split_count")
    spinoff = ~split & (pct >= t.split_pct) & (pct >= t.spinoff_pct)
    cash = ~split & ~spinoff & some("dividend_count")
    mean = F.col("dividend_sum") / F.col("dividend_count")
    special = cash & (pct >= t.special_dividend_pct) & (F.col("dividend_max") > mean * 2)
    gain = ~split & ~spinoff & ~cash & some("gain_count")
    kind = (F.when(split & (F.col("split_factor") < 1), "reverse_split").when(split, "stock_split")
            .when(spinoff, "spinoff").when(special, "special_dividend").when(cash, "dividend")
            .when(gain, "capital_gain").otherwise("unknown"))
    severity = (F.when(F.col("event_type").isin("stock_split", "spinoff"), "critical")
                .when(F.col("event_type").isin("reverse_split", "special_dividend"), "high")
                .when(F.col("event_type").isin("dividend", "capital_gain"), "normal").otherwise("low"))
    advice = F.when(F.col("severity") == "critical", ADVICE["critical"])
    for level in ("high", "normal", "low"):
        advice = advice.when(F.col("severity") == level, ADVICE[level])
    note = (F.when(spinoff, NOTE_SPINOFF)
            .when(~split & ~cash & ~gain, NOTE_UNKNOWN))
    return rows.withColumn("event_type", kind).withColumn("severity", severity).select(
        *samples.columns, "event_type", "severity", advice.alias("recommendation"),
        F.when(split, F.col("split_factor")).alias("cumulative_factor"),
        F.when(split, F.col("split_count")).alias("split_count"),
        F.when(cash, F.col("dividend_count")).alias("dividend_count"),
        F.when(cash, F.col("dividend_sum")).alias("total_dividends"),
        F.when(special, F.col("dividend_max")).alias("special_dividend"),
        F.when(gain, F.col("gain_sum")).alias("capital_gains"), note.alias("note"))


def split_details(classified: DataFrame, events: DataFrame) -> DataFrame:
    """The splits behind each split verdict, one row each."""
    s = events.where("kind = 'split'").select("symbol", F.col("event_date").alias("split_date"),
                                              F.col("value").cast("double").alias("ratio"))
    rows = classified.where("split_count is not null").select("symbol", "check_date", "event_type")
    return rows.join(s, "symbol").where("split_date > check_date")


@dataclass
class Scan:
    """Outcome of a scan: deviating samples with their cause, and one row per ticker."""

    events: DataFrame
    symbols: DataFrame
    samples: DataFrame = field(repr=False)


def detect_adjustments(symbols: DataFrame, prices: DataFrame, reference: DataFrame, events: DataFrame, as_of,
                       t: Thresholds = DEFAULTS, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> Scan:
    """All tickers at once against the vendor's adjusted closes.

    ``store`` is applied to the samples and the classified deviations, about a
    dozen rows per ticker that several results read; pass one that writes and
    reads back.
    """
    scanned = prices.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    regular = store(sample_points(scanned, as_of, t))
    samples = store(add_presplit_samples(regular, scanned, events.where("kind = 'split'")))
    ref = reference.select("symbol", "date", F.col("close").alias("reference_close"))
    pairs = samples.withColumnRenamed("close", "stored_close").join(ref, ["symbol", "date"])
    found = price_deviation(pairs, t).where("significant").drop("significant").withColumnRenamed("date", "check_date")
    classified = store(classify_deviation(found, events, t))

    extent = samples.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"),
                                           F.count(F.lit(1)).alias("n_samples"))
    covered = (ref.select("symbol", "date").join(extent, "symbol").where("date between a and b")
               .select("symbol").distinct().withColumn("_ref", F.lit(True)))
    hits = classified.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"),
                                            F.max("pct_difference").alias("max_pct_diff"))
    status = (symbols.select("symbol").distinct().join(extent.select("symbol", "n_samples"), "symbol", "left")
              .join(covered, "symbol", "left").join(hits, "symbol", "left"))
    error = (F.when(F.coalesce("n_samples", F.lit(0)) < 2, FEW_SAMPLES.format(t.min_age_days))
             .when(F.col("_ref").isNull(), "No reference data available for the sample period"))
    per_symbol = status.select(
        "symbol", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
        (F.coalesce("n_events", F.lit(0)) > 0).alias("needs_refresh"),
        F.coalesce("max_pct_diff", F.lit(0.0)).alias("max_pct_diff"), error.alias("error"))
    return Scan(events=classified, symbols=per_symbol, samples=samples)


def scan_summary(scan: Scan) -> DataFrame:
    """Counts by cause, by severity and by outcome."""
    by_event = scan.events.groupingSets([["event_type"], ["severity"]], "event_type", "severity").agg(
        F.count(F.lit(1)).alias("n"))
    by_event = by_event.select(
        F.when(F.col("event_type").isNotNull(), "by_type").otherwise("by_severity").alias("section"),
        F.coalesce("event_type", "severity").alias("name"), "n")
    return by_event.unionByName(scan_outcomes(scan).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("symbols").alias("section"), F.col("outcome").alias("name"), "n"))


def scan_outcomes(scan: Scan) -> DataFrame:
    """Each ticker under needs_refresh, no_change or errors."""
    outcome = (F.when(F.col("error").isNotNull(), "errors").when(F.col("needs_refresh"), "needs_refresh")
               .otherwise("no_change"))
    return scan.symbols.select("symbol", outcome.alias("outcome"), "error")


def scan_report(scan: Scan) -> DataFrame:
    """One row per ticker to refresh with its events nested; a ticker has at most a sample set of them."""
    fields = [c for c in scan.events.columns if c != "symbol"]
    nested = scan.events.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("check_date", *[c for c in fields if c != "check_date"]))).alias("events"))
    return scan.symbols.where("needs_refresh and error is null").join(nested, "symbol")


def adjustment_report(report: DataFrame, symbols=None, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """The last scan by ticker (any case) and severity; tickers left without events disappear."""
    if symbols is not None:
        report = report.where(F.upper("symbol").isin([s.upper() for s in symbols]))
    if severity is not None:
        report = report.withColumn("events", F.filter("events", lambda e: e["severity"] == severity))
        report = report.where(F.size("events") > 0)
    report = report.orderBy("symbol")
    return report if limit is None else report.limit(limit)


def first_events(scan: Scan, events: DataFrame) -> DataFrame:
    """(symbol, event_id) of the tickers to refresh: the event recorded for the earliest deviation of the scan.

    ``events`` is the event table after the scan has been recorded (E6).
    """
    first = scan.events.groupBy("symbol").agg(F.min_by("event_type", "check_date").alias("event_type"), F.min("check_date").alias("event_date"))
    found = first.join(events.select("symbol", "event_date", "event_type", F.col("id").alias("event_id")),
                       ["symbol", "event_date", "event_type"], "left").select("symbol", "event_id")
    return scan.symbols.where("needs_refresh and error is null").select("symbol").join(found, "symbol", "left")


def fix_plan(affected: DataFrame, prices: DataFrame, today: Column, confirm: bool = True) -> DataFrame:
    """Per ticker the rows to delete, the full-history job to queue, and the status its event moves to.

    ``affected`` has (symbol, event_id). Nothing is planned without ``confirm``. The event
    counts as fixed once the job is queued. Apply with E7, E10 and a union to the jobs.
    """
    counts = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_deleted"))
    job = F.concat(F.lit("fix_"), "symbol", F.lit("_"), F.date_format(today, "yyyyMMdd"))
    return affected.where(F.lit(confirm)).join(counts, "symbol", "left").select(
        "symbol", "event_id", F.coalesce("rows_deleted", F.lit(0)).alias("rows_deleted"), job.alias("job_id"),
        F.lit("1970-01-01").cast("date").alias("date_from"), today.alias("date_to"), F.lit("1d").alias("interval"),
        F.lit(True).alias("force_refresh"), F.lit("high").alias("priority"), F.lit("pending").alias("job_status"),
        F.when(F.col("event_id").isNotNull(), "fixed").alias("event_status"))
