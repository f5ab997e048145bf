"""Vendor comparison and momentum."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.dates import previous_business_day
from quotary.operators.scale import asof_join, month_of, order_statistics, top_k, with_row
from quotary.schemas import RAW_SOURCES

ADJUSTED = "stored"


def month_end_business_days(start: str, end: str) -> Column:
    """Array of the last weekday of each month in the range."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: previous_business_day(F.add_months(F.trunc(m, "MM"), 1)))


def source_point_grid(symbols: DataFrame, days: Column, raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """What each source says for each ticker and target day.

    ``days`` is an array expression; grid rows come from exploding it and the
    fixed source list. ``raw`` may carry ``adj_close``; ``adjusted`` is the
    stored, adjusted price table.
    """
    sources = F.array(*[F.lit(s) for s in [*RAW_SOURCES, ADJUSTED]])
    grid = symbols.select("symbol", F.explode(days).alias("date")).select("symbol", "date", F.explode(sources).alias("source"))
    number = lambda c: F.col(c).cast("double").alias(c)
    adj = number("adj_close") if "adj_close" in raw.columns else F.lit(None).cast("double").alias("adj_close")
    points = raw.select("symbol", "date", "source", number("open"), number("close"), adj, "volume").unionByName(
        adjusted.select("symbol", "date", F.lit(ADJUSTED).alias("source"), number("open"),
                        F.lit(None).cast("double").alias("close"), F.col("close").cast("double").alias("adj_close"), "volume"))
    points = points.withColumn("_there", F.lit(True))
    out = grid.join(points, ["symbol", "date", "source"], "left")
    barred = (F.col("symbol") == "VIX") & (F.col("source") == "alpaca")
    status = F.when(barred, "unsupported").when(F.col("_there"), "ok").otherwise("missing")
    blank = lambda c: F.when(~barred, F.col(c)).alias(c)
    return out.select("symbol", "date", "source", blank("open"), blank("close"), blank("adj_close"), blank("volume"),
                      status.alias("status"))


def _one(source: str, col: str) -> Column:
    return F.max(F.when(F.col("source") == source, F.col(col)))


def source_summary(points: DataFrame) -> DataFrame:
    """Per (symbol, date) how far the sources are apart."""
    opens = {s: _one(s, "open") for s in RAW_SOURCES}
    closes = {s: _one(s, "close") for s in RAW_SOURCES}
    g = points.groupBy("symbol", "date").agg(
        *[c.alias(f"o_{s}") for s, c in opens.items()], *[c.alias(f"c_{s}") for s, c in closes.items()],
        _one("eodhd", "adj_close").alias("a_eodhd"), _one("tiingo", "adj_close").alias("a_tiingo"),
        _one(ADJUSTED, "adj_close").alias("a_stored"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "status"))), "; ").alias("statuses"))
    present = F.array_compact(F.array(*[F.col(f"c_{s}") for s in RAW_SOURCES]))
    # an open counts only where the source has a close
    with_open = F.array_compact(F.array(*[F.when(F.col(f"c_{s}").isNotNull(), F.col(f"o_{s}")) for s in RAW_SOURCES]))
    spread = lambda a: F.when(F.size(a) >= 2, F.array_max(a) - F.array_min(a))
    ordered = F.array_sort(present)
    n = F.size(present)
    lower, upper = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    median = F.when(n > 0, (lower + upper) / 2)
    return g.select(
        "symbol", "date", n.alias("raw_source_count"), spread(with_open).alias("max_raw_open_diff"),
        spread(present).alias("max_raw_close_diff"),
        (F.col("c_eodhd") - F.col("c_tiingo")).alias("primary_verifier_close_diff"),
        (F.col("c_alpaca") - median).alias("third_vs_raw_median_close"),
        (F.col("a_stored") - F.col("a_eodhd")).alias("stored_adj_vs_primary_adj"),
        (F.col("a_stored") - F.col("a_tiingo")).alias("stored_adj_vs_verifier_adj"), "statuses")


def source_scorecard(summary: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row of totals and the verdict on the primary source."""
    diff, third = F.col("primary_verifier_close_diff"), F.col("third_vs_raw_median_close")
    two = F.col("raw_source_count") >= 2
    matches = F.count_if(F.abs(diff) <= tolerance)
    comparable = F.count_if(two)
    out = summary.agg(
        F.count(F.lit(1)).alias("rows"), comparable.alias("rows_with_two_sources"), matches.alias("primary_matches"),
        F.count("primary_verifier_close_diff").alias("primary_compared"),
        F.count_if(F.abs(third) <= tolerance).alias("third_matches"),
        F.count("third_vs_raw_median_close").alias("third_compared"),
        F.max(F.when(two, F.abs("max_raw_close_diff"))).alias("max_raw_close_diff"),
        F.max(F.abs("stored_adj_vs_primary_adj")).alias("max_stored_vs_primary"),
        F.max(F.abs("stored_adj_vs_verifier_adj")).alias("max_stored_vs_verifier"))
    need = F.greatest(F.lit(1), F.floor(F.col("rows_with_two_sources") * 0.9))
    return out.withColumn("primary_recommended", F.col("primary_matches") >= need)


def stored_vs_vendor(stored: DataFrame, vendor: DataFrame) -> DataFrame:
    """I4: days both have, with the absolute difference."""
    s = stored.select("symbol", "date", F.col("close").alias("stored_close"))
    v = vendor.select("symbol", "date", F.col("close").alias("vendor_close")).where("vendor_close is not null")
    return s.join(v, ["symbol", "date"]).withColumn("abs_diff", F.abs(F.col("stored_close") - F.col("vendor_close")))


def stored_vs_vendor_diff(stored: DataFrame, vendor: DataFrame) -> DataFrame:
    """I4: rows, max, median and nearest-rank p99 of the difference, per ticker and overall (symbol ``*``).

    ``vendor_missing`` counts stored days the vendor lacks.
    """
    pairs = stored_vs_vendor(stored, vendor).select("symbol", "abs_diff")
    both = pairs.select(F.explode(F.array("symbol", F.lit("*"))).alias("symbol"), "abs_diff")
    lower, upper = lambda n: F.floor((n + 1) / 2), lambda n: F.floor(n / 2) + 1
    stats = order_statistics(both, ["symbol"], "abs_diff", {
        "rows": None, "max_diff": lambda n: n, "lo": lower, "hi": upper, "p99_diff": lambda n: F.ceil(n * 0.99)})
    v = vendor.where("close is not null").select("symbol", "date")
    absent = stored.select("symbol", "date").join(v, ["symbol", "date"], "left_anti").select(
        F.explode(F.array("symbol", F.lit("*"))).alias("symbol"))
    absent = absent.groupBy("symbol").agg(F.count(F.lit(1)).alias("vendor_missing"))
    return stats.join(absent, "symbol", "full_outer").select(
        "symbol", F.coalesce("rows", F.lit(0)).alias("rows"), "max_diff",
        ((F.col("lo") + F.col("hi")) / 2).alias("median_diff"), "p99_diff",
        F.coalesce("vendor_missing", F.lit(0)).alias("vendor_missing"))


def month_end_dates(prices: DataFrame) -> DataFrame:
    """The last observed day of each month over all tickers."""
    return prices.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date")).select("date")


def momentum_score(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """Return from the last close at or before ``as_of`` minus ``lookback`` months to that at ``as_of``.

    ``targets`` has (symbol, as_of, lookback). Both ends are looked up in one pass.
    """
    keys = ["symbol", "as_of", "lookback"]
    ends = targets.select(*keys, F.inline(F.array(
        F.struct(F.lit("now").alias("which"), F.col("as_of").alias("day")),
        F.struct(F.lit("then").alias("which"), F.expr("add_months(as_of, -lookback)").alias("day")))))
    rows = prices.select("symbol", F.col("date").alias("price_date"), "close")
    found = asof_join(ends, rows, ["symbol"], "day", "price_date", ["close"])
    both = found.groupBy(*keys).agg(F.max(F.when(F.col("which") == "now", F.col("close"))).alias("now"),
                                    F.max(F.when(F.col("which") == "then", F.col("close"))).alias("then"))
    return both.select(*keys, F.when(F.col("then") != 0, F.col("now") / F.col("then") - 1.0).alias("score"))


def momentum_targets(prices: DataFrame, lookbacks) -> DataFrame:
    """Every ticker at every month end of the table, for each lookback.

    The month ends travel as one row, an array with twelve entries per year.
    """
    ends = month_end_dates(prices).agg(F.array_sort(F.collect_list("date")).alias("ends"))
    grid = with_row(prices.select("symbol").distinct(), ends).select("symbol", F.explode("ends").alias("as_of"))
    return grid.select("symbol", "as_of", F.explode(F.array(*[F.lit(k) for k in lookbacks])).alias("lookback"))


def _cutoffs(ends: DataFrame, shifts) -> DataFrame:
    """(month, cuts): for each shift that some month end, moved back by it, falls in the month: (i, cutoff, as_of).

    ``i`` is the shift's position. There is a row per calendar month, so it may be broadcast whatever the tables hold.
    """
    moved = ends.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.add_months("date", -k).alias("cutoff"), F.col("date").alias("as_of"))
                                           for i, k in enumerate(shifts)])))
    return moved.groupBy(month_of("cutoff").alias("month")).agg(F.array_sort(F.collect_list(F.struct("i", "cutoff", "as_of"))).alias("cuts"))


def month_end_closes(tables: dict[str, DataFrame], ends: DataFrame, shifts, from_first: bool = False) -> DataFrame:
    """The last close of each ticker at or before each month end moved back by each of ``shifts`` months.

    One row per (symbol, as_of) with a column ``name_i`` for every table and
    position of a shift. Per ticker and month the last close up to each cutoff
    and the last of all are conditional aggregates; months without rows take
    the one before. ``from_first`` also gives rows, without closes, for month
    ends before a ticker's first month. Each table is read once.
    """
    cuts = _cutoffs(ends, shifts)
    rows = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("side"), "symbol", "date", "close", month_of("date").alias("month"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(F.broadcast(cuts), "month", "left")  # a row per calendar month
    n = len(shifts)

    def upto(i: int) -> Column:
        return F.col("date") <= F.get(F.filter("cuts", lambda c: c["i"] == i), F.lit(0))["cutoff"]

    monthly = rows.groupBy("side", "symbol", "month").agg(
        F.max_by("close", "date").alias("close"),
        *[F.max_by(F.when(upto(i), F.col("close")), F.when(upto(i), F.col("date"))).alias(f"v{i}") for i in range(n)],
        *[F.max(upto(i)).alias(f"h{i}") for i in range(n)])
    w = Window.partitionBy("side", "symbol").orderBy("month")  # a row per calendar month
    before = F.lag("close").over(w)
    own = F.array(*[F.when(F.col(f"h{i}"), F.col(f"v{i}")).otherwise(before) for i in range(n)])
    monthly = monthly.select("side", "symbol", "month", "close", own.alias("own"), F.lag("month").over(w).alias("_prev"),
                             F.lead("month").over(w).alias("_next"))
    span = with_row(monthly, cuts.agg(F.min("month").alias("_a"), F.max("month").alias("_b")))
    since = F.when(F.col("_prev").isNull(), F.least("_a", "month")).otherwise(F.col("month")) if from_first else F.col("month")
    until = F.coalesce(F.add_months("_next", -1), "_b")
    filled = span.where(since <= until).select("side", "symbol", F.col("month").alias("_own"), "close", "own", F.explode(
        F.sequence(since, until, F.expr("interval 1 month"))).alias("month"))
    value = F.when(F.col("month") == F.col("_own"), F.col("own")).when(
        F.col("month") > F.col("_own"), F.array_repeat("close", n)).otherwise(F.array_repeat(F.lit(None).cast("double"), n))
    values = filled.withColumn("value", value).join(F.broadcast(cuts), "month").select(
        "side", "symbol", "value", F.inline("cuts")).select("side", "symbol", "as_of", "i", F.expr("get(value, i)").alias("v"))
    return values.groupBy("symbol", "as_of").agg(*[
        F.max(F.when((F.col("side") == name) & (F.col("i") == i), F.col("v"))).alias(f"{name}_{i}") for name in tables for i in range(n)])


def _scores(closes: DataFrame, names: dict[str, str], lookbacks) -> DataFrame:
    """Scores per lookback from the closes of `month_end_closes` over shifts (0, *lookbacks)."""
    def score(name: str, i: int) -> Column:
        then = F.col(f"{name}_{i}")
        return F.when(then != 0, F.col(f"{name}_0") / then - 1.0)

    per = [F.struct(F.lit(k).alias("lookback"), *[score(name, i).alias(to) for name, to in names.items()]) for i, k in enumerate(lookbacks, 1)]
    return closes.select("symbol", "as_of", F.inline(F.array(*per)))


def month_end_momentum(prices: DataFrame, lookbacks=(1, 3, 6, 12)) -> DataFrame:
    """I6 for every ticker at every month end of the table: `momentum_score` of `momentum_targets`, without that grid."""
    closes = month_end_closes({"p": prices}, month_end_dates(prices), (0, *lookbacks), from_first=True)
    return _scores(closes, {"p": "score"}, lookbacks)


def momentum_reversal_risk(vendor: DataFrame, stored: DataFrame, lookbacks=(1, 3, 6, 12)) -> DataFrame:
    """Month ends at which the stored prices could, or do, change the top-ranked ticker."""
    closes = month_end_closes({"v": vendor, "s": stored}, month_end_dates(vendor), (0, *lookbacks))
    both = _scores(closes, {"v": "v_score", "s": "s_score"}, lookbacks).where("v_score is not null and s_score is not null")
    ranks = both.select("as_of", "lookback", "symbol", F.abs(F.col("s_score") - F.col("v_score")).alias("error"), F.inline(F.array(
        F.struct(F.lit("v").alias("by"), F.col("v_score").alias("score")), F.struct(F.lit("s").alias("by"), F.col("s_score").alias("score")))))
    lead = top_k(ranks, ["as_of", "lookback", "by"], [F.desc("score"), "symbol"], 2, "rk")
    at = lambda by, rank, c: F.max(F.when((F.col("by") == by) & (F.col("rk") == rank), F.col(c)))
    out = lead.groupBy("as_of", "lookback").agg(
        F.count(F.lit(1)).alias("n"), at("v", 1, "symbol").alias("vendor_top"), at("s", 1, "symbol").alias("stored_top"),
        (at("v", 1, "score") - at("v", 2, "score")).alias("top_margin"),
        (at("v", 1, "error") + at("v", 2, "error")).alias("top_error_bound")).where("n = 4")
    out = out.withColumn("rank_reversed", F.col("vendor_top") != F.col("stored_top"))
    return out.where(F.col("rank_reversed") | (F.col("top_error_bound") >= F.col("top_margin"))).drop("n")
