"""Coverage and gaps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions import dates
from quotary.functions.dates import previous_business_day, previous_month_last_business_day, weekday_count
from quotary.operators.scale import month_of, running_last, running_max_before, seek, with_row

SYMBOL_COLS = ["symbol", "name", "exchange", "currency", "is_active"]
SORT_FIELDS = [*SYMBOL_COLS, "data_start", "data_end", "data_days", "row_count", "last_updated"]


def month_masks(prices: DataFrame) -> DataFrame:
    """The stored days of each (symbol, month) as a mask, bit by day, with the rows and their newest stamp.

    One aggregate with map-side combine: a ticker's day travels as one bit.
    """
    stamp = [F.max("last_updated").alias("last_updated")] if "last_updated" in prices.columns else []
    return prices.groupBy("symbol", month_of("date").alias("month")).agg(
        F.bit_or(dates.day_bit("date")).alias("mask"), F.count(F.lit(1)).alias("n_rows"), *stamp)


def _per_symbol(prices: DataFrame) -> DataFrame:
    """Extent, rows and distinct days per ticker, from its months."""
    mask, month = F.col("mask"), F.col("month")
    return month_masks(prices).groupBy("symbol").agg(
        F.min(dates.first_day(month, mask)).alias("data_start"), F.max(dates.last_day(month, mask)).alias("data_end"),
        F.sum(F.bit_count(mask)).alias("data_days"), F.sum("n_rows").alias("row_count"), F.max("last_updated").alias("last_updated"))


def symbol_coverage_view(symbols: DataFrame, prices: DataFrame) -> DataFrame:
    """All-time coverage. A ticker without prices counts one row, as an outer join's COUNT(*) does."""
    span = F.datediff("data_end", "data_start") + 1
    return symbols.select(*SYMBOL_COLS).join(_per_symbol(prices), "symbol", "left").select(
        *SYMBOL_COLS, "data_start", "data_end", F.coalesce("data_days", F.lit(0)).alias("data_days"),
        F.coalesce("row_count", F.lit(1)).alias("row_count"), "last_updated",
        F.coalesce(span > F.col("data_days"), F.lit(False)).alias("has_gaps"))


def coverage_recent(symbols: DataFrame, prices: DataFrame, as_of, years: int = 5) -> DataFrame:
    """Coverage of the last years, aggregated before the join."""
    facts = _per_symbol(prices.where(F.col("date") >= F.add_months(as_of, -12 * years)))
    sparse = F.col("row_count") < (F.datediff("data_end", "data_start") + 1) * 0.8
    facts = facts.withColumn("has_gaps", sparse)
    return symbols.select(*SYMBOL_COLS).join(facts, "symbol", "left").select(
        *SYMBOL_COLS, "data_start", "data_end", F.coalesce("data_days", F.lit(0)).alias("data_days"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), "last_updated",
        F.coalesce("has_gaps", F.lit(False)).alias("has_gaps"))


def coverage_stats(symbols: DataFrame, prices: DataFrame, wanted=None, start=None, end=None) -> DataFrame:
    """D3: all-time extent with the ticker's own dates as fallback."""
    facts = prices.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"),
                                         F.count(F.lit(1)).alias("data_points"))
    rows = symbols if not wanted else symbols.where(F.col("symbol").isin(list(wanted)))
    out = rows.join(facts, "symbol", "left").select(
        *SYMBOL_COLS, F.coalesce("_a", "first_date").alias("first_date"), F.coalesce("_b", "last_date").alias("last_date"),
        F.coalesce("data_points", F.lit(0)).alias("data_points"), "created_at")
    if start is not None:
        out = out.where(F.col("first_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("last_date") <= F.lit(end).cast("date"))
    return out.orderBy("symbol")


def coverage_filter(coverage: DataFrame, q=None, has_data=None, start_after=None, end_before=None,
                    updated_after=None) -> DataFrame:
    """The listing's filters."""
    if q:
        coverage = coverage.where(F.col("symbol").ilike(f"%{q}%") | F.col("name").ilike(f"%{q}%"))
    if has_data is not None:
        coverage = coverage.where(F.col("data_start").isNotNull() if has_data else F.col("data_start").isNull())
    if start_after is not None:
        coverage = coverage.where(F.col("data_start") >= F.lit(start_after).cast("date"))
    if end_before is not None:
        coverage = coverage.where(F.col("data_end") <= F.lit(end_before).cast("date"))
    if updated_after is not None:
        coverage = coverage.where(F.col("last_updated") >= F.lit(updated_after).cast("timestamp"))
    return coverage


def _listing_order(sort_by: str, order: str) -> list[tuple[str, bool]]:
    key = sort_by if sort_by in SORT_FIELDS else "symbol"
    return [(key, order.lower() == "desc")] + ([("symbol", False)] if key != "symbol" else [])


def coverage_listing(coverage: DataFrame, sort_by: str = "symbol", order: str = "asc", page: int = 1,
                     page_size: int = 50, **filters) -> DataFrame:
    """One page of the filtered coverage with the total and the page count.

    Nulls sort last ascending and first descending, as in PostgreSQL.
    """
    rows = coverage_filter(coverage, **filters)
    key = F.col(sort_by if sort_by in SORT_FIELDS else "symbol")
    key = key.desc_nulls_first() if order.lower() == "desc" else key.asc_nulls_last()
    total = rows.agg(F.count(F.lit(1)).alias("total_items"))
    pages = F.greatest(F.ceil(F.col("total_items") / page_size), F.lit(1)).alias("total_pages")
    part = rows.orderBy(key, "symbol").offset((page - 1) * page_size).limit(page_size)
    return with_row(part, total.select("total_items", pages)).orderBy(key, "symbol")


def coverage_listing_after(coverage: DataFrame, after=None, sort_by: str = "symbol", order: str = "asc",
                           page_size: int = 50, **filters) -> DataFrame:
    """D4 by seek: the page that follows the row with the key ``after`` (the sort field's value, then the ticker)."""
    return seek(coverage_filter(coverage, **filters), _listing_order(sort_by, order), page_size, after)


KEY = ["symbol", "date_from", "date_to"]


def _request_months(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """The months of each request with masks of its weekdays (asked) and of the days that are stored or missing in it.

    Requests are cut by month and meet the masks on ticker and month, however
    many of them overlap; a reversed request has one row without a month.
    Both sides are read once.
    """
    month, valid = F.col("month"), F.col("date_from") <= F.col("date_to")
    months = F.sequence(F.trunc("date_from", "month"), F.trunc("date_to", "month"), F.expr("interval 1 month"))
    asked = requests.select(*KEY).distinct().select(*KEY, F.explode_outer(F.when(valid, months)).alias("month"))
    rows = asked.join(month_masks(prices).select("symbol", "month", "mask"), ["symbol", "month"], "left")
    inside = dates.range_mask(month, F.col("date_from"), F.col("date_to"))
    rows = rows.withColumn("stored", F.coalesce("mask", F.lit(0)).bitwiseAND(inside)).withColumn(
        "asked", dates.weekday_mask(month).bitwiseAND(inside))
    return rows.select(*KEY, "month", "asked", "stored", F.col("asked").bitwiseAND(F.bitwise_not("stored")).alias("missing"))


def _runs(solid: Column) -> Column:
    """Array of the runs of set bits of a mask, each as a mask, in order."""
    starts = solid.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", solid, F.lit(1))))
    at = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftright", starts, i).bitwiseAND(F.lit(1)) == 1)

    def run(i: Column) -> Column:
        # adding its lowest bit to a run carries through to the first day after it
        low = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        return solid.bitwiseAND(F.bitwise_not(solid + low))

    rest = F.transform(at, lambda i: run(i).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1)))
    return F.when(solid != 0, rest).otherwise(F.array().cast("array<bigint>"))


def missing_ranges(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """Maximal runs of weekdays without a price, per request (symbol, date_from, date_to).

    Runs are found in each month's mask, weekends filled in. One that reaches
    the end of its month goes on to where the missing head of a later month
    ends: the window runs over a request's months.
    """
    month, missing = F.col("month"), F.col("missing")
    rows = _request_months(prices, requests).where("month is not null and asked <> 0")
    # weekend days between the first and the last asked weekday join the runs on both sides
    first, last = dates.first_day(month, F.col("asked")), dates.last_day(month, F.col("asked"))
    weekend = dates.range_mask(month, F.col("first"), F.col("last")).bitwiseAND(F.bitwise_not("asked"))
    rows = rows.withColumns({"first": first, "last": last}).withColumn("solid", F.when(missing != 0, missing.bitwiseOR(weekend)).otherwise(F.lit(0)))
    # a run of weekend days alone has no missing weekday
    rows = rows.withColumn("runs", F.filter(F.transform(_runs(F.col("solid")), lambda r: r.bitwiseAND(missing)), lambda r: r != 0)).drop("solid")
    rows = rows.withColumn("spans", F.transform("runs", lambda r: F.struct(
        dates.first_day(month, r).alias("gap_start"), dates.last_day(month, r).alias("gap_end"))))
    head = F.get("spans", F.lit(0))
    open_head = F.coalesce(head["gap_start"] == F.col("first"), F.lit(False))
    open_tail = F.coalesce(F.try_element_at("spans", F.lit(-1))["gap_end"] == F.col("last"), F.lit(False))
    # where a run that comes in from the month before ends: null if it goes on through all of this month
    stop = F.when(missing == F.col("asked"), None).when(open_head, head["gap_end"]).otherwise(previous_business_day(F.col("first")))
    rows = rows.withColumns({"open_head": open_head, "open_tail": open_tail, "stop": stop})
    w = Window.partitionBy(*KEY).orderBy("month")
    rows = rows.withColumns({
        "continued": F.coalesce(F.lag("open_tail").over(w), F.lit(False)) & F.col("open_head"),
        "goes_to": F.coalesce(F.first("stop", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
                              F.max("last").over(w.rowsBetween(0, Window.unboundedFollowing)))})
    gaps = rows.select(*KEY, F.col("last").alias("_last"), "goes_to", "continued", F.posexplode("spans").alias("pos", "gap")).where(
        "not (continued and pos = 0)")
    gap_end = F.when(F.col("gap.gap_end") == F.col("_last"), F.col("goes_to")).otherwise(F.col("gap.gap_end"))
    out = gaps.select(*KEY, "gap.gap_start", gap_end.alias("gap_end"))
    return out.withColumn("weekdays", weekday_count(F.col("gap_start"), F.col("gap_end")))


def missing_weekdays(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """Each weekday of a request without a price."""
    return _request_months(prices, requests).where("missing <> 0").select(
        *KEY, F.explode(dates.mask_days(F.col("month"), F.col("missing"))).alias("missing_date"))


def coverage_range(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored extent in each request, whether weekdays are missing, and the first one; one aggregate over its months."""
    month = F.col("month")
    out = _request_months(prices, requests).groupBy(*KEY).agg(
        F.min(dates.first_day(month, F.col("stored"))).alias("first_date"), F.max(dates.last_day(month, F.col("stored"))).alias("last_date"),
        F.coalesce(F.sum(F.bit_count("stored")), F.lit(0)).alias("cnt"), F.min(dates.first_day(month, F.col("missing"))).alias("_first"))
    expected = weekday_count(F.col("date_from"), F.col("date_to"))
    return out.withColumn("has_weekday_gaps", (F.col("cnt") > 0) & (F.col("cnt") < expected)).select(
        *KEY, "first_date", "last_date", "cnt", "has_weekday_gaps",
        F.when(F.col("has_weekday_gaps"), F.col("_first")).alias("first_missing_weekday"))


def merge_date_ranges(ranges: DataFrame, by=("symbol",), start: str = "start", end: str = "end") -> DataFrame:
    """Per key, ranges that overlap or touch (next day) become one."""
    by = list(by)
    r = ranges.select(*by, F.col(start).alias("s"), F.col(end).alias("e")).groupBy(*by, "s").agg(F.max("e").alias("e"))
    r = running_max_before(r, by, month_of("s"), ["s"], F.col("e"), "reach")
    opens = F.when(F.col("reach").isNull() | (F.col("s") > F.date_add("reach", 1)), F.col("s"))
    r = running_last(r.drop("_v"), by, month_of("s"), ["s"], opens, "island")
    return r.groupBy(*by, "island").agg(F.max("e").alias(end)).withColumnRenamed("island", start)


def fetch_plan(coverage: DataFrame) -> DataFrame:
    """Ranges to fetch for each row of D5, merged."""
    first, last = F.col("first_date"), F.col("last_date")
    start, end, missing = F.col("date_from"), F.col("date_to"), F.col("first_missing_weekday")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    stale = last.isNotNull() & (end >= last) & (F.datediff(end, last) > 1) & (F.least(first, start) <= end)
    head = F.greatest(start, missing)
    has_head = F.col("has_weekday_gaps") & missing.isNotNull() & (head < F.coalesce(first, end))
    wanted = F.array(F.when(stale, span(F.least(first, start), end)),
                     F.when(has_head, span(head, F.least(F.coalesce(first, end), end))),
                     F.when(first.isNull(), span(start, end)))
    # at most three ranges a row: they are merged where they are
    ranges = F.array_sort(F.filter(wanted, lambda x: x.isNotNull()))

    def join_up(done, x):
        last = F.element_at(done, -1)
        touches = x["start"] <= F.date_add(last["end"], 1)
        longer = F.array(span(last["start"], F.greatest(last["end"], x["end"])))
        return F.when((F.size(done) > 0) & touches, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(
            F.concat(done, F.array(span(x["start"], x["end"]))))

    empty = F.array().cast("array<struct<start:date,end:date>>")
    return coverage.select(*KEY, F.inline(F.aggregate(ranges, empty, join_up)))


# Dates at which availability is probed, and the width of a probe.
PROBES = ["1970-01-01", "1980-01-01", "1990-01-01", "2000-01-01", "2010-01-01"]
PROBE_DAYS = 30


def availability_adjustment(requests: DataFrame, available: DataFrame) -> DataFrame:
    """The earliest probe with data in its window against the requested start.

    Probes are tried in the order listed and the requested start last; they
    stop at the first one past the requested end.
    """
    probes = F.array(*[F.lit(p).cast("date") for p in PROBES], F.col("date_from"))
    p = requests.select("symbol", "date_from", "date_to", F.posexplode(probes).alias("pos", "probe"))
    stop = F.coalesce(F.array_position(F.transform(probes, lambda d: d > F.col("date_to")), True), F.lit(0))
    bound = requests.select("symbol", "date_from", "date_to", stop.alias("stop"))
    key = ["symbol", "date_from", "date_to"]
    p = p.join(bound, key).where("stop = 0 or pos < stop - 1")
    width = PROBE_DAYS
    month = F.explode(F.sequence(F.trunc("probe", "month"), F.trunc(F.date_add("probe", width), "month"), F.expr("interval 1 month")))
    days = available.select("symbol", "date", F.trunc("date", "month").alias("_m"))
    hits = (p.withColumn("_m", month).join(days, ["symbol", "_m"])
            .where(F.col("date").between(F.col("probe"), F.date_add("probe", width)))
            .groupBy(*key).agg(F.min(F.struct("pos", "probe")).alias("hit")))
    out = requests.select(*key).join(hits, key, "left")
    actual = F.coalesce("hit.probe", "date_from")
    status = (F.when(actual > F.col("date_to"), "no_data_in_range").when(actual > F.col("date_from"), "partial_data"))
    return out.select(*key, actual.alias("actual_start"), status.alias("status"))


def availability_start(requests: DataFrame, available: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """D11 by the true first day: the first day there is anything to fetch against the requested start.

    The first day comes from the ticker's months, so that a start between two
    probes is exact. With ``coverage``, the rows of `coverage_range` for the
    same requests, only those are looked up that have no stored day or lack
    weekdays, as a fetch would.
    """
    asked = requests.select(*KEY).distinct()
    if coverage is not None:
        asked = asked.join(coverage.where("first_date is null or has_weekday_gaps").select(*KEY), KEY, "left_semi")
    first = month_masks(available).groupBy("symbol").agg(F.min(dates.first_day(F.col("month"), F.col("mask"))).alias("_first"))
    actual = F.coalesce("_first", "date_from")
    status = F.when(actual > F.col("date_to"), "no_data_in_range").when(actual > F.col("date_from"), "partial_data")
    return asked.join(first, "symbol", "left").select(*KEY, actual.alias("actual_start"), status.alias("status"))


def symbol_date_metadata(symbols: DataFrame, fetched: DataFrame) -> DataFrame:
    """Dates widened by what was fetched, full-history flag set, and what still lacks a full load."""
    facts = fetched.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    out = symbols.join(facts, "symbol", "left")
    full = F.col("has_full_history") | F.col("_a").isNotNull()
    return out.select("symbol", F.least("first_date", "_a").alias("first_date"),
                      F.greatest("last_date", "_b").alias("last_date"), full.alias("has_full_history"),
                      (~F.col("has_full_history")).alias("lacked_full_history"))


def month_end_confirmation(expected: DataFrame, prices: DataFrame, today) -> DataFrame:
    """Which expected tickers have a row on the last business day of the previous month.

    One row per ticker; ``month_end_status`` sums it up.
    """
    target = previous_month_last_business_day(today)
    there = prices.where(F.col("date") == target).select("symbol").distinct().withColumn("_there", F.lit(True))
    return expected.select("symbol").distinct().join(there, "symbol", "left").select(
        "symbol", target.alias("target_date"), F.col("_there").isNotNull().alias("present"))


def month_end_status(confirmation: DataFrame) -> DataFrame:
    """Counts and ``confirmed`` or ``pending``."""
    missing = F.count_if(~F.col("present"))
    return confirmation.groupBy("target_date").agg(
        F.count(F.lit(1)).alias("symbols_expected"), F.count_if(F.col("present")).alias("symbols_present"),
        F.when(missing == 0, "confirmed").otherwise("pending").alias("status"))


def economic_fetch_window(listing: DataFrame, economic: DataFrame, today) -> DataFrame:
    """Next range to fetch per series, and whether there is anything to fetch."""
    facts = economic.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    late = F.col("_a").isNull() | (F.col("_a") > F.lit("1955-01-01").cast("date"))
    start = F.when(late, F.lit("1954-01-01").cast("date")).otherwise(F.date_add("_b", 1))
    return listing.select("symbol").join(facts, "symbol", "left").select(
        "symbol", start.alias("date_from"), today.alias("date_to"), (start <= today).alias("needed"))
