"""Price reads.

Small inputs (change table, request lists) are joined without a broadcast
hint: Spark broadcasts them by their measured size and sort-merges otherwise.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.functions.tickers import normalize_symbol
from quotary.operators.scale import asof_join, with_row
from quotary.schemas import MAX_ROWS_FETCH, MAX_ROWS_LOCAL

ROW = ["symbol", "date", "open", "high", "low", "close", "volume", "source", "last_updated"]


def _wanted(df: DataFrame, symbols, column: str = "symbol") -> DataFrame:
    """Rows for a list of tickers, or for the tickers of a frame; all rows if ``symbols`` is None."""
    if symbols is None:
        return df
    if isinstance(symbols, DataFrame):
        names = symbols.select(F.col("symbol").alias(column)).distinct()
        return df.join(names, column, "left_semi")
    return df.where(F.col(column).isin(list(symbols)))


def _between(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def prices_range(prices: DataFrame, symbols, start, end) -> DataFrame:
    """Rows of the tickers in the range, by ticker and day."""
    rows = _between(_wanted(prices, symbols), start, end)
    return rows.select(*ROW, F.lit(None).cast("string").alias("source_symbol")).orderBy("symbol", "date")


def prices_resolved(prices: DataFrame, changes: DataFrame, symbols, start, end) -> DataFrame:
    """C1 plus the history under the old name of a renamed ticker.

    Keys make the two branches disjoint and free of repeats: (symbol, date)
    in prices, one row per new name in changes. So no DISTINCT is needed.
    """
    rows = _between(prices.select(*ROW), start, end)
    since = changes.select(F.col("new_symbol").alias("symbol"), "change_date")
    own = (_wanted(rows, symbols).join(since, "symbol", "left")
           .where("change_date is null or date >= change_date")
           .select(*ROW, F.lit(None).cast("string").alias("source_symbol")))
    before = _wanted(changes, symbols, "new_symbol").select(
        F.col("old_symbol").alias("symbol"), "new_symbol", "change_date")
    old = rows.join(before, "symbol").where("date < change_date").select(
        F.col("new_symbol").alias("symbol"), *ROW[1:], F.col("symbol").alias("source_symbol"))
    return own.unionByName(old)


def symbol_segments(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Each request as one or two (ticker in use, from, to) segments."""
    c = changes.select("old_symbol", "new_symbol", "change_date")
    names = (c.select(F.explode(F.array("old_symbol", "new_symbol")).alias("symbol"), F.struct("*").alias("hit"))
             .groupBy("symbol").agg(F.min(F.struct("hit.change_date", "hit.old_symbol", "hit.new_symbol")).alias("hit")))
    day = F.col("hit.change_date")
    segment = lambda s, a, b: F.struct(s.alias("actual_symbol"), a.alias("seg_from"), b.alias("seg_to"))
    start, end = F.col("date_from"), F.col("date_to")
    parts = F.when(day.isNull(), F.array(segment(F.col("symbol"), start, end))).otherwise(F.array(
        segment(F.col("hit.old_symbol"), start, F.least(end, F.date_sub(day, 1))),
        segment(F.col("hit.new_symbol"), F.greatest(start, day), end)))
    joined = requests.join(names, "symbol", "left")
    return (joined.select(*requests.columns, "hit", F.inline(parts))
            .where("hit is null or seg_from <= seg_to").drop("hit"))


def serve_prices(prices: DataFrame, changes: DataFrame, symbols: DataFrame, start, end, today) -> DataFrame:
    """C4: C2 for distinct tickers up to today, by day and ticker."""
    last = F.least(F.lit(end).cast("date"), F.lit(today).cast("date"))
    wanted = symbols.select("symbol").distinct()
    return prices_resolved(prices, changes, wanted, start, last).orderBy("date", "symbol")


def response_limits(rows: DataFrame) -> DataFrame:
    """C4: row count of a response against the two limits."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n_rows"), (n > MAX_ROWS_FETCH).alias("over_fetch_limit"),
                    (n > MAX_ROWS_LOCAL).alias("over_local_limit"))


def price_count(prices: DataFrame) -> DataFrame:
    """Rows, first and last day per ticker."""
    return prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("min_date"),
                                        F.max("date").alias("max_date"))


def list_symbols(symbols: DataFrame, active: bool | None = None) -> DataFrame:
    """C6."""
    rows = symbols if active is None else symbols.where(F.col("is_active") == active)
    return rows.select("symbol", "name", "exchange", "currency", "is_active", "first_date", "last_date").orderBy("symbol")


def closest_price_before(prices: DataFrame, targets: DataFrame, on: str = "target_date") -> DataFrame:
    """Last price strictly before each (symbol, target)."""
    rows = prices.select("symbol", F.col("date").alias("price_date"), "close")
    return asof_join(targets, rows, ["symbol"], on, "price_date", ["price_date", "close"], strict=True)


def price_series_before(prices: DataFrame, cutoff) -> DataFrame:
    """(date, close) before a cutoff."""
    return prices.where(F.col("date") < cutoff).select("symbol", "date", "close").orderBy("symbol", "date")


def recent_close_arrays(prices: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The last ``days`` days of closes per ticker, at most one entry per day by key."""
    rows = prices.where((F.col("date") >= F.date_sub(as_of, days)) & (F.col("date") <= as_of))
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("closes"))


def symbol_registration_plan(requests: DataFrame, symbols: DataFrame, listing: DataFrame) -> DataFrame:
    """Every requested ticker as existing, new (in the listing) or failed."""
    wanted = requests.select("raw").distinct().withColumn("symbol", normalize_symbol(F.col("raw")))
    have = symbols.select("symbol", F.lit(True).alias("_have"))
    valid = listing.select("symbol").distinct().withColumn("_valid", F.lit(True))
    out = wanted.join(have, "symbol", "left").join(valid, "symbol", "left")
    outcome = F.when(F.col("_have"), "existing").when(F.col("_valid"), "new").otherwise("failed")
    return out.select("raw", "symbol", outcome.alias("outcome"),
                      F.when(outcome == "failed", "validation").alias("error"))


def renamed_symbol_exists(requests: DataFrame, changes: DataFrame, prices: DataFrame) -> DataFrame:
    """C11: has the ticker a rename to it, has it any price."""
    new_names = changes.select(F.col("new_symbol").alias("symbol")).distinct().withColumn("_c", F.lit(True))
    priced = prices.select("symbol").distinct().withColumn("_p", F.lit(True))
    return (requests.select("symbol").distinct().join(new_names, "symbol", "left").join(priced, "symbol", "left")
            .select("symbol", F.col("_c").isNotNull().alias("has_change"), F.col("_p").isNotNull().alias("has_prices")))


def table_health(symbols: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of totals."""
    s = symbols.agg(F.count(F.lit(1)).alias("total_symbols"), F.count_if(F.col("is_active")).alias("active_symbols"),
                    F.count_if(~F.col("is_active")).alias("inactive_symbols"))
    p = (prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
         .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_price_records"),
              F.count(F.lit(1)).alias("symbols_with_data"),
              F.min("a").alias("earliest_date"), F.max("b").alias("latest_date")))
    return with_row(s, p)


def recent_activity(prices: DataFrame, as_of, days: int = 30, k: int = 10) -> DataFrame:
    """The ``k`` tickers with most rows in the last ``days`` days."""
    recent = prices.where(F.col("date") >= F.date_sub(as_of, days))
    return (recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("record_count"), F.min("date").alias("first_date"),
                                         F.max("date").alias("last_date"))
            .orderBy(F.desc("record_count"), "symbol").limit(k))


def economic_series_info(economic: DataFrame, listing: DataFrame) -> DataFrame:
    """Each listed series with its extent; empty series show 0 rows."""
    facts = economic.groupBy("symbol").agg(F.min("date").alias("data_start"), F.max("date").alias("data_end"),
                                           F.count("date").alias("row_count"),
                                           F.max("last_updated").alias("last_updated"))
    return listing.join(facts, "symbol", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def economic_range(economic: DataFrame, series, start=None, end=None, descending: bool = False,
                   limit: int | None = None) -> DataFrame:
    """C14: one series in order, with the range that is returned; at most ``limit`` rows if one is given."""
    day = F.col("date").desc() if descending else F.col("date").asc()
    rows = _between(economic.where(F.col("symbol") == F.upper(F.lit(series))), start, end)
    if limit is not None:
        rows = rows.orderBy(day).limit(limit)
    extent = rows.agg(F.min("date").alias("range_from"), F.max("date").alias("range_to"))
    return with_row(rows, extent).select(
        "symbol", "date", "value", "last_updated", "range_from", "range_to").orderBy(day)


def economic_latest(economic: DataFrame) -> DataFrame:
    """Newest row per series."""
    newest = F.max(F.struct("date", "value", "last_updated")).alias("r")
    return economic.groupBy("symbol").agg(newest).select("symbol", "r.*")
