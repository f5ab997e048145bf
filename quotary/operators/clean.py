"""Row cleaning, validation and request checks."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.functions.tickers import normalize_symbol, stripped
from quotary.schemas import (EVENT_STATUSES, EVENT_TYPES, INTERVALS, MAX_SYMBOLS_FETCH, MAX_SYMBOLS_LOCAL, PRIORITIES,
                             SEVERITIES)

OHLC = ["open", "high", "low", "close"]
_QUOTE_NAMES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close",
                "Volume": "volume"}


def parse_symbol_list(requests: DataFrame, key: str = "request_id", text: str = "symbols") -> DataFrame:
    """A10: comma list to one row per distinct ticker, in order of first appearance."""
    items = requests.select(key, F.posexplode(F.split(text, ",")).alias("pos", "item"))
    items = items.where(stripped("item") != "").select(key, "pos", normalize_symbol(F.col("item")).alias("symbol"))
    firsts = items.groupBy(key, "symbol").agg(F.min("pos").alias("pos"))
    sizes = firsts.groupBy(key).agg(F.count(F.lit(1)).alias("n_symbols"))
    return firsts.join(sizes, key).select(
        key, "symbol", "pos", "n_symbols",
        (F.col("n_symbols") > MAX_SYMBOLS_FETCH).alias("over_fetch_limit"),
        (F.col("n_symbols") > MAX_SYMBOLS_LOCAL).alias("over_local_limit"))


def clean_quote_frame(quotes: DataFrame) -> DataFrame:
    """Lower-case names, no adjusted close; empty if a required column is absent."""
    df = quotes.withColumnsRenamed(_QUOTE_NAMES).drop("adj_close")
    complete = {*OHLC, "volume"} <= set(df.columns)
    return df if complete else df.where(F.lit(False))


def _present(cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _whole_volume(df: DataFrame) -> Column:
    """Volume truncated to a whole number; null where it is none."""
    if df.schema["volume"].dataType.typeName() in ("double", "float"):
        return F.when(~F.isnan("volume"), F.col("volume").try_cast("bigint"))
    return F.col("volume").try_cast("bigint")


def _widened(df: DataFrame) -> DataFrame:
    return df.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})


def clean_ohlcv(df: DataFrame, source: Column | None = None, last_updated: Column | None = None) -> DataFrame:
    """Complete, positive bars only; high and low widened to hold open and close."""
    ok = _present(OHLC)
    for c in OHLC:
        ok = ok & ~F.isnan(c) & (F.col(c) > 0)
    out = _widened(df.where(ok).withColumn("volume", _whole_volume(df)).where("volume >= 0"))
    if source is not None:
        out = out.withColumn("source", source)
    return out if last_updated is None else out.withColumn("last_updated", last_updated)


def normalize_price_rows(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows fit for an upsert; prices at or below zero pass, as do missing optional columns.

    An open or close that is not a number becomes the bar's high; a bar whose
    high or low is none is dropped.
    """
    casts = {c: F.col(c).try_cast("double") for c in OHLC}
    out = df.withColumns(casts).withColumn("volume", _whole_volume(df))
    out = out.where(_present(["symbol", "date", *OHLC, "volume"]) & (F.col("volume") >= 0)
                    & ~F.isnan("high") & ~F.isnan("low"))
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("open", "close")})
    out = _widened(out)
    out = out.withColumns({c: F.coalesce(c, "high") for c in ("open", "close")})
    source = F.coalesce("source", F.lit("yfinance")) if "source" in df.columns else F.lit("yfinance")
    stamp = now if now is not None else F.current_timestamp()
    updated = F.coalesce("last_updated", stamp) if "last_updated" in df.columns else stamp
    return out.withColumns({"source": source, "last_updated": updated}).select(
        "symbol", "date", *OHLC, "volume", "source", "last_updated")


_BAR_RULES = {
    "nonpositive_price": "open <= 0 or high <= 0 or low <= 0 or close <= 0",
    "low_above_body": "low > least(open, close)",
    "high_below_body": "high < greatest(open, close)",
    "negative_volume": "volume < 0",
}


def _outside(col: str, domain) -> str:
    return f"{col} not in ({', '.join(repr(v) for v in domain)})"


RULES = {
    "prices": _BAR_RULES,
    "prices_raw": _BAR_RULES,
    "corporate_events": {
        "event_type": _outside("event_type", EVENT_TYPES),
        "status": _outside("status", EVENT_STATUSES),
        "severity": _outside("severity", SEVERITIES),
    },
}


def validate_relation(df: DataFrame, rules: dict, key=(), symbols: DataFrame | None = None,
                      required=()) -> DataFrame:
    """Adds ``reasons``, the sorted names of the rules a row breaks; empty means accepted.

    Rules are SQL conditions that hold for *bad* rows. As with check
    constraints a condition that is null does not reject. The duplicate count
    is an aggregate joined back, so a repeated key does not form one window.
    """
    out = df
    flags = {name: F.coalesce(F.expr(cond), F.lit(False)) for name, cond in rules.items()}
    for c in required:
        flags[f"null_{c}"] = F.col(c).isNull()
    if key:
        repeated = df.groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("_dup"))
        out = out.join(repeated, list(key), "left")
        flags["duplicate_key"] = F.coalesce("_dup", F.lit(False))
    if symbols is not None:
        known = symbols.select("symbol").distinct().withColumn("_known", F.lit(True))
        out = out.join(known, "symbol", "left")
        flags["unknown_symbol"] = F.col("_known").isNull()
    reasons = F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]),
                                    lambda r: r.isNotNull()))
    return out.withColumn("reasons", reasons).select(*df.columns, "reasons")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0)


def range_outcome(start, end, today) -> Column:
    """Reason code of a date range; ``very_old_date`` is only a warning, null is fine."""
    return (F.when(start > end, "start_after_end").when(end > today, "future_date")
            .when(start < F.date_sub(today, 365 * 20), "very_old_date"))


def job_request_outcome(today) -> Column:
    """First rule a job request breaks, null if it may run. Symbols first, then the dates, then the domains."""
    wrong = F.exists("symbols", lambda s: ~F.upper(s).rlike(r"^[\^A-Z0-9.-]{1,20}$"))
    return (F.when(F.size("symbols") > 100, "too_many_symbols")
            .when(F.size("symbols") == 0, "no_symbols")
            .when(wrong, "bad_symbol")
            .when(F.col("date_from") < F.date_sub(today, 7300), "from_too_old")
            .when(F.col("date_to") < F.col("date_from"), "to_before_from")
            .when(F.col("date_to") > today, "to_in_future")
            .when(F.datediff("date_to", "date_from") > 3650, "range_too_long")
            .when(~F.col("interval").isin(INTERVALS), "bad_interval")
            .when(~F.col("priority").isin(PRIORITIES), "bad_priority"))


def validate_request_ranges(requests: DataFrame, today) -> DataFrame:
    """Both outcomes next to each request."""
    return requests.withColumns({"range_outcome": range_outcome(F.col("date_from"), F.col("date_to"), today),
                                 "job_outcome": job_request_outcome(today)})


def safe_end(as_of) -> Column:
    """Last day whose close is final at ``as_of``: yesterday from 21:00 to 08:00 in Tokyo, else today."""
    hour = F.hour(F.from_utc_timestamp(as_of, "Asia/Tokyo"))
    return F.date_sub(as_of.cast("date"), F.when((hour >= 21) | (hour < 8), 1).otherwise(0))


def exclude_open_session(df: DataFrame, as_of) -> DataFrame:
    return df.where(F.col("date") <= safe_end(as_of))
