"""Declared schemas and value domains of the relations."""

from pyspark.sql import types as T

_OHLC_DOUBLE = [T.StructField(c, T.DoubleType(), False) for c in ("open", "high", "low", "close")]
_OHLC_DECIMAL = [T.StructField(c, T.DecimalType(18, 6), False) for c in ("open", "high", "low", "close")]


def _f(name, kind, nullable=True):
    return T.StructField(name, kind, nullable)


SYMBOLS = T.StructType([
    _f("symbol", T.StringType(), False),
    _f("name", T.StringType()),
    _f("exchange", T.StringType()),
    _f("currency", T.StringType()),
    _f("is_active", T.BooleanType()),
    _f("has_full_history", T.BooleanType(), False),
    _f("first_date", T.DateType()),
    _f("last_date", T.DateType()),
    _f("created_at", T.TimestampType(), False),
])

SYMBOL_CHANGES = T.StructType([
    _f("old_symbol", T.StringType(), False),
    _f("new_symbol", T.StringType(), False),
    _f("change_date", T.DateType(), False),
    _f("reason", T.StringType()),
])

PRICES = T.StructType([
    _f("symbol", T.StringType(), False),
    _f("date", T.DateType(), False),
    *_OHLC_DOUBLE,
    _f("volume", T.LongType(), False),
    _f("source", T.StringType(), False),
    _f("last_updated", T.TimestampType(), False),
])

PRICES_RAW = T.StructType([
    _f("symbol", T.StringType(), False),
    _f("date", T.DateType(), False),
    _f("source", T.StringType(), False),
    *_OHLC_DECIMAL,
    _f("volume", T.LongType(), False),
    _f("fetched_at", T.TimestampType(), False),
    _f("consensus_close", T.DecimalType(18, 6)),
])

EVENT_SOURCES = T.ArrayType(T.StructType([_f("source", T.StringType())]))

CORPORATE_EVENTS = T.StructType([
    _f("id", T.LongType(), False),
    _f("symbol", T.StringType(), False),
    _f("event_date", T.DateType(), False),
    _f("event_type", T.StringType(), False),
    _f("ratio", T.DecimalType(38, 6)),
    _f("amount", T.DecimalType(18, 4)),
    _f("dividend_amount", T.DecimalType(18, 8)),
    _f("split_ratio", T.DecimalType(18, 8)),
    _f("currency", T.StringType()),
    _f("ex_date", T.DateType()),
    _f("record_date", T.DateType()),
    _f("pay_date", T.DateType()),
    _f("confirmed_at", T.TimestampType()),
    _f("source_count", T.IntegerType()),
    _f("sources_json", EVENT_SOURCES),
    _f("detected_at", T.TimestampType(), False),
    _f("detection_method", T.StringType()),
    _f("db_price_at_detection", T.DecimalType(18, 4)),
    _f("yf_price_at_detection", T.DecimalType(18, 4)),
    _f("pct_difference", T.DecimalType(18, 6)),
    _f("severity", T.StringType()),
    _f("status", T.StringType()),
    _f("fixed_at", T.TimestampType()),
    _f("fix_job_id", T.StringType()),
    _f("rows_deleted", T.LongType()),
    _f("rows_refetched", T.LongType()),
    _f("source_data", T.StringType()),
    _f("notes", T.StringType()),
    _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

ECONOMIC = T.StructType([
    _f("symbol", T.StringType(), False),
    _f("date", T.DateType(), False),
    _f("value", T.DoubleType()),
    _f("last_updated", T.TimestampType(), False),
])

JOB_RESULT = T.StructType([
    _f("symbol", T.StringType()),
    _f("status", T.StringType()),
    _f("rows_fetched", T.LongType()),
    _f("error", T.StringType()),
])

FETCH_JOBS = T.StructType([
    _f("job_id", T.StringType(), False),
    _f("status", T.StringType(), False),
    _f("symbols", T.ArrayType(T.StringType()), False),
    _f("date_from", T.DateType(), False),
    _f("date_to", T.DateType(), False),
    _f("interval", T.StringType(), False),
    _f("force_refresh", T.BooleanType(), False),
    _f("priority", T.StringType(), False),
    _f("progress", T.StringType()),
    _f("results", T.ArrayType(JOB_RESULT)),
    _f("errors", T.StringType()),
    _f("created_at", T.TimestampType(), False),
    _f("started_at", T.TimestampType()),
    _f("completed_at", T.TimestampType()),
    _f("created_by", T.StringType()),
])

RELATIONS = {
    "symbols": SYMBOLS,
    "symbol_changes": SYMBOL_CHANGES,
    "prices": PRICES,
    "prices_raw": PRICES_RAW,
    "corporate_events": CORPORATE_EVENTS,
    "economic_indicators": ECONOMIC,
    "fetch_jobs": FETCH_JOBS,
}

KEYS = {
    "symbols": ["symbol"],
    "symbol_changes": ["old_symbol", "change_date"],
    "prices": ["symbol", "date"],
    "prices_raw": ["symbol", "date", "source"],
    "corporate_events": ["symbol", "event_date", "event_type"],
    "economic_indicators": ["symbol", "date"],
    "fetch_jobs": ["job_id"],
}

# Enum domains, limits and tolerances of the data model.
EVENT_TYPES = [
    "stock_split", "reverse_split", "dividend", "special_dividend",
    "capital_gain", "spinoff", "unknown",
    "split",  # written by the raw-price refresh
]
EVENT_STATUSES = ["detected", "confirmed", "fixing", "fixed", "ignored", "failed"]
SEVERITIES = ["critical", "high", "normal", "low"]
INTERVALS = ["1d", "1wk", "1mo", "3mo"]
PRIORITIES = ["low", "normal", "high"]
RAW_SOURCES = ["eodhd", "tiingo", "alpaca"]
TOLERANCE = 0.01
TOLERANCE_SLACK = 1e-9
MAX_SYMBOLS_FETCH = 10
MAX_SYMBOLS_LOCAL = 100
MAX_ROWS_FETCH = 50_000
MAX_ROWS_LOCAL = 400_000
