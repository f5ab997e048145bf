"""Landed vendor payloads to rows.

A payload table has one row per landed response: ``symbol`` and the response
text. ``read_payloads`` builds it from files named after the symbol. A row of a
price payload is either a raw price or a reject with its reason; an ingest is
the first, ``vendor_rejects`` the second of one parse.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.functions.numbers import reported_number
from quotary.functions.tickers import vendor_supported

_NUMBER = "string"  # vendors send numbers as numbers or as text
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("symbol"), F.col("value").alias("payload"))


def _calendar_day(col) -> Column:
    """Date part of an ISO date or time stamp, as written (no zone shift); null for any other text."""
    iso = F.col(col) if isinstance(col, str) else col
    return F.when(iso.rlike(_ISO), F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd"))


@dataclass(frozen=True)
class Payload:
    """How a vendor spells a daily row: its source name, the fields, and the member that holds the rows, if any."""

    source: str
    day: str
    open: str
    high: str
    low: str
    close: str
    volume: str
    within: str | None = None

    @property
    def schema(self) -> str:
        row = "struct<" + ",".join(f"{c}:string" for c in (self.day, self.open, self.high, self.low, self.close, self.volume)) + ">"
        return f"struct<{self.within}:array<{row}>>" if self.within else f"array<{row}>"


EOD = Payload("eodhd", "date", "open", "high", "low", "close", "volume")
ISO = Payload("tiingo", "date", "open", "high", "low", "close", "volume")
BARS = Payload("alpaca", "t", "o", "h", "l", "c", "v", within="bars")


def parsed_rows(payloads: DataFrame, kind: Payload) -> DataFrame:
    """Every row of every payload, once: the values of a raw price, the row's text, and why it cannot be used (``reason``, else null).

    Reasons, the first that holds: ``unsupported`` (the vendor does not cover
    the ticker), ``payload`` (no JSON, or not of this shape; one row per
    response), ``day``, ``price`` (one of the four is missing or no number) and
    ``volume`` (neither empty nor a number; an empty one is 0). A response
    without rows has none.
    """
    parsed = F.from_json("payload", kind.schema)
    rows = payloads.withColumn("_rows", parsed[kind.within] if kind.within else parsed)
    broken = F.col("payload").isNull() | F.try_parse_json("payload").isNull()
    if kind.within is None:
        broken = broken | F.col("_rows").isNull()
    rows = rows.select("symbol", F.when(broken, F.coalesce("payload", F.lit(""))).alias("_broken"), "_rows")
    # a row for a broken response is put into the list: a filter on lists would be pushed down and parse every response again
    none = F.expr("coalesce(cardinality(_rows), 0) < 1")
    listed = F.when(F.col("_broken").isNotNull() & none, F.array_repeat(F.lit(None), 1)).otherwise(F.col("_rows"))
    rows = rows.select("symbol", "_broken", F.explode(listed).alias("_row"))
    item = lambda c: F.col("_row")[getattr(kind, c)]
    prices = {c: item(c).try_cast("decimal(18,6)") for c in ("open", "high", "low", "close")}
    volume = F.when(F.coalesce(item("volume"), F.lit("")) == "", 0.0).otherwise(item("volume").try_cast("double"))
    rows = rows.select("symbol", _calendar_day(item("day")).alias("date"), F.lit(kind.source).alias("source"),
                       *[v.alias(c) for c, v in prices.items()], volume.alias("_volume"), "_broken",
                       F.coalesce("_broken", F.to_json("_row"), F.lit("null")).alias("text"))
    reason = (F.when(~vendor_supported(F.lit(kind.source), F.col("symbol")), "unsupported").when(F.col("_broken").isNotNull(), "payload")
              .when(F.col("date").isNull(), "day")
              .when(F.greatest(*[F.col(c).isNull() for c in prices]), "price")
              .when(F.col("_volume").isNull() | F.isnan("_volume"), "volume"))
    return rows.select("symbol", "date", "source", *prices, F.col("_volume").try_cast("bigint").alias("volume"), "text", reason.alias("reason"))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("text", "reason")


def vendor_rejects(payloads: DataFrame, kind: Payload) -> DataFrame:
    """The rows that an ingest leaves out: symbol, source, day where it can be read, reason and text."""
    return parsed_rows(payloads, kind).where("reason is not null").select("symbol", "source", "date", "reason", "text")


def ingest_vendor_eod(payloads: DataFrame) -> DataFrame:
    """A2: JSON array of daily rows."""
    return _usable(parsed_rows(payloads, EOD))


def ingest_vendor_iso(payloads: DataFrame) -> DataFrame:
    """A3: JSON array of daily rows dated by ISO timestamps."""
    return _usable(parsed_rows(payloads, ISO))


def ingest_vendor_bars(payloads: DataFrame) -> DataFrame:
    """A4: one object with a ``bars`` array of short-named rows; no bars, no rows."""
    return _usable(parsed_rows(payloads, BARS))


def union_raw_sources(*sources: DataFrame) -> DataFrame:
    """A5: the vendors' rows together, without pairs a vendor does not cover."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out.where(vendor_supported(F.col("source"), F.col("symbol")))


def parse_economic_observations(observations: DataFrame) -> DataFrame:
    """Text observations to (symbol, date, value); ``.`` and unreadable rows are dropped."""
    day = F.expr("try_to_date(date, 'yyyy-MM-dd')")
    rows = observations.withColumns({"date": day, "value": F.col("value").try_cast("double")})
    return rows.where("date is not null and value is not null")


def _either(first: str, second: str) -> Column:
    """``first or second`` where an empty text or a zero counts as absent."""
    a = F.col(first)
    empty = a.isNull() | (a == "") | F.coalesce(a.try_cast("double") == 0, F.lit(False))
    return F.when(empty, F.col(second)).otherwise(a)


def parse_corporate_actions(dividends: DataFrame, splits: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """Dividend and split payloads to confirmed actions; rows that are not numbers go to the second frame."""
    cash = f"array<struct<date:string,ex_date:string,value:{_NUMBER},amount:{_NUMBER}>>"
    parts = f"array<struct<date:string,ex_date:string,split:{_NUMBER},ratio:{_NUMBER}>>"
    div = dividends.select("symbol", F.inline(F.from_json("payload", cash))).select(
        "symbol", "date", "ex_date", F.lit("dividend").alias("event_type"), _either("value", "amount").alias("text"))
    spl = splits.select("symbol", F.inline(F.from_json("payload", parts))).select(
        "symbol", "date", "ex_date", F.lit("split").alias("event_type"), _either("split", "ratio").alias("text"))
    first_date = F.when(F.coalesce("ex_date", F.lit("")) == "", F.col("date")).otherwise(F.col("ex_date"))
    number = reported_number(F.col("text"))
    rows = (div.unionByName(spl)
            .withColumns({"ex_date": _calendar_day(first_date), "amount": number})
            .where(F.col("ex_date") <= today)
            .where(F.col("text").isNotNull() & ~F.col("text").isin("", "NA", "N/A")))
    actions = rows.where("amount is not null").select(
        "symbol", F.col("ex_date").alias("event_date"), "event_type",
        F.when(F.col("event_type") == "dividend", F.col("amount")).cast("decimal(18,8)").alias("dividend_amount"),
        F.when(F.col("event_type") == "split", F.col("amount")).cast("decimal(18,8)").alias("split_ratio"),
        "ex_date", F.lit(None).cast("date").alias("record_date"), F.lit(None).cast("date").alias("pay_date"),
        F.lit("eodhd").alias("source"))
    rejects = rows.where("amount is null").select("symbol", "ex_date", "event_type", "text")
    return actions, rejects


def extract_inline_events(quotes: DataFrame) -> DataFrame:
    """Splits and dividends carried in a quote frame's action columns."""
    both = quotes.select("symbol", "date", F.inline(F.array(
        F.struct(F.lit("split").alias("kind"), F.col("Stock Splits").cast("double").alias("number")),
        F.struct(F.lit("dividend").alias("kind"), F.col("Dividends").cast("double").alias("number")))))
    both = both.where("number is not null and not isnan(number) and number <> 0")
    is_split = F.col("kind") == "split"
    kind = F.when(is_split & (F.col("number") >= 1), "stock_split").when(is_split, "reverse_split").otherwise("dividend")
    return both.select("symbol", "date", kind.alias("event_type"),
                       F.when(is_split, F.col("number")).alias("ratio"),
                       F.when(~is_split, F.col("number")).alias("amount"))
