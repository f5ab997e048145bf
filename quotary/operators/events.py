"""Corporate-event queries (H1-H5)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.operators.scale import seek, with_row


def _filtered(events: DataFrame, symbol=None, event_type=None, status=None, start=None, end=None) -> DataFrame:
    if symbol:
        events = events.where(F.col("symbol") == symbol)
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    if status:
        events = events.where(F.col("status") == status)
    if start is not None:
        events = events.where(F.col("event_date") >= F.lit(start).cast("date"))
    if end is not None:
        events = events.where(F.col("event_date") <= F.lit(end).cast("date"))
    return events


def events_listing(events: DataFrame, page: int = 1, page_size: int = 50, **filters) -> DataFrame:
    """H1: one page, newest detection first, with the total."""
    rows = _filtered(events, **filters)
    order = [F.desc("detected_at"), F.col("id")]
    part = rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return with_row(part, rows.agg(F.count(F.lit(1)).alias("total"))).orderBy(*order)


def events_listing_after(events: DataFrame, after=None, page_size: int = 50, **filters) -> DataFrame:
    """H1 by seek: the page that follows the event with the key ``after`` (detected_at, id)."""
    return seek(_filtered(events, **filters), [("detected_at", True), ("id", False)], page_size, after)


def events_by_symbol(events: DataFrame, symbol: str) -> DataFrame:
    """H2."""
    return events.where(F.col("symbol") == symbol).orderBy(F.desc("event_date"), "id")


def pending_events(events: DataFrame) -> DataFrame:
    """H3: neither fixed nor ignored; events without a status do not count."""
    return events.where("status <> 'fixed' and status <> 'ignored'").orderBy(F.desc("detected_at"), "id")


def dividend_calendar(events: DataFrame, start=None, end=None, symbol=None) -> DataFrame:
    """H4."""
    rows = events.where(F.col("event_type").isin("dividend", "special_dividend"))
    return _filtered(rows, symbol=symbol, start=start, end=end).orderBy(F.desc("event_date"), "id")


def split_history(events: DataFrame, start=None, end=None, symbol=None) -> DataFrame:
    """H5."""
    rows = events.where(F.col("event_type").isin("stock_split", "reverse_split"))
    return _filtered(rows, symbol=symbol, start=start, end=end).orderBy(F.desc("event_date"), "id")
