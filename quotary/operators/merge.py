"""Table-level writes (E1-E10): old table and changes in, new table out.

The results carry a ``change`` column (``inserted``, ``updated``,
``unchanged``), so exact counts are one aggregate away. Writing is
copy-on-write: never overwrite the path the plan reads.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.operators.clean import normalize_price_rows
from quotary.operators.prices import ROW
from quotary.schemas import KEYS

VALUES = [c for c in ROW if c not in ("symbol", "date")]


def _latest(rows: DataFrame, key, stamp: str, values) -> DataFrame:
    """One incoming row per key: the newest, ties by value."""
    ranked = F.struct(stamp, *[c for c in values if c != stamp])
    return rows.groupBy(*key).agg(F.max(ranked).alias("r")).select(*key, "r.*").select(*key, *values)


def _merge(old: DataFrame, new: DataFrame, key, values, wins) -> DataFrame:
    """Full outer join on the key; ``wins`` decides whether the new values replace the old ones."""
    o = old.select(*key, F.struct(*values).alias("o"))
    n = new.select(*key, F.struct(*values).alias("n"))
    both = o.join(n, key, "full_outer")
    take = F.col("n").isNotNull() & (F.col("o").isNull() | wins)
    change = (F.when(F.col("o").isNull(), "inserted").when(take, "updated").otherwise("unchanged"))
    return both.select(*key, F.when(take, F.col("n")).otherwise(F.col("o")).alias("r"), change.alias("change")).select(
        *key, "r.*", "change")


def upsert_prices(prices: DataFrame, incoming: DataFrame, force: bool = False, now: Column | None = None) -> DataFrame:
    """Replace a stored bar only by a strictly newer one, or always with ``force``."""
    key = KEYS["prices"]
    rows = _latest(normalize_price_rows(incoming, now), key, "last_updated", VALUES)
    newer = F.lit(True) if force else F.col("o.last_updated") < F.col("n.last_updated")
    return _merge(prices, rows, key, VALUES, newer)


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def upsert_raw(raw: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite the vendor's values, keep the consensus.

    Values meet column by column, so that only those that are read later are
    shuffled and sorted.
    """
    key = KEYS["prices_raw"]
    values = ["open", "high", "low", "close", "volume", "fetched_at"]
    n = _latest(incoming, key, "fetched_at", values).select(*key, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_n"))
    o = raw.select(*key, *values, "consensus_close", F.lit(True).alias("_o"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNotNull(), "updated").otherwise("unchanged")
    merged = [F.when(F.col("_n").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return both.select(*key, *merged, "consensus_close", change.alias("change"))


def upsert_economic(economic: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite value and time stamp."""
    key, values = KEYS["economic_indicators"], ["value", "last_updated"]
    return _merge(economic, _latest(incoming, key, "last_updated", values), key, values, F.lit(True))


def event_id() -> Column:
    """The id of a new event, from its key alone: the same in every run, and above the counted ids of older rows."""
    key = F.concat_ws("|", "symbol", F.date_format("event_date", "yyyy-MM-dd"), "event_type")
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def upsert_confirmed_events(events: DataFrame, actions: DataFrame, now) -> DataFrame:
    """E5: confirm vendor actions; the columns a vendor does not know survive."""
    key = KEYS["corporate_events"]
    best = F.max(F.struct("dividend_amount", "split_ratio", F.coalesce("ex_date", "event_date").alias("ex_date"),
                          "record_date", "pay_date", "source")).alias("n")
    n = actions.groupBy(*key).agg(best)
    both = events.join(n, key, "full_outer")
    has = F.col("n").isNotNull()
    fresh = {
        "dividend_amount": F.col("n.dividend_amount"), "split_ratio": F.col("n.split_ratio"),
        "amount": F.col("n.dividend_amount").cast("decimal(18,4)"),
        "ratio": F.col("n.split_ratio").cast("decimal(38,6)"),
        "ex_date": F.col("n.ex_date"), "record_date": F.col("n.record_date"), "pay_date": F.col("n.pay_date"),
        "confirmed_at": now, "source_count": F.lit(1),
        "sources_json": F.array(F.struct(F.col("n.source").alias("source"))),
        "status": F.lit("confirmed"), "updated_at": now,
    }
    new_row = has & F.col("detected_at").isNull()
    defaults = {"id": event_id(), "currency": F.lit("USD"), "detection_method": F.lit("auto"), "detected_at": now, "created_at": now}
    out = both.withColumn("change", F.when(new_row, "inserted").when(has, "updated").otherwise("unchanged"))
    columns = []
    for c in events.columns:
        if c in key:
            columns.append(F.col(c))
        elif c in fresh:
            columns.append(F.when(has, fresh[c]).otherwise(F.col(c)).alias(c))
        elif c in defaults:
            columns.append(F.when(new_row, defaults[c]).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns, "change")


def record_events(events: DataFrame, detected: DataFrame, now) -> DataFrame:
    """Add detected events whose key is new; one row per key.

    ``detected`` has the columns of ``classify_deviation`` (G4). A split's
    ratio is its cumulative factor, a dividend's amount the total, else the
    special dividend.
    """
    is_split = F.col("event_type").isin("stock_split", "reverse_split")
    is_cash = F.col("event_type").isin("dividend", "special_dividend")
    details = [c for c in detected.columns if c not in ("symbol", "check_date", "event_type", "severity", "recommendation")]
    rows = detected.select(
        "symbol", F.col("check_date").alias("event_date"), "event_type", "severity",
        F.when(is_split, F.col("cumulative_factor")).cast("decimal(38,6)").alias("ratio"),
        F.when(is_cash, F.coalesce("total_dividends", "special_dividend")).cast("decimal(18,4)").alias("amount"),
        F.col("stored_close").cast("decimal(18,4)").alias("db_price_at_detection"),
        F.col("reference_close").cast("decimal(18,4)").alias("yf_price_at_detection"),
        F.col("pct_difference").cast("decimal(18,6)").alias("pct_difference"),
        F.col("recommendation").alias("notes"), F.to_json(F.struct(*details)).alias("source_data"))
    key = KEYS["corporate_events"]
    one = rows.groupBy(*key).agg(F.max(F.struct(*[c for c in rows.columns if c not in key])).alias("r")).select(*key, "r.*")
    fresh = one.join(events.select(*key), key, "left_anti").withColumns({
        "id": event_id(), "currency": F.lit("USD"), "detection_method": F.lit("auto"), "status": F.lit("detected"),
        "detected_at": now, "created_at": now, "updated_at": now})
    return events.withColumn("change", F.lit("unchanged")).unionByName(
        fresh.withColumn("change", F.lit("inserted")), allowMissingColumns=True)


def delete_prices(prices: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    """The table without one ticker's rows, in a range if given."""
    from quotary.functions.tickers import normalize_symbol

    gone = F.col("symbol") == normalize_symbol(F.lit(symbol))
    if start is not None:
        gone = gone & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        gone = gone & (F.col("date") <= F.lit(end).cast("date"))
    return prices.where(~gone)


def _asked_away() -> Column:
    return ((F.col("p.symbol") == F.col("d.symbol"))
            & (F.col("d.date_from").isNull() | (F.col("p.date") >= F.col("d.date_from")))
            & (F.col("d.date_to").isNull() | (F.col("p.date") <= F.col("d.date_to"))))


def delete_prices_by(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """E7 for many requests (symbol, date_from, date_to; open ends are null) in one pass."""
    return prices.alias("p").join(requests.alias("d"), _asked_away(), "left_anti")


def deleted_count(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """How many rows per ticker ``delete_prices_by`` takes away."""
    gone = prices.select("symbol", "date").alias("p").join(requests.alias("d"), _asked_away(), "left_semi")
    return gone.groupBy("symbol").agg(F.count(F.lit(1)).alias("deleted"))


def register_symbols(symbols: DataFrame, names: DataFrame, now) -> DataFrame:
    """Add unknown tickers as active ones."""
    fresh = (names.select("symbol").distinct().join(symbols.select("symbol"), "symbol", "left_anti")
             .withColumns({"is_active": F.lit(True), "has_full_history": F.lit(False), "created_at": now}))
    return symbols.withColumn("change", F.lit("unchanged")).unionByName(
        fresh.withColumn("change", F.lit("inserted")), allowMissingColumns=True)


def set_active_symbols(symbols: DataFrame, keep: DataFrame) -> DataFrame:
    """Exactly the listed tickers become active."""
    listed = keep.select("symbol").distinct().withColumn("_keep", F.lit(True))
    return symbols.join(listed, "symbol", "left").withColumn("is_active", F.col("_keep").isNotNull()).drop("_keep")


def deactivate_symbols(symbols: DataFrame, drop: DataFrame) -> DataFrame:
    """The listed tickers become inactive."""
    listed = drop.select("symbol").distinct().withColumn("_drop", F.lit(True))
    return (symbols.join(listed, "symbol", "left")
            .withColumn("is_active", F.when(F.col("_drop"), False).otherwise(F.col("is_active"))).drop("_drop"))


def symbols_not_found(symbols: DataFrame, names: DataFrame) -> DataFrame:
    return names.select("symbol").distinct().join(symbols.select("symbol"), "symbol", "left_anti")


def event_status_update(events: DataFrame, actions: DataFrame, now) -> DataFrame:
    """Apply (id, action, reason) with action confirm, ignore, fixing, fixed or failed.

    Actions may also carry the fix itself: job_id and rows_deleted. Of several
    actions on one event the last by the column ``at`` counts, if there is one,
    else the last by name.
    """
    fix = {"job_id": "fix_job_id", "rows_deleted": "rows_deleted"}
    given = {c: kept for c, kept in fix.items() if c in actions.columns}
    order = [c for c in ("at",) if c in actions.columns]
    last = actions.groupBy("id").agg(F.max(F.struct(*order, "action", "reason", *given)).alias("r"))
    a = last.select("id", "r.action", "r.reason", *[F.col(f"r.{c}").alias(f"_{c}") for c in given])
    status = (F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "ignore", "ignored")
              .otherwise(F.col("action")))
    note = F.when(F.col("action") == "ignore",
                  F.when(F.coalesce("reason", F.lit("")) == "", "Ignored").otherwise(
                      F.concat(F.lit("Ignored: "), F.col("reason"))))
    hit = F.col("action").isNotNull()
    out = events.join(a, "id", "left").withColumns({
        "status": F.when(hit, status).otherwise(F.col("status")),
        "notes": F.coalesce(note, "notes"),
        "fixed_at": F.when(F.col("action") == "fixed", now).otherwise(F.col("fixed_at")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        **{kept: F.coalesce(f"_{c}", kept) for c, kept in given.items()}})
    return out.select(*events.columns)
