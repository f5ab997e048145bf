"""Raw vendor closes to consensus closes to adjusted prices."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.numbers import within_tolerance
from quotary.operators.merge import upsert_confirmed_events, upsert_prices, upsert_raw
from quotary.operators.scale import month_of
from quotary.schemas import KEYS, TOLERANCE, TOLERANCE_SLACK


def majority_close(values: Column, tolerance: float = TOLERANCE) -> Column:
    """Mean of the closes near the first anchor that has company, null if none has.

    ``values`` is an array of (source, close) structs ordered by source.
    """
    closes = values["close"]
    near = lambda a: F.filter(closes, lambda v: F.abs(v - a) <= F.lit(tolerance) + F.lit(TOLERANCE_SLACK))
    matches = F.filter(F.transform(closes, near), lambda m: F.size(m) >= 2)
    # a list of the first match alone: named by a lambda, it is worked out once for the sum and the count
    mean = lambda m: F.round(F.aggregate(m, F.lit(0.0), lambda acc, v: acc + v) / F.size(m), 6)
    return F.get(F.transform(F.slice(matches, 1, 1), mean), F.lit(0))


def consensus_close(raw: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """one row per (symbol, date) with the closes by source and their consensus.

    The key (symbol, date, source) bounds a group by the number of vendors.
    """
    value = F.struct("source", F.col("close").cast("double").alias("close"))
    grouped = raw.groupBy("symbol", "date").agg(F.sort_array(F.collect_list(value)).alias("closes"))
    return grouped.withColumn("consensus_close", majority_close(F.col("closes"), tolerance))


def consensus_alerts(consensus: DataFrame) -> DataFrame:
    """days on which no two sources agree, with what they said."""
    return consensus.where("consensus_close is null").select("symbol", "date", "closes")


def apply_consensus(raw: DataFrame, consensus: DataFrame, clear_stale: bool = False) -> DataFrame:
    """write the consensus to every source row of its day.

    Where sources no longer agree the stored value stays, unless ``clear_stale``.
    """
    c = consensus.select("symbol", "date", F.col("consensus_close").cast("decimal(18,6)").alias("_c"))
    value = F.col("_c") if clear_stale else F.coalesce("_c", "consensus_close")
    columns = [value.alias("consensus_close") if n == "consensus_close" else F.col(n) for n in raw.columns]
    return raw.join(c, ["symbol", "date"], "left").select(*columns)


def between(rows: DataFrame, start=None, end=None, day: str = "date") -> DataFrame:
    if start is not None:
        rows = rows.where(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(day) <= F.lit(end).cast("date"))
    return rows


def collapse_raw(raw: DataFrame, start=None, end=None) -> DataFrame:
    """consensus and volume per (symbol, date) in the range."""
    rows = between(raw.where("consensus_close is not null"), start, end)
    return rows.groupBy("symbol", "date").agg(F.max("consensus_close").cast("double").alias("consensus_close"),
                                              F.max("volume").alias("volume"))


def agreed_days(raw: DataFrame, tolerance: float = TOLERANCE, clear_stale: bool = False) -> DataFrame:
    """F1, F3 and F4 in one aggregate per (symbol, date): what the sources say, their consensus, and the collapsed row.

    ``agreed_close`` is the consensus of these rows, ``consensus_close`` and
    ``volume`` what `collapse_raw` finds once `apply_consensus` has written it;
    they are null on a day that never had one. Nothing is joined back.
    """
    value = F.struct("source", F.col("close").cast("double").alias("close"))
    kept = F.lit(None).cast("decimal(18,6)") if clear_stale else F.col("consensus_close")
    days = raw.groupBy("symbol", "date").agg(
        F.sort_array(F.collect_list(value)).alias("closes"), F.max(kept).alias("_kept"), F.max("volume").alias("_all"),
        F.max(F.when(kept.isNotNull(), F.col("volume"))).alias("_some"))
    days = days.withColumn("agreed_close", majority_close(F.col("closes"), tolerance))
    return days.select("symbol", "date", "closes", "agreed_close",
                       F.coalesce(F.col("agreed_close").cast("decimal(18,6)"), "_kept").cast("double").alias("consensus_close"),
                       F.when(F.col("agreed_close").isNotNull(), F.col("_all")).otherwise(F.col("_some")).alias("volume"))


def confirmed_events(events: DataFrame, end=None) -> DataFrame:
    """Confirmed splits and dividends with a usable number, up to ``end``."""
    rows = events.where("confirmed_at is not null")
    if end is not None:
        rows = rows.where(F.col("ex_date") <= F.lit(end).cast("date"))
    split = (F.col("event_type") == "split") & (F.coalesce("split_ratio", F.lit(0)) != 0)
    cash = (F.col("event_type") == "dividend") & (F.coalesce("dividend_amount", F.lit(0)) != 0)
    return rows.where(split | cash).select(
        "symbol", "event_type", "ex_date", F.col("dividend_amount").cast("double").alias("dividend_amount"),
        F.col("split_ratio").cast("double").alias("split_ratio"))


def _months(collapsed: DataFrame, events: DataFrame) -> DataFrame:
    """Per (symbol, month) its events and, if it has any, its days, in order, and the last day before the month.

    A month has at most 31 days, and the window runs over months, so no list
    and no partition grows beyond the calendar. Each input is read once.
    """
    days = collapsed.select("symbol", month_of("date").alias("month"), F.struct("date", F.col("consensus_close").alias("close")).alias("day"))
    moves = events.where("ex_date is not null").select("symbol", month_of("ex_date").alias("month"), F.struct(
        "ex_date", "event_type", "dividend_amount", "split_ratio").alias("event"))
    months = days.unionByName(moves, allowMissingColumns=True).groupBy("symbol", "month").agg(
        F.array_sort(F.collect_list("day")).alias("days"), F.array_sort(F.collect_list("event")).alias("events"))
    # the days of a month without events are read no more: only its last one goes on to the window
    months = months.withColumns({"_last": F.try_element_at("days", F.lit(-1)), "days": F.when(F.size("events") > 0, F.col("days"))})
    earlier = Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return months.withColumn("before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")


def _previous(event: Column) -> Column:
    """The last day of the month, or before it, strictly before the event."""
    return F.coalesce(F.try_element_at(F.filter("days", lambda d: d["date"] < event["ex_date"]), F.lit(-1)), F.col("before"))


def _cash_factor(amount: Column, close: Column) -> Column:
    return F.when(F.coalesce(close, F.lit(0.0)) <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - amount / close))


def dividend_factors(collapsed: DataFrame, events: DataFrame) -> DataFrame:
    """price factor of each dividend from the last consensus close before its ex date."""
    cash = events.where("event_type = 'dividend'")
    rows = _months(collapsed, cash).select("symbol", F.inline(F.transform("events", lambda e: F.struct(
        e["event_type"].alias("event_type"), e["ex_date"].alias("ex_date"), e["dividend_amount"].alias("dividend_amount"),
        e["split_ratio"].alias("split_ratio"), _previous(e).alias("prev")))))
    rows = rows.select("symbol", "event_type", "ex_date", "dividend_amount", "split_ratio", F.col("prev.date").alias("prev_date"),
                       F.col("prev.close").alias("prev_close"))
    return rows.withColumn("factor", _cash_factor(F.col("dividend_amount"), F.col("prev_close")))


def factor_at(trade_date: Column, close: Column, events: Column) -> Column:
    """F6 on an array of events, newest first: splits divide, dividends multiply.

    An event is (event_type, ex_date, dividend_amount, split_ratio, factor); a
    dividend without a factor uses the row's own close.
    """
    def step(acc, e):
        own = F.greatest(F.lit(0.0), 1.0 - e["dividend_amount"] / close)
        split = (e["event_type"] == "split") & (F.coalesce(e["split_ratio"], F.lit(0.0)) != 0)
        cash = (e["event_type"] == "dividend") & (F.coalesce(e["dividend_amount"], F.lit(0.0)) != 0)
        return F.when(split, acc / e["split_ratio"]).when(cash, acc * F.coalesce(e["factor"], own)).otherwise(acc)

    return F.aggregate(F.filter(events, lambda e: trade_date < e["ex_date"]), F.lit(1.0), step)


def factor_intervals(collapsed: DataFrame, events: DataFrame) -> DataFrame:
    """the factor that holds in each half-open range of days, cut by month: (symbol, month, since, until, factor).

    The factor before an ex date is the product of all events from that date
    on. A day's factors are multiplied by size, days from the last one back:
    the result does not depend on how rows arrive. The window runs over one row
    per month and per ex date of a ticker.
    """
    def step(e: Column) -> Column:
        cash = _cash_factor(e["dividend_amount"], _previous(e)["close"])
        return F.struct(e["ex_date"].alias("ex_date"), F.when(e["event_type"] == "split", 1.0 / e["split_ratio"]).otherwise(cash).alias("step"))

    months = _months(collapsed, events).select("symbol", "month", F.array_sort(F.transform("events", step)).alias("steps"))
    daily = F.transform(F.array_distinct(F.transform("steps", lambda s: s["ex_date"])), lambda d: F.struct(
        d.alias("ex_date"), F.aggregate(F.filter("steps", lambda s: s["ex_date"] == d), F.lit(1.0), lambda a, s: a * s["step"]).alias("step")))
    rows = months.select("symbol", "month", F.inline_outer(daily))
    back = Window.partitionBy("symbol").orderBy(F.desc("month"), F.desc("ex_date"))
    step = F.coalesce("step", F.lit(1.0))
    rows = rows.select(
        "symbol", "month", "ex_date", F.product(step).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("factor"),
        F.coalesce(F.product(step).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("later"),
        (F.lag("month").over(back) == F.col("month")).alias("same"),
        F.when(F.lead("month").over(back) == F.col("month"), F.lead("ex_date").over(back)).alias("older"))
    span = lambda a, b, f: F.struct(a.alias("since"), b.alias("until"), f.alias("factor"))
    month, ex = F.col("month"), F.col("ex_date")
    up_to = F.when(ex > F.coalesce("older", month), span(F.coalesce("older", month), ex, F.col("factor")))
    after = F.when(~F.coalesce("same", F.lit(False)), span(F.coalesce(ex, month), F.add_months(month, 1), F.col("later")))
    return rows.select("symbol", "month", F.inline(F.array_compact(F.array(up_to, after))))


def adjustment_factor(collapsed: DataFrame, events: DataFrame) -> DataFrame:
    """the factor of each collapsed row; 1 from the last ex date on. Rows meet intervals by ticker and month."""
    rows = collapsed.withColumn("month", month_of("date"))
    return (rows.join(factor_intervals(collapsed, events), ["symbol", "month"])
            .where("date >= since and date < until").select(*collapsed.columns, "factor"))


def adjusted_bars(collapsed: DataFrame, events: DataFrame, now) -> DataFrame:
    """flat adjusted bars of collapsed rows and usable events."""
    rows = adjustment_factor(collapsed.select("symbol", "date", "consensus_close", "volume"), events)
    close = F.col("consensus_close") * F.col("factor")
    return rows.select("symbol", "date", *[close.alias(c) for c in ("open", "high", "low", "close")],
                       F.coalesce("volume", F.lit(0)).alias("volume"),
                       F.lit("raw_consensus_events").alias("source"), now.alias("last_updated"))


def derive_adjusted(raw: DataFrame, events: DataFrame, start, end, now) -> DataFrame:
    """flat adjusted bars from the consensus closes."""
    return adjusted_bars(collapse_raw(raw, start, end), confirmed_events(events, end), now)


@dataclass
class Refresh:
    """Outcome of one refresh."""

    raw: DataFrame
    confirmed: DataFrame
    alerts: DataFrame
    events: DataFrame
    derived: DataFrame
    prices: DataFrame


def raw_price_refresh(raw: DataFrame, landed: DataFrame, events: DataFrame, actions: DataFrame, prices: DataFrame,
                      start, end, now, tolerance: float = TOLERANCE,
                      store: Callable[[DataFrame], DataFrame] = lambda df: df) -> Refresh:
    """F8: merge landed rows, agree on closes, confirm actions, derive adjusted prices, merge them.

    Only rows of the range are merged for the consensus, one row per ticker
    and day comes out, and ``store`` is applied to it, since several results
    read it; pass one that writes and reads back. The new raw table is a frame
    of its own that nothing else reads.
    """
    inside = upsert_raw(between(raw, start, end), between(landed, start, end)).drop("change")
    days = store(agreed_days(inside, tolerance))
    consensus = days.select("symbol", "date", "closes", F.col("agreed_close").alias("consensus_close"))
    known = upsert_confirmed_events(events, actions, now).drop("change")
    derived = adjusted_bars(days.where("consensus_close is not null"), confirmed_events(known, end), now)
    return Refresh(raw=apply_consensus(upsert_raw(raw, landed).drop("change"), consensus),
                   confirmed=consensus.where("consensus_close is not null"),
                   alerts=consensus_alerts(consensus), events=known, derived=derived,
                   prices=upsert_prices(prices, derived, force=True))


@dataclass
class RefreshChanges:
    """What one delivery changes: rows to merge into the raw, event and price tables, and days without agreement."""

    raw: DataFrame
    alerts: DataFrame
    events: DataFrame
    derived: DataFrame


def _moved_events(events: DataFrame, known: DataFrame, end) -> DataFrame:
    """(symbol, cutoff): the last ex date up to ``end``, old or new, among a ticker's new and changed events."""
    key = KEYS["corporate_events"]
    old = events.select(*key, F.col("ex_date").alias("_old"))
    usable = lambda c: F.when(F.col(c) <= F.lit(end).cast("date"), F.col(c))
    return (known.where("change <> 'unchanged'").select(*key, "ex_date").join(old, key, "left")
            .select("symbol", F.greatest(usable("ex_date"), usable("_old")).alias("cutoff")).where("cutoff is not null"))


def refresh_changes(raw: DataFrame, landed: DataFrame, events: DataFrame, actions: DataFrame, start, end, now,
                    tolerance: float = TOLERANCE, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> RefreshChanges:
    """F8 for one delivery: only what its rows and actions can change is computed.

    A landed row changes its own day, and all days before a dividend whose
    factor rests on that day's close; a new or changed event changes the days
    before its ex date. Raw rows and events are cut down to the tickers that
    this touches by semi-joins, adjusted bars to the affected days. Merged into
    the result of an earlier refresh of the same range they give that of
    `raw_price_refresh` over everything. ``store`` is applied to what several
    results read: the events of the delivery's tickers, their cutoffs, the
    touched tickers, and their days. Spark knows the size of a written list of
    tickers, and need not shuffle the raw table to cut it down to a short one.
    """
    arrived = between(landed, start, end)
    days_in = arrived.select("symbol", "date").distinct()
    tickers = actions.select("symbol").distinct()
    known = store(upsert_confirmed_events(events.join(tickers, "symbol", "left_semi"), actions, now))
    moved = store(_moved_events(events, known, end).groupBy("symbol").agg(F.max("cutoff").alias("cutoff")))
    touched = store(days_in.select("symbol").unionByName(moved.select("symbol")).distinct())

    def own(rows: DataFrame) -> DataFrame:
        return rows.join(touched, "symbol", "left_semi")

    merged = upsert_raw(own(between(raw, start, end)), arrived).drop("change")
    days = store(agreed_days(merged, tolerance))
    collapsed = days.where("consensus_close is not null")
    usable = confirmed_events(known.drop("change").unionByName(events.join(tickers, "symbol", "left_anti")), end)
    usable = own(usable)
    rested = dividend_factors(collapsed, usable).join(
        days_in.withColumnRenamed("date", "prev_date"), ["symbol", "prev_date"], "left_semi").select("symbol", F.col("ex_date").alias("cutoff"))
    cutoffs = moved.unionByName(rested).groupBy("symbol").agg(F.max("cutoff").alias("cutoff"))
    bars = (adjusted_bars(collapsed, usable, now).join(cutoffs, "symbol", "left")
            .join(days_in.withColumn("_in", F.lit(True)), ["symbol", "date"], "left"))
    derived = bars.where("_in or date < cutoff").drop("_in", "cutoff")
    of_day = days.join(days_in, ["symbol", "date"], "left_semi")
    consensus = of_day.select("symbol", "date", "closes", F.col("agreed_close").alias("consensus_close"))
    rows = upsert_raw(raw.join(days_in, ["symbol", "date"], "left_semi"), arrived).drop("change")
    late = landed.where(~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    outside = upsert_raw(raw.join(late.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi"), late).drop("change")
    return RefreshChanges(raw=apply_consensus(rows, consensus).unionByName(outside), alerts=consensus_alerts(consensus),
                          events=known.where("change <> 'unchanged'"), derived=derived)


def refresh_counts(refresh: Refresh) -> DataFrame:
    """F8: confirmed days, alerts and derived rows."""
    parts = [("confirmed", refresh.confirmed), ("alerts", refresh.alerts), ("derived", refresh.derived)]
    out = None
    for name, df in parts:
        one = df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def verify_two_sources(symbols: DataFrame, raw: DataFrame, day, primary: str = "eodhd", verifier: str = "tiingo",
                       tolerance: float = TOLERANCE) -> DataFrame:
    """per ticker the two sources' closes on a day and whether they agree, with the reason if not."""
    on_day = raw.where(F.col("date") == day)
    closes = on_day.where(F.col("source").isin(primary, verifier)).groupBy("symbol").agg(
        F.max(F.when(F.col("source") == primary, F.col("close").cast("double"))).alias("primary_close"),
        F.max(F.when(F.col("source") == verifier, F.col("close").cast("double"))).alias("verifier_close"))
    out = symbols.select("symbol").distinct().join(closes, "symbol", "left")
    p, v = F.col("primary_close"), F.col("verifier_close")
    state = lambda c: F.when(c.isNull(), "missing").otherwise("ok")
    absent = p.isNull() | v.isNull()
    status = F.when(absent, "unverified").when(~within_tolerance(p, v, tolerance), "mismatch").otherwise("ok")
    out = out.withColumns({"diff": F.abs(p - v), "status": status})
    reason = (F.when(absent, F.concat("symbol", F.lit(f": source unavailable {primary}="), state(p),
                                      F.lit(f" {verifier}="), state(v)))
              .when(F.col("status") == "mismatch", F.concat(
                  "symbol", F.lit(f": {primary}/{verifier} close diff "), F.format_string("%.4f", "diff"),
                  F.lit(f" > {tolerance:.4f}"))))
    return out.select("symbol", day.alias("date"), "primary_close", "verifier_close", "diff", "status",
                      reason.alias("reason"))


def verification_status(comparisons: DataFrame) -> DataFrame:
    """``success`` or ``alert`` over all tickers of a day."""
    bad = F.count_if(F.col("status") != "ok")
    return comparisons.groupBy("date").agg(
        F.count(F.lit(1)).alias("symbols_checked"), F.count_if(F.col("status") == "mismatch").alias("mismatches"),
        F.count_if(F.col("status") == "unverified").alias("unverified"),
        F.when(bad == 0, "success").otherwise("alert").alias("status"))
