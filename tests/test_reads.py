"""Day masks, factor intervals, deliveries and month-end closes: plain versions, and how often a plan reads its inputs."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from small_tables import SF_DIR

from quotary.functions import dates
from quotary.operators import adjustments, compare, consensus, coverage, merge
from quotary.plans.queries import QUERIES, SPAN
from quotary.sources.fixtures import RANGE, Market


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, SF_DIR)


def now():
    return F.lit("2001-11-05 06:00:00").cast("timestamp")


def same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


@pytest.mark.parametrize(("name", "most"), [("derive_adjusted", 4), ("adjustment_factor", 4), ("dividend_factors", 3), ("coverage_range", 4),
                                            ("missing_ranges", 4), ("fetch_plan", 4), ("momentum_reversal_risk", 6), ("momentum_score", 6)])
def test_scans_planned(market, name, most):
    plan = QUERIES[name](market)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= most


def _requests():
    """Overlapping, adjacent, one-day, weekend-only, reversed and repeated requests of two tickers."""
    rng = random.Random(4)
    out = []
    for symbol in "AB":
        for _ in range(60):
            a = date(2023, 12, 1) + timedelta(rng.randrange(140))
            out.append((symbol, a, a + timedelta(rng.choice([-3, 0, 1, 2, 5, 30, 31, 60, 90]))))
    return out + out[:5] + [("C", date(2024, 1, 6), date(2024, 3, 3)), ("D", date(2024, 1, 6), date(2024, 1, 7)), ("E", date(2024, 2, 29), date(2024, 2, 29))]


def _stored():
    rng = random.Random(5)
    days = [date(2023, 11, 20) + timedelta(i) for i in range(220)]
    out = [("A", d) for d in days if rng.random() < 0.6]
    out += [("B", d) for d in days if d.weekday() < 5 and d.month not in (2, 3) and rng.random() < 0.9]
    return out + [("D", date(2024, 1, 6)), ("E", date(2024, 2, 29))]


@pytest.fixture(scope="module")
def gaps(spark):
    prices = spark.createDataFrame(_stored(), "symbol string, date date")
    return prices, spark.createDataFrame(_requests(), "symbol string, date_from date, date_to date")


def _days(a, b):
    return [a + timedelta(i) for i in range((b - a).days + 1)]


def test_masks_of_months(spark):
    rows = spark.createDataFrame([(date(y, m, 1),) for y in (1999, 2000, 2023, 2024) for m in range(1, 13)], "month date").select(
        "month", dates.mask_days(F.col("month"), dates.weekday_mask(F.col("month"))).alias("days"), dates.weekday_mask(F.col("month")).alias("mask")
    ).withColumns({"first": dates.first_day(F.col("month"), F.col("mask")), "last": dates.last_day(F.col("month"), F.col("mask")),
                   "none": dates.first_day(F.col("month"), F.lit(0).cast("long"))}).collect()
    for r in rows:
        nxt = (r.month + timedelta(31)).replace(day=1)
        want = [d for d in _days(r.month, nxt - timedelta(1)) if d.weekday() < 5]
        assert r.days == want and (r.first, r.last, r.none) == (want[0], want[-1], None)


def test_gaps_of_overlapping_requests(gaps):
    prices, requests = gaps
    stored = {(s, d) for s, d in _stored()}
    ranges, weekdays, facts = {}, {}, {}
    for s, a, b in set(_requests()):
        asked = [d for d in _days(a, b) if d.weekday() < 5]
        there = [d for d in _days(a, b) if (s, d) in stored]
        missing = [d for d in asked if (s, d) not in stored]
        runs = []
        for i, d in enumerate(asked):
            if d in missing:
                if runs and i and runs[-1][1] == asked[i - 1]:
                    runs[-1][1:] = [d, runs[-1][2] + 1]
                else:
                    runs.append([d, d, 1])
        ranges[s, a, b], weekdays[s, a, b] = sorted(map(tuple, runs)), missing
        lacking = 0 < len(there) < len(asked)
        facts[s, a, b] = (min(there, default=None), max(there, default=None), len(there), lacking, missing[0] if lacking and missing else None)
    got = {k: [] for k in ranges}
    for r in coverage.missing_ranges(prices, requests).collect():
        got[r.symbol, r.date_from, r.date_to].append((r.gap_start, r.gap_end, r.weekdays))
    assert {k: sorted(v) for k, v in got.items()} == ranges
    got = {k: [] for k in weekdays}
    for r in coverage.missing_weekdays(prices, requests).collect():
        got[r.symbol, r.date_from, r.date_to].append(r.missing_date)
    assert {k: sorted(v) for k, v in got.items()} == weekdays
    got = {(r.symbol, r.date_from, r.date_to): tuple(r)[3:] for r in coverage.coverage_range(prices, requests).collect()}
    assert got == facts
    assert any(len(v) > 4 for v in ranges.values()) and any(n > 25 for v in ranges.values() for *_, n in v)


def test_first_available_day_between_probes(spark):
    requests = spark.createDataFrame([(s, date(1999, 12, 20), date(2001, 1, 1)) for s in "ABCD"], "symbol string, date_from date, date_to date")
    available = spark.createDataFrame([("A", date(2000, 5, 17)), ("A", date(2000, 6, 1)), ("B", date(2003, 2, 3)), ("D", date(1985, 7, 1))], "symbol string, date date")
    got = {r.symbol: (r.actual_start, r.status) for r in coverage.availability_start(requests, available).collect()}
    assert got == {"A": (date(2000, 5, 17), "partial_data"), "B": (date(2003, 2, 3), "no_data_in_range"),
                   "C": (date(1999, 12, 20), None), "D": (date(1985, 7, 1), None)}
    stored = spark.createDataFrame([("D", d) for d in _days(date(1999, 12, 20), date(2001, 1, 1))] + [("A", date(2000, 6, 1))], "symbol string, date date")
    gated = coverage.availability_start(requests, available, coverage.coverage_range(stored, requests))
    assert {r.symbol for r in gated.collect()} == {"A", "B", "C"}


def test_delivery_gives_what_a_full_refresh_gives(market):
    """Raw rows, events and bars: an earlier refresh with the delivery's changes merged in is the refresh over everything."""
    landed = market.raw_changes.where("symbol in ('S1', 'S4', 'S7')")
    actions = market.corporate_events.where("symbol in ('S4', 'S8') and event_type in ('dividend', 'split')").select(
        "symbol", F.date_sub("event_date", 40).alias("event_date"), "event_type", (F.col("dividend_amount") * 2).cast("decimal(18,8)").alias("dividend_amount"),
        "split_ratio", F.lit(None).cast("date").alias("ex_date"), F.lit(None).cast("date").alias("record_date"),
        F.lit(None).cast("date").alias("pay_date"), F.lit("eodhd").alias("source"))
    known = actions.withColumn("event_date", F.date_add("event_date", 40)).withColumn("dividend_amount", F.lit(0.25).cast("decimal(18,8)"))
    actions = actions.unionByName(known)
    empty = landed.limit(0), actions.limit(0)
    before = consensus.raw_price_refresh(market.prices_raw, empty[0], market.corporate_events, empty[1], market.prices, *RANGE, now())
    after = consensus.raw_price_refresh(before.raw, landed, before.events, actions, before.prices.drop("change"), *RANGE, now())
    changes = consensus.refresh_changes(before.raw, landed, before.events, actions, *RANGE, now())
    for old, new, change, key in ((before.derived, after.derived, changes.derived, ["symbol", "date"]), (before.raw, after.raw, changes.raw, ["symbol", "date", "source"]),
                                  (before.events, after.events, changes.events.drop("change"), ["symbol", "event_date", "event_type"])):
        change = change.cache()
        assert same(old.join(change, key, "left_anti").unionByName(change.select(old.columns)), new)
        assert 0 < change.count() < new.count() / 2
    assert not same(before.derived, after.derived)
    assert same(changes.alerts.select("symbol", "date"), after.alerts.join(landed.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi").select("symbol", "date"))


def test_one_aggregate_agrees_with_the_three_steps(market):
    raw = market.prices_raw
    plain = consensus.collapse_raw(consensus.apply_consensus(raw, consensus.consensus_close(raw)), *SPAN)
    days = consensus.agreed_days(raw)
    assert same(days.where("consensus_close is not null").select(plain.columns), plain)
    assert same(days.where("agreed_close is null").select("symbol", "date", "closes"), consensus.consensus_alerts(consensus.consensus_close(raw)))
    cleared = consensus.collapse_raw(consensus.apply_consensus(raw, consensus.consensus_close(raw), clear_stale=True), *SPAN)
    assert same(consensus.agreed_days(raw, clear_stale=True).where("consensus_close is not null").select(plain.columns), cleared)


def test_intervals_cover_each_day_once(market):
    days = consensus.agreed_days(market.prices_raw).where("consensus_close is not null")
    events = consensus.confirmed_events(market.corporate_events)
    spans = consensus.factor_intervals(days, events)
    assert spans.where("since >= until").isEmpty()
    bounds = spans.groupBy("symbol", "month").agg(F.min("since").alias("a"), F.max("until").alias("b"), F.sum(F.datediff("until", "since")).alias("n"))
    assert bounds.where("a <> month or b <> add_months(month, 1) or n <> datediff(b, a)").isEmpty()
    assert consensus.adjustment_factor(days, events).count() == days.count()


@pytest.mark.parametrize("first", [True, False])
def test_month_end_scores_are_those_of_the_grid(market, first):
    prices = market.prices if first else market.reference_prices.where("close > 20")
    want = compare.momentum_score(prices, compare.momentum_targets(prices, (1, 3, 6, 12)))
    assert same(compare.month_end_momentum(prices), want)


def test_deletions_are_counted_as_they_are_made(market):
    asked = market.symbols.select("symbol", F.lit("1997-01-01").cast("date").alias("date_from"), F.lit(None).cast("date").alias("date_to"))
    asked = asked.unionByName(asked.where("symbol < 'S3'").withColumn("date_to", F.lit("1998-01-01").cast("date"))).where("symbol like 'S%'")
    left = merge.delete_prices_by(market.prices, asked)
    assert merge.deleted_count(market.prices, asked).agg(F.sum("deleted")).collect()[0][0] == market.prices.count() - left.count()


def _price_scans(df):
    """The scans of line items that prices are computed from; events read other columns of theirs."""
    plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return [x for x in plan if "FileScan" in x and "l_shipdate" in x and "l_discount" not in x]


@pytest.mark.parametrize("name", ["adjustment_factor", "derive_adjusted", "fix_plan"])
def test_prices_computed_once(market, name):
    assert not _price_scans(QUERIES[name](market))


@pytest.mark.parametrize("name", ["scan_summary", "record_events", "fix_plan"])
def test_scan_reads_written_days(market, name, monkeypatch):
    seen, detect = [], adjustments.detect_adjustments

    def spy(symbols, prices, reference, *rest, **named):
        seen.extend([prices, reference])
        return detect(symbols, prices, reference, *rest, **named)

    monkeypatch.setattr(adjustments, "detect_adjustments", spy)
    QUERIES[name](market)
    assert len(seen) == 2 and not any(_price_scans(df) for df in seen)


def test_shared_days_are_the_same(market):
    assert same(market.shared.prices, market.prices) and same(market.shared.prices_raw, market.prices_raw)


def test_touched_tickers_are_written(market):
    kept = []

    def store(df):
        kept.append(df.columns)
        return df

    consensus.refresh_changes(market.prices_raw, market.raw_changes, market.corporate_events, market.corporate_events.select(
        "symbol", "event_date", "event_type", "dividend_amount", "split_ratio", "ex_date", "record_date", "pay_date",
        F.lit("eodhd").alias("source")), *RANGE, now(), store=store)
    assert ["symbol"] in kept


def test_months_without_events_carry_no_days(spark):
    days = spark.createDataFrame([("A", date(2024, 1, 2), 1.0), ("A", date(2024, 1, 9), 2.0), ("A", date(2024, 3, 4), 4.0)],
                                 "symbol string, date date, consensus_close double")
    events = spark.createDataFrame([("A", "dividend", date(2024, 3, 1), 1.0, None)],
                                   "symbol string, event_type string, ex_date date, dividend_amount double, split_ratio double")
    months = {r.month: r for r in consensus._months(days, events).collect()}
    assert months[date(2024, 1, 1)].days is None and months[date(2024, 3, 1)].before.close == 2.0
    assert {r.date: r.factor for r in consensus.adjustment_factor(days, events).collect()} == {
        date(2024, 1, 2): 0.5, date(2024, 1, 9): 0.5, date(2024, 3, 4): 1.0}


def test_consensus_of_merged_rows_reads_few_columns_and_matches_once(spark):
    text = "symbol string, date date, source string, open double, high double, low double, close double, volume long, fetched_at timestamp"
    at, d = datetime(2024, 1, 3), date(2024, 1, 2)
    raw = spark.createDataFrame([("A", d, "x", 1.0, 1.0, 1.0, 1.0, 5, at, None), ("A", d, "x", 1.0, 1.0, 1.0, 1.5, 6, at, 7.0),
                                 ("A", d, "y", 1.0, 1.0, 1.0, 2.0, 7, at, None), (None, d, "x", 1.0, 1.0, 1.0, 1.0, 8, at, None)],
                                f"{text}, consensus_close double")
    landed = spark.createDataFrame([("A", d, "x", 3.0, 3.0, 3.0, 2.005, None, at), ("A", d, "z", 3.0, 3.0, 3.0, 9.0, 1, at),
                                    (None, d, "x", 3.0, 3.0, 3.0, 3.0, 2, at)], text)
    merged = merge.upsert_raw(raw, landed)
    got = sorted(((r.symbol or "", r.source, r.close, r.volume or 0, r.consensus_close or 0.0, r.change) for r in merged.collect()))
    assert got == [("", "x", 1.0, 8, 0.0, "unchanged"), ("", "x", 3.0, 2, 0.0, "inserted"), ("A", "x", 2.005, 0, 0.0, "updated"),
                   ("A", "x", 2.005, 0, 7.0, "updated"), ("A", "y", 2.0, 7, 0.0, "unchanged"), ("A", "z", 9.0, 1, 0.0, "inserted")]
    days = consensus.agreed_days(merged.drop("change"))
    assert {r.symbol: r.agreed_close for r in days.collect()} == {None: None, "A": 2.003333}
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    stored_side = lines[next(i for i, line in enumerate(lines) if "Join FullOuter" in line) + 1]
    assert plan.count("abs(") == 1 and "close#" in stored_side and "open#" not in stored_side
