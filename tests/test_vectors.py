"""Small literal cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quotary.functions import dates, numbers
from quotary.operators import adjustments, clean, consensus, coverage, prices
from quotary.sources import vendors


def D(text):
    return date.fromisoformat(text)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def day(text):
    return F.lit(text).cast("date")


def raw(spark, closes, symbol="SPY", on="2026-06-30"):
    rows = [(symbol, D(on), s, c) for s, c in closes.items()]
    return spark.createDataFrame(rows, "symbol string, date date, source string, close double")


@pytest.mark.parametrize("closes, expected", [
    ({"eodhd": 109.07, "tiingo": 109.071, "alpaca": 109.20}, 109.0705),
    ({"eodhd": 109.07, "tiingo": 109.20, "alpaca": 109.40}, None),
    ({"eodhd": 109.07}, None),
    ({"alpaca": 1.00, "eodhd": 1.01, "tiingo": 1.02}, 1.005),  # the anchor is the first source, not the middle one
])
def test_consensus(spark, closes, expected):
    row = consensus.consensus_close(raw(spark, closes), 0.01).first()
    assert row["consensus_close"] == expected
    assert len(row["closes"]) == len(closes)
    assert consensus.consensus_alerts(consensus.consensus_close(raw(spark, closes))).count() == (expected is None)


def test_consensus_reaches_every_source_and_keeps_stale_values(spark):
    rows = raw(spark, {"eodhd": 10.0, "tiingo": 10.0, "alpaca": 12.0}).unionByName(
        raw(spark, {"eodhd": 1.0, "tiingo": 2.0}, on="2026-07-01"))
    rows = rows.withColumn("consensus_close", F.lit(9).cast("decimal(18,6)"))
    c = consensus.consensus_close(rows)
    kept = {(r["date"], float(r["consensus_close"])) for r in consensus.apply_consensus(rows, c).collect()}
    assert kept == {(D("2026-06-30"), 10.0), (D("2026-07-01"), 9.0)}
    cleared = consensus.apply_consensus(rows, c, clear_stale=True).where("date = '2026-07-01'").collect()
    assert all(r["consensus_close"] is None for r in cleared)


def test_actions_only_up_to_today(spark):
    div = spark.createDataFrame([("SPY", '[{"date":"2026-06-01","value":0.25},{"date":"2026-08-01","value":0.30},'
                                  '{"date":"2026-06-02","value":"N/A"},{"date":"2026-06-03","value":0,"amount":0.5},'
                                  '{"date":"2026-06-04","value":"oops"}]')], "symbol string, payload string")
    spl = spark.createDataFrame([("SPY", '[{"date":"2026-06-15","split":2.0}]')], "symbol string, payload string")
    actions, rejects = vendors.parse_corporate_actions(div, spl, day("2026-07-05"))
    got = {(r["event_type"], r["ex_date"], float(r["dividend_amount"] or r["split_ratio"])) for r in actions.collect()}
    assert got == {("dividend", D("2026-06-01"), 0.25), ("dividend", D("2026-06-03"), 0.5), ("split", D("2026-06-15"), 2.0)}
    assert [r["text"] for r in rejects.collect()] == ["oops"]


def events_frame(spark, rows):
    return spark.createDataFrame(
        [(s, k, D(d), a, r, datetime(2026, 1, 1)) for s, k, d, a, r in rows],
        "symbol string, event_type string, ex_date date, dividend_amount double, split_ratio double, confirmed_at timestamp")


def bars(spark, rows):
    return spark.createDataFrame([(s, D(d), c, v) for s, d, c, v in rows],
                                 "symbol string, date date, consensus_close double, volume long")


def test_derive_adjusted(spark):
    out = consensus.derive_adjusted(bars(spark, [("SPY", "2026-05-31", 100.0, 1000)]),
                                    events_frame(spark, [("SPY", "dividend", "2026-06-01", 1.0, None)]),
                                    "2026-05-01", "2026-06-30", F.current_timestamp()).first()
    assert out["close"] == 99.0 and out["open"] == out["high"] == out["low"] == 99.0
    assert out["source"] == "raw_consensus_events" and out["volume"] == 1000


def test_factor_chain_and_end(spark):
    collapsed = bars(spark, [("A", f"2026-01-{d:02d}", 100.0, 1) for d in (5, 6, 7, 8)])
    ev = events_frame(spark, [("A", "split", "2026-01-07", None, 2.0), ("A", "dividend", "2026-01-06", 10.0, None),
                              ("A", "dividend", "2026-01-08", 0.0, None), ("A", "stock_split", "2026-01-08", None, 4.0)])
    got = {r["date"].day: r["factor"] for r in
           consensus.adjustment_factor(collapsed, consensus.confirmed_events(ev)).collect()}
    assert got == {5: pytest.approx(0.45), 6: 0.5, 7: 1.0, 8: 1.0}


def test_factor_without_previous_close_is_neutral(spark):
    ev = events_frame(spark, [("A", "dividend", "2026-01-05", 10.0, None)])
    rows = consensus.dividend_factors(bars(spark, [("A", "2026-01-05", 100.0, 1)]), consensus.confirmed_events(ev))
    assert rows.first()["factor"] == 1.0


def test_factor_on_an_array_uses_the_own_close(spark):
    kind = "array<struct<event_type:string,ex_date:date,dividend_amount:double,split_ratio:double,factor:double>>"
    ev = F.from_json(F.lit('[{"event_type":"split","ex_date":"2026-01-09","split_ratio":4.0},'
                           '{"event_type":"dividend","ex_date":"2026-01-08","dividend_amount":5.0}]'), kind)
    assert one(spark, consensus.factor_at(day("2026-01-07"), F.lit(100.0), ev)) == pytest.approx(0.95 / 4)
    assert one(spark, consensus.factor_at(day("2026-01-09"), F.lit(100.0), ev)) == 1.0


def test_tolerance(spark):
    assert one(spark, numbers.within_tolerance(F.lit(108.688), F.lit(108.689)))
    assert not one(spark, numbers.within_tolerance(F.lit(108.688), F.lit(108.72)))


def test_two_sources(spark):
    names = spark.createDataFrame([("SPY",), ("QQQ",), ("GLD",)], "symbol string")
    rows = raw(spark, {"eodhd": 100.0, "tiingo": 100.01}).unionByName(
        raw(spark, {"eodhd": 50.0, "tiingo": 50.02}, "QQQ")).unionByName(raw(spark, {"eodhd": 7.0}, "GLD"))
    out = consensus.verify_two_sources(names, rows, day("2026-06-30"))
    assert {r["symbol"]: r["status"] for r in out.collect()} == {"SPY": "ok", "QQQ": "mismatch", "GLD": "unverified"}
    assert {r["symbol"]: r["reason"] for r in out.collect()}["GLD"] == "GLD: source unavailable eodhd=ok tiingo=missing"
    assert consensus.verification_status(out).first()["status"] == "alert"


@pytest.mark.parametrize("given, prev, month_end", [
    ("2026-07-06", "2026-07-03", "2026-06-30"), ("2026-07-05", "2026-07-03", "2026-06-30"),
    ("2026-06-10", "2026-06-09", "2026-05-29"), ("2026-03-02", "2026-02-27", "2026-02-27")])
def test_business_days(spark, given, prev, month_end):
    assert one(spark, dates.previous_business_day(day(given))) == D(prev)
    assert one(spark, dates.previous_month_last_business_day(day(given))) == D(month_end)


@pytest.mark.parametrize("a, b, n", [("2024-01-01", "2024-01-07", 5), ("2024-01-06", "2024-01-07", 0),
                                     ("2024-01-05", "2024-01-08", 2), ("2024-01-08", "2024-01-05", 0), ("1950-03-01", "1970-03-01", 5218)])
def test_weekday_count(spark, a, b, n):
    assert one(spark, dates.weekday_count(day(a), day(b))) == n


def test_month_end_confirmation(spark):
    names = spark.createDataFrame([("SPY",), ("QQQ",)], "symbol string")
    rows = spark.createDataFrame([("SPY", D("2026-06-30"))], "symbol string, date date")
    out = coverage.month_end_confirmation(names, rows, day("2026-07-05"))
    assert {r["symbol"]: r["present"] for r in out.collect()} == {"SPY": True, "QQQ": False}
    status = coverage.month_end_status(out).first()
    assert (status["status"], status["symbols_expected"], status["symbols_present"]) == ("pending", 2, 1)


@pytest.mark.parametrize("stored, ref, pct, significant", [
    (100.0, 100.0, 0.0, False), (100.0, 99.0, 1.0, True), (0.0, 99.0, 0.0, False), (100.0, 0.0, 0.0, False),
    (100.0, 100.0005, 0.0005, False), (100.0, 100.001, 0.001, True), (3.0, 2.0, 33.333333, True)])
def test_deviation(spark, stored, ref, pct, significant):
    df = spark.createDataFrame([(stored, ref)], "stored_close double, reference_close double")
    row = adjustments.price_deviation(df).first()
    assert (row["pct_difference"], row["significant"]) == (pct, significant)


@pytest.mark.parametrize("pct, happened, kind, severity", [
    (50.0, [("split", 2.0)], "stock_split", "critical"), (50.0, [("split", 0.1)], "reverse_split", "high"),
    (20.0, [], "spinoff", "critical"), (12.0, [], "unknown", "low"), (1.0, [("dividend", 0.5)], "dividend", "normal"),
    (5.0, [("dividend", 0.5), ("dividend", 0.5), ("dividend", 5.0)], "special_dividend", "high"),
    (12.0, [("dividend", 0.5)], "dividend", "normal"), (0.5, [("capital_gain", 1.0)], "capital_gain", "normal"),
    (0.5, [("split", 2.0)], "unknown", "low")])
def test_classification(spark, pct, happened, kind, severity):
    sample = spark.createDataFrame([("A", D("2024-01-10"), pct)], "symbol string, check_date date, pct_difference double")
    rows = [("A", D(f"2024-02-{i + 1:02d}"), k, v) for i, (k, v) in enumerate(happened)]
    rows += [("A", D("2024-01-10"), "split", 9.0), ("B", D("2024-02-01"), "split", 9.0)]  # neither counts
    ev = spark.createDataFrame(rows, "symbol string, event_date date, kind string, value double")
    row = adjustments.classify_deviation(sample, ev).first()
    assert (row["event_type"], row["severity"]) == (kind, severity)


def test_sample_points(spark):
    rows = spark.sql("select 'A' as symbol, date_add(DATE'2020-01-01', cast(id as int)) as date, cast(id as double) as close "
                     "from range(100) union all select 'B', DATE'2020-01-01', 1.0D")
    got = [int(r["close"]) for r in adjustments.sample_points(rows, day("2021-01-01")).orderBy("date").collect()]
    assert got == [0, 10, 20, 30, 40, 50, 55, 60, 70, 80, 90, 99]


def plan_for(spark, **c):
    row = dict(symbol="A", date_from=D("2010-01-01"), date_to=D("2026-07-03"), first_date=None, last_date=None,
               has_weekday_gaps=False, first_missing_weekday=None)
    row.update({k: D(v) if isinstance(v, str) else v for k, v in c.items()})
    df = spark.createDataFrame([tuple(row.values())], "symbol string, date_from date, date_to date, first_date date, "
                               "last_date date, has_weekday_gaps boolean, first_missing_weekday date")
    return [(r["start"], r["end"]) for r in coverage.fetch_plan(df).orderBy("start").collect()]


def test_fetch_plan(spark):
    full = [(D("2010-01-01"), D("2026-07-03"))]
    assert plan_for(spark, first_date="2010-01-01", last_date="2026-07-01") == full
    assert plan_for(spark, first_date="2010-01-01", last_date="2026-07-02") == []
    assert plan_for(spark) == full
    assert plan_for(spark, first_date="2012-01-03", last_date="2026-07-03", has_weekday_gaps=True,
                    first_missing_weekday="2010-01-01") == [(D("2010-01-01"), D("2012-01-03"))]


@pytest.mark.parametrize("utc_hour, skipped", [(11, False), (12, True), (22, True), (23, False), (0, False), (5, False)])
def test_open_session(spark, utc_hour, skipped):
    at = F.lit(f"2026-01-10 {utc_hour:02d}:00:00").cast("timestamp")
    assert one(spark, clean.safe_end(at)) == (D("2026-01-09") if skipped else D("2026-01-10"))


def test_observations(spark):
    df = spark.createDataFrame([("2024-01-01", "5.25"), ("2024-01-02", "."), ("bad", "1"), ("2024-01-03", "x")],
                               "date string, value string")
    assert [(r["date"], r["value"]) for r in vendors.parse_economic_observations(df).collect()] == [(D("2024-01-01"), 5.25)]


def test_quote_frame(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 1.4, 10)], ["Open", "High", "Low", "Close", "Adj Close", "Volume"])
    assert clean.clean_quote_frame(df).columns == ["open", "high", "low", "close", "volume"]
    assert clean.clean_quote_frame(df.drop("Volume")).count() == 0


def test_symbol_list_limits(spark):
    text = ",".join(f"S{i}" for i in range(101)) + ",s1, ,"
    rows = clean.parse_symbol_list(spark.createDataFrame([(1, text)], "request_id int, symbols string"))
    r = rows.first()
    assert (r["n_symbols"], r["over_fetch_limit"], r["over_local_limit"]) == (101, True, True)


def test_segments(spark):
    changes = spark.createDataFrame([("FB", "META", D("2022-06-09"))], "old_symbol string, new_symbol string, change_date date")
    ask = spark.createDataFrame([("META", D("2022-06-01"), D("2022-06-30")), ("FB", D("2022-06-09"), D("2022-06-10")),
                                 ("FB", D("2022-01-01"), D("2022-06-08")), ("SPY", D("2022-01-01"), D("2022-02-01"))],
                                "symbol string, date_from date, date_to date")
    got = {(r["symbol"], r["date_from"].day): [] for r in ask.collect()}
    for r in prices.symbol_segments(ask, changes).orderBy("seg_from").collect():
        got[(r["symbol"], r["date_from"].day)].append((r["actual_symbol"], str(r["seg_from"]), str(r["seg_to"])))
    assert got == {("META", 1): [("FB", "2022-06-01", "2022-06-08"), ("META", "2022-06-09", "2022-06-30")],
                   ("FB", 9): [("META", "2022-06-09", "2022-06-10")], ("FB", 1): [("FB", "2022-01-01", "2022-06-08")],
                   ("SPY", 1): [("SPY", "2022-01-01", "2022-02-01")]}
