"""Hot keys, algebraic properties and plan shapes."""

import pytest
from small_tables import SF_DIR
from pyspark.sql import Window
from pyspark.sql import functions as F

from quotary.operators import clean, consensus, coverage, merge, prices, scale
from quotary.plans.queries import QUERIES
from quotary.sources import csv_out, relations, vendors
from quotary.sources.fixtures import Market

KEY = ["symbol"]


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds half of all rows; days repeat nowhere within a key."""
    return spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("K"), F.col("id") % 50)).alias("symbol"),
        F.expr("date_add(DATE'1990-01-01', cast(id as int))").alias("date"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 7919 % 1000).cast("double")).alias("v"))


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, SF_DIR)


def same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


def test_running_last_is_the_plain_window(hot):
    for inclusive, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, end)
        got = scale.running_last(hot, KEY, scale.year_of("date"), ["date"], F.col("v"), "x", inclusive)
        assert same(got, hot.withColumn("x", F.last("v", ignorenulls=True).over(w)))


def test_running_max_is_the_plain_window(hot):
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    got = scale.running_max_before(hot, KEY, scale.month_of("date"), ["date"], F.col("v"), "x")
    assert same(got, hot.withColumn("x", F.max("v").over(w)))


def test_ranked_is_the_plain_window(hot):
    w = Window.partitionBy("symbol").orderBy("date")
    want = hot.withColumn("i", (F.row_number().over(w) - 1).cast("bigint")).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    assert same(scale.ranked(hot, KEY, scale.year_of("date"), ["date"], "i", "n"), want)


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_is_the_latest_row(hot, strict):
    left = hot.select("symbol", F.date_add("date", 3).alias("at")).unionByName(
        hot.select("symbol", F.date_sub("date", 9000).alias("at")))
    right = hot.where("v < 200").select("symbol", F.col("date").alias("d"), "v")
    pairs = left.join(right, "symbol").where("d < at" if strict else "d <= at")
    best = pairs.groupBy("symbol", "at").agg(F.max(F.struct("d", "v")).alias("m")).select("symbol", "at", "m.*")
    assert same(scale.asof_join(left, right, KEY, "at", "d", ["d", "v"], strict), left.join(best, ["symbol", "at"], "left"))


def test_next_join_is_the_earliest_row_after(hot):
    left, right = hot.select("symbol", F.col("date").alias("at")), hot.where("v < 200").select("symbol", F.col("date").alias("d"), "v")
    best = left.join(right, "symbol").where("d > at").groupBy("symbol", "at").agg(F.min(F.struct("d", "v")).alias("m"))
    assert same(scale.next_join(left, right, KEY, "at", "d", ["v"]),
                left.join(best, ["symbol", "at"], "left").select("symbol", "at", "m.v"))


def test_top_k_and_order_statistics(hot):
    order = [F.desc("v"), F.col("date")]
    w = Window.partitionBy("symbol").orderBy(*order)
    plain = hot.withColumn("rk", F.row_number().over(w)).where("rk <= 5")
    assert same(scale.top_k(hot, KEY, order, 5, "rk"), plain)
    got = scale.order_statistics(hot, KEY, "v", {"n": None, "top": lambda n: n, "third": lambda n: F.lit(3)})
    want = hot.where("v is not null").groupBy("symbol").agg(
        F.count("v").alias("n"), F.max("v").alias("top"), F.sort_array(F.collect_list("v"))[2].alias("third"))
    assert same(got, want)


def test_merged_ranges_are_disjoint_and_cover(market):
    ranges = market.range_requests
    merged = coverage.merge_date_ranges(ranges)
    nxt = F.lead("start").over(Window.partitionBy("symbol").orderBy("start"))
    assert merged.withColumn("nxt", nxt).where("nxt <= date_add(end, 1)").isEmpty()
    m = merged.select("symbol", F.col("start").alias("a"), F.col("end").alias("b"))
    inside = ranges.join(m, "symbol").where("start >= a and end <= b")
    assert inside.count() == ranges.count()


def test_upsert_twice_is_upsert_once(market):
    once = merge.upsert_prices(market.prices, market.price_changes).drop("change")
    again = merge.upsert_prices(once, market.price_changes)
    assert same(once, again.drop("change"))
    assert again.where("change <> 'unchanged'").isEmpty()


def test_resolved_rows_come_from_old_and_new_names(market):
    rows = prices.prices_resolved(market.prices, market.symbol_changes, None, "1990-01-01", "2010-01-01")
    origin = rows.select(F.coalesce("source_symbol", "symbol").alias("symbol"), "date")
    assert origin.join(market.prices, ["symbol", "date"], "left_anti").isEmpty()
    assert rows.groupBy("symbol", "date", "source_symbol").count().where("count > 1").isEmpty()


def test_accepted_and_rejected_split_the_table(market):
    rows = clean.clean_quote_frame(market.quotes)
    checked = clean.validate_relation(rows, clean.RULES["prices"], ["symbol", "date"])
    assert clean.accepted(checked).count() + clean.rejected(checked).count() == rows.count()


def test_delete_one_symbol(market):
    left = merge.delete_prices(market.prices, " s3", "1996-01-01", "1997-12-31")
    gone = market.prices.where("symbol = 'S3' and date between '1996-01-01' and '1997-12-31'")
    assert not gone.isEmpty() and left.count() == market.prices.count() - gone.count()


def test_files_round_trip(spark, market, tmp_path):
    relations.save_relation(market.prices, str(tmp_path / "prices"))
    back = relations.load_relation(spark, str(tmp_path), "prices")
    assert same(back, market.prices)
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "SPY.json").write_text('{"bars":[{"t":"2026-01-02T05:00:00Z","o":1,"h":2,"l":0.5,"c":1.5,"v":10.9}]}')
    (tmp_path / "landed" / "%5EVIX.json").write_text('{"bars":null}')
    rows = vendors.ingest_vendor_bars(vendors.read_payloads(spark, str(tmp_path / "landed"))).collect()
    assert [(r["symbol"], str(r["date"]), float(r["close"]), r["volume"]) for r in rows] == [("SPY", "2026-01-02", 1.5, 10)]
    out = csv_out.coverage_export(coverage.coverage_recent(market.symbols, market.prices, F.lit("2001-11-05").cast("date")))
    csv_out.write_csv(out, str(tmp_path / "csv"))
    again = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert again.columns == csv_out.COVERAGE_COLUMNS and again.count() == market.symbols.count()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "load_"))))
def test_no_pair_join_and_no_python(market, name):
    text = plan(QUERIES[name](market))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


def test_range_read_is_pushed_and_pruned(spark, market, tmp_path):
    relations.save_relation(market.prices, str(tmp_path / "prices"))
    stored = relations.load_relation(spark, str(tmp_path), "prices", start="1999-01-01")
    text = plan(prices.price_series_before(stored, F.lit("1999-06-01").cast("date")))
    assert "(year#" in text.split("PartitionFilters")[1].split("]")[0] and "LessThan(date,1999-06-01)" in text
    assert "volume" not in text.split("ReadSchema")[1]


def test_consensus_needs_one_shuffle(spark, market, tmp_path):
    market.prices_raw.write.parquet(str(tmp_path / "raw"))
    text = plan(consensus.consensus_close(spark.read.parquet(str(tmp_path / "raw"))))
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_buckets_are_shuffled_on_their_own_after_a_ticker_shuffle(spark, hot, threshold):
    """A window over (ticker, bucket) must not settle for a layout by ticker, with or without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        by_ticker = hot.repartition("symbol")
        for df in (scale.ranked(by_ticker, KEY, scale.year_of("date"), ["date"], "i", "n"),
                   scale.running_last(by_ticker, KEY, scale.year_of("date"), ["date"], F.col("v"), "x"),
                   scale.asof_join(by_ticker, by_ticker.select("symbol", F.col("date").alias("d")), KEY, "date", "d", ["d"])):
            text = plan(df)
            window = text.index("Window [")
            assert "hashpartitioning(symbol#" in text[window:] and ", _b#" in text[window:].split("hashpartitioning(")[1][:40]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_relation_summary_counts_keys_by_masks(spark):
    rows = [("A", "2020-01-31", "x"), ("A", "2020-01-31", "x"), ("A", "2020-01-31", "y"), ("A", "2020-02-29", "x"), ("A", "2020-02-01", None),
            ("A", "2020-12-31", "x"), ("A", "2021-12-31", "x"), (None, "2019-12-31", "x"), ("B", None, "x"), ("B", "2020-11-30", "x"),
            ("B", "2020-03-01", "x"), ("B", "2020-04-01", "x"), ("B", "2020-02-28", "x"), ("B", "2020-01-01", "x")]
    df = spark.createDataFrame(rows, "symbol string, date string, source string").withColumn("date", F.col("date").cast("date"))
    for frame in (df, df.where("false"), df.where("date is null")):
        for keys in (["symbol", "date"], ["symbol", "date", "source"], ["symbol"], ["date"]):
            want = frame.agg(F.count(F.lit(1)), F.count_distinct(*keys), F.min("date"), F.max("date")).collect()
            assert [tuple(r) for r in relations.summary(frame, keys, "date").collect()] == [tuple(r) for r in want]
    assert tuple(relations.summary(df, ["symbol", "source"], None).collect()[0]) == (14, 3, None, None)
    sent = [x for x in plan(relations.summary(df, ["symbol", "date"], "date")).splitlines() if "Exchange hashpartitioning" in x]
    assert len(sent) == 1 and "date#" not in sent[0].split("hashpartitioning")[1]


def test_stored_files_are_sorted_by_ticker_and_day(spark, market, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    relations.save_relation(market.prices.repartition(3), str(tmp_path / "prices"))
    assert spark.conf.get(key) == before
    files = sorted((tmp_path / "prices").glob("year=*/*.parquet"))
    assert len({f.parent for f in files}) == 7
    for file in files:
        rows = [(r.symbol, r.date) for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert rows == sorted(rows) and {d.year for _, d in rows} == {int(file.parent.name[5:])}


def test_thousandths_become_decimals_exactly(spark):
    from quotary.sources.fixtures import _decimal

    rows = spark.range(-5000, 5000, 7).selectExpr("id as n").unionByName(spark.sql("select explode(array(null, 0L, 999999999999999L, -123456789012345L)) as n"))
    old = (F.col("n").cast("decimal(15,0)") * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(18,6)")
    assert rows.select(_decimal("n")).schema[0].dataType.simpleString() == "decimal(18,6)"
    assert rows.where(~_decimal("n").eqNullSafe(old)).isEmpty()
