"""Streams that restart, replay and drop late rows; vendor payloads with mistakes; pages by seek; stored years."""

import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from small_tables import SF_DIR

from quotary.operators import consensus, coverage, merge, scale
from quotary.plans.queries import QUERIES
from quotary.schemas import RELATIONS
from quotary.sources import relations, vendors
from quotary.sources.fixtures import Market
from quotary.streaming import streams


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, SF_DIR)


def same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_price_log_restarts_and_replays(spark, market, tmp_path):
    base, changes = market.prices.cache(), market.price_changes.cache()
    folder = str(tmp_path)
    relations.save_relation(base, f"{folder}/base")
    stored = files(f"{folder}/base")

    def arrive(rows):
        rows.repartition(3).write.mode("append").parquet(f"{folder}/landed")

    def run(checkpoint="state"):
        landed = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/landed")
        streams.stream_upsert_prices(landed, f"{folder}/log", f"{folder}/{checkpoint}").awaitTermination()
        return streams.price_table(base, streams.price_log(spark, f"{folder}/log"))

    early, late = changes.where("volume % 300 = 0"), changes.where("volume % 300 <> 0")
    arrive(early)
    assert same(run(), merge.upsert_prices(base, early).drop("change"))
    before = files(f"{folder}/log")
    assert same(run(), merge.upsert_prices(base, early).drop("change")) and files(f"{folder}/log") == before  # nothing new, nothing written
    arrive(late)
    after = run()
    assert same(after, merge.upsert_prices(base, changes).drop("change"))
    assert before.items() <= files(f"{folder}/log").items() and files(f"{folder}/base") == stored
    # the same deliveries once more, as a vendor may send them: the table stays as it is
    arrive(changes)
    assert same(run(), after)
    # a new base from the table, and a new log
    relations.save_relation(after, f"{folder}/next")
    again = spark.read.parquet(f"{folder}/next").select(base.columns)
    assert same(streams.price_table(again, streams.price_log(spark, f"{folder}/log").limit(0)), after)


def test_ties_in_the_price_log(spark, market):
    row = market.prices.limit(1).cache()
    stamp = F.lit("2001-01-01 00:00:00").cast("timestamp")
    at = lambda close, t: row.withColumn("close", F.lit(close)).withColumn("last_updated", t)
    base = at(1.0, stamp)
    for arrived, want in ((at(2.0, stamp), 1.0), (at(2.0, F.expr("timestamp'2001-01-01 00:00:01'")), 2.0), (at(3.0, F.expr("timestamp'1999-01-01'")), 1.0)):
        assert [r.close for r in streams.price_table(base, arrived).collect()] == [want]
        assert [r.close for r in merge.upsert_prices(base, arrived).collect()] == [want]
    unknown = at(1.0, F.lit(None).cast("timestamp"))
    assert [r.close for r in streams.price_table(unknown, at(2.0, stamp)).collect()] == [r.close for r in merge.upsert_prices(unknown, at(2.0, stamp)).collect()] == [1.0]


def test_late_rows_are_counted_and_left_to_the_batch_refresh(spark, market, tmp_path):
    folder = str(tmp_path)
    raw = market.prices_raw.where("date < DATE'1997-01-01'").drop("consensus_close").cache()
    late = raw.where("volume % 900 = 0 and date < DATE'1995-11-01'").withColumns({
        "close": (F.col("close") + F.lit(1).cast("decimal(18,6)")).cast("decimal(18,6)"), "fetched_at": F.expr("fetched_at + interval 3 days")}).cache()
    for i, rows in enumerate((raw.where("date < DATE'1996-01-01'"), raw.where("date >= DATE'1996-01-01'"), late)):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/raw")
    counter = streams.LateRows()
    spark.streams.addListener(counter)
    try:
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/raw")
        streams.drain_updates(streams.stream_consensus(stream, delay="30 days"), f"{folder}/out", f"{folder}/state").awaitTermination()
        assert counter.wait() == late.count() > 0
    finally:
        spark.streams.removeListener(counter)
    got = streams.newest_updates(spark, f"{folder}/out", ["symbol", "date"], ["consensus_close"])
    on_time = consensus.consensus_close(raw).select("symbol", "date", "consensus_close")
    assert same(got, on_time)
    # the refresh repairs the days that the late rows belong to
    newest = raw.agg(F.max("date")).collect()[0][0]
    left = streams.late_days(late, newest, "30 days")
    assert same(left, late)
    repaired = consensus.refresh_changes(raw.withColumn("consensus_close", F.lit(None).cast("decimal(18,6)")), left, market.corporate_events,
                                         QUERIES["upsert_confirmed_events"](market).limit(0).select(
                                             "symbol", "event_date", "event_type", "dividend_amount", "split_ratio", "ex_date",
                                             F.lit(None).cast("date").alias("record_date"), F.lit(None).cast("date").alias("pay_date"), F.lit("x").alias("source")),
                                         "1990-01-01", "1997-01-01", F.lit("2001-01-01 00:00:00").cast("timestamp"))
    assert same(repaired.raw.select("symbol", "date").distinct(), late.select("symbol", "date").distinct())


def test_each_payload_row_is_taken_or_rejected(spark):
    good = '{"date":"2024-01-02","open":1,"high":"2.5","low":0.5,"close":2,"volume":"7.9"}'
    cases = {
        "A": (f"[{good}]", ["taken"]), "B": (f'[{good},{{"date":"2024-13-02","open":1,"high":1,"low":1,"close":1}}]', ["taken", "day"]),
        "C": ('[{"date":"2024-01-02","open":1,"high":1,"low":1}]', ["price"]), "D": ('[{"date":"2024-01-02","open":"n/a","high":1,"low":1,"close":1}]', ["price"]),
        "E": ('[{"date":"2024-01-02","open":1,"high":1,"low":1,"close":1,"volume":"many"}]', ["volume"]), "F": ("[]", []), "G": ("[{", ["payload"]),
        "H": (None, ["payload"]), "I": ("", ["payload"]), "J": ('[{"open":1,"high":1,"low":1,"close":1}]', ["day"]),
        "K": ('[{"date":"2024-01-02","open":1,"high":1,"low":1,"close":1,"volume":""}]', ["taken"]), "VIX": (f"[{good}]", ["taken"]),
    }
    payloads = spark.createDataFrame([(s, p) for s, (p, _) in cases.items()], "symbol string, payload string")
    got = {s: [] for s in cases}
    for r in vendors.parsed_rows(payloads, vendors.EOD).collect():
        got[r.symbol].append(r.reason or "taken")
    assert got == {s: want for s, (_, want) in cases.items()}
    taken, left = vendors.ingest_vendor_eod(payloads), vendors.vendor_rejects(payloads, vendors.EOD)
    assert taken.count() + left.count() == sum(len(w) for _, w in cases.values())
    assert {(str(r.close), r.volume) for r in taken.where("symbol = 'A'").collect()} == {("2.000000", 7)}
    assert {r.symbol: r.text for r in left.collect()}["G"] == "[{"
    assert [r.reason for r in vendors.vendor_rejects(payloads.where("symbol = 'VIX'"), vendors.ISO).collect()] == ["unsupported"]
    bars = spark.createDataFrame([("A", '{"bars":[{"t":"2024-01-02T05:00:00Z","o":1,"h":2,"l":1,"c":"x","v":1}]}'), ("B", '{"bars":null}'), ("C", "{}"), ("D", "{")],
                                 "symbol string, payload string")
    assert {(r.symbol, r.reason, r.date) for r in vendors.vendor_rejects(bars, vendors.BARS).collect()} == {("A", "price", date(2024, 1, 2)), ("D", "payload", None)}


@pytest.mark.parametrize("kind", [vendors.EOD, vendors.BARS])
def test_each_response_is_parsed_once(spark, kind):
    row = f'{{"{kind.day}":"2024-01-02","{kind.open}":1,"{kind.high}":2,"{kind.low}":1,"{kind.close}":1,"{kind.close}":1}}'
    body = f"[{row},{row}]" if kind.within is None else f'{{"{kind.within}":[{row},{row}]}}'
    rows = vendors.parsed_rows(spark.createDataFrame([("A", body), ("B", body[:9]), ("C", None)], "symbol string, payload string"), kind)
    assert sorted((r.symbol, r.reason) for r in rows.collect()) == [("A", "payload")] * 2 + [("B", "payload"), ("C", "payload")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json("), plan.count("parseJson(")) == (1, 1)


@pytest.mark.parametrize("order", [[("a", False), ("k", False)], [("a", True), ("k", False)], [("a", True), ("k", True)]])
def test_pages_by_seek_follow_one_another(spark, order):
    rows = [(i, None if i % 5 == 0 else i * 7 % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, a int").repartition(4)
    whole = scale.seek(df, order, 1000).collect()
    after, pages = None, []
    while page := scale.seek(df, order, 7, after).collect():
        pages += page
        after = [page[-1][c] for c, _ in order]
    assert pages == whole and len(whole) == 40


def test_seek_pages_are_those_of_offsets(market):
    rows = coverage.coverage_recent(market.symbols, market.prices, F.lit("2001-11-05").cast("date")).cache()
    how = {"sort_by": "data_start", "order": "desc", "page_size": 9}
    after = None
    for page in range(1, 4):
        want = [r.symbol for r in coverage.coverage_listing(rows, page=page, **how).collect()]
        found = coverage.coverage_listing_after(rows, after=after, **how).collect()
        assert [r.symbol for r in found] == want
        after = (found[-1].data_start, found[-1].symbol)


def test_only_the_years_of_a_delivery_are_written(spark, market, tmp_path):
    root = str(tmp_path)
    relations.save_relation(market.prices, f"{root}/prices")
    before = files(root)
    late = market.price_changes.where("year(date) in (1997, 1999)")
    counts = {r.change: r.n for r in relations.upsert_relation(spark, root, "prices", late, merge.upsert_prices).collect()}
    after = files(root)
    touched = {os.path.basename(os.path.dirname(p)) for p in before.keys() ^ after.keys()}
    assert touched == {"year=1997", "year=1999"}
    assert all(after[p] == t for p, t in before.items() if p in after) and counts["updated"] > 0
    assert same(relations.load_relation(spark, root, "prices"), merge.upsert_prices(market.prices, late).drop("change"))
    assert relations.upsert_relation(spark, root, "prices", late.limit(0), merge.upsert_prices).collect() == []


def test_declared_types_from_text(market):
    """What a database driver may hand over: text, wider numbers, JSON as text."""
    for name, df in (("prices", market.prices), ("prices_raw", market.prices_raw), ("fetch_jobs", market.jobs.limit(50))):
        want = df.select(*RELATIONS[name].names)
        nested = [f.name for f in RELATIONS[name].fields if not isinstance(f.dataType, AtomicType)]
        text = want.select(*[(F.to_json(c) if c in nested else F.col(c).cast("string")).alias(c) for c in want.columns])
        got = relations.declared(text, name)
        assert [f.dataType for f in got.schema.fields] == [f.dataType for f in RELATIONS[name].fields]
        assert same(got, relations.declared(want, name))


def test_a_slice_is_a_batch(spark, tmp_path):
    """Few rows a slice, and a slice without any: still as many files each, so that batches keep the order of time."""
    from quotary.plans.queries import _stream
    from quotary.sources.fixtures import Market

    rows = spark.createDataFrame([(i, date(2024, 1, 1 + i)) for i in (0, 1, 2, 6, 9, 11)], "i int, date date")
    stream = _stream(Market(spark, ""), rows, "rows", str(tmp_path), order="date", slices=6)
    landed = spark.read.schema(rows.schema).parquet(f"{tmp_path}/rows")
    assert len(landed.inputFiles()) == 6 * spark.sparkContext.defaultParallelism and landed.count() == 6
    batches = []
    stream.writeStream.foreachBatch(lambda batch, _: batches.append(sorted(r.i for r in batch.collect()))).option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert batches == [[0, 1], [2], [], [6], [9], [11]]


def test_state_of_a_stream_is_on_disk(spark, tmp_path):
    """State in the heap grows with a month of rows and a batch; the session keeps its own settings."""
    before = {key: spark.conf.get(key, None) for key in streams.ON_DISK}
    schema = "symbol string, date date, source string, fetched_at timestamp, close decimal(18,6)"
    rows = spark.createDataFrame([(f"S{i % 5}", date(2024, 1, 2 + i // 10), "a" if i % 10 < 5 else "b", None, None) for i in range(40)], schema)
    rows.withColumn("close", F.lit(1).cast("decimal(18,6)")).coalesce(1).write.parquet(f"{tmp_path}/raw")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/raw")
    query = streams.drain_updates(streams.stream_consensus(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    operators = query.recentProgress[0]["stateOperators"]
    assert len(operators) == 2 and all(any(k.startswith("rocksdb") for k in op["customMetrics"]) for op in operators)
    assert {key: spark.conf.get(key, None) for key in streams.ON_DISK} == before
    assert streams.newest_updates(spark, f"{tmp_path}/out", ["symbol", "date"], ["consensus_close"]).count() == 20
