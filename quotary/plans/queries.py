"""Registered queries: one function from ``Market`` to a result per key.

Results use plain column types: dates and time stamps as ISO text, decimals as
double, arrays joined to text.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotary.functions import dates, numbers, tickers
from quotary.operators import adjustments, clean, compare, consensus, coverage, events, jobs, merge, ops, prices
from quotary.operators.scale import with_row
from quotary.schemas import KEYS, RELATIONS
from quotary.sources import csv_out, relations, vendors
from quotary.sources.fixtures import AS_OF, JOBS_AS_OF, RANGE, Market
from quotary.streaming import streams

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def day(text: str):
    return F.lit(text).cast("date")


def moment(text: str):
    return F.lit(text).cast("timestamp")


def plain(df: DataFrame) -> DataFrame:
    """The result in column types every engine writes alike."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind == "decimal":
            c = c.cast("double")
        elif kind == "array":
            c = F.array_join(c, ";")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def scratch(m: Market) -> str:
    """A folder of its own for this run, shared where the cluster names a shared one."""
    return f"{relations.scratch_dir(m.spark)}/quotary-{uuid.uuid4().hex}"


def _closes(df: DataFrame) -> DataFrame:
    """Closes by source as text, in cents' tenths."""
    text = F.transform("closes", lambda v: F.concat(v["source"], F.lit(":"), F.round(v["close"] * 1000).cast("bigint")))
    return df.withColumn("closes", F.array_join(text, ";"))


# --- A: sources and sinks -------------------------------------------------------------------------


@query
def load_relations(m: Market):
    root, m = scratch(m), m.shared
    tables = {"symbols": m.symbols, "symbol_changes": m.symbol_changes, "prices": m.prices, "prices_raw": m.prices_raw,
              "corporate_events": m.corporate_events, "economic_indicators": m.economic, "fetch_jobs": m.jobs}
    for name, df in tables.items():
        relations.save_relation(df.select(*RELATIONS[name].names), f"{root}/{name}")
    out = None
    for name, df in relations.load_relations(m.spark, root).items():
        day = next((c for c in ("date", "event_date") if c in df.columns), None)
        one = relations.summary(df, KEYS[name], day).select(F.lit(name).alias("relation"), "n_rows", "n_keys", "first_day", "last_day")
        out = one if out is None else out.unionByName(one)
    return out


def _payloads(rows: DataFrame, item, wrap=None) -> DataFrame:
    """One response text per ticker and year, as a vendor would send it.

    Rows are shuffled as they are: a ticker's days are spread over all tasks,
    and lists begun before the shuffle would hold a row or two each.
    """
    body = F.collect_list("_item")
    if wrap:
        body = F.struct(body.alias(wrap))
    items = rows.select("symbol", F.year("date").alias("y"), item.alias("_item")).repartition("symbol", "y")
    return items.groupBy("symbol", "y").agg(F.to_json(body).alias("payload")).select("symbol", "payload")


@query
def ingest_vendor_eod(m: Market):
    rows = m.prices_raw.where("source = 'eodhd'").withColumn("date", F.col("date"))
    item = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume")
    return vendors.ingest_vendor_eod(_payloads(rows, item))


@query
def ingest_vendor_iso(m: Market):
    rows = m.prices_raw.where("source = 'tiingo'")
    item = F.struct(F.date_format("date", "yyyy-MM-dd'T00:00:00.000Z'").alias("date"), "open", "high", "low", "close", "volume")
    return vendors.ingest_vendor_iso(_payloads(rows, item))


@query
def ingest_vendor_bars(m: Market):
    rows = m.prices_raw.where("source = 'alpaca'")
    item = F.struct(F.date_format("date", "yyyy-MM-dd'T05:00:00Z'").alias("t"), F.col("open").alias("o"),
                    F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                    F.when(F.col("volume") > 0, F.col("volume")).alias("v"))
    return vendors.ingest_vendor_bars(_payloads(rows, item, "bars"))


def _spoilt(rows: DataFrame, day: str) -> DataFrame:
    """Vendor rows with what goes wrong in them: days, prices and volumes that cannot be read, by volume."""
    v = F.expr("volume div 100")
    text = lambda c: F.col(c).cast("string")
    return rows.withColumns({
        "day": F.when(v % 13 == 0, F.lit("31/12/1999")).when(v % 17 == 0, F.lit(None)).otherwise(F.date_format("date", day)),
        "open": F.when(v % 11 == 0, "n/a").otherwise(text("open")), "close": F.when(v % 19 == 0, F.lit(None)).otherwise(text("close")),
        "volume": F.when(v % 7 == 0, "many").when(v % 5 == 0, "").otherwise(text("volume"))})


def _spoilt_payloads(m: Market):
    """Of each vendor; responses of tickers that end in 3 are cut off, and S1 stands for a ticker that two vendors lack."""
    named = F.expr("CASE WHEN symbol = 'S1' THEN 'VIX' ELSE symbol END")
    torn = F.when(F.col("symbol").endswith("3"), F.expr("substr(payload, 1, length(payload) - 1)")).otherwise(F.col("payload"))
    for kind, form in ((vendors.EOD, "yyyy-MM-dd"), (vendors.ISO, "yyyy-MM-dd'T00:00:00.000Z'"), (vendors.BARS, "yyyy-MM-dd'T05:00:00Z'")):
        rows = _spoilt(m.prices_raw.where(F.col("source") == kind.source), form).withColumn("symbol", named)
        item = F.struct(F.col("day").alias(kind.day), *[F.col(c).alias(getattr(kind, c)) for c in ("open", "high", "low", "close", "volume")])
        yield kind, _payloads(rows, item, kind.within).withColumn("payload", torn)


@query
def vendor_rejects(m: Market):
    """Per vendor and ticker: the rows taken in, and the rejects by reason."""
    out = None
    for kind, payloads in _spoilt_payloads(m.shared):
        one = vendors.parsed_rows(payloads, kind).groupBy("source", "symbol", F.coalesce("reason", F.lit("taken")).alias("outcome")).agg(
            F.count(F.lit(1)).alias("n"), F.count("date").alias("n_days"), F.sum(F.coalesce("volume", F.lit(0))).alias("volume"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def union_raw_sources(m: Market):
    raw = m.prices_raw.drop("consensus_close").withColumn(
        "symbol", F.when(F.col("symbol") == "S1", "VIX").otherwise(F.col("symbol")))
    parts = [raw.where(F.col("source") == s) for s in ("eodhd", "tiingo", "alpaca")]
    return vendors.union_raw_sources(*parts).drop("fetched_at")


@query
def clean_quote_frame(m: Market):
    close = F.when(F.isnan("close"), -1.0).otherwise(F.col("close"))
    return clean.clean_quote_frame(m.quotes).select(
        "symbol", "date", "open", "high", "low", close.alias("close"), "volume", "line_key", "line_no")


@query
def parse_economic_observations(m: Market):
    return vendors.parse_economic_observations(m.observations)


def action_payloads(m: Market):
    """Dividend and split responses with every spelling a vendor uses."""
    e = m.corporate_events.where(F.col("event_type").isin("dividend", "split")).select(
        "symbol", "event_type", F.col("event_date").alias("date"), (F.col("id") % 6).alias("v"),
        F.coalesce("dividend_amount", "split_ratio").cast("double").cast("string").alias("x"))
    late = F.date_format(F.when(F.col("v") == 5, F.date_add("date", 30)).otherwise(F.col("date")), "yyyy-MM-dd")
    first = F.expr("case v when 0 then x when 2 then '0' when 3 then 'NA' when 4 then 'bad' when 5 then x end")
    second = F.expr("case when v in (1, 2) then x end")

    def payload(kind, a, b):
        item = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"),
                        F.when(F.col("v") == 5, late).alias("ex_date"), first.alias(a), second.alias(b))
        return _payloads(e.where(F.col("event_type") == kind), item)

    return payload("dividend", "value", "amount"), payload("split", "split", "ratio")


@query
def parse_corporate_actions(m: Market):
    actions, rejects = vendors.parse_corporate_actions(*action_payloads(m), day("2000-01-01"))
    good = actions.select("symbol", "event_date", "event_type", "dividend_amount", "split_ratio",
                          F.lit("action").alias("outcome"))
    bad = rejects.select("symbol", F.col("ex_date").alias("event_date"), "event_type", F.lit("reject").alias("outcome"))
    return good.unionByName(bad, allowMissingColumns=True)


@query
def extract_inline_events(m: Market):
    return vendors.extract_inline_events(m.quotes)


@query
def parse_symbol_list(m: Market):
    return clean.parse_symbol_list(m.symbol_lists)


@query
def export_coverage_csv(m: Market):
    return csv_out.coverage_export(coverage.coverage_recent(m.symbols, m.prices, day(AS_OF)))


MONTH_ENDS = ("1995-01-01", "2001-12-01")


def _grid(m: Market):
    raw = m.prices_raw.withColumn("adj_close", F.when(F.col("source") != "alpaca", F.col("close")))
    return compare.source_point_grid(m.symbols, compare.month_end_business_days(*MONTH_ENDS), raw, m.prices)


@query
def export_comparison(m: Market):
    return csv_out.points_export(_grid(m))


@query
def export_run_summary(m: Market):
    return csv_out.summary_export(jobs.run_status(_runs(m), batch_size=10))


# --- B: cleaning and validation -------------------------------------------------------------------


@query
def normalize_symbol(m: Market):
    return m.typed_tickers.select("request_id", tickers.normalize_symbol(F.col("raw")).alias("symbol"))


@query
def vendor_symbol(m: Market):
    name = F.expr("case symbol when 'X1' then 'VIX' when 'X2' then 'GSPC' else symbol end").alias("symbol")
    rows = m.symbols.select(name, F.explode(F.array(*[F.lit(v) for v in ("eodhd", "tiingo", "alpaca", "yfinance")])).alias("vendor"))
    return rows.withColumn("vendor_symbol", tickers.vendor_symbol("symbol", "vendor"))


def _bars(m: Market):
    return clean.clean_quote_frame(m.quotes)


@query
def clean_ohlcv(m: Market):
    return clean.clean_ohlcv(_bars(m)).select("symbol", "date", "open", "high", "low", "close", "volume", "line_key", "line_no")


@query
def normalize_price_rows(m: Market):
    rows = _bars(m).withColumn("source", F.when(F.col("line_no") > 3, "vendor"))
    return clean.normalize_price_rows(rows, moment("2001-11-05 00:00:00"))


@query
def validate_relation(m: Market):
    rows = _bars(m).select("symbol", "date", "open", "high", "low", "close", "volume", "line_key", "line_no")
    known = m.symbols.where("is_active")
    return clean.validate_relation(rows, clean.RULES["prices"], ["symbol", "date"], known,
                                   ["open", "volume"]).select("symbol", "date", "line_key", "line_no", "reasons")


@query
def validate_events(m: Market):
    rows = m.corporate_events.select("id", "symbol", "event_date", F.when(F.col("event_type") == "spinoff", "merger")
                                     .otherwise(F.col("event_type")).alias("event_type"), "status",
                                     F.when(F.col("severity") == "low", "minor").otherwise(F.col("severity")).alias("severity"))
    return clean.validate_relation(rows, clean.RULES["corporate_events"], ["symbol", "event_date", "event_type"],
                                   m.symbols).select("id", "reasons")


@query
def validate_request_ranges(m: Market):
    return clean.validate_request_ranges(m.job_requests, day(AS_OF)).select("request_id", "range_outcome", "job_outcome")


@query
def exclude_open_session(m: Market):
    at = F.col("ts").cast("timestamp")
    rows = m.table("events").select("event_id", F.col("ts").cast("date").alias("date"), at.alias("ts"))
    return clean.exclude_open_session(rows, F.col("ts")).select("event_id", "date", clean.safe_end(F.col("ts")).alias("safe_end"))


@query
def vendor_tolerance_ok(m: Market):
    side = lambda s: m.prices_raw.where(F.col("source") == s).select(
        "symbol", "date", F.col("close").cast("double").alias(s))
    both = side("eodhd").join(side("tiingo"), ["symbol", "date"])
    return both.select("symbol", "date", numbers.within_tolerance(F.col("eodhd"), F.col("tiingo")).alias("ok"))


@query
def business_day(m: Market):
    d = m.table("orders").select(F.col("o_orderkey"), F.col("o_orderdate").cast("date").alias("day"))
    return d.select("o_orderkey", dates.previous_business_day(F.col("day")).alias("previous"),
                    dates.previous_month_last_business_day(F.col("day")).alias("month_end"))


# --- C: price reads -------------------------------------------------------------------------------


@query
def prices_range(m: Market):
    return prices.prices_range(m.prices, m.symbols.where("is_active"), "1996-01-01", "2000-12-31")


@query
def prices_resolved(m: Market):
    return prices.prices_resolved(m.prices, m.symbol_changes, m.symbols, *RANGE)


@query
def symbol_segments(m: Market):
    return prices.symbol_segments(m.coverage_requests, m.symbol_changes)


@query
def serve_prices(m: Market):
    return prices.serve_prices(m.prices, m.symbol_changes, m.symbols, "1997-01-01", "2030-01-01", "2001-06-30")


@query
def response_limits(m: Market):
    return prices.response_limits(prices.prices_resolved(m.prices, m.symbol_changes, m.symbols, *RANGE))


@query
def price_count(m: Market):
    return prices.price_count(m.prices)


@query
def list_symbols(m: Market):
    return prices.list_symbols(m.symbols, True)


@query
def closest_price_before(m: Market):
    targets = m.corporate_events.select("id", "symbol", F.col("event_date").alias("target_date"))
    return prices.closest_price_before(m.prices, targets)


@query
def price_series_before(m: Market):
    return prices.price_series_before(m.prices, day("2000-01-01"))


@query
def recent_close_arrays(m: Market):
    text = F.transform("closes", lambda c: F.concat(c["date"].cast("string"), F.lit("="), F.round(c["close"] * 100).cast("bigint")))
    return prices.recent_close_arrays(m.prices, day("2001-06-30")).select("symbol", F.array_join(text, ";").alias("closes"))


@query
def symbol_registration_plan(m: Market):
    raw = F.expr("case c_custkey % 3 when 0 then concat(' s', c_custkey) when 1 then concat('u', c_custkey, ' ') "
                 "else concat('c', c_custkey, '.b') end").alias("raw")
    listing = m.series_listing.where("name is not null")
    return prices.symbol_registration_plan(m.table("customer").select(raw), m.symbols, listing)


@query
def renamed_symbol_exists(m: Market):
    return prices.renamed_symbol_exists(m.symbols, m.symbol_changes, m.prices)


@query
def table_health(m: Market):
    return prices.table_health(m.symbols, m.prices)


@query
def recent_activity(m: Market):
    return prices.recent_activity(m.prices, day("2001-06-30"))


@query
def economic_series_info(m: Market):
    return prices.economic_series_info(m.economic, m.series_listing.select("symbol", "name"))


@query
def economic_range(m: Market):
    return prices.economic_range(m.economic, "u1", "2024-01-03", "2024-01-28", descending=True)


@query
def economic_latest(m: Market):
    return prices.economic_latest(m.economic)


# --- D: coverage ----------------------------------------------------------------------------------


@query
def symbol_coverage_view(m: Market):
    return coverage.symbol_coverage_view(m.symbols, m.prices)


@query
def coverage_recent(m: Market):
    return coverage.coverage_recent(m.symbols, m.prices, day(AS_OF))


@query
def coverage_stats(m: Market):
    return coverage.coverage_stats(m.symbols, m.prices, start="1995-01-03", end="2001-12-31")


@query
def coverage_listing(m: Market):
    rows = coverage.coverage_recent(m.symbols, m.prices, day(AS_OF))
    return coverage.coverage_listing(rows, sort_by="row_count", order="desc", page=2, page_size=20, q="s", has_data=True,
                                     start_after="1996-11-01", end_before="2001-12-31",
                                     updated_after="2000-01-01 00:00:00")


@query
def coverage_listing_after(m: Market):
    """The second page, by the key of the last row of the first."""
    rows = coverage.coverage_recent(m.symbols, m.prices, day(AS_OF))
    how = {"sort_by": "row_count", "order": "desc", "page_size": 5, "q": "s"}
    last = coverage.coverage_listing(rows, **how).orderBy("row_count", F.desc("symbol")).select("row_count", "symbol").first()
    return coverage.coverage_listing_after(rows, after=last, **how)


@query
def coverage_range(m: Market):
    return coverage.coverage_range(m.prices, m.coverage_requests)


@query
def weekday_count(m: Market):
    return m.range_requests.select("symbol", "start", "end", dates.weekday_count(F.col("start"), F.col("end")).alias("weekdays"),
                                   dates.weekday_count(F.col("end"), F.col("start")).alias("reversed"))


@query
def missing_weekdays(m: Market):
    return coverage.missing_weekdays(m.prices, m.coverage_requests)


@query
def missing_ranges(m: Market):
    return coverage.missing_ranges(m.prices, m.coverage_requests)


@query
def merge_date_ranges(m: Market):
    return coverage.merge_date_ranges(m.range_requests)


@query
def fetch_plan(m: Market):
    return coverage.fetch_plan(coverage.coverage_range(m.prices, m.coverage_requests))


@query
def availability_adjustment(m: Market):
    asked = m.symbols.select("symbol", F.expr("case when has_full_history then DATE'1993-05-01' else DATE'1999-12-20' end")
                             .alias("date_from"), day(AS_OF).alias("date_to"))
    return coverage.availability_adjustment(asked, m.prices)


@query
def availability_start(m: Market):
    asked = m.coverage_requests
    return coverage.availability_start(asked, m.reference_prices, coverage.coverage_range(m.prices, asked))


@query
def symbol_date_metadata(m: Market):
    return coverage.symbol_date_metadata(m.symbols, m.prices)


@query
def month_end_confirmation(m: Market):
    rows = coverage.month_end_confirmation(m.symbols.where("is_active"), m.prices, day("2001-06-15"))
    return with_row(rows, coverage.month_end_status(rows).drop("target_date"))


@query
def economic_fetch_window(m: Market):
    return coverage.economic_fetch_window(m.series_listing, m.economic, day("2024-01-25"))


# --- E: writes ------------------------------------------------------------------------------------

NOW = "2001-11-05 06:00:00"


@query
def upsert_prices(m: Market):
    return merge.upsert_prices(m.prices, m.price_changes, now=moment(NOW))


@query
def upsert_prices_force(m: Market):
    return merge.upsert_prices(m.prices, m.price_changes, force=True, now=moment(NOW))


@query
def upsert_counts(m: Market):
    return merge.change_counts(merge.upsert_prices(m.prices, m.price_changes, now=moment(NOW)))


@query
def upsert_stored_years(m: Market):
    """A stored table after a delivery for two of its years, read back."""
    root = scratch(m)
    relations.save_relation(m.prices, f"{root}/prices")
    late = m.price_changes.where("year(date) in (1997, 1999)")
    relations.upsert_relation(m.spark, root, "prices", late, lambda old, new: merge.upsert_prices(old, new, now=moment(NOW)))
    return relations.load_relation(m.spark, root, "prices")


@query
def upsert_raw(m: Market):
    return merge.upsert_raw(m.prices_raw, m.raw_changes)


@query
def upsert_economic(m: Market):
    return merge.upsert_economic(m.economic, m.economic_changes)


def _actions(m: Market):
    """Vendor actions: known events again with other amounts, and new ones a month later."""
    e = m.corporate_events.where(F.col("event_type").isin("dividend", "split")).select(
        "symbol", "event_date", "event_type", (F.col("dividend_amount") * 2).cast("decimal(18,8)").alias("dividend_amount"),
        "split_ratio", F.lit(None).cast("date").alias("ex_date"), F.lit(None).cast("date").alias("record_date"),
        F.lit(None).cast("date").alias("pay_date"), F.lit("eodhd").alias("source"))
    moved = e.where("event_type = 'dividend'").withColumn("event_date", F.date_add("event_date", 4000))
    return e.unionByName(moved)


def _event_view(df: DataFrame):
    names = F.transform("sources_json", lambda s: s["source"])
    return df.select("id", "symbol", "event_date", "event_type", "ratio", "amount", "dividend_amount", "split_ratio", "ex_date",
                     "confirmed_at", F.coalesce("source_count", F.lit(0)).alias("source_count"), names.alias("source_names"),
                     "severity", "status", "updated_at", "change")


@query
def upsert_confirmed_events(m: Market):
    return _event_view(merge.upsert_confirmed_events(m.corporate_events, _actions(m), moment(NOW)))


@query
def record_events(m: Market):
    out = merge.record_events(m.corporate_events, _scan(m).events, moment(NOW))
    return out.where("change = 'inserted'").select(
        "id", "symbol", "event_date", "event_type", "severity", "ratio", "amount", "db_price_at_detection",
        "yf_price_at_detection", "pct_difference", "status", "notes", "detected_at")


def _deletions(m: Market):
    return m.symbols.where("not coalesce(is_active, false)").select(
        "symbol", F.when(F.col("is_active").isNull(), day("1997-01-01")).alias("date_from"), day("1998-12-31").alias("date_to"))


@query
def delete_prices(m: Market):
    return merge.delete_prices_by(m.prices, _deletions(m))


@query
def deleted_count(m: Market):
    return merge.deleted_count(m.prices, _deletions(m))


@query
def register_symbols(m: Market):
    names = m.table("part").select(F.concat(F.lit("S"), "p_partkey").alias("symbol"))
    return merge.register_symbols(m.symbols, names, moment(NOW)).select(
        "symbol", "name", "is_active", "has_full_history", "created_at", "change")


@query
def set_active_symbols(m: Market):
    keep = m.symbol_changes.select(F.col("new_symbol").alias("symbol"))
    return merge.set_active_symbols(m.symbols, keep).select("symbol", "is_active")


@query
def deactivate_symbols(m: Market):
    gone = m.symbol_changes.select(F.col("old_symbol").alias("symbol"))
    return merge.deactivate_symbols(m.symbols, gone).select("symbol", "is_active")


@query
def symbols_not_found(m: Market):
    names = m.table("part").select(F.concat(F.lit("S"), "p_partkey").alias("symbol"))
    return merge.symbols_not_found(m.symbols, names)


@query
def event_status_update(m: Market):
    actions = m.corporate_events.where("severity <> 'low'").select(
        "id", F.expr("element_at(array('confirm', 'ignore', 'fixing', 'fixed', 'failed'), cast(id % 5 as int) + 1)").alias("action"),
        F.when(F.col("id") % 2 == 0, "noise").alias("reason"))
    return merge.event_status_update(m.corporate_events, actions, moment(NOW)).select(
        "id", "status", "notes", "fixed_at", "updated_at")


# --- F: consensus and adjusted prices -------------------------------------------------------------


@query
def consensus_close(m: Market):
    return _closes(consensus.consensus_close(m.prices_raw))


@query
def consensus_alerts(m: Market):
    return _closes(consensus.consensus_alerts(consensus.consensus_close(m.prices_raw)))


@query
def apply_consensus(m: Market):
    return consensus.apply_consensus(m.prices_raw, consensus.consensus_close(m.prices_raw)).select(
        "symbol", "date", "source", "close", "consensus_close")


SPAN = ("1990-01-01", "2030-12-31")  # all there is


@query
def collapse_raw(m: Market):
    return consensus.collapse_raw(m.prices_raw, *SPAN)


def _collapsed(m: Market, *columns: str):
    """The days of the raw table with their new consensus, written once: factors and rows both read them."""
    days = consensus.agreed_days(consensus.between(m.prices_raw, *SPAN)).where("consensus_close is not null")
    return relations.stored(days.select("symbol", "date", "consensus_close", *columns))


def _usable(m: Market):
    return consensus.confirmed_events(m.corporate_events, SPAN[1])


@query
def dividend_factors(m: Market):
    rows = consensus.dividend_factors(_collapsed(m), _usable(m))
    return rows.select("symbol", "ex_date", "dividend_amount", "prev_date", "prev_close", F.round("factor", 9).alias("factor"))


@query
def adjustment_factor(m: Market):
    rows = consensus.adjustment_factor(_collapsed(m), _usable(m))
    return rows.select("symbol", "date", F.round("factor", 9).alias("factor"))


@query
def derive_adjusted(m: Market):
    return consensus.adjusted_bars(_collapsed(m, "volume"), _usable(m), moment(NOW))


def _refresh(m: Market):
    m = m.shared
    return consensus.raw_price_refresh(m.prices_raw, m.raw_changes, m.corporate_events, _actions(m), m.prices, *RANGE,
                                       moment(NOW), store=relations.stored)


@query
def raw_price_refresh(m: Market):
    return _refresh(m).prices


@query
def refresh_counts(m: Market):
    return consensus.refresh_counts(_refresh(m))


def _delivery(m: Market):
    """The part of the changes that one delivery might bring: every ninth ticker's rows, every fifth ticker's actions."""
    some = lambda n: F.pmod(F.expr("cast(substr(symbol, 2) as bigint)"), F.lit(n)) == 0
    return m.raw_changes.where(some(9)), _actions(m).where(some(5))


@query
def raw_price_changes(m: Market):
    landed, actions = _delivery(m)
    return consensus.refresh_changes(m.prices_raw, landed, m.corporate_events, actions, *RANGE, moment(NOW), store=relations.stored).derived


VERIFY_DAY = "1998-06-30"


@query
def verify_two_sources(m: Market):
    return consensus.verify_two_sources(m.symbols, m.prices_raw, day(VERIFY_DAY))


@query
def verification_status(m: Market):
    return consensus.verification_status(consensus.verify_two_sources(m.symbols, m.prices_raw, day(VERIFY_DAY)))


# --- G: adjustment detection ----------------------------------------------------------------------


def _reference_events(m: Market):
    kind = (F.when(F.col("event_type").isin("split", "stock_split", "reverse_split"), "split")
            .when(F.col("event_type").isin("dividend", "special_dividend"), "dividend")
            .when(F.col("event_type") == "capital_gain", "capital_gain"))
    rows = m.corporate_events.select("symbol", "event_date", kind.alias("kind"),
                                     F.coalesce("split_ratio", "dividend_amount").cast("double").alias("value"))
    return rows.where("kind is not null and value <> 0")


SCAN_DAY = "2001-06-30"


def _scan(m: Market):
    m = m.shared
    return adjustments.detect_adjustments(m.symbols.where("coalesce(is_active, true)"), m.prices, m.reference_prices,
                                          _reference_events(m), day(SCAN_DAY), store=relations.stored)


def _pairs(m: Market):
    return m.prices.select("symbol", "date", F.col("close").alias("stored_close")).join(
        m.reference_prices.withColumnRenamed("close", "reference_close"), ["symbol", "date"])


@query
def price_deviation(m: Market):
    return adjustments.price_deviation(_pairs(m))


@query
def sample_points(m: Market):
    return adjustments.sample_points(m.prices, day(SCAN_DAY))


@query
def add_presplit_samples(m: Market):
    samples = adjustments.sample_points(m.prices, day(SCAN_DAY))
    return adjustments.add_presplit_samples(samples, m.prices, _reference_events(m).where("kind = 'split'"))


@query
def classify_deviation(m: Market):
    found = adjustments.price_deviation(_pairs(m)).where("significant").drop("significant")
    rows = adjustments.classify_deviation(found.withColumnRenamed("date", "check_date"), _reference_events(m))
    return _event_facts(rows)


def _event_facts(rows: DataFrame):
    """Details with zero for absent figures."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("split_count", "dividend_count")}
    return rows.withColumns({**zero, "cumulative_factor": F.round("cumulative_factor", 9)})


@query
def classify_split_details(m: Market):
    return adjustments.split_details(_scan(m).events, _reference_events(m))


@query
def detect_adjustments(m: Market):
    return _scan(m).symbols


@query
def detected_events(m: Market):
    return _event_facts(_scan(m).events)


@query
def scan_summary(m: Market):
    return adjustments.scan_summary(_scan(m))


@query
def scan_outcomes(m: Market):
    return adjustments.scan_outcomes(_scan(m))


@query
def adjustment_report(m: Market):
    report = adjustments.adjustment_report(adjustments.scan_report(_scan(m)), severity="critical")
    text = F.transform("events", lambda e: F.concat(e["check_date"].cast("string"), F.lit("="), e["event_type"]))
    return report.select("symbol", "needs_refresh", "max_pct_diff", F.array_join(text, ";").alias("events"))


@query
def fix_plan(m: Market):
    scan = _scan(m)
    recorded = merge.record_events(m.corporate_events, scan.events, moment(NOW))
    return adjustments.fix_plan(adjustments.first_events(scan, recorded), m.shared.prices, day(SCAN_DAY))


# --- H: corporate events --------------------------------------------------------------------------


def _event_row(df: DataFrame):
    keep = ["id", "symbol", "event_date", "event_type", "ratio", "amount", "status", "severity", "detected_at"]
    return df.select(*keep, *[c for c in ("total",) if c in df.columns])


@query
def events_listing(m: Market):
    return _event_row(events.events_listing(m.corporate_events, page=2, page_size=20, status="confirmed",
                                            start="1996-01-01", end="2001-06-30"))


@query
def events_listing_after(m: Market):
    return _event_row(events.events_listing_after(m.corporate_events, after=("1998-06-30 00:00:00", 0), page_size=50))


@query
def events_by_symbol(m: Market):
    return _event_row(events.events_by_symbol(m.corporate_events, "S3"))


@query
def pending_events(m: Market):
    return _event_row(events.pending_events(m.corporate_events))


@query
def dividend_calendar(m: Market):
    return _event_row(events.dividend_calendar(m.corporate_events, "1996-01-01", "2000-12-31"))


@query
def split_history(m: Market):
    return _event_row(events.split_history(m.corporate_events))


# --- I: vendor comparison -------------------------------------------------------------------------


@query
def source_point_grid(m: Market):
    return _grid(m).withColumn("volume", F.coalesce("volume", F.lit(0)))


@query
def source_summary(m: Market):
    rows = compare.source_summary(_grid(m))
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.endswith("_diff") or "_vs_" in c or c.endswith("_adj")})


@query
def source_scorecard(m: Market):
    rows = compare.source_scorecard(compare.source_summary(_grid(m)))
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.startswith("max_")})


@query
def stored_vs_vendor_diff(m: Market):
    return compare.stored_vs_vendor_diff(m.prices, m.reference_prices)


@query
def month_end_dates(m: Market):
    return compare.month_end_dates(m.prices)


@query
def momentum_score(m: Market):
    return compare.month_end_momentum(m.prices)


@query
def momentum_reversal_risk(m: Market):
    rows = compare.momentum_reversal_risk(m.reference_prices, m.prices)
    return rows.withColumns({c: F.round(c, 9) for c in ("top_margin", "top_error_bound")})


# --- J: fetch jobs --------------------------------------------------------------------------------


@query
def jobs_listing(m: Market):
    rows = jobs.jobs_listing(m.jobs, moment(JOBS_AS_OF), status="processing", created_from="1999-01-01", limit=50, offset=10)
    return rows.select("job_id", "status", "created_at", "started_at", "completed_at", "duration_seconds", "total")


@query
def jobs_listing_after(m: Market):
    rows = jobs.jobs_listing_after(m.jobs, moment(JOBS_AS_OF), after=("1998-06-30 12:00:00", ""), limit=200)
    return rows.select("job_id", "status", "created_at", "started_at", "completed_at", "duration_seconds")


@query
def job_outcome(m: Market):
    return jobs.job_outcome(m.jobs)


@query
def job_queue_status(m: Market):
    return jobs.job_queue_status(m.jobs, moment(JOBS_AS_OF))


@query
def cancel_jobs(m: Market):
    asked = m.jobs.where("priority = 'high'").select("job_id")
    return jobs.cancel_jobs(m.jobs, asked, moment(JOBS_AS_OF)).select("job_id", "status", "completed_at", "cancelled")


@query
def purge_jobs(m: Market):
    return jobs.purge_jobs(m.jobs, moment("1999-06-30 00:00:00"), 30, keep_failed=False).select("job_id", "status", "created_at")


@query
def purged_count(m: Market):
    return jobs.purged_count(m.jobs, moment("1999-06-30 00:00:00"), 30, keep_failed=False)


@query
def run_status(m: Market):
    return jobs.run_status(_runs(m), batch_size=10)


def _runs(m: Market):
    return m.table("lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("run_id"), F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_quantity")).cast("bigint").alias("rows"))


@query
def run_affected(m: Market):
    return jobs.run_affected(_runs(m))


@query
def create_jobs(m: Market):
    return jobs.create_jobs(m.job_requests, day(AS_OF))


@query
def next_pending(m: Market):
    return jobs.next_pending(m.jobs).select("job_id", "created_at", "symbols")


# --- K: reports and resampling --------------------------------------------------------------------


@query
def latency_report(m: Market):
    rows = ops.latency_report(m.timings)
    return rows.withColumns({"avg": F.round("avg", 6), "recent_avg": F.round("recent_avg", 6)})


@query
def slowest_operations(m: Market):
    return ops.slowest_operations(m.timings)


@query
def load_test_summary(m: Market):
    rows = ops.load_test_summary(m.load_test)
    return rows.withColumns({c: F.round(c, 6) for c in ("total_time_s", "avg_latency_ms", "p50_latency_ms", "throughput_rps")})


@query
def resample_ohlcv(m: Market):
    out = None
    for interval in ops.UNITS:
        one = ops.resample_ohlcv(m.prices, interval).withColumn("interval", F.lit(interval))
        out = one if out is None else out.unionByName(one)
    return out


# --- S: streams -----------------------------------------------------------------------------------


def _stream(m: Market, df: DataFrame, name: str, folder: str, order: str | None = None, slices: int = 6) -> DataFrame:
    """Land a frame as files and read them back as a stream; by slices of the time ``order``, a batch each, if given.

    The time bounds go down to the tables that the frame reads, so that no slice computes another's rows and no row is
    shuffled to be landed. A slice has at most ``files`` files; empty ones make up for those it lacks, so that no batch
    takes files of the next slice.
    """
    path, files = f"{folder}/{name}", m.spark.sparkContext.defaultParallelism
    if order is None:
        df.write.parquet(path)
    else:
        at = F.unix_seconds(F.col(order).cast("timestamp"))
        first, last = df.agg(F.min(at), F.max(at)).collect()[0]
        step = (last - first) // slices + 1
        none = m.spark.createDataFrame([], df.schema).coalesce(1)
        for i in range(slices):
            df.where((at >= first + i * step) & (at < first + (i + 1) * step)).coalesce(files).write.mode("append").parquet(path)
            for _ in range((i + 1) * files - len(m.spark.read.schema(df.schema).parquet(path).inputFiles())):
                none.write.mode("append").parquet(path)
    return m.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_upsert_prices(m: Market):
    folder = scratch(m)
    arriving = _stream(m, m.price_changes, "arriving", folder)
    streams.stream_upsert_prices(arriving, f"{folder}/log", f"{folder}/state").awaitTermination()
    return streams.price_table(m.prices, streams.price_log(m.spark, f"{folder}/log"))


DELAY = "30 days"


@query
def stream_consensus(m: Market):
    """Vendor rows in the order of their days; a day's state goes once the newest is a month later."""
    folder = scratch(m)
    rows = streams.stream_consensus(_stream(m, m.prices_raw, "raw", folder, order="date"), delay=DELAY)
    streams.drain_updates(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    latest = streams.newest_updates(m.spark, f"{folder}/out", ["symbol", "date"], ["consensus_close"])
    return latest


@query
def stream_late_rows(m: Market):
    """Rows that come a second time, corrected, when their day has passed: dropped, counted, and left to the batch refresh."""
    folder = scratch(m)
    raw = m.prices_raw.drop("consensus_close")
    stream = _stream(m, raw, "raw", folder, order="date")
    m.raw_changes.where("volume % 400 = 0 and date < DATE'2000-01-01'").select(raw.columns).write.mode("append").parquet(f"{folder}/raw")
    counter = streams.LateRows()
    m.spark.streams.addListener(counter)
    try:
        streams.drain_updates(streams.stream_consensus(stream, delay=DELAY), f"{folder}/out", f"{folder}/state").awaitTermination()
        dropped = counter.wait()
    finally:
        m.spark.streams.removeListener(counter)
    days = streams.newest_updates(m.spark, f"{folder}/out", ["symbol", "date"], ["consensus_close"])
    return days.agg(F.count(F.lit(1)).alias("days"), F.count("consensus_close").alias("agreed")).withColumn("dropped", F.lit(dropped))


@query
def stream_error_counts(m: Market):
    folder = scratch(m)
    source = m.table("events").where("event_type = 'error'").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("kind"))
    rows = streams.stream_error_counts(_stream(m, source, "errors", folder, order="ts"), F.col("kind"))
    streams.drain_updates(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    return streams.newest_updates(m.spark, f"{folder}/out", ["window_start", "error_type"], ["n"])
