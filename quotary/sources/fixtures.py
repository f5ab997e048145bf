"""The seven relations, and the inputs around them, derived from the test tables.

``lineitem`` gives prices (supplier = ticker, ship date = trading day, price
per unit in whole cents = close), ``supplier`` and ``nation`` the ticker list,
``events`` economic series and timings, ``orders`` fetch jobs. Prices are
computed in whole cents so that they are the same in every engine.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.sources.relations import stored

AS_OF = "2001-11-05"
JOBS_AS_OF = "2001-08-01 12:00:00"
RANGE = ("1995-01-01", "2001-12-31")


def _money(cents) -> Column:
    return F.expr(cents).cast("double") / F.lit(100.0)


def _decimal(mills: str) -> Column:
    """Thousandths of a dollar as decimal(18,6).

    Intervals are whole microseconds and become decimals as they are; products of decimals are several times slower.
    """
    return F.expr(f"cast(interval '0.001' second * ({mills}) as decimal(18,6))")


def change_date(k: str) -> Column:
    return F.expr(f"date_add(DATE'1996-01-01', cast({k} * 37 % 1800 as int))")


def renamed(k: str) -> Column:
    return F.expr(f"{k} % 5 = 0")


def ticker(k: str, day: str) -> Column:
    new_name = renamed(k) & (F.col(day) >= change_date(k))
    return F.concat(F.when(new_name, "N").otherwise("S"), F.col(k).cast("string"))


def _clock(day: str, seconds: str) -> Column:
    return F.expr(f"timestamp_seconds(cast(unix_date({day}) as bigint) * 86400 + {seconds})")


class Market:
    """Lazy DataFrames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _days(self) -> DataFrame:
        """One row per supplier and ship date, in cents."""
        lines = self.table("lineitem").select(
            F.col("l_suppkey").alias("k"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.expr("cast(floor(l_extendedprice * 100 + 0.5) as bigint) div cast(l_quantity as bigint)").alias("cents"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.col("l_orderkey").alias("ok"))
        days = lines.groupBy("k", "date").agg(
            F.min("cents").alias("lo"), F.max("cents").alias("hi"),
            F.expr("sum(cents) div count(*)").alias("mid"),
            (F.sum("qty") * 100).alias("volume"), F.sum("ok").alias("ok"))
        opening = F.expr("mid - mid div 333 + (mid div 1000) * (ok % 7)")
        return (days.withColumn("op", opening)
                .withColumn("lo", F.least("lo", "op")).withColumn("hi", F.greatest("hi", "op")))

    @cached_property
    def shared(self) -> "Market":
        """The same relations over days that are written once: for queries that read prices several times."""
        market = Market(self.spark, self.sf_dir)
        market._days = stored(self._days)
        return market

    @cached_property
    def prices(self) -> DataFrame:
        d = self._days
        symbol = F.when(renamed("k") & F.expr("ok % 11 = 0"), F.concat(F.lit("N"), F.col("k").cast("string")))
        return d.select(
            F.coalesce(symbol, ticker("k", "date")).alias("symbol"), "date",
            _money("op").alias("open"), _money("hi").alias("high"),
            _money("lo").alias("low"), _money("mid").alias("close"),
            "volume", F.lit("yfinance").alias("source"),
            _clock("date", "64800 + ok % 3600").alias("last_updated"))

    @cached_property
    def prices_raw(self) -> DataFrame:
        offsets = """array(
            named_struct('source', 'eodhd', 'off', 0, 'wait', 0, 'there', ok % 13 <> 0),
            named_struct('source', 'tiingo', 'off', element_at(array(0, 1, 10, 25), cast(ok % 4 as int) + 1),
                         'wait', 60, 'there', ok % 7 <> 0),
            named_struct('source', 'alpaca', 'off', element_at(array(0, 11, 20, 40, 100), cast(ok % 5 as int) + 1),
                         'wait', 120, 'there', ok % 3 <> 0))"""
        rows = self._days.select("*", F.inline(F.expr(offsets))).where("there")
        return rows.select(
            ticker("k", "date").alias("symbol"), "date", "source",
            _decimal("op * 10 + off").alias("open"), _decimal("hi * 10 + off").alias("high"),
            _decimal("lo * 10 + off").alias("low"), _decimal("mid * 10 + off").alias("close"),
            "volume", _clock("date", "72000 + wait").alias("fetched_at"),
            F.when(F.expr("ok % 17 = 0"), _decimal("mid * 10")).alias("consensus_close"))

    @cached_property
    def raw_changes(self) -> DataFrame:
        """A later delivery: corrected closes for some rows, and one new day per ticker and day's end."""
        raw = self.prices_raw.drop("consensus_close")
        fixed = raw.where("volume % 400 = 0").withColumn(
            "close", (F.col("close") + F.lit("0.005").cast("decimal(18,6)")).cast("decimal(18,6)"))
        fixed = fixed.withColumn("high", F.greatest("high", "close"))
        moved = raw.where("volume % 900 = 0").withColumn("date", F.date_add("date", 3000))
        return fixed.unionByName(moved).withColumn(
            "fetched_at", F.expr("fetched_at + interval 2 days"))

    @cached_property
    def price_changes(self) -> DataFrame:
        """Incoming rows: some newer, some older, some as old, some for new days."""
        p = self.prices
        shift = F.expr("element_at(array(-1, 0, 1), cast(volume div 100 % 3 as int) + 1)")
        known = p.where("volume % 500 <> 0").withColumn("_d", shift)
        fresh = p.where("volume % 700 = 0").withColumn("_d", F.lit(5)).withColumn("date", F.date_add("date", 3000))
        return (known.unionByName(fresh)
                .withColumn("close", F.col("low"))
                .withColumn("source", F.lit("vendor"))
                .withColumn("last_updated", F.expr("last_updated + make_interval(0, 0, 0, _d, 0, 0, 0)"))
                .drop("_d"))

    @cached_property
    def symbols(self) -> DataFrame:
        s = self.table("supplier").withColumnRenamed("s_suppkey", "k")
        own = s.select(
            F.explode(F.expr("filter(array(concat('S', k), if(k % 5 = 0, concat('N', k), null)), x -> x is not null)"))
            .alias("symbol"),
            F.when(F.col("s_acctbal") < 9500, F.col("s_name")).alias("name"),
            F.expr("element_at(array('NYSE', 'NASDAQ', null), s_nationkey % 3 + 1)").alias("exchange"),
            F.when(F.col("s_acctbal") >= 0, "USD").alias("currency"),
            F.when(F.col("s_acctbal") < 0, False).when(F.col("s_acctbal") < 9000, True).alias("is_active"),
            (F.col("s_acctbal") > 5000).alias("has_full_history"),
            F.when(F.col("s_acctbal") > 4000, F.expr("date_add(DATE'1994-06-01', s_nationkey * 40)")).alias("first_date"),
            F.when(F.col("s_acctbal") > 4000, F.expr("date_add(DATE'2001-10-01', s_nationkey * 2)")).alias("last_date"),
            F.expr("timestamp_seconds(757382400 + cast(k as bigint) * 60)").alias("created_at"))
        idle = self.table("nation").select(
            F.concat(F.lit("X"), "n_nationkey").alias("symbol"), F.col("n_name").alias("name"),
            F.lit(None).cast("string").alias("exchange"), F.lit("USD").alias("currency"),
            F.lit(True).alias("is_active"), F.lit(False).alias("has_full_history"),
            F.when(F.col("n_regionkey") == 0, F.lit("1999-01-04").cast("date")).alias("first_date"),
            F.lit(None).cast("date").alias("last_date"),
            F.expr("timestamp_seconds(757382400)").alias("created_at"))
        return own.unionByName(idle)

    @cached_property
    def symbol_changes(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").alias("k")).where(renamed("k"))
        return s.select(F.concat(F.lit("S"), "k").alias("old_symbol"), F.concat(F.lit("N"), "k").alias("new_symbol"),
                        change_date("k").alias("change_date"), F.lit("rename").alias("reason"))

    @cached_property
    def corporate_events(self) -> DataFrame:
        """Line items with a high discount and tax stand for corporate actions."""
        lines = (self.table("lineitem").where("l_discount >= 0.09 and l_tax >= 0.06")
                 .select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("event_date"),
                         F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("bigint").alias("qty"),
                         F.col("l_orderkey").alias("ok")))
        lines = lines.groupBy("k", "event_date", "n").agg(F.min("qty").alias("qty"), F.max("ok").alias("ok"))
        kinds = ("array('dividend', 'split', 'stock_split', 'reverse_split', 'special_dividend', "
                 "'capital_gain', 'spinoff')")
        ratios = "array(2.0, 3.0, 0.5, 1.5, 0.0, 4.0)"
        is_split = F.col("event_type").isin("split", "stock_split", "reverse_split")
        is_cash = F.col("event_type").isin("dividend", "special_dividend", "capital_gain")
        e = (lines.withColumn("event_type", F.expr(f"element_at({kinds}, n)"))
             .withColumn("split_ratio", F.when(is_split, F.expr(f"element_at({ratios}, cast(qty % 6 as int) + 1)"))
                         .cast("decimal(18,8)"))
             .withColumn("dividend_amount", F.when(is_cash, (F.col("qty") - 1) / F.lit(4.0)).cast("decimal(18,8)")))
        return e.select(
            F.expr("(k * 10000 + datediff(event_date, DATE'1995-01-01')) * 8 + n").alias("id"),
            ticker("k", "event_date").alias("symbol"), "event_date", "event_type",
            F.col("split_ratio").cast("decimal(38,6)").alias("ratio"),
            F.col("dividend_amount").cast("decimal(18,4)").alias("amount"),
            "dividend_amount", "split_ratio", F.lit("USD").alias("currency"),
            F.col("event_date").alias("ex_date"),
            F.lit(None).cast("date").alias("record_date"), F.lit(None).cast("date").alias("pay_date"),
            F.when(F.expr("ok % 4 <> 0"), _clock("event_date", "3600")).alias("confirmed_at"),
            F.when(F.expr("ok % 4 <> 0"), F.lit(1)).alias("source_count"),
            F.when(F.expr("ok % 4 <> 0"), F.array(F.struct(F.lit("eodhd").alias("source")))).alias("sources_json"),
            _clock("event_date", "ok % 86400").alias("detected_at"),
            F.lit("auto").alias("detection_method"),
            F.lit(None).cast("decimal(18,4)").alias("db_price_at_detection"),
            F.lit(None).cast("decimal(18,4)").alias("yf_price_at_detection"),
            F.lit(None).cast("decimal(18,6)").alias("pct_difference"),
            F.expr("element_at(array('critical', 'high', 'normal', 'low'), cast(ok % 4 as int) + 1)").alias("severity"),
            F.expr("element_at(array('detected', 'confirmed', 'fixing', 'fixed', 'ignored', 'failed', null), "
                   "cast(ok % 7 as int) + 1)").alias("status"),
            F.lit(None).cast("timestamp").alias("fixed_at"), F.lit(None).cast("string").alias("fix_job_id"),
            F.lit(None).cast("bigint").alias("rows_deleted"), F.lit(None).cast("bigint").alias("rows_refetched"),
            F.lit(None).cast("string").alias("source_data"), F.lit(None).cast("string").alias("notes"),
            _clock("event_date", "0").alias("created_at"), _clock("event_date", "0").alias("updated_at"))

    @cached_property
    def reference_prices(self) -> DataFrame:
        """Vendor-adjusted closes: most equal the stored ones, some deviate, some are missing."""
        p = self.prices.where("volume % 1100 <> 0")
        cents = F.expr("cast(floor(close * 100 + 0.5) as bigint)")
        factor = F.expr("element_at(array(1000, 1000, 1000, 999, 970, 880, 500, 2000), "
                        "cast(volume div 100 % 8 as int) + 1)")
        return p.select("symbol", "date", (cents * factor / F.lit(100000.0)).alias("close"))

    @cached_property
    def economic(self) -> DataFrame:
        e = self.table("events").select(
            F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("ts").cast("date").alias("date"),
            F.expr("cast(floor(value * 100 + 0.5) as bigint)").alias("cents"),
            F.col("event_id"))
        return e.groupBy("symbol", "date").agg(F.sum("cents").alias("c"), F.max("event_id").alias("e")).select(
            "symbol", "date", F.when(F.expr("e % 9 <> 0"), F.col("c") / F.lit(100.0)).alias("value"),
            _clock("date", "43200 + e % 3600").alias("last_updated"))

    @cached_property
    def economic_changes(self) -> DataFrame:
        e = self.economic.where("value is not null")
        moved = e.where("value > 100").withColumn("date", F.date_add("date", 40))
        return (e.where("value > 50").withColumn("value", F.col("value") + 1).unionByName(moved)
                .withColumn("last_updated", F.expr("last_updated + interval 1 days")))

    @cached_property
    def series_listing(self) -> DataFrame:
        return self.table("customer").select(
            F.concat(F.lit("U"), "c_custkey").alias("symbol"), F.col("c_name").alias("name"),
            F.lit("Daily").alias("frequency"), F.lit("Percent").alias("units"))

    @cached_property
    def observations(self) -> DataFrame:
        text = (F.when(F.col("event_type") == "error", ".").when(F.col("event_type") == "signup", "n/a")
                .otherwise(F.col("value").cast("string")))
        day = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")
        return self.table("events").select(
            F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), "event_id",
            F.when((F.col("event_type") == "view") & (F.col("value") > 100), "2024-13-01").otherwise(day).alias("date"),
            text.alias("value"))

    @cached_property
    def jobs(self) -> DataFrame:
        o = self.table("orders").select(
            F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"),
            F.col("o_orderpriority").alias("pr"), F.col("o_orderdate").cast("date").alias("d"))
        status = (F.when(F.col("st") == "F", F.expr("element_at(array('completed', 'completed_errors', 'failed'), "
                                                    "cast(k % 3 as int) + 1)"))
                  .when(F.col("st") == "O", F.expr("if(k % 4 = 0, 'processing', 'pending')"))
                  .otherwise(F.expr("if(k % 2 = 0, 'cancelled', 'completed')")))
        done = F.col("status").isin("completed", "completed_errors", "failed")
        result = ("transform(symbols, (s, i) -> named_struct('symbol', s, "
                  "'status', element_at(array('success', 'success', 'failed', 'no_data'), cast((k + i) % 4 as int) + 1), "
                  "'rows_fetched', if((k + i) % 4 < 2, (c + i) % 500, 0L), "
                  "'error', if((k + i) % 4 = 2, 'timeout', null)))")
        return (o.withColumn("status", status)
                .withColumn("symbols", F.expr(
                    "filter(array(concat('S', c % 97), concat('S', k % 89), if(k % 3 = 0, concat('S', c % 11), null)), "
                    "x -> x is not null)"))
                .withColumn("created_at", _clock("d", "k % 86400"))
                .withColumn("started_at", F.when(F.col("status") != "pending", F.expr("created_at + interval 30 seconds")))
                .withColumn("completed_at", F.when(done, F.expr("started_at + make_interval(0, 0, 0, 0, 0, 0, c % 4000)")))
                .select(F.concat(F.lit("job_"), "k").alias("job_id"), "status", "symbols",
                        F.date_sub("d", 300).alias("date_from"), F.col("d").alias("date_to"),
                        F.lit("1d").alias("interval"), F.expr("k % 2 = 0").alias("force_refresh"),
                        F.when(F.col("pr").isin("1-URGENT", "2-HIGH"), "high").when(F.col("pr") == "5-LOW", "low")
                        .otherwise("normal").alias("priority"),
                        F.lit(None).cast("string").alias("progress"),
                        F.when(done, F.expr(result)).alias("results"), F.lit(None).cast("string").alias("errors"),
                        "created_at", "started_at", "completed_at",
                        F.concat(F.lit("user"), F.col("c") % 50).alias("created_by")))

    @cached_property
    def job_requests(self) -> DataFrame:
        """What callers ask for, with mistakes of every kind."""
        o = self.table("orders").select(
            F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("pr"),
            F.col("o_orderdate").cast("date").alias("d"))
        return o.select(
            F.concat(F.lit("req_"), "k").alias("request_id"),
            F.expr("case when c % 50 = 0 then array() when c % 50 = 1 then array('bad symbol!') "
                   "when c % 50 = 2 then transform(sequence(1, 101), i -> concat('T', i)) "
                   "else array(concat('s', c), concat('S', c), '^vix', concat('brk.', substr(pr, 1, 1))) end").alias("symbols"),
            F.date_sub("d", F.expr("cast(element_at(array(30, 400, -20, 4000, 9000), cast(k % 5 as int) + 1) as int)"))
            .alias("date_from"),
            F.date_add("d", F.expr("cast(if(k % 7 = 0, 2000, 0) as int)")).alias("date_to"),
            F.expr("element_at(array('1d', '1wk', '1mo', '3mo', '2h'), cast(k % 5 as int) + 1)").alias("interval"),
            F.expr("k % 2 = 0").alias("force"),
            F.expr("case pr when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' when '5-LOW' then 'low' "
                   "else 'normal' end").alias("priority"),
            _clock("d", "k % 86400").alias("created_at"))

    @cached_property
    def quotes(self) -> DataFrame:
        """A vendor frame as delivered: capitalised columns, holes, bad values, inline actions."""
        cents = "(cast(floor(l_extendedprice * 100 + 0.5) as bigint) div cast(l_quantity as bigint))"
        return self.table("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(F.col("l_discount") != 0.01, _money(cents)).alias("Open"),
            F.when(F.col("l_discount") == 0.02, _money(f"{cents} - 50")).otherwise(_money(f"{cents} + 50")).alias("High"),
            F.when(F.col("l_discount") == 0.03, F.lit(0.0)).otherwise(_money(f"{cents} - 25")).alias("Low"),
            F.when(F.col("l_discount") == 0.04, F.lit(float("nan"))).otherwise(_money(f"{cents} + 10")).alias("Close"),
            _money(cents).alias("Adj Close"),
            F.when(F.col("l_discount") == 0.05, -F.col("l_quantity")).when(F.col("l_discount") == 0.06, F.lit(None))
            .otherwise(F.col("l_quantity") + 0.5).alias("Volume"),
            F.expr("case when l_discount = 0.07 then 2.0D when l_discount = 0.08 then 0.5D "
                   "when l_discount = 0.09 then null else 0.0D end").alias("Stock Splits"),
            F.expr("case when l_tax = 0.08 then l_quantity / 100 when l_tax = 0.07 then null else 0.0D end")
            .alias("Dividends"),
            F.col("l_orderkey").alias("line_key"), F.col("l_linenumber").alias("line_no"))

    @cached_property
    def typed_tickers(self) -> DataFrame:
        suffixes = "array('.b', '.TO', '.t', '.XYZ', '', '.1', ' ', '.twO')"
        stem = "concat(' ', lower(substr(c_mktsegment, 1, 4)), c_custkey % 100, "
        return self.table("customer").select(
            F.col("c_custkey").alias("request_id"),
            F.expr(f"case when c_acctbal < -900 then null when c_acctbal < -800 then '  ' "
                   f"when c_acctbal < 0 then concat('^', lower(substr(c_mktsegment, 1, 3)), '.b') "
                   f"else {stem} element_at({suffixes}, c_nationkey % 8 + 1)) end").alias("raw"))

    @cached_property
    def symbol_lists(self) -> DataFrame:
        long_list = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("L"), i.cast("string"))), ",")
        return self.table("orders").select(
            F.col("o_orderkey").alias("request_id"),
            F.concat(F.lit("s"), F.col("o_custkey"), F.lit(", S"), F.col("o_custkey"), F.lit(" ,brk.b,,^vix, "),
                     F.lower("o_orderstatus"), F.lit(".to,BRK-B,"),
                     F.when(F.col("o_orderpriority") == "1-URGENT", long_list).otherwise(F.lit("")))
            .alias("symbols"))

    @cached_property
    def coverage_requests(self) -> DataFrame:
        """One price request per listed ticker, and the period it wants covered."""
        return self.symbols.select(
            "symbol",
            F.expr("date_add(DATE'1995-01-10', cast(unix_timestamp(created_at) div 60 % 400 as int))").alias("date_from"),
            F.expr("date_add(DATE'2001-10-20', cast(unix_timestamp(created_at) div 60 % 16 as int))").alias("date_to"))

    @cached_property
    def range_requests(self) -> DataFrame:
        """Ranges fetched per customer: order date, and some weeks on."""
        return self.table("orders").select(
            F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"),
            F.col("o_orderdate").cast("date").alias("start"),
            F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 40 as int))").alias("end"))

    @cached_property
    def timings(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
            F.col("value").alias("duration"))

    @cached_property
    def load_test(self) -> DataFrame:
        return self.table("events").select(
            F.expr("cast(user_id % 6 + 1 as int) * 4").alias("concurrency"),
            (F.col("event_type") != "error").alias("ok"),
            F.col("value").alias("elapsed_ms"),
            F.date_trunc("second", F.col("ts").cast("timestamp")).alias("started_at"))
