"""SQL for the registered queries, to be run on the same tables by another engine."""

from quotary.functions.tickers import EXCHANGE_SUFFIXES
from quotary.operators.adjustments import ADVICE
from quotary.plans.views import with_views

#: Three statements end in ORDER BY: read with a LIMIT around them, joins of union views do not come to an end in the other engine.
ORACLE = {}


def sql(name: str, views: str, body: str) -> None:
    ORACLE[name] = with_views(body, *views.split())


def _s(*cols: str) -> str:
    return ", ".join(f'CAST({c} AS VARCHAR) AS "{c}"' for c in cols)


OHLC = "open, high, low, close"
DBL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close"))

# --- A --------------------------------------------------------------------------------------------

sql("load_relations", "symbols changes prices raw ev econ jobs", " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(*) AS n_rows, count(DISTINCT ({k})) AS n_keys, CAST(min({d}) AS VARCHAR) AS first_day, "
    f"CAST(max({d}) AS VARCHAR) AS last_day FROM {v}" for n, v, k, d in [
        ("symbols", "symbols", "symbol", "CAST(NULL AS DATE)"), ("symbol_changes", "changes", "old_symbol, change_date", "CAST(NULL AS DATE)"),
        ("prices", "prices", "symbol, date", "date"), ("prices_raw", "raw", "symbol, date, source", "date"),
        ("corporate_events", "ev", "symbol, event_date, event_type", "event_date"), ("economic_indicators", "econ", "symbol, date", "date"),
        ("fetch_jobs", "jobs", "job_id", "CAST(NULL AS DATE)")]))
for _name, _src in (("ingest_vendor_eod", "eodhd"), ("ingest_vendor_iso", "tiingo"), ("ingest_vendor_bars", "alpaca")):
    sql(_name, "raw", f"SELECT symbol, {_s('date')}, source, {DBL}, volume FROM raw WHERE source = '{_src}'")
sql("vendor_rejects", "raw", """
    WITH r AS (SELECT CASE WHEN symbol = 'S1' THEN 'VIX' ELSE symbol END AS symbol, source, date, volume, volume // 100 AS v FROM raw),
    t AS (SELECT *, CASE WHEN symbol = 'VIX' AND source <> 'eodhd' THEN 'unsupported' WHEN symbol LIKE '%3' THEN 'payload' WHEN v % 13 = 0 OR v % 17 = 0 THEN 'day'
            WHEN v % 11 = 0 OR v % 19 = 0 THEN 'price' WHEN v % 7 = 0 THEN 'volume' ELSE 'taken' END AS outcome FROM r)
    SELECT source, symbol, outcome, count(*) AS n, count(*) FILTER (NOT (v % 13 = 0 OR v % 17 = 0)) AS n_days,
           CAST(sum(CASE WHEN v % 7 = 0 OR v % 5 = 0 THEN 0 ELSE volume END) AS BIGINT) AS volume FROM t WHERE outcome <> 'payload' GROUP BY ALL
    UNION ALL SELECT source, symbol, outcome, count(DISTINCT year(date)), 0, 0 FROM t WHERE outcome = 'payload' GROUP BY ALL""")
sql("union_raw_sources", "raw", f"""
    SELECT * FROM (SELECT CASE WHEN symbol = 'S1' THEN 'VIX' ELSE symbol END AS symbol, {_s('date')}, source, {DBL}, volume
                   FROM raw) WHERE NOT (symbol = 'VIX' AND source IN ('alpaca', 'tiingo'))""")
sql("clean_quote_frame", "quotes", f"""
    SELECT symbol, {_s('date')}, open, high, low, CASE WHEN isnan(close) THEN -1.0 ELSE close END AS close, volume,
           line_key, CAST(line_no AS BIGINT) AS line_no FROM quotes""")
sql("parse_economic_observations", "obs", """
    SELECT symbol, event_id, CAST(TRY_CAST(date AS DATE) AS VARCHAR) AS date, TRY_CAST(value AS DOUBLE) AS value
    FROM obs WHERE value <> '.' AND TRY_CAST(date AS DATE) IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NOT NULL""")
sql("parse_corporate_actions", "ev", """
    SELECT symbol, CAST(d AS VARCHAR) AS event_date, event_type,
           CASE WHEN v <> 4 AND event_type = 'dividend' THEN x END AS dividend_amount,
           CASE WHEN v <> 4 AND event_type = 'split' THEN x END AS split_ratio,
           CASE WHEN v = 4 THEN 'reject' ELSE 'action' END AS outcome
    FROM (SELECT symbol, event_type, id % 6 AS v, CASE WHEN id % 6 = 5 THEN event_date + 30 ELSE event_date END AS d,
                 CAST(coalesce(dividend_amount, split_ratio) AS DOUBLE) AS x
          FROM ev WHERE event_type IN ('dividend', 'split'))
    WHERE d <= DATE '2000-01-01' AND v <> 3 AND NOT (v IN (0, 5) AND x = 0)""")
sql("extract_inline_events", "quotes", f"""
    SELECT symbol, {_s('date')}, CASE WHEN splits >= 1 THEN 'stock_split' ELSE 'reverse_split' END AS event_type,
           splits AS ratio, CAST(NULL AS DOUBLE) AS amount FROM quotes WHERE splits <> 0
    UNION ALL SELECT symbol, {_s('date')}, 'dividend', NULL, dividends FROM quotes WHERE dividends <> 0""")
_SUFFIXES = ", ".join(f"'{x}'" for x in EXCHANGE_SUFFIXES)
_ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items())


def _norm(x: str) -> str:
    s = f"upper(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"
    tail = f"split_part({s}, '.', -1)"
    return f"""CASE WHEN {s} LIKE '^%' OR position('.' IN {s}) = 0 OR {tail} IN ({_SUFFIXES}) THEN {s}
        WHEN length({tail}) = 1 AND {tail} BETWEEN 'A' AND 'Z'
        THEN substr({s}, 1, length({s}) - 2) || '-' || {tail} ELSE {s} END"""


sql("parse_symbol_list", "symbol_lists", f"""
    WITH items AS (SELECT request_id, unnest(string_split(symbols, ',')) AS item,
                          unnest(range(len(string_split(symbols, ',')))) AS pos FROM symbol_lists),
    firsts AS (SELECT request_id, {_norm('item')} AS symbol, min(pos) AS pos FROM items WHERE trim(item) <> '' GROUP BY 1, 2)
    SELECT request_id, symbol, pos, count(*) OVER (PARTITION BY request_id) AS n_symbols,
           count(*) OVER (PARTITION BY request_id) > 10 AS over_fetch_limit,
           count(*) OVER (PARTITION BY request_id) > 100 AS over_local_limit FROM firsts""")

_RECENT = """SELECT s.symbol, s.name, s.exchange, s.currency, s.is_active, p.data_start, p.data_end,
       coalesce(p.data_days, 0) AS data_days, coalesce(p.row_count, 0) AS row_count, p.last_updated,
       coalesce(p.has_gaps, FALSE) AS has_gaps
    FROM symbols s LEFT JOIN (
      SELECT symbol, min(date) AS data_start, max(date) AS data_end, count(DISTINCT date) AS data_days, count(*) AS row_count,
             max(last_updated) AS last_updated,
             CAST(count(*) AS DOUBLE) < CAST(date_diff('day', min(date), max(date)) + 1 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS has_gaps
      FROM prices WHERE date >= DATE '2001-11-05' - INTERVAL 5 YEARS GROUP BY symbol) p USING (symbol)"""
sql("export_coverage_csv", "symbols prices", f"""
    SELECT symbol, coalesce(name, '') AS name, coalesce(exchange, '') AS exchange, coalesce(currency, '') AS currency,
           CASE WHEN is_active THEN 'True' WHEN NOT is_active THEN 'False' ELSE '' END AS is_active,
           coalesce(CAST(data_start AS VARCHAR), '') AS data_start, coalesce(CAST(data_end AS VARCHAR), '') AS data_end,
           CAST(data_days AS VARCHAR) AS data_days, CAST(row_count AS VARCHAR) AS row_count,
           coalesce(strftime(last_updated, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS last_updated,
           CASE WHEN has_gaps THEN 'True' ELSE 'False' END AS has_gaps
    FROM ({_RECENT})""")
_GRID = """grid AS (
      SELECT s.symbol, d.date, src.source FROM symbols s,
        (SELECT max(CAST(x AS DATE)) AS date FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(x)
         WHERE isodow(x) < 6 GROUP BY date_trunc('month', x)) d, (VALUES ('eodhd'), ('tiingo'), ('alpaca'), ('stored')) src(source)),
    pts AS (SELECT symbol, date, source, CAST(open AS DOUBLE) AS open, CAST(close AS DOUBLE) AS close,
                   CASE WHEN source <> 'alpaca' THEN CAST(close AS DOUBLE) END AS adj_close, volume FROM raw
            UNION ALL SELECT symbol, date, 'stored', open, NULL, close, volume FROM prices),
    points AS (SELECT symbol, date, source, p.open, p.close, p.adj_close, p.volume,
                      CASE WHEN p.volume IS NULL THEN 'missing' ELSE 'ok' END AS status
               FROM grid LEFT JOIN pts p USING (symbol, date, source))"""
sql("export_comparison", "symbols raw prices", f"""
    WITH {_GRID}
    SELECT symbol, CAST(date AS VARCHAR) AS date, source, coalesce(printf('%.6f', open), '') AS open,
           coalesce(printf('%.6f', close), '') AS close, coalesce(printf('%.6f', adj_close), '') AS adj_close,
           coalesce(CAST(volume AS VARCHAR), '') AS volume, status FROM points""")

# --- B --------------------------------------------------------------------------------------------

sql("normalize_symbol", "typed", f"SELECT request_id, {_norm('raw')} AS symbol FROM typed")
sql("vendor_symbol", "symbols", """
    SELECT symbol, vendor, CASE vendor
        WHEN 'eodhd' THEN CASE WHEN symbol = 'VIX' THEN 'VIX.INDX' ELSE symbol || '.US' END
        WHEN 'tiingo' THEN CASE WHEN symbol = 'VIX' THEN '^VIX' ELSE lower(symbol) END
        WHEN 'yfinance' THEN CASE WHEN symbol IN ('VIX', 'GSPC') THEN '^' || symbol ELSE symbol END
        ELSE symbol END AS vendor_symbol
    FROM (SELECT CASE symbol WHEN 'X1' THEN 'VIX' WHEN 'X2' THEN 'GSPC' ELSE symbol END AS symbol FROM symbols),
         (VALUES ('eodhd'), ('tiingo'), ('alpaca'), ('yfinance')) v(vendor)""")
sql("clean_ohlcv", "quotes", f"""
    SELECT symbol, {_s('date')}, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close,
           CAST(trunc(volume) AS BIGINT) AS volume, line_key, CAST(line_no AS BIGINT) AS line_no
    FROM quotes WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND NOT isnan(close) AND trunc(volume) >= 0""")
sql("normalize_price_rows", "quotes", f"""
    SELECT symbol, {_s('date')}, open, greatest(high, open, CASE WHEN NOT isnan(close) THEN close END) AS high,
           least(low, open, CASE WHEN NOT isnan(close) THEN close END) AS low,
           CASE WHEN isnan(close) THEN greatest(high, open) ELSE close END AS close,
           CAST(trunc(volume) AS BIGINT) AS volume, CASE WHEN line_no > 3 THEN 'vendor' ELSE 'yfinance' END AS source,
           '2001-11-05 00:00:00' AS last_updated
    FROM quotes WHERE open IS NOT NULL AND trunc(volume) >= 0""")
sql("validate_relation", "quotes symbols", f"""
    SELECT symbol, {_s('date')}, line_key, CAST(line_no AS BIGINT) AS line_no, array_to_string(list_sort(list_filter([
        CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'nonpositive_price' END,
        CASE WHEN low > least(open, close) THEN 'low_above_body' END,
        CASE WHEN high < greatest(open, close) THEN 'high_below_body' END,
        CASE WHEN volume < 0 THEN 'negative_volume' END,
        CASE WHEN open IS NULL THEN 'null_open' END, CASE WHEN volume IS NULL THEN 'null_volume' END,
        CASE WHEN count(*) OVER (PARTITION BY symbol, date) > 1 THEN 'duplicate_key' END,
        CASE WHEN symbol NOT IN (SELECT symbol FROM symbols WHERE is_active) THEN 'unknown_symbol' END],
        lambda x : x IS NOT NULL)), ';') AS reasons FROM quotes""")
sql("validate_events", "ev symbols", """
    SELECT id, array_to_string(list_sort(list_filter([
        CASE WHEN event_type = 'spinoff' THEN 'event_type' END, CASE WHEN severity = 'low' THEN 'severity' END,
        CASE WHEN symbol NOT IN (SELECT symbol FROM symbols) THEN 'unknown_symbol' END,
        CASE WHEN count(*) OVER (PARTITION BY symbol, event_date, event_type) > 1 THEN 'duplicate_key' END],
        lambda x : x IS NOT NULL)), ';') AS reasons FROM ev""")
_JOB_OUTCOME = """CASE WHEN n > 100 THEN 'too_many_symbols' WHEN n = 0 THEN 'no_symbols' WHEN bad THEN 'bad_symbol'
        WHEN date_from < DATE '2001-11-05' - 7300 THEN 'from_too_old' WHEN date_to < date_from THEN 'to_before_from'
        WHEN date_to > DATE '2001-11-05' THEN 'to_in_future' WHEN date_diff('day', date_from, date_to) > 3650 THEN 'range_too_long'
        WHEN "interval" = '2h' THEN 'bad_interval' WHEN priority = 'urgent' THEN 'bad_priority' END"""
_JOB_INPUT = """(SELECT *, CASE c % 50 WHEN 0 THEN 0 WHEN 2 THEN 101 ELSE 4 END AS n, c % 50 = 1 AS bad FROM job_requests)"""
sql("validate_request_ranges", "job_requests", f"""
    SELECT request_id, CASE WHEN date_from > date_to THEN 'start_after_end' WHEN date_to > DATE '2001-11-05' THEN 'future_date'
        WHEN date_from < DATE '2001-11-05' - 7300 THEN 'very_old_date' END AS range_outcome, {_JOB_OUTCOME} AS job_outcome
    FROM {_JOB_INPUT}""")
sql("exclude_open_session", "timings", """
    SELECT event_id, CAST(date AS VARCHAR) AS date, CAST(safe_end AS VARCHAR) AS safe_end FROM (
      SELECT event_id, CAST(ts AS DATE) AS date, CAST(ts AS DATE) - CASE WHEN h >= 21 OR h < 8 THEN 1 ELSE 0 END AS safe_end
      FROM (SELECT event_id, ts, hour(ts + INTERVAL 9 HOURS) AS h FROM timings)) WHERE date <= safe_end""")
sql("vendor_tolerance_ok", "raw", """
    SELECT a.symbol, CAST(a.date AS VARCHAR) AS date,
           abs(CAST(a.close AS DOUBLE) - CAST(b.close AS DOUBLE)) <= CAST(0.01 AS DOUBLE) + CAST(1e-9 AS DOUBLE) AS ok
    FROM raw a JOIN raw b USING (symbol, date) WHERE a.source = 'eodhd' AND b.source = 'tiingo' ORDER BY ALL""")
sql("business_day", "", """
    SELECT o_orderkey, CAST(d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS previous,
           CAST(f - CASE isodow(f) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS month_end
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS f FROM orders)""")

# --- C --------------------------------------------------------------------------------------------

_ROW = f"symbol, {_s('date')}, {OHLC}, volume, source, {_s('last_updated')}"
sql("prices_range", "prices symbols", f"""
    SELECT {_ROW}, CAST(NULL AS VARCHAR) AS source_symbol FROM prices
    WHERE symbol IN (SELECT symbol FROM symbols WHERE is_active) AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
_RESOLVED = """SELECT DISTINCT * FROM (
      SELECT p.*, CAST(NULL AS VARCHAR) AS source_symbol FROM prices p LEFT JOIN changes c ON c.new_symbol = p.symbol
      WHERE p.symbol IN (SELECT symbol FROM symbols) AND (c.change_date IS NULL OR p.date >= c.change_date)
      UNION ALL
      SELECT c.new_symbol, p.* EXCLUDE (symbol), p.symbol FROM prices p JOIN changes c ON c.old_symbol = p.symbol
      WHERE c.new_symbol IN (SELECT symbol FROM symbols) AND p.date < c.change_date)"""
sql("prices_resolved", "prices changes symbols", f"""
    SELECT {_ROW}, source_symbol FROM ({_RESOLVED}) WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""")
sql("symbol_segments", "cover_requests changes", """
    SELECT symbol, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, actual_symbol,
           CAST(a AS VARCHAR) AS seg_from, CAST(b AS VARCHAR) AS seg_to FROM (
      SELECT r.*, r.symbol AS actual_symbol, date_from AS a, date_to AS b FROM cover_requests r
      WHERE symbol NOT IN (SELECT old_symbol FROM changes UNION ALL SELECT new_symbol FROM changes)
      UNION ALL
      SELECT r.*, old_symbol, date_from, least(date_to, change_date - 1) FROM cover_requests r
      JOIN changes c ON r.symbol IN (c.old_symbol, c.new_symbol) WHERE date_from < change_date
      UNION ALL
      SELECT r.*, new_symbol, greatest(date_from, change_date), date_to FROM cover_requests r
      JOIN changes c ON r.symbol IN (c.old_symbol, c.new_symbol) WHERE date_to >= change_date)""")
sql("serve_prices", "prices changes symbols", f"""
    SELECT {_ROW}, source_symbol FROM ({_RESOLVED}) WHERE date BETWEEN DATE '1997-01-01' AND DATE '2001-06-30'""")
sql("response_limits", "prices changes symbols", f"""
    SELECT count(*) AS n_rows, count(*) > 50000 AS over_fetch_limit, count(*) > 400000 AS over_local_limit FROM ({_RESOLVED})""")
sql("price_count", "prices", """
    SELECT symbol, count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date
    FROM prices GROUP BY symbol""")
sql("list_symbols", "symbols", f"""
    SELECT symbol, name, exchange, currency, is_active, {_s('first_date', 'last_date')} FROM symbols WHERE is_active""")
sql("closest_price_before", "prices ev", """
    SELECT e.id, e.symbol, CAST(e.event_date AS VARCHAR) AS target_date, CAST(p.date AS VARCHAR) AS price_date, p.close
    FROM ev e ASOF LEFT JOIN prices p ON e.symbol = p.symbol AND e.event_date > p.date""")
sql("price_series_before", "prices", f"SELECT symbol, {_s('date')}, close FROM prices WHERE date < DATE '2000-01-01'")
sql("recent_close_arrays", "prices", """
    SELECT symbol, string_agg(CAST(date AS VARCHAR) || '=' || CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY date) AS closes
    FROM prices WHERE date BETWEEN DATE '2001-06-30' - 30 AND DATE '2001-06-30' GROUP BY symbol""")
sql("symbol_registration_plan", "symbols series", f"""
    WITH want AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN ' s' || CAST(c_custkey AS VARCHAR)
        WHEN 1 THEN 'u' || CAST(c_custkey AS VARCHAR) || ' ' ELSE 'c' || CAST(c_custkey AS VARCHAR) || '.b' END AS raw FROM customer),
    named AS (SELECT raw, {_norm('raw')} AS symbol FROM want)
    SELECT raw, symbol, CASE WHEN symbol IN (SELECT symbol FROM symbols) THEN 'existing'
        WHEN symbol IN (SELECT symbol FROM series) THEN 'new' ELSE 'failed' END AS outcome,
        CASE WHEN symbol NOT IN (SELECT symbol FROM symbols) AND symbol NOT IN (SELECT symbol FROM series) THEN 'validation' END AS error
    FROM named""")
sql("renamed_symbol_exists", "symbols changes prices", """
    SELECT symbol, symbol IN (SELECT new_symbol FROM changes) AS has_change, symbol IN (SELECT symbol FROM prices) AS has_prices
    FROM symbols""")
sql("table_health", "symbols prices", """
    SELECT (SELECT count(*) FROM symbols) AS total_symbols, (SELECT count(*) FROM symbols WHERE is_active) AS active_symbols,
           (SELECT count(*) FROM symbols WHERE NOT is_active) AS inactive_symbols, count(*) AS total_price_records,
           count(DISTINCT symbol) AS symbols_with_data, CAST(min(date) AS VARCHAR) AS earliest_date,
           CAST(max(date) AS VARCHAR) AS latest_date FROM prices""")
sql("recent_activity", "prices", """
    SELECT symbol, record_count, CAST(a AS VARCHAR) AS first_date, CAST(b AS VARCHAR) AS last_date FROM (
      SELECT symbol, count(*) AS record_count, min(date) AS a, max(date) AS b FROM prices
      WHERE date >= DATE '2001-06-30' - 30 GROUP BY symbol ORDER BY record_count DESC, symbol LIMIT 10)""")
sql("economic_series_info", "econ series", """
    SELECT s.symbol, s.name, CAST(a AS VARCHAR) AS data_start, CAST(b AS VARCHAR) AS data_end, coalesce(n, 0) AS row_count,
           CAST(u AS VARCHAR) AS last_updated FROM series s LEFT JOIN (
      SELECT symbol, min(date) AS a, max(date) AS b, count(date) AS n, max(last_updated) AS u FROM econ GROUP BY symbol) USING (symbol)""")
sql("economic_range", "econ", f"""
    SELECT symbol, {_s('date')}, value, {_s('last_updated')}, CAST(min(date) OVER () AS VARCHAR) AS range_from,
           CAST(max(date) OVER () AS VARCHAR) AS range_to FROM (
      SELECT * FROM econ WHERE symbol = 'U1' AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28')""")
sql("economic_latest", "econ", f"""
    SELECT symbol, {_s('date')}, value, {_s('last_updated')} FROM econ
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")

# --- D --------------------------------------------------------------------------------------------

_COV = f"symbol, name, exchange, currency, is_active, {_s('data_start', 'data_end')}, data_days, row_count, {_s('last_updated')}, has_gaps"
sql("symbol_coverage_view", "symbols prices", f"""
    SELECT {_COV} FROM (
      SELECT s.symbol, s.name, s.exchange, s.currency, s.is_active, min(p.date) AS data_start, max(p.date) AS data_end,
             count(DISTINCT p.date) AS data_days, count(*) AS row_count, max(p.last_updated) AS last_updated,
             coalesce(date_diff('day', min(p.date), max(p.date)) + 1 > count(DISTINCT p.date), FALSE) AS has_gaps
      FROM symbols s LEFT JOIN prices p ON s.symbol = p.symbol GROUP BY ALL)""")
sql("coverage_recent", "symbols prices", f"SELECT {_COV} FROM ({_RECENT})")
sql("coverage_stats", "symbols prices", f"""
    SELECT symbol, name, exchange, currency, is_active, {_s('first_date', 'last_date')}, data_points, {_s('created_at')} FROM (
      SELECT s.symbol, s.name, s.exchange, s.currency, s.is_active, coalesce(p.a, s.first_date) AS first_date,
             coalesce(p.b, s.last_date) AS last_date, coalesce(p.n, 0) AS data_points, s.created_at
      FROM symbols s LEFT JOIN (SELECT symbol, min(date) AS a, max(date) AS b, count(*) AS n FROM prices GROUP BY symbol) p
      ON s.symbol = p.symbol) WHERE first_date >= DATE '1995-01-03' AND last_date <= DATE '2001-12-31'""")
sql("coverage_listing", "symbols prices", f"""
    WITH hits AS (SELECT * FROM ({_RECENT}) WHERE (symbol ILIKE '%s%' OR name ILIKE '%s%') AND data_start IS NOT NULL
        AND data_start >= DATE '1996-11-01' AND data_end <= DATE '2001-12-31' AND last_updated >= TIMESTAMP '2000-01-01')
    SELECT {_COV}, total_items, CAST(greatest(ceil(total_items / 20.0), 1) AS BIGINT) AS total_pages FROM (
      SELECT *, count(*) OVER () AS total_items FROM hits ORDER BY row_count DESC, symbol LIMIT 20 OFFSET 20)""")
sql("coverage_listing_after", "symbols prices", f"""
    SELECT {_COV} FROM (SELECT * FROM ({_RECENT}) WHERE symbol ILIKE '%s%' OR name ILIKE '%s%' ORDER BY row_count DESC, symbol LIMIT 5 OFFSET 5)""")
_CALENDAR = """cal AS (SELECT symbol, date_from, date_to, CAST(x AS DATE) AS date FROM (
        SELECT *, unnest(generate_series(CAST(date_from AS TIMESTAMP), CAST(date_to AS TIMESTAMP), INTERVAL 1 DAY)) AS x
        FROM cover_requests) WHERE isodow(x) < 6),
    miss AS (SELECT c.* FROM cal c WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.symbol = c.symbol AND p.date = c.date))"""
_D5 = """d5 AS (SELECT r.*, coalesce(n, 0) AS cnt, a AS first_date, b AS last_date,
        coalesce(n < (SELECT count(*) FROM cal c WHERE c.symbol = r.symbol), FALSE) AS has_weekday_gaps
      FROM cover_requests r LEFT JOIN (SELECT symbol, min(date) AS a, max(date) AS b, count(*) AS n
        FROM prices JOIN cover_requests USING (symbol) WHERE date BETWEEN date_from AND date_to GROUP BY symbol) p USING (symbol)),
    d5x AS (SELECT d5.*, CASE WHEN has_weekday_gaps THEN f END AS first_missing_weekday
      FROM d5 LEFT JOIN (SELECT symbol, min(date) AS f FROM miss GROUP BY symbol) USING (symbol))"""
sql("coverage_range", "prices cover_requests", f"""
    WITH {_CALENDAR}, {_D5}
    SELECT symbol, {_s('date_from', 'date_to', 'first_date', 'last_date')}, cnt, has_weekday_gaps, {_s('first_missing_weekday')} FROM d5x""")
sql("weekday_count", "range_requests", """
    SELECT symbol, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end",
           len(list_filter(generate_series(CAST(start AS TIMESTAMP), CAST("end" AS TIMESTAMP), INTERVAL 1 DAY),
                           lambda x : isodow(x) < 6)) AS weekdays,
           CASE WHEN start = "end" AND isodow(start) < 6 THEN 1 ELSE 0 END AS reversed FROM range_requests""")
sql("missing_weekdays", "prices cover_requests", f"""
    WITH {_CALENDAR} SELECT symbol, {_s('date_from', 'date_to')}, CAST(date AS VARCHAR) AS missing_date FROM miss""")
sql("missing_ranges", "prices cover_requests", f"""
    WITH {_CALENDAR},
    runs AS (SELECT *, date_diff('week', DATE '1990-01-01', date) * 5 + isodow(date)
                    - row_number() OVER (PARTITION BY symbol ORDER BY date) AS run FROM miss)
    SELECT symbol, CAST(min(date_from) AS VARCHAR) AS date_from, CAST(min(date_to) AS VARCHAR) AS date_to,
           CAST(min(date) AS VARCHAR) AS gap_start, CAST(max(date) AS VARCHAR) AS gap_end, count(*) AS weekdays
    FROM runs GROUP BY symbol, run""")


def _merged(source: str, by: str) -> str:
    return f"""SELECT {by}, CAST(min(start) AS VARCHAR) AS start, CAST(max("end") AS VARCHAR) AS "end" FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY {by} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, max("end") OVER (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM {source})) GROUP BY {by}, island"""


sql("merge_date_ranges", "range_requests", _merged("range_requests", "symbol"))
sql("fetch_plan", "prices cover_requests", f"""
    WITH {_CALENDAR}, {_D5}, wanted AS (
      SELECT symbol, date_from, date_to, least(first_date, date_from) AS start, date_to AS "end" FROM d5x
      WHERE last_date IS NOT NULL AND date_diff('day', last_date, date_to) > 1
      UNION ALL
      SELECT symbol, date_from, date_to, greatest(date_from, first_missing_weekday), least(coalesce(first_date, date_to), date_to) FROM d5x
      WHERE first_missing_weekday IS NOT NULL AND greatest(date_from, first_missing_weekday) < coalesce(first_date, date_to)
      UNION ALL
      SELECT symbol, date_from, date_to, date_from, date_to FROM d5x WHERE first_date IS NULL)
    SELECT symbol, {_s('date_from', 'date_to')}, start, "end" FROM ({_merged('wanted', 'symbol, date_from, date_to')})""")
sql("availability_adjustment", "symbols prices", """
    WITH r AS (SELECT symbol, CASE WHEN has_full_history THEN DATE '1993-05-01' ELSE DATE '1999-12-20' END AS date_from,
                      DATE '2001-11-05' AS date_to FROM symbols),
    probes AS (SELECT r.*, p.pos, p.d FROM r, (VALUES (0, DATE '1970-01-01'), (1, DATE '1980-01-01'), (2, DATE '1990-01-01'),
                 (3, DATE '2000-01-01')) p(pos, d)),
    hits AS (SELECT symbol, min(d) AS d FROM probes q WHERE EXISTS (SELECT 1 FROM prices p WHERE p.symbol = q.symbol
               AND p.date BETWEEN q.d AND q.d + 30) GROUP BY symbol)
    SELECT symbol, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to,
           CAST(coalesce(d, date_from) AS VARCHAR) AS actual_start,
           CASE WHEN coalesce(d, date_from) > date_to THEN 'no_data_in_range' WHEN coalesce(d, date_from) > date_from THEN 'partial_data' END AS status
    FROM r LEFT JOIN hits USING (symbol)""")
sql("availability_start", "prices ref_prices cover_requests", f"""
    WITH {_CALENDAR}, {_D5}
    SELECT symbol, {_s('date_from', 'date_to')}, CAST(coalesce(a, date_from) AS VARCHAR) AS actual_start,
           CASE WHEN a > date_to THEN 'no_data_in_range' WHEN a > date_from THEN 'partial_data' END AS status
    FROM d5x LEFT JOIN (SELECT symbol, min(date) AS a FROM ref_prices GROUP BY symbol) USING (symbol)
    WHERE first_date IS NULL OR has_weekday_gaps""")
sql("symbol_date_metadata", "symbols prices", """
    SELECT s.symbol, CAST(least(s.first_date, a) AS VARCHAR) AS first_date, CAST(greatest(s.last_date, b) AS VARCHAR) AS last_date,
           has_full_history OR a IS NOT NULL AS has_full_history, NOT has_full_history AS lacked_full_history
    FROM symbols s LEFT JOIN (SELECT symbol, min(date) AS a, max(date) AS b FROM prices GROUP BY symbol) USING (symbol)""")
sql("month_end_confirmation", "symbols prices", """
    SELECT '2001-05-31' AS target_date, symbol, present, count(*) OVER () AS symbols_expected,
           count(*) FILTER (WHERE present) OVER () AS symbols_present,
           CASE WHEN count(*) FILTER (WHERE NOT present) OVER () = 0 THEN 'confirmed' ELSE 'pending' END AS status
    FROM (SELECT symbol, symbol IN (SELECT symbol FROM prices WHERE date = DATE '2001-05-31') AS present
          FROM symbols WHERE is_active)""")
sql("economic_fetch_window", "econ series", """
    SELECT symbol, CAST(f AS VARCHAR) AS date_from, '2024-01-25' AS date_to, f <= DATE '2024-01-25' AS needed FROM (
      SELECT s.symbol, CASE WHEN a IS NULL OR a > DATE '1955-01-01' THEN DATE '1954-01-01' ELSE b + 1 END AS f
      FROM series s LEFT JOIN (SELECT symbol, min(date) AS a, max(date) AS b FROM econ GROUP BY symbol) USING (symbol))""")

# --- E --------------------------------------------------------------------------------------------

# a full history of both tables, the stored row before the incoming ones
_BEST = """best AS (SELECT * FROM price_changes QUALIFY row_number() OVER (PARTITION BY symbol, date
      ORDER BY last_updated DESC, open DESC, high DESC, low DESC, close DESC, volume DESC) = 1)"""


def _upsert(newer: str) -> str:
    cols = ", ".join(f"CASE WHEN take THEN n.{c} ELSE o.{c} END AS {c}"
                     for c in ("open", "high", "low", "close", "volume", "source"))
    return f"""WITH {_BEST}, both_sides AS (
      SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.date, n.date) AS date, o, n,
             n.symbol IS NOT NULL AND (o.symbol IS NULL OR {newer}) AS take
      FROM prices o FULL OUTER JOIN best n ON o.symbol = n.symbol AND o.date = n.date)
    SELECT symbol, {_s('date')}, {cols}, CAST(CASE WHEN take THEN n.last_updated ELSE o.last_updated END AS VARCHAR) AS last_updated,
           CASE WHEN o.symbol IS NULL THEN 'inserted' WHEN take THEN 'updated' ELSE 'unchanged' END AS change FROM both_sides"""


sql("upsert_prices", "prices price_changes", _upsert("o.last_updated < n.last_updated"))
sql("upsert_prices_force", "prices price_changes", _upsert("TRUE"))
sql("upsert_stored_years", "prices price_changes", "SELECT * EXCLUDE (change) FROM ("
    + _upsert("o.last_updated < n.last_updated").replace("price_changes", "(SELECT * FROM price_changes WHERE year(date) IN (1997, 1999))") + ")")
sql("upsert_counts", "prices price_changes", f"""
    WITH {_BEST} SELECT change, count(*) AS n FROM (
      SELECT CASE WHEN o.symbol IS NULL THEN 'inserted' WHEN o.last_updated < n.last_updated THEN 'updated' ELSE 'unchanged' END AS change
      FROM prices o FULL OUTER JOIN best n ON o.symbol = n.symbol AND o.date = n.date) GROUP BY change""")
_RAW_MERGE = """rbest AS (SELECT * FROM raw_changes QUALIFY row_number() OVER (PARTITION BY symbol, date, source
      ORDER BY fetched_at DESC, open DESC, high DESC, low DESC, close DESC, volume DESC) = 1),
    merged AS (SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.date, o.date) AS date, coalesce(n.source, o.source) AS source,
        coalesce(n.open, o.open) AS open, coalesce(n.high, o.high) AS high, coalesce(n.low, o.low) AS low,
        coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume, coalesce(n.fetched_at, o.fetched_at) AS fetched_at,
        o.consensus_close, CASE WHEN o.symbol IS NULL THEN 'inserted' WHEN n.symbol IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS change
      FROM raw o FULL OUTER JOIN rbest n ON o.symbol = n.symbol AND o.date = n.date AND o.source = n.source)"""
sql("upsert_raw", "raw raw_changes", f"""
    WITH {_RAW_MERGE} SELECT symbol, {_s('date')}, source, {DBL}, volume, {_s('fetched_at')},
        CAST(consensus_close AS DOUBLE) AS consensus_close, change FROM merged ORDER BY ALL""")
sql("upsert_economic", "econ econ_changes", f"""
    WITH best AS (SELECT * FROM econ_changes QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY last_updated DESC, value DESC) = 1)
    SELECT coalesce(n.symbol, o.symbol) AS symbol, CAST(coalesce(n.date, o.date) AS VARCHAR) AS date,
           CASE WHEN n.symbol IS NOT NULL THEN n.value ELSE o.value END AS value,
           CAST(coalesce(n.last_updated, o.last_updated) AS VARCHAR) AS last_updated,
           CASE WHEN o.symbol IS NULL THEN 'inserted' WHEN n.symbol IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS change
    FROM econ o FULL OUTER JOIN best n ON o.symbol = n.symbol AND o.date = n.date""")
_NOW = "2001-11-05 06:00:00"


def _event_id(day: str, t: str = "") -> str:
    return f"CAST('0x' || substr(md5({t}symbol || '|' || CAST({t}{day} AS VARCHAR) || '|' || {t}event_type), 1, 15) AS BIGINT)"


_ACTIONS = """a0 AS (SELECT symbol, event_date, event_type, CAST(dividend_amount * 2 AS DECIMAL(18,8)) AS dividend_amount, split_ratio
      FROM ev WHERE event_type IN ('dividend', 'split')),
    acts AS (SELECT symbol, event_date, event_type, max(dividend_amount) AS dividend_amount, max(split_ratio) AS split_ratio
      FROM (SELECT * FROM a0 UNION ALL SELECT symbol, event_date + 4000, event_type, dividend_amount, split_ratio FROM a0
            WHERE event_type = 'dividend') GROUP BY 1, 2, 3),
    known AS (SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.event_date, n.event_date) AS event_date,
        coalesce(o.event_type, n.event_type) AS event_type, n.symbol IS NOT NULL AS hit,
        CASE WHEN n.symbol IS NOT NULL THEN n.dividend_amount ELSE o.dividend_amount END AS dividend_amount,
        CASE WHEN n.symbol IS NOT NULL THEN n.split_ratio ELSE o.split_ratio END AS split_ratio,
        coalesce(n.event_date, o.ex_date) AS ex_date, o.confirmed_at, o.source_count, o.source_names, o.severity, o.status,
        o.updated_at, o.symbol AS had, o.id
      FROM ev o FULL OUTER JOIN acts n ON o.symbol = n.symbol AND o.event_date = n.event_date AND o.event_type = n.event_type)"""
sql("upsert_confirmed_events", "ev", f"""
    WITH {_ACTIONS}
    SELECT coalesce(id, {_event_id('event_date')}) AS id, symbol, {_s('event_date')}, event_type, CAST(CAST(split_ratio AS DECIMAL(38,6)) AS DOUBLE) AS ratio,
           CAST(CAST(dividend_amount AS DECIMAL(18,4)) AS DOUBLE) AS amount, CAST(dividend_amount AS DOUBLE) AS dividend_amount,
           CAST(split_ratio AS DOUBLE) AS split_ratio, {_s('ex_date')},
           CASE WHEN hit THEN '{_NOW}' ELSE CAST(confirmed_at AS VARCHAR) END AS confirmed_at,
           CASE WHEN hit THEN 1 ELSE coalesce(source_count, 0) END AS source_count,
           CASE WHEN hit THEN 'eodhd' ELSE source_names END AS source_names, severity,
           CASE WHEN hit THEN 'confirmed' ELSE status END AS status,
           CASE WHEN hit THEN '{_NOW}' ELSE CAST(updated_at AS VARCHAR) END AS updated_at,
           CASE WHEN had IS NULL THEN 'inserted' WHEN hit THEN 'updated' ELSE 'unchanged' END AS change FROM known""")
sql("delete_prices", "prices symbols", f"""
    SELECT {_ROW} FROM prices p WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.symbol = p.symbol
      AND NOT coalesce(s.is_active, FALSE) AND p.date <= DATE '1998-12-31'
      AND (s.is_active IS NOT NULL OR p.date >= DATE '1997-01-01'))""")
sql("deleted_count", "prices symbols", """
    SELECT p.symbol, count(*) AS deleted FROM prices p JOIN symbols s ON s.symbol = p.symbol
    WHERE NOT coalesce(s.is_active, FALSE) AND p.date <= DATE '1998-12-31' AND (s.is_active IS NOT NULL OR p.date >= DATE '1997-01-01')
    GROUP BY p.symbol""")
sql("register_symbols", "symbols", f"""
    SELECT symbol, name, is_active, has_full_history, {_s('created_at')}, 'unchanged' AS change FROM symbols
    UNION ALL SELECT 'S' || CAST(p_partkey AS VARCHAR), NULL, TRUE, FALSE, '{_NOW}', 'inserted' FROM part
    WHERE 'S' || CAST(p_partkey AS VARCHAR) NOT IN (SELECT symbol FROM symbols)""")
sql("set_active_symbols", "symbols changes", "SELECT symbol, symbol IN (SELECT new_symbol FROM changes) AS is_active FROM symbols")
sql("deactivate_symbols", "symbols changes", """
    SELECT symbol, CASE WHEN symbol IN (SELECT old_symbol FROM changes) THEN FALSE ELSE is_active END AS is_active FROM symbols""")
sql("symbols_not_found", "symbols", """
    SELECT 'S' || CAST(p_partkey AS VARCHAR) AS symbol FROM part
    WHERE 'S' || CAST(p_partkey AS VARCHAR) NOT IN (SELECT symbol FROM symbols)""")
sql("event_status_update", "ev", f"""
    SELECT id, CASE WHEN severity = 'low' THEN status ELSE CASE id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'ignored'
             WHEN 2 THEN 'fixing' WHEN 3 THEN 'fixed' ELSE 'failed' END END AS status,
           CASE WHEN severity <> 'low' AND id % 5 = 1 THEN CASE WHEN id % 2 = 0 THEN 'Ignored: noise' ELSE 'Ignored' END END AS notes,
           CASE WHEN severity <> 'low' AND id % 5 = 3 THEN '{_NOW}' END AS fixed_at,
           CASE WHEN severity <> 'low' THEN '{_NOW}' ELSE CAST(updated_at AS VARCHAR) END AS updated_at FROM ev""")

# --- F --------------------------------------------------------------------------------------------


def _consensus(raw: str, p: str = "") -> str:
    """Self-join form: the anchor is the first source that has another source near it."""
    return f"""{p}v AS (SELECT symbol, date, source, CAST(close AS DOUBLE) AS c FROM {raw}),
    {p}near AS (SELECT a.symbol, a.date, a.source AS anchor, count(*) AS n, avg(b.c) AS mean FROM {p}v a JOIN {p}v b USING (symbol, date)
      WHERE abs(b.c - a.c) <= CAST(0.01 AS DOUBLE) + CAST(1e-9 AS DOUBLE) GROUP BY ALL HAVING count(*) >= 2),
    {p}cons AS (SELECT symbol, date, round(arg_min(mean, anchor), 6) AS consensus_close FROM {p}near GROUP BY symbol, date)"""


_SAID = """said AS (SELECT symbol, date, string_agg(source || ':' || CAST(CAST(round(c * 1000) AS BIGINT) AS VARCHAR), ';' ORDER BY source) AS closes
      FROM v GROUP BY symbol, date)"""
sql("consensus_close", "raw", f"""
    WITH {_consensus('raw')}, {_SAID}
    SELECT symbol, {_s('date')}, closes, consensus_close FROM said LEFT JOIN cons USING (symbol, date)""")
sql("consensus_alerts", "raw", f"""
    WITH {_consensus('raw')}, {_SAID}
    SELECT symbol, {_s('date')}, closes FROM said ANTI JOIN cons USING (symbol, date)""")
_SETTLED = """settled AS (SELECT r.* EXCLUDE (consensus_close),
      coalesce(CAST(c.consensus_close AS DECIMAL(18,6)), r.consensus_close) AS consensus_close FROM {raw} r LEFT JOIN cons c USING (symbol, date))"""
sql("apply_consensus", "raw", f"""
    WITH {_consensus('raw')}, {_SETTLED.format(raw='raw')}
    SELECT symbol, {_s('date')}, source, CAST(close AS DOUBLE) AS close, CAST(consensus_close AS DOUBLE) AS consensus_close
    FROM settled ORDER BY ALL""")
_COLLAPSED = """collapsed AS (SELECT symbol, date, CAST(max(consensus_close) AS DOUBLE) AS consensus_close, max(volume) AS volume
      FROM {src} WHERE consensus_close IS NOT NULL AND date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY symbol, date)"""
_A, _B = "1990-01-01", "2030-12-31"
sql("collapse_raw", "raw", f"WITH {_COLLAPSED.format(src='raw', a=_A, b=_B)} SELECT symbol, {_s('date')}, consensus_close, volume FROM collapsed")


def _factors(source: str, end: str) -> str:
    return f"""conf AS (SELECT symbol, event_type, ex_date, CAST(dividend_amount AS DOUBLE) AS d, CAST(split_ratio AS DOUBLE) AS r
      FROM {source} WHERE ex_date <= DATE '{end}'
      AND (event_type = 'split' AND split_ratio <> 0 OR event_type = 'dividend' AND dividend_amount <> 0)),
    cashed AS (SELECT e.*, p.date AS prev_date, p.consensus_close AS prev_close,
        CASE WHEN coalesce(p.consensus_close, 0) <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - d / p.consensus_close) END AS factor
      FROM (SELECT * FROM conf WHERE event_type = 'dividend') e ASOF LEFT JOIN collapsed p ON e.symbol = p.symbol AND e.ex_date > p.date),
    steps AS (SELECT symbol, ex_date, factor AS f FROM cashed UNION ALL SELECT symbol, ex_date, 1.0 / r FROM conf WHERE event_type = 'split'),
    daily AS (SELECT symbol, ex_date, list_reduce(list_prepend(CAST(1 AS DOUBLE), list_sort(list(f))), lambda a, b: a * b) AS f FROM steps GROUP BY ALL),
    factored AS (SELECT c.symbol, c.date, any_value(c.consensus_close) AS consensus_close, any_value(c.volume) AS volume,
        list_reduce(list_prepend(CAST(1 AS DOUBLE), list(s.f ORDER BY s.ex_date DESC) FILTER (s.f IS NOT NULL)), lambda a, b: a * b) AS factor
      FROM collapsed c LEFT JOIN daily s ON s.symbol = c.symbol AND c.date < s.ex_date GROUP BY c.symbol, c.date)"""


_CONFIRMED = "cev AS (SELECT * FROM ev WHERE confirmed_at IS NOT NULL)"
_ALL_F = f"""{_consensus('raw')}, {_SETTLED.format(raw='raw')}, {_COLLAPSED.format(src='settled', a=_A, b=_B)}, {_CONFIRMED}, {_factors('cev', _B)}"""
sql("dividend_factors", "raw ev", f"""
    WITH {_ALL_F} SELECT symbol, {_s('ex_date')}, d AS dividend_amount, {_s('prev_date')}, prev_close, round(factor, 9) AS factor FROM cashed""")
sql("adjustment_factor", "raw ev", f"WITH {_ALL_F} SELECT symbol, {_s('date')}, round(factor, 9) AS factor FROM factored")
_FLAT = ", ".join(f"consensus_close * factor AS {c}" for c in ("open", "high", "low", "close"))
sql("derive_adjusted", "raw ev", f"""
    WITH {_ALL_F} SELECT symbol, {_s('date')}, {_FLAT}, volume, 'raw_consensus_events' AS source, '{_NOW}' AS last_updated FROM factored""")
_REFRESH = f"""{_RAW_MERGE}, inside AS (SELECT * FROM merged WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
    {_consensus('inside')}, {_SETTLED.format(raw='merged')}, {_COLLAPSED.format(src='settled', a='1995-01-01', b='2001-12-31')},
    {_ACTIONS}, cev AS (SELECT * FROM known WHERE hit OR confirmed_at IS NOT NULL), {_factors('cev', '2001-12-31')}"""
sql("raw_price_refresh", "raw raw_changes ev prices", f"""
    WITH {_REFRESH}
    SELECT coalesce(f.symbol, p.symbol) AS symbol, CAST(coalesce(f.date, p.date) AS VARCHAR) AS date,
           {', '.join(f"CASE WHEN f.symbol IS NOT NULL THEN f.consensus_close * f.factor ELSE p.{c} END AS {c}" for c in ('open', 'high', 'low', 'close'))},
           coalesce(f.volume, p.volume) AS volume, CASE WHEN f.symbol IS NOT NULL THEN 'raw_consensus_events' ELSE p.source END AS source,
           CASE WHEN f.symbol IS NOT NULL THEN '{_NOW}' ELSE CAST(p.last_updated AS VARCHAR) END AS last_updated,
           CASE WHEN p.symbol IS NULL THEN 'inserted' WHEN f.symbol IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS change
    FROM prices p FULL OUTER JOIN factored f ON p.symbol = f.symbol AND p.date = f.date""")
sql("refresh_counts", "raw raw_changes ev", f"""
    WITH {_REFRESH}
    SELECT 'confirmed' AS what, count(*) AS n FROM cons
    UNION ALL SELECT 'alerts', count(*) FROM (SELECT DISTINCT symbol, date FROM inside) ANTI JOIN cons USING (symbol, date)
    UNION ALL SELECT 'derived', count(*) FROM factored""")
_NINTH, _FIFTH = "CAST(substr(symbol, 2) AS BIGINT) % 9 = 0", "CAST(substr(symbol, 2) AS BIGINT) % 5 = 0"
sql("raw_price_changes", "raw raw_changes ev", f"""
    WITH some_changes AS (SELECT * FROM raw_changes WHERE {_NINTH}), {_RAW_MERGE.replace('raw_changes', 'some_changes')},
    inside AS (SELECT * FROM merged WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
    {_consensus('inside')}, {_SETTLED.format(raw='merged')}, {_COLLAPSED.format(src='settled', a='1995-01-01', b='2001-12-31')},
    {_ACTIONS.replace('acts AS (', 'every_act AS (', 1).replace('known AS (', f'acts AS (SELECT * FROM every_act WHERE {_FIFTH}), known AS (', 1)},
    cev AS (SELECT * FROM known WHERE hit OR confirmed_at IS NOT NULL), {_factors('cev', '2001-12-31')},
    landed AS (SELECT DISTINCT symbol, date FROM some_changes WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
    cutoffs AS (SELECT symbol, max(ex) AS cutoff FROM (
        SELECT symbol, ex_date AS ex FROM known WHERE hit AND ex_date <= DATE '2001-12-31'
        UNION ALL SELECT c.symbol, c.ex_date FROM cashed c JOIN landed l ON c.symbol = l.symbol AND c.prev_date = l.date) GROUP BY symbol)
    SELECT f.symbol, CAST(f.date AS VARCHAR) AS date, {_FLAT}, volume, 'raw_consensus_events' AS source, '{_NOW}' AS last_updated
    FROM factored f LEFT JOIN cutoffs c USING (symbol) WHERE f.date < c.cutoff OR (f.symbol, f.date) IN (SELECT symbol, date FROM landed)""")
_VERIFY = """cmp AS (SELECT s.symbol, a.c AS p, b.c AS q, abs(a.c - b.c) AS diff,
        CASE WHEN a.c IS NULL OR b.c IS NULL THEN 'unverified' WHEN abs(a.c - b.c) > CAST(0.01 AS DOUBLE) + CAST(1e-9 AS DOUBLE)
             THEN 'mismatch' ELSE 'ok' END AS status
      FROM symbols s
      LEFT JOIN (SELECT symbol, CAST(close AS DOUBLE) AS c FROM raw WHERE source = 'eodhd' AND date = DATE '1998-06-30') a USING (symbol)
      LEFT JOIN (SELECT symbol, CAST(close AS DOUBLE) AS c FROM raw WHERE source = 'tiingo' AND date = DATE '1998-06-30') b USING (symbol))"""
sql("verify_two_sources", "raw symbols", f"""
    WITH {_VERIFY}
    SELECT symbol, '1998-06-30' AS date, p AS primary_close, q AS verifier_close, diff, status, CASE status
        WHEN 'unverified' THEN symbol || ': source unavailable eodhd=' || CASE WHEN p IS NULL THEN 'missing' ELSE 'ok' END ||
             ' tiingo=' || CASE WHEN q IS NULL THEN 'missing' ELSE 'ok' END
        WHEN 'mismatch' THEN symbol || ': eodhd/tiingo close diff ' || printf('%.4f', diff) || ' > 0.0100' END AS reason FROM cmp""")
sql("verification_status", "raw symbols", f"""
    WITH {_VERIFY}
    SELECT '1998-06-30' AS date, count(*) AS symbols_checked, count(*) FILTER (WHERE status = 'mismatch') AS mismatches,
           count(*) FILTER (WHERE status = 'unverified') AS unverified,
           CASE WHEN bool_and(status = 'ok') THEN 'success' ELSE 'alert' END AS status FROM cmp""")

# --- G --------------------------------------------------------------------------------------------

_REF_EVENTS = """revents AS (SELECT symbol, event_date, CASE WHEN event_type IN ('split', 'stock_split', 'reverse_split') THEN 'split'
        WHEN event_type = 'capital_gain' THEN 'capital_gain' ELSE 'dividend' END AS kind,
        CAST(coalesce(split_ratio, dividend_amount) AS DOUBLE) AS value FROM ev
      WHERE event_type <> 'spinoff' AND coalesce(split_ratio, dividend_amount) <> 0)"""


def _pct(s: str, r: str) -> str:
    """Exact in whole cents and thousandths of a percent's base."""
    return (f"CAST(round(abs(CAST({s} AS DECIMAL(18,6)) - CAST({r} AS DECIMAL(18,6))) * 100 / CAST({s} AS DECIMAL(18,6)), 6) AS DOUBLE)")


_PAIRS = f"""pairs AS (SELECT p.symbol, p.date, p.close AS stored_close, r.close AS reference_close, {_pct('p.close', 'r.close')} AS pct_difference
      FROM prices p JOIN ref_prices r USING (symbol, date))"""
sql("price_deviation", "prices ref_prices", f"""
    WITH {_PAIRS} SELECT symbol, {_s('date')}, stored_close, reference_close, pct_difference, pct_difference >= 0.001 AS significant FROM pairs""")


def _sampled(source: str) -> str:
    return f"""numbered AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
        count(*) OVER (PARTITION BY symbol) AS n FROM {source} WHERE date < DATE '2001-06-30' - 7),
    sampled AS (SELECT symbol, date, close FROM numbered WHERE n >= 2 AND (
        (i % greatest(1, n // least(10, n)) = 0 AND i // greatest(1, n // least(10, n)) < least(10, n)) OR i = n - 1
        OR n > 20 AND (i = greatest(0, n - 90) OR i = (greatest(0, n - 90) + n) // 2)))"""


def _presplit(source: str) -> str:
    return f"""oldest AS (SELECT symbol, min(date) AS f FROM sampled GROUP BY symbol),
    extra AS (SELECT t.symbol, p.date, p.close FROM (SELECT DISTINCT e.symbol, e.event_date FROM revents e JOIN oldest USING (symbol)
        WHERE e.kind = 'split' AND e.event_date > f) t ASOF JOIN {source} p ON t.symbol = p.symbol AND t.event_date > p.date),
    samples AS (SELECT * FROM sampled UNION SELECT * FROM extra)"""


sql("sample_points", "prices", f"WITH {_sampled('prices')} SELECT symbol, {_s('date')}, close FROM sampled")
sql("add_presplit_samples", "prices ev", f"""
    WITH {_REF_EVENTS}, {_sampled('prices')}, {_presplit('prices')} SELECT symbol, {_s('date')}, close FROM samples""")


def _classified(pairs: str) -> str:
    return f"""sums AS (SELECT q.symbol, q.date, any_value(q.stored_close) AS stored_close, any_value(q.reference_close) AS reference_close,
        any_value(q.pct_difference) AS pct, count(*) FILTER (WHERE kind = 'split') AS ns, product(value) FILTER (WHERE kind = 'split') AS ps,
        count(*) FILTER (WHERE kind = 'dividend') AS nd, sum(value) FILTER (WHERE kind = 'dividend') AS sd,
        max(value) FILTER (WHERE kind = 'dividend') AS md, avg(value) FILTER (WHERE kind = 'dividend') AS ad,
        count(*) FILTER (WHERE kind = 'capital_gain') AS ng, sum(value) FILTER (WHERE kind = 'capital_gain') AS sg
      FROM {pairs} q LEFT JOIN revents e ON e.symbol = q.symbol AND e.event_date > q.date
      WHERE q.pct_difference >= 0.001 GROUP BY q.symbol, q.date),
    verdict AS (SELECT *, CASE WHEN pct >= 10 AND ns > 0 THEN CASE WHEN ps < 1 THEN 'reverse_split' ELSE 'stock_split' END
        WHEN pct >= 15 THEN 'spinoff' WHEN nd > 0 THEN CASE WHEN pct >= 2 AND md > ad * 2 THEN 'special_dividend' ELSE 'dividend' END
        WHEN ng > 0 THEN 'capital_gain' ELSE 'unknown' END AS event_type FROM sums),
    ranked AS (SELECT *, CASE WHEN event_type IN ('stock_split', 'spinoff') THEN 'critical'
        WHEN event_type IN ('reverse_split', 'special_dividend') THEN 'high'
        WHEN event_type IN ('dividend', 'capital_gain') THEN 'normal' ELSE 'low' END AS severity FROM verdict)"""


_FACTS = f"""SELECT symbol, CAST(date AS VARCHAR) AS check_date, stored_close, reference_close, pct AS pct_difference, event_type, severity,
    CASE severity {_ADVICE} END AS recommendation,
    CASE WHEN event_type LIKE '%_split' THEN round(ps, 9) END AS cumulative_factor,
    CASE WHEN event_type LIKE '%_split' THEN ns ELSE 0 END AS split_count,
    CASE WHEN event_type LIKE '%dividend' THEN nd ELSE 0 END AS dividend_count,
    CASE WHEN event_type LIKE '%dividend' THEN sd END AS total_dividends,
    CASE WHEN event_type = 'special_dividend' THEN md END AS special_dividend,
    CASE WHEN event_type = 'capital_gain' THEN sg END AS capital_gains,
    CASE event_type WHEN 'spinoff' THEN 'Possible spinoff or data quality issue' WHEN 'unknown' THEN 'Could not determine cause' END AS note
    FROM ranked"""
sql("classify_deviation", "prices ref_prices ev", f"WITH {_PAIRS}, {_REF_EVENTS}, {_classified('pairs')} {_FACTS}")
_SCAN = f"""{_REF_EVENTS}, asked AS (SELECT symbol FROM symbols WHERE coalesce(is_active, TRUE)),
    held AS (SELECT * FROM prices WHERE symbol IN (SELECT symbol FROM asked)), {_sampled('held')}, {_presplit('held')},
    spairs AS (SELECT p.symbol, p.date, p.close AS stored_close, r.close AS reference_close, {_pct('p.close', 'r.close')} AS pct_difference
      FROM samples p JOIN ref_prices r USING (symbol, date)), {_classified('spairs')},
    extent AS (SELECT symbol, min(date) AS a, max(date) AS b, count(*) AS n FROM samples GROUP BY symbol),
    covered AS (SELECT DISTINCT r.symbol FROM ref_prices r JOIN extent x ON r.symbol = x.symbol AND r.date BETWEEN a AND b),
    scan AS (SELECT s.symbol, coalesce(x.n, 0) AS n_samples, coalesce(h.n, 0) AS n_events, coalesce(h.n, 0) > 0 AS needs_refresh,
        coalesce(h.m, 0.0) AS max_pct_diff, CASE WHEN coalesce(x.n, 0) < 2 THEN 'Insufficient historical data (need at least 2 points older than 7 days)'
          WHEN s.symbol NOT IN (SELECT symbol FROM covered) THEN 'No reference data available for the sample period' END AS error
      FROM asked s LEFT JOIN extent x USING (symbol)
      LEFT JOIN (SELECT symbol, count(*) AS n, max(pct) AS m FROM ranked GROUP BY symbol) h USING (symbol)),
    outcomes AS (SELECT symbol, CASE WHEN error IS NOT NULL THEN 'errors' WHEN needs_refresh THEN 'needs_refresh' ELSE 'no_change' END AS outcome,
        error FROM scan)"""
_SCAN_VIEWS = "prices ref_prices ev symbols"
sql("classify_split_details", _SCAN_VIEWS, f"""
    WITH {_SCAN} SELECT r.symbol, CAST(r.date AS VARCHAR) AS check_date, r.event_type, CAST(e.event_date AS VARCHAR) AS split_date, e.value AS ratio
    FROM ranked r JOIN revents e ON e.symbol = r.symbol AND e.event_date > r.date AND e.kind = 'split'
    WHERE r.event_type IN ('stock_split', 'reverse_split')""")
sql("detect_adjustments", _SCAN_VIEWS, f"WITH {_SCAN} SELECT * FROM scan")
sql("detected_events", _SCAN_VIEWS, f"WITH {_SCAN} {_FACTS}")
sql("scan_summary", _SCAN_VIEWS, f"""
    WITH {_SCAN} SELECT 'by_type' AS section, event_type AS name, count(*) AS n FROM ranked GROUP BY 2
    UNION ALL SELECT 'by_severity', severity, count(*) FROM ranked GROUP BY 2
    UNION ALL SELECT 'symbols', outcome, count(*) FROM outcomes GROUP BY 2""")
sql("scan_outcomes", _SCAN_VIEWS, f"WITH {_SCAN} SELECT * FROM outcomes")
sql("adjustment_report", _SCAN_VIEWS, f"""
    WITH {_SCAN} SELECT s.symbol, s.needs_refresh, s.max_pct_diff,
        string_agg(CAST(r.date AS VARCHAR) || '=' || r.event_type, ';' ORDER BY r.date) AS events
    FROM scan s JOIN ranked r ON r.symbol = s.symbol WHERE s.error IS NULL AND r.severity = 'critical'
    GROUP BY 1, 2, 3""")
sql("fix_plan", _SCAN_VIEWS, f"""
    WITH {_SCAN}, firsts AS (SELECT symbol, min(date) AS date, arg_min(event_type, date) AS event_type FROM ranked GROUP BY symbol),
    named AS (SELECT f.symbol, coalesce(e.id, {_event_id('date', 'f.')}) AS id FROM firsts f LEFT JOIN ev e
      ON e.symbol = f.symbol AND e.event_date = f.date AND e.event_type = f.event_type)
    SELECT s.symbol, e.id AS event_id, coalesce(p.n, 0) AS rows_deleted, 'fix_' || s.symbol || '_20010630' AS job_id,
        '1970-01-01' AS date_from, '2001-06-30' AS date_to, '1d' AS "interval", TRUE AS force_refresh, 'high' AS priority,
        'pending' AS job_status, CASE WHEN e.id IS NOT NULL THEN 'fixed' END AS event_status
    FROM scan s LEFT JOIN named e USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS n FROM prices GROUP BY symbol) p USING (symbol) WHERE s.needs_refresh AND s.error IS NULL""")
sql("record_events", _SCAN_VIEWS, f"""
    WITH {_SCAN} SELECT {_event_id('date')} AS id, symbol, CAST(date AS VARCHAR) AS event_date, event_type, severity,
        CASE WHEN event_type LIKE '%_split' THEN CAST(CAST(ps AS DECIMAL(38,6)) AS DOUBLE) END AS ratio,
        CASE WHEN event_type LIKE '%dividend' THEN CAST(CAST(sd AS DECIMAL(18,4)) AS DOUBLE) END AS amount,
        CAST(CAST(CAST(CAST(stored_close AS VARCHAR) AS DECIMAL(18,8)) AS DECIMAL(18,4)) AS DOUBLE) AS db_price_at_detection,
        CAST(CAST(CAST(CAST(reference_close AS VARCHAR) AS DECIMAL(18,8)) AS DECIMAL(18,4)) AS DOUBLE) AS yf_price_at_detection,
        CAST(CAST(pct AS DECIMAL(18,6)) AS DOUBLE) AS pct_difference,
        'detected' AS status, CASE severity {_ADVICE} END AS notes, '{_NOW}' AS detected_at
    FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.symbol = r.symbol AND e.event_date = r.date AND e.event_type = r.event_type)""")

# --- H --------------------------------------------------------------------------------------------

_EV = f"id, symbol, {_s('event_date')}, event_type, CAST(ratio AS DOUBLE) AS ratio, CAST(amount AS DOUBLE) AS amount, status, severity, {_s('detected_at')}"
sql("events_listing", "ev", f"""
    SELECT {_EV}, total FROM (SELECT *, count(*) OVER () AS total FROM ev WHERE status = 'confirmed'
      AND event_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' ORDER BY detected_at DESC, id LIMIT 20 OFFSET 20)""")
sql("events_listing_after", "ev", f"""
    SELECT {_EV} FROM (SELECT * FROM ev WHERE detected_at < TIMESTAMP '1998-06-30' OR detected_at = TIMESTAMP '1998-06-30' AND id > 0
      ORDER BY detected_at DESC, id LIMIT 50)""")
sql("events_by_symbol", "ev", f"SELECT {_EV} FROM ev WHERE symbol = 'S3'")
sql("pending_events", "ev", f"SELECT {_EV} FROM ev WHERE status NOT IN ('fixed', 'ignored')")
sql("dividend_calendar", "ev", f"""
    SELECT {_EV} FROM ev WHERE event_type IN ('dividend', 'special_dividend') AND event_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
sql("split_history", "ev", f"SELECT {_EV} FROM ev WHERE event_type IN ('stock_split', 'reverse_split')")

# --- I --------------------------------------------------------------------------------------------

_GRID_VIEWS = "symbols raw prices"
sql("source_point_grid", _GRID_VIEWS, f"""
    WITH {_GRID} SELECT symbol, {_s('date')}, source, open, close, adj_close, coalesce(volume, 0) AS volume, status FROM points""")
_SUMMARY = f"""{_GRID}, said AS (SELECT symbol, date, string_agg(source || ':' || status, '; ' ORDER BY source) AS statuses FROM points GROUP BY 1, 2),
    rawpts AS (SELECT * FROM points WHERE source <> 'stored' AND close IS NOT NULL),
    rawsum AS (SELECT symbol, date, count(*) AS n, max(close) - min(close) AS cd, max(open) - min(open) AS od, median(close) AS med
      FROM rawpts GROUP BY 1, 2),
    summary AS (SELECT s.symbol, s.date, coalesce(r.n, 0) AS raw_source_count, round(CASE WHEN r.n >= 2 THEN od END, 6) AS max_raw_open_diff,
        round(CASE WHEN r.n >= 2 THEN cd END, 6) AS max_raw_close_diff, round(e.close - t.close, 6) AS primary_verifier_close_diff,
        round(a.close - r.med, 6) AS third_vs_raw_median_close, round(y.adj_close - e.adj_close, 6) AS stored_adj_vs_primary_adj,
        round(y.adj_close - t.adj_close, 6) AS stored_adj_vs_verifier_adj, statuses,
        e.close - t.close AS d1, a.close - r.med AS d2
      FROM said s LEFT JOIN rawsum r USING (symbol, date)
      LEFT JOIN points e ON e.symbol = s.symbol AND e.date = s.date AND e.source = 'eodhd'
      LEFT JOIN points t ON t.symbol = s.symbol AND t.date = s.date AND t.source = 'tiingo'
      LEFT JOIN points a ON a.symbol = s.symbol AND a.date = s.date AND a.source = 'alpaca'
      LEFT JOIN points y ON y.symbol = s.symbol AND y.date = s.date AND y.source = 'stored')"""
sql("source_summary", _GRID_VIEWS, f"""
    WITH {_SUMMARY} SELECT symbol, {_s('date')}, raw_source_count, max_raw_open_diff, max_raw_close_diff, primary_verifier_close_diff,
        third_vs_raw_median_close, stored_adj_vs_primary_adj, stored_adj_vs_verifier_adj, statuses FROM summary""")
sql("source_scorecard", _GRID_VIEWS, f"""
    WITH {_SUMMARY}, totals AS (SELECT count(*) AS rows, count(*) FILTER (WHERE raw_source_count >= 2) AS rows_with_two_sources,
        count(*) FILTER (WHERE abs(d1) <= CAST(0.01 AS DOUBLE)) AS primary_matches, count(d1) AS primary_compared,
        count(*) FILTER (WHERE abs(d2) <= CAST(0.01 AS DOUBLE)) AS third_matches, count(d2) AS third_compared,
        max(abs(max_raw_close_diff)) AS max_raw_close_diff, max(abs(stored_adj_vs_primary_adj)) AS max_stored_vs_primary,
        max(abs(stored_adj_vs_verifier_adj)) AS max_stored_vs_verifier FROM summary)
    SELECT *, primary_matches >= greatest(1, floor(CAST(rows_with_two_sources AS DOUBLE) * CAST(0.9 AS DOUBLE))) AS primary_recommended FROM totals""")
sql("stored_vs_vendor_diff", "prices ref_prices", """
    WITH d AS (SELECT p.symbol, abs(p.close - r.close) AS x FROM prices p JOIN ref_prices r USING (symbol, date)),
    both_levels AS (SELECT * FROM d UNION ALL SELECT '*', x FROM d),
    gone AS (SELECT symbol FROM prices p WHERE NOT EXISTS (SELECT 1 FROM ref_prices r WHERE r.symbol = p.symbol AND r.date = p.date)),
    gone2 AS (SELECT symbol, count(*) AS g FROM (SELECT symbol FROM gone UNION ALL SELECT '*' FROM gone) GROUP BY symbol),
    stats AS (SELECT symbol, count(*) AS rows, max(x) AS max_diff, median(x) AS median_diff,
        list_sort(list(x))[CAST(ceil(CAST(count(*) AS DOUBLE) * CAST(0.99 AS DOUBLE)) AS INTEGER)] AS p99_diff FROM both_levels GROUP BY symbol)
    SELECT coalesce(s.symbol, g.symbol) AS symbol, coalesce(rows, 0) AS rows, max_diff, median_diff, p99_diff, coalesce(g, 0) AS vendor_missing
    FROM stats s FULL OUTER JOIN gone2 g ON s.symbol = g.symbol""")
sql("month_end_dates", "prices", """
    SELECT CAST(max(date) AS VARCHAR) AS date FROM prices GROUP BY date_trunc('month', date)""")


def _momentum(source: str, grid: str, p: str) -> str:
    return f"""{p}now AS (SELECT g.*, x.close AS c1 FROM {grid} g ASOF LEFT JOIN {source} x ON g.symbol = x.symbol AND g.as_of >= x.date),
    {p}score AS (SELECT n.symbol, n.as_of, n.lookback, CASE WHEN y.close <> 0 THEN n.c1 / y.close - 1.0 END AS score
      FROM {p}now n ASOF LEFT JOIN {source} y ON n.symbol = y.symbol AND n.past >= y.date)"""


def _targets(source: str) -> str:
    return f"""targets AS (SELECT s.symbol, m.as_of, l.lookback, CAST(m.as_of - to_months(l.lookback) AS DATE) AS past
      FROM (SELECT DISTINCT symbol FROM {source}) s, (SELECT max(date) AS as_of FROM {source} GROUP BY date_trunc('month', date)) m,
           (VALUES (1), (3), (6), (12)) l(lookback))"""


sql("momentum_score", "prices", f"""
    WITH {_targets('prices')}, {_momentum('prices', 'targets', 'a_')} SELECT symbol, {_s('as_of')}, lookback, score FROM a_score""")
sql("momentum_reversal_risk", "prices ref_prices", f"""
    WITH {_targets('ref_prices')}, {_momentum('ref_prices', 'targets', 'v_')}, {_momentum('prices', 'targets', 's_')},
    both_scores AS (SELECT v.symbol, v.as_of, v.lookback, v.score AS vs, s.score AS ss, abs(s.score - v.score) AS err
      FROM v_score v JOIN s_score s USING (symbol, as_of, lookback) WHERE v.score IS NOT NULL AND s.score IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY as_of, lookback ORDER BY vs DESC, symbol) AS rv,
        row_number() OVER (PARTITION BY as_of, lookback ORDER BY ss DESC, symbol) AS rs FROM both_scores),
    risk AS (SELECT a.as_of, a.lookback, a.symbol AS vendor_top, a.vs - b.vs AS top_margin, a.err + b.err AS top_error_bound, c.symbol AS stored_top
      FROM placed a JOIN placed b USING (as_of, lookback) JOIN placed c USING (as_of, lookback) WHERE a.rv = 1 AND b.rv = 2 AND c.rs = 1)
    SELECT {_s('as_of')}, lookback, vendor_top, stored_top, round(top_margin, 9) AS top_margin, round(top_error_bound, 9) AS top_error_bound,
           vendor_top <> stored_top AS rank_reversed FROM risk WHERE vendor_top <> stored_top OR top_error_bound >= top_margin""")

# --- J --------------------------------------------------------------------------------------------

sql("jobs_listing", "jobs", f"""
    SELECT job_id, status, {_s('created_at', 'started_at', 'completed_at')},
           CAST(date_diff('second', started_at, coalesce(completed_at, TIMESTAMP '2001-08-01 12:00:00')) AS BIGINT) AS duration_seconds, total
    FROM (SELECT *, count(*) OVER () AS total FROM jobs WHERE status = 'processing' AND created_at >= TIMESTAMP '1999-01-01'
          ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 10)""")
sql("jobs_listing_after", "jobs", f"""
    SELECT job_id, status, {_s('created_at', 'started_at', 'completed_at')},
           CAST(date_diff('second', started_at, coalesce(completed_at, TIMESTAMP '2001-08-01 12:00:00')) AS BIGINT) AS duration_seconds
    FROM (SELECT * FROM jobs WHERE created_at <= TIMESTAMP '1998-06-30 12:00:00' ORDER BY created_at DESC, job_id LIMIT 200)""")
sql("job_outcome", "job_results", """
    SELECT job_id, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
           count(*) FILTER (WHERE status = 'no_data') AS no_data_count, CAST(sum(rows_fetched) AS BIGINT) AS fetched_rows, CAST(100 AS DOUBLE) AS percent,
           CASE WHEN bool_and(status = 'success') THEN 'completed' ELSE 'completed_errors' END AS final_status
    FROM job_results GROUP BY job_id""")
sql("job_queue_status", "jobs", """
    SELECT * FROM (SELECT status, count(*) AS n FROM jobs GROUP BY status), (
      SELECT count(*) AS recent_total, count(*) FILTER (WHERE status = 'completed') AS recent_completed,
             count(*) FILTER (WHERE status = 'failed') AS recent_failed,
             CAST(trunc(coalesce(avg(date_diff('second', started_at, completed_at)), 0)) AS BIGINT) AS recent_avg_seconds
      FROM jobs WHERE created_at >= TIMESTAMP '2001-07-31 12:00:00')""")
sql("cancel_jobs", "jobs", """
    WITH c AS (SELECT *, priority = 'high' AS asked, status NOT IN ('completed', 'failed', 'cancelled') AS open FROM jobs)
    SELECT job_id, CASE WHEN asked AND open THEN 'cancelled' ELSE status END AS status,
           CASE WHEN asked AND open THEN '2001-08-01 12:00:00' ELSE CAST(completed_at AS VARCHAR) END AS completed_at,
           CASE WHEN asked THEN open END AS cancelled FROM c""")
sql("purge_jobs", "jobs", f"""
    SELECT job_id, status, {_s('created_at')} FROM jobs
    WHERE NOT (created_at < TIMESTAMP '1999-05-31' AND status IN ('completed', 'cancelled'))""")
sql("purged_count", "jobs", """
    SELECT status, count(*) AS purged FROM jobs WHERE created_at < TIMESTAMP '1999-05-31' AND status IN ('completed', 'cancelled') GROUP BY status""")
_RUN_STATUS = """
    WITH r AS (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS run_id, 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
        max(CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END) <= 0 AS bad FROM lineitem GROUP BY 1, 2)
    SELECT run_id, count(*) AS total_symbols, CAST(ceil(count(*) / 10.0) AS BIGINT) AS batch_count, count(*) FILTER (WHERE NOT bad) AS success_count,
           count(*) FILTER (WHERE bad) AS failed_count,
           CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN 'success' WHEN count(*) FILTER (WHERE NOT bad) = 0 THEN 'failed'
                ELSE 'completed_with_errors' END AS status FROM r GROUP BY run_id"""
sql("run_status", "", _RUN_STATUS)
sql("export_run_summary", "", f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in ('run_id', 'total_symbols', 'batch_count', 'success_count', 'failed_count', 'status'))} FROM ({_RUN_STATUS})")
sql("run_affected", "", """
    SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS run_id, 'S' || CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem GROUP BY 1, 2
    HAVING max(CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END) <= 0""")
sql("create_jobs", "job_requests", f"""
    SELECT 'job_' || strftime(created_at, '%Y%m%d_%H%M%S') || '_' || request_id AS job_id, 'pending' AS status,
           'S' || CAST(c AS VARCHAR) || ';^VIX;BRK.' || p1 AS symbols, {_s('date_from', 'date_to')}, "interval", force AS force_refresh,
           priority, {_s('created_at')} FROM {_JOB_INPUT} WHERE {_JOB_OUTCOME} IS NULL""")
sql("next_pending", "jobs", f"""
    SELECT job_id, {_s('created_at')}, array_to_string(symbols, ';') AS symbols FROM jobs WHERE status = 'pending'
    ORDER BY jobs.created_at, job_id LIMIT 1""")

# --- K --------------------------------------------------------------------------------------------

_TIMED = "timed AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS rk FROM timings)"
sql("latency_report", "timings", f"""
    WITH {_TIMED} SELECT operation, count(*) AS count, round(avg(duration), 6) AS avg, min(duration) AS min, max(duration) AS max,
        round(avg(duration) FILTER (WHERE rk <= 10), 6) AS recent_avg FROM timed WHERE rk <= 100 GROUP BY operation""")
sql("slowest_operations", "timings", f"""
    WITH {_TIMED} SELECT operation, duration, event_id FROM timed WHERE rk <= 10 ORDER BY duration DESC, operation, event_id LIMIT 10""")
sql("load_test_summary", "load_test", """
    WITH t AS (SELECT concurrency, (max(epoch_us(started_at) + elapsed_ms * 1000) - min(epoch_us(started_at))) / 1e6 AS s,
        count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS e, avg(elapsed_ms) FILTER (WHERE ok) AS a,
        median(elapsed_ms) FILTER (WHERE ok) AS p50, list_sort(list(elapsed_ms) FILTER (WHERE ok)) AS l FROM load_test GROUP BY concurrency)
    SELECT concurrency, n AS successful, e AS errors, round(s, 6) AS total_time_s, round(a, 6) AS avg_latency_ms, round(p50, 6) AS p50_latency_ms,
           l[CAST(floor(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS INTEGER) + 1] AS p95_latency_ms, round(n / s, 6) AS throughput_rps FROM t""")
sql("resample_ohlcv", "prices", " UNION ALL ".join(f"""
    SELECT symbol, CAST(CAST(date_trunc('{unit}', date) AS DATE) AS VARCHAR) AS period_start, arg_min(open, date) AS open, max(high) AS high,
           min(low) AS low, arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume, '{name}' AS "interval"
    FROM prices GROUP BY symbol, date_trunc('{unit}', date)""" for name, unit in (("1wk", "week"), ("1mo", "month"), ("3mo", "quarter"))))

# --- S: a drained stream equals the batch result ----------------------------------------------------

sql("stream_upsert_prices", "prices price_changes", "SELECT * EXCLUDE (change) FROM ("
    + _upsert("o.last_updated < n.last_updated") + ")")
sql("stream_consensus", "raw", f"""
    WITH {_consensus('raw')} SELECT symbol, {_s('date')}, consensus_close FROM (SELECT DISTINCT symbol, date FROM v)
    LEFT JOIN cons USING (symbol, date)""")
sql("stream_late_rows", "raw raw_changes", f"""
    WITH {_consensus('raw')} SELECT count(*) AS days, count(consensus_close) AS agreed,
        (SELECT count(*) FROM raw_changes WHERE volume % 400 = 0 AND date < DATE '2000-01-01') AS dropped
    FROM (SELECT DISTINCT symbol, date FROM v) LEFT JOIN cons USING (symbol, date)""")
sql("stream_error_counts", "", """
    SELECT CAST(date_trunc('minute', ts) AS VARCHAR) AS window_start, 'k' || json_extract_string(props, '$.k') AS error_type, count(*) AS n
    FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
