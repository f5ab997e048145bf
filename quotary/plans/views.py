"""The fixture relations as SQL, for the checks. Each view lists the views it reads."""

_TICKER = ("CASE WHEN {k} % 5 = 0 AND {d} >= DATE '1996-01-01' + CAST({k} * 37 % 1800 AS INTEGER) "
           "THEN 'N' ELSE 'S' END || CAST({k} AS VARCHAR)")
_CLOCK = "CAST({d} AS TIMESTAMP) + to_seconds(CAST({s} AS BIGINT))"


def _ticker(k, d):
    return _TICKER.format(k=k, d=d)


def _clock(d, s):
    return _CLOCK.format(d=d, s=s)


def _money(c):
    return f"CAST({c} AS DOUBLE) / CAST(100 AS DOUBLE)"


def _mills(m):
    return f"CAST(CAST({m} AS DECIMAL(15,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,6))"


def _raw(source, off, wait, there):
    return f"""SELECT {_ticker('k', 'date')} AS symbol, date, '{source}' AS source,
        {_mills(f'op * 10 + {off}')} AS open, {_mills(f'hi * 10 + {off}')} AS high,
        {_mills(f'lo * 10 + {off}')} AS low, {_mills(f'mid * 10 + {off}')} AS close,
        volume, {_clock('date', f'72000 + {wait}')} AS fetched_at,
        CASE WHEN ok % 17 = 0 THEN {_mills('mid * 10')} END AS consensus_close
        FROM days WHERE {there}"""


_CENTS = "(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT))"

VIEWS = {
    "days": ((), f"""
        SELECT k, date, least(lo, op) AS lo, greatest(hi, op) AS hi, mid, op, volume, ok FROM (
          SELECT *, mid - mid // 333 + (mid // 1000) * (ok % 7) AS op FROM (
            SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, min(c) AS lo, max(c) AS hi,
                   CAST(sum(c) AS BIGINT) // count(*) AS mid, CAST(sum(q) AS BIGINT) * 100 AS volume,
                   CAST(sum(l_orderkey) AS BIGINT) AS ok
            FROM (SELECT *, {_CENTS} AS c, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
            GROUP BY 1, 2))"""),
    "prices": (("days",), f"""
        SELECT CASE WHEN k % 5 = 0 AND ok % 11 = 0 THEN 'N' || CAST(k AS VARCHAR) ELSE {_ticker('k', 'date')} END AS symbol,
               date, {_money('op')} AS open, {_money('hi')} AS high, {_money('lo')} AS low, {_money('mid')} AS close,
               volume, 'yfinance' AS source, {_clock('date', '64800 + ok % 3600')} AS last_updated
        FROM days"""),
    "raw": (("days",), " UNION ALL ".join([
        _raw("eodhd", "0", 0, "ok % 13 <> 0"),
        _raw("tiingo", "CASE ok % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 25 END", 60, "ok % 7 <> 0"),
        _raw("alpaca", "CASE ok % 5 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 20 WHEN 3 THEN 40 ELSE 100 END", 120,
             "ok % 3 <> 0")])),
    "raw_changes": (("raw",), """
        SELECT symbol, date, source, open, greatest(high, CAST(close + 0.005 AS DECIMAL(18,6))) AS high, low,
               CAST(close + 0.005 AS DECIMAL(18,6)) AS close, volume, fetched_at + INTERVAL 2 DAYS AS fetched_at
        FROM raw WHERE volume % 400 = 0
        UNION ALL
        SELECT symbol, date + 3000 AS date, source, open, high, low, close, volume, fetched_at + INTERVAL 2 DAYS
        FROM raw WHERE volume % 900 = 0"""),
    "price_changes": (("prices",), """
        SELECT symbol, date, open, high, low, low AS close, volume, 'vendor' AS source,
               last_updated + to_days(CAST(volume // 100 % 3 - 1 AS INTEGER)) AS last_updated
        FROM prices WHERE volume % 500 <> 0
        UNION ALL
        SELECT symbol, date + 3000, open, high, low, low, volume, 'vendor', last_updated + INTERVAL 5 DAYS
        FROM prices WHERE volume % 700 = 0"""),
    "symbols": ((), """
        SELECT p || CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN s_acctbal < 9500 THEN s_name END AS name,
               CASE s_nationkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' END AS exchange,
               CASE WHEN s_acctbal >= 0 THEN 'USD' END AS currency,
               CASE WHEN s_acctbal < 0 THEN FALSE WHEN s_acctbal < 9000 THEN TRUE END AS is_active,
               s_acctbal > 5000 AS has_full_history,
               CASE WHEN s_acctbal > 4000 THEN DATE '1994-06-01' + s_nationkey * 40 END AS first_date,
               CASE WHEN s_acctbal > 4000 THEN DATE '2001-10-01' + s_nationkey * 2 END AS last_date,
               TIMESTAMP '1994-01-01' + to_minutes(CAST(s_suppkey AS BIGINT)) AS created_at
        FROM supplier, (VALUES ('S'), ('N')) v(p) WHERE p = 'S' OR s_suppkey % 5 = 0
        UNION ALL
        SELECT 'X' || CAST(n_nationkey AS VARCHAR), n_name, NULL, 'USD', TRUE, FALSE,
               CASE WHEN n_regionkey = 0 THEN DATE '1999-01-04' END, NULL, TIMESTAMP '1994-01-01'
        FROM nation"""),
    "changes": ((), """
        SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS old_symbol, 'N' || CAST(s_suppkey AS VARCHAR) AS new_symbol,
               DATE '1996-01-01' + CAST(s_suppkey * 37 % 1800 AS INTEGER) AS change_date
        FROM supplier WHERE s_suppkey % 5 = 0"""),
    "ev": ((), f"""
        SELECT id, symbol, event_date, event_type, CAST(split_ratio AS DECIMAL(10,6)) AS ratio,
               CAST(dividend_amount AS DECIMAL(12,4)) AS amount, dividend_amount, split_ratio, event_date AS ex_date,
               CASE WHEN ok % 4 <> 0 THEN {_clock('event_date', '3600')} END AS confirmed_at,
               CASE WHEN ok % 4 <> 0 THEN 1 END AS source_count,
               CASE WHEN ok % 4 <> 0 THEN 'eodhd' END AS source_names,
               {_clock('event_date', 'ok % 86400')} AS detected_at,
               CASE ok % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS severity,
               CASE ok % 7 WHEN 0 THEN 'detected' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'fixing' WHEN 3 THEN 'fixed'
                    WHEN 4 THEN 'ignored' WHEN 5 THEN 'failed' END AS status,
               CAST(event_date AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS notes
        FROM (
          SELECT *, (k * 10000 + date_diff('day', DATE '1995-01-01', event_date)) * 8 + n AS id,
                 {_ticker('k', 'event_date')} AS symbol,
                 CASE n WHEN 1 THEN 'dividend' WHEN 2 THEN 'split' WHEN 3 THEN 'stock_split' WHEN 4 THEN 'reverse_split'
                        WHEN 5 THEN 'special_dividend' WHEN 6 THEN 'capital_gain' WHEN 7 THEN 'spinoff' END AS event_type,
                 CASE WHEN n IN (2, 3, 4) THEN CAST(CASE qty % 6 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 WHEN 2 THEN 0.5
                        WHEN 3 THEN 1.5 WHEN 4 THEN 0.0 ELSE 4.0 END AS DECIMAL(18,8)) END AS split_ratio,
                 CASE WHEN n IN (1, 5, 6) THEN CAST((qty - 1) / 4.0 AS DECIMAL(18,8)) END AS dividend_amount
          FROM (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS event_date, l_linenumber AS n,
                       min(CAST(l_quantity AS BIGINT)) AS qty, max(l_orderkey) AS ok
                FROM lineitem WHERE l_discount >= 0.09 AND l_tax >= 0.06 GROUP BY 1, 2, 3))"""),
    "ref_prices": (("prices",), """
        SELECT symbol, date, CAST(CAST(round(close * 100) AS BIGINT) *
               CASE volume // 100 % 8 WHEN 3 THEN 999 WHEN 4 THEN 970 WHEN 5 THEN 880 WHEN 6 THEN 500 WHEN 7 THEN 2000
                    ELSE 1000 END AS DOUBLE) / CAST(100000 AS DOUBLE) AS close
        FROM prices WHERE volume % 1100 <> 0"""),
    "econ": ((), f"""
        SELECT symbol, date, CASE WHEN e % 9 <> 0 THEN {_money('c')} END AS value,
               {_clock('date', '43200 + e % 3600')} AS last_updated
        FROM (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date,
                     CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c, max(event_id) AS e
              FROM events GROUP BY 1, 2)"""),
    "econ_changes": (("econ",), """
        SELECT symbol, date, value + 1 AS value, last_updated + INTERVAL 1 DAY AS last_updated
        FROM econ WHERE value > 50
        UNION ALL
        SELECT symbol, date + 40, value, last_updated + INTERVAL 1 DAY FROM econ WHERE value > 100"""),
    "series": ((), "SELECT 'U' || CAST(c_custkey AS VARCHAR) AS symbol, c_name AS name FROM customer"),
    "obs": ((), """
        SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, event_id,
               CASE WHEN event_type = 'view' AND value > 100 THEN '2024-13-01'
                    ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END AS date,
               CASE event_type WHEN 'error' THEN '.' WHEN 'signup' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value
        FROM events"""),
    "jobs": ((), f"""
        SELECT 'job_' || CAST(k AS VARCHAR) AS job_id, k, c, status, symbols, date_from, date_to, priority,
               created_at, started_at,
               CASE WHEN status IN ('completed', 'completed_errors', 'failed')
                    THEN started_at + to_seconds(c % 4000) END AS completed_at
        FROM (SELECT *, CASE WHEN status <> 'pending' THEN created_at + INTERVAL 30 SECONDS END AS started_at
          FROM (SELECT o_orderkey AS k, o_custkey AS c,
                 CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'completed'
                          WHEN 1 THEN 'completed_errors' ELSE 'failed' END
                      WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'processing' ELSE 'pending' END
                      ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'completed' END END AS status,
                 list_filter(['S' || CAST(o_custkey % 97 AS VARCHAR), 'S' || CAST(o_orderkey % 89 AS VARCHAR),
                   CASE WHEN o_orderkey % 3 = 0 THEN 'S' || CAST(o_custkey % 11 AS VARCHAR) END],
                   lambda x : x IS NOT NULL) AS symbols,
                 CAST(o_orderdate AS DATE) - 300 AS date_from, CAST(o_orderdate AS DATE) AS date_to,
                 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low'
                      ELSE 'normal' END AS priority,
                 {_clock('CAST(o_orderdate AS DATE)', 'o_orderkey % 86400')} AS created_at
          FROM orders))"""),
    "job_results": (("jobs",), """
        SELECT job_id, symbol, CASE (k + i) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'failed'
                 ELSE 'no_data' END AS status, CASE WHEN (k + i) % 4 < 2 THEN (c + i) % 500 ELSE 0 END AS rows_fetched
        FROM (SELECT job_id, k, c, unnest(symbols) AS symbol, generate_subscripts(symbols, 1) - 1 AS i FROM jobs
              WHERE status IN ('completed', 'completed_errors', 'failed'))"""),
    "job_requests": ((), f"""
        SELECT 'req_' || CAST(o_orderkey AS VARCHAR) AS request_id, o_orderkey AS k, o_custkey AS c,
               substr(o_orderpriority, 1, 1) AS p1,
               CAST(o_orderdate AS DATE) - CASE o_orderkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 400 WHEN 2 THEN -20
                    WHEN 3 THEN 4000 ELSE 9000 END AS date_from,
               CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 7 = 0 THEN 2000 ELSE 0 END AS date_to,
               CASE o_orderkey % 5 WHEN 0 THEN '1d' WHEN 1 THEN '1wk' WHEN 2 THEN '1mo' WHEN 3 THEN '3mo' ELSE '2h' END
                    AS "interval",
               CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low'
                    ELSE 'normal' END AS priority,
               o_orderkey % 2 = 0 AS force,
               {_clock('CAST(o_orderdate AS DATE)', 'o_orderkey % 86400')} AS created_at
        FROM orders"""),
    "quotes": ((), f"""
        SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS line_key,
               l_linenumber AS line_no,
               CASE WHEN l_discount <> 0.01 THEN {_money(_CENTS)} END AS open,
               CASE WHEN l_discount = 0.02 THEN {_money(_CENTS + ' - 50')} ELSE {_money(f'({_CENTS} + 50)')} END AS high,
               CASE WHEN l_discount = 0.03 THEN 0.0 ELSE {_money(f'({_CENTS} - 25)')} END AS low,
               CASE WHEN l_discount = 0.04 THEN CAST('NaN' AS DOUBLE) ELSE {_money(f'({_CENTS} + 10)')} END AS close,
               CASE WHEN l_discount = 0.05 THEN -l_quantity WHEN l_discount = 0.06 THEN NULL ELSE l_quantity + 0.5 END AS volume,
               CAST(CASE WHEN l_discount = 0.07 THEN 2.0 WHEN l_discount = 0.08 THEN 0.5 WHEN l_discount = 0.09 THEN NULL
                    ELSE 0.0 END AS DOUBLE) AS splits,
               CASE WHEN l_tax = 0.08 THEN l_quantity / 100 WHEN l_tax = 0.07 THEN NULL ELSE 0.0 END AS dividends
        FROM lineitem""".replace(_money(_CENTS + ' - 50'), _money(f'({_CENTS} - 50)'))),
    "typed": ((), """
        SELECT c_custkey AS request_id,
               CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal < -800 THEN '  '
                    WHEN c_acctbal < 0 THEN '^' || lower(substr(c_mktsegment, 1, 3)) || '.b'
                    ELSE ' ' || lower(substr(c_mktsegment, 1, 4)) || CAST(c_custkey % 100 AS VARCHAR) ||
                      (['.b', '.TO', '.t', '.XYZ', '', '.1', ' ', '.twO'])[c_nationkey % 8 + 1] END AS raw
        FROM customer"""),
    "symbol_lists": ((), """
        SELECT o_orderkey AS request_id,
               's' || CAST(o_custkey AS VARCHAR) || ', S' || CAST(o_custkey AS VARCHAR) || ' ,brk.b,,^vix, ' ||
               lower(o_orderstatus) || '.to,BRK-B,' ||
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'L1,L2,L3,L4,L5,L6,L7,L8,L9,L10,L11,L12' ELSE '' END AS symbols
        FROM orders"""),
    "cover_requests": (("symbols",), """
        SELECT symbol, DATE '1995-01-10' + CAST(CAST(epoch(created_at) AS BIGINT) // 60 % 400 AS INTEGER) AS date_from,
               DATE '2001-10-20' + CAST(CAST(epoch(created_at) AS BIGINT) // 60 % 16 AS INTEGER) AS date_to
        FROM symbols"""),
    "range_requests": ((), """
        SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS start,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS "end"
        FROM orders"""),
    "timings": ((), "SELECT event_type AS operation, ts, event_id, value AS duration FROM events"),
    "load_test": ((), """
        SELECT CAST(user_id % 6 + 1 AS INTEGER) * 4 AS concurrency, event_type <> 'error' AS ok, value AS elapsed_ms,
               date_trunc('second', ts) AS started_at
        FROM events"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind a WITH clause that defines ``names`` and what they read."""
    seen: list[str] = []

    def add(name):
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in seen:
            seen.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in seen)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
