"""New events have ids, and a scan's own event is the one that its fix updates."""

from pyspark.sql import functions as F

from quotary.operators import adjustments, merge
from quotary.schemas import RELATIONS


def now():
    return F.lit("2001-07-01 00:00:00").cast("timestamp")


def _events(spark):
    row = {"id": 5, "symbol": "AA", "event_date": "1990-01-01", "event_type": "dividend", "status": "confirmed",
           "detected_at": "1990-01-01 00:00:00"}
    fields = [F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in RELATIONS["corporate_events"].fields]
    return spark.range(1).select(*fields)


def _scan(spark):
    found = spark.sql("""SELECT * FROM VALUES
        ('AA', DATE'2000-03-01', 80.0D, 10.0D, 700.0D, 'stock_split', 'critical', 'Immediate data refresh required', 8.0D),
        ('AA', DATE'2000-05-01', 40.0D, 39.0D, 2.5D, 'dividend', 'normal', 'Schedule data refresh', NULL)
        AS t(symbol, check_date, stored_close, reference_close, pct_difference, event_type, severity, recommendation, cumulative_factor)""")
    found = found.withColumns({c: F.lit(None).cast("double") for c in ("total_dividends", "special_dividend", "capital_gains")})
    symbols = spark.sql("SELECT 'AA' AS symbol, true AS needs_refresh, CAST(NULL AS string) AS error")
    return adjustments.Scan(events=found, symbols=symbols, samples=found)


def test_detect_record_fix_status(spark):
    scan = _scan(spark)
    table = merge.record_events(_events(spark), scan.events, now())
    new = {r.event_type: r for r in table.where("change = 'inserted'").collect()}
    assert len({r.id for r in new.values()} | {5}) == 3 and all(r.id for r in new.values())
    assert float(new["stock_split"].pct_difference) == 700.0 and float(new["stock_split"].ratio) == 8.0
    assert '"cumulative_factor":8.0' in new["stock_split"].source_data
    prices = spark.sql("SELECT 'AA' AS symbol, explode(sequence(1, 7)) AS n")
    plan = adjustments.fix_plan(adjustments.first_events(scan, table), prices, F.lit("2001-07-01").cast("date"))
    assert [(r.event_id, r.rows_deleted) for r in plan.collect()] == [(new["stock_split"].id, 7)]
    actions = plan.select(F.col("event_id").alias("id"), F.col("event_status").alias("action"), F.lit(None).cast("string").alias("reason"),
                          "job_id", "rows_deleted")
    after = {r.id: r for r in merge.event_status_update(table.drop("change"), actions, now()).collect()}
    fixed = after[new["stock_split"].id]
    assert (fixed.status, fixed.fix_job_id, fixed.rows_deleted) == ("fixed", "fix_AA_20010701", 7) and fixed.fixed_at
    assert after[5].status == "confirmed" and after[new["dividend"].id].status == "detected"


def test_ids_do_not_change_from_run_to_run(spark):
    ids = [sorted(r.id for r in merge.record_events(_events(spark), _scan(spark).events, now()).collect()) for _ in range(2)]
    assert ids[0] == ids[1]


def test_the_last_of_several_actions_counts_once(spark):
    table = _events(spark)
    rows = [(5, "ignore", "noise", 1), (5, "confirm", None, 3), (5, "failed", None, 2), (9, "fixed", None, 1)]
    actions = spark.createDataFrame(rows, "id bigint, action string, reason string, at int")
    assert [(r.id, r.status) for r in merge.event_status_update(table, actions, now()).collect()] == [(5, "confirmed")]
    assert [(r.id, r.status) for r in merge.event_status_update(table, actions.drop("at"), now()).collect()] == [(5, "ignored")]
