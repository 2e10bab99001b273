"""Idempotence, empty inputs and invariants of the maintenance jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.operators import incremental, ledger, maintain
from tallybook.plans import audit, inventory, packaging, purchasing, risk
from tallybook.testviews import Inputs


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_upsert_twice_is_once(spark, sf_dir):
    v = Inputs(spark, sf_dir)
    old = v("f_store_orders").withColumn("seq", F.lit(1))
    new = old.filter("id % 3 = 0").withColumns({"status": F.lit("paid"), "seq": F.lit(2)})
    once = maintain.upsert(old, new, ["id"], ["seq"])
    assert rows_of(maintain.upsert(once, new, ["id"], ["seq"])) == rows_of(once)
    assert once.count() == old.count() and once.filter("status = 'paid'").count() == new.count()
    assert rows_of(maintain.upsert(old, new.limit(0), ["id"], ["seq"])) == rows_of(old)


def test_range_supersede_twice_is_once_and_audits_clean(spark, sf_dir):
    v = Inputs(spark, sf_dir)
    items = v("f_mkt_items")
    old, new = items.filter("report_job_id % 2 = 0"), items.filter("report_job_id % 2 = 1")
    once = maintain.supersede_ranges(old, new)
    assert rows_of(maintain.supersede_ranges(once, new)) == rows_of(once)
    assert audit.duplicate_lines(once).agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0] == 0


def test_dedupe_keeps_what_it_does_not_delete(spark, sf_dir):
    v = Inputs(spark, sf_dir)
    items, jobs = v("f_mkt_items"), v("f_report_jobs")
    kept, summary = maintain.dedupe_superseded(items, jobs)
    deleted = summary.agg(F.sum("deleted")).first()[0]
    assert kept.count() + deleted == items.count() and deleted > 0
    assert audit.superseded_rows(kept, jobs).agg(F.sum("rows")).first()[0] == 0
    again, _ = maintain.dedupe_superseded(kept, jobs)
    assert again.count() == kept.count()


def test_children_replaced_by_an_empty_set(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "order_id long, sku string")
    parents = spark.createDataFrame([(1,), (1,)], "order_id long")
    assert rows_of(maintain.replace_children(lines, parents, lines.limit(0), "order_id")) == rows_of(lines.filter("order_id = 2"))


def test_snapshot_guard(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "code string, quantity long")
    assert ledger.write_snapshot(rows.limit(0), str(tmp_path), 0)
    assert ledger.write_snapshot(rows, str(tmp_path), 1)
    assert not ledger.write_snapshot(rows.limit(0), str(tmp_path), 2)
    assert rows_of(ledger.read_snapshot(spark, str(tmp_path), "code string, quantity long")) == rows_of(rows)


def test_cursor_rules(spark):
    def cursor(times, size, mark="t5", page=3):
        page_rows = spark.createDataFrame([(t,) for t in times], "at string")
        r = incremental.next_cursor(page_rows, "at", mark, page, size).first()
        return r["watermark"], r["page"]

    assert cursor(["t5", "t5"], 2) == ("t5", 4)
    assert cursor(["t5"], 2) == ("t5", 1)
    assert cursor(["t5", "t7"], 2) == ("t7", 1)
    assert cursor([], 2) == ("t5", 1)
    assert cursor([None, ""], 2) == ("t5", 1)
    rows = spark.createDataFrame([(i, "t5") for i in range(5)] + [(9, "t4")], "id long, at string")
    pages = [[r["id"] for r in incremental.slice_page(rows, "at", "t5", 2, p).collect()] for p in (1, 2, 3, 4)]
    assert pages == [[0, 1], [2, 3], [4], []]


def test_incomplete_sweep_records_nothing(spark):
    orders = spark.createDataFrame([("CA", dt.date(2026, 4, 2), 1.0)], "market string, local_date date, total double")
    assert incremental.recovered(orders, orders, dt.date(2026, 5, 1), complete=False).count() == 0
    assert incremental.recovered(orders.limit(0), orders, dt.date(2026, 5, 1)).first()["recovered_share"] == 1.0


def test_lead_time_median(spark):
    pairs = [("2025-11-07", "2025-12-17"), ("2026-01-22", "2026-02-19"), ("2026-03-03", "2026-03-27"), ("2026-04-01", "2026-04-28"), ("2026-05-13", "2026-06-09")]
    rows = [(f"PO-{i}", "TC Printing", dt.date.fromisoformat(a), "Completed", dt.date.fromisoformat(b), "X", 1, 1) for i, (a, b) in enumerate(pairs)]
    lines = spark.createDataFrame(rows, "reference string, company string, created_date date, status string, fully_received_date date, code string, qty long, qty_received long")
    out = {r["key"]: r for r in purchasing.lead_times(purchasing.lead_samples(lines, dt.date(2026, 7, 1))).collect()}
    assert set(out) == {"TC Printing", "family:srt"}
    assert (out["family:srt"]["median_days"], out["TC Printing"]["latest_days"], out["TC Printing"]["max_days"]) == (27, 27, 40)
    four = purchasing.lead_times(purchasing.lead_samples(lines.filter("reference <> 'PO-1'"), dt.date(2026, 7, 1))).first()
    assert four["median_days"] == 27


def test_stock_breakdown(spark):
    rows = [("AU-OG-NPO-35", "base", 5123, 0, False), ("AU-CTN-OG-NPO-48", "carton", 551, 0, False), ("AU-CTN-SC-BCF-48", "carton", 9, 0, True)]
    r = inventory.base_stock(spark.createDataFrame(rows, "sku string, kind string, warehouse_soh long, fba long, discontinued boolean")).collect()
    assert [(x["base"], x["loose"], x["from_cartons"], x["carton_count"]) for x in r] == [("AU-OG-NPO-35", 5123, 26448, 551)]
    assert r[0]["loose"] + r[0]["from_cartons"] == 31571


def test_run_rate_edges(spark):
    rows = [("2026-04", "A", 61.0), ("2026-07", "B", 10.0), ("2026-07", "A", 5.0)]
    skus = spark.createDataFrame(rows, "ym string, sku string, total_tins double")
    day = dt.date(2026, 7, 10)
    out = {r["sku"]: r for r in risk.run_rate(skus, day).collect()}
    assert out["A"]["rate"] == 61.0 / 91 and not out["A"]["rate_provisional"]
    assert out["B"]["rate"] == 1.0 and out["B"]["rate_provisional"]
    loaded = {r["sku"]: r["rate"] for r in risk.run_rate(skus, day, ["2026-04"]).collect()}
    assert loaded["A"] == 61.0 / 30
    assert {r["sku"]: r["rate"] for r in risk.run_rate(skus, day, []).collect()}["A"] == 0.5


def test_mailer_bands(spark):
    cases = {1: [("AU-A-35", 6)], 2: [("AU-A-35", 7)], 3: [("AU-A-35", 12)], 4: [("AU-A-35M", 13)], 5: [("AU-A-85", 6)], 6: [("AU-A-85", 7)], 7: [("AU-A-35", 6), ("AU-A-85", 5)],
             8: [("AU-A-35", 5), ("AU-A-85", 5)], 9: [("AU-A-35", 1), ("AU-SRT-Ax12", 1)], 10: [("X", 4)]}
    orders = spark.createDataFrame([(k, "AU", "completed", dt.date(2026, 4, 1)) for k in cases], "id long, market string, status string, local_date date")
    lines = spark.createDataFrame([(k, s, q) for k, ls in cases.items() for s, q in ls], "order_id long, sku string, quantity long")
    r = packaging.mailer_demand(orders, lines, dt.date(2026, 1, 1)).first()
    assert (r["box"], r["large_envelope"], r["envelope"], r["unassigned"], r["orders"]) == (3, 4, 1, 0, 8)




def test_source_that_never_ran_is_stale(spark):
    now = dt.datetime(2026, 1, 1, 12)
    runs = spark.createDataFrame([("a", "CA", "sweep", now - dt.timedelta(hours=3))], "source string, market string, action string, run_at timestamp_ntz")
    expected = spark.createDataFrame([("a", "CA", "sweep"), ("a", "US", "sweep")], "source string, market string, action string")
    out = {r["market"]: r["stale"] for r in incremental.stale_sources(runs, {"sweep": 4}, now, expected).collect()}
    assert out == {"CA": False, "US": True}


def test_number_texts(spark):
    from tallybook.sources.parse import number, whole

    texts = ["3.99999", " 12 ", "-4.5x", "abc", "", None, "7.0", "1,000"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(whole(F.col("t"))).collect()] == [3, 12, -4, 0, 0, 0, 7, 1]
    assert [float(r[0]) for r in rows.select(number(F.col("t"))).collect()] == [4.0, 12.0, -4.5, 0.0, 0.0, 0.0, 7.0, 1.0]
