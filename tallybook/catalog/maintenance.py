"""Table maintenance, incremental reads and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.catalog.base import AS_OF, NOW, query
from tallybook.catalog.store import marketplace_orders
from tallybook.functions import text
from tallybook.operators import erp_lines, incremental, ledger, maintain
from tallybook.session import work_dir
from tallybook.streaming import jobs as streams
from tallybook.streaming import tables
from tallybook.testviews import VIEWS

_REDELIVERED = """SELECT id, market, number, 'refunded' AS status, date_created, local_date, total, currency, 2 AS seq FROM f_store_orders WHERE id % 4 = 0
UNION ALL SELECT id, market, number, 'on-hold', date_created, local_date, CAST(total + 1 AS DECIMAL(18,2)), currency, 3 FROM f_store_orders WHERE id % 8 = 0"""


@query("upsert_latest_by_key", f"""
SELECT id, market, number, status, date_created, CAST(local_date AS VARCHAR) AS local_date, CAST(total AS DOUBLE) AS total, currency, CAST(seq AS BIGINT) AS seq FROM (
 SELECT *, 1 AS seq FROM f_store_orders UNION ALL {_REDELIVERED}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""")
def upsert_latest_by_key(v):
    old = v("f_store_orders").withColumn("seq", F.lit(1))
    again = v("f_store_orders").filter(F.col("id") % 4 == 0).withColumns({"status": F.lit("refunded"), "seq": F.lit(2)})
    later = v("f_store_orders").filter(F.col("id") % 8 == 0).withColumns({
        "status": F.lit("on-hold"), "total": (F.col("total") + 1).cast("decimal(18,2)"), "seq": F.lit(3)})
    return maintain.upsert(old, again.unionByName(later), ["id"], ["seq"])


@query("replace_children", """
SELECT order_id, market, sku, name, quantity, CAST(total AS DOUBLE) AS total, CAST(local_date AS VARCHAR) AS local_date FROM f_store_items WHERE order_id % 5 <> 0
UNION ALL SELECT order_id, market, sku, name, quantity + 1, CAST(total AS DOUBLE), CAST(local_date AS VARCHAR) FROM f_store_items WHERE order_id % 5 = 0 AND quantity < 4""")
def replace_children(v):
    lines = v("f_store_items")
    parents = v("f_store_orders").filter(F.col("id") % 5 == 0).select(F.col("id").alias("order_id"))
    new = lines.filter((F.col("order_id") % 5 == 0) & (F.col("quantity") < 4)).withColumn("quantity", F.col("quantity") + 1)
    return maintain.replace_children(lines, parents, new, "order_id")


_LINE = "market, seller_sku, shipment_item_id, quantity, total, date_created, sales_channel, currency, ship_country, range_label, report_job_id"


@query("supersede_range_upsert", f"""
WITH b AS (SELECT DISTINCT market, range_label, report_job_id FROM f_mkt_items WHERE report_job_id % 2 = 1),
u AS (SELECT 0 AS is_new, {_LINE} FROM f_mkt_items e WHERE report_job_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.market = e.market AND b.range_label = e.range_label AND b.report_job_id <> e.report_job_id)
 UNION ALL SELECT 1, {_LINE} FROM f_mkt_items WHERE report_job_id % 2 = 1)
SELECT market, seller_sku, shipment_item_id, quantity, CAST(total AS DOUBLE) AS total, date_created, sales_channel, currency, ship_country, range_label, report_job_id FROM (
 SELECT * FROM u WHERE shipment_item_id IS NULL
 UNION ALL SELECT * FROM (SELECT * FROM u WHERE shipment_item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market, shipment_item_id
  ORDER BY is_new DESC, report_job_id DESC, seller_sku DESC, quantity DESC, total DESC, date_created DESC, sales_channel DESC, currency DESC, ship_country DESC, range_label DESC) = 1))""")
def supersede_range_upsert(v):
    items = v("f_mkt_items")
    odd = F.col("report_job_id") % 2 == 1
    return maintain.supersede_ranges(items.filter(~odd), items.filter(odd))


_LATEST_JOB = "SELECT market, range_label, max(id) AS latest_job, count(*) AS jobs_seen FROM f_report_jobs WHERE status = 'ingested' GROUP BY 1, 2"


@query("dedupe_superseded", f"""
WITH n AS (SELECT report_job_id, count(*) AS n FROM f_mkt_items GROUP BY 1)
SELECT l.market, l.range_label, l.latest_job, CAST(l.jobs_seen AS BIGINT) AS jobs_seen, CAST(coalesce(sum(n) FILTER (j.id = l.latest_job), 0) AS BIGINT) AS kept,
 CAST(coalesce(sum(n) FILTER (j.id <> l.latest_job), 0) AS BIGINT) AS deleted
FROM ({_LATEST_JOB}) l JOIN f_report_jobs j ON j.market = l.market AND j.range_label = l.range_label AND j.status = 'ingested' LEFT JOIN n ON n.report_job_id = j.id GROUP BY 1, 2, 3, 4""")
def dedupe_superseded(v):
    return maintain.dedupe_superseded(v("f_mkt_items"), v("f_report_jobs"))[1]


@query("batch_semi_join", """
SELECT market, seller_sku, shipment_item_id, quantity, report_job_id FROM f_mkt_items WHERE report_job_id IN (SELECT id FROM f_report_jobs WHERE status = 'ingested')""")
def batch_semi_join(v):
    done = v("f_report_jobs").filter(F.col("status") == "ingested")
    return maintain.in_batches(v("f_mkt_items"), done).select("market", "seller_sku", "shipment_item_id", "quantity", "report_job_id")


@query("cascade_delete", """
SELECT 'job' AS kind, id, CAST(0 AS BIGINT) AS quantity FROM f_report_jobs WHERE status <> 'failed'
UNION ALL SELECT 'line', report_job_id, quantity FROM f_mkt_items WHERE report_job_id NOT IN (SELECT id FROM f_report_jobs WHERE status = 'failed')""")
def cascade_delete(v):
    jobs = v("f_report_jobs")
    doomed = jobs.filter(F.col("status") == "failed").select("id")
    left, lines = maintain.cascade_delete(jobs, v("f_mkt_items"), doomed, "id", "report_job_id")
    kept = left.select(F.lit("job").alias("kind"), "id", F.lit(0).cast("bigint").alias("quantity"))
    return kept.unionByName(lines.select(F.lit("line").alias("kind"), F.col("report_job_id").alias("id"), "quantity"))


@query("backfill_local_date", "SELECT id, date_created, substr(date_created, 1, 10) AS local_date FROM f_store_orders")
def backfill_local_date(v):
    gaps = v("f_store_orders").withColumn("local_date", F.when(F.col("id") % 3 != 0, F.col("local_date")))
    return maintain.backfill_local_date(gaps).select("id", "date_created", "local_date")


_SELLER = "lower(trim(company)) LIKE 'amazon seller%'"


@query("backfill_channel", f"""
WITH b AS (SELECT *, CASE WHEN id % 2 = 0 THEN attr END AS tag FROM s_erp_orders), a AS (SELECT *, CASE WHEN tag IS NULL AND {_SELLER} THEN 'amz' ELSE tag END AS t2 FROM b)
SELECT 'pending before' AS measure, CAST(count(*) AS BIGINT) AS rows FROM b WHERE tag IS NULL AND {_SELLER}
UNION ALL SELECT 'tagged after', CAST(count(*) AS BIGINT) FROM a WHERE t2 = 'amz' UNION ALL SELECT ym, CAST(count(*) AS BIGINT) FROM a WHERE t2 = 'amz' GROUP BY 1""")
def backfill_channel(v):
    before = erp_lines.with_channel(v("f_erp_orders")).withColumn("channel_attr", F.when(F.col("id") % 2 == 0, F.col("channel_attr")))
    return maintain.backfill_report(before, maintain.backfill_channel(before))


_LOG = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'GET /orders?consumer_key=ck_' || CAST(user_id AS STRING) || '&page=' || CAST(event_id AS STRING)
 WHEN 1 THEN 'key ck_0123456789abcdef' || lpad(CAST(event_id AS STRING), 8, '0') || ' rejected' WHEN 2 THEN 'token Atza|IwEB' || CAST(event_id AS STRING) || ' expired'
 WHEN 3 THEN 'secret amzn1.oa2-cs.v1.' || CAST(event_id AS STRING) || ' bad' WHEN 4 THEN 'jwt eyJhbGciOi' || CAST(event_id AS STRING) || '.pay.sig end'
 WHEN 5 THEN 'api_key="' || CAST(event_id AS STRING) || '"' ELSE event_type || ' ok ' || CAST(event_id AS STRING) END AS line FROM events"""
_LOG_CLEAN = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'GET /orders?consumer_key=[REDACTED]&page=' || CAST(event_id AS STRING)
 WHEN 1 THEN 'key ck_[REDACTED] rejected' WHEN 2 THEN 'token Atz_[REDACTED] expired'
 WHEN 3 THEN 'secret amzn1.oa2-cs.v1.[REDACTED] bad' WHEN 4 THEN 'jwt eyJ[REDACTED] end'
 WHEN 5 THEN 'api_key="' || CAST(event_id AS STRING) || '"' ELSE event_type || ' ok ' || CAST(event_id AS STRING) END AS line FROM events"""


@query("scrub_log_text", f"""
SELECT 'log' AS source, event_id AS id, line FROM ({_LOG_CLEAN})
UNION ALL SELECT 'document', doc_id, regexp_replace(text, '(consumer_key|consumer_secret|access_token|refresh_token|api_key|client_secret|oauth_token|code|id_token)=[^&\\s"'']+', '\\1=[REDACTED]', 'gi') FROM documents""")
def scrub_log_text(v):
    lines = v.select(_LOG).select(F.lit("log").alias("source"), F.col("event_id").alias("id"), text.scrub(F.col("line")).alias("line"))
    docs = v("documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), text.scrub(F.col("text")).alias("line"))
    return lines.unionByName(docs)


_RUN = """SELECT source, market, count(*) AS pages, sum(orders_added) AS orders_added, sum(items_added) AS items_added, strftime(max(run_at), '%Y-%m-%dT%H:%M:%S') AS watermark_after,
 CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' ELSE 'ok' END AS status FROM f_run_log"""


@query("append_run_log", f"""
WITH a AS (SELECT *, '' AS watermark_before FROM ({_RUN} WHERE run_at < TIMESTAMP '2024-01-15' GROUP BY 1, 2) UNION ALL SELECT *, '2024-01-15' FROM ({_RUN} WHERE run_at >= TIMESTAMP '2024-01-15' GROUP BY 1, 2))
SELECT source, market, CAST(pages AS BIGINT) AS pages, CAST(orders_added AS BIGINT) AS orders_added, CAST(items_added AS BIGINT) AS items_added, watermark_after, status, watermark_before FROM a""")
def append_run_log(v):
    path = work_dir(v.spark, "run-log")
    half = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    ledger.append_run_log(ledger.run_rows(v("f_run_log").filter(F.col("run_at") < half), ""), path)
    ledger.append_run_log(ledger.run_rows(v("f_run_log").filter(F.col("run_at") >= half), "2024-01-15"), path)
    return v.spark.read.parquet(path)


@query("save_cursor", """
SELECT source, market, strftime(max(run_at) FILTER (run_at < TIMESTAMP '2024-01-15' OR market <> 'AU'), '%Y-%m-%dT%H:%M:%S') AS watermark, '2024-01-30T12:00:00Z' AS last_synced_at FROM f_run_log GROUP BY 1, 2""")
def save_cursor(v):
    path = work_dir(v.spark, "cursor")
    half = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    polled = v("f_run_log").select("source", "market").distinct()
    early = ledger.run_rows(v("f_run_log").filter(F.col("run_at") < half), "")
    tables.write_batch(ledger.next_state(None, early, polled, "2024-01-15T00:00:00Z"), path, 0)
    late = ledger.run_rows(v("f_run_log").filter((F.col("run_at") >= half) & (F.col("market") != "AU")), "")
    state = tables.read_batch(v.spark, path, 0)
    tables.write_batch(ledger.next_state(state, late, polled, "2024-01-30T12:00:00Z"), path, 1)
    return tables.read_batch(v.spark, path, 1)


@query("snapshot_overwrite_guarded", """
SELECT code, CAST(sum(stock_on_hand) AS BIGINT) AS quantity FROM f_stock WHERE stock_on_hand > 5 GROUP BY 1""")
def snapshot_overwrite_guarded(v):
    path = work_dir(v.spark, "snapshot")
    held = v("f_stock").groupBy("code").agg(F.sum("stock_on_hand").alias("quantity"))
    ledger.write_snapshot(held, path, 0)
    more = v("f_stock").filter(F.col("stock_on_hand") > 5).groupBy("code").agg(F.sum("stock_on_hand").alias("quantity"))
    ledger.write_snapshot(more, path, 1)
    ledger.write_snapshot(held.filter(F.col("quantity") < 0), path, 2)
    return ledger.read_snapshot(v.spark, path, "code string, quantity long")


MARK = "1998-01-01T14:00:06Z"


@query("incremental_slice", f"SELECT id, reference, modified_date FROM f_erp_orders WHERE modified_date >= '{MARK}' ORDER BY modified_date, id LIMIT 250")
def incremental_slice(v):
    return incremental.slice_page(v("f_erp_orders"), "modified_date", MARK, 250).select("id", "reference", "modified_date")


@query("next_cursor", f"""
WITH p AS (SELECT modified_date FROM f_erp_orders WHERE modified_date >= '{MARK}' ORDER BY modified_date, id LIMIT 250)
SELECT CASE WHEN count(*) >= 250 AND min(modified_date) = '{MARK}' AND max(modified_date) = '{MARK}' THEN '{MARK}' ELSE coalesce(max(modified_date), '{MARK}') END AS watermark,
 CASE WHEN count(*) >= 250 AND max(modified_date) = '{MARK}' THEN 2 ELSE 1 END::BIGINT AS page, CAST(count(*) AS BIGINT) AS rows FROM p""")
def next_cursor(v):
    page = incremental.slice_page(v("f_erp_orders"), "modified_date", MARK, 250)
    return incremental.next_cursor(page, "modified_date", MARK, 1, 250)


@query("boundary_dedupe", "SELECT id, reference, status, CAST(1 AS BIGINT) AS page FROM f_erp_orders")
def boundary_dedupe(v):
    first = v("f_erp_orders").select("id", "reference", "status", F.lit(1).alias("page"))
    second = first.filter(F.col("id") % 10 == 0).withColumns({"status": F.lit("LATER"), "page": F.lit(2)})
    return maintain.first_by_key(second.unionByName(first), ["id"], ["page"])


_SWEPT = "(local_date + CAST(id % 5 AS INT)) >= DATE '2001-06-30' - 30"


@query("lookback_resweep", f"""
SELECT 'store' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN {_SWEPT} THEN status ELSE 'stale' END AS status FROM f_store_orders WHERE id % 10 <> 0 OR {_SWEPT}
UNION ALL SELECT 'marketplace', id, CASE WHEN substr(purchase_date, 1, 10) >= CAST(DATE '2001-06-30' - 45 AS VARCHAR) THEN status ELSE 'stale' END FROM f_mkt_orders
UNION ALL SELECT 'erp', CAST(id AS VARCHAR), CASE WHEN substr(created_date, 1, 10) >= CAST(DATE '2001-06-30' - 60 AS VARCHAR) THEN status ELSE 'stale' END FROM f_erp_orders""")
def lookback_resweep(v):
    shifted = F.date_add("local_date", (F.col("id") % 5).cast("int")).cast("string")
    store = v("f_store_orders").select(F.col("id").cast("string").alias("id"), "status", shifted.alias("at"), (F.col("id") % 10 == 0).alias("missing"))
    market = v("f_mkt_orders").select("id", "status", F.col("purchase_date").alias("at"), F.lit(False).alias("missing"))
    erp = v("f_erp_orders").select(F.col("id").cast("string").alias("id"), "status", F.col("created_date").alias("at"), F.lit(False).alias("missing"))
    out = []
    for kind, rows, days in (("store", store, 30), ("marketplace", market, 45), ("erp", erp, 60)):
        stored = rows.filter(~F.col("missing")).withColumn("status", F.lit("stale")).drop("missing")
        swept = incremental.lookback(rows.drop("missing"), "at", AS_OF, days)
        out.append(maintain.upsert(stored, swept, ["id"], ["at"]).select(F.lit(kind).alias("kind"), "id", "status"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("recovered_fraction", """
WITH o AS (SELECT *, strftime(local_date, '%Y-%m') AS ym, CAST(substr(id, 5, 7) AS BIGINT) % 10 <> 0 AS had FROM s_mkt_orders WHERE local_date >= DATE '2001-05-01'),
m AS (SELECT market, ym, CAST(count(*) AS BIGINT) AS a, CAST(count(*) FILTER (had) AS BIGINT) AS b, sum(total) AS ra, coalesce(sum(total) FILTER (had), 0) AS rb FROM o GROUP BY 1, 2)
SELECT market, ym, b AS stored_before, a AS stored_after, CAST(rb AS DOUBLE) AS revenue_before, CAST(ra AS DOUBLE) AS revenue_after, a - b AS recovered,
 (a - b) / CAST(a AS DOUBLE) AS recovered_share, max((a - b) / CAST(a AS DOUBLE)) OVER (PARTITION BY market) AS worst_share FROM m""")
def recovered_fraction(v):
    after = marketplace_orders(v)
    before = after.filter(F.substring("id", 5, 7).cast("bigint") % 10 != 0)
    return incremental.recovered(before, after, AS_OF)


@query("import_cursor", """
SELECT 'store' AS source, max(date_created) AS cursor FROM f_store_orders UNION ALL SELECT 'erp', max(modified_date) FROM f_erp_orders""")
def import_cursor(v):
    store = incremental.import_cursor(v("f_store_orders"), "date_created").select(F.lit("store").alias("source"), "cursor")
    return store.unionByName(incremental.import_cursor(v("f_erp_orders"), "modified_date").select(F.lit("erp").alias("source"), "cursor"))


ALLOWED = {"amazon-safetynet": 4, "amazon-reports": 1, "incremental": 4, "backfill": 168}


@query("stale_sources", """
WITH r AS (SELECT source, market, action, max(run_at) AS l FROM f_run_log GROUP BY 1, 2, 3)
SELECT source, market, action, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_run, CAST(trunc(epoch(TIMESTAMP '2024-01-30 12:00:00' - l)) AS BIGINT) AS age_seconds, h AS allowed_hours,
 CAST(trunc(epoch(TIMESTAMP '2024-01-30 12:00:00' - l)) AS BIGINT) >= h * 3600 AS stale
FROM (SELECT *, CASE action WHEN 'amazon-safetynet' THEN 4 WHEN 'amazon-reports' THEN 1 WHEN 'incremental' THEN 4 ELSE 168 END::BIGINT AS h FROM r)""")
def stale_sources(v):
    return incremental.stale_sources(v("f_run_log"), ALLOWED, NOW)


def store_order_columns():
    return [f"{expr} AS {col}" for col, expr in VIEWS["f_store_orders"][1]]


@query("stream_orders_upsert", """
SELECT id, market, number, status, date_created, CAST(local_date AS VARCHAR) AS local_date, CAST(total AS DOUBLE) AS total, currency FROM f_store_orders""")
def stream_orders_upsert(v):
    path = work_dir(v.spark, "stream-orders")
    files = streams.read_files(v.spark, v.stream_path("orders"), v("orders").schema)
    stream = files.selectExpr(*store_order_columns())
    streams.upsert_orders(stream, path)
    schema = "id long, market string, number string, status string, date_created string, local_date date, total decimal(18,2), currency string"
    return tables.read_latest(v.spark, f"{path}/rows", schema, ["id"], ["date_created"])


@query("sellout_transition", """
WITH t AS (SELECT run_id AS id, ts, product_id, stock, lag(stock) OVER (PARTITION BY product_id ORDER BY ts, run_id) AS prev FROM (
 SELECT event_id AS run_id, ts, user_id % 20 AS product_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 6 END AS stock FROM events))
SELECT product_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, id FROM t WHERE prev > 0 AND stock = 0""")
def sellout_transition(v):
    path = work_dir(v.spark, "stream-sellouts")
    files = streams.read_files(v.spark, v.stream_path("events"), v("events").schema)
    ticks = files.selectExpr("event_id AS id", *[f"{expr} AS {col}" for col, expr in VIEWS["f_stock_ticks"][1]])
    streams.detect_sellouts(ticks, path)
    return tables.read_all(v.spark, f"{path}/events", "product_id long, ts timestamp_ntz, id long").drop("batch")


STEPS = (2, 3, 5, 8, 13)


@query("milestone_crossings", """
WITH h AS (SELECT market, local_date, CAST(substr(date_created, 12, 2) AS BIGINT) AS tick, count(*) AS c FROM f_store_orders GROUP BY 1, 2, 3),
n AS (SELECT *, sum(c) OVER w AS n, sum(c) OVER w - c AS prev, row_number() OVER w AS rn FROM h WINDOW w AS (PARTITION BY market, local_date ORDER BY tick)),
x AS (SELECT *, CASE WHEN prev < 13 AND n >= 13 THEN 13 WHEN prev < 8 AND n >= 8 THEN 8 WHEN prev < 5 AND n >= 5 THEN 5 WHEN prev < 3 AND n >= 3 THEN 3 WHEN prev < 2 AND n >= 2 THEN 2 END AS threshold FROM n WHERE rn > 1)
SELECT market, CAST(local_date AS VARCHAR) AS local_date, tick, CAST(prev AS BIGINT) AS prev, CAST(n AS BIGINT) AS n, CAST(threshold AS BIGINT) AS threshold FROM x WHERE threshold IS NOT NULL""")
def milestone_crossings(v):
    return incremental.milestone_ticks(incremental.hourly_ticks(v("f_store_orders")), STEPS)
