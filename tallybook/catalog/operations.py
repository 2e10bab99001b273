"""Fulfilment, shipping, audits and the activity feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.catalog.base import AS_OF, NOW, SQL_VIEWS, query
from tallybook.catalog.store import FLOOR, jobs, marketplace_items
from tallybook.catalog.supply import stock
from tallybook.functions import text
from tallybook.plans import audit, fulfilment, shipping, store

_DC = """CASE WHEN attr = 'col' AND lower(company) LIKE '%redbank%' THEN {} WHEN attr = 'col' AND lower(company) LIKE '%kemps creek%' THEN {} WHEN attr = 'col' THEN {} WHEN attr = 'woo2' THEN {} ELSE {} END"""

SQL_VIEWS.update({
    "s_dist": f"""SELECT *, CASE attr WHEN 'col' THEN 'coles' WHEN 'woo2' THEN 'woolies' ELSE 'otherDistributors' END AS grp,
 {_DC.format("'Coles QLD'", "'Coles NSW'", "'Coles'", "'Woolworths — Moorebank'", "company")} AS label,
 CAST(substr(delivery_date, 1, 10) AS DATE) AS delivery_day, dispatched_date IS NOT NULL AS is_dispatched,
 CASE WHEN attr = 'col' AND lower(company) LIKE '%redbank%' THEN CAST(CAST(substr(delivery_date, 1, 10) AS DATE) - CASE isodow(CAST(substr(delivery_date, 1, 10) AS DATE)) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS DATE)
  ELSE CAST(substr(delivery_date, 1, 10) AS DATE) END AS must_ship_by FROM s_erp_orders WHERE attr IN ('col', 'woo2', 'dist')""",
    "s_wh": "SELECT code, CAST(greatest(soh - fba_soh, 0) AS DOUBLE) AS wh FROM s_stock",
    "s_fulfil": """SELECT order_id, code AS sku, base_sku, q, uom_size, CASE WHEN alt THEN q / uom_size ELSE q END AS need, CASE WHEN alt THEN q ELSE q * mult END AS tins_needed, is_dispatched,
  CASE WHEN alt THEN uom_size ELSE mult END AS per, CASE WHEN mult > 1 AND NOT alt THEN coalesce(cw, 0) WHEN alt THEN floor(coalesce(cw, bw, 0) / uom_size) ELSE coalesce(cw, bw, 0) END AS have,
  CASE WHEN mult > 1 AND NOT alt THEN floor(CASE WHEN base_sku <> code THEN coalesce(bw, 0) ELSE 0 END / mult) ELSE 0 END AS kit,
  CASE WHEN mult > 1 AND NOT alt THEN coalesce(cw, 0) * mult + CASE WHEN base_sku <> code THEN coalesce(bw, 0) ELSE 0 END ELSE coalesce(cw, bw, 0) END AS tins_available
 FROM (SELECT i.order_id, nullif(i.code, '') AS code, i.base_sku, CAST(i.qty AS DOUBLE) AS q, CAST(i.uom_size AS DOUBLE) AS uom_size, CAST(i.mult AS DOUBLE) AS mult, i.uom_size > 1 AS alt, d.is_dispatched, c.wh AS cw, b.wh AS bw
  FROM s_erp_lines i JOIN s_dist d ON d.id = i.order_id LEFT JOIN s_wh c ON c.code = nullif(i.code, '') LEFT JOIN s_wh b ON b.code = i.base_sku WHERE i.parent_id = 0 AND i.qty > 0)""",
    "s_fulfil_state": "SELECT *, CASE WHEN is_dispatched THEN 'dispatched' WHEN have >= need THEN 'ready' WHEN have + kit >= need THEN 'kit' ELSE 'short' END AS state FROM s_fulfil",
    "s_open_dist": "SELECT * FROM s_dist WHERE status = 'APPROVED' AND delivery_day >= DATE '2001-06-29'",
})


def distributor_orders(v):
    return fulfilment.distributor_orders(v("f_erp_orders"))


def fulfilment_lines(v):
    return fulfilment.line_fulfilment(distributor_orders(v), v("f_erp_lines"), stock(v))


@query("open_distributor_orders", """
SELECT id, reference, grp, CAST(delivery_day AS VARCHAR) AS delivery_day, is_dispatched FROM s_open_dist""")
def open_distributor_orders(v):
    return fulfilment.open_orders(distributor_orders(v), AS_OF).select("id", "reference", "grp", "delivery_day", "is_dispatched")


@query("line_fulfilment", """
SELECT order_id, sku, base_sku, q AS qty, CAST(uom_size AS BIGINT) AS uom_size, need AS cartons_needed, CASE WHEN is_dispatched THEN need ELSE have END AS cartons_available,
 CASE WHEN is_dispatched THEN 0 ELSE kit END::DOUBLE AS kittable_cartons, CASE WHEN is_dispatched THEN 0 ELSE greatest(need - have, 0) END::DOUBLE AS cartons_to_kit, tins_needed,
 CASE WHEN is_dispatched THEN tins_needed ELSE tins_available END AS tins_available, CASE WHEN per > 1 THEN 'cartons' ELSE 'units' END AS unit_label,
 state IN ('dispatched', 'ready') AS is_fulfillable, state AS fulfil_state FROM s_fulfil_state""")
def line_fulfilment(v):
    return fulfilment_lines(v).drop("gap_display")


@query("distributor_board", """
SELECT d.id, d.reference, d.grp, d.label, CAST(d.delivery_day AS VARCHAR) AS delivery_date, CAST(d.must_ship_by AS VARCHAR) AS must_ship_by, d.is_dispatched,
 NOT d.is_dispatched AND d.must_ship_by < DATE '2001-06-30' AS is_past_due, CAST(count(f.state) AS BIGINT) AS line_count, coalesce(bool_and(f.state IN ('dispatched', 'ready')), FALSE) AS all_fulfillable
FROM s_open_dist d LEFT JOIN s_fulfil_state f ON f.order_id = d.id GROUP BY ALL""")
def distributor_board(v):
    opened = fulfilment.open_orders(distributor_orders(v), AS_OF)
    lines = fulfilment.line_fulfilment(opened, v("f_erp_lines"), stock(v))
    return fulfilment.by_must_ship(fulfilment.board(opened, lines, AS_OF)).select(
        "id", "reference", "grp", "label", F.col("delivery_day").alias("delivery_date"), "must_ship_by", "is_dispatched", "is_past_due",
        "line_count", "all_fulfillable")


@query("must_ship_sort", """
SELECT id, grp, CAST(must_ship_by AS VARCHAR) AS must_ship_by, is_dispatched FROM s_dist WHERE grp <> 'otherDistributors'""")
def must_ship_sort(v):
    rows = distributor_orders(v).filter(F.col("grp") != "otherDistributors")
    return fulfilment.by_must_ship(rows).select("id", "grp", "must_ship_by", "is_dispatched")


@query("natural_sort_refs", """
SELECT id, reference, array_to_string(list_transform(regexp_extract_all(lower(reference), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
 THEN lpad(CAST(length(ltrim(substr(x, 1, length(x) - 1), '0')) + 1 AS VARCHAR), 4, '0') || ltrim(substr(x, 1, length(x) - 1), '0') || right(x, 1) ELSE x END), '') AS sort_key
FROM s_dist WHERE grp = 'otherDistributors'""")
def natural_sort_refs(v):
    rows = distributor_orders(v).filter(F.col("grp") == "otherDistributors")
    return fulfilment.by_reference(rows).select("id", "reference", text.natural_key(F.col("reference")).alias("sort_key"))


SHIPMENTS = """SELECT l_orderkey AS shipment_id, CAST(l_shipdate AS DATE) AS ship_date, l_returnflag = 'R' AS voided, code AS sku, CAST(l_quantity AS BIGINT) AS quantity
 FROM lineitem JOIN f_code ON l_partkey = part_id"""


@query("shipping_snapshot", f"""
WITH w AS (SELECT DISTINCT order_id FROM f_store_items WHERE sku LIKE 'WC-%' OR sku LIKE '%-SRT-%' OR sku LIKE '%-CTN-%')
SELECT 'open_orders' AS measure, CAST(count(*) AS BIGINT) AS value FROM f_ship_orders WHERE order_status = 'awaiting_shipment'
UNION ALL SELECT 'express_intl_open', count(*) FROM f_ship_orders WHERE order_status = 'awaiting_shipment' AND (upper(trim(coalesce(country, ''))) NOT IN ('', 'AU') OR lower(service) LIKE '%express%' OR lower(service) LIKE '%next_day%')
UNION ALL SELECT 'wholesale_open', count(*) FROM f_ship_orders o JOIN w ON w.order_id = o.order_number WHERE order_status = 'awaiting_shipment'
UNION ALL SELECT 'store_on_hold', count(*) FROM f_ship_orders WHERE order_status = 'on_hold' AND store_id = 1
UNION ALL SELECT 'shipped_orders', count(DISTINCT shipment_id) FROM ({SHIPMENTS}) WHERE NOT voided
UNION ALL SELECT 'shipped_items', CAST(sum(quantity) AS BIGINT) FROM ({SHIPMENTS}) WHERE NOT voided""")
def shipping_snapshot(v):
    return shipping.snapshot(v("f_ship_orders"), v("f_store_items"), v.select(SHIPMENTS), None, store_id=1)


@query("shipping_alerts", """
WITH o AS (SELECT *, upper(trim(coalesce(country, ''))) NOT IN ('', 'AU') AS intl, lower(service) LIKE '%express%' OR lower(service) LIKE '%next_day%' AS exp FROM f_ship_orders WHERE order_status = 'awaiting_shipment')
SELECT 'express_intl' AS list, order_number, country, service, concat_ws(',', CASE WHEN intl THEN 'INTL' END, CASE WHEN exp THEN 'EXPRESS' END) AS flags, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS company FROM o WHERE intl OR exp
UNION ALL SELECT DISTINCT 'wholesale', order_number, country, service, NULL, i.sku, company FROM o JOIN f_store_items i ON i.order_id = o.order_number
 WHERE i.sku LIKE 'WC-%' OR i.sku LIKE '%-SRT-%' OR i.sku LIKE '%-CTN-%'""")
def shipping_alerts(v):
    return shipping.alert_lists(v("f_ship_orders"), v("f_store_items"))


@query("on_hold_by_store", """
SELECT coalesce(CAST(store_id AS VARCHAR), 'unknown') AS store_id, CAST(count(*) AS BIGINT) AS orders FROM f_ship_orders WHERE order_status = 'on_hold' GROUP BY 1""")
def on_hold_by_store(v):
    return shipping.on_hold_by_store(v("f_ship_orders"))


@query("named_customer_flag", """
SELECT CAST(count(*) AS BIGINT) AS wholesale_open, CAST(count(*) FILTER (regexp_matches(lower(company), 'waiva\\s*clark')) AS BIGINT) AS flagged FROM f_ship_orders o
WHERE order_status = 'awaiting_shipment' AND EXISTS (SELECT 1 FROM f_store_items i WHERE i.order_id = o.order_number AND (i.sku LIKE 'WC-%' OR i.sku LIKE '%-SRT-%' OR i.sku LIKE '%-CTN-%'))""")
def named_customer_flag(v):
    return shipping.named_customer(v("f_ship_orders"), v("f_store_items"), r"(?i)waiva\s*clark")


@query("audit_row_counts", """
SELECT 'store orders' AS source, market, CAST(count(*) AS BIGINT) AS rows FROM f_store_orders GROUP BY 2 UNION ALL SELECT 'store items', market, count(*) FROM f_store_items GROUP BY 2
UNION ALL SELECT 'marketplace orders', market, count(*) FROM f_mkt_orders GROUP BY 2 UNION ALL SELECT 'marketplace items', market, count(*) FROM f_mkt_items GROUP BY 2
UNION ALL SELECT 'mapped skus', market, count(DISTINCT dashboard_sku) FROM s_mkt_items WHERE dashboard_sku IS NOT NULL AND local_date >= DATE '2001-01-01' GROUP BY 2""")
def audit_row_counts(v):
    counts = audit.row_counts({
        "store orders": v("f_store_orders"), "store items": v("f_store_items"),
        "marketplace orders": v("f_mkt_orders"), "marketplace items": v("f_mkt_items")})
    skus = audit.mapped_skus(marketplace_items(v), FLOOR).select(F.lit("mapped skus").alias("source"), "market", "rows")
    return counts.unionByName(skus)


@query("audit_superseded_rows", """
WITH l AS (SELECT id, max(id) OVER (PARTITION BY market, range_label) AS latest FROM f_report_jobs WHERE status = 'ingested')
SELECT m.market, CAST(count(i.market) AS BIGINT) AS rows FROM (SELECT DISTINCT market FROM f_report_jobs) m
LEFT JOIN f_mkt_items i ON i.market = m.market AND i.report_job_id IN (SELECT id FROM l WHERE id <> latest) GROUP BY 1""")
def audit_superseded_rows(v):
    return audit.superseded_rows(v("f_mkt_items"), v("f_report_jobs"))


@query("audit_duplicate_lines", """
SELECT market, CAST(count(*) - count(DISTINCT shipment_item_id) AS BIGINT) AS extra FROM f_mkt_items WHERE shipment_item_id IS NOT NULL GROUP BY 1""")
def audit_duplicate_lines(v):
    return audit.duplicate_lines(v("f_mkt_items"))


@query("audit_line_id_coverage", """
SELECT market, CAST(count(*) - count(shipment_item_id) AS BIGINT) AS missing, CAST(count(shipment_item_id) AS BIGINT) AS with_id FROM s_mkt_items
WHERE dashboard_sku IS NOT NULL AND local_date >= DATE '2001-05-01' GROUP BY 1""")
def audit_line_id_coverage(v):
    return audit.line_id_coverage(marketplace_items(v), AS_OF)


@query("source_freshness", """
SELECT source, market, action, strftime(max(run_at), '%Y-%m-%dT%H:%M:%SZ') AS last_sync, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS total FROM f_run_log GROUP BY 1, 2, 3
UNION ALL SELECT source, market, 'any', strftime(max(run_at), '%Y-%m-%dT%H:%M:%SZ'), NULL, NULL FROM f_run_log GROUP BY 1, 2
UNION ALL SELECT 'woo', market, 'rows', NULL, count(*), NULL FROM f_store_orders GROUP BY 2 UNION ALL SELECT 'amazon', market, 'rows', NULL, count(*), NULL FROM f_mkt_orders GROUP BY 2
UNION ALL SELECT 'report_jobs', market, 'ingested', NULL, count(*) FILTER (status = 'ingested'), count(*) FROM f_report_jobs GROUP BY 2""")
def source_freshness(v):
    return audit.freshness(v("f_run_log"), {"woo": v("f_store_orders"), "amazon": v("f_mkt_orders")}, v("f_report_jobs"))


@query("reconcile_store", """
WITH l AS (SELECT market, substr(date_created, 1, 7) AS ym, count(*) AS n, sum(total) AS r, substr(min(date_created), 1, 10) AS a, substr(max(date_created), 1, 10) AS b, count(*) FILTER (id % 50 <> 0) AS m
 FROM f_store_orders WHERE status IN ('completed', 'processing') GROUP BY 1, 2),
j AS (SELECT market, ym, n, r, a, b, CASE WHEN ym <> '2000-05' AND m > 0 THEN m END AS rem FROM l),
x AS (SELECT * FROM j UNION ALL SELECT market, 'all', sum(n), sum(r), min(a), max(b), sum(rem) FROM j GROUP BY 1)
SELECT market, ym, CAST(n AS BIGINT) AS local_count, CAST(r AS DOUBLE) AS revenue, a AS date_min, b AS date_max, CAST(rem AS BIGINT) AS remote_count, n = rem AS count_match, CAST(n - rem AS BIGINT) AS count_delta,
 floor(CAST(r AS DOUBLE) / CAST(n AS DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS average_order FROM x""")
def reconcile_store(v):
    ym = F.substring("date_created", 1, 7)
    seen = store.countable(v("f_store_orders")).filter((F.col("id") % 50 != 0) & (ym != "2000-05"))
    remote = seen.groupBy("market", ym.alias("ym")).agg(F.count("*").alias("remote_count"))
    return audit.reconcile(v("f_store_orders"), remote)


_SUMMARY = """CASE status WHEN 'rate_limited' THEN 'rate-limited by upstream' WHEN 'error' THEN 'error' ELSE
 CASE WHEN action = 'amazon-reports' THEN CASE WHEN o = 0 AND i = 0 THEN 'idle (all ranges fresh)' ELSE concat_ws(', ', CASE WHEN o > 0 THEN '+'||o||' job'||CASE WHEN o = 1 THEN '' ELSE 's' END||' ingested' END,
   CASE WHEN i > 0 THEN '+'||i||' poll'||CASE WHEN i = 1 THEN '' ELSE 's' END||' advanced' END) END
 ELSE CASE WHEN o = 0 AND i = 0 THEN '0 new orders, system healthy' ELSE concat_ws(', ', '+'||o||' order'||CASE WHEN o = 1 THEN '' ELSE 's' END, CASE WHEN i > 0 THEN '+'||i||' item'||CASE WHEN i = 1 THEN '' ELSE 's' END END) END END END"""


@query("activity_feed", f"""
SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS at, source, market, action, status, summary, scope FROM (
 SELECT run_at AS t, CASE WHEN action = 'amazon-reports' THEN action ELSE source END AS source, market, action, status, {_SUMMARY} AS summary, 'tick' AS scope
  FROM (SELECT *, orders_added AS o, items_added AS i FROM f_run_log) WHERE run_at >= TIMESTAMP '2024-01-28 12:00:00'
 UNION ALL SELECT updated_at, 'amazon-reports', market, status, CASE WHEN status IN ('ingested', 'ready') THEN 'ok' WHEN status = 'failed' THEN 'error' ELSE 'pending' END,
  CASE status WHEN 'ingested' THEN range_label || ' ingested · ' || rows_matched || ' rows matched' || CASE WHEN rows_unmatched > 0 OR rows_wrong_market > 0 THEN ' (' || rows_unmatched || ' unmatched, ' || rows_wrong_market || ' wrong-market)' ELSE '' END
   WHEN 'failed' THEN range_label || ' failed: ' || coalesce(error, 'unknown') WHEN 'ready' THEN range_label || ' ready to ingest'
   ELSE range_label || ' pending (' || attempts || ' poll' || CASE WHEN attempts = 1 THEN '' ELSE 's' END || ')' END, 'job' FROM s_jobs WHERE updated_at >= TIMESTAMP '2024-01-28 12:00:00'
 UNION ALL SELECT TIMESTAMP '2024-01-30 07:00:00', 'stock', NULL, 'snapshot', 'ok', count(DISTINCT code) || ' SKUs cached', 'snapshot' FROM f_stock)
ORDER BY t DESC, scope, source, market NULLS FIRST, action, status, summary LIMIT 500""")
def activity_feed(v):
    cached = v("f_stock").agg(F.count_distinct("code").alias("count")).select(
        F.lit(NOW - dt.timedelta(hours=5)).cast("timestamp_ntz").alias("at"), F.lit("stock").alias("source"),
        F.lit(None).cast("string").alias("market"), "count")
    return audit.activity(v("f_run_log"), jobs(v), cached, NOW, hours=48, limit=500)
