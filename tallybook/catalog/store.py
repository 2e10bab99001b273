"""Store and marketplace reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.catalog.base import AS_OF, MONTHS, NOW, SQL_VIEWS, query
from tallybook.functions import calendar
from tallybook.plans import launch, marketplace, store

FLOOR = calendar.month_start(AS_OF, MONTHS - 1)
_OK = "status IN ('completed', 'processing')"

SQL_VIEWS.update({
    "s_store_lines": f"SELECT i.* FROM f_store_items i JOIN f_store_orders o ON o.id = i.order_id WHERE o.{_OK}",
    "s_months": "SELECT strftime(d, '%Y-%m') AS ym, CAST(row_number() OVER (ORDER BY d) - 1 AS BIGINT) AS idx"
                " FROM (SELECT unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS d)",
    "s_markets": "SELECT unnest(['CA', 'US', 'AU']) AS market",
    "s_sku_daily": "SELECT market, sku, local_date AS day, max(name) AS name, CAST(sum(quantity) AS BIGINT) AS qty, sum(total) AS revenue"
                   " FROM s_store_lines WHERE local_date >= DATE '2001-01-01' GROUP BY 1, 2, 3",
    "s_mkt_daily": "SELECT market, dashboard_sku AS sku, local_date AS day, CAST(NULL AS VARCHAR) AS name, CAST(sum(quantity) AS BIGINT) AS qty, sum(total) AS revenue"
                   " FROM s_mkt_items WHERE dashboard_sku IS NOT NULL AND local_date >= DATE '2001-01-01' GROUP BY 1, 2, 3",
    "s_jobs": "SELECT id, market, range_label, status, attempts, TIMESTAMP '2024-01-30 12:00:00' - to_hours(id % 60) AS updated_at,"
              " CASE WHEN id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 12:00:00' - to_seconds(id % 200) END AS last_polled_at,"
              " CASE WHEN id % 5 = 0 THEN NULL ELSE 'R' || id END AS report_id, 10 + id % 90 AS rows_matched, id % 4 AS rows_unmatched, id % 3 AS rows_wrong_market,"
              " CASE id % 3 WHEN 0 THEN 'sales_channel' WHEN 1 THEN 'currency' ELSE 'ship_country' END AS filter_signal, CASE WHEN id % 2 = 0 THEN 'timed out' END AS error FROM f_report_jobs",
})


def jobs(v):
    """The ledger view with the columns only a live ledger carries."""
    at = F.lit(NOW).cast("timestamp_ntz")
    i = F.col("id")
    return v("f_report_jobs").select(
        "id", "market", "range_label", "status", "attempts",
        F.timestamp_add("HOUR", -(i % 60), at).alias("updated_at"),
        F.when(i % 7 != 0, F.timestamp_add("SECOND", -(i % 200), at)).alias("last_polled_at"),
        F.when(i % 5 != 0, F.concat(F.lit("R"), i.cast("string"))).alias("report_id"),
        (i % 90 + 10).alias("rows_matched"), (i % 4).alias("rows_unmatched"), (i % 3).alias("rows_wrong_market"),
        F.when(i % 3 == 0, "sales_channel").when(i % 3 == 1, "currency").otherwise("ship_country").alias("filter_signal"),
        F.when(i % 2 == 0, "timed out").alias("error"),
    )


def marketplace_orders(v):
    return marketplace.with_local_date(v("f_mkt_orders"), "purchase_date")


def marketplace_items(v):
    return marketplace.with_sku(marketplace.with_local_date(v("f_mkt_items"), "date_created"))


@query("countable_orders", f"""
SELECT id, market, status, CAST(local_date AS VARCHAR) AS local_date, CAST(total AS DOUBLE) AS total FROM f_store_orders
WHERE {_OK} AND local_date >= DATE '2001-01-01'""")
def countable_orders(v):
    return store.countable(v("f_store_orders"), FLOOR).select("id", "market", "status", "local_date", "total")


@query("orders_join_items", """
SELECT order_id, market, coalesce(sku, '') AS sku, quantity, CAST(total AS DOUBLE) AS total FROM s_store_lines""")
def orders_join_items(v):
    return store.order_lines(v("f_store_orders"), v("f_store_items")).select(
        "order_id", "market", F.coalesce("sku", F.lit("")).alias("sku"), "quantity", "total")


@query("store_monthly", f"""
SELECT k.market, m.idx, m.ym, CAST(count(o.id) AS BIGINT) AS orders, CAST(coalesce(sum(o.total), 0) AS DOUBLE) AS revenue
FROM s_markets k CROSS JOIN s_months m LEFT JOIN (SELECT *, strftime(local_date, '%Y-%m') AS ym FROM f_store_orders WHERE {_OK}) o
 ON o.market = k.market AND o.ym = m.ym GROUP BY 1, 2, 3""")
def store_monthly(v):
    return store.monthly(store.countable(v("f_store_orders")), AS_OF, MONTHS)


def _daily(v):
    return store.sku_daily(store.order_lines(v("f_store_orders"), v("f_store_items"), FLOOR))


@query("store_sku_daily", "SELECT market, sku, CAST(day AS VARCHAR) AS day, name, qty, CAST(revenue AS DOUBLE) AS revenue FROM s_sku_daily")
def store_sku_daily(v):
    return _daily(v)


def _totals_sql(daily: str) -> str:
    months = ", ".join(
        f"CAST(coalesce(sum(qty) FILTER (ym = '2001-0{i + 1}'), 0) AS BIGINT) AS qty_m{i},"
        f" CAST(coalesce(sum(revenue) FILTER (ym = '2001-0{i + 1}'), 0) AS DOUBLE) AS revenue_m{i}" for i in range(6))
    return f"""SELECT market, CASE WHEN coalesce(sku, '') = '' THEN 'unknown' ELSE sku END AS sku,
 arg_min(name, day) FILTER (coalesce(name, '') <> '') AS name, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(revenue) AS DOUBLE) AS revenue, {months}
FROM (SELECT *, strftime(day, '%Y-%m') AS ym FROM {daily}) GROUP BY 1, 2"""


_WEEK_SQL = """SELECT market, CASE WHEN coalesce(sku, '') = '' THEN 'unknown' ELSE sku END AS sku,
 CAST(greatest(CAST(date_trunc('week', day) AS DATE), CAST(date_trunc('month', day) AS DATE)) AS VARCHAR) AS week, CAST(sum(qty) AS BIGINT) AS qty FROM {} GROUP BY 1, 2, 3"""


@query("store_sku_totals", _totals_sql("s_sku_daily"))
def store_sku_totals(v):
    return store.sku_totals(_daily(v), AS_OF, MONTHS)


@query("store_sku_weekly", _WEEK_SQL.format("s_sku_daily"))
def store_sku_weekly(v):
    return store.sku_weekly(_daily(v))


@query("audit_daily_orders", f"""
SELECT market, CAST(local_date AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS orders FROM f_store_orders
WHERE {_OK} AND local_date >= DATE '2001-01-01' GROUP BY 1, 2""")
def audit_daily_orders(v):
    return store.daily_orders(v("f_store_orders"), FLOOR)


@query("recent_orders", f"""
SELECT id, market, date_created, CAST(total AS DOUBLE) AS amount, currency FROM f_store_orders
WHERE {_OK} AND CAST(date_created AS TIMESTAMP) >= TIMESTAMP '2001-06-29 00:00:00'
ORDER BY CAST(date_created AS TIMESTAMP) DESC, id DESC LIMIT 50""")
def recent_orders(v):
    return store.recent(v("f_store_orders"), dt.datetime.combine(AS_OF, dt.time())).select(
        "id", "market", "date_created", F.col("total").alias("amount"), "currency")


@query("marketplace_monthly", """
SELECT market, strftime(local_date, '%Y-%m') AS ym, CAST(count(*) AS BIGINT) AS orders, CAST(sum(total) AS DOUBLE) AS revenue
FROM s_mkt_orders WHERE local_date >= DATE '2001-01-01' GROUP BY 1, 2""")
def marketplace_monthly(v):
    return marketplace.monthly(marketplace_orders(v), FLOOR)


def _mkt_daily(v):
    lines = marketplace.mapped_lines(marketplace_items(v), FLOOR).withColumn("name", F.lit(None).cast("string"))
    return store.sku_daily(lines, "dashboard_sku")


@query("marketplace_sku_daily", "SELECT market, sku, CAST(day AS VARCHAR) AS day, name, qty, CAST(revenue AS DOUBLE) AS revenue FROM s_mkt_daily")
def marketplace_sku_daily(v):
    return _mkt_daily(v)


@query("marketplace_sku_totals", _totals_sql("s_mkt_daily"))
def marketplace_sku_totals(v):
    return store.sku_totals(_mkt_daily(v), AS_OF, MONTHS)


@query("report_job_status", """
SELECT s.market, s.status, CAST(count(*) AS BIGINT) AS jobs, any_value(t.ingested) AS ingested, any_value(t.total) AS total
FROM f_report_jobs s JOIN (SELECT market, CAST(count(*) FILTER (status = 'ingested') AS BIGINT) AS ingested, CAST(count(*) AS BIGINT) AS total
 FROM f_report_jobs GROUP BY 1) t ON t.market = s.market GROUP BY 1, 2""")
def report_job_status(v):
    return marketplace.job_status(v("f_report_jobs"))


@query("report_match_totals", """
SELECT market, CAST(sum(rows_matched) AS BIGINT) AS matched, CAST(sum(rows_unmatched) AS BIGINT) AS unmatched,
 CAST(sum(rows_wrong_market) AS BIGINT) AS wrong_market, string_agg(DISTINCT filter_signal, ',' ORDER BY filter_signal) AS signals
FROM s_jobs WHERE status = 'ingested' GROUP BY 1""")
def report_match_totals(v):
    return marketplace.match_totals(jobs(v))


@query("latest_job_per_range", """
SELECT market, range_label, id, status, attempts FROM f_report_jobs QUALIFY row_number() OVER (PARTITION BY market, range_label ORDER BY id DESC) = 1""")
def latest_job_per_range(v):
    return marketplace.latest_job(v("f_report_jobs")).select("market", "range_label", "id", "status", "attempts")


@query("due_report_ranges", """
WITH r AS (SELECT k.market, m.ym || '-' || h.half || 'h' AS range_label, m.idx >= 4 AS is_active,
  CASE h.half WHEN 1 THEN CAST(m.ym || '-01' AS DATE) ELSE CAST(m.ym || '-16' AS DATE) END AS a,
  CASE h.half WHEN 1 THEN CAST(m.ym || '-16' AS DATE) ELSE CAST(CAST(m.ym || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE) END AS b
 FROM s_markets k CROSS JOIN s_months m CROSS JOIN (SELECT unnest([1, 2]) AS half) h),
z AS (SELECT *, date_diff('hour', CAST(a AS TIMESTAMP), timezone('UTC', timezone('America/Toronto', CAST(a AS TIMESTAMP)))) AS oa,
 date_diff('hour', CAST(b AS TIMESTAMP), timezone('UTC', timezone('America/Toronto', CAST(b AS TIMESTAMP)))) AS ob FROM r),
l AS (SELECT * FROM s_jobs QUALIFY row_number() OVER (PARTITION BY market, range_label ORDER BY id DESC) = 1)
SELECT z.market, z.range_label, CAST(a AS VARCHAR) || 'T00:00:00-0' || oa || ':00' AS data_start_time,
 CAST(b AS VARCHAR) || 'T00:00:00-0' || ob || ':00' AS data_end_time, is_active
FROM z LEFT JOIN l ON l.market = z.market AND l.range_label = z.range_label
WHERE l.id IS NULL OR (l.status = 'ingested' AND is_active AND date_diff('second', l.updated_at, TIMESTAMP '2024-01-30 12:00:00') >= 86400)""")
def due_report_ranges(v):
    ranges = marketplace.report_ranges(v.spark, ["CA", "US", "AU"], AS_OF, MONTHS)
    return marketplace.due_ranges(ranges, jobs(v), NOW)


@query("due_polls", """
SELECT id, market, range_label, attempts FROM s_jobs WHERE status = 'pending' AND report_id IS NOT NULL
 AND (last_polled_at IS NULL OR date_diff('second', last_polled_at, TIMESTAMP '2024-01-30 12:00:00') > 90) ORDER BY id LIMIT 25""")
def due_polls(v):
    return marketplace.due_polls(jobs(v), NOW, limit=25).select("id", "market", "range_label", "attempts")


@query("reconcile_marketplace", """
SELECT market, coalesce(strftime(local_date, '%Y-%m'), 'all') AS ym, CAST(count(*) AS BIGINT) AS orders, CAST(sum(total) AS DOUBLE) AS revenue
FROM s_mkt_orders GROUP BY GROUPING SETS ((market, strftime(local_date, '%Y-%m')), (market))""")
def reconcile_marketplace(v):
    return marketplace.reconcile(marketplace_orders(v))


@query("orders_per_hour", """
SELECT d.market, CAST(d.local_date AS VARCHAR) AS local_date, h.hour, CAST(count(o.id) AS BIGINT) AS orders
FROM (SELECT DISTINCT market, local_date FROM f_store_orders) d CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS hour) h
LEFT JOIN f_store_orders o ON o.market = d.market AND o.local_date = d.local_date AND CAST(substr(o.date_created, 12, 2) AS BIGINT) = h.hour
GROUP BY 1, 2, 3""")
def orders_per_hour(v):
    return launch.orders_per_hour(v("f_store_orders"))


@query("launch_day_summary", """
WITH l AS (SELECT order_id, sum(quantity) FILTER (sku = 'AU-OG-NPO-35') AS a, sum(quantity) FILTER (sku = 'AU-BD-NPS-100') AS b FROM f_store_items
 WHERE coalesce(sku IN ('AU-OG-NPO-35', 'AU-BD-NPS-100'), FALSE) OR coalesce(lower(name) LIKE '%widget%', FALSE) GROUP BY 1)
SELECT o.market, CAST(o.local_date AS VARCHAR) AS local_date, CAST(count(*) AS BIGINT) AS orders, CAST(count(l.order_id) AS BIGINT) AS launch_orders,
 CAST(coalesce(sum(l.a), 0) AS BIGINT) AS units_0, CAST(coalesce(sum(l.b), 0) AS BIGINT) AS units_1
FROM f_store_orders o LEFT JOIN l ON l.order_id = o.id GROUP BY 1, 2""")
def launch_day_summary(v):
    return launch.launch_summary(v("f_store_orders"), v("f_store_items"), ("AU-OG-NPO-35", "AU-BD-NPS-100"), ("Widget",))


_PRODUCTS = ("SELECT l_partkey AS part_id, code AS sku, CAST(l_quantity AS BIGINT) AS total_sales, l_suppkey % 3 = 0 AS manage_stock,"
             " CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS stock_quantity FROM lineitem JOIN f_code ON l_partkey = part_id")


@query("product_lifetime_sales", f"""
SELECT sku, CAST(sum(total_sales) AS BIGINT) AS total_sales, CAST(sum(CASE WHEN manage_stock THEN stock_quantity END) AS BIGINT) AS stock_quantity
FROM ({_PRODUCTS}) GROUP BY 1""")
def product_lifetime_sales(v):
    return launch.product_lifetime(v.select(_PRODUCTS))
