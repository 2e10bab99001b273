"""ERP sales, refunds and the five-channel report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.catalog.base import CUTOVER, SQL_ALIAS_AU, SQL_VIEWS, query, sql_base, sql_pack, sql_regional
from tallybook.catalog.store import marketplace_orders
from tallybook.functions import codes
from tallybook.operators import erp_lines
from tallybook.plans import erp, marketplace

_DEAD = "status NOT IN ('VOID', 'VOIDED', 'CANCELLED')"

SQL_VIEWS.update({
    "s_chan_lines": f"""SELECT o.attr, o.ym, i.* FROM s_erp_orders o JOIN s_erp_lines i ON i.order_id = o.id
 WHERE o.{_DEAD} AND i.parent_id = 0 AND (o.attr IN ('col', 'woo2', 'dist') OR (o.attr = 'amz' AND o.ym >= '{CUTOVER}'))""",
    "s_live_credit": f"SELECT * FROM s_credit_lines WHERE {_DEAD} AND status <> 'DRAFT' AND parent_id = 0",
    "s_woo_lines": f"""SELECT i.order_id, strftime(i.local_date, '%Y-%m') AS ym, i.name, i.quantity, i.total, {sql_base('i.sku')} AS base_sku,
 {sql_regional('i.sku')} AS is_au, CASE WHEN {sql_regional('i.sku')} THEN i.quantity * {sql_pack('i.sku')} ELSE 0 END AS tins
 FROM f_store_items i JOIN f_store_orders o ON o.id = i.order_id WHERE o.market = 'AU' AND o.status IN ('completed', 'processing')""",
    "s_au_items": f"SELECT *, {SQL_ALIAS_AU} AS own_sku, strftime(local_date, '%Y-%m') AS ym FROM s_mkt_items WHERE market = 'AU'",
    "s_chan_month": "SELECT ym, attr AS channel, sum(tins) AS tins, sum(total) AS revenue, count(DISTINCT order_id) AS orders FROM s_chan_lines GROUP BY 1, 2",
    "s_sku_pivot": """SELECT ym, base_sku AS sku, max(name) AS name, coalesce(sum(tins) FILTER (attr = 'col'), 0) AS col, coalesce(sum(tins) FILTER (attr = 'woo2'), 0) AS woo2,
 coalesce(sum(tins) FILTER (attr = 'dist'), 0) AS dist, coalesce(sum(tins) FILTER (attr = 'amz'), 0) AS amz,
 coalesce(sum(total) FILTER (attr = 'amz'), 0) AS amz_revenue, coalesce(sum(total) FILTER (attr <> 'amz'), 0) AS erp_revenue
 FROM s_chan_lines WHERE base_sku IS NOT NULL GROUP BY 1, 2""",
    "s_refunds": "SELECT ym, sum(tins) AS tins, sum(revenue) AS revenue, count(DISTINCT credit_note_id) FILTER (tins <> 0 OR revenue <> 0) AS orders FROM s_live_credit GROUP BY 1",
    "s_refund_skus": "SELECT ym, base_sku AS sku, sum(tins) AS tins, sum(revenue) AS sales FROM s_live_credit WHERE is_au AND base_sku IS NOT NULL GROUP BY 1, 2",
    "s_woo_total": "SELECT ym, sum(quantity) AS units, sum(tins) AS tins, sum(total) AS revenue, count(DISTINCT order_id) AS orders FROM s_woo_lines GROUP BY 1",
    "s_woo_skus": "SELECT ym, base_sku AS sku, max(name) AS name, sum(quantity) AS units, sum(tins) AS tins, sum(total) AS revenue FROM s_woo_lines WHERE is_au GROUP BY 1, 2",
    "s_amz_total": """SELECT ym, coalesce(u.units, 0) AS units, coalesce(o.revenue, 0) AS revenue, coalesce(o.orders, 0) AS orders FROM
 (SELECT strftime(local_date, '%Y-%m') AS ym, count(DISTINCT id) AS orders, sum(total) AS revenue FROM s_mkt_orders WHERE market = 'AU' GROUP BY 1) o
 FULL JOIN (SELECT ym, sum(quantity) AS units FROM s_au_items GROUP BY 1) u USING (ym)""",
    "s_amz_skus": "SELECT ym, own_sku AS sku, sum(quantity) AS units, sum(total) AS revenue FROM s_au_items WHERE own_sku IS NOT NULL GROUP BY 1, 2",
    "s_merged": f"""SELECT ym, sku, coalesce(nullif(e.name, ''), nullif(w.name, '')) AS name, coalesce(e.col, 0) AS col, coalesce(e.woo2, 0) AS woo2, coalesce(e.dist, 0) AS dist,
 coalesce(w.tins, 0) AS woo, coalesce(e.amz, 0) + coalesce(a.units, 0) AS amz,
 coalesce(e.erp_revenue, 0) + coalesce(e.amz_revenue, 0) + coalesce(w.revenue, 0) + coalesce(a.revenue, 0) AS revenue
 FROM s_sku_pivot e FULL JOIN s_woo_skus w USING (ym, sku) FULL JOIN (SELECT * FROM s_amz_skus WHERE ym < '{CUTOVER}') a USING (ym, sku)""",
})


def au_items(v):
    """Marketplace lines with the regional alias rule."""
    rows = marketplace.with_local_date(v("f_mkt_items"), "date_created")
    return rows.withColumn("dashboard_sku", codes.regional_marketplace_sku(F.col("seller_sku")))


def chan_lines(v):
    return erp.channel_lines(v("f_erp_orders"), v("f_erp_lines"), CUTOVER)


def chan_counts(v):
    return erp.order_counts(erp.channel_heads(v("f_erp_orders"), CUTOVER), erp.top_level(v("f_erp_lines")))


def facts(v):
    return erp.five_channel_facts(
        v("f_erp_orders"), v("f_erp_lines"), v("f_store_orders"), v("f_store_items"), marketplace_orders(v), au_items(v), CUTOVER)


@query("live_erp_documents", f"""
SELECT 'order' AS kind, id, status, ym FROM s_erp_orders WHERE {_DEAD}
UNION ALL SELECT DISTINCT 'credit', credit_note_id, status, ym FROM s_live_credit""")
def live_erp_documents(v):
    orders = erp.live_orders(v("f_erp_orders")).select(F.lit("order").alias("kind"), "id", "status", "ym")
    notes = erp.live_credit_lines(v("f_credit_lines")).select(
        F.lit("credit").alias("kind"), F.col("credit_note_id").alias("id"), "status", "ym").distinct()
    return orders.unionByName(notes)


@query("erp_join_lines", f"""
SELECT 'sale' AS kind, o.id, o.attr AS channel_attr, i.base_sku, CAST(i.tins AS DOUBLE) AS tins, CAST(i.total AS DOUBLE) AS total
FROM s_erp_orders o JOIN s_erp_lines i ON i.order_id = o.id WHERE o.{_DEAD} AND i.parent_id = 0
UNION ALL SELECT 'credit', credit_note_id, NULL, base_sku, CAST(tins AS DOUBLE), CAST(revenue AS DOUBLE) FROM s_live_credit""")
def erp_join_lines(v):
    heads = erp.live_orders(v("f_erp_orders")).select("id", "channel_attr")
    tops = erp_lines.derive_lines(v("f_erp_lines"), "sales").filter(F.col("parent_id") == 0)
    sales = tops.join(heads, tops["order_id"] == heads["id"]).select(
        F.lit("sale").alias("kind"), "id", "channel_attr", "base_sku", "tins", "total")
    notes = erp.live_credit_lines(v("f_credit_lines")).select(
        F.lit("credit").alias("kind"), F.col("credit_note_id").alias("id"), F.lit(None).cast("string").alias("channel_attr"),
        "base_sku", "tins", F.col("revenue_signed").alias("total"))
    return sales.unionByName(notes)


@query("erp_channel_month", """
SELECT ym, channel, CAST(tins AS DOUBLE) AS tins, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders FROM s_chan_month""")
def erp_channel_month(v):
    return erp.channel_month(erp.line_facts(chan_lines(v)), chan_counts(v))


@query("erp_sku_channel_pivot", """
SELECT ym, sku, name, CAST(col AS DOUBLE) AS col, CAST(woo2 AS DOUBLE) AS woo2, CAST(dist AS DOUBLE) AS dist, CAST(amz AS DOUBLE) AS amz,
 CAST(amz_revenue AS DOUBLE) AS amz_revenue, CAST(erp_revenue AS DOUBLE) AS erp_revenue FROM s_sku_pivot""")
def erp_sku_channel_pivot(v):
    return erp.sku_pivot(erp.line_facts(chan_lines(v)))


@query("refunds_month", """
SELECT ym, CAST(tins AS DOUBLE) AS tins, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders FROM s_refunds""")
def refunds_month(v):
    return erp.refunds_month(v("f_credit_lines"))


@query("refund_sku_lines", "SELECT ym, sku, CAST(tins AS DOUBLE) AS tins, CAST(sales AS DOUBLE) AS sales, CAST(NULL AS VARCHAR) AS name FROM s_refund_skus")
def refund_sku_lines(v):
    return erp.refund_sku_lines(v("f_credit_lines"))


@query("store_au_channel", """
SELECT ym, 'all' AS sku, CAST(NULL AS VARCHAR) AS name, CAST(units AS BIGINT) AS units, CAST(tins AS BIGINT) AS tins, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders FROM s_woo_total
UNION ALL SELECT ym, sku, name, CAST(units AS BIGINT), CAST(tins AS BIGINT), CAST(revenue AS DOUBLE), NULL FROM s_woo_skus""")
def store_au_channel(v):
    orders, items = v("f_store_orders"), v("f_store_items")
    counts = erp.order_counts(erp.store_heads(orders), items)
    total, by_sku = erp.store_channel(erp.store_facts(erp.store_lines(orders, items)), counts)
    head = total.select("ym", F.lit("all").alias("sku"), F.lit(None).cast("string").alias("name"), "units", "tins", "revenue", "orders")
    return head.unionByName(by_sku.withColumn("orders", F.lit(None).cast("bigint")))


@query("marketplace_au_channel", """
SELECT ym, 'all' AS sku, CAST(units AS BIGINT) AS units, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders FROM s_amz_total
UNION ALL SELECT ym, sku, CAST(units AS BIGINT), CAST(revenue AS DOUBLE), NULL FROM s_amz_skus""")
def marketplace_au_channel(v):
    total, by_sku = erp.marketplace_channel(erp.marketplace_facts(au_items(v)), erp.marketplace_heads(marketplace_orders(v)))
    head = total.select("ym", F.lit("all").alias("sku"), "units", "revenue", "orders")
    return head.unionByName(by_sku.select("ym", "sku", "units", "revenue", F.lit(None).cast("bigint").alias("orders")))


_MERGED = """SELECT ym, sku, name, CAST(col AS DOUBLE) AS col, CAST(woo2 AS DOUBLE) AS woo2, CAST(dist AS DOUBLE) AS dist, CAST(woo AS DOUBLE) AS woo,
 CAST(amz AS DOUBLE) AS amz, CAST(col + woo2 + dist + woo + amz AS DOUBLE) AS total_tins, CAST(revenue AS DOUBLE) AS revenue FROM s_merged
 WHERE col + woo2 + dist + woo + amz <> 0 OR revenue <> 0"""


@query("sku_channel_full_merge", _MERGED)
def sku_channel_full_merge(v):
    return erp.sku_rows(facts(v))


_N = "CAST(NULL AS DOUBLE)"


@query("five_channel_month", f"""
SELECT 'channel' AS section, ym, channel AS key, CAST(NULL AS VARCHAR) AS name, {_N} AS col, {_N} AS woo2, {_N} AS dist, {_N} AS woo, {_N} AS amz,
 CAST(tins AS DOUBLE) AS total_tins, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders FROM s_chan_month
UNION ALL SELECT 'channel', ym, 'woo', NULL, {_N}, {_N}, {_N}, {_N}, {_N}, CAST(tins AS DOUBLE), CAST(revenue AS DOUBLE), orders FROM s_woo_total
UNION ALL SELECT 'channel', ym, 'amz', NULL, {_N}, {_N}, {_N}, {_N}, {_N}, CAST(units AS DOUBLE), CAST(revenue AS DOUBLE), orders FROM s_amz_total WHERE ym < '{CUTOVER}'
UNION ALL SELECT 'refund', ym, 'all', NULL, {_N}, {_N}, {_N}, {_N}, {_N}, CAST(tins AS DOUBLE), CAST(revenue AS DOUBLE), orders FROM s_refunds
UNION ALL SELECT 'refund_sku', ym, sku, NULL, {_N}, {_N}, {_N}, {_N}, {_N}, CAST(tins AS DOUBLE), CAST(sales AS DOUBLE), NULL FROM s_refund_skus
UNION ALL SELECT 'sku', ym, sku, name, col, woo2, dist, woo, amz, total_tins, revenue, NULL FROM ({_MERGED})""")
def five_channel_month(v):
    return erp.five_channel(facts(v), v("f_credit_lines"))


def erp_documents(v):
    """One document per line, as a paged feed may deliver an order.

    Grouping an order's lines into one array would put a huge order in one
    task; parity does not need it.
    """
    heads = v("f_erp_orders")
    lines = v("f_erp_lines").drop("line_no")
    item = F.struct(*[c for c in lines.columns if c != "order_id"])
    return lines.select("order_id", F.array(item).alias("lineItems")).join(heads, F.col("order_id") == heads["id"]).drop("order_id")


@query("erp_channel_month_raw", f"""
SELECT ym, channel, CAST(sum(tins) AS DOUBLE) AS tins, CAST(sum(total) AS DOUBLE) AS revenue, CAST(count(DISTINCT ref) AS BIGINT) AS orders FROM (
 SELECT o.ym, o.attr AS channel, i.tins, i.total, o.reference AS ref FROM s_erp_orders o JOIN s_erp_lines i ON i.order_id = o.id
  WHERE o.{_DEAD} AND o.attr IS NOT NULL AND i.parent_id = 0 AND i.code <> ''
 UNION ALL SELECT ym, 'refund', tins, revenue, CASE WHEN tins <> 0 OR revenue <> 0 THEN 'note-' || credit_note_id END FROM s_live_credit) GROUP BY 1, 2""")
def erp_channel_month_raw(v):
    return erp.channel_month_raw(erp_documents(v), v("f_credit_lines"))


@query("channel_source_compare", f"""
SELECT ym, CAST(coalesce(erp_orders, 0) AS BIGINT) AS erp_orders, CAST(coalesce(erp_tins, 0) AS DOUBLE) AS erp_tins, CAST(coalesce(erp_revenue, 0) AS DOUBLE) AS erp_revenue,
 CAST(coalesce(a.orders, 0) AS BIGINT) AS mkt_orders, CAST(coalesce(a.units, 0) AS BIGINT) AS mkt_tins, CAST(coalesce(a.revenue, 0) AS DOUBLE) AS mkt_revenue
FROM (SELECT o.ym, count(DISTINCT o.id) AS erp_orders, sum(i.tins) AS erp_tins, sum(i.total) AS erp_revenue FROM s_erp_orders o JOIN s_erp_lines i ON i.order_id = o.id
 WHERE o.{_DEAD} AND i.parent_id = 0 AND lower(trim(o.company)) LIKE 'amazon seller%' GROUP BY 1) e FULL JOIN s_amz_total a USING (ym)""")
def channel_source_compare(v):
    return erp.channel_source_compare(v("f_erp_orders"), v("f_erp_lines"), marketplace_orders(v), au_items(v))


@query("erp_stage_distribution", """
SELECT 'status' AS field, status AS value, CAST(count(*) AS BIGINT) AS n FROM s_erp_orders GROUP BY 1, 2
UNION ALL SELECT 'channel_attr', coalesce(attr, '(NULL)'), count(*) FROM s_erp_orders GROUP BY 1, 2
UNION ALL SELECT 'approved stage', coalesce(CASE id % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Dispatched' END, '(NULL)'), count(*) FROM s_erp_orders WHERE status = 'APPROVED' GROUP BY 1, 2""")
def erp_stage_distribution(v):
    orders = erp_lines.with_channel(v("f_erp_orders"))
    k = F.col("id") % 4
    staged = orders.withColumn("stage", F.when(k == 0, "New").when(k == 1, "Processing").when(k == 2, "Dispatched"))
    parts = [
        erp.stage_distribution(orders, "status").withColumn("field", F.lit("status")),
        erp.stage_distribution(orders, "channel_attr").withColumn("field", F.lit("channel_attr")),
        erp.stage_distribution(staged, "stage", "APPROVED").withColumn("field", F.lit("approved stage")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PROFILE = "SELECT id, channel, CASE WHEN id % 6 = 0 THEN NULL ELSE 'R' || CAST(id % 6 AS STRING) END AS pos_register, status, company FROM f_erp_orders"
_TOP = "QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 5"


@query("field_value_profile", f"""
SELECT field, value, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS BIGINT) AS rank FROM (
 SELECT 'channel' AS field, channel AS value, count(*) AS n FROM ({_PROFILE}) GROUP BY 1, 2
 UNION ALL SELECT 'pos_register', coalesce(pos_register, ''), count(*) FROM ({_PROFILE}) GROUP BY 1, 2
 UNION ALL SELECT 'status', status, count(*) FROM ({_PROFILE}) GROUP BY 1, 2
 UNION ALL SELECT 'company', company, count(*) FROM ({_PROFILE}) GROUP BY 1, 2
 UNION ALL SELECT 'channel x company', coalesce(nullif(channel, ''), '(none)') || ' | ' || coalesce(nullif(company, ''), '(none)'), count(*) FROM ({_PROFILE}) GROUP BY 1, 2)
{_TOP}
UNION ALL SELECT kind || ' sample', id || ' ' || reference, 1, rank FROM (
 SELECT kind, id, reference, row_number() OVER (PARTITION BY kind ORDER BY id) AS rank FROM (
  SELECT DISTINCT 'bulk' AS kind, o.id, o.reference FROM f_erp_orders o JOIN f_erp_lines i ON i.order_id = o.id WHERE i.code LIKE 'AU-CTN-%'
  UNION ALL SELECT DISTINCT 'refund', o.id, o.reference FROM f_erp_orders o JOIN f_credit_lines c ON c.credit_note_id = o.id WHERE c.qty < 0)) WHERE rank <= 5""")
def field_value_profile(v):
    rows = v.select(_PROFILE)
    none = F.lit("(none)")
    pair = F.concat_ws(" | ", F.coalesce(F.nullif("channel", F.lit("")), none), F.coalesce(F.nullif("company", F.lit("")), none))
    fields = ["channel", "pos_register", "status", "company", "channel x company"]
    profile = erp.value_profile(rows.withColumn("channel x company", pair), fields, top=5)
    sales = v("f_erp_lines").select("order_id", "code", "qty")
    back = v("f_credit_lines").select(F.col("credit_note_id").alias("order_id"), F.lit(None).cast("string").alias("code"), "qty")
    samples = erp.order_samples(v("f_erp_orders"), sales.unionByName(back), 5)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    listed = samples.select(
        F.concat("kind", F.lit(" sample")).alias("field"),
        F.concat_ws(" ", F.col("id").cast("string"), "reference").alias("value"), F.lit(1).cast("bigint").alias("n"), rank.alias("rank"))
    return profile.unionByName(listed)


@query("credit_note_profile", """
SELECT status, CAST(count(DISTINCT credit_note_id) AS BIGINT) AS notes, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (parent_id = 0) AS BIGINT) AS parent_lines,
 CAST(count(*) FILTER (parent_id > 0) AS BIGINT) AS child_lines, CAST(count(*) FILTER (uom_size > 1) AS BIGINT) AS alt_unit_lines FROM f_credit_lines GROUP BY 1""")
def credit_note_profile(v):
    return erp.credit_note_profile(v("f_credit_lines"))


@query("latest_erp_orders", "SELECT id, reference, status, created_date FROM f_erp_orders ORDER BY created_date DESC, id DESC LIMIT 5")
def latest_erp_orders(v):
    return v("f_erp_orders").orderBy(F.col("created_date").desc(), F.col("id").desc()).limit(5).select("id", "reference", "status", "created_date")


@query("top_values", "SELECT company AS value, CAST(count(*) AS BIGINT) AS n FROM f_erp_orders GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(v):
    return v("f_erp_orders").groupBy(F.col("company").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(10)
