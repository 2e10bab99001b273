"""Column rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.catalog.base import (
    AS_OF, MONTHS, SQL_ALIAS, SQL_ALIAS_AU, SQL_CHANNEL, query, sql_base, sql_pack, sql_regional,
)
from tallybook.functions import calendar, channels, codes, text
from tallybook.operators.erp_lines import derive_lines, with_channel
from tallybook.plans.shipping import order_flags, wholesale_lines


@query("sku_base_rollup", f"SELECT part_id, code, {sql_base('code')} AS base_sku, CAST({sql_pack('code')} AS BIGINT) AS multiplier FROM f_code")
def sku_base_rollup(v):
    c = F.col("code")
    return v("f_code").select("part_id", "code", codes.base_code(c).alias("base_sku"), codes.pack_size(c).alias("multiplier"))


@query("sku_is_regional", f"SELECT part_id, code, {sql_regional('code')} AS is_regional FROM f_code")
def sku_is_regional(v):
    return v("f_code").select("part_id", "code", codes.is_regional(F.col("code")).alias("is_regional"))


@query("marketplace_sku_map", f"""
SELECT market, seller_sku, CASE WHEN market = 'AU' THEN {SQL_ALIAS_AU} ELSE {SQL_ALIAS} END AS dashboard_sku,
 CAST(count(*) AS BIGINT) AS lines FROM f_mkt_items GROUP BY 1, 2, 3""")
def marketplace_sku_map(v):
    sku = F.col("seller_sku")
    mapped = F.when(F.col("market") == "AU", codes.regional_marketplace_sku(sku)).otherwise(codes.marketplace_sku(sku))
    return (
        v("f_mkt_items").groupBy("market", "seller_sku", mapped.alias("dashboard_sku"))
        .agg(F.count("*").alias("lines"))
    )


@query("erp_channel", f"SELECT id, company, reference, {SQL_CHANNEL} AS channel_attr FROM f_erp_orders")
def erp_channel(v):
    attr = channels.erp_channel(F.col("channel"), F.col("company"), F.lit(None).cast("string"), F.col("reference"))
    return v("f_erp_orders").select("id", "company", "reference", attr.alias("channel_attr"))


@query("erp_channel_csv", """
SELECT id, company, channel, CASE
 WHEN company = 'Stock Adjustments' OR lower(company) LIKE 'amazon%' THEN NULL
 WHEN lower(company) LIKE '%woolworths%' THEN 'woo2'
 WHEN lower(company) IN ('coles', 'kemps creek') OR lower(company) LIKE '%grocery holdings%' THEN 'col'
 WHEN channel <> 'Backend' OR company IN ('', '[Redacted]') OR lower(company) IN ('mr', 'mrs', 'ms', 'private') THEN NULL
 ELSE 'dist' END AS channel_attr FROM f_erp_orders""")
def erp_channel_csv(v):
    attr = channels.erp_channel_csv(F.col("channel"), F.col("company"), F.lit(None).cast("string"))
    return v("f_erp_orders").select("id", "company", "channel", attr.alias("channel_attr"))


@query("erp_line_fields", """
SELECT 'sales' AS kind, order_id, code, base_sku, CAST(mult AS BIGINT) AS multiplier, is_au AS is_au_sku,
 CAST(tins AS DOUBLE) AS tins, CAST(total AS DOUBLE) AS total, CAST(-abs(total) AS DOUBLE) AS revenue_signed FROM s_erp_lines
UNION ALL
SELECT 'credit', credit_note_id, trim(code), """ + sql_base("code") + ", CAST(" + sql_pack("code") + " AS BIGINT), " + sql_regional("code") + """,
 CAST(CASE WHEN """ + sql_regional("code") + " THEN -abs(CASE WHEN uom_size > 1 THEN qty ELSE qty * " + sql_pack("code") + """ END) ELSE 0 END AS DOUBLE),
 CAST(total AS DOUBLE), CAST(-abs(total) AS DOUBLE) FROM f_credit_lines""")
def erp_line_fields(v):
    picked = ["kind", "order_id", "code", "base_sku", "multiplier", "is_au_sku", "tins", "total", "revenue_signed"]
    sales = derive_lines(v("f_erp_lines"), "sales").withColumn("kind", F.lit("sales"))
    credit = (
        derive_lines(v("f_credit_lines"), "credit").withColumn("kind", F.lit("credit"))
        .withColumnRenamed("credit_note_id", "order_id")
    )
    # A blank code is null in storage; the report shows it as text.
    shown = [F.coalesce("code", F.lit("")).alias("code") if c == "code" else F.col(c) for c in picked]
    return sales.select(*shown).unionByName(credit.select(*shown))


@query("business_local_date", """
SELECT id, purchase_date, CAST(local_date AS VARCHAR) AS local_date FROM s_mkt_orders""")
def business_local_date(v):
    return v("f_mkt_orders").select("id", "purchase_date", calendar.business_date(F.col("purchase_date")).alias("local_date"))


@query("sydney_local_date", """
SELECT id, dispatched_date, CAST(CAST(timezone('Australia/Sydney', timezone('UTC', CAST(left(dispatched_date, 19) AS TIMESTAMP))) AS DATE) AS VARCHAR) AS dispatched_day
FROM f_erp_orders""")
def sydney_local_date(v):
    return v("f_erp_orders").select("id", "dispatched_date", calendar.warehouse_date(F.col("dispatched_date")).alias("dispatched_day"))


@query("week_key", """
SELECT CAST(local_date AS VARCHAR) AS local_date,
 CAST(CASE WHEN month(d) = month(local_date) THEN d ELSE CAST(date_trunc('month', local_date) AS DATE) END AS VARCHAR) AS week_key,
 CAST(count(*) AS BIGINT) AS orders
FROM (SELECT local_date, CAST(local_date - CAST(isodow(local_date) - 1 AS INT) AS DATE) AS d FROM f_store_orders) GROUP BY 1, 2""")
def week_key(v):
    day = F.col("local_date")
    return v("f_store_orders").groupBy(day, calendar.week_key(day).alias("week_key")).agg(F.count("*").alias("orders"))


@query("month_window", """
SELECT m.market, m.ym, CAST(m.idx AS BIGINT) AS idx, m.label, CAST(count(o.id) AS BIGINT) AS orders
FROM (SELECT market, strftime(d, '%Y-%m') AS ym, row_number() OVER (PARTITION BY market ORDER BY d) - 1 AS idx, strftime(d, '%b %Y') AS label
 FROM (SELECT DISTINCT market FROM f_store_orders) t, (SELECT unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS d) g) m
LEFT JOIN f_store_orders o ON o.market = m.market AND strftime(o.local_date, '%Y-%m') = m.ym GROUP BY ALL""")
def month_window(v):
    from tallybook.plans.store import by_market_month

    orders = v("f_store_orders")
    counted = orders.groupBy("market", calendar.month_of(F.col("local_date")).alias("ym")).agg(F.count("*").alias("orders"))
    return (
        by_market_month(orders.select("market").distinct(), AS_OF, MONTHS).join(counted, ["market", "ym"], "left")
        .select("market", "ym", "idx", "label", F.coalesce("orders", F.lit(0)).alias("orders"))
    )


@query("previous_business_day", """
SELECT CAST(local_date AS VARCHAR) AS local_date,
 CAST(local_date - CASE isodow(local_date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS previous_day,
 CAST(count(*) AS BIGINT) AS orders FROM f_store_orders GROUP BY 1, 2""")
def previous_business_day(v):
    day = F.col("local_date")
    return (
        v("f_store_orders").groupBy(day, calendar.previous_business_day(day).alias("previous_day"))
        .agg(F.count("*").alias("orders"))
    )


@query("business_midnight", """
WITH i AS (SELECT local_date AS d, count(*) AS n,
 timezone('UTC', timezone('America/Toronto', CAST(local_date AS TIMESTAMP))) AS u FROM f_store_orders GROUP BY 1)
SELECT CAST(d AS VARCHAR) AS local_date, strftime(u, '%Y-%m-%d %H:%M:%S') AS midnight_utc,
 CAST(d AS VARCHAR) || 'T00:00:00-0' || CAST(date_diff('hour', CAST(d AS TIMESTAMP), u) AS VARCHAR) || ':00' AS midnight_text,
 CAST(n AS BIGINT) AS orders FROM i""")
def business_midnight(v):
    day = F.col("local_date")
    return (
        v("f_store_orders").groupBy(day).agg(F.count("*").alias("orders"))
        .select(day, calendar.business_midnight(day).alias("midnight_utc"),
                calendar.business_midnight_text(day).alias("midnight_text"), "orders")
    )


@query("delivery_date_text", "SELECT id, delivery_date, substr(delivery_date, 1, 10) AS delivery_day FROM f_erp_orders")
def delivery_date_text(v):
    return v("f_erp_orders").select("id", "delivery_date", calendar.leading_date(F.col("delivery_date")).alias("delivery_day"))


_STAMPS = """SELECT run_id, CASE run_id % 5 WHEN 0 THEN strftime(run_at, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(run_at, '%Y-%m-%dT%H:%M:%SZ')
 WHEN 2 THEN strftime(run_at, '%Y-%m-%dT%H:%M:%S+10:00') WHEN 3 THEN strftime(run_at, '%Y-%m-%d') ELSE '' END AS stamp FROM f_run_log"""


@query("utc_text_normalise", f"""
SELECT run_id, stamp, CASE run_id % 5 WHEN 0 THEN replace(stamp, ' ', 'T') || 'Z' WHEN 4 THEN NULL ELSE stamp END AS iso FROM ({_STAMPS})""")
def utc_text_normalise(v):
    at, kind = F.col("run_at"), F.col("run_id") % 5
    stamp = (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+10:00'"))
        .when(kind == 3, F.date_format(at, "yyyy-MM-dd"))
        .otherwise("")
    )
    return v("f_run_log").select("run_id", stamp.alias("stamp")).withColumn("iso", calendar.iso_utc(F.col("stamp")))


@query("discontinued_flag", """
SELECT part_id, code, code LIKE 'AU-SC-%' OR code LIKE 'AU-CTN-SC-%' OR code LIKE 'AU-B-SC-%' OR code LIKE 'D-AU-SC-%' AS discontinued FROM f_code""")
def discontinued_flag(v):
    return v("f_code").select("part_id", "code", codes.is_discontinued(F.col("code")).alias("discontinued"))


SQL_PO_CLASS = """CASE WHEN trim(coalesce(code, '')) = '' THEN 'other' WHEN lower(code) IN ('freight', 'shipping', 'postage', 'kittingfee') THEN 'fees'
 WHEN code LIKE 'T-%' THEN 'raw_tin' WHEN code LIKE 'AU-BD-%' THEN 'soap' WHEN code LIKE 'AU-CTN-%' OR code LIKE 'AU-SRT-%' THEN 'carton_tray'
 WHEN code LIKE 'AU-%' THEN 'finished' WHEN code LIKE 'P-%' THEN 'packaging' ELSE 'other' END"""


@query("po_line_class", f"""
SELECT code, {SQL_PO_CLASS} AS line_class, CAST(count(*) AS BIGINT) AS lines, CAST(sum(qty) AS BIGINT) AS qty FROM f_po_lines GROUP BY 1, 2""")
def po_line_class(v):
    return (
        v("f_po_lines").groupBy("code", codes.po_line_class(F.col("code")).alias("line_class"))
        .agg(F.count("*").alias("lines"), F.sum("qty").alias("qty"))
    )


# 3PL code shapes made from the parts table.
SQL_3PL_SKU = """CASE part_id % 9 WHEN 0 THEN 'T-CA-'||scent||'-'||form||'-35' WHEN 1 THEN 'NP_INSERTS' WHEN 2 THEN 'P-CA-BLANK-CTN-'||CAST(2 + part_id % 3 AS STRING)||'SRT'
 WHEN 3 THEN 'P-BLANK-ENV-A1' WHEN 4 THEN 'P-CA-SRT-'||scent||'-'||form WHEN 5 THEN 'P-CA-SRT-SS' WHEN 6 THEN 'P-ENV-A'||CAST(part_id % 4 AS STRING)
 WHEN 7 THEN 'Label-'||scent ELSE 'CA-'||scent||'-'||form||'-35' END"""
SQL_3PL_CLASS = """CASE WHEN sku LIKE 'T-%' THEN 'tins' WHEN sku = 'NP_INSERTS' THEN 'inserts' WHEN sku LIKE 'P-CA-BLANK-CTN-%SRT' OR sku LIKE 'P-BLANK-ENV-%' THEN 'blankCartons'
 WHEN sku LIKE 'P-CA-SRT-%' THEN 'srt' WHEN sku LIKE 'P-ENV-%' THEN 'envelopes' END"""


@query("packaging_class", f"""
SELECT part_id, sku, {SQL_3PL_CLASS} AS grp FROM (SELECT part_id, {SQL_3PL_SKU} AS sku FROM f_sku)""")
def packaging_class(v):
    skus = v("f_sku").selectExpr("part_id", f"{SQL_3PL_SKU} AS sku")
    return skus.withColumn("grp", codes.packaging_class(F.col("sku")))


@query("tray_linkage", f"""
SELECT part_id, sku, CASE WHEN sku LIKE 'P-CA-SRT-%' THEN substr(sku, 10, 2) ELSE '' END AS scent,
 CASE WHEN sku LIKE 'P-CA-SRT-__-%' THEN substr(sku, 13) ELSE '' END AS form,
 CASE WHEN sku LIKE 'P-CA-SRT-__-%' THEN 'CA-'||substr(sku, 10)||'-35' ELSE '' END AS linked_sku,
 CASE WHEN sku LIKE 'P-CA-BLANK-CTN-%' THEN CAST(substr(sku, 16, 1) AS BIGINT) ELSE 0 END AS capacity
FROM (SELECT part_id, {SQL_3PL_SKU} AS sku FROM f_sku)""")
def tray_linkage(v):
    sku = F.col("sku")
    return v("f_sku").selectExpr("part_id", f"{SQL_3PL_SKU} AS sku").select(
        "part_id", "sku", codes.tray_scent(sku).alias("scent"), codes.tray_form(sku).alias("form"),
        codes.tray_tin(sku).alias("linked_sku"), codes.carton_capacity(sku).alias("capacity"),
    )


_SHIP_INTL = "upper(trim(coalesce(country, ''))) NOT IN ('', 'AU')"
_SHIP_EXP = "(lower(service) LIKE '%express%' OR lower(service) LIKE '%next_day%' OR lower(service) LIKE '%next-day%')"


@query("shipping_flags", f"""
SELECT order_number, country, service, concat_ws(',', CASE WHEN {_SHIP_INTL} THEN 'INTL' END, CASE WHEN {_SHIP_EXP} THEN 'EXPRESS' END) AS flags
FROM f_ship_orders""")
def shipping_flags(v):
    return order_flags(v("f_ship_orders")).select("order_number", "country", "service", F.array_join("flags", ",").alias("flags"))


@query("wholesale_skus", """
SELECT DISTINCT o.order_number, o.company, i.sku FROM f_ship_orders o JOIN f_store_items i ON i.order_id = o.order_number
WHERE i.sku LIKE 'WC-%' OR i.sku LIKE '%-SRT-%' OR i.sku LIKE '%-CTN-%'""")
def wholesale_skus(v):
    return wholesale_lines(v("f_ship_orders"), v("f_store_items")).select("order_number", "company", "sku")


@query("distributor_class", """
SELECT id, company, attr AS retailer,
 CASE attr WHEN 'col' THEN 'coles' WHEN 'woo2' THEN 'woolies' ELSE 'otherDistributors' END AS grp,
 CASE WHEN attr = 'col' AND lower(company) LIKE '%redbank%' THEN 'Coles QLD' WHEN attr = 'col' AND lower(company) LIKE '%kemps creek%' THEN 'Coles NSW'
  WHEN attr = 'col' THEN 'Coles' WHEN attr = 'woo2' THEN 'Woolworths — Moorebank' ELSE company END AS label,
 CASE WHEN attr = 'col' AND lower(company) LIKE '%redbank%' THEN 'QLD' WHEN attr = 'col' AND lower(company) LIKE '%kemps creek%' THEN 'NSW'
  WHEN attr = 'woo2' THEN 'NSW' END AS state,
 attr = 'col' AND lower(company) LIKE '%redbank%' AS ship_day_before
FROM s_erp_orders WHERE attr IN ('col', 'woo2', 'dist')""")
def distributor_class(v):
    orders = with_channel(v("f_erp_orders")).filter(F.col("channel_attr").isin("col", "woo2", "dist"))
    attr = F.col("channel_attr")
    return orders.select("id", "company", attr.alias("retailer"), channels.distributor(attr, F.col("company")).alias("d")).select(
        "id", "company", "retailer", "d.*")


@query("launch_line_match", """
SELECT order_id, sku, name, quantity, sku IN ('AU-OG-NPO-35', 'AU-BD-NPS-100') OR coalesce(lower(name) LIKE '%widget%', FALSE) AS is_launch
FROM (SELECT order_id, coalesce(sku, '') AS sku, name, quantity FROM f_store_items)""")
def launch_line_match(v):
    from tallybook.plans.launch import is_launch_line

    rows = v("f_store_items").select("order_id", F.coalesce("sku", F.lit("")).alias("sku"), "name", "quantity")
    return rows.withColumn("is_launch", is_launch_line(F.col("sku"), F.col("name"), ("AU-OG-NPO-35", "AU-BD-NPS-100"), ("Widget",)))


@query("log_summary_text", """
SELECT run_id, CASE status WHEN 'rate_limited' THEN 'rate-limited by upstream' WHEN 'error' THEN 'error' ELSE
 CASE WHEN action = 'amazon-reports' THEN CASE WHEN o = 0 AND i = 0 THEN 'idle (all ranges fresh)'
   WHEN i = 0 THEN '+'||o||CASE WHEN o = 1 THEN ' job' ELSE ' jobs' END||' ingested'
   WHEN o = 0 THEN '+'||i||CASE WHEN i = 1 THEN ' poll' ELSE ' polls' END||' advanced'
   ELSE '+'||o||CASE WHEN o = 1 THEN ' job' ELSE ' jobs' END||' ingested, +'||i||CASE WHEN i = 1 THEN ' poll' ELSE ' polls' END||' advanced' END
 ELSE CASE WHEN o = 0 AND i = 0 THEN '0 new orders, system healthy'
   WHEN i = 0 THEN '+'||o||CASE WHEN o = 1 THEN ' order' ELSE ' orders' END
   ELSE '+'||o||CASE WHEN o = 1 THEN ' order' ELSE ' orders' END||', +'||i||CASE WHEN i = 1 THEN ' item' ELSE ' items' END END END END AS summary
FROM (SELECT *, orders_added AS o, items_added AS i FROM f_run_log)""")
def log_summary_text(v):
    return v("f_run_log").select("run_id", text.run_summary(
        F.col("action"), F.col("status"), F.lit(None).cast("string"), F.col("orders_added"), F.col("items_added")).alias("summary"))
