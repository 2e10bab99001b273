"""Landing jobs, fed with documents and files Spark makes from the tables.

A document carries a whole order with all its lines, and some are delivered again.
Lines and orders are moved in the tables' own few columns; what is made from them is made behind the shuffle.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook.catalog.base import AS_OF, SQL_ALIAS, query, sql_base, sql_pack, sql_regional
from tallybook.catalog.operations import SHIPMENTS
from tallybook.catalog.supply import THREEPL
from tallybook.functions import calendar
from tallybook.plans import erp as erp_reports
from tallybook.catalog.erp import chan_counts, chan_lines
from tallybook.session import work_dir
from tallybook.sources import accounting, erp, marketplace, shipping, stock, store
from tallybook.sources.parse import from_text
from tallybook.testviews import VIEWS


def as_text(df, keep: tuple[str, ...] = ()):
    """Rows as JSON text, the way a landed file holds them."""
    body = F.to_json(F.struct(*[c for c in df.columns if c not in keep]), {"ignoreNullFields": "false"})
    return df.select(*keep, body.alias("value"))


def s(col):
    return F.col(col).cast("string")


def line_rows(v, view, *columns):
    """Columns of a view over lines and codes.  What a line alone gives is worked out before the join, in fewer bytes than it is made of."""
    made = {c: e for c, e in VIEWS[view][1] if c in columns}
    own = {c: e for c, e in made.items() if set(re.findall(r"\bl_\w+", e)) - {"l_partkey"}}
    lines = v("lineitem").select("l_partkey", *[F.expr(e).alias(c) for c, e in own.items()])
    joined = lines.join(v("f_code"), F.col("l_partkey") == F.col("part_id"))
    return joined.select(*[c if c in own else F.expr(made[c]).alias(c) for c in columns])


def by_document(lines, *keys):
    """keys, lines: all lines of a document in one array.  Lines move as rows: an array for each line would take more."""
    rest = [c for c in lines.columns if c not in keys]
    return lines.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("lines"))


def with_lines(v, view, items):
    """Rows of a view over the orders alone, each with its lines and the number of its copies (rows with its key)."""
    copies = F.count("*").over(Window.partitionBy("o_orderkey")).alias("copies")
    o = v("orders").select("*", copies).join(items, F.col("o_orderkey") == F.col("order_id"), "left")
    return o.select(*[F.expr(e).alias(c) for c, e in VIEWS[view][1]], F.coalesce("lines", F.array()).alias("lines"), "copies")


def deliveries(docs, variants):
    """A row for each variant (condition, fields) a document is delivered in, as column `d`."""
    each = [F.when(which, F.struct(*[c.alias(n) for n, c in fields.items()])) for which, fields in variants]
    return docs.withColumn("d", F.explode(F.array_compact(F.array(*each))))


# --- store -------------------------------------------------------------------

def store_texts(v):
    """Deliveries of every order with its lines and gifts: all once, some again changed, late, on a tied clock, or as an exact copy."""
    items = by_document(line_rows(v, "f_store_items", "order_id", "sku", "name", "quantity", "total"), "order_id")
    o, k = with_lines(v, "f_store_orders", items), F.col("id")
    # The view joins its lines with the orders: a line is there once for each copy of its order.
    each = F.when(F.col("copies") == 1, F.col("lines")).otherwise(F.flatten(F.array_repeat("lines", F.col("copies").cast("int"))))
    o = o.withColumn("lines", each)

    def delivery(which, arrival, status, modified, more, gifts):
        return which, {"arrival": F.lit(arrival), "status": status, "modified": modified, "more": F.lit(more), "gifts": F.lit(gifts)}

    none, created = F.lit(None).cast("string"), F.col("date_created")
    known = F.when(k % 11 != 0, F.col("status"))
    docs = deliveries(o, (
        delivery(k >= 0, 0, known, created, 0, 1),
        delivery(k % 4 == 0, 1, F.lit("refunded"), F.concat(F.substring("date_created", 1, 10), F.lit("T23:59:59")), 10, 0),
        delivery(k % 8 == 0, 2, F.lit("zzz"), none, 20, 1),
        delivery(k % 10 == 5, 3, F.lit("on-hold"), created, 30, 0),
        delivery(k % 6 == 0, 0, known, created, 0, 1),
    ))
    gift = F.struct(none.alias("sku"), F.lit("Gift").alias("name"), F.lit("1").alias("quantity"), none.alias("total"))
    line = F.transform("lines", lambda li: F.struct(
        li["sku"].alias("sku"), li["name"].alias("name"), F.concat((li["quantity"] + F.col("d.more")).cast("string"), F.lit(".0")).alias("quantity"),
        li["total"].cast("string").alias("total")))
    docs = docs.select(
        "market", "d.arrival", "id", F.when(k % 7 != 0, F.col("number")).alias("number"), "d.status",
        "date_created", F.col("d.modified").alias("date_modified"), s("total").alias("total"), F.when(k % 5 != 0, F.col("currency")).alias("currency"),
        F.concat(line, F.array_repeat(gift, F.col("d.gifts"))).alias("line_items"))
    return as_text(docs, ("market", "arrival"))


def store_documents(v):
    return from_text(store_texts(v), store.ORDER_SCHEMA)


@query("land_store_orders", """
WITH w AS (SELECT *, CASE WHEN id % 4 = 0 THEN 10 WHEN id % 10 = 5 THEN 30 ELSE 0 END AS more,
 CASE WHEN id % 4 = 0 THEN 'refunded' WHEN id % 10 = 5 THEN 'on-hold' WHEN id % 11 = 0 THEN 'unknown' ELSE status END AS last_status FROM f_store_orders)
SELECT 'order' AS kind, id AS order_id, market, number, last_status AS status, CAST(local_date AS VARCHAR) AS local_date, CAST(total AS DOUBLE) AS total, currency AS detail, CAST(NULL AS BIGINT) AS quantity FROM w
UNION ALL SELECT 'line', w.id, w.market, NULL, NULL, CAST(w.local_date AS VARCHAR), CAST(i.total AS DOUBLE), i.sku, i.quantity + w.more FROM w JOIN f_store_items i ON i.order_id = w.id
UNION ALL SELECT 'line', id, market, NULL, NULL, CAST(local_date AS VARCHAR), 0, NULL, 1 FROM w WHERE more = 0""")
def land_store_orders(v):
    orders, lines = store.land_orders(store_documents(v))
    none = F.lit(None)
    head = orders.select(
        F.lit("order").alias("kind"), F.col("id").alias("order_id"), "market", "number", "status", "local_date", "total",
        F.col("currency").alias("detail"), none.cast("long").alias("quantity"))
    return head.unionByName(lines.select(
        F.lit("line").alias("kind"), "order_id", "market", none.cast("string").alias("number"), none.cast("string").alias("status"), "local_date",
        "total", F.col("sku").alias("detail"), "quantity"))


VIEWS["x_store_csv"] = (
    "f_store_items i JOIN f_store_orders o ON order_id = id",
    (
        ("order_id", "id"),
        ("position_text", "lpad(CAST(i.quantity AS STRING), 4, '0')||coalesce(sku, '')||CAST(i.total AS STRING)"),
        ("number", "'#'||number"),
        ("status", "CASE WHEN quantity = 1 THEN ' Pending ' ELSE upper(status) END"),
        ("created", "CASE id % 3 WHEN 0 THEN substr(date_created, 1, 10)||' '||substr(date_created, 12, 8) WHEN 1 THEN substr(date_created, 1, 10) ELSE CASE WHEN id % 50 = 2 THEN 'n/a' ELSE substr(date_created, 1, 10)||' 08:00:00' END END"),
        ("currency", "CASE WHEN id % 4 = 0 THEN ' ' ELSE currency END"),
        ("total", "CAST(o.total AS STRING)"),
        ("sku", "sku"),
        ("name", "name"),
        ("quantity", "CAST(quantity AS STRING)"),
        ("line_total", "CAST(i.total AS STRING)"),
    ),
)


def store_csv(v):
    names = {
        "order_id": "Order ID", "number": "Order Number", "status": "Status", "created": "Order Created At", "currency": "Currency", "total": "Total",
        "sku": "Line Item Sku", "name": "Line Item Name", "quantity": "Line Item Quantity", "line_total": "Line Item Total"}
    rows = v("x_store_csv")
    return rows.select(F.struct("position_text").alias("position"), *[s(c).alias(n) for c, n in names.items()])


_CSV_ORDER = """SELECT order_id, arg_min(lower(trim(status)), position_text) AS status, any_value(CAST(total AS DECIMAL(18,2))) AS total, any_value(substr(number, 2)) AS number,
 any_value(CASE WHEN trim(currency) = '' THEN 'AUD' ELSE currency END) AS currency,
 any_value(CASE WHEN created = 'n/a' THEN created WHEN length(created) = 10 THEN created || 'T00:00:00' ELSE substr(created, 1, 10) || 'T' || substr(created, 12) END) AS date_created, count(*) AS n FROM x_store_csv WHERE order_id <> 0 GROUP BY 1"""


@query("import_store_csv", f"""
WITH o AS ({_CSV_ORDER})
SELECT 'order' AS kind, order_id, number, status, date_created, substr(date_created, 1, 10) AS local_date, currency AS detail, CAST(total AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS quantity FROM o
UNION ALL SELECT 'line', l.order_id, NULL, NULL, o.date_created, substr(o.date_created, 1, 10), l.sku, CAST(CAST(l.line_total AS DECIMAL(18,2)) AS DOUBLE), CAST(l.quantity AS BIGINT) FROM x_store_csv l JOIN o ON o.order_id = l.order_id""")
def import_store_csv(v):
    orders, lines = store.import_csv(store_csv(v))
    none = F.lit(None)
    head = orders.select(
        F.lit("order").alias("kind"), F.col("id").alias("order_id"), "number", "status", "date_created", "local_date",
        F.col("currency").alias("detail"), "total", none.cast("long").alias("quantity"))
    return head.unionByName(lines.select(
        F.lit("line").alias("kind"), "order_id", none.cast("string").alias("number"), none.cast("string").alias("status"), "date_created",
        "local_date", F.col("sku").alias("detail"), "total", "quantity"))


# --- marketplace --------------------------------------------------------------

@query("land_marketplace_orders", """
SELECT id, market, status, CAST(local_date AS VARCHAR) AS local_date, CASE WHEN k % 19 = 0 THEN 0 ELSE CAST(total AS DOUBLE) END AS total,
 CASE market WHEN 'CA' THEN 'CAD' WHEN 'US' THEN 'USD' ELSE 'AUD' END AS currency FROM (SELECT *, CAST(substr(id, 5, 7) AS BIGINT) AS k FROM s_mkt_orders)
WHERE k % 13 <> 0 AND status NOT IN ('Canceled', 'Pending')""")
def land_marketplace_orders(v):
    k = F.substring("id", 5, 7).cast("long")
    own = F.when(F.col("market") == "CA", "A2EUQ1WTGCTBG2").when(F.col("market") == "US", "ATVPDKIKX0DER").otherwise("A39IBJ37TRP1C6")
    docs = v("f_mkt_orders").select(
        "market", F.col("id").alias("AmazonOrderId"), F.when(k % 13 == 0, "ELSEWHERE").when(k % 3 != 0, own).alias("MarketplaceId"),
        F.col("status").alias("OrderStatus"), F.when(k % 17 != 0, F.col("purchase_date")).alias("PurchaseDate"),
        F.col("purchase_date").alias("LastUpdateDate"),
        F.when(k % 19 != 0, F.struct(s("total").alias("Amount"), F.lit(None).cast("string").alias("CurrencyCode"))).alias("OrderTotal"))
    landed = marketplace.land_orders(from_text(as_text(docs, ("market",)), marketplace.ORDER_SCHEMA))
    return landed.select("id", "market", "status", "local_date", "total", "currency")


def tagged_reports(v):
    """Three report layouts: all signal columns, no channel, country only."""
    items = v("f_mkt_items")
    tags = ["market", "range_label", "report_job_id"]
    text = items.select(
        *tags, F.col("seller_sku").alias("Seller-SKU"), F.lit("Tin").alias("Product Name"), s("quantity").alias("quantity-shipped"),
        s("total").alias("item-price"), F.col("date_created").alias("Purchase Date"), F.col("shipment_item_id").alias("shipment-item-id"),
        F.col("sales_channel").alias("sales-channel"), "currency", F.col("ship_country").alias("ship-country"))
    kind = F.col("report_job_id") % 3
    full = marketplace.tag_report(text.filter(kind == 0))
    money = marketplace.tag_report(text.filter(kind == 1).drop("sales-channel").withColumnRenamed("item-price", "item-price-per-unit"))
    place = marketplace.tag_report(text.filter(kind == 2).drop("sales-channel", "currency", "quantity-shipped"))
    return full.unionByName(money).unionByName(place)


_REPORT = f"""SELECT *, CASE report_job_id % 3 WHEN 0 THEN 'sales_channel' WHEN 1 THEN 'currency' ELSE 'ship_country' END AS filter_signal,
 CASE WHEN market <> 'AU' AND CASE report_job_id % 3
   WHEN 0 THEN sales_channel <> '' AND NOT (CASE market WHEN 'CA' THEN lower(sales_channel) = 'amazon.ca' ELSE lower(sales_channel) IN ('amazon.com', 'amazon.com.us', 'amazon') END)
   WHEN 1 THEN currency <> CASE market WHEN 'CA' THEN 'CAD' ELSE 'USD' END
   ELSE NOT (CASE market WHEN 'CA' THEN ship_country = 'CA' ELSE ship_country IN ('US', 'USA') END) END THEN 'wrong_market'
  WHEN dashboard_sku IS NULL THEN 'unmatched' ELSE 'matched' END AS outcome FROM s_mkt_items"""


@query("land_shipment_report", f"""
SELECT market, range_label, trim(seller_sku) AS seller_sku, dashboard_sku, CASE WHEN report_job_id % 3 = 2 THEN 1 ELSE quantity END::BIGINT AS quantity, CAST(total AS DOUBLE) AS total,
 CAST(local_date AS VARCHAR) AS local_date, shipment_item_id, report_job_id % 3 = 1 AS price_per_unit FROM ({_REPORT}) WHERE outcome = 'matched'""")
def land_shipment_report(v):
    return marketplace.land_report(tagged_reports(v)).select(
        "market", "range_label", "seller_sku", "dashboard_sku", "quantity", "total", "local_date", "shipment_item_id", "price_per_unit")


@query("shipment_report_stats", f"""
SELECT market, range_label, filter_signal, CAST(count(*) AS BIGINT) AS rows_total, CAST(count(*) FILTER (outcome = 'matched') AS BIGINT) AS rows_matched,
 CAST(count(*) FILTER (outcome = 'unmatched') AS BIGINT) AS rows_unmatched, CAST(count(*) FILTER (outcome = 'wrong_market') AS BIGINT) AS rows_wrong_market,
 CAST(count(*) FILTER (outcome = 'matched' AND shipment_item_id IS NULL) AS BIGINT) AS identity_missing FROM ({_REPORT}) GROUP BY 1, 2, 3""")
def shipment_report_stats(v):
    return marketplace.report_stats(tagged_reports(v))


VIEWS["x_mkt_csv"] = (
    "lineitem JOIN orders ON l_orderkey = o_orderkey",
    (
        ("file_no", "l_suppkey % 2"),
        ("sort_text", "CAST(CAST(l_shipdate AS DATE) AS STRING)||'|'||lpad(CAST(l_partkey AS STRING), 12, '0')||lpad(CAST(l_suppkey AS STRING), 12, '0')||lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 4, '0')||CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"),
        ("order_id", "CASE WHEN l_partkey % 101 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) END"),
        ("item_id", "CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING) END"),
        ("day", "CAST(o_orderdate AS DATE)"),
        ("hour", "o_orderkey % 24"),
        ("bad_date", "o_orderkey % 53 = 0"),
        ("sku", "CASE l_partkey % 4 WHEN 0 THEN ' AU-OG-NPO-35 ' WHEN 1 THEN 'AU-CL-VLB-35' WHEN 2 THEN 'X-'||CAST(l_partkey % 10 AS STRING) ELSE '' END"),
        ("quantity", "CAST(l_quantity AS BIGINT)"),
        ("currency", "CASE l_suppkey % 4 WHEN 0 THEN 'AUD' WHEN 1 THEN 'aud' WHEN 2 THEN '' ELSE 'NZD' END"),
        ("country", "CASE l_partkey % 6 WHEN 0 THEN 'NZ' WHEN 1 THEN '' ELSE 'au' END"),
        ("item_price", "CAST(l_extendedprice AS DECIMAL(18,2))"),
        ("shipping", "CASE WHEN l_linenumber % 2 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(5.5 AS DECIMAL(18,2)) END"),
    ),
)


def marketplace_files(v):
    """The export twice: one file per naming convention."""
    rows = v("x_mkt_csv")
    when = F.when(F.col("bad_date"), F.concat(s("day"), F.lit(" late"))).otherwise(
        F.concat(s("day"), F.lit("T"), F.lpad(s("hour"), 2, "0"), F.lit(":18:49+00:00")))
    position = F.struct("file_no", "sort_text").alias("position")
    qty, ship = F.concat(s("quantity"), F.lit(".0")), F.when(F.col("shipping") > 0, s("shipping")).otherwise("")
    titled = rows.filter("file_no = 0").select(
        position, F.col("order_id").alias("Amazon Order Id"), F.col("item_id").alias("Shipment Item ID"), when.alias("Purchase Date"),
        F.col("sku").alias("Merchant SKU"), F.lit("Tin").alias("Title"), qty.alias("Dispatched Quantity"), F.col("currency").alias("Currency"),
        s("item_price").alias("Item Price"), ship.alias("Delivery Price"), F.col("country").alias("Delivery Country Code"))
    hyphened = rows.filter("file_no = 1").select(
        position, F.col("order_id").alias("amazon-order-id"), F.col("item_id").alias("shipment-item-id"), when.alias("purchase-date"), "sku",
        F.lit("Tin").alias("product-name"), qty.alias("quantity-shipped"), "currency", s("item_price").alias("item-price"),
        ship.alias("shipping-price"), F.col("country").alias("ship-country"))
    return [titled, hyphened]


_MKT_CSV = """SELECT *, CASE WHEN order_id = '' THEN 'no_order_id' WHEN country = 'NZ' THEN 'non_au_ship_country' WHEN currency = 'NZD' THEN 'non_aud_currency' ELSE 'candidate' END AS reason,
 CASE WHEN item_id <> '' THEN item_id ELSE order_id || '|' || trim(sku) END AS k, CASE WHEN bad_date THEN day ELSE CAST(CAST(day AS TIMESTAMP) + to_hours(CAST(hour + 10 AS INT)) AS DATE) END AS local_date FROM x_mkt_csv"""
_MKT_KEPT = f"SELECT * FROM ({_MKT_CSV}) WHERE reason = 'candidate' QUALIFY row_number() OVER (PARTITION BY k ORDER BY file_no, sort_text) = 1"


@query("import_marketplace_csv", f"""
WITH k AS ({_MKT_KEPT})
SELECT 'order' AS kind, order_id, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS dashboard_sku, CAST(count(*) AS BIGINT) AS quantity, CAST(sum(item_price + shipping) AS DOUBLE) AS total,
 CAST(any_value(local_date) AS VARCHAR) AS local_date FROM k GROUP BY 2
UNION ALL SELECT 'item', order_id, trim(sku), CASE WHEN trim(sku) LIKE 'AU-%' THEN trim(sku) END, quantity, CAST(item_price AS DOUBLE), CAST(local_date AS VARCHAR) FROM k""")
def import_marketplace_csv(v):
    items = marketplace.csv_items(marketplace.csv_rows(marketplace_files(v)))
    none = F.lit(None).cast("string")
    orders = marketplace.csv_orders(items).select(
        F.lit("order").alias("kind"), "order_id", none.alias("sku"), none.alias("dashboard_sku"), F.col("items").alias("quantity"), "total", "local_date")
    return orders.unionByName(items.select(
        F.lit("item").alias("kind"), "order_id", F.col("seller_sku").alias("sku"), "dashboard_sku", "quantity", F.col("item_price").alias("total"), "local_date"))


@query("import_marketplace_csv_stats", f"""
WITH a AS ({_MKT_CSV}), k AS ({_MKT_KEPT})
SELECT 'rows' AS metric, 'seen' AS key, CAST(count(*) AS BIGINT) AS n FROM a UNION ALL SELECT 'reason', reason, count(*) FROM a WHERE reason <> 'candidate' GROUP BY 2
UNION ALL SELECT 'reason', 'kept', count(*) FROM k UNION ALL SELECT 'reason', 'duplicate_item_id', (SELECT count(*) FROM a WHERE reason = 'candidate') - (SELECT count(*) FROM k)
UNION ALL SELECT 'lines', CASE WHEN trim(sku) LIKE 'AU-%' THEN 'mapped' ELSE 'unmapped' END, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'unmapped sku', trim(sku), count(*) FROM k WHERE trim(sku) LIKE 'X-%' GROUP BY 2
UNION ALL SELECT 'month', strftime(local_date, '%Y-%m'), count(DISTINCT order_id) FROM k GROUP BY 2""")
def import_marketplace_csv_stats(v):
    rows = marketplace.csv_rows(marketplace_files(v))
    return marketplace.csv_stats(rows, marketplace.csv_items(rows))


@query("fba_inventory", f"""
SELECT seller_sku, {SQL_ALIAS} AS dashboard_sku, CASE WHEN report_job_id % 3 = 0 THEN quantity WHEN report_job_id % 3 = 1 THEN 0 ELSE quantity * 2 END::BIGINT AS fulfillable,
 CASE WHEN report_job_id % 3 = 0 THEN 0 ELSE quantity % 5 END::BIGINT AS inbound, CASE WHEN report_job_id % 3 = 2 THEN quantity % 7 ELSE 0 END::BIGINT AS reserved, CAST(0 AS BIGINT) AS unfulfillable FROM f_mkt_items""")
def fba_inventory(v):
    kind, q = F.col("report_job_id") % 3, F.col("quantity")
    held = F.struct((q % 7).alias("totalReservedQuantity"))
    none = F.lit(None)
    bad = none.cast("struct<totalUnfulfillableQuantity: long>")
    details = F.when(kind == 1, F.struct(
        F.lit(0).cast("long").alias("fulfillableQuantity"), (q % 5).alias("inboundWorkingQuantity"),
        none.cast("struct<totalReservedQuantity: long>").alias("reservedQuantity"), bad.alias("unfulfillableQuantity"))).when(kind == 2, F.struct(
            (q * 2).alias("fulfillableQuantity"), (q % 5).alias("inboundWorkingQuantity"), held.alias("reservedQuantity"), bad.alias("unfulfillableQuantity")))
    docs = v("f_mkt_items").select(F.col("seller_sku").alias("sellerSku"), q.alias("totalQuantity"), details.alias("inventoryDetails"))
    return marketplace.fba_inventory(from_text(as_text(docs), marketplace.FBA_SCHEMA))


# --- ERP ---------------------------------------------------------------------------

_BOTH_GONE = "id % 899 = 0"


_ERP_AGAIN = "2030-01-01T00:00:00Z"


def erp_order_documents(v):
    """Deliveries of every order with its lines and fees: all once, some again changed, late, or as an exact copy."""
    items = by_document(line_rows(v, "f_erp_lines", "order_id", "parent_id", "code", "uom_size", "qty", "unit_price", "total", "name"), "order_id")
    o, k = with_lines(v, "f_erp_orders", items), F.col("id")

    def delivery(which, arrival, modified, more, fees):
        return which, {"arrival": F.lit(arrival), "modified": modified, "more": F.lit(more), "fees": F.lit(fees)}

    usual = F.when(k % 31 != 0, F.col("modified_date"))
    docs = deliveries(o, (
        delivery(k >= 0, 0, usual, 0, 1), delivery(k % 4 == 0, 1, F.lit(_ERP_AGAIN), 10, 0),
        delivery(k % 8 == 0, 2, F.lit("1990-01-01T00:00:00Z"), 20, 1), delivery(k % 6 == 0, 0, usual, 0, 1),
    ))

    def line(parent, code, name, qty, uom, price, total):
        return F.struct(
            parent.alias("parentId"), code.alias("code"), name.alias("name"), qty.cast("decimal(18,4)").alias("qty"), uom.cast("decimal(5,1)").alias("uomSize"),
            price.cast("decimal(18,6)").alias("unitPrice"), total.cast("decimal(18,2)").alias("total"))

    fee = line(F.lit(0).cast("long"), F.lit("196"), F.lit("Tin"), F.lit(48), F.lit(48), F.lit(1), F.lit(5))
    real = F.transform("lines", lambda li: line(
        li["parent_id"], li["code"], li["name"], li["qty"] + F.col("d.more"), li["uom_size"], li["unit_price"], li["total"]))
    docs = docs.select(
        "d.arrival", "id", "reference", "company", "channel", F.when(k % 37 != 0, F.col("status")).alias("status"),
        F.when(k % 29 != 0, F.col("created_date")).alias("createdDate"), F.col("d.modified").alias("modifiedDate"),
        F.concat(real, F.array_repeat(fee, F.col("d.fees"))).alias("lineItems"))
    return from_text(as_text(docs, ("arrival",)), erp.ORDER_SCHEMA)


@query("land_erp_orders", f"""
WITH w AS (SELECT *, CASE WHEN id % 4 = 0 THEN 10 ELSE 0 END AS more, CASE WHEN id % 29 = 0 THEN CASE WHEN id % 4 = 0 THEN '{_ERP_AGAIN}' ELSE modified_date END ELSE created_date END AS made,
  CASE WHEN id % 4 = 0 THEN '{_ERP_AGAIN}' WHEN id % 31 = 0 THEN created_date ELSE modified_date END AS changed FROM s_erp_orders WHERE NOT {_BOTH_GONE} OR id % 4 = 0)
SELECT 'order' AS kind, id, reference AS text, nullif(company, '') AS company, attr AS channel_attr, CASE WHEN id % 37 = 0 THEN 'UNKNOWN' ELSE status END AS status, made AS created_date, changed AS modified_date,
 CAST(NULL AS DOUBLE) AS tins, CAST(NULL AS DOUBLE) AS total FROM w
UNION ALL SELECT 'line', w.id, {sql_base('i.code')}, NULL, NULL, NULL, made, NULL, CAST(CASE WHEN i.uom_size > 1 THEN i.qty + more ELSE (i.qty + more) * {sql_pack('i.code')} END AS DOUBLE),
 CAST(CAST(coalesce(i.total, (i.qty + more) * i.unit_price) AS DECIMAL(18,2)) AS DOUBLE) FROM w JOIN f_erp_lines i ON i.order_id = w.id
UNION ALL SELECT 'line', id, '196', NULL, NULL, NULL, made, NULL, 48, 5 FROM w WHERE id % 4 <> 0""")
def land_erp_orders(v):
    heads, lines = erp.land_orders(erp_order_documents(v))
    none = F.lit(None)
    top = heads.select(
        F.lit("order").alias("kind"), "id", F.col("reference").alias("text"), "company", "channel_attr", "status", "created_date", "modified_date",
        none.cast("double").alias("tins"), none.cast("double").alias("total"))
    return top.unionByName(lines.select(
        F.lit("line").alias("kind"), F.col("order_id").alias("id"), F.col("base_sku").alias("text"), none.cast("string").alias("company"),
        none.cast("string").alias("channel_attr"), none.cast("string").alias("status"), "created_date", none.cast("string").alias("modified_date"),
        F.col("tins").cast("double").alias("tins"), F.col("total").cast("double").alias("total")))


@query("land_erp_credit_notes", f"""
SELECT 'note' AS kind, credit_note_id AS id, CAST(NULL AS VARCHAR) AS base_sku, any_value(status) AS status, CAST(NULL AS DOUBLE) AS tins, CAST(NULL AS DOUBLE) AS revenue_signed FROM f_credit_lines GROUP BY 2
UNION ALL SELECT 'line', credit_note_id, base_sku, NULL, CAST(tins AS DOUBLE), CAST(revenue AS DOUBLE) FROM s_credit_lines""")
def land_erp_credit_notes(v):
    notes = by_document(v("f_credit_lines"), "credit_note_id", "status", "created_date")
    line = F.transform("lines", lambda li: F.struct(
        li["parent_id"].alias("parentId"), li["code"].alias("code"), li["qty"].alias("qty"), li["uom_size"].alias("uomSize"), li["total"].alias("total")))
    docs = notes.select(
        F.col("credit_note_id").alias("id"), "status", F.lit(None).cast("string").alias("createdDate"), F.col("created_date").alias("modifiedDate"),
        line.alias("lineItems"))
    docs = docs.unionByName(docs.filter("id % 5 = 0"))
    heads, lines = erp.land_credit_notes(from_text(as_text(docs), erp.CREDIT_SCHEMA))
    none = F.lit(None)
    top = heads.select(F.lit("note").alias("kind"), "id", none.cast("string").alias("base_sku"), "status", none.cast("double").alias("tins"), none.cast("double").alias("revenue_signed"))
    return top.unionByName(lines.select(
        F.lit("line").alias("kind"), F.col("credit_note_id").alias("id"), "base_sku", none.cast("string").alias("status"),
        F.col("tins").cast("double").alias("tins"), F.col("revenue_signed").cast("double").alias("revenue_signed")))


VIEWS["x_erp_csv"] = (
    "lineitem JOIN f_erp_orders ON l_orderkey = id JOIN f_code ON l_partkey = part_id",
    (
        ("order_id", "id"),
        ("bad_id", "l_partkey % 211 = 0"),
        ("reference", "reference"),
        ("company", "company"),
        ("channel", "channel"),
        ("created", "CAST(substr(created_date, 1, 10) AS DATE)"),
        ("invoice", "CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(substr(created_date, 1, 10) AS DATE) + CAST(id % 7 AS INT) END"),
        ("dispatched", "CASE WHEN dispatched_date IS NULL THEN NULL ELSE CAST(substr(created_date, 1, 10) AS DATE) + CAST(id % 40 AS INT) END"),
        ("cancelled", "id % 17 = 0"),
        ("code", "code"),
        ("qty", "CAST(l_quantity AS BIGINT)"),
        ("price", "CAST(900 + l_partkey % 1000 AS DECIMAL(18,2))"),
        ("name", "name"),
        ("line_no", "l_linenumber"),
    ),
)


def erp_csv(v):
    def shown(c, clock=None):
        day = F.date_format(c, "dd MMM yyyy")
        return F.coalesce(F.concat_ws(" ", day, F.lit(clock)) if clock else day, F.lit(""))

    return v("x_erp_csv").select(
        F.struct("line_no", "code").alias("position"), F.when(F.col("bad_id"), "n/a").otherwise(s("order_id")).alias("Order Id"),
        F.col("reference").alias("Order Ref"), F.col("company").alias("Company"), F.lit("").alias("First Name"), F.col("channel").alias("Channel"),
        shown("created", "10:00 AM").alias("Created Date"), shown("invoice").alias("Invoice Date"),
        F.when(F.col("dispatched").isNotNull(), shown("dispatched", "02:30 PM")).otherwise("").alias("Fully Dispatched"),
        F.when(F.col("cancelled"), "01 Jan 2001").otherwise("").alias("Cancellation Date"), F.lit("1234.50").alias("Total Excl"),
        F.col("code").alias("Item Code"), s("qty").alias("Item Qty"), s("price").alias("Item Price"), F.col("name").alias("Item Name"))


_CSV_CHANNEL = """CASE WHEN company = 'Stock Adjustments' OR lower(company) LIKE 'amazon%' THEN NULL WHEN lower(company) LIKE '%woolworths%' THEN 'woo2'
 WHEN lower(company) IN ('coles', 'kemps creek') OR lower(company) LIKE '%grocery holdings%' THEN 'col' WHEN channel <> 'Backend' OR company IN ('', '[Redacted]') OR lower(company) IN ('mr', 'mrs', 'ms', 'private') THEN NULL ELSE 'dist' END"""
_ERP_CSV = f"""SELECT *, {_CSV_CHANNEL} AS attr, CASE WHEN cancelled THEN 'VOID' WHEN dispatched IS NOT NULL OR invoice IS NOT NULL THEN 'APPROVED' ELSE 'OPEN' END AS status,
 CAST(created AS TIMESTAMP) + INTERVAL 10 HOUR AS c, CAST(invoice AS TIMESTAMP) AS i, CAST(dispatched AS TIMESTAMP) + INTERVAL 870 MINUTE AS d FROM x_erp_csv WHERE NOT bad_id AND {_CSV_CHANNEL} IS NOT NULL"""
_NOW_SQL = "TIMESTAMP '2001-06-30 00:00:00'"
_ERP_ORDERS = f"""SELECT DISTINCT order_id, reference, company, attr, status, strftime(c, '%Y-%m-%dT%H:%M:%SZ') AS created_date,
 strftime(coalesce(greatest(CASE WHEN c <= {_NOW_SQL} THEN c END, CASE WHEN i <= {_NOW_SQL} THEN i END, CASE WHEN d <= {_NOW_SQL} THEN d END), c), '%Y-%m-%dT%H:%M:%SZ') AS modified_date FROM ({_ERP_CSV})"""
_ERP_LINES = f"""SELECT order_id, {sql_base('code')} AS base_sku, CAST(qty * price AS DOUBLE) AS total, CAST(CASE WHEN {sql_regional('code')} THEN qty * {sql_pack('code')} ELSE 0 END AS DOUBLE) AS tins FROM ({_ERP_CSV})"""
NOW_TS = dt.datetime.combine(AS_OF, dt.time())


@query("import_erp_csv", f"""
SELECT 'order' AS kind, order_id, reference AS text, attr AS channel_attr, status, created_date, modified_date, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS tins FROM ({_ERP_ORDERS})
UNION ALL SELECT 'line', order_id, base_sku, NULL, NULL, NULL, NULL, total, tins FROM ({_ERP_LINES})""")
def import_erp_csv(v):
    orders, lines = erp.import_csv(erp_csv(v), NOW_TS)
    none = F.lit(None).cast("string")
    head = orders.select(
        F.lit("order").alias("kind"), F.col("id").alias("order_id"), F.col("reference").alias("text"), "channel_attr", "status", "created_date", "modified_date",
        F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("tins"))
    return head.unionByName(lines.select(
        F.lit("line").alias("kind"), "order_id", F.col("base_sku").alias("text"), none.alias("channel_attr"), none.alias("status"),
        none.alias("created_date"), none.alias("modified_date"), F.col("total").cast("double").alias("total"), F.col("tins").cast("double").alias("tins")))


@query("import_summary", f"""
WITH o AS ({_ERP_ORDERS}), l AS (SELECT order_id, count(*) AS n, sum(tins) AS t FROM ({_ERP_LINES}) GROUP BY 1), j AS (SELECT o.*, l.n, l.t FROM o JOIN l ON l.order_id = o.order_id),
so AS ({_CSV_ORDER})
SELECT 'erp channel' AS grp, attr AS key, CAST(count(*) AS BIGINT) AS orders, CAST(sum(n) AS BIGINT) AS items, sum(t) AS amount FROM j GROUP BY 2
UNION ALL SELECT 'erp status', status, count(*), CAST(sum(n) AS BIGINT), sum(t) FROM j GROUP BY 2 UNION ALL SELECT 'erp month', substr(created_date, 1, 7), count(*), CAST(sum(n) AS BIGINT), sum(t) FROM j GROUP BY 2
UNION ALL SELECT 'store status', status, count(*), CAST(sum(n) AS BIGINT), CAST(sum(total) AS DOUBLE) FROM so GROUP BY 2
UNION ALL SELECT 'store month', substr(date_created, 1, 7), count(*), CAST(sum(n) AS BIGINT), CAST(sum(total) AS DOUBLE) FROM so GROUP BY 2""")
def import_summary(v):
    left = erp.import_summary(*erp.import_csv(erp_csv(v), NOW_TS)).withColumn("grp", F.concat(F.lit("erp "), "grp"))
    right = store.import_summary(*store.import_csv(store_csv(v))).withColumn("grp", F.concat(F.lit("store "), "grp"))
    return left.select("grp", "key", "orders", "items", F.col("tins").cast("double").alias("amount")).unionByName(
        right.select("grp", "key", "orders", "items", F.col("revenue").cast("double").alias("amount")))


# --- stock, 3PL, uploads, histories ---------------------------------------------------

@query("land_stock_snapshot", """
SELECT code, branch_name, stock_on_hand, available, incoming, 'Tin — Small / Red' AS product_name FROM f_stock WHERE code <> ''""")
def land_stock_snapshot(v):
    # Some rows know only their style code, some still use the old incoming field.
    old = F.col("stock_on_hand") % 3 == 0
    docs = v("f_stock").select(
        F.when(old, "").otherwise(F.col("code")).alias("code"), F.col("code").alias("styleCode"), F.lit("Tin").alias("productName"),
        F.lit("Small").alias("option1"), F.lit("").alias("option2"), F.lit("Red").alias("option3"), F.col("branch_name").alias("branchName"),
        F.col("stock_on_hand").alias("stockOnHand"), "available", F.when(~old, F.col("incoming")).alias("incoming"), F.col("incoming").alias("openPurchaseOrders"))
    return stock.land_stock(from_text(as_text(docs), stock.STOCK_SCHEMA))


@query("land_product_meta", """
WITH d AS (SELECT part_id, 0 AS slot, code, category, 'Active' AS status FROM f_product_meta UNION ALL SELECT part_id, 1, 'STYLE-' || (part_id % 50), category, 'Discontinued' FROM f_product_meta WHERE part_id % 3 <> 0)
SELECT code, category, status FROM d WHERE code <> '' QUALIFY row_number() OVER (PARTITION BY code ORDER BY part_id DESC, slot DESC) = 1""")
def land_product_meta(v):
    kind = F.col("part_id") % 3
    style = F.concat(F.lit("STYLE-"), (F.col("part_id") % 50).cast("string"))
    none = F.lit(None).cast("string")
    options = F.array(
        F.struct(F.col("code"), none.alias("status")), F.struct(none.alias("code"), F.lit("Discontinued").alias("status")))
    docs = v("f_product_meta").select(
        F.col("part_id").alias("id"), F.when(kind == 0, F.col("code")).otherwise(style).alias("styleCode"), "category", F.lit("Active").alias("status"),
        F.when((kind != 0) & (F.col("code") != ""), options).when(kind != 0, F.slice(options, 2, 1)).alias("productOptions"))
    return stock.land_product_meta(from_text(as_text(docs), stock.PRODUCT_SCHEMA))


def threepl_pages(v):
    """One item per page, in the three shapes the service answers with."""
    rows = v.select(THREEPL)
    named = F.col("category")
    item = F.struct(
        "sku", "name", s("quantity").alias("quantity"), s("quantity_reserved").alias("quantity_reserved"), s("quantity_incoming").alias("quantity_incoming"),
        s("low_threshold").alias("low_threshold"), s("cost").alias("cost"), named.alias("category"))
    nested = F.struct(*[c for c in ("sku", "name", "quantity", "quantity_reserved", "quantity_incoming", "low_threshold", "cost")], F.struct(named.alias("name")).alias("category"))
    shape = F.col("part_id") % 3
    page = (
        F.when(shape == 0, F.to_json(F.struct(F.array(F.array(F.struct(nested.alias("Item")))).alias("items"))))
        .when(shape == 1, F.to_json(F.struct(F.array(item).alias("items")))).otherwise(F.to_json(F.array(F.struct(item.alias("Item"))))))
    return rows.select(page.alias("value"))


@query("land_3pl_items", f"""
SELECT sku, name, CAST(quantity AS DOUBLE) AS quantity, CAST(quantity_reserved AS DOUBLE) AS quantity_reserved, CAST(cost AS DOUBLE) AS cost, category FROM ({THREEPL})""")
def land_3pl_items(v):
    return stock.land_3pl_items(threepl_pages(v)).select("sku", "name", "quantity", "quantity_reserved", "cost", "category")


@query("threepl_inventory", f"""
SELECT sku, name, CAST(quantity - quantity_reserved AS DOUBLE) AS quantity, category FROM ({THREEPL})
WHERE lower(category) NOT LIKE '%packaging%' AND lower(category) NOT LIKE '%manufacturing%' AND sku NOT LIKE 'Label-%' AND sku NOT LIKE 'MF-%'""")
def threepl_inventory(v):
    return stock.threepl_inventory(stock.land_3pl_items(threepl_pages(v)))


@query("validate_wms_upload", """
SELECT 'codes' AS upload, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (trim(code) = '') AS BIGINT) AS blank, 'blank sku' AS verdict FROM f_code
UNION ALL SELECT 'stock', count(*), 0, 'ok' FROM s_stock
UNION ALL SELECT 'lines', count(*), count(*) FILTER (code = ''), 'blank sku' FROM f_stock
UNION ALL SELECT 'none', 0, 0, 'inventory is empty'""")
def validate_wms_upload(v):
    uploads = {
        "codes": v("f_code").select(F.col("code").alias("sku")), "stock": v("f_stock").filter("code <> ''").select(F.col("code").alias("sku")).distinct(),
        "lines": v("f_stock").select(F.col("code").alias("sku")), "none": v("f_code").filter("code = 'absent'").select(F.col("code").alias("sku"))}
    checks = [stock.validate_upload(rows).select(F.lit(name).alias("upload"), "rows", "blank", "verdict") for name, rows in uploads.items()]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3])


_HISTORY = "SELECT sku, strftime(local_date, '%Y-%m') AS ym, sum(quantity) AS q FROM f_store_items WHERE sku IS NOT NULL GROUP BY 1, 2"


@query("buying_history_long", f"""
SELECT sku, ym, CAST(q AS BIGINT) AS quantity, CAST(sum(q) OVER (PARTITION BY sku) % 100 AS BIGINT) AS allocated FROM ({_HISTORY})""")
def buying_history_long(v):
    month = calendar.month_of(F.col("local_date"))
    by_month = v("f_store_items").filter(F.col("sku").isNotNull()).groupBy("sku", month.alias("ym")).agg(F.sum("quantity").cast("int").alias("q"))
    docs = by_month.groupBy("sku").agg(
        F.map_from_entries(F.collect_list(F.struct("ym", "q"))).alias("monthlySales"), (F.sum("q") % 100).cast("int").alias("allocated"))
    return stock.buying_history_long(from_text(as_text(docs), stock.HISTORY_SCHEMA))


@query("static_month_snapshot", """
SELECT 'channel' AS section, ym, channel AS key, CAST(tins AS DOUBLE) AS tins, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders FROM s_chan_month
UNION ALL SELECT 'sku', ym, sku, CAST(col + woo2 + dist + amz AS DOUBLE), CAST(erp_revenue AS DOUBLE), NULL FROM s_sku_pivot""")
def static_month_snapshot(v):
    sums = erp_reports.line_facts(chan_lines(v))
    totals = erp_reports.channel_month(sums, chan_counts(v))
    record = F.struct(F.col("tins").cast("double").alias("tins"), F.col("revenue").cast("double").alias("revenue"), "orders")
    # A month has at most five channels; SKU rows go one to a document.
    months = totals.groupBy("ym").agg(F.map_from_entries(F.collect_list(F.struct("channel", record))).alias("channels")).select(
        F.to_json(F.struct(F.create_map("ym", "channels").alias("salesByMonth"))).alias("body"))
    total = (F.col("col") + F.col("woo2") + F.col("dist") + F.col("amz")).cast("double").alias("total_tins")
    row = F.array(F.struct("sku", "name", total, F.col("erp_revenue").cast("double").alias("revenue")))
    skus = erp_reports.sku_pivot(sums).select(F.to_json(F.struct(F.create_map("ym", row).alias("skuSalesByMonth"))).alias("body"))
    wrapped = F.concat(F.lit("// generated\nwindow.MONTH_DATA = "), "body", F.lit(";\n")).alias("value")
    return stock.month_snapshot(months.unionByName(skus).select(wrapped))


@query("buying_history_document", f"""
SELECT sku, ym, CAST(q AS BIGINT) AS quantity, CAST(sum(q) OVER (PARTITION BY sku) % 100 AS BIGINT) AS allocated FROM ({_HISTORY})
UNION ALL SELECT 'no months', NULL, NULL, 7 WHERE EXISTS (SELECT 1 FROM f_store_items)""")
def buying_history_document(v):
    """All SKUs in one object, as the file is delivered; it is bounded by the number of product codes."""
    path = work_dir(v.spark, "history")
    month = calendar.month_of(F.col("local_date"))
    by_month = v("f_store_items").filter(F.col("sku").isNotNull()).groupBy("sku", month.alias("ym")).agg(F.sum("quantity").cast("int").alias("q"))
    entries = by_month.groupBy("sku").agg(F.struct(
        F.map_from_entries(F.collect_list(F.struct("ym", "q"))).alias("monthlySales"), (F.sum("q") % 100).cast("int").alias("allocated")).alias("d"))
    none = v.spark.sql("SELECT 'no months' AS sku, named_struct('monthlySales', CAST(NULL AS map<string, int>), 'allocated', 7) AS d")
    whole = entries.unionByName(none).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("sku", "d")))).alias("body"))
    whole.select(F.concat(F.lit("// generated\n// by hand\nexport default \n"), "body", F.lit(";\n")).alias("value")).coalesce(1).write.text(path)
    return stock.buying_history_document(v.spark.read.text(path, wholetext=True))


@query("static_month_channels", """
SELECT ym, channel, CAST(NULL AS VARCHAR) AS sku, CAST(tins AS DOUBLE) + 1 AS units, CAST(tins AS DOUBLE) AS tins FROM s_chan_month
UNION ALL SELECT ym, unnest(['col', 'woo2', 'dist', 'amz']), sku, NULL, unnest([CAST(col AS DOUBLE), CAST(woo2 AS DOUBLE), CAST(dist AS DOUBLE), CAST(amz AS DOUBLE)]) FROM s_sku_pivot""")
def static_month_channels(v):
    sums = erp_reports.line_facts(chan_lines(v))
    tins = F.col("tins").cast("double")
    record = F.struct((tins + 1).alias("units"), tins.alias("tins"))
    months = erp_reports.channel_month(sums, chan_counts(v)).groupBy("ym").agg(F.map_from_entries(F.collect_list(F.struct("channel", record))).alias("channels")).select(
        F.to_json(F.struct(F.create_map("ym", "channels").alias("salesByMonth"))).alias("body"))
    row = F.array(F.struct("sku", *[F.col(c).cast("double").alias(c) for c in ("col", "woo2", "dist", "amz")]))
    skus = erp_reports.sku_pivot(sums).select(F.to_json(F.struct(F.create_map("ym", row).alias("skuSalesByMonth"))).alias("body"))
    wrapped = F.concat(F.lit("// generated\nwindow.MONTH_DATA = "), "body", F.lit(";\n")).alias("value")
    return stock.month_snapshot_channels(months.unionByName(skus).select(wrapped))


# --- accounting -----------------------------------------------------------------------------



def accounting_text(day, kind):
    """A date in one of the shapes the accounting service uses."""
    ms = F.datediff(day, F.lit(dt.date(1970, 1, 1))).cast("long") * 86400000 + 3600000
    return (
        F.when(kind == 0, F.concat(F.lit("/Date("), ms.cast("string"), F.lit("+1100)/"))).when(kind == 1, F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/")))
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd'T'00:00:00")).when(kind == 3, "soon")
    )


@query("accounting_dates", """
SELECT id, CASE WHEN id % 5 < 3 THEN CAST(local_date AS VARCHAR) END AS day FROM f_store_orders""")
def accounting_dates(v):
    raw = v("f_store_orders").select("id", accounting_text(F.col("local_date"), F.col("id") % 5).alias("raw"))
    return raw.select("id", calendar.accounting_date(F.col("raw")).alias("day"))


@query("supplier_pos_accounting", """
SELECT reference AS po, lower(status) AS status, CAST(delivery_date AS VARCHAR) AS expected_date, company AS supplier, code AS sku, CAST(qty AS DOUBLE) AS qty FROM f_po_lines
WHERE status <> 'VOID' AND delivery_date >= DATE '2001-06-01' AND code NOT LIKE 'T-%'""")
def supplier_pos_accounting(v):
    lines = v("f_po_lines")
    kind = F.when(F.col("qty") % 2 == 0, 0).otherwise(2)
    docs = lines.select(
        F.col("reference").alias("PurchaseOrderNumber"), F.when(F.col("status") == "VOID", "Billed").otherwise(F.col("status")).alias("Status"),
        accounting_text(F.col("delivery_date"), kind).alias("DeliveryDate"), F.struct(F.col("company").alias("Name")).alias("Contact"),
        F.array(F.struct(F.col("code").alias("ItemCode"), F.col("qty").alias("Quantity")), F.struct(F.lit("T-AU-X-35").alias("ItemCode"), F.lit(1).cast("long").alias("Quantity"))).alias("LineItems"))
    pos = accounting.supplier_pos(from_text(as_text(docs), accounting.PO_SCHEMA), AS_OF)
    return accounting.po_lines(pos).select("po", "status", "expected_date", "supplier", "sku", "qty")


@query("invoices_accounting", """
SELECT o.id, CAST(o.local_date AS VARCHAR) AS date, o.status, CASE o.id % 6 WHEN 1 THEN 'Unknown' ELSE 'Stockist ' || o.market END AS contact, i.sku, CAST(i.quantity AS DOUBLE) AS qty, CAST(i.total AS DOUBLE) AS line_total
FROM f_store_orders o JOIN f_store_items i ON i.order_id = o.id WHERE o.local_date >= DATE '2000-12-30' AND o.id % 6 NOT IN (2, 3) AND o.id % 7 <> 0 AND i.sku IS NOT NULL""")
def invoices_accounting(v):
    o, i = v("f_store_orders"), v("f_store_items")
    items = i.select("order_id", "sku", "quantity", F.col("total").alias("line_total"))
    k = F.col("id") % 6
    contact = F.when(k == 2, "Metorik weekly").when(k == 3, "AMAZON settlement").when(k != 1, F.concat(F.lit("Stockist "), "market"))
    line = F.struct(F.col("sku").alias("ItemCode"), F.col("quantity").alias("Quantity"), F.col("line_total").alias("LineAmount"))
    docs = o.join(items, o["id"] == items["order_id"]).select(
        s("id").alias("InvoiceID"), F.when(F.col("id") % 7 == 0, "ACCPAY").otherwise("ACCREC").alias("Type"), F.col("status").alias("Status"),
        accounting_text(F.col("local_date"), F.lit(0)).alias("Date"), F.struct(contact.alias("Name")).alias("Contact"), F.array(line).alias("LineItems"))
    rows = accounting.invoices(from_text(as_text(docs), accounting.INVOICE_SCHEMA), AS_OF)
    return accounting.invoice_lines(rows).select(F.col("id").cast("long").alias("id"), "date", "status", "contact", "sku", "qty", "line_total")


# --- shipping --------------------------------------------------------------------------------

@query("shipping_stores", """
SELECT s_suppkey AS store_id, s_name AS store_name, 'Market ' || (s_nationkey % 3) AS marketplace, 'acct-' || s_suppkey AS account_name, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://store.example/' || s_suppkey END AS integration_url,
 s_suppkey % 5 <> 0 AS active FROM supplier""")
def shipping_stores(v):
    k = F.col("s_suppkey")
    docs = v("supplier").select(
        k.alias("storeId"), F.col("s_name").alias("storeName"), F.concat(F.lit("Market "), (F.col("s_nationkey") % 3).cast("string")).alias("marketplaceName"),
        F.concat(F.lit("acct-"), k.cast("string")).alias("accountName"),
        F.when(k % 4 != 0, F.concat(F.lit("https://store.example/"), k.cast("string"))).alias("integrationUrl"), (k % 5 != 0).alias("active"))
    return shipping.stores(from_text(as_text(docs), shipping.STORE_SCHEMA))


@query("shipping_orders", """
SELECT CAST(order_number AS VARCHAR) AS order_number, store_id, country, service, company AS bill_company FROM f_ship_orders WHERE order_status = 'awaiting_shipment'""")
def shipping_orders(v):
    k = F.col("order_number")
    docs = v("f_ship_orders").select(
        k.alias("orderId"), F.when(k % 3 != 0, s("order_number")).alias("orderNumber"), F.col("order_status").alias("orderStatus"),
        F.when(k % 2 == 0, F.col("store_id")).alias("storeId"), F.struct(F.when(k % 2 != 0, F.col("store_id")).alias("storeId")).alias("advancedOptions"),
        F.when(k % 5 != 0, F.col("service")).alias("requestedShippingService"), F.col("service").alias("serviceCode"),
        F.struct(F.col("company").alias("company")).alias("billTo"), F.struct(F.col("country").alias("country")).alias("shipTo"))
    landed = shipping.orders(from_text(as_text(docs), shipping.ORDER_SCHEMA))
    return landed.select("order_number", "store_id", "country", "service", "bill_company")


@query("shipments", f"""
SELECT shipment_id, CAST(ship_date AS VARCHAR) AS ship_date, sku, quantity FROM ({SHIPMENTS}) WHERE NOT voided""")
def shipments(v):
    docs = v.select(SHIPMENTS).select(
        F.col("shipment_id").alias("shipmentId"), F.concat(s("ship_date"), F.lit("T00:00:00")).alias("shipDate"), "voided",
        F.array(F.struct("sku", "quantity")).alias("shipmentItems"))
    return shipping.shipments(from_text(as_text(docs), shipping.SHIPMENT_SCHEMA))
