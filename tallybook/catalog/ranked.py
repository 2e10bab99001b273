"""Reports whose order is part of the result, and reports over tables by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.catalog.base import AS_OF, CUTOVER, MONTHS, ORACLE, query
from tallybook.catalog.erp import facts
from tallybook.catalog.operations import distributor_orders
from tallybook.catalog.store import FLOOR
from tallybook.catalog.supply import risk_rows, stock_inventory
from tallybook.operators.ranking import ranked
from tallybook.plans import erp, fulfilment, inventory, risk, store
from tallybook.session import work_dir
from tallybook.sources import layout


def in_order(key: str, of: str, columns: str, order: str):
    """Register a query whose SQL numbers the rows of another query's SQL."""
    ORACLE[key] = f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM ({ORACLE[of]})"
    return query(key)


_RISKS = "['critical', 'critical-incoming', 'low', 'low-incoming', 'monitor', 'stable', 'no-sales', 'inactive']"


@in_order("stock_risk_ranked", "stock_risk", "sku, risk, days_left", f"list_position({_RISKS}, risk), coalesce(days_left, 99999), sku")
def stock_risk_ranked(v):
    return ranked(risk_rows(v).select("sku", "risk", "days_left"), *risk.risk_order())


@in_order("must_ship_ranked", "must_ship_sort", "id, grp, must_ship_by, is_dispatched", "is_dispatched, must_ship_by NULLS LAST, id")
def must_ship_ranked(v):
    rows = distributor_orders(v).filter(F.col("grp") != "otherDistributors").select("id", "grp", "must_ship_by", "is_dispatched")
    return ranked(rows, *fulfilment.must_ship_order())


ORACLE["natural_refs"] = ORACLE["natural_sort_refs"].replace("SELECT id, reference, array_to_string", "SELECT id, reference, is_dispatched, array_to_string")


@in_order("natural_refs_ranked", "natural_refs", "id, reference", "is_dispatched, sort_key, id")
def natural_refs_ranked(v):
    rows = distributor_orders(v).filter(F.col("grp") == "otherDistributors").select("id", "reference", "is_dispatched")
    return ranked(rows, *fulfilment.reference_order()).drop("is_dispatched")


# Only a step towards the statement above.
del ORACLE["natural_refs"]


@in_order("inventory_ranked", "inventory_rollup", "sku, discontinued, warehouse_soh", "discontinued, warehouse_soh DESC, sku")
def inventory_ranked(v):
    return ranked(stock_inventory(v).select("sku", "discontinued", "warehouse_soh"), *inventory.inventory_order())


ORACLE["five_channel_whole"] = f"""
WITH b AS ({ORACLE['five_channel_month']}),
m AS (SELECT DISTINCT ym FROM b),
slots AS (SELECT 'channel' AS section, ym, unnest(['col', 'woo2', 'dist', 'woo', 'amz']) AS key FROM m UNION ALL SELECT 'refund', ym, 'all' FROM m),
c AS (SELECT ym, coalesce(sum(orders) FILTER (section = 'channel' AND (key NOT IN ('woo', 'amz') OR (key = 'amz' AND ym >= '{CUTOVER}'))), 0) AS considered,
  coalesce(sum(orders) FILTER (section = 'refund'), 0) AS notes, count(*) FILTER (section = 'sku') AS skus FROM b GROUP BY ym),
u AS (
 SELECT section, ym, key, name, col, woo2, dist, woo, amz, total_tins, revenue, orders FROM b WHERE section IN ('sku', 'refund_sku')
 UNION ALL SELECT s.section, s.ym, s.key, NULL, NULL, NULL, NULL, NULL, NULL, coalesce(total_tins, 0), coalesce(revenue, 0), coalesce(orders, 0) FROM slots s LEFT JOIN b USING (section, ym, key)
 UNION ALL SELECT 'counts', ym, unnest(['ordersConsidered', 'attributedRefs', 'creditNotesConsidered', 'skuRows']), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  unnest([considered, considered + notes, notes, skus]) FROM c)
SELECT section, ym, key, name, col, woo2, dist, woo, amz, total_tins, revenue, CAST(orders AS BIGINT) AS orders,
 row_number() OVER (ORDER BY section, ym, total_tins DESC NULLS LAST, key) AS position FROM u"""


@query("five_channel_whole")
def five_channel_whole(v):
    return erp.five_channel_whole(erp.five_channel(facts(v), v("f_credit_lines")), CUTOVER)


_BY_MONTH = "id long, number string, status string, date_created string, local_date date, total decimal(18,2), currency string"


def _by_month(v):
    """The store orders as a table by market and month."""
    path = work_dir(v.spark, "orders-by-month")
    layout.write_by_month(v("f_store_orders"), path)
    return layout.read_by_month(v.spark, path, _BY_MONTH)


ORACLE["store_monthly_by_month"] = ORACLE["store_monthly"]
ORACLE["countable_orders_by_month"] = ORACLE["countable_orders"]


@query("store_monthly_by_month")
def store_monthly_by_month(v):
    rows = layout.in_months(store.countable(_by_month(v)), layout.month_axis(v.spark, AS_OF, MONTHS))
    return store.monthly(rows.drop("idx", "ym"), AS_OF, MONTHS)


@query("countable_orders_by_month")
def countable_orders_by_month(v):
    return layout.since(store.countable(_by_month(v)), FLOOR).select("id", "market", "status", "local_date", "total")
