"""Landed documents hold the lines of the tables, not made-up ones."""

from __future__ import annotations

from collections import Counter

from tallybook.catalog import QUERIES, landing
from tallybook.sources import erp
from tallybook.testviews import Inputs


def test_store_documents_hold_every_item(spark, sf_dir):
    v = Inputs(spark, sf_dir)
    usual = "id % 4 <> 0 AND id % 10 <> 5"
    items = v("f_store_items").selectExpr("order_id AS id", "sku", "quantity", "CAST(total AS DOUBLE) AS total").filter(usual)
    gifts = v("f_store_orders").filter(usual).selectExpr("id", "CAST(NULL AS STRING)", "1L", "0D")
    landed = QUERIES["land_store_orders"](spark, sf_dir).filter("kind = 'line'").selectExpr("order_id AS id", "detail", "quantity", "total").filter(usual)
    assert Counter(map(tuple, landed.collect())) == Counter(map(tuple, items.union(gifts).collect()))


def test_erp_documents_hold_every_line(spark, sf_dir):
    v = Inputs(spark, sf_dir)
    lines = v("f_erp_lines").filter("order_id % 899 <> 0 OR order_id % 4 = 0")
    _, landed = erp.land_orders(landing.erp_order_documents(v))
    fees = v("f_erp_orders").filter("id % 4 <> 0 AND id % 899 <> 0").count()
    assert landed.count() == lines.count() + fees
    children = lines.filter("parent_id <> 0").groupBy("order_id", "parent_id").count()
    kept = landed.filter("parent_id <> 0").groupBy("order_id", "parent_id").count()
    assert children.count() > 0 and Counter(map(tuple, kept.collect())) == Counter(map(tuple, children.collect()))


def test_credit_documents_hold_every_line(spark, sf_dir):
    expected = Inputs(spark, sf_dir)("f_credit_lines").groupBy("credit_note_id").count()
    landed = QUERIES["land_erp_credit_notes"](spark, sf_dir).filter("kind = 'line'").groupBy("id").count()
    assert Counter(map(tuple, landed.collect())) == Counter(map(tuple, expected.collect()))
