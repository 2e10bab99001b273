"""What landing jobs move and write: each line and each document once, in few bytes."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.catalog import folders as folder_queries
from tallybook.catalog import landing
from tallybook.operators import maintain
from tallybook.sources import erp, parse, store
from tallybook.testviews import Inputs


@pytest.fixture()
def unhelped(spark):
    """No broadcasts, as with large tables, and plans that show every shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(frame):
    return plan(frame).count("Exchange hashpartitioning")


def deliveries(spark):
    def doc(i, status, modified, *quantities):
        items = [{"sku": "A", "quantity": q, "total": "1"} for q in quantities]
        return json.dumps({"id": i, "status": status, "date_created": "2026-01-01T00:00:00", "date_modified": modified, "line_items": items})

    texts = [(doc(i, s, m, *q), a) for i, s, m, a, *q in (
        (1, "old", None, 0, 1), (1, "new", "2026-01-02T00:00:00", 0, 2, 3), (1, "new", "2026-01-02T00:00:00", 0, 2, 3), (2, "late", None, 1, 4), (2, "early", None, 0, 5),
        (None, "lost", None, 0, 6), (3, "empty", None, 0))]
    raw = spark.createDataFrame(texts, "value string, arrival int").repartition(3)
    return parse.from_text(raw, store.ORDER_SCHEMA).withColumn("market", F.lit("CA"))


def test_a_document_moves_once(unhelped):
    docs = deliveries(unhelped)
    newest = maintain.newest_documents(docs, "id", [F.coalesce("date_modified", "date_created"), maintain.arrival(docs)])
    assert shuffles(newest) == 1
    assert sorted((r["id"], r["status"], len(r["line_items"])) for r in newest.collect()) == [(1, "new", 2), (2, "late", 1), (3, "empty", 0)]


def test_orders_alone_leave_the_lines_where_they_are(unhelped):
    orders, lines = store.land_orders(deliveries(unhelped))
    alone, none = store.land_orders(deliveries(unhelped), with_lines=False)
    assert none is None and sorted(alone.collect()) == sorted(orders.collect())
    assert "line_items, line_items" in plan(orders) and "line_items, line_items" not in plan(alone)
    assert sorted((r["order_id"], r["quantity"]) for r in lines.collect()) == [(1, 2), (1, 3), (2, 4)]


def test_store_lines_are_moved_twice_and_orders_once(unhelped, sf_dir):
    # Lines and codes by code, then lines and orders by order.
    assert shuffles(landing.store_texts(Inputs(unhelped, sf_dir))) == 4


class Given(Inputs):
    """Inputs of given rows in place of the test tables."""

    def __init__(self, spark, **frames):
        super().__init__(spark, "/nowhere")
        self._frames = frames


@pytest.fixture()
def repeated(spark):
    """Order 1 is there twice, order 3 has no line, a line has no order and one has no key; part 2 is there twice."""
    orders = spark.sql("SELECT o_orderkey, 4L AS o_custkey, 'F' AS o_orderstatus, 10.5D AS o_totalprice, TIMESTAMP_NTZ '2000-01-02 00:00:00' AS o_orderdate FROM VALUES (1L), (1L), (2L), (3L), (NULL) t(o_orderkey)")
    lines = spark.sql("""SELECT l_orderkey, l_partkey, 3L AS l_suppkey, 1L AS l_linenumber, l_quantity, 100D AS l_extendedprice, 0.1D AS l_discount
        FROM VALUES (1L, 1L, 1D), (1L, 2L, 2D), (2L, 1L, 3D), (9L, 1L, 4D), (NULL, 1L, 5D), (2L, NULL, 6D) t(l_orderkey, l_partkey, l_quantity)""")
    codes = spark.sql("SELECT * FROM VALUES (1L, 'AU-A-35', 'tin'), (2L, '', NULL), (2L, '', NULL) t(part_id, code, name)")
    return Given(spark, orders=orders, lineitem=lines, f_code=codes)


def landed_lines(documents):
    return Counter((d["id"], li["sku"], li["quantity"], li["total"]) for d in documents.collect() for li in d["line_items"] if li["name"] != "Gift")


def test_repeated_orders_and_parts_repeat_store_lines(repeated):
    got = landing.store_documents(repeated).filter("arrival = 0 AND id < 4")
    # As in the view: each line once for each copy of its order and its part, in each copy of the order.
    assert landed_lines(got) == {(1, "AU-A-35", "2.0", "90.00"): 4, (1, None, "3.0", "90.00"): 8, (2, "AU-A-35", "4.0", "90.00"): 1}
    assert sorted(d["id"] for d in got.collect()) == [1, 1, 2, 3]


def test_files_of_documents_are_compressed(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(folder_queries, "work_dir", lambda *_: str(tmp_path / "documents"))
    assert folder_queries.land_store_rejects(Inputs(spark, sf_dir)).count() == 9
    text = spark.read.parquet(str(tmp_path / "documents")).agg(F.sum(F.length("value"))).first()[0]
    assert 0 < sum(f.stat().st_size for f in (tmp_path / "documents").rglob("*.parquet")) < text / 3


def test_erp_lines_are_moved_twice_and_orders_once(unhelped, sf_dir):
    documents = landing.erp_order_documents(Inputs(unhelped, sf_dir))
    assert shuffles(documents) == 4
    # The documents themselves move once more, for headers and lines alike.
    heads, lines = erp.land_orders(documents)
    assert shuffles(heads) == shuffles(lines) == 5


def test_repeated_orders_and_parts_repeat_erp_lines_by_part_alone(repeated):
    got = landing.erp_order_documents(repeated).filter("arrival = 0 AND id < 4").collect()
    lines = Counter((d["id"], li["code"], int(li["qty"]), int(li["unitPrice"])) for d in got for li in d["lineItems"] if li["code"] != "196")
    assert lines == {(1, "AU-A-35", 1, 901): 2, (1, "", 2, 902): 4, (2, "AU-A-35", 3, 901): 1}
    assert sorted(d["id"] for d in got) == [1, 1, 2, 3]


def test_orders_and_lines_share_one_shuffle_of_documents(unhelped, sf_dir):
    orders, lines = store.land_orders(landing.store_documents(Inputs(unhelped, sf_dir)))
    both = orders.select("id", "status").unionByName(lines.select(F.col("order_id").alias("id"), F.col("sku").alias("status")))
    unhelped.conf.set("spark.sql.adaptive.enabled", "false")
    text = plan(both)
    unhelped.conf.set("spark.sql.adaptive.enabled", "true")
    # Two of lines, two of codes and orders, one of documents, and the last named again where it is used again.
    assert text.count("ReusedExchange") == 1 and text.count("Exchange hashpartitioning") == 6
