"""One key holding a third of all rows, and what plans may not contain."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallybook.catalog import QUERIES
from tallybook.operators import incremental, maintain
from tallybook.plans import packaging, purchasing, shipping, store

N = 30_000


@pytest.fixture(scope="module")
def lines(spark):
    """A third of the lines belong to order 0."""
    i = F.col("id")
    return spark.range(N).select(
        F.when(i % 3 == 0, 0).otherwise(i).cast("long").alias("order_id"), F.lit("AU").alias("market"),
        F.concat(F.lit("AU-"), (i % 7).cast("string"), F.lit("-35")).alias("sku"), F.lit("n").alias("name"), (i % 5).alias("quantity"),
        F.lit(1).cast("decimal(18,2)").alias("total"), F.lit(dt.date(2026, 4, 1)).alias("local_date"))


@pytest.fixture(scope="module")
def orders(lines):
    return lines.select(F.col("order_id").alias("id"), "market", "local_date").distinct().withColumn("status", F.lit("completed"))


def test_hot_order(spark, orders, lines):
    out = store.sku_daily(store.order_lines(orders, lines))
    assert out.agg(F.sum("qty")).first()[0] == sum(i % 5 for i in range(N))
    assert packaging.mailer_demand(orders, lines, dt.date(2026, 1, 1)).first()["orders"] == lines.filter("quantity > 0").select("order_id").distinct().count()
    ship = orders.select(F.col("id").alias("order_number"), F.lit("c").alias("company"))
    assert shipping.wholesale_lines(ship, lines.withColumn("sku", F.lit("WC-X"))).count() == orders.count()


def test_hot_key_upsert(spark, lines):
    rows = lines.select("order_id", "sku", F.monotonically_increasing_id().alias("seq"))
    latest = maintain.latest_by_key(rows, ["order_id"], ["seq"])
    expected = rows.groupBy("order_id").agg(F.max("seq").alias("seq"))
    assert latest.join(expected, ["order_id", "seq"], "left_semi").count() == expected.count() == latest.count()


def test_hot_supplier_sends_few_rows(spark):
    rows = spark.range(N).select(
        F.concat(F.lit("PO-"), F.col("id").cast("string")).alias("reference"), F.when(F.col("id") % 1000 == 0, "Two").otherwise("One").alias("company"), F.lit(dt.date(2026, 1, 1)).alias("created_date"),
        F.lit("Completed").alias("status"), F.date_add(F.lit(dt.date(2026, 1, 2)), (F.col("id") % 60).cast("int")).alias("fully_received_date"),
        F.lit("X").alias("code"), F.lit(1).alias("qty"), F.lit(1).alias("qty_received"))
    samples = purchasing.lead_samples(rows, dt.date(2026, 6, 1))
    assert samples.count() == 20
    assert "WindowGroupLimit" in samples._jdf.queryExecution().executedPlan().toString()


def test_hot_product_sellouts(spark):
    i = F.col("id")
    ticks = spark.range(N).select(
        i, F.timestamp_add("SECOND", i, F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz")).alias("ts"), F.lit(1).cast("long").alias("product_id"),
        F.when(i % 2 == 0, 3).otherwise(0).cast("long").alias("stock"))
    assert incremental.sellouts(ticks).count() == N // 2


def test_a_hot_product_over_years(spark):
    i = F.col("id")
    ticks = spark.range(N).select(
        i, F.timestamp_add("HOUR", i * 7, F.lit(dt.datetime(2001, 1, 1)).cast("timestamp_ntz")).alias("ts"), F.lit(1).cast("long").alias("product_id"),
        F.when(i % 2 == 0, 3).otherwise(0).cast("long").alias("stock"))
    assert incremental.sellouts(ticks).count() == N // 2
    # No window is over the product's readings alone but the one over its years.
    along = ticks.select("product_id", F.date_trunc("year", "ts")).distinct().count()
    assert along < 30


def plan(spark, sf_dir, key):
    return QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


STREAMS = {"stream_orders_upsert", "sellout_transition", "milestone_stream", "boundary_dedupe_stream", "orders_per_hour_stream", "stream_order_versions"}
WRITES = {"append_run_log", "save_cursor", "snapshot_overwrite_guarded"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS - WRITES))
def test_no_cross_joins_or_python(spark, sf_dir, key):
    text = plan(spark, sf_dir, key)
    assert not re.search("CartesianProduct|NestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(spark, sf_dir, "countable_orders")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    counts = plan(spark, sf_dir, "audit_duplicate_lines")
    assert "l_extendedprice" not in counts and "l_quantity" not in counts
    po = plan(spark, sf_dir, "fully_received_pos")
    assert "l_extendedprice" not in po


def test_shuffled_parts_stay_small(spark):
    """More rows are more tasks, whatever the number of shuffle partitions."""
    rows = spark.range(1_500_000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("x"), F.unhex(F.sha2((-F.col("id")).cast("string"), 512)).alias("y"))
    tasks = rows.repartition(F.col("id")).groupBy(F.spark_partition_id()).agg(F.max("x"), F.max("y")).collect()
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_table_of_millions_of_keys_is_not_broadcast(spark, tmp_path):
    """Keys in order are small in files and large in memory."""
    path = str(tmp_path / "keys")
    spark.range(2_000_000).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")).repartition(1).sortWithinPartitions("id").write.parquet(path)
    keys = spark.read.parquet(path).select("id")
    text = keys.join(keys.withColumnRenamed("id", "other"), F.col("id") == F.col("other"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
