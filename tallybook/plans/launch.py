"""Launch-day reports: launch lines, hourly orders, product totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_launch_line(sku: Column, name: Column, skus: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    """SKU in the launch set, or a launch phrase in the product name."""
    hit = F.coalesce(sku.isin(*skus), F.lit(False))
    for phrase in phrases:
        hit = hit | F.coalesce(F.lower(name).contains(phrase.lower()), F.lit(False))
    return hit


def orders_per_hour(orders: DataFrame, day: dt.date | None = None) -> DataFrame:
    """24 zero-filled buckets per market and day, by the store's own clock."""
    if day is not None:
        orders = orders.filter(F.col("local_date") == F.lit(day))
    hour = F.substring("date_created", 12, 2).try_cast("int")
    counted = orders.groupBy("market", "local_date", hour.alias("hour")).agg(F.count("*").alias("n"))
    # At most 24 entries a day: rows are counted before they are listed.
    entry = F.when(F.col("hour").between(0, 23), F.struct("hour", "n"))
    days = counted.groupBy("market", "local_date").agg(F.map_from_entries(F.collect_list(entry)).alias("by_hour"))
    buckets = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    return days.select("market", "local_date", "by_hour", buckets).select(
        "market", "local_date", "hour",
        F.coalesce(F.try_element_at("by_hour", F.col("hour")), F.lit(0).cast("bigint")).alias("orders"),
    )


def launch_summary(
    orders: DataFrame, lines: DataFrame, skus: tuple[str, ...], phrases: tuple[str, ...], day: dt.date | None = None,
) -> DataFrame:
    """Per market and day: orders, orders with a launch line, units per launch SKU.

    Lines collapse to one row per order before the join, so the join is one to one.
    """
    if day is not None:
        orders = orders.filter(F.col("local_date") == F.lit(day))
    hit = is_launch_line(F.col("sku"), F.col("name"), skus, phrases)
    per_order = lines.filter(hit).groupBy("order_id").agg(
        *[F.sum(F.when(F.col("sku") == s, F.col("quantity")).otherwise(0)).alias(f"units_{i}") for i, s in enumerate(skus)])
    joined = orders.join(per_order, orders["id"] == per_order["order_id"], "left")
    return joined.groupBy("market", "local_date").agg(
        F.count("*").alias("orders"),
        F.count("order_id").alias("launch_orders"),
        *[F.coalesce(F.sum(f"units_{i}"), F.lit(0)).alias(f"units_{i}") for i in range(len(skus))],
    )


def product_lifetime(products: DataFrame) -> DataFrame:
    """Lifetime sales per SKU; stock is null when no product row manages stock."""
    managed = F.when(F.col("manage_stock") & F.col("stock_quantity").isNotNull(), F.col("stock_quantity"))
    return products.groupBy("sku").agg(
        F.sum("total_sales").alias("total_sales"), F.sum(managed).alias("stock_quantity"))
