"""Store sales reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar
from tallybook.functions.fixed import COUNTABLE_STATUSES

MONEY = "decimal(18,2)"


def money(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast(MONEY)


def countable(orders: DataFrame, floor: dt.date | None = None, market: str | None = None) -> DataFrame:
    """Completed or processing orders, optionally of one market and from a date on."""
    out = orders.filter(F.col("status").isin(*COUNTABLE_STATUSES))
    if market is not None:
        out = out.filter(F.col("market") == market)
    if floor is not None:
        out = out.filter(F.col("local_date") >= F.lit(floor))
    return out


def by_market_month(markets: DataFrame, as_of: dt.date, months: int) -> DataFrame:
    """Every market with every month of the window."""
    slots = [
        F.struct(F.lit(i).alias("idx"), F.lit(ym).alias("ym"),
                 F.lit(dt.date(int(ym[:4]), int(ym[5:]), 1).strftime("%b %Y")).alias("label"))
        for i, ym in enumerate(calendar.month_keys(as_of, months))
    ]
    return markets.select("market", F.explode(F.array(*slots)).alias("m")).select("market", "m.*")


def monthly(orders: DataFrame, as_of: dt.date, months: int) -> DataFrame:
    """Orders and revenue per market and month of the window, zeros included.

    The month axis is added to the distinct markets after the facts have been
    reduced to one row per market and month.
    """
    keys = calendar.month_keys(as_of, months)
    ym = calendar.month_of(F.col("local_date"))
    # One scan: every market is kept, months outside the window fall into null.
    counted = orders.groupBy("market", F.when(ym.isin(*keys), ym).alias("ym")).agg(
        F.count("*").alias("orders"), money(F.col("total")).alias("revenue"))
    slots = by_market_month(counted.select("market").distinct(), as_of, months)
    return slots.join(counted, ["market", "ym"], "left").select(
        "market", "idx", "ym",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue"),
    )


def order_lines(orders: DataFrame, lines: DataFrame, floor: dt.date | None = None) -> DataFrame:
    """Lines of countable orders; the parent only contributes its status."""
    keep = countable(orders, floor).select(F.col("id").alias("order_id"))
    if floor is not None:
        lines = lines.filter(F.col("local_date") >= F.lit(floor))
    return lines.join(keep, "order_id")


def sum_with_name(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums per key and the greatest name.

    A text maximum would make Spark sort every row before combining.  With the
    name as a key of the first step the rows are hashed, and only the few
    (key, name) pairs left are sorted.
    """
    first = rows.groupBy(*keys, "name").agg(*[col.alias(n) for n, col in sums.items()])
    again = [F.sum(n).cast(first.schema[n].dataType).alias(n) for n in sums]
    return first.groupBy(*keys).agg(F.max("name").alias("name"), *again)


def sku_daily(lines: DataFrame, sku: str = "sku") -> DataFrame:
    rows = lines.select("market", F.col(sku).alias("sku"), F.col("local_date").alias("day"), "name", "quantity", "total")
    return sum_with_name(rows, ["market", "sku", "day"], {"qty": F.sum("quantity"), "revenue": money(F.col("total"))})


def sku_totals(daily: DataFrame, as_of: dt.date, months: int) -> DataFrame:
    """Totals per SKU with one quantity and one revenue column per month.

    The name is the first non-empty one by day.
    """
    name = F.when(F.col("name") != "", F.col("name"))
    ym = calendar.month_of(F.col("day"))
    columns = [
        F.min_by(name, F.when(name.isNotNull(), F.struct("day", "name"))).alias("name"),
        F.sum("qty").alias("qty"), money(F.col("revenue")).alias("revenue"),
    ]
    for i, key in enumerate(calendar.month_keys(as_of, months)):
        hit = ym == key
        columns.append(F.sum(F.when(hit, F.col("qty")).otherwise(0)).alias(f"qty_m{i}"))
        columns.append(money(F.when(hit, F.col("revenue"))).alias(f"revenue_m{i}"))
    sku = F.when(F.coalesce(F.col("sku"), F.lit("")) == "", "unknown").otherwise(F.col("sku"))
    return daily.groupBy("market", sku.alias("sku")).agg(*columns)


def sku_weekly(daily: DataFrame, floor: dt.date | None = None) -> DataFrame:
    sku = F.when(F.coalesce(F.col("sku"), F.lit("")) == "", "unknown").otherwise(F.col("sku"))
    return (
        daily.withColumn("week", calendar.week_key(F.col("day"), floor)).filter(F.col("week").isNotNull())
        .groupBy("market", sku.alias("sku"), "week").agg(F.sum("qty").alias("qty"))
    )


def daily_orders(orders: DataFrame, floor: dt.date) -> DataFrame:
    return countable(orders, floor).groupBy("market", F.col("local_date").alias("day")).agg(F.count("*").alias("orders"))


def recent(orders: DataFrame, now: dt.datetime, limit: int = 50) -> DataFrame:
    """Countable orders of the last 24 hours, newest first; the cap is the feature."""
    at = F.col("date_created").try_cast("timestamp_ntz")
    return (
        countable(orders).withColumn("at", at)
        .filter((at >= F.lit(now - dt.timedelta(hours=24)).cast("timestamp_ntz")))
        .orderBy(F.col("at").desc(), F.col("id").desc()).limit(limit).drop("at")
    )
