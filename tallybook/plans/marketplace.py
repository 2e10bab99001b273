"""Marketplace sales reports and report-request ledgers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import calendar, codes
from tallybook.plans.store import money


def with_local_date(rows: DataFrame, source: str) -> DataFrame:
    return rows.withColumn("local_date", calendar.business_date(F.col(source)))


def with_sku(items: DataFrame) -> DataFrame:
    return items.withColumn("dashboard_sku", codes.marketplace_sku(F.col("seller_sku")))


def monthly(orders: DataFrame, floor: dt.date | None = None) -> DataFrame:
    """Orders and revenue per market and month, whatever the status."""
    if floor is not None:
        orders = orders.filter(F.col("local_date") >= F.lit(floor))
    return orders.groupBy("market", calendar.month_of(F.col("local_date")).alias("ym")).agg(
        F.count("*").alias("orders"), money(F.col("total")).alias("revenue"))


def mapped_lines(items: DataFrame, floor: dt.date | None = None) -> DataFrame:
    """Lines with a known SKU, ready for the per-SKU reports shared with the store."""
    out = items.filter(F.col("dashboard_sku").isNotNull())
    return out if floor is None else out.filter(F.col("local_date") >= F.lit(floor))


def job_status(jobs: DataFrame) -> DataFrame:
    by_status = jobs.groupBy("market", "status").agg(F.count("*").alias("jobs"))
    per_market = jobs.groupBy("market").agg(
        F.count_if(F.col("status") == "ingested").alias("ingested"), F.count("*").alias("total"))
    return by_status.join(per_market, "market")


def match_totals(jobs: DataFrame) -> DataFrame:
    """Matched, unmatched and wrong-market sums of ingested batches, and the signals used."""
    return jobs.filter(F.col("status") == "ingested").groupBy("market").agg(
        F.sum("rows_matched").alias("matched"), F.sum("rows_unmatched").alias("unmatched"),
        F.sum("rows_wrong_market").alias("wrong_market"),
        F.array_join(F.array_sort(F.collect_set("filter_signal")), ",").alias("signals"),
    )


def latest_job(jobs: DataFrame, ingested_only: bool = False) -> DataFrame:
    """Newest job per (market, range)."""
    if ingested_only:
        jobs = jobs.filter(F.col("status") == "ingested")
    others = [c for c in jobs.columns if c not in ("market", "range_label", "id")]
    newest = F.max_by(F.struct("id", *others), "id").alias("j")
    return jobs.groupBy("market", "range_label").agg(newest).select("market", "range_label", "j.*")


def report_ranges(spark: SparkSession, markets: list[str], as_of: dt.date, months: int = 6) -> DataFrame:
    """Half-month ranges of the rolling window, with their bounds as instants."""
    rows = calendar.month_window(spark, as_of, months)
    half = F.explode(F.array(F.lit(1), F.lit(2))).alias("half")
    out = rows.select("ym", "idx", "first_day", half, F.explode(F.array(*[F.lit(m) for m in markets])).alias("market"))
    middle = F.date_add("first_day", 15)
    start = F.when(F.col("half") == 1, F.col("first_day")).otherwise(middle)
    end = F.when(F.col("half") == 1, middle).otherwise(F.add_months("first_day", 1))
    return out.select(
        "market",
        F.concat("ym", F.lit("-"), F.col("half").cast("string"), F.lit("h")).alias("range_label"),
        calendar.business_midnight_text(start).alias("data_start_time"),
        calendar.business_midnight_text(end).alias("data_end_time"),
        (F.col("idx") >= months - 2).alias("is_active"),
    )


def due_ranges(ranges: DataFrame, jobs: DataFrame, now: dt.datetime, stale_hours: int = 24) -> DataFrame:
    """Ranges to request: never asked for, or ingested, still active and a day old.

    A pending, ready or failed request is never asked for again.
    """
    last = latest_job(jobs).select("market", "range_label", F.col("status").alias("last_status"), F.col("updated_at").alias("last_update"))
    age = F.timestamp_diff("SECOND", F.col("last_update"), F.lit(now).cast("timestamp_ntz")) / 3600
    refresh = (F.col("last_status") == "ingested") & F.col("is_active") & (age >= stale_hours)
    return (
        ranges.join(last, ["market", "range_label"], "left")
        .filter(F.col("last_status").isNull() | refresh)
        .drop("last_status", "last_update")
    )


def due_polls(jobs: DataFrame, now: dt.datetime, limit: int, min_seconds: int = 90) -> DataFrame:
    """Pending requests not polled lately, oldest first; the cap is the poll budget."""
    waited = F.timestamp_diff("SECOND", F.col("last_polled_at"), F.lit(now).cast("timestamp_ntz"))
    due = F.col("last_polled_at").isNull() | (waited > min_seconds)
    return (
        jobs.filter((F.col("status") == "pending") & F.col("report_id").isNotNull() & due)
        .orderBy("id").limit(limit)
    )


def reconcile(orders: DataFrame) -> DataFrame:
    """Month and overall counts per market; the overall row has ym 'all'."""
    month = monthly(orders)
    total = month.groupBy("market").agg(F.sum("orders").alias("orders"), F.sum("revenue").cast("decimal(18,2)").alias("revenue"))
    return month.unionByName(total.withColumn("ym", F.lit("all")))
