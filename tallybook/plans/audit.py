"""Data-quality audits, freshness, reconciliation and the activity feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar, text
from tallybook.operators.maintain import superseded
from tallybook.plans.store import countable, money


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per source and market."""
    out = None
    for source, rows in tables.items():
        part = rows.groupBy("market").agg(F.count("*").alias("rows")).select(F.lit(source).alias("source"), "market", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def mapped_skus(items: DataFrame, floor: dt.date) -> DataFrame:
    """Exact number of mapped SKUs sold since a date, per market."""
    return items.filter(F.col("dashboard_sku").isNotNull() & (F.col("local_date") >= F.lit(floor))).groupBy("market").agg(
        F.count_distinct("dashboard_sku").alias("rows"))


def superseded_rows(items: DataFrame, jobs: DataFrame) -> DataFrame:
    markets = jobs.select("market").distinct()
    stale = superseded(items, jobs).groupBy("market").agg(F.count("*").alias("rows"))
    return markets.join(stale, "market", "left").na.fill(0, ["rows"])


def duplicate_lines(items: DataFrame) -> DataFrame:
    """Extra copies per market of a line id; rows without an id do not count."""
    copies = items.filter(F.col("shipment_item_id").isNotNull()).groupBy("market", "shipment_item_id").agg(F.count("*").alias("n"))
    return copies.groupBy("market").agg(F.sum(F.col("n") - 1).alias("extra"))


def line_id_coverage(items: DataFrame, as_of: dt.date) -> DataFrame:
    """Mapped lines with and without a line id in this month and last month."""
    active = items.filter(
        F.col("dashboard_sku").isNotNull() & (F.col("local_date") >= F.lit(calendar.month_start(as_of, 1))))
    has = F.col("shipment_item_id").isNotNull()
    return active.groupBy("market").agg(F.count_if(~has).alias("missing"), F.count_if(has).alias("with_id"))


def freshness(runs: DataFrame, tables: dict[str, DataFrame], jobs: DataFrame) -> DataFrame:
    """Per source, market and action: last run; plus row counts and job ledgers."""
    stamp = F.date_format(F.max("run_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ticks = runs.groupBy("source", "market", "action").agg(stamp.alias("last_sync"))
    sources = runs.groupBy("source", "market").agg(stamp.alias("last_sync")).withColumn("action", F.lit("any"))
    none = F.lit(None)
    synced = ticks.unionByName(sources).withColumns({"rows": none.cast("bigint"), "total": none.cast("bigint")})
    counts = row_counts(tables).withColumns({
        "action": F.lit("rows"), "last_sync": none.cast("string"), "total": none.cast("bigint")})
    ledger = jobs.groupBy("market").agg(
        F.count_if(F.col("status") == "ingested").alias("rows"), F.count("*").alias("total")).withColumns(
        {"source": F.lit("report_jobs"), "action": F.lit("ingested"), "last_sync": none.cast("string")})
    return synced.unionByName(counts).unionByName(ledger)


def reconcile(orders: DataFrame, remote: DataFrame) -> DataFrame:
    """Local against authoritative counts per market and month, and overall ('all').

    ``remote``: market, ym, remote_count.  A month the comparator lacks stays
    null.  Only monthly sums meet.
    """
    local = countable(orders).groupBy("market", F.substring("date_created", 1, 7).alias("ym")).agg(
        F.count("*").alias("local_count"), money(F.col("total")).alias("revenue"),
        F.min(F.substring("date_created", 1, 10)).alias("date_min"), F.max(F.substring("date_created", 1, 10)).alias("date_max"))
    month = local.join(remote, ["market", "ym"], "full")
    overall = month.groupBy("market").agg(
        F.sum("local_count").alias("local_count"), F.sum("revenue").cast("decimal(18,2)").alias("revenue"), F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"), F.sum("remote_count").alias("remote_count")).withColumn("ym", F.lit("all"))
    both = month.unionByName(overall)
    aov = F.floor(F.col("revenue").cast("double") / F.col("local_count").cast("double") * 100.0 + 0.5) / 100.0
    return both.withColumns({
        "count_match": F.col("local_count") == F.col("remote_count"),
        "count_delta": F.col("local_count") - F.col("remote_count"),
        "average_order": F.when(F.col("local_count") > 0, aov)})


def activity(runs: DataFrame, jobs: DataFrame, snapshots: DataFrame, now: dt.datetime, hours: int = 24, limit: int = 200) -> DataFrame:
    """Run log, report jobs and snapshots as one feed, newest first.

    Runs and jobs count within ``hours`` (1..168); snapshots always.  The cap
    (10..1000) is the page size; ties break on every shown column.
    """
    if not 1 <= hours <= 168 or not 10 <= limit <= 1000:
        raise ValueError("hours must be 1 to 168 and limit 10 to 1000")
    since = F.lit(now - dt.timedelta(hours=hours)).cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    action = F.col("action")
    ticks = runs.filter(F.col("run_at") >= since).select(
        F.col("run_at").alias("at"), F.when(action == "amazon-reports", action).otherwise(F.col("source")).alias("source"), "market",
        F.coalesce(action, F.lit("sync")).alias("action"), F.coalesce("status", F.lit("ok")).alias("status"),
        text.run_summary(action, F.col("status"), none, F.col("orders_added"), F.col("items_added")).alias("summary"), F.lit("tick").alias("scope"))
    shown = F.when(F.col("status").isin("ingested", "ready"), "ok").when(F.col("status") == "failed", "error").otherwise("pending")
    batches = jobs.filter(F.col("updated_at") >= since).select(
        F.col("updated_at").alias("at"), F.lit("amazon-reports").alias("source"), "market", F.col("status").alias("action"), shown.alias("status"),
        text.job_summary(F.col("status"), F.col("range_label"), F.col("attempts"), F.col("error"),
                         F.col("rows_matched"), F.col("rows_unmatched"), F.col("rows_wrong_market")).alias("summary"),
        F.lit("job").alias("scope"))
    cached = snapshots.select(
        "at", "source", "market", F.lit("snapshot").alias("action"), F.lit("ok").alias("status"),
        text.snapshot_summary(F.col("count")).alias("summary"), F.lit("snapshot").alias("scope"))
    feed = ticks.unionByName(batches).unionByName(cached)
    return feed.orderBy(F.col("at").desc(), "scope", "source", "market", "action", "status", "summary").limit(limit)
