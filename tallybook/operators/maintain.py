"""Keeping tables right under re-delivered, late and duplicated rows.

Every job is a pure function from frames to frames; the caller writes the
result.  One row per key is picked by a max or min over a struct, which is
combined map-side, so a key with most of the rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar


def _one_per_key(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = pick(F.struct(*order, *rest)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, "row.*").select(*rows.columns)


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest order per key; ties break on the other columns."""
    return _one_per_key(rows, keys, order, F.max)


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _one_per_key(rows, keys, order, F.min)


def newest_documents(documents: DataFrame, key: str, order: list[Column], wanted: list[str] | None = None) -> DataFrame:
    """Documents, one per key: the key and what is wanted of the delivery with the highest order.

    Deliveries are reduced to one per key and task before the only shuffle, so a document moves
    once at most, and all that is read from the result shares that shuffle.  Ties break on the
    whole content, wanted or not, and exact copies count once.  Documents without a key are left out.
    """
    wanted = wanted or [c for c in documents.columns if c != key]
    version = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*documents.columns).alias("content"))
    newest = documents.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*wanted), version).alias("_newest"))
    return newest.select(key, "_newest.*")


def arrival(documents: DataFrame) -> Column:
    """Arrival number of a delivery, where the reader gives one."""
    return F.col("arrival") if "arrival" in documents.columns else F.lit(0)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Replace whole rows by key; the newest delivered copy wins over any stored one."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return latest_by_key(both, keys, ["is_new", *order]).drop("is_new")


def replace_children(lines: DataFrame, parents: DataFrame, new_lines: DataFrame, key: str) -> DataFrame:
    """Lines of re-delivered parents are replaced as a set, even by an empty one."""
    kept = lines.join(parents.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new_lines.select(*lines.columns))


#: Rows of a membership set that are broadcast at most.
BROADCAST_ROWS = 100_000


def members(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A membership set to join with: broadcast if it is counted to have at most ``most`` rows.

    Then the big side isn't shuffled, however many of its rows share one id.  A larger set is
    joined by shuffles: Spark filters the big side by a Bloom filter of the set where that pays, and splits hot ids.
    """
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def supersede_ranges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Land re-fetched report batches.

    The newest incoming batch of a (market, range) replaces every row stored
    for it, its own included, so landing a batch twice changes nothing.  Then
    rows with a line id are unique per (market, line id), newest batch first:
    a line may have moved between ranges.  Rows without an id are only replaced
    by range: they take no part in the aggregation.
    """
    span = ["market", "range_label"]
    newest = members(incoming.groupBy(*span).agg(F.max("report_job_id").alias("new_job")))
    both = existing.withColumn("is_new", F.lit(0)).unionByName(incoming.withColumn("is_new", F.lit(1)))
    untouched = (F.col("is_new") == 0) & F.col("new_job").isNull()
    landed = (F.col("is_new") == 1) & (F.col("report_job_id") == F.col("new_job"))
    rows = both.join(newest, span, "left").filter(untouched | landed).drop("new_job")
    lines = latest_by_key(rows.filter(F.col("shipment_item_id").isNotNull()), ["market", "shipment_item_id"], ["is_new", "report_job_id"])
    return lines.unionByName(rows.filter(F.col("shipment_item_id").isNull())).drop("is_new")


def _ingested_latest(jobs: DataFrame) -> DataFrame:
    done = jobs.filter(F.col("status") == "ingested")
    newest = done.groupBy("market", "range_label").agg(F.max("id").alias("latest_job"), F.count("*").alias("jobs_seen"))
    return done.select("id", "market", "range_label").join(newest, ["market", "range_label"])


def superseded(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows held by an ingested batch that is not the latest of its range."""
    stale = _ingested_latest(jobs).filter(F.col("id") != F.col("latest_job")).select(F.col("id").alias("report_job_id"))
    return items.join(members(stale), "report_job_id", "left_semi")


def dedupe_superseded(items: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, summary per range).  Rows are counted per batch before any join."""
    ledger = _ingested_latest(jobs)
    stale = ledger.filter(F.col("id") != F.col("latest_job")).select(F.col("id").alias("report_job_id"))
    kept = items.join(members(stale), "report_job_id", "left_anti")
    held = items.groupBy("report_job_id").agg(F.count("*").alias("n"))
    is_latest = F.col("id") == F.col("latest_job")
    summary = ledger.join(held, ledger["id"] == held["report_job_id"], "left").groupBy(
        "market", "range_label", "latest_job", "jobs_seen").agg(
        F.coalesce(F.sum(F.when(is_latest, F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(~is_latest, F.col("n"))), F.lit(0)).alias("deleted"))
    return kept, summary


def in_batches(items: DataFrame, batches: DataFrame) -> DataFrame:
    return items.join(members(batches.select(F.col("id").alias("report_job_id")).distinct()), "report_job_id", "left_semi")


def cascade_delete(parents: DataFrame, children: DataFrame, doomed: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the doomed parents; ``doomed`` has column id."""
    ids = members(doomed.select(F.col("id").alias("doomed_id")).distinct())
    return (
        parents.join(ids, F.col(parent_key) == F.col("doomed_id"), "left_anti"),
        children.join(ids, F.col(child_key) == F.col("doomed_id"), "left_anti"),
    )


def backfill_local_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn("local_date", F.coalesce("local_date", calendar.leading_date(F.col("date_created"))))


def backfill_channel(orders: DataFrame) -> DataFrame:
    """Tag untagged mirror orders of the marketplace seller account."""
    mirror = F.col("channel_attr").isNull() & F.lower(F.trim("company")).startswith("amazon seller")
    return orders.withColumn("channel_attr", F.when(mirror, "amz").otherwise(F.col("channel_attr")))


def backfill_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows pending, rows tagged, and tagged rows per month."""
    pending = before.filter(
        F.col("channel_attr").isNull() & F.lower(F.trim("company")).startswith("amazon seller")
    ).agg(F.count("*").alias("rows")).select(F.lit("pending before").alias("measure"), "rows")
    tagged = after.filter(F.col("channel_attr") == "amz")
    by_month = tagged.groupBy(F.substring("created_date", 1, 7).alias("measure")).agg(F.count("*").alias("rows"))
    total = by_month.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit("tagged after").alias("measure"), "rows")
    return pending.unionByName(total).unionByName(by_month)
