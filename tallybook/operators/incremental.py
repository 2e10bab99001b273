"""Incremental reads, cursors and re-sweeps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import calendar
from tallybook.functions.fixed import MILESTONES
from tallybook.plans.store import money


def slice_page(rows: DataFrame, column: str, watermark: str, size: int, page: int = 1) -> DataFrame:
    """One page of rows at or past the watermark, in (time, id) order."""
    ordered = rows.filter(F.col(column) >= watermark).orderBy(column, "id")
    return (ordered.offset((page - 1) * size) if page > 1 else ordered).limit(size)


def next_cursor(page: DataFrame, column: str, watermark: str, page_no: int, size: int) -> DataFrame:
    """Cursor after a page: stay and turn the page only inside a full cluster.

    A full page that sits entirely on the watermark holds it and moves to the
    next page; a page without times holds it and starts over; anything else
    moves to the newest time, page 1.
    """
    at = F.nullif(F.col(column), F.lit(""))
    seen = page.agg(
        F.count("*").alias("n"), F.count(at).alias("timed"), F.max(at).alias("newest"),
        F.count_if(at == watermark).alias("on_mark"))
    inside = (F.col("n") >= size) & (F.col("timed") > 0) & (F.col("on_mark") == F.col("timed"))
    return seen.select(
        F.when(inside | (F.col("timed") == 0), F.lit(watermark)).otherwise(F.greatest("newest", F.lit(watermark))).alias("watermark"),
        F.when(inside, page_no + 1).otherwise(1).alias("page"), F.col("n").alias("rows"))


def lookback(rows: DataFrame, column: str, as_of: dt.date, days: int) -> DataFrame:
    """Rows a sweep re-reads: dated within the last ``days`` days."""
    return rows.filter(calendar.leading_date(F.col(column)) >= F.lit(as_of - dt.timedelta(days=days)))


def month_counts(orders: DataFrame, floor: dt.date) -> DataFrame:
    kept = orders.filter(F.col("local_date") >= F.lit(floor))
    return kept.groupBy("market", calendar.month_of(F.col("local_date")).alias("ym")).agg(
        F.count("*").alias("n"), money(F.col("total")).alias("revenue"))


def recovered(before: DataFrame, after: DataFrame, as_of: dt.date, complete: bool = True) -> DataFrame:
    """What a sweep recovered per month since the first day of last month.

    Nothing is recorded when the sweep did not finish: a partial count is no truth.
    """
    floor = calendar.month_start(as_of, 1)
    b = month_counts(before, floor).withColumnsRenamed({"n": "stored_before", "revenue": "revenue_before"})
    a = month_counts(after, floor).withColumnsRenamed({"n": "stored_after", "revenue": "revenue_after"})
    joined = a.join(b, ["market", "ym"], "left").na.fill(0, ["stored_before", "revenue_before"])
    gain = F.col("stored_after") - F.col("stored_before")
    share = F.when(F.col("stored_after") > 0, gain / F.col("stored_after").cast("double")).otherwise(0.0)
    out = joined.withColumns({"recovered": gain, "recovered_share": share})
    worst = F.max("recovered_share").over(Window.partitionBy("market"))
    return out.withColumn("worst_share", F.greatest(worst, F.lit(0.0))).filter(F.lit(complete))


def import_cursor(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.max(column).alias("cursor"))


def stale_sources(runs: DataFrame, hours: dict[str, int], now: dt.datetime, expected: DataFrame | None = None) -> DataFrame:
    """Last run per source, market and action against the allowed age.

    ``expected`` lists what should run; what never ran is stale too.
    """
    key = ["source", "market", "action"]
    limit = F.create_map(*[x for k, v in hours.items() for x in (F.lit(k), F.lit(v))])[F.col("action")]
    last = runs.groupBy(*key).agg(F.max("run_at").alias("last_run"))
    if expected is not None:
        last = expected.select(*key).join(last, key, "left")
    age = F.timestamp_diff("SECOND", F.col("last_run"), F.lit(now).cast("timestamp_ntz"))
    out = last.withColumns({"age_seconds": age, "allowed_hours": limit})
    return out.withColumn("stale", F.col("last_run").isNull() | (F.col("age_seconds") >= F.col("allowed_hours") * 3600))


def sellouts(ticks: DataFrame, block: str = "minute", wider: tuple[str, ...] = ("day", "year")) -> DataFrame:
    """Ticks where a product's stock goes from positive to zero.

    ``ticks``: ts, id, product_id, stock.  A null stock means untracked: it is
    remembered, so the next reading never fires; nor does the first reading.

    The previous reading is found inside short time blocks; a block is then known by its first and last
    reading, and so is each block of blocks.  A task sees the ticks of a product and a minute, its minutes of a
    day, its days of a year or its years, so a product with a third of the table over many years is spread.
    """
    tick = F.struct("ts", "id", "stock")
    spans = ticks.select("product_id", tick.alias("first"), tick.alias("last"))
    order = ("minute", "hour", "day", "month", "year")
    levels = [block, *[w for w in wider if order.index(w) > order.index(block)], None]
    fired = []
    for level in levels:
        keys = ["product_id"]
        if level:
            spans = spans.withColumn("block", F.date_trunc(level, "first.ts"))
            keys.append("block")
        along = Window.partitionBy(*keys).orderBy("first.ts", "first.id")
        met = spans.withColumn("prev", F.lag("last.stock").over(along)).filter((F.col("prev") > 0) & (F.col("first.stock") == 0))
        fired.append(met.select("product_id", F.col("first.ts").alias("ts"), F.col("first.id").alias("id")))
        if level:
            spans = spans.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("block")
    out = fired[0]
    for more in fired[1:]:
        out = out.unionByName(more)
    return out


def milestone_ticks(ticks: DataFrame, thresholds: tuple[int, ...] = MILESTONES) -> DataFrame:
    """Highest threshold newly crossed at each tick.

    ``ticks``: market, local_date, tick, n (orders so far that day).  The first
    tick of a day only marks what has passed; a day has at most a tick per poll.
    """
    along = Window.partitionBy("market", "local_date").orderBy("tick")
    prev = F.lag("n").over(along)
    steps = F.array(*[F.lit(t).cast("bigint") for t in thresholds])
    seen = ticks.withColumn("prev", prev).filter(F.col("prev").isNotNull())
    crossed = F.array_max(F.filter(steps, lambda t: (F.col("prev") < t) & (F.col("n") >= t)))
    return seen.withColumn("threshold", crossed).filter(F.col("threshold").isNotNull())


def hourly_ticks(orders: DataFrame) -> DataFrame:
    """Orders so far per market and day, one tick per hour with orders.

    Rows are counted per hour first; only the 24 hourly sums of a day are ordered.
    """
    hour = F.substring("date_created", 12, 2).try_cast("int")
    counted = orders.groupBy("market", "local_date", hour.alias("tick")).agg(F.count("*").alias("new"))
    along = Window.partitionBy("market", "local_date").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("market", "local_date", "tick", F.sum("new").over(along).alias("n"))
