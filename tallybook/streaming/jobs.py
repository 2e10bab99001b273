"""Streaming jobs over landed files.

Each handles one micro-batch as ordinary DataFrames and keeps its state in a
table keyed by batch number.  Work inside a batch is spread like any batch
job, so a hot key does not land in one stateful task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.fixed import MILESTONES
from tallybook.operators.incremental import milestone_ticks, sellouts
from tallybook.operators.maintain import latest_by_key
from tallybook.streaming.tables import late_rows, read_batch, run_available, write_batch, written_batches


def upsert_orders(stream: DataFrame, path: str, key: str = "id", order: str = "date_created") -> None:
    """Land orders; each batch keeps one copy per key, readers take the newest.

    A batch only writes what it brought: the table is never rewritten.  The
    stream checkpoint is the cursor.
    """
    def handle(rows: DataFrame, batch_id: int) -> None:
        write_batch(latest_by_key(rows, [key], [order]), f"{path}/rows", batch_id)

    run_available(stream, handle, f"{path}/checkpoint")


def upsert_versions(stream: DataFrame, path: str, key: str = "id", modified: str = "date_modified", fold_every: int = 8) -> None:
    """Land rows that are delivered again: per key the copy modified last counts, then that of the later batch.

    A batch writes its newest copies.  Every fold_every batches, what has come so far is folded to one copy per key, from the
    fold before and the batches since; so a read touches fold_every folders at most, whatever the stream's age.  A retried
    batch or fold overwrites its own folder.  What the fold before the last has taken up is read no more and may be removed.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def handle(rows: DataFrame, batch_id: int) -> None:
        arrived = rows.filter(F.col(key).isNotNull()).withColumn("arrival", F.lit(batch_id).cast("long"))
        write_batch(latest_by_key(arrived, [key], [modified, "arrival"]), f"{path}/rows", batch_id)
        if (batch_id + 1) % fold_every == 0:
            folds = [b for b in written_batches(spark, f"{path}/folded") if b < batch_id]
            last = folds[-1] if folds else -1
            parts = [f"{path}/rows/batch={b}" for b in range(last + 1, batch_id + 1)] + [f"{path}/folded/batch={last}"] * bool(folds)
            whole = spark.read.schema(f"{schema}, arrival long").parquet(*parts)
            write_batch(latest_by_key(whole, [key], [modified, "arrival"]), f"{path}/folded", batch_id)

    run_available(stream, handle, f"{path}/checkpoint")


def detect_sellouts(stream: DataFrame, path: str) -> None:
    """Emit sell-outs; the state is the last tick of each product.

    A tick older than its product's remembered tick is compared in time order
    within its batch, as a poller would see it.
    """
    spark = stream.sparkSession

    def handle(rows: DataFrame, batch_id: int) -> None:
        state = read_batch(spark, f"{path}/state", batch_id - 1)
        fresh = rows.select("product_id", "ts", "id", "stock").withColumn("carried", F.lit(False))
        ticks = fresh if state is None else fresh.unionByName(state.withColumn("carried", F.lit(True)))
        fired = sellouts(ticks.drop("carried"))
        new_ids = fresh.select("product_id", "id")
        write_batch(fired.join(new_ids, ["product_id", "id"], "left_semi"), f"{path}/events", batch_id)
        last = latest_by_key(ticks.drop("carried"), ["product_id"], ["ts", "id"])
        write_batch(last, f"{path}/state", batch_id)

    run_available(stream, handle, f"{path}/checkpoint")


def detect_milestones(stream: DataFrame, path: str, thresholds: tuple[int, ...] = MILESTONES) -> None:
    """Emit daily order-count milestones, one look per micro-batch.

    The state is one count per market and day; a batch is reduced to such
    counts before it meets the state.
    """
    spark = stream.sparkSession
    key = ["market", "local_date"]

    def handle(rows: DataFrame, batch_id: int) -> None:
        state = read_batch(spark, f"{path}/state", batch_id - 1)
        new = rows.groupBy(*key).agg(F.count("*").alias("n"))
        if state is None:
            state = new.limit(0)
        seen = state.withColumn("tick", F.lit(0))
        now = state.unionByName(new).groupBy(*key).agg(F.sum("n").alias("n"))
        ticks = seen.unionByName(now.withColumn("tick", F.lit(1)))
        write_batch(milestone_ticks(ticks, thresholds).select(*key, "threshold", "n"), f"{path}/events", batch_id)
        write_batch(now, f"{path}/state", batch_id)

    run_available(stream, handle, f"{path}/checkpoint")


def detect_order_milestones(stream: DataFrame, path: str, thresholds: tuple[int, ...] = MILESTONES, grace_days: int = 1) -> int:
    """Emit daily order-count milestones of distinct orders; returns the late rows, which are left to the re-sweep.

    stream: market, local_date, id and more.  An order that is delivered again doesn't count again: ids are remembered as
    keyed state until their day has ended and grace_days more have been seen, and then forgotten.  The
    state is keyed by id within the day, so the orders of a hot day are spread over all state partitions.  Counts per
    market and open day are a small table per batch.  Rows without an id or a date are no orders.
    """
    spark = stream.sparkSession
    key = ["market", "local_date"]
    days = stream.filter(F.col("id").isNotNull() & F.col("local_date").isNotNull()).select(
        *key, "id", F.date_add("local_date", 1).cast("timestamp").alias("day_end"))
    once = days.withWatermark("day_end", f"{grace_days} days").dropDuplicates([*key, "id", "day_end"])

    def handle(rows: DataFrame, batch_id: int) -> None:
        state = read_batch(spark, f"{path}/state", batch_id - 1)
        # Stored first, so that the remembered ids are gone through once a batch.
        write_batch(rows.groupBy(*key).agg(F.count("*").alias("n")), f"{path}/new", batch_id)
        new = read_batch(spark, f"{path}/new", batch_id)
        if state is None:
            state = new.limit(0)
        now = state.unionByName(new).groupBy(*key).agg(F.sum("n").alias("n"))
        ticks = state.withColumn("tick", F.lit(0)).unionByName(now.withColumn("tick", F.lit(1)))
        write_batch(milestone_ticks(ticks, thresholds).select(*key, "prev", "n", "threshold"), f"{path}/events", batch_id)
        # Days that the watermark has closed get no more orders.
        newest = now.agg(F.max("local_date").alias("newest"))
        open_days = now.join(F.broadcast(newest), F.col("local_date") >= F.date_sub("newest", grace_days)).drop("newest")
        write_batch(open_days, f"{path}/state", batch_id)

    return run_available(once, handle, f"{path}/checkpoint")


def dedupe_pages(stream: DataFrame, key: str = "id", late: str = "1 day") -> DataFrame:
    """Drop repeats of an id across overlapping pages, first copy wins.

    The watermark on ``at`` only bounds the remembered ids; rows later than
    that are left to the re-sweep.
    """
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame) -> DataFrame:
    """Orders per market and event-time hour of a stream with a watermark on ``at``."""
    return (
        stream.groupBy("market", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("orders"))
        .select("market", F.col("w.start").alias("hour_start"), "orders")
    )


def append_available(stream: DataFrame, path: str) -> int:
    """Append what everything in the source gives to path/rows; returns the rows that came after the watermark.

    Rows are written once, whatever is retried.  A window is written when the watermark has passed its end.
    """
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return late_rows(query)


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
