"""Run log, cursors and guarded snapshots on files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.maintain import latest_by_key


def append_run_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def run_rows(runs: DataFrame, watermark_before: str) -> DataFrame:
    """One log row per source and market of a finished run."""
    return runs.groupBy("source", "market").agg(
        F.count("*").alias("pages"), F.sum("orders_added").alias("orders_added"), F.sum("items_added").alias("items_added"),
        F.date_format(F.max("run_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("watermark_after"),
        F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("ok").alias("status"),
    ).withColumn("watermark_before", F.lit(watermark_before))


def next_state(state: DataFrame | None, runs: DataFrame, expected: DataFrame, now: str) -> DataFrame:
    """Cursor table after a tick: watermarks move forward only, heartbeats always.

    ``expected`` lists every (source, market) polled, so a poll without rows
    still shows a heartbeat.
    """
    fresh = runs.groupBy("source", "market").agg(F.max("watermark_after").alias("new_mark"))
    out = expected.join(fresh, ["source", "market"], "left")
    if state is None:
        old = F.lit(None).cast("string")
    else:
        out = out.join(state.select("source", "market", "watermark"), ["source", "market"], "left")
        old = F.col("watermark")
    return out.select("source", "market", F.greatest(old, "new_mark").alias("watermark"), F.lit(now).alias("last_synced_at"))


def write_snapshot(new: DataFrame, path: str, version: int) -> bool:
    """Write a snapshot version unless it is empty and an older one exists.

    Versions sit side by side, so a reader of the old one is never cut off.
    """
    if new.isEmpty() and version > 0:
        return False
    new.write.mode("overwrite").parquet(f"{path}/version={version}")
    return True


def read_snapshot(spark, path: str, schema: str) -> DataFrame:
    """Rows of the newest written version."""
    rows = spark.read.schema(f"{schema}, version int").parquet(path)
    newest = rows.agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), "version").drop("version")


__all__ = ["append_run_log", "run_rows", "next_state", "write_snapshot", "read_snapshot", "latest_by_key"]
