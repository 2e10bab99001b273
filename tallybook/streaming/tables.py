"""Batch-numbered folders: the state and output of the streaming jobs.

Each micro-batch writes its own folder and a retry overwrites it, so a lost
executor or a restarted query never doubles a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.operators.maintain import latest_by_key


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """One batch's rows, or None before the first batch; a later batch whose state is gone fails."""
    if batch_id < 0:
        return None
    return spark.read.parquet(f"{path}/batch={batch_id}")


def written_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def read_versions(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Newest copy of each key: the highest order, then the latest batch.  Reads the last fold and the batches after it."""
    folds = written_batches(spark, f"{path}/folded")
    last = folds[-1] if folds else -1
    folders = [f"{path}/folded/batch={last}"] if folds else []
    folders += [f"{path}/rows/batch={b}" for b in written_batches(spark, f"{path}/rows") if b > last]
    rows = spark.read.schema(f"{schema}, arrival long")
    rows = rows.parquet(*folders) if folders else spark.createDataFrame([], f"{schema}, arrival long")
    return latest_by_key(rows, [key], [order, "arrival"])


def read_all(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of every batch with their batch number."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def read_latest(spark: SparkSession, path: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    """Current table: the newest copy of each key, by order and then by batch."""
    return latest_by_key(read_all(spark, path, schema), keys, [*order, "batch"]).drop("batch")


def late_rows(query) -> int:
    """Rows that a finished query's stateful operators dropped for coming after the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_available(stream: DataFrame, handle, checkpoint: str) -> int:
    """Feed everything the source holds through ``handle(rows, batch_id)``; returns the late rows that were dropped."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return late_rows(query)
