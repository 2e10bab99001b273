"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  All are runtime settings, so they can be
# applied to a session somebody else built.
JOB_CONF = {
    # Dates are cut from instants in a named zone; the session zone must not leak in.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Split a hot join key even when the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A task takes about this much of a scan or a shuffle, however large the tables and whatever number
    # of shuffle partitions the cluster sets: its memory doesn't grow with the input.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    # Keys in order take an eighth of their size in files: a table is broadcast by the size of its rows.
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # Late rows are counted over all batches of a run.
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
    # The JVM does not compile methods over 8000 bytes: a stage that grows past
    # that is faster as several smaller ones than as one interpreted loop.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(cpus: str | int = "*", app: str = "tallybook", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    shuffle = "8" if cpus == "*" else str(max(int(cpus), 1))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", shuffle)
    )
    for key, value in {**JOB_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallybook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
