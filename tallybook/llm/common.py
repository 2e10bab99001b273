"""Reading tables, cutting lineage and sizing, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, and safe if an executor is lost.

    The folder is the cluster's checkpoint folder, whose clean-up rule removes the files after the job.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many partitions as the session shuffles to."""
    return frame.repartition(shuffle_partitions(frame.sparkSession), *[F.col(k) for k in keys])


#: Bytes of text that a task takes apart at a time, whatever the size of a batch; one text is never cut.
SLICE_BYTES = 1 << 22


def sliced(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs whose texts in `column` hold about SLICE_BYTES, so that what is made from them is as small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        starts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
    # A worker lives on after its task: what the task's texts took goes back now.
    pa.default_memory_pool().release_unused()


_shared: list[Broadcast] = []


def shared(spark: SparkSession, value) -> Broadcast:
    """A broadcast that release() takes from the executors."""
    _shared.append(spark.sparkContext.broadcast(value))
    return _shared[-1]


def release(spark: SparkSession) -> None:
    """Frees the executors' copies of all broadcasts so far; a frame that still needs one fetches it again."""
    while _shared:
        old = _shared.pop()
        if old._sc is spark.sparkContext:
            old.unpersist()
