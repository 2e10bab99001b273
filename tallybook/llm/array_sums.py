"""A large array of counts, summed over all partitions of a table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

CHUNK = 1 << 14
SCHEMA = "part long, chunk int, counts binary"


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, "<i8").reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").reshape(-1)


def summed(rows: DataFrame, add: Callable[[np.ndarray, list], None], size: int, name: str) -> np.ndarray:
    """The sum over all tasks of the integer array that add(array, values of a batch's only column) fills.

    A task sends its array once, compressed and cut into chunks; the chunks of 32 tasks at a time
    are added until one is left.  `size` is a multiple of CHUNK and does not depend on the input.
    """

    def of_task(batches):
        total = np.zeros(size, np.int64)
        for batch in sliced(batches, 0):
            add(total, batch.column(0))
        part = TaskContext.get().partitionId()
        chunks = [packed(c) for c in total.reshape(-1, CHUNK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())],
            ["part", "chunk", "counts"],
        )

    def of_parts(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for blob in frame["counts"]:
            total += unpacked(blob)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "chunk": [int(frame["chunk"].iloc[0])], "counts": [packed(total)]})

    parts = stored(rows.mapInArrow(of_task, SCHEMA), name)
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / 32)).groupBy("chunk", "part").applyInPandas(of_parts, SCHEMA)
        left = -(-left // 32)
        if left <= 1:
            break
    out = np.zeros(size, np.int64)
    for r in parts.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = unpacked(r["counts"])
    return out
