"""Positions in a total order, without one task that sees all rows.

Rows are range partitioned by the order and sorted where they land; partitions are
counted, and the sum of the partitions before is added to a row's place in its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir

#: monotonically_increasing_id() holds a row's place in its partition in its lower bits.
_PLACE = (1 << 33) - 1
#: Groups whose starts are broadcast at most.
BROADCAST_GROUPS = 10_000


def ranked(frame: DataFrame, *order: str | Column, position: str = "position") -> DataFrame:
    """frame with `position`: each row's place in the order, from 1.

    Rows that tie in all of `order` have neighbouring positions; which of them comes first isn't
    defined, so give an order that tells different rows apart.  Rows that tie are split over
    partitions by where they were read, so a third of all rows may tie.  The frame is read twice, once to
    find the ranges.  One number per partition comes to the driver; the rows are stored in the
    shared folder, so that counts and positions come from the same partitions.  An empty frame stays empty.
    """
    spark = frame.sparkSession
    # An order may name columns or expressions of them; both are taken before anything is added.
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tagged = frame.withColumn("_source", F.spark_partition_id())
    placed = (
        tagged.repartitionByRange(parts, *keys, F.col("_source"))
        .sortWithinPartitions(*keys, F.col("_source"))
        .drop("_source")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    )
    path = work_dir(spark, "ranked")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    offsets = F.from_json(F.lit(json.dumps(before)), "array<bigint>")
    return placed.withColumn(position, F.element_at(offsets, F.col("_part") + 1) + F.col("_place") + 1).drop("_part", "_place")


def ranked_in_groups(frame: DataFrame, group: str, *order: str | Column, position: str = "position") -> DataFrame:
    """frame with `position`: each row's place in the order among the rows of its group, from 1.

    Null is a group like others.  A group may hold any share of the rows: the order of all rows is by group first, and a
    group's first position is taken off.  The starts, one row per group, are broadcast only
    where there are at most BROADCAST_GROUPS of them.
    """
    placed = ranked(frame, group, *order, position="_all")
    starts = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_all").alias("_start"))
    few = starts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = placed.join(F.broadcast(starts) if few else starts, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(position, F.col("_all") - F.col("_start") + 1).drop("_all", "_group", "_start")
