"""Fact tables as folders by market and month, so that reports read only the months they show."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import calendar

#: Rows of a file about; a market's month of more is dealt over several tasks and files.
FILE_ROWS = 1_000_000


def write_by_month(rows: DataFrame, path: str, date: str = "local_date", file_rows: int = FILE_ROWS) -> None:
    """Write rows under market=/ym=; only the folders that the rows touch are replaced.

    Rows are counted by folder first, so a hot market and month becomes as many tasks as it needs and a cold one a single file.
    Rows without a date go to the folder of a null month.
    """
    dated = rows.withColumn("ym", calendar.month_of(F.col(date)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sizes = dated.groupBy(F.col("market").alias("_m"), F.col("ym").alias("_y")).agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_pieces"))
    same = F.col("market").eqNullSafe(F.col("_m")) & F.col("ym").eqNullSafe(F.col("_y"))
    piece = F.pmod(F.xxhash64(*rows.columns), F.col("_pieces"))
    # One row per folder: markets times months.
    placed = dated.join(F.broadcast(sizes), same).withColumn("_piece", piece).drop("_m", "_y", "_pieces")
    dealt = placed.repartition(parts, "market", "ym", "_piece").drop("_piece")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "ym").parquet(path)


def read_by_month(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table with its columns, ``market`` and ``ym`` last; a filter on these reads only their folders."""
    return spark.read.schema(f"{schema}, market string, ym string").parquet(path)


def month_axis(spark: SparkSession, as_of: dt.date, months: int) -> DataFrame:
    """idx, ym: the months of the window, oldest first, out of all months of a century.

    Joined with a table by month it prunes folders while the query runs.
    """
    first = calendar.month_start(as_of, months - 1)
    return (
        spark.range(1200).select(F.expr("add_months(DATE '1970-01-01', CAST(id AS INT))").alias("d"))
        .filter(F.col("d").between(F.lit(first), F.lit(as_of)))
        .select(F.floor(F.months_between("d", F.lit(first))).alias("idx"), F.date_format("d", "yyyy-MM").alias("ym"))
    )


def in_months(rows: DataFrame, axis: DataFrame) -> DataFrame:
    """rows of the axis's months, with idx; the axis is a handful of rows."""
    return rows.join(F.broadcast(axis), "ym")


def since(rows: DataFrame, floor: dt.date, date: str = "local_date") -> DataFrame:
    """rows from a date on; the folders of earlier months aren't read."""
    return rows.filter((F.col("ym") >= f"{floor:%Y-%m}") & (F.col(date) >= F.lit(floor)))
