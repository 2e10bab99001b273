"""Labelled documents to learn from: a bounded sample, never one of the held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most rows[label] documents of each label, with whole texts.

    With most_bytes, each label's documents end where their texts together would hold more.

    The rows are those of the smallest hash, so the choice is the same in every run.  What is
    broadcast is the chosen ids, which the bound limits.  A document labelled twice counts with its larger label.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(*rows) & ~held_out(F.col("doc_id")))
    )
    chosen = None
    for value, most in rows.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if most_bytes is not None:
        sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
        # At most as many narrow rows as `rows` allows.
        along = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        chosen = sizes.withColumn("so_far", F.sum("bytes").over(along)).where(F.col("so_far") <= most_bytes).select("doc_id", "label")
    return texts.join(F.broadcast(chosen), "doc_id")
