from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallybook.operators.ranking import ranked, ranked_in_groups


def test_positions_against_a_sort(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "é"]), rng.randrange(9)) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    got = {r["id"]: r["position"] for r in ranked(frame, F.col("v").desc(), "id").collect()}
    assert got == {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    got = {r["id"]: r["position"] for r in ranked_in_groups(frame, "g", "v", "id").collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_ties_are_split_and_counted_once(spark):
    frame = spark.range(5000).repartition(8).select(F.lit(1).alias("v"))
    assert sorted(r["position"] for r in ranked(frame, "v").collect()) == list(range(1, 5001))
    assert ranked(frame.limit(0), "v").count() == 0
    assert ranked_in_groups(frame.limit(0).withColumn("g", F.lit("x")), "g", "v").count() == 0
