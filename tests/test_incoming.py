"""Every open PO of a code is given, not only the first few."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.plans import purchasing


def test_incoming_lists_every_open_po(spark):
    rows = [("AU-X-35", f"PO-{i}", f"2026-01-{i:02}", i) for i in range(1, 8)] + [("AU-X-35", "PO-8", None, 8), ("AU-Y-35", "PO-1", "2026-01-01", 5)]
    units = spark.createDataFrame(rows, "base string, reference string, expected_date string, qty long").withColumn("expected_date", F.to_date("expected_date"))
    got = purchasing.incoming_by_sku(units).withColumn("expected_date", F.col("expected_date").cast("string"))
    assert sorted(map(str, (tuple(r) for r in got.select("base", "reference", "expected_date", "po_qty").collect()))) == sorted(map(str, rows))
    assert {(r["base"], r["qty"], r["pos"], r["next_ref"]) for r in got.collect()} == {("AU-X-35", 36, 8, "PO-1"), ("AU-Y-35", 5, 1, "PO-1")}
    assert {r["refs"] for r in purchasing.incoming_shown(units).collect()} == {"PO-8,PO-7,PO-6", "PO-1"}
