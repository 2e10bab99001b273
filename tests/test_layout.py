"""Tables by market and month: what is read, what is replaced, and how a hot month is dealt."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallybook.operators import maintain
from tallybook.plans import store
from tallybook.sources import layout

SCHEMA = "id long, status string, local_date date, total decimal(18,2)"


@pytest.fixture
def table(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(3000).select(
        i, F.lit("completed").alias("status"), F.when(i % 3 == 0, F.lit(dt.date(2026, 6, 5))).otherwise(F.date_sub(F.lit(dt.date(2026, 6, 30)), (i % 700).cast("int"))).alias("local_date"),
        F.lit(2).cast("decimal(18,2)").alias("total"), F.when(i % 2 == 0, "AU").otherwise("CA").alias("market"))
    layout.write_by_month(rows, f"{tmp_path}/t", file_rows=100)
    return rows, f"{tmp_path}/t"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def spoil(path, month):
    """A folder that can't be read: a query that succeeds hasn't touched it."""
    for market in ("AU", "CA"):
        with open(f"{path}/market={market}/ym={month}/part-bad.parquet", "w") as f:
            f.write("no parquet")


def test_six_months_read_six_months(spark, table):
    rows, path = table
    as_of = dt.date(2026, 6, 30)
    axis = layout.month_axis(spark, as_of, 6)
    assert [tuple(r) for r in axis.orderBy("idx").collect()] == [(n, f"2026-0{n + 1}") for n in range(6)]
    spoil(path, "2025-12")
    read = layout.in_months(store.countable(layout.read_by_month(spark, path, SCHEMA)), axis)
    out = store.monthly(read.drop("idx", "ym"), as_of, 6)
    want = store.monthly(store.countable(rows), as_of, 6)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "dynamicpruningexpression(ym" in plan(out)
    since = layout.since(layout.read_by_month(spark, path, SCHEMA), dt.date(2026, 2, 10)).filter("market = 'AU'")
    text = plan(since)
    assert re.search(r"PartitionFilters: \[[^\]]*market[^\]]*ym[^\]]*>= 2026-02", text)
    assert since.count() == rows.filter("market = 'AU' and local_date >= date '2026-02-10'").count()
    with pytest.raises(Exception, match="part-bad"):
        layout.read_by_month(spark, path, SCHEMA).count()


def test_only_touched_months_are_replaced_and_a_hot_one_is_split(spark, table, tmp_path):
    rows, path = table
    hot = list((tmp_path / "t/market=AU/ym=2026-06").glob("*.parquet"))
    assert len(hot) >= 3 and len(list((tmp_path / "t/market=AU/ym=2024-12").glob("*.parquet"))) == 1
    before = layout.read_by_month(spark, path, SCHEMA)
    assert before.count() == 3000
    new = rows.filter("market = 'AU' and id < 10 and local_date >= date '2026-06-01'")
    layout.write_by_month(new, path)
    after = layout.read_by_month(spark, path, SCHEMA)
    gone = rows.filter("market = 'AU' and local_date >= date '2026-06-01'").count()
    assert after.count() == 3000 - gone + new.count()
    layout.write_by_month(rows.limit(0), path)
    assert layout.read_by_month(spark, path, SCHEMA).count() == after.count()


def test_batches_are_left_out_without_moving_lines(spark):
    i = F.col("id")
    lines = spark.range(20_000).select(
        F.when(i % 3 == 0, 1).otherwise(i % 50).cast("long").alias("report_job_id"), F.lit("AU").alias("market"), F.concat(F.lit("r"), (i % 5).cast("string")).alias("range_label"),
        F.when(i % 2 == 0, i.cast("string")).alias("shipment_item_id"), i.alias("quantity"))
    jobs = spark.range(50).select(i, F.lit("AU").alias("market"), F.lit("r1").alias("range_label"), F.lit("ingested").alias("status"))
    doomed = jobs.filter("id < 2")
    for out in (maintain.in_batches(lines, doomed), maintain.cascade_delete(jobs, lines, doomed, "id", "report_job_id")[1], maintain.superseded(lines, jobs), maintain.dedupe_superseded(lines, jobs)[0]):
        assert not re.search(r"hashpartitioning\(report_job_id", plan(out))
    kept = lines.filter("report_job_id >= 2").count()
    assert maintain.cascade_delete(jobs, lines, doomed, "id", "report_job_id")[1].count() == kept
    # Beyond the bound the set is joined by a shuffle, with the same rows.
    assert lines.join(maintain.members(doomed.select(i.alias("report_job_id")), 1), "report_job_id", "left_anti").count() == kept
    landed = maintain.supersede_ranges(lines.filter("report_job_id < 25"), lines.filter("report_job_id >= 25"))
    assert not re.search(r"hashpartitioning\((range_label|market#\d+, range_label)", re.sub(r"#\d+L?", "", plan(landed).split("Aggregate")[0]))
    newest = lines.filter("report_job_id >= 25").groupBy("range_label").agg(F.max("report_job_id").alias("m"))
    want = lines.join(newest, "range_label").filter("report_job_id = m").count()
    assert landed.count() == want
