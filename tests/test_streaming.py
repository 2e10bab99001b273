"""Streams against batch, over several micro-batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.catalog import streams
from tallybook.operators import incremental
from tallybook.streaming import jobs, tables
from tallybook.testviews import Inputs


def spread(df, path, column, parts):
    """Write rows as one file per value of column, oldest file first."""
    for value in parts:
        df.filter(F.col(column) == value).drop(column).coalesce(1).write.mode("append").parquet(path)


def test_upsert_over_batches(spark, tmp_path):
    path = str(tmp_path)
    schema = "id long, status string, modified string"
    batches = [[(1, "new", "2026-01-01"), (2, "new", "2026-01-01")], [(1, "paid", "2026-01-03"), (3, "new", "2026-01-03")], [(1, "late", "2026-01-02"), (2, "paid", "2026-01-04")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        jobs.upsert_orders(jobs.read_files(spark, f"{path}/in", schema), f"{path}/out", order="modified")
    # Run once more without new files: nothing changes.
    jobs.upsert_orders(jobs.read_files(spark, f"{path}/in", schema), f"{path}/out", order="modified")
    rows = tables.read_latest(spark, f"{path}/out/rows", schema, ["id"], ["modified"]).orderBy("id").collect()
    # The late copy of order 1 is older than what is stored, so it does not win.
    assert [tuple(r) for r in rows] == [(1, "paid", "2026-01-03"), (2, "paid", "2026-01-04"), (3, "new", "2026-01-03")]


def test_retried_batch_does_not_double(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, status string")
    for _ in range(2):
        tables.write_batch(rows, str(tmp_path), 0)
    assert tables.read_all(spark, str(tmp_path), "id long, status string").count() == 1


def ticks_of(spark, sf_dir):
    return Inputs(spark, sf_dir)("events").selectExpr(
        "event_id AS id", "ts", "user_id % 20 AS product_id", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 6 END AS stock")


def test_sellouts_stream_equals_batch_and_plain_lag(spark, sf_dir, tmp_path):
    ticks = ticks_of(spark, sf_dir)
    prev, expected = {}, set()
    for r in ticks.orderBy("ts", "id").collect():
        if r["stock"] == 0 and (prev.get(r["product_id"]) or 0) > 0:
            expected.add(r["id"])
        prev[r["product_id"]] = r["stock"]
    for block in ("minute", "hour", "day"):
        assert {r["id"] for r in incremental.sellouts(ticks, block).collect()} == expected
    days = ticks.withColumn("part", F.weekofyear("ts"))
    spread(days, f"{tmp_path}/in", "part", sorted(r[0] for r in days.select("part").distinct().collect()))
    stream = jobs.read_files(spark, f"{tmp_path}/in", ticks.schema, files_per_batch=1)
    jobs.detect_sellouts(stream, f"{tmp_path}/out")
    events = tables.read_all(spark, f"{tmp_path}/out/events", "product_id long, ts timestamp_ntz, id long")
    assert events.select("batch").distinct().count() > 1
    assert sorted(r["id"] for r in events.collect()) == sorted(expected)


def test_milestones_stream_equals_batch(spark, sf_dir, tmp_path):
    orders = Inputs(spark, sf_dir)("f_store_orders").withColumns({"market": F.lit("AU"), "local_date": F.trunc("local_date", "year")})
    steps = (5, 50, 60, 150)
    batch = incremental.milestone_ticks(incremental.hourly_ticks(orders), steps)
    expected = sorted((r["local_date"], r["threshold"], r["n"]) for r in batch.collect())
    assert expected
    rows = orders.select("market", "local_date", F.substring("date_created", 12, 2).cast("int").alias("hour"))
    spread(rows, f"{tmp_path}/in", "hour", range(24))
    stream = jobs.read_files(spark, f"{tmp_path}/in", "market string, local_date date", files_per_batch=1)
    jobs.detect_milestones(stream, f"{tmp_path}/out", steps)
    got = tables.read_all(spark, f"{tmp_path}/out/events", "market string, local_date date, threshold long, n long")
    assert sorted((r["local_date"], r["threshold"], r["n"]) for r in got.collect()) == expected


def test_milestone_rules(spark):
    def fired(counts):
        rows = [("AU", dt.date(2026, 1, 1), i, n) for i, n in enumerate(counts)]
        out = incremental.milestone_ticks(spark.createDataFrame(rows, "market string, local_date date, tick int, n long"))
        return [(r["tick"], r["threshold"]) for r in out.orderBy("tick").collect()]

    assert fired([10, 499, 500, 900]) == [(2, 500)]
    assert fired([700, 800, 1200]) == [(2, 1000)]
    assert fired([10, 1600, 1800, 1900]) == [(1, 1500), (2, 1733)]


def test_hourly_counts_and_page_dedupe(spark, tmp_path):
    schema = "id long, market string, at timestamp"
    at = dt.datetime(2026, 1, 1, 10)
    pages = [[(1, "AU", at), (2, "AU", at.replace(minute=40))], [(2, "AU", at.replace(minute=40)), (3, "AU", at.replace(hour=11))], [(9, "AU", at.replace(hour=20))]]
    for rows in pages:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.dedupe_pages(jobs.read_files(spark, f"{tmp_path}/in", schema, files_per_batch=1), late="1 hour")
    query = (
        jobs.hourly_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["hour_start"].hour, r["orders"]) for r in rows)[:2] == [(10, 2), (11, 1)]


ORDERS = "market string, local_date date, id long"


def deliver(spark, path, rows):
    spark.createDataFrame(rows, ORDERS).coalesce(1).write.mode("append").parquet(path)


def run_milestones(spark, path, steps=(3, 5, 100), grace=1):
    stream = jobs.read_files(spark, f"{path}/in", ORDERS, files_per_batch=1)
    late = jobs.detect_order_milestones(stream, f"{path}/out", steps, grace)
    rows = tables.read_all(spark, f"{path}/out/events", "market string, local_date date, prev long, n long, threshold long").collect()
    return late, sorted((r["market"], r["local_date"].day, r["prev"], r["n"], r["threshold"]) for r in rows)


def test_orders_delivered_again_count_once_over_a_restart(spark, tmp_path):
    day = dt.date(2026, 1, 1)
    deliver(spark, f"{tmp_path}/in", [("AU", day, i) for i in (1, 2, 2, 2)] + [("US", day, 1), ("US", day, None)])
    deliver(spark, f"{tmp_path}/in", [("AU", day, i) for i in (1, 2, 1)])
    assert run_milestones(spark, tmp_path) == (0, [])
    # Started again from its checkpoint: what was delivered before still doesn't count.
    deliver(spark, f"{tmp_path}/in", [("AU", day, i) for i in (1, 2, 3)])
    assert run_milestones(spark, tmp_path) == (0, [("AU", 1, 2, 3, 3)])
    deliver(spark, f"{tmp_path}/in", [("AU", day, i) for i in range(1, 120)] + [("US", day, i) for i in range(40)])
    assert run_milestones(spark, tmp_path) == (0, [("AU", 1, 2, 3, 3), ("AU", 1, 3, 119, 100), ("US", 1, 1, 40, 5)])
    # Nothing new: nothing happens.
    assert run_milestones(spark, tmp_path)[1][-1] == ("US", 1, 1, 40, 5)


def test_days_are_forgotten_when_they_have_ended(spark, tmp_path):
    day = dt.date(2026, 1, 1)
    for n in range(4):
        deliver(spark, f"{tmp_path}/in", [("AU", day + dt.timedelta(days=3 * n), i) for i in range(2)])
    run_milestones(spark, tmp_path)
    deliver(spark, f"{tmp_path}/in", [("AU", day, i) for i in range(9)])
    late, events = run_milestones(spark, tmp_path)
    assert late == 9 and events == []
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out/state").iterdir() if "=" in p.name)
    kept = tables.read_batch(spark, f"{tmp_path}/out/state", last).collect()
    assert [r["local_date"].day for r in kept] == [10]


def test_deliveries_of_many_files(spark):
    class Given:
        def __call__(self, name):
            return spark.range(0, 400, 1, 4).select("id", F.lit("AU").alias("market"), F.lit("new").alias("status"), F.lit("2026-01-01T10:00:00").alias("date_created"))

    given = Given()
    given.spark = spark
    got = streams.stream_order_versions(given)
    # Five deliveries are five batches, though each came as four files.
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert folders == {"batch=3", "batch=4"}
    landed = f"{got.inputFiles()[0].split('stream-versions-')[0]}stream-versions-{got.inputFiles()[0].split('stream-versions-')[1].split('/')[0]}/in"
    assert len(spark.read.parquet(landed).inputFiles()) == 20
    status = {r["id"]: r["status"] for r in got.collect()}
    assert len(status) == 400 and (status[1], status[4], status[6], status[8], status[20]) == ("new", "refunded", "on-hold", "refunded", "late")


def test_versions_over_folds_and_a_restart(spark, tmp_path):
    schema = "id long, status string, date_modified string"
    batches = [
        [(1, "new", "2026-01-01"), (2, "new", "2026-01-01")], [(1, "paid", "2026-01-03"), (None, "lost", "2026-01-01")], [(1, "late copy", "2026-01-02"), (2, "tied", "2026-01-01")],
        [(3, "new", None)], [(3, "dated", "2026-01-01"), (1, "tied again", "2026-01-03")], [(2, "old", "2025-01-01")], [(4, "x", "2026-01-01")],
    ]
    want = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.upsert_versions(jobs.read_files(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", fold_every=3)
        for i, status, modified in rows:
            if i is not None and (i not in want or (modified or "") >= (want[i][1] or "")):
                want[i] = (status, modified)
        got = tables.read_versions(spark, f"{tmp_path}/out", schema, "id", "date_modified")
        assert {r["id"]: (r["status"], r["date_modified"]) for r in got.collect()} == want
        assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= 3
    assert tables.written_batches(spark, f"{tmp_path}/out/folded") == [2, 5]
    assert tables.read_versions(spark, f"{tmp_path}/none", schema, "id", "date_modified").count() == 0
