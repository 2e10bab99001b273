"""Event-time streams: files that arrive one after the other, with repeats and late rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.catalog.base import query
from tallybook.session import work_dir
from tallybook.streaming import jobs as streams
from tallybook.streaming import tables

ORDER = "market string, local_date date, id long, hour int, status string"
STEPS = (2, 3, 5, 8, 13)
#: Where a file of orders ends and the next begins, and the looks at a day.
CUTS = (dt.date(1994, 7, 1), dt.date(1997, 1, 1), dt.date(1999, 7, 1))
LOOKS = 3
#: A file is read in blocks of this size, each by any task.
BLOCK_BYTES = 8 << 20
#: A look brings all days of a stretch, so days stay open as long.
STRETCH_DAYS = 2000


def _orders(v):
    return v("f_store_orders").select("market", "local_date", "id", F.substring("date_created", 12, 2).cast("int").alias("hour"), "status")


def _arrive(rows, path):
    """One more file; the file source takes files in the order they were written."""
    rows.coalesce(1).write.mode("append").option("parquet.block.size", BLOCK_BYTES).parquet(path)


def _arrive_in_parts(rows, path):
    """One more delivery, of any number of files."""
    rows.write.mode("append").option("parquet.block.size", BLOCK_BYTES).parquet(path)


def _looks(v, path):
    """Two stretches of days, each looked at three times; a look brings a third of the hours, and half of what was there again."""
    orders = _orders(v)
    span = 24 // LOOKS
    for days in (orders.filter(F.col("local_date") < F.lit(CUTS[1])), orders.filter(F.col("local_date") >= F.lit(CUTS[1]))):
        for look in range(LOOKS):
            now = F.floor(F.col("hour") / span) == look
            again = (F.col("hour") < look * span) & (F.col("id") % 2 == 0)
            twice = F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 10 == 0, 2).otherwise(1)))
            _arrive(days.filter(now | again).select("*", twice.alias("copy")).drop("copy"), path)


@query("milestone_stream", f"""
WITH h AS (SELECT market, local_date, CAST(substr(date_created, 12, 2) AS BIGINT) // {24 // LOOKS} AS look, count(DISTINCT id) AS c FROM f_store_orders GROUP BY 1, 2, 3),
n AS (SELECT market, local_date, look, sum(c) OVER w AS n, sum(c) OVER w - c AS prev FROM h WINDOW w AS (PARTITION BY market, local_date ORDER BY look)),
x AS (SELECT *, CASE {' '.join(f'WHEN prev < {t} AND n >= {t} THEN {t}' for t in reversed(STEPS))} END AS threshold FROM n WHERE prev > 0)
SELECT market, CAST(local_date AS VARCHAR) AS local_date, CAST(prev AS BIGINT) AS prev, CAST(n AS BIGINT) AS n, CAST(threshold AS BIGINT) AS threshold FROM x WHERE threshold IS NOT NULL""")
def milestone_stream(v):
    path = work_dir(v.spark, "stream-milestones")
    _looks(v, f"{path}/in")
    streams.detect_order_milestones(streams.read_files(v.spark, f"{path}/in", ORDER, files_per_batch=1), path, STEPS, STRETCH_DAYS)
    return tables.read_all(v.spark, f"{path}/events", "market string, local_date date, prev long, n long, threshold long").drop("batch")


DELAY_MINUTES = 36 * 60 + 10


def _pages(v, path):
    """Four pages by time.  Of a page's last day some rows come, and some come again, with the next; a few rows of all days come two pages late."""
    orders = _orders(v)
    page = F.lit(0)
    for n, cut in enumerate(CUTS):
        page = F.when(F.col("local_date") >= F.lit(cut), n + 1).otherwise(page)
    last_day = F.date_add("local_date", 1).isin(*[F.lit(c) for c in CUTS])
    id_ = F.col("id")
    own = F.when((page + 2 <= len(CUTS)) & (id_ % 101 == 0), page + 2).when(last_day & (id_ % 7 == 0), page + 1).otherwise(page)
    at = F.timestamp_add("MINUTE", F.col("hour") * 60 + 30, F.col("local_date").cast("timestamp"))
    dealt = orders.select("market", "id", "status", at.alias("at"), own.alias("page"), (last_day & (id_ % 5 == 0) & (own == page)).alias("again"))
    for n in range(len(CUTS) + 1):
        first = dealt.filter(F.col("page") == n).drop("page", "again")
        if n:
            repeats = dealt.filter((F.col("page") == n - 1) & F.col("again")).drop("page", "again").withColumn("status", F.lit("LATER"))
            first = first.unionByName(repeats)
        _arrive(first, path)


PAGE = "market string, id long, status string, at timestamp"
_CUTS_SQL = ", ".join(f"DATE '{c}'" for c in CUTS)
# What a page brings, and what comes too late for the stream: rows are held against the newest time of the pages before the last one.
_TAKEN = f"""
WITH o AS (SELECT market, id, status, CAST(left(date_created, 19) AS TIMESTAMP) AS came, len(list_filter([{_CUTS_SQL}], lambda c: c <= local_date)) AS stretch,
 list_contains([{_CUTS_SQL}], CAST(local_date + 1 AS DATE)) AS last_day FROM f_store_orders),
d AS (SELECT *, CASE WHEN stretch + 2 <= {len(CUTS)} AND id % 101 = 0 THEN stretch + 2 WHEN last_day AND id % 7 = 0 THEN stretch + 1 ELSE stretch END AS page FROM o),
m AS (SELECT page + 2 AS page, max(x) OVER (ORDER BY page) - INTERVAL {DELAY_MINUTES} MINUTE AS mark FROM (SELECT page, max(came) AS x FROM d GROUP BY page)),
t AS (SELECT d.*, coalesce(came <= mark, FALSE) AS late FROM d LEFT JOIN m USING (page))
"""


@query("boundary_dedupe_stream", f"{_TAKEN} SELECT id, status, market FROM t WHERE NOT late UNION ALL SELECT NULL, 'rows left to the re-sweep: ' || count(*), NULL FROM t WHERE late")
def boundary_dedupe_stream(v):
    path = work_dir(v.spark, "stream-pages")
    _pages(v, f"{path}/in")
    pages = streams.read_files(v.spark, f"{path}/in", PAGE, files_per_batch=1)
    late = streams.append_available(streams.dedupe_pages(pages, late=f"{DELAY_MINUTES} minutes"), path)
    rows = v.spark.read.parquet(f"{path}/rows").select("id", "status", "market")
    return rows.unionByName(v.spark.sql(f"SELECT CAST(NULL AS BIGINT) AS id, 'rows left to the re-sweep: {late}' AS status, CAST(NULL AS STRING) AS market"))


@query("orders_per_hour_stream", f"""{_TAKEN} SELECT market, strftime(date_trunc('hour', came), '%Y-%m-%d %H:%M:%S') AS hour_start, CAST(count(*) AS BIGINT) AS orders FROM t WHERE NOT late GROUP BY 1, 2
UNION ALL SELECT 'left to the re-sweep', NULL, count(*) FROM t WHERE late""")
def orders_per_hour_stream(v):
    path = work_dir(v.spark, "stream-hours")
    _pages(v, f"{path}/in")
    # A heartbeat moves the watermark past the last hours, so that they are written too.
    beat = _orders(v).agg(F.max("local_date").alias("d")).select(
        F.lit("heartbeat").alias("market"), F.lit(-1).cast("long").alias("id"), F.lit("").alias("status"), F.date_add("d", 30).cast("timestamp").alias("at"))
    _arrive(beat, f"{path}/in")
    pages = streams.read_files(v.spark, f"{path}/in", PAGE, files_per_batch=1)
    late = streams.append_available(streams.hourly_counts(streams.dedupe_pages(pages, late=f"{DELAY_MINUTES} minutes")), path)
    rows = v.spark.read.parquet(f"{path}/rows").filter(F.col("market") != "heartbeat").select("market", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "orders")
    return rows.unionByName(v.spark.sql(f"SELECT 'left to the re-sweep' AS market, CAST(NULL AS STRING) AS hour_start, CAST({late} AS BIGINT) AS orders"))


_VERSION = "id long, market string, status string, date_modified string"


@query("stream_order_versions", """
SELECT id, market, CASE WHEN id % 10 = 0 THEN 'late' WHEN id % 4 = 0 THEN 'refunded' WHEN id % 6 = 0 THEN 'on-hold' ELSE status END AS status,
 CASE WHEN id % 10 = 0 OR id % 4 = 0 THEN substr(date_created, 1, 10) || 'T23:59:59' ELSE date_created END AS date_modified FROM f_store_orders""")
def stream_order_versions(v):
    """Five deliveries, each of many files and landed by a run of its own: all orders, some changed, some as an older copy, some changed on a tied clock, some changed again on a tied clock."""
    path = work_dir(v.spark, "stream-versions")
    orders, k = v("f_store_orders"), F.col("id")
    created, night = F.col("date_created"), F.concat(F.substring("date_created", 1, 10), F.lit("T23:59:59"))
    for which, status, modified in (
        (k >= 0, F.col("status"), created), (k % 4 == 0, F.lit("refunded"), night), (k % 8 == 0, F.lit("stale"), F.lit("1990-01-01T00:00:00")),
        (k % 6 == 0, F.lit("on-hold"), created), (k % 10 == 0, F.lit("late"), night),
    ):
        _arrive_in_parts(orders.filter(which).select("id", "market", status.alias("status"), modified.alias("date_modified")), f"{path}/in")
        streams.upsert_versions(streams.read_files(v.spark, f"{path}/in", _VERSION), path, fold_every=2)
    return tables.read_versions(v.spark, path, _VERSION, "id", "date_modified").drop("arrival")
