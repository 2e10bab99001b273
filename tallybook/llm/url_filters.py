"""URL rules by a sort-merge range join over reversed-host keys.

A host's labels, reversed and joined, form a key under which a host and all its
subdomains are one interval.  Rule boundaries and urls are sorted together and
swept once; the sweep carries the stack of rules whose intervals are open.  The
path part of a rule is tested against the open rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

#: The rules that the registered query applies: host, path, action.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
RULE_SCHEMA = "host string, path string, action string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between labels in a key; CLOSE sorts after every subdomain of a host.
STEP, CLOSE = "\x01", "\x02"
#: Boundaries swept together by one task; more of them are split into ranges.
RANGE_EVENTS = 20_000


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without a ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), STEP)


def rule_events(rules: DataFrame) -> DataFrame:
    """One row per interval boundary: its key and the stack of rules open from there on.

    Intervals of hosts are nested or apart, so what is open after a boundary are the
    rules of the host itself (at its start) and of the hosts above it.
    """
    clean = (
        rules.select(
            F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("path"), F.col("action").alias("action")
        )
        .where("host is not null and host != '' and path is not null and action is not null")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))  # a rule that is given with both actions blocks
    )
    by_host = clean.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "action"))).alias("rules"))
    labels = F.split("host", r"\.")
    above = by_host.select(
        "host",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
            )
        ).alias("step", "over"),
    )
    known = by_host.select(F.col("host").alias("over"), F.explode("rules").alias("r"))
    open_rules = above.join(known, "over").select(
        "host", "step", F.struct(F.col("over").alias("host"), F.col("r.path").alias("path"), F.col("r.action").alias("action")).alias("r")
    )
    stacks = open_rules.groupBy("host").agg(
        F.collect_list("r").alias("inside"),
        F.collect_list(F.when(F.col("step") > 0, F.col("r"))).alias("outside"),
    )
    key = host_key(F.col("host"))
    starts = stacks.select(key.alias("key"), F.col("inside").alias("stack"))
    ends = stacks.select(F.concat(key, F.lit(CLOSE)).alias("key"), F.col("outside").alias("stack"))
    return starts.unionByName(ends)


def range_bounds(events: DataFrame) -> list[str]:
    """Keys that cut the boundaries into ranges of about RANGE_EVENTS; none for a short list."""
    ranges = events.count() // RANGE_EVENTS
    if not ranges:
        return []
    ranges = min(ranges, 1000)
    some = events.select("key").sample(min(1.0, 200 * ranges / (ranges * RANGE_EVENTS)), seed=7)
    keys = sorted({r.key for r in some.collect()})
    return keys[:: max(1, len(keys) // ranges)][1:]


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    rule (host and path together, then the longer host) wins; without one the verdict is
    `otherwise`.  Null urls and urls without a :// have an empty host and path, and no rule.
    Repeated rows stay; empty tables give empty results; other columns are not looked at.
    Urls are dealt by (range, salt), so a host that holds a third of them is shared by all tasks;
    the boundaries of a range, few by construction, go to each salt.
    """
    spark = pages.sparkSession
    events = rule_events(rules)
    bounds = range_bounds(events)
    salts = shuffle_partitions(spark)
    cut = F.lit(0)
    if bounds:
        cut = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("key")))
    urls = pages.select(
        F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("key", host_key(F.col("host")))
    # A range starts at a boundary, or what was open before it is carried in by the boundary last seen.
    marks = events.withColumn("bucket", cut)
    if bounds:
        marks = marks.unionByName(_carried(marks, bounds))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "bucket", "salt", "key", F.lit(0).alias("turn"), "stack",
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    lines = urls.withColumn("bucket", cut).select(
        "bucket", "salt", "key", F.lit(1).alias("turn"), F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"),
        "page_id", "host", "path",
    )
    sweep = Window.partitionBy("bucket", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        lines.unionByName(marks)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("turn = 1")
    )
    fitting = F.filter(
        "open",
        lambda r: F.startswith(F.col("path"), r["path"])
        & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))),
    )
    best = F.array_max(
        F.transform(
            fitting,
            lambda r: F.struct(
                F.length(F.concat(r["host"], r["path"])).alias("size"), F.length(r["host"]).alias("host_size"),
                F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("action"),
            ),
        )
    )
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(otherwise)).alias("verdict"),
    )


def _carried(marks: DataFrame, bounds: list[str]) -> DataFrame:
    """For each range but the first, the stack that is open where it begins."""
    spark = marks.sparkSession
    last = marks.groupBy("bucket").agg(F.max_by("stack", "key").alias("stack"))
    # Before all keys of the range, also before a boundary that begins it.
    starts = spark.createDataFrame([(i + 1, "") for i in range(len(bounds))], "bucket int, key string")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: at most a thousand.
    return (
        starts.join(last, "bucket", "left")
        .unionByName(last.where("bucket = 0").select("bucket", F.lit("").alias("key"), "stack"))
        .withColumn("stack", F.last("stack", ignorenulls=True).over(before))
        .where("bucket > 0")
        .select("key", "stack", "bucket")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), RULE_SCHEMA))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
OP8_SQL = rf"""
WITH rules(rhost, rpath, action) AS (VALUES {_RULE_ROWS}),
urls AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS n FROM pages),
hits AS (
  SELECT n, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (n)
"""
