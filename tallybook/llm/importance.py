"""Importance resampling towards a target text: array-scored weights, a cutoff by bisection, ranks by ranges.

Features are hashed to buckets and counted in the documents and in the target.  A document's
weight is the mean gain of its features, summed over an array with the gains as a literal.  Gumbel noise from a
hash of the id turns a draw without replacement into "the highest scores".  The cutoff is found by counts
over the stored scores: first of the score, then of the doc_id among rows of that score.  What is above it is range
partitioned for its ranks.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import stored, table

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Gains and scores are whole numbers of this many steps a unit.
STEPS = 1000
#: Thresholds that one count job looks at: it leaves a part in CUTS + 1 of the interval.
CUTS = 15
#: A null doc_id counts as the largest in ties.
LAST_ID = 2**63 - 1


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def buckets(word: Column, longest: int, size: int) -> Column:
    """array<int>: the bucket of every run of 1 to `longest` words, repeats included."""

    def hashed(run: Column) -> Column:
        return F.pmod(F.crc32(run.cast("binary")), F.lit(size)).cast("int")

    def runs_of(word: Column, n: int) -> Column:
        starts = F.slice(word, F.lit(1), F.greatest(F.size(word) - n + 1, F.lit(0)))
        return F.transform(starts, lambda w, i: hashed(F.concat_ws(" ", w, *[F.get(word, i + k) for k in range(1, n)])))

    def all_runs(word: Column) -> Column:
        return F.concat(F.transform(word, hashed), *[runs_of(word, n) for n in range(2, longest + 1)])

    # The words are named, or they would be looked for again at each run.
    return F.transform(word, hashed) if longest == 1 else F.element_at(F.transform(F.array(word), all_runs), 1)


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, size: int = BUCKETS) -> list[int]:
    """The gain of each bucket: how much commoner its features are in the target, add-one smoothed, in steps, floored.

    The counts cover all rows of both tables; `size` rows come to the driver, whatever the input.
    """

    def counted(frame: DataFrame, name: str) -> DataFrame:
        bucket = F.explode(buckets(words(F.col("text")), longest, size)).alias("bucket")
        return frame.select(bucket).groupBy("bucket").agg(F.count("*").alias(name))

    both = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0)
    rows = stored(both, "bucket-counts")
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    x = F.log(
        (F.col("t") + 1).cast("double") * F.lit(float(all_s + size))
        / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + size)))
    )
    return [r[0] for r in rows.orderBy("bucket").select(F.floor(STEPS * x)).collect()]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from the id, in steps, floored; a null id is hashed as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-STEPS * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score (long), and tie, a hash of the text."""
    gain = F.from_json(F.lit(json.dumps(gains(docs, target, longest, size))), "array<bigint>")
    # The array is made once a row, ahead of what is computed from it.
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"),
    ).select("doc_id", "tie", F.size("w").cast("long").alias("n_words"), buckets(F.col("w"), longest, size).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    summed = found.select("doc_id", "tie", "n_words", F.size("b").cast("long").alias("n_features"), total.alias("total"))
    # Exact floor of the mean: what is left over is taken off before dividing.
    n = F.greatest("n_features", F.lit(1))
    weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
    return summed.withColumn("weight", F.when(F.col("n_features") > 0, weight).otherwise(F.lit(0)).cast("long")).withColumn(
        "score", F.col("weight") + noise(F.col("doc_id"), seed)
    ).drop("total")


def _bisect(rows: DataFrame, value: str, wanted: int) -> tuple[int, int]:
    """(x, n): the largest x with at least `wanted` rows of value >= x, and n, the rows above x.

    wanted is 1 or more and no more than the rows there are.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    # The answer lies in low..high; rows at or above low are enough, those above high are none.
    above = 0
    while low < high:
        step = max(1, -(-(high - low) // (CUTS + 1)))
        cuts = [c for c in range(low + step, high + 1, step)]
        counts = rows.agg(*[F.count_if(F.col(value) >= c) for c in cuts]).first()
        enough = [c for c, n in zip(cuts, counts) if n >= wanted]
        short = [(c, n) for c, n in zip(cuts, counts) if n < wanted]
        low = max(enough, default=low)
        if short:
            high, above = short[0][0] - 1, short[0][1]
    return low, above


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST_RUN, size: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (from 1; null where the row isn't drawn).

    Drawn are floor(percent * N / 100) of the N rows with at least `least_words` words: the highest scores, ties to
    the smaller doc_id.  Null texts have no words, weight 0 and are not drawn unless least_words is 0.  A
    null doc_id loses ties.  Rows that repeat an id are rows of their own: they tie, and their
    number of features, then a hash of their text decides.  Empty tables give empty results; an empty target gains
    nothing it doesn't lose elsewhere.  Columns other than doc_id and text are not read.

    What comes to the driver: `size` gains, CUTS counts a job and one number per range.
    """
    rows = stored(scored(docs, target, longest, size, seed).withColumn("id_key", F.coalesce("doc_id", F.lit(LAST_ID))), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    score, above = _bisect(able, "score", wanted)
    # Smaller ids come first, so their negatives are bisected.
    tied = able.where(F.col("score") == score).select((-F.col("id_key")).alias("id_key"))
    last_id = -_bisect(tied, "id_key", wanted - above)[0]
    near = (F.col("n_words") >= least_words) & (
        (F.col("score") > score) | ((F.col("score") == score) & (F.col("id_key") <= last_id))
    )
    # Rows that repeat the last id may be more than are wanted: their places decide.
    placed = ranked(rows.where(near), F.col("score").desc(), "id_key", "n_features", "tie", position="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*out, "rank").unionByName(rest.select(*out, "rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: DuckDB has no CRC-32: one step a byte over the table of its 256 remainders, once for each distinct word.
OP11_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
found AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
aimed AS (SELECT regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
doc_words AS (SELECT doc_id, unnest(w) AS word FROM found),
target_words AS (SELECT unnest(w) AS word FROM aimed),
known AS (SELECT DISTINCT word FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM target_words)),
coded AS (
  SELECT word, (xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, strlen(word) + 1), lambda k: ('0x' || substr(hex(encode(word)), 2 * k - 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS}) AS bucket FROM known, crc),
s_counts AS (SELECT bucket, count(*) AS s FROM doc_words JOIN coded USING (word) GROUP BY 1),
t_counts AS (SELECT bucket, count(*) AS t FROM target_words JOIN coded USING (word) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s_counts) AS big_s, (SELECT coalesce(sum(t), 0) FROM t_counts) AS big_t),
gain AS (
  SELECT bucket, floor({STEPS} * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + {BUCKETS})::DOUBLE
         / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM s_counts FULL JOIN t_counts USING (bucket), sums),
totals AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM doc_words JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY 1),
weights AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE ((total - ((total % n) + n) % n) // n) END::BIGINT AS weight,
         ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN totals USING (doc_id)),
scores AS (SELECT *, weight + floor(-{STEPS} * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weights),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS big_n
  FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * big_n // 100 THEN place END::BIGINT AS rank
FROM scores LEFT JOIN places USING (doc_id)
"""
