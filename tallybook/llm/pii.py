"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Fixed patterns find seed entities.  The words around the seeds are lexical patterns; tokens
that look like identifiers and stand in the same contexts are instances.  Patterns and
instances are a bipartite graph that is scored in turns: a pattern by the share of its
instances that are seeds or believed, an unseen instance by its patterns.  Instances that
end above the threshold are added as spans; the seeds' spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: The kinds in their order, and what each one looks like.  Runs are possessive and
#: start at a run's first character, or where the last match ended, so no text is scanned twice.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: An identifier-like token has so many characters, and so many digits or an at sign.
TOKEN_CHARS, TOKEN_DIGITS = 8, 4
#: A pattern counts from so many different seeds on; an instance is added from this score on.
SUPPORT, ACCEPT, TURNS = 3, 0.8, 3
#: Characters around a token in which its context words are looked for.
CONTEXT_CHARS = 64
CHUNK = 512

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _named(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lengths: Column, first: Column) -> Column:
    """first, first + l0, first + l0 + l1, ...; the last sum is left out."""
    grown = F.aggregate(lengths, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return _named(grown, lambda g: F.slice(g, 1, F.size(g) - 1))


def _running_long(lengths: Column) -> Column:
    """_running from 0, chunk by chunk, so that an array of n costs n * CHUNK and not n * n."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(CHUNK)), lambda at: F.slice(lengths, at + 1, CHUNK)
    )
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return _named(
        _running(sums, F.lit(0)), lambda firsts: F.flatten(F.zip_with(chunks, firsts, lambda c, first: _running(c, first)))
    )


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, before>> of the matches, in code points; `before` ends where the match starts."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,before:string,after:string>>)")

    def placed(hits: Column) -> Column:
        # A text is split at the very matches that are extracted.
        gaps = F.split(text, pattern, -1)

        def rows(g: Column) -> Column:
            both = F.zip_with(
                F.slice(g, 1, F.size(hits)), hits,
                lambda before, hit: F.struct(before.alias("before"), hit.alias("hit"), F.length(before).alias("b"), F.length(hit).alias("h")),
            )
            return _named(
                both,
                lambda rows_: _named(
                    _running_long(F.transform(rows_, lambda r: r["b"] + r["h"])),
                    lambda at: F.transform(
                        rows_,
                        lambda r, i: F.struct(
                            (F.get(at, i) + r["b"]).cast("int").alias("start"),
                            (F.get(at, i) + r["b"] + r["h"]).cast("int").alias("end"),
                            r["hit"].alias("hit"),
                            F.right(r["before"], F.lit(CONTEXT_CHARS)).alias("before"),
                            F.left(F.get(g, i + 1), F.lit(CONTEXT_CHARS)).alias("after"),
                        ),
                    ),
                ),
            )

        return F.when(F.size(hits) > 0, _named(gaps, rows)).otherwise(none)

    return _named(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc
        + _named(
            F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(hit, r"\."),
            lambda part: _named(
                F.regexp_replace(part, "^0+", ""), lambda p: F.when(F.length(p) > 3, False).otherwise(F.concat(F.lit("0"), p).cast("int") <= 255)
            ),
        )
    if kind == "email":
        return F.lit(True)
    digits = F.translate(hit, "+ ().-", "")
    least, most = (14, 19) if kind == "card" else (10, 15)
    right_size = F.length(digits).between(least, most)
    return _named(digits, lambda d: F.when(F.length(d).between(least, most), _luhn(d)).otherwise(False)) if kind == "card" else right_size


def base_spans(text: Column) -> Column:
    """All valid matches of the four kinds, by start and then kind."""
    empty = F.expr(f"cast(array() as {SPAN})")

    def of(n: int, kind: str) -> Column:
        found = F.transform(
            F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["hit"])),
            lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")),
        )
        return F.when(F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]"), found).otherwise(empty)

    return F.array_sort(F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)]))


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens, with the kind of the base span they touch, or none, and the words around them."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,token:string,kind:int,left:string,left2:string,right:string>>)")
    like = F.filter(
        matches(text, TOKEN),
        lambda m: (F.length(m["hit"]) >= TOKEN_CHARS)
        & (F.contains(m["hit"], F.lit("@")) | (F.length(F.regexp_replace(m["hit"], "[^0-9]", "")) >= TOKEN_DIGITS)),
    )
    rows = F.transform(
        like,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"),
            F.regexp_replace(F.lower(m["hit"]), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("token"),
            F.get(F.filter(base, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])), F.lit(0))["kind"].alias("kind"),
            F.lower(F.regexp_extract(m["before"], r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)).alias("left"),
            F.lower(F.regexp_extract(m["before"], r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)).alias("left2"),
            F.lower(F.regexp_extract(m["after"], r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)).alias("right"),
        ),
    )
    return F.when(text.rlike("[0-9@]"), rows).otherwise(none)


def believed(seen: DataFrame) -> DataFrame:
    """token, kind of unseen instances whose score ends at ACCEPT or above."""
    edges = stored(
        seen.select(
            "token", "kind",
            F.explode(
                F.filter(
                    F.array(
                        F.concat(F.lit("l "), "left"), F.concat(F.lit("ll "), "left2"), F.concat(F.lit("r "), "right")
                    ),
                    lambda p: ~p.isin("l ", "ll ", "r "),
                )
            ).alias("pattern"),
        )
        .groupBy("pattern", "token")
        .agg(F.count("*").alias("n"), F.max("kind").alias("kind")),
        "pattern-edges",
    )
    seeds = edges.groupBy("token").agg(F.max("kind").alias("seed"))
    score = seeds.select("token", "seed", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    for _ in range(TURNS):
        known = edges.select("pattern", "token", "n").join(score, "token")
        patterns = known.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("trust"),
            F.sum(F.when(F.col("seed").isNotNull(), 1).otherwise(0)).alias("seeds"),
            F.max_by("seed", "n").alias("kind"),
        )
        votes = edges.select("pattern", "token").join(patterns.where(F.col("seeds") >= SUPPORT), "pattern")
        by_token = votes.groupBy("token").agg(F.avg("trust").alias("trust"), F.max_by("kind", "trust").alias("vote"))
        score = stored(
            seeds.join(by_token, "token", "left").select(
                "token", "seed", "vote",
                F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("score"),
            ),
            "pattern-scores",
        )
    return score.where(F.col("seed").isNull() & (F.col("score") >= ACCEPT) & F.col("vote").isNotNull()).select(
        "token", F.col("vote").alias("vote")
    )


def spans_text(spans: Column, names: tuple[str, ...]) -> Column:
    named = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base (the seeds' spans) and spans (these and the added ones), as arrays.

    A span is (start, kind, end) in code points, end exclusive; kinds 0 to 3 are KINDS and
    kinds 4 to 7 the same for added spans.  Null and empty texts have none.  Repeated rows give
    repeated results; an empty table gives an empty one; columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = stored(
        rows.select(
            "doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "base",
            candidates(F.col("text"), F.col("base")).alias("tokens"),
        ),
        "base-spans",
    )
    seen = found.where(F.size("tokens") > 0).select("k1", "k2", F.inline("tokens")).where("token != ''")
    added = (
        seen.where("kind is null")
        .dropDuplicates(["k1", "k2", "start"])
        .join(believed(seen), "token")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", (F.col("vote") + len(KINDS)).cast("int").alias("kind"), "end")).alias("more"))
    )
    return found.join(added, ["k1", "k2"], "left").select(
        "doc_id", "base",
        F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPAN})")))).alias("spans"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")

    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    names = (*KINDS, *(f"like_{k}" for k in KINDS))
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans"), names).alias("spans"),
    )
