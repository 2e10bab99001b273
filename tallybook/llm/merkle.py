"""A Merkle manifest of a dataset: a rollup of nested structs by the digits of ranks.

Rows become leaves; leaves have ranks within their language, found by ranges.  The digits of a
rank, base FAN, say under which nodes a leaf stands.  Within a block of FAN ** DIGITS ranks, one digit
after the other is grouped away: a node holds its children as an array of structs, which hold theirs.  Blocks are
the leaves of the next round, until a group is one block; the subroots of all languages are rolled
up in the same way.  From the top down, blocks are exploded again: each level's siblings are cut
from the parent's array, so proofs need no join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked, ranked_in_groups
from .common import shuffle_partitions, stored, table

#: Children of a node, and levels within a block, which so holds 4,096 nodes at most.
FAN, DIGITS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """H of the values: each as its UTF-8 byte count, a colon and itself, null as a hyphen."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return digest(F.concat(*parts))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda h, level: digest(F.concat(level["before"], h, level["after"])))


# --- up ------------------------------------------------------------------------------------


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """One stored row per block: grp, block, kids (the children of its top, nested), root, lone.

    nodes: grp, place (from 0), root, lone, item.  `root` is a node's digest as a child of others, `lone` its digest
    where no other node of its group is left: then the levels above it that have one child each aren't hashed.
    """
    digits = [F.floor(F.col("place") / FAN**d).cast("long") for d in range(DIGITS + 1)]
    at = nodes.select(
        "grp", digits[DIGITS].alias("block"), *[F.pmod(digits[d], F.lit(FAN)).cast("int").alias(f"d{d}") for d in range(DIGITS)],
        "root", "lone", "item",
    )
    # Dealt by block once: all groupings below are by these columns and more, and move no row.
    at = at.repartition(shuffle_partitions(nodes.sparkSession), "grp", "block")
    inner = ["root", "lone", "item"]
    for d in range(DIGITS):
        keys = ["grp", "block", *[f"d{k}" for k in range(DIGITS - 1, d, -1)]]
        kids = F.sort_array(F.collect_list(F.struct(f"d{d}", *inner))).alias("kids")
        at = at.groupBy(*keys).agg(kids).withColumn("root", digest(F.array_join(F.col("kids.root"), "")))
        at = at.withColumn("lone", F.when(F.size("kids") == 1, F.col("kids")[0]["lone"]).otherwise(F.col("root")))
        inner = ["root", "lone", "kids"]
    return stored(at.select("grp", "block", "kids", "root", "lone"), name)


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of each round; in the last one every group is one block."""
    done = [_blocks(nodes, f"{name}-0")]
    while (done[-1].agg(F.max("block")).first()[0] or 0) > 0:
        upper = done[-1].select("grp", F.col("block").alias("place"), "root", "lone", F.struct("block").alias("item"))
        done.append(_blocks(upper, f"{name}-{len(done)}"))
    return done


# --- down ----------------------------------------------------------------------------------

PROOF = "array<struct<before:string,after:string>>"


def _siblings(kids: Column, i: Column) -> Column:
    """The digests of the children before and after place i (from 0), joined."""
    return F.struct(
        F.array_join(F.transform(F.slice(kids, F.lit(1), i), lambda k: k["root"]), "").alias("before"),
        F.array_join(F.transform(F.slice(kids, i + 2, F.lit(FAN)), lambda k: k["root"]), "").alias("after"),
    )


def _opened(blocks: DataFrame) -> DataFrame:
    """Blocks (grp, block, kids, alone, proof, carry) as their nodes: grp, node, alone, proof, carry.

    A block that is alone in its group has no levels above the last node that has several children.
    """
    at = blocks
    for d in range(DIGITS - 1, -1, -1):
        kids = F.col("kids")
        each = F.transform(kids, lambda kid, i: F.struct(kid.alias("kid"), _siblings(F.col("kids"), i).alias("level")))
        at = at.select("grp", (F.col("alone") & (F.size(kids) == 1)).alias("alone"), "proof", "carry", F.explode(each).alias("at"))
        at = at.select(
            "grp", "alone", F.when(F.col("alone"), F.col("proof")).otherwise(F.concat(F.array("at.level"), "proof")).alias("proof"), "carry",
            *([F.col("at.kid").alias("node")] if d == 0 else [F.col("at.kid.kids").alias("kids")]),
        )
    return at


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round: grp, node, proof, carry.

    above: grp, proof and carry of each group's top.  Blocks and what lies above them meet in a grouping: two rows a block.
    """
    above = above.select("grp", F.lit(0).cast("long").alias("block"), F.lit(True).alias("alone"), "proof", "carry")
    for n in range(len(rounds) - 1, -1, -1):
        blocks = rounds[n].select("grp", "block", "kids")
        both = blocks.unionByName(above, allowMissingColumns=True).groupBy("grp", "block")
        whole = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("kids", "alone", "proof", "carry")])
        nodes = _opened(whole)
        if n:
            above = nodes.select("grp", F.col("node.item.block").alias("block"), "alone", "proof", "carry")
    return nodes


# --- the operator --------------------------------------------------------------------------


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: doc_id, the group column, leaf, subroot, root, proof, and `bent`, the leaf with `changed` columns in place.

    Leaves of a group ascend by doc_id, null first; rows that repeat an id ascend by leaf.  While a group has several nodes, every
    FAN consecutive ones become their digest; the last is the subroot.  Subroots in the order of the group's value, null first, lead to
    the root alike.  proof: for each level from the leaf up, the digests before and after its node in the run, joined.
    Rows that repeat are leaves of their own.  An empty table has no rows and no root.  Texts are hashed whole and not
    kept.  Columns that aren't in `columns` don't matter, whatever their names.
    """
    swapped = [(changed or {}).get(c, F.col(c)) for c in columns]
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(group).cast("string").alias("grp"),
        leaf([F.col(c) for c in columns]).alias("leaf"), leaf(swapped).alias("bent"),
    )
    placed = ranked_in_groups(stored(leaves, "leaves"), "grp", "doc_id", "leaf")
    nodes = placed.select(
        "grp", (F.col("position") - 1).alias("place"), F.col("leaf").alias("root"), F.col("leaf").alias("lone"), F.struct("doc_id", "bent").alias("item")
    )
    rounds = _rounds(nodes, "merkle")
    tops = ranked(rounds[-1].select("grp", "lone"), "grp")
    tops = tops.select(
        F.lit(0).alias("grp"), (F.col("position") - 1).alias("place"), F.col("lone").alias("root"), "lone", F.col("grp").alias("name")
    ).select("grp", "place", "root", "lone", F.struct("name").alias("item"))
    top_rounds = _rounds(tops, "merkle-top")
    start = top_rounds[-1].select("grp", F.array().cast(PROOF).alias("proof"), F.struct(F.col("lone").alias("root")).alias("carry"))
    groups = _down(top_rounds, start).select(
        F.col("node.item.name").alias("grp"), "proof", F.struct("carry.root", F.col("node.lone").alias("subroot")).alias("carry")
    )
    return _down(rounds, stored(groups, "merkle-groups")).select(
        F.col("node.item.doc_id").alias("doc_id"), F.col("grp").alias(group), F.col("node.root").alias("leaf"),
        "carry.subroot", "carry.root", "proof", F.col("node.item.bent").alias("bent"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.when(tampered, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)
    rows = manifest(table(spark, sf_dir, "documents"), changed={"text": lower})
    rows = rows.withColumn("folded_root", fold(F.col("bent"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda level: F.concat(level["before"], level["after"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _levels(n: int, top: bool) -> str:
    """CTEs of one level: nodes with what stands before and after them in their run, and the nodes above."""
    a, b = ("u", "0 AS lang") if top else ("n", "lang")
    run = f"PARTITION BY lang, r // {FAN} ORDER BY r ROWS BETWEEN"
    return f"""
{a}{n}s AS (SELECT lang, r, h, count(*) OVER (PARTITION BY lang) AS m,
  coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {a}{n}),
{a}{n + 1} AS (SELECT lang, r // {FAN} AS r, CASE WHEN min(m) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h
  FROM {a}{n}s GROUP BY lang, r // {FAN}),"""


def _folds(n: int, top: bool, before: str) -> str:
    a = "u" if top else "n"
    rank = f"{'place' if top else 'r'} // {FAN**n}"
    match = "TRUE" if top else "f.lang IS NOT DISTINCT FROM s.lang"
    return f"""
{a}{n}f AS (SELECT f.* EXCLUDE (fold, proof), CASE WHEN m = 1 THEN fold ELSE sha256(a || fold || z) END AS fold,
  CASE WHEN m = 1 THEN proof ELSE proof || a || z END AS proof FROM {before} f JOIN {a}{n}s s ON {match} AND s.r = f.{rank}),"""


def _sql(levels: int, top_levels: int) -> str:
    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    # CRC-32 of the decimal id, a byte a step.
    crc = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295))"""
    sql = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {lower} ELSE text END AS other FROM documents, crc),
leaves AS (SELECT doc_id, lang, sha256({' || '.join(part(c) for c in COLUMNS)}) AS leaf,
  sha256({' || '.join(part('other' if c == 'text' else c) for c in COLUMNS)}) AS bent FROM texts),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, bent AS fold, '' AS proof FROM leaves),
n0 AS (SELECT lang, r, leaf AS h FROM f),"""
    sql += "".join(_levels(n, False) for n in range(levels))
    sql += f"""
tops AS (SELECT lang AS name, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM n{levels}),
u0 AS (SELECT 0 AS lang, place AS r, subroot AS h FROM tops),"""
    sql += "".join(_levels(n, True) for n in range(top_levels))
    last = "f"
    for n in range(levels):
        sql += _folds(n, False, last)
        last = f"n{n}f"
    sql += f"\ng AS (SELECT x.*, subroot, place FROM {last} x JOIN tops ON x.lang IS NOT DISTINCT FROM name),"
    last = "g"
    for n in range(top_levels):
        sql += _folds(n, True, last)
        last = f"u{n}f"
    return sql + f"""
top AS (SELECT h AS root FROM u{top_levels})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {last}, top"""


#: Seven levels hold two million rows of a language, two hold 64 languages.
OP13_SQL = _sql(7, 2)
