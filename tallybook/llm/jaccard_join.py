"""Near-duplicate classes by an exact Jaccard join of word shingles, with a count-vector R-tree.

Equal shingle sets are one class from the start.  A document goes to the blocks of its
rarest shingles, as many as a partner of the required similarity can't miss.  What shares a
block is a point: its shingles hashed to groups and counted.  No pair shares more than the sum
of the smaller counts, so an R-tree over the points drops node pairs, then pairs, whose sum
is too small.  The pairs left are verified on their whole sets.

Links are looked for in two rounds, and only classes are needed: first against the least
document of each block, and then, by the tree, between documents that are not yet in one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .array_sums import summed
from .common import shared as broadcast
from .common import shuffle_partitions, sliced, stored, table
from .components import components
from .words import shingles

WORDS, SIMILARITY = 5, (80, 100)
#: Counters that order shingles by how common they are: of fixed size, whatever the input.
COUNTERS = 1 << 20
#: Groups of a count vector; points in a node; points in a task's block before it is split.
GROUPS, FANOUT, BLOCK = 256, 32, 2048


def required(a, b, similarity: tuple[int, int]):
    """Least overlap, times (part + whole), of sets of sizes a and b that link."""
    return similarity[0] * (a + b)


def prefix_size(n: int, similarity: tuple[int, int]) -> int:
    part, whole = similarity
    return n - -(-part * n // whole) + 1


# --- pass 1: how common shingles are ------------------------------------------------------


def common_counters(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of all documents' shingles by hash, in COUNTERS counters."""

    def add(total, texts):
        for text in texts.cast(pa.binary()):
            total[(shingles(text.as_py(), words) % np.uint64(COUNTERS)).astype(np.int64)] += 1

    return summed(docs.select(F.col("text").cast("string")), add, COUNTERS, "shingle-counters")


# --- pass 2: sets, points and block keys ---------------------------------------------------


def describe(text: bytes | None, common: np.ndarray, words: int, similarity: tuple[int, int]):
    """Size, two hashes of the set, count vector and block keys of a text."""
    s = shingles(text, words)
    if not len(s):
        return 0, None, None, None, None
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    vector = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS).astype("<u4")
    order = np.lexsort((s, common[(s % np.uint64(COUNTERS)).astype(np.int64)]))
    keys = s[order[: prefix_size(len(s), similarity)]].view(np.int64)
    return len(s), (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), vector.tobytes(), keys


def described(docs: DataFrame, common, words: int, similarity: tuple[int, int]) -> DataFrame:
    def rows(batches):
        for batch in sliced(batches, 1):
            out = [describe(t.as_py(), common.value, words, similarity) for t in batch.column(1).cast(pa.binary())]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "s1", "s2", "vector", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        rows, "doc_id long, n long, s1 long, s2 long, vector binary, keys array<long>"
    )


# --- the tree ------------------------------------------------------------------------------


class CountTree:
    """An R-tree over count vectors: nodes hold the largest counts and the least size below them."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(sizes))
        # Points of like size, and among them of like counts in the group that varies most, share a node.
        spread_of = vectors.var(axis=0).argsort()[::-1]
        order = order[np.lexsort((vectors[:, spread_of[1]], vectors[:, spread_of[0]], sizes))]
        self.order = order
        self.levels = [(vectors[order], sizes[order])]
        while len(self.levels[-1][1]) > FANOUT:
            box, least = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(box, cuts), np.minimum.reduceat(least, cuts)))


def tree_pairs(a: CountTree, b: CountTree, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Points of a and of b whose vectors allow a link, by going down both trees at once.

    Trees of the same build have levels that differ by one at most where their sizes do.
    """
    both = sum(similarity)
    i, j = np.meshgrid(np.arange(len(a.levels[-1][1])), np.arange(len(b.levels[-1][1])), indexing="ij")
    i, j = i.ravel(), j.ravel()
    at_a, at_b = len(a.levels) - 1, len(b.levels) - 1
    while True:
        (box_a, least_a), (box_b, least_b) = a.levels[at_a], b.levels[at_b]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            s = slice(at, at + (1 << 14))
            overlap = np.minimum(box_a[i[s]], box_b[j[s]]).sum(axis=1, dtype=np.int64)
            keep[s] = both * overlap >= required(least_a[i[s]].astype(np.int64), least_b[j[s]], similarity)
        i, j = i[keep], j[keep]
        if not at_a and not at_b:
            return a.order[i], b.order[j]
        if at_a >= at_b:
            at_a -= 1
            i, j = _down(i, j, len(a.levels[at_a][1]))
        else:
            at_b -= 1
            j, i = _down(j, i, len(b.levels[at_b][1]))


def _down(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every child of the nodes i, with the j of its parent."""
    child = (i[:, None] * FANOUT + np.arange(FANOUT)[None, :]).ravel()
    j = np.repeat(j, FANOUT)
    real = child < n
    return child[real], j[real]


def block_pairs(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a, b: pairs of a block that the tree lets through, between different classes.

    rows: key, i, j (the two chunks that a task compares), chunk, doc, class, n, vector.
    """

    def pairs_of(size, doc, of, chunk, vectors, ci, cj):
        left, right = np.flatnonzero(chunk == ci), np.flatnonzero(chunk == cj)
        if not len(left) or not len(right):
            return None
        tree = CountTree(vectors[left], size[left])
        other = tree if ci == cj else CountTree(vectors[right], size[right])
        x, y = tree_pairs(tree, other, similarity)
        x, y = left[x], right[y]
        keep = of[x] != of[y]
        if ci == cj:
            keep &= x < y
        return doc[x[keep]], doc[y[keep]]

    def of_blocks(batches):
        """Whole blocks, as they pass in order; the last one of a batch waits for the next batch."""
        waiting: pa.Table | None = None
        for batch in batches:
            rows_ = pa.Table.from_batches([batch])
            waiting = rows_ if waiting is None else pa.concat_tables([waiting, rows_])
            yield from finished(waiting, last := _last_block(waiting))
            waiting = waiting.slice(last)
        if waiting is not None:
            yield from finished(waiting, waiting.num_rows)

    def finished(rows_: pa.Table, n: int):
        if not n:
            return
        column = {c: rows_.column(c).slice(0, n) for c in rows_.column_names}
        number = {c: column[c].to_numpy() for c in ("key", "i", "j", "chunk", "doc", "class", "n")}
        cuts = _block_starts(number)
        a, b = [], []
        for start, end in zip(cuts, [*cuts[1:], n]):
            part = slice(start, end)
            vectors = np.frombuffer(b"".join(v.as_py() for v in column["vector"].slice(start, end - start)), "<u4").reshape(-1, GROUPS).astype(np.int64)
            found = pairs_of(
                number["n"][part], number["doc"][part], number["class"][part], number["chunk"][part], vectors, number["i"][start], number["j"][start]
            )
            if found is not None and len(found[0]):
                a.append(found[0])
                b.append(found[1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(of_blocks, "a long, b long")


def _block_starts(number: dict[str, np.ndarray]) -> list[int]:
    new = np.zeros(len(number["key"]), bool)
    new[:1] = True
    for c in ("key", "i", "j"):
        new[1:] |= number[c][1:] != number[c][:-1]
    return np.flatnonzero(new).tolist()


def _last_block(rows: pa.Table) -> int:
    """Where the last block of the rows begins."""
    return _block_starts({c: rows.column(c).to_numpy() for c in ("key", "i", "j")})[-1] if rows.num_rows else 0


# --- verification --------------------------------------------------------------------------


def bounded(pairs: DataFrame, points: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow a link."""
    both = sum(similarity)

    def keep(batches):
        for frame in batches:
            a = np.frombuffer(b"".join(frame["va"]), "<u4").reshape(-1, GROUPS)
            b = np.frombuffer(b"".join(frame["vb"]), "<u4").reshape(-1, GROUPS)
            overlap = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            yield frame.loc[both * overlap >= required(frame["na"].to_numpy(), frame["nb"].to_numpy(), similarity), ["a", "b"]]

    part, whole = similarity
    left = points.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    right = points.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))
    like = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * whole >= F.greatest("na", "nb") * part)
    return like.mapInPandas(keep, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: tuple[int, int], name: str) -> DataFrame:
    """The pairs (a, b) of documents that link, by their whole sets."""
    pairs = stored(pairs, f"{name}-pairs")
    part, whole = similarity
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batches):
        for batch in sliced(batches, 1):
            out = [shingles(t.as_py(), words).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "shingles"])

    of = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(wanted, "doc_id", "left_semi")
        .mapInArrow(sets, "doc long, shingles binary")
    )
    # A doc_id that repeats has the sets of all its texts, and links if one of them does.
    of = stored(of.dropDuplicates(["doc", "shingles"]), f"{name}-sets")

    def links(batches):
        for batch in sliced(batches, 2):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(whole * common >= part * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (
        pairs.join(of.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(of.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    return joined.mapInArrow(links, "a long, b long")


# --- the operator --------------------------------------------------------------------------


def blocks(shared: DataFrame) -> DataFrame:
    """key, n, first, of blocks (key, doc) with two documents or more; blocks with the same documents are one."""
    stats = shared.groupBy("key").agg(
        F.count("*").alias("size"), F.min("doc").alias("first"),
        F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"),
    )
    return stats.where("size > 1").groupBy("x", "y", "size", "first").agg(F.min("key").alias("key")).select("key", "size", "first")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are what stands between ASCII white space, A-Z lower-cased; a set holds the distinct runs of
    `words` words, or the whole text as one run if it is shorter.  Documents link when
    whole * overlap >= part * union.  Null and empty texts have no set and link with nothing; all
    texts with equal sets link.  Rows that repeat a doc_id are one document: what links with one
    of its texts is in its class.  A row without a doc_id has its n_shingles and a null component.  An empty table stays empty.  Other
    columns are not read.  Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    common = broadcast(spark, common_counters(docs, words))
    rows = stored(described(docs, common, words, similarity), "shingle-sets")
    full = rows.where("n > 0 and doc_id is not null")
    first = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"))
    members = stored(
        full.select("doc_id", "s1", "s2").distinct().join(first, ["s1", "s2"]).select("doc_id", "doc", "n"), "set-classes"
    )

    # Keys of one document only go before anything is joined to them.
    keys = full.select("doc_id", F.explode("keys").alias("key"))
    alone = keys.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    shared = stored(
        keys.join(alone, "key").join(members.select("doc_id", "doc"), "doc_id").select("key", "doc").distinct(), "shared-keys"
    )
    unique = blocks(shared)
    placed = stored(shared.join(unique, "key"), "blocks")
    points = stored(
        full.join(placed.select("doc").distinct(), full["doc_id"] == F.col("doc"), "left_semi")
        .select(F.col("doc_id").alias("doc"), "n", "vector")
        .dropDuplicates(["doc", "n", "vector"]),
        "points",
    )

    stars = placed.where("doc != first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    links = verified(bounded(stars, points, similarity), docs, words, similarity, "stars")
    links = stored(links, "star-links")
    classes = components(links, "stars")

    of = placed.join(classes.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "doc", "size", F.coalesce("component", "doc").alias("class")
    )
    mixed = of.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key")
    pieces = F.ceil(F.col("size") / BLOCK).cast("int")
    open_rows = (
        of.join(mixed, "key")
        .join(points, "doc")
        .withColumn("pieces", pieces)
        .withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .select("key", "i", "j", "chunk", "doc", "class", "n", "vector")
    )
    more = block_pairs(open_rows, similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # A star's pair that didn't link doesn't need another look.
    more = more.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    crossing = verified(more, docs, words, similarity, "blocks")
    # The texts of a doc_id that repeats are one document: their classes meet in it.
    several = members.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z")
    same = members.join(several, "doc_id").where("doc > a").select("a", F.col("doc").alias("b"))
    edges = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(crossing).unionByName(same)
    final = components(edges, "classes")

    # Copies of a document's row have one entry here.
    found = members.join(final.withColumnRenamed("node", "doc"), "doc", "left").select(
        "doc_id", F.coalesce("component", "doc").alias("component")
    ).groupBy("doc_id").agg(F.min("component").alias("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORD = r"[^\x20\x09-\x0D]+"
OP2_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM docs),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets sa ON a = sa.doc_id JOIN sets sb ON b = sb.doc_id
          WHERE 100 * common >= 80 * (len(sa.s) + len(sb.s) - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS spot FROM sets UNION SELECT node, b FROM reach JOIN sides ON spot = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(spot) AS component_id FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, s
"""
