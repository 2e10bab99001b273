"""Lines found in several documents, dropped by probing a sharded minimal perfect hash.

One pass counts in how many documents each line's 128-bit hash is found.  The hashes that
reach the limit are dealt to shards; each shard is a minimal perfect hash (levels of bit
arrays, a key sits where no other key of its level falls) over compact arrays: a 64-bit
fingerprint, the document count and the document that keeps the line.  A second pass over
the documents probes the arrays; lines are never joined.  Shards travel as one broadcast
while their measured size is below BROADCAST_BYTES; beyond it the line hashes go to the
shards instead and only the hits come back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shared as broadcast
from .common import sliced, stored, table

#: Distinct hashes in a shard, about, and the size up to which all shards are broadcast.
SHARD_KEYS = 1 << 16
BROADCAST_BYTES = 64 << 20
#: Distinct line hashes that are probed together, about, when they are sent to the shards.
ASKED_KEYS = 1 << 18
#: Bits a key of a level of the perfect hash.
GAMMA = 2.0
BLANK = b" \t\n\v\f\r"
SHARD_SCHEMA = "shard int, index binary"


def line_keys(text: bytes | None) -> list[bytes]:
    """Each line without white space at its ends, A-Z lower-cased."""
    return [line.strip(BLANK).lower() for line in (text or b"").split(b"\n")]


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def hash_pair(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def _long_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for k in line_keys(text) if len(k) >= min_chars and code_points(k) >= min_chars}


# --- the perfect hash -------------------------------------------------------------------


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return ((x >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0..n-1 of n distinct (h1, h2) pairs, and the arrays that the slots index."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.levels, self.prints, self.counts, self.keepers = levels, prints, counts, keepers
        ends = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.cumsum(b) - 1 + e for b, e in zip(levels, ends)]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> PerfectHash:
        key = h1.view(np.uint64) ^ (h2.view(np.uint64) << np.uint64(1))
        levels, rest, order = [], np.arange(len(key)), []
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = _place(key[rest], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            fits = alone[at]
            order.append(rest[fits][np.argsort(at[fits])])
            rest = rest[~fits]
            if len(levels) > 64:  # two pairs with one mixed key can't be told apart by any level
                raise ValueError("equal keys in a shard")
        by_slot = np.concatenate(order) if order else np.zeros(0, np.int64)
        return cls(levels, h2.view(np.uint64)[by_slot], counts[by_slot], keepers[by_slot])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is a key, its document count and its keeper."""
        key = h1.view(np.uint64) ^ (h2.view(np.uint64) << np.uint64(1))
        slot = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _place(key[left], level, len(bits))
            here = bits[at]
            slot[left[here]] = rank[at[here]]
            left = left[~here]
        found = slot >= 0
        found[found] = self.prints[slot[found]] == h2.view(np.uint64)[found]
        safe = np.where(found, slot, 0)
        if not len(self.prints):
            return found, np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        return found, self.counts[safe], self.keepers[safe]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.prints), len(self.levels), *map(len, self.levels)], np.int64)
        bits = [np.packbits(b).tobytes() for b in self.levels]
        return b"".join([np.int64(len(head)).tobytes(), head.tobytes(), *bits, self.prints.tobytes(), self.counts.tobytes(), self.keepers.tobytes()])

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n_head = int(np.frombuffer(blob, np.int64, 1)[0])
        n, _, *sizes = np.frombuffer(blob, np.int64, n_head, 8).tolist()
        at, levels = 8 + 8 * n_head, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=size).astype(bool))
            at += width
        parts = [np.frombuffer(blob, kind, n, at + 8 * n * i) for i, kind in enumerate((np.uint64, np.int64, np.int64))]
        return cls(levels, *parts)


# --- the passes over documents -----------------------------------------------------------


def line_hashes(docs: DataFrame, min_chars: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The whole-number columns named as keys, h1, h2 of each document row's distinct long lines."""
    names = [*keys, "h1", "h2"]

    def rows(batches):
        for batch in sliced(batches, len(keys)):
            ids = zip(*(batch.column(i).to_pylist() for i in range(len(keys))))
            texts = batch.column(len(keys)).cast(pa.binary())
            out = [(*i, *hash_pair(k)) for i, t in zip(ids, texts) for k in _long_keys(t.as_py(), min_chars)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    read = docs.select(*(F.col(k).cast("long") for k in keys), F.col("text").cast("string"))
    return read.mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h1, h2, n_docs, keeper of lines found in min_docs documents or more; a null doc_id is no document."""
    lines = line_hashes(docs, min_chars).where("doc_id is not null")
    # Rows of one document may repeat, so pairs are counted once; equal lines of many documents
    # meet only as one partial count a task.
    return (
        lines.distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def build_shards(lines: DataFrame, n_shards: int) -> DataFrame:
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        index = PerfectHash.build(*(frame[c].to_numpy(np.int64) for c in ("h1", "h2", "n_docs", "keeper")))
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "index": [index.to_bytes()]})

    return lines.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(build, SHARD_SCHEMA)


def kept_text(text: bytes | None, dropped: np.ndarray) -> bytes:
    return b"\n".join(line for line, gone in zip((text or b"").split(b"\n"), dropped) if not gone)


def _drop(docs: DataFrame, find, extra: list[str]) -> DataFrame:
    """docs with its text cut by find(rows of the batch) -> per row a mask of lines, or None."""
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")
    gone = [names.index(c) for c in extra]
    keep = [i for i in range(len(names)) if i not in gone]
    kept_schema = StructType([docs.schema.fields[i] for i in keep]).add("n_lines", "long").add("n_dropped", "long")

    def rows(batches):
        for batch in sliced(batches, at_text):
            texts = [t.as_py() for t in batch.column(at_text).cast(pa.binary())]
            masks = find(batch.column(at_id).to_pylist(), texts, [batch.column(i) for i in gone])
            n_lines = [1 + (t or b"").count(b"\n") for t in texts]
            cut = [t if m is None else kept_text(t, m) for t, m in zip(texts, masks)]
            columns = [pa.array(cut, pa.binary()).cast(pa.string()) if i == at_text else batch.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array([0 if m is None else int(m.sum()) for m in masks], pa.int64())],
                [*(names[i] for i in keep), "n_lines", "n_dropped"],
            )

    return docs.mapInArrow(rows, kept_schema)


def _probe_local(shards, n_shards: int, min_chars: int):
    """A find() that probes broadcast shards."""

    def find(ids, texts, _):
        indexes = _shards_of(shards)
        keys = [line_keys(t) for t in texts]
        place, h1, h2, doc = [], [], [], []
        for row, (i, lines) in enumerate(zip(ids, keys)):
            for n, k in enumerate(lines):
                if len(k) >= min_chars and code_points(k) >= min_chars:
                    a, b = hash_pair(k)
                    place.append((row, n))
                    h1.append(a)
                    h2.append(b)
                    doc.append(i)
        masks = [None] * len(texts)
        if not place:
            return masks
        a, b = np.array(h1, np.int64), np.array(h2, np.int64)
        known = np.array([i is not None for i in doc])
        docs = np.array([0 if i is None else i for i in doc], np.int64)
        shard = np.mod(a, n_shards)
        for s in np.unique(shard):
            if (index := indexes.get(int(s))) is None:
                continue
            here = np.flatnonzero(shard == s)
            found, _, keeper = index.probe(a[here], b[here])
            # A document without an id holds no line for good.
            for j in here[found & ((keeper != docs[here]) | ~known[here])]:
                row, n = place[j]
                if masks[row] is None:
                    masks[row] = np.zeros(len(keys[row]), bool)
                masks[row][n] = True
        return masks

    return find


_opened: dict = {}


def _shards_of(shards) -> dict[int, PerfectHash]:
    """The shards of a broadcast, opened once a worker."""
    if _opened.get("of") is not shards:
        _opened.update(of=shards, shards={s: PerfectHash.from_bytes(b) for s, b in shards.value})
    return _opened["shards"]


def _probe_shuffled(docs: DataFrame, shards: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    """docs with the hashes of its lines to drop, found by sending hashes to the shards.

    Equal hashes are probed once, whatever their documents.  A shard's hashes are dealt to salts, each with a
    copy of the shard, so that a group holds about ASKED_KEYS whatever the corpus.  A row without a doc_id is
    known by its text; no document keeps its lines.
    """
    known, text = F.col("doc_id").isNotNull(), F.col("text").cast("string")
    keys = {
        "row_known": known.cast("long"),
        "row_1": F.when(known, F.col("doc_id").cast("long")).otherwise(F.xxhash64(text)),
        "row_2": F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64(text, F.lit(1))),
    }
    rows = docs.withColumns(keys)
    lines = line_hashes(rows, min_chars, tuple(keys)).withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    asked = stored(lines.select("shard", "h1", "h2").distinct(), "asked-lines")
    n_salts = max(1, -(-asked.count() // (n_shards * ASKED_KEYS)))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("h1", "h2"), F.lit(n_salts)).cast("int"))
    shards = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))

    def probe(keys: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(keys):
            return pd.DataFrame({"h1": [], "h2": [], "keeper": []}).astype("int64")
        a, b = keys["h1"].to_numpy(np.int64), keys["h2"].to_numpy(np.int64)
        found, _, keeper = PerfectHash.from_bytes(shard["index"].iloc[0]).probe(a, b)
        return pd.DataFrame({"h1": a[found], "h2": b[found], "keeper": keeper[found]})

    hits = asked.groupBy("shard", "salt").cogroup(shards.groupBy("shard", "salt")).applyInPandas(probe, "h1 long, h2 long, keeper long")
    drops = lines.join(hits, ["h1", "h2"]).where((F.col("row_known") == 0) | (F.col("row_1") != F.col("keeper")))
    by_row = drops.select(*keys, "h1", "h2").distinct().groupBy(*keys).agg(F.collect_list("h1").alias("drop_h1"), F.collect_list("h2").alias("drop_h2"))
    return rows.join(by_row, [*keys], "left").select(*docs.columns, "drop_h1", "drop_h2")


def _find_listed(min_chars: int):
    def find(ids, texts, listed):
        masks = []
        for text, a, b in zip(texts, listed[0].to_pylist(), listed[1].to_pylist()):
            gone = set(zip(a or (), b or ()))
            masks.append(
                np.array([len(k) >= min_chars and code_points(k) >= min_chars and hash_pair(k) in gone for k in line_keys(text)])
                if gone else None
            )
        return masks

    return find


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with repeated lines gone from `text`, and n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased.  A key of at
    least min_chars code points that is found in at least min_docs documents stays only in the
    largest doc_id that holds it.  A null text is one empty line and stays null; a text whose lines all
    go becomes empty.  Rows that repeat a doc_id count as one document and are cut alike; a row
    without a doc_id is no document: it counts for nothing and loses all repeated lines.  All other columns are carried along,
    but for those named like the ones added.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "drop_h1", "drop_h2")
    lines = stored(repeated_lines(docs, min_chars, min_docs), "repeated-lines")
    n = lines.count()
    n_shards = max(1, -(-n // SHARD_KEYS))
    shards = build_shards(lines, n_shards)
    # A key takes 24 bytes and the bits of its levels.
    if n * 32 <= broadcast_bytes:
        blobs = [(r["shard"], bytes(r["index"])) for r in shards.collect()]
        return _drop(docs, _probe_local(broadcast(spark, blobs), n_shards, min_chars), [])
    return _drop(_probe_shuffled(docs, shards, n_shards, min_chars), _find_listed(min_chars), ["drop_h1", "drop_h2"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT n, doc_id, string_split(text, chr(10)) AS lines FROM docs),
lines AS (SELECT n, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
many AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, m.key IS NOT NULL AND m.keeper != k.doc_id AS gone FROM keyed k LEFT JOIN many m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY n, doc_id
"""
