"""Repeated passages, found by hashes of sliding sentence spans and cut from all documents but the first.

The shortest runs that have RUN sentences and RUN_WORDS words are hashed, both from and up to every sentence, so that
the last sentences of a passage are in one too, and single sentences that are long.  The hashes meet in one join over all documents; what goes through it is a hash and a document id.
Repeats inside one document are seen in its own task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import sliced, stored, table
from .words import RUN_BASE, RUN_BASE_BACK, mix, span_hashes, word_hashes

#: Sentences and words a run needs at least, and the words that make a sentence a span by itself.
RUN, RUN_WORDS, LONE_WORDS = 2, 10, 20
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of words and hash of every sentence.

    A sentence ends after a word whose last character is . ! or ?, and at a line end.  Its
    hash is that of its words, A-Z lower-cased; what white space stands between them doesn't count.
    """
    words, first, last = word_hashes(text)
    if not len(words):
        return first, first, words
    a = np.frombuffer(text, np.uint8)
    lines = np.concatenate(([0], np.cumsum(a == 10)))
    ends = _ENDS[a[last - 1]]
    ends[:-1] |= lines[first[1:]] > lines[last[:-1]]
    ends[-1] = True
    end = np.flatnonzero(ends) + 1
    start = np.concatenate(([0], end[:-1]))
    return first[start], end - start, span_hashes(words, start, end, RUN_BASE, RUN_BASE_BACK)


def spans(n_words: np.ndarray, hashes: np.ndarray, run: int, run_words: int, lone_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of every span."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(n_words)))
    here = np.arange(n)
    # From a sentence on, and back from one; a run found both ways is one span.
    end = np.maximum(here + run, np.searchsorted(total, total[:-1] + run_words))
    begin = np.minimum(here + 1 - run, np.searchsorted(total, total[1:] - run_words, side="right") - 1)
    both = np.concatenate((here[end <= n] * (n + 1) + end[end <= n], (begin * (n + 1) + here + 1)[begin >= 0]))
    at, end = np.divmod(np.unique(both), n + 1)
    lone = np.flatnonzero(n_words >= lone_words)
    with np.errstate(over="ignore"):
        runs = span_hashes(hashes, at, end, RUN_BASE, RUN_BASE_BACK)
        out = np.concatenate((runs, mix(hashes[lone] + np.uint64(1))))
    return np.concatenate((at, lone)), np.concatenate((end - at, np.ones(len(lone), np.int64))), out


def span_rows(docs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """h, doc_id: the distinct span hashes of each document row."""

    def rows(batches):
        for batch in sliced(batches, 1):
            hashes, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                _, n_words, of = sentences(t.as_py() or b"")
                own = np.unique(spans(n_words, of, *shape)[2])
                hashes.append(own)
                ids.append(np.full(len(own), i))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], ["h", "doc_id"]
                )

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return known.mapInArrow(rows, "h long, doc_id long")


def cut(text: bytes | None, repeated: list[int] | None, shape: tuple[int, int, int]) -> tuple[bytes | None, int, int]:
    """The text without sentences of repeated spans, its number of sentences and how many went."""
    first, n_words, of = sentences(text or b"")
    if not len(of):
        return text, 0, 0
    at, size, h = spans(n_words, of, *shape)
    gone = np.zeros(len(of), bool)
    if len(h):
        hit = np.isin(h, np.array(repeated, np.int64).view(np.uint64)) if repeated else np.zeros(len(h), bool)
        # Spans stand in order of their place within each size, so what is not the first of its hash is a repeat.
        order = np.lexsort((at, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        hit |= again
        for j in range(int(size.max())):
            here = hit & (size > j)
            gone[at[here] + j] = True
    if not gone.any():
        return text, len(of), 0
    ends = np.concatenate((first[1:], [len(text)]))
    kept = [text[: first[0]], *(text[first[i] : ends[i]] for i in np.flatnonzero(~gone))]
    return b"".join(kept), len(of), int(gone.sum())


def drop_repeated_spans(docs: DataFrame, run: int = RUN, run_words: int = RUN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """docs with repeated spans cut from `text`, and n_sentences (before) and n_removed.

    A span is repeated if another document with a smaller doc_id holds it, or an earlier place of
    the same text.  All sentences that a repeated span covers go, with the white space after them.  A passage of RUN sentences and
    RUN_WORDS words or more goes whole, wherever it stands; texts are read whole, however long.  An empty table stays empty.
    Null texts stay null and have no sentences.  Rows with the same doc_id count as one document, so copies
    of a row keep the same; a row without a doc_id is compared with itself only.  Other columns are
    carried along, but for those named like the ones added.
    """
    shape = (run, run_words, lone_words)
    docs = docs.drop("n_sentences", "n_removed", "repeated_spans")
    rows = stored(span_rows(docs, shape), "sentence-spans")
    # Minimum and maximum are combined before the shuffle: a passage of many documents is a row a task.
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    hits = (
        rows.join(firsts.select("h", "first"), "h")
        .where("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_set("h").alias("repeated_spans"))
    )
    joined = docs.join(hits, "doc_id", "left").select(*docs.columns, "repeated_spans")
    names = docs.columns
    at = names.index("text")

    def rows_out(batches):
        for batch in sliced(batches, at):
            done = [
                cut(t.as_py(), r.as_py(), shape) for t, r in zip(batch.column(at).cast(pa.binary()), batch.column(len(names)))
            ]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], [*names, "n_sentences", "n_removed"]
            )

    schema = StructType([*docs.schema.fields]).add("n_sentences", "long").add("n_removed", "long")
    return joined.mapInArrow(rows_out, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


_WS = r"\x20\x09-\x0D"
OP1_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
split AS (SELECT n, doc_id, regexp_extract_all(text, '[^{_WS}]+[{_WS}]*') AS items FROM docs WHERE text IS NOT NULL),
words AS (SELECT n, doc_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM split),
marked AS (SELECT *, regexp_matches(item, '[.!?][{_WS}]*$') OR contains(item, chr(10)) AS ends FROM words),
numbered AS (SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM marked),
sent AS (SELECT n, doc_id, s, count(*) AS n_words, string_agg(item, '' ORDER BY pos) AS piece,
         string_agg(translate(rtrim(item, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY pos) AS key
         FROM numbered GROUP BY n, doc_id, s),
upto AS (SELECT *, sum(n_words) OVER (PARTITION BY n ORDER BY s) AS upto FROM sent),
runs AS (SELECT a.n, a.doc_id, a.s, min(b.s) AS last_s FROM upto a CROSS JOIN range({RUN} - 1, {RUN} + {RUN_WORDS}) r(more) JOIN upto b ON b.n = a.n AND b.s = a.s + r.more
         WHERE b.upto - a.upto + a.n_words >= {RUN_WORDS} GROUP BY 1, 2, 3
         UNION SELECT a.n, a.doc_id, max(b.s), a.s FROM upto a CROSS JOIN range({RUN} - 1, {RUN} + {RUN_WORDS}) r(more) JOIN upto b ON b.n = a.n AND b.s = a.s - r.more
         WHERE a.upto - b.upto + b.n_words >= {RUN_WORDS} GROUP BY a.n, a.doc_id, a.s),
run_at AS (SELECT *, unnest(range(s::bigint, last_s::bigint + 1)) AS at FROM runs),
spans AS (SELECT r.n, r.doc_id, r.s, r.last_s, string_agg(t.key, ' / ' ORDER BY t.s) AS span FROM run_at r JOIN sent t ON t.n = r.n AND t.s = r.at GROUP BY 1, 2, 3, 4
          UNION ALL SELECT n, doc_id, s, s, key FROM sent WHERE n_words >= {LONE_WORDS}),
placed AS (SELECT *, min(doc_id) OVER (PARTITION BY span) AS first_doc, min(s) OVER (PARTITION BY span, n) AS first_s FROM spans),
gone AS (SELECT DISTINCT n, unnest(range(s::bigint, last_s::bigint + 1)) AS s FROM placed WHERE doc_id > first_doc OR s > first_s),
kept AS (SELECT n, count(*) AS n_sentences, count(g.s) AS n_removed, string_agg(piece, '' ORDER BY t.s) FILTER (WHERE g.s IS NULL) AS rest
         FROM sent t LEFT JOIN gone g USING (n, s) GROUP BY n)
SELECT doc_id, CASE WHEN k.n IS NULL THEN text ELSE regexp_extract(text, '^[{_WS}]*') || coalesce(rest, '') END AS text,
       coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed
FROM docs d LEFT JOIN kept k USING (n)
"""
