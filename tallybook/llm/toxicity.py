"""Toxicity by compression distance: windows compressed with a toxic and an ordinary zstandard dictionary.

Both dictionaries hold the same common words; the toxic one ends in the stems that toxic texts
have and ordinary ones lack, the ordinary one in as many bytes of further common words.  A
window that takes fewer bytes with the toxic dictionary is nearer to toxic text.  All windows that
save anything are looked at word by word.  How much a document's windows save is turned into a
probability by a logistic curve that is fitted on documents the dictionaries weren't made from.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared as broadcast
from .common import sliced, table
from .labelled import held_out, sample

#: Labelled documents that are learned from at most, by label, and bytes of their whole texts by label.
TRAIN_ROWS = {0: 4000, 1: 2000}
TRAIN_BYTES = 1 << 25
#: Words in a window; common words and stems in a dictionary.
WINDOW, COMMON_WORDS, STEMS = 8, 3000, 600
GRAM, LEVEL = 5, 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode()


def windows(text: bytes, size: int = WINDOW):
    """Runs of `size` words, end to end, each with the blank before it; the last may be shorter."""
    ends = [m.end() for m in _WORD.finditer(text)]
    at = 0
    for i in range(size - 1, len(ends) + size - 1, size):
        end = ends[min(i, len(ends) - 1)]
        yield b" " + text[at:end].lstrip()
        at = end


def make_pair(toxic: bytes, ordinary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for content in (toxic, ordinary):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d))
    return tuple(out)


def features(text: bytes, toxic, ordinary) -> list[float]:
    """How many bytes the toxic dictionary saves: largest, mean and tail over windows, and over single words."""
    parts = list(windows(text))
    if not parts:
        return [0.0] * 12
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts], float)
    order = np.argsort(-saved, kind="stable")
    top = np.zeros(8)
    top[: min(8, len(saved))] = saved[order[:8]]
    # A word is measured once a text, however often it stands in such windows.
    words = Counter(b" " + x + b" " for i in np.flatnonzero(saved > 0) for x in parts[i].split())
    each = np.array([len(ordinary.compress(x)) - len(toxic.compress(x)) for x in words] or [0], float)
    single = np.sort(np.repeat(each, list(words.values()) or [1]))[::-1]
    return [
        top[0], top[:2].mean(), top[:4].mean(), top.mean(), saved.mean(), (saved >= 3).mean(), (saved >= 5).mean(),
        np.log1p((saved >= 5).sum()), np.log1p(len(saved)), single[0], single[:3].mean(), np.log1p((single >= 3).sum()),
    ]


def _grams(text: bytes) -> set[bytes]:
    text = b" " + b" ".join(text.split())
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary; the nearest the end, the cheaper to refer to."""
    seen_t: Counter[bytes] = Counter()
    seen_o: Counter[bytes] = Counter()
    for texts, seen in ((toxic, seen_t), (ordinary, seen_o)):
        for t in texts:
            seen.update(_grams(t))
    n_t, n_o = max(1, len(toxic)), max(1, len(ordinary))
    # In one toxic text of a hundred at least, and twenty times as often as in ordinary ones.
    odd = {g for g, n in seen_t.items() if n >= max(3, 0.01 * n_t) and n / n_t > 20 * (seen_o[g] + 0.5) / n_o}
    stems: Counter[bytes] = Counter()
    for t in toxic:
        for word, n in Counter(t.split()).items():
            word = b" " + word
            at = [i for i in range(len(word) - GRAM + 1) if word[i : i + GRAM] in odd]
            if at:
                stems[word[at[0] : at[-1] + GRAM]] += n
    common = Counter(w for t in ordinary for w in t.split())
    words = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[: COMMON_WORDS + 3000]]
    stem_text = b" ".join(s for s, _ in sorted(stems.items(), key=lambda x: (-x[1], x[0]))[:STEMS][::-1]) + b" "
    base = b" ".join(words[:COMMON_WORDS][::-1]) + b" "
    return base + stem_text, base + b" ".join(words[COMMON_WORDS:])[: len(stem_text) - 1] + b" "


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights (the last is the constant) of a ridge logistic regression."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / deviation, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - 1e-1 * w)
    return mean, deviation, w


def probability(model, x: np.ndarray) -> np.ndarray:
    mean, deviation, w = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / deviation, np.ones(len(x))] @ w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int] = TRAIN_ROWS):
    """The two dictionary contents and the curve, or a plain probability where one of the labels is missing."""
    learned = sample(docs, labels, label, rows, TRAIN_BYTES).select("doc_id", "text", "label").collect()
    learned = sorted((r["doc_id"], b" ".join(folded(r["text"]).split()), r["label"]) for r in learned)
    by = {v: [t for _, t, y in learned if y == v] for v in (0, 1)}
    if not by[0] or not by[1]:
        return None, (len(by[1]) + 0.5) / (len(learned) + 1)
    # Three of five make the dictionaries, two the curve; with few rows, all do both.
    few = min(map(len, by.values())) < 10
    part = {v: ([t for i, t in enumerate(x) if few or i % 5 < 3], [t for i, t in enumerate(x) if few or i % 5 >= 3]) for v, x in by.items()}
    contents = dictionaries(part[1][0], part[0][0])
    pair = make_pair(*contents)
    x = np.array([features(t, *pair) for v in (0, 1) for t in part[v][1]])
    y = np.array([float(v) for v in (0, 1) for _ in part[v][1]])
    return contents, logistic(x, y)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: dict[int, int] = TRAIN_ROWS) -> DataFrame:
    """doc_id and score (0 to 1: how likely label 1 is) of every row of docs, from its whole text alone.

    Null and empty texts have no windows and get the score of a text that saves nothing.  Rows of
    one document are scored alike.  Without labels of both kinds all scores are the share of the one seen.  The dictionaries and
    the curve are broadcast; their size doesn't depend on the input.
    """
    contents, model = fit(docs, labels, label, rows)
    shared = broadcast(docs.sparkSession, (contents, model))

    def run(batches):
        contents, model = shared.value
        pair = make_pair(*contents) if contents else None
        for batch in sliced(batches, 1):
            if pair is None:
                out = np.full(batch.num_rows, model)
            else:
                x = np.array([features(folded(t.as_py()), *pair) for t in batch.column(1)]).reshape(batch.num_rows, 12)
                out = probability(model, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
