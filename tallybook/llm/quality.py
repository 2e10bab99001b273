"""Text quality: random-indexing word vectors, pooled per document, in a two-layer network.

A token's index vector is a few signed ones at places its hash picks.  Its word vector is the
sum of the index vectors of its neighbours over the whole corpus, kept for hashed
tokens in a table of fixed size.  A document is the mean and spread of its tokens' vectors and a few
ratios; a network trained in numpy on a bounded sample of labelled rows scores it, and a temperature fitted on
rows that the training didn't see makes the scores probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .array_sums import summed
from .common import shared as broadcast
from .common import sliced, table
from .labelled import held_out, sample
from .words import span_hashes

#: Labelled documents that are learned from at most, by label.
TRAIN_ROWS = {0: 6000, 1: 12000}
#: Hashed tokens, places of a vector, ones in an index vector, neighbours on each side.
TOKENS, PLACES, ONES, REACH = 8192, 32, 2, 2
#: Token pairs that are summed at a time, and tokens of a text that are pooled at a time.
PAIRS_AT_ONCE = 1 << 18
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
N_FEATURES = 2 * PLACES + 8

_RNG = np.random.default_rng(41)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
INDEX_PLACE = _RNG.integers(0, PLACES, (TOKENS, ONES))
INDEX_SIGN = _RNG.choice(np.array([-1, 1]), (TOKENS, ONES))
#: White space, small letters, capitals, digits, all else; bytes of other scripts are small letters.
_KIND = np.full(256, 4, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_PIECE = 1 << 16


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed token, kind and length of the text's tokens: runs of letters, of digits, and of other marks."""
    parts = []
    for at in range(0, max(len(text), 1), _PIECE):
        a = np.frombuffer(text, np.uint8, min(_PIECE, len(text) - at), at)
        kind = _KIND[a]
        # Letters run on whether large or small; a run's kind is that of its last byte.
        run = np.where(kind == 2, 1, kind)
        start = np.flatnonzero(np.diff(run, prepend=0) != 0)
        start = start[run[start] != 0]
        edge = np.flatnonzero(np.diff(run, append=0) != 0) + 1
        end = edge[run[edge - 1] != 0]
        if len(start):
            h = span_hashes(_BYTE_VALUE[a], start, end, _BASE, _BACK)
            parts.append(((h % np.uint64(TOKENS)).astype(np.int64), kind[end - 1], end - start))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """TOKENS rows of length 1: what stands around each token in all documents."""

    def add(total, texts):
        waiting: list[np.ndarray] = []

        def flush():
            joined = np.concatenate(waiting)
            waiting.clear()
            for reach in range(1, REACH + 1):
                x, y = joined[:-reach], joined[reach:]
                near = (x >= 0) & (y >= 0)
                if reach == 2:
                    near &= joined[1:-1] >= 0
                for word, other in ((x[near], y[near]), (y[near], x[near])):
                    for k in range(ONES):
                        place = word * PLACES + INDEX_PLACE[other, k]
                        sign = INDEX_SIGN[other, k]
                        up, down = place[sign > 0], place[sign < 0]
                        total[:] += np.bincount(up, minlength=len(total)) - np.bincount(down, minlength=len(total))

        n = 0
        for text in texts.cast(pa.binary()):
            t = tokens(text.as_py() or b"")[0]
            for at in range(0, len(t), PAIRS_AT_ONCE):
                # A text that is cut here loses the pairs across the cut no more than once: the next part begins REACH earlier.
                waiting.append(np.concatenate((t[max(0, at - REACH) : at + PAIRS_AT_ONCE], np.full(1, -1))))
                n += len(waiting[-1])
                if n >= PAIRS_AT_ONCE:
                    flush()
                    n = 0
        if waiting:
            flush()

    total = summed(docs.select(F.col("text").cast("string")), add, TOKENS * PLACES, "word-vectors").reshape(TOKENS, PLACES)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The features of a text: mean and spread of its tokens' vectors, and ratios of its tokens."""
    token, kind, length = tokens(text)
    out = np.zeros(N_FEATURES)
    if not len(token):
        return out
    # As many rows as the table has at most, however long the text.
    count = np.bincount(token, minlength=TOKENS)
    have = np.flatnonzero(count)
    weight = count[have] / len(token)
    v = vectors[have]
    mean = weight @ v
    out[:PLACES] = mean
    out[PLACES : 2 * PLACES] = np.sqrt(np.maximum(weight @ (v * v) - mean * mean, 0))
    shares = [(kind == k).mean() for k in (1, 2, 3, 4)]
    out[2 * PLACES :] = [
        *shares, length.mean() / 10, np.log1p(len(token)), len(have) / len(token), length[kind == 4].mean() if shares[3] else 0.0
    ]
    return out


# --- the network ---------------------------------------------------------------------------


def _forward(net, x):
    mean, deviation, w1, b1, w2, b2, _ = net
    hidden = np.tanh(((x - mean) / deviation) @ w1 + b1)
    return hidden, hidden @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, seed: int = 5):
    """Weights of a two-layer network, by Adam on the mean log loss; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = len(x) // 5 if len(x) >= 50 else 0
    check, learn = order[:cut], order[cut:]
    mean, deviation = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z = (x - mean) / deviation
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            step += 1
            hidden = np.tanh(z[rows] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))
            slope = (p - y[rows]) / len(rows)
            back = np.outer(slope, w[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ slope + DECAY * w[2], np.array([slope.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = (mean, deviation, *w, 1.0)
    if not cut:
        return net
    logit = _forward(net, x[check])[1]
    heats = np.geomspace(0.25, 16, 61)
    loss = [np.mean(np.logaddexp(0, logit / t) - y[check] * logit / t) for t in heats]
    return (*net[:-1], float(heats[int(np.argmin(loss))]))


def predict(net, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_forward(net, x)[1] / net[-1], -30, 30)))


# --- the operator --------------------------------------------------------------------------


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: dict[int, int] = TRAIN_ROWS) -> DataFrame:
    """docs with `score` (0 to 1: how likely label 1 is), from the whole text alone.

    Null and empty texts have no tokens and are scored as such.  Copies of a text are scored
    alike.  Without labels of both kinds all scores are the share of label 1 seen, 0.5 without any.
    Other columns are carried along, but for one named score.  What is broadcast, the word
    vectors and the network, has a size that doesn't depend on the input.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    vectors = broadcast(spark, word_vectors(docs))

    def features(batches):
        for batch in sliced(batches, 1):
            x = [pooled(t.as_py() or b"", vectors.value).tolist() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    learned = sample(docs, labels, label, rows).select("label", "text").mapInArrow(features, "label int, x array<double>").collect()
    learned.sort(key=lambda r: (r["label"], r["x"]))
    seen = {r["label"] for r in learned}
    if len(seen) == 2:
        net = train(np.array([r["x"] for r in learned]), np.array([float(r["label"]) for r in learned]))
    else:
        net = 1.0 if seen == {1} else 0.0 if seen == {0} else 0.5
    shared = broadcast(spark, net)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        net = shared.value
        for batch in sliced(batches, at):
            if isinstance(net, float):
                out = np.full(batch.num_rows, net)
            else:
                x = [pooled(t.as_py() or b"", vectors.value) for t in batch.column(at).cast(pa.string()).cast(pa.binary())]
                out = predict(net, np.array(x).reshape(batch.num_rows, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, "score"])

    schema = docs.limit(0).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
