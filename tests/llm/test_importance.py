from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallybook.llm import importance

DOCS = "doc_id long, text string, score string, rank string, bucket int, n_words int"


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiouÉé") + rng.choice("klmnst") for _ in range(n))


def brute(rows, target, percent, least, longest, size, seed):
    def features(text):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % size for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    docs, aimed = [(r[0], *features(r[1])) for r in rows], [features(t)[1] for t in target]
    s, t = [0] * size, [0] * size
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for f in aimed:
        for b in f:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + size) / ((s[b] + 1) * (sum(t) + size)))) for b in range(size)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, [x[0] for x in able[: percent * len(able) // 100]]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 37), (1, 100), (1, 0)])
def test_against_brute_force(spark, longest, percent):
    rng = random.Random(longest)
    texts = [None, "", "!!", "A a a", *(prose(rng, rng.choice([5, 19, 20, 21, 80])) for _ in range(300)), prose(rng, 30000)]
    rows = list(enumerate(texts))
    target = [prose(rng, 50), None, "é É a"]
    docs = spark.createDataFrame([(*r, "s", "r", 1, 2) for r in rows], DOCS).repartition(4)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, longest, 500).collect()
    want, drawn = brute(rows, target, percent, 20, longest, 500, importance.SEED)
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"]) for r in got} == {x[0]: x[2:] for x in want}
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_ties_and_repeated_rows(spark):
    text = prose(random.Random(1), 25)
    rows = [(3, text)] * 400 + [(None, text)] * 300 + [(i, text) for i in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = importance.resample(docs, docs.limit(0), 40).collect()
    assert len(got) == 750 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 301))
    ranks = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [-r["score"] for r in ranks] == sorted(-r["score"] for r in ranks)
    left = [r["score"] for r in got if r["rank"] is None]
    assert ranks[-1]["score"] >= max(left)


def test_bisection(spark):
    values = [random.Random(2).randrange(-50, 50) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in (1, 2, 250, 499, 500):
        x, above = importance._bisect(frame, "v", wanted)
        assert x == sorted(values, reverse=True)[wanted - 1] and above == sum(v > x for v in values)
    same = frame.select(F.lit(7).alias("v"))
    assert importance._bisect(same, "v", 3) == (7, 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs).count() == 0
    only = importance.resample(docs, docs.limit(0)).first()
    assert (only["n_features"], only["rank"]) == (3, None)
