from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallybook.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, item string, place int, proof string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """The root of a list of digests, and each one's siblings by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for n, place in enumerate(places):
            run, at = runs[place // 8], place % 8
            proofs[n].append(("".join(run[:at]), "".join(run[at + 1 :])))
            places[n] = place // 8
        nodes = [h(*run) for run in runs]
    return nodes[0], proofs


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted(((r, leaf_of(r)) for r in rows if r[2] == g), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for g in langs}
    sub = {g: tree([x[1] for x in own[g]]) for g in langs}
    root, above = tree([sub[g][0] for g in langs])
    return sorted(
        (x[0][0] is None, x[0][0], x[1], sub[g][0], root, sub[g][1][n] + above[k])
        for k, g in enumerate(langs) for n, x in enumerate(own[g])
    )


def rows_of(sizes):
    rng, rows = random.Random(4), []
    for lang, n in sizes.items():
        for i in range(n):
            rows.append((len(rows) * 3, rng.choice([None, "web"]), lang, rng.choice([None, i]), rng.choice([None, "", "Text É", "x" * i])))
    rng.shuffle(rows)
    return rows


MIXED = {None: 1, "de": 9, "en": 65, "é": 3, "z": 64}


@pytest.mark.parametrize("digits, sizes", [
    (4, {"en": 1}), (4, {"en": 8}), (4, MIXED), (4, {f"l{i:02}": 1 + i % 5 for i in range(20)}), (2, MIXED), (1, {"en": 530, "de": 2}),
])
def test_against_one_tree_in_memory(spark, monkeypatch, digits, sizes):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = rows_of(sizes)
    docs = spark.createDataFrame([(*r, "r", "i", 1, "p") for r in rows], DOCS).repartition(4)
    got = merkle.manifest(docs).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] and r["bent"] == r["leaf"] for r in got)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in got) == brute(rows)


def test_repeated_rows_null_ids_and_changes(spark):
    rows = [(1, "a", "en", 1, "Same")] * 20 + [(None, None, None, None, None)] * 3 + [(2, "a", "en", 1, "x" * 200000), (None, "b", "en", 2, "t")]
    docs = spark.createDataFrame(rows, DOCS.split(", root")[0]).repartition(3)
    got = merkle.manifest(docs, changed={"text": F.lower("text")})
    got = got.withColumn("folded", merkle.fold(F.col("bent"), F.col("proof"))).collect()
    assert len(got) == 25 and len({r["root"] for r in got}) == 1
    assert sorted(((r["doc_id"] or -1), r["leaf"]) for r in got) == sorted(((r[0] or -1), leaf_of(r)) for r in rows)
    for r in got:
        assert (r["folded"] == r["root"]) == (r["doc_id"] != 1)
    assert merkle.manifest(docs.limit(0)).count() == 0
