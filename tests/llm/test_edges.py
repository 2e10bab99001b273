"""Slices of batches, and the pipeline's stages on odd tables."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from tallybook.llm import byte_bpe, common, jaccard_join, substring_dedup, toxicity


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["a" * 4, None, "é" * 30, "", "b" * 9, "c" * 2, None, "d" * 11, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(common.sliced([batch, batch.slice(0, 0), batch.slice(3, 4)], 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(9), 3, 4, 5, 6]
    assert all(p.num_rows for p in parts)
    for p in parts:
        sizes = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        # What stands before a slice's last text is less than a slice.
        assert sum(sizes[:-1]) < 10 + max(sizes)


def test_words_are_merged_again_after_the_store_is_emptied(monkeypatch):
    monkeypatch.setattr(byte_bpe, "WORDS_AT_ONCE", 3)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    ids = byte_bpe.WordIds({"abc": (257).to_bytes(4, "little")}, ranks)
    want = b"".join(i.to_bytes(4, "little") for i in (257, 256, 97, 97, 99))
    for _ in range(5):
        assert ids.encode(["abc", "ab", "a", "ac"]) == want


def test_all_windows_and_whole_texts_count():
    rng = random.Random(7)

    def prose(n):
        return " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("klmnst") + rng.choice("aeiou") for _ in range(n))

    contents = toxicity.dictionaries([f"{prose(30)} grublotzen {prose(9)}".encode() for _ in range(60)], [prose(40).encode() for _ in range(60)])
    pair = toxicity.make_pair(*contents)
    calm = prose(20000)
    plain, late = (toxicity.features(t.encode(), *pair) for t in (calm, f"{calm} {'grublotzen ' * 9}"))
    assert late[0] > plain[0] and late[9] > plain[9] and late[11] > plain[11]
    assert toxicity.features(b"", *pair) == [0.0] * 12


ROWS = [(1, "a b c", 1.0, "it", 3), (None, None, 2.0, "x", 0), (1, "a b c", 1.0, "it", 3), (2, "", 0.0, "y", 0), (3, "word " * 30000, 0.5, "z", 1)]


@pytest.mark.parametrize("n", range(4))
def test_stages_carry_columns_whatever_their_names(spark, sf_dir, n):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[n]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score double, items string, others int").repartition(3)
    kept = stage(spark, docs, sf_dir)
    assert kept.schema.names == docs.schema.names
    rows = [tuple(r) for r in kept.collect()]
    assert set(rows) <= set(ROWS) and all(rows.count(r) == ROWS.count(r) for r in rows), name
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_passages_go_with_their_last_sentences(spark):
    passage = "One sentence of this passage has quite some words in it. Then one more. And the end."
    long = " ".join(f"Sentence number {i} of a long text, which ends." for i in range(20000))
    texts = [f"Start. {passage} Own words stand here now.", f"Another start. {passage} Then other words follow, ever so many more of them. And on.", passage, passage, None, "", long, long]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, passage, "x"), (None, passage, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string").repartition(3)
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in substring_dedup.drop_repeated_spans(docs).collect()]
    of = dict((i, (t, n)) for i, t, n in got if i is not None)
    assert of[0] == (texts[0], 0)
    assert of[1] == ("Another start. Then other words follow, ever so many more of them. And on.", 3)
    assert of[2] == of[3] == ("", 3) and got.count((2, "", 3)) == 2
    assert of[4] == (None, 0) and of[5] == ("", 0) and of[6] == (long, 0) and of[7] == ("", 20000)
    assert (None, passage, 0) in got
    assert substring_dedup.drop_repeated_spans(docs.limit(0)).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(50)) for _ in range(60)) for _ in range(8)]
    rows = []
    for _ in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = "changed"
        rows.append((rng.choice([None, *range(40)]), " ".join(words)))
    rows += [(50, "x y"), (50, base[0]), (51, "x  Y"), (52, None), (None, "x y"), (53, "")]

    def of(t):
        w = [x.lower() for x in re.findall(r"[^ ]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, of(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if x and y and root[a] != root[b] and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, doc int").repartition(4)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == root
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(of(t)) for _, t in rows)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
