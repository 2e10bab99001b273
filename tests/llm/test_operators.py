"""The training-data operators on small tables, against brute force, and on empty and odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallybook.llm import byte_bpe, components, decontaminate, jaccard_join, line_dedup, nearest, pii, quality, substring_dedup, toxicity, url_filters
from tallybook.llm.words import shingles, word_hashes

DOCS = "doc_id long, text string, n_lines string, score string, items string, h long"


def frame(spark, texts):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "x", "y", "z", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnst") + rng.choice("aeiou") for _ in range(n))


ODD = [None, "", " \n\t ", "a", "A  a", prose(1, 30000), "é" * 9, "x\n\ny\r\n", prose(2, 40), prose(2, 40)]


def test_words_and_shingles():
    text = "The  cat\tsat,\nTHE cat sat on é".encode()
    h, first, last = word_hashes(text)
    assert [text[a:b].lower() for a, b in zip(first, last)] == text.lower().split()
    assert len(set(h.tolist())) == len(set(text.lower().split()))
    long = prose(3, 30000).encode()
    words = long.split()
    assert len(shingles(long)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    texts = list(ODD)
    for n in range(12):
        words = prose(n + 50, rng.choice([3, 12, 60, 150])).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(99))
            texts.append(" ".join(copy))

    def of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [of(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_tree_lets_no_link_through():
    rng = np.random.default_rng(3)
    v = rng.poisson(2, (300, jaccard_join.GROUPS))
    v[150:] = np.maximum(v[:150] + rng.integers(-1, 2, (150, jaccard_join.GROUPS)) * (rng.random((150, jaccard_join.GROUPS)) < 0.1), 0)
    tree = jaccard_join.CountTree(v, v.sum(axis=1))
    got = set(zip(*map(list, jaccard_join.tree_pairs(tree, tree, (80, 100)))))
    n = v.sum(axis=1)
    want = {(i, j) for i in range(300) for j in range(300) if 180 * np.minimum(v[i], v[j]).sum() >= 80 * (n[i] + n[j])}
    assert got == want


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_lines(spark, room):
    line = "A line that many documents hold"
    texts = [*ODD, f"{line}\nrest one", f"  {line.lower()}\t\nrest two", f"x\n{line}", line, None]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(frame(spark, texts), broadcast_bytes=room).collect()}
    assert [got[i]["text"] for i in range(10, 15)] == ["rest one", "rest two", "x", line, None]
    assert [got[i]["n_dropped"] for i in range(10, 15)] == [1, 1, 1, 0, 0]
    assert [got[i]["text"] for i in range(10)] == ODD
    assert got[0]["n_lines"] == 1 and got[7]["n_lines"] == 4
    empty = line_dedup.drop_repeated_lines(frame(spark, []).limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_lines_of_rows_without_an_id(spark, room, monkeypatch):
    monkeypatch.setattr(line_dedup, "ASKED_KEYS", 2)
    line = "A line that many documents hold"
    own = [f"a line of one row alone, number {i}" for i in range(12)]
    rows = [(i, f"{line}\n{own[i]}") for i in range(10)] + [(None, f"{line}\n{own[10]}\n{line.upper()}"), (None, own[11]), (None, None), (None, line)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=room).collect()
    assert sorted((r["text"], r["n_dropped"]) for r in got if r["doc_id"] is None and r["text"] is not None) == [("", 1), (own[10], 2), (own[11], 0)]
    assert [(r["text"], r["n_dropped"]) for r in sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"])] == [
        *((o, 1) for o in own[:9]), (f"{line}\n{own[9]}", 0)]
    assert len(got) == len(rows)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, (2, 5000))
    index = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(a, b, np.arange(5000), a + b).to_bytes())
    found, counts, keepers = index.probe(a, b)
    assert found.all() and (counts == np.arange(5000)).all() and (keepers == a + b).all()
    assert not index.probe(a, b + 1)[0].any()


def test_spans(spark):
    passage = "One sentence of this passage has some words. Another one follows it here with more! A third ends it."
    texts = [f"Start. {passage} End of the first.", f"Other start\n{passage.upper()}\nOther end.", f"{passage} {passage}", "Short. Short.", None, ""]
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_spans(frame(spark, texts)).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["text"] == texts[0]
    assert got[1]["text"] == "Other start\nOther end." and got[1]["n_removed"] == 3
    assert got[2]["text"] == "" and got[2]["n_removed"] == 6
    assert [got[i]["text"] for i in (3, 4, 5)] == texts[3:]


def test_substring_dedup_of_short_sentences(spark):
    shouted = " ".join(f"{prose(i, 1 + i % 4)}!!" for i in range(40))
    texts = [shouted, shouted.upper(), f"Before. {shouted} {prose(99, 12)}.", "One! Two! Three!", "One! Two! Three!"]
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeated_spans(frame(spark, texts)).collect()}
    assert got[0]["text"] == shouted and got[0]["n_removed"] == 0
    assert got[1]["text"] == "" and got[1]["n_removed"] == 40
    assert got[2]["text"] == f"Before. {prose(99, 12)}." and got[2]["n_removed"] == 40
    assert got[3]["n_removed"] == got[4]["n_removed"] == 0


def test_bpe(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "q" * 3000, "Ünïcödé 123 don't", prose(4, 500), prose(4, 500)]
    for words in (0, 50_000):
        coded = byte_bpe.decode(byte_bpe.encode(frame(spark, texts), ranks, P.PATTERN, words), ranks).collect()
        for r in coded:
            text = texts[r["doc_id"]] or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text)
            assert bytes(r["decoded"]) == text.encode()
    assert byte_bpe.digests(frame(spark, []), path, P.PATTERN).count() == 0


def test_decontamination(spark):
    item = "Which of the four rivers runs through the old town? The answer to this is the small one."
    benchmark = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "")], "item_id long, text string")
    noise = prose(8, 400)
    texts = [*ODD, f"{noise} {item.upper()} {noise}", f"{noise} {item[:50]} {noise}", item]
    got = {r["doc_id"]: [i["item_id"] for i in r["items"]] for r in decontaminate.find_items(frame(spark, texts), benchmark).collect()}
    assert {i for i, x in got.items() if x} == {10, 12} and got[10] == [1]
    assert decontaminate.find_items(frame(spark, texts), benchmark.limit(0)).where("size(items) > 0").count() == 0


def test_retrieval_is_exhaustive():
    rng = random.Random(2)
    items = [(n, prose(n, 20).encode()) for n in range(200)]
    seen = [set(decontaminate.terms(t).tolist()) for _, t in items]
    frequency = {t: sum(t in s for s in seen) for s in seen for t in s}
    index = decontaminate.Index(items, frequency, len(items), 20, 0.5)
    first, part, weight = index.lists
    for _ in range(50):
        query = np.array(sorted(rng.sample(range(len(index.terms)), 40)))
        score = np.zeros(len(items))
        for t in query:
            score[part[first[t] : first[t + 1]]] += weight[first[t] : first[t + 1]]
        assert [n for n, _ in index.retrieve(query)] == np.flatnonzero(score >= index.threshold).tolist()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:600] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (920, [0.0] * 12), (940, [math.nan] + [1.0] * 11), (960, [None] + [1.0] * 11), (980, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nearest.nearest(table).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 900, 20))
    hits = []
    for q, found in got.items():
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert sorted(found) == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-9 for i, s in found.values())
        hits.append(len(set(best) & {i for i, _ in found.values()}) / 20)
    assert np.mean(hits) >= 0.9
    assert [i for _, (i, _) in sorted(got[400].items())] == list(range(300, 320))
    assert nearest.nearest(table.limit(0)).count() == 0
    few = nearest.nearest(table.where("vec_id < 5")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]


def test_chi_square():
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 0.01
    assert abs(nearest.chi_square_quantile(0.5, 2) - 1.386) < 0.01


def test_personal_data(spark):
    texts = [
        None, "", "a_b@c.org x 1.2.3.4 and 300.1.1.1", "4111 1111 1111 1111 +44 (20) 7946-0018", "a@b.c_d@e.f é x@y.zz",
        *(f"please call desk u{i}abc@mail.org for help" for i in range(6)), "please call desk u9abc(at)mail-2024.org for help", "A" * 50000,
    ]
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    spans = {i: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for i, r in got.items()}
    assert spans[2] == [(0, 0, 9), (12, 1, 19)] and spans[3] == [(0, 2, 19), (20, 3, 38)]
    assert spans[4] == [(0, 0, 5), (5, 0, 11), (14, 0, 20)] and spans[0] == spans[1] == spans[12] == []
    added = [(s["start"], s["kind"], s["end"]) for s in got[11]["spans"]]
    assert added == [(17, 4, 39)]


def test_url_rules(spark):
    urls = [
        None, "no scheme", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.www.example.com/en/y", "http://com/",
        "http://x.net/es/1", "http://net/fr", "http://org/en/", "x://example.com", "http://notexample.com/en/", "",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(list(url_filters.RULES), url_filters.RULE_SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect()}
    assert got[0] == got[1] == got[11] == ("", "", None, "allow")
    assert got[2] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[3][2:] == got[4][2:] == ("www.example.com/en/", "allow") and got[5][2] == "com/"
    assert got[6][2:] == ("net/es/", "block") and got[7][2] is None and got[8][2] is None and got[9] == ("example.com", "", None, "allow")
    assert got[10][2] == "com/"
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "RANGE_EVENTS", 4)
    hosts = [f"h{i % 7}.d{i % 5}.t{i % 3}" for i in range(60)] + ["t0", "d1.t1"]
    rules = spark.createDataFrame([(h, "/", "block") for h in set(hosts[:20])] + [("t0", "/", "allow"), ("d1.t1", "/a", "block")], url_filters.RULE_SCHEMA)
    pages = spark.createDataFrame([(i, f"http://w.{h}/a{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filters.judge(pages, rules).collect()}
    known = {(r["host"], r["path"]) for r in rules.collect()}
    for i, h in enumerate(hosts):
        fits = [a + b for a, b in known if ("w." + h).endswith("." + a) and f"/a{i}".startswith(b)]
        assert got[i] == (max(fits, key=len) if fits else None)


@pytest.mark.parametrize("score, label, column", [(quality.score, "quality", "quality"), (toxicity.score, "toxic", "toxic")])
def test_scores(spark, sf_dir, score, label, column):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 100000), (None, "a b")], "doc_id long, text string")
    rows = score(docs.unionByName(odd), labels, label).select("doc_id", "score").collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["score"] for r in rows}
    held = [(got[r["doc_id"]], r[column]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc >= (0.95 if column == "quality" else 0.75)
    none = score(docs.limit(5), labels.limit(0), label).collect()
    assert {r["score"] for r in none} == {0.5}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(kept) < len(texts) and {r["doc_id"] for r in kept} <= set(texts)
    untouched = sum(hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() == r["decoded_sha256"] for r in kept)
    assert untouched > 0


def test_sql(spark, sf_dir):
    """The queries that SQL can express, on the small tables."""
    duckdb = pytest.importorskip("duckdb")
    from tallybook.llm.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for key, sql in ORACLE.items():
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted(map(repr, cursor.fetchall()))
        assert sorted(map(repr, map(tuple, QUERIES[key](spark, sf_dir).select(*names).collect()))) == want, key
