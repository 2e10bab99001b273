"""Benchmark items found in training documents, by a BM25 index with block-max WAND.

The test items are the indexed texts and every passage of every document is a query.  A
term's weight in an item is its BM25 weight over the item's own score, so a passage that holds
all of an item scores 1.  Passages whose terms can't reach the threshold together are dropped before the
index is asked, and in the index the blocks of items whose largest weights can't reach it.  What is retrieved is verified: enough of the item's question and of its answer must
stand near the passage, as runs of three words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import shared as broadcast
from .common import sliced, table
from .words import IS_MARK, run_hashes, word_hashes

K1, B = 1.2, 0.75
#: Terms of a passage, terms between passages, terms of an indexed part of an item.
PASSAGE, STRIDE, PART = 80, 32, 48
#: Least BM25 share, and least share of question and of answer runs.
THRESHOLD, OVERLAP = 0.6, 0.6
RUN = 3
#: Postings in a block; items in an index that is broadcast at once.
BLOCK, INDEX_ITEMS = 32, 50_000


def terms(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased text's runs of letters and digits."""
    return word_hashes(text.decode("utf-8", "replace").lower().encode(), IS_MARK)[0].view(np.int64)


def question_and_answer(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Size of the runs, and the runs of the item's question and of its answer.

    The answer is the last sentence, or as much of the end as makes a run; of an item of one
    sentence, its last third.  A question too short for a run is the whole item.
    """
    of = terms(text).view(np.uint64)
    size = min(RUN, max(1, len(of)))
    last = re.split(rb"(?<=[.!?])\s+|\n+", text.strip())[-1]
    n = len(terms(last))
    if n >= len(of):
        n = len(of) // 3
    cut = len(of) - max(n, size)
    question = of[:cut] if cut >= size else of
    return size, np.unique(run_hashes(question, size)), np.unique(run_hashes(of[max(cut, 0) :], size))


def parts_of(of: np.ndarray) -> list[np.ndarray]:
    """The terms of an item in parts of like size, PART at most; a short rest would match anything."""
    return np.array_split(of, -(-len(of) // PART)) if len(of) else []


class Index:
    """Postings by term, in order of items' parts, and the largest weight of each term in each block of parts."""

    def __init__(self, items: list[tuple[int, bytes]], frequency: dict[int, int], n_parts: int, mean_terms: float, threshold: float):
        self.item_of, self.runs, self.size = [], [], []
        of_term, of_part, weight_of = [], [], []
        for item, text in items:
            of = terms(text)
            runs = question_and_answer(text)
            for part_terms in parts_of(of):
                part, tf = np.unique(part_terms, return_counts=True)
                df = np.array([frequency[int(t)] for t in part])
                idf = np.log1p((n_parts - df + 0.5) / (df + 0.5))
                weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean_terms))
                of_term.append(part)
                of_part.append(np.full(len(part), len(self.item_of)))
                weight_of.append(weight / weight.sum())
                self.item_of.append(item)
                self.runs.append(runs)
                self.size.append(len(of))
        self.threshold = threshold - 1e-9
        sizes = sorted({r[0] for r in self.runs})
        #: The runs of all items, by their number of terms; hardly any text without an item has one.
        self.known_runs = [(n, np.unique(np.concatenate([x for r in self.runs if r[0] == n for x in r[1:]]))) for n in sizes]
        if not self.item_of:
            self.terms = np.zeros(0, np.int64)
            return
        term, part, weight = np.concatenate(of_term), np.concatenate(of_part), np.concatenate(weight_of)
        order = np.lexsort((part, term))
        part, weight = part[order], weight[order]
        self.terms, place = np.unique(term[order], return_inverse=True)
        self.lists = (np.searchsorted(place, np.arange(len(self.terms) + 1)), part, weight)
        # The same by blocks of parts.
        edge = np.flatnonzero(np.diff(place * (len(self.item_of) + 1) + part // BLOCK, prepend=-1))
        self.tops = (np.searchsorted(place[edge], np.arange(len(self.terms) + 1)), part[edge] // BLOCK, np.maximum.reduceat(weight, edge))
        self.need = self._need(place, part, weight, np.array([frequency[int(t)] for t in self.terms]), n_parts)

    def _need(self, place, part, weight, df, n_parts) -> np.ndarray:
        """Per term the largest share of what a part still needs that the term can bring.

        Common terms alone bring a part some of the threshold, so rare ones must bring the rest.  A part
        that common terms nearly suffice for counts all its terms.  A passage whose shares sum to less than 1
        reaches no part.
        """
        common = (df > 0.05 * n_parts)[place]
        given = np.bincount(part, np.where(common, weight, 0.0), minlength=len(self.item_of))
        plain = given > 0.8 * self.threshold
        left = np.where(plain, self.threshold, self.threshold - given)
        share = np.where(common & ~plain[part], 0.0, weight / left[part])
        need = np.zeros(len(self.terms))
        np.maximum.at(need, place, share)
        return need

    def retrieve(self, query: np.ndarray) -> list[tuple[int, float]]:
        """All parts whose weights of the query's terms sum to the threshold or more.

        Blocks of parts whose largest weights don't sum to it are skipped, as in block-max WAND, with all
        blocks judged at once instead of a pivot moving over them.
        """
        reach = _sums(self.tops, query, -(-len(self.item_of) // BLOCK))
        hot = reach >= self.threshold
        if not hot.any():
            return []
        score = _sums(self.lists, query, len(self.item_of), hot)
        found = np.flatnonzero(score >= self.threshold)
        return list(zip(found.tolist(), score[found].tolist()))

    def find(self, text: bytes, overlap: float) -> list[tuple[int, float, float, float]]:
        """item, BM25 share, question share and answer share of every item that the text holds."""
        of = terms(text)
        if not len(of) or not len(self.terms):
            return []
        # What is retrieved must share runs with the item to be kept, so passages away from all items' runs aren't asked for.
        held = np.zeros(len(of) + 1, np.int64)
        for n, runs in self.known_runs:
            own = run_hashes(of.view(np.uint64), n)
            held[: len(own)] += runs[np.minimum(np.searchsorted(runs, own), len(runs) - 1)] == own
        least = min(overlap * max(map(len, r[1:])) for r in self.runs)
        if held.sum() < least:
            return []
        held = np.concatenate(([0], np.cumsum(held)))
        reach = max(self.size)
        at = np.minimum(np.searchsorted(self.terms, of), len(self.terms) - 1)
        known = self.terms[at] == of
        share = np.concatenate(([0.0], np.cumsum(np.where(known, self.need[at], 0.0))))
        starts = np.arange(0, max(1, len(of) - PASSAGE + STRIDE), STRIDE)
        ends = np.minimum(starts + PASSAGE, len(of))
        # Repeated terms count again here, so this bound is never too small.
        hot = share[ends] - share[starts] >= 1 - 1e-6
        hot &= held[np.minimum(ends + reach, len(of))] - held[np.maximum(starts - reach, 0)] >= least
        best: dict[int, tuple[float, float, float]] = {}
        for s, e in zip(starts[hot].tolist(), ends[hot].tolist()):
            query = np.unique(at[s:e][known[s:e]])
            if self.need[query].sum() < 1 - 1e-6:
                continue
            for number, score in self.retrieve(query):
                size, *wanted = self.runs[number]
                reach = self.size[number]
                near = run_hashes(of[max(0, s - reach) : e + reach].view(np.uint64), size)
                shares = [float(np.isin(r, near).mean()) if len(r) else 1.0 for r in wanted]
                if min(shares) >= overlap:
                    item = self.item_of[number]
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, *shares))
        return [(item, *v) for item, v in sorted(best.items())]


def _sums(lists, query: np.ndarray, size: int, hot: np.ndarray | None = None) -> np.ndarray:
    """Sum of the query's postings by part, or of those in hot blocks."""
    first, part, weight = lists
    take = np.concatenate([np.arange(first[t], first[t + 1]) for t in query])
    if hot is not None:
        take = take[hot[part[take] // BLOCK]]
    return np.bincount(part[take], weight[take], minlength=size)


def term_frequencies(benchmark: DataFrame) -> DataFrame:
    """block, term, df, and in a row with a null term the parts and their terms: over all items."""

    def rows(batches):
        for batch in batches:
            term, n = [], []
            for t in batch.column(0).cast(pa.binary()):
                of = terms(t.as_py() or b"")
                for part in parts_of(of):
                    term.extend(np.unique(part).tolist())
                    term.append(None)
                    n.extend([1] * len(np.unique(part)))
                    n.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    return benchmark.select(F.col("text").cast("string")).mapInArrow(rows, "term long, n long").groupBy("term").agg(
        F.count("*").alias("df"), F.sum("n").alias("n")
    )


def indexes(benchmark: DataFrame, threshold: float):
    """One index after the other, each of about INDEX_ITEMS items, with weights from all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id is not null and text is not null"
    )
    n = items.count()
    blocks = max(1, -(-n // INDEX_ITEMS))
    frequency = term_frequencies(items)
    whole = frequency.where("term is null").first()
    if whole is None:
        return
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        texts = sorted((r["item_id"], r["text"].encode()) for r in part.distinct().collect())
        own = frequency.where("term is not null")
        if blocks > 1:
            own = own.join(term_frequencies(part).where("term is not null").select("term"), "term", "left_semi")
        yield Index(texts, {r["term"]: r["df"] for r in own.collect()}, whole["df"], whole["n"] / whole["df"], threshold)


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs with `items`: the benchmark items that the text holds, as (item_id, score, question, answer).

    score is the best passage's share of the item's own BM25 score, question and answer the
    shares of their runs.  Null and empty texts hold nothing, and items without a text or an id are in nothing; copies of a
    row are treated alike; an empty benchmark is found nowhere.  Items of one term or more are
    looked for.  Other columns are carried along, but for one named items.  A benchmark of more than INDEX_ITEMS items
    is indexed in blocks, and the documents are read once for each.
    """
    spark = docs.sparkSession
    docs = docs.drop("items")
    kind = StructType().add("item_id", LongType()).add("score", DoubleType()).add("question", DoubleType()).add("answer", DoubleType())
    found = docs.withColumn("items", F.array().cast(ArrayType(kind)))
    names = docs.columns
    at = names.index("text")

    def reader(shared):
        def run(batches):
            index = shared.value
            for batch in sliced(batches, at):
                out = []
                for text, before in zip(batch.column(at).cast(pa.string()).cast(pa.binary()), batch.column(len(names))):
                    hits = index.find(text.as_py() or b"", overlap)
                    out.append((before.as_py() or []) + [dict(zip(("item_id", "score", "question", "answer"), h)) for h in hits])
                arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, arrow)], [*names, "items"])

        return run

    for index in indexes(benchmark, threshold):
        found = found.mapInArrow(reader(broadcast(spark, index)), found.schema)
    return found


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.inline("items"))
