"""Byte-level BPE by Spark higher-order functions, and decoding by joining pieces.

Texts are cut by the tokenizer's pattern and the distinct words are counted.  The words
above a count threshold form a dictionary of bounded size, which is encoded as rows of
distinct words by a fold that merges the lowest-ranked neighbours of an array of byte pieces,
with the rank map as a literal.  Document tasks look words up in it; the rare words outside it
are merged in the task by the same rule, each once a batch, because the fold takes about 0.1 ms of CPU
a word.  Decoding joins the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shared as broadcast
from .common import sliced, stored, table

#: Words in the dictionary at most.
DICTIONARY_WORDS = 100_000
#: Longer words would make the fold quadratic; a heap merges them.
FOLD_BYTES = 48
#: Counts above this are one step of the histogram that sets the threshold.
TOP_COUNT = 100_000
#: The literal is an array of small maps, dealt by CRC-32, as a map is searched from its start.
RANK_BUCKETS = 1 << 14
NO_RANK = 2**31 - 1
#: Distinct words that a task counts, or keeps the ids of, before it starts again.
WORDS_AT_ONCE = 1 << 17
#: Bits that hold where a piece of a folded word starts.
START_BITS = 6


def load_ranks(path: str) -> dict[bytes, int]:
    """The pieces and ranks of a vocabulary file: a base64 piece and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


# --- the fold ------------------------------------------------------------------------------


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<hex of a piece, rank>> as one foldable literal."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % RANK_BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def _rank_of(rank_map: Column, piece: Column) -> Column:
    bucket = F.element_at(rank_map, F.crc32(piece).bitwiseAND(F.lit(RANK_BUCKETS - 1)).cast("int") + 1)
    return F.coalesce(F.element_at(bucket, piece), F.lit(NO_RANK))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _packed(rank: Column, start: Column) -> Column:
    return F.shiftleft(rank.cast("bigint"), START_BITS).bitwiseOR(start.cast("bigint"))


def _start(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")


def _merge_once(state: Column, between: Callable[[Column, Column], Column]) -> Column:
    """state after the first merge of its lowest rank.

    An element stands for a piece: the rank of the piece joined with the next one, and the byte it
    starts at, so the least element is the leftmost of the best merges.  The last one only marks the end.
    """

    def merged(at: Column) -> Column:
        """at: the place of the merged piece, from 1."""
        first, last = _start(F.element_at(state, at)), _start(F.element_at(state, at + 2))
        size = F.size(state)
        with_next = F.when(at + 2 < size, between(first, _start(F.element_at(state, at + 3)))).otherwise(F.lit(NO_RANK))
        before = _start(F.element_at(state, at - 1))
        rest = F.slice(state, at + 2, size)
        joined = F.array(_packed(with_next, first))
        return F.when(at == 1, F.concat(joined, rest)).otherwise(
            F.concat(F.slice(state, 1, at - 2), F.array(_packed(between(before, last), before)), joined, rest)
        )

    def best_of(best: Column) -> Column:
        place = F.size(F.filter(state, lambda x: _start(x) < _start(best))) + 1
        return F.when(best >= NO_RANK << START_BITS, state).otherwise(_named(place, merged))

    return _named(F.array_min(state), best_of)


def encode_words(words: Column, rank_map: Column) -> Column:
    """array<string> of words of at most FOLD_BYTES bytes to array<array<int>> of ids, in order."""

    def encode(bytes_hex: Column, ranks: Column) -> Column:
        n = F.shiftright(F.length(bytes_hex), 1)

        def between(first: Column, last: Column) -> Column:
            """The rank of the bytes from first to before last."""
            return _rank_of(ranks, F.substring(bytes_hex, first * 2 + 1, (last - first) * 2))

        start = F.transform(
            F.sequence(F.lit(0), n),
            lambda i: _packed(F.when(i < n - 1, between(i, i + 2)).otherwise(F.lit(NO_RANK)), i),
        )
        # As many merges at most as there are neighbours.
        fold = _named(
            start,
            lambda s: F.aggregate(
                F.slice(s, 1, n - 1), s, lambda state, _: _merge_once(state, between),
                lambda state: F.transform(
                    F.slice(state, 1, F.size(state) - 1), lambda x, i: between(_start(x), _start(F.element_at(state, i + 2)))
                ),
            ),
        )
        # A word that is a piece, as all of one byte are, is not taken apart.
        return _named(_rank_of(ranks, bytes_hex), lambda whole: F.when(whole < NO_RANK, F.array(whole)).otherwise(fold))

    # The literal is named once, so that the plan holds it once.
    return _named(rank_map, lambda ranks: F.transform(words, lambda w: _named(F.hex(F.encode(w, "utf-8")), lambda h: encode(h, ranks))))


def encode_rare(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word outside the dictionary: a scan for short ones, a heap for long ones."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > FOLD_BYTES:
        return _merge_by_heap(word, ranks)
    cuts = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pair and (best := min(pair)) != NO_RANK:
        i = pair.index(best)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[cuts[i] : cuts[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], NO_RANK)
    return [ranks[word[x:y]] for x, y in zip(cuts, cuts[1:])]


def _merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        right = after[i]
        alive[right] = False
        end[i], after[i] = stop, after[right]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# --- dictionary ----------------------------------------------------------------------------


def word_rows(docs: DataFrame, pattern: str) -> DataFrame:
    """word, n: how often each run of documents of a task holds each word; the counts of all runs add up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in sliced(batches, 0):
            for text in batch.column(0):
                seen.update(find(text.as_py() or ""))
            if len(seen) > WORDS_AT_ONCE:
                yield counted()
        yield counted()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "word string, n long")


def common_words(docs: DataFrame, pattern: str, most: int = DICTIONARY_WORDS) -> DataFrame:
    """The words of the highest counts: all words at or above the least count that leaves at most `most`."""
    counts = stored(
        word_rows(docs, pattern).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word-counts"
    )
    steps = counts.groupBy(F.least("n", F.lit(TOP_COUNT)).alias("n")).count().orderBy(F.desc("n")).collect()
    total, threshold = 0, None
    for step in steps:
        total += step["count"]
        if total > most:
            break
        threshold = step["n"]
    if threshold is None:
        return counts.where(F.lit(False)).select("word")
    return counts.where(F.col("n") >= threshold).where(F.octet_length("word") <= FOLD_BYTES).select("word")


# --- documents -----------------------------------------------------------------------------


class Pieces:
    """The bytes of every id, laid end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        parts = [b""] * size
        for piece, rank in ranks.items():
            parts[rank] = piece
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1])).astype(np.int64) if size else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> bytes:
        out = []
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            length = self.length[part]
            ends = np.cumsum(length)
            shift = np.repeat(self.start[part] - (ends - length), length)
            out.append(self.bytes[np.arange(len(shift)) + shift].tobytes())
        return b"".join(out)


class WordIds(dict):
    """word -> its ids as bytes: from the dictionary, or merged here once."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__()
        self.known, self.ranks = known, ranks

    def __missing__(self, word: str) -> bytes:
        blob = self.known.get(word)
        if blob is None:
            ids = encode_rare(word.encode(), self.ranks)
            blob = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = blob
        return blob

    def encode(self, words: list[str]) -> bytes:
        if len(self) > WORDS_AT_ONCE:
            self.clear()
        return b"".join(map(self.__getitem__, words))


def _dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int):
    """A broadcast of the folded words' ids and of the ranks."""
    coded = common_words(docs, pattern, most).withColumn("ids", F.element_at(encode_words(F.array("word"), rank_literal(ranks)), 1))
    # By Arrow: a row of Python objects for each word and id would take the driver many times their bytes.
    known: dict[str, bytes] = {}
    for batch in coded.select("word", "ids").toArrow().to_batches():
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        known.update((word.as_py(), part.tobytes()) for word, part in zip(batch.column("word"), np.split(flat, ends[:-1])))
    return broadcast(docs.sparkSession, (known, ranks))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """docs with `ids`: its text's token ids, little-endian unsigned 32-bit integers end to end.

    A null or empty text has no ids.  Rows are kept one for one, repeated ones too; all
    other columns are carried along, but for those named like the ones added here.
    Two things are broadcast: the dictionary, at most `dictionary_words` words of
    at most FOLD_BYTES bytes, and the vocabulary file's pieces.  Neither grows with the documents.
    """
    docs = docs.drop("ids")
    words = _dictionary(docs, ranks, pattern, dictionary_words)
    names = docs.columns
    at = names.index("text")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids_of = regex.compile(pattern).findall, WordIds(*words.value)
        for batch in sliced(batches, at):
            out = [ids_of.encode(find(text.as_py() or "")) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "ids"])

    return docs.mapInArrow(put_together, StructType([*docs.schema.fields]).add("ids", "binary"))


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """rows with `decoded`: the pieces of `ids` joined, as binary.  Null ids decode to nothing."""
    rows = rows.drop("decoded")
    all_pieces = broadcast(rows.sparkSession, Pieces(ranks))
    names = rows.columns
    at = names.index("ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = all_pieces.value
        for batch in sliced(batches, at):
            out = [pieces.decode(np.frombuffer(i.as_py() or b"", "<u4")) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return rows.mapInArrow(read, StructType([*rows.schema.fields]).add("decoded", "binary"))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    Texts are encoded, and their ids decoded, as by encode() and decode(), but in one task that keeps neither.
    """
    ranks = load_ranks(vocabulary)
    words = _dictionary(docs, ranks, pattern, DICTIONARY_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids_of, pieces = regex.compile(pattern).findall, WordIds(*words.value), Pieces(words.value[1])
        for batch in sliced(batches, 1):
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = ids_of.encode(find(text.as_py() or ""))
                sizes.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(pieces.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                [c.split()[0] for c in DIGESTS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
