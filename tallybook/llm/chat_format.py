r"""Conversations as training text, by a template compiled to closures, with the spans to learn from.

Rows are range partitioned by (conversation, turn), so a conversation of any length is
spread over tasks.  A task renders the conversations that lie whole in its range; those that may go on in
another range, and long ones, wait as chunks of turns, get their first turn's number from the counts
of the ranges before, and are rendered chunk by chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import Template, Written, unescape
from .common import shuffle_partitions, stored, table

#: Marks of the template below, guarded inside texts.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
CHAT = r"""
{%- set begin = '[' ~ 'INST] ' -%}
{%- for message in messages -%}
  {%- if message.role == 'assistant' -%}
    {{ '<s>' ~ 'assistant\n' }}{% generation %}{{ message.text | escape }}{% endgeneration %}{{ '</s>\n' }}
  {%- else -%}
    {{ begin ~ (message.role | escape_line) ~ '\n' ~ (message.text | escape) ~ ' [/INST]\n' }}
  {%- endif -%}
{%- endfor -%}
"""
#: Characters of text in a piece; a longer conversation comes in several.  One turn is never cut.
PIECE_CHARS = 1 << 21
#: Characters of formatted text that a task holds before it hands rows on.
SLICE_CHARS = 1 << 23

TURNS = "array<struct<role:string,text:string>>"
LOSS = "array<struct<start:long,end:long>>"
PIECES = f"conv_id long, part int, seq long, first_run boolean, last_run boolean, ends boolean, start long, n_turns long, turns {TURNS}, formatted string, loss {LOSS}"
_TURNS_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_LOSS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rendered(template: Template, turns: list[tuple], start: int, final: bool) -> Written:
    out = Written()
    for n, values in enumerate(turns):
        template.turn(values, start + n, final and n == len(turns) - 1, out)
    return out


def _spans(out: Written) -> list[dict]:
    return [{"start": a, "end": b} for a, b in out.spans]


class _Range:
    """The sorted rows of one range, cut into runs of a conversation and chunks of a run."""

    def __init__(self, template: Template, part: int):
        self.template, self.part = template, part
        self.rows: list[tuple] = []
        self.held = 0
        self.seq = self.run = 0
        self.conv: object = None
        self.begun = False
        self.turns: list[tuple] = []
        self.chars = self.start = 0
        # A chunk of the run that is under way has been handed on: all of its chunks wait.
        self.waits = True

    def _chunk(self, ends: bool, last_run: bool) -> None:
        formatted = loss = turns = None
        waits = self.waits or last_run or not ends
        if waits:
            turns = [{"role": r, "text": t} for r, t in self.turns]
            self.held += self.chars
        else:
            out = _rendered(self.template, self.turns, 0, True)
            formatted, loss = out.text(), _spans(out)
            self.held += out.length
        self.rows.append((self.conv, self.part, self.seq, self.run == 0, last_run, ends, self.start, len(self.turns), turns, formatted, loss))
        self.seq += 1
        self.start += len(self.turns)
        self.turns, self.chars, self.waits = [], 0, waits

    def add(self, conv, role: str, text: str) -> None:
        if self.begun and conv != self.conv:
            self._chunk(True, False)
            self.run += 1
            self.start, self.waits = 0, False
        elif self.turns and self.chars + len(text) > PIECE_CHARS:
            self._chunk(False, False)
        self.conv, self.begun = conv, True
        self.turns.append((role, text))
        self.chars += len(role) + len(text)

    def end(self) -> None:
        if self.begun:
            self._chunk(True, True)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 11
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), _TURNS_TYPE, pa.string(), _LOSS_TYPE]
        names = [c.split()[0] for c in PIECES.split(", ")]
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _in_ranges(rows: DataFrame, source: str, controls: tuple[str, ...]) -> DataFrame:
    """Sorted ranges of (conv_id, role, text) as pieces, rendered where they are whole conversations."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_ = _Range(Template(source, controls), TaskContext.get().partitionId())
        for batch in batches:
            for conv, role, text in zip(*batch.columns):
                range_.add(conv.as_py(), role.as_py(), text.as_py())
                if range_.held > SLICE_CHARS:
                    yield range_.batch()
        range_.end()
        yield range_.batch()

    return rows.mapInArrow(step, PIECES)


def _carried(ends: list[tuple]) -> tuple[list[int], list[bool]]:
    """ends: (part, conv, is first run, is last run, turns up to there) of the first and last runs of the ranges that have rows.

    For each range: the number of its first turn within the conversation, and whether the next range goes on with the last one.
    """
    size = max((e[0] for e in ends), default=-1) + 1
    begins, goes_on = [0] * size, [False] * size
    before: tuple | None = None
    for part, conv, is_first, is_last, turns in sorted(ends, key=lambda e: (e[0], not e[2], e[3])):
        start = 0
        if is_first and before and before[1] == conv:
            start = begins[part] = before[2]
            goes_on[before[0]] = True
        if is_last:
            before = (part, conv, start + turns)
    return begins, goes_on


def formatted(conversations: DataFrame, source: str = CHAT, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Per conversation: conv_id, piece, whole, n_turns, formatted, loss (spans of `formatted`, in code points).

    A conversation comes as one row (`whole`), or, if it is longer than PIECE_CHARS or lies where two ranges meet, as several: their
    `formatted` joined in the order of `piece` is its text, and their turns and spans are those of the piece.

    Turns are in the order of `turn`, null first; turns of one number by a hash of role and text; rows that repeat
    are all turns.  Null texts and roles are empty.  A null conv_id is a conversation of its own.  An
    empty table gives no rows.  Columns other than conv_id, turn, role and text are not read.  Texts are used whole.  What
    comes to the driver is two rows per range.
    """
    Template(source, controls)
    spark = conversations.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.md5(F.concat(role, F.lit("\n"), text)).alias("tie"), F.spark_partition_id().alias("source"),
    )
    order = ["conv_id", "turn", "tie", "source"]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    pieces = stored(_in_ranges(dealt.select("conv_id", "role", "text"), source, controls), "conversations")
    done = pieces.where("turns is null").select(
        "conv_id", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("whole"), "n_turns", "formatted", "loss"
    )
    waiting = pieces.where("turns is not null")
    ends = waiting.where("first_run or last_run").groupBy("part", "conv_id", "first_run", "last_run").agg(F.max(F.col("start") + F.col("n_turns")))
    begins, goes_on = _carried([tuple(r) for r in ends.collect()])
    begin = F.element_at(F.from_json(F.lit(json.dumps(begins)), "array<bigint>"), F.col("part") + 1)
    on = F.element_at(F.from_json(F.lit(json.dumps(goes_on)), "array<boolean>"), F.col("part") + 1)
    numbered = waiting.select(
        "conv_id", (F.shiftleft(F.col("part").cast("long"), 33) + F.col("seq")).alias("piece"), "n_turns", "turns",
        (F.col("start") + F.when(F.col("first_run"), begin).otherwise(F.lit(0))).alias("start"),
        (F.col("ends") & ~(F.col("last_run") & on)).alias("final"),
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)
        for batch in batches:
            # A row holds PIECE_CHARS or one turn, so rows go one at a time.
            for n in range(batch.num_rows):
                conv, piece, n_turns, turns, start, final = (c[n].as_py() for c in batch.columns)
                out = _rendered(template, [(t["role"], t["text"]) for t in turns], start, final)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([conv], pa.int64()), pa.array([piece], pa.int64()), pa.array([final and not start], pa.bool_()),
                        pa.array([n_turns], pa.int64()), pa.array([out.text()], pa.string()), pa.array([_spans(out)], _LOSS_TYPE),
                    ],
                    ["conv_id", "piece", "whole", "n_turns", "formatted", "loss"],
                )

    late = numbered.mapInArrow(render, f"conv_id long, piece long, whole boolean, n_turns long, formatted string, loss {LOSS}")
    return done.unionByName(late)


# --- reading back --------------------------------------------------------------------------

_MARKS = {"<s>": re.compile(r"\\.|(</s>\n)", re.DOTALL), "[INST]": re.compile(r"\\.|( \[/INST\]\n)", re.DOTALL)}


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of text that CHAT has formatted."""
    at = 0
    while at < len(text):
        mark = "<s>" if text.startswith("<s>", at) else "[INST]"
        line = text.index("\n", at)
        role = unescape(text[at + len(mark) : line].removeprefix(" " if mark == "[INST]" else ""))
        end = next(m for m in _MARKS[mark].finditer(text, line + 1) if m.group(1))
        yield role, unescape(text[line + 1 : end.start()])
        at = end.end()


class _Digest:
    def __init__(self, conv):
        self.conv = conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in read_turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in spans:
            learned = unescape(text[span["start"] : span["end"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.formatted_chars += len(text)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from formatted pieces.

    Whole conversations are read where they are.  Pieces of others are dealt by conversation and read in order, a piece at
    a time: a digest runs over a text from its start to its end, so it can't be split, but no task holds a conversation.
    """

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        columns = list(zip(*[d.row() for d in done])) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _DIGEST_TYPES)], [c.split()[0] for c in DIGESTS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, whole, text, loss in zip(*batch.columns):
                if now is None or whole.as_py() or now.conv != conv.as_py():
                    if now:
                        done.append(now)
                    now = _Digest(conv.as_py())
                now.add(text.as_py(), loss.as_py())
            yield rows(done)
        if now:
            yield rows([now])

    columns = ["conv_id", "whole", "formatted", "loss"]
    whole = pieces.where("whole").select(*columns).mapInArrow(read, DIGESTS)
    cut = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(cut.select(*columns).mapInArrow(read, DIGESTS))


#: A conversation whose texts hold the template's own marks, and more.
TRIAL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.createDataFrame(TRIAL, "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.unionByName(trial)))


def _sql() -> str:
    chars = "length({0})".format
    # A backslash for each backslash and for each place where a mark begins.
    extra = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS))
    text, role = "t", "ro"
    says = f"CASE WHEN {role} = 'assistant' THEN {len('<s>assistant') + 1 + len('</s>') + 1} ELSE {len('[INST] ') + 1 + len(' [/INST]') + 1} + {chars(role)} + {extra.format(role)} + length({role}) - length(replace({role}, chr(10), '')) END"
    trial = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in TRIAL)
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {trial})),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS ro, coalesce(text, '') AS t FROM rows_),
tied AS (SELECT *, md5(ro || chr(10) || t) AS tie FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(ro || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
  sum(CASE WHEN ro = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN ro = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, tie)) AS loss_sha256,
  sum({says} + {chars(text)} + {extra.format(text)})::BIGINT AS formatted_chars
FROM tied GROUP BY conv_id"""


OP12_SQL = _sql()
