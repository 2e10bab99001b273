from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallybook.llm import chat_format
from tallybook.llm.chat_template import Const, Escape, Out, Template, TemplateError, unescape

TABLE = "conv_id long, turn long, role string, text string, formatted string, whole string, piece long"
NUMBERED = (
    "{# remark #}<head>{% set dash = '-' ~ '-' %}{% for m in messages -%} {% if loop.first %}<first>{% elif loop.last %}<last>{% endif %}"
    "{% set who = m['role'] | upper if m.role != 'user' else 'me' %}{{ loop.index ~ dash ~ who }}:"
    "{% if 'sist' in m.role %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape | trim }}{% endif %};"
    "{%- endfor %}<tail>"
)


def test_rendering():
    t = Template(NUMBERED, ("[x]",))
    out = t.render([("user", " a "), ("assistant", "[x]\\"), ("tool", "c")])
    assert out.text() == r"<head><first>1--me:a;2--ASSISTANT:\[x]\\;<last>3--TOOL:c;<tail>"
    assert [out.text()[a:b] for a, b in out.spans] == ["\\[x]\\\\"]
    assert t.render([]).text() == "" and t.render([(None, None)]).text() == "<head><first>1--:;<tail>"


def test_constants_are_folded():
    t = Template("a{% set b = 'x' ~ 1 ~ true %}{% if b == 'x1true' and not false %}{{ b | upper }}{% else %}{{ nothing }}{% endif %}"
                 "{% for m in messages %}{{ ('p' ~ 'q') ~ m.text ~ ('r' | upper) ~ 's' }}{% endfor %}")
    assert t.before == "aX1TRUE" and t.tree[0] == Out(Const("aX1TRUE"))
    assert [p for p in t.tree[1].body[0].value.parts if isinstance(p, Const)] == [Const("pq"), Const("Rs")]


@pytest.mark.parametrize("source", [
    "", "{% for m in messages %}", "{% for m in messages %}{{ m.text.__class__ }}{% endfor %}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}",
    "{% for m in messages %}{{ m.text | eval }}{% endfor %}", "{% for m in messages %}{{ range(9) }}{% endfor %}", "{% for m in messages %}{{ x }}{% endfor %}",
    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ m.text }}{% for m in messages %}{% endfor %}", "{% while true %}{% for m in messages %}{% endfor %}",
    "{% for m in range %}{% endfor %}", "{% for m in messages %}{% if m.text %}{% set a = 1 %}{% endif %}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}", "{{ 'a' {% for m in messages %}{% endfor %}",
])
def test_the_sandbox(source):
    with pytest.raises(TemplateError):
        Template(source)


@given(st.text("\\n<s>/[INST] \na", max_size=40), st.text("\\n<s>/[INST] \na", max_size=20))
def test_escapes_are_reversible(text, role):
    guard = Escape(chat_format.CONTROLS)
    assert unescape(guard.text(text)) == text and unescape(guard.line(text)) == text and "\n" not in guard.line(text)
    out = Template(chat_format.CHAT, chat_format.CONTROLS).render([(role, text), ("assistant", text), ("assistant", "")])
    assert list(chat_format.read_turns(out.text())) == [(role, text), ("assistant", text), ("assistant", "")]
    assert [unescape(out.text()[a:b]) for a, b in out.spans] == [text] * ((role == "assistant") + 1) + [""]


def conversations():
    rng = random.Random(6)
    rows = [(5, i, rng.choice(["user", "assistant", None]), rng.choice([None, "", "x" * rng.randrange(90), "</s>[INST] é\\"])) for i in range(300)]
    rows += [(c, t, rng.choice(["user", "assistant", "a\nb"]), f"said {c} {t}") for c in range(60) for t in range(rng.randrange(6))]
    rows += [(None, None, "user", "no ids"), (None, 1, "assistant", "x"), (7, None, "user", "first"), (8, 1, "user", "tie b"), (8, 1, "user", "tie a")]
    rows += [(9, 3, "assistant", "same")] * 80 + [(10, 0, "assistant", "long " * 5000)]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    def key(r):
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest())

    return {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in {r[0] for r in rows}}


@pytest.mark.parametrize("chars", [1 << 21, 200])
def test_formatting_against_one_conversation_at_a_time(spark, monkeypatch, chars):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", chars)
    rows = conversations()
    frame = spark.createDataFrame([(*r, "f", "w", 1) for r in rows], TABLE).repartition(5)
    for source, controls in ((NUMBERED, ()), (chat_format.CHAT, chat_format.CONTROLS)):
        template, got = Template(source, controls), {}
        for r in sorted(chat_format.formatted(frame, source, controls).collect(), key=lambda r: r["piece"]):
            got.setdefault(r["conv_id"], []).append(r)
        want = in_order(rows)
        assert set(got) == set(want)
        for c, pieces in got.items():
            out = template.render(want[c])
            assert "".join(p["formatted"] for p in pieces) == out.text()
            learned = [p["formatted"][s["start"] : s["end"]] for p in pieces for s in p["loss"]]
            assert learned == [out.text()[a:b] for a, b in out.spans]
            assert sum(p["n_turns"] for p in pieces) == len(want[c]) and [p["whole"] for p in pieces] == [len(pieces) == 1] * len(pieces)
        if chars == 200:
            # No piece but a single turn is longer: a hot conversation is spread.
            assert len(got[5]) > 20


@pytest.mark.parametrize("chars", [1 << 21, 200])
def test_digests(spark, monkeypatch, chars):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", chars)
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.formatted(frame)).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    template = Template(chat_format.CHAT, chat_format.CONTROLS)
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[c])[1:] == (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest(), template.render(turns).length,
        )
    assert chat_format.digests(chat_format.formatted(frame.limit(0))).count() == 0
