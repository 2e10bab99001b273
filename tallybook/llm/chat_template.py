r"""A small template language for conversations, compiled to Python closures.

    {{ expression }}    {% if e %} {% elif e %} {% else %} {% endif %}    {% set name = e %}    {# remark #}
    {% for message in messages %} ... {% endfor %}     one loop, at the top level
    {% generation %} ... {% endgeneration %}           what a model learns to say, inside the loop

Expressions: strings, whole numbers, true, false, none; names; message.field, message['field'], loop.index,
loop.index0, loop.first, loop.last; == != in not and or; ~ joins; a if c else b; value | filter.  A minus inside a tag's
brackets strips the white space next to it.

A source is parsed to a tree, constants are folded, names are bound to places, and every node becomes a closure.
The language is a sandbox: there are no calls, no attributes but those above, no Python objects and
no loop but one, all names are checked before anything runs, and a turn's output is linear in its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

LOOP_FIELDS = ("index0", "index", "first", "last")


class TemplateError(ValueError):
    """The source isn't a template of the language."""


# --- escaping ------------------------------------------------------------------------------


class Escape:
    """Control strings inside a text get a backslash before each place where one begins; so do backslashes."""

    def __init__(self, controls: tuple[str, ...]):
        if any(not c or c[0] in "\\n" for c in controls):
            raise TemplateError("a control string can't be empty or begin with a backslash or an n")
        starts = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
        self._find = re.compile(rf"\\|(?={starts})." if controls else r"\\", re.DOTALL)

    def text(self, value: str) -> str:
        return self._find.sub(lambda m: "\\" + m.group(), value)

    def line(self, value: str) -> str:
        """The same on one line."""
        return self.text(value).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(value: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), value)


# --- tree ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    base: str
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation on values: join, equal, contains, not, and, or, choice, or a filter's name."""

    what: str
    parts: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Put:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    condition: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -------------------------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<mark>==|!=|[~|.()\[\]=]))""")
_STRING_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def has(self, *marks: str) -> bool:
        kind, text = self.tokens[self.at]
        return kind in ("mark", "name") and text in marks

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        got = self.tokens[self.at]
        if (kind and got[0] != kind) or (text and got[1] != text):
            raise TemplateError(f"{text or kind} expected, not {got[1]!r}")
        self.at += 1
        return got[1]

    def whole(self):
        value = self.choice()
        self.take("end")
        return value

    def choice(self):
        value = self.any()
        if not self.has("if"):
            return value
        self.take()
        condition = self.any()
        self.take("name", "else")
        return Apply("choice", (condition, value, self.choice()))

    def any(self):
        value = self.all()
        while self.has("or"):
            self.take()
            value = Apply("or", (value, self.all()))
        return value

    def all(self):
        value = self.negated()
        while self.has("and"):
            self.take()
            value = Apply("and", (value, self.negated()))
        return value

    def negated(self):
        if self.has("not"):
            self.take()
            return Apply("not", (self.negated(),))
        return self.compared()

    def compared(self):
        value = self.joined()
        if self.has("==", "!="):
            different = self.take() == "!="
            value = Apply("equal", (value, self.joined()))
            return Apply("not", (value,)) if different else value
        if self.has("in", "not"):
            absent = self.has("not") and bool(self.take())
            self.take("name", "in")
            value = Apply("contains", (self.joined(), value))
            return Apply("not", (value,)) if absent else value
        return value

    def joined(self):
        parts = [self.filtered()]
        while self.has("~"):
            self.take()
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else Apply("join", tuple(parts))

    def filtered(self):
        value = self.atom()
        while self.has("|"):
            self.take()
            value = Apply(f"|{self.take('name')}", (value,))
        return value

    def atom(self):
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.take()
            return Const(re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m.group(1), m.group(1)), text[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(self.take()))
        if self.has("("):
            self.take()
            value = self.choice()
            self.take("mark", ")")
            return value
        name = self.take("name")
        if name in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[name])
        if self.has("."):
            self.take()
            return Field(name, self.take("name"))
        if self.has("["):
            self.take()
            inner = self.take("string")[1:-1]
            self.take("mark", "]")
            return Field(name, inner)
        return Name(name)


def _parts(source: str):
    """(kind, content) of the source: text, {{ value }} and {% statement %}, with stripped white space."""
    strip = False
    pieces = _TAG.split(source)
    for n, piece in enumerate(pieces):
        if n % 2 == 0:
            if strip:
                piece = piece.lstrip()
            if n + 1 < len(pieces) and pieces[n + 1][2:3] == "-":
                piece = piece.rstrip()
            if "{{" in piece or "{%" in piece:
                raise TemplateError("a tag isn't closed")
            if piece:
                yield "text", piece
            continue
        strip = piece[-3:-2] == "-"
        if piece[1] != "#":
            yield ("value" if piece[1] == "{" else "statement"), piece[2:-2].strip("-").strip()


def parse(source: str) -> tuple:
    """The statements of a source."""
    parts = list(_parts(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(parts):
            kind, content = parts[at]
            at += 1
            if kind == "text":
                out.append(Out(Const(content)))
            elif kind == "value":
                out.append(Out(_Expression(content).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in ends:
                    return tuple(out), content
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branches(condition: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            other = (branches(end[4:]),)
        elif end == "else":
            other = block("endif")[0]
        else:
            other = ()
        return If(_Expression(condition).whole(), then, other)

    def statement(word: str, rest: str):
        if word == "if":
            return branches(rest)
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+messages\s*", rest)
            if not m:
                raise TemplateError("the loop is: for NAME in messages")
            return For(m.group(1), block("endfor")[0])
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError("an assignment is: set NAME = value")
            return Put(name.strip(), _Expression(value).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"no statement: {word!r}")

    return block()[0]


# --- folding -------------------------------------------------------------------------------


def _written(value: object) -> str:
    if value is None:
        return ""
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


_OPERATIONS: dict[str, Callable] = {
    "join": lambda *v: "".join(map(_written, v)),
    "equal": lambda a, b: a == b,
    "contains": lambda a, b: _written(b) in _written(a),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "choice": lambda c, a, b: a if c else b,
    "|trim": lambda a: _written(a).strip(),
    "|lower": lambda a: _written(a).lower(),
    "|upper": lambda a: _written(a).upper(),
}


class _Folder:
    """Replaces what doesn't depend on a message by its value, and drops branches that are never taken."""

    def __init__(self, operations: dict[str, Callable]):
        self.operations = operations

    def value(self, e, known: dict[str, object]):
        if isinstance(e, Name) and e.name in known:
            return Const(known[e.name])
        if not isinstance(e, Apply):
            return e
        if e.what not in self.operations:
            raise TemplateError(f"no filter: {e.what[1:]!r}")
        parts = tuple(self.value(p, known) for p in e.parts)
        if e.what == "join":
            flat = []
            for p in parts:
                inner = p.parts if isinstance(p, Apply) and p.what == "join" else (p,)
                for q in inner:
                    if flat and isinstance(q, Const) and isinstance(flat[-1], Const):
                        flat[-1] = Const(_written(flat[-1].value) + _written(q.value))
                    else:
                        flat.append(q)
            parts = tuple(flat)
        if all(isinstance(p, Const) for p in parts):
            return Const(self.operations[e.what](*(p.value for p in parts)))
        if e.what in ("and", "or", "choice") and isinstance(parts[0], Const):
            if e.what == "choice":
                return parts[1] if parts[0].value else parts[2]
            return parts[1] if bool(parts[0].value) == (e.what == "and") else parts[0]
        return Apply(e.what, parts)

    def body(self, statements: tuple, known: dict[str, object], may_set: bool = True) -> tuple:
        """known: names with a constant value; an assignment adds to it or takes away."""
        out: list = []

        def add(s):
            if isinstance(s, Out) and isinstance(s.value, Const):
                text = _written(s.value.value)
                if not text:
                    return
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                s = Out(Const(text))
            out.append(s)

        for s in statements:
            if isinstance(s, Out):
                add(Out(self.value(s.value, known)))
            elif isinstance(s, Put):
                if not may_set:
                    raise TemplateError("an assignment can't stand in a branch or a generation block: use a if c else b")
                value = self.value(s.value, known)
                known.pop(s.name, None)
                if isinstance(value, Const):
                    known[s.name] = value.value
                else:
                    add(Put(s.name, value))
            elif isinstance(s, If):
                condition = self.value(s.condition, known)
                if isinstance(condition, Const):
                    for t in self.body(s.then if condition.value else s.other, known, False):
                        add(t)
                else:
                    add(If(condition, self.body(s.then, known, False), self.body(s.other, known, False)))
            elif isinstance(s, Generation):
                add(Generation(self.body(s.body, known, False)))
            else:
                # What the body assigns holds for one turn.
                add(For(s.name, self.body(s.body, dict(known))))
        return tuple(out)


# --- closures ------------------------------------------------------------------------------


@dataclass
class Written:
    """Formatted text and the spans of it, in code points, that a model learns to say."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


class _Compiler:
    """Binds names to places in a turn's list and makes a closure of each node."""

    def __init__(self, operations: dict[str, Callable], message: str, fields: tuple[str, ...]):
        self.operations, self.message = operations, message
        self.places = {(message, f): n for n, f in enumerate(fields)}
        self.places |= {("loop", f): len(fields) + n for n, f in enumerate(LOOP_FIELDS)}

    def value(self, e) -> Callable[[list], object]:
        if isinstance(e, Const):
            constant = e.value
            return lambda turn: constant
        if isinstance(e, (Field, Name)):
            key = (e.base, e.name) if isinstance(e, Field) else e.name
            if key not in self.places:
                raise TemplateError(f"no such name here: {'.'.join(key) if isinstance(e, Field) else key}")
            place = self.places[key]
            return lambda turn: turn[place]
        parts = [self.value(p) for p in e.parts]
        if e.what == "choice":
            condition, then, other = parts
            return lambda turn: then(turn) if condition(turn) else other(turn)
        operation = self.operations[e.what]
        if len(parts) == 1:
            one = parts[0]
            return lambda turn: operation(one(turn))
        if len(parts) == 2:
            one, two = parts
            return lambda turn: operation(one(turn), two(turn))
        return lambda turn: operation(*[p(turn) for p in parts])

    def statement(self, s) -> Callable[[list, Written], None]:
        if isinstance(s, Out):
            if isinstance(s.value, Const):
                text = s.value.value
                return lambda turn, out: out.put(text)
            value = self.value(s.value)
            return lambda turn, out: out.put(_written(value(turn)))
        if isinstance(s, Put):
            value = self.value(s.value)
            place = self.places.setdefault(s.name, len(self.places))

            def put(turn, out):
                turn[place] = value(turn)

            return put
        if isinstance(s, If):
            condition, then, other = self.value(s.condition), self.body(s.then), self.body(s.other)
            return lambda turn, out: then(turn, out) if condition(turn) else other(turn, out)
        if isinstance(s, Generation):
            body = self.body(s.body)

            def generation(turn, out):
                start = out.length
                body(turn, out)
                out.spans.append((start, out.length))

            return generation
        raise TemplateError("a loop can't stand in a branch or a loop")

    def body(self, statements: tuple) -> Callable[[list, Written], None]:
        steps = [self.statement(s) for s in statements]
        if len(steps) == 1:
            return steps[0]

        def run(turn, out):
            for step in steps:
                step(turn, out)

        return run


class Template:
    """A compiled template: `turn` renders one turn, `render` a whole conversation.

    fields: the names of a message's fields, in the order in which `turn` gets them.  controls: the strings
    that the filters `escape` and `escape_line` guard.
    """

    def __init__(self, source: str, controls: tuple[str, ...] = (), fields: tuple[str, ...] = ("role", "text")):
        guard = Escape(controls)
        operations = _OPERATIONS | {"|escape": lambda a: guard.text(_written(a)), "|escape_line": lambda a: guard.line(_written(a))}
        self.tree = _Folder(operations).body(parse(source), {})
        loops = [n for n, s in enumerate(self.tree) if isinstance(s, For)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        outside = [*self.tree[: loops[0]], *self.tree[loops[0] + 1 :]]
        if not all(isinstance(s, Out) and isinstance(s.value, Const) for s in outside):
            raise TemplateError("outside of the loop only constant text can stand")
        self.before = "".join(s.value.value for s in self.tree[: loops[0]])
        self.after = "".join(s.value.value for s in self.tree[loops[0] + 1 :])
        loop = self.tree[loops[0]]
        compiler = _Compiler(operations, loop.name, fields)
        self._body = compiler.body(loop.body)
        self._free = [None] * (len(compiler.places) - len(fields) - len(LOOP_FIELDS))

    def turn(self, values: tuple, index0: int, last: bool, out: Written) -> None:
        """Writes turn number index0; the text before the loop goes with the first one, that after it with the last."""
        if not index0:
            out.put(self.before)
        self._body([*values, index0, index0 + 1, not index0, last, *self._free], out)
        if last:
            out.put(self.after)

    def render(self, messages: list[tuple]) -> Written:
        out = Written()
        for n, values in enumerate(messages):
            self.turn(values, n, n == len(messages) - 1, out)
        return out
