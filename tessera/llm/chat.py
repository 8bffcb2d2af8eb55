"""Chat formatting with a small template compiler.

Templates know ``{{ expression }}``, ``{% for x in y %}``, ``{% if %} {% elif %} {% else %}`` and ``{% generation %}``.
Expressions are strings, integers, names, ``a.b``, ``==``, ``!=``, ``+``, ``and``, ``or``, ``not``, parentheses and the filters
below. There are no calls, no attributes of Python objects and no evaluation of code. A template is parsed into a syntax tree, constant parts are folded, and
each node becomes a Python closure; rendering yields pieces of text with a mark whether they were generated.

Rows are sorted by (conversation, turn, role, text) in the JVM, which spills; a task streams through them, holding a turn
at a time, so a conversation with a third of all rows needs no memory of its size. Its digests are sequential by nature and
stay in one task.

Cases: null roles and texts are empty; turns with equal numbers go by role, then text; repeated rows are turns of
their own; a null conversation id is a conversation; empty tables give empty results; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Control strings of the template; inside texts they are broken up by a backslash after their first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN ", "[/TURN]")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[TURN {{ m.role | name }}] {{ m.text | escape }} [/TURN]{% endif %}"
    "{% endfor %}"
)
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def name(text: str) -> str:
    return re.sub(r"[%\[\]<>\\]", lambda m: f"%{ord(m[0]):02X}", text)


def unname(text: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": name, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class For:
    variable: str
    source: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body); the else branch has Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|+]))")
TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.DOTALL)


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("string", "int", "name", "sign"), m.groups()) if v is not None))
            at = m.end()

    def next_is(self, *values: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] in ("sign", "name") and self.tokens[0][1] in values

    def parse(self):
        out = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return out

    def chain(self, below: Callable, *signs: str):
        out = below()
        while self.next_is(*signs):
            out = Op(self.tokens.pop(0)[1], (out, below()))
        return out

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.next_is("not"):
            self.tokens.pop(0)
            return Op("not", (self.negated(),))
        return self.chain(self.joined, "==", "!=")

    def joined(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        out = self.atom()
        while self.next_is("|"):
            self.tokens.pop(0)
            kind, value = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or value not in FILTERS:
                raise TemplateError(f"unknown filter {value!r}")
            out = Op(f"|{value}", (out,))
        return out

    def atom(self):
        if not self.tokens:
            raise TemplateError("an expression ends early")
        kind, value = self.tokens.pop(0)
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return Const(int(value))
        if value == "(":
            out = self.either()
            if not self.next_is(")"):
                raise TemplateError("a parenthesis is not closed")
            self.tokens.pop(0)
            return out
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return Const(value == "true")
        path = [value]
        while self.next_is("."):
            self.tokens.pop(0)
            kind, part = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or part.startswith("_"):
                raise TemplateError(f"bad name after {'.'.join(path)!r}")
            path.append(part)
        return Name(tuple(path))


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if source[at:]:
        parts.append(("text", source[at:]))

    def block(*ends: str) -> tuple[tuple, str]:
        out = []
        while parts:
            kind, value = parts.pop(0)
            if kind == "text":
                out.append(Output(Const(value)))
            elif kind == "value":
                out.append(Output(Expression(value).parse()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                    if not m:
                        raise TemplateError(f"bad loop {value!r}")
                    out.append(For(m[1], Expression(m[2]).parse(), block("endfor")[0]))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                elif word == "if":
                    branches, condition = [], Expression(rest).parse()
                    while True:
                        body, end = block("elif", "else", "endif")
                        branches.append((condition, body))
                        word, _, rest = end.partition(" ")
                        if word == "endif":
                            break
                        condition = Const(True) if word == "else" else Expression(rest).parse()
                    out.append(If(tuple(branches)))
                else:
                    raise TemplateError(f"unknown or misplaced tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    return block()[0]


# ---- constant folding


def fold(node):
    """The node with constant parts computed."""
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(value_of(Op(node.kind, args))({}))
        return Op(node.kind, args)
    if isinstance(node, Output):
        value = fold(node.value)
        return Output(Const(shown(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, For):
        return For(node.variable, fold(node.source), fold_body(node.body))
    if isinstance(node, Generation):
        return Generation(fold_body(node.body))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, fold_body(body)))
            if isinstance(condition, Const):
                break
        return If(tuple(branches))
    return node


def fold_body(body: tuple) -> tuple:
    out: list = []
    for node in map(fold, body):
        if isinstance(node, If) and (not node.branches or isinstance(node.branches[0][0], Const)):
            inner = node.branches[0][1] if node.branches else ()
        else:
            inner = (node,)
        for x in inner:
            if isinstance(x, Output) and isinstance(x.value, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                out[-1] = Output(Const(out[-1].value.value + x.value.value))
            else:
                out.append(x)
    return tuple(out)


# ---- closures


def shown(value: object) -> str:
    return "" if value is None else str(value)


def value_of(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        def look(scope: dict, path=node.path):
            for part in path:
                scope = scope.get(part) if isinstance(scope, dict) else None
            return scope

        return look
    args = [value_of(a) for a in node.args]
    if node.kind[0] == "|":
        return lambda scope, f=FILTERS[node.kind[1:]], a=args[0]: f(shown(a(scope)))
    a, b = args[0], args[-1]
    return {
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "+": lambda scope: shown(a(scope)) + shown(b(scope)),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "not": lambda scope: not a(scope),
    }[node.kind]


Piece = tuple[str, bool]
Render = Callable[[dict, bool], Iterator[Piece]]


def code_of(body: tuple) -> Render:
    steps = [step_of(n) for n in body]

    def run(scope: dict, generated: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, generated)

    return steps[0] if len(steps) == 1 else run


def step_of(node) -> Render:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            return lambda scope, generated, text=node.value.value: iter(((text, generated),))
        value = value_of(node.value)
        return lambda scope, generated: iter(((shown(value(scope)), generated),))
    if isinstance(node, Generation):
        inner = code_of(node.body)
        return lambda scope, generated: inner(scope, True)
    if isinstance(node, For):
        source, inner = value_of(node.source), code_of(node.body)

        def loop(scope: dict, generated: bool) -> Iterator[Piece]:
            for x in source(scope) or ():
                yield from inner({**scope, node.variable: x}, generated)

        return loop
    branches = [(value_of(c), code_of(b)) for c, b in node.branches]

    def choose(scope: dict, generated: bool) -> Iterator[Piece]:
        for condition, inner in branches:
            if condition(scope):
                yield from inner(scope, generated)
                return

    return choose


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A template as a function of messages, which may be a stream, to pieces of (text, generated)."""
    render = code_of(fold_body(parse(source)))
    return lambda messages: render({"messages": messages}, False)


# ---- reading back


@dataclass
class Reader:
    """Takes formatted text of TEMPLATE in pieces of any size; gives (role, text) turns as they end."""

    buffer: str = ""
    begun: bool = False
    turns: list = field(default_factory=list)

    def feed(self, text: str) -> list[tuple[str, str]]:
        self.buffer += text
        out: list[tuple[str, str]] = []
        if not self.begun:
            if len(self.buffer) < 3:
                return out
            if not self.buffer.startswith("<s>"):
                raise ValueError("no start of a conversation")
            self.buffer, self.begun = self.buffer[3:], True
        while self.buffer:
            if any(c.startswith(self.buffer) for c in ("[INST] ", "[TURN ")):
                return out  # more of the mark is to come
            role, begin, end = ("user", 7, " [/INST]") if self.buffer.startswith("[INST] ") else (None, 6, " [/TURN]") if self.buffer.startswith("[TURN ") else ("assistant", 0, "</s>")
            stop = self.buffer.find(end)
            if stop < 0:
                return out
            text = self.buffer[begin:stop]
            if role is None:
                role, _, text = text.partition("] ")
                role = unname(role)
            out.append((role, unescape(text)))
            self.buffer = self.buffer[stop + len(end) :]
        return out


def conversations(rows: DataFrame, work: Callable[[object, Iterator[dict]], dict], columns: list[pa.Field], *, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``work`` on each conversation's id and stream of messages; one row each."""
    bound_batches(rows.sparkSession)
    named = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = named.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text"))))
        out: list[dict] = []
        size = 0
        schema = pa.schema(columns)
        for conv, group in groupby(stream, key=lambda r: r[0]):
            out.append({columns[0].name: conv} | work(conv, ({"role": r, "text": t} for _, r, t in group)))
            size += out[-1].get("formatted_chars", 0)
            if len(out) >= 1000 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return ordered.mapInArrow(run, from_arrow_schema(pa.schema(columns)))


def id_field(rows: DataFrame, conv_id: str) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(conv_id, to_arrow_type(rows.schema[conv_id].dataType))


def formatted(rows: DataFrame, *, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its formatted text and the generated spans in code points, for conversations that fit a row."""
    render = None

    def work(conv, messages):
        nonlocal render
        render = render or compiled(template)
        parts, spans, at = [], [], 0
        for piece, generated in render(messages):
            if generated and piece:
                if spans and spans[-1]["end"] == at:
                    spans[-1]["end"] = at + len(piece)
                else:
                    spans.append({"start": at, "end": at + len(piece)})
            parts.append(piece)
            at += len(piece)
        return {"formatted": "".join(parts), "generated": spans, "formatted_chars": at}

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return conversations(rows, work, [id_field(rows, conv_id), pa.field("formatted", pa.string()), pa.field("generated", span), pa.field("formatted_chars", pa.int64())], conv_id=conv_id, turn=turn, role=role, text=text)


def read_back(rows: DataFrame, *, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats each conversation as a stream and reads the output back: number and digest of the turns, characters and digest of the generated text."""
    render = None

    def work(conv, messages):
        nonlocal render
        render = render or compiled(template)
        reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
        n = chars = size = 0
        masked: list[str] = []
        for piece, generated in render(messages):
            size += len(piece)
            if generated:
                masked.append(piece)
            elif masked:
                own = unescape("".join(masked))
                loss.update(own.encode())
                chars += len(own)
                masked = []
            for r, t in reader.feed(piece):
                turns.update(f"{r}\n{t}\n".encode())
                n += 1
        if masked:
            own = unescape("".join(masked))
            loss.update(own.encode())
            chars += len(own)
        if reader.buffer:
            raise ValueError(f"conversation {conv}: {reader.buffer[:80]!r} could not be read back")
        return {"n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

    fields = [pa.field(c, pa.string() if "sha" in c else pa.int64()) for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
    return conversations(rows, work, [id_field(rows, conv_id), *fields], conv_id=conv_id, turn=turn, role=role, text=text)
