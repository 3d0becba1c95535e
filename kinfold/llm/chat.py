"""Chat formatting with compiled templates.

A template is text with ``{{ expression }}`` and ``{% statement %}`` tags. Its source is parsed into a syntax
tree, constant expressions are folded, neighbouring constant texts joined, and every node becomes a Python
closure. The language is closed: names are ``messages``, the loop variable, ``loop`` and what ``set`` binds; there are
no calls, attributes are keys of the message (``role``, ``content``) and of ``loop`` (``first``, ``last``, ``index``, ``index0``,
``previous``), filters and tests come from fixed tables. ``messages`` can only be looped over, once, outside any other
loop: so a conversation streams through with one message of look-ahead and its length does not matter.

    statements: if / elif / else / endif, for x in messages / endfor, set x = e, generation / endgeneration
    operators: or, and, not, == != < <= > >= in, +, ~, unary filters with |

Text inside ``generation`` is under the loss mask.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, Callable, Iterable, Iterator

from pyspark.sql import DataFrame

#: Marks turns as <|im_start|>role\\n text <|im_end|>\\n; the assistant's text is generated.
TURNS = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}{% else %}{{ m.content | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
PIECE_CHARS = 1 << 20


class TemplateError(ValueError):
    """The template breaks the rules of the language."""


def escape(text: str) -> str:
    """One backslash more between ``<`` and ``|``, so no control string is left; see :func:`unescape`."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_line(text: str) -> str:
    """For text that must stay in one line: backslashes, line feeds and bars."""
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(str(v)), "escape_line": lambda v: escape_line(str(v)), "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": len,
}
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b),
}
LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))
WORDS = {"or", "and", "not", "in", "true", "false", "none"}
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>+~|.()=]))""")
TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
KEYS = {"role", "content", "first", "last", "index", "index0", "previous"}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Key:
    of: Any
    key: str


@dataclass
class Apply:
    """``and``, ``or``, ``not``, an operator or a filter over its operands."""
    name: str
    operands: list


@dataclass
class Output:
    value: Any


@dataclass
class If:
    arms: list  # (condition, body); the last condition may be Const(True)


@dataclass
class For:
    name: str
    body: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


class _Parser:
    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in TAG.finditer(source):
            if m.start() > at:
                self.parts.append(("text", source[at:m.start()]))
            self.parts.append(("out", m[1]) if m[1] is not None else ("do", m[2].strip()))
            at = m.end()
        if at < len(source):
            self.parts.append(("text", source[at:]))
        self.at, self.loops, self.inside = 0, 0, 0

    def body(self, *ends: str) -> tuple[list, str]:
        nodes: list = []
        while self.at < len(self.parts):
            kind, source = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Output(Const(source)))
            elif kind == "out":
                nodes.append(Output(self.expression(source)))
            else:
                word, _, rest = source.partition(" ")
                if word in ends:
                    return nodes, source
                nodes.append(self.statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def statement(self, word: str, rest: str):
        if word == "if":
            arms, condition = [], self.expression(rest)
            while True:
                nodes, end = self.body("elif", "else", "endif")
                arms.append((condition, nodes))
                if end == "endif":
                    return If(arms)
                if end == "else":
                    arms.append((Const(True), self.body("endif")[0]))
                    return If(arms)
                condition = self.expression(end.partition(" ")[2])
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)
            self.loops += 1
            if not m or self.loops > 1 or self.inside:
                raise TemplateError("the only loop is one over messages, outside a generation")
            return For(m[1], self.body("endfor")[0])
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier() or name.strip() in WORDS | {"messages", "loop"}:
                raise TemplateError(f"can't set {name.strip()!r}")
            return Set(name.strip(), self.expression(value))
        if word == "generation":
            if self.inside:
                raise TemplateError("a generation can't hold another one")
            self.inside += 1
            nodes = self.body("endgeneration")[0]
            self.inside -= 1
            return Generation(nodes)
        raise TemplateError(f"unknown statement {word!r}")

    def expression(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        node = self.level(0)
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def peek(self) -> str:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] in ("mark", "name") else ""

    def level(self, k: int):
        if k == len(LEVELS):
            return self.filtered()
        if LEVELS[k] == ("not",):
            if self.peek() == "not":
                self.tokens.pop(0)
                return Apply("not", [self.level(k)])
            return self.level(k + 1)
        node = self.level(k + 1)
        while self.peek() in LEVELS[k]:
            name = self.tokens.pop(0)[1]
            node = Apply(name, [node, self.level(k + 1)])
        return node

    def filtered(self):
        node = self.simple()
        while self.peek() in ("|", "."):
            mark = self.tokens.pop(0)[1]
            if not self.tokens or self.tokens[0][0] != "name":
                raise TemplateError(f"a name must follow {mark!r}")
            name = self.tokens.pop(0)[1]
            if mark == "|" and name not in FILTERS or mark == "." and name not in KEYS:
                raise TemplateError(f"unknown {'filter' if mark == '|' else 'key'} {name!r}")
            node = Apply("|" + name, [node]) if mark == "|" else Key(node, name)
        return node

    def simple(self):
        if not self.tokens:
            raise TemplateError("an expression is missing")
        kind, value = self.tokens.pop(0)
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if value == "(":
            node = self.level(0)
            if self.peek() != ")":
                raise TemplateError("a bracket is open")
            self.tokens.pop(0)
            return node
        if kind != "name" or value == "messages" or value in WORDS - {"true", "false", "none"}:
            raise TemplateError(f"unexpected {value!r}")
        return Const({"true": True, "false": False, "none": None}[value]) if value in WORDS else Name(value)


def fold(node):
    """The same tree with constant parts computed, dead arms dropped and neighbouring texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Output) and isinstance(y.value, Const):
                    y = Output(Const(_text(y.value.value)))
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + y.value.value))
                        continue
                out.append(y)
        return out
    if isinstance(node, Apply):
        node = Apply(node.name, [fold(x) for x in node.operands])
        return Const(_operation(node.name)(*[x.value for x in node.operands])) if all(isinstance(x, Const) for x in node.operands) else node
    if isinstance(node, Key):
        return Key(fold(node.of), node.key)
    if isinstance(node, (Output, Set)):
        return Output(fold(node.value)) if isinstance(node, Output) else Set(node.name, fold(node.value))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        return [] if not arms else arms[0][1] if isinstance(arms[0][0], Const) else If(arms)
    if isinstance(node, For):
        return For(node.name, fold(node.body))
    return Generation(fold(node.body)) if isinstance(node, Generation) else node


def _operation(name: str) -> Callable:
    if name[0] == "|":
        return FILTERS[name[1:]]
    return {"and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}.get(name) or OPERATORS[name]


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Key):
        of = _value(node.of)
        return lambda scope, k=node.key: (of(scope) or {}).get(k)
    operands, use = [_value(x) for x in node.operands], _operation(node.name)
    if node.name in ("and", "or"):
        left, right = operands
        return (lambda s: left(s) and right(s)) if node.name == "and" else (lambda s: left(s) or right(s))
    if len(operands) == 1:
        return lambda s, a=operands[0]: use(a(s))
    return lambda s, a=operands[0], b=operands[1]: use(a(s), b(s))


Piece = tuple[str, bool]  # text, under the loss mask


def _run(nodes: list) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, loss: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, loss)

    return run


def _step(node) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Output):
        value = _value(node.value)

        def output(scope, loss):
            yield _text(value(scope)), loss
        return output
    if isinstance(node, Set):
        value = _value(node.value)

        def bind(scope, loss):
            scope[node.name] = value(scope)
            return iter(())
        return bind
    if isinstance(node, Generation):
        inner = _run(node.body)
        return lambda scope, loss: inner(scope, True)
    if isinstance(node, If):
        arms = [(_value(c), _run(b)) for c, b in node.arms]

        def choose(scope, loss):
            for condition, body in arms:
                if condition(scope):
                    yield from body(scope, loss)
                    return
        return choose
    body = _run(node.body)

    def loop(scope, loss):
        rest, previous, k = iter(scope["messages"]), None, 0
        message = next(rest, None)
        while message is not None:
            following = next(rest, None)
            scope[node.name] = message
            scope["loop"] = {"first": k == 0, "last": following is None, "index": k + 1, "index0": k, "previous": previous}
            yield from body(scope, loss)
            previous, message, k = message, following, k + 1
    return loop


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (``role`` and ``content``) to pieces of text with their loss mark."""
    run = _run(fold(_Parser(source).body()[0]))
    return lambda messages: run({"messages": messages}, False)


def format_conversations(df: DataFrame, template: str = TURNS, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(conversation, piece, formatted, spans)``: each conversation's text, in pieces of about ``piece_chars``
    characters (one piece as a rule), with the spans of each piece under the loss mask.

    Rows are dealt by conversation and sorted by turn, then role and text, so ties have one order; they then
    stream, and a conversation of any length takes the memory of a message and a piece. Spans say whether they
    go on in the next piece. Null roles and texts are empty, null turns come first, rows with a null
    conversation are one conversation, repeated rows are turns of their own. Other columns are not read.
    """
    compiled(template)  # faults show before a job starts
    kind = df.schema[conversation].dataType.simpleString()

    def render(batches):
        import itertools

        import pyarrow as pa

        run = compiled(template)

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        out: list[tuple] = []
        held = 0
        for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
            number, parts, spans, at = 0, [], [], 0
            for piece, loss in run({"role": r or "", "content": t or ""} for _, r, t in group):
                # a text longer than a piece is cut; an open span goes on in the next piece
                for k in range(0, len(piece) or 1, piece_chars):
                    part = piece[k:k + piece_chars]
                    if loss and (part or k == 0):
                        spans.append((at, at + len(part), k + piece_chars < len(piece)))
                    parts.append(part)
                    at += len(part)
                    if at >= piece_chars:
                        out.append((conv, number, "".join(parts), spans))
                        held += at
                        number, parts, spans, at = number + 1, [], [], 0
                        if held >= 4 * piece_chars:
                            yield made(out)
                            out, held = [], 0
            if parts or spans or number == 0:
                out.append((conv, number, "".join(parts), spans))
                held += at + 64
            if held >= 4 * piece_chars:
                yield made(out)
                out, held = [], 0
        if out:
            yield made(out)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = f"`{conversation}` {kind}, piece long, formatted string, spans array<struct<start:long,stop:long,open:boolean>>"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)

    def made(rows: list[tuple]):
        import pyarrow as pa

        cells = list(zip(*rows))
        spans = [[{"start": a, "stop": b, "open": o} for a, b, o in s] for s in cells[3]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((*cells[:3], spans), schema.types)], schema=schema)

    dealt = df.select(conversation, role, text, turn).repartition(conversation).sortWithinPartitions(conversation, turn, role, text)
    return dealt.select(conversation, role, text).mapInArrow(render, shape)


def turns_of(pieces: Iterable[tuple[str, list]]) -> Iterator[tuple[str, str, bool]]:
    """Reads :data:`TURNS` back: ``(role, text, under the loss mask)`` per turn, from a conversation's pieces."""
    text, marks, base = "", [], 0
    for piece, spans in pieces:
        marks += [(base + len(text) + s["start"], s["stop"] - s["start"]) for s in spans]
        text += piece
        while True:
            stop = text.find("<|im_end|>\n")
            if stop < 0:
                break
            head = text.index("\n")
            inside = [m for m in marks if m[0] < base + stop + 1]
            marks = marks[len(inside):]
            yield unescape_line(text[len("<|im_start|>"):head]), unescape(text[head + 1:stop]), bool(inside)
            text, base = text[stop + len("<|im_end|>\n"):], base + stop + len("<|im_end|>\n")


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation what its formatted text says when read back; pieces must lie as they were made.

    ``loss`` figures come from the spans alone: the text that they cut out, unescaped.
    """
    kind = formatted.schema[conversation].dataType.simpleString()

    def read(batches):
        import hashlib
        import itertools

        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        def result(conv, group):
            sha, loss = hashlib.sha256(), hashlib.sha256()
            n, loss_chars, chars, held = 0, 0, 0, [""]

            def watched():
                nonlocal chars, loss_chars
                for _, _, text, spans in group:
                    chars += len(text)
                    for s in spans:
                        held[0] += text[s["start"]:s["stop"]]
                        if not s["open"]:
                            own = unescape(held[0])
                            held[0] = ""
                            loss.update(own.encode("utf-8"))
                            loss_chars += len(own)
                    yield text, spans

            for role, text, _ in turns_of(watched()):
                n += 1
                sha.update(f"{role}\n{text}\n".encode("utf-8"))
            return conv, n, sha.hexdigest(), loss_chars, loss.hexdigest(), chars

        names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        out: list = []
        for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
            out.append(result(conv, group))
            if len(out) >= 4096:
                yield _batch(out, names, pa)
                out = []
        if out:
            yield _batch(out, names, pa)

    def _batch(rows, names, pa):
        cells = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in cells], names=names)

    return formatted.mapInArrow(read, f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
