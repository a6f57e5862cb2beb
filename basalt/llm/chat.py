r"""Chat formatting by a compiled template.

A small sandboxed template language is parsed into a syntax tree, its constants are folded, and
each node becomes a Python closure that writes pieces to a sink. The language has text, `{{ expr }}`,
`{% for x in e %}`, `{% if e %}..{% elif e %}..{% else %}`, `{% set x = e %}` and
`{% generation %}`, whose text is the loss mask. Expressions know names, items of mappings
(`m.role`, `m["role"]`), strings, integers, `==`, `!=`, `+`, `not`, `and`, `or`, parentheses and
the filters in FILTERS. Nothing else is reachable: no calls, no attributes of objects.

Texts are escaped reversibly, so that control strings inside them are never taken for marks:
`\` becomes `\\`, a `#` that starts `###` becomes `\#`, and `<` before `/turn>` becomes `\<`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean

#: The production template; marks are `### Role: ` and `</turn>`.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role|role }}: "
    '{% if m.role == "assistant" %}{% generation %}{{ m.text|escape }}{% endgeneration %}'
    "{% else %}{{ m.text|escape }}{% endif %}</turn>\n{% endfor %}"
)

_ESCAPED = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE = re.compile(r"[\\:#<\n]")
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _role_mark(role: str) -> str:
    """The role as a mark shows it: first letter in upper case; what could end the mark is escaped, as is a first letter that changes back otherwise."""
    if role[:1].isalpha() and role[:1].upper().lower() == role[:1] and len(role[:1].upper()) == 1:
        role = role[:1].upper() + role[1:]
    elif role[:1].isalpha():
        return "\\" + role[:1] + _ROLE.sub(r"\\\g<0>", role[1:])
    return _ROLE.sub(r"\\\g<0>", role)


def _role_back(mark: str) -> str:
    return unescape(mark) if mark[:1] == "\\" or not mark[:1].isalpha() else mark[:1].lower() + unescape(mark[1:])


FILTERS: dict[str, Callable[[str], object]] = {"escape": escape, "role": _role_mark, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    """The template is not in the language, or reads what is not there."""


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<int>\d+)|(?P<op>==|!=|[|.\[\]()+]))")


class _Expression:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.items, at = [], 0
        while at < len(source.rstrip()):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0
        self.node = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r} in {source!r}")

    def take(self, *values: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][1] in values and self.items[self.at][0] != "str":
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.summed()
        while op := self.take("==", "!="):
            node = (op, node, self.summed())
        return node

    def summed(self):
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.primary()
        while self.take("|"):
            kind, name = self.items[self.at] if self.at < len(self.items) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", node, name)
        return node

    def primary(self):
        if self.take("("):
            node = self.either()
            self.need(")")
        else:
            if self.at >= len(self.items):
                raise TemplateError("an expression is missing")
            kind, value = self.items[self.at]
            self.at += 1
            if kind == "str":
                node = ("const", value[1:-1])
            elif kind == "int":
                node = ("const", int(value))
            elif kind == "name":
                node = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                kind, value = self.items[self.at] if self.at < len(self.items) else ("", "")
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                node = ("item", node, ("const", value))
            else:
                node = ("item", node, self.either())
                self.need("]")
        return node


def parse(source: str) -> list:
    """The template's syntax tree: a list of statement tuples."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("print", m.group(1)) if m.group(1) is not None else ("tag", m.group(2)))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    place = 0

    def block(*ends: str):
        nonlocal place
        out = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "print":
                out.append(("print", _Expression(value).node))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, word, rest
                if word == "for":
                    name, found, over = rest.partition(" in ")
                    if not found or not name.strip().isidentifier():
                        raise TemplateError(f"bad loop {value!r}")
                    body, _, _ = block("endfor")
                    out.append(("for", name.strip(), _Expression(over).node, body))
                elif word == "if":
                    arms, other, test = [], [], rest
                    while True:
                        body, end, more = block("elif", "else", "endif")
                        if test is None:
                            other = body
                        else:
                            arms.append((_Expression(test).node, body))
                        if end == "endif":
                            break
                        test = more if end == "elif" else None
                    out.append(("if", arms, other))
                elif word == "set":
                    name, found, expr = rest.partition("=")
                    if not found or not name.strip().isidentifier():
                        raise TemplateError(f"bad set {value!r}")
                    out.append(("set", name.strip(), _Expression(expr).node))
                elif word == "generation":
                    body, _, _ = block("endgeneration")
                    out.append(("generation", body))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, "", ""

    return block()[0]


def _plus(a, b):
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two strings or two integers")
    return a + b


_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _plus}


def fold_expression(node):
    """The expression with every part that has no name computed."""
    op = node[0]
    if op in ("const", "name"):
        return node
    if op == "filter":
        inner = fold_expression(node[1])
        return ("const", FILTERS[node[2]](_shown(inner[1]))) if inner[0] == "const" else ("filter", inner, node[2])
    if op == "not":
        inner = fold_expression(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold_expression(node[1]), fold_expression(node[2])
    if op in ("and", "or") and a[0] == "const":
        return b if bool(a[1]) == (op == "and") else a
    if op in _BINARY and a[0] == b[0] == "const":
        return ("const", _BINARY[op](a[1], b[1]))
    return (op, a, b)


def fold(nodes: list) -> list:
    """Statements with constants folded: constant prints become text, decided tests vanish, neighbouring texts join."""
    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "print":
            e = fold_expression(node[1])
            add(("text", _shown(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        elif node[0] == "if":
            arms, other = [], fold(node[2])
            for test, body in node[1]:
                test = fold_expression(test)
                if test[0] == "const":
                    if test[1]:
                        other = fold(body)
                        break
                    continue
                arms.append((test, fold(body)))
            if arms:
                add(("if", arms, other))
            else:
                for inner in other:
                    add(inner)
        else:
            add(node)
    return out


def _shown(value) -> str:
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only strings and integers can be shown")


def _closure(node) -> Callable[[dict], object]:
    op = node[0]
    if op == "const":
        value = node[1]
        return lambda names: value
    if op == "name":
        name = node[1]

        def read(names):
            if name not in names:
                raise TemplateError(f"no name {name!r}")
            return names[name]

        return read
    if op == "item":
        base, key = _closure(node[1]), _closure(node[2])

        def item(names):
            holder = base(names)
            if type(holder) is not dict:
                raise TemplateError("only mappings have items")
            return holder.get(key(names))

        return item
    if op == "filter":
        base, call = _closure(node[1]), FILTERS[node[2]]
        return lambda names: call(_shown(base(names)))
    if op == "not":
        base = _closure(node[1])
        return lambda names: not base(names)
    a, b = _closure(node[1]), _closure(node[2])
    if op == "and":
        return lambda names: a(names) and b(names)
    if op == "or":
        return lambda names: a(names) or b(names)
    call = _BINARY[op]
    return lambda names: call(a(names), b(names))


Pieces = Iterator[tuple[str, bool]]


def _statement(node, masked: bool) -> Callable[[dict], Pieces]:
    """A closure that yields (text, in the loss mask) for one statement."""
    op = node[0]
    if op == "text":
        piece = [(node[1], masked)]
        return lambda names: iter(piece)
    if op == "print":
        value = _closure(node[1])
        return lambda names: iter([(_shown(value(names)), masked)])
    if op == "set":
        name, value = node[1], _closure(node[2])

        def assign(names):
            names[name] = value(names)
            return iter(())

        return assign
    if op == "generation":
        return _writer(node[1], True)
    if op == "for":
        name, over, body = node[1], _closure(node[2]), _writer(node[3], masked)

        def loop(names):
            items = over(names)
            if isinstance(items, (str, dict)) or not hasattr(items, "__iter__"):
                raise TemplateError("only lists can be looped over")
            for number, item in enumerate(items):
                yield from body(names | {name: item, "loop": {"index": number + 1, "first": number == 0}})

        return loop
    other = _writer(node[2], masked)
    for test, body in reversed([(_closure(t), _writer(b, masked)) for t, b in node[1]]):
        other = _choice(test, body, other)
    return other


def _choice(test, body, other) -> Callable[[dict], Pieces]:
    return lambda names: body(names) if test(names) else other(names)


def _writer(nodes: list, masked: bool) -> Callable[[dict], Pieces]:
    """A closure that yields the pieces of all statements in order."""
    steps = tuple(_statement(node, masked) for node in nodes)

    def write(names):
        for step in steps:
            yield from step(names)

    return write


class Template:
    """A compiled template; render() yields (text, in the loss mask) pieces lazily."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._write = _writer(self.tree, False)

    def render(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        return self._write({"messages": messages})


_OUT = "conv_id long, part long, formatted string, mask array<struct<start:long,end:long>>"


def _by_conversation(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Groups neighbouring rows by their first field, one row at a time."""
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


def _batched(rows: Iterator[tuple], schema: pa.Schema, count: int = 2000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= count or size >= chars:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in held], schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, piece_chars: int = 1 << 20) -> DataFrame:
    """Formats conversations (rows conv_id, turn, role, text; ordered by turn, then role, then text).

    Returns conv_id, part, formatted and mask: pieces whose concatenation by part is the formatted
    conversation (one piece unless it is longer than piece_chars), with the loss mask as code-point
    ranges within the piece. A null role or text is empty; null conv_ids are one conversation;
    repeated rows are repeated turns. Turns stream through: a conversation of any length is never
    held whole. Other columns are ignored; an empty table gives none.
    """
    Template(template)  # a bad template fails here, not on executors
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        compiled = Template(template)

        def pieces():
            for conv, rows in _runs(_by_conversation(batches, "conv_id", "role", "text")):
                out, mask, size, part = [], [], 0, 0
                for text, masked in compiled.render({"role": r or "", "text": t or ""} for _, r, t in rows):
                    if masked:
                        if mask and mask[-1]["end"] == size:
                            mask[-1]["end"] = size + len(text)
                        else:
                            mask.append({"start": size, "end": size + len(text)})
                    out.append(text)
                    size += len(text)
                    if size >= piece_chars:
                        yield conv, part, "".join(out), mask
                        out, mask, size, part = [], [], 0, part + 1
                if size or not part:
                    yield conv, part, "".join(out), mask

        yield from _batched(pieces(), schema)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lean(run), _OUT)


_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.DOTALL)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Reads format_conversations' output of the production template back, streaming.

    Returns conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n for each turn), loss_chars and
    loss_sha256 (of the unescaped text under the mask) and formatted_chars.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])

    def run(batches):
        def digests():
            for conv, rows in _runs(_by_conversation(batches, "conv_id", "formatted", "mask")):
                turns, loss, n, chars, size, rest, cut = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, "", ""
                for _, text, mask in rows:
                    size += len(text)
                    for k, span in enumerate(mask):
                        # an escape cut by the end of a piece waits for its second half
                        raw = (cut if k == 0 and span["start"] == 0 else "") + text[span["start"] : span["end"]]
                        tail = len(raw) - len(raw.rstrip("\\"))
                        cut = "\\" if tail % 2 and span["end"] == len(text) else ""
                        plain = unescape(raw[: len(raw) - len(cut)])
                        chars += len(plain)
                        loss.update(plain.encode())
                    text, at = rest + text, 0
                    while m := _TURN.match(text, at):
                        turns.update(f"{_role_back(m[1])}\n{unescape(m[2])}\n".encode())
                        n, at = n + 1, m.end()
                    rest = text[at:]
                if rest:
                    raise ValueError(f"conversation {conv}: not in the template's format")
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        yield from _batched(digests(), schema)

    kinds = ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names)
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lean(run), kinds)
