"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures. Rendering
yields pieces of text with a flag that says whether a piece lies in a generation block (the loss mask). A loop takes its
items one by one, so a conversation is rendered turn by turn in bounded memory.

Language: text; `{{ expression }}`; `{% for x in xs %}...{% endfor %}`; `{% if e %}...{% elif e %}...{% else %}...
{% endif %}`; `{% generation %}...{% endgeneration %}`. Expressions: strings, integers, names, `.field`, `+`, `==`, `!=`,
`not`, `and`, `or`, parentheses, and the filters `| escape`, `| trim`, `| upper`, `| lower`. Names reach only what the
caller passes in; fields are looked up in mappings, never as attributes; there are no calls.

Escaping: in texts a backslash is doubled, and `<` and `[` get a backslash behind them, so that no control string can
occur in a text and the text can be read back exactly.

Defined results: null roles and texts count as empty; turns are ordered by turn, ties by role and text, and repeated
rows are turns of their own; a null turn comes first; rows with a null conversation id form one conversation; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

#: The control strings of the default template.
TURN, ROLE_END, TURN_END = "<turn>", "[/role]", "</turn>"

DEFAULT = (
    "{% for m in messages %}<turn>{{ m.role | escape }}[/role]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>{% endfor %}"
)


def escape(text: str) -> str:
    return re.sub(r"[<\[]", r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\|\\\\", lambda m: m[1] or "\\", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- parsing: trees are tuples (kind, ...) ---

LEXEME = re.compile(r"\s*(?:(?P<string>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.|+()]))")
KEYWORDS = {"not", "and", "or", "true", "false"}


class _Expression:
    """Recursive descent over the lexemes of one expression."""

    def __init__(self, source: str):
        self.lexemes, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.lexemes.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.lexemes[self.at][1] if self.at < len(self.lexemes) and self.lexemes[self.at][0] != "string" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        while (sign := self.peek()) in ("==", "!="):
            self.at += 1
            tree = (sign, tree, self.added())
        return tree

    def added(self) -> tuple:
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.reached()
        while self.take("|"):
            kind, name = self.lexemes[self.at] if self.at < len(self.lexemes) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def reached(self) -> tuple:
        tree = self.atom()
        while self.take("."):
            kind, name = self.lexemes[self.at] if self.at < len(self.lexemes) else ("", "")
            if kind != "name":
                raise TemplateError("a field name must follow '.'")
            self.at += 1
            tree = ("field", tree, name)
        return tree

    def atom(self) -> tuple:
        if self.at >= len(self.lexemes):
            raise TemplateError("expression ends early")
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing ')'")
            return tree
        kind, text = self.lexemes[self.at]
        self.at += 1
        if kind == "string":
            return ("const", text[1:-1])
        if kind == "number":
            return ("const", int(text))
        if kind == "name" and text in ("true", "false"):
            return ("const", text == "true")
        if kind == "name" and text not in KEYWORDS:
            return ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                nodes.append(("print", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), f"{word} {rest}".strip()
                nodes.append(statement(word, rest))
            elif part:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return ("block", nodes), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*) in (.+)", rest.strip())):
            return ("for", m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "if":
            body, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                other = ("block", [statement("if", end[4:].strip())])
            else:
                other = block("endif")[0] if end == "else" else ("block", [])
            return ("if", _Expression(rest).whole(), body, other)
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


# --- folding ---

_OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def fold(tree: tuple) -> tuple:
    """The tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    kind = tree[0]
    if kind in _OPERATORS:
        left, right = fold(tree[1]), fold(tree[2])
        if left[0] == right[0] == "const":
            return ("const", _OPERATORS[kind](left[1], right[1]))
        return (kind, left, right)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](str(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "field":
        return ("field", fold(tree[1]), tree[2])
    if kind == "print":
        inner = fold(tree[1])
        return ("text", str(inner[1])) if inner[0] == "const" else ("print", inner)
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    if kind == "if":
        test = fold(tree[1])
        if test[0] == "const":
            return fold(tree[2] if test[1] else tree[3])
        return ("if", test, fold(tree[2]), fold(tree[3]))
    if kind == "block":
        nodes: list[tuple] = []
        for node in map(fold, tree[1]):
            for x in node[1] if node[0] == "block" else [node]:
                if x[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + x[1])
                else:
                    nodes.append(x)
        return ("block", nodes)
    return tree


# --- closures ---


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda names, v=tree[1]: v
    if kind == "name":
        return lambda names, n=tree[1]: names.get(n, "")
    if kind == "field":
        inner, name = _value(tree[1]), tree[2]
        return lambda names: x.get(name, "") if isinstance(x := inner(names), dict) else ""
    if kind == "filter":
        inner, apply = _value(tree[2]), FILTERS[tree[1]]
        return lambda names: apply(str(inner(names)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda names: not inner(names)
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    apply = _OPERATORS[kind]
    return lambda names: apply(left(names), right(names))


Pieces = Iterator[tuple[str, bool]]


def _writer(tree: tuple, masked: bool = False) -> Callable[[dict], Pieces]:
    kind = tree[0]
    if kind == "text":
        return lambda names: iter(((tree[1], masked),))
    if kind == "print":
        value = _value(tree[1])
        return lambda names: iter(((str(value(names)), masked),))
    if kind == "generation":
        return _writer(tree[1], True)
    if kind == "if":
        test, body, other = _value(tree[1]), _writer(tree[2], masked), _writer(tree[3], masked)
        return lambda names: body(names) if test(names) else other(names)
    if kind == "for":
        name, items, body = tree[1], _value(tree[2]), _writer(tree[3], masked)

        def loop(names: dict) -> Pieces:
            for item in items(names):
                yield from body(names | {name: item})

        return loop
    parts = [_writer(x, masked) for x in tree[1]]

    def each(names: dict) -> Pieces:
        for part in parts:
            yield from part(names)

    return each


@functools.lru_cache(64)
def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A function from names to the (text, in a generation block) pieces of the rendering."""
    return _writer(fold(parse(source)))


def render(source: str, names: dict) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text, and the (start, end) spans of its generation blocks."""
    out, spans, at = [], [], 0
    for text, masked in compile_template(source)(names):
        out.append(text)
        if masked and text:
            spans.append((at, at + len(text)))
        at += len(text)
    return "".join(out), spans


def read_turns(pieces: Pieces) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, unescaped masked text, length) of each turn of output in the default template's markers."""
    held, masks = "", []
    for text, masked in pieces:
        if masked:
            masks.append((len(held), len(held) + len(text)))
        held += text
        while (end := held.find(TURN_END)) >= 0:
            head = held.index(ROLE_END)
            if not held.startswith(TURN):
                raise ValueError("a turn must start with its marker")
            loss = "".join(unescape(held[a:b]) for a, b in masks if b <= end)
            yield unescape(held[len(TURN) : head]), unescape(held[head + len(ROLE_END) : end]), loss, end + len(TURN_END)
            held, masks = held[end + len(TURN_END) :], []
    if held:
        raise ValueError("the last turn has no end")


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = common.own_columns(rows, conv=conv, turn=turn, role=role, text=text)
    rows = rows.withColumns({c: common.text_or_empty(c) for c in ("role", "text")})
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation, its messages one by one) of sorted rows; the messages must be read before the next conversation."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True))
    ahead = next(rows, None)

    def messages(conv) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            now, ahead = ahead, next(rows, None)
            yield {"role": now[1], "text": now[2]}

    while ahead is not None:
        conv = ahead[0]
        yield conv, messages(conv)


def format_conversations(rows: DataFrame, template: str = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted text and loss spans (start, end in code points) of every conversation."""
    parse(template)
    schema = f"conv_id {rows.schema[conv].dataType.simpleString()}, formatted string, loss_spans array<struct<start: long, end: long>>"
    form = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for key, messages in _conversations(batches):
            out, spans = render(template, {"messages": messages})
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "formatted": out, "loss_spans": [{"start": a, "end": b} for a, b in spans]}], form)

    return _ordered(rows, conv, turn, role, text).mapInArrow(run, schema)


def digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Render every conversation by the default template and digest what is read back from the output, turn by turn.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256 (the unescaped
    text under the loss mask), formatted_chars. Only one turn of a conversation is held at a time.
    """
    schema = f"conv_id {rows.schema[conv].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    form = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        out = []
        for key, messages in _conversations(batches):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for read_role, read_text, masked, length in read_turns(compile_template(DEFAULT)({"messages": messages})):
                turns.update(f"{read_role}\n{read_text}\n".encode())
                loss.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + length
            out.append(dict(zip(form.names, (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True)))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, form)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, form)

    return _ordered(rows, conv, turn, role, text).mapInArrow(run, schema)
