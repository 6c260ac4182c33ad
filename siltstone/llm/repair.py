"""Repair of conversation structure by a forward Viterbi recursion over a grammar of roles.

The initials of a repaired conversation's roles match `(s?(ua)+)?`: nothing, or user and assistant in turn, with a system row in
front or not. The four grammar states are the start, after system, after user and after assistant; start and after assistant may
end. Edits: Keep costs 0, Rerole (to the role that the grammar asks for) 1, Delete 2, Insert of a turn without text 5; a
truncated row that is not deleted costs 5 more; blank and duplicate rows have to be deleted. Every state carries the least
(cost, audit string) of the paths into it; the audit string holds the initials of the edits. After each row the layer is closed by
two rounds of inserts, as a third would only turn in a circle. Of equal costs the audit string that is least in ASCII stays.

Spark computes the faults of a row beside its text, deals the rows by conversation and sorts them (turn, nulls first, then role
and text), and tasks read them one by one. What can no longer win is let go: a state whose cost exceeds the least by more than
SLACK, since every other state reaches its future for that much; and where all audit strings begin alike, that beginning is decided, so
its rows go out. A conversation of any length therefore needs memory for its open rows and its audit string only. It passes through
one task in order, as its digest is a single SHA-256; its sort spills.

Faults, of which the first counts: blank (no character other than U+0009 to U+000D and the blank), duplicate (role and text seen
earlier in the conversation), truncated (the last such character is none of `.`, `!`, `?`).

Defined results: null roles and texts count as empty; a null conversation identifier is a conversation of its own; rows of the same
turn follow in the order of role and text, repeated rows are duplicates; empty tables give no rows; a conversation
without rows (all marked by `gone`) has zeros, an empty audit string and the digest of an empty string; very long texts are held
one by one; extra columns are left out and can't clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept row, by the state before it and the initial of its role.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that the grammar asks for next, and the state after it.
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: From any state the rest of another state's best path can be followed after two inserts, or one deletion, at most.
SLACK = 2 * INSERT
LEGAL = {"su", "ua", "au"}

#: The least (cost, audit string) of each state that can be reached.
Layer = dict[int, tuple[int, str]]


def close(layer: Layer) -> Layer:
    """The layer with the best paths that end in inserts."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            after, new = WANTED[state][1], (cost + INSERT, audit + "I")
            if after not in layer or new < layer[after]:
                layer[after] = new
    return layer


def step(layer: Layer, initial: str, must_go: bool, truncated: bool) -> Layer:
    """The closed layer after one row."""
    new: Layer = {}

    def offer(state: int, cost: int, audit: str) -> None:
        if state not in new or (cost, audit) < new[state]:
            new[state] = (cost, audit)

    more = TRUNCATED * truncated
    for state, (cost, audit) in layer.items():
        offer(state, cost + DELETE, audit + "D")
        if not must_go:
            kept = AFTER.get((state, initial))
            if kept is not None:
                offer(kept, cost + KEEP + more, audit + "K")
            role, after = WANTED[state]
            if initial != role[0]:
                offer(after, cost + REROLE + more, audit + "R")
    return close(new)


class Conversation:
    """One conversation, row by row: faults are counted, and edits go out as soon as they are decided."""

    def __init__(self, tell: Callable[[str, str | None, str | None], None]):
        # tell(letter of the edit, role, text) gets each decided edit; role and text are None for a deleted row
        self.layer, self.open, self.tell = close({START: (0, "")}), [], tell
        self.at = START  # the grammar state up to which edits are decided
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first, self.last, self.before = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = (turn if self.first is None else self.first), turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.open.append((role, text))
        layer = step(self.layer, initial, fault in ("blank", "duplicate"), fault == "truncated")
        least = min(cost for cost, _ in layer.values())
        self.layer = {state: path for state, path in layer.items() if path[0] <= least + SLACK}
        if len(self.open) >= 16:
            self._decide(os.path.commonprefix([audit for _, audit in self.layer.values()]))

    def _decide(self, audit: str) -> None:
        """Send out these edits, with which all paths begin."""
        rows = iter(self.open)
        for edit in audit:
            if edit == "D":
                next(rows)
                self.tell("D", None, None)
                continue
            role, after = WANTED[self.at]
            if edit == "I":
                self.tell("I", role, "")
            else:
                own, text = next(rows)
                if edit == "K":
                    role, after = own, AFTER[self.at, own[:1]]
                self.tell(edit, role, text)
            self.at = after
        self.open = list(rows)
        self.layer = {state: (cost, path[len(audit) :]) for state, (cost, path) in self.layer.items()}

    def end(self) -> int:
        """Send out the rest; returns the cost."""
        best = min(path for state, path in self.layer.items() if state in (START, ASSISTANT))
        self.layer = {START: best}
        self._decide(best[1])
        if self.first is not None:
            self.gaps = self.last - self.first + 1 - self.turns
        return best[0]


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """conv, turn, role, text, fault, gone: dealt by conversation and sorted."""
    own = common.own_columns(rows.withColumn("_gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)), conv=conv, turn=turn, role=role, text=text, gone="_gone")
    own = own.withColumns({c: common.text_or_empty(c) for c in ("role", "text")} | {"turn": F.col("turn").cast("long")})
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    own = own.withColumn("ends", F.when(last == "", "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated"))
    # the rows are dealt by conversation once; the window below only sorts them
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    own = own.repartition("conv").withColumn("seen", seen)
    fault = F.when(F.col("ends") == "blank", "blank").when(F.col("seen") > 1, "duplicate").otherwise(F.col("ends"))
    own = own.select("conv", "turn", "role", "text", fault.alias("fault"), "gone", "seen")
    return own.sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("seen"))


def _each(batches: Iterator[pa.RecordBatch], begin: Callable[[object], Conversation]) -> Iterator[tuple[object, Conversation, bool]]:
    """(identifier, conversation, whether it ends here) after each row and at the end of each conversation."""
    key = now = None
    for batch in common.slices(batches):
        for conv, turn, role, text, fault, gone in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault", "gone")), strict=True):
            if now is None or conv != key:
                if now is not None:
                    yield key, now, True
                key, now = conv, begin(conv)
            if not gone:
                now.add(turn, role, text, fault)
            yield key, now, False
    if now is not None:
        yield key, now, True


def _form(rows: DataFrame, conv: str, rest: str) -> tuple[str, pa.Schema]:
    schema = f"conv_id {rows.schema[conv].dataType.simpleString()}, {rest}"
    return schema, to_arrow_schema(StructType.fromDDL(schema))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, number (from 0), edit (Keep, Rerole, Insert), role, text of every turn of the repaired conversations."""
    schema, form = _form(rows, conv, "number long, edit string, role string, text string")
    names = {"K": "Keep", "R": "Rerole", "I": "Insert"}

    def run(batches):
        told: list[tuple] = []
        out, number, size = [], 0, 0
        for _, c, ends in _each(batches, lambda key: Conversation(lambda *edit: told.append((key, *edit)))):
            if ends:
                c.end()
            for key, edit, new_role, new_text in told:
                if edit != "D":
                    out.append({"conv_id": key, "number": number, "edit": names[edit], "role": new_role, "text": new_text})
                    number, size = number + 1, size + len(new_text)
            told.clear()
            number *= not ends
            if len(out) >= 5000 or size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, form)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, form)

    return _rows(rows, conv, turn, role, text, None).mapInArrow(run, schema)


def audit(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows for which `gone` holds only say that their conversation exists. The digest is that of the repaired turns as `role:text`,
    joined by newlines.
    """
    schema, form = _form(rows, conv, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def run(batches):
        digest, letters, turns = hashlib.sha256(), [], 0

        def tell(edit: str, new_role: str | None, new_text: str | None) -> None:
            nonlocal turns
            letters.append(edit)
            if edit != "D":
                digest.update(f"{chr(10) if turns else ''}{new_role}:{new_text}".encode())
                turns += 1

        out = []
        for key, c, ends in _each(batches, lambda _: Conversation(tell)):
            if not ends:
                continue
            cost = c.end()
            out.append(dict(zip(form.names, (key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(letters), digest.hexdigest()), strict=True)))
            digest, letters, turns = hashlib.sha256(), [], 0
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, form)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, form)

    return _rows(rows, conv, turn, role, text, gone).mapInArrow(run, schema)
