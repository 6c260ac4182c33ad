"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

A passage within e edits of an item of m characters shares at least m - q + 1 - q * e of its q-grams with it, and they lie
on neighbouring diagonals (document position minus item position). Shared q-grams are counted in overlapping bands
of diagonals; bands that reach the bound are aligned, with free ends in the document, within the band only.
An item's edit budget is `rate` of its length, less for short items, so that the bound stays at 1 at least. Items of less
than q characters have no q-gram and a budget of no edit: they are looked up whole, by a hash for each of their lengths.

Shared q-grams are counted piece by piece, so repetitive texts take no more memory than others. The alignment keeps for each
diagonal how far it reaches with 0, 1, 2, ... edits; equal stretches are skipped by hashes of ranges, from prefix sums. So its work
grows with the edits that are needed, not with the item's length.

Texts are compared in lower case with runs of white space as one blank. The benchmark is the query set: it is taken in
blocks of a bounded number of characters, one after another, and each block is sent to all tasks and held against all rows.

Defined results: null or empty texts match nothing, nor do items of white space only; an item without identifier is
reported with a null item_id, each such item for itself, and identifiers keep their type; repeated rows are each
reported; an empty benchmark or document table gives no rows; very long texts are searched whole, one at a time; extra columns
of either table play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, vocabulary

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NOWHERE = -(1 << 40)


@functools.cache
def _lower() -> np.ndarray:
    """The lower case of every code point that has one of a single character; white space is a blank."""
    table = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.int32, 0x110000)
    table[vocabulary.WHITE_SPACE] = 0x20
    return table


def normalise(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, character position in its own text, text number) of the normalised texts of a buffer."""
    at, code = vocabulary.decode_utf8(raw)
    code = _lower()[code]
    firsts = np.searchsorted(at, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    blank = code == 0x20
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    return code[keep], (np.arange(len(code)) - firsts[owner])[keep], owner[keep]


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)])) for x in (BASE, INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; those of usual lengths are kept."""
    return _powers(1 << 21) if n <= 1 << 21 else _powers.__wrapped__(n)


def sums(code: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the code points; the hash of a range is a difference times a power."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers(len(code) + 1)[0][: len(code)])])


def grams(total: np.ndarray, owner: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of all q-grams that lie within one text, from its prefix sums."""
    n = len(owner) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[q - 1 :])
    with np.errstate(over="ignore"):
        return at, common.mix64(((total[q:] - total[:-q]) * powers(n)[1][:n])[at])


class Items:
    """The q-gram index of a block of benchmark items."""

    def __init__(self, texts: list[str], q: int = 10, rate: float = 0.08):
        self.q = q
        code, _, owner = normalise(*common.text_buffers(pa.array(texts, pa.string())))
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.code, self.size, self.sums = code, np.diff(self.first), sums(code)
        self.budget = np.maximum(np.minimum((rate * self.size).astype(np.int64), (self.size - q) // q), 0)
        self.least = self.size - q + 1 - q * self.budget
        at, h = grams(self.sums, owner, q)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], owner[at[order]], at[order] - self.first[owner[at[order]]]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hash >> np.uint64(42)] = True
        blank = np.add.reduceat(np.append(code != 0x20, 0), self.first[:-1]) == 0 if len(texts) else np.zeros(0, bool)
        self.short = {}
        for size in np.unique(self.size[(self.size > 0) & (self.size < q) & ~blank]):
            which = np.flatnonzero((self.size == size) & ~blank)
            whole = np.stack([code[self.first[which] + k] for k in range(size)], 1)
            whole, group = np.unique(whole, axis=0, return_inverse=True)
            h = grams(sums(whole.ravel()), np.repeat(np.arange(len(whole)), size), int(size))[1]
            order = np.argsort(h, kind="stable")
            group = np.argsort(order)[group.ravel()]
            self.short[int(size)] = (h[order], whole[order], [which[group == k] for k in range(len(h))])

    def bands(self, total: np.ndarray, owner: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, band) of the bands with enough shared q-grams; a band is two steps of 2 * budget + 1 diagonals wide."""
        at, h = grams(total, owner, self.q)
        likely = self.maybe[h >> np.uint64(42)]
        at, h = at[likely], h[likely]
        low = np.searchsorted(self.hash, h, "left")
        n = np.searchsorted(self.hash, h, "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        # a band's number is read from a key of text, item and band
        many, span, shift = len(self.size), len(owner) + int(self.size.max(initial=0)) + 4, int(self.size.max(initial=0)) + 2
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(n)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + piece, "right")))
            k, rows = n[first:last], slice(first, last)
            each = np.repeat(low[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            place, item = np.repeat(at[rows], k), self.item[each]
            band = (place - self.at[each]) // (2 * self.budget[item] + 1)
            keys, counts = _added(keys, counts, *_counted((owner[place].astype(np.int64) * many + item) * span + band + shift))
            first = last
        # each q-gram counts in its own band and in the one that begins a step earlier
        keys, counts = _added(keys, counts, keys - 1, counts)
        item = keys // span % max(many, 1)
        full = counts >= self.least[item]
        keys, item = keys[full], item[full]
        return keys // span // max(many, 1), item, keys % span - shift

    def find_short(self, code: np.ndarray, total: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, position) of the first place of each item of less than q characters."""
        for size, (hashes, whole, items) in self.short.items():
            at, h = grams(total, owner, size)
            low = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[low] == h
            at, low = at[same], low[same]
            for k in range(size):
                same = code[at + k] == whole[low, k]
                at, low = at[same], low[same]
            _, first = np.unique(owner[at].astype(np.int64) * len(hashes) + low, return_index=True)
            for a, k in zip(at[first], low[first], strict=True):
                for item in items[k]:
                    yield int(owner[a]), int(item), int(a)

    def find(self, offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, first and last character) of all passages; the best one of a text and item."""
        code, place, owner = normalise(offsets, raw)
        total = sums(code)
        for d, i, first in self.find_short(code, total, owner):
            yield d, i, 0, int(place[first]), int(place[first + self.size[i] - 1])
        doc, item, band = self.bands(total, owner)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        for d, i, edits, end in self.align(code, total, bounds, doc, item, band):
            first = max(int(bounds[d]), end - int(self.size[i]))
            found = (edits, int(place[first]), int(place[end - 1]))
            if (d, i) not in best or found < best[d, i]:
                best[d, i] = found
        for (d, i), (edits, first, last) in best.items():
            yield d, i, edits, first, last

    def align(self, code: np.ndarray, total: np.ndarray, bounds: np.ndarray, doc: np.ndarray, item: np.ndarray, band: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, end position) of the bands whose best alignment keeps the budget, in batches of so many cells."""
        wide = 6 * self.budget[item] + 2
        order = np.argsort(wide, kind="stable")
        while len(order):
            batch = max(1, int(np.searchsorted(np.arange(1, len(order) + 1) * wide[order], cells, "right")))
            now, order = order[:batch], order[batch:]
            yield from self._align(code, total, bounds, doc[now], item[now], band[now])

    def _align(self, code: np.ndarray, total: np.ndarray, bounds: np.ndarray, doc: np.ndarray, item: np.ndarray, band: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        budget, size = self.budget[item], self.size[item]
        low, width = band * (2 * budget + 1) - budget, 6 * budget + 2
        k = np.arange(int(width.max()))
        diagonal = low[:, None] + k
        start, stop = bounds[doc][:, None], bounds[doc + 1][:, None]
        inside = k < width[:, None]
        most = np.minimum(size[:, None], stop - diagonal)
        reach = np.where(inside & (diagonal >= start) & (diagonal <= stop), 0, NOWHERE)
        live = np.arange(len(doc))
        for edits in range(int(budget.max()) + 1):
            if edits:
                new = np.where(reach < most[live], reach + 1, reach)  # another character
                more = np.where(reach[:, :-1] <= most[live, 1:], reach[:, :-1], NOWHERE)  # one that only the document has
                new[:, 1:] = np.maximum(new[:, 1:], more)
                new[:, :-1] = np.maximum(new[:, :-1], reach[:, 1:] + 1)  # one that only the item has
                reach = np.where(inside[live], np.minimum(new, size[live][:, None]), NOWHERE)
            row, column = np.nonzero((reach >= 0) & (reach < most[live]))
            far = reach[row, column]
            reach[row, column] = far + self._equal(code, total, diagonal[live[row], column] + far, self.first[item[live[row]]] + far, most[live[row], column] - far)
            ended = (reach >= size[live][:, None]).any(1)
            for x in np.flatnonzero(ended):
                yield int(doc[live[x]]), int(item[live[x]]), edits, int(low[live[x]] + (reach[x] >= size[live[x]]).argmax() + size[live[x]])
            on = ~ended & (budget[live] > edits)
            live, reach = live[on], reach[on]
            if not len(live):
                return

    def _equal(self, code: np.ndarray, total: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many characters are equal from x in the document and y in the items on, `most` at most."""
        out = np.zeros(len(x), np.int64)
        x0, y0 = x, y
        who = np.flatnonzero(code[x] == self.code[y])
        x, y, low, high = x[who], y[who], np.ones(len(who), np.int64), most[who]
        power = powers(max(len(code), len(self.code)) + 1)[0]
        while len(who):
            half = (low + high + 1) // 2
            with np.errstate(over="ignore"):
                same = (total[x + half] - total[x]) * power[y] == (self.sums[y + half] - self.sums[y]) * power[x]
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
            ready = low >= high
            out[who[ready]] = low[ready]
            who, x, y, low, high = (v[~ready] for v in (who, x, y, low, high))
        return self._confirmed(code, x0, y0, out)

    def _confirmed(self, code: np.ndarray, x: np.ndarray, y: np.ndarray, equal: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """The stretches up to their first character that differs after all: equal sums may, in theory, be those of other texts."""
        ends = np.cumsum(equal)
        first = 0
        while first < len(equal):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + piece, "right")))
            n = equal[first:last]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = code[np.repeat(x[first:last], n) + step] != self.code[np.repeat(y[first:last], n) + step]
            if differ.any():
                owner = np.repeat(np.arange(first, last), n)[differ]
                rows, where = np.unique(owner, return_index=True)
                equal[rows] = step[differ][where]
            first = last
        return equal


def _counted(keys: np.ndarray, table: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often each occurs; keys that lie close together are counted in a table."""
    if len(keys) and (least := int(keys.min())) + table > int(keys.max()):
        counts = np.bincount(keys - least)
        at = np.flatnonzero(counts)
        return at + least, counts[at]
    return np.unique(keys, return_counts=True)


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of counts as one."""
    both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([counts, more_counts]), len(both)).astype(np.int64)


def _blocks(space: common.Workspace, benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[tuple[list, list, bool]]:
    """(ids, texts, is it the last) of the benchmark in blocks of about `block_chars` characters; at least one block."""
    items = common.own_columns(benchmark, id=item_col, text=item_text).where(F.char_length("text") > 0)
    blocks = 1 + (items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0) // block_chars
    if blocks > 1:
        numbered = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
        items = space.keep(numbered.repartition("block").sortWithinPartitions("block"))
    for block in range(blocks):
        part = (items.where(F.col("block") == block) if blocks > 1 else items).orderBy("id", "text").collect()
        yield [r["id"] for r in part], [r["text"] for r in part], block == blocks - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, edits, first_char, last_char of every document and item of which it holds a passage.

    What is sent to the tasks and held by the driver is one block of items, so it doesn't grow with the benchmark: of several
    blocks each is worked off and its results are stored before the next one is sent.
    """
    rows = common.own_columns(docs, id=id_col, text=text_col)
    item_kind = common.own_columns(benchmark, id=item_col).schema["id"].dataType
    item_type = to_arrow_type(item_kind)
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, item_id {item_kind.simpleString()}, edits long, first_char long, last_char long"
    found = None
    with common.Workspace(docs.sparkSession, "leaks") as space:
        for ids, texts, last in _blocks(space, benchmark, item_col, item_text, block_chars):
            sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

            def run(batches, sent=sent):
                ids, texts = sent.value
                index = Items(texts, q, rate)
                for batch in common.slices(batches):
                    hits = list(index.find(*common.text_buffers(batch.column("text"))))
                    d, i, *rest = zip(*hits, strict=True) if hits else ((),) * 5
                    taken = batch.column("id").take(pa.array(d, pa.int64()))
                    yield pa.RecordBatch.from_arrays([taken, pa.array([ids[k] for k in i], item_type), *(pa.array(x, pa.int64()) for x in rest)], ["id", "item_id", "edits", "first_char", "last_char"])

            one = rows.mapInArrow(run, kinds)
            if found is None and last:
                return one.withColumnRenamed("id", id_col)
            one = common.cut(one)
            sent.destroy()
            found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("id", id_col)


def remove_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The rows that hold no benchmark passage, with all their columns; rows are tested where they lie, without a join.

    Of several blocks each is worked off and the rows that are left are stored before the next one is sent.
    """
    with common.Workspace(docs.sparkSession, "clean") as space:
        for _, texts, last in _blocks(space, benchmark, item_col, item_text, block_chars):
            sent = docs.sparkSession.sparkContext.broadcast(texts)

            def run(batches, sent=sent):
                index = Items(sent.value, q, rate)
                for batch in common.slices(batches, text_col):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[hit[0] for hit in index.find(*common.text_buffers(batch.column(text_col)))]] = False
                    yield batch.filter(pa.array(keep))

            docs = docs.mapInArrow(run, docs.schema)
            if not last:
                docs = common.cut(docs)
                sent.destroy()
    return docs
