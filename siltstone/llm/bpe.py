"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches, and an offset-table decoder.

Encoding: an Aho-Corasick automaton reports every token that occurs in a pre-token. From each position the longest
token is taken that is compatible with the token before it; a dead end marks its position and steps back to a shorter
token. Every position is left for good at most once, so the work is linear. A pair is compatible when BPE of its joined
bytes gives the pair again, which makes the result equal to merging by rank. Pre-tokens of a buffer take their steps together;
one of more than LONG bytes is walked on its own.

Defined results: a null text encodes as the empty text, which has no tokens; special strings inside a text become their
special token, as in the public library's default; repeated rows are each encoded; an empty table gives no rows; texts are
encoded whole, however long; extra columns play no part. The encoding is unique, so there are no ties.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import automaton, common, vocabulary


#: Pre-tokens of more bytes are walked one by one: steps of many machines at once don't pay for a single one.
LONG = 1024


class Encoder:
    """Encodes buffers of texts; all pre-tokens of a buffer take their steps together."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary.load(path)
        # read from the back, the longest token that ends at a byte is the longest that starts there
        self.found = automaton.Automaton({piece[::-1]: i for piece, i in self.vocabulary.ids.items()})
        self.data, self.starts = self.vocabulary.offsets()
        self.size = np.diff(self.starts)
        self.shorter = np.full(len(self.size), -1, np.int64)  # the longest token that a token begins with
        for piece, i in self.vocabulary.ids.items():
            for k in range(len(piece) - 1, 0, -1):
                if (found_id := self.vocabulary.ids.get(piece[:k])) is not None:
                    self.shorter[i] = found_id
                    break
        self.sizes, self.shorters = self.size.tolist(), self.shorter.tolist()

    def longest(self, raw: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The longest token from each byte that stays within its pre-token (`stops`: where these end)."""
        return self.found.matches(raw[::-1], len(raw) - stops)[::-1]

    def encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, token) of all tokens of the pre-tokens that start at `starts`, in order."""
        n = len(raw)
        stops = np.append(starts[1:], n)
        untried = self.longest(raw, stops).copy()  # by position; the longest comes first
        arrived = np.full(n + 1, -1, np.int64)  # by position, the token that ends there on the path
        dead = np.zeros(n + 1, bool)
        long = stops - starts > LONG
        for first, last in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            arrived[first + 1 : last + 1] = self._walk(untried[first:last].tolist())
        at, begin, stop = starts[~long], starts[~long], stops[~long]
        prev = np.full(len(at), -1, np.int64)
        ends_at, tokens = [], []
        while len(at):
            token = untried[at]
            stuck = token < 0
            to = np.where(stuck, at, at + self.size[token])
            fits = ~stuck & ~dead[to]
            asked = np.flatnonzero(fits & (prev >= 0))
            fits[asked] = self.vocabulary.compatible_many(prev[asked], token[asked])
            untried[at] = self.shorter[token]
            go, back = np.flatnonzero(fits), np.flatnonzero(stuck)
            arrived[to[go]] = token[go]
            if len(back):
                dead[at[back]] = True
                to[back] = at[back] - self.size[prev[back]]
            at = np.where(fits | stuck, to, at)
            prev = np.where(fits, token, prev)
            if len(back):
                first = at[back] == begin[back]
                prev[back] = np.where(first, -1, arrived[at[back]])
            on = at < stop
            if not on.all():
                at, begin, stop, prev = at[on], begin[on], stop[on], prev[on]
        arrived[dead] = -1
        ends = np.flatnonzero(arrived >= 0)
        return ends, arrived[ends]

    def _walk(self, untried: list[int]) -> list[int]:
        """For each position of one pre-token but the first, the token that ends there, or -1; `untried` has the longest tokens."""
        n = len(untried)
        size, shorter, compatible = self.sizes, self.shorters, self.vocabulary.compatible
        arrived, dead = [-1] * (n + 1), bytearray(n + 1)
        at, prev = 0, -1
        while at < n:
            token = untried[at]
            if token < 0:
                dead[at] = 1
                arrived[at] = -1
                at -= size[prev]
                prev = arrived[at] if at else -1
                continue
            untried[at] = shorter[token]
            to = at + size[token]
            if not dead[to] and (prev < 0 or compatible(prev, token)):
                arrived[to] = prev = token
                at = to
        return arrived[1:]

    def texts(self, offsets: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """Token ids of each text of a buffer."""
        if not len(raw):
            return [np.zeros(0, np.int64)] * (len(offsets) - 1)
        spans = self.vocabulary.special_spans(raw.tobytes(), offsets)
        parts = np.array([p for a, b, _ in spans for p in (a, b)], np.int64)
        segments = np.unique(np.concatenate([offsets[:-1], parts]))
        ends, ids = self.encode(raw, vocabulary.pretoken_starts(raw, segments[segments < len(raw)]))
        if spans:
            first, last, special = np.array(spans, np.int64).T
            # what was found within the spans goes, all in one pass
            change = np.zeros(len(ends) + 1, np.int64)
            np.add.at(change, np.searchsorted(ends, first + 1), 1)
            np.add.at(change, np.searchsorted(ends, last + 1), -1)
            outside = np.cumsum(change)[:-1] == 0
            ends, ids = np.concatenate([ends[outside], last]), np.concatenate([ids[outside], special])
            order = np.argsort(ends, kind="stable")
            ends, ids = ends[order], ids[order]
        cuts = np.searchsorted(ends, offsets, "right")
        return [ids[first:last] for first, last in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence, gathered through the offset table."""
        lengths = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        where = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.data[where].tobytes()


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode_texts(parts: list[bytes]) -> list[str]:
    """Bytes as text; bytes that are no valid UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in parts]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text has no ids."""

    def run(batches):
        tool = encoder(path or vocabulary.default_path())
        for batch in common.slices(batches):
            at, raw = common.text_buffers(batch.column("text"))
            ids = tool.texts(at, raw)
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, flat)], ["id", "ids"])

    rows = common.own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of token ids; null ids decode to the empty text."""

    def run(batches):
        tool = encoder(path or vocabulary.default_path())
        for batch in batches:
            texts = decode_texts([tool.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = common.own_columns(encoded, id=id_col, ids=ids_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every row; keep digests: doc_id, n_tokens, ids_sha256, decoded_sha256, exact.

    `ids_sha256` is of the decimal ids joined by commas, `decoded_sha256` of the decoded text in UTF-8; `exact` says
    whether the decoded text is the text itself.
    """

    def run(batches):
        tool = encoder(path or vocabulary.default_path())
        digits = np.array([str(i) for i in range(len(tool.vocabulary.bytes))], object)
        for batch in common.slices(batches):
            at, raw = common.text_buffers(batch.column("text"))
            out: list[list] = [[], [], [], []]
            for k, ids in enumerate(tool.texts(at, raw)):
                decoded = tool.decode(ids)
                text = decoded.decode("utf-8", "replace").encode()
                for column, value in zip(out, (len(ids), hashlib.sha256(",".join(digits[ids].tolist()).encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text == raw[at[k] : at[k + 1]].tobytes()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out, kinds)], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    rows = common.own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_col)
