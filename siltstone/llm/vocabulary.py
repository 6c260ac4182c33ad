"""A byte-level BPE vocabulary: pre-token boundaries, token bytes and the pair-compatibility relation."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)

#: Code points with the Unicode White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: The suffixes that the pre-tokeniser splits off after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def decode_utf8(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of every character of valid UTF-8."""
    if not (raw & 0x80).any():
        return np.arange(len(raw)), raw.astype(np.int32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at]
    code = lead.astype(np.int32)
    for least, most, keep, more in ((0xC0, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xFF, 0x07, 3)):
        who = np.flatnonzero((lead >= least) & (lead <= most))
        if len(who):
            value = code[who] & keep
            for k in range(1, more + 1):
                value = (value << 6) | (raw[at[who] + k] & 0x3F)
            code[who] = value
    return at, code


def pretoken_starts(raw: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start. `segments`: sorted byte positions where texts or parts of texts start.

    The rule is the public byte-level pattern: contractions; an optional blank and a run of letters, of numbers or of
    other characters; white space, whose last character before a visible one stands apart.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    at, code = decode_utf8(raw)
    n = len(at)
    kind = char_classes()[code]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, segments)] = True
    first[0] = first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last_blank = np.flatnonzero((kind == SPACE)[:-1] & (kind != SPACE)[1:] & ~first[1:n])
    start[last_blank] = True
    start[last_blank[code[last_blank] == 0x20] + 1] = False
    quotes = np.flatnonzero(start & (code == 0x27))
    for suffix in CONTRACTIONS:
        who = quotes[quotes + len(suffix) < n]
        for k, letter in enumerate(suffix, 1):
            who = who[(code[who + k] == ord(letter)) & ~first[who + k]]
        start[who + 1] = False
        after = who + len(suffix) + 1
        start[after[after < n]] = True
    return at[start]


class Vocabulary:
    """Token bytes, merge pairs and splits of a byte-level BPE file; compat() is memoised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        to_byte = {chr(b): b for b in printable}
        to_byte |= {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in set(printable))}
        as_bytes = lambda piece: bytes(map(to_byte.__getitem__, piece))
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"] if x["special"]}
        self.ids = {as_bytes(piece): i for piece, i in model["vocab"].items() if piece.encode() not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for piece, i in (*self.ids.items(), *self.special.items()):
            self.bytes[i] = piece
        #: pair of ids -> (rank, merged id); id -> (rank, left, right), rank -1 for single bytes
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: list[tuple[int, int, int]] = [(-1, i, i) for i in range(size)]
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.ids[left + right]
            self.merges[self.ids[left], self.ids[right]] = (rank, made)
            if self.split[made][0] < 0:
                self.split[made] = (rank, self.ids[left], self.ids[right])
        self._compatible: dict[int, bool] = {}
        self.rank, self.left, self.right = (np.array(x, np.int64) for x in zip(*self.split, strict=True))
        keys = np.array([a << 20 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self._pairs = np.append(keys[order], np.int64(2**62))
        self._ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], 2**40)
        self._cached, self._stand = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """The decoding table: all token bytes in a row, and where each token starts."""
        lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.concatenate([[0], np.cumsum(lengths)])

    def compatible(self, left: int, right: int) -> bool:
        """Does BPE of the two tokens' joined bytes give just these two tokens?"""
        key = left << 20 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            known = self._compatible[key] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, latest first; the seam fails when a merge across it came before the one undone."""
        limit = len(self.merges)
        while True:
            across = self.merges.get((left, right))
            if across and across[0] < limit:
                return False
            (a, _, inner), (b, outer, _) = self.split[left], self.split[right]
            if a < 0 and b < 0:
                return True
            # of two merges with one rank the left one is made first, so the right one is undone first
            if a > b:
                limit, left = a, inner
            else:
                limit, right = b + 1, outer

    def compatible_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of many pairs, through a table of pairs met before."""
        key = left << 20 | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        missing = np.flatnonzero(self._cached[slot] != key)
        result = self._stand[slot]
        if len(missing):
            _, at = np.unique(key[missing], return_index=True)
            at = missing[at]
            stands = self._stand_many(left[at], right[at])
            self._cached[slot[at]], self._stand[slot[at]] = key[at], stands
            found = np.searchsorted(key[at], key[missing])
            result[missing] = stands[found]
        return result

    def _stand_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stands() of many pairs in step."""
        result = np.ones(len(left), bool)
        who, limit = np.arange(len(left)), np.full(len(left), len(self.merges))
        while len(who):
            key = left << 20 | right
            at = np.searchsorted(self._pairs, key)
            fails = (self._pairs[at] == key) & (self._ranks[at] < limit)
            result[who[fails]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~fails & ((a >= 0) | (b >= 0))
            who, left, right, a, b = who[on], left[on], right[on], a[on], b[on]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return result

    def special_spans(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special strings within the texts of a buffer, left to right."""
        found = []
        for text, i in self.special.items():
            at = raw.find(text)
            while at >= 0:
                end = at + len(text)
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):
                    found.append((at, end, i))
                at = raw.find(text, end)
        return sorted(found)


@functools.lru_cache(2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
