"""Token counts by a compiled finite-state transducer.

BPE of a pre-token is read as a deterministic transducer over bytes. A state holds the longest suffix that can still
grow into a token, and for each place in it the last token and the count of the best prefix so far; a transition is
annotated with the change of the token count. States are made on first use and kept in flat tables, so a step is a
table look-up. A new pre-token resets the machine.

Texts are laid out as equal chunks that all run at once, each from the state of a pre-token's start. A chunk's state map is
kept as the path of states from one entry: any other entry leads to the same path from where the two meet, at the
first reset at the latest. Maps of neighbouring blocks compose by a parallel prefix scan: in each round all blocks of twice
the length are formed at once, and the right half is replayed from the left half's exit until it meets its path. After
as many rounds as the number of chunks has binary digits, all paths hang together from the first byte on.

Defined results: a null text counts as the empty text, which has no tokens; repeated rows are each counted; an empty table gives
no rows; a text is counted whole, however long, in spans that hand their state on; extra columns play no part. The tokens of
a text are unique, so there are no ties.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vocabulary

#: Histories are packed integers: (token + 1) << 12 | count + 2048, with 0 as the token at a pre-token's start; -1: no use.
ZERO = 2048
ORIGIN = np.array([ZERO], np.int64).tobytes()
#: Bytes of a chunk, and of a span, between which states can be made anew.
CHUNK, SPAN = 512, 1 << 18


class Transducer:
    """Transition tables that grow as states are met; beyond `most` states they are made anew."""

    def __init__(self, path: str, most: int = 300_000):
        self.vocabulary = vocabulary.load(path)
        self.grows = {piece[:k] for piece in self.vocabulary.ids for k in range(1, len(piece))}
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[bytes, bytes]] = [(b"", ORIGIN)]
        self.number = {self.states[0]: 0}
        self.kinds = np.full(256, -1, np.int64)  # bytes are numbered as they are met
        self.seen: list[int] = []
        self.to = np.full((4096, 64), -1, np.int32)
        self.emits = np.zeros((4096, 64), np.int8)

    def step(self, state: tuple[bytes, bytes], byte: int) -> tuple[tuple[bytes, bytes], int]:
        """The state after one more byte, and the change of the token count."""
        suffix, packed = state
        history = memoryview(packed).cast("q").tolist()
        grown = suffix + bytes((byte,))
        find, compatible, grows = self.vocabulary.ids.get, self.vocabulary.compatible, self.grows
        for k, past in enumerate(history):
            if past >= 0:
                token = find(grown[k:])
                if token is not None and (past < 4096 or compatible((past >> 12) - 1, token)):
                    break
        else:
            raise ValueError(f"no token ends {grown!r}")
        change = (past & 4095) - ZERO + 1
        kept, new = None, []
        for k, past in enumerate(history):
            useful = grown[k:] in grows
            if kept is None:
                if not useful:
                    continue
                kept = k
            new.append(past - change if useful and past >= 0 else -1)
        new.append((token + 1) << 12 | ZERO)
        return (b"" if kept is None else grown[kept:], struct.pack(f"{len(new)}q", *new)), change

    def learn(self, state: int, kind: int) -> None:
        made, change = self.step(self.states[state], self.seen[kind])
        to = self.number.get(made)
        if to is None:
            to = self.number[made] = len(self.states)
            self.states.append(made)
            self._widen(to)
        self.to[state, kind], self.emits[state, kind] = to, change

    def _widen(self, state: int) -> None:
        if state >= len(self.to):
            more = len(self.to)
            self.to = np.concatenate([self.to, np.full((more, self.to.shape[1]), -1, np.int32)])
            self.emits = np.concatenate([self.emits, np.zeros((more, self.emits.shape[1]), np.int8)])

    def classes(self, raw: np.ndarray) -> np.ndarray:
        """The bytes by their numbers; unseen ones get the next number."""
        for byte in np.flatnonzero((np.bincount(raw, minlength=256) > 0) & (self.kinds < 0)).tolist():
            self.kinds[byte] = len(self.seen)
            self.seen.append(byte)
        while len(self.seen) > self.to.shape[1]:
            self.to = np.concatenate([self.to, np.full_like(self.to, -1)], axis=1)
            self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)], axis=1)
        return self.kinds[raw].astype(np.uint8)

    def advance(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many machines at once."""
        width = self.to.shape[1]
        at = state.astype(np.int64) * width + kind
        to = self.to.ravel()[at]
        missing = np.flatnonzero(to < 0)
        if len(missing):
            for key in np.unique(at[missing]).tolist():
                self.learn(*divmod(key, width))
            to = self.to.ravel()[at]
        return to, self.emits.ravel()[at]

    def enter(self, state: tuple[bytes, bytes]) -> int:
        """The number of a state, which may be from before a reset."""
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self._widen(number)
        return number

    def changes(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The count's change at every byte, given where pre-tokens start."""
        out = np.zeros(len(raw), np.int16)
        carry = self.states[0]
        for first in range(0, len(raw), SPAN):
            if len(self.states) > self.most:
                self.reset()
            low, high = np.searchsorted(starts, [first, first + SPAN])
            out[first : first + SPAN], carry = self._span(raw[first : first + SPAN], starts[low:high] - first, carry)
        return out

    def _span(self, raw: np.ndarray, starts: np.ndarray, carry: tuple[bytes, bytes]) -> tuple[np.ndarray, tuple[bytes, bytes]]:
        """The changes of a span that is entered in state `carry`, and the state that it ends in."""
        n = len(raw)
        lanes = -(-n // CHUNK)
        fresh = np.zeros(lanes * CHUNK, bool)
        fresh[starts] = True
        fresh[n:] = True  # padding: each byte is a pre-token of its own
        padded = np.zeros(lanes * CHUNK, np.uint8)
        padded[:n] = self.classes(raw)
        fresh, byte = (np.ascontiguousarray(x.reshape(lanes, CHUNK).T) for x in (fresh, padded))
        out, path = np.zeros((CHUNK, lanes), np.int16), np.zeros((CHUNK + 1, lanes), np.int32)
        for t in range(CHUNK):
            path[t, fresh[t]] = 0
            path[t + 1], out[t] = self.advance(path[t], byte[t])
        width = 1
        while width < lanes:
            right = np.arange(width, lanes, 2 * width)
            self._replay(right, np.minimum(right + width, lanes), path[CHUNK, right - 1], fresh, byte, out, path)
            width *= 2
        self._replay(np.zeros(1, np.int64), np.array([lanes]), np.array([self.enter(carry)]), fresh, byte, out, path)
        # the padding comes after the last byte
        last = path[(n - 1) % CHUNK + 1, lanes - 1]
        return out.T.ravel()[:n], self.states[last]

    def _replay(self, now: np.ndarray, stop: np.ndarray, entry: np.ndarray, fresh: np.ndarray, byte: np.ndarray, out: np.ndarray, path: np.ndarray) -> None:
        """Run blocks, which begin with chunk `now`, from the states `entry` until they meet the paths that are known; all in step."""
        state = entry.astype(np.int32)
        while len(now):
            who = np.arange(len(now))
            for t in range(CHUNK):
                who = who[~fresh[t, now[who]] & (state[who] != path[t, now[who]])]
                if not len(who):
                    break
                path[t, now[who]] = state[who]
                state[who], out[t, now[who]] = self.advance(state[who], byte[t, now[who]])
            who = who[state[who] != path[CHUNK, now[who]]]
            path[CHUNK, now[who]] = state[who]
            who = who[now[who] + 1 < stop[who]]
            now, stop, state = now[who] + 1, stop[who], state[who]

    def counts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer; special strings count as one token."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(n, np.int64)
        spans = self.vocabulary.special_spans(raw.tobytes(), offsets)
        parts = np.array([p for a, b, _ in spans for p in (a, b)], np.int64)
        segments = np.unique(np.concatenate([offsets[:-1], parts]))
        change = self.changes(raw, vocabulary.pretoken_starts(raw, segments[segments < len(raw)]))
        for a, b, _ in spans:
            change[a:b] = 0
            change[a] = 1
        out, full = np.zeros(n, np.int64), np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(change, offsets[full], dtype=np.int64)
        return out


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""

    def run(batches):
        tool = transducer(path or vocabulary.default_path())
        for batch in common.slices(batches):
            at, raw = common.text_buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(tool.counts(at, raw))], ["id", "n_bytes", "n_tokens"])

    rows = common.own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
