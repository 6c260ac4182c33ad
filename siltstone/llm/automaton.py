"""An Aho-Corasick automaton in flat tables, run over many chunks of a buffer at once."""

from __future__ import annotations

import numpy as np


class Automaton:
    """Finds, for every byte, the longest of the given words that ends there."""

    def __init__(self, words: dict[bytes, int]):
        nodes = sorted({word[:k] for word in words for k in range(1, len(word) + 1)}, key=len)
        number = {b"": 0} | {node: i for i, node in enumerate(nodes, 1)}
        parent = np.array([0, *(number[x[:-1]] for x in nodes)])
        byte = np.array([0, *(x[-1] for x in nodes)])
        depth = np.array([0, *map(len, nodes)])
        self.longest = int(depth.max())
        self.next = np.zeros((len(number), 256), np.int32)
        self.word = np.array([-1, *(words.get(x, -1) for x in nodes)], np.int64)
        fail = np.zeros(len(number), np.int64)
        for d in range(1, self.longest + 1):
            level = np.flatnonzero(depth == d)
            if d > 1:
                fail[level] = self.next[fail[parent[level]], byte[level]]
            self.next[parent[level], byte[level]] = level
            self.next[level] = self.next[fail[level]]
            self.word[level] = np.where(self.word[level] < 0, self.word[fail[level]], self.word[level])

    def matches(self, raw: np.ndarray, resets: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """The longest word ending at each byte (-1: none) that does not reach back over the last reset position."""
        n, warm = len(raw), self.longest
        lanes = -(-n // chunk)
        padded, fresh = np.zeros(warm + lanes * chunk, np.uint8), np.zeros(warm + lanes * chunk, bool)
        padded[warm : warm + n] = raw
        fresh[warm + resets] = True
        view = np.lib.stride_tricks.sliding_window_view
        byte, fresh = (np.ascontiguousarray(view(x, warm + chunk)[::chunk].T) for x in (padded, fresh))
        state = np.zeros(lanes, np.int64)
        out = np.empty((chunk, lanes), np.int64)
        flat = self.next.ravel()
        for t in range(warm + chunk):
            state[fresh[t]] = 0
            state = flat[state * 256 + byte[t]].astype(np.int64)
            if t >= warm:
                out[t - warm] = self.word[state]
        return out.T.ravel()[:n]
