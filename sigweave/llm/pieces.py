"""A store of what a tokenizer makes of each distinct chunk of text.

Tokenizers that never join pieces over a chunk's ends can be run once per distinct chunk; a text's
result is then the concatenation of its chunks' results. The store is keyed by two independent hashes of
the chunk: chunks that agree in the first one only are told apart. It lives in a Python worker, and holds at
most ``limit`` chunks, or those of one call: beyond that the less used half goes, but none that the call asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sigweave.llm.text import mix


class ChunkStore:
    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint32, limit: int = 400_000):
        """encode: chunks to the number of values of each, and all values one after the other."""
        self.encode, self.limit = encode, limit
        self.keys = np.empty(0, np.uint64)
        self.checks = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.total = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int32)
        self.pool = np.empty(0, dtype)

    def rows(self, hashes: np.ndarray, checks: np.ndarray, chunk: Callable[[int], bytes]) -> np.ndarray:
        """The store's row of each chunk, given by two hashes; chunk(i) gives the text behind hashes[i]."""
        while True:  # a chunk whose first hash is another chunk's moves on
            keys, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            own = checks[first]
            known = self._find(keys)
            taken = (known >= 0) & (self.checks[known] != own) if len(self.keys) else np.zeros(len(keys), bool)
            wrong = (own[inverse] != checks) | taken[inverse]
            if not wrong.any():
                break
            hashes = np.where(wrong, mix(hashes + checks), hashes)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            if len(self.keys) + len(missing) > self.limit or len(self.pool) > 16 * self.limit:
                self._shrink(known[known >= 0])
            sizes, values = self.encode([chunk(int(i)) for i in first[missing]])
            ends = np.cumsum(sizes)
            begin = len(self.pool) + ends - sizes
            run = np.concatenate(([0], np.cumsum(values)))
            place = np.searchsorted(self.keys, keys[missing])
            self.keys = np.insert(self.keys, place, keys[missing])
            self.checks = np.insert(self.checks, place, own[missing])
            self.at = np.insert(self.at, place, begin)
            self.size = np.insert(self.size, place, sizes)
            self.total = np.insert(self.total, place, run[ends] - run[ends - sizes])
            self.uses = np.insert(self.uses, place, 0)
            self.pool = np.concatenate((self.pool, values.astype(self.pool.dtype)))
            known = self._find(keys)
        self.uses[known] = np.minimum(self.uses[known] + counts, 1 << 30)
        return known[inverse]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _shrink(self, asked: np.ndarray) -> None:
        """The less used half goes; rows that are just being asked for stay."""
        keep = np.union1d(np.argsort(self.uses, kind="stable")[len(self.uses) // 2 :], asked)
        self.pool = self._gather(keep)
        self.keys, self.checks, self.size, self.total, self.uses = self.keys[keep], self.checks[keep], self.size[keep], self.total[keep], self.uses[keep] // 2
        self.at = (np.cumsum(self.size) - self.size).astype(np.int64)

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.at[rows] - (ends - size), size) + np.arange(total)]

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some chunks one after the other, and where each chunk's values end."""
        return self._gather(rows), np.cumsum(self.size[rows].astype(np.int64))
