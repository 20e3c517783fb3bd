"""Vectorised word and n-gram hashing over Arrow string columns.

Every function works on a *slice*: the bytes of some whole documents, one after the other, with
their offsets. Slices hold about ``SLICE_BYTES`` of text (one document at least), so memory in a
task follows the longest document, never the partition.

Hashes are 64-bit. A word's is a chain over its 8-byte blocks, a run of words is put together from the
hashes of its halves, and every step multiplies and scrambles, so no pattern of bytes or words (as a
polynomial would have them) makes different texts hash alike. Equal sequences always hash alike, on
every machine and in every run. Where a result depends on two texts being equal, operators compare a
second hash (``checks``) or the words themselves.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

#: Longer words are hashed one by one; the others block by block, all words at once.
_LONG_WORD = 64
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_HEAD = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x369DEA0F31A53F85))
#: Masks that keep the first k bytes of a block.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

#: Words without ASCII white space; words of digits, a-z and any non-ASCII character.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_libc = ctypes.CDLL(ctypes.util.find_library("c") or None)


def release_memory() -> None:
    """Gives freed memory back to the system where the C library can; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(left: np.ndarray, right: np.ndarray, kind: int = 0) -> np.ndarray:
    """The hash of two runs that follow each other, from their hashes."""
    return mix(mix(left * _STEP[kind] + _HEAD[kind]) * _STEP[1 - kind] + right)


class Slice:
    """Some documents: ``data`` their bytes, ``offsets`` where each begins, ``first`` the row of the first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, is_word: np.ndarray, cuts: np.ndarray | None = None) -> "Words":
        """is_word: which byte values words are made of. cuts: bytes before which a word ends and another one begins."""
        return Words(self, is_word, cuts)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
        j = min(j, len(column))
        yield Slice(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], i)
        i = j
    release_memory()


class Words:
    """The words of a slice in order: bytes ``starts`` to ``ends``; document i has words ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, of: Slice, is_word: np.ndarray, cuts: np.ndarray | None = None):
        self.slice = of
        inside = is_word[of.data]
        before, after = np.empty(len(inside), bool), np.empty(len(inside), bool)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = of.offsets[1:-1]
            before[edges[edges < len(inside)]] = False
            after[edges[edges > 0] - 1] = False
            if cuts is not None:
                before[cuts] = False
                after[:-1][cuts[1:]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(self.starts, of.offsets)
        self.counts = np.diff(self.at)

    def hashes(self, lower: bool, kind: int = 0) -> np.ndarray:
        """The hash of each word. kind 1 gives other hashes, independent of those of kind 0."""
        data = LOWER[self.slice.data] if lower else self.slice.data
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _STEP[kind] + _HEAD[kind]
        at = np.flatnonzero(size <= _LONG_WORD)
        done = 0
        while len(at):
            left = size[at] - done
            block = blocks[self.starts[at] + done] & _FIRST_BYTES[np.minimum(left, 8)]
            h[at] = mix((h[at] ^ block) * _STEP[kind])
            at, done = at[left > 8], done + 8
        for i in np.flatnonzero(size > _LONG_WORD).tolist():
            word = data[self.starts[i] : self.ends[i]]
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"%d" % kind).digest(), "little")
        return h

    def chunk(self, i: int) -> bytes:
        return self.slice.data[self.starts[i] : self.ends[i]].tobytes()


def grams(hashes: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """The hash of every run of n words; runs over a document's end must be left out by the caller."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    # runs of 1, 2, 4, ... words; those that make up n are put together from the largest down
    power, runs = [hashes], 1
    while 2 * runs <= n:
        power.append(join(power[-1][: len(power[-1]) - runs], power[-1][runs:], kind))
        runs *= 2
    out, length = power[-1], runs
    for k in range(len(power) - 2, -1, -1):
        if n >> k & 1:
            out = join(out[: len(hashes) - length - (1 << k) + 1], power[k][length:], kind)
            length += 1 << k
    return out if n > 1 else join(hashes, hashes, kind)


def signed(x: np.ndarray) -> np.ndarray:
    """For Spark's long."""
    return x.view(np.int64)


def flags_within(starts: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in any [start, start + length)."""
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, total), -1)
    return np.cumsum(marks[:total]) > 0
