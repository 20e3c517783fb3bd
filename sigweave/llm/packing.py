"""Sequence packing: shortest-pack-first over the histogram of lengths.

Documents become pieces of at most ``size`` tokens. Only the histogram of piece lengths (``size``
rows at most) is placed on the driver: lengths go longest first, each time into the open packs with
the most room that still hold the length, which changes how many packs there are of each pattern; a
length for which no pack has room opens new ones. Patterns are then joined back to the pieces by
rank: piece number r of its length takes slot number r of that length.

The histogram and the patterns are bounded by the size, however many documents there are. Ranks
within a length are counted in blocks (a block's start plus the row number in it), so a length that
a third of all pieces have is not numbered in one task.

Results for odd input: a null or empty text is the single end token; a text of any length is cut at
multiples of the size; repeated rows are packed each by itself; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.pieces import ChunkStore
from sigweave.llm.shared import stash
from sigweave.llm.text import NOT_SPACE, slices

SIZE = 4096
END = 2
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
#: Marks that may be cut off a word: not those of contractions and special tokens.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in "'<|>" for b in range(256)])


class WordTokenizer:
    """A tokenizer that drops white space and splits letters from marks: ids of a text are those of its parts, one after the other.

    A cut stands before an ASCII character only, so no accent is parted from its letter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store = ChunkStore(self._encode)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes, values = [], []
        for k in range(0, len(chunks), 1000):
            some = [c.decode() for c in chunks[k : k + 1000]]
            # a text of chunks between line breaks; each id belongs to the chunk that it begins in
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            begins = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
            sizes.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(some)))
            values.append(np.array(found.ids, np.int64))
        return np.concatenate(sizes), np.concatenate(values)

    def ids(self, part) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents, and where each document's begin and end."""
        cuts = np.zeros(len(part.data), bool)
        letter, mark = _LETTER[part.data], _MARK[part.data]
        cuts[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        w = part.words(NOT_SPACE, cuts)
        if not len(w.starts):
            return np.empty(0, np.uint32), np.zeros(part.n + 1, np.int64)
        values, ends = self.store.values(self.store.rows(w.hashes(lower=False), w.hashes(lower=False, kind=1), w.chunk))
        return values, np.concatenate(([0], ends))[w.at]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(path: str, size: int, batches):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
    tok = word_tokenizer(path)
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        out: list[tuple] = []
        for part in slices(batch.column(1)):
            ids, at = tok.ids(part)
            for i in range(part.n):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(END)).astype("<u4")
                raw = own.tobytes()
                out += [(doc_ids[part.first + i], s, min(size, len(own) - s), zlib.crc32(raw[4 * s : 4 * (s + size)]), len(own)) for s in range(0, len(own), size)]
        for k in range(0, max(1, len(out)), 100_000):
            rows = list(zip(*out[k : k + 100_000], strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def cut(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document, with the CRC-32 of their ids."""
    path = vocabulary or default_vocabulary()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _cut(path, size, batches), _PIECES)


def place(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: how many packs there are of each pattern (its lengths, longest first).

    The work follows the number of lengths and patterns, not of pieces.
    """
    packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by what is used
    used: list[int] = []  # the keys of packs in order

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if total not in packs or not packs[total]:
            if total not in used:
                bisect.insort(used, total)
        packs[total][pattern] = packs[total].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and used and used[0] + length <= size:
            total = used[0]
            pattern = next(iter(packs[total]))
            take = min(left, packs[total][pattern])
            if take == packs[total][pattern]:
                del packs[total][pattern]
                if not packs[total]:
                    used.pop(0)
            else:
                packs[total][pattern] -= take
            put(total + length, (*pattern, length), take)
            left -= take
        if left:
            put(length, (length,), left)
    return [(n, pattern) for total in used for pattern, n in packs[total].items()]


#: Slot tables larger than this are joined without a broadcast.
BROADCAST_SLOTS = 1_000_000


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset): rank r of the length stands at that offset of sequence first + r - first rank."""
    out, taken, sequence = [], defaultdict(int), 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, taken[length], taken[length] + n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stash(cut(docs, size, vocabulary), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    table = slots(place(histogram, size))
    blocks = max(16, sum(histogram.values()) // 500_000)
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    sums = numbered.groupBy("length", "block").agg(F.count("*").alias("n"))
    first = sums.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select("length", "block", F.coalesce("first", F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = numbered.withColumn("row", F.row_number().over(order)).join(first, ["length", "block"]).withColumn("rank", F.col("first") + F.col("row") - 1)
    where = spark.createDataFrame(table, "slot_length long, low long, high long, sequence long, offset long")
    where = F.broadcast(where) if len(table) <= BROADCAST_SLOTS else where
    found = ranked.join(where, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
