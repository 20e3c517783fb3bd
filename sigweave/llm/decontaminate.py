"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

The test items are normalised (A-Z lower-cased, words of digits, letters and non-ASCII characters)
and cut into windows of n words. Their hashes go to every task as a sorted array; training documents
are scanned window by window, each hash hit is verified against the item's words, and what is hit
comes back as word ranges, so a caller can drop documents or cut spans.

The set is broadcast only in blocks of at most ``block_bytes`` of item text: a test collection that is
larger is worked off block by block over all documents, and the hits are merged.

Results for odd input: a null or empty text has no words and no hits; an item without words never
occurs; an item of fewer than n words is a single window; the words of an item without item_id are hit
like others, but it is not named; repeated rows are judged each by itself;
an empty benchmark table hits nothing. Other columns of either table are not touched.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import stash
from sigweave.llm.text import ALNUM, LOWER, flags_within, grams, slices

BLOCK_BYTES = 32 << 20
_HITS = "doc_id long, text_key long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class WindowSet:
    """Windows of test items: for each length the sorted hashes with the word that each begins at, a 20-bit table to pass over misses, and the items' bytes to verify with.

    It takes some 24 bytes a word beside the texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.ids = [k for k, _ in items]
        self.sorted, self.begins, self.coarse = {}, {}, {}
        if not items:
            return
        (part,) = slices(pa.array([t for _, t in items], pa.large_string()), 1 << 62)
        w = part.words(ALNUM)
        hashes = w.hashes(lower=True)
        self.data, self.starts, self.ends, self.at = LOWER[part.data], w.starts, w.ends, w.at
        sizes = np.minimum(w.counts, n)
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = grams(hashes, size)
            item = np.repeat(np.arange(len(items)), w.counts)[: len(own)]
            begins = np.flatnonzero((sizes[item] == size) & (np.arange(len(own)) + size <= w.at[1:][item]))
            order = np.argsort(own[begins], kind="stable")
            self.begins[size], self.sorted[size] = begins[order], own[begins][order]
            self.coarse[size] = np.zeros(1 << 20, bool)
            self.coarse[size][(self.sorted[size] >> np.uint64(44)).astype(np.int64)] = True

    def items(self, size: int, hash_: np.uint64, words: list[bytes]) -> set[str | None] | None:
        """The ids of the items that have a window of these words; None if none has."""
        table, found = self.sorted[size], set()
        low, high = np.searchsorted(table, hash_), np.searchsorted(table, hash_, side="right")
        for begin in self.begins[size][low:high].tolist():
            if all(self.data[self.starts[begin + k] : self.ends[begin + k]].tobytes() == word for k, word in enumerate(words)):
                found.add(self.ids[int(np.searchsorted(self.at, begin, side="right")) - 1])
        return found or None


def _scan(windows: WindowSet, batches):
    for batch in batches:
        out: list[tuple] = []
        ids, keys = batch.column(0), batch.column(1)
        for part in slices(batch.column(2)):
            w = part.words(ALNUM)
            hashes = w.hashes(lower=True)
            ends = np.repeat(w.at[1:], w.counts)
            found: dict[int, tuple[list, list, set]] = {}
            for size, table in windows.sorted.items():
                g = grams(hashes, size)
                if not len(g):
                    continue
                at = np.flatnonzero(windows.coarse[size][(g >> np.uint64(44)).astype(np.int64)])
                at = at[at + size <= ends[at]]
                place = np.minimum(np.searchsorted(table, g[at]), len(table) - 1)
                for j in at[table[place] == g[at]].tolist():
                    items = windows.items(size, g[j], [w.chunk(j + k).lower() for k in range(size)])
                    if items:
                        doc = int(np.searchsorted(w.at, j, side="right")) - 1
                        starts, sizes, all_items = found.setdefault(doc, ([], [], set()))
                        starts.append(j - int(w.at[doc]))
                        sizes.append(size)
                        all_items |= items
            for i in range(part.n):
                n_words, spans, n_hit, items = int(w.counts[i]), [], 0, []
                if i in found:
                    starts, sizes, all_items = found[i]
                    hit = flags_within(np.array(starts), np.array(sizes), n_words)
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    n_hit, items = int(hit.sum()), sorted(x for x in all_items if x is not None)
                out.append((n_words, n_hit, items, spans))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [ids, keys, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "text_key", "n_words", "n_hit", "items", "spans"],
        )


def _block(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(WindowSet([(r[0], r[1]) for r in items.collect()], n))
    return docs.mapInArrow(lambda batches: _scan(shared.value, batches), _HITS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, text_key (a hash of the text), n_words, n_hit, items (ids as sorted strings), spans (hit word ranges)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = math.ceil(size / block_bytes)
    if blocks <= 1:
        return _block(docs, items, n)
    parts = [stash(_block(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), n), "contamination") for b in range(blocks)]
    merged = reduce(DataFrame.unionByName, [p.withColumn("block", F.lit(b)) for b, p in enumerate(parts)])
    # repeated rows of a document count once for each block
    merged = merged.groupBy("doc_id", "text_key", "block").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_words", "items", "spans")])
    ranges = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = merged.groupBy("doc_id", "text_key").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), ranges.alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["hit"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("hit")))["hit"]
    return merged.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def is_contaminated(n_hit, n_words):
    """At least a twentieth of the words lies in occurrences of test windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
