"""Incremental substring deduplication with a log-structured fingerprint index.

A window is a run of ``window`` words. Its fingerprint is the hash of its smallest ``ANCHOR``-word
gram (the leftmost of equals), so equal windows have equal fingerprints, and neighbouring windows
mostly share one: a text of w words has about w/14 fingerprints to store.

``FingerprintIndex`` keeps the fingerprints seen so far in sorted immutable runs (bucketed, sorted
tables). Each new batch is merge-joined with every run; fingerprints met again, or twice in the
batch, are suspects. The batch then becomes a run of its own, and when a level holds ``fanout`` runs
they are compacted into one run of the next level. An index that is kept from call to call also has
runs of (hash, fingerprint) of all whole windows, so that a new table is held against all earlier ones
without reading their texts again: a window was there before if both 64-bit numbers were. One call's own
index, which is dropped at its end, needs none.

Suspects are verified: the documents that hold them are read again, the 64-bit hashes of their whole
windows are compared among the holders of a fingerprint, and a window counts as repeated only if
another one is equal in both numbers. Holders of a frequent fingerprint are dealt over several tasks, which
exchange the hashes that only one holder in the task has; the most frequent fingerprints of all (HOT at
most) are broadcast, so that no join deals their rows to one task. With a kept index, windows that only one
holder has are looked up in its runs as well.

Results for odd input: null texts and texts under ``window`` words lose nothing; every occurrence of a
repeated window is cut, the first as well, but texts of earlier calls stay as they were returned;
identical rows cut each other; an empty table gives an empty result; other columns are carried along
by the pipeline stage, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm.shared import bloom_filter, passing, split, stash
from sigweave.llm.text import NOT_SPACE, flags_within, grams, signed, slices

WINDOW, ANCHOR = 35, 8
BATCHES, FANOUT = 4, 2
_GROUP = 1000
#: So many fingerprints are joined by a broadcast, however large the table is.
HOT = 1000
#: A fingerprint stands for at most so many neighbouring windows: they are bits of a long.
_MOST = 62


def anchor_words(window: int) -> int:
    return min(window, max(ANCHOR, window + 1 - _MOST))


class Anchors:
    """For each window of a slice's documents (``first`` its first word) the word at which its smallest gram begins (``at``); windows never leave a document."""

    def __init__(self, part, window: int):
        self.words = w = part.words(NOT_SPACE)
        self.hashes = w.hashes(lower=False)
        ends = np.repeat(w.at[1:], w.counts)
        anchor = anchor_words(window)
        self.grams = grams(self.hashes, anchor)
        begin = np.arange(max(0, len(self.hashes) - window + 1))
        self.first = begin[begin + window <= ends[: len(begin)]]
        n = max(1, int(len(self.grams)).bit_length())
        # hash above, place below: the smallest value is the smallest hash, leftmost of equals
        low = (self.grams >> np.uint64(n) << np.uint64(n)) | np.arange(len(self.grams), dtype=np.uint64)
        width, span = 1, window - anchor + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        rest = span - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest and len(low) > rest else low
        self.at = (low[self.first] & np.uint64((1 << n) - 1)).astype(np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.at, at, side="right") - 1


def _fingerprints(window: int, batches):
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for part in slices(batch.column(2)):
            a = Anchors(part, window)
            at = np.unique(a.at)
            doc = a.document(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(a.grams[at])), pa.array(ids[part.first + doc], pa.int64(), from_pandas=True), pa.array(keys[part.first + doc], pa.int64()), pa.array((at - a.words.at[doc]).astype(np.int32))],
                names=["fp", "doc_id", "text_key", "at"],
            )


def _window_hashes(window: int, batches):
    for batch in batches:
        for part in slices(batch.column(0)):
            a = Anchors(part, window)
            whole, at = np.unique(signed(grams(a.hashes, window, 1)[a.first]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(signed(a.grams[a.at[at]]))], names=["fp", "anchor"])


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(fp, doc_id, text_key, at): each distinct anchor of each document row."""
    return docs.select("doc_id", "text_key", "text").mapInArrow(lambda batches: _fingerprints(window, batches), "fp long, doc_id long, text_key long, at int")


class FingerprintIndex:
    """Sorted immutable runs of (keys, n), by level. Tables are named after the index: the same name opens the runs that the catalog has of it.

    The first key is ``fp``. ``windows`` is the index of whole windows that belongs to it."""

    def __init__(self, spark: SparkSession, name: str | None = None, fanout: int = FANOUT, buckets: int | None = None, keys: tuple[str, ...] = ("fp",)):
        self.spark, self.fanout, self.keys = spark, fanout, list(keys)
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0
        for level, made in sorted(tuple(map(int, m.groups())) for m in self._tables(r"_(\d+)_(\d+)")):
            self.levels += [[] for _ in range(level + 1 - len(self.levels))]
            self.levels[level].append(f"{self.name}_{level}_{made}")
            self.made = max(self.made, made)

    def _tables(self, rest: str) -> list[re.Match]:
        found = (re.fullmatch(re.escape(self.name.lower()) + rest, t.name.lower()) for t in self.spark.catalog.listTables())
        return [m for m in found if m]

    def windows(self, window: int) -> FingerprintIndex:
        """The index of the hashes of whole windows; an index serves one window size."""
        sizes = {int(m[1]) for m in self._tables(r"_windows(\d+)_\d+_\d+")} - {window}
        if sizes:
            raise ValueError(f"index {self.name} was made with windows of {sizes.pop()} words")
        return FingerprintIndex(self.spark, f"{self.name}_windows{window}", self.fanout, self.buckets, ("fp", "anchor"))

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        table = f"{self.name}_{level}_{self.made}"
        rows.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (the keys; one row for each occurrence). Returns (keys, n): those of the batch that are there twice or were there before, and how often they are there."""
        new = stash(batch.groupBy(*self.keys).agg(F.count("*").alias("n")), "batch")
        met = [new.where("n > 1").select(*self.keys, "n"), *self.known(new)]
        found = stash(reduce(DataFrame.unionByName, met).groupBy(*self.keys).agg(F.max("n").alias("n")), "met")
        self._write(new, 0)
        self._compact()
        return found

    def known(self, batch: DataFrame) -> list[DataFrame]:
        """The rows of the batch (one for each key) that a run has, for each run."""
        return [batch.join(self.spark.table(run).select(*self.keys), self.keys, "left_semi").select(batch.columns) for run in self.runs()]

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                merged = reduce(DataFrame.unionByName, [self.spark.table(run) for run in runs]).groupBy(*self.keys).agg(F.sum("n").alias("n"))
                self._write(merged, level + 1)
                self.levels[level] = []
                for run in runs:
                    self.spark.sql(f"DROP TABLE {run}")
            level += 1

    def drop(self) -> None:
        for run in self.runs() + [m[0] for m in self._tables(r"_windows\d+_\d+_\d+")]:
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []


def _windows(window: int, batches):
    """Documents with their suspect anchors to one row for each: the anchor, and the hashes of all windows that it stands for."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
        rows: list[list] = [[], [], [], [], []]
        for part in slices(batch.column(2)):
            a = Anchors(part, window)
            if not len(a.first):
                continue
            whole = signed(grams(a.hashes, window, 1)[a.first])
            edges = np.flatnonzero(np.concatenate(([True], np.diff(a.at) != 0)))
            ends = np.append(edges[1:], len(a.at))
            anchor = a.at[edges]
            doc = a.document(anchor)
            for i in np.unique(doc):
                marks = np.zeros(a.words.counts[i], bool)
                marks[columns[2][part.first + i]] = True
                own = np.flatnonzero(doc == i) if part.n > 1 else np.arange(len(doc))
                for r in own[marks[anchor[own] - a.words.at[i]]]:
                    rows[0].append(int(signed(a.grams[anchor[r] : anchor[r] + 1])[0]))
                    rows[1].append(columns[0][part.first + i])
                    rows[2].append(columns[1][part.first + i])
                    rows[3].append(int(a.first[edges[r]] - a.words.at[i]))
                    rows[4].append(whole[edges[r] : ends[r]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.list_(pa.int64()))],
            names=["fp", "doc_id", "text_key", "first", "windows"],
        )


def _repeats(every_group: bool, batches):
    """Rows sorted by (fp, salt): those of one group together. Returns (kind 0) for each row its repeated windows as a bit mask; of dealt
    groups, or of every group, (kind 1) also each distinct window hash, with its holder if there is just one here."""

    def judge(group: list[tuple]):
        n = np.array([len(x[4]) for x in group])
        every = np.concatenate([x[4] for x in group])
        keys, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        at = 0
        for x, size in zip(group, n, strict=True):
            mask = sum(1 << int(k) for k in np.flatnonzero(twice[at : at + size]))
            if mask:
                yield (0, x[1], x[2], x[3], mask, None, None, None)
            at += size
        if every_group or group[0][6] > 1:
            owner = np.repeat(np.arange(len(group)), n)
            offset = np.concatenate([np.arange(k) for k in n])
            firsts = np.full(len(keys), -1)
            firsts[inverse[::-1]] = np.arange(len(every))[::-1]
            for k, i in enumerate(firsts):
                x = group[owner[i]]
                yield (1, x[1], x[2], x[3], 1 << int(offset[i]) if counts[k] == 1 else None, int(keys[k]), x[0], x[5])

    def out(found: list[tuple]):
        columns = list(zip(*found, strict=True)) or [[]] * 8
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "doc_id", "text_key", "first", "mask", "fp", "anchor", "salt"])

    group: list[tuple] = []
    found: list[tuple] = []
    for batch in batches:
        lists = batch.column(4)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
        for k, (fp, doc, key, first, salt, parts) in enumerate(zip(*columns, strict=True)):
            if group and (group[0][0], group[0][5]) != (fp, salt):
                found += judge(group)
                group = []
            group.append((fp, doc, key, first, values[ends[k] : ends[k + 1]].copy(), salt, parts))
        if len(found) > 20_000:
            yield out(found)
            found = []
    if group:
        found += judge(group)
    yield out(found)


def _cut(window: int, batches):
    """Rows (row, text, starts) to (row, n_words, n_removed, kept_sha256, kept_text)."""
    for batch in batches:
        starts, n_words, n_removed, digest, text = batch.column(2).to_pylist(), [], [], [], []
        for part in slices(batch.column(1)):
            for i in range(part.n):
                words, removed = part.bytes_of(i).split(), 0
                n_words.append(len(words))
                own = starts[part.first + i]
                if own:
                    gone = flags_within(np.array(own), window, len(words))
                    words, removed = [x for x, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())
                kept = b" ".join(words)
                n_removed.append(removed)
                digest.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode() if removed else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string()), batch.column(1)], names=["row", "n_words", "n_removed", "kept_sha256", "kept_text", "text"])


def _untouched(table: np.ndarray, batches):
    """Rows (row, text, text_key) that are not in the filter, as input of _cut."""
    for batch in passing(table, "text_key", False, batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(batch.num_rows, pa.list_(pa.int32()))], names=["row", "text", "starts"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, text_key, starts): for each document row that holds any, the first words of its repeated windows. docs: doc_id, text_key, text.

    With an index, windows that stood in the docs of an earlier call with it are repeated too, and the docs are added to it."""
    spark = docs.sparkSession
    own = index is None
    index = index or FingerprintIndex(spark)
    past = None if own else index.windows(window)
    anchors = fingerprints(docs, window).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)).cast("int"))
    anchors = stash(anchors, "anchors", ["batch"])
    met = [index.append(anchors.where(F.col("batch") == b).select("fp")) for b in range(batches)]
    if own:
        index.drop()
    suspects = stash(reduce(DataFrame.unionByName, met).groupBy("fp").agg(F.sum("n").alias("n")), "suspects")
    hot = F.broadcast(stash(suspects.orderBy(F.desc("n"), "fp").limit(HOT).select("fp"), "hot"))
    anchors = anchors.select("fp", "doc_id", "text_key", "at")
    held = anchors.join(hot, "fp", "left_anti").join(suspects.select("fp"), "fp", "left_semi").unionByName(anchors.join(hot, "fp", "left_semi"))
    held = stash(held, "held")
    # identical rows hold the same anchors; each of them is joined with the one list
    lists = stash(held.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("anchors")), "lists")
    near, _ = split(docs.select("doc_id", "text_key", "text"), "text_key", bloom_filter(lists, "text_key"))
    same = near["doc_id"].eqNullSafe(lists["doc_id"]) & (near["text_key"] == lists["text_key"])
    rows = near.join(lists, same).select(near["doc_id"], near["text_key"], "text", "anchors").mapInArrow(lambda b: _windows(window, b), "fp long, doc_id long, text_key long, first int, windows array<long>")
    # groups over _GROUP are dealt; at most HOT of them are looked up in a broadcast, and no other one holds more than one row in HOT
    sizes = stash(held.groupBy("fp").agg(F.ceil(F.count("*") / _GROUP).cast("int").alias("parts")).where("parts > 1"), "sizes")
    largest = F.broadcast(stash(sizes.orderBy(F.desc("parts"), "fp").limit(HOT).select("fp", F.col("parts").alias("most")), "largest"))
    rows = rows.join(largest, "fp", "left")
    if sizes.count() > HOT:
        rows = stash(rows, "rows")
        rest = rows.where("most is null").join(sizes, "fp", "left").withColumn("most", F.col("parts")).drop("parts")
        rows = rows.where("most is not null").unionByName(rest)
    rows = rows.withColumn("parts", F.coalesce("most", F.lit(1)))
    rows = rows.select("fp", "doc_id", "text_key", "first", "windows", F.pmod(F.xxhash64("doc_id", "text_key", "first"), F.col("parts")).cast("int").alias("salt"), "parts")
    judged = rows.repartition("fp", "salt").sortWithinPartitions("fp", "salt").mapInArrow(lambda b: _repeats(not own, b), "kind int, doc_id long, text_key long, first int, mask long, fp long, anchor long, salt int")
    judged = stash(judged, "judged")
    apart, both = judged.where("kind = 1"), ["fp", "anchor"]
    again = apart.groupBy(*both).agg(F.count("*").alias("parts")).where("parts > 1").select(*both)
    if past is not None:
        single = stash(apart.where("mask is not null").select(*both).distinct(), "single")
        again = stash(reduce(DataFrame.unionByName, [again, *past.known(single)]).distinct(), "again")
        past.append(docs.select("text").mapInArrow(lambda b: _window_hashes(window, b), "fp long, anchor long"))
    more = apart.where("mask is not null").join(again, both, "left_semi")
    found = judged.where("kind = 0").select("doc_id", "text_key", "first", "mask").unionByName(more.select("doc_id", "text_key", "first", "mask"))
    starts = F.expr(f"transform(filter(sequence(0, {window - anchor_words(window)}), k -> (shiftright(mask, k) & 1) = 1), k -> first + k)")
    return found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list(starts)).alias("starts"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """One row per document row: row (a struct of its columns but the text), n_words, n_removed, kept_sha256, kept_text (null where nothing was cut), text.

    index: kept from call to call; each call adds its docs and is held against those of all earlier calls."""
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    starts = stash(repeated_windows(docs, window, batches, index), "starts")
    bloom = bloom_filter(starts, "text_key")
    maybe, _ = split(docs, "text_key", bloom)
    same = maybe["doc_id"].eqNullSafe(starts["doc_id"]) & (maybe["text_key"] == starts["text_key"])
    touched = maybe.join(starts, same, "left").select("row", "text", "starts")
    schema = T.StructType([docs.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string, text string")])
    # one worker filters and cuts: two in a row would each hold texts
    clear = docs.select("row", "text", "text_key").mapInArrow(lambda b: _cut(window, _untouched(bloom.value, b)), schema)
    return touched.mapInArrow(lambda b: _cut(window, b), schema).unionByName(clear)
