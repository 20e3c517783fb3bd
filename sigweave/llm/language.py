"""Language identification with language-bitmask n-gram filters.

Learning counts byte n-grams (of lower-cased letters, words joined by one space, spaces around the text) per
language; every n-gram that a language uses at least ``share`` times as often as any other language goes into
its Bloom filter. The filters are bit-sliced: one table whose cell holds a bit for each language, so that
ANDing an n-gram's cells gives all languages that contain it at once. A text's popcount per language,
corrected for the filter's false positives, decides; ties go to the language that sorts first, which is also
what texts get whose n-grams no language has (with score 0).

Spark sets the filters' bits; only the cells reach the driver, whose number is a parameter. All labelled rows
that are given are learned from, and of the n-grams only those are left out of a language's filter that another
language uses more than 1 / ``share`` times as often: the more there are, the more false positives there are to correct for.

Results for odd input: null texts and texts without letters are ``und`` with score 0, as is every
text when there was nothing to learn from; repeated rows are judged each by itself; rows without a
language are not learned from; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import stash
from sigweave.llm.text import ALNUM, LOWER, mix, slices

N = 4
SHARE = 0.25
CELLS = 1 << 22
PROBES = 2
_LETTER = ALNUM & ~np.isin(np.arange(256), np.arange(0x30, 0x3A))


def _gram_codes(part) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a slice and the document of each; digits and punctuation become a space, runs of which are one."""
    data = np.where(_LETTER[part.data], LOWER[part.data], 0x20).astype(np.uint8)
    starts = np.zeros(len(data) + 1, bool)
    starts[part.offsets] = True
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = ~((data[1:] == 0x20) & (data[:-1] == 0x20) & ~starts[1:-1])
    doc = np.repeat(np.arange(part.n, dtype=np.int32), np.diff(part.offsets))
    data, doc = data[keep].astype(np.uint32), doc[keep]
    # spaces around each text, so that a single letter makes an n-gram
    padded = np.full(len(data) + 3 * part.n, 0x20, np.uint32)
    padded[np.arange(len(data)) + 3 * doc + 2] = data
    data, doc = padded, np.repeat(np.arange(part.n, dtype=np.int32), np.bincount(doc, minlength=part.n) + 3)
    if len(data) < N:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    code = data[: len(data) - N + 1].copy()
    for k in range(1, N):
        code = (code << np.uint32(8)) | data[k : len(data) - N + 1 + k]
    same = doc[: len(doc) - N + 1] == doc[N - 1 :]
    return code[same], doc[: len(doc) - N + 1][same]


def _count(batches):
    """(gram, language number) counts of a task, merged as it goes."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(more: np.ndarray, n: np.ndarray) -> None:
        nonlocal keys, counts
        keys, inverse = np.unique(np.concatenate((keys, more)), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate((counts, n)), len(keys)).astype(np.int64)

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        lang = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        for part in slices(batch.column(0)):
            code, doc = _gram_codes(part)
            waiting.append(np.unique(code.astype(np.uint64) << np.uint64(32) | lang[part.first + doc], return_counts=True))
            if len(waiting) >= 32:
                add(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
                waiting = []
    if waiting:
        add(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
    for i in range(0, len(keys), 100_000):
        k = keys[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(32)).astype(np.int64)), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(counts[i : i + 100_000])], names=["gram", "lang", "n"])


def _cells(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x51ED270B))
    step = CELLS.bit_length() - 1
    return [((h >> np.uint64(step * k)) & np.uint64(CELLS - 1)).astype(np.int32) for k in range(PROBES)]


def _bits(batches):
    """(gram, lang) to (the table's number, cell, mask), merged within a batch."""
    for batch in batches:
        gram, lang = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        cell = np.concatenate(_cells(gram)).astype(np.int64)
        mask = np.tile(np.uint64(1) << (lang % 64).astype(np.uint64), PROBES).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(lang // 64, PROBES).astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(mask)], names=["part", "cell", "mask"])


class LanguageFilters:
    """tables: for each 64 languages one array of CELLS bit masks. false_positive: each language's rate."""

    def __init__(self, languages: list[str], part: np.ndarray, cell: np.ndarray, mask: np.ndarray):
        self.languages = languages
        self.tables = []
        for first in range(0, len(languages), 64):
            table = np.zeros(CELLS, np.uint8 if len(languages) - first <= 8 else np.uint64)
            here = part == first // 64
            table[cell[here]] = mask[here].view(np.uint64).astype(table.dtype)
            self.tables.append(table)
        fill = [float(((t >> t.dtype.type(k)) & t.dtype.type(1)).mean()) for first, t in zip(range(0, len(languages), 64), self.tables, strict=True) for k in range(min(64, len(languages) - first))]
        self.false_positive = np.array(fill) ** PROBES

    def popcounts(self, grams: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Hits of each document in each language's filter."""
        cells, out = _cells(grams), []
        edges = np.searchsorted(doc, np.arange(n_docs + 1))
        for i, table in enumerate(self.tables):
            mask = table[cells[0]]
            for at in cells[1:]:
                mask &= table[at]
            for k in range(min(64, len(self.languages) - 64 * i)):
                sums = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(k)) & mask.dtype.type(1), dtype=np.int64)))
                out.append(sums[edges[1:]] - sums[edges[:-1]])
        return np.array(out).T.reshape(n_docs, len(self.languages))


def learn_languages(labelled: DataFrame, share: float = SHARE) -> LanguageFilters:
    """labelled: columns text and lang. The languages (not the texts) are named on the driver."""
    spark = labelled.sparkSession
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    languages = [r[0] for r in labelled.select("lang").distinct().orderBy("lang").collect()]
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "number int, lang string"))
    counts = labelled.join(numbers, "lang").select("text", "number").mapInArrow(_count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = stash(counts, "grams")
    rates = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rates.join(best, "gram").where(F.col("rate") >= share * F.col("best")).select("gram", "lang")
    table = kept.mapInArrow(_bits, "part int, cell int, mask long").groupBy("part", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    return LanguageFilters(languages, *(table[c].to_numpy() for c in ("part", "cell", "mask")))


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def _predict(model: LanguageFilters, batches):
    names = np.array([*model.languages, "und"], dtype=object)
    for batch in batches:
        pred, score = [], []
        for part in slices(batch.column(1)):
            code, doc = _gram_codes(part)
            total = np.bincount(doc, minlength=part.n)
            best, value = np.full(part.n, len(model.languages)), np.zeros(part.n)
            if model.languages:
                hits = model.popcounts(code, doc, part.n)
                f = model.false_positive
                real = np.clip((hits - total[:, None] * f) / (1 - f), 0, None)
                letters = np.concatenate(([0], np.cumsum(_LETTER[part.data] & (part.data < 0x80))))
                certain = letters[part.offsets[1:]] > letters[part.offsets[:-1]]
                for i in np.flatnonzero(~certain):
                    certain[i] = _has_letter(part.bytes_of(int(i)))
                best = np.where(certain, real.argmax(axis=1), best)
                value = np.where(certain, np.clip(real.max(axis=1) / np.maximum(total, 1), 0, 1), 0.0)
            pred += names[best].tolist()
            score += value.tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred, score (the corrected share of the text's n-grams that the language contains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _predict(shared.value, batches), "doc_id long, lang_pred string, score double")
