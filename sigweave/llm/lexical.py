"""Ranked lexical search: an inverted index in shards, searched with Block-Max MaxScore.

A shard is a row: the ids and lengths of some thousand documents, and for each term its list of postings in
compressed blocks. Beside a block stand the best pairs (occurrences, document length) in it, of which no other
pair is better in both, so the highest score of a block is known for any statistics of the whole table
without unpacking it, and the index is built in one pass.

A search works on a shard in windows of documents. The lists of a query are ordered by their bounds; those of least
bound that together cannot reach the k-th best score so far are not essential: they alone bring no document in. The
essential lists give the candidates of a window; then the others are taken from the highest bound down, and a
candidate whose score so far, plus the maximum of the block that would hold it, plus the bounds of the lists
still to come, stays below the k-th best score is rejected before that block is unpacked. Every task keeps a heap for each
query over all its shards; the heaps of all tasks are merged by rank. Nothing is approximate: ties go by document id.

Scores are whole numbers. With N documents that have a term, L terms in all of them, n terms in a document, df documents
that hold a term and tf occurrences in this one: weight w = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + 90 n N div L, and
a document scores the sum of w (10^9 tf div (1000 tf + 8 m)) over the query's distinct terms.

Results for odd input: a null text has no term and is never found, a query without terms finds nothing; repeated rows are documents of their own, and
repeated queries are answered each; a null doc_id is found and ranked after equal scores of others; empty tables give no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.shared import stash
from sigweave.llm.text import ALNUM, signed, slices

K = 10
BLOCK = 128
#: A shard is closed at so many documents, postings or bytes of text.
SHARD_DOCS, SHARD_POSTINGS, SHARD_BYTES = 8192, 1 << 19, 32 << 20
#: Documents that a search takes on at once.
WINDOW_DOCS = 2048
#: Queries are answered in blocks of so many bytes; a block's terms are broadcast.
QUERY_BYTES = 16 << 20
#: Up to so many terms (16 bytes each) are broadcast to index only what queries ask for; with more, all terms are indexed.
MOST_TERMS = 1 << 21

_LIST = "struct<term:long,check:long,df:int,skip:binary,blocks:binary>"
_SHARD = f"doc_ids array<long>, lengths array<int>, n_docs long, n_terms long, lists array<{_LIST}>"


class Terms:
    """Terms to index: two hashes each, sorted by the first; a 20-bit table passes over most others."""

    def __init__(self, term: np.ndarray, check: np.ndarray):
        order = np.lexsort((check, term))
        self.term, self.check = term[order], check[order]
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.term >> np.uint64(44)).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that may be terms."""
        at = np.flatnonzero(self.coarse[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.term):
            return at[:0]
        place = np.minimum(np.searchsorted(self.term, hashes[at]), len(self.term) - 1)
        return at[self.term[place] == hashes[at]]


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """values[block, 128] in so many bits each: bytes[block, 16 * width]."""
    shifts = np.arange(width, dtype=np.uint32)
    return np.packbits(((values[:, :, None].astype(np.uint32) >> shifts) & 1).astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unbits(packed: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), BLOCK), np.int64)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return bits.astype(np.int32) @ (1 << np.arange(width, dtype=np.int64))


def pack_list(docs: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """A term's postings (documents ascending) as (skip, blocks).

    skip: 32-bit numbers: blocks, bits of a step, bits of a count, then for each block its first document, last
    document and postings and where its best pairs end, then the pairs' counts and lengths."""
    n = len(docs)
    count = -(-n // BLOCK)
    pad = count * BLOCK - n
    step = np.diff(docs, prepend=docs[:1])
    step[::BLOCK] = 0
    step, less = (np.pad(x, (0, pad)).reshape(count, BLOCK) for x in (step, tf - 1))
    widths = [int(x.max()).bit_length() for x in (step, less)]
    blocks = np.concatenate([_bits(x, w) for x, w in zip((step, less), widths, strict=True) if w] or [np.empty((count, 0), np.uint8)], axis=1)
    block = np.arange(n) // BLOCK
    order = np.lexsort((-tf, lengths, block))
    seen = block[order] * (int(tf.max()) + 1) + tf[order]
    best = np.concatenate(([True], seen[1:] > np.maximum.accumulate(seen)[:-1]))
    best = order[best]
    ends = np.cumsum(np.bincount(block[best], minlength=count))
    first = np.arange(count) * BLOCK
    last = np.minimum(first + BLOCK, n) - 1
    skip = np.concatenate(([count, *widths], docs[first], docs[last], last - first + 1, ends, tf[best], lengths[best])).astype("<i4")
    return skip.tobytes(), blocks.tobytes()


class Postings:
    """A list of a shard. ``bounds``: the highest impact of each block; blocks are unpacked when they are asked for, once."""

    def __init__(self, skip: bytes, blocks: bytes, lengths: np.ndarray, impact):
        head = np.frombuffer(skip, "<i4")
        n, self.widths = int(head[0]), head[1:3].tolist()
        self.first, self.last, self.counts, ends = head[3 : 3 + 4 * n].reshape(4, n)
        pairs = head[3 + 4 * n :].reshape(2, -1).astype(np.int64)
        self.bounds = np.maximum.reduceat(impact(pairs[0], pairs[1]), ends - np.diff(ends, prepend=0))
        self.bound = int(self.bounds.max())
        self.lengths, self.impact = lengths, impact
        self.packed = np.frombuffer(blocks, np.uint8).reshape(n, -1)
        self.unpacked = np.zeros(n, bool)
        self.docs = np.empty((n, BLOCK), np.int32)
        self.impacts = np.empty((n, BLOCK), np.int64)

    def unpack(self, blocks: np.ndarray) -> None:
        new = blocks[~self.unpacked[blocks]]
        if not len(new):
            return
        cut = BLOCK // 8 * self.widths[0]
        step, less = _unbits(self.packed[new, :cut], self.widths[0]), _unbits(self.packed[new, cut:], self.widths[1])
        docs = self.first[new][:, None] + np.cumsum(step, axis=1)
        there = np.arange(BLOCK) < self.counts[new][:, None]
        self.docs[new] = np.where(there, docs, 1 << 30)
        self.impacts[new] = np.where(there, self.impact(less + 1, self.lengths[np.where(there, docs, 0)].astype(np.int64)), 0)
        self.unpacked[new] = True

    def within(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents from low to high that hold the term, and their impacts."""
        blocks = np.arange(np.searchsorted(self.last, low), np.searchsorted(self.first, high))
        self.unpack(blocks)
        docs, impacts = self.docs[blocks].ravel(), self.impacts[blocks].ravel()
        here = (docs >= low) & (docs < high)
        return docs[here], impacts[here]

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that would hold each document; -1 if none does."""
        at = np.searchsorted(self.last, docs)
        inside = np.minimum(at, len(self.last) - 1)
        return np.where((at < len(self.last)) & (self.first[inside] <= docs), inside, -1)

    def impacts_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The impact on each document (ascending), of which blocks[i] would hold docs[i]; 0 where the term is not there."""
        each = np.unique(blocks)
        self.unpack(each)
        own, impacts = self.docs[each].ravel(), self.impacts[each].ravel()
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, impacts[at], 0)


class Heap:
    """The k best (score, doc_id) so far: higher scores first, then smaller ids; a missing id comes last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.named = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A score below this one cannot come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        if not len(scores):
            return
        if len(scores) > 4 * self.k:  # only what can be among the k best, ties included
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, named = scores[keep], ids[keep], named[keep]
        scores, ids, named = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.named, named))
        order = np.lexsort((ids, ~named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[order], ids[order], named[order]


def search_shard(lists: list[tuple[int, Postings]], n_docs: int, ids: np.ndarray, named: np.ndarray, heap: Heap, window: int = WINDOW_DOCS) -> None:
    """Brings a shard's documents into a query's heap. lists: weight and postings of each term of the query that the shard has."""
    lists = sorted(((w * p.bound, w, p) for w, p in lists if w > 0 and p.bound > 0), key=lambda x: x[0])
    reach = np.cumsum([0] + [x[0] for x in lists])  # reach[i]: what the first i lists can add
    for low in range(0, n_docs, window):
        least = heap.least
        essential = int(np.searchsorted(reach[1:], least))  # the lists before it cannot reach the heap together
        if essential == len(lists):
            return
        high = min(low + window, n_docs)
        score = np.zeros(high - low, np.int64)
        for _, w, p in lists[essential:]:
            docs, impacts = p.within(low, high)
            score[docs - low] += w * impacts
        found = np.flatnonzero(score)
        for i in range(essential - 1, -1, -1):
            _, w, p = lists[i]
            blocks = p.block_of(found + low)
            most = score[found] + np.where(blocks >= 0, w * p.bounds[blocks], 0) + reach[i]
            found, blocks = found[most >= least], blocks[most >= least]
            held = blocks >= 0
            if held.any():
                score[found[held]] += w * p.impacts_of(found[held] + low, blocks[held])
        found = found[score[found] >= least]
        heap.add(score[found], ids[low:high][found], named[low:high][found])


def _rows_of_shard(ids, named, lengths, parts) -> pa.RecordBatch:
    lengths = np.concatenate(lengths)
    term, check, doc, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, check, term))
    term, check, doc, tf = term[order], check[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (check[1:] != check[:-1])))) if len(term) else np.empty(0, np.int64)
    ends = np.append(new[1:], len(term)) if len(new) else new
    packed = [pack_list(doc[a:b], tf[a:b], lengths[doc[a:b]].astype(np.int64)) for a, b in zip(new, ends, strict=True)]
    fields = [pa.array(signed(term[new])), pa.array(signed(check[new])), pa.array((ends - new).astype(np.int32)), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())]
    lists = pa.StructArray.from_arrays(fields, names=["term", "check", "df", "skip", "blocks"])
    ids = pa.array(np.concatenate(ids), mask=~np.concatenate(named))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(ids), one(pa.array(lengths.astype(np.int32))), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), one(lists)], names=["doc_ids", "lengths", "n_docs", "n_terms", "lists"])


def _index(terms: Terms | None, shard_docs: int, batches):
    ids, named, lengths, parts = [], [], [], []
    docs = postings = size = 0
    for batch in batches:
        column = batch.column(0)
        for part in slices(batch.column(1)):
            w = part.words(ALNUM)
            hashes = w.hashes(lower=True)
            at = np.arange(len(hashes)) if terms is None else terms.among(hashes)
            some = copy.copy(w)
            some.starts, some.ends = w.starts[at], w.ends[at]
            checks, hashes = some.hashes(lower=True, kind=1), hashes[at]
            doc = np.repeat(np.arange(part.n), w.counts)[at]
            order = np.lexsort((checks, hashes, doc))
            hashes, checks, doc = hashes[order], checks[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])))) if len(doc) else np.empty(0, np.int64)
            tf = np.diff(np.append(new, len(doc)))
            parts.append((hashes[new], checks[new], doc[new] + docs, tf))
            own = column.slice(part.first, part.n)
            ids.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            named.append(own.is_valid().to_numpy(zero_copy_only=False))
            lengths.append(w.counts)
            docs, postings, size = docs + part.n, postings + len(new), size + len(part.data)
            if docs >= shard_docs or postings >= SHARD_POSTINGS or size >= SHARD_BYTES:
                yield _rows_of_shard(ids, named, lengths, parts)
                ids, named, lengths, parts = [], [], [], []
                docs = postings = size = 0
    if docs:
        yield _rows_of_shard(ids, named, lengths, parts)


def _terms(batches):
    """The distinct terms of each text, as two hashes."""
    for batch in batches:
        term, check = [], []
        for part in slices(batch.column(1)):
            w = part.words(ALNUM)
            pairs = np.stack((w.hashes(lower=True), w.hashes(lower=True, kind=1)), axis=1)
            for i in range(part.n):
                own = np.unique(pairs[w.at[i] : w.at[i + 1]], axis=0)
                term.append(signed(own[:, 0].copy()))
                check.append(signed(own[:, 1].copy()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(term, pa.list_(pa.int64())), pa.array(check, pa.list_(pa.int64()))], names=["item_id", "term", "check"])


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and the distinct terms of each item as arrays of two hashes."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_terms, f"item_id {kind}, term array<long>, check array<long>")


def build_index(docs: DataFrame, asked: DataFrame | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of docs (doc_id, text), a row per shard. asked: what query_terms() gives, to index only terms that queries have; all terms if not given."""
    terms = None
    if asked is not None:
        each = asked.select(F.explode(F.arrays_zip("term", "check")).alias("x")).select("x.term", "x.check").distinct().limit(MOST_TERMS + 1).toArrow()
        if each.num_rows <= MOST_TERMS:
            terms = docs.sparkSession.sparkContext.broadcast(Terms(*(each[c].to_numpy().view(np.uint64) for c in ("term", "check"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stash(rows.mapInArrow(lambda batches: _index(terms and terms.value, shard_docs, batches), _SHARD), "index")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search(queries: list[list[tuple[int, int, int]]], ids: pa.Array, n: int, total: int, k: int, window: int, batches):
    """queries: (term, check, weight) of each term. Returns the k best of each query over all shards of the task."""
    impact = lambda tf, length: 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * length * n // total))
    heaps = [Heap(k) for _ in queries]
    asked = {(t, c) for q in queries for t, c, _ in q}
    for batch in batches:
        where, rows, lengths = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_ids", "lists", "lengths"))
        for i in range(batch.num_rows):
            own, doc_ids, sizes = rows[i].values, where[i].values, lengths[i].values.to_numpy(zero_copy_only=False)
            if own is None or not len(own):
                continue
            pairs = zip(own.field("term").to_pylist(), own.field("check").to_pylist(), strict=True)
            skip, blocks = own.field("skip"), own.field("blocks")
            lists = {key: Postings(skip[j].as_py(), blocks[j].as_py(), sizes, impact) for j, key in enumerate(pairs) if key in asked}
            numbers, named = doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_valid().to_numpy(zero_copy_only=False)
            for q, heap in zip(queries, heaps, strict=True):
                mine = [(w, lists[t, c]) for t, c, w in q if (t, c) in lists]
                if mine:
                    search_shard(mine, len(sizes), numbers, named, heap, window)
    query = np.repeat(np.arange(len(queries), dtype=np.int32), [len(h.scores) for h in heaps])
    join = lambda name, kind: np.concatenate([getattr(h, name) for h in heaps] or [np.empty(0, kind)])
    yield pa.RecordBatch.from_arrays([pa.array(query), ids.take(pa.array(query)), pa.array(join("ids", np.int64), mask=~join("named", bool)), pa.array(join("scores", np.int64))], names=["query", "item_id", "doc_id", "score"])


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, asked: DataFrame, k: int = K, window: int = WINDOW_DOCS) -> DataFrame:
    """The k best documents of each query: item_id, rank (from 1), doc_id, score. asked: what query_terms() gives."""
    spark = index.sparkSession
    kind = asked.schema["item_id"].dataType.simpleString()
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    size = asked.agg(F.coalesce(F.sum(16 * F.size("term") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // QUERY_BYTES))
    df = index.select(F.explode("lists").alias("x")).groupBy("x.term", "x.check").agg(F.sum("x.df").alias("df"))
    found = []
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("item_id", "term"), F.lit(parts)) == part).toArrow()
        keys = spark.createDataFrame(pa.table({"term": pa.chunked_array([c.values for c in some["term"].chunks] or [[]], pa.int64()), "check": pa.chunked_array([c.values for c in some["check"].chunks] or [[]], pa.int64())}).group_by(["term", "check"]).aggregate([]))
        counts = {(r[0], r[1]): r[2] for r in df.join(F.broadcast(keys), ["term", "check"]).select("term", "check", "df").collect()}
        queries = [[(t, c, weight(n, counts[t, c])) for t, c in zip(*pair, strict=True) if (t, c) in counts] for pair in zip(some["term"].to_pylist(), some["check"].to_pylist(), strict=True)]
        shared = spark.sparkContext.broadcast((queries, some["item_id"].combine_chunks()))
        heaps = index.mapInArrow(lambda batches, shared=shared: _search(*shared.value, n, total, k, window, batches), f"query int, item_id {kind}, doc_id long, score long")
        best = _best(heaps, k)
        found.append(best if parts == 1 else stash(best, "found"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents for each item: an index of the items' terms over all docs is built and searched."""
    asked = stash(query_terms(items), "queries")
    return search(build_index(docs, asked), asked, k)
