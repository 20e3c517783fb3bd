"""Near-duplicate classes by SimHash: fingerprints within a few bits of each other, found by the generalised pigeonhole principle.

A fingerprint has 64 bits: a bit is set if more than half of a text's word shingles (repeats count) have it in
their 64-bit hash. Equal fingerprints are one node; two nodes link when at most DISTANCE bits differ.

The bits are dealt into partitions, correlated bits together. If the thresholds of the partitions, each plus one, add up to
DISTANCE + 1, then two fingerprints that link are within the threshold of one partition at least; a threshold of -1 leaves a partition out. So
every fingerprint lies in one bucket of each partition, and probes the buckets within its own thresholds, which a dynamic
programme gives it: it takes the thresholds with the fewest estimated candidates, counted from the frequent values of each partition and the mean of the rest. A
fingerprint whose bits are common in one partition is looked for in the others. The number of partitions follows the number of fingerprints.

What meets in a bucket is compared bit by bit, inside the task, and a spanning forest of the links comes out, not all links. A
bucket of more than ``bucket_limit`` fingerprints is not compared: each of its fingerprints is written at every point within two bits of it (of the bits
that differ in the bucket), and who is within one bit of a point links with all that are within two; a point has at most 2,081
fingerprints, so neither a task nor the number of rows grows with the square of a bucket.

Results for odd input: without words (null, empty, blank) the fingerprint is zero and links like any other; fewer words than a shingle are one
shingle, the whole sequence; repeated rows are one node; null doc_ids never name a component unless all its rows have none; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.components import components
from sigweave.llm.shared import stash
from sigweave.llm.text import LOWER, NOT_SPACE, signed, slices

N = 3
SEED = 42
DISTANCE = 3
BITS = 64
#: Buckets up to so many fingerprints are compared in one task (a few seconds).
BUCKET_LIMIT = 1 << 16
#: What a comparison costs, in rows that are shuffled.
COMPARE_COST = 0.02
#: A value of a partition counts as frequent from this share of all fingerprints on, so a partition has at most 256 of them.
FREQUENT = 1 / 256
#: Runs of up to so many fingerprints are compared all at once.
_SHORT = 8

# The primes of XXH64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in _PRIMES)
_LONG = 4096


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(lane: np.ndarray, block: np.ndarray) -> np.ndarray:
    return _rotated(lane + block * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start : start + size] for many spans at once; spans may overlap."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    s = np.uint64(seed)
    h = np.full(len(starts), s + _P5, np.uint64)
    with np.errstate(over="ignore"):
        at = np.flatnonzero((sizes >= 32) & (sizes <= _LONG))
        if len(at):
            lanes = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            own, done = np.arange(len(at)), 0
            while len(own):
                where = starts[at[own]] + done
                for k, lane in enumerate(lanes):
                    lane[own] = _round(lane[own], eight[where + 8 * k])
                done += 32
                own = own[sizes[at[own]] - done >= 32]
            x = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for lane in lanes:
                x = (x ^ _round(np.zeros(len(at), np.uint64), lane)) * _P1 + _P4
            h[at] = x
        h += sizes.astype(np.uint64)
        where, left = starts + sizes // 32 * 32, sizes % 32
        for k in range(3):
            at = np.flatnonzero(left >= 8 * (k + 1))
            h[at] = _rotated(h[at] ^ _round(np.zeros(len(at), np.uint64), eight[where[at] + 8 * k]), 27) * _P1 + _P4
        where, left = where + left // 8 * 8, left % 8
        at = np.flatnonzero(left >= 4)
        h[at] = _rotated(h[at] ^ (four[where[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        where, left = where + left // 4 * 4, left % 4
        for k in range(3):
            at = np.flatnonzero(left > k)
            h[at] = _rotated(h[at] ^ (padded[where[at] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), seed)
    return h


def shingle_hashes(part, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of a slice's documents, in order, and where each document's begin and end."""
    w = part.words(NOT_SPACE)
    sizes = w.ends - w.starts
    # the words one after the other, a space behind each
    text = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = LOWER[part.data[NOT_SPACE[part.data]]]
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    last = np.repeat(w.at[1:], w.counts)
    each = np.arange(len(sizes))
    few = np.repeat(w.counts < n, w.counts)
    first = np.repeat(w.at[:-1], w.counts)
    keep = np.flatnonzero(np.where(few, each == first, each + n <= last))
    end = np.where(few, last, each + n)[keep] - 1
    hashes = xxh64(text, begins[keep], begins[end] + sizes[end] - begins[keep])
    return hashes, np.searchsorted(keep, w.at)


def simhash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A fingerprint for each document: the bits that more than half of hashes[at[i] : at[i + 1]] have; zero without any."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    sizes = np.diff(at)[full]
    # eight counters in the bytes of a number; each counts to 255 at most
    steps = -(-sizes // 255)
    first = np.cumsum(steps) - steps
    chunks = np.repeat(at[:-1][full] - 255 * first, steps) + 255 * np.arange(int(steps.sum()))
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        counts = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, chunks).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        more = 2 * counts > sizes[:, None]
        for byte in range(8):
            out[full] |= more[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _prints(n: int, batches):
    for batch in batches:
        found = [simhash(*shingle_hashes(part, n)) for part in slices(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(np.concatenate(found)) if found else [], pa.int64())], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id and print (64 bits as a long) for each document row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _prints(n, batches), "doc_id long, print long")


def _together(batches):
    """How often two bits are set together: 64 * 64 sums of a task."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for k in range(0, len(bits), 1 << 16):
            total += bits[k : k + (1 << 16)].T @ bits[k : k + (1 << 16)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], names=["pair", "n"])


def correlated_groups(together: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """The bits in groups of almost equal size: each group begins with the bit that depends on the others most, and takes the bit that depends on the group most."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, out = list(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), groups)):
        own = [max(left, key=lambda i: (tied[i, left].sum(), -i))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda i: (tied[i, own].sum(), -i)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    """The values of a partition within so many bits of a value."""
    return sum(math.comb(width, k) for k in range(radius + 1))


def value_of(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition, put together."""
    out = np.zeros(len(prints), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def allocate(costs: np.ndarray, units: int) -> np.ndarray:
    """costs[q, p, u]: what it costs query q to have threshold u - 1 in partition p. Returns the thresholds of each query whose units add up to ``units`` at least cost."""
    n, parts, _ = costs.shape
    best = np.full((n, units + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((parts, n, units + 1), np.int8)
    for p in range(parts):
        new = np.full((n, units + 1), np.inf)
        for total in range(units + 1):
            options = np.stack([best[:, total - u] + costs[:, p, u] for u in range(total + 1)], axis=1)
            took[p, :, total] = options.argmin(axis=1)
            new[:, total] = options.min(axis=1)
        best = new
    out, left = np.empty((n, parts), np.int8), np.full(n, units)
    for p in reversed(range(parts)):
        out[:, p] = took[p, np.arange(n), left]
        left = left - out[:, p]
    return out - 1


def candidate_costs(values: list[np.ndarray], widths: list[int], frequent: list[tuple[np.ndarray, np.ndarray]], n: int, distance: int) -> np.ndarray:
    """What allocate() takes: probes, and estimated candidates times COMPARE_COST. frequent: values and their counts, by partition."""
    costs = np.zeros((len(values[0]), len(values), distance + 2))
    for p, (own, width, (often, counts)) in enumerate(zip(values, widths, frequent, strict=True)):
        near = np.bitwise_count(own[:, None] ^ often[None, :]) if len(often) else np.zeros((len(own), 0), np.uint8)
        rest = max(0, n - int(counts.sum()))
        for t in range(distance + 1):
            met = (near <= t) @ counts.astype(float) if len(often) else 0
            size = ball(width, t) if t <= width else 1 << width
            costs[:, p, t + 1] = (size - 1) + COMPARE_COST * (met + rest * min(1.0, size / 2.0**width))
    return costs


def partitions_for(n: int, distance: int) -> int:
    """How many partitions are cheapest if all bits are independent."""

    def cost(groups: int) -> float:
        widths = [len(x) for x in np.array_split(np.arange(BITS), groups)]
        values, none = [np.zeros(1, np.uint64)] * groups, [(np.empty(0, np.uint64), np.empty(0, np.int64))] * groups
        costs = candidate_costs(values, widths, none, n, distance)
        units = allocate(costs, distance + 1)[0] + 1
        return groups + sum(costs[0, p, u] for p, u in enumerate(units))

    return min(range(2, distance + 2), key=cost)


def _buckets(layout: list[list[int]], frequent: list, n: int, distance: int, batches):
    """Rows (bucket, print): the bucket of each partition, and the buckets that the thresholds of the print reach."""
    widths = [len(x) for x in layout]
    assert max(widths) <= 60
    flips = [[np.array([sum(1 << i for i in some) for some in itertools.combinations(range(w), k)], np.uint64) for k in range(min(w, distance) + 1)] for w in widths]
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(0, max(1, len(prints)), 4096):
            own = prints[k : k + 4096]
            values = [value_of(own, bits) for bits in layout]
            reach = allocate(candidate_costs(values, widths, frequent, n, distance), distance + 1) if len(own) else np.empty((0, len(layout)), np.int8)
            buckets, owners = [], []
            for p in range(len(layout)):
                for t in range(min(widths[p], distance) + 1):
                    some = np.flatnonzero(reach[:, p] >= t) if t else np.arange(len(own))
                    met = values[p][some][:, None] ^ flips[p][t][None, :]
                    buckets.append((met | np.uint64(p << 60)).ravel())
                    owners.append(np.repeat(own[some], met.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(x))) for x in (buckets, owners)], names=["bucket", "print"])


def _forest(own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links connect among some fingerprints."""
    left, out = own, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= distance
            if near.any():
                found = left[near]
                out += [(here, x) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def _links(distance: int, batches):
    """Rows sorted by bucket to links (a, b)."""
    held_bucket, held_print = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(bucket, prints):
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        sizes = np.diff(edges)
        a, b = [], []
        short = np.repeat(sizes <= _SHORT, sizes)
        for apart in range(1, min(_SHORT, len(prints))):
            same = np.flatnonzero(short[apart:] & (bucket[apart:] == bucket[:-apart]))
            same = same[np.bitwise_count(prints[same] ^ prints[same + apart]) <= distance]
            a.append(prints[same])
            b.append(prints[same + apart])
        for k in np.flatnonzero(sizes > _SHORT).tolist():
            found = _forest(prints[edges[k] : edges[k + 1]], distance)
            a.append(np.array([x for x, _ in found], np.uint64))
            b.append(np.array([x for _, x in found], np.uint64))
        a, b = (signed(np.concatenate(x)) if x else np.empty(0, np.int64) for x in (a, b))
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        bucket = np.concatenate((held_bucket, batch.column(0).to_numpy(zero_copy_only=False)))
        prints = np.concatenate((held_print, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        if not len(bucket):
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
        held_bucket, held_print = bucket[cut:], prints[cut:]
        if cut:
            yield links(bucket[:cut], prints[:cut])
    if len(held_bucket):
        yield links(held_bucket, held_print)


def _points(batches):
    """Rows (bucket, print, varying) to (bucket, point, far, print): all points within two of the varying bits."""
    for batch in batches:
        bucket, prints, varying = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        for i in range(len(bucket)):
            bits = [1 << k for k in range(BITS) if int(varying[i]) >> k & 1]
            flips = np.array([0, *bits, *(x | y for x, y in itertools.combinations(bits, 2))], np.uint64)
            far = np.array([0] + [1] * len(bits) + [2] * (len(flips) - 1 - len(bits)), np.int32)
            points = prints[i : i + 1].view(np.uint64) ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flips), bucket[i])), pa.array(signed(points)), pa.array(far), pa.array(np.full(len(flips), prints[i]))], names=["bucket", "point", "far", "print"])


def dense_links(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Links of distance 3 in large buckets (bucket, varying), through points between fingerprints: linear in their number."""
    points = rows.join(large, "bucket").select("bucket", "print", "varying").mapInArrow(_points, "bucket long, point long, far int, print long")
    # at most 2,081 fingerprints are within two bits of a point
    hub = F.min(F.struct("far", "print")).over(Window.partitionBy("bucket", "point"))
    met = points.withColumn("hub", hub).where((F.col("hub.far") <= 1) & (F.col("hub.print") != F.col("print")))
    return met.select(F.least("print", "hub.print").alias("a"), F.greatest("print", "hub.print").alias("b")).distinct()


def hamming_links(prints: DataFrame, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT, partitions: int | None = None) -> DataFrame:
    """Links (a, b) that connect what links of at most ``distance`` bits connect. prints: distinct values of a long column ``print``.

    Large buckets need a distance of 3."""
    together = prints.select("print").mapInArrow(_together, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 4,096 rows
    table = np.zeros(BITS * BITS)
    table[together["pair"].to_numpy()] = together["n"].to_numpy()
    n = prints.count()
    groups = partitions or partitions_for(n, distance)
    layout = correlated_groups(table.reshape(BITS, BITS), n, groups)
    # the frequent values of each partition: their number is bounded by FREQUENT
    part = lambda p: sum((F.shiftleft(F.shiftright("print", b).bitwiseAND(F.lit(1)).cast("long"), k) for k, b in enumerate(layout[p])), F.lit(0).cast("long"))
    counts = prints.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), part(p).alias("value")) for p in range(groups)])).alias("x")).groupBy("x.p", "x.value").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= max(_SHORT, math.ceil(n * FREQUENT))).collect()
    frequent = [(np.array([r["value"] for r in often if r["p"] == p], np.int64).view(np.uint64), np.array([r["n"] for r in often if r["p"] == p], np.int64)) for p in range(groups)]

    rows = stash(prints.select("print").mapInArrow(lambda batches: _buckets(layout, frequent, n, distance, batches), "bucket long, print long"), "buckets")
    large = stash(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_and("print").bitwiseXOR(F.bit_or("print")).alias("varying")).where(F.col("n") > bucket_limit).select("bucket", "varying"), "large")
    some = not large.isEmpty()
    if some and distance != DISTANCE:
        raise ValueError(f"buckets of more than {bucket_limit} fingerprints need a distance of {DISTANCE}")
    small = rows.join(large, "bucket", "left_anti") if some else rows
    found = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _links(distance, batches), "a long, b long")
    return found.unionByName(dense_links(rows, large)) if some else found


def simhash_classes(docs: DataFrame, n: int = N, distance: int = DISTANCE, bucket_limit: int = BUCKET_LIMIT, partitions: int | None = None) -> DataFrame:
    """One row per document row: doc_id, print, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = stash(fingerprints(docs, n), "prints")
    nodes = stash(prints.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "nodes")
    labels = components(hamming_links(nodes, distance, bucket_limit, partitions))
    named = nodes.join(labels.select(F.col("node").alias("print"), "component"), "print", "left").select("print", "doc_id", F.coalesce("component", "print").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
