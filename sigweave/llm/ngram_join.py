"""Exact Jaccard self-join on word n-grams: a size-aware heavy-light join.

Texts with the same set of n-grams are one class; classes are joined. Under one order of all n-grams
(random, but frequent ones last) the k-th n-gram that two linking sets share is among the first
size - least overlap + k n-grams of either, where the overlap is the least one of two sets of their sizes. So

* light sets, up to a boundary size, are enumerated: every 2-subset of that prefix is a signature, and
  two light sets that link have one in common;
* for heavy sets the inverted lists of the prefix's n-grams are scanned;
* the boundary is where the sum of both costs, taken from the histogram of set sizes, is least.

Candidates first have to pass a bound: sets whose parity bitmaps (each n-gram flips one bit, of twice as many as
there are n-grams at least) differ in d bits have d n-grams at least that only one of them has. What is left is verified on whole texts: links are decided on all 64-bit hashes of both texts' n-grams, and
classes whose names collide (seen by a second hash) are named anew. Large groups of near copies never become
all their pairs: a first round links every set to one or two leaders of the lists that it is in, and the
second round looks only at sets of different components.
There an entry meets only partners of sizes for which its place in the set can be the first shared one: in a
group of near copies that differ too much to link, what they have in common stands behind what each has of
its own, so such lists meet nobody. Lists of signatures are hashed to buckets of bounded size; those of
frequent n-grams, the only long ones, are dealt as rows.

Results for odd input: texts without words (null, empty, blank) have the empty set and link with
nothing; fewer than n words are one n-gram, the whole sequence; repeated rows are one class; null doc_ids
are joined like others and are never a component's name unless all its rows have none; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.components import components
from sigweave.llm.quality import bucket
from sigweave.llm.shared import bloom_filter, may_contain, split, stash
from sigweave.llm.text import NOT_SPACE, grams, join, mix, signed, slices

N = 5
#: Two sets link when PER * intersection >= LEAST * union.
LEAST, PER = 75, 100
#: N-grams that are kept of a heavy set beyond those among which the first shared one is; leaders are judged by them.
K = 2
#: The least boundary: sets in inverted lists overlap in K n-grams at least.
LEAST_LIGHT = 4
#: An n-gram in so many texts counts as frequent; at most MAX_FREQUENT of them (12 MB) are broadcast. This orders n-grams; it leaves none out.
FREQUENT, MAX_FREQUENT = 8, 1 << 20
#: Cost of an entry of an inverted list (it is written, read and counted) in signatures.
LIST_COST = 2
BUCKET_ENTRIES = 150_000
LEADERS = 2
#: The smallest parity bitmap.
LEAST_BITS = 256
_GROUP = 500

_ENTRY = [("sig", "<u8"), ("set", "<i8"), ("size", "<i4"), ("pos", "<i4")]


def text_sets(part, n: int = N):
    """For each document of a slice, its sorted distinct n-gram hashes (A-Z lower-cased)."""
    w = part.words(NOT_SPACE)
    hashes = w.hashes(lower=True)
    all_grams = grams(hashes, n)
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    short = np.zeros(part.n, np.uint64)
    short[few] = hashes[w.at[few]]
    for k in range(1, n - 1):
        few = few[w.counts[few] > k]
        short[few] = join(short[few], hashes[w.at[few] + k])
    for i in range(part.n):
        if w.counts[i] == 0:
            yield np.empty(0, np.uint64)
        elif w.counts[i] < n:
            yield short[i : i + 1]
        else:
            yield np.unique(all_grams[w.at[i] : w.at[i + 1] - n + 1])


def set_id(own: np.ndarray, seed: int = 0) -> int:
    """A 64-bit name of a set."""
    total, folded = own.sum(dtype=np.uint64), np.bitwise_xor.reduce(own) if len(own) else 0
    first, last = np.array([total], np.uint64), np.array([folded], np.uint64)
    return int(signed(join(mix(first + np.uint64(seed)), last + np.uint64(len(own)), seed % 2))[0])


def parity(own: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as longs: bit k tells whether an odd number of its n-grams fall on k. The bits are a power of two, from two to four for each n-gram."""
    bits = max(LEAST_BITS, 1 << max(0, 2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").view("<i8")


def _sets(n: int, seed: int, batches):
    """A row for each document, and rows (token, freq) for n-grams that stand out among some of the task's documents."""
    waiting, size = [], 0
    columns = ["doc_id", "text_key", "set_id", "again", "n", "token", "freq", "bits"]

    def frequent():
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keep = counts >= 2
        m = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 5 + [pa.array(signed(keys[keep])), pa.array(counts[keep]), pa.nulls(m, pa.list_(pa.int64()))], names=columns)

    for batch in batches:
        names, checks, sizes, bits = [], [], [], []
        for part in slices(batch.column(2)):
            for own in text_sets(part, n):
                names.append(set_id(own, seed))
                checks.append(set_id(own, seed + 1))
                sizes.append(len(own))
                bits.append(parity(own))
                waiting.append(own)
                size += len(own)
            if size > 500_000:
                yield frequent()
                waiting, size = [], 0
        m = len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (names, checks, sizes)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=columns)
    yield frequent()


def least_overlap(size: int) -> int:
    """The least overlap of a set of this size with any set that it links with."""
    return -(-LEAST * size // PER)


def prefix_length(size: int, k: int) -> int:
    return min(size, size - least_overlap(size) + k)


def boundary(histogram: dict[int, int]) -> int:
    """The largest light size: where enumerating all light sets and scanning lists for the others costs least. histogram: sets by size, all over 64 under 65."""

    def cost(x: int) -> int:
        light = sum(c * math.comb(prefix_length(s, 2), 2) for s, c in histogram.items() if s <= x)
        return light + sum(LIST_COST * c * prefix_length(s, K) for s, c in histogram.items() if PER * s >= LEAST * (x + 1))

    return min(range(LEAST_LIGHT, 65), key=cost)


def _order(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The set in the common order, and which are frequent. frequent: hashes in order, and how frequent each is; the most frequent come last."""
    tokens, freq = frequent
    rank = np.zeros(len(own), np.int32)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        rank = np.where(tokens[at] == own, freq[at], 0)
    order = np.argsort(rank, kind="stable")
    return own[order], rank[order] > 0


def _signatures(n: int, seed: int, light: int, buckets: int, frequent: tuple[np.ndarray, np.ndarray], packed: bool, batches):
    """Entries (signature, set, size, place of its last n-gram in the set): packed by bucket, or (not packed) as rows those with only frequent n-grams in the signature. A set is signed once a task."""
    done: set[int] = set()
    signs: list[np.ndarray] = []
    owners: list[tuple[int, int, int]] = []
    rows: list[tuple[np.ndarray, int, int]] = []
    count = 0

    def flush():
        if packed:
            yield _packed_entries(signs, owners, buckets)
        else:
            sig = signed(np.concatenate([x[0] for x in rows])) if rows else np.empty(0, np.int64)
            reps = [len(x[0]) for x in rows]
            pos = np.concatenate([x[3] for x in rows]) if rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(np.array([x[1] for x in rows], np.int64), reps)), pa.array(np.repeat(np.array([x[2] for x in rows], np.int32), reps)), pa.array(pos, pa.int32())], names=["sig", "set_id", "size", "pos"])

    def add(sig: np.ndarray, pos: np.ndarray, often: np.ndarray, name: int, size: int, kind: int) -> None:
        nonlocal count
        sig = (mix(sig) & ~np.uint64(1)) | np.uint64(kind)
        mine = ~often if packed else often
        sig, pos = sig[mine], pos[mine]
        if packed:
            signs.append(sig)
            owners.append((name, size, len(sig), pos))
        else:
            rows.append((sig, name, size, pos))
        count += len(sig)

    for batch in batches:
        for part in slices(batch.column(0)):
            for own in text_sets(part, n):
                size, name = len(own), set_id(own, seed)
                if size < 2 or name in done:  # a single n-gram links only with itself
                    continue
                done.add(name)
                own, often = _order(own, frequent)
                if size <= light:
                    p = prefix_length(size, 2)
                    i, j = np.triu_indices(p, 1)
                    add(join(own[i], own[j]), j.astype(np.int32), often[i] & often[j], name, size, 0)
                if PER * size >= LEAST * (light + 1):
                    p = prefix_length(size, K)
                    add(own[:p], np.arange(p, dtype=np.int32), often[:p], name, size, 1)
            if count > 300_000:
                yield from flush()
                signs, owners, rows, count = [], [], [], 0
    yield from flush()


def _packed_entries(signs: list, owners: list, buckets: int) -> pa.RecordBatch:
    sig = np.concatenate(signs) if signs else np.empty(0, np.uint64)
    reps = [x[2] for x in owners]
    entry = np.empty(len(sig), _ENTRY)
    entry["sig"] = sig
    entry["set"] = np.repeat(np.array([x[0] for x in owners], np.int64), reps)
    entry["size"] = np.repeat(np.array([x[1] for x in owners], np.int32), reps)
    entry["pos"] = np.concatenate([x[3] for x in owners]) if owners else 0
    bucket = (sig >> np.uint64(8)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    entry, bucket = entry[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([entry[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "entries"])


def _shared_entries(table: pa.Table) -> pa.Table:
    """The entries of one bucket whose signature two sets or more have."""
    entry = np.frombuffer(b"".join(table["entries"].to_pylist()), _ENTRY)
    order = np.lexsort((entry["set"], entry["sig"]))
    sig, name, size, pos = entry["sig"][order], entry["set"][order], entry["size"][order], entry["pos"][order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
    sig, name, size, pos = sig[new], name[new], size[new], pos[new]
    twin = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    return pa.table({"sig": signed(sig[twin]), "set_id": name[twin], "size": size[twin], "pos": pos[twin]})


def _texts(n: int, seed: int, table: np.ndarray, batches):
    """set_id and text of documents that pass the filter, each set once a task."""
    done: set[int] = set()
    for batch in batches:
        ids = batch.column(0)
        here = may_contain(table, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        batch = batch.filter(pa.array(here))
        names, keep = [], []
        for part in slices(batch.column(1)):
            for own in text_sets(part, n):
                name = set_id(own, seed)
                keep.append(name not in done)
                done.add(name)
                names.append(name)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()).filter(keep), batch.column(1).filter(keep)], names=["set_id", "text"])


def _compare(n: int, batches):
    """Rows sorted by (a, salt, role): a leader's text, then its members'. Returns the pairs that link."""
    key, leader = None, np.empty(0, np.uint64)
    for batch in batches:
        a, b, salt, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        out: list[tuple[int, int]] = []
        for part in slices(batch.column(4)):
            for k, own in enumerate(text_sets(part, n), part.first):
                if role[k] == 0:
                    key, leader = (a[k], salt[k]), own
                elif key == (a[k], salt[k]) and len(leader) and len(own):
                    small, large = (own, leader) if len(own) <= len(leader) else (leader, own)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    inner = int((large[at] == small).sum())
                    if PER * inner >= LEAST * (len(own) + len(leader) - inner):
                        out.append((int(a[k]), int(b[k])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The pairs (a, b) of sets that link, judged on whole texts. Each text goes to the pairs' left sides; a left side with many partners is dealt over several tasks."""
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    wanted = bloom_filter(ends.join(classes, "set_id").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "doc_id")
    texts = docs.select("doc_id", "text").mapInArrow(lambda batches: _texts(n, seed, wanted.value, batches), "set_id long, text string")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("partners")).select("a", F.ceil(F.col("partners") / _GROUP).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = dealt.join(texts.withColumnRenamed("set_id", "b"), "b").select("a", "b", "salt", F.lit(1).alias("role"), "text")
    leaders = sizes.join(texts.withColumnRenamed("set_id", "a"), "a").select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), "text")
    both = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return both.mapInArrow(lambda batches: _compare(n, batches), "a long, b long").distinct()


def can_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bitmaps allow a link. sets: set_id, n, bits; only those of the pairs are shuffled."""
    pairs = stash(pairs, "met")
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    near, _ = split(sets.select("set_id", "n", "bits"), "set_id", bloom_filter(ends, "set_id"))
    near = stash(near.groupBy("set_id").agg(F.max("n").alias("n"), F.first("bits").alias("bits")), "bitmaps")
    side = lambda x: near.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    # of sets that fit, one bitmap is twice the other at most; it is folded
    both = both.withColumn("longs", F.least(F.size("bits_a"), F.size("bits_b")))
    folded = lambda x: F.when(F.size(x) > F.col("longs"), xor(F.slice(x, F.lit(1), F.col("longs")), F.slice(x, F.col("longs") + 1, F.col("longs")))).otherwise(F.col(x))
    apart = F.aggregate(xor(folded("bits_a"), folded("bits_b")), F.lit(0), lambda total, x: total + F.bit_count(x))
    both = both.where(_fits(F.col("n_a"), F.col("n_b")))
    return both.where(F.floor((F.col("n_a") + F.col("n_b") - apart) / 2) >= _overlap(F.col("n_a"), F.col("n_b"))).select("a", "b")


def _fits(a, b):
    return (PER * F.least(a, b) >= LEAST * F.greatest(a, b)) & (a > 0)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _unsettled(lists: DataFrame, near: DataFrame) -> DataFrame:
    """The entries of lists whose sets are in several components. near: node, component."""
    placed = lists.join(near.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    several = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    return placed.join(several, "sig")


def _k(sig):
    """How many shared n-grams an entry stands for: two in a 2-subset, one in a list."""
    return F.when(F.col(sig) % 2 != 0, 1).otherwise(2)


def _overlap(a, b):
    """The least overlap of two sets of these sizes that link."""
    return F.ceil(LEAST * (a + b) / (LEAST + PER))


def _side(entries: DataFrame, x: str) -> DataFrame:
    return entries.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("set_id", "size", "pos", "component")])


def _can_link(light: int, apart) -> object:
    """Of two entries of a list: these can be the first shared ones of sets that link."""
    sizes = F.col("size_a"), F.col("size_b")
    overlap = _overlap(*sizes)
    first = [F.col(f"pos_{x}") < F.col(f"size_{x}") - overlap + _k("sig") for x in "ab"]
    kind = (F.col("sig") % 2 == 0) | (F.greatest(*sizes) > light)
    return apart & _fits(*sizes) & kind & first[0] & first[1]


def _all_pairs(placed: DataFrame, light: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share an entry which can be their first shared one.

    Entries whose place allows only partners of sizes that no other component has in their list are left out before lists are joined."""
    reach = F.col("size") - F.col("pos") + _k("sig") - 1
    most = F.least(F.floor((LEAST + PER) * reach / LEAST) - F.col("size"), F.floor(PER * F.col("size") / LEAST))
    least = F.ceil(LEAST * F.col("size") / PER)
    own = placed.withColumn("least", least).withColumn("most", most).where("least <= most").select("sig", "set_id", "size", "pos", "component", bucket("least", 5).alias("low"), bucket("most", 5).alias("high"))
    there = own.groupBy("sig", bucket("size", 5).alias("class")).agg(F.min("component").alias("one"), F.max("component").alias("another"))
    meets = (F.col("class") >= F.col("low")) & (F.col("class") <= F.col("high")) & ((F.col("one") != F.col("component")) | (F.col("another") != F.col("component")))
    own = stash(own.join(there.withColumnRenamed("sig", "_sig"), (F.col("sig") == F.col("_sig")) & meets, "left_semi").select("sig", "set_id", "size", "pos", "component"), "entries")
    pairs = _side(own, "a").join(_side(own, "b"), "sig").where((F.col("set_id_a") < F.col("set_id_b")) & _can_link(light, F.col("component_a") != F.col("component_b")))
    return pairs.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, n: int = N) -> DataFrame:
    """One row per document row: doc_id, text_key (a hash of the text), n_shingles, component_id (the smallest doc_id reachable over links) and component (a number of its component; null without words)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    for seed in range(0, 64, 2):
        scanned = stash(docs.mapInArrow(lambda batches: _sets(n, seed, batches), "doc_id long, text_key long, set_id long, again long, n long, token long, freq long, bits array<long>"), "sets")  # noqa: B023
        sets = scanned.where("n is not null").select("doc_id", "text_key", "set_id", "again", "n", "bits")
        classes = stash(sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min("again").alias("low"), F.max("again").alias("high")), "classes")
        if classes.where("low != high").isEmpty():  # else two different sets have one name
            break

    often = scanned.where("n is null").groupBy("token").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= FREQUENT)
    often = often.orderBy(F.desc("freq"), "token").limit(MAX_FREQUENT).toArrow()
    tokens = often["token"].to_numpy().view(np.uint64)
    by_hash = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[by_hash], np.minimum(often["freq"].to_numpy()[by_hash], 1 << 30).astype(np.int32)))
    histogram = {r[0]: r[1] for r in classes.groupBy(F.least("n", F.lit(65)).alias("n")).count().collect()}
    light = boundary(histogram)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4 // BUCKET_ENTRIES)

    sign = lambda packed, schema: docs.select("text").mapInArrow(lambda batches: _signatures(n, seed, light, buckets, frequent.value, packed, batches), schema)
    packed = sign(True, "bucket int, entries binary").groupBy("bucket").applyInArrow(_shared_entries, "sig long, set_id long, size int, pos int")
    rows = sign(False, "sig long, set_id long, size int, pos int").distinct()
    lists = stash(packed.unionByName(rows), "lists")

    # first round: every set of a list against the list's leader, the set with the fewest n-grams before this one: of near copies, the one
    # with the least of its own. In lists that the same sets are in, LEADERS of them are met at most
    colour = F.pmod(F.shiftright("sig", 1), F.lit(LEADERS))
    leader = lists.groupBy("sig").agg(F.min_by(F.struct(F.col("set_id").alias("a"), F.col("size").alias("size_a")), F.struct("pos", F.xxhash64("set_id", colour), "set_id")).alias("leader"))
    star = lists.join(leader, "sig").select("leader.*", F.col("set_id").alias("b"), "size", (F.col("sig") % 2 == 0).alias("light")).where("a != b").where(_fits(F.col("size_a"), F.col("size")))
    star = star.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("light").alias("light")).where(F.col("light") | (F.col("shared") >= K)).select("a", "b")
    star = stash(can_overlap(star, sets), "star")
    linked = stash(verify(docs, star, classes, n, seed), "links")

    # second round: all pairs of different components that can link
    placed = _unsettled(lists, components(linked))
    pairs = stash(can_overlap(_all_pairs(placed, light).join(_both_ways(star), ["a", "b"], "left_anti"), sets), "pairs")
    linked = linked.unionByName(verify(docs, pairs, classes, n, seed))

    labels = components(linked)
    named = classes.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("set_id", "component_id", "component")
    joined = sets.join(named, "set_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key", F.when(F.col("n") > 0, F.col("component")).alias("component"))
