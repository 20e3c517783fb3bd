"""Tokenizer alignment, SimHash classes and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sigweave.llm import alignment, lexical, simhash
from sigweave.llm import queries as q
from sigweave.llm.components import components
from sigweave.llm.pieces import ChunkStore
from sigweave.llm.shared import prepare
from sigweave.llm.text import slices

FOLDER = "/root/testdata/sf0.001"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = [None, "", " ", "  ", "a ", " a", "one two", "One  two\tthree", "\n", "x" * 3000, "é ü " * 5, "say <|endoftext|> or <s>", "a▁b", "　a b", "a’ b"]


def lowered(text):
    return (text or "").encode().translate(_LOWER)


def frame(spark, rows, schema="doc_id long, text string"):
    prepare(spark)
    return spark.createDataFrame(rows, schema)


def texts_of(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# ---- alignment


def plain_alignment(texts):
    al = alignment.aligner(*alignment.default_vocabularies())
    each, pairs = [], Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        a = al.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = al.b.encode(text, num_threads=1) if text else []
        if not text or b"".join(al.bytes_a[i] for i in a) != whole or b"".join(al.bytes_b[i] for i in b) != whole:
            each.append(None)
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((al.bytes_a, a), (al.bytes_b, b))]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        pairs.update(links)
        each.append((len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    rows = [(0,) * 6 + ("",) if e is None else (e[0], e[1], len(e[2]), len(e[2]), sum(pairs[x] == most[x[1]] for x in e[2]), sum(pairs[x] for x in e[2]), hashlib.sha256(e[3].encode()).hexdigest()) for e in each]
    return rows, pairs, ["" if e is None else e[3] for e in each]


def test_alignment_of_odd_texts(spark):
    random.seed(4)
    parts = list("ab c  d\n\t.,'s1é日本　’​😀<|>") + ["<|endoftext|>", "<s>", " the", "▁", "\x00", "\x85", " "]
    texts = ODD + ["".join(random.choice(parts) for _ in range(random.randint(1, 30))) for _ in range(400)] + ["one two"] * 3
    want, pairs, groups = plain_alignment(texts)
    docs = frame(spark, [(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n long").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(docs, with_groups=True).collect()}
    assert got == {i: (*w, g) for i, (w, g) in enumerate(zip(want, groups, strict=True))}
    counted = alignment.pair_counts(docs).collect()
    assert {(r["a"], r["b"]): r["n"] for r in counted} == pairs


def test_alignment_query(spark):
    rows = texts_of(spark)
    want, _, _ = plain_alignment([t for _, t in rows])
    got = {r[0]: tuple(r)[1:] for r in q.op11_alignment(spark, FOLDER).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, [])).collect() == []
    got = alignment.align(frame(spark, [(None, "a b"), (None, "a b"), (3, None)])).collect()
    assert sorted((r["doc_id"] is None, r["n_a"]) for r in got) == [(False, 0), (True, 2), (True, 2)]


def aligned(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = next(alignment._scan(alignment.default_vocabularies(), True, iter([batch])))
    return list(zip(*(got[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "groups_sha256", "groups")), strict=True))


def test_alignment_while_the_store_gives_up_chunks(monkeypatch):
    al = alignment.aligner(*alignment.default_vocabularies())
    monkeypatch.setattr(al, "store", ChunkStore(al._encode, limit=200))
    r = random.Random(6)
    for _ in range(10):
        texts = [" ".join("x%x" % r.randrange(400) for _ in range(20)) for _ in range(15)]
        want, _, groups = plain_alignment(texts)
        assert aligned(texts) == [(*w[:3], w[6], g) for w, g in zip(want, groups, strict=True)]


def test_alignment_of_a_million_blanks():
    al = alignment.aligner(*alignment.default_vocabularies())
    for text in (" " * 1_050_000 + "a", "x\n" + "\n" * 1_050_000):
        a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text, num_threads=1)
        ((n_a, n_b, _, _, groups),) = aligned([text])
        got = [g.split("|") for g in groups.split(";")]
        assert (n_a, n_b) == (len(a), len(b))
        assert [[int(i) for g in got for i in g[k].split(",")] for k in (0, 1)] == [a, b]


def test_pointers_and_ranks():
    pointer = alignment.farthest(np.array([2, 3, 5, 9]), np.array([1, 4, 5, 7, 9]))
    assert pointer.tolist() == [6, 6, 6, 8, 6, 6, 6, 8, 8]
    al = alignment.aligner(*alignment.default_vocabularies())
    assert al.ranked is not None
    for text in ["don't go", " the  end\n\n of", "x" * 500, "été 12.5%", "aaaaaaaab"]:
        assert al.ranked.encode_ordinary(text) == al.a.encode(text, add_special_tokens=False).ids


# ---- SimHash


def plain_print(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def plain_components(rows, distance=3):
    """rows: (id, print). The smallest id reachable, for each row."""
    prints = np.array(sorted({p for _, p in rows}), np.uint64)
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= distance):
            up[top(i)] = top(i + 1 + int(j))
    group = {int(p): top(i) for i, p in enumerate(prints)}
    least = {}
    for i, p in rows:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return [least.get(group[p]) for _, p in rows]


def test_xxh64_of_many_lengths():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 12000).astype(np.uint8)
    sizes = np.concatenate((np.arange(150), rng.integers(0, 6000, 200)))
    starts = rng.integers(0, 6000, len(sizes))
    got = simhash.xxh64(data, starts, sizes)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, sizes, strict=True)]


def test_prints_of_odd_texts():
    texts = ODD + [" ".join(f"w{i % 11}" for i in range(2000)), "A b C d"]
    got = np.concatenate([simhash.simhash(*simhash.shingle_hashes(p)) for p in slices(pa.array(texts), 64)])
    assert [int(x) for x in got] == [plain_print(t) for t in texts]


@pytest.mark.parametrize("limit, partitions", [(1 << 16, None), (1 << 16, 3), (1 << 16, 2), (15, 4), (15, 2)])
def test_links_of_dense_groups(spark, limit, partitions):
    rng = np.random.default_rng(3)
    prints = set()
    for base in rng.integers(0, 2**63, 12):
        for _ in range(40):
            x = int(base)
            for k in rng.choice(20, rng.integers(0, 7), replace=False):
                x ^= 1 << int(3 * k + 1)
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    prepare(spark)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(3)
    labels = {r["node"]: r["component"] for r in components(simhash.hamming_links(rows, 3, limit, partitions)).collect()}
    want = plain_components([(signed(p), p) for p in prints])
    assert [labels.get(signed(p), signed(p)) for p in prints] == want


def test_simhash_query(spark):
    rows = texts_of(spark)
    prints = [(i, plain_print(t)) for i, t in rows]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op12_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints), strict=True)}


def test_simhash_of_odd_rows(spark):
    texts = [(7, None), (5, ""), (None, " "), (9, "a b c d e"), (9, "a b c d e"), (None, "A b c d e"), (None, "quite another text here"), (2, "x")]
    got = simhash.simhash_classes(frame(spark, [(i, t, 0) for i, t in texts], "doc_id long, text string, component long")).collect()
    prints = [(i, plain_print(t)) for i, t in texts]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=key) == sorted(want, key=key)
    assert simhash.simhash_classes(frame(spark, [])).collect() == []


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(1)
    costs = np.concatenate((np.zeros((50, 4, 1)), np.cumsum(rng.random((50, 4, 4)), axis=2)), axis=2)
    got = simhash.allocate(costs, 4)
    assert (got.sum(axis=1) == 0).all() and got.min() >= -1
    options = [(a, b, c, 4 - a - b - c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
    for i in range(50):
        best = min(sum(costs[i, p, u] for p, u in enumerate(o)) for o in options)
        assert math.isclose(best, sum(costs[i, p, t + 1] for p, t in enumerate(got[i])))


# ---- ranked search


def plain_search(docs, items, k=10):
    """docs, items: (id, text). Rows (item, rank, doc_id, score)."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    terms = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(1 for _, c in terms if c), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in terms:
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * n // total))) for t in set(words(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made_up(seed, n, vocabulary=60):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"W{x}" for x in rng.zipf(1.4, rng.integers(0, 40)) if x < vocabulary)) for i in range(n)]


@pytest.mark.parametrize("shard, window, full", [(8192, 2048, False), (50, 16, False), (300, 64, True)])
def test_search_equals_plain(spark, shard, window, full):
    docs = [(i if i % 50 else None, t) for i, t in made_up(1, 700)] + [(900, None), (901, ""), (902, "W1 W2 W3")] * 2
    items = made_up(2, 25) + [(97, None), (98, "nothing of it"), (99, "w1 w2 w3 w3")]
    asked = lexical.query_terms(frame(spark, items, "item_id int, text string"))
    index = lexical.build_index(frame(spark, docs).repartition(2), None if full else asked, shard)
    got = lexical.search(index, asked, 10, window).collect()
    assert sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got], key=str) == plain_search(docs, items)


def test_search_in_query_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = made_up(3, 200), made_up(4, 12)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 2000)
    got = lexical.ranked_search(frame(spark, docs), frame(spark, items, "item_id int, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_search(docs, items)
    assert lexical.ranked_search(frame(spark, []), frame(spark, items, "item_id int, text string")).collect() == []
    assert lexical.ranked_search(frame(spark, docs), frame(spark, [], "item_id int, text string")).collect() == []


def test_blocks_that_cannot_come_in_stay_packed():
    lengths = np.full(4000, 50, np.int64)
    impact = lambda tf, n: 1_000_000_000 * tf // (1000 * tf + 8 * n)
    common = lexical.Postings(*lexical.pack_list(np.arange(4000), np.ones(4000, np.int64), lengths), lengths, impact)
    rare = lexical.Postings(*lexical.pack_list(np.arange(0, 4000, 300), np.array([9] * 3 + [3] * 11), lengths[:14]), lengths, impact)
    heap = lexical.Heap(3)
    lexical.search_shard([(10, common), (9000, rare)], 4000, np.arange(4000), np.ones(4000, bool), heap, 512)
    assert heap.ids.tolist() == [0, 300, 600]
    assert common.unpacked.sum() < len(common.unpacked) / 2


def test_packed_lists_come_back():
    rng = np.random.default_rng(5)
    for n in (1, 127, 128, 129, 1000):
        docs = np.sort(rng.choice(8000, n, replace=False)).astype(np.int64)
        tf, lengths = rng.integers(1, 300, n), rng.integers(1, 900, 8000)
        impact = lambda t, m: 1_000_000_000 * t // (1000 * t + 8 * m)
        p = lexical.Postings(*lexical.pack_list(docs, tf, lengths[docs]), lengths, impact)
        got, impacts = p.within(0, 8000)
        assert got.tolist() == docs.tolist() and impacts.tolist() == impact(tf, lengths[docs]).tolist()
        assert p.bounds.tolist() == [max(impacts[k : k + 128]) for k in range(0, n, 128)]
