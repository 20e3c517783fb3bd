"""The corpus operators against brute force on small fixtures with nulls, empty, long and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import chat, decontaminate, language, licenses, ngram_join, packing, quality, sharding, substring_dedup, token_counts
from sigweave.llm.components import components
from tests.llm import plain

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3, n=120):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["Émile", "straße", "a", "B"]
    passage = [r.choice(words) for _ in range(60)]
    base = [r.choice(words) for _ in range(90)]
    out = [None, "", " \n\t ", "one", "one", "a b c", "A B C", "x " * 50]
    for i in range(n):
        kind = i % 6
        w = [r.choice(words) for _ in range(r.randint(1, 120))]
        if kind == 1:
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(words)
        elif kind == 2:
            k = r.randrange(len(w))
            w = w[:k] + passage + w[k:]
        elif kind == 3:
            w = list(base)
        out.append("\n ".join([" ".join(w[:20]), "  ".join(w[20:])]))
    out.append(" ".join(r.choice(words) for _ in range(5000)))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s%d" % (i % 2), len(t or ""), "x") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def test_ngram_join(docs, empty):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == plain.classes(corpus())
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_boundary_follows_cost():
    assert ngram_join.boundary({60: 100}) < 45  # large sets only: all in lists, none enumerated
    assert 6 <= ngram_join.boundary({6: 1000}) <= 64 and ngram_join.boundary({6: 1000, 30: 100}) < 30
    many = {s: 10 for s in range(1, 65)}
    costs = {x: sum(c * math.comb(ngram_join.prefix_length(s, 2), 2) for s, c in many.items() if s <= x) + 2 * sum(c * ngram_join.prefix_length(s, ngram_join.K) for s, c in many.items() if 4 * s >= 3 * (x + 1)) for x in range(4, 65)}
    assert costs[ngram_join.boundary(many)] == min(costs.values())


def near_group(r, n, size, edits):
    """Texts of one base text, each with some words changed at random."""
    base = ["b%d" % i for i in range(size)]
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(size), r.choice(edits)):
            w[k] = "x%d" % r.randrange(10**9)
        yield " ".join(w)


def test_sets_just_below_the_threshold_meet_few(spark, monkeypatch):
    r = random.Random(6)
    texts = [*near_group(r, 150, 150, (1, 2, 3, 4)), *near_group(r, 150, 150, (5, 6, 7)), *near_group(r, 60, 20, (1, 2))]
    r.shuffle(texts)
    texts = list(enumerate(texts))
    compared, stash = {}, ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: compared.setdefault(name, []).append(kept := stash(df, name)) or kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = plain.classes(texts)
    assert got == want and len({x for _, x in want.values()}) > 100
    assert sum(df.count() for name in ("star", "pairs") for df in compared[name]) < math.comb(len(texts), 2) / 10


def thue_morse(n):
    """Two different words of n bytes that every polynomial modulo a power of two hashes alike from n = 1024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [64, 1024, 4096])
def test_words_of_equal_polynomials(spark, size):
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    from sigweave.llm.text import NOT_SPACE, grams, slices

    a, b = thue_morse(size)
    runs = [" ".join(x) for x in thue_morse(size)]
    for texts in ([a, b], runs):
        (part,) = slices(pa.array(texts), 1 << 20)
        w = part.words(NOT_SPACE)
        h = w.hashes(lower=True)
        n = len(h) // 2
        assert grams(h[:n], n)[0] != grams(h[n:], n)[0] and (w.hashes(True, 1) != h).all()
    tail = " p q r s t"
    docs = spark.createDataFrame([(0, a + tail), (1, b + tail), (2, f"{a} {a} {a} {a} {a} {b} {a} {a} {a} {a}"), (3, " ".join([a] + ["k%d" % i for i in range(34)])), (4, " ".join([b] + ["k%d" % i for i in range(34)]))], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
    assert {r["row"]["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {i: 0 for i in range(5)}
    judged = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect()}
    assert judged == {i: 0 for i in range(5)}
    lib, tok = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model()), Tokenizer.from_file(packing.default_vocabulary())
    rows = docs.collect()
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()} == {r[0]: len(lib.encode(r[1])) for r in rows}
    ids = {r[0]: [*tok.encode(r[1], add_special_tokens=False).ids, 2] for r in rows}
    for r in packing.pack(docs).collect():
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]))


def test_null_ids_are_joined(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "q w e r t y", None]
    rows = [(None, t) for t in texts] + [(3, texts[0]), (4, texts[0] + " zz"), (9, None)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(None, 4, 3), (None, 4, 3), (None, 2, None), (None, 0, None), (3, 4, 3), (4, 5, 3), (9, 0, 9)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.judge(docs, prior=20).collect()}
    for i, t in corpus():
        w = WORD.findall(t or "")
        fives = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marks = set()
        for k in range(len(w) - 4):
            if fives[tuple(w[k : k + 5])] > 1:
                marks |= set(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(marks), len(lines) - len(set(lines)))
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(marks) > 20 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality.judge(empty).count() == 0


def test_fences_follow_the_source(spark):
    r = random.Random(4)
    words = lambda n: [r.choice("abcdefgh") * r.randint(2, 7) + r.choice("xyz") for _ in range(n)]
    same, loud, wordy = (" ".join(words(50) + x) for x in (["******"], words(5), []))
    loud, wordy = loud.replace("x", "X"), " ".join(w + "ending" for w in wordy.split())
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(100)), "prose"))
        w = words(100) + ["*" * r.randint(5, 30)]
        rows.append((100 + i, " ".join(x + "endings" * r.randint(0, 1) for x in w).upper() if i % 2 else " ".join(w), "code"))
    for k, text in enumerate((same, loud, wordy)):
        rows += [(1000 + k, text, "prose"), (2000 + k, text, "code")]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string"), prior=5).collect()}
    assert [got[1000 + k]["failed"] for k in range(3)] == [["symbol_rate"], ["upper_rate"], ["word_length"]]
    assert {i: (x["base_failed"], x["failed"]) for i, x in got.items() if i not in (1000, 1001, 1002) and not x["kept"]} == {}


def test_sketch_buckets(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 1000, 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket("v").alias("b")).select("v", quality.bucket_value("b").alias("low")).collect()
    assert all(r["low"] <= r["v"] <= r["low"] * 129 / 128 for r in rows)


def test_substring_dedup(docs, empty):
    rows = {r["row"]["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    words = {i: WORD.findall(t or "") for i, t in corpus()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_later_batches_are_held_against_earlier_ones(spark):
    r = random.Random(9)
    some = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(99)) for _ in range(n)]
    p, q = some(60), some(37)
    tables = [
        {0: some(20) + p + some(9), 1: some(80), 2: None},
        {3: p[5:50], 4: some(50) + q, 5: some(30) + q + some(30) + q, 2: None},
        {6: q, 7: some(9) + p[:34], 8: some(3) + p[24:] + some(2), 9: some(90)},
    ]
    seen = Counter()
    for table in tables:
        rows = [(i, " ".join(w) if w else None) for i, w in table.items()]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        # opened again by its name for each table
        index = substring_dedup.FingerprintIndex(spark, "kept", fanout=2, buckets=2)
        got = {x["row"]["doc_id"]: x["n_removed"] for x in substring_dedup.substring_dedup(df, batches=1, index=index).collect()}
        seen.update(tuple(w[k : k + 35]) for w in table.values() if w for k in range(len(w) - 34))
        want = {}
        for i, w in table.items():
            starts = [k for k in range(len(w or []) - 34) if seen[tuple(w[k : k + 35])] > 1]
            want[i] = len({x for k in starts for x in range(k, k + 35)})
        assert got == want
    assert want == {6: 37, 7: 0, 8: 36, 9: 0}
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(df, window=20, batches=1, index=index)
    index.drop()
    assert not spark.catalog.listTables()


@pytest.mark.parametrize("window", [5, 90])
def test_other_window_sizes(spark, window):
    r = random.Random(window)
    p = ["w%d" % r.randrange(50) for _ in range(130)]
    texts = [" ".join(p), " ".join(["a", *p[20:], "b"]), " ".join(p[:60]), " ".join(["c"] * 200), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["row"]["doc_id"]: x["kept_sha256"] for x in substring_dedup.substring_dedup(df, window=window).collect()}
    assert got == {i: plain.digest(kept) for i, _, kept in plain.without_repeats(enumerate(texts), window)}


def test_hot_fingerprints_give_the_same(docs, monkeypatch):
    want = {tuple(r) for r in substring_dedup.substring_dedup(docs).select("row.doc_id", "n_removed").collect()}
    monkeypatch.setattr(substring_dedup, "_GROUP", 2)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    assert {tuple(r) for r in substring_dedup.substring_dedup(docs).select("row.doc_id", "n_removed").collect()} == want


def test_dealt_groups_give_the_same(docs, monkeypatch):
    want = {tuple(r) for r in substring_dedup.substring_dedup(docs).select("row.doc_id", "n_removed").collect()}
    monkeypatch.setattr(substring_dedup, "_GROUP", 3)
    assert {tuple(r) for r in substring_dedup.substring_dedup(docs).select("row.doc_id", "n_removed").collect()} == want


def test_sharding(docs, empty):
    rows = docs.unionByName(docs.where("doc_id < 5")).select("doc_id", "text")
    got = sharding.exact_shuffle(rows, shards=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == rows.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert {tuple(r) for r in got} == {tuple(r) for r in sharding.exact_shuffle(rows.repartition(5), shards=16).collect()}
    assert sharding.exact_shuffle(empty.select("doc_id"), shards=16).count() == 0
    with pytest.raises(ValueError):
        sharding.exact_shuffle(rows.withColumn("Slot", F.lit(1)), shards=16)


def test_communication_matrix_law():
    m = sharding.communication_matrix([10, 0, 7, 30], 4, 1)
    assert [sum(r) for r in m] == [10, 0, 7, 30] and max(map(sum, zip(*m, strict=True))) - min(map(sum, zip(*m, strict=True))) <= 1
    r = random.Random(5)
    draws = Counter(sharding.hypergeometric(r, 3, 4, 3) for _ in range(20000))
    for k, p in {0: 4 / 35, 1: 18 / 35, 2: 12 / 35, 3: 1 / 35}.items():
        assert abs(draws[k] / 20000 - p) < 0.015


def test_token_counts(spark, docs):
    import sentencepiece

    odd = [" ", "  a  b \n c<s>", "\n", "\nab", "a\n", " \n ", "a▁b ▁ c", "x" * 300, "é　ü x", "a\n\n  b  ", "tab\tx\r\n y", " " * 40 + "q", "🙂 x🙂", "\x00a"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    got = token_counts.count_tokens(rows, limit=50).join(rows, "doc_id").collect()
    for r in got:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(lib.encode(text)), len(lib.encode(text)) > 50)
        if r["over_limit"] and r["fit_bytes"]:
            assert len(lib.encode(text.encode()[: r["fit_bytes"]].decode())) <= 50


def test_longest_prefix_of_every_budget():
    import pyarrow as pa
    import sentencepiece

    path = token_counts.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    base64 = "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(300))
    texts = [base64, "ภาษาไทยไม่มีช่องว่าง" * 4, "中文没有空格的长文本" * 6, "function(a,b){return(a+b)}" * 5, "internationalisation of  straße\n\n  🙂x🙂 end ", "a▁b ▁ cde▁▁fgh", " " * 40 + "q", "w" * 90, "\x00a\n \n"]
    for text in texts:
        counts = [len(lib.encode(text[:k])) for k in range(len(text) + 1)]
        for limit in range(counts[-1] + 1):
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "one " + text])], names=["doc_id", "text"])
            (got,) = token_counts._counts(path, limit, iter([batch]))
            best = max(k for k, c in enumerate(counts) if c <= limit)
            assert (got["n_tokens"][0].as_py(), got["fit_bytes"][0].as_py()) == (counts[-1], len(text[:best].encode())), (text, limit)
            after = text_prefix(lib, "one " + text, limit)
            assert got["fit_bytes"][1].as_py() == after


def text_prefix(lib, text, limit):
    return len(text[: max(k for k in range(len(text) + 1) if len(lib.encode(text[:k])) <= limit)].encode())


def test_prefix_programme():
    tok = token_counts.tokenizer(token_counts.default_model())
    for chunk in ("▁hello", "▁▁▁foo", "wörld🙂x", "AAAAaaaa", "▁internationalisation"):
        assert tok.chunk_prefixes(chunk) == [len(tok.raw.encode(chunk[:i])) for i in range(len(chunk) + 1)]


def test_counts_while_the_store_gives_up_chunks(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    from sigweave.llm.pieces import ChunkStore

    path = token_counts.default_model()
    lib, tok = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.tokenizer(path)
    for limit in (20, 300):
        monkeypatch.setattr(tok, "store", ChunkStore(tok._steps, np.int16, limit))
        r = random.Random(limit)
        for _ in range(10):
            texts = [" ".join("x%x" % r.randrange(600) for _ in range(20)) for _ in range(20)]
            batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["doc_id", "text"])
            (got,) = token_counts._counts(path, 30, iter([batch]))
            assert got["n_tokens"].to_pylist() == [len(lib.encode(t)) for t in texts]


def test_a_store_keeps_what_is_asked_for():
    from sigweave.llm.pieces import ChunkStore
    from sigweave.llm.text import mix

    # value k of chunk "7" is 7 + k
    store = ChunkStore(lambda chunks: (np.full(len(chunks), 2), np.array([int(c) + k for c in chunks for k in range(2)])), limit=10)
    r = random.Random(1)
    for _ in range(200):
        asked = np.array([r.randrange(25) for _ in range(r.randint(1, 8))], np.uint64)
        rows = store.rows(mix(asked + np.uint64(1)), mix(asked + np.uint64(99)), lambda i: b"%d" % asked[i])  # noqa: B023
        values, ends = store.values(rows)
        assert values.tolist() == [int(c) + k for c in asked for k in range(2)] and ends.tolist() == list(range(2, 2 * len(asked) + 1, 2))
        assert len(store.keys) <= 20


def test_chunks_end_where_no_piece_goes_on(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    from sigweave.llm.pieces import ChunkStore

    path = token_counts.default_model()
    lib, tok = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.tokenizer(path)
    monkeypatch.setattr(tok, "store", ChunkStore(tok._steps, np.int16))
    words, marks = ["word", "other", "longer", "häuser", "слово"], ["7", "42", "1999", "00"]
    texts = [f"{a}{b}{c} {b}{a}" for a in words for b in marks for c in words]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    (got,) = token_counts._counts(path, 4096, iter([batch]))
    assert got["n_tokens"].to_pylist() == [len(lib.encode(t)) for t in texts]
    # words and numbers, with and without a space before them, and the empty end of a text; not their products
    assert len(tok.store.keys) <= 2 * (len(words) + len(marks)) + 1
    # every text over all characters, cut at every budget
    r = random.Random(5)
    odd = "ab1 2\n.!<>_-/'\"#*éßñя日本ไท😀\u0301\u200b▁\x00\x7f\u00a0"
    texts = ["", " ", "7", *("".join(r.choices(odd, k=r.randint(1, 40))) for _ in range(400)), *("</s> <0x0A>" + "".join(r.choices("09<>x/s", k=9)) for _ in range(50))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    sizes = [[len(lib.encode(t[:k])) for k in range(len(t) + 1)] for t in texts]
    for limit in (1, 4, 9, 20):
        (got,) = token_counts._counts(path, limit, iter([batch]))
        assert got["n_tokens"].to_pylist() == [own[-1] for own in sizes]
        assert got["fit_bytes"].to_pylist() == [len(t[: max(k for k, n in enumerate(own) if n <= limit)].encode()) for t, own in zip(texts, sizes, strict=True)]


def test_a_long_run_of_digits_is_one_chunk():
    import pyarrow as pa

    from sigweave.llm.text import slices

    tok = token_counts.tokenizer(token_counts.default_model())
    (part,) = slices(pa.array(["a" + "0123456789" * 100 + "b" + "1" * 50]))
    counts = token_counts.PrefixCounts(part, tok, tok.joined)
    assert len(counts.ends) <= 3 and counts.last.tolist() == [len(tok.whole.encode(part.bytes_of(0).decode()))]


def test_runs_of_many_spaces_have_keys_of_their_own():
    from types import SimpleNamespace

    import pyarrow as pa

    from sigweave.llm.text import slices

    nothing = SimpleNamespace(counts=lambda hashes, checks, chunk: np.zeros(len(hashes), np.int64))
    (part,) = slices(pa.array(["a \nb" + " " * ((1 << 24) + 1) + "\n"]), 1 << 25)
    keys = token_counts.PrefixCounts(part, nothing).keys[0]
    assert len(set(keys.tolist())) == len(keys)


def test_short_and_tied_texts_have_a_language(spark):
    rows = [(1, "x", "aa"), (2, "ja ja", "bb"), (3, "Z", None), (4, "X!", None), (5, "ja", None), (1, "x", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.identify(df, language.learn_languages(df)).collect()]
    assert sorted(got) == [(1, "aa", True), (1, "aa", True), (2, "bb", True), (3, "aa", False), (4, "aa", True), (5, "bb", True)]
    assert language.identify(df.where("false"), language.learn_languages(df)).count() == 0


def test_language(spark):
    r = random.Random(1)
    vocab = {"aa": ["katze", "hund", "straße", "und"], "bb": ["chat", "chien", "rue", "été"], "cc": ["gato", "perro", "calle", "niño"]}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(12)), k) for i, k in enumerate(list(vocab) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(df)
    odd = spark.createDataFrame([(500, None, None), (501, "123 ?!", None), (502, "", None)], df.schema)
    got = {x["doc_id"]: x for x in language.identify(df.unionByName(odd), model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert language.identify(df, language.learn_languages(df.where("false"))).where("lang_pred != 'und'").count() == 0


def test_decontamination(spark, docs, empty):
    texts = dict(corpus())
    items = [(1, " ".join(WORD.findall(texts[-1 + len(texts)])[100:130]).upper()), (2, "one"), (3, None), (4, "zz yy xx"), (5, "B, w1 "), (None, "w7 w8"), (None, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = [(i, [tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)]) for i, t in items if (w := split(t))]
    for bytes_ in (1 << 20, 100):
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, block_bytes=bytes_).collect()}
        assert len(got) == len(texts)
        for i, t in texts.items():
            w, hit, found = split(t), set(), set()
            for item, own in windows:
                for win in own:
                    for k in range(len(w) - len(win) + 1):
                        if tuple(w[k : k + len(win)]) == win:
                            hit |= set(range(k, k + len(win)))
                            found |= {str(item)} - {"None"}
            assert (got[i]["n_words"], got[i]["n_hit"], sorted(got[i]["items"])) == (len(w), len(hit), sorted(found))
    assert decontaminate.find_contamination(empty, bench).count() == 0 and decontaminate.find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(docs, size=256).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in corpus()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) and r["doc_tokens"] == len(want[r["doc_id"]])
    assert {i: sum(p["length"] for p in v) for i, v in pieces.items()} == {i: len(v) for i, v in want.items()}
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_place_counts():
    histogram = {100: 3, 60: 5, 40: 9, 1: 50}
    patterns = packing.place(histogram, 100)
    used = Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    assert dict(used) == histogram


def test_licenses(spark):
    texts = {name: text for name, text in reversed(licenses.KNOWN)}
    mit, bsd = texts["MIT"], texts["BSD-3-Clause"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit), (2, mit.lower().replace(", ", ",  ").replace("copyright holders", "Copyright   Holders")), (3, "abc\nReleased under the MIT licence!"), (4, None), (5, "  \n"), (6, mit + " more"),
        (7, "The MIT License (MIT)\n\nCopyright © 1999 A. Author\nAll rights reserved.\n\n" + mit.replace("subject to", "subject\nto")), (8, "BSD 3-Clause License\n(c) 2001, B.\n" + bsd.replace(" 2. ", "\n\n2.  ").replace(". ", ".\n    ")),
        (9, "intro\n" + texts["Apache-2.0"].replace("License", "Licence") + "\noutro"), (10, texts["MPL-2.0"]),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert {i: r["license"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "MIT", 8: "BSD-3-Clause", 9: None, 10: "MPL-2.0"}
    assert got[3]["notices"] == ["MIT"] and got[9]["notices"] == ["Apache-2.0"] and got[7]["notices"] == []
    assert got[4]["digest"] is None and got[5]["digest"] is None and got[6]["digest"] is not None
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.scan(rows.where("false"), licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(rows, licenses.known_licenses(spark).where("false")).where("license is not null").count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "ok"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", None), (5, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.preference_rows(df, chat.adjacent_pairs(df)).collect()}
    a = got[0]
    assert a["n_prompt_turns"] == 1 and a["prompt"] == "<|user|>\nhi\n" and a["rejected"] == "<|assistant|>\nno\n"
    assert [a["chosen"][x["start"] : x["end"]] for x in a["chosen_mask"]] == ["yes\n", "ok\n"]
    minus = spark.createDataFrame([(-1, 0, "user", "a <|assistant|>"), (-2, 0, "user", "b"), (-3, 0, "user", "c")], df.schema)
    below = {r["pair_id"]: r for r in chat.preference_rows(minus, chat.adjacent_pairs(minus)).collect()}
    assert set(below) == {-1, -2} and (below[-1]["chosen"], below[-1]["rejected"], below[-2]["chosen"]) == ("<|user|>\nb\n", "<|user|>\na <\\|assistant|>\n", None)
    assert got[1]["rejected"] is None and got[1]["n_prompt_turns"] == 0 and got[1]["chosen"] == "<|user|>\n\n"
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen"] == "" and got[2]["rejected"] == ""
