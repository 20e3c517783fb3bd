"""Every corpus query over the smallest tables, against its SQL or a plain version; and the pipeline."""

import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigweave.llm import packing, queries, token_counts
from tests.helpers import compare, connection
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def documents():
    return [(r.doc_id, r.text if isinstance(r.text, str) else None, r.lang, r.source) for r in pd.read_parquet(f"{FOLDER}/documents.parquet").itertuples()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, connection(FOLDER), queries.queries()[name], SQL[name], FOLDER)


def test_sharding(spark, documents):
    rows = queries.op4_sharding(spark, FOLDER).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(documents) and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    for i, text, *_ in documents:
        raw = (text or "").encode()
        assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_sharding_is_uniform(spark):
    from sigweave.llm.sharding import exact_shuffle

    seen, n, rounds = defaultdict(int), 12, 60
    rows = spark.range(n).coalesce(1)
    for seed in range(rounds):
        for r in exact_shuffle(rows, shards=3, seed=1000 + 10 * seed).collect():
            seen[r["id"], r["shard"], r["slot"]] += 1
    # each of the 12 rows stands in each of the 12 places 5 times on average; the chi-square of 121 degrees is under 190 but once in 20,000 draws
    expected = rounds / n
    chi = sum((seen[i, s, k] - expected) ** 2 / expected for i in range(n) for s in range(3) for k in range(4))
    assert chi < 190


def test_token_counts(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_token_counts(spark, FOLDER).collect()}
    want = {i: (len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for i, t, *_ in documents}
    assert got == want


def test_language(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in documents}
    got = {r["doc_id"]: r for r in queries.op8_language(spark, FOLDER).collect()}
    learned = {x for i, _, x, _ in documents if x and not held[i]}
    right = [got[i]["lang_pred"] == x for i, t, x, _ in documents if x and held[i] and any(c.isalpha() for c in t or "")]
    assert len(right) > 20 and sum(right) / len(right) > 0.97
    for i, t, *_ in documents:
        r = got[i]
        assert r["held_out"] == held[i] and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if any(c.isalpha() for c in t or "") else r["lang_pred"] == "und"


def check_packing(rows, texts, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        assert gapless(parts) == len(ids[i])
    used = sum(gapless(parts) for parts in sequences.values())
    assert all(gapless(parts) <= size for parts in sequences.values())
    return used / (len(sequences) * size)


def gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at
        at += length
    return at


def test_packing(spark, documents):
    texts = [(i, t) for i, t, *_ in documents]
    rows = queries.op10_packing(spark, FOLDER).collect()
    assert check_packing(rows, texts, 4096) > 0.9
    assert len({r["sequence_id"] for r in rows}) == max(r["sequence_id"] for r in rows) + 1


def test_special_strings_are_packed_as_the_library_has_them(spark):
    texts = list(enumerate(["a<|endoftext|>b", "It's foo's. x'st ..'s 'tis don't!", "a≠ b≮c é.a x.́y", "A,B;c 1,2.3 (x) [y] <z> <|startoftext|>", "<|ENDOFTEXT|> word,word.word", "x" * 300_000, None, ""]))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_packing(packing.pack(df, size=128).collect(), texts, 128)


def test_pipeline_equals_brute_force(spark, documents):
    import corpus_pipeline

    rows = documents
    kept = plain.quality_kept(rows)
    rows = [r for r, k in zip(rows, kept) if k]
    linked = plain.classes([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if linked[r[0]][1] == r[0]]
    cut = [(i, " ".join(k) if len(k) < len(w) else None) for i, w, k in plain.without_repeats([(r[0], r[1]) for r in rows]) if k]
    texts = {r[0]: r[1] for r in rows}
    texts = {i: texts[i] if t is None else t for i, t in cut}
    items = list(pd.read_parquet(f"{FOLDER}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None))
    for i in list(texts):
        n, hit, _ = plain.contamination(texts[i], items)
        if hit and 20 * hit >= n:
            del texts[i]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len(texts) < len(documents)
    check_packing(got, texts.items(), 4096)


def test_pipeline_with_nothing_left(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, some in enumerate((docs.where("false"), docs.limit(3).withColumn("text", F.lit("too short")), docs.limit(4).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))):
        folder = f"{tmp_path}/{k}"
        some.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_duplicates_with_shared_and_null_ids(spark):
    import corpus_pipeline

    a, b = "a b c d e f g h i j k l", "q w e r t y u i o p z x"
    rows = [(1, a), (1, a + " m"), (2, a), (1, b), (None, b), (None, b), (None, "n n m m k k j j"), (3, None), (3, None), (None, "n n m m k k j j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    first = min(a, a + " m", key=lambda t: docs.where(F.col("text") == t).select(F.xxhash64("text")).first()[0])
    assert got == sorted([(1, first), (1, b), (None, "n n m m k k j j"), (3, None)], key=str)
