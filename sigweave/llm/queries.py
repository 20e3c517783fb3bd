"""The queries of the numbered operators: thin digests over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import alignment, chat, decontaminate, language, lexical, licenses, ngram_join, packing, quality, sharding, simhash, substring_dedup, token_counts
from sigweave.llm.oracles import SQL
from sigweave.llm.shared import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, folder, "documents"), n=5).select("doc_id", "n_shingles", "component_id")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, folder, "documents").select("doc_id", "text"), window=35)
    return cut.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = sharding.exact_shuffle(rows, shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), licenses.known_licenses(spark))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def op7_preferences(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    rows = chat.preference_rows(turns, chat.adjacent_pairs(turns))
    mask = lambda side: F.array_join(F.transform(f"{side}_mask", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias(f"{side}_mask")
    return rows.select("pair_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", mask("chosen"), "rejected", mask("rejected"))


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.learn_languages(docs.where(~held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=13)
    digest = F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), size=4096)


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_quality, op3_substring_dedup, op4_sharding, op5_token_counts, op6_licenses, op7_preferences, op8_language, op9_decontamination, op10_packing, op11_alignment, op12_simhash, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    """Sharding draws at random, and SQL has neither the tokenizers nor the filters: those queries are tested against brute force."""
    return dict(SQL)
