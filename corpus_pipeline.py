"""A training corpus from raw documents: quality rules, near-duplicate join, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from sigweave.llm.shared import bloom_filter, prepare, split, stash, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go."""
    prepare(spark)
    rejected = stash(quality.judge(docs).where(~F.col("kept")).select("text_key", "lang", "source"), "rejected")
    return without(docs, rejected, {"text_key": F.xxhash64("text"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays: that with the smallest doc_id, of several with this doc_id that with the smallest
    hash of its text; identical rows become one."""
    prepare(spark)
    rows = stash(ngram_join.jaccard_classes(docs).select("doc_id", "text_key", "component", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")), "classes")
    # rows without words have no component; identical ones are a group
    group = ["component", F.when(F.col("component").isNull(), F.col("text_key")).alias("wordless"), "doc_id"]
    named = rows.where("first").select(*group, "text_key")
    several = stash(named.groupBy("component", "wordless", "doc_id").agg(F.count("*").alias("n"), F.min("text_key").alias("text_key")).where("n > 1"), "several")
    other = named.join(several.select(*[F.col(c).alias(f"{c}_") for c in ("component", "doc_id", "text_key")]), F.col("component") == F.col("component_")).where(F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_key") != F.col("text_key_")))
    gone = stash(rows.where("not first").select("doc_id", "text_key").unionByName(other.select("doc_id", "text_key")), "copies")
    # rows of both tables pass one filter, so that one worker a task holds texts; equal rows pass together
    ids = gone.select("doc_id").unionByName(several.select("doc_id")).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    marked = docs.withColumns({"_sigweave_id": F.col("doc_id").cast("long"), "_sigweave_key": F.xxhash64("text")})
    near, clear = split(marked, "_sigweave_id", bloom_filter(ids, "doc_id"))
    kept = near.join(gone, near["_sigweave_id"].eqNullSafe(gone["doc_id"]) & (near["_sigweave_key"] == gone["text_key"]), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(clear).drop("_sigweave_id", "_sigweave_key")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 35 words are cut from the texts; a document with no word left goes."""
    prepare(spark)
    cut = substring_dedup.substring_dedup(docs)
    cut = cut.where("n_removed = 0 or n_removed < n_words")
    text = F.coalesce("kept_text", "text")
    column = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return cut.select(*[(column[c].cast(docs.schema[c].dataType) if c in column else F.col("row").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth lies in benchmark windows go."""
    prepare(spark)
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = stash(found.where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select("text_key"), "contaminated")
    return without(docs, dirty, {"text_key": F.xxhash64("text")})


def packing_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document that is left, in sequences of 4096."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing_into_sequences),
]

#: SQL expresses neither the tokenizer nor the packing; test_pipeline_equals_brute_force holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
