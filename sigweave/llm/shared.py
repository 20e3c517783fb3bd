"""Tables written to the folder that all executors share, and filters of bounded size made from a column."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder is set only where it is unset on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sigweave-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Rows that go to a Python worker at once: a batch's texts are held by the JVM and by the worker.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Small batches for Python workers, unless the session asks for others. Workers on this machine find the package where the driver found it; on a
    cluster it comes with --py-files or an image."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, root)))


ROW_GROUP_BYTES = 16 << 20


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # small row groups: a task that writes holds one of them in memory
    writer = df.write.option("parquet.block.size", str(ROW_GROUP_BYTES))
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A filter never takes more than this, however many keys there are; with more keys it lets more rows through.
BLOOM_MAX_BYTES = 16 << 20
_PROBES = 3


def _probe(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    from sigweave.llm.text import mix

    out, x = [], keys.astype(np.uint64)
    for _ in range(_PROBES):
        x = mix(x + np.uint64(0x9E3779B97F4A7C15))
        out.append(x & np.uint64(bits - 1))
    return out


def bloom_filter(keys: DataFrame, column: str):
    """A broadcast Bloom filter over a long column: about 16 bits a key, at most BLOOM_MAX_BYTES.

    Spark sets the bits: each task turns its keys into word positions and masks, which are merged
    with bit_or; only the merged words, whose number is bounded, reach the driver.
    """
    import pyarrow as pa

    spark = keys.sparkSession
    n = max(1, keys.count())
    bits = 1 << min(max(12, (16 * n - 1).bit_length()), (8 * BLOOM_MAX_BYTES).bit_length() - 1)

    def words(batches):
        for batch in batches:
            k = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(_probe(k, bits))) if len(k) else np.empty(0, np.uint64)
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    merged = keys.select(F.col(column).cast("long").alias("key")).mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[merged["word"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def may_contain(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are certainly not in the filter."""
    out = np.ones(len(keys), bool)
    for at in _probe(keys.view(np.uint64), len(table) * 64):
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def passing(table: np.ndarray, column: str, inside: bool, batches):
    """The rows of batches that may have a key of the filter, or (not inside) that certainly have none."""
    import pyarrow as pa

    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield batch.filter(pa.array(may_contain(table, keys) == inside))


def split(rows: DataFrame, column: str, bloom) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a key of the filter, and rows that certainly have none, without a shuffle. column: long; null counts as 0."""
    part = lambda inside: rows.mapInArrow(lambda batches: passing(bloom.value, column, inside, batches), rows.schema)
    return part(True), part(False)


def without(rows: DataFrame, gone: DataFrame, keys: dict) -> DataFrame:
    """The rows whose keys (name: expression over the rows; the first is a long) are not in ``gone`` (columns of those names; nulls are equal).

    Only rows that pass a filter made from ``gone`` are shuffled."""
    own = {name: f"_sigweave_{uuid.uuid4().hex}" for name in keys}
    first = next(iter(keys))
    marked = rows.withColumns({own[name]: x for name, x in keys.items()})
    near, clear = split(marked, own[first], bloom_filter(gone.select(F.coalesce(F.col(first), F.lit(0)).alias(first)), first))
    gone = gone.select(*keys).distinct()
    same = [near[own[name]].eqNullSafe(gone[name]) for name in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return near.join(gone, condition, "left_anti").unionByName(clear).drop(*own.values())
