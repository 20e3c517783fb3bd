"""A learning cycle over new files: learn, stage new versions of the tables, gate them, and commit or hold.

Every cycle has a version (in a stream, the number of its micro-batch). Its tables are written beside the old ones, into a folder of that version; what makes
them valid is one small commit, written last and only after the gate: the files taken in, and whether they were accepted. Readers take the newest
accepted version. So a cycle that dies anywhere leaves nothing that is read, and when it runs again it writes the same folders over; a cycle
that is committed is not run again. Files of a held cycle stay pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.sources.files import optional

_FILES = "path string, signature string"
_COMMITS = f"status string, reasons array<string>, {_FILES}"
Tables = dict[str, DataFrame]


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(version, status, reasons, path, signature): a row for each file of each committed cycle; a cycle without files has one without a path."""
    return optional(spark, f"{root}/commits", f"{_COMMITS}, version long")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, signature) of the files that accepted cycles have taken in."""
    return commits(spark, root).where("status = 'accepted' and path is not null").select("path", "signature").distinct()


def held(spark: SparkSession, root: str) -> DataFrame:
    """(path, signature) of files that cycles held and none accepted since."""
    rows = commits(spark, root).where("path is not null").select("path", "signature", "status")
    return rows.groupBy("path", "signature").agg(F.bool_or(F.col("status") == "accepted").alias("taken")).where("not taken").drop("taken")


def load(spark: SparkSession, root: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    """A table as the newest accepted cycle left it (or as a given version has it); empty before the first one."""
    if version is None:
        version = commits(spark, root).where("status = 'accepted'").agg(F.max("version")).first()[0]
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{root}/tables/{name}/version={version}")


def run_cycle(spark: SparkSession, root: str, version: int, found: DataFrame, schemas: dict[str, str], learn: Callable[[DataFrame, Tables], Tables], gate: Callable[[Tables, Tables], list[str]]) -> str:
    """One cycle over files (path, signature): "accepted", "held" or "idle"; of a cycle that was committed before, what it was.

    learn: new files and the tables so far to the new tables, all of those in ``schemas``. gate: tables before and after to the reasons against them; none accepts."""
    before = commits(spark, root).where(F.col("version") == version).select("status").first()
    if before:
        return before[0]
    fresh = found.select("path", "signature").unionByName(held(spark, root)).distinct().join(manifest(spark, root).select("signature"), "signature", "left_anti").select("path", "signature")
    files = fresh.collect()  # a cycle's list of files, not their rows
    pending = spark.createDataFrame(files, _FILES)
    status, reasons = "idle", []
    if files:
        old = {name: load(spark, root, name, schema) for name, schema in schemas.items()}
        for name, table in learn(pending, old).items():
            table.write.mode("overwrite").parquet(f"{root}/tables/{name}/version={version}")
        reasons = gate(old, {name: load(spark, root, name, schema, version) for name, schema in schemas.items()})
        status = "held" if reasons else "accepted"
    rows = [(status, reasons, r["path"], r["signature"]) for r in files] or [(status, reasons, None, None)]
    spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/version={version}")
    return status


def watch(found: DataFrame, root: str, checkpoint: str, schemas: dict[str, str], learn: Callable[[DataFrame, Tables], Tables], gate: Callable[[Tables, Tables], list[str]], interval: str | None = None):
    """A stream of files (path, signature) to a cycle for each micro-batch: all there is now, or every ``interval`` (like "60 seconds") until it is stopped."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        run_cycle(rows.sparkSession, root, batch_id, rows, schemas, learn, gate)

    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def file_stream(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """(path, signature) of new files below a folder; their content is not read."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.select("path", F.sha1(F.concat_ws("::", "path", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string"))).alias("signature"))
