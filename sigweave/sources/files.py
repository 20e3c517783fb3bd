"""Scans and sinks: decoded rows, tables by protocol, tolerant JSON lines, versioned snapshots, manifests, suites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.schemas import MESSAGE, conform


def discover(spark: SparkSession, root: str, glob: str = "*.pcap*") -> DataFrame:
    """(path, size, modified, signature) of capture files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha1(F.concat_ws("::", "path", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string"))).alias("signature"))


def scan_decoded(spark: SparkSession, path: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Decoded rows: separated by |, quoted, all text; blanks are null. Bad rows go to the column _bad, or fail if strict."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ("" if strict else ", _bad string")
    reader = spark.read.schema(schema).option("sep", "|").option("quote", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = (reader if strict else reader.option("columnNameOfCorruptRecord", "_bad")).csv(path)
    return rows.select(*[F.nullif(F.trim(f"`{c}`"), F.lit("")).alias(c) for c in columns], *([] if strict else ["_bad"]))


def decoded_rows(rows: DataFrame, capture_id: str, protocol: str) -> DataFrame:
    """Wide text columns to (capture_id, protocol, fields), the input of normalization."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in rows.columns if c != "_bad"])
    return rows.select(F.lit(capture_id).alias("capture_id"), F.lit(protocol).alias("protocol"), F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("fields"))


def supported(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns; those that the source lacks as null text."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in wanted])


def optional(spark: SparkSession, path: str, schema: str, fallback: str | None = None) -> DataFrame:
    """A Parquet table; if there is none, the one at ``fallback``, or an empty one of the schema. Any other error is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return optional(spark, fallback, schema) if fallback else spark.createDataFrame([], schema)


def load_collections(spark: SparkSession, paths: dict[str, str], columns: list[str], capture_id: str) -> DataFrame:
    """(capture_id, protocol, fields) of several protocols' decoded rows, by the path of each; a protocol without a file has no rows."""
    from pyspark.errors import AnalysisException

    parts = []
    for protocol, path in paths.items():
        try:
            parts.append(decoded_rows(scan_decoded(spark, path, columns), capture_id, protocol))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "capture_id string, protocol string, fields map<string,string>")


def union_protocols(parts: list[DataFrame]) -> DataFrame:
    """All families as messages in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [conform(p) for p in parts])


def save_messages(messages: DataFrame, path: str) -> None:
    messages.write.partitionBy("protocol").mode("overwrite").json(path)


def load_messages(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.schema(", ".join(f"{n} {t}" for n, t in MESSAGE.items())).json(path))


SLIM = ["capture_id", "session_id", "start_ts", "end_ts", "protocols", "imsi", "msisdn", "final_sip_code", "rca_label", "severity", "confidence_pct"]


def save_sessions(sessions: DataFrame, path: str, slim: bool = False) -> None:
    (supported(sessions, SLIM) if slim else sessions).write.mode("overwrite").parquet(path)


def save_features(features: DataFrame, path: str) -> None:
    flat = [c for c, t in features.dtypes if not t.startswith(("array", "struct", "map"))]
    features.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def load_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def load_feedback(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feedback records; lines that are not JSON objects are left out."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def save_snapshot(table: DataFrame, root: str, name: str, version: int) -> None:
    """A new version beside the old ones; readers take the newest complete one."""
    table.write.mode("errorifexists").parquet(f"{root}/{name}/version={version}")


def load_snapshot(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    rows = optional(spark, f"{root}/{name}", schema + ", version int")
    newest = rows.agg(F.max("version").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("version") == F.col("newest")).drop("version", "newest")


def pending_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose signature was not accepted before."""
    return files.join(manifest.select("signature"), "signature", "left_anti")


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases of a JSON file that is a list, or an object with a list named cases."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("cases").alias("c")).select("c.*") if "cases" in rows.columns else rows


def append_report(report: DataFrame, path: str) -> None:
    report.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)
