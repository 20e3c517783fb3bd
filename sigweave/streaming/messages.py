"""Structured Streaming: sources, watermarked sessions, deduplication, interval joins, failure counts, micro-batch labels, stateful segmentation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.plans.batch import labelled


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A bounded poll: so many new files a batch. What was read is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(messages: DataFrame, ts: str = "ts") -> DataFrame:
    return messages.withColumn("event_time", F.timestamp_seconds(ts))


def deduplicated(messages: DataFrame, delay: str = "1 minute") -> DataFrame:
    return messages.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["message_uid"])


def gap_sessions(messages: DataFrame, keys: list[str], gap: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Sessions of each key that end after a gap; rows exactly a gap apart stay together."""
    window = F.session_window("event_time", gap)
    return messages.withWatermark("event_time", delay).groupBy(window, *keys).agg(F.count("*").alias("messages"), F.array_sort(F.collect_set("protocol")).alias("protocols"), F.count_if("is_failure").alias("failures")).select("session_window.start", "session_window.end", *keys, "messages", "protocols", "failures")


def interval_join(left: DataFrame, right: DataFrame, key: str, seconds: int = 5, delay: str = "1 minute") -> DataFrame:
    """Rows of two streams with one key and times within so many seconds."""
    a = left.withWatermark("event_time", delay).select(F.col(key).alias("_a"), F.col("event_time").alias("left_time"), F.col("message_uid").alias("left_uid"))
    b = right.withWatermark("event_time", delay).select(F.col(key).alias("_b"), F.col("event_time").alias("right_time"), F.col("message_uid").alias("right_uid"))
    near = F.expr(f"right_time BETWEEN left_time - INTERVAL {seconds} SECONDS AND left_time + INTERVAL {seconds} SECONDS")
    return a.join(b, (F.col("_a") == F.col("_b")) & near).select(F.col("_a").alias(key), "left_uid", "right_uid", "left_time", "right_time")


def failure_counts(messages: DataFrame, size: str = "1 minute", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    rows = messages.where("is_failure").withWatermark("event_time", delay)
    window = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    return rows.groupBy(window, "protocol").agg(F.count("*").alias("failures")).select("window.start", "window.end", "protocol", "failures")


def label_counts(sessions: DataFrame) -> DataFrame:
    """Running counts of labels over all batches."""
    return sessions.groupBy("rca_label").agg(F.count("*").alias("n"))


def label_batches(messages: DataFrame, out: str, checkpoint: str, gap: float = 15.0):
    """Labels each micro-batch with the batch job. A batch that runs again overwrites its own folder, so each is there once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        labelled(batch, gap).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def procedure_segments(messages: DataFrame, key: str = "session_id", gap: float = 10.0, restart_gap: float = 2.0, delay: str = "1 minute", keep: float = 86_400.0) -> DataFrame:
    """(key, message_uid, segment): the rule of the batch operator (without its least size), with what it remembers of a session kept as state.

    The state is three numbers, so a session is remembered for ``keep`` seconds after its last message, not for a gap only: when it goes on, its segments are counted on as in a batch. A
    timer then forgets it. Within a micro-batch, messages are taken in order; ones later than the watermark are not seen. Needs the RocksDB state store, which is set if Spark's default is."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from sigweave.functions.predicates import completion_marker, start_marker

    class Segments(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("at", "segment int, last double, completed boolean")

        def handleInputRows(self, k, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            segment, last, completed = self.state.get() if self.state.exists() else (0, float("nan"), False)
            rows = pd.concat(list(frames)).sort_values(["ts", "message_uid"])
            out = []
            for ts, uid, starts, completes in rows[["ts", "message_uid", "starts", "completes"]].itertuples(index=False):
                apart = ts - last
                if apart > gap or (completed and starts and apart > restart_gap):
                    segment, completed = segment + 1, False
                completed, last = completed or bool(completes), ts
                out.append((k[0], uid, segment))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(int((last + keep) * 1000), timers.getCurrentWatermarkInMs() + 1))
            self.state.update((segment, float(last), bool(completed)))
            yield pd.DataFrame(out, columns=[key, "message_uid", "segment"])

        def handleExpiredTimer(self, k, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
            self.state.clear()
            yield pd.DataFrame({key: pd.Series(dtype=str), "message_uid": pd.Series(dtype="int64"), "segment": pd.Series(dtype="int32")})

        def close(self) -> None:
            pass

    conf = messages.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass"):
        conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = messages.withWatermark("event_time", delay).select(key, "event_time", "ts", "message_uid", start_marker(F.col("message")).alias("starts"), completion_marker(F.col("message")).alias("completes"))
    return marked.groupBy(key).transformWithStateInPandas(Segments(), f"{key} string, message_uid long, segment int", "Append", "EventTime")
