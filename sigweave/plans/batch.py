"""The batch job: messages of any number of captures to labelled sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import rules, seeds, sessions


def sessionize(messages: DataFrame, gap: float = 15.0, key: str = "imsi") -> DataFrame:
    """Adds session_id: the key, cut at gaps."""
    cut = seeds.gap_segments(messages.where(F.col(key).isNotNull()), ["capture_id", key], gap)
    return cut.withColumn("session_id", seeds.segment_id(F.col(key), F.col("segment")))


def labelled(messages: DataFrame, gap: float = 15.0, key: str = "imsi") -> DataFrame:
    """Session records with rule, label, severity, confidence and cross-layer root cause."""
    return rules.root_cause(rules.classify(sessions.refresh(sessionize(messages, gap, key))))
