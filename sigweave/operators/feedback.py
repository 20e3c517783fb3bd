"""From reviews back to models: snapshots, training rows, targets, the retraining decision, promotion.

A review record has session_id, review_action, resolved_root_cause, hybrid_root_cause, knowledge_root_cause, rule_root_cause and
the struct session_snapshot of ``snapshots``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators import evaluation, models

# Features that a snapshot keeps, and least priorities of targets.
SNAPSHOT_FEATURES = ["duration_ms", "time_to_failure_ms", "dia_failure_count", "charging_failed_flag", "auth_failed_dia", "cross_protocol_hops", "timer_anomaly_count", "has_retransmission", "sip_4xx", "sip_5xx", "q850_network_fail", "protocol_count", "technology_count"]
REJECTED_FLOOR, UNKNOWN_FLOOR, FAILURE_FLOOR, NORMAL_FLOOR, HIGHEST = 82.0, 82.0, 80.0, 35.0, 99.0


def _have(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def snapshots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, session_snapshot): what a reviewer saw of a session. rows: scored sessions with features."""
    kept = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SNAPSHOT_FEATURES])
    confidence = F.coalesce(F.col("confidence_pct").cast("double"), F.lit(0.0))
    return rows.select(*keys, F.struct(
        F.col("session_id"), F.col("protocols"), F.col("technologies"), F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"), F.col("rca_label"), confidence.alias("confidence_pct"), _have(rows, "raw_confidence_pct", confidence).alias("raw_confidence_pct"),
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"), F.coalesce("priority_band", F.lit("low")).alias("priority_band"), F.coalesce("priority_reason", F.lit("baseline inspection")).alias("priority_reason"), kept.alias("features"),
    ).alias("session_snapshot"))


def training_sessions(records: DataFrame) -> DataFrame:
    """A training row for each review with a snapshot: the label is the first one present of reviewer, snapshot, fusion, memory and rules.

    An approved session keeps its priority and is a positive for calibration; any other one is a negative of priority 82 at least."""
    s = F.col("session_snapshot")
    approved = F.coalesce(F.lower("review_action") == "approve", F.lit(False))
    label = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("resolved_root_cause"), s["rca_label"], F.col("hybrid_root_cause"), F.col("knowledge_root_cause"), F.col("rule_root_cause"))], F.lit("UNKNOWN"))
    priority = F.coalesce(s["priority_score"], F.lit(0.0))
    return records.where("session_snapshot is not null").select(
        F.coalesce(F.nullif(s["session_id"], F.lit("")), "session_id").alias("session_id"), s["protocols"].alias("protocols"), s["technologies"].alias("technologies"), F.coalesce(s["duration_ms"], F.lit(0.0)).alias("duration_ms"), label.alias("rca_label"),
        F.coalesce(s["confidence_pct"], F.lit(0.0)).alias("confidence_pct"), F.coalesce(s["raw_confidence_pct"], s["confidence_pct"], F.lit(0.0)).alias("raw_confidence_pct"), priority.alias("priority_score"), s["features"].alias("features"),
        F.when(approved, priority).otherwise(F.least(F.lit(HIGHEST), F.greatest(priority, F.lit(REJECTED_FLOOR)))).alias("priority_label"), approved.cast("int").alias("confidence_label"),
    )


def calibration_rows(rows: DataFrame) -> DataFrame:
    """(score, label) for the calibrator: raw confidence as a share between 0 and 1; rows without a label go."""
    raw = F.coalesce(F.col("raw_confidence_pct"), F.col("confidence_pct"), F.lit(0.0)).cast("double")
    return rows.where("confidence_label is not null").select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / 100)).alias("score"), F.col("confidence_label").cast("boolean").cast("int").alias("label"))


def ranking_targets(sessions: DataFrame, cases: DataFrame, case: str = "case") -> DataFrame:
    """Sessions of benchmark cases with priority_label: raised to 80 (to 35 if normal) where the label is the expected one, to 82 where it is unknown and none may be."""
    label = F.upper(F.coalesce("rca_label", F.lit("UNKNOWN")))
    rows = sessions.join(cases.select(case, F.upper("dominant_label").alias("_dominant"), F.col("max_unknown").alias("_most")), case)
    score = F.coalesce(F.col("priority_score").cast("double"), F.lit(0.0))
    expected = F.when(label == F.col("_dominant"), F.when(label == "NORMAL_CALL", NORMAL_FLOOR).otherwise(FAILURE_FLOOR))
    unknown = F.when((label == "UNKNOWN") & (F.col("_most") == 0), UNKNOWN_FLOOR)
    return rows.withColumn("priority_label", F.least(F.lit(HIGHEST), F.greatest(score, expected, unknown))).drop("_dominant", "_most")


def calibration_labels(sessions: DataFrame, cases: DataFrame, case: str = "case") -> DataFrame:
    """Sessions of benchmark cases with confidence_label: 1 for a label that the case expects, 0 for an unknown one where none may be; others say nothing and go.

    A case that expects no label takes every known one as right."""
    label = F.upper(F.coalesce("rca_label", F.lit("UNKNOWN")))
    required = F.transform(F.map_keys("required_labels"), F.upper) if "required_labels" in cases.columns else F.array().cast("array<string>")
    wanted = F.array_distinct(F.array_compact(F.concat(F.coalesce(required, F.array().cast("array<string>")), F.array(F.nullif(F.upper("dominant_label"), F.lit(""))))))
    rows = sessions.join(cases.select(case, wanted.alias("_wanted"), F.col("max_unknown").alias("_most")), case)
    told = F.when(F.size("_wanted") == 0, (label != "UNKNOWN").cast("int")).when(F.array_contains("_wanted", label), 1).when((label == "UNKNOWN") & (F.col("_most") == 0), 0)
    return rows.withColumn("confidence_label", told).where("confidence_label is not null").drop("_wanted", "_most")


def benchmark_summary(metrics: DataFrame, gated: DataFrame) -> DataFrame:
    """One row for a run of the suite: share and numbers of passed, failed and missing cases, and means over the cases that have sessions."""
    means = metrics.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2).alias(c) for c in ("abnormal_priority", "avg_priority", "avg_confidence")])
    return evaluation.suite(gated).join(F.broadcast(means))


def evaluate_artifacts(sessions: DataFrame, cases: DataFrame, model: PipelineModel | None, features: list[str]) -> DataFrame:
    """benchmark_summary of the suite under a ranking model; without a model, under the heuristic priority."""
    metrics = evaluation.case_metrics(models.blended_priority(sessions, model, features), ["case"])
    return benchmark_summary(metrics, evaluation.case_gate(metrics, cases))


def retraining_decision(training: DataFrame, drift: DataFrame, least: int = 3) -> DataFrame:
    """One row: retrain, reason, samples. Too few rows, or a check of the drift report that failed, stop it."""
    bad = drift.agg(F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("_bad"))
    reason = F.when(F.col("samples") < least, "insufficient_feedback_samples").when(F.col("_bad") > 0, "feedback_drift_exceeds_limit").otherwise("ready")
    return training.agg(F.count("*").alias("samples")).join(F.broadcast(bad)).select((reason == "ready").alias("retrain"), reason.alias("reason"), "samples")


def promote(model, path: str) -> None:
    """Puts a candidate where the live model is read from."""
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str, kind=PipelineModel):
    """The model at a path, or None if there is none; any other fault is raised."""
    try:
        spark.read.text(f"{path}/metadata").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return kind.load(path)


def retrain(records: DataFrame, baseline: DataFrame, evaluate: Callable[[PipelineModel | None], DataFrame], live: str, least: int = 3, features: list[str] | None = None) -> dict:
    """Trains a ranker on reviews and promotes it if the suite is no worse under it.

    baseline: labelled sessions that the drift is measured against; evaluate: the summary of a model (``evaluate_artifacts``); live: where the model in use is.
    Only one-row tables reach the driver."""
    names = features or SNAPSHOT_FEATURES
    training = training_sessions(records)
    decided = retraining_decision(training, evaluation.drift_report(baseline, training), least).first()
    if not decided["retrain"]:
        return {"retrained": False, "promoted": False, "reason": decided["reason"], "samples": decided["samples"]}
    rows = training.select("priority_label", *[F.col(f"features.{c}").alias(c) for c in names])
    candidate = models.train_ranker(rows, names, "priority_label")
    current = evaluate(load(baseline.sparkSession, live))
    gate = evaluation.promotion_gate(current.select("pass_rate", "failed", "abnormal_priority"), evaluate(candidate).select("pass_rate", "failed", "abnormal_priority")).first()
    if gate["promote"]:
        promote(candidate, live)
    return {"retrained": True, "promoted": gate["promote"], "reason": gate["reasons"] or "no worse", "samples": decided["samples"]}
