"""Snapshots, training rows, targets and the retraining decision over scored sessions of the signalling view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import evaluation as E
from sigweave.operators import feedback as B
from sigweave.queries import evaluation
from sigweave.queries.details import SCORED_SQL, scored
from sigweave.queries.rca import KEYS


def snapshots(s, d):
    x = F.col("session_snapshot")
    return B.snapshots(scored(s, d), KEYS).select(*KEYS, x["rca_label"].alias("rca_label"), x["confidence_pct"].alias("confidence_pct"), x["priority_score"].alias("priority_score"), *[x["features"][c].alias(c) for c in ("dia_failure_count", "cross_protocol_hops", "timer_anomaly_count", "protocol_count")])


def _records(s, d) -> DataFrame:
    """Reviews of all sessions: approved if the session has an even number of messages, another cause for one of three, no snapshot of single messages."""
    rows = scored(s, d).select(*KEYS, "messages")
    rows = rows.join(B.snapshots(scored(s, d), KEYS), KEYS)
    n = F.col("messages")
    none = F.lit(None).cast("string")
    return rows.select("session_id", F.when(n % 2 == 0, "Approve").otherwise("reject").alias("review_action"), F.when(n % 3 == 0, "MANUAL").alias("resolved_root_cause"), none.alias("hybrid_root_cause"), none.alias("knowledge_root_cause"), none.alias("rule_root_cause"), F.when(n > 1, F.col("session_snapshot")).alias("session_snapshot"))


def training_sessions(s, d):
    return B.training_sessions(_records(s, d)).select("session_id", "rca_label", "priority_score", F.round("priority_label", 3).alias("priority_label"), "confidence_label")


def calibration_rows(s, d):
    return B.calibration_rows(B.training_sessions(_records(s, d))).groupBy("score", "label").agg(F.count("*").alias("n"))


TRAINING_SQL = SCORED_SQL + """, tr AS (
  SELECT session_id, CASE WHEN messages % 3 = 0 THEN 'MANUAL' ELSE rca_label END AS rca_label, confidence_pct, priority_score, CASE WHEN messages % 2 = 0 THEN priority_score ELSE least(99, greatest(priority_score, 82)) END AS priority_label, CAST(messages % 2 = 0 AS INT) AS confidence_label FROM sc WHERE messages > 1
)"""


def _cases(s, d) -> DataFrame:
    n = F.col("id")
    return s.range(10).select(F.concat(F.lit("cap-"), n.cast("string")).alias("case"), F.when(n % 3 == 0, "normal_call").when(n % 3 == 1, "USER_BUSY").alias("dominant_label"), F.when(n % 2 == 0, 0).alias("max_unknown"), F.when(n == 1, F.create_map(F.lit("CHARGING_FAILURE"), F.lit(1))).alias("required_labels"))


def _by_case(s, d) -> DataFrame:
    return scored(s, d).withColumnRenamed("capture_id", "case").select("case", "session_id", "rca_label", "priority_score", "confidence_pct")


def ranking_targets(s, d):
    return B.ranking_targets(_by_case(s, d), _cases(s, d)).select("case", "session_id", "priority_label")


def calibration_labels(s, d):
    return B.calibration_labels(_by_case(s, d), _cases(s, d)).select("case", "session_id", "confidence_label")


def benchmark_summary(s, d):
    metrics = E.case_metrics(evaluation._actual(s, d), ["case"], evaluation.expected_matching(s, d))
    return B.benchmark_summary(metrics, evaluation.case_gates(s, d)).withColumn("pass_rate", F.round("pass_rate", 6))


def retraining_decision(s, d):
    return B.retraining_decision(B.training_sessions(_records(s, d)), evaluation.drift(s, d))


_DRIFT = next(sql for name, _, sql in evaluation.QUERIES if name == "m31_drift_report")
QUERIES = [
    ("r22_snapshots", snapshots, f"WITH {SCORED_SQL} SELECT capture_id, session_id, rca_label, CAST(confidence_pct AS DOUBLE) AS confidence_pct, priority_score, CAST(dia_failures AS DOUBLE) AS dia_failure_count, CAST(cross_protocol_hops AS DOUBLE) AS cross_protocol_hops, CAST(timer_anomaly_count AS DOUBLE) AS timer_anomaly_count, CAST(protocol_count AS DOUBLE) AS protocol_count FROM sc"),
    ("m40_feedback_training", training_sessions, f"WITH {TRAINING_SQL} SELECT session_id, rca_label, priority_score, CAST(round(priority_label, 3) AS DOUBLE) AS priority_label, confidence_label FROM tr"),
    ("m37_calibration_rows", calibration_rows, f"WITH {TRAINING_SQL} SELECT confidence_pct / 100 AS score, confidence_label AS label, count(*) AS n FROM tr GROUP BY 1, 2"),
    ("m14_ranking_targets", ranking_targets, f"WITH {SCORED_SQL} SELECT capture_id AS \"case\", session_id, CAST(least(99, greatest(priority_score, CASE WHEN i % 3 = 0 AND rca_label = 'NORMAL_CALL' THEN 35 WHEN i % 3 = 1 AND rca_label = 'USER_BUSY' THEN 80 ELSE 0 END, CASE WHEN rca_label = 'UNKNOWN' AND i % 2 = 0 THEN 82 ELSE 0 END)) AS DOUBLE) AS priority_label FROM (SELECT *, CAST(substr(capture_id, 5) AS INT) AS i FROM sc)"),
    ("m18_calibration_labels", calibration_labels, f"WITH {SCORED_SQL}, x AS (SELECT capture_id AS \"case\", session_id, CASE WHEN i % 3 = 2 THEN CAST(rca_label <> 'UNKNOWN' AS INT) WHEN (i % 3 = 0 AND rca_label = 'NORMAL_CALL') OR (i % 3 = 1 AND rca_label = 'USER_BUSY') OR (i = 1 AND rca_label = 'CHARGING_FAILURE') THEN 1 WHEN rca_label = 'UNKNOWN' AND i % 2 = 0 THEN 0 END AS confidence_label FROM (SELECT *, CAST(substr(capture_id, 5) AS INT) AS i FROM sc)) SELECT * FROM x WHERE confidence_label IS NOT NULL"),
    ("a39_benchmark_summary", benchmark_summary, f"WITH {evaluation._GATE}, me AS (SELECT round(avg(abnormal_priority), 2) AS abnormal_priority, round(avg(avg_confidence), 2) AS avg_confidence, round(avg(avg_confidence * 0.5), 2) AS avg_priority FROM xf) SELECT passed, failed, missing, cases, pass_rate, abnormal_priority, avg_priority, avg_confidence FROM (SELECT count(*) FILTER (len(r) = 0) AS passed, count(*) FILTER (len(r) > 0) AS failed, count(*) FILTER (missing) AS missing, count(*) AS cases, round(avg(CAST(len(r) = 0 AS INT)), 6) AS pass_rate FROM gt), me"),
    ("m32_retraining_decision", retraining_decision, f"WITH {TRAINING_SQL} SELECT n >= 3 AND bad = 0 AS retrain, CASE WHEN n < 3 THEN 'insufficient_feedback_samples' WHEN bad > 0 THEN 'feedback_drift_exceeds_limit' ELSE 'ready' END AS reason, n AS samples FROM (SELECT count(*) AS n FROM tr), (SELECT count(*) FILTER (NOT passed) AS bad FROM ({_DRIFT}))"),
]
