"""Features, embeddings, anomaly and priority of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators import rules, scoring
from sigweave.plans.batch import labelled, sessionize
from sigweave.plans.testviews import GAP, SEGMENTS_SQL, messages
from sigweave.queries.rca import KEYS, VOTE_SQL

SLOW_MS = 3_600_000.0


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = messages(spark, folder)
    return scoring.features(labelled(rows, GAP), scoring.hops(sessionize(rows, GAP), KEYS, SLOW_MS), KEYS)


def session_hops(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.hops(sessionize(messages(spark, folder), GAP), KEYS, SLOW_MS)
    return rows.select(*KEYS, "cross_protocol_hops", "timer_anomaly_count", F.array_join("sequence", ">").alias("sequence"))


def protocol_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.transitions(sessionize(messages(spark, folder), GAP), KEYS)


FEATURES_SQL = VOTE_SQL + """, ph AS (
  SELECT *, lag(protocol) OVER w AS before, (ts - lag(ts) OVER w) * 1000 AS gap_ms, row_number() OVER w AS seq FROM s WINDOW w AS (PARTITION BY capture_id, session_id ORDER BY ts, frame_number)
), hp AS (
  SELECT capture_id, session_id, count(*) FILTER (before <> protocol) AS cross_protocol_hops, count(*) FILTER (gap_ms >= 3600000) AS timer_anomaly_count, string_agg(protocol || ':' || message, '>' ORDER BY seq) FILTER (seq <= 40) AS sequence, count(*) FILTER (seq <= 40) AS sequence_length FROM ph GROUP BY 1, 2
), ft AS (
  SELECT r.*, hp.cross_protocol_hops, hp.timer_anomaly_count, hp.sequence, hp.sequence_length,
    CAST(coalesce(final_sip_code IN ('486', '480', '487'), false) AS INT) AS sip_4xx, CAST(has_200 AND NOT has_bye AS INT) AS missing_bye, CAST(NOT has_cancel AND coalesce(final_sip_code = '487', false) AS INT) AS missing_cancel,
    CAST(invites > 1 AS INT) AS has_retransmission, len(protocols) AS protocol_count, len(technologies) AS technology_count, CAST(rca_label = 'UNKNOWN' AS INT) AS is_unknown,
    round((end_ts - start_ts) * 1000, 3) AS duration_ms,
    CASE WHEN list_contains(protocols, 'SIP') AND list_contains(protocols, 'NAS_5GS') THEN 'VoNR' WHEN list_contains(protocols, 'SIP') THEN 'VoLTE' WHEN list_contains(protocols, 'GTP') THEN 'LTE data' WHEN list_contains(protocols, 'NAS_5GS') THEN '5G data' ELSE 'Other' END AS call_type
  FROM rca r JOIN hp USING (capture_id, session_id)
), an0 AS (
  SELECT *, least(1.0, has_retransmission * 0.45 + least(timer_anomaly_count, 4) * 0.12) AS transport, least(1.0, least(dia_failures, 4) * 0.2 + CAST(charging_failed AS INT) * 0.34 + CAST(auth_failed AS INT) * 0.24) AS charging,
    least(1.0, least(sip_4xx, 4) * 0.16 + least(cross_protocol_hops, 6) * 0.08 + least(sequence_length, 24) / 120 + is_unknown * 0.18) AS signaling,
    least(1.0, least(cross_protocol_hops, 6) * 0.06 + least(timer_anomaly_count, 4) * 0.06 + technology_count * 0.02) AS mobility_signal FROM ft
), an AS (
  SELECT *, least(1.0, (transport * 0.28 + charging * 0.32 + signaling * 0.22 + mobility_signal * 0.18) * 0.82) AS anomaly_score FROM an0
)"""


def session_features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_rows(spark, folder).select(*KEYS, "sip_4xx", "missing_bye", "missing_cancel", "has_retransmission", "protocol_count", "technology_count", "is_unknown", "dia_failure_count", "flow_length", "signature", F.round("duration_ms", 1).alias("duration_ms"))


def anomaly_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.anomaly(feature_rows(spark, folder)).select(*KEYS, F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomalous", F.round("transport", 6).alias("transport"), F.round("charging", 6).alias("charging"), F.round("signaling", 6).alias("signaling"), F.round("mobility_signal", 6).alias("mobility_signal"), "suggested_cause")


def priorities(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.anomaly(feature_rows(spark, folder))
    votes = rules.vote(rules.hypotheses(labelled(messages(spark, folder), GAP), KEYS), KEYS)
    return scoring.priority(rows.join(votes.select(*KEYS, "is_conflicted"), KEYS, "left")).select(*KEYS, F.round("priority_score", 3).alias("priority_score"), "priority_band")


def ranked_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 sessions of highest priority over all captures (the explorer's list)."""
    rows = scoring.priority(scoring.anomaly(feature_rows(spark, folder))).withColumn("priority_score", F.round("priority_score", 3))
    return rows.orderBy(F.desc("priority_score"), F.desc("confidence_pct"), "rca_label", *KEYS).limit(100).select(*KEYS, "priority_score", "rca_label")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.embedding(feature_rows(spark, folder), KEYS)
    return rows.select(*KEYS, F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"), F.array_join(F.transform("embedding", lambda x: F.format_string("%.3f", x)), " ").alias("vector"))


def explanations(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.explain(feature_rows(spark, folder), KEYS).select(*KEYS, "rca_label", "feature", F.round("contribution", 6).alias("contribution"))


PRIORITY_SQL = """round(greatest(0, least(99, 10 + CASE WHEN rca_label <> 'NORMAL_CALL' THEN 30 ELSE 0 END + CASE WHEN rca_label = 'UNKNOWN' THEN 16 ELSE 0 END
    + CASE WHEN rca_label <> 'NORMAL_CALL' OR severity = 'HIGH' THEN CASE severity WHEN 'HIGH' THEN 18 WHEN 'MEDIUM' THEN 12 ELSE 6 END ELSE 0 END
    + CASE WHEN rca_label <> 'NORMAL_CALL' THEN least(18, confidence_pct * 0.16) ELSE least(8, (100 - confidence_pct) * 0.08) END
    + CASE WHEN anomaly_score >= 0.55 THEN least(12, anomaly_score * 12) ELSE 0 END + CASE WHEN 1 - confidence_pct / 100 >= 0.35 THEN least(10, (1 - confidence_pct / 100) * 14) ELSE 0 END
    + {conflict} + least(6, timer_anomaly_count * 1.5) + has_retransmission * 5 + least(8, dia_failures * 2.0) + CASE WHEN cross_protocol_hops >= 2 THEN least(6, cross_protocol_hops * 0.8) ELSE 0 END)), 3)"""
_P = PRIORITY_SQL.format(conflict="CASE WHEN coalesce(is_conflicted, false) THEN 8 ELSE 0 END")
_P0 = PRIORITY_SQL.format(conflict="0")

QUERIES = [
    ("w10_cross_protocol_hops", session_hops, f"WITH {FEATURES_SQL} SELECT capture_id, session_id, cross_protocol_hops, timer_anomaly_count, sequence FROM hp"),
    ("w10_protocol_transitions", protocol_transitions, f"WITH {FEATURES_SQL} SELECT before AS protocol_from, protocol AS protocol_to, count(*) AS n FROM ph WHERE before <> protocol GROUP BY 1, 2"),
    ("m01_session_features", session_features, f"WITH {FEATURES_SQL} SELECT f.capture_id, f.session_id, sip_4xx, missing_bye, missing_cancel, has_retransmission, protocol_count, technology_count, is_unknown, dia_failures AS dia_failure_count, least(10, x.n) AS flow_length, call_type || '|' || coalesce(final_sip_code, 'NA') || '|' || array_to_string(protocols, '/') AS signature, round(duration_ms, 1) AS duration_ms "
     "FROM ft f JOIN (SELECT capture_id, session_id, count(DISTINCT message) AS n FROM s GROUP BY 1, 2) x USING (capture_id, session_id)"),
    ("m07_anomaly_score", anomaly_scores, f"WITH {FEATURES_SQL} SELECT capture_id, session_id, CAST(round(anomaly_score, 6) AS DOUBLE) AS anomaly_score, anomaly_score >= 0.55 AS is_anomalous, CAST(round(transport, 6) AS DOUBLE) AS transport, CAST(round(charging, 6) AS DOUBLE) AS charging, CAST(round(signaling, 6) AS DOUBLE) AS signaling, CAST(round(mobility_signal, 6) AS DOUBLE) AS mobility_signal, "
     "CASE WHEN charging_failed OR dia_failures >= 2 THEN 'CHARGING_FAILURE' WHEN auth_failed THEN 'SUBSCRIBER_BARRED' WHEN has_retransmission > 0 THEN 'CORE_NETWORK_FAILURE' WHEN cross_protocol_hops >= 3 AND timer_anomaly_count >= 2 THEN 'NETWORK_CONGESTION' ELSE rca_label END AS suggested_cause FROM an"),
    ("m10_priority", priorities, f"WITH {FEATURES_SQL}, pr AS (SELECT *, CAST({_P} AS DOUBLE) AS priority_score FROM an LEFT JOIN voted USING (capture_id, session_id)) SELECT capture_id, session_id, priority_score, CASE WHEN priority_score >= 80 THEN 'critical' WHEN priority_score >= 60 THEN 'high' WHEN priority_score >= 35 THEN 'medium' ELSE 'low' END AS priority_band FROM pr"),
    ("k02_priority_rank", ranked_sessions, f"WITH {FEATURES_SQL} SELECT capture_id, session_id, CAST({_P0} AS DOUBLE) AS priority_score, rca_label FROM an ORDER BY {_P0} DESC, confidence_pct DESC, rca_label, capture_id, session_id LIMIT 100"),
    ("m04_session_embedding", embeddings, None),
    ("m27_explanations", explanations, f"WITH {FEATURES_SQL}, w(label, feature, weight) AS (VALUES ('CHARGING_FAILURE', 'charging_failed_flag', 0.6), ('CHARGING_FAILURE', 'dia_failure_count', 0.25), ('SUBSCRIBER_BARRED', 'auth_failed_dia', 0.6), ('USER_BUSY', 'sip_486', 0.7), ('SUBSCRIBER_UNREACHABLE', 'sip_480', 0.6), ('USER_ABORT', 'sip_487', 0.5), ('NORMAL_CALL', 'sip_200', 0.5), ('SERVICE_TIMEOUT', 'failure_timeout', 0.4), ('UNKNOWN', 'is_unknown', 0.3)), "
     "lg AS (SELECT capture_id, session_id, rca_label, unnest(['charging_failed_flag', 'dia_failure_count', 'auth_failed_dia', 'sip_486', 'sip_480', 'sip_487', 'sip_200', 'failure_timeout', 'is_unknown']) AS feature, unnest([CAST(charging_failed AS INT), dia_failures, CAST(auth_failed AS INT), CAST(coalesce(final_sip_code = '486', false) AS INT), CAST(coalesce(final_sip_code = '480', false) AS INT), CAST(coalesce(final_sip_code = '487', false) AS INT), CAST(coalesce(final_sip_code = '200', false) AS INT), CAST(coalesce((failure_ts - start_ts) * 1000 > 15000, false) AS INT), is_unknown]) AS value FROM ft) "
     "SELECT capture_id, session_id, rca_label, lg.feature, CAST(round(value * weight, 6) AS DOUBLE) AS contribution FROM lg JOIN w ON w.label = rca_label AND w.feature = lg.feature WHERE value <> 0"),
]
