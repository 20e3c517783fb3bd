"""Sessions, rules, hypotheses, chains and fusion over the signalling view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators import rules, sessions
from sigweave.plans.batch import labelled, sessionize
from sigweave.plans.testviews import GAP, MESSAGES_SQL, SEGMENTS_SQL, SESSIONS_SQL, messages

KEYS = ["capture_id", "session_id"]


def segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessionize(messages(spark, folder), GAP)
    return rows.select("capture_id", "imsi", "frame_number", "segment", "session_id")


def session_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.refresh(sessionize(messages(spark, folder), GAP))
    return rows.select(*KEYS, "start_ts", "end_ts", "messages", F.array_join("protocols", ",").alias("protocols"), F.array_join("technologies", ",").alias("technologies"), "final_sip_code", "failure_ts", "invites", "has_invite", "has_bye", "has_cancel", "has_180", "has_200", "sip_count", "dia_count", "gtp_count", "http_count")


def rca_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(messages(spark, folder), GAP).select(*KEYS, "rule_id", "rca_label", "severity", F.col("confidence_pct").cast("int").alias("confidence_pct"))


def rca_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """The root-cause distribution of each capture."""
    rows = labelled(messages(spark, folder), GAP)
    return rows.groupBy("capture_id", "rca_label").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"))


def rca_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution per capture with totals of captures and of the corpus."""
    rows = labelled(messages(spark, folder), GAP)
    return rows.rollup("capture_id", "rca_label").agg(F.count("*").alias("sessions"))


def cross_layer_cause(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(messages(spark, folder), GAP)
    return rows.select(*KEYS, "root_cause", "correlation_confidence", F.size("contributing_factors").alias("factors"))


def session_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Merged flow in time order with the dialog segment of each message."""
    rows = sessions.flow(sessionize(messages(spark, folder), GAP))
    return rows.select(*KEYS, "seq", "dialog", "frame_number", "protocol")


def flow_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.refresh(sessionize(messages(spark, folder), GAP)).select(*KEYS, "flow", "first_message", "last_message")


def agent_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    return rules.hypotheses(labelled(messages(spark, folder), GAP), KEYS).select(*KEYS, "agent", "label", "confidence")


HYPOTHESES_SQL = SESSIONS_SQL + """, hyp AS (
  SELECT capture_id, session_id, 'gtp' AS agent, 0 AS agent_rank, CASE WHEN core_failures > 0 THEN 'CORE_NETWORK_FAILURE' WHEN core_successes > 0 THEN 'NORMAL_CALL' ELSE 'UNKNOWN' END AS label,
    CASE WHEN core_failures > 0 THEN 0.78 WHEN core_successes > 0 THEN 0.74 ELSE 0.4 END::DOUBLE AS confidence FROM ss WHERE gtp_count > 0
  UNION ALL SELECT capture_id, session_id, 'diameter', 1, CASE WHEN roaming_denied OR auth_failed THEN 'SUBSCRIBER_BARRED' WHEN charging_failed THEN 'CHARGING_FAILURE' ELSE 'NORMAL_CALL' END,
    CASE WHEN roaming_denied THEN 0.94 WHEN auth_failed THEN 0.9 WHEN charging_failed THEN 0.86 ELSE 0.45 END::DOUBLE FROM ss WHERE dia_count > 0
  UNION ALL SELECT capture_id, session_id, 'nas', 2, CASE WHEN nas_failures > 0 THEN 'NETWORK_REJECTION' ELSE 'NORMAL_CALL' END, CASE WHEN nas_failures > 0 THEN 0.84 ELSE 0.7 END::DOUBLE FROM ss WHERE nas_failures + nas_successes > 0
  UNION ALL SELECT capture_id, session_id, 'sip', 3, CASE WHEN final_sip_code = '487' THEN 'USER_REJECTED' WHEN final_sip_code = '486' THEN 'USER_BUSY' ELSE 'UNKNOWN' END,
    CASE WHEN final_sip_code IN ('487', '486') THEN 0.82 ELSE 0.45 END::DOUBLE FROM ss WHERE sip_count > 0
)"""


def agent_vote(spark: SparkSession, folder: str) -> DataFrame:
    rows = rules.vote(rules.hypotheses(labelled(messages(spark, folder), GAP), KEYS), KEYS)
    return rows.select(*KEYS, "top_label", "top_confidence", F.round("consensus", 6).alias("consensus"), "is_conflicted")


VOTE_SQL = HYPOTHESES_SQL + """, ranked AS (
  SELECT *, row_number() OVER w AS rank, first(label) OVER w AS top FROM hyp WINDOW w AS (PARTITION BY capture_id, session_id ORDER BY confidence DESC, agent_rank)
), voted AS (
  SELECT capture_id, session_id, max(label) FILTER (rank = 1) AS top_label, max(confidence) AS top_confidence, sum(confidence) FILTER (label = top) / count(*) AS consensus,
    coalesce(max(confidence) - max(confidence) FILTER (rank = 2 AND label <> top) <= 0.18, false) AS is_conflicted FROM ranked GROUP BY 1, 2
)"""


def chain(spark: SparkSession, folder: str) -> DataFrame:
    return rules.event_chain(sessionize(messages(spark, folder), GAP), KEYS, window=6 * 3600.0)


CHAIN_SQL = SEGMENTS_SQL + """, ch AS (
  SELECT *, upper(protocol || ':' || message) AS event, ts - lag(ts) OVER w AS gap, lag(upper(protocol || ':' || message)) OVER w AS event_from FROM s WINDOW w AS (PARTITION BY capture_id, session_id ORDER BY ts, frame_number)
), cw AS (
  SELECT *, CASE WHEN event_from IS NOT NULL THEN least(0.99, greatest(0.05, exp(-greatest(gap, 0) / 21600))) END AS weight FROM ch
), cs AS (
  SELECT *, least(0.99, 0.2 + CASE WHEN is_failure THEN 0.45 ELSE 0 END + CASE WHEN protocol IN ('DIAMETER', 'GTP', 'NAS_5GS', 'SIP') THEN 0.1 ELSE 0 END + least(0.25, coalesce(weight * 0.4, 0))) AS score FROM cw
)"""


def event_chain(spark: SparkSession, folder: str) -> DataFrame:
    return chain(spark, folder).select(*KEYS, "frame_number", "event", "event_from", F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score"))


def causal_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The five events of highest causal score of each session."""
    return rules.top_events(chain(spark, folder).withColumn("score", F.round("score", 9)), KEYS, 5).select(*KEYS, "rank", "event", "score")


def confidence_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Rule, causal and agent evidence fused to one label and confidence per session."""
    rows = labelled(messages(spark, folder), GAP)
    votes = rules.vote(rules.hypotheses(rows, KEYS), KEYS)
    top = rules.top_events(chain(spark, folder).withColumn("score", F.round("score", 9)), KEYS, 1)
    causal = top.join(rows.select(*KEYS, "rca_label"), KEYS).join(votes.select(*KEYS, "top_label"), KEYS, "left").select(*KEYS, F.lit("causal").alias("source"), rules.event_label(F.col("event"), F.coalesce("top_label", "rca_label")).alias("label"), F.col("score").alias("strength"))
    evidence = rows.select(*KEYS, F.lit("rule").alias("source"), F.col("rca_label").alias("label"), (F.col("confidence_pct") / 100).alias("strength"))
    evidence = evidence.unionByName(causal).unionByName(votes.select(*KEYS, F.lit("agents").alias("source"), F.col("top_label").alias("label"), F.col("consensus").alias("strength")))
    facts = rows.select(*KEYS, F.lit(None).cast("double").alias("historical_success"), F.lit(None).cast("double").alias("anomaly_score"))
    fused = rules.fuse(evidence.withColumn("strength", F.round("strength", 9)), facts, KEYS)
    return fused.select(*KEYS, "final_label", F.round("confidence", 6).alias("confidence"), F.round("uncertainty", 6).alias("uncertainty"))


FUSION_SQL = VOTE_SQL + CHAIN_SQL.removeprefix(SEGMENTS_SQL) + """, topev AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY round(score, 9) DESC, ts, frame_number) AS rank FROM cs) WHERE rank = 1
), ev AS (
  SELECT capture_id, session_id, rca_label AS label, 0.4 * (confidence_pct / 100) AS part FROM rca
  UNION ALL SELECT t.capture_id, t.session_id, CASE WHEN t.event LIKE '%DIAMETER%' AND regexp_matches(t.event, '5004|ROAMING|5003|REJECT|BARRED|AUTH') THEN 'SUBSCRIBER_BARRED' WHEN t.event LIKE '%DIAMETER%' AND regexp_matches(t.event, '4012|CREDIT|LIMIT') THEN 'CHARGING_FAILURE'
    WHEN t.event LIKE '%NAS%' AND regexp_matches(t.event, 'REJECT|FAIL') THEN 'NETWORK_REJECTION' WHEN t.event LIKE '%SIP%' AND regexp_matches(t.event, '487|603') THEN 'USER_REJECTED' WHEN t.event LIKE '%SIP%' AND regexp_matches(t.event, '408|504|TIMEOUT') THEN 'SERVICE_TIMEOUT'
    ELSE coalesce(v.top_label, r.rca_label) END, 0.2 * round(t.score, 9)
  FROM topev t JOIN rca r USING (capture_id, session_id) LEFT JOIN voted v USING (capture_id, session_id)
  UNION ALL SELECT capture_id, session_id, top_label, 0.15 * round(consensus, 9) FROM voted
), sums AS (
  SELECT capture_id, session_id, label, sum(part) AS score FROM ev GROUP BY 1, 2, 3
), rk AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY score DESC, label) AS rank FROM sums
), best AS (
  SELECT capture_id, session_id, max(label) FILTER (rank = 1) AS final_label, max(score) AS winner, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM rk GROUP BY 1, 2
)
SELECT capture_id, session_id, final_label, round(least(0.99, greatest(0.2, winner * 0.55 + 0.5 * 0.15 + (1 - greatest(0, 1 - least(1, (winner - second) * 2.5))) * 0.2 + 0.1)), 6) AS confidence,
  round(greatest(0, 1 - least(1, (winner - second) * 2.5)), 6) AS uncertainty FROM best"""

QUERIES = [
    ("sig_messages", lambda s, d: messages(s, d).select("capture_id", "frame_number", "ts", "protocol", "technology", "imsi", "call_id", "method", "status_code", "result_code", "cause_code", "message", "src_ip", "dst_ip", "framed_ip", "is_failure"),
     f"WITH {MESSAGES_SQL} SELECT capture_id, frame_number, ts, protocol, technology, imsi, call_id, method, status_code, result_code, cause_code, message, src_ip, dst_ip, framed_ip, is_failure FROM m"),
    ("w01_gap_segments", segments, f"WITH {SEGMENTS_SQL} SELECT capture_id, imsi, frame_number, segment, session_id FROM s"),
    ("a17_session_records", session_records, f"WITH {SESSIONS_SQL} SELECT capture_id, session_id, start_ts, end_ts, messages, array_to_string(protocols, ',') AS protocols, array_to_string(technologies, ',') AS technologies, final_sip_code, failure_ts, invites, has_invite, has_bye, has_cancel, has_180, has_200, sip_count, dia_count, gtp_count, http_count FROM ss"),
    ("r01_rule_cascade", rca_sessions, f"WITH {SESSIONS_SQL} SELECT capture_id, session_id, rule_id, rca_label, severity, confidence_pct FROM rca"),
    ("a25_rca_distribution", rca_distribution, f"WITH {SESSIONS_SQL} SELECT capture_id, rca_label, count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages FROM rca GROUP BY 1, 2"),
    ("a25_rca_rollup", rca_rollup, f"WITH {SESSIONS_SQL} SELECT capture_id, rca_label, count(*) AS sessions FROM rca GROUP BY ROLLUP (capture_id, rca_label)"),
    ("r08_cross_layer_cause", cross_layer_cause, f"WITH {SESSIONS_SQL} SELECT capture_id, session_id, coalesce(CASE WHEN http_5xx THEN 'NF_FAILURE' WHEN http_4xx THEN 'CLIENT_ERROR' END, CASE WHEN core_failures > 0 THEN 'CORE_NETWORK_FAILURE' END, CASE WHEN auth_failed THEN 'SUBSCRIBER_BARRED' WHEN dia_failures > 0 THEN 'CHARGING_FAILURE' END, rca_label) AS root_cause, "
     "CASE WHEN http_5xx OR http_4xx OR core_failures > 0 OR dia_failures > 0 THEN 90 ELSE 50 END AS correlation_confidence, CAST(http_5xx OR http_4xx AS INT) + CAST(core_failures > 0 AS INT) + CAST(dia_failures > 0 AS INT) AS factors FROM rca"),
    ("w04_session_flow", session_flow, f"WITH {SEGMENTS_SQL} SELECT capture_id, session_id, row_number() OVER w AS seq, nullif(CAST(sum(CASE WHEN method = 'INVITE' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT), 0) AS dialog, frame_number, protocol FROM s WINDOW w AS (PARTITION BY capture_id, session_id ORDER BY ts, family, frame_number)"),
    ("w06_flow_summary", flow_summary, f"WITH {SEGMENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY ts, family, frame_number) AS seq, coalesce(message, protocol) AS token FROM s), f AS (SELECT capture_id, session_id, token, min(seq) AS seq FROM o GROUP BY 1, 2, 3), "
     "ft AS (SELECT capture_id, session_id, token, seq, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY seq) AS place FROM f) "
     "SELECT ft.capture_id, ft.session_id, string_agg(token, ' → ' ORDER BY ft.seq) FILTER (place <= 10) AS flow, any_value(x.first_message) AS first_message, any_value(x.last_message) AS last_message FROM ft JOIN (SELECT capture_id, session_id, arg_min(message, seq) AS first_message, arg_max(message, seq) AS last_message FROM o GROUP BY 1, 2) x USING (capture_id, session_id) GROUP BY 1, 2"),
    ("r09_hypotheses", agent_hypotheses, f"WITH {HYPOTHESES_SQL} SELECT capture_id, session_id, agent, label, confidence FROM hyp"),
    ("r10_agent_vote", agent_vote, f"WITH {VOTE_SQL} SELECT capture_id, session_id, top_label, top_confidence, round(consensus, 6) AS consensus, is_conflicted FROM voted"),
    ("w13_event_chain", event_chain, f"WITH {CHAIN_SQL} SELECT capture_id, session_id, frame_number, event, event_from, round(weight, 6) AS weight, round(score, 6) AS score FROM cs"),
    ("r11_causal_chain", causal_chain, f"WITH {CHAIN_SQL} SELECT capture_id, session_id, CAST(rank AS INT) AS rank, event, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY round(score, 9) DESC, ts, frame_number) AS rank FROM cs) WHERE rank <= 5"),
    ("r13_confidence_fusion", confidence_fusion, f"WITH {FUSION_SQL}"),
]
