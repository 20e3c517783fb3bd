"""Capture analytics over the signalling view."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigweave.functions import codes
from sigweave.operators import analytics as A
from sigweave.plans.batch import labelled, sessionize
from sigweave.plans.testviews import GAP, MESSAGES_SQL, SESSIONS_SQL, messages

KEYS = ["capture_id", "session_id"]


def _labelled(s, d):
    return labelled(messages(s, d), GAP)


def _summary(s, d):
    return A.capture_summary(messages(s, d), _labelled(s, d))


def capture_summary(s, d):
    return _summary(s, d).select("capture_id", "messages", "failures", "tech_ims", "tech_http", "tech_core", "tech_lte", "tech_5g", "sessions", "normal", "unknown", F.round("avg_confidence", 4).alias("avg_confidence"))


def protocol_breakdown(s, d):
    return A.protocol_breakdown(messages(s, d)).withColumn("percent", F.round("percent", 4))


def capture_window(s, d):
    return A.capture_window(messages(s, d)).withColumn("duration", F.round("duration", 3))


def corpus_audit(s, d):
    return A.corpus_audit(_labelled(s, d)).withColumn("protocols", F.array_join("protocols", ","))


def protocol_share(s, d):
    return A.protocol_share(messages(s, d)).withColumn("share", F.round("share", 6))


def expert_findings(s, d):
    return A.expert_findings(_summary(s, d), A.error_analysis(messages(s, d)))


def findings(s, d):
    rows = sessionize(messages(s, d), GAP).withColumn("code", F.coalesce("status_code", "result_code", "cause_code"))
    return A.protocol_findings(codes.interpret(rows), KEYS).select(*KEYS, "protocol", "family", "recommended_label", "n")


def parties(s, d):
    return A.parties(sessionize(messages(s, d), GAP), KEYS)


def session_filter(s, d):
    return A.session_filter(_labelled(s, d), "FAILED", "SIP", "busy").select(*KEYS, "rca_label", "confidence_pct")


def compact_repeats(s, d):
    rows = messages(s, d)
    return A.compact_repeats(rows, ["capture_id"], "message", F.struct("ts", "frame_number"))


_SUMMARY_SQL = SESSIONS_SQL + """, sm AS (
  SELECT capture_id, count(*) AS messages, count(*) FILTER (is_failure) AS failures, count(*) FILTER (technology = 'IMS') AS tech_ims, count(*) FILTER (technology = 'HTTP') AS tech_http, count(*) FILTER (technology = 'Core') AS tech_core, count(*) FILTER (technology = 'LTE') AS tech_lte, count(*) FILTER (technology = '5G') AS tech_5g FROM m GROUP BY 1
), so AS (
  SELECT capture_id, count(*) AS sessions, count(*) FILTER (rca_label = 'NORMAL_CALL') AS normal, count(*) FILTER (rca_label = 'UNKNOWN') AS unknown, avg(confidence_pct) AS avg_confidence FROM rca GROUP BY 1
)"""
_ERRORS_SQL = MESSAGES_SQL + """, er AS (
  SELECT c.capture_id, k.category, (SELECT count(*) FROM m WHERE m.capture_id = c.capture_id AND ((k.category = 'GTPv2 context not found' AND cause_code = '64') OR (k.category = 'Diameter errors' AND protocol = 'DIAMETER' AND is_failure))) AS n
  FROM (SELECT DISTINCT capture_id FROM m) c, (SELECT unnest(['SIP 401', 'TCP transport issues', 'GTPv2 context not found', 'NGAP release', 'S1AP release', 'Diameter errors', 'Diameter informational', 'RADIUS errors', 'RADIUS challenges', 'TCP RST']) AS category) k
)"""

QUERIES = [
    ("a20_endpoint_activity", lambda s, d: A.endpoint_activity(messages(s, d)), f"WITH {MESSAGES_SQL}, x AS (SELECT capture_id, unnest([src_ip, dst_ip]) AS endpoint FROM m), c AS (SELECT capture_id, endpoint, count(*) AS n FROM x GROUP BY 1, 2) SELECT capture_id, endpoint, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, endpoint) AS r FROM c) WHERE r <= 10"),
    ("a21_capture_summary", capture_summary, f"WITH {_SUMMARY_SQL} SELECT sm.*, sessions, normal, unknown, round(avg_confidence, 4) AS avg_confidence FROM sm JOIN so USING (capture_id)"),
    ("a22_protocol_breakdown", protocol_breakdown, f"WITH {MESSAGES_SQL} SELECT capture_id, protocol, count(DISTINCT frame_number) AS frames, round(count(DISTINCT frame_number) * 100 / (SELECT count(DISTINCT frame_number) FROM m x WHERE x.capture_id = m.capture_id), 4) AS percent FROM m GROUP BY 1, 2"),
    ("a23_capture_window", capture_window, f"WITH {MESSAGES_SQL} SELECT capture_id, min(ts) AS start_ts, max(ts) AS end_ts, count(DISTINCT frame_number) AS frames, count(*) AS messages, round(max(ts) - min(ts), 3) AS duration FROM m GROUP BY 1"),
    ("a24_top_pairs", lambda s, d: A.top_pairs(messages(s, d)), f"WITH {MESSAGES_SQL}, c AS (SELECT capture_id, protocol, src_ip, dst_ip, count(*) AS n FROM m GROUP BY 1, 2, 3, 4) SELECT capture_id, protocol, src_ip, dst_ip, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, protocol ORDER BY n DESC, src_ip, dst_ip) AS r FROM c) WHERE r = 1"),
    ("a26_corpus_audit", corpus_audit, f"WITH {SESSIONS_SQL}, c AS (SELECT capture_id, rca_label, count(*) AS n FROM rca GROUP BY 1, 2), t AS (SELECT capture_id, rca_label AS top_label FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, rca_label) AS r FROM c) WHERE r = 1) "
     "SELECT capture_id, count(*) AS sessions, count(*) FILTER (rca_label = 'UNKNOWN') AS unknown, array_to_string(list_sort(list_distinct(flatten(list(protocols)))), ',') AS protocols, any_value(top_label) AS top_label FROM rca JOIN t USING (capture_id) GROUP BY 1"),
    ("a27_error_analysis", lambda s, d: A.error_analysis(messages(s, d)), f"WITH {_ERRORS_SQL} SELECT capture_id, category, n, CASE WHEN n = 0 THEN 'none' ELSE 'medium' END AS severity FROM er"),
    ("w15_error_timeline", lambda s, d: A.error_timeline(messages(s, d)), f"WITH {MESSAGES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY capture_id, protocol, message ORDER BY ts, frame_number) AS nth FROM m WHERE is_failure), y AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, frame_number) AS r FROM x WHERE nth = 1 OR (protocol = 'GTP' AND nth <= 3)) SELECT capture_id, ts, frame_number, protocol, message FROM y WHERE r <= 10"),
    ("k10_packet_examples", lambda s, d: A.packet_examples(messages(s, d)), f"WITH {MESSAGES_SQL} SELECT capture_id, protocol, frame_number, ts, message FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, protocol ORDER BY ts, frame_number) AS r FROM m WHERE is_failure) WHERE r <= 5"),
    ("k11_protocol_share", protocol_share, f"WITH {MESSAGES_SQL}, c AS (SELECT protocol, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, protocol LIMIT 5) SELECT protocol, n, round(n / sum(n) OVER (), 6) AS share FROM c"),
    ("a34_duration_histogram", lambda s, d: A.duration_histogram(_labelled(s, d), (1.0, 3_600_000.0, 14_400_000.0)), f"WITH {SESSIONS_SQL}, x AS (SELECT (end_ts - start_ts) * 1000 AS d FROM ss) SELECT CASE WHEN d < 1 THEN 'bin1' WHEN d < 3600000 THEN 'bin2' WHEN d < 14400000 THEN 'bin3' ELSE 'bin4' END AS bin, count(*) AS sessions FROM x GROUP BY 1"),
    ("f02_session_filter", session_filter, f"WITH {SESSIONS_SQL} SELECT capture_id, session_id, rca_label, confidence_pct FROM rca WHERE rca_label = 'USER_BUSY' AND list_contains(protocols, 'SIP') ORDER BY confidence_pct DESC, capture_id, session_id LIMIT 100"),
    ("k07_expert_findings", expert_findings, f"WITH {_SUMMARY_SQL}, x AS (SELECT capture_id, 1 - (normal + unknown) / sessions AS ab, unknown / sessions AS un, failures, (SELECT count(*) FROM m WHERE m.capture_id = sm.capture_id AND protocol = 'DIAMETER' AND is_failure) AS de, (SELECT count(*) FROM m WHERE m.capture_id = sm.capture_id AND cause_code = '64') AS ge FROM sm JOIN so USING (capture_id)), "
     "f AS (SELECT capture_id, 'High share of abnormal sessions' AS title, 'high' AS severity, 0 AS p FROM x WHERE ab >= 0.45 UNION ALL SELECT capture_id, 'Many sessions without a cause', 'medium', 1 FROM x WHERE un >= 0.3 UNION ALL SELECT capture_id, 'Diameter errors', 'high', 3 FROM x WHERE de > 0 UNION ALL SELECT capture_id, 'Bearer contexts not found', 'medium', 4 FROM x WHERE ge > 0 UNION ALL SELECT capture_id, 'No failure observed', 'low', 6 FROM x WHERE failures = 0) "
     "SELECT capture_id, title, severity FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, p) AS r FROM f) WHERE r <= 4"),
    ("k09_protocol_findings", findings, f"WITH {SESSIONS_SQL}, v(protocol, code, family, recommended_label, weight) AS (VALUES ('DIAMETER', '2001', 'success', 'NORMAL_CALL', 0), ('DIAMETER', '4012', 'charging', 'CHARGING_FAILURE', 3), ('DIAMETER', '5003', 'authorization', 'SUBSCRIBER_BARRED', 3), ('DIAMETER', '5004', 'roaming', 'SUBSCRIBER_BARRED', 3), ('DIAMETER', '5550', 'subscriber_absent', 'SUBSCRIBER_UNREACHABLE', 2), ('SIP', '480', 'unreachable', 'SUBSCRIBER_UNREACHABLE', 1), ('SIP', '486', 'busy', 'USER_BUSY', 1), ('SIP', '487', 'cancelled', 'USER_ABORT', 1), ('GTP', '64', 'context', 'CORE_NETWORK_FAILURE', 2), ('HTTP', '404', 'client', 'CLIENT_ERROR', 1), ('HTTP', '503', 'server', 'NF_FAILURE', 2)), "
     "c AS (SELECT capture_id, session_id, s.protocol, v.family, recommended_label, weight, count(*) AS n FROM s JOIN v ON v.protocol = s.protocol AND v.code = coalesce(status_code, result_code, cause_code) GROUP BY 1, 2, 3, 4, 5, 6) SELECT capture_id, session_id, protocol, family, recommended_label, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY weight DESC, n DESC, protocol, family) AS r FROM c) WHERE r <= 5"),
    ("a42_parties", parties, f"WITH {SESSIONS_SQL}, x AS (SELECT *, CASE protocol WHEN 'DIAMETER' THEN 0 WHEN 'GTP' THEN 1 WHEN 'NAS_5GS' THEN 2 ELSE 3 END AS rk FROM s) SELECT capture_id, session_id, arg_min(imsi, (rk, us, frame_number)) AS subscriber, arg_min(protocol, (rk, us, frame_number)) AS named_by, count(DISTINCT imsi) AS subscribers FROM x GROUP BY 1, 2"),
    ("a33_recurring_failures", lambda s, d: A.recurring(_labelled(s, d)), f"WITH {SESSIONS_SQL} SELECT rca_label, count(*) AS n, count(DISTINCT capture_id) AS captures FROM rca WHERE rca_label <> 'NORMAL_CALL' GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, rca_label LIMIT 10"),
    ("a35_compact_repeats", compact_repeats, f"WITH {MESSAGES_SQL} SELECT capture_id, CASE WHEN count(*) > 1 THEN arg_min(message, (us, frame_number)) || ' x' || count(*) ELSE arg_min(message, (us, frame_number)) END AS text, count(*) AS n FROM m GROUP BY capture_id, lower(message)"),
    ("r17_capture_reports", lambda s, d: A.reports(_summary(s, d)), f"WITH {_SUMMARY_SQL} SELECT capture_id, sessions || ' sessions, ' || (sessions - normal - unknown) || ' abnormal, ' || unknown || ' unknown' AS headline, CASE WHEN (sessions - normal - unknown) * 2 >= sessions THEN 'critical' WHEN sessions - normal - unknown > 0 THEN 'degraded' ELSE 'healthy' END AS assessment, "
     "array_to_string(list_filter([CASE WHEN sessions - normal - unknown > 0 THEN 'review abnormal sessions' END, CASE WHEN unknown > 0 THEN 'extend correlation' END, CASE WHEN failures = 0 THEN 'no action' END], lambda x: x IS NOT NULL), '; ') AS recommendations FROM sm JOIN so USING (capture_id)"),
    ("w16_retained_events", lambda s, d: A.retained(messages(s, d).where("is_failure").select("capture_id", "ts", "frame_number", "message"), ["capture_id"], 50), f"WITH {MESSAGES_SQL} SELECT capture_id, ts, frame_number, message FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts DESC, frame_number DESC) AS r FROM m WHERE is_failure) WHERE r <= 50"),
]
