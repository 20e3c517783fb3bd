"""All families and rules over the view of procedures; generic sessions, states, findings, advice and details of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators import analytics, findings, seeds, sessions, stateful, strategies
from sigweave.plans.batch import labelled, sessionize
from sigweave.plans.familyviews import FAMILIES_SQL, GAP, messages
from sigweave.plans.testviews import MESSAGES_SQL
from sigweave.plans.testviews import messages as call_messages

KEYS = ["capture_id", "session_id"]


def family_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(messages(spark, folder), GAP).select(*KEYS, "rule_id", "messages")


def advice(spark: SparkSession, folder: str) -> DataFrame:
    """How often each cause occurs in each capture, with what to do about it."""
    counts = labelled(messages(spark, folder), GAP).groupBy("capture_id", "rca_label").agg(F.count("*").alias("sessions"))
    return findings.with_advice(counts).select("capture_id", "rca_label", "sessions", "title", F.array_join("advice", "; ").alias("advice"))


def family_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.family_counts(sessionize(messages(spark, folder), GAP))


def generic_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = messages(spark, folder).where("protocol not in ('SIP', 'DIAMETER', 'GTP')")
    return seeds.generic_sessions(rows, gap=36 * 3600.0, restart_gap=3600.0, legacy_restart_gap=1800.0, least_rows=12)


def _stateful_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The view, with a service on access messages of every fourth number, and addresses of subscribers on bearer messages."""
    rows = sessionize(messages(spark, folder), 4 * GAP)
    return rows.withColumns({"sbi_service": F.when((F.col("protocol") == "NGAP") & (F.col("k") % 4 == 0), "nudm-sdm"), "subscriber_ips": F.when((F.col("protocol") == "GTP") & (F.col("k") % 5 < 3), F.array("src_ip"))})


def stateful_evidence(spark: SparkSession, folder: str) -> DataFrame:
    told = stateful.stateful_evidence(_stateful_rows(spark, folder), KEYS, gap=6 * 3600.0)
    return told.select(*KEYS, F.array_join("methods", ",").alias("methods"), F.array_join("evidence", "; ").alias("evidence"))


def epdg_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Calls from the outer address of a tunnel and the Diameter rows of its inner address; the first message of each day opens the call."""
    rows = messages(spark, folder)
    tunnels = rows.where("protocol = 'IKEV2'")
    aliases = seeds.epdg_aliases(tunnels)
    days = tunnels.select("capture_id", F.concat_ws("/", "imsi", F.floor(F.col("ts") / 86400).cast("string")).alias("session_id"), "ts", "src_ip")
    calls = days.groupBy(*KEYS).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.lit(None).cast("string").alias("msisdn"), F.lit(None).cast("string").alias("imsi"))
    ips = days.select(*KEYS, F.col("src_ip").alias("ip"), F.lit(0).alias("rank")).distinct()
    found = strategies.diameter_fusion(calls, ips, rows.where("protocol = 'DIAMETER'"), 6 * 3600.0, aliases=aliases, time_fallback=False)
    return found.select(*KEYS, "message_uid", "strategy", "score")


def _with_hosts(rows: DataFrame) -> DataFrame:
    """Names of hosts and realms, and codes without a meaning, by number."""
    k = F.col("k")
    realm = lambda test: F.concat(F.lit("epc.mnc0"), F.when(test, "2").otherwise("1"), F.lit(".mcc262.3gppnetwork.org"))
    host = F.when(k % 4 == 0, "hss1.").when(k % 4 == 1, "ocs7.").when(k % 4 == 2, "dsr2.").otherwise("node.")
    return rows.withColumns({
        "result_code": F.when(k % 20 == 4, "5012").when(k % 20 == 5, "5999").when(k % 20 == 6, "5998").otherwise(F.col("result_code")), "is_failure": F.col("is_failure") | (k % 20).isin(4, 5, 6),
        "origin_realm": realm(F.lit(False)), "destination_realm": realm(k % 3 == 0), "origin_host": F.concat(host, realm(F.lit(False))), "destination_host": F.concat(F.lit("mme3."), realm(k % 3 == 0)),
    })


def diameter_findings(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.diameter_findings(_with_hosts(call_messages(spark, folder)))
    return found.select("message_uid", "family", "title", "fault_domain", "unlikely", "network_side", "evidence", "score")


def ranked_findings(spark: SparkSession, folder: str) -> DataFrame:
    return findings.ranked_findings(findings.diameter_findings(_with_hosts(call_messages(spark, folder))), ["capture_id"])


def capture_details(spark: SparkSession, folder: str) -> DataFrame:
    """Details of the captures of all subscribers of a procedure, so that captures differ in their families."""
    rows = sessionize(messages(spark, folder), GAP).withColumn("capture_id", F.concat(F.lit("p-"), (F.substring("imsi", 6, 10).cast("long") % 17 % 12).cast("string")))
    return analytics.capture_details(rows, rows.select(*KEYS).distinct())


def transport_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Transport faults of each capture; every fifth lost message is a repeated acknowledgement."""
    rows = messages(spark, folder).withColumns({"duplicate_ack": F.col("k") % 5 == 0, "retransmission": F.coalesce("retransmission", F.lit(False)) & (F.col("k") % 5 != 0), "reset": F.coalesce("timeout", F.lit(False))})
    return findings.transport_issues(rows, ["capture_id"])


_ADVICE_ROWS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (name, title, "; ".join(todo))) + ")" for name, (title, todo) in findings.ADVICE.items())

ADVICE_SQL = f"""WITH {FAMILIES_SQL}, advice (label, title, advice) AS (VALUES {_ADVICE_ROWS}), labels AS (
  SELECT capture_id, CASE WHEN rule_id = 'R0_POLICY' THEN 'POLICY_FAILURE' WHEN rule_id = 'R0_RADIUS_REJECT' THEN 'SUBSCRIBER_BARRED' WHEN rule_id LIKE 'R0%' OR rule_id = 'R4B_CONTROL_SUCCESS' THEN 'NORMAL_CALL' WHEN rule_id = 'R2_REJECT' THEN 'USER_REJECTED' WHEN rule_id = 'R2_ROUTING' THEN 'ROUTING_FAILURE'
    WHEN rule_id = 'R3B_DNS' THEN 'DNS_FAILURE' WHEN rule_id = 'R3B_ICMP' THEN 'ICMP_NETWORK_FAILURE' WHEN rule_id = 'R3B_NAS' THEN 'NAS_REJECTION' WHEN rule_id = 'R4_GTP' THEN 'CORE_NETWORK_FAILURE' WHEN rule_id = 'R5_TCP_RETX' THEN 'NETWORK_CONGESTION' WHEN rule_id = 'R5_TIMEOUT' THEN 'TRANSPORT_TIMEOUT'
    WHEN rule_id = 'R6_SERVER' THEN 'SERVER_ERROR' WHEN rule_id = 'R6_CLIENT' THEN 'NETWORK_REJECTION' ELSE 'UNKNOWN' END AS rca_label FROM fr
)
SELECT capture_id, rca_label, count(*) AS sessions, any_value(title) AS title, any_value(advice) AS advice FROM labels JOIN advice ON label = rca_label GROUP BY 1, 2"""

GENERIC_SQL = f"""WITH RECURSIVE {FAMILIES_SQL}, g AS (
  SELECT *, protocol || ':' || CASE WHEN protocol = 'IKEV2' THEN 'imsi:' || imsi ELSE coalesce(transaction_id, CASE WHEN protocol = 'PFCP' THEN 'seid-' || user_id END, 'imsi:' || imsi) END AS key,
    protocol IN ('RANAP', 'MAP') AS legacy, protocol IN ('NAS_EPS', 'S1AP', 'SCTP', 'UDP') AS procedural, regexp_matches(text, 'UE CONTEXT RELEASE|TRACKING AREA UPDATE COMPLETE') AS done, regexp_matches(text, 'SERVICE REQUEST|TRACKING AREA UPDATE REQUEST|INITIAL UE MESSAGE') AS fresh
  FROM f WHERE protocol NOT IN ('SIP', 'DIAMETER', 'GTP')
), o AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, key ORDER BY ts, frame_number) AS r, count(*) OVER (PARTITION BY capture_id, key) AS n, ts - lag(ts) OVER (PARTITION BY capture_id, key ORDER BY ts, frame_number) AS apart FROM g
), walk AS (
  SELECT capture_id, key, r, frame_number, 0 AS part, done FROM o WHERE r = 1
  UNION ALL SELECT o.capture_id, o.key, o.r, o.frame_number, w.part + CAST(c AS INT), CASE WHEN c THEN o.done ELSE w.done OR o.done END
  FROM walk w JOIN o ON o.capture_id = w.capture_id AND o.key = w.key AND o.r = w.r + 1, LATERAL (SELECT o.apart > 129600 OR (o.fresh AND w.done AND o.apart > CASE WHEN o.legacy THEN 1800 ELSE 3600 END) AS c)
), p AS (
  SELECT o.*, o.key || CASE WHEN part > 0 AND (legacy OR (procedural AND n >= 12)) THEN ':seg' || (part + 1) ELSE '' END AS sid FROM o JOIN walk w USING (capture_id, key, r)
)
SELECT capture_id, sid AS session_id, arg_min(src_ip, (ts, frame_number)) AS calling, arg_max(dst_ip, (ts, frame_number)) AS called, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, array_to_string(list_slice(list(message ORDER BY ts, frame_number), 1, 8), ' → ') AS flow FROM p GROUP BY 1, 2"""

STATEFUL_SQL = f"""WITH {FAMILIES_SQL}, x0 AS (
  SELECT capture_id, imsi, ts, frame_number, k, protocol, text, teid, user_id, src_ip, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id, imsi ORDER BY ts, frame_number) > {4 * GAP:.0f} THEN 1 ELSE 0 END AS cut FROM f
), x AS (
  SELECT * EXCLUDE (cut), imsi || CASE WHEN seg > 0 THEN ':seg' || (seg + 1) ELSE '' END AS session_id FROM (SELECT *, CAST(sum(cut) OVER (PARTITION BY capture_id, imsi ORDER BY ts, frame_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM x0)
), b0 AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id, session_id ORDER BY ts, frame_number) > 21600 THEN 1 ELSE 0 END AS cut FROM x WHERE protocol = 'GTP'
), b AS (
  SELECT capture_id, session_id, part, list(DISTINCT teid) AS tunnels, bool_or(k % 5 < 3) AS ip, bool_or(regexp_matches(text, 'MODIFY BEARER|RELEASE ACCESS BEARERS')) AS moved
  FROM (SELECT *, sum(cut) OVER (PARTITION BY capture_id, session_id ORDER BY ts, frame_number ROWS UNBOUNDED PRECEDING) AS part FROM b0) GROUP BY 1, 2, 3
), chains AS (
  SELECT DISTINCT l.capture_id, l.session_id FROM b l JOIN b r ON l.capture_id = r.capture_id AND l.session_id = r.session_id AND r.part = l.part + 1 WHERE NOT list_has_any(l.tunnels, r.tunnels) AND ((l.ip AND r.ip) OR l.moved OR r.moved)
), s AS (
  SELECT capture_id, session_id, any_value(imsi) AS imsi, bool_or(protocol IN ('S1AP', 'NGAP')) AS access, bool_or(protocol = 'NGAP' AND k % 4 = 0) AS sbi, any_value(user_id) AS u, bool_or(protocol = 'DIAMETER' AND user_id % 17 = 16) AS framed, array_to_string(list_slice(list_sort(list(DISTINCT teid) FILTER (teid IS NOT NULL)), 1, 4), ', ') AS tunnels FROM x GROUP BY 1, 2
)
SELECT s.capture_id, s.session_id, concat_ws(',', CASE WHEN access THEN 'access_subscriber' END, CASE WHEN sbi THEN 'sbi_subscriber' END, CASE WHEN c.session_id IS NOT NULL THEN 'tunnel_chain' END) AS methods,
  concat_ws('; ', CASE WHEN access THEN 'access id ue-' || u || ' goes with the subscriber' END, CASE WHEN sbi THEN 'subscriber named by service nudm-sdm' END, CASE WHEN c.session_id IS NOT NULL THEN 'tunnels ' || tunnels || ' follow each other for IMSI ' || imsi END) AS evidence
FROM s LEFT JOIN chains c ON c.capture_id = s.capture_id AND c.session_id = s.session_id"""

EPDG_SQL = f"""WITH {FAMILIES_SQL}, calls AS (
  SELECT capture_id, user_id, imsi || '/' || CAST(floor(ts / 86400) AS BIGINT) AS session_id, min(ts) AS a, max(ts) AS b FROM f WHERE protocol = 'IKEV2' GROUP BY ALL
)
SELECT c.capture_id, c.session_id, f.frame_number AS message_uid, 'epdg_inner_ip_fusion' AS strategy, 112 AS score FROM calls c JOIN f ON f.capture_id = c.capture_id AND f.user_id = c.user_id AND f.protocol = 'DIAMETER' AND f.ts BETWEEN c.a - 21600 AND c.b + 21600"""

FINDINGS_SQL = f"""WITH {MESSAGES_SQL}, d AS (
  SELECT * EXCLUDE (family), CASE k % 20 WHEN 4 THEN '5012' WHEN 5 THEN '5999' WHEN 6 THEN '5998' ELSE result_code END AS code, 'epc.mnc01.mcc262.3gppnetwork.org' AS home, CASE WHEN k % 3 = 0 THEN 'epc.mnc02.mcc262.3gppnetwork.org' ELSE 'epc.mnc01.mcc262.3gppnetwork.org' END AS far,
    CASE k % 4 WHEN 0 THEN 'HSS/HLR' WHEN 1 THEN 'OCS' WHEN 2 THEN 'DSR' END AS role, CASE k % 4 WHEN 0 THEN 'hss1.' WHEN 1 THEN 'ocs7.' WHEN 2 THEN 'dsr2.' ELSE 'node.' END AS host FROM m WHERE protocol = 'DIAMETER'
), t AS (
  SELECT *, CASE code WHEN '4012' THEN 'charging' WHEN '5003' THEN 'authorization' WHEN '5004' THEN 'roaming' WHEN '5550' THEN 'subscriber_absent' ELSE 'unknown_non_success' END AS family,
    CASE code WHEN '4012' THEN 'DIAMETER_CREDIT_LIMIT_REACHED' WHEN '5003' THEN 'DIAMETER_AUTHORIZATION_REJECTED' WHEN '5004' THEN 'DIAMETER_ERROR_ROAMING_NOT_ALLOWED' WHEN '5550' THEN 'DIAMETER_ERROR_ABSENT_USER' END AS name, k % 3 = 0 AS crossing, coalesce(role IN ('HSS/HLR', 'DSR'), false) AS network_side
  FROM d WHERE code <> '2001'
), found AS (
  SELECT capture_id, frame_number AS message_uid, family, CASE WHEN name IS NOT NULL THEN name || ' (' || code || ')' ELSE 'Diameter code ' || code || ' from ' || coalesce(role, 'a peer') || ' to MME' END AS title,
    CASE family WHEN 'charging' THEN 'credit control' WHEN 'authorization' THEN 'entitlement and policy of the subscriber' WHEN 'roaming' THEN 'roaming agreement or location update between networks' WHEN 'subscriber_absent' THEN 'subscriber data or registration state'
      ELSE CASE WHEN crossing THEN 'routing between networks or subscriber look-up' WHEN network_side THEN role || ' state of the subscriber' ELSE 'service logic or set-up of a peer' END END AS fault_domain,
    CASE family WHEN 'subscriber_absent' THEN 'a fault of the handset''s screen or dialer' WHEN 'unknown_non_success' THEN 'a fault of the handset alone' ELSE 'packet loss' END AS unlikely, network_side,
    'CCR with ' || code || ' from ' || host || home || ' to mme3.' || far AS evidence, CASE WHEN name IS NOT NULL THEN 100 WHEN crossing THEN 70 ELSE 60 END AS score FROM t
)"""

DETAILS_SQL = f"""WITH {FAMILIES_SQL}, y AS (
  SELECT f.* EXCLUDE (capture_id), 'p-' || (user_id % 17 % 12) AS capture_id, CASE protocol WHEN 'SIP' THEN 'IMS' WHEN 'DIAMETER' THEN 'Core' WHEN 'GTP' THEN 'LTE' WHEN 'S1AP' THEN 'LTE' WHEN 'NAS_EPS' THEN 'LTE' WHEN 'NGAP' THEN '5G' WHEN 'PFCP' THEN '5G' WHEN 'RANAP' THEN '3G' WHEN 'BSSAP' THEN '2G' WHEN 'MAP' THEN '2G/3G'
    WHEN 'IKEV2' THEN 'VoWiFi' WHEN 'RADIUS' THEN 'AAA' ELSE 'IP' END AS technology, CASE protocol WHEN 'DIAMETER' THEN 'Diameter' WHEN 'MAP' THEN 'GSM MAP' ELSE protocol END AS shown FROM f
), n AS (
  SELECT capture_id, protocol, any_value(shown) AS shown, count(*) AS n FROM y GROUP BY 1, 2
), t AS (
  SELECT capture_id, list(protocol ORDER BY n DESC, protocol) AS ps, list(shown ORDER BY n DESC, shown) FILTER (protocol NOT IN ('TCP', 'SCTP')) AS fam FROM n GROUP BY 1
), w AS (
  SELECT capture_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS frames, count(DISTINCT imsi) AS subscribers, list_sort(list(DISTINCT technology)) AS tech, count(DISTINCT session_id) AS sessions FROM y GROUP BY 1
), d AS (
  SELECT *, CASE WHEN list_has_all(ps, ['SIP', 'DIAMETER']) THEN 'IMS call trace' WHEN list_contains(ps, 'RADIUS') AND NOT list_has_any(ps, ['SIP', 'DIAMETER']) THEN 'RADIUS AAA trace' WHEN list_has_all(ps, ['NGAP', 'S1AP']) THEN 'Multi-RAT 5G/4G signalling trace' WHEN list_has_any(ps, ['NGAP', 'PFCP']) THEN '5G signalling trace'
    WHEN list_has_any(ps, ['S1AP', 'GTP']) THEN 'LTE/4G signalling trace' WHEN list_contains(ps, 'RANAP') THEN '3G signalling trace' WHEN list_contains(ps, 'BSSAP') THEN '2G signalling trace' ELSE 'Mixed telecom trace' END AS trace_type FROM t JOIN w USING (capture_id)
)
SELECT capture_id, trace_type, CASE WHEN list_has_all(ps, ['SIP', 'DIAMETER']) AND list_has_any(ps, ['NGAP', 'S1AP']) THEN 'IMS registration and mobile-originated VoIP call over a converged 5G/4G core' WHEN list_has_all(ps, ['SIP', 'DIAMETER']) THEN 'IMS registration and voice signalling validation'
    WHEN list_contains(ps, 'RADIUS') THEN 'RADIUS authentication, authorization, and accounting validation' WHEN list_has_all(ps, ['PFCP', 'GTP']) THEN 'Packet-core session establishment and bearer validation' WHEN list_has_all(ps, ['NGAP', 'S1AP']) THEN 'Multi-RAT signalling and interworking validation' ELSE 'Telecom signalling and service validation' END AS scenario,
  coalesce(fam[1], ps[1]) AS dominant_protocol, array_to_string(list_slice(ps, 1, 4), ',') AS top_protocols, array_to_string(tech, ',') AS technologies, trace_type || ' with ' || array_to_string(list_slice(ps, 1, 2), ', ') || ' activity across ' || array_to_string(list_slice(tech, 1, 3), ', ') AS headline, start_ts, end_ts, frames, subscribers, sessions FROM d"""

ISSUES_SQL = f"""WITH {FAMILIES_SQL}, i AS (
  SELECT capture_id, CASE WHEN mark = 'late' THEN 'reset' WHEN mark = 'lost' AND k % 5 <> 0 THEN 'retransmission' WHEN k % 5 = 0 THEN 'duplicate ack' END AS kind FROM f WHERE protocol = 'TCP'
), c AS (SELECT capture_id, kind, count(*) AS n FROM i WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT capture_id, CAST(sum(n) AS BIGINT) AS issues, string_agg(n || ' ' || kind, ', ' ORDER BY n DESC, replace(kind, ' ', '_')) AS breakdown FROM c GROUP BY 1"""

QUERIES = [
    ("r03_family_cascade", family_cascade, f"WITH {FAMILIES_SQL} SELECT capture_id, session_id, rule_id, messages FROM fr"),
    ("j30_recommendations", advice, ADVICE_SQL),
    ("a16_family_buckets", family_buckets, f"WITH {FAMILIES_SQL} SELECT capture_id, session_id, " + ", ".join(f"count(*) FILTER (protocol = '{b}') AS {b.lower()}" for b in sessions.BUCKETS) + " FROM f GROUP BY 1, 2"),
    ("a46_generic_sessions", generic_sessions, GENERIC_SQL),
    ("a47_stateful_evidence", stateful_evidence, STATEFUL_SQL),
    ("j03_epdg_alias_join", epdg_alias, EPDG_SQL),
    ("p50_diameter_findings", diameter_findings, f"{FINDINGS_SQL} SELECT * EXCLUDE (capture_id) FROM found"),
    ("p50_ranked_findings", ranked_findings, f"""{FINDINGS_SQL}, once AS (SELECT capture_id, title, family, count(*) AS n, max(score) AS score, arg_min(evidence, message_uid) AS evidence FROM found GROUP BY 1, 2, 3)
SELECT capture_id, place, title, family, n, evidence FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY CASE family WHEN 'subscriber_absent' THEN 6 WHEN 'authorization' THEN 5 WHEN 'roaming' THEN 5 WHEN 'unknown_non_success' THEN 4 ELSE 2 END DESC, score DESC, n DESC, title) AS place FROM once) WHERE place <= 4"""),
    ("a44_capture_details", capture_details, DETAILS_SQL),
    ("a48_transport_issues", transport_issues, ISSUES_SQL),
]
