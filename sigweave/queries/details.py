"""Detail rows of sessions and captures over the signalling view."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigweave.operators import details as D
from sigweave.operators import graphs, scoring, sessions
from sigweave.plans.batch import labelled, sessionize
from sigweave.plans.testviews import GAP, MESSAGES_SQL, SEGMENTS_SQL, SESSIONS_SQL, messages
from sigweave.queries.rca import KEYS
from sigweave.queries.scoring import FEATURES_SQL, PRIORITY_SQL, feature_rows


def scored(s, d):
    """Scored sessions with their features."""
    return scoring.priority(scoring.anomaly(feature_rows(s, d))).withColumn("priority_score", F.round("priority_score", 3))


SCORED_SQL = FEATURES_SQL + f""", sc AS (
  SELECT *, CAST({PRIORITY_SQL.format(conflict="0")} AS DOUBLE) AS priority_score FROM an
)"""


def focus(s, d):
    return D.focus_failures(scored(s, d), ["capture_id"]).select(*KEYS, "rca_label", "priority_score")


def _cut(s, d):
    return sessionize(messages(s, d), GAP)


def anchors(s, d):
    return D.anchors(_cut(s, d), KEYS, k=5)


def session_names(s, d):
    return D.session_name(_cut(s, d), KEYS)


def apns(s, d):
    rows = _cut(s, d).withColumn("apn", F.when(F.col("protocol").isin("GTP", "HTTP"), F.concat(F.lit(" Net"), (F.col("k") % 4).cast("string"))))
    return D.apns(rows, KEYS).select(*KEYS, F.array_join("apns", ",").alias("apns"))


def party_networks(s, d):
    """Networks of parties, with IMSI, number or SIP domains left out for some of them."""
    rows = _cut(s, d)
    mnc = F.when(F.col("k") % 4 == 0, "01").when(F.col("k") % 4 == 1, "002").when(F.col("k") % 4 == 2, "077")
    rows = rows.withColumn("from_uri", F.when(F.col("protocol") == "SIP", F.concat(F.lit("sip:"), F.col("imsi"), F.lit("@ims.mnc"), mnc, F.lit(".mcc262.3gppnetwork.org"))))
    last, tail = F.substring("imsi", 15, 1), F.substring("imsi", 9, 7)
    parties = rows.groupBy(*KEYS).agg(F.min("imsi").alias("imsi")).withColumn("msisdn", F.when(last.isin("0", "1"), F.concat(F.lit("0171"), tail)).when(last == "3", F.concat(F.lit("0049152"), tail)).when(last == "6", F.concat(F.lit("+1202"), tail)))
    parties = parties.withColumn("imsi", F.when(~last.isin("0", "3", "6", "9"), F.col("imsi")))
    return D.party_networks(parties, KEYS, D.domain_networks(rows, parties, KEYS))


NETWORKS_SQL = SEGMENTS_SQL + """, u AS (
  SELECT *, 'sip:' || imsi || '@ims.mnc' || CASE k % 4 WHEN 0 THEN '01' WHEN 1 THEN '002' WHEN 2 THEN '077' END || '.mcc262' AS uri, CASE k % 4 WHEN 0 THEN '26201' WHEN 1 THEN '262002' WHEN 2 THEN '262077' END AS code FROM s
), pa AS (
  SELECT capture_id, session_id, CASE WHEN min(imsi)[15] NOT IN ('0', '3', '6', '9') THEN min(imsi) END AS imsi,
    CASE WHEN min(imsi)[15] IN ('0', '1') THEN '171' WHEN min(imsi)[15] = '3' THEN '152' END AS prefix FROM s GROUP BY 1, 2
), hi AS (
  SELECT u.capture_id, u.session_id, arg_min(code, (coalesce(NOT starts_with(pa.imsi, code), true), us, family, frame_number)) AS code FROM u JOIN pa USING (capture_id, session_id) WHERE protocol = 'SIP' AND code IS NOT NULL GROUP BY 1, 2
), nw AS (
  SELECT capture_id, session_id, prefix, coalesce(hi.code, CASE WHEN imsi IS NOT NULL THEN '26201' END) AS code, CASE WHEN hi.code IS NOT NULL THEN 'SIP domain ' ELSE 'IMSI ' END AS kind FROM pa LEFT JOIN hi USING (capture_id, session_id)
)"""


def resolved_nodes(s, d):
    rows = messages(s, d)
    role = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ["CSCF", "P-CSCF", "AMF", "AMF/MME", "SGW/PGW", "UPF/SGW"])), F.col("role")), F.col("role"))
    inventory = graphs.node_inventory(rows).withColumn("role", role)
    found = D.resolved_nodes(graphs.topology_nodes(rows, ["capture_id"]).withColumnRenamed("node", "address"), inventory)
    return found.select("capture_id", "address", "role", "node", "label", F.round("confidence", 6).alias("confidence"))


def topology_lines(s, d):
    rows = messages(s, d)
    return D.topology_lines(rows, rows.groupBy("capture_id").agg(F.min("imsi").alias("calling"), F.max("call_id").alias("called")), ["capture_id"])


def traffic_series(s, d):
    return D.traffic_series(sessions.refresh(_cut(s, d)), ["capture_id"])


def evidence_lists(s, d):
    rows = feature_rows(s, d)
    return rows.select(*KEYS, F.array_join(D.evidence(rows), "; ").alias("evidence"))


EVIDENCE_SQL = FEATURES_SQL + """, eo AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY ts, family, frame_number) AS seq, coalesce(message, protocol) AS token FROM s
), ed AS (
  SELECT capture_id, session_id, token, min(seq) AS seq FROM eo GROUP BY 1, 2, 3
), ef AS (
  SELECT capture_id, session_id, array_to_string(list(token ORDER BY seq)[1:10], ' → ') AS flow FROM ed GROUP BY 1, 2
), em AS (
  SELECT capture_id, session_id, list('slow_gap:' || protocol || ':' || message ORDER BY seq) FILTER (gap_ms >= 3600000) AS slow FROM ph GROUP BY 1, 2
), ex AS (
  SELECT ft.*, slow, list_filter([CASE WHEN NOT has_cancel AND final_sip_code = '487' THEN 'ended with 487 though neither side sent CANCEL' END, CASE WHEN round((failure_ts - start_ts) * 1000, 3) > 15000 THEN 'the first failure came ' || CAST(floor(round((failure_ts - start_ts) * 1000, 3)) AS BIGINT) || ' ms after the start' END,
    CASE WHEN charging_failed THEN 'charging was refused in ' || dia_failures || ' failed Diameter answers' END, 'the last final answer was ' || final_sip_code, CASE WHEN end_ts > start_ts THEN 'it took ' || CAST(floor(round((end_ts - start_ts) * 1000, 3)) AS BIGINT) || ' ms' END, 'its steps were ' || flow], lambda v: v IS NOT NULL) AS evidence
  FROM ft JOIN ef USING (capture_id, session_id) JOIN em USING (capture_id, session_id)
)"""


def ladder(s, d):
    return D.ladder(sessions.flow(_cut(s, d)), KEYS)


LADDER_SQL = """ld AS (
  SELECT capture_id, session_id, seq AS step, protocol, CASE protocol WHEN 'SIP' THEN coalesce(method, status_code) ELSE 'CCR ' || result_code END AS label, CASE WHEN protocol = 'DIAMETER' THEN 'OCS' WHEN method IS NOT NULL THEN 'UE / Caller' ELSE 'S-CSCF / TAS' END AS from_entity,
    CASE WHEN protocol = 'SIP' AND method IS NULL THEN 'UE / Caller' ELSE 'S-CSCF / TAS' END AS to_entity, CASE WHEN is_failure THEN 'failed' WHEN status_code = '200' OR result_code = '2001' THEN 'ok' WHEN method = 'CANCEL' THEN 'cancel' ELSE 'info' END AS status
  FROM eo WHERE protocol IN ('SIP', 'DIAMETER')
)"""


def explanation_rows(s, d):
    rows = feature_rows(s, d)
    out = D.explanation_rows(rows, KEYS, ladder(s, d), scoring.explain(rows, KEYS).withColumn("contribution", F.round("contribution", 6)))
    return out.select(*KEYS, "rca_label", F.col("confidence_pct").cast("int").alias("confidence_pct"), F.size("evidence").alias("evidence"), F.array_join("features", ",").alias("features"), "ladder_steps", "failed_steps")


_WEIGHTS = "VALUES " + ", ".join(f"('{label}', '{feature}', {weight})" for label, feature, weight in scoring.EXPLAIN)
# features of EXPLAIN that the view can reach, as SQL
_REACHED = {"charging_failed_flag": "CAST(charging_failed AS INT)", "dia_failure_count": "dia_failures", "auth_failed_dia": "CAST(auth_failed AS INT)", **{f"sip_{c}": f"CAST(coalesce(final_sip_code = '{c}', false) AS INT)" for c in ("486", "480", "487", "200")}, "failure_timeout": "CAST(coalesce((failure_ts - start_ts) * 1000 > 15000, false) AS INT)", "has_retransmission": "has_retransmission", "is_unknown": "is_unknown"}
EXPLAINED_SQL = f"""cw(label, feature, weight) AS ({_WEIGHTS}), cl AS (
  SELECT capture_id, session_id, rca_label, unnest({list(_REACHED)}) AS feature, unnest([{", ".join(_REACHED.values())}]) AS value FROM ft
), cf AS (
  SELECT capture_id, session_id, string_agg(cl.feature, ',' ORDER BY value * weight DESC, cl.feature) AS features FROM cl JOIN cw ON cw.label = rca_label AND cw.feature = cl.feature WHERE value <> 0 GROUP BY 1, 2
), ls AS (
  SELECT capture_id, session_id, count(*) AS ladder_steps, count(*) FILTER (status = 'failed') AS failed_steps FROM ld GROUP BY 1, 2
)"""


def narratives(s, d):
    rows = feature_rows(s, d)
    told = rows.withColumn("evidence", D.evidence(rows))
    return told.select(*KEYS, D.narrative(told).alias("narrative"))


def contexts(s, d):
    """Context of sessions, with vendor names put into some addresses and one capture from a visited network."""
    rows = messages(s, d)
    named = lambda c, vendor, i: F.when(F.col("k") % 16 == i, F.concat(F.lit(vendor), F.col(c)))
    rows = rows.withColumns({"src_ip": F.coalesce(named("src_ip", "nokia-", 3), named("src_ip", "Huawei.", 5), F.col("src_ip")), "dst_ip": F.coalesce(named("dst_ip", "ericsson-", 7), F.col("dst_ip")), "capture_id": F.when(F.col("capture_id") == "cap-3", "cap-3-visited").otherwise(F.col("capture_id"))})
    cut = sessionize(rows, GAP)
    return D.context(cut, sessions.refresh(cut), KEYS).select(*KEYS, "network_scope", "vendor", F.array_join("protocols", ",").alias("protocols"), "call_type")


def abnormal_sessions(s, d):
    return labelled(messages(s, d), GAP).where(D.is_abnormal()).groupBy("capture_id").agg(F.count("*").alias("abnormal"))


_ORDER = "(us, family, frame_number)"
QUERIES = [
    ("k03_focus_failures", focus, f"WITH {SCORED_SQL} SELECT capture_id, session_id, rca_label, priority_score FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rca_label NOT IN ('UNKNOWN', 'NORMAL_CALL') DESC, priority_score DESC, confidence_pct DESC, duration_ms DESC, session_id) AS r FROM sc) WHERE r = 1"),
    ("f15_abnormal_sessions", abnormal_sessions, f"WITH {SESSIONS_SQL} SELECT capture_id, count(*) AS abnormal FROM rca WHERE rca_label NOT IN ('UNKNOWN', 'NORMAL_CALL') GROUP BY 1"),
    ("a41_session_anchors", anchors, f"WITH {SEGMENTS_SQL}, a AS (SELECT capture_id, session_id, arg_min(call_id, {_ORDER}) FILTER (call_id IS NOT NULL) AS c, min('dia-' || user_id) FILTER (protocol = 'DIAMETER') AS di, arg_min(teid, {_ORDER}) FILTER (teid IS NOT NULL) AS te, min(imsi) AS im, min(framed_ip) AS ip FROM s GROUP BY 1, 2), "
     "b AS (SELECT capture_id, session_id, unnest([1, 3, 4, 8, 10, 15]) AS rank, unnest(['Call-ID', 'Diameter Session-ID', 'Tunnel ID (TEID)', 'IMSI', 'Subscriber IP', 'Session-ID']) AS label, unnest([c, di, te, im, ip, session_id]) AS value FROM a) "
     "SELECT capture_id, session_id, CAST(place AS INT) AS place, label, value FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY rank) AS place FROM b WHERE value IS NOT NULL) WHERE place <= 5"),
    ("a45_session_names", session_names, f"WITH {SEGMENTS_SQL} SELECT capture_id, session_id, coalesce(arg_min(call_id, {_ORDER}) FILTER (call_id IS NOT NULL), min('dia-' || user_id) FILTER (protocol = 'DIAMETER'), arg_min(teid, {_ORDER}) FILTER (teid IS NOT NULL), 'session:' || count(*)) AS name FROM s GROUP BY 1, 2"),
    ("j32_session_apns", apns, f"WITH {SEGMENTS_SQL}, a AS (SELECT capture_id, session_id, 'net' || (k % 4) AS apn, min({_ORDER}) AS o FROM s WHERE protocol IN ('GTP', 'HTTP') GROUP BY 1, 2, 3) SELECT capture_id, session_id, string_agg(apn, ',' ORDER BY o) AS apns FROM a GROUP BY 1, 2"),
    ("j31_party_networks", party_networks, f"WITH {NETWORKS_SQL} SELECT capture_id, session_id, CASE WHEN code = '26201' THEN 'Deutsche Telekom Germany' WHEN code = '262002' THEN 'Vodafone Germany' WHEN code = '262077' THEN 'PLMN 262-077' WHEN prefix = '171' THEN 'Deutsche Telekom Germany (heuristic)' WHEN prefix = '152' THEN 'Vodafone Germany (heuristic)' ELSE 'Unknown' END AS network, "
     "CASE WHEN code IS NOT NULL THEN kind || substr(code, 1, 3) || '-' || substr(code, 4) WHEN prefix IS NOT NULL THEN 'number prefix +49 ' || prefix ELSE 'none' END AS network_source FROM nw"),
    ("j28_resolved_nodes", resolved_nodes, f"WITH {MESSAGES_SQL}, c AS (SELECT capture_id, CASE protocol WHEN 'SIP' THEN 'P-CSCF' WHEN 'DIAMETER' THEN 'HSS/OCS' WHEN 'GTP' THEN 'UPF/SGW' WHEN 'HTTP' THEN '5GC NF' ELSE 'AMF/MME' END AS role, dst_ip AS address, count(*) AS n FROM m GROUP BY 1, 2, 3), i AS (SELECT capture_id, address, arg_min(role, role) AS role, arg_min(n / total, role) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, role ORDER BY n DESC, address) AS r, sum(n) OVER (PARTITION BY capture_id, role) AS total FROM c) WHERE r = 1 GROUP BY 1, 2), "
     "a AS (SELECT DISTINCT capture_id, unnest([src_ip, dst_ip]) AS address FROM m), b AS (SELECT a.*, i.confidence, coalesce(i.role, CASE WHEN address LIKE '172.%' THEN 'IMS' ELSE 'CORE' END) AS role FROM a LEFT JOIN i USING (capture_id, address)) SELECT capture_id, address, role, CASE WHEN role IN ('P-CSCF', 'UPF/SGW', 'AMF/MME') THEN role ELSE address END AS node, CASE WHEN role IN ('P-CSCF', 'UPF/SGW', 'AMF/MME') THEN role ELSE split_part(address, '.', 1) || '.' || split_part(address, '.', 2) || '.x.x' END AS label, round(confidence, 6) AS confidence FROM b"),
    ("g04_topology_lines", topology_lines, f"WITH {MESSAGES_SQL}, c AS (SELECT capture_id, CASE protocol WHEN 'NAS_5GS' THEN 2 WHEN 'GTP' THEN 3 ELSE 4 END AS place, src_ip, dst_ip, count(*) AS n FROM m WHERE protocol IN ('NAS_5GS', 'GTP', 'SIP') GROUP BY 1, 2, 3, 4), b AS (SELECT *, split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2) || '.x.x' AS a, split_part(dst_ip, '.', 1) || '.' || split_part(dst_ip, '.', 2) || '.x.x' AS z FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, place ORDER BY n DESC, src_ip, dst_ip) AS r FROM c) WHERE r = 1) "
     "SELECT capture_id, place, CASE place WHEN 2 THEN 'gNB/eNB ' || a || ' -> NGAP/S1AP -> AMF/MME ' || z WHEN 3 THEN 'UPF/SGW ' || a || ' <-> PFCP/GTPv2 <-> SMF/PGW-C ' || z ELSE 'P-CSCF ' || a || ' -> SIP -> I/S-CSCF ' || z END AS line FROM b UNION ALL SELECT capture_id, 1, 'UE (' || min(imsi) || ')' FROM m GROUP BY 1 UNION ALL SELECT capture_id, 5, 'SIP INVITE -> ' || max(call_id) FROM m GROUP BY 1 HAVING max(call_id) IS NOT NULL"),
    ("a36_traffic_series", traffic_series, f"WITH {SESSIONS_SQL} SELECT capture_id, CAST(place AS INT) AS place, messages AS value FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_ts, session_id) AS place FROM ss) WHERE place <= 10"),
    ("m28_evidence", evidence_lists, f"WITH {EVIDENCE_SQL} SELECT capture_id, session_id, array_to_string(evidence, '; ') AS evidence FROM ex"),
    ("m29_ladder", ladder, f"WITH {EVIDENCE_SQL}, {LADDER_SQL} SELECT capture_id, session_id, step, protocol, label, from_entity, to_entity, status FROM ld"),
    ("m38_explanation_rows", explanation_rows, f"WITH {EVIDENCE_SQL}, {LADDER_SQL}, {EXPLAINED_SQL} SELECT capture_id, session_id, rca_label, confidence_pct, CAST(len(evidence) AS INT) AS evidence, coalesce(features, '') AS features, coalesce(ladder_steps, 0) AS ladder_steps, coalesce(failed_steps, 0) AS failed_steps FROM ex LEFT JOIN cf USING (capture_id, session_id) LEFT JOIN ls USING (capture_id, session_id)"),
    ("r16_narrative", narratives, f"WITH {EVIDENCE_SQL} SELECT capture_id, session_id, concat_ws(' | ', lower(replace(rca_label, '_', ' ')) || ' (' || call_type || '): ' || evidence[1], CASE WHEN len(evidence) > 1 THEN 'also ' || array_to_string(evidence[2:3], ', ') END, CASE WHEN len(slow) > 0 THEN 'waits at ' || array_to_string(slow[1:2], ', ') END) AS narrative FROM ex"),
    ("p48_session_context", contexts, f"WITH {FEATURES_SQL}, v AS (SELECT capture_id, session_id, arg_min(CASE k % 16 WHEN 3 THEN 'NOKIA' ELSE 'HUAWEI' END, {_ORDER}) FILTER (k % 16 IN (3, 5)) AS a, bool_or(k % 16 = 7) AS b FROM s GROUP BY 1, 2) SELECT capture_id || CASE WHEN capture_id = 'cap-3' THEN '-visited' ELSE '' END AS capture_id, session_id, CASE WHEN capture_id = 'cap-3' THEN 'ROAMING' ELSE 'HOME' END AS network_scope, coalesce(a, CASE WHEN b THEN 'ERICSSON' END, 'UNKNOWN') AS vendor, array_to_string(protocols, ',') AS protocols, call_type FROM ft JOIN v USING (capture_id, session_id)"),
]
