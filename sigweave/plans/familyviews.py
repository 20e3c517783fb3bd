"""A second signalling view over ``events``: every subscriber follows one of seventeen procedures, so that all families and all rules of the cascade occur.

Steps of a procedure come in the order that the events' numbers give, so a session holds any part of its procedure and rules hold or fail by what was seen.
FAMILIES_SQL is the same view in DuckDB's SQL, as common table expressions; its rows are named ``f``, and ``fs`` are its sessions with their facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions import codes, predicates
from sigweave.schemas import conform

DAY = 86400.0
#: Gap between sessions that suits the density of a subscriber's events.
GAP = 12 * 3600.0

# (protocol, message, method, status, result, command, cause, ICMP type and code, lost or timed out), by procedure; the step is the event's number modulo the length
_N = None
PROCEDURES = [
    [("DIAMETER", "AAR 2001", _N, _N, "2001", "265", _N, _N, _N, _N), ("DIAMETER", "AAR 5012", _N, _N, "5012", "265", _N, _N, _N, _N), ("DIAMETER", "RAR", _N, _N, _N, "258", _N, _N, _N, _N)],
    [("RADIUS", "Access-Request", _N, "1", _N, _N, _N, _N, _N, _N), ("RADIUS", "Access-Accept", _N, "2", _N, _N, _N, _N, _N, _N), ("RADIUS", "Access-Reject", _N, "3", _N, _N, _N, _N, _N, _N), ("RADIUS", "Access-Challenge", _N, "11", _N, _N, _N, _N, _N, _N)],
    [("DIAMETER", "CLR", _N, _N, _N, "317", _N, _N, _N, _N), ("SCTP", "HEARTBEAT", _N, _N, _N, _N, _N, _N, _N, _N), ("SCTP", "SACK", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("RADIUS", "Accounting-Request", _N, "4", _N, _N, _N, _N, _N, _N), ("RADIUS", "Accounting-Response", _N, "5", _N, _N, _N, _N, _N, _N), ("GTP", "Create Session Response", _N, _N, _N, _N, "64", _N, _N, _N), ("RADIUS", "CoA-ACK", _N, "44", _N, _N, _N, _N, _N, _N)],
    [("S1AP", "Handover Resource Allocation", _N, _N, _N, _N, _N, _N, _N, _N), ("S1AP", "Handover Notification", _N, _N, _N, _N, _N, _N, _N, _N), ("S1AP", "UE Context Release", _N, _N, _N, _N, _N, _N, _N, _N), ("GTP", "Modify Bearer Response", _N, _N, _N, _N, "16", _N, _N, _N)],
    [("NAS_EPS", "Tracking Area Update Request", _N, _N, _N, _N, _N, _N, _N, _N), ("NAS_EPS", "Tracking Area Update Accept", _N, _N, _N, _N, _N, _N, _N, _N), ("NAS_EPS", "Tracking Area Update Complete", _N, _N, _N, _N, _N, _N, _N, _N), ("S1AP", "MME Status Transfer", _N, _N, _N, _N, _N, _N, _N, _N), ("GTP", "Modify Bearer Response", _N, _N, _N, _N, "16", _N, _N, _N), ("GTP", "Create Session Response", _N, _N, _N, _N, "18", _N, _N, _N)],
    [("MAP", "sendAuthenticationInfo", _N, _N, _N, _N, _N, _N, _N, _N), ("MAP", "updateGprsLocation", _N, _N, _N, _N, _N, _N, _N, _N), ("MAP", "insertSubscriberData", _N, _N, _N, _N, _N, _N, _N, _N), ("MAP", "returnResultLast", _N, _N, _N, _N, _N, _N, _N, _N), ("MAP", "cancelLocation", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("RANAP", "Routing Area Update Request", _N, _N, _N, _N, _N, _N, _N, _N), ("RANAP", "SecurityModeComplete", _N, _N, _N, _N, _N, _N, _N, _N), ("RANAP", "Iu-ReleaseComplete", _N, _N, _N, _N, _N, _N, _N, _N), ("BSSAP", "Routing Area Update Accept", _N, _N, _N, _N, _N, _N, _N, _N), ("RANAP", "Iu-ReleaseCommand", _N, _N, _N, _N, _N, _N, _N, _N), ("BSSAP", "Location Update Reject", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("ICMP", "Destination unreachable", _N, _N, _N, _N, _N, "3", "3", _N), ("GTP", "Release Access Bearers Request", _N, _N, _N, _N, "16", _N, _N, _N), ("GTP", "Echo Response", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("PFCP", "Session Establishment Request", _N, _N, _N, _N, _N, _N, _N, _N), ("PFCP", "Session Establishment Response", _N, _N, _N, _N, "1", _N, _N, _N), ("PFCP", "Session Report Request", _N, _N, _N, _N, _N, _N, _N, _N), ("PFCP", "Session Report Response", _N, _N, _N, _N, "1", _N, _N, _N)],
    [("PFCP", "Session Modification Request", _N, _N, _N, _N, _N, _N, _N, _N), ("PFCP", "Session Modification Response", _N, _N, _N, _N, "65", _N, _N, _N), ("NGAP", "UE Context Release", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("SIP", "INVITE", "INVITE", _N, _N, _N, _N, _N, _N, _N), ("SIP", "603", _N, "603", _N, _N, _N, _N, _N, _N), ("SIP", "404", _N, "404", _N, _N, _N, _N, _N, _N), ("SIP", "500", _N, "500", _N, _N, _N, _N, _N, _N), ("SIP", "488", _N, "488", _N, _N, _N, _N, _N, _N)],
    [("DNS", "A response", _N, _N, _N, _N, "0", _N, _N, _N), ("DNS", "A response", _N, _N, _N, _N, "2", _N, _N, _N), ("UDP", "DATA", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("ICMP", "Host unreachable", _N, _N, _N, _N, _N, "3", "1", _N), ("ICMP", "Echo reply", _N, _N, _N, _N, _N, "0", "0", _N), ("TCP", "TCP", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("NAS_EPS", "Service Request", _N, _N, _N, _N, _N, _N, _N, _N), ("NAS_EPS", "Service Reject", _N, _N, _N, _N, "9", _N, _N, _N), ("NGAP", "Initial UE Message", _N, _N, _N, _N, _N, _N, _N, _N)],
    [("TCP", "TCP", _N, _N, _N, _N, _N, _N, _N, _N), ("TCP", "TCP", _N, _N, _N, _N, _N, _N, _N, "lost"), ("TCP", "TCP", _N, _N, _N, _N, _N, _N, _N, "late")],
    [("IKEV2", "IKE_AUTH", _N, _N, _N, _N, _N, _N, _N, _N), ("IKEV2", "IKE_SA_INIT", _N, _N, _N, _N, _N, _N, _N, _N), ("DIAMETER", "RAR", _N, _N, _N, "258", _N, _N, _N, _N)],
]
STEP = ["protocol", "message", "method", "status_code", "result_code", "command_code", "cause_code", "icmp_type", "icmp_code", "mark"]
_ROWS = [(p, i, len(steps), *step) for p, steps in enumerate(PROCEDURES) for i, step in enumerate(steps)]
#: Families that the view holds, by name.
FAMILIES = sorted({r[3] for r in _ROWS})


def messages(spark: SparkSession, folder: str) -> DataFrame:
    # the steps are the sixty-odd rows above, whatever the data
    steps = spark.createDataFrame(_ROWS, "procedure_id int, step int, steps int, " + ", ".join(f"{c} string" for c in STEP))
    lengths = F.array(*[F.lit(len(s)) for s in PROCEDURES])
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), (F.col("user_id") % len(PROCEDURES)).cast("int").alias("procedure_id"))
    rows = events.withColumn("step", F.col("k") % F.get(lengths, F.col("procedure_id"))).join(F.broadcast(steps.drop("steps")), ["procedure_id", "step"])
    p, user = F.col("protocol"), F.col("user_id").cast("string")
    ended = lambda prefix: F.concat(F.lit(prefix), user)
    octets = lambda first: F.concat(F.lit(first), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    rows = rows.withColumns({
        "capture_id": F.concat(F.lit("cap-"), (F.col("user_id") % 10).cast("string")), "frame_number": F.col("event_id"), "ts": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6,
        "imsi": F.concat(F.lit("26202"), F.lpad(user, 10, "0")), "src_ip": octets("192.168."), "dst_ip": F.concat(F.lit("172.20.0."), (F.col("k") % 4).cast("string")),
        "retransmission": F.col("mark") == "lost", "timeout": F.col("mark") == "late",
        "command_name": F.when(p == "DIAMETER", F.substring_index("message", " ", 1)), "call_id": F.when(p == "SIP", ended("call-")), "dia_session_id": F.when(p == "DIAMETER", ended("dia-")),
        "teids": F.when(p == "GTP", F.array(F.concat(F.lit("t"), (F.col("k") % 2).cast("string"), F.lit("-"), user))), "seid": F.when(p == "PFCP", ended("seid-")), "access_ids": F.when(p.isin("S1AP", "NGAP"), F.array(ended("ue-"))),
        "ike_inner_ips": F.when(p == "IKEV2", F.array(octets("10.64."))), "framed_ip": F.when((p == "DIAMETER") & (F.col("procedure_id") == 16), octets("10.64.")),
        "transaction_id": F.when(p.isin("RADIUS", "DNS"), F.concat(F.lit("tx-"), (F.col("k") % 3).cast("string"), F.lit("-"), user)), "stream_id": F.when(p.isin("TCP", "UDP", "SCTP"), ended("st-")),
    })
    names = ("protocol", "message", "status_code", "cause_code", "retransmission", "icmp_type", "icmp_code")
    general = predicates.is_failure({c: F.col(c) for c in names} | {"reset": F.lit(None).cast("boolean")})
    bad = F.coalesce(~F.col("result_code").isin(*predicates.DIAMETER_SUCCESS, "1001"), F.lit(False))
    rows = rows.withColumns({
        "is_failure": F.when(p == "DIAMETER", bad).when(p == "SIP", F.coalesce(F.col("status_code").rlike("^[456]"), F.lit(False))).otherwise(general),
        "is_policy_reject": bad & F.col("command_code").isin("258", "265"), "is_auth_failure": F.lit(False), "is_charging_failure": F.lit(False), "is_subscriber_absent": F.lit(False), "technology": codes.technology(p, F.lit(False), F.lit(False)),
    })
    return conform(rows.drop("procedure_id", "step", "mark", "user_id", "event_id")).withColumn("message_uid", F.col("frame_number"))


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


FAMILIES_SQL = f"""
steps (pid, step, steps, protocol, message, method, status_code, result_code, command_code, cause_code, icmp_type, icmp_code, mark) AS (
  VALUES {", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _ROWS)}
), fe AS (
  SELECT event_id AS frame_number, user_id, epoch_us(ts) / 1e6 AS ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(user_id % {len(PROCEDURES)} AS INT) AS pid FROM events
), f0 AS (
  SELECT 'cap-' || (user_id % 10) AS capture_id, '26202' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS imsi, fe.*, s.* EXCLUDE (pid), upper(s.message) AS text, '192.168.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip, '172.20.0.' || (k % 4) AS dst_ip,
    CASE WHEN protocol = 'GTP' THEN 't' || (k % 2) || '-' || user_id END AS teid,
    CASE WHEN protocol IN ('RADIUS', 'DNS') THEN 'tx-' || (k % 3) || '-' || user_id END AS transaction_id, CASE WHEN protocol IN ('TCP', 'UDP', 'SCTP') THEN 'st-' || user_id END AS stream_id
  FROM fe JOIN steps s ON s.pid = fe.pid AND fe.k % s.steps = s.step
), f1 AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id, imsi ORDER BY ts, frame_number) > {GAP:.0f} THEN 1 ELSE 0 END AS cut FROM f0
), f AS (
  SELECT * EXCLUDE (cut), imsi || CASE WHEN seg > 0 THEN ':seg' || (seg + 1) ELSE '' END AS session_id FROM (SELECT *, CAST(sum(cut) OVER (PARTITION BY capture_id, imsi ORDER BY ts, frame_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM f1)
), fs AS (
  SELECT capture_id, session_id, min(ts) AS start_ts, count(*) AS messages, list(DISTINCT protocol) AS protocols,
    arg_max(status_code, (ts, frame_number)) FILTER (protocol = 'SIP' AND status_code IS NOT NULL) AS code, bool_or(result_code = '5012') AS policy, coalesce(bool_or(result_code = '2001'), false) AS dia_ok, count(*) FILTER (result_code = '5012') AS dia_bad, bool_or(command_code = '317') AS clr,
    coalesce(bool_or(protocol = 'RADIUS' AND status_code = '3'), false) AS radius_bad, coalesce(bool_or(protocol = 'RADIUS' AND status_code IN ('2', '5', '44')), false) AS radius_ok,
    count(*) FILTER (protocol = 'GTP' AND cause_code = '64' OR protocol = 'PFCP' AND cause_code = '65') AS core_bad, count(*) FILTER (protocol = 'GTP' AND cause_code IN ('16', '18') OR protocol = 'PFCP' AND cause_code = '1') AS core_ok, count(*) FILTER (protocol = 'GTP' AND cause_code IN ('16', '18')) AS gtp_ok,
    count(*) FILTER (protocol = 'NAS_EPS' AND text = 'SERVICE REJECT') AS nas_bad, count(*) FILTER (protocol = 'NAS_EPS' AND text <> 'SERVICE REJECT') AS nas_ok,
    coalesce(bool_or(protocol = 'DNS' AND cause_code = '2'), false) AS dns_bad, count(*) FILTER (protocol = 'ICMP') AS icmp, coalesce(bool_or(icmp_type = '3'), false) AS icmp_bad, coalesce(bool_and(icmp_code = '3') FILTER (protocol = 'ICMP'), false) AS port_only,
    count(*) FILTER (mark = 'lost') AS lost, coalesce(bool_or(mark = 'late'), false) AS late, list(DISTINCT text) AS texts, count(*) FILTER (regexp_matches(text, 'RETURNRESULT|ACCEPT|COMPLETE')) AS results, bool_or(regexp_matches(text, 'REJECT')) AS refused
  FROM f GROUP BY 1, 2
), ff AS (
  SELECT *, list_contains(texts, 'HANDOVER RESOURCE ALLOCATION') AND list_contains(texts, 'HANDOVER NOTIFICATION') AS handover, list_has_all(texts, ['TRACKING AREA UPDATE REQUEST', 'TRACKING AREA UPDATE ACCEPT', 'TRACKING AREA UPDATE COMPLETE']) AS tau,
    list_contains(texts, 'UE CONTEXT RELEASE') AS released, list_contains(texts, 'MME STATUS TRANSFER') AS transferred, list_contains(texts, 'RELEASE ACCESS BEARERS REQUEST') AS freed, NOT (core_bad > 0 OR nas_bad > 0) AS clean,
    list_has_any(texts, ['SENDAUTHENTICATIONINFO']) AS auth, list_contains(texts, 'CANCELLOCATION') AS cancel, list_contains(texts, 'UPDATEGPRSLOCATION') OR list_contains(texts, 'LOCATION UPDATE REJECT') AS moved, list_contains(texts, 'INSERTSUBSCRIBERDATA') AS data
  FROM fs
), fr0 AS (
  SELECT *, list_contains(texts, 'SESSION ESTABLISHMENT REQUEST') AND list_contains(texts, 'SESSION ESTABLISHMENT RESPONSE') AND list_contains(texts, 'SESSION REPORT REQUEST') AND list_contains(texts, 'SESSION REPORT RESPONSE') AS healthy,
    icmp > 0 AND port_only AND freed AND core_ok > 0 AND core_bad = 0 AS benign,
    NOT list_contains(texts, 'SERVICE REJECT') AND ((gtp_ok = 0 AND len(list_filter(protocols, lambda x: x NOT IN ('SCTP', 'S1AP', 'NGAP', 'NAS_EPS', 'NAS_5GS'))) = 0 AND released AND handover) OR (gtp_ok >= 2 AND ((handover AND tau) OR (handover AND released) OR (tau AND transferred)))) AS lte,
    NOT refused AND list_has_any(protocols, ['MAP', 'RANAP', 'BSSAP']) AND ((list_has_all(texts, ['ROUTING AREA UPDATE REQUEST', 'SECURITYMODECOMPLETE', 'IU-RELEASECOMPLETE']) OR list_has_all(texts, ['ROUTING AREA UPDATE ACCEPT', 'IU-RELEASECOMMAND']))
      OR (auth AND cancel AND results >= 1) OR (auth AND moved AND (data OR results >= 2))) AS legacy
  FROM ff
), fr AS (
  SELECT *, CASE WHEN coalesce(policy, false) THEN 'R0_POLICY' WHEN radius_bad THEN 'R0_RADIUS_REJECT' WHEN dia_ok AND dia_bad = 0 THEN 'R0A_DIAMETER_SUCCESS'
    WHEN clr AND len(list_filter(protocols, lambda x: x NOT IN ('DIAMETER', 'SCTP'))) = 0 AND clean THEN 'R0AA_DIAMETER_HOUSEKEEPING' WHEN radius_ok AND clean THEN 'R0AB_RADIUS_SUCCESS' WHEN lte THEN 'R0B_LTE_MOBILITY_SUCCESS' WHEN legacy THEN 'R0C_LEGACY_MOBILITY_SUCCESS'
    WHEN benign THEN 'R0D_BENIGN_ICMP_CLEANUP' WHEN healthy THEN 'R0E_PFCP_HEALTHY' WHEN code = '603' THEN 'R2_REJECT' WHEN code = '404' THEN 'R2_ROUTING' WHEN dns_bad THEN 'R3B_DNS' WHEN icmp_bad THEN 'R3B_ICMP' WHEN nas_bad > 0 THEN 'R3B_NAS' WHEN core_bad > 0 THEN 'R4_GTP'
    WHEN core_ok > 0 OR nas_ok > 0 THEN 'R4B_CONTROL_SUCCESS' WHEN lost > 0 THEN 'R5_TCP_RETX' WHEN late THEN 'R5_TIMEOUT' WHEN code LIKE '5%' THEN 'R6_SERVER' WHEN code LIKE '4%' THEN 'R6_CLIENT' ELSE 'R7_UNKNOWN' END AS rule_id
  FROM fr0
)"""
