"""Normalization of decoded rows: the signalling view is written back as decoded fields and normalized again."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigweave.functions import fields, predicates
from sigweave.operators import normalize, seeds
from sigweave.plans.testviews import MESSAGES_SQL, messages


def decoded(s, d):
    """(capture_id, protocol, fields): what a decoder would have given for each message of the view."""
    rows = messages(s, d)
    pairs = {
        "frame.number": F.col("frame_number").cast("string"), "frame.time_epoch": F.col("ts").cast("string"), "ip.src": F.col("src_ip"), "ip.dst": F.col("dst_ip"), "sip.Call-ID": F.col("call_id"), "sip.Method": F.lower("method"),
        "sip.Status-Code": F.when(F.col("protocol") == "SIP", F.col("status_code")), "http.response.code": F.when(F.col("protocol") == "HTTP", F.col("status_code")), "diameter.Session-Id": F.col("dia_session_id"), "diameter.cmd.code": F.col("command_code"), "diameter.Result-Code": F.col("result_code"),
        "gtpv2.cause_value": F.col("cause_code"), "gtpv2.message_type": F.when(F.col("protocol") == "GTP", F.lit("33")), "e212.imsi": F.concat(F.lit(" "), "imsi", F.lit(" ")), "_ws.col.Info": F.when(F.col("protocol") == "NAS_5GS", F.col("message")),
    }
    return rows.select("capture_id", "protocol", F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull())).alias("fields"))


def normalized(s, d):
    rows = normalize.normalize(decoded(s, d))
    return rows.select("capture_id", "frame_number", "protocol", "technology", "message", "method", "status_code", "result_code", "command_name", "cause_code", "imsi", "is_failure")


def deduplicated(s, d):
    """The view twice over, without its repeats."""
    rows = normalize.normalize(decoded(s, d))
    return seeds.deduplicate(rows.unionByName(rows)).groupBy("protocol").agg(F.count("*").alias("n"))


def flow_failures(s, d):
    rows = messages(s, d)
    return rows.select("frame_number", predicates.flow_failure(F.col("protocol"), F.col("status_code"), F.col("result_code"), F.col("cause_code"), F.col("is_failure")).alias("failed"))


def identities(s, d):
    """Identities written into service texts and read from them again."""
    text = F.concat(F.lit("/nudm-sdm/v2/imsi-"), "imsi", F.lit("/x?gpsi=msisdn-49"), F.substring("imsi", 6, 8), F.lit("&y=%7B%22a%22%3A1%7D"))
    rows = messages(s, d).where("protocol = 'HTTP'").select("frame_number", text.alias("text"))
    rows = fields.with_sbi_context(rows, "text", F.lit(True))
    return rows.select("frame_number", F.col("sbi_service").alias("service"), "supi", "gpsi", F.col("sbi_imsi").alias("imsi"), F.col("sbi_msisdn").alias("msisdn"), fields.plain_payload("text").alias("plain"))


def decoded_families(s, d):
    """Events written as decoded rows of six other families, one for each subscriber: info texts, operation and message codes, and every spelling of tunnels and addresses."""
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    kind, k = F.col("user_id") % 6, F.col("k")
    text = lambda x: x.cast("string")
    info = F.when(kind == 0, F.when(k % 3 == 0, "SACK (Ack=7, Arwnd=106496) , Handover Notification").when(k % 3 == 1, "DATA (TSN=4), UE Context Release").otherwise("SACK (Ack=7, Arwnd=106496) ")).when(kind == 1, F.when(k % 3 == 0, "invoke  sendAuthenticationInfo").when(k % 3 == 1, "returnResultLast updateLocation").otherwise("returnError  unknownSubscriber"))
    tunnel = F.element_at(F.array(*map(F.lit, normalize.TUNNELS)), (k % 11 + 1))
    address = F.element_at(F.array(*map(F.lit, normalize.SUBSCRIBER_IPS[:7])), (k % 7 + 1))
    named = [
        (F.lit("frame.number"), text(F.col("event_id"))), (F.lit("_ws.col.Info"), info), (F.lit("tcap.tid"), F.when((kind == 2) & (k % 7 != 0), text(k))), (F.lit("inap.opcode"), F.when((kind == 2) & (k % 5 != 0), text(k))), (F.lit("pfcp.msg_type"), F.when(kind == 3, text(50 + k % 8))),
        (F.lit("pfcp.cause"), F.when((kind == 3) & (k % 2 == 1), F.when(k % 4 == 1, "1").otherwise("65"))), (tunnel, F.when(kind == 4, F.concat(F.lit("t"), text(k)))), (address, F.when(kind == 4, F.concat(F.lit("10.1.1."), text(k)))), (F.lit("radius.code"), F.when(kind == 5, text(k % 6))),
    ]
    named = F.array(*[F.struct(key.alias("key"), value.alias("value")) for key, value in named])
    family = F.element_at(F.array(*map(F.lit, ["S1AP", "MAP", "INAP", "PFCP", "GTP", "RADIUS"])), kind.cast("int") + 1)
    return rows.select(F.lit("cap").alias("capture_id"), family.alias("protocol"), F.map_from_entries(F.filter(named, lambda e: e["value"].isNotNull())).alias("fields"))


def normalized_families(s, d):
    rows = normalize.normalize(decoded_families(s, d))
    release = predicates.inap_flags(F.col("procedure"))
    return rows.select("frame_number", "protocol", "message", "cause_code", "is_failure", F.array_join("teids", ",").alias("teids"), F.array_join("subscriber_ips", ",").alias("ips"), (release["service_logic"] & (F.col("protocol") == "INAP")).alias("service_logic"), "f_teid", "gtp_tid")


NORMALIZED_FAMILIES_SQL = """WITH n AS (
  SELECT event_id AS frame_number, user_id % 6 AS kind, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
), codes (op, name) AS (
  VALUES (1, 'OriginationAttemptAuthorized'), (2, 'CollectedInformation'), (3, 'RouteSelectFailure'), (4, 'OCalledPartyBusy'), (6, 'OAnswer'), (22, 'ReleaseCall'), (23, 'RequestReportBCSMEvent'), (24, 'EventReportBCSM'), (29, 'Continue'), (31, 'InitiateCallAttempt'), (41, 'ApplyCharging'), (43, 'CallInformationReport'), (46, 'ConnectToResource'), (48, 'DisconnectForwardConnection'), (63, 'PromptAndCollectUserInformation')
)
SELECT frame_number, ['S1AP', 'MAP', 'INAP', 'PFCP', 'GTP', 'RADIUS'][kind + 1] AS protocol,
  CASE kind WHEN 0 THEN ['Handover Notification', 'UE Context Release', 'S1AP'][k % 3 + 1] WHEN 1 THEN ['MAP sendAuthenticationInfo', 'MAP result updateLocation', 'MAP error unknownSubscriber'][k % 3 + 1] WHEN 2 THEN CASE WHEN k % 5 = 0 THEN 'UNKNOWN' ELSE coalesce(name, 'UNKNOWN_' || k) END
    WHEN 3 THEN ['Session Establishment Request', 'Session Establishment Response', 'Session Modification Request', 'Session Modification Response', 'Session Deletion Request', 'Session Deletion Response', 'Session Report Request', 'Session Report Response'][k % 8 + 1]
    WHEN 4 THEN 'GTP' ELSE ['RADIUS', 'Access-Request', 'Access-Accept', 'Access-Reject', 'Accounting-Request', 'Accounting-Response'][k % 6 + 1] END AS message,
  CASE WHEN kind = 3 AND k % 2 = 1 THEN CASE WHEN k % 4 = 1 THEN '1' ELSE '65' END END AS cause_code, CASE kind WHEN 1 THEN k % 3 = 2 WHEN 2 THEN k IN (3, 4) WHEN 3 THEN k % 4 = 3 WHEN 5 THEN k % 6 = 3 ELSE false END AS is_failure,
  CASE WHEN kind = 4 THEN 't' || k ELSE '' END AS teids, CASE WHEN kind = 4 THEN '10.1.1.' || k ELSE '' END AS ips, kind = 2 AND k IN (22, 29, 46, 63) AS service_logic, CASE WHEN kind = 4 AND k % 11 = 1 THEN 't' || k END AS f_teid, CASE WHEN kind = 4 AND k % 11 = 2 THEN 't' || k END AS gtp_tid
FROM n LEFT JOIN codes ON op = k WHERE NOT (kind = 2 AND k % 7 = 0)"""

QUERIES = [
    ("p04_normalize", normalized, f"WITH {MESSAGES_SQL} SELECT capture_id, frame_number, protocol, technology, CASE protocol WHEN 'SIP' THEN coalesce(method, status_code, 'SIP') WHEN 'HTTP' THEN status_code WHEN 'DIAMETER' THEN message WHEN 'GTP' THEN 'Create Session Response' ELSE nas END AS message, method, status_code, result_code, CASE WHEN protocol = 'DIAMETER' THEN 'CCR' END AS command_name, cause_code, imsi, is_failure FROM m"),
    ("p12_normalize_families", normalized_families, NORMALIZED_FAMILIES_SQL),
    ("a02_deduplicate", deduplicated, f"WITH {MESSAGES_SQL} SELECT protocol, count(*) AS n FROM m GROUP BY 1"),
    ("p44_flow_failures", flow_failures, f"WITH {MESSAGES_SQL} SELECT frame_number, is_failure AND NOT (protocol = 'SIP' AND false) AS failed FROM m"),
    ("p16_sbi_identities", identities, f"WITH {MESSAGES_SQL} SELECT frame_number, 'nudm-sdm' AS service, 'imsi-' || imsi AS supi, 'msisdn-49' || substr(imsi, 6, 8) AS gpsi, imsi, '49' || substr(imsi, 6, 8) AS msisdn, '/nudm-sdm/v2/imsi-' || imsi || '/x?gpsi=msisdn-49' || substr(imsi, 6, 8) || '&y={{\"a\":1}}' AS plain FROM m WHERE protocol = 'HTTP'"),
]
