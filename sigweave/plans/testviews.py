"""A signalling view over the ``events`` table, by whole-number rules, so that other SQL engines compute the same rows.

MESSAGES_SQL is the same view in DuckDB's SQL, as a common table expression named ``m``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.schemas import conform

PROTOCOLS = {"click": "SIP", "view": "HTTP", "purchase": "DIAMETER", "error": "GTP", "signup": "NAS_5GS"}
HOUR = 3600.0
#: Gap between sessions and window of interval joins that suit the density of ``events``.
GAP, WINDOW = 6 * HOUR, HOUR


def messages(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = events.select(
        F.concat(F.lit("cap-"), (F.col("user_id") % 10).cast("string")).alias("capture_id"), F.col("event_id").alias("frame_number"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"),
        F.element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), F.col("event_type")).alias("protocol"), F.concat(F.lit("26201"), F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("imsi"),
        k.alias("k"), "user_id", F.date_format("ts", "yyyyMMdd").alias("day"), "value",
    )
    sip, http, dia, gtp, nas = (F.col("protocol") == p for p in PROTOCOLS.values())
    mod = lambda n: F.col("k") % n
    rows = rows.withColumns({
        "ts": F.col("us") / 1e6,
        "call_id": F.when(sip, F.concat(F.lit("call-"), F.col("user_id").cast("string"), F.lit("-"), F.col("day"))),
        "method": F.when(sip, F.when(mod(8) == 0, "INVITE").when(mod(8) == 3, "BYE").when(mod(8) == 4, "CANCEL")),
        "status_code": F.when(sip, F.when(mod(8) == 1, "180").when(mod(8) == 2, "200").when(mod(8) == 5, "487").when(mod(8) == 6, "486").when(mod(8) == 7, "480")).when(http, F.when(mod(10) == 0, "503").when(mod(10) == 1, "404").otherwise("200")),
        "result_code": F.when(dia, F.when(mod(20) == 0, "5004").when(mod(20) == 1, "5003").when(mod(20) == 2, "5550").when(mod(20) == 3, "4012").otherwise("2001")),
        "command_code": F.when(dia, "272"), "command_name": F.when(dia, "CCR"),
        "cause_code": F.when(gtp, F.when(mod(5) == 0, "64").otherwise("16")),
        "nas": F.when(nas, F.when(mod(6) == 0, "Registration Reject").when(mod(6) == 1, "Registration Accept").otherwise("Registration Request")),
        "src_ip": F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), mod(16).cast("string")), "dst_ip": F.concat(F.lit("172.16.0."), mod(8).cast("string")),
        "framed_ip": F.concat(F.lit("10.23."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")),
    })
    rows = rows.withColumn("message", F.coalesce("method", F.when(sip | http, F.col("status_code")), F.when(dia, F.concat(F.lit("CCR "), F.col("result_code"))), F.when(gtp, F.concat(F.lit("Cause "), F.col("cause_code"))), "nas"))
    bad = dia & (F.col("result_code") != "2001")
    rows = rows.withColumns({
        "is_failure": F.coalesce((sip & F.col("status_code").rlike("^[456]")) | (http & F.col("status_code").rlike("^[45]")) | bad | (gtp & (F.col("cause_code") == "64")) | (nas & (F.col("nas") == "Registration Reject")), F.lit(False)),
        "is_auth_failure": dia & (F.col("result_code") == "5003"), "is_roaming_failure": dia & (F.col("result_code") == "5004"), "is_charging_failure": bad, "is_subscriber_absent": dia & (F.col("result_code") == "5550"),
        "technology": F.when(sip, "IMS").when(http, "HTTP").when(dia, "Core").when(gtp, "LTE").otherwise("5G"), "dia_session_id": F.when(dia, F.concat(F.lit("dia-"), F.col("user_id").cast("string"))),
        "teids": F.when(gtp, F.array(F.concat(F.lit("teid-"), F.expr("k div 3").cast("string"), F.lit("-"), F.col("user_id").cast("string")))),
    })
    return conform(rows.drop("day", "nas", "user_id")).withColumn("message_uid", F.col("frame_number"))


MESSAGES_SQL = """
e AS (
  SELECT event_id, user_id, value, event_type, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) AS us FROM events
), m0 AS (
  SELECT 'cap-' || (user_id % 10) AS capture_id, event_id AS frame_number, us, us / 1e6 AS ts, k, value, user_id,
    CASE event_type WHEN 'click' THEN 'SIP' WHEN 'view' THEN 'HTTP' WHEN 'purchase' THEN 'DIAMETER' WHEN 'error' THEN 'GTP' ELSE 'NAS_5GS' END AS protocol,
    '26201' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS imsi,
    CASE WHEN event_type = 'click' THEN 'call-' || user_id || '-' || strftime(ts, '%Y%m%d') END AS call_id,
    CASE WHEN event_type = 'click' THEN CASE k % 8 WHEN 0 THEN 'INVITE' WHEN 3 THEN 'BYE' WHEN 4 THEN 'CANCEL' END END AS method,
    CASE WHEN event_type = 'click' THEN CASE k % 8 WHEN 1 THEN '180' WHEN 2 THEN '200' WHEN 5 THEN '487' WHEN 6 THEN '486' WHEN 7 THEN '480' END
         WHEN event_type = 'view' THEN CASE k % 10 WHEN 0 THEN '503' WHEN 1 THEN '404' ELSE '200' END END AS status_code,
    CASE WHEN event_type = 'purchase' THEN CASE k % 20 WHEN 0 THEN '5004' WHEN 1 THEN '5003' WHEN 2 THEN '5550' WHEN 3 THEN '4012' ELSE '2001' END END AS result_code,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 5 = 0 THEN '64' ELSE '16' END END AS cause_code,
    CASE WHEN event_type = 'signup' THEN CASE k % 6 WHEN 0 THEN 'Registration Reject' WHEN 1 THEN 'Registration Accept' ELSE 'Registration Request' END END AS nas,
    '10.0.' || (user_id % 4) || '.' || (k % 16) AS src_ip, '172.16.0.' || (k % 8) AS dst_ip,
    '10.23.' || (user_id // 256) || '.' || (user_id % 256) AS framed_ip,
    CASE WHEN event_type = 'error' THEN 'teid-' || (k // 3) || '-' || user_id END AS teid
  FROM e
), m AS (
  SELECT *,
    coalesce(method, CASE WHEN protocol IN ('SIP', 'HTTP') THEN status_code END, CASE WHEN protocol = 'DIAMETER' THEN 'CCR ' || result_code END, CASE WHEN protocol = 'GTP' THEN 'Cause ' || cause_code END, nas) AS message,
    CASE protocol WHEN 'SIP' THEN 'IMS' WHEN 'HTTP' THEN 'HTTP' WHEN 'DIAMETER' THEN 'Core' WHEN 'GTP' THEN 'LTE' ELSE '5G' END AS technology,
    CASE protocol WHEN 'SIP' THEN 0 WHEN 'DIAMETER' THEN 1 WHEN 'GTP' THEN 3 ELSE 4 END AS family,
    coalesce((protocol = 'SIP' AND regexp_matches(status_code, '^[456]')) OR (protocol = 'HTTP' AND regexp_matches(status_code, '^[45]')) OR (protocol = 'DIAMETER' AND result_code <> '2001')
      OR (protocol = 'GTP' AND cause_code = '64') OR (protocol = 'NAS_5GS' AND nas = 'Registration Reject'), false) AS is_failure
  FROM m0
)"""

#: Adds s: messages with segment (gap of six hours per subscriber) and session_id.
SEGMENTS_SQL = (
    MESSAGES_SQL
    + """, g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id, imsi ORDER BY ts, frame_number) > 21600 THEN 1 ELSE 0 END AS cut FROM m
), s0 AS (
  SELECT *, CAST(sum(cut) OVER (PARTITION BY capture_id, imsi ORDER BY ts, frame_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g
), s AS (
  SELECT *, CASE WHEN segment > 0 THEN imsi || ':seg' || (segment + 1) ELSE imsi END AS session_id FROM s0
)"""
)

#: Adds ss (session records) and rca (the rules that the view can reach).
SESSIONS_SQL = (
    SEGMENTS_SQL
    + """, ss AS (
  SELECT capture_id, session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, list_sort(list(DISTINCT protocol)) AS protocols, list_sort(list(DISTINCT technology)) AS technologies,
    arg_max(status_code, (us, frame_number)) FILTER (protocol = 'SIP' AND status_code <> '100') AS final_sip_code,
    min(ts) FILTER (protocol = 'SIP' AND regexp_matches(status_code, '^[456]')) AS failure_ts,
    count(*) FILTER (protocol = 'SIP') AS sip_count, count(*) FILTER (protocol = 'DIAMETER') AS dia_count, count(*) FILTER (protocol = 'GTP') AS gtp_count, count(*) FILTER (protocol = 'HTTP') AS http_count,
    count(*) FILTER (method = 'INVITE') AS invites,
    coalesce(bool_or(method = 'INVITE'), false) AS has_invite, coalesce(bool_or(method = 'BYE'), false) AS has_bye, coalesce(bool_or(method = 'CANCEL'), false) AS has_cancel,
    coalesce(bool_or(protocol = 'SIP' AND status_code = '180'), false) AS has_180, coalesce(bool_or(protocol = 'SIP' AND status_code = '200'), false) AS has_200,
    coalesce(bool_or(result_code = '5004'), false) AS roaming_denied, coalesce(bool_or(result_code = '5003'), false) AS auth_failed, coalesce(bool_or(result_code = '5550'), false) AS subscriber_absent,
    coalesce(bool_or(result_code <> '2001'), false) AS charging_failed, coalesce(bool_or(result_code = '2001'), false) AS dia_success, count(*) FILTER (protocol = 'DIAMETER' AND is_failure) AS dia_failures,
    count(*) FILTER (cause_code = '64') AS core_failures, count(*) FILTER (cause_code = '16') AS core_successes, count(*) FILTER (nas = 'Registration Reject') AS nas_failures, count(*) FILTER (nas IN ('Registration Accept', 'Registration Request')) AS nas_successes,
    coalesce(bool_or(protocol = 'HTTP' AND status_code = '404'), false) AS http_4xx, coalesce(bool_or(protocol = 'HTTP' AND status_code = '503'), false) AS http_5xx
  FROM s GROUP BY 1, 2
), rca0 AS (
  SELECT *, CASE WHEN roaming_denied THEN 'R0_ROAMING_DENIED' WHEN auth_failed THEN 'R0_AUTH' WHEN subscriber_absent THEN 'R0_SUBSCRIBER_ABSENT' WHEN charging_failed THEN 'R0_CHARGING'
    WHEN dia_success AND dia_failures = 0 THEN 'R0A_DIAMETER_SUCCESS' WHEN has_200 AND has_invite AND has_bye THEN 'R1_NORMAL' WHEN final_sip_code = '486' THEN 'R2_BUSY' WHEN final_sip_code = '480' THEN 'R2_UNREACHABLE'
    WHEN final_sip_code = '487' AND has_cancel THEN 'R2_CANCEL' WHEN final_sip_code = '487' AND NOT has_180 THEN 'R2_487_EARLY' WHEN final_sip_code = '487' THEN 'R2_487_TIMEOUT'
    WHEN http_5xx THEN 'R3_SBI_5XX' WHEN http_4xx THEN 'R3_SBI_4XX' WHEN nas_failures > 0 THEN 'R3B_NAS' WHEN core_failures > 0 THEN 'R4_GTP' WHEN core_successes > 0 OR nas_successes > 0 THEN 'R4B_CONTROL_SUCCESS' ELSE 'R7_UNKNOWN' END AS rule_id
  FROM ss
), rca AS (
  SELECT *, CASE WHEN rule_id IN ('R0_ROAMING_DENIED', 'R0_AUTH') THEN 'SUBSCRIBER_BARRED' WHEN rule_id IN ('R0_SUBSCRIBER_ABSENT', 'R2_UNREACHABLE') THEN 'SUBSCRIBER_UNREACHABLE' WHEN rule_id = 'R0_CHARGING' THEN 'CHARGING_FAILURE'
    WHEN rule_id IN ('R0A_DIAMETER_SUCCESS', 'R1_NORMAL', 'R4B_CONTROL_SUCCESS') THEN 'NORMAL_CALL' WHEN rule_id = 'R2_BUSY' THEN 'USER_BUSY' WHEN rule_id = 'R2_CANCEL' THEN 'USER_ABORT' WHEN rule_id = 'R2_487_EARLY' THEN 'NETWORK_REJECTION' WHEN rule_id = 'R2_487_TIMEOUT' THEN 'SERVICE_TIMEOUT'
    WHEN rule_id = 'R3_SBI_5XX' THEN 'NF_FAILURE' WHEN rule_id = 'R3_SBI_4XX' THEN 'CLIENT_ERROR' WHEN rule_id = 'R3B_NAS' THEN 'NAS_REJECTION' WHEN rule_id = 'R4_GTP' THEN 'CORE_NETWORK_FAILURE' ELSE 'UNKNOWN' END AS rca_label,
    CASE WHEN rule_id IN ('R0A_DIAMETER_SUCCESS', 'R7_UNKNOWN') THEN 'LOW' WHEN rule_id IN ('R2_487_EARLY', 'R2_487_TIMEOUT', 'R3_SBI_4XX', 'R4B_CONTROL_SUCCESS') THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
    CASE rule_id WHEN 'R0_ROAMING_DENIED' THEN 94 WHEN 'R0_AUTH' THEN 90 WHEN 'R0_SUBSCRIBER_ABSENT' THEN 93 WHEN 'R0_CHARGING' THEN 92 WHEN 'R0A_DIAMETER_SUCCESS' THEN 68 WHEN 'R1_NORMAL' THEN 98 WHEN 'R2_BUSY' THEN 95 WHEN 'R2_UNREACHABLE' THEN 90
      WHEN 'R2_CANCEL' THEN 90 WHEN 'R2_487_EARLY' THEN 75 WHEN 'R2_487_TIMEOUT' THEN 70 WHEN 'R3_SBI_5XX' THEN 90 WHEN 'R3_SBI_4XX' THEN 80 WHEN 'R3B_NAS' THEN 86 WHEN 'R4_GTP' THEN 85 WHEN 'R4B_CONTROL_SUCCESS' THEN 72 ELSE 30 END AS confidence_pct
  FROM rca0
)"""
)
