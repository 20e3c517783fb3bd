"""Decoded rows to canonical messages: one projection for all protocol families, without a UDF or a shuffle.

Input: capture_id, protocol, fields (map of field name to text; a missing key, a blank and a blank list are the same).
Rows that do not meet their family's minimum (Call-ID; session and command; transaction; frame, time or address) go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import codes, fields, predicates
from sigweave.schemas import conform

# Field names of decoders, in order of precedence.
ALIASES = {
    "frame_number": ["frame.number"],
    "time": ["frame.time_epoch"],
    "src_ip": ["ip.src", "ipv6.src"],
    "dst_ip": ["ip.dst", "ipv6.dst"],
    "src_port": ["tcp.srcport", "udp.srcport", "sctp.srcport"],
    "dst_port": ["tcp.dstport", "udp.dstport", "sctp.dstport"],
    "stream_id": ["tcp.stream", "udp.stream", "sctp.assoc_index"],
    "transaction_id": ["transaction_id", "gtpv2.seq", "pfcp.seqno", "radius.id", "dns.id", "http2.streamid", "ikev2.ispi", "ike.ispi", "isakmp.ispi", "s1ap.MME_UE_S1AP_ID", "ngap.AMF_UE_NGAP_ID"],
    "procedure": ["s1ap.procedureCode", "ngap.procedureCode", "ranap.procedureCode", "gtpv2.message_type", "pfcp.msg_type", "radius.code", "sctp.chunk_type", "inap.opcode", "inap.localValue", "inap_opcode"],
    "cause_code": ["cause_code", "gtpv2.cause_value", "gtpv2.cause", "pfcp.cause", "nas_eps.emm.cause", "nas_5gs.mm.5gmm_cause", "dns.flags.rcode", "isakmp.notify.msgtype", "s1ap.cause", "ngap.cause", "inap.cause_indicator", "inap.cause"],
    "status_code": ["sip.Status-Code", "http.response.code", "http2.headers.status", "radius.code"],
    "method": ["sip.Method", "http.request.method", "http2.headers.method"],
    "uri": ["http.request.uri", "http2.headers.path"],
    "host": ["http.host", "http2.headers.authority"],
    "call_id": ["sip.Call-ID"],
    "from": ["sip.From"],
    "to": ["sip.To"],
    "reason": ["sip.Reason"],
    "dia_session": ["diameter.Session-Id"],
    "command": ["diameter.cmd.code"],
    "result": ["diameter.Result-Code", "diameter.Experimental-Result-Code"],
    "tcap": ["tcap.tid"],
    "imsi": ["e212.imsi", "gtpv2.imsi", "gsm_map.imsi", "nas_eps.emm.imsi"],
    "msisdn": ["e164.msisdn", "gtpv2.msisdn", "gsm_map.msisdn"],
    "apn": ["gtpv2.apn", "gtp.apn", "diameter.Called-Station-Id"],
    "framed_ip": ["diameter.Framed-IP-Address", "radius.Framed-IP-Address"],
    "seid": ["pfcp.seid"],
    "info": ["_ws.col.Info", "_ws.col.info"],
}
TUNNELS = ["gtp.teid", "gtp.f_teid", "gtp.tid", "gtpv2.teid", "gtpv2.f_teid_gre_key", "gtpv2.teid_c", "gtpv2.sgw_s1u_teid", "gtp.teid_cp", "gtp.uplink_teid_cp", "gtp.teid_data", "gtp.uplink_teid_data"]
SUBSCRIBER_IPS = ["gtp.subscriber_ip", "gtpv2.pdn_addr_and_prefix.ipv4", "gtpv2.pdn_addr_and_prefix.ipv6", "gtp.user_ipv4", "gtp.user_ipv6", "gtp.pdp_address.ipv4", "gtp.pdp_address.ipv6", "pfcp.ue_ip_addr_ipv4"]
ACCESS_IDS = ["s1ap.ENB_UE_S1AP_ID", "s1ap.MME_UE_S1AP_ID", "ngap.RAN_UE_NGAP_ID", "ngap.AMF_UE_NGAP_ID"]
INNER_IPS = ["isakmp.cfg.attr.internal_ip4_address", "isakmp.cfg.attr.internal_ip6_address"]
CODE_DOMAINS = {"GTP": "gtpv2", "PFCP": "pfcp", "S1AP": "s1ap", "NGAP": "ngap", "RANAP": "ranap", "BSSAP": "bssap", "RADIUS": "radius", "SCTP": "sctp_chunk", "INAP": "inap"}


def field(*names: str) -> Column:
    return fields.first_present(*[F.col("fields")[n] for n in names])


def known(name: str) -> Column:
    return field(*ALIASES[name])


def enough(row: Column) -> Column:
    """Whether a row (protocol, fields) meets its family's minimum."""
    p = row["protocol"]
    has = lambda name: fields.first_present(*[row["fields"][n] for n in ALIASES[name]])
    least = F.when(p == "SIP", has("call_id").isNotNull()).when(p == "DIAMETER", has("dia_session").isNotNull() & has("command").isNotNull()).when(p == "INAP", has("tcap").isNotNull())
    return least.otherwise(fields.to_int(has("frame_number")).isNotNull() | fields.to_float(has("time")).isNotNull() | F.coalesce(has("src_ip"), has("dst_ip")).isNotNull())


def normalize(raw: DataFrame) -> DataFrame:
    """All families in one pass.

    The minimum is asked of the one element of an array: the optimizer moves conditions below the columns that they name and writes those out at each place, so a plain
    condition on the normalized columns would hold the expression behind ``fields`` dozens of times (170,000 characters, over which the driver ran out of memory)."""
    p = F.upper("protocol")
    raw = raw.where(F.exists(F.array(F.struct(p.alias("protocol"), "fields")), enough))
    rows = raw.select(
        "capture_id",
        p.alias("protocol"),
        fields.to_int(known("frame_number")).alias("frame_number"),
        fields.to_float(known("time")).alias("ts"),
        known("src_ip").alias("src_ip"),
        known("dst_ip").alias("dst_ip"),
        fields.to_int(known("src_port")).alias("src_port"),
        fields.to_int(known("dst_port")).alias("dst_port"),
        known("stream_id").alias("stream_id"),
        F.when(F.col("fields")["tcp.stream"].isNotNull(), "TCP").when(F.col("fields")["udp.stream"].isNotNull(), "UDP").when(F.col("fields")["sctp.stream"].isNotNull(), "SCTP").otherwise("IP").alias("transport"),
        known("transaction_id").alias("transaction_id"),
        known("procedure").alias("procedure"),
        F.upper(known("method")).alias("method"),
        known("status_code").alias("status_code"),
        known("result").alias("result_code"),
        known("command").alias("command_code"),
        known("cause_code").alias("cause_code"),
        fields.as_bool(F.col("fields")["tcp.analysis.retransmission"]).alias("retransmission"),
        fields.as_bool(F.col("fields")["tcp.flags.reset"]).alias("reset"),
        field("icmp.type").alias("icmp_type"),
        field("icmp.code").alias("icmp_code"),
        known("call_id").alias("call_id"),
        fields.header_param(known("to"), "tag").alias("to_tag"),
        fields.clean_uri(known("from")).alias("from_uri"),
        fields.clean_uri(known("to")).alias("to_uri"),
        known("reason").alias("reason"),
        known("dia_session").alias("dia_session_id"),
        known("tcap").alias("tcap_tid"),
        known("apn").alias("apn"),
        known("framed_ip").alias("framed_ip"),
        fields.distinct_values(*[F.col("fields")[n] for n in TUNNELS]).alias("teids"),
        fields.distinct_values(*[F.col("fields")[n] for n in SUBSCRIBER_IPS]).alias("subscriber_ips"),
        fields.distinct_values(*[F.col("fields")[n] for n in ACCESS_IDS]).alias("access_ids"),
        fields.distinct_values(*[F.col("fields")[n] for n in INNER_IPS]).alias("ike_inner_ips"),
        known("seid").alias("seid"),
        field("gtp.f_teid").alias("f_teid"),
        field("gtp.tid").alias("gtp_tid"),
        known("info").alias("raw_info"),
        known("host").alias("host"),
        known("imsi").alias("own_imsi"),
        known("msisdn").alias("own_msisdn"),
        field("tls.record.content_type").isNotNull().alias("is_tls"),
        known("uri").alias("uri"),
    )
    rows = rows.withColumn("sbi_text", F.concat_ws(" ", "uri", "host", "raw_info"))
    rows = fields.with_sbi_context(rows, "sbi_text", F.col("protocol") == "HTTP")
    rows = rows.withColumns({
        "info": fields.informative_segment("raw_info", F.col("protocol")),
        "imsi": F.coalesce("own_imsi", "sbi_imsi"),
        "msisdn": F.coalesce("own_msisdn", "sbi_msisdn"),
        "domain": F.element_at(F.create_map(*[F.lit(x) for kv in CODE_DOMAINS.items() for x in kv]), F.col("protocol")),
    })
    names = codes.code_names(raw.sparkSession).select(F.col("domain").alias("_domain"), F.col("code").alias("_code"), F.col("name").alias("code_name"))
    rows = rows.join(F.broadcast(names), (F.col("domain") == F.col("_domain")) & (F.col("procedure") == F.col("_code")), "left")
    rows = codes.with_code_name(rows, "diameter_command", "command_code", "command_name")
    sip = F.coalesce("method", "status_code")
    http = F.trim(F.concat_ws(" ", F.coalesce("method", "status_code"), F.when(F.col("method").isNotNull(), F.col("uri"))))
    message = F.when(F.col("protocol") == "SIP", sip).when(F.col("protocol") == "HTTP", F.nullif(http, F.lit(""))).when(F.col("protocol") == "DIAMETER", F.concat_ws(" ", "command_name", "result_code"))
    message = message.when(F.col("protocol") == "INAP", F.coalesce("code_name", F.concat_ws("_", F.lit("UNKNOWN"), "procedure")))
    rows = rows.withColumn("message", F.coalesce(message, "code_name", "info", "protocol"))
    failed_result = F.coalesce(~F.col("result_code").isin(*predicates.DIAMETER_SUCCESS, "1001"), F.lit(False))
    names_used = ("protocol", "message", "status_code", "cause_code", "retransmission", "reset", "icmp_type", "icmp_code")
    general = predicates.is_failure({c: F.col(c) for c in names_used})
    rows = rows.withColumns({
        "is_failure": F.when(F.col("protocol") == "DIAMETER", failed_result).when(F.col("protocol") == "SIP", F.coalesce(F.col("status_code").rlike("^[456]"), F.lit(False))).when(F.col("protocol") == "INAP", predicates.inap_flags(F.col("procedure"))["failure"]).otherwise(general),
        "is_auth_failure": failed_result & (F.col("result_code") == "5003"),
        "is_roaming_failure": F.coalesce(F.col("result_code") == "5004", F.lit(False)),
        "is_charging_failure": failed_result & (F.col("command_code") == "272"),
        "is_policy_reject": failed_result & F.col("command_code").isin("258", "265"),
        "is_subscriber_absent": F.coalesce(F.col("result_code").isin("5001", "5550"), F.lit(False)),
        "technology": codes.technology(F.col("protocol"), F.col("sbi_service").isNotNull(), F.col("is_tls")),
    })
    return conform(rows.drop("info", "raw_info", "host", "sbi_text", "sbi_imsi", "sbi_msisdn", "suci", "payload_hint", "own_imsi", "own_msisdn", "domain", "_domain", "_code", "code_name", "is_tls", "uri"))
