"""Session records: everything that is derived from a session's messages, in one aggregation on the session key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import fields, predicates

KEY = ["capture_id", "session_id"]
# Order of the families in a merged flow.
FAMILY_RANK = {"SIP": 0, "DIAMETER": 1, "INAP": 2, "GTP": 3}
TRANSPORT = ["TCP", "UDP", "SCTP"]
GTP_OR_GENERIC = 4
# Messages of transport protocols that tell nothing by themselves.
BENIGN = ["UDP", "TCP", "DATA", "INIT", "ABORT", "SACK", "HEARTBEAT", "HEARTBEAT_ACK"]


def family_rank() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY_RANK.items() for x in kv]), F.col("protocol")), F.lit(GTP_OR_GENERIC))


def order() -> Column:
    """The order that picks and flows follow: time, family, frame, identity."""
    return F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), family_rank().alias("family"), F.coalesce("frame_number", F.lit(0)).alias("frame"), F.col("message_uid"))


def first_of(value, when: Column | None = None) -> Column:
    """The first present value in the session's order."""
    value = F.col(value) if isinstance(value, str) else value
    keep = value.isNotNull() if when is None else value.isNotNull() & when
    return F.min_by(F.when(keep, value), F.when(keep, order()))


def last_of(value, when: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    keep = value.isNotNull() if when is None else value.isNotNull() & when
    return F.max_by(F.when(keep, value), F.when(keep, order()))


def _any(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def flow(messages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Messages with seq (1, 2, ... in the merged order) and dialog (the number of INVITEs so far)."""
    w = Window.partitionBy(*keys).orderBy(order())
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("seq", F.row_number().over(w)).withColumn("dialog", F.nullif(F.sum(F.when(F.col("method") == "INVITE", 1).otherwise(0)).over(running), F.lit(0)))


def flow_token() -> Column:
    return F.coalesce("message", F.when(F.col("protocol") == "SIP", F.coalesce("method", "status_code")), "protocol")


def flow_summary(messages: DataFrame, keys: list[str] = KEY, k: int = 10) -> DataFrame:
    """(keys, flow): the first k distinct tokens of each session in order. What is gathered of a session is its distinct tokens, however many messages it has."""
    first = messages.select(*keys, flow_token().alias("token"), order().alias("at")).where("token is not null").groupBy(*keys, "token").agg(F.min("at").alias("at"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("at", "token"))), 1, k)
    return first.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["token"]), " → ").alias("flow"))


def records(messages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The session record without its flow: every flag, pick and set comes from one aggregation on the session key."""
    p = F.col("protocol")
    sip = p == "SIP"
    dia = p == "DIAMETER"
    status = lambda code: _any(sip & (F.col("status_code") == code))
    method = lambda name: _any(sip & (F.col("method") == name))
    text = F.upper(F.coalesce("message", F.lit("")))
    seen = lambda *markers: _any(predicates.has_any(F.col("message"), list(markers)))
    core_ok, core_bad = predicates.core_success(p, F.col("cause_code")), predicates.core_failure(p, F.col("cause_code"))
    nas_ok, nas_bad = predicates.nas_success(p, F.col("message")), predicates.nas_failure(p, F.col("message"))
    failed = F.coalesce("is_failure", F.lit(False))
    aggregates = {
        "start_ts": F.min("ts"), "end_ts": F.max("ts"), "messages": F.count("*"),
        "protocols": F.array_sort(F.collect_set("protocol")), "technologies": F.array_sort(F.collect_set("technology")),
        "final_sip_code": last_of("status_code", sip & (F.col("status_code") != "100")),
        "failure_ts": F.min(F.when(sip & F.col("status_code").rlike("^[456]"), F.col("ts"))),
        "imsi": first_of("imsi"), "msisdn": first_of("msisdn"), "call_id": first_of("call_id"), "apn": first_of("apn"), "framed_ip": first_of("framed_ip"),
        "calling": first_of(fields.uri_user("from_uri"), sip), "called": first_of(fields.uri_user("to_uri"), sip),
        "q850": last_of(fields.q850_cause("reason"), sip), "first_message": first_of("message", ~p.isin(*TRANSPORT)), "last_message": last_of("message", ~p.isin(*TRANSPORT)),
        "sip_count": F.count_if(sip), "dia_count": F.count_if(dia), "inap_count": F.count_if(p == "INAP"), "gtp_count": F.count_if(p == "GTP"), "http_count": F.count_if(p == "HTTP"),
        "invites": F.count_if(sip & (F.col("method") == "INVITE")), "has_invite": method("INVITE"), "has_bye": method("BYE"), "has_cancel": method("CANCEL"),
        "has_180": status("180"), "has_183": status("183"), "has_200": status("200"),
        "roaming_denied": _any(dia & (F.coalesce("is_roaming_failure", F.lit(False)) | (F.col("result_code") == "5004"))), "auth_failed": _any(dia & F.col("is_auth_failure")), "subscriber_absent": _any(dia & F.col("is_subscriber_absent")),
        "charging_failed": _any(dia & F.col("is_charging_failure")), "policy_failed": _any(dia & F.col("is_policy_reject")), "dia_success": _any(dia & F.col("result_code").isin(*predicates.DIAMETER_SUCCESS)), "dia_failures": F.count_if(dia & failed),
        "dia_clr": _any(dia & F.upper("command_name").isin("CLR", "CANCEL-LOCATION")),
        "radius_reject": _any(predicates.radius_failure(p, F.col("status_code"), F.col("message"))), "radius_accept": _any(predicates.radius_success(p, F.col("status_code"))),
        "core_failures": F.count_if(core_bad), "core_successes": F.count_if(core_ok), "gtp_accepted": F.count_if(core_ok & (p == "GTP")), "nas_failures": F.count_if(nas_bad), "nas_successes": F.count_if(nas_ok),
        "http_4xx": _any((p == "HTTP") & F.col("status_code").startswith("4")), "http_5xx": _any((p == "HTTP") & F.col("status_code").startswith("5")),
        "dns_failed": _any((p == "DNS") & failed), "icmp_failed": _any((p == "ICMP") & failed), "icmp_count": F.count_if(p == "ICMP"),
        "icmp_port_only": F.coalesce(F.bool_and(F.when(p == "ICMP", (F.col("icmp_type") == "3") & (F.col("icmp_code") == "3"))), F.lit(False)),
        "retransmissions": F.count_if((p == "TCP") & F.col("retransmission")), "timeout": _any((p == "TCP") & F.col("timeout")), "mobility": _any(text.rlike("HANDOVER|TRACKING AREA UPDATE|LOCATION UPDATE|RELOCATION")),
        # markers of mobility procedures
        "lte_handover_done": seen("HANDOVER RESOURCE ALLOCATION"), "lte_handover_notified": seen("HANDOVER NOTIFICATION"), "lte_handover_asked": seen("HANDOVER REQUEST"), "lte_status_transfer": seen("STATUS TRANSFER"),
        "tau_asked": seen("TRACKING AREA UPDATE REQUEST"), "tau_accepted": seen("TRACKING AREA UPDATE ACCEPT"), "tau_completed": seen("TRACKING AREA UPDATE COMPLETE"), "context_released": seen("UE CONTEXT RELEASE"),
        "explicit_reject": seen(*predicates.NAS_REJECTS, "HANDOVER PREPARATION FAILURE", "HANDOVER CANCELLED", "RADIO-CONNECTION-WITH-UE-LOST"),
        "legacy_auth": seen("SENDAUTHENTICATIONINFO", "AUTHENTICATION"), "legacy_update": seen("UPDATEGPRSLOCATION", "UPDATELOCATION", "LOCATION UPDATE"), "legacy_data": seen("INSERTSUBSCRIBERDATA"), "legacy_cancel": seen("CANCELLOCATION"),
        "attach_asked": seen("ATTACH REQUEST"), "attach_accepted": seen("ATTACH ACCEPT"), "attach_completed": seen("ATTACH COMPLETE"), "rau_asked": seen("ROUTING AREA UPDATE REQUEST"), "rau_accepted": seen("ROUTING AREA UPDATE ACCEPT"),
        "security_asked": seen("SECURITYMODECOMMAND"), "security_done": seen("SECURITYMODECOMPLETE"), "iu_release_asked": seen("IU-RELEASECOMMAND"), "iu_release_done": seen("IU-RELEASECOMPLETE"),
        "legacy_results": F.count_if(predicates.has_any(F.col("message"), [" RESULT", "RETURNRESULT", "ACCEPT", "COMPLETE"])),
        "legacy_failed": _any((text.contains("ERROR") & ~text.contains("ERRORINDICATION")) | text.rlike("REJECT|FAIL|ABORT|REFUSE|DENIED")),
        "bearers_released": _any(predicates.is_core(p) & text.rlike("RELEASE ACCESS BEARERS REQUEST|SESSION DELETION REQUEST")),
        **{f"pfcp_{name}_{side}": _any((p == "PFCP") & text.contains(f"SESSION {name.upper()} {side.upper()}")) for name in ("establishment", "modification", "deletion", "report") for side in ("request", "response")},
        "pfcp_count": F.count_if(p == "PFCP"), "pfcp_failures": F.count_if((p == "PFCP") & (core_bad | text.rlike("REJECT|FAIL|NOT FOUND|MISSING|ERROR"))),
    }
    out = messages.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.withColumns({"duration_ms": F.bround((F.col("end_ts") - F.col("start_ts")) * 1000, 3), "time_to_failure_ms": F.bround((F.col("failure_ts") - F.col("start_ts")) * 1000, 3)})


def refresh(messages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The session record with its flow, which is put together from the first place of each distinct token."""
    out = records(messages, keys)
    told = out.join(flow_summary(messages, keys), keys, "left").withColumn("flow", F.coalesce("flow", F.lit("")))
    last = ["duration_ms", "time_to_failure_ms"]
    return told.select(*[c for c in told.columns if c not in last], *last)


# Families beside the call families that a session's messages are counted by.
BUCKETS = ["HTTP", "IKEV2", "TCP", "UDP", "SCTP", "DNS", "ICMP", "S1AP", "NGAP", "RANAP", "BSSAP", "MAP", "NAS_EPS", "NAS_5GS", "PFCP", "RADIUS"]


def family_counts(messages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, http, ikev2, ...): how many messages of each family a session has; families in any case, others count for none."""
    p = F.upper("protocol")
    return messages.groupBy(*keys).agg(*[F.count_if(p == b).alias(b.lower()) for b in BUCKETS])


def tokens(messages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, kind, token): the distinct identities, addresses and endpoints of each session, for joins between sessions."""
    one = lambda kind, x: F.array(F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("token")))
    many = lambda kind, x: F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("token")))
    pair = F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    everything = F.concat(
        one("id", F.col("call_id")), one("id", F.col("dia_session_id")), one("id", F.col("tcap_tid")), one("subscriber_id", F.col("imsi")), one("subscriber_id", F.col("msisdn")),
        one("subscriber_ip", F.col("framed_ip")), many("subscriber_ip", F.col("subscriber_ips")), many("tunnel", F.col("teids")), many("access", F.col("access_ids")),
        one("stream", F.col("stream_id")), one("ip", F.col("src_ip")), one("ip", F.col("dst_ip")), one("pair", F.when(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull(), pair)), one("technology", F.col("technology")),
    )
    return messages.select(*keys, F.explode(everything).alias("t")).select(*keys, "t.kind", "t.token").where("token is not null and token != ''").distinct()


def correlation_methods(sessions: DataFrame) -> Column:
    """Which identities a session was held together by."""
    return F.array_compact(F.array(
        F.when(F.col("call_id").isNotNull(), "call_id"), F.when(F.col("imsi").isNotNull(), "imsi"), F.when(F.col("msisdn").isNotNull(), "msisdn"),
        F.when(F.col("framed_ip").isNotNull(), "framed_ip"), F.when(F.size("protocols") > 1, "cross_protocol"),
    ))


def low_value(messages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys): sessions of transport or bearer-probe noise without any identity, which are left out."""
    p, text = F.col("protocol"), predicates.transport_noise_text(F.coalesce("message", F.lit("")))
    facts = messages.groupBy(*keys).agg(
        F.collect_set("protocol").alias("protocols"), F.count("*").alias("n"), F.bool_or(F.coalesce("imsi", "msisdn", "supi").isNotNull()).alias("known"),
        F.collect_set(text).alias("texts"), F.coalesce(F.bool_and(F.when(p == "ICMP", F.coalesce(F.col("icmp_type").isin("134", "135"), F.lit(False)))), F.lit(True)).alias("router_only"),
        F.bool_and(F.coalesce("reset", F.lit(False))).alias("resets"), F.bool_and((F.coalesce("src_ip", F.lit("")) == "127.0.0.1") & (F.coalesce("dst_ip", F.lit("")) == "127.0.0.1")).alias("loopback"),
        F.bool_or(F.col("cause_code").isNotNull() | (F.size("teids") > 0) | (F.size("subscriber_ips") > 0)).alias("bearer"),
    )
    only = lambda *names: F.size(F.array_except("protocols", F.array(*map(F.lit, names)))) == 0
    within = lambda *names: F.size(F.array_except("texts", F.array(*map(F.lit, names)))) == 0
    transport = ~F.col("known") & only("TCP", "UDP", "SCTP", "ICMP") & (
        (only("SCTP") & (within("INIT", "ABORT") | within("HEARTBEAT", "HEARTBEAT_ACK") | within("DATA")))
        | (only("ICMP", "UDP") & F.col("router_only"))
        | (only("TCP") & within("TCP") & (F.col("resets") | F.col("loopback")))
        | ((F.col("n") <= 4) & within(*BENIGN))
    )
    probe = ~F.col("known") & only("GTP") & (F.col("n") <= 6) & within("GTP") & ~F.coalesce("bearer", F.lit(False))
    return facts.where(transport | probe).select(*keys)
