"""Boolean columns over messages: failures, successes, markers, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACCEPTED = ["0", "16", "18", "128", "REQUEST_ACCEPTED", "DIAMETER_SUCCESS"]
GTP_ACCEPTED = ["16", "18", "128", "REQUEST_ACCEPTED"]
DIAMETER_SUCCESS = ["2001", "2002"]
RADIUS_REJECT, RADIUS_ACCEPT, RADIUS_CHALLENGE = ["3", "42", "45"], ["2", "5", "41", "44"], ["11"]
NAS_REJECTS = ["ATTACH REJECT", "TRACKING AREA UPDATE REJECT", "SERVICE REJECT", "REGISTRATION REJECT", "PDU SESSION ESTABLISHMENT REJECT"]


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def has_any(text: Column, markers: list[str]) -> Column:
    """Whether upper-cased text contains one of the markers."""
    return _no(F.upper(text).rlike("|".join(m.replace("-", r"\-") for m in markers)))


def is_core(p: Column) -> Column:
    return p.isin("GTP", "PFCP")


def is_nas(p: Column) -> Column:
    return p.isin("NAS_EPS", "NAS_5GS")


def core_failure(protocol: Column, cause: Column) -> Column:
    cause = F.nullif(F.trim(cause), F.lit(""))
    return _no(is_core(protocol) & F.when(protocol == "PFCP", ~cause.isin("1", "REQUEST_ACCEPTED")).otherwise(~cause.isin(*GTP_ACCEPTED)))


def core_success(protocol: Column, cause: Column) -> Column:
    return _no(is_core(protocol) & F.when(protocol == "PFCP", cause.isin("1", "REQUEST_ACCEPTED")).otherwise(cause.isin(*GTP_ACCEPTED)))


def nas_failure(protocol: Column, message: Column) -> Column:
    return is_nas(protocol) & has_any(message, NAS_REJECTS)


def nas_success(protocol: Column, message: Column) -> Column:
    return is_nas(protocol) & has_any(message, ["ACCEPT", "COMPLETE", "REQUEST"]) & ~nas_failure(protocol, message)


def radius_failure(protocol: Column, code: Column, message: Column) -> Column:
    return _no((protocol == "RADIUS") & (_no(code.isin(*RADIUS_REJECT)) | has_any(message, ["REJECT", "NAK", "DENIED"])))


def radius_success(protocol: Column, code: Column) -> Column:
    return _no((protocol == "RADIUS") & code.isin(*RADIUS_ACCEPT))


def is_failure(c: dict[str, Column]) -> Column:
    """The failure flag of a normalized message; c: its columns by name (protocol, message, status_code, cause_code, retransmission, reset, icmp_type, icmp_code)."""
    p, message, status, cause = c["protocol"], c["message"], c["status_code"], c["cause_code"]
    bad_cause = _no(cause.isNotNull() & ~cause.isin(*ACCEPTED))
    ike_number = cause.try_cast("int")
    return _no(
        F.when(p.isin("MAP", "RANAP", "BSSAP"), has_any(message, ["REJECT", "ERROR", "FAIL", "ABORT", "DENIED"]))
        .when(p == "HTTP", status.rlike("^[45]"))
        .when(p == "DNS", _no(~cause.isin("0", "NOERROR")))
        .when(p == "ICMP", _no(c["icmp_type"].isin("3", "11", "1")) | ~F.coalesce(c["icmp_code"], F.lit("")).isin("", "0"))
        .when(p == "RADIUS", _no(status.isin(*RADIUS_REJECT)) | has_any(message, ["REJECT", "NAK", "DENIED"]))
        .when(p.isin("TCP", "UDP"), _no(c["retransmission"]) | _no(c["reset"]))
        .when(is_nas(p), has_any(message, ["REJECT", "FAIL", "DENIED"]) | bad_cause)
        .when(p == "PFCP", F.when(cause.isNotNull(), cause != "1").otherwise(has_any(message, ["REJECT", "NOT FOUND", "FAIL", "MISSING", "ERROR"])))
        .when(p == "IKEV2", F.when(ike_number.isNotNull(), ike_number.between(1, 16383)).otherwise(has_any(message, ["FAIL", "INVALID", "UNSUPPORTED", "UNACCEPTABLE", "NOT_FOUND"])))
        .otherwise(bad_cause)
    )


def flow_failure(protocol: Column, status: Column, result: Column, cause: Column, flagged: Column) -> Column:
    """Whether an event of a flow is a failure: SIP from 400 on but challenges, Diameter answers but success and multi-round, bearer causes but accepted."""
    number = status.try_cast("int")
    return _no(
        F.when(protocol == "SIP", (number >= 400) & ~number.isin(401, 407))
        .when(protocol == "DIAMETER", ~result.isin("2001", "1001"))
        .when(protocol == "GTP", ~cause.isin("16", "128"))
        .otherwise(flagged)
    )


def dialog_specific(status: Column, method: Column) -> Column:
    return _no(~F.coalesce(status, F.lit("")).isin("", "100")) | _no(method.isin("ACK", "BYE", "CANCEL", "PRACK", "UPDATE"))


def start_marker(message: Column) -> Column:
    return has_any(message, ["INITIAL UE MESSAGE", "ATTACH REQUEST", "SERVICE REQUEST", "REGISTRATION REQUEST", "TRACKING AREA UPDATE REQUEST", "HANDOVER REQUEST"])


def completion_marker(message: Column) -> Column:
    return has_any(message, ["UE CONTEXT RELEASE", "ATTACH COMPLETE", "REGISTRATION COMPLETE", "TRACKING AREA UPDATE COMPLETE", "DETACH ACCEPT"])


def transport_noise_text(message: Column) -> Column:
    """The message upper-cased and without a trailing payload id."""
    return F.trim(F.substring_index(F.upper(message), "PPID=", 1))


# Operations of the intelligent network by what they tell.
INAP_KINDS = {"failure": ["3", "4", "5"], "service_logic": ["0", "20", "22", "29", "46", "60", "63"], "media": ["46", "60", "63"], "routing_failure": ["3"], "initial": ["0"], "release": ["22"]}


def inap_flags(opcode: Column) -> dict[str, Column]:
    """What an operation tells, by name; without an operation nothing."""
    return {kind: _no(F.trim(opcode).isin(codes)) for kind, codes in INAP_KINDS.items()}


def tcp_issue(reset: Column, retransmission: Column, zero_window: Column, duplicate_ack: Column, out_of_order: Column) -> Column:
    return F.when(_no(reset), "reset").when(_no(retransmission), "retransmission").when(_no(zero_window), "zero_window").when(_no(duplicate_ack), "duplicate_ack").when(_no(out_of_order), "out_of_order")


# Error categories of a capture with the order in which they are reported.
ERROR_CATEGORIES = ["SIP 401", "TCP transport issues", "GTPv2 context not found", "NGAP release", "S1AP release", "Diameter errors", "Diameter informational", "RADIUS errors", "RADIUS challenges", "TCP RST"]


def error_categories(c: dict[str, Column]) -> Column:
    """All error categories of a message (an array, mostly empty)."""
    p, message, failed = c["protocol"], c["message"], F.coalesce(c["is_failure"], F.lit(False))
    tests = [
        ("SIP 401", (p == "SIP") & (c["status_code"] == "401")),
        ("TCP transport issues", (p == "TCP") & (_no(c["retransmission"]) | _no(c["reset"]))),
        ("GTPv2 context not found", (p == "GTP") & (c["cause_code"] == "64")),
        ("NGAP release", (p == "NGAP") & (_no(c["procedure"].isin("41", "42")) | has_any(message, ["UE CONTEXT RELEASE"]))),
        ("S1AP release", (p == "S1AP") & (_no(c["procedure"].isin("18")) | has_any(message, ["UE CONTEXT RELEASE"]))),
        ("Diameter errors", (p == "DIAMETER") & failed & (F.coalesce(c["result_code"], F.lit("")) != "1001")),
        ("Diameter informational", (p == "DIAMETER") & (c["result_code"] == "1001")),
        ("RADIUS errors", radius_failure(p, c["status_code"], message)),
        ("RADIUS challenges", (p == "RADIUS") & (c["status_code"] == "11")),
        ("TCP RST", (p == "TCP") & _no(c["reset"])),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
