"""Names and meanings of protocol codes, as tables for broadcast joins (all are a few hundred rows, whatever the data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Message, cause and procedure names of the public 3GPP, ITU and IETF code tables.
NAMES = {
    "gtpv2": {"1": "Echo Request", "2": "Echo Response", "32": "Create Session Request", "33": "Create Session Response", "34": "Modify Bearer Request", "35": "Modify Bearer Response", "36": "Delete Session Request", "37": "Delete Session Response", "95": "Create Bearer Request", "96": "Create Bearer Response", "97": "Update Bearer Request", "98": "Update Bearer Response", "133": "Forward Relocation Request", "134": "Forward Relocation Response", "170": "Release Access Bearers Request", "171": "Release Access Bearers Response"},
    "gtp_cause": {"16": "Request Accepted", "18": "New PDN Type Due To Network Preference", "64": "Context Not Found", "72": "System Failure", "73": "No Resources Available", "78": "Missing or Unknown APN", "83": "Preferred PDN Type Not Supported", "87": "UE Not Responding", "89": "Service Not Supported", "94": "Request Rejected"},
    "pfcp": {"1": "Heartbeat Request", "2": "Heartbeat Response", "5": "Association Setup Request", "6": "Association Setup Response", "7": "Association Update Request", "8": "Association Update Response", "9": "Association Release Request", "10": "Association Release Response", "50": "Session Establishment Request", "51": "Session Establishment Response", "52": "Session Modification Request", "53": "Session Modification Response", "54": "Session Deletion Request", "55": "Session Deletion Response", "56": "Session Report Request", "57": "Session Report Response"},
    "pfcp_cause": {"1": "Request Accepted", "64": "Request Rejected", "65": "Session Context Not Found", "66": "Mandatory IE Missing", "67": "Conditional IE Missing", "68": "Invalid Length", "69": "Mandatory IE Incorrect", "72": "No Established PFCP Association", "73": "Rule Creation or Modification Failure"},
    "s1ap": {"1": "Handover Resource Allocation", "2": "Handover Notification", "5": "E-RAB Setup", "7": "E-RAB Release", "9": "Initial Context Setup", "10": "Paging", "11": "Downlink NAS Transport", "12": "Initial UE Message", "13": "Uplink NAS Transport", "18": "UE Context Release Request", "21": "UE Context Release", "22": "eNB Status Transfer", "23": "MME Status Transfer"},
    "ngap": {"4": "Downlink NAS Transport", "12": "Handover Required", "13": "Handover Request", "14": "Initial Context Setup", "15": "Initial UE Message", "41": "UE Context Release", "42": "UE Context Release Request", "44": "UE Radio Capability Info Indication", "46": "Uplink NAS Transport"},
    "ranap": {"19": "Relocation Required", "20": "Relocation Command"},
    "bssap": {"0x01": "BSSAP Reset", "0x04": "BSSAP Clear Command", "0x08": "BSSAP Paging", "0x09": "BSSAP Unitdata"},
    "nas_emm": {"0x41": "Attach Request", "0x42": "Attach Accept", "0x43": "Attach Complete", "0x44": "Attach Reject", "0x48": "Tracking Area Update Request", "0x49": "Tracking Area Update Accept", "0x4a": "Tracking Area Update Complete", "0x4b": "Tracking Area Update Reject", "0x4e": "Service Reject", "0x50": "Service Request", "0x52": "Authentication Response", "0x53": "Authentication Failure"},
    "nas_esm": {"0xc1": "Activate Default EPS Bearer Context Request", "0xc2": "Activate Default EPS Bearer Context Accept", "0xc3": "Activate Default EPS Bearer Context Reject", "0xc5": "PDN Connectivity Reject", "0xc9": "PDN Connectivity Request"},
    "nas_5gmm": {"0x41": "Registration Request", "0x42": "Registration Accept", "0x43": "Registration Complete", "0x44": "Registration Reject", "0x4c": "Service Reject", "0x56": "Authentication Request", "0x57": "Authentication Response", "0x5d": "Security Mode Command", "0x5e": "Security Mode Complete"},
    "nas_5gsm": {"0xc1": "PDU Session Establishment Request", "0xc2": "PDU Session Establishment Accept", "0xc3": "PDU Session Establishment Reject"},
    "radius": {"1": "Access-Request", "2": "Access-Accept", "3": "Access-Reject", "4": "Accounting-Request", "5": "Accounting-Response", "11": "Access-Challenge", "40": "Disconnect-Request", "41": "Disconnect-ACK", "42": "Disconnect-NAK", "43": "CoA-Request", "44": "CoA-ACK", "45": "CoA-NAK"},
    "radius_acct": {"1": "Start", "2": "Stop", "3": "Interim-Update", "7": "Accounting-On", "8": "Accounting-Off"},
    "ike_exchange": {"34": "IKE_SA_INIT", "35": "IKE_AUTH", "36": "CREATE_CHILD_SA", "37": "INFORMATIONAL", "38": "IKE_SESSION_RESUME"},
    "ike_notify": {"7": "INVALID_SYNTAX", "14": "NO_PROPOSAL_CHOSEN", "24": "AUTHENTICATION_FAILED", "36": "INTERNAL_ADDRESS_FAILURE", "38": "TS_UNACCEPTABLE", "43": "TEMPORARY_FAILURE", "44": "CHILD_SA_NOT_FOUND", "16388": "NAT_DETECTION_SOURCE_IP", "16389": "NAT_DETECTION_DESTINATION_IP"},
    "inap": {"0": "InitialDP", "1": "OriginationAttemptAuthorized", "2": "CollectedInformation", "3": "RouteSelectFailure", "4": "OCalledPartyBusy", "5": "ONoAnswer", "6": "OAnswer", "7": "ODisconnect", "20": "Connect", "22": "ReleaseCall", "23": "RequestReportBCSMEvent", "24": "EventReportBCSM", "29": "Continue", "31": "InitiateCallAttempt", "40": "ApplyChargingReport", "41": "ApplyCharging", "43": "CallInformationReport", "46": "ConnectToResource", "48": "DisconnectForwardConnection", "60": "PlayAnnouncement", "63": "PromptAndCollectUserInformation"},
    "sctp_chunk": {"0": "DATA", "1": "INIT", "2": "INIT_ACK", "3": "SACK", "4": "HEARTBEAT", "5": "HEARTBEAT_ACK", "6": "ABORT", "7": "SHUTDOWN", "8": "SHUTDOWN_ACK", "9": "ERROR", "10": "COOKIE_ECHO", "11": "COOKIE_ACK", "14": "SHUTDOWN_COMPLETE"},
    "diameter_command": {"257": "CER", "258": "RAR", "265": "AAR", "271": "ACR", "272": "CCR", "274": "ASR", "275": "STR", "280": "DWR", "282": "DPR", "316": "ULR", "317": "CLR", "318": "AIR", "319": "IDR", "320": "DSR", "321": "PUR"},
    "diameter_result": {"1001": "DIAMETER_MULTI_ROUND_AUTH", "2001": "DIAMETER_SUCCESS", "2002": "DIAMETER_LIMITED_SUCCESS", "3002": "DIAMETER_UNABLE_TO_DELIVER", "3004": "DIAMETER_TOO_BUSY", "4010": "DIAMETER_END_USER_SERVICE_DENIED", "4012": "DIAMETER_CREDIT_LIMIT_REACHED", "5001": "DIAMETER_ERROR_USER_UNKNOWN", "5003": "DIAMETER_AUTHORIZATION_REJECTED", "5004": "DIAMETER_ERROR_ROAMING_NOT_ALLOWED", "5012": "DIAMETER_UNABLE_TO_COMPLY", "5030": "DIAMETER_USER_UNKNOWN", "5550": "DIAMETER_ERROR_ABSENT_USER"},
    "cc_request_type": {"1": "INITIAL", "2": "UPDATE", "3": "TERMINATION", "4": "EVENT"},
    "q850": {"1": "unallocated number", "16": "normal clearing", "17": "user busy", "18": "no user responding", "19": "no answer", "20": "subscriber absent", "21": "call rejected", "27": "destination out of order", "31": "normal unspecified", "34": "no circuit available", "38": "network out of order", "41": "temporary failure", "42": "switching equipment congestion", "47": "resource unavailable", "50": "facility not subscribed", "55": "incoming calls barred", "102": "recovery on timer expiry", "111": "protocol error", "127": "interworking unspecified"},
}
# Technology of a protocol family.
TECHNOLOGY = {"SIP": "IMS", "DIAMETER": "Core", "INAP": "IN", "GTP": "LTE", "S1AP": "LTE", "NAS_EPS": "LTE", "NGAP": "5G", "NAS_5GS": "5G", "PFCP": "5G", "RANAP": "3G", "BSSAP": "2G", "MAP": "2G/3G", "HTTP": "HTTP", "IKEV2": "VoWiFi", "RADIUS": "AAA", "DNS": "IP", "ICMP": "IP", "TCP": "IP", "UDP": "IP", "SCTP": "IP"}
# Fixed values: (protocol, code, family, recommended label, meaning).
SEMANTICS = [
    ("DIAMETER", "2001", "success", "NORMAL_CALL", "The request was answered with success."),
    ("DIAMETER", "4012", "charging", "CHARGING_FAILURE", "The subscriber's credit does not cover the service."),
    ("DIAMETER", "5003", "authorization", "SUBSCRIBER_BARRED", "The request is not authorised."),
    ("DIAMETER", "5004", "roaming", "SUBSCRIBER_BARRED", "Roaming is not allowed in the visited network."),
    ("DIAMETER", "5001", "subscriber_absent", "SUBSCRIBER_UNREACHABLE", "The subscriber is not known to the server."),
    ("DIAMETER", "5550", "subscriber_absent", "SUBSCRIBER_UNREACHABLE", "The subscriber is not registered or not reachable."),
    ("SIP", "480", "unreachable", "SUBSCRIBER_UNREACHABLE", "The called party is not reachable for now."),
    ("SIP", "486", "busy", "USER_BUSY", "The called party is busy."),
    ("SIP", "487", "cancelled", "USER_ABORT", "The call ended before an answer."),
    ("GTP", "64", "context", "CORE_NETWORK_FAILURE", "The bearer context was not found."),
    ("HTTP", "404", "client", "CLIENT_ERROR", "The resource is not known to the function."),
    ("HTTP", "503", "server", "NF_FAILURE", "The network function is not available."),
]


def code_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, c, n) for d, names in NAMES.items() for c, n in names.items()], "domain string, code string, name string")


def code_semantics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEMANTICS, "protocol string, code string, family string, recommended_label string, meaning string")


def with_code_name(df: DataFrame, domain: str, code: str, output: str, prefix: str = "") -> DataFrame:
    """Adds the name of a code; unknown codes get prefix + code."""
    names = code_names(df.sparkSession).where(F.col("domain") == domain).select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    joined = df.join(F.broadcast(names), df[code] == names["_code"], "left")
    return joined.withColumn(output, F.coalesce("_name", F.concat(F.lit(prefix), code))).drop("_code", "_name")


def interpret(messages: DataFrame, protocol: str = "protocol", code: str = "code") -> DataFrame:
    """Adds family, recommended_label and meaning of (protocol, code)."""
    table = code_semantics(messages.sparkSession).withColumnsRenamed({"protocol": "_protocol", "code": "_code"})
    return messages.join(F.broadcast(table), (messages[protocol] == table["_protocol"]) & (messages[code] == table["_code"]), "left").drop("_protocol", "_code")


def technology(protocol: Column, is_sbi: Column, is_tls: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in TECHNOLOGY.items() for x in kv]), protocol)
    return F.when((protocol == "HTTP") & is_sbi, "5G").when((protocol == "HTTP") & is_tls, "HTTPS").otherwise(F.coalesce(named, F.lit("Core")))
