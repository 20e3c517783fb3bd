"""What a refused Diameter request means, whose fault it may be, and what to do about a root cause."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import codes, fields, predicates
from sigweave.operators.analytics import top_k

# Markers of the names of Diameter nodes, in order of precedence, and the role that they name.
DIAMETER_ROLES = [
    ("mme", "MME"), ("amf", "AMF"), ("hss", "HSS/HLR"), ("hlr", "HSS/HLR"), ("udm", "HSS/HLR"), ("smsc", "SMSC"), ("dsr", "DSR"), ("pcf", "PCRF/PCF"), ("pcrf", "PCRF/PCF"),
    ("ocs", "OCS"), ("cscf", "S-CSCF"), ("pgw", "PGW/SMF"), ("smf", "PGW/SMF"), ("sgw", "SGW/UPF"), ("upf", "SGW/UPF"),
]
NETWORK_ROLES = ["MME", "AMF", "HSS/HLR", "DSR", "SMSC", "PCRF/PCF", "S-CSCF", "PGW/SMF"]
# How much a family of codes weighs among findings; all others weigh 2.
FAMILY_WEIGHTS = {"subscriber_absent": 6, "authorization": 5, "roaming": 5, "unknown_non_success": 4, "policy": 4, "success": 0}
#: Family of codes: where the fault lies, and what it is unlikely to be.
DOMAINS = {
    "subscriber_absent": ("subscriber data or registration state", "a fault of the handset's screen or dialer"),
    "authorization": ("entitlement and policy of the subscriber", "packet loss"),
    "roaming": ("roaming agreement or location update between networks", "packet loss"),
    "charging": ("credit control", "packet loss"),
}
_HOSTS = ["origin_host", "destination_host", "origin_realm", "destination_realm"]

#: Root cause: title, and what to do.
ADVICE = {
    "CHARGING_FAILURE": ("Charging refused", ["look up the credit-control answers of the session", "check the account and quota of the subscriber", "check load and reachability of the charging system"]),
    "SUBSCRIBER_BARRED": ("Subscriber barred", ["check the subscriber's status in the home register", "look for recent changes of barring and roaming rights"]),
    "POLICY_FAILURE": ("Policy refused", ["read the policy function's log of the refused request", "check the rules of the access point"]),
    "NORMAL_CALL": ("Normal session", ["keep as an example of healthy signalling"]),
    "USER_BUSY": ("Called party busy", ["no fault of the network; offer call waiting or voice mail"]),
    "USER_REJECTED": ("Called party declined", ["no fault of the network unless many calls to one number are declined"]),
    "SUBSCRIBER_UNREACHABLE": ("Subscriber unreachable", ["check registration and paging of the subscriber", "check coverage at the last known cell"]),
    "ROUTING_FAILURE": ("Number not routed", ["check number translation and the routing tables", "check that the number is in service"]),
    "USER_ABORT": ("Caller gave up", ["compare the time to ring with that of other calls"]),
    "NETWORK_REJECTION": ("Rejected by the network", ["find the node that sent the refusal", "check admission and compatibility of the request"]),
    "SERVICE_TIMEOUT": ("No answer in time", ["find the hop after which nothing came back", "compare the timers of both sides"]),
    "NF_FAILURE": ("Network function failed", ["check health and load of the function that answered", "check its registration with the repository function"]),
    "CLIENT_ERROR": ("Request not accepted by a function", ["compare the request with the interface's release", "check identifiers and scope of the token"]),
    "CORE_NETWORK_FAILURE": ("Bearer not set up", ["read the cause of the failed bearer message", "check that both gateways hold the same contexts"]),
    "NETWORK_CONGESTION": ("Congestion", ["measure loss and queueing on the path", "compare with the load of the link at the time"]),
    "TRANSPORT_TIMEOUT": ("Transport timed out", ["check that the far end is reachable", "look for firewalls that drop idle flows"]),
    "SERVER_ERROR": ("Server error", ["check the log of the server that answered", "look for the same answer to other callers"]),
    "DNS_FAILURE": ("Name not resolved", ["ask the resolver for the same name", "check the zone and the delegation"]),
    "ICMP_NETWORK_FAILURE": ("Destination unreachable", ["trace the route to the destination", "check filters on the way"]),
    "NAS_REJECTION": ("Rejected by mobility management", ["read the cause of the reject", "check subscription and area restrictions"]),
    "UNKNOWN": ("Unknown cause", ["capture more interfaces of the session", "review by hand"]),
}


def role(name: Column) -> Column:
    """The role of a Diameter node by its name or address; null if nothing tells it."""
    text = F.lower(name)
    return reduce(lambda w, r: w.when(text.contains(r[0]), r[1]), DIAMETER_ROLES[1:], F.when(text.contains(DIAMETER_ROLES[0][0]), DIAMETER_ROLES[0][1]))


def diameter_findings(messages: DataFrame) -> DataFrame:
    """(capture_id, message_uid, code, family, title, meaning, fault_domain, unlikely, network_side, evidence, score): one row for each failed Diameter answer.

    Codes of the table of meanings are told by their family; others by where the answer came from: from another network, from a control node of the network, or unknown.
    messages may have origin_host, destination_host, origin_realm, destination_realm; without them addresses stand for hosts. Null codes give no row."""
    rows = messages.where((F.col("protocol") == "DIAMETER") & F.col("result_code").isNotNull() & F.coalesce("is_failure", F.lit(False)))
    rows = rows.select("capture_id", "message_uid", F.col("result_code").alias("code"), "protocol", "command_name", "command_code", "src_ip", "dst_ip", *[(F.col(c) if c in messages.columns else F.lit(None).cast("string")).alias(c) for c in _HOSTS])
    rows = codes.with_code_name(codes.interpret(rows), "diameter_result", "code", "code_name")
    sender, receiver = F.coalesce(role(F.col("origin_host")), role(F.col("src_ip"))), F.coalesce(role(F.col("destination_host")), role(F.col("dst_ip")))
    relation = fields.realm_relation(F.coalesce("origin_realm", "origin_host"), F.coalesce("destination_realm", "destination_host"))
    known, own = F.col("family").isNotNull(), F.coalesce(sender.isin(NETWORK_ROLES), F.lit(False))
    by_family = lambda i: reduce(lambda w, kv: w.when(F.col("family") == kv[0], kv[1][i]), DOMAINS.items(), F.when(F.lit(False), ""))
    far = relation == "cross"
    answer = F.coalesce("command_name", "command_code", F.lit("an answer"))
    return rows.select(
        "capture_id", "message_uid", "code", F.coalesce("family", F.lit("unknown_non_success")).alias("family"),
        F.when(known, F.concat("code_name", F.lit(" ("), "code", F.lit(")"))).otherwise(F.concat(F.lit("Diameter code "), "code", F.when(sender.isNotNull() | receiver.isNotNull(), F.concat(F.lit(" from "), F.coalesce(sender, F.lit("a peer")), F.lit(" to "), F.coalesce(receiver, F.lit("a peer")))).otherwise(""))).alias("title"),
        F.coalesce("meaning", F.when(far, "Refused across two networks: routing, interconnection or roaming.").when(own, "Refused by a control node of the network.").otherwise("Refused with a code that has no known meaning.")).alias("meaning"),
        F.when(known, F.coalesce(by_family(0), F.lit("Diameter signalling"))).when(far, "routing between networks or subscriber look-up").when(own, F.concat(sender, F.lit(" state of the subscriber"))).otherwise("service logic or set-up of a peer").alias("fault_domain"),
        F.when(known, F.coalesce(by_family(1), F.lit("packet loss"))).otherwise("a fault of the handset alone").alias("unlikely"),
        own.alias("network_side"),
        F.concat(answer, F.lit(" with "), "code", F.lit(" from "), F.coalesce("origin_host", "src_ip", F.lit("?")), F.lit(" to "), F.coalesce("destination_host", "dst_ip", F.lit("?"))).alias("evidence"),
        F.when(known, 100).when(far, 70).otherwise(60).alias("score"),
    )


def ranked_findings(found: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """(keys, place, title, family, n, evidence): each title once, the heaviest family first, then score, number and title; k at most. The evidence is that of the first message."""
    weight = reduce(lambda w, kv: w.when(F.col("family") == kv[0], kv[1]), FAMILY_WEIGHTS.items(), F.when(F.lit(False), 0)).otherwise(2)
    once = found.groupBy(*keys, "title", "family").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min_by("evidence", "message_uid").alias("evidence"))
    return top_k(once, keys, [weight.desc(), F.desc("score"), F.desc("n"), F.col("title")], k, place="place").select(*keys, "place", "title", "family", "n", "evidence")


def with_advice(rows: DataFrame, label: str = "rca_label") -> DataFrame:
    """Adds title and advice (texts) of a root cause; labels that are not known, and null, get those of UNKNOWN."""
    key = F.when(F.col(label).isin(list(ADVICE)), F.col(label)).otherwise("UNKNOWN")
    table = rows.sparkSession.createDataFrame([(name, title, advice) for name, (title, advice) in ADVICE.items()], "_label string, title string, advice array<string>")
    return rows.withColumn("_label", key).join(F.broadcast(table), "_label").drop("_label")


def transport_issues(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, issues, breakdown): how many messages show a transport fault, and a text of the kinds by number, the most frequent first. Each message counts for one kind."""
    no = lambda c: F.col(c) if c in messages.columns else F.lit(None).cast("boolean")
    kind = predicates.tcp_issue(no("reset"), no("retransmission"), no("zero_window"), no("duplicate_ack"), no("out_of_order"))
    counts = messages.where("protocol = 'TCP'").withColumn("_kind", kind).where("_kind is not null").groupBy(*keys, "_kind").agg(F.count("*").alias("_n"))
    # at most five kinds a key
    told = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_kind").alias("kind")))), lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), F.translate(x["kind"], "_", " ")))
    return counts.groupBy(*keys).agg(F.sum("_n").alias("issues"), F.array_join(told, ", ").alias("breakdown"))
