"""Root causes: an ordered rule cascade over session records, cross-layer overrides, hypotheses, votes and evidence fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rule id, label, severity, confidence, in order of precedence.
RULES = [
    ("R0_ROAMING_DENIED", "SUBSCRIBER_BARRED", "HIGH", 94), ("R0_AUTH", "SUBSCRIBER_BARRED", "HIGH", 90), ("R0_SUBSCRIBER_ABSENT", "SUBSCRIBER_UNREACHABLE", "HIGH", 93),
    ("R0_CHARGING", "CHARGING_FAILURE", "HIGH", 92), ("R0_POLICY", "POLICY_FAILURE", "HIGH", 88), ("R0_RADIUS_REJECT", "SUBSCRIBER_BARRED", "HIGH", 88),
    ("R0A_DIAMETER_SUCCESS", "NORMAL_CALL", "LOW", 68), ("R0AA_DIAMETER_HOUSEKEEPING", "NORMAL_CALL", "LOW", 62), ("R0AB_RADIUS_SUCCESS", "NORMAL_CALL", "LOW", 66),
    ("R0B_LTE_MOBILITY_SUCCESS", "NORMAL_CALL", "MEDIUM", 82), ("R0C_LEGACY_MOBILITY_SUCCESS", "NORMAL_CALL", "MEDIUM", 78), ("R0D_BENIGN_ICMP_CLEANUP", "NORMAL_CALL", "LOW", 66), ("R0E_PFCP_HEALTHY", "NORMAL_CALL", "LOW", 64),
    ("R1_NORMAL", "NORMAL_CALL", "HIGH", 98), ("R2_BUSY", "USER_BUSY", "HIGH", 95), ("R2_REJECT", "USER_REJECTED", "HIGH", 95), ("R2_UNREACHABLE", "SUBSCRIBER_UNREACHABLE", "HIGH", 90), ("R2_ROUTING", "ROUTING_FAILURE", "HIGH", 90),
    ("R2_CANCEL", "USER_ABORT", "HIGH", 90), ("R2_487_EARLY", "NETWORK_REJECTION", "MEDIUM", 75), ("R2_487_TIMEOUT", "SERVICE_TIMEOUT", "MEDIUM", 70),
    ("R3_SBI_5XX", "NF_FAILURE", "HIGH", 90), ("R3_SBI_4XX", "CLIENT_ERROR", "MEDIUM", 80), ("R3B_DNS", "DNS_FAILURE", "MEDIUM", 82), ("R3B_ICMP", "ICMP_NETWORK_FAILURE", "MEDIUM", 78), ("R3B_NAS", "NAS_REJECTION", "HIGH", 86),
    ("R4_GTP", "CORE_NETWORK_FAILURE", "HIGH", 85), ("R4B_CONTROL_SUCCESS", "NORMAL_CALL", "MEDIUM", 72), ("R5_TCP_RETX", "NETWORK_CONGESTION", "MEDIUM", 70), ("R5_TIMEOUT", "TRANSPORT_TIMEOUT", "MEDIUM", 70),
    ("R6_SERVER", "SERVER_ERROR", "MEDIUM", 80), ("R6_CLIENT", "NETWORK_REJECTION", "MEDIUM", 75), ("R7_UNKNOWN", "UNKNOWN", "LOW", 30),
]


def within(protocols: list[str]) -> Column:
    return (F.size("protocols") > 0) & (F.size(F.array_except("protocols", F.array(*map(F.lit, protocols)))) == 0)


def lte_mobility() -> Column:
    """A handover or tracking-area update that went through."""
    handover = F.col("lte_handover_done") & F.col("lte_handover_notified")
    update = F.col("tau_asked") & F.col("tau_accepted") & F.col("tau_completed")
    cleanup = (F.col("gtp_accepted") == 0) & within(["SCTP", "S1AP", "NGAP", "NAS_EPS", "NAS_5GS"]) & F.col("context_released") & (handover | F.col("lte_handover_asked"))
    accepted = (F.col("gtp_accepted") >= 2) & ((handover & update) | (handover & F.col("context_released")) | (update & F.col("lte_status_transfer")))
    return ~F.col("explicit_reject") & (cleanup | accepted)


def legacy_mobility() -> Column:
    attach = F.col("attach_asked") & F.col("attach_accepted") & F.col("attach_completed") & (F.col("legacy_auth") | (F.col("security_asked") & F.col("security_done"))) & (F.col("iu_release_asked") | F.col("iu_release_done"))
    area = (F.col("rau_asked") & F.col("security_done") & F.col("iu_release_done")) | (F.col("rau_accepted") & F.col("iu_release_asked"))
    cancel = F.col("legacy_auth") & F.col("legacy_cancel") & (F.col("legacy_results") >= 1)
    update = F.col("legacy_auth") & F.col("legacy_update") & (F.col("legacy_data") | (F.col("legacy_results") >= 2))
    return F.arrays_overlap("protocols", F.array(F.lit("MAP"), F.lit("RANAP"), F.lit("BSSAP"))) & ~F.col("legacy_failed") & (attach | area | cancel | update)


def benign_icmp() -> Column:
    return (F.col("icmp_count") > 0) & F.col("icmp_port_only") & F.col("bearers_released") & (F.col("core_successes") >= 1) & (F.col("core_failures") == 0)


def pfcp_healthy() -> Column:
    both = lambda name: F.col(f"pfcp_{name}_request") & F.col(f"pfcp_{name}_response")
    return (F.col("pfcp_count") > 0) & (F.col("pfcp_failures") == 0) & both("establishment") & (both("modification") | both("report") | both("deletion"))


def conditions() -> dict[str, Column]:
    """The condition of each rule but the last."""
    code = F.coalesce("final_sip_code", F.lit(""))
    icmp_failed = F.col("icmp_failed") & ~benign_icmp()
    clean_core = ~((F.col("core_failures") > 0) | (F.col("nas_failures") > 0) | icmp_failed)
    cancelled = code == "487"
    refused = F.col("charging_failed") | F.col("auth_failed") | F.col("policy_failed")
    return {
        "R0_ROAMING_DENIED": F.col("roaming_denied"), "R0_AUTH": F.col("auth_failed"), "R0_SUBSCRIBER_ABSENT": F.col("subscriber_absent"), "R0_CHARGING": F.col("charging_failed"), "R0_POLICY": F.col("policy_failed"), "R0_RADIUS_REJECT": F.col("radius_reject"),
        "R0A_DIAMETER_SUCCESS": F.col("dia_success") & (F.col("dia_failures") == 0), "R0AA_DIAMETER_HOUSEKEEPING": (F.col("dia_count") > 0) & F.col("dia_clr") & within(["DIAMETER", "SCTP"]) & (F.col("dia_failures") == 0) & clean_core,
        "R0AB_RADIUS_SUCCESS": F.col("radius_accept") & clean_core, "R0B_LTE_MOBILITY_SUCCESS": lte_mobility(), "R0C_LEGACY_MOBILITY_SUCCESS": legacy_mobility(), "R0D_BENIGN_ICMP_CLEANUP": benign_icmp() & (F.col("core_successes") > 0), "R0E_PFCP_HEALTHY": pfcp_healthy(),
        "R1_NORMAL": F.col("has_200") & F.col("has_invite") & F.col("has_bye"), "R2_BUSY": code == "486", "R2_REJECT": code == "603", "R2_UNREACHABLE": code == "480", "R2_ROUTING": code == "404",
        "R2_CANCEL": cancelled & F.col("has_cancel"), "R2_487_EARLY": cancelled & ~F.col("has_180"), "R2_487_TIMEOUT": cancelled, "R3_SBI_5XX": F.col("http_5xx"), "R3_SBI_4XX": F.col("http_4xx"),
        "R3B_DNS": F.col("dns_failed"), "R3B_ICMP": icmp_failed, "R3B_NAS": F.col("nas_failures") > 0, "R4_GTP": F.col("core_failures") > 0, "R4B_CONTROL_SUCCESS": ((F.col("core_successes") > 0) | (F.col("nas_successes") > 0)) & ~refused,
        "R5_TCP_RETX": F.col("retransmissions") > 0, "R5_TIMEOUT": F.col("timeout"), "R6_SERVER": code.startswith("5"), "R6_CLIENT": code.startswith("4"),
    }


def classify(sessions: DataFrame) -> DataFrame:
    """Adds rule_id, rca_label, severity, confidence_pct: the first rule whose condition holds."""
    tests = list(conditions().items())
    rule = reduce(lambda w, t: w.when(t[1], t[0]), tests[1:], F.when(tests[0][1], tests[0][0])).otherwise(RULES[-1][0])
    table = sessions.sparkSession.createDataFrame(RULES, "rule_id string, rca_label string, severity string, confidence_pct int")
    return sessions.withColumn("rule_id", rule).join(F.broadcast(table), "rule_id")


def root_cause(sessions: DataFrame) -> DataFrame:
    """Adds root_cause, contributing_factors, correlation_confidence: of the layers with a failure the lowest one wins (transport, then service, bearer, Diameter)."""
    diameter = F.when(F.col("auth_failed"), "SUBSCRIBER_BARRED").when(F.col("dia_failures") > 0, "CHARGING_FAILURE").when(F.col("policy_failed"), "POLICY_FAILURE")
    service = F.when(F.col("http_5xx"), "NF_FAILURE").when(F.col("http_4xx"), "CLIENT_ERROR")
    transport = F.when(F.col("timeout"), "TRANSPORT_TIMEOUT").when(F.col("retransmissions") > 0, "NETWORK_CONGESTION")
    bearer = F.when(F.col("core_failures") > 0, "CORE_NETWORK_FAILURE")
    found = F.coalesce(transport, service, bearer, diameter)
    factors = F.array_compact(F.array(F.when(diameter.isNotNull(), F.concat(F.lit("Diameter: "), diameter)), F.when(bearer.isNotNull(), "Bearer: failure cause"), F.when(service.isNotNull(), F.concat(F.lit("Service: "), service)), F.when(transport.isNotNull(), F.concat(F.lit("Transport: "), transport))))
    return sessions.withColumns({"contributing_factors": factors, "correlation_confidence": F.when(found.isNotNull(), 90).otherwise(50), "root_cause": F.coalesce(found, "rca_label")})


def hypotheses(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agent, agent_rank, label, confidence): one row for each protocol agent that has something to say."""
    code = F.coalesce("final_sip_code", F.lit(""))
    pick = lambda *options: reduce(lambda w, o: w.when(o[0], F.struct(F.lit(o[1]).alias("label"), F.lit(o[2]).cast("double").alias("confidence"))), options[1:], F.when(options[0][0], F.struct(F.lit(options[0][1]).alias("label"), F.lit(options[0][2]).cast("double").alias("confidence"))))
    yes = F.lit(True)
    agents = [
        ("gtp", (F.col("gtp_count") + F.col("pfcp_count")) > 0, pick((F.col("core_failures") > 0, "CORE_NETWORK_FAILURE", 0.78), (F.col("core_successes") > 0, "NORMAL_CALL", 0.74), (yes, "UNKNOWN", 0.4))),
        ("diameter", F.col("dia_count") > 0, pick((F.col("roaming_denied"), "SUBSCRIBER_BARRED", 0.94), (F.col("auth_failed"), "SUBSCRIBER_BARRED", 0.9), (F.col("charging_failed"), "CHARGING_FAILURE", 0.86), (F.col("dia_failures") > 0, "POLICY_FAILURE", 0.72), (yes, "NORMAL_CALL", 0.45))),
        ("nas", (F.col("nas_failures") + F.col("nas_successes")) > 0, pick((lte_mobility(), "NORMAL_CALL", 0.88), (legacy_mobility(), "NORMAL_CALL", 0.82), (F.col("nas_failures") > 0, "NETWORK_REJECTION", 0.84), (F.col("nas_successes") > 0, "NORMAL_CALL", 0.7), (yes, "UNKNOWN", 0.42))),
        ("sip", F.col("sip_count") > 0, pick((code.isin("487", "603"), "USER_REJECTED", 0.82), (code.isin("408", "504"), "SERVICE_TIMEOUT", 0.8), (code == "486", "USER_BUSY", 0.82), (yes, "UNKNOWN", 0.45))),
        ("transport", F.col("dns_failed") | (F.col("icmp_count") > 0) | (F.col("retransmissions") > 0), pick((F.col("dns_failed"), "DNS_FAILURE", 0.86), (benign_icmp(), "NORMAL_CALL", 0.52), (F.col("icmp_failed"), "CORE_NETWORK_FAILURE", 0.79), (F.col("retransmissions") > 0, "NETWORK_CONGESTION", 0.76), (yes, "UNKNOWN", 0.35))),
    ]
    rows = F.array_compact(F.array(*[F.when(here, F.struct(F.lit(name).alias("agent"), F.lit(rank).alias("agent_rank"), h["label"].alias("label"), h["confidence"].alias("confidence"))) for rank, (name, here, h) in enumerate(agents)]))
    return sessions.select(*keys, F.explode(rows).alias("h")).select(*keys, "h.*")


def vote(found: DataFrame, keys: list[str], margin: float = 0.18) -> DataFrame:
    """(keys, top_label, top_confidence, consensus, is_conflicted): the strongest hypothesis, how much agrees with it, and whether the next one is within the margin."""
    strongest = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "agent_rank")
    ranked = found.withColumn("rank", F.row_number().over(strongest)).withColumn("top", F.first("label").over(strongest))
    votes = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("top_label"), F.max("confidence").alias("top_confidence"),
        (F.sum(F.when(F.col("label") == F.col("top"), F.col("confidence"))) / F.count("*")).alias("consensus"),
        F.max(F.when((F.col("rank") == 2) & (F.col("label") != F.col("top")), F.col("confidence"))).alias("second"),
    )
    return votes.withColumn("is_conflicted", F.coalesce(F.col("top_confidence") - F.col("second") <= margin, F.lit(False))).drop("second")


def event_chain(messages: DataFrame, keys: list[str], window: float = 5.0, learned: DataFrame | None = None) -> DataFrame:
    """Events of each session in order with gap (s), weight of the edge from the event before, and a causal score.

    learned: (event_from, event_to, learned_weight) of earlier sessions; it adds up to 1 to an edge's weight."""
    p = F.col("protocol")
    name = F.upper(F.concat_ws(":", "protocol", F.coalesce("message", F.lit("EVENT"))))
    rows = messages.withColumn("event", name)
    w = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0)), "frame_number")
    rows = rows.withColumn("event_from", F.lag("event").over(w)).withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    own = F.greatest(F.lit(0.05), F.exp(-F.greatest(F.col("gap"), F.lit(0.0)) / window))
    if learned is not None:
        rows = rows.join(learned.select("event_from", F.col("event_to").alias("event"), "learned_weight"), ["event_from", "event"], "left")
        own = own + F.least(F.lit(1.0), F.coalesce("learned_weight", F.lit(0.0)))
    rows = rows.withColumn("weight", F.when(F.col("event_from").isNotNull(), F.least(F.lit(0.99), own)))
    known = p.isin("DIAMETER", "GTP", "NGAP", "NAS_5GS", "NAS_EPS", "SIP", "DNS", "ICMP")
    score = 0.2 + F.when(F.coalesce("is_failure", F.lit(False)), 0.45).otherwise(0.0) + F.when(known, 0.1).otherwise(0.0) + F.least(F.lit(0.25), F.coalesce(F.col("weight") * 0.4, F.lit(0.0)))
    return rows.withColumn("score", F.least(F.lit(0.99), score))


def top_events(chain: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k events of highest causal score of each session."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.coalesce("ts", F.lit(0)), "frame_number")
    return chain.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def event_label(event: Column, fallback: Column) -> Column:
    has = lambda *words: event.rlike("|".join(words))
    return (
        F.when(has("DNS") & has("NXDOMAIN", "SERVFAIL", "FAIL"), "DNS_FAILURE").when(has("ICMP") & has("UNREACH", "TIME_EXCEEDED"), "CORE_NETWORK_FAILURE")
        .when(has("DIAMETER") & has("5004", "ROAMING", "5003", "REJECT", "BARRED", "AUTH"), "SUBSCRIBER_BARRED").when(has("DIAMETER") & has("4012", "CREDIT", "LIMIT"), "CHARGING_FAILURE")
        .when(has("NAS") & has("REJECT", "FAIL"), "NETWORK_REJECTION").when(has("SIP") & has("487", "603"), "USER_REJECTED").when(has("SIP") & has("408", "504", "TIMEOUT"), "SERVICE_TIMEOUT")
        .otherwise(fallback)
    )


# Weights of the sources of evidence.
CONFIDENCE_WEIGHTS = {"rule": 0.40, "pattern": 0.20, "anomaly": 0.05, "causal": 0.20, "agents": 0.15}
BLEND_WEIGHTS = {"rule": 0.40, "pattern": 0.25, "anomaly": 0.12, "causal": 0.15, "agents": 0.08}


def fuse(evidence: DataFrame, facts: DataFrame, keys: list[str], weights: dict[str, float] = CONFIDENCE_WEIGHTS) -> DataFrame:
    """Evidence (keys, source, label, strength) to (keys, final_label, confidence, uncertainty).

    facts: (keys, historical_success, anomaly_score), nulls are 0.5 and 0. Equal sums go to the label that sorts first."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source"))
    sums = evidence.where("label is not null").groupBy(*keys, "label").agg(F.sum(weight * F.col("strength")).alias("score"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "label")))
    best = ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("final_label"), F.max("score").alias("winner"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    both = best.join(facts, keys, "left")
    uncertainty = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), (F.col("winner") - F.col("second")) * 2.5))
    confidence = F.col("winner") * 0.55 + F.coalesce("historical_success", F.lit(0.5)) * 0.15 + (1 - uncertainty) * 0.2 + (1 - F.least(F.lit(1.0), F.coalesce("anomaly_score", F.lit(0.0)))) * 0.1
    return both.select(*keys, "final_label", F.least(F.lit(0.99), F.greatest(F.lit(0.2), confidence)).alias("confidence"), uncertainty.alias("uncertainty"))
