"""Session features, embeddings, anomaly and priority: arithmetic columns over session records and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups of Q.850 causes; flows of normal and failed calls.
Q850 = {"busy": [17], "no_answer": [18, 19], "unreachable": [20, 27], "rejected": [21, 50, 55], "network_fail": [34, 38, 41, 42], "normal": [16, 31]}
DIMENSIONS = 48


def hops(messages: DataFrame, keys: list[str], slow_ms: float = 2000.0) -> DataFrame:
    """(keys, cross_protocol_hops, timer_anomaly_count, sequence, timer_anomalies): changes of protocol, slow gaps, the first 40 PROTOCOL:message tokens,
    and slow_gap:PROTOCOL:message of the first 10 messages behind a slow gap."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0)), "frame_number")
    rows = messages.withColumn("before", F.lag("protocol").over(w)).withColumn("gap_ms", (F.col("ts") - F.lag("ts").over(w)) * 1000).withColumn("seq", F.row_number().over(w))
    rows = rows.withColumn("slow", F.when(F.col("gap_ms") >= slow_ms, F.sum(F.when(F.col("gap_ms") >= slow_ms, 1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    token = F.concat_ws(":", "protocol", F.coalesce("message", F.lit("EVENT")))
    first = F.array_sort(F.collect_list(F.when(F.col("seq") <= 40, F.struct("seq", token.alias("token")))))
    return rows.groupBy(*keys).agg(F.count_if(F.col("before") != F.col("protocol")).alias("cross_protocol_hops"), F.count_if(F.col("gap_ms") >= slow_ms).alias("timer_anomaly_count"), F.transform(first, lambda x: x["token"]).alias("sequence"), F.transform(F.array_sort(F.collect_list(F.when(F.col("slow") <= 10, F.struct("seq", F.concat(F.lit("slow_gap:"), token).alias("token"))))), lambda x: x["token"]).alias("timer_anomalies"))


def transitions(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(protocol_from, protocol_to, n) over all sessions."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0)), "frame_number")
    return messages.withColumn("protocol_from", F.lag("protocol").over(w)).where("protocol_from is not null and protocol_from != protocol").groupBy("protocol_from", F.col("protocol").alias("protocol_to")).agg(F.count("*").alias("n"))


def call_type() -> Column:
    p = F.col("protocols")
    has = lambda x: F.array_contains(p, x)
    return F.when(has("IKEV2"), "VoWiFi").when(has("SIP") & (has("NAS_5GS") | has("NGAP")), "VoNR").when(has("SIP"), "VoLTE").when(has("GTP") | has("S1AP"), "LTE data").when(has("NAS_5GS") | has("NGAP") | has("PFCP"), "5G data").when(has("MAP") | has("BSSAP"), "Legacy").otherwise("Other")


def features(sessions: DataFrame, sequence: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric features of each labelled session, with its sequence and signature."""
    code = F.coalesce("final_sip_code", F.lit(""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    failure = F.col("time_to_failure_ms")
    rows = sessions.join(sequence, keys)
    named = {
        "sip_1xx": flag(code.startswith("1")), "sip_2xx": flag(code.startswith("2")), "sip_4xx": flag(code.startswith("4")), "sip_5xx": flag(code.startswith("5")), **{f"sip_{c}": flag(code == c) for c in ("480", "487", "488", "486", "408", "503", "200")},
        "flow_length": F.size(F.split("flow", " → ")), "missing_ringing": flag(~(F.col("has_180") | F.col("has_183") | F.col("has_200"))), "missing_cancel": flag(~F.col("has_cancel") & (code == "487")), "missing_200_ok": flag(~F.col("has_200")), "missing_bye": flag(F.col("has_200") & ~F.col("has_bye")),
        "failure_immediate": flag((failure > 0) & (failure < 500)), "failure_fast": flag((failure >= 500) & (failure < 5000)), "failure_timeout": flag(failure > 15000), **{f"q850_{n}": flag(F.col("q850").isin(v)) for n, v in Q850.items()},
        "has_diameter": flag(F.col("dia_count") > 0), "dia_failure_count": F.col("dia_failures").cast("int"), "auth_failed_dia": flag(F.col("auth_failed")), "charging_failed_flag": flag(F.col("charging_failed")), "has_inap": flag(F.col("inap_count") > 0),
        "has_retransmission": flag(F.col("invites") > 1), "protocol_count": F.size("protocols"), "technology_count": F.size("technologies"), "sequence_length": F.size("sequence"), "is_unknown": flag(F.col("rca_label") == "UNKNOWN"), "is_normal": flag(F.col("rca_label") == "NORMAL_CALL"), "is_mobility": flag(F.col("mobility")),
        "sip_error_count": flag(code.rlike("^[45]")), "transport_heavy": flag(F.size(F.array_except("protocols", F.array(F.lit("TCP"), F.lit("UDP"), F.lit("SCTP"), F.lit("DNS"), F.lit("ICMP")))) == 0),
        "call_type": call_type(),
    }
    rows = rows.withColumns(named)
    final = F.coalesce("final_sip_code", F.col("q850").cast("string"), F.lit("NA"))
    return rows.withColumn("signature", F.concat_ws("|", "call_type", final, F.array_join(F.slice("protocols", 1, 5), "/")))


def anomaly(rows: DataFrame) -> DataFrame:
    """Adds the four signals, anomaly_score, is_anomalous, dominant_signal and suggested_cause."""
    n = lambda c, most: F.least(F.col(c).cast("double"), F.lit(float(most)))
    one = lambda x: F.least(F.lit(1.0), x)
    signals = {
        "transport": one(F.col("has_retransmission") * 0.45 + n("timer_anomaly_count", 4) * 0.12 + F.col("q850_network_fail") * 0.22 + F.col("transport_heavy") * 0.08),
        "charging": one(n("dia_failure_count", 4) * 0.2 + F.col("charging_failed_flag") * 0.34 + F.col("auth_failed_dia") * 0.24),
        "signaling": one(n("sip_error_count", 4) * 0.16 + n("cross_protocol_hops", 6) * 0.08 + n("sequence_length", 24) / 120 + F.col("is_unknown") * 0.18),
        "mobility_signal": one(F.col("is_mobility") * 0.16 + n("cross_protocol_hops", 6) * 0.06 + n("timer_anomaly_count", 4) * 0.06 + F.col("technology_count") * 0.02),
    }
    rows = rows.withColumns(signals)
    score = (F.col("transport") * 0.28 + F.col("charging") * 0.32 + F.col("signaling") * 0.22 + F.col("mobility_signal") * 0.18) * 0.82
    order = F.array(*[F.struct(F.col(s).alias("v"), F.lit(-i).alias("first"), F.lit(s).alias("name")) for i, s in enumerate(signals)])
    cause = F.when((F.col("charging_failed_flag") > 0) | (F.col("dia_failure_count") >= 2), "CHARGING_FAILURE").when(F.col("auth_failed_dia") > 0, "SUBSCRIBER_BARRED").when((F.col("q850_network_fail") > 0) | (F.col("has_retransmission") > 0), "CORE_NETWORK_FAILURE")
    cause = cause.when((F.col("cross_protocol_hops") >= 3) & (F.col("timer_anomaly_count") >= 2), "NETWORK_CONGESTION").otherwise(F.col("rca_label"))
    return rows.withColumns({"anomaly_score": one(score), "is_anomalous": score >= 0.55, "dominant_signal": F.array_max(order)["name"], "suggested_cause": cause})


# What a severity adds to the priority.
SEVERITY = {"CRITICAL": 20.0, "HIGH": 18.0, "MEDIUM": 12.0, "LOW": 6.0}


def priority(rows: DataFrame) -> DataFrame:
    """Adds priority_score (0 to 99), priority_band and priority_reason. Optional columns: uncertainty, is_conflicted, similarity."""
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)
    normal, unknown = F.col("rca_label") == "NORMAL_CALL", F.col("rca_label") == "UNKNOWN"
    severe = F.col("severity").isin("HIGH", "CRITICAL")
    confidence = F.col("confidence_pct").cast("double")
    uncertainty = have("uncertainty", None) if "uncertainty" in rows.columns else F.greatest(F.lit(0.0), 1 - confidence / 100)
    similarity, conflicted = have("similarity", 0.0), have("is_conflicted", False)
    cap = lambda most, x: F.least(F.lit(float(most)), x)
    parts = [
        (~normal, F.lit(30.0), F.concat(F.initcap(F.replace("rca_label", F.lit("_"), F.lit(" "))), F.lit(" RCA"))), (unknown, F.lit(16.0), F.lit("needs correlation review")),
        (~normal | severe, F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity")), F.when(severe, F.concat(F.initcap("severity"), F.lit(" severity")))),
        (~normal, cap(18, confidence * 0.16), None), (normal, cap(8, F.greatest(F.lit(0.0), (100 - confidence) * 0.08)), None),
        (F.col("anomaly_score") >= 0.55, cap(12, F.col("anomaly_score") * 12), F.lit("anomalous behavior")), (uncertainty >= 0.35, cap(10, uncertainty * 14), F.lit("low confidence")), (conflicted, F.lit(8.0), F.lit("agent disagreement")),
        (F.col("timer_anomaly_count") > 0, cap(6, F.col("timer_anomaly_count") * 1.5), F.lit("timer anomalies")), (F.col("has_retransmission") > 0, F.lit(5.0), F.lit("retransmissions")),
        (F.col("dia_failure_count") > 0, cap(8, F.col("dia_failure_count") * 2.0), F.lit("Diameter failure")), (F.col("cross_protocol_hops") >= 2, cap(6, F.col("cross_protocol_hops") * 0.8), F.lit("cross-protocol complexity")),
        ((similarity >= 0.92) & normal, F.lit(-8.0), None), ((similarity >= 0.92) & ~normal, F.lit(4.0), None),
    ]
    score = F.lit(10.0)
    for test, points, _ in parts:
        score = score + F.when(test, points).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(99.0), score))
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(test, reason) for test, _, reason in parts if reason is not None])))
    band = F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")
    return rows.withColumns({"priority_score": score, "priority_band": band, "priority_reason": F.coalesce(F.nullif(F.array_join(F.slice(reasons, 1, 3), ", "), F.lit("")), F.lit("baseline inspection"))})


def confidence_band(pct: Column) -> Column:
    return F.when(pct >= 85, "high").when(pct >= 60, "medium").when(pct >= 35, "low").otherwise("very low")


def embedding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, embedding): a signed hashing vector of the session's tokens and seven numbers, of length 1."""
    named = lambda prefix, x: F.transform(x, lambda v: F.concat(F.lit(prefix), v))
    tokens = F.concat(named("proto:", F.col("protocols")), named("tech:", F.col("technologies")), named("seq:", F.slice("sequence", 1, 20)), F.array(F.concat(F.lit("rca:"), "rca_label"), F.concat(F.lit("fail:"), F.coalesce("signature", F.lit("unknown")))), named("timer:", F.coalesce("timer_anomalies", F.array().cast("array<string>"))))
    exploded = rows.select(*keys, F.explode(tokens).alias("token")).withColumn("h", F.sha2(F.encode("token", "UTF-8"), 256))
    byte = lambda i: F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")
    hashed = exploded.select(*keys, (byte(0) % DIMENSIONS).alias("slot"), (F.when(byte(1) % 2 == 0, 1.0).otherwise(-1.0) * (1 + byte(2) / 255)).alias("value"))
    numbers = [F.col("duration_ms") / 10000, F.col("dia_failure_count"), F.col("inap_count"), F.col("protocol_count"), F.col("technology_count"), F.col("cross_protocol_hops"), F.col("timer_anomaly_count")]
    extra = rows.select(*keys, F.posexplode(F.array(*[x.cast("double") for x in numbers])).alias("slot", "value"))
    sums = hashed.unionByName(extra).groupBy(*keys, "slot").agg(F.sum("value").alias("value")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    sums = sums.select(*keys, vector.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return sums.select(*keys, F.transform("v", lambda x: F.bround(F.when(norm > 0, x / norm).otherwise(0.0), 6)).alias("embedding"))


# Weight of a feature in the explanation of a label.
EXPLAIN = [("CHARGING_FAILURE", "charging_failed_flag", 0.6), ("CHARGING_FAILURE", "dia_failure_count", 0.25), ("SUBSCRIBER_BARRED", "auth_failed_dia", 0.6), ("USER_BUSY", "sip_486", 0.7), ("SUBSCRIBER_UNREACHABLE", "sip_480", 0.6), ("USER_ABORT", "sip_487", 0.5), ("SERVICE_TIMEOUT", "failure_timeout", 0.4), ("NETWORK_CONGESTION", "has_retransmission", 0.5), ("CORE_NETWORK_FAILURE", "q850_network_fail", 0.5), ("NORMAL_CALL", "sip_200", 0.5), ("UNKNOWN", "is_unknown", 0.3)]


def explain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value, contribution) of the features that speak for each session's label."""
    table = rows.sparkSession.createDataFrame(EXPLAIN, "label string, feature string, weight double")
    names = sorted({f for _, f, _ in EXPLAIN})
    long = rows.select(*keys, "rca_label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in names])).alias("f")).select(*keys, "rca_label", "f.*").where("value != 0")
    return long.join(F.broadcast(table), (F.col("rca_label") == table["label"]) & (long["feature"] == table["feature"])).select(*keys, "rca_label", long["feature"], "value", (F.col("value") * F.col("weight")).alias("contribution"))
