"""Capture-level analytics: activity, breakdowns, windows, errors, timelines, findings, inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import predicates


def endpoint_activity(messages: DataFrame, k: int = 10) -> DataFrame:
    """(capture_id, endpoint, n): the k busiest addresses of each capture, as source or destination."""
    counts = messages.select("capture_id", F.explode(F.array("src_ip", "dst_ip")).alias("endpoint")).where("endpoint is not null").groupBy("capture_id", "endpoint").agg(F.count("*").alias("n"))
    return top_k(counts, ["capture_id"], [F.desc("n"), F.col("endpoint")], k)


def top_k(rows: DataFrame, keys: list[str], order: list, k: int, place: str | None = None) -> DataFrame:
    """The k first rows of each key; their number is kept as ``place`` if it is named."""
    w = Window.partitionBy(*keys).orderBy(*order)
    best = rows.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= k)
    return best.withColumnRenamed("_row", place) if place else best.drop("_row")


def protocol_breakdown(messages: DataFrame) -> DataFrame:
    """(capture_id, protocol, frames, percent): distinct frames, and their share of the capture's."""
    total = messages.groupBy("capture_id").agg(F.count_distinct("frame_number").alias("total"))
    own = messages.groupBy("capture_id", "protocol").agg(F.count_distinct("frame_number").alias("frames"))
    return own.join(total, "capture_id").select("capture_id", "protocol", "frames", (F.col("frames") * 100 / F.col("total")).alias("percent"))


def capture_window(messages: DataFrame) -> DataFrame:
    return messages.groupBy("capture_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count_distinct("frame_number").alias("frames"), F.count("*").alias("messages"), (F.max("ts") - F.min("ts")).alias("duration"))


def capture_summary(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per capture: counts of messages by technology, and of sessions by outcome."""
    by = messages.groupBy("capture_id").agg(F.count("*").alias("messages"), F.count_if(F.col("is_failure")).alias("failures"), *[F.count_if(F.col("technology") == t).alias(f"tech_{t.lower()}") for t in ("IMS", "HTTP", "Core", "LTE", "5G")])
    outcome = sessions.groupBy("capture_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("rca_label") == "NORMAL_CALL").alias("normal"), F.count_if(F.col("rca_label") == "UNKNOWN").alias("unknown"), F.avg("confidence_pct").alias("avg_confidence"), F.avg("duration_ms").alias("avg_duration_ms"))
    return by.join(outcome, "capture_id", "left")


# Names of families in a breakdown (others by their own), and the transport families, which say least.
SHOWN = {"DIAMETER": "Diameter", "MAP": "GSM MAP", "TCP": "TCP/SCTP", "SCTP": "TCP/SCTP"}
# What a capture is called by the families that it has: all of these, any of these, none of these.
TRACE_TYPES = [
    ("IMS call trace", ["SIP", "DIAMETER"], [], []), ("RADIUS AAA trace", ["RADIUS"], [], ["SIP", "DIAMETER"]), ("Multi-RAT 5G/4G signalling trace", ["NGAP", "S1AP"], [], []), ("5G signalling trace", [], ["NGAP", "PFCP"], []),
    ("LTE/4G signalling trace", [], ["S1AP", "GTP"], []), ("3G signalling trace", ["RANAP"], [], []), ("2G signalling trace", ["BSSAP"], [], []), ("HTTP/HTTPS service trace", ["HTTP"], [], []),
]
SCENARIOS = [
    ("IMS registration and mobile-originated VoIP call over a converged 5G/4G core", ["SIP", "DIAMETER"], ["NGAP", "S1AP"], []), ("IMS registration and voice signalling validation", ["SIP", "DIAMETER"], [], []),
    ("RADIUS authentication, authorization, and accounting validation", ["RADIUS"], [], []), ("Packet-core session establishment and bearer validation", ["PFCP", "GTP"], [], []), ("Multi-RAT signalling and interworking validation", ["NGAP", "S1AP"], [], []),
]


def capture_details(messages: DataFrame, sessions: DataFrame, keys: tuple = ("capture_id",)) -> DataFrame:
    """One row per capture: trace_type, scenario, dominant family, top four protocols, technologies, headline, window, frames, sessions, subscribers.

    The dominant family is the most frequent one that is not transport, by distinct frames, ties by name; a capture of transport alone is named by its first protocol. What is
    gathered of a capture is its protocols and technologies, a few dozen names."""
    keys = list(keys)
    p = F.coalesce("protocol", F.lit("UNKNOWN"))
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), p), p)
    counts = messages.groupBy(*keys, p.alias("_p"), shown.alias("_shown")).agg(F.count("*").alias("_n"))
    place = F.struct((-F.col("_n")).alias("n"), F.col("_p").alias("p"))
    top = counts.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(place)), 1, 4).alias("_top"), F.collect_set("_p").alias("_have"))
    families = messages.where(shown != "TCP/SCTP").groupBy(*keys, shown.alias("_shown")).agg(F.count_distinct("frame_number").alias("_frames"))
    best = families.groupBy(*keys).agg(F.min_by("_shown", F.struct((-F.col("_frames")).alias("n"), F.col("_shown"))).alias("_best"))
    window = messages.groupBy(*keys).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count_distinct("frame_number").alias("frames"), F.count_distinct("imsi").alias("subscribers"), F.array_sort(F.collect_set("technology")).alias("_tech"))
    rows = window.join(top, keys).join(best, keys, "left").join(sessions.groupBy(*keys).agg(F.count("*").alias("sessions")), keys, "left")
    has = lambda name: F.array_contains("_have", name)

    def holds(every: list[str], some: list[str], none: list[str]) -> Column:
        tests = [has(x) for x in every] + [~has(x) for x in none] + ([reduce(lambda a, b: a | b, [has(x) for x in some])] if some else [])
        return reduce(lambda a, b: a & b, tests)

    named = lambda table, other: reduce(lambda w, t: w.when(holds(*t[1:]), t[0]), table[1:], F.when(holds(*table[0][1:]), table[0][0])).otherwise(other)
    listed = F.transform("_top", lambda x: x["p"])
    trace = named(TRACE_TYPES, "Mixed telecom trace")
    headline = F.concat(trace, F.lit(" with "), F.array_join(F.slice(listed, 1, 2), ", "), F.lit(" activity across "), F.coalesce(F.nullif(F.array_join(F.slice("_tech", 1, 3), ", "), F.lit("")), F.lit("unknown technologies")))
    return rows.select(*keys, trace.alias("trace_type"), named(SCENARIOS, "Telecom signalling and service validation").alias("scenario"), F.coalesce("_best", F.get(listed, F.lit(0))).alias("dominant_protocol"), F.array_join(listed, ",").alias("top_protocols"),
        F.array_join("_tech", ",").alias("technologies"), headline.alias("headline"), "start_ts", "end_ts", "frames", "subscribers", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def top_pairs(messages: DataFrame) -> DataFrame:
    """The busiest pair of addresses of each capture and protocol."""
    counts = messages.groupBy("capture_id", "protocol", "src_ip", "dst_ip").agg(F.count("*").alias("n"))
    return top_k(counts, ["capture_id", "protocol"], [F.desc("n"), F.col("src_ip"), F.col("dst_ip")], 1)


def corpus_audit(sessions: DataFrame) -> DataFrame:
    """One row per capture: sessions, unknown, top label, protocols; the worst first by unknown share."""
    labels = sessions.groupBy("capture_id", "rca_label").agg(F.count("*").alias("n"))
    top = top_k(labels, ["capture_id"], [F.desc("n"), F.col("rca_label")], 1).select("capture_id", F.col("rca_label").alias("top_label"))
    facts = sessions.groupBy("capture_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("rca_label") == "UNKNOWN").alias("unknown"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("protocols")))).alias("protocols"))
    return facts.join(top, "capture_id")


def error_analysis(messages: DataFrame, low_below: int = 80) -> DataFrame:
    """(capture_id, category, n, severity): every category for every capture, also those that do not occur."""
    names = ("protocol", "message", "status_code", "cause_code", "result_code", "procedure", "is_failure", "retransmission", "reset")
    found = messages.select("capture_id", F.explode(predicates.error_categories({c: F.col(c) for c in names})).alias("category")).groupBy("capture_id", "category").agg(F.count("*").alias("n"))
    grid = messages.select("capture_id").distinct().select("capture_id", F.explode(F.array(*map(F.lit, predicates.ERROR_CATEGORIES))).alias("category"))
    rows = grid.join(found, ["capture_id", "category"], "left").na.fill(0, ["n"])
    some = F.when(F.col("n") == 0, "none")
    severity = F.when(F.col("category").isin("SIP 401", "NGAP release", "S1AP release", "RADIUS challenges"), "none").when(F.col("category") == "TCP transport issues", some.when(F.col("n") < low_below, "low").otherwise("medium")).when(F.col("category") == "Diameter informational", some.otherwise("low")).otherwise(some.otherwise("medium"))
    return rows.withColumn("severity", severity)


def error_timeline(messages: DataFrame, k: int = 10, repeats: int = 3) -> DataFrame:
    """The first failures of each capture: the first of each protocol and message, and up to ``repeats`` of bearer failures; the first k."""
    failed = messages.where("is_failure")
    w = Window.partitionBy("capture_id", "protocol", "message").orderBy("ts", "frame_number")
    ranked = failed.withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) | ((F.col("protocol") == "GTP") & (F.col("nth") <= repeats)))
    return top_k(ranked.select("capture_id", "ts", "frame_number", "protocol", "message"), ["capture_id"], [F.col("ts"), F.col("frame_number")], k)


def packet_examples(messages: DataFrame, k: int = 5) -> DataFrame:
    """The first k failing messages of each capture and protocol."""
    return top_k(messages.where("is_failure").select("capture_id", "protocol", "frame_number", "ts", "message"), ["capture_id", "protocol"], [F.col("ts"), F.col("frame_number")], k)


def protocol_share(messages: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent protocols with their share of the k's total."""
    counts = messages.groupBy("protocol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "protocol").limit(k)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def duration_histogram(sessions: DataFrame, edges: tuple = (1000.0, 5000.0, 15000.0)) -> DataFrame:
    d = F.coalesce("duration_ms", F.lit(0.0))
    label = reduce(lambda w, e: w.when(d < e[1], e[0]), [(f"bin{i + 1}", e) for i, e in enumerate(edges[1:], 1)], F.when(d < edges[0], "bin1")).otherwise(f"bin{len(edges) + 1}")
    return sessions.groupBy(label.alias("bin")).agg(F.count("*").alias("sessions"))


def session_filter(sessions: DataFrame, status: str = "ALL", protocol: str | None = None, text: str = "", k: int = 100, keys: tuple = ("capture_id", "session_id")) -> DataFrame:
    """The explorer: sessions of an outcome, with a protocol, with a text in any of their shown fields; the first k by priority."""
    rows = sessions
    if status != "ALL":
        rows = rows.where((F.col("rca_label") == "NORMAL_CALL") if status == "SUCCESS" else (F.col("rca_label") != "NORMAL_CALL"))
    if protocol:
        rows = rows.where(F.array_contains("protocols", protocol))
    if text:
        shown = [c for c in ("session_id", "imsi", "msisdn", "calling", "called", "rca_label", "flow", "final_sip_code", "apn") if c in rows.columns]
        rows = rows.where(F.lower(F.concat_ws(" ", *shown)).contains(text.lower()))
    order = [F.desc("confidence_pct"), *keys]
    return rows.orderBy(*order).limit(k)


def expert_findings(summary: DataFrame, errors: DataFrame, k: int = 4) -> DataFrame:
    """(capture_id, title, severity): findings on a capture, the most severe first, each title once."""
    facts = summary.withColumn("abnormal_ratio", 1 - (F.col("normal") + F.col("unknown")) / F.col("sessions")).withColumn("unknown_ratio", F.col("unknown") / F.col("sessions"))
    counts = errors.groupBy("capture_id").pivot("category", predicates.ERROR_CATEGORIES).agg(F.max("n"))
    rows = facts.join(counts, "capture_id", "left")
    c = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(0))
    tests = [
        (F.col("abnormal_ratio") >= 0.45, "High share of abnormal sessions", "high"), (F.col("unknown_ratio") >= 0.3, "Many sessions without a cause", "medium"), (c("TCP transport issues") >= 50, "Transport instability", "medium"),
        (c("Diameter errors") > 0, "Diameter errors", "high"), (c("GTPv2 context not found") > 0, "Bearer contexts not found", "medium"), (c("RADIUS errors") > 0, "RADIUS rejects", "medium"), (F.col("failures") == 0, "No failure observed", "low"),
    ]
    found = rows.select("capture_id", F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(title).alias("title"), F.lit(s).alias("severity"), F.lit(i).alias("place"))) for i, (t, title, s) in enumerate(tests)]))).alias("f")).select("capture_id", "f.*")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return top_k(found.withColumn("severity_rank", rank), ["capture_id"], [F.col("severity_rank"), F.col("place")], k).select("capture_id", "title", "severity")


def protocol_findings(interpreted: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Meanings of codes per session, the heaviest families first. interpreted: messages with family, recommended_label, meaning."""
    weight = F.when(F.col("family").isin("charging", "roaming", "authorization"), 3).when(F.col("family").isin("subscriber_absent", "server", "context"), 2).when(F.col("family") == "success", 0).otherwise(1)
    counts = interpreted.where("family is not null").groupBy(*keys, "protocol", "family", "recommended_label").agg(F.count("*").alias("n"), F.max(weight).alias("weight"))
    return top_k(counts, keys, [F.desc("weight"), F.desc("n"), F.col("protocol"), F.col("family")], k)


def parties(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The primary subscriber of each session, and which family named it."""
    rank = F.when(F.col("protocol") == "DIAMETER", 0).when(F.col("protocol") == "GTP", 1).when(F.col("protocol").isin("NAS_5GS", "NAS_EPS"), 2).otherwise(3)
    named = messages.where("imsi is not null").withColumn("rank", rank)
    order = F.struct("rank", "ts", "frame_number")
    return named.groupBy(*keys).agg(F.min_by("imsi", order).alias("subscriber"), F.min_by("protocol", order).alias("named_by"), F.count_distinct("imsi").alias("subscribers"))


def recurring(sessions: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    """Labels (but normal ones) that recur over all captures."""
    return sessions.where("rca_label != 'NORMAL_CALL'").groupBy("rca_label").agg(F.count("*").alias("n"), F.count_distinct("capture_id").alias("captures")).where(F.col("n") >= least).orderBy(F.desc("n"), "rca_label").limit(k)


def compact_repeats(rows: DataFrame, keys: list[str], text: str, order: Column) -> DataFrame:
    """Equal texts (in any case) once, as ``text xN``, at their first place."""
    counts = rows.groupBy(*keys, F.lower(text).alias("_key")).agg(F.min_by(text, order).alias("first_text"), F.count("*").alias("n"))
    return counts.select(*keys, F.when(F.col("n") > 1, F.concat("first_text", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("first_text")).alias("text"), "n")


def reports(summary: DataFrame) -> DataFrame:
    """Headline, assessment and recommendations of each capture, as text."""
    abnormal = F.col("sessions") - F.col("normal") - F.col("unknown")
    headline = F.concat(F.col("sessions").cast("string"), F.lit(" sessions, "), abnormal.cast("string"), F.lit(" abnormal, "), F.col("unknown").cast("string"), F.lit(" unknown"))
    assessment = F.when(abnormal * 2 >= F.col("sessions"), "critical").when(abnormal > 0, "degraded").otherwise("healthy")
    advice = F.array_compact(F.array(F.when(abnormal > 0, "review abnormal sessions"), F.when(F.col("unknown") > 0, "extend correlation"), F.when(F.col("failures") == 0, "no action")))
    return summary.select("capture_id", headline.alias("headline"), assessment.alias("assessment"), F.array_join(advice, "; ").alias("recommendations"))


def retained(events: DataFrame, keys: list[str], k: int = 5000) -> DataFrame:
    """The latest k events of each key."""
    return top_k(events, keys, [F.desc("ts"), F.desc("frame_number")], k)
