"""Seeding: which messages begin as one session, and where a session is cut in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import predicates


def deduplicate(messages: DataFrame) -> DataFrame:
    """The first message (in time) of each identity.

    An aggregate of each column by one order, which takes all columns from the same message, leaves out the columns that nobody reads and drops repeats before they are sent. A filter on
    a row number would make the optimizer derive what holds for each of the message's columns, through both sides of a union: more than a driver of 750 MB holds."""
    keys = ["capture_id", "message_uid"]
    at = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), F.col("frame_number").alias("frame"))
    rows = messages.groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c in messages.columns if c not in keys])
    return rows.select(*messages.columns)


def grouped(messages: DataFrame, key: Column, prefix: str = "") -> DataFrame:
    """session_id from a key; rows without one go."""
    return messages.withColumn("session_id", F.concat(F.lit(prefix), key.cast("string"))).where("session_id is not null")


def peer_key() -> Column:
    """Both addresses in either order, and the frame."""
    return F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"), F.col("frame_number").cast("string"))


def subscriber_key() -> Column:
    return F.coalesce("imsi", "supi", "msisdn")


def seed_key() -> Column:
    """The identity that a message's session is seeded by, by family, with the peers as the last resort."""
    p = F.col("protocol")
    tunnel = F.when(F.size("teids") > 0, F.array_min("teids"))
    own_ip = F.when(F.size("subscriber_ips") > 0, F.concat_ws("|", F.array_min("subscriber_ips"), F.coalesce("imsi", "apn")))
    chosen = (
        F.when(p == "SIP", F.col("call_id"))
        .when(p == "DIAMETER", F.coalesce("dia_session_id", "imsi", "msisdn"))
        .when(p == "INAP", F.coalesce("tcap_tid", "msisdn"))
        .when(p == "GTP", F.coalesce(tunnel, own_ip, "imsi"))
        .when((p == "HTTP") & F.col("sbi_service").isNotNull(), F.coalesce("supi", "imsi", "transaction_id", "stream_id"))
        .when(p == "NAS_5GS", F.coalesce("imsi", "supi", "transaction_id"))
        .otherwise(F.coalesce("transaction_id", "seid", subscriber_key(), "stream_id"))
    )
    return F.concat_ws(":", F.lower(p), F.coalesce(chosen, peer_key()))


def seed(messages: DataFrame) -> DataFrame:
    """Adds session_id within the capture."""
    return messages.withColumn("session_id", seed_key())


def sip_seed(sip: DataFrame) -> DataFrame:
    """SIP dialogs: a Call-ID with several To-tags is one session per tag; messages without a tag go to every one."""
    tags = sip.groupBy("capture_id", "call_id").agg(F.array_sort(F.collect_set("to_tag")).alias("tags"))
    rows = sip.join(tags, ["capture_id", "call_id"])
    rows = rows.withColumn("dialog_tag", F.explode_outer(F.when(F.size("tags") > 1, F.col("tags"))))
    rows = rows.where(F.col("dialog_tag").isNull() | F.col("to_tag").isNull() | (F.col("to_tag") == F.col("dialog_tag")))
    return rows.withColumn("session_id", F.concat_ws(":to-tag:", "call_id", "dialog_tag")).drop("tags")


def gap_segments(messages: DataFrame, keys: list[str], gap: float = 15.0, ts: str = "ts") -> DataFrame:
    """segment (0, 1, ...): a new one where more than ``gap`` passed since the message before."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce(ts, F.lit(0)), "frame_number")
    cut = F.when(F.col(ts) - F.lag(ts).over(order) > gap, 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(running)).drop("_cut")


def segment_id(session: Column, segment: Column) -> Column:
    return F.when(segment > 0, F.concat(session, F.lit(":seg"), (segment + 1).cast("string"))).otherwise(session)


def procedure_segments(messages: DataFrame, keys: list[str], gap: float = 10.0, restart_gap: float = 2.0, least_rows: int = 12) -> DataFrame:
    """segment by procedure: cut at a gap, or at a start marker after a completion marker with the restart gap between them; sessions of fewer than ``least_rows`` rows stay whole.

    Whether a completion was seen since the last cut is a state of one bit, and what a row does to it is one of two functions: at a gap, and at a start marker behind the restart gap, the bit
    becomes the row's own completion mark (cut or not, nothing older counts any more); at any other row it stays set or is set by the row. So the bit before a row is the
    maximum of the marks since the last row of the first sort: running windows over one order, without a list of a session's rows."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0.0)), F.coalesce("frame_number", F.lit(0)), "message_uid")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ts = F.coalesce("ts", F.lit(0.0))
    apart = ts - F.lag(ts).over(order)
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = messages.withColumns({"_late": no(apart > gap), "_fresh": no(predicates.start_marker(F.col("message"))) & no(apart > restart_gap), "_done": no(predicates.completion_marker(F.col("message"))).cast("int")})
    rows = rows.withColumn("_since", F.count_if(F.col("_late") | F.col("_fresh")).over(running))
    since = Window.partitionBy(*keys, "_since").orderBy(*[F.coalesce("ts", F.lit(0.0)), F.coalesce("frame_number", F.lit(0)), F.col("message_uid")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_after", F.max("_done").over(since)).withColumn("_before", F.coalesce(F.lag("_after").over(order), F.lit(0)))
    rows = rows.withColumn("_cut", (F.col("_late") | (F.col("_fresh") & (F.col("_before") == 1))).cast("int")).withColumn("segment", F.sum("_cut").over(running).cast("int"))
    size = messages.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.count("*").alias("_rows"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    rows = rows.join(size, same).withColumn("segment", F.when(F.col("_rows") >= least_rows, F.col("segment")).otherwise(0))
    return rows.drop("_late", "_fresh", "_done", "_since", "_after", "_before", "_cut", "_rows", *[f"_key_{k}" for k in keys])


# Families whose messages are cut by procedure.
LEGACY, BY_PROCEDURE = ["RANAP", "MAP"], ["NAS_EPS", "S1AP", "SCTP", "UDP"]


def named_subscriber() -> Column:
    """The first subscriber identity with its kind: IMSIs have 14 to 16 digits, other numbers are MSISDNs."""
    value = F.regexp_replace(subscriber_key(), "^(imsi|msisdn)-", "")
    return F.when(value.rlike("^[0-9]{14,16}$"), F.concat(F.lit("imsi:"), value)).when(value.rlike("^[0-9]+$"), F.concat(F.lit("msisdn:"), value)).otherwise(F.concat(F.lit("id:"), value))


def generic_key() -> Column:
    """The key of a message of no call family: service and 5G messages go by subscriber, tunnels of IKEv2 by subscriber or inner address, all others by transaction first."""
    p, who = F.col("protocol"), named_subscriber()
    inner = F.when(F.size("ike_inner_ips") > 0, F.array_min("ike_inner_ips"))
    chosen = F.when(F.col("sbi_service").isNotNull() & who.isNotNull(), F.concat(F.lit("sbi:"), who)).when((p == "NAS_5GS") & who.isNotNull(), F.concat(F.lit("5gs:"), who)).when(p == "IKEV2", F.coalesce(who, inner, "transaction_id", "stream_id"))
    return F.coalesce(chosen.otherwise(F.coalesce("transaction_id", "seid", who, "stream_id")), peer_key())


def generic_sessions(messages: DataFrame, gap: float = 10.0, restart_gap: float = 2.0, legacy_restart_gap: float = 0.5, least_rows: int = 12, k: int = 8) -> DataFrame:
    """(capture_id, session_id, calling, called, start_ts, end_ts, messages, flow): sessions of captures without any call family, named by protocol and key and cut by procedure.

    A session has one protocol, so that each protocol's way of cutting is applied to its own rows. Calling is the first source, called the last destination, flow the first k messages."""
    keys = ["capture_id", "session_id"]
    rows = messages.withColumn("session_id", F.concat_ws(":", F.coalesce("protocol", F.lit("GENERIC")), generic_key()))
    p = F.coalesce("protocol", F.lit(""))
    legacy = procedure_segments(rows.where(p.isin(LEGACY)), keys, gap, legacy_restart_gap, 0)
    cut = procedure_segments(rows.where(p.isin(BY_PROCEDURE)), keys, gap, restart_gap, least_rows)
    whole = rows.where(~p.isin(LEGACY + BY_PROCEDURE)).withColumn("segment", F.lit(0))
    parts = legacy.unionByName(cut).unionByName(whole).withColumn("session_id", segment_id(F.col("session_id"), F.col("segment")))
    at = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), F.coalesce("frame_number", F.lit(0)).alias("frame"), F.col("message_uid").alias("uid"))
    out = parts.groupBy(*keys).agg(F.min_by("src_ip", at).alias("calling"), F.max_by("dst_ip", at).alias("called"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("messages"))
    first = parts.withColumn("_at", at).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).where(F.col("_n") <= k)
    told = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("message", "protocol").alias("text")))), lambda x: x["text"]), " → ").alias("flow"))
    return out.join(told, keys)


def epdg_aliases(messages: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(capture_id, outer_ip, inner_ip): configured aliases, and inferred ones of outer addresses with one inner address only."""
    tunnels = messages.where((F.col("protocol") == "IKEV2") & (F.size("ike_inner_ips") > 0))
    ends = tunnels.select("capture_id", F.explode(F.array("src_ip", "dst_ip")).alias("outer_ip"), "ike_inner_ips")
    pairs = ends.select("capture_id", "outer_ip", F.explode("ike_inner_ips").alias("inner_ip"))
    single = pairs.where("outer_ip is not null and outer_ip != inner_ip").groupBy("capture_id", "outer_ip").agg(F.count_distinct("inner_ip").alias("n"), F.min("inner_ip").alias("inner_ip")).where("n = 1").drop("n")
    if configured is None:
        return single
    return configured.select("capture_id", "outer_ip", "inner_ip").unionByName(single.join(configured, ["capture_id", "outer_ip"], "left_anti"))
