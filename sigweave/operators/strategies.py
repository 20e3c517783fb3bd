"""Correlation of SIP sessions with rows of other families: equi joins on an identity plus an interval on time.

Every strategy gives candidates (session, row, strategy, score, rank); arbitration keeps one strategy
per session. Nothing is compared pair by pair: similarity is an equality of derived keys, containment runs over
distinct values, and a pure time window is an equi join of time buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import fields

CANDIDATE = ["capture_id", "session_id", "message_uid", "strategy", "score", "rank"]
# Scores of the strategies.
SCORES = {"epdg_inner_ip_fusion": 112, "framed_ip_fusion": 110, "framed_ip_nat_similarity": 108, "ip_layer_match": 85, "msisdn_exact": 80, "msisdn_suffix": 78, "imsi_bridge": 75, "apn_match": 70, "time_cluster": 50}
GTP_SCORES = {"subscriber_ip_fusion": 120, "imsi_fusion": 105}
#: So many addresses of a session are carried along where it is compared with rows.
FEW = 64


def in_window(ts: Column, start: Column, end: Column, window: float) -> Column:
    return ts.between(start - window, end + window)


def keys_of(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(capture_id, message_uid, ts, kind, key): the look-up keys of rows; a kind's expression may be an array."""
    array = lambda x: x if "array" in rows.select(x.alias("x")).schema[0].dataType.simpleString() else F.array(x)
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("key"))
    every = F.concat(*[F.transform(F.coalesce(array(x), F.array().cast("array<string>")), named(kind)) for kind, x in kinds.items()])
    return rows.select("capture_id", "message_uid", "ts", F.explode(every).alias("e")).select("capture_id", "message_uid", "ts", "e.kind", "e.key").where("key is not null and key != ''").distinct()


def candidate_ips(sip: DataFrame, columns: list[str]) -> DataFrame:
    """(capture_id, session_id, ip, rank): the addresses of a session's messages, each at its first place."""
    rows = sip.select("capture_id", "session_id", F.posexplode(F.array(*columns)).alias("rank", "ip")).where("ip is not null")
    return rows.groupBy("capture_id", "session_id", "ip").agg(F.min("rank").alias("rank"))


def equi_window(sessions: DataFrame, session_keys: DataFrame, row_keys: DataFrame, kind: str, strategy: str, score: int, window: float, least: int = 1) -> DataFrame:
    """Candidates of one strategy. session_keys: (capture_id, session_id, key, rank); sessions: start_ts, end_ts."""
    left = session_keys.join(sessions.select("capture_id", "session_id", "start_ts", "end_ts"), ["capture_id", "session_id"])
    right = row_keys.where(F.col("kind") == kind).select("capture_id", "key", "message_uid", "ts")
    found = left.join(right, ["capture_id", "key"]).where(in_window(F.col("ts"), F.col("start_ts"), F.col("end_ts"), window))
    best = found.withColumn("best", F.min("rank").over(Window.partitionBy("capture_id", "session_id"))).where("rank = best")
    if least > 1:
        best = best.withColumn("n", F.count("*").over(Window.partitionBy("capture_id", "session_id"))).where(F.col("n") >= least)
    return best.select("capture_id", "session_id", "message_uid", F.lit(strategy).alias("strategy"), F.lit(score).alias("score"), "rank")


def _bucket(x: Column, window: float) -> Column:
    return F.floor(x / window).cast("long")


def _spans(start: Column, end: Column, window: float, wide: float) -> Column:
    """The buckets of a width that a session's window covers; none without a time."""
    return F.when(start.isNotNull() & end.isNotNull(), F.sequence(_bucket(start - window, wide), _bucket(F.greatest(start, end) + window, wide)))


def _variants(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(capture_id, message_uid, columns): identities that rows of one value of the columns have, and those of several."""
    listed = rows.groupBy("capture_id", "message_uid").agg(F.collect_set(F.struct(*columns)).alias("v"))
    of = lambda x: x.select("capture_id", "message_uid", F.explode("v").alias("v")).select("capture_id", "message_uid", "v.*")
    return of(listed.where(F.size("v") == 1)), of(listed.where(F.size("v") > 1))


def time_window(sessions: DataFrame, rows: DataFrame, window: float, strategy: str = "time_cluster", score: int = 50) -> DataFrame:
    """Rows in a session's window by time alone: both sides meet in buckets as wide as the window, each row in one, each session in those that it covers."""
    spans = sessions.select("capture_id", "session_id", "start_ts", "end_ts", F.explode(_spans(F.col("start_ts"), F.col("end_ts"), window, window)).alias("bucket"))
    found = rows.select("capture_id", "message_uid", "ts", _bucket(F.col("ts"), window).alias("bucket")).join(spans, ["capture_id", "bucket"]).where(in_window(F.col("ts"), F.col("start_ts"), F.col("end_ts"), window))
    return found.select("capture_id", "session_id", "message_uid", F.lit(strategy).alias("strategy"), F.lit(score).alias("score"), F.lit(0).alias("rank"))


def arbitrate(candidates: DataFrame) -> DataFrame:
    """The rows of each session's best strategy: highest score, then lowest rank, then name."""
    w = Window.partitionBy("capture_id", "session_id").orderBy(F.desc("score"), "rank", "strategy")
    best = candidates.withColumn("best", F.first("strategy").over(w)).where("strategy = best")
    return best.drop("best").distinct()


def diameter_fusion(sessions: DataFrame, ips: DataFrame, diameter: DataFrame, window: float = 5.0, aliases: DataFrame | None = None, called: DataFrame | None = None, min_overlap: int = 1, time_fallback: bool = True) -> DataFrame:
    """Diameter rows of SIP sessions. sessions: start_ts, end_ts, msisdn; ips: (capture_id, session_id, ip, rank)."""
    rows = keys_of(diameter, {
        "framed": F.col("framed_ip"), "similar": fields.similarity_key("framed_ip"), "ip": F.array("src_ip", "dst_ip"), "msisdn": fields.digits("msisdn"),
        "suffix": F.right(fields.digits("msisdn"), F.lit(8)), "imsi": F.col("imsi"),
    })
    ip_keys = ips.select("capture_id", "session_id", F.col("ip").alias("key"), "rank")
    number = sessions.where("msisdn is not null").select("capture_id", "session_id", fields.digits("msisdn").alias("key"), F.lit(0).alias("rank"))
    go = lambda keys, kind, strategy, least=1: equi_window(sessions, keys, rows, kind, strategy, SCORES[strategy], window, least)
    found = [
        go(ip_keys, "framed", "framed_ip_fusion"),
        go(ips.select("capture_id", "session_id", fields.similarity_key("ip").alias("key"), "rank").where("key is not null"), "similar", "framed_ip_nat_similarity"),
        go(ip_keys, "ip", "ip_layer_match"),
        go(number, "msisdn", "msisdn_exact", min_overlap),
        go(number.withColumn("key", F.right("key", F.lit(8))), "suffix", "msisdn_suffix", min_overlap),
    ]
    bridge = diameter.where("msisdn is not null and imsi is not null").groupBy("capture_id", fields.digits("msisdn").alias("number")).agg(F.min_by("imsi", "ts").alias("bridged"))
    over = number.join(bridge.withColumnRenamed("number", "key"), ["capture_id", "key"]).select("capture_id", "session_id", F.col("bridged").alias("key"), "rank")
    found.append(go(over, "imsi", "imsi_bridge", min_overlap))
    if aliases is not None:
        inner = ips.join(aliases.withColumnRenamed("outer_ip", "ip"), ["capture_id", "ip"]).select("capture_id", "session_id", F.col("inner_ip").alias("key"), "rank")
        found.append(go(inner, "framed", "epdg_inner_ip_fusion"))
    if called is not None:  # an access point has a number in it if one of its parts of the number's length is the number
        points = diameter.select("capture_id", F.lower("apn").alias("key")).where("key is not null").distinct()
        wanted = called.select("capture_id", "session_id", F.lower("called").alias("part")).where("part is not null")
        parts = points.join(F.broadcast(wanted.select(F.length("part").alias("n")).distinct())).where("n <= length(key)")
        parts = parts.select("capture_id", "key", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(key) - n + 1), i -> substring(key, i, n))"))).alias("part"))
        inside = wanted.join(parts, ["capture_id", "part"]).select("capture_id", "session_id", "key", F.lit(0).alias("rank"))
        by_point = keys_of(diameter, {"apn": F.lower("apn")})
        found.append(equi_window(sessions, inside, by_point, "apn", "apn_match", SCORES["apn_match"], window, min_overlap))
    strong = arbitrate(reduce(DataFrame.unionByName, found))
    if not time_fallback:
        return strong
    # every strategy counts more than time, so a session that one has found is decided; what the others have by time alone needs no arbitration, and is written as it is found
    left = sessions.join(strong.select("capture_id", "session_id").distinct(), ["capture_id", "session_id"], "left_anti")
    single, several = _variants(diameter, ["ts"])
    near = time_window(left, single, window)
    if not several.isEmpty():
        near = near.unionByName(time_window(left, several, window).distinct())
    return strong.unionByName(near.select(*strong.columns))


def gtp_fusion(sessions: DataFrame, ips: DataFrame, gtp: DataFrame, window: float = 5.0) -> DataFrame:
    """Bearer rows of SIP sessions: by subscriber address, else by IMSI."""
    rows = keys_of(gtp, {"subscriber_ip": F.col("subscriber_ips"), "imsi": F.col("imsi")})
    by_ip = equi_window(sessions, ips.select("capture_id", "session_id", F.col("ip").alias("key"), "rank"), rows, "subscriber_ip", "subscriber_ip_fusion", GTP_SCORES["subscriber_ip_fusion"], window)
    imsi = sessions.where("imsi is not null").select("capture_id", "session_id", F.col("imsi").alias("key"), F.lit(0).alias("rank"))
    return arbitrate(by_ip.unionByName(equi_window(sessions, imsi, rows, "imsi", "imsi_fusion", GTP_SCORES["imsi_fusion"], window)))


def endpoint_rows(sessions: DataFrame, ips: DataFrame, rows: DataFrame, window: float = 5.0) -> DataFrame:
    """Generic rows that share an endpoint with a session in its window; a session without addresses takes all rows in the window.

    Both sides meet by address and bucket of time, since very many sessions of all times have a gateway's address. What is found is
    written as it is found, without a shuffle of the result."""
    wide = 6 * window
    single, several = _variants(rows, ["ts", "src_ip", "dst_ip"])
    named = single.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("src_ip", "dst_ip")})
    second = F.when(~F.col("src_ip").eqNullSafe(F.col("dst_ip")), F.col("dst_ip"))
    ends = named.select("capture_id", "message_uid", "ts", _bucket(F.col("ts"), wide).alias("bucket"), "src_ip", F.posexplode(F.array("src_ip", second)).alias("side", "ip")).where("ip is not null")
    spans = sessions.select("capture_id", "session_id", "start_ts", "end_ts", F.explode(_spans(F.col("start_ts"), F.col("end_ts"), window, wide)).alias("bucket"))
    own = ips.groupBy("capture_id", "session_id").agg(F.collect_set("ip").alias("own"))
    few = own.where(F.size("own") <= FEW)
    asks = few.select("*", F.explode("own").alias("ip")).join(spans, ["capture_id", "session_id"])
    here = in_window(F.col("ts"), F.col("start_ts"), F.col("end_ts"), window)
    # a row that the session has by its source is not taken again by its destination
    shared = asks.join(ends, ["capture_id", "ip", "bucket"]).where(here & ((F.col("side") == 0) | ~F.coalesce(F.array_contains("own", F.col("src_ip")), F.lit(False)))).select("capture_id", "session_id", "message_uid")
    # sessions of many addresses, and identities that several rows have, are made distinct afterwards
    timed = lambda x: keys_of(x, {"ip": F.array("src_ip", "dst_ip")}).withColumn("bucket", _bucket(F.col("ts"), wide)).withColumnRenamed("key", "ip")
    many = own.where(F.size("own") > FEW).select("capture_id", "session_id", F.explode("own").alias("ip")).join(spans, ["capture_id", "session_id"])
    rest = []
    if not many.isEmpty():
        rest.append(many.join(timed(rows), ["capture_id", "ip", "bucket"]))
    if not several.isEmpty():
        rest.append(asks.drop("own").join(timed(several), ["capture_id", "ip", "bucket"]))
    bare = sessions.join(own.select("capture_id", "session_id"), ["capture_id", "session_id"], "left_anti")
    if rest:
        shared = shared.unionByName(reduce(DataFrame.unionByName, rest).where(here).select("capture_id", "session_id", "message_uid").distinct())
    return shared.unionByName(time_window(bare, rows, window).select("capture_id", "session_id", "message_uid"))


def related_imsi(parties: DataFrame, diameter: DataFrame, mobile: DataFrame) -> DataFrame:
    """parties: (capture_id, number). Adds imsi: of a Diameter row with the number, else of a mobile-application row with its last 8 digits."""
    exact = diameter.where("msisdn is not null and imsi is not null").groupBy("capture_id", fields.digits("msisdn").alias("number")).agg(F.min_by("imsi", "frame_number").alias("exact"))
    suffix = mobile.where("msisdn is not null and imsi is not null").groupBy("capture_id", F.right(fields.digits("msisdn"), F.lit(8)).alias("tail")).agg(F.min_by("imsi", "frame_number").alias("by_suffix"))
    both = parties.join(exact, ["capture_id", "number"], "left").withColumn("tail", F.right("number", F.lit(8))).join(suffix, ["capture_id", "tail"], "left")
    return both.withColumn("imsi", F.coalesce("exact", "by_suffix")).drop("exact", "by_suffix", "tail")


def latest_before(events: DataFrame, known: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """As-of: each event with the value of the latest known row of its keys at or before its time (null if there is none).

    One shuffle of both sides on the keys and one running window, no join; of known rows with one time the largest value counts."""
    sides = events.withColumn("_value", F.lit(None).cast(known.schema[value].dataType)).withColumn("_side", F.lit(1))
    facts = known.select(*keys, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = sides.unionByName(facts, allowMissingColumns=True).withColumn(value, F.last("_value", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*events.columns, value)
