"""Scoring and merging pairs of sessions, blocked by shared tokens.

A pair can only reach the threshold if it shares an identity, an address or a stream, or one continues the other, so joining on tokens loses no
pair. A token that very many sessions share (a gateway's address, a subscriber over a month) is no reason to compare them all: tokens that more than
``hot`` sessions of a capture have are compared within time buckets, outside of which they count for nothing anyway. Only session identities
and streams count at any distance.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import fields

# What a shared token of a kind adds, within the time window unless said otherwise.
POINTS = {"subscriber_ip": 110, "tunnel": 105, "access": 95, "subscriber_id": 90}
TEID_CONTINUATION, ACCESS_CONTINUATION, SAME_ID, SAME_STREAM = 102, 92, 120, 85
MERGE_AT, ATTACH_AT = 70, 55
TRANSPORT = ("TCP", "UDP", "SCTP")
KINDS = ["id", "subscriber_ip", "tunnel", "access", "subscriber_id", "stream", "pair", "ip"]


def gap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0 on overlap, infinite if a bound is missing."""
    return F.coalesce(F.greatest(a_start - b_end, b_start - a_end, F.lit(0.0)) + 0 * (a_start + a_end + b_start + b_end), F.lit(float("inf")))


def _spans(start: Column, end: Column, reach: float) -> Column:
    """Buckets of time, of which two spans have one in common if at most ``reach`` lies between them."""
    bucket = lambda x: F.floor(x / reach)
    return F.sequence(bucket(start - reach), bucket(end))


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of different sessions that share a token, each once: of several common buckets the first one counts."""
    both = left.withColumnsRenamed({"session_id": "one", "first": "one_first"}).join(right.withColumnsRenamed({"session_id": "other", "first": "other_first"}), ["capture_id", "kind", "token", "bucket", *on])
    return both.where((F.col("one") != F.col("other")) & (F.col("bucket") == F.greatest("one_first", "other_first")))


def blocked_pairs(sessions: DataFrame, tokens: DataFrame, reach: float, hot: int = 200, apart: str | None = None) -> DataFrame:
    """(capture_id, a, b, id, subscriber_ip, ...): how many tokens of each kind each pair of sessions shares. sessions: start_ts, end_ts.

    reach: the largest gap in seconds at which the caller's rule still counts tokens; pairs that are nearer are never lost.
    apart: a column of sessions; two that differ in it are not brought together by anything but session identities. Sessions without a value meet all others."""
    who = F.col(apart).cast("string") if apart else F.lit("")
    facts = sessions.select("capture_id", "session_id", "start_ts", "end_ts", who.alias("who"))
    strong, weak = tokens.where("kind in ('id', 'stream')"), tokens.where("kind not in ('id', 'stream', 'technology')")
    if apart:
        # addresses and the like only count of sessions that have another one of their kin near; of whom none is, is known from the sessions alone
        facts = saved(facts)
        kin = Window.partitionBy("capture_id", "who").orderBy("start_ts")
        timed = facts.where("start_ts is not null and end_ts is not null and who is not null")
        timed = timed.select("*", F.max("end_ts").over(kin.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("start_ts").over(kin).alias("after"))
        near = saved(timed.where((F.col("before") >= F.col("start_ts") - reach) | (F.col("after") <= F.col("end_ts") + reach)).select("capture_id", "session_id"))
        bare = not facts.where("who is null").isEmpty()
        if not bare:
            weak = weak.limit(0) if near.isEmpty() else weak.join(near, ["capture_id", "session_id"], "left_semi")
    # session identities bring all together, everything else those of one kin
    rows = strong.unionByName(weak).join(facts, ["capture_id", "session_id"]).withColumn("who", F.when(F.col("kind") == "id", F.lit("")).otherwise(F.col("who")))
    sharers = weak.join(facts, ["capture_id", "session_id"]).groupBy("capture_id", "kind", "token", "who").agg(F.count("*").alias("sharers"))
    common = sharers.where(F.col("sharers") > hot)

    def bucketed(rows: DataFrame, common: DataFrame, on: list[str]) -> DataFrame:
        rows = rows.join(common, ["capture_id", "kind", "token", *on], "left")
        spans = F.when(F.col("sharers").isNotNull(), _spans(F.col("start_ts"), F.col("end_ts"), reach)).otherwise(F.array(F.lit(-1).cast("bigint")))
        # of a common token, a session without a time is near nothing and has no row
        return rows.withColumn("spans", spans).select("capture_id", "kind", "token", "who", "session_id", F.col("spans")[0].alias("first"), F.explode("spans").alias("bucket"))

    keyed = bucketed(rows.where("who is not null"), common, ["who"])
    met = _met(keyed, keyed, ["who"]).where("one < other").select("capture_id", F.col("one").alias("a"), F.col("other").alias("b"), "kind")
    if apart and bare:
        # those without a value, and whoever shares a token with one of them
        shared = rows.where("kind != 'id'")
        wide = sharers.groupBy("capture_id", "kind", "token").agg(F.sum("sharers").alias("sharers")).where(F.col("sharers") > hot)
        theirs = shared.where("who is null").select("capture_id", "kind", "token").distinct()
        there = bucketed(shared.join(theirs, ["capture_id", "kind", "token"], "left_semi"), wide, [])
        some = _met(there.where("who is null").drop("who"), there, []).where("who is not null or one < other")
        met = met.unionByName(some.select("capture_id", F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), "kind"))
    return met.groupBy("capture_id", "a", "b").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def sides(pairs: DataFrame, sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Adds a_<column> and b_<column>."""
    for s in ("a", "b"):
        pairs = pairs.join(sessions.select("capture_id", F.col("session_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]), ["capture_id", s])
    return pairs


def continuations(sessions: DataFrame, tokens: DataFrame, window: float) -> DataFrame:
    """(capture_id, a, b, method): pairs that continue each other within the stateful window.

    ``teid_continuation``: of the sessions with tunnels that share an IMSI, each one and the first after it that has other tunnels, with a subscriber address, an access id
    or a mobility procedure (column ``mobility``, if there is one) to support it. ``access_continuation``: sessions with one access id and no common session identity that share a
    subscriber or a subscriber address, or of which one has a tunnel. Sharers are met within time buckets only."""
    reach = max(15.0, 30.0, 6 * window)
    kinds = ["id", "subscriber_id", "subscriber_ip", "tunnel", "access"]
    listed = tokens.groupBy("capture_id", "session_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("token"))).alias(k) for k in kinds])
    mobility = F.coalesce("mobility", F.lit(False)) if "mobility" in sessions.columns else F.lit(False)
    facts = saved(sessions.select("capture_id", "session_id", "start_ts", "end_ts", mobility.alias("mobility")).join(listed, ["capture_id", "session_id"]))
    bucket = lambda x: F.floor(x / reach).cast("long")
    keyed = facts.withColumn("key", F.explode(F.concat(F.when(F.size("tunnel") > 0, F.filter("subscriber_id", lambda x: fields.is_imsi(x))).otherwise(F.array().cast("array<string>")), F.transform("access", lambda x: F.concat(F.lit("access "), x)))))
    keyed = keyed.where("start_ts is not null and end_ts is not null").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_ts") - reach), bucket(F.col("end_ts")))))
    side = lambda x: keyed.select("capture_id", "key", "bucket", F.struct("start_ts", "session_id").alias(f"{x}_place"), *[F.col(c).alias(f"{x}_{c}") for c in ("session_id", "start_ts", "end_ts", "mobility", *kinds)])
    met = side("a").join(side("b"), ["capture_id", "key", "bucket"]).where("a_place < b_place").where(gap_seconds(F.col("a_start_ts"), F.col("a_end_ts"), F.col("b_start_ts"), F.col("b_end_ts")) <= reach)
    shared = lambda c: F.arrays_overlap(f"a_{c}", f"b_{c}")
    some = lambda c: (F.size(f"a_{c}") > 0) | (F.size(f"b_{c}") > 0)
    access = F.col("key").startswith("access ")
    teid = met.where(~access & ~shared("tunnel") & (shared("subscriber_ip") | shared("access") | F.col("a_mobility") | F.col("b_mobility")))
    teid = teid.groupBy("capture_id", "key", F.col("a_session_id").alias("one")).agg(F.min("b_place").alias("next")).select("capture_id", "one", F.col("next.session_id").alias("other"), F.lit("teid_continuation").alias("method"))
    held = met.where(access & ~shared("id") & (shared("subscriber_id") | shared("subscriber_ip") | some("tunnel")))
    both = teid.unionByName(held.select("capture_id", F.col("a_session_id").alias("one"), F.col("b_session_id").alias("other"), F.lit("access_continuation").alias("method")))
    return both.select("capture_id", F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), "method").distinct()


def score_pairs(sessions: DataFrame, tokens: DataFrame, window: float = 5.0, links: DataFrame | None = None, hot: int = 200) -> DataFrame:
    """(capture_id, a, b, score, same_id) of every pair that scores, by a shared token or as a continuation. sessions: start_ts, end_ts, protocols, technologies, imsi.

    Two sessions of different IMSIs score by a common session identity only, so they never meet over an address. A session identity is worth its
    points whatever the two sessions are, so only the other pairs look their sessions up."""
    counts = blocked_pairs(sessions, tokens, max(2.0, 2 * window), hot, apart="imsi")
    if links is None:
        links = continuations(sessions, tokens, window)
    marks = links.groupBy("capture_id", "a", "b").agg(F.max(F.when(F.col("method") == "teid_continuation", TEID_CONTINUATION).otherwise(ACCESS_CONTINUATION)).alias("state"))
    counts = counts.join(marks, ["capture_id", "a", "b"], "full").na.fill(0, [c for c in counts.columns if c not in ("capture_id", "a", "b")])
    same = counts.where("id > 0").select("capture_id", "a", "b", F.lit(SAME_ID).alias("score"), F.lit(True).alias("same_id"))
    pairs = sides(counts.where("id = 0"), sessions, ["start_ts", "end_ts", "protocols", "technologies", "imsi"])
    near = gap_seconds(F.col("a_start_ts"), F.col("a_end_ts"), F.col("b_start_ts"), F.col("b_end_ts")) <= max(2.0, 2 * window)
    conflict = F.coalesce(F.col("a_imsi") != F.col("b_imsi"), F.lit(False))
    points = lambda kind: F.when(near & (F.col(kind) > 0), POINTS[kind]).otherwise(0)
    plain = ~(F.size(F.array_except("a_protocols", F.array(*map(F.lit, TRANSPORT)))) + F.size(F.array_except("b_protocols", F.array(*map(F.lit, TRANSPORT)))) == 0)
    place = F.when(near & (F.col("pair") > 0), 80).when(near & (F.col("ip") >= 2), 72).when(near & (F.col("ip") > 0) & plain, 60).otherwise(0)
    total = F.coalesce("state", F.lit(0)) + points("subscriber_ip") + points("tunnel") + points("access") + points("subscriber_id") + F.when(F.col("stream") > 0, SAME_STREAM).otherwise(0) + place
    total = total + F.when(near & F.arrays_overlap("a_technologies", "b_technologies"), 15).otherwise(0)
    other = pairs.select("capture_id", "a", "b", F.when(conflict, 0).otherwise(total).alias("score"), F.lit(False).alias("same_id"))
    return same.unionByName(other.where("score > 0"))


def attach_orphans(sessions: DataFrame, tokens: DataFrame, window: float = 5.0, hot: int = 200) -> DataFrame:
    """(capture_id, session_id, host, score): transport-only sessions and the session that they belong to."""
    only_transport = (F.size("protocols") > 0) & (F.size(F.array_except("protocols", F.array(*map(F.lit, TRANSPORT)))) == 0)
    reach = max(3.0, 3 * window)
    counts = blocked_pairs(sessions, tokens.where("kind in ('stream', 'pair', 'ip')"), reach, hot)
    both = sides(counts, sessions.withColumn("orphan", only_transport), ["orphan", "start_ts", "end_ts", "technologies"]).where("a_orphan != b_orphan")
    near = gap_seconds(F.col("a_start_ts"), F.col("a_end_ts"), F.col("b_start_ts"), F.col("b_end_ts")) <= reach
    score = F.when(F.col("stream") > 0, 90).otherwise(0) + F.when(F.col("pair") > 0, 70).when(F.col("ip") >= 2, 60).when(F.col("ip") > 0, 40).otherwise(0) + F.when(F.arrays_overlap("a_technologies", "b_technologies"), 10).otherwise(0)
    rows = both.where(near).select("capture_id", F.when(F.col("a_orphan"), F.col("a")).otherwise(F.col("b")).alias("session_id"), F.when(F.col("a_orphan"), F.col("b")).otherwise(F.col("a")).alias("host"), score.alias("score"))
    best = Window.partitionBy("capture_id", "session_id").orderBy(F.desc("score"), "host")
    return rows.where(F.col("score") >= ATTACH_AT).withColumn("_row", F.row_number().over(best)).where("_row = 1").drop("_row")


def merge_clusters(pairs: DataFrame, sessions: DataFrame, threshold: int = MERGE_AT) -> DataFrame:
    """(capture_id, session_id, cluster): sessions joined by pairs that reach the threshold, named by the smallest id.

    Each session points to its best partner of a smaller id (highest score, then smallest id); pointers are then followed by
    doubling, so chains of any length are done in a logarithmic number of rounds. Each session's best partner is written once (checkpoint) before that."""
    best = pairs.where(F.col("score") >= threshold).groupBy("capture_id", F.col("b").alias("session_id")).agg(F.min_by("a", F.struct((-F.col("score")).alias("score"), "a")).alias("cluster"))
    followed = _roots(saved(best))
    return sessions.select("capture_id", "session_id").join(followed, ["capture_id", "session_id"], "left").select("capture_id", "session_id", F.coalesce("cluster", "session_id").alias("cluster"))


def _roots(moving: DataFrame) -> DataFrame:
    """Pointers of sessions to others, followed to the end by doubling: each round every session takes the pointer of the one that it points to."""
    while True:
        jump = moving.select("capture_id", F.col("session_id").alias("cluster"), F.col("cluster").alias("next"))
        moved = saved(moving.join(jump, ["capture_id", "cluster"], "left").select("capture_id", "session_id", F.coalesce("next", "cluster").alias("cluster"), F.col("next").isNotNull().alias("changed")))
        moving = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return moving


def _followed(labels: DataFrame) -> DataFrame:
    """Labels after all pointers are followed."""
    roots = _roots(labels.where("cluster != session_id")).withColumnRenamed("cluster", "root")
    return saved(labels.join(roots, ["capture_id", "session_id"], "left").select("capture_id", "session_id", F.coalesce("root", "cluster").alias("cluster")))


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the folder that spark.checkpoint.dir names and read again: lineage ends here, rows outlive lost executors, and later plans know their size.

    On one machine without such a setting a temporary folder is taken."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="sigweave-")
        context.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy_merge(pairs: DataFrame, sessions: DataFrame, threshold: int = MERGE_AT) -> DataFrame:
    """The fold of ``merge_clusters``, per capture: each session in order of its id goes to the best host before it. For captures of a bounded size, and to hold ``merge_clusters`` against."""
    import pandas as pd

    rows = sessions.select("capture_id", "session_id", "start_ts").join(pairs.where(F.col("score") >= threshold).groupBy("capture_id", F.col("b").alias("session_id")).agg(F.collect_list(F.struct("score", "a")).alias("hosts")), ["capture_id", "session_id"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        of: dict[str, str] = {}
        for r in pdf.sort_values(["session_id"]).itertuples():
            hosts = [] if r.hosts is None else sorted(((-h["score"], h["a"]) for h in r.hosts))
            of[r.session_id] = next((of[a] for _, a in hosts if a in of), r.session_id)
        return pd.DataFrame({"capture_id": pdf["capture_id"], "session_id": pdf["session_id"], "cluster": pdf["session_id"].map(of)})

    return rows.groupBy("capture_id").applyInPandas(fold, "capture_id string, session_id string, cluster string")
