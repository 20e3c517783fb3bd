"""Merging of sessions: each one, in order of start, goes to the best cluster of earlier ones.

What a session scores with a cluster depends on all that the cluster has taken in before it (identities, addresses, time span, dialog), so the
rule is a fold over the sessions of a capture. It is done in rounds of joins in place of a loop: given an assignment of all sessions, every
session decides anew among the clusters that earlier sessions make up; the decisions are the next assignment. The first
session is always right, and a round in which the first k are right makes the next one right, so an assignment that
no decision changes is the fold's. A first guess, by chains along shared tokens, leaves few rounds to do.

Only clusters that share a token with a session within reach are looked at. A token that many sessions share costs as many rows as there
are sessions and clusters with it in a time bucket, not as there are pairs of its sharers: what shares a token in a bucket and may
merge is one cluster already. A session refused by its best cluster (another dialog, another subscriber, a restart) goes to the next best one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import fields, predicates
from sigweave.operators.pairs import ACCESS_CONTINUATION, MERGE_AT, POINTS, SAME_ID, SAME_STREAM, TEID_CONTINUATION, TRANSPORT, _followed, continuations, gap_seconds, saved

KEY = ["capture_id", "session_id"]
#: Kinds of tokens that count at any distance; the others within the window only.
TIMELESS = ("id", "stream")
#: Groups of sessions that can merge with each other are folded one session after the other if they have so many at most, else in rounds of joins.
SMALL = 500


def _place() -> Column:
    """The order of the fold."""
    return F.struct(F.coalesce("start_ts", F.lit(0.0)).alias("ts"), F.col("session_id").alias("id"))


def _buckets(start: Column, end: Column, reach: float) -> Column:
    """Buckets of time, of which two spans have one in common if at most ``reach`` lies between them; -1 without a time."""
    bucket = lambda x: F.floor(x / reach).cast("long")
    return F.coalesce(F.sequence(bucket(start - reach), bucket(end)), F.array(F.lit(-1).cast("long")))


def first_guess(sessions: DataFrame, tokens: DataFrame, reach: float) -> DataFrame:
    """(capture_id, session_id, cluster): each session with the session before it that has the same token and is near, by the token that counts most."""
    worth = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in {"id": SAME_ID, "stream": SAME_STREAM, **POINTS}.items()])
    strong = tokens.withColumn("worth", worth).where("worth is not null").join(sessions.select(*KEY, "start_ts", "end_ts", _place().alias("place")), KEY)
    before = Window.partitionBy("capture_id", "kind", "token").orderBy("place")
    linked = strong.withColumn("up", F.lag("session_id").over(before)).withColumn("up_end", F.lag("end_ts").over(before))
    linked = linked.where("up is not null").where(F.col("kind").isin(*TIMELESS) | F.coalesce(F.col("start_ts") - F.col("up_end") <= reach, F.lit(False)))
    best = linked.groupBy(*KEY).agg(F.max_by("up", F.struct("worth", "up")).alias("up"))
    return _followed(saved(sessions.select(*KEY).join(best, KEY, "left").select(*KEY, F.coalesce("up", "session_id").alias("cluster"))))


def met_clusters(here: DataFrame, has: DataFrame, clusters: DataFrame, reach: float) -> DataFrame:
    """(capture_id, session_id, cluster): sessions and the clusters that had one of their tokens before them, at most ``reach`` away unless the token counts at any distance.

    here: the tokens of sessions with place, start_ts, end_ts; has: those of clusters with since; clusters: from, to."""
    timed = ~F.col("kind").isin(*TIMELESS)
    bucket = lambda start, end: F.explode(F.when(timed, _buckets(F.col(start), F.col(end), reach)).otherwise(F.array(F.lit(-2).cast("long")))).alias("bucket")
    asks = here.select(*KEY, "kind", "token", "place", bucket("start_ts", "end_ts"))
    there = has.where("kind != 'technology'").join(clusters.select("capture_id", "cluster", "from", "to"), ["capture_id", "cluster"]).select("capture_id", "cluster", "kind", "token", "since", bucket("from", "to"))
    return asks.join(there, ["capture_id", "kind", "token", "bucket"]).where("since < place").select(*KEY, "cluster")


def _decide(sessions: DataFrame, tokens: DataFrame, links: DataFrame, labels: DataFrame, window: float) -> DataFrame:
    """(capture_id, session_id, cluster): the best of the clusters that labels make up of earlier sessions, or the session's own name."""
    near_at, reach = max(2.0, 2 * window), max(3.0, 2 * window)
    of = sessions.join(labels, KEY).withColumn("place", _place())
    held = tokens.join(of.select(*KEY, "cluster", "place"), KEY)
    # what a cluster has, and since when
    has = saved(held.groupBy("capture_id", "cluster", "kind", "token").agg(F.min("place").alias("since")))
    since = lambda when: F.min(F.when(when, F.col("place")))
    spoken = F.size(F.array_except("protocols", F.array(*map(F.lit, TRANSPORT)))) > 0
    clusters = of.groupBy("capture_id", "cluster").agg(F.min("place").alias("root"), F.min("start_ts").alias("from"), F.max("end_ts").alias("to"), F.min_by(F.struct("place", "dialog_key"), F.when(F.col("dialog_key").isNotNull(), F.col("place"))).alias("dialog"), since(spoken).alias("spoken"))
    technologies = of.select("capture_id", "cluster", "place", F.explode("technologies").alias("technology")).groupBy("capture_id", "cluster", "technology").agg(F.min("place").alias("since"))
    technologies = technologies.groupBy("capture_id", "cluster").agg(F.collect_list(F.struct("technology", "since")).alias("known"))
    imsi = fields.is_imsi(F.col("token")) & (F.col("kind") == "subscriber_id")
    known = has.groupBy("capture_id", "cluster").agg(F.min(F.when(imsi, F.col("since"))).alias("imsi_since"), F.min(F.when(F.col("kind") == "subscriber_ip", F.col("since"))).alias("ip_since"))
    clusters = saved(clusters.join(technologies, ["capture_id", "cluster"], "left").join(known, ["capture_id", "cluster"], "left"))

    here = tokens.where("kind != 'technology'").join(of.select(*KEY, "place", "start_ts", "end_ts"), KEY)
    both = links.select("capture_id", F.col("a").alias("session_id"), F.col("b").alias("other"), "method").unionByName(links.select("capture_id", F.col("b").alias("session_id"), F.col("a").alias("other"), "method"))
    linked = both.join(of.select("capture_id", F.col("session_id").alias("other"), "cluster"), ["capture_id", "other"])
    pairs = saved(met_clusters(here, has, clusters, reach).unionByName(linked.select(*KEY, "cluster")).distinct())

    # how many tokens of each kind they share
    shared = pairs.join(here.select(*KEY, "kind", "token", "place"), KEY).join(has, ["capture_id", "cluster", "kind", "token"]).where("since < place")
    kinds = ["id", "stream", *POINTS, "pair", "ip"]
    counts = shared.groupBy(*KEY, "cluster").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count_if(imsi).alias("n_imsi"))

    # a cluster as it stood before the session: its end, its least name, its last message
    mine = of.select("capture_id", "cluster", "place", F.lit(1).alias("role"), "end_ts", F.col("session_id").alias("name"), F.when(F.col("last_message").isNotNull(), F.struct("end_ts", "session_id", "last_message")).alias("said"), F.lit(None).cast("string").alias("session_id"))
    asked = pairs.join(of.select(*KEY, "place"), KEY).select("capture_id", "cluster", "place", F.lit(0).alias("role"), F.lit(None).cast("double").alias("end_ts"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(mine.schema["said"].dataType).alias("said"), "session_id")
    so_far = Window.partitionBy("capture_id", "cluster").orderBy("place", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stood = mine.unionByName(asked).select("*", F.max("end_ts").over(so_far).alias("c_end"), F.min("name").over(so_far).alias("c_name"), F.max("said").over(so_far).alias("c_said")).where("role = 0")

    own = tokens.groupBy(*KEY).agg(F.bool_or(imsi).alias("any_imsi"), F.bool_or(F.col("kind") == "subscriber_ip").alias("any_ip"))
    rows = stood.select(*KEY, "cluster", "place", "c_end", "c_name", "c_said").join(counts, [*KEY, "cluster"], "left").na.fill(0, [f"n_{k}" for k in (*kinds, "imsi")]).join(clusters, ["capture_id", "cluster"]).where("root < place")
    rows = rows.join(sessions.select(*KEY, "start_ts", "end_ts", "technologies", "dialog_key", "first_message", spoken.alias("speaks")), KEY).join(own, KEY, "left").na.fill(False, ["any_imsi", "any_ip"])
    state = both.groupBy(*KEY, F.col("other").alias("c_name")).agg(F.max(F.when(F.col("method") == "teid_continuation", TEID_CONTINUATION).otherwise(ACCESS_CONTINUATION)).alias("state"))
    rows = rows.join(state, [*KEY, "c_name"], "left")

    before = lambda c: F.coalesce(F.col(c) < F.col("place"), F.lit(False))
    gap = gap_seconds(F.col("from"), F.col("c_end"), F.col("start_ts"), F.col("end_ts"))
    near = gap <= near_at
    stem = lambda s: F.substring_index(s, ":seg", 1)
    segments = (stem("c_name") == stem("session_id")) & (F.contains("c_name", F.lit(":seg")) | F.contains("session_id", F.lit(":seg")))
    restarted = F.coalesce(predicates.completion_marker(F.col("c_said.last_message")) & predicates.start_marker(F.col("first_message")), F.lit(False))
    other_dialog = before("dialog.place") & F.coalesce(F.col("dialog.dialog_key") != F.col("dialog_key"), F.lit(False))
    foreign = (before("imsi_since") & F.col("any_imsi") & (F.col("n_imsi") == 0)) | (before("ip_since") & F.col("any_ip") & (F.col("n_subscriber_ip") == 0) & (F.col("n_subscriber_id") == 0))
    same_technology = F.exists(F.coalesce("known", F.array().cast("array<struct<technology:string,since:struct<ts:double,id:string>>>")), lambda x: (x["since"] < F.col("place")) & F.array_contains("technologies", x["technology"]))
    points = lambda kind, n: F.when(near & (F.col(f"n_{kind}") > 0), n).otherwise(0)
    address = F.when(near & (F.col("n_pair") > 0), 80).when(near & (F.col("n_ip") >= 2), 72).when(near & (F.col("n_ip") > 0) & (F.col("speaks") | before("spoken")), 60).otherwise(0)
    total = F.coalesce("state", F.lit(0)) + reduce(lambda x, y: x + y, [points(k, v) for k, v in POINTS.items()]) + F.when(F.col("n_stream") > 0, SAME_STREAM).otherwise(0) + address + F.when(near & same_technology, 15).otherwise(0)
    score = F.when(other_dialog | (segments & (restarted | (gap > reach))), 0).when(F.col("n_id") > 0, SAME_ID).when(foreign, 0).otherwise(total)
    best = rows.withColumn("score", score).where(F.col("score") >= MERGE_AT).groupBy(*KEY).agg(F.min_by("cluster", F.struct((-F.col("score")).alias("score"), "root")).alias("best"))
    return sessions.select(*KEY).join(best, KEY, "left").select(*KEY, F.coalesce("best", "session_id").alias("cluster"))


def fold_pass(sessions: DataFrame, tokens: DataFrame, window: float = 5.0) -> DataFrame:
    """(capture_id, session_id, cluster): one pass of the fold; a cluster has the name of its first session."""
    tokens = saved(tokens.join(sessions.select(*KEY), KEY, "left_semi"))
    links = saved(continuations(sessions, tokens, window))
    labels = first_guess(sessions, tokens, max(2.0, 2 * window))
    while True:
        decided = _followed(saved(_decide(sessions, tokens, links, labels, window)))
        changed = decided.join(labels.withColumnRenamed("cluster", "was"), KEY).where("cluster != was")
        if changed.isEmpty():
            return decided
        labels = decided


def _relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    return rows.join(moved, KEY).drop("session_id").withColumnRenamed("to", "session_id")


def _groups(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(capture_id, session_id, label, small): sessions that can be in one cluster have one label, if small.

    Without a common session identity, sessions of different IMSIs never merge, so identities, IMSIs and whatever sessions without an IMSI have hold groups together. The
    smallest name runs along these three times; labels that a token still has several of are not closed, and like those of more than SMALL sessions not small."""
    imsi = (F.col("kind") == "subscriber_id") & fields.is_imsi(F.col("token"))
    named = tokens.where("kind != 'technology'").join(rows.select(*KEY), KEY, "left_semi")
    known = named.where(imsi).select(*KEY).distinct()
    loose = named.join(known, KEY, "left_anti").select("capture_id", "kind", "token").distinct()
    of = ["capture_id", "kind", "token"]
    keys = saved(named.where(imsi | (F.col("kind") == "id")).unionByName(named.join(loose, of, "left_semi")).select(*KEY, "kind", "token").distinct())
    labels = rows.select(*KEY, F.col("session_id").alias("label"))
    for _ in range(3):
        least = keys.join(labels, KEY).groupBy(*of).agg(F.min("label").alias("least"))
        heard = keys.join(least, of).groupBy(*KEY).agg(F.min("least").alias("least"))
        labels = saved(labels.join(heard, KEY, "left").select(*KEY, F.least("label", F.coalesce("least", "label")).alias("label")))
    several = keys.join(labels, KEY).groupBy(*of).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select(*of)
    open_ = keys.join(several, of, "left_semi").join(labels, KEY).select("capture_id", "label").distinct().withColumn("open", F.lit(True))
    sizes = labels.groupBy("capture_id", "label").agg(F.count("*").alias("n")).join(open_, ["capture_id", "label"], "left")
    return saved(labels.join(sizes.select("capture_id", "label", (F.col("open").isNull() & (F.col("n") <= SMALL)).alias("small")), ["capture_id", "label"]))


class _Cluster:
    """What the fold knows of a session or a cluster."""

    __slots__ = ("dialog", "end", "first", "kinds", "mobile", "members", "name", "place", "said", "spoken", "start", "technologies")

    def __init__(self, row, kinds):
        self.name, self.members, self.start, self.end, self.kinds = row.session_id, [row.session_id], _some(row.start_ts), _some(row.end_ts), kinds
        self.place, self.dialog, self.mobile, self.spoken = (self.start or 0.0, self.name), row.dialog_key, row.mobility, row.speaks
        self.technologies = set(row.technologies if row.technologies is not None else ())
        self.first = None if row.starts is None else (_first(self.start), self.name, row.starts)
        self.said = None if row.ends is None else (_first(self.end), self.name, row.ends)


def _some(x):
    return None if x is None or x != x else float(x)


def _first(x):
    """Orders a missing number before all others."""
    return (0, 0.0) if x is None else (1, x)


def _gap(a, b):
    if None in (a.start, a.end, b.start, b.end):
        return float("inf")
    return max(a.start - b.end, b.start - a.end, 0.0)


def _links(all_, window):
    """``continuations`` between the members of a small group: the points by names."""
    reach, out = max(15.0, 30.0, 6 * window), {}
    by_imsi, by_access = {}, {}
    for c in sorted((c for c in all_ if None not in (c.start, c.end)), key=lambda c: (c.start, c.name)):
        for x in c.kinds["imsi"] if c.kinds["tunnel"] else ():
            by_imsi.setdefault(x, []).append(c)
        for x in c.kinds["access"]:
            by_access.setdefault(x, []).append(c)
    for group in by_imsi.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if b.start - a.end > reach:
                    break
                if not a.kinds["tunnel"] & b.kinds["tunnel"] and _gap(a, b) <= reach and (a.mobile or b.mobile or a.kinds["subscriber_ip"] & b.kinds["subscriber_ip"] or a.kinds["access"] & b.kinds["access"]):
                    out[frozenset((a.name, b.name))] = TEID_CONTINUATION
                    break
    for group in by_access.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if b.start - a.end > reach:
                    break
                held = a.kinds["tunnel"] or b.kinds["tunnel"] or a.kinds["subscriber_id"] & b.kinds["subscriber_id"] or a.kinds["subscriber_ip"] & b.kinds["subscriber_ip"]
                if held and not a.kinds["id"] & b.kinds["id"] and _gap(a, b) <= reach:
                    out.setdefault(frozenset((a.name, b.name)), ACCESS_CONTINUATION)
    return out


def _score(c, s, links, window):
    gap, near_at, reach = _gap(c, s), max(2.0, 2 * window), max(3.0, 2 * window)
    near = gap <= near_at
    if c.dialog is not None and s.dialog is not None and c.dialog != s.dialog:
        return 0
    if (":seg" in c.name or ":seg" in s.name) and c.name.split(":seg")[0] == s.name.split(":seg")[0]:
        if gap > reach or (c.said is not None and s.first is not None and c.said[2] and s.first[2]):
            return 0
    n = {k: len(c.kinds[k] & s.kinds[k]) for k in c.kinds}
    if n["id"]:
        return SAME_ID
    if c.kinds["imsi"] and s.kinds["imsi"] and not n["imsi"]:
        return 0
    if c.kinds["subscriber_ip"] and s.kinds["subscriber_ip"] and not n["subscriber_ip"] and not n["subscriber_id"]:
        return 0
    total = links.get(frozenset((c.name, s.name)), 0) + (SAME_STREAM if n["stream"] else 0)
    if near:
        total += sum(v for k, v in POINTS.items() if n[k])
        total += 80 if n["pair"] else 72 if n["ip"] >= 2 else 60 if n["ip"] and (c.spoken or s.spoken) else 0
        total += 15 if c.technologies & s.technologies else 0
    return total


def _take(c, s):
    """The cluster with a later session of the pass."""
    c.members, c.name = c.members + s.members, min(c.name, s.name)
    c.dialog = s.dialog if c.dialog is None else c.dialog
    c.start = min((x for x in (c.start, s.start) if x is not None), default=None)
    c.end = max((x for x in (c.end, s.end) if x is not None), default=None)
    c.kinds = {k: v | s.kinds[k] for k, v in c.kinds.items()}
    c.technologies, c.mobile, c.spoken = c.technologies | s.technologies, c.mobile or s.mobile, c.spoken or s.spoken
    c.first = min((x for x in (c.first, s.first) if x is not None), default=None)
    c.said = max((x for x in (c.said, s.said) if x is not None), default=None)


def _folded(waiting, window, passes):
    for _ in range(passes):
        links, done = _links(waiting, window), []
        before = len(waiting)
        for s in sorted(waiting, key=lambda c: c.place):
            best, at = 0, None
            for c in done:
                points = _score(c, s, links, window)
                if points >= MERGE_AT and points > best:
                    best, at = points, c
            if at is None:
                done.append(s)
            else:
                _take(at, s)
        waiting = done
        for c in done:
            c.place = (c.start or 0.0, c.name)
            # of what was said first and last, the next pass knows it under the cluster's name
            c.first = None if c.first is None else (_first(c.start), c.name, c.first[2])
            c.said = None if c.said is None else (_first(c.end), c.name, c.said[2])
        if len(done) == before:
            break
    return waiting


def _merge_small(rows: DataFrame, tokens: DataFrame, groups: DataFrame, window: float, passes: int) -> DataFrame:
    """``merge_sessions`` of small groups, each as the fold itself in one task."""
    small = groups.where("small").select(*KEY, "label")
    kinds = ["id", "stream", *POINTS, "pair", "ip"]
    imsi = (F.col("kind") == "subscriber_id") & fields.is_imsi(F.col("token"))
    held = tokens.where(F.col("kind").isin(kinds)).withColumn("kind", F.when(imsi, "imsi").otherwise(F.col("kind"))).groupBy(*KEY).agg(F.collect_set(F.concat_ws("\t", "kind", "token")).alias("held"))
    spoken = F.size(F.array_except("protocols", F.array(*map(F.lit, TRANSPORT)))) > 0
    facts = rows.select(*KEY, "start_ts", "end_ts", "technologies", "dialog_key", "mobility", spoken.alias("speaks"), F.when(F.col("first_message").isNotNull(), F.coalesce(predicates.start_marker(F.col("first_message")), F.lit(False))).alias("starts"), F.when(F.col("last_message").isNotNull(), F.coalesce(predicates.completion_marker(F.col("last_message")), F.lit(False))).alias("ends"))
    facts = facts.join(small, KEY).join(held, KEY, "left")

    def fold(pdf):
        import pandas as pd

        waiting = []
        for r in pdf.astype(object).where(pdf.notna(), None).itertuples():
            own = {k: set() for k in (*kinds, "imsi")}
            for x in r.held if r.held is not None else ():
                kind, token = x.split("\t", 1)
                own[kind].add(token)
                if kind == "imsi":
                    own["subscriber_id"].add(token)
            waiting.append(_Cluster(r, own))
        out = [(m, c.name) for c in _folded(waiting, window, passes) for m in c.members]
        return pd.DataFrame({"capture_id": [pdf["capture_id"].iloc[0]] * len(out), "session_id": [m for m, _ in out], "cluster": [n for _, n in out]})

    return facts.groupBy("capture_id", "label").applyInPandas(fold, "capture_id string, session_id string, cluster string")


def _merge_in_rounds(rows: DataFrame, tokens: DataFrame, window: float, passes: int) -> DataFrame:
    """``merge_sessions`` by rounds of joins, for groups of any size."""
    of = rows.select(*KEY, F.col("session_id").alias("cluster"))
    early = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("start_ts", "was"))).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    for _ in range(passes):
        labels = fold_pass(rows, tokens, window)
        names = labels.groupBy("capture_id", "cluster").agg(F.min("session_id").alias("to"))
        moved = saved(labels.join(names, ["capture_id", "cluster"]).select(*KEY, "to"))
        if moved.where("session_id != to").isEmpty():
            break
        of = saved(of.join(moved.withColumnRenamed("session_id", "cluster"), ["capture_id", "cluster"]).select(*KEY, F.col("to").alias("cluster")))
        merged = _relabelled(rows.withColumn("was", F.col("session_id")), moved).groupBy(*KEY)
        said = F.max_by("last_message", F.when(F.col("last_message").isNotNull(), F.struct("end_ts", "was"))).alias("last_message")
        # with several IMSIs none is the session's own
        own = F.when(F.min("imsi") == F.max("imsi"), F.min("imsi")).alias("imsi")
        rows = saved(merged.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.bool_or("mobility").alias("mobility"), union("protocols"), union("technologies"), own, early("first_message"), said, early("dialog_key")))
        tokens = saved(_relabelled(tokens, moved).distinct())
    return of


def merge_sessions(sessions: DataFrame, tokens: DataFrame, window: float = 5.0, passes: int = 3) -> DataFrame:
    """(capture_id, session_id, cluster): sessions merged in up to ``passes`` passes; merged ones are taken again with all their identities and their whole time span.

    A cluster has the smallest id of its members. sessions: records of ``sessions.refresh``, with dialog_key if there are forked dialogs. A session
    without a time stands first and is near nothing; repeated tokens count once; no sessions give no rows."""
    if "dialog_key" not in sessions.columns:
        sessions = sessions.withColumn("dialog_key", F.lit(None).cast("string"))
    mobility = F.coalesce("mobility", F.lit(False)) if "mobility" in sessions.columns else F.lit(False)
    rows = saved(sessions.select(*KEY, mobility.alias("mobility"), "start_ts", "end_ts", "protocols", "technologies", "imsi", "first_message", "last_message", "dialog_key"))
    tokens = saved(tokens.select(*KEY, "kind", "token").distinct())
    groups = _groups(rows, tokens)
    found = _merge_small(rows, tokens, groups, window, passes)
    large = groups.where("not small").select(*KEY)
    if large.isEmpty():
        return saved(found)
    return saved(found).unionByName(_merge_in_rounds(saved(rows.join(large, KEY, "left_semi")), saved(tokens.join(large, KEY, "left_semi")), window, passes))


def merged_messages(messages: DataFrame, of: DataFrame) -> DataFrame:
    """Messages under the names of their merged sessions; ``sessions.refresh`` of them gives the merged records."""
    return _relabelled(messages, of.withColumnRenamed("cluster", "to"))
