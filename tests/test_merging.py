"""Merging of sessions, a capture for each case; and random captures against the fold done one session after the other."""

import random

import pytest

from sigweave.operators import merging
from sigweave.operators.pairs import POINTS

SESSION = "capture_id string, session_id string, start_ts double, end_ts double, protocols array<string>, technologies array<string>, imsi string, first_message string, last_message string, dialog_key string"
TOKEN = "capture_id string, session_id string, kind string, token string"
IMSI, OTHER = "262010000000001", "262010000000002"
WINDOW = 5.0


def session(name, start, imsi=None, dialog=None, first="A", last="B", length=1.0, protocols=("SIP",), technologies=("IMS",)):
    return (name, start, None if start is None else start + length, list(protocols), list(technologies), imsi, first, last, dialog)


def same(kind, token, *names):
    return [(n, kind, token) for n in names]


IPS = [("a", "subscriber_id", IMSI), ("b", "subscriber_id", OTHER), *same("subscriber_ip", "1", "a", "b")]
CASES = {
    # forked dialogs stay apart, a neutral session goes to the first of them
    "forked": ([session("a", 1.0, dialog="x"), session("b", 2.0), session("d", 3.0, dialog="y")], same("subscriber_ip", "1", *"abd"), {"a": "a", "b": "a", "d": "d"}),
    # b comes first and knows no dialog; the others share b's addresses only
    "bridge": ([session("b", 1.0), session("a", 2.0, dialog="x"), session("d", 3.0, dialog="y")], [*same("subscriber_ip", "1", *"ba"), *same("tunnel", "t", *"bd")], {"a": "a", "b": "a", "d": "d"}),
    # refused by its best cluster, d goes to the second best in the same pass
    "second": ([session("a", 1.0, dialog="x"), session("c", 1.5), session("d", 2.0, dialog="y")], [*same("id", "i", *"ad"), *same("pair", "p", *"cd")], {"a": "a", "c": "c", "d": "c"}),
    "imsis": ([session("a", 1.0, IMSI), session("b", 2.0, OTHER)], IPS, {"a": "a", "b": "b"}),
    "imsis with an id": ([session("a", 1.0, IMSI), session("b", 2.0, OTHER)], [*IPS, *same("id", "i", *"ab")], {"a": "a", "b": "a"}),
    "restart": ([session("s", 1.0, last="Attach Complete"), session("s:seg2", 3.0, first="Attach Request")], same("id", "i", "s", "s:seg2"), {"s": "s", "s:seg2": "s:seg2"}),
    "segment": ([session("s", 1.0), session("s:seg2", 3.0)], same("id", "i", "s", "s:seg2"), {"s": "s", "s:seg2": "s"}),
    "late segment": ([session("s", 1.0), session("s:seg2", 30.0)], same("id", "i", "s", "s:seg2"), {"s": "s", "s:seg2": "s:seg2"}),
    # b brings a's cluster near to c, in time and by a's address
    "further": ([session("a", 1.0), session("b", 20.0, length=10.0), session("c", 35.0)], [*same("subscriber_ip", "1", *"ac"), *same("id", "i", *"ab")], {"a": "a", "b": "a", "c": "a"}),
    "addresses of two": ([session("a", 1.0), session("b", 2.0), session("c", 3.0)], [*same("id", "i", *"ab"), ("a", "ip", "1"), ("b", "ip", "2"), *same("ip", "1", "c"), *same("ip", "2", "c")], {"a": "a", "b": "a", "c": "a"}),
    "no time": ([session("a", None), session("b", 1.0)], [*same("id", "i", *"ab"), *same("ip", "1", *"ab")], {"a": "a", "b": "a"}),
    "nothing shared": ([session("a", 1.0), session("b", 1.0)], [], {"a": "a", "b": "b"}),
}


def random_capture(seed):
    rng = random.Random(seed)
    sessions, tokens = [], []
    imsis = [IMSI, OTHER, None, None]
    for i in range(rng.randint(4, 16)):
        imsi = rng.choice(imsis)
        name = f"s{rng.randint(1, 4)}:seg{i}" if rng.random() < 0.2 else f"n{i:02d}"
        sessions.append(session(name, round(rng.uniform(0, 60), 1), imsi, rng.choice([None, None, None, "x", "y"]), rng.choice(["A", "Attach Request"]), rng.choice(["B", "Attach Complete"]), rng.choice([0.5, 4.0, 12.0]), [rng.choice(["SIP", "GTP", "TCP"])], [rng.choice(["IMS", "LTE"])]))
        tokens += [(name, "subscriber_id", imsi)] * bool(imsi)
        for kind, n, chance in (("id", 4, 0.3), ("subscriber_ip", 3, 0.3), ("tunnel", 3, 0.2), ("access", 2, 0.2), ("stream", 3, 0.1), ("pair", 3, 0.4), ("ip", 3, 0.6), ("ip", 3, 0.4)):
            if rng.random() < chance:
                tokens.append((name, kind, f"{kind}{rng.randint(1, n)}"))
    return sessions, tokens


# ---- the fold, one session after the other


class Cluster:
    def __init__(self, row, tokens):
        name, self.start, self.end, protocols, technologies, imsi, first, last, self.dialog = row
        self.members, self.name, self.root = {name}, name, name
        self.tokens, self.protocols, self.technologies = set(tokens), set(protocols), set(technologies)
        self.first, self.imsi = (self.start, name, first), {imsi} - {None}
        self.last = (self.end, name, last)

    def kind(self, *kinds):
        return {t for t in self.tokens if t[0] in kinds}

    def take(self, other):
        self.members |= other.members
        self.name = min(self.name, other.name)
        self.dialog = self.dialog or other.dialog
        self.start, self.end = min(self.start, other.start), max(self.end, other.end)
        self.tokens |= other.tokens
        self.protocols |= other.protocols
        self.technologies |= other.technologies
        self.imsi |= other.imsi
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)


def gap(a, b):
    return max(a.start - b.end, b.start - a.end, 0)


def links_of(all_):
    """Continuations between the clusters of a pass, by their names."""
    out = {}
    reach = 30.0
    order = sorted(all_, key=lambda c: (c.start, c.name))
    for i, a in enumerate(order):
        for imsi in (IMSI, OTHER):
            for b in order[i + 1 :]:
                ta, tb = a.kind("tunnel"), b.kind("tunnel")
                if ("subscriber_id", imsi) in a.tokens & b.tokens and ta and tb and not ta & tb and gap(a, b) <= reach and (a.kind("subscriber_ip") & b.kind("subscriber_ip") or a.kind("access") & b.kind("access")):
                    out[frozenset((a.name, b.name))] = 102
                    break
    for a in all_:
        for b in all_:
            support = any(a.kind(k) & b.kind(k) for k in ("subscriber_id", "subscriber_ip")) or a.kind("tunnel") or b.kind("tunnel")
            if a.name < b.name and a.kind("access") & b.kind("access") and not a.kind("id") & b.kind("id") and support and gap(a, b) <= reach:
                out.setdefault(frozenset((a.name, b.name)), 92)
    return out


def score(c, s, links):
    near = gap(c, s) <= 2 * WINDOW
    if c.dialog and s.dialog and c.dialog != s.dialog:
        return 0
    if c.name.split(":seg")[0] == s.name.split(":seg")[0] and (":seg" in c.name or ":seg" in s.name):
        if (c.last[2] == "Attach Complete" and s.first[2] == "Attach Request") or gap(c, s) > max(3, 2 * WINDOW):
            return 0
    both = c.tokens & s.tokens
    n = lambda k: sum(t[0] == k for t in both)
    if n("id"):
        return 120
    imsis = lambda x: {t for t in x.kind("subscriber_id") if len(t[1]) == 15}
    if imsis(c) and imsis(s) and not imsis(c) & imsis(s):
        return 0
    if c.kind("subscriber_ip") and s.kind("subscriber_ip") and not n("subscriber_ip") and not n("subscriber_id"):
        return 0
    total = links.get(frozenset((c.name, s.name)), 0) + 85 * (n("stream") > 0)
    if near:
        total += sum(v for k, v in POINTS.items() if n(k))
        total += 80 if n("pair") else 72 if n("ip") >= 2 else 60 if n("ip") and (c.protocols | s.protocols) - {"TCP", "UDP", "SCTP"} else 0
        total += 15 * bool(c.technologies & s.technologies)
    return total


def plain_fold(sessions, tokens, passes=3):
    waiting = [Cluster(r, [t[1:] for t in tokens if t[0] == r[0]]) for r in sessions]
    for _ in range(passes):
        links, done = links_of(waiting), []
        for s in sorted(waiting, key=lambda c: (c.start, c.name)):
            best = max(((score(c, s, links), -i) for i, c in enumerate(done)), default=(0, 0))
            if best[0] >= 70:
                done[-best[1]].take(s)
            else:
                done.append(s)
        if len(done) == len(waiting):
            break
        waiting = done
    return {m: c.name for c in waiting for m in c.members}


RANDOM = {f"random {i}": random_capture(i) for i in range(60)}


@pytest.fixture(scope="module")
def merged(spark):
    captures = {k: v[:2] for k, v in CASES.items()} | RANDOM
    rows = spark.createDataFrame([(k, *s) for k, (sessions, _) in captures.items() for s in sessions], SESSION)
    tokens = spark.createDataFrame([(k, *t) for k, (_, own) in captures.items() for t in own], TOKEN)
    out = {}
    for r in merging.merge_sessions(rows, tokens, WINDOW).collect():
        out.setdefault(r["capture_id"], {})[r["session_id"]] = r["cluster"]
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(merged, name):
    assert merged[name] == CASES[name][2]


def test_random_captures_equal_the_fold(merged):
    wrong = {k: (merged[k], plain_fold(*v)) for k, v in RANDOM.items() if merged[k] != plain_fold(*v)}
    assert not wrong
    refused = sum(len(set(x.values())) < len(x) for x in (merged[k] for k in RANDOM))
    assert refused > 30  # most captures merge something


def test_no_sessions(spark):
    assert merging.merge_sessions(spark.createDataFrame([], SESSION), spark.createDataFrame([], TOKEN)).collect() == []


def test_one_address_of_5000_sessions(spark):
    """What sessions are held against grows with the sharers of a token, not with their pairs: those near each other are one cluster, those far apart are in other buckets."""
    from pyspark.sql import functions as F

    n = 5000
    rows = spark.range(n).select(F.lit("c").alias("capture_id"), F.format_string("n%05d", "id").alias("session_id"), F.col("id").cast("double").alias("start_ts"), (F.col("id") + 0.5).alias("end_ts"), F.array(F.lit("SIP")).alias("protocols"), F.array(F.lit("IMS")).alias("technologies"),
                                 F.lit(None).cast("string").alias("imsi"), F.lit("A").alias("first_message"), F.lit("B").alias("last_message"))
    # two runs of sessions a second apart, with an hour between them
    rows = rows.withColumns({c: F.col(c) + F.when(F.col("session_id") >= "n02500", 3600.0).otherwise(0.0) for c in ("start_ts", "end_ts")})
    tokens = rows.select("capture_id", "session_id", F.lit("subscriber_ip").alias("kind"), F.lit("10.0.0.1").alias("token"))
    met = []
    plain = merging.met_clusters
    try:
        merging.met_clusters = lambda *a: met.append(plain(*a)) or met[-1]
        of = merging.merge_sessions(rows, tokens, WINDOW)
    finally:
        merging.met_clusters = plain
    assert {(r["cluster"], r["count"]) for r in of.groupBy("cluster").count().collect()} == {("n00000", 2500), ("n02500", 2500)}
    assert max(x.count() for x in met) <= 3 * n
