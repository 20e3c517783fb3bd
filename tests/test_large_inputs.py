"""Cases in which queries differed from their SQL, or grew faster than their result."""

import random

import duckdb
from pyspark.sql import functions as F

from sigweave.functions import fields
from sigweave.operators import learning, merging, normalize, pairs, seeds, strategies


def test_page_labels_round_and_lower_as_sql(spark, tmp_path):
    """Sizes midway between two tenths, and a letter that Java lowers to two."""
    from sigweave import catalog

    sizes = [0, 1023, 1024, 1280, 1382, 2304, 3328, 6400, 1048575, 1048576, 1310720, 1835008]
    urls = ["https://a.com/x", "http://Ex\u0130ample.com/\u00c0/\u0130x", None, "ftp://-"]
    rows = spark.createDataFrame([(i, urls[i % 4], "x" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["p46_page_identities"](spark, str(tmp_path)).select("page_id", "host", "slug", "chars", "size").collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(f"select page_id, host, slug, chars, size from ({catalog.oracle_sql()['p46_page_identities']})").fetchall())
    assert spark.range(1).select(fields.size_label(F.lit(3328))).first()[0] == "3.2 KB"


def _sessions(n, imsis, seed=1):
    rng = random.Random(seed)
    rows, tokens = [], []
    for i in range(n):
        start = None if rng.random() < 0.05 else round(rng.uniform(0, 300), 1)
        rows.append(("c", f"s{i:02d}", start, None if start is None else start + rng.choice([0.0, 5.0, 70.0]), [rng.choice(["GTP", "TCP"])], [rng.choice(["LTE", "5G"])], rng.choice(imsis)))
        tokens += {("c", f"s{i:02d}", k, f"{k}{rng.randint(1, m)}") for k, m, p in (("id", 9, 0.3), ("stream", 9, 0.2), ("ip", 2, 0.9), ("ip", 2, 0.9), ("pair", 4, 0.4), ("tunnel", 5, 0.3), ("access", 5, 0.2), ("subscriber_ip", 6, 0.4), ("technology", 2, 1.0)) if rng.random() < p}
    return rows, sorted(tokens)


def _scores(rows, tokens, near):
    """All pairs, one by one."""
    has = {r[1]: {t[2:] for t in tokens if t[1] == r[1]} for r in rows}
    out = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            n = {k: sum(t[0] == k for t in has[x[1]] & has[y[1]]) for k in pairs.KINDS}
            close = None not in (x[2], y[2]) and max(x[2] - y[3], y[2] - x[3], 0) <= near
            place = 80 if n["pair"] else 72 if n["ip"] >= 2 else 60 if n["ip"] and (x[4] != ["TCP"] or y[4] != ["TCP"]) else 0
            score = 85 * (n["stream"] > 0) + close * (sum(v * (n[k] > 0) for k, v in pairs.POINTS.items()) + place + 15 * (x[5] == y[5]))
            if not any(n.values()) or (x[6] and y[6] and x[6] != y[6]):
                score = 0
            score = 120 if n["id"] else score
            if score:
                out[x[1], y[1]] = score
    return out


def _scored(spark, rows, tokens, hot):
    sessions = spark.createDataFrame(rows, "capture_id string, session_id string, start_ts double, end_ts double, protocols array<string>, technologies array<string>, imsi string")
    listed = spark.createDataFrame(tokens, "capture_id string, session_id string, kind string, token string")
    none = spark.sql("select '' as capture_id, '' as a, '' as b, '' as method where false")
    return pairs.score_pairs(sessions, listed, window=10.0, links=none, hot=hot)


def test_scores_of_all_pairs_with_and_without_imsi(spark):
    for imsis, hot in ((["1", "2", None], 3), (["1", "2", None], 1000), (["1", "2"], 3)):
        rows, tokens = _sessions(40, imsis)
        found = _scored(spark, rows, tokens, hot).collect()
        got = {(r["a"], r["b"]): r["score"] for r in found}
        assert len(found) == len(got) and got == _scores(rows, tokens, 20.0)


def test_sessions_of_many_subscribers_do_not_meet_over_an_address(spark):
    """400 subscribers at one time behind one address: no pair of them scores, and none is formed."""
    rows = [("c", f"s{i:03d}", 1.0, 2.0, ["GTP"], ["LTE"], f"{i}") for i in range(400)]
    assert _scored(spark, rows, [("c", r[1], "ip", "10.0.0.1") for r in rows], 5).count() == 0
    sessions = spark.createDataFrame(rows, "capture_id string, session_id string, start_ts double, end_ts double, protocols array<string>, technologies array<string>, imsi string")
    tokens = sessions.selectExpr("capture_id", "session_id", "'ip' as kind", "'10.0.0.1' as token")
    assert pairs.blocked_pairs(sessions, tokens, 20.0, apart="imsi").count() == 0


def test_conditions_of_normalization_stay_small(spark):
    """What the rows must have is not written out once for each place that names it."""
    from sigweave.queries.normalization import decoded

    rows = normalize.normalize(decoded(spark, "/root/testdata/sf0.001"))
    plan = seeds.deduplicate(rows.unionByName(rows)).groupBy("protocol").count()._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, plan.splitlines())) < 30_000 and "row_number" not in plan


def test_the_first_message_of_each_identity_is_whole(spark):
    rows = [("c", 1, 5.0, 2, "late", None), ("c", 1, 1.0, 3, None, "x"), ("c", 1, 1.0, 9, "same time", "y"), ("c", 2, None, 1, "no time", "z"), ("c", 2, 1.0, 1, "w", "w"), ("d", 1, 7.0, None, "other", None), (None, 1, 7.0, None, "none", None)]
    messages = spark.createDataFrame(rows, "capture_id string, message_uid long, ts double, frame_number long, message string, imsi string").repartition(3)
    got = {tuple(r) for r in seeds.deduplicate(messages.unionByName(messages)).collect()}
    assert got == {rows[1], rows[3], rows[5], rows[6]}
    assert seeds.deduplicate(messages.unionByName(messages)).columns == messages.columns


def test_endpoints_meet_by_time_and_each_row_once(spark, monkeypatch):
    """Against all pairs: sessions of few and of many addresses, rows of one identity, blanks, missing bounds."""
    rng = random.Random(3)
    ip = lambda: rng.choice([None, "", "1", "2", "3", "4", "5"])
    sessions = [("c", f"s{i}", t, None if t is None else t + rng.choice([0.0, 4.0, 60.0])) for i in range(30) for t in [rng.choice([None, *[rng.uniform(0, 200)] * 9])]]
    ips = sorted({("c", s[1], a) for s in sessions[:25] for a in (ip(), ip(), ip(), ip()) if a is not None})
    rows = [("c", rng.randint(1, 70), None if rng.random() < 0.05 else rng.uniform(0, 260), ip(), ip()) for _ in range(100)]
    frame = lambda x, ddl: spark.createDataFrame(x, ddl).repartition(2)
    s = frame(sessions, "capture_id string, session_id string, start_ts double, end_ts double")
    i = frame([(*x, 0) for x in ips], "capture_id string, session_id string, ip string, rank int")
    r = frame(rows, "capture_id string, message_uid long, ts double, src_ip string, dst_ip string")
    of = {x[1]: {a for _, n, a in ips if n == x[1]} for x in sessions}
    near = [(x, y) for x in sessions for y in rows if None not in (x[2], y[2]) and x[2] - 5 <= y[2] <= x[3] + 5]
    want = {(x[1], y[1]) for x, y in near if of[x[1]] & ({y[3], y[4]} - {None, ""})} | {(x[1], y[1]) for x, y in near if not of[x[1]]}
    for few in (64, 2):
        monkeypatch.setattr(strategies, "FEW", few)
        got = [(x["session_id"], x["message_uid"]) for x in strategies.endpoint_rows(s, i, r).collect()]
        shared = [x for x in got if of[x[0]]]
        assert set(got) == want and len(shared) == len(set(shared))


def test_time_fallback_and_access_points(spark):
    """Numbers of several lengths within access points; sessions that no strategy finds take each near row once; no number is compared with all access points."""
    s = spark.createDataFrame([("c", f"s{i}", 10.0 * i, 10.0 * i + 1, n) for i, n in enumerate(["4917", "0817", "x", None, "491"])], "capture_id string, session_id string, start_ts double, end_ts double, msisdn string")
    ips = spark.createDataFrame([], "capture_id string, session_id string, ip string, rank int")
    rows = [("c", 1, 11.0, "IMS.4917.net"), ("c", 2, 11.0, "ims.net.491"), ("c", 3, 21.0, "49"), ("c", 4, 33.0, None), ("c", 4, 31.0, "z"), ("c", 5, 3.0, "a4917491"), ("c", 6, 45.0, "491"), ("c", 7, None, "4917")]
    columns = ", ".join(f"cast(null as string) as {c}" for c in ("framed_ip", "src_ip", "dst_ip", "msisdn", "imsi"))
    dia = spark.createDataFrame(rows, "capture_id string, message_uid long, ts double, apn string").selectExpr("*", *columns.split(", "))
    found = strategies.diameter_fusion(s, ips, dia, 5.0, called=s.select("capture_id", "session_id", F.col("msisdn").alias("called")))
    got = sorted((r["session_id"], r["message_uid"], r["strategy"]) for r in found.collect())
    assert got == [("s0", 5, "apn_match"), ("s1", 1, "time_cluster"), ("s1", 2, "time_cluster"), ("s2", 3, "time_cluster"), ("s3", 4, "time_cluster"), ("s4", 6, "apn_match")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(key" not in plan


def test_nearest_by_products_is_nearest_one_by_one(spark, monkeypatch):
    """Copies, scaled copies and zero vectors, with names of text: values and ties are those of the plain expression."""
    rng = random.Random(5)
    some = [[rng.choice([-1.0, 0.0, 0.1, 0.7, 3.0]) for _ in range(5)] for _ in range(12)]
    rows = [(f"p{i}", [x * s for x in v]) for i in range(150) for v, s in [(rng.choice(some), rng.choice([1.0, 1.0, 3.0]))]] + [("z", [0.0] * 5)]
    patterns = spark.createDataFrame(rows, "pattern_id string, embedding array<float>").repartition(3)
    queries = patterns.where("pattern_id like '%7' or pattern_id = 'z'").withColumnRenamed("pattern_id", "query_id")
    plain = queries.crossJoin(patterns.withColumnRenamed("embedding", "_p")).select("query_id", "pattern_id", learning.cosine(F.col("embedding"), F.col("_p")).alias("similarity"))
    by = {}
    for r in plain.collect():
        by.setdefault(r[0], []).append((-r[2], r[1]))
    want = {(q, p, -c, n + 1) for q, x in by.items() for n, (c, p) in enumerate(sorted(x)[:4])}
    for block, square in ((8192, 2048), (5, 16)):
        monkeypatch.setattr(learning, "QUERY_BLOCK", block)
        monkeypatch.setattr(learning, "SQUARE", square)
        found = learning.nearest(queries, patterns, k=4)
        assert {tuple(r) for r in found.collect()} == want and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    odd = patterns.unionByName(spark.createDataFrame([("odd", None)], patterns.schema))
    assert {tuple(r) for r in learning.nearest(queries.where("query_id = 'p7'"), odd, k=4).collect()} == {w for w in want if w[0] == "p7"}


def test_small_groups_fold_like_the_plain_fold():
    """The fold that small groups take, without Spark, against the plain one on random captures."""
    from types import SimpleNamespace

    from tests.test_merging import IMSI, OTHER, WINDOW, plain_fold, random_capture

    for seed in range(300):
        sessions, tokens = random_capture(seed)
        waiting = []
        for name, start, end, protocols, technologies, _, first, last, dialog in sessions:
            own = {k: {t[2] for t in tokens if t[0] == name and t[1] == k} for k in ("id", "stream", *pairs.POINTS, "pair", "ip")}
            own["imsi"] = own["subscriber_id"] & {IMSI, OTHER}
            row = SimpleNamespace(session_id=name, start_ts=start, end_ts=end, technologies=technologies, dialog_key=dialog, mobility=False, speaks=bool(set(protocols) - {"TCP", "UDP", "SCTP"}), starts=first == "Attach Request", ends=last == "Attach Complete")
            waiting.append(merging._Cluster(row, own))
        got = {m: c.name for c in merging._folded(waiting, WINDOW, 3) for m in c.members}
        assert got == plain_fold(sessions, tokens), seed
