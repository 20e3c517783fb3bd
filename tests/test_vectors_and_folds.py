"""Vectors in blocks, folds, expected sessions and procedure segments against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sigweave.operators import evaluation, learning, models, scoring, seeds, vectors

COMPLETE, START, OTHER = "Attach Complete", "Attach Request", "Measurement"


def near(a, b):
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / length) if length else 0.0


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    out = [centres[i % 6] + rng.normal(size=8) * (0.3 + 0.1 * (i % 4)) for i in range(90)]
    return [*out, out[3], out[3], np.zeros(8), np.zeros(8)]


@pytest.mark.parametrize("leaders, part", [(1024, 4096), (3, 7), (1, 50)])
def test_cover_equals_the_fold(spark, points, leaders, part):
    rows = [(i % 3, f"v{i:03d}", float(i * 37 % 11), [float(x) for x in p]) for i, p in enumerate(points)]
    got = {r["id"]: r["leader"] for r in vectors.greedy_cover(spark.createDataFrame(rows, "group long, id string, place double, vector array<double>"), 0.9, leaders, part).collect()}
    want = {}
    for g in range(3):
        alone = []
        for _, name, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            want[name] = next((n for n, w in alone if near(np.array(v), np.array(w)) >= 0.9), name)
            if want[name] == name:
                alone.append((name, v))
    assert got == want


@pytest.mark.parametrize("part", [4096, 9])
def test_clusters_equal_plain(spark, points, part):
    rows = [(10 + i, [float(x) for x in p]) for i, p in enumerate(points)] + [(500, None)]
    got = {r["id"]: r["cluster"] for r in vectors.near_clusters(spark.createDataFrame(rows, "id long, vector array<double>"), 0.1, part).collect()}
    n = len(points)
    link = [[i != j and near(points[i], points[j]) >= 0.9 for j in range(n)] for i in range(n)]
    want, seen = {500: None}, set()
    for i in range(n):
        if i in seen:
            continue
        group, queue = {i}, [i]
        while queue:
            k = queue.pop()
            new = {j for j in range(n) if link[k][j]} - group
            group |= new
            queue += new
        seen |= group
        want |= {10 + k: 10 + i if len(group) > 1 else None for k in group}
    assert got == want
    assert len({x for x in want.values() if x}) > 2 and None in want.values()


def test_no_vectors(spark):
    assert vectors.near_clusters(spark.createDataFrame([], "id long, vector array<double>")).collect() == []
    assert vectors.greedy_cover(spark.createDataFrame([], "group long, id string, place double, vector array<double>"), 0.9).collect() == []


def test_connected(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in vectors.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_compaction_sums_and_drops(spark):
    rows = [("a", "X", "p", 0.9, 4, "2025-01-01", [1.0, 0.0]), ("b", "X", "p", 0.8, 3, "2025-01-02", [1.0, 0.1]), ("c", "X", "q", 0.8, 3, "2025-01-02", [1.0, 0.1]), ("d", "X", "p", 0.7, 1, "2024-01-02", [1.0, 0.1]), ("e", "X", "p", 0.2, 9, "2025-01-01", [1.0, 0.0])]
    p = spark.createDataFrame(rows, "pattern_id string, root_cause string, protocols string, confidence double, occurrence_count long, last_seen string, embedding array<double>").withColumn("last_seen", F.to_date("last_seen"))
    got = {r["pattern_id"]: (r["occurrence_count"], str(r["last_seen"])) for r in learning.compact(p, F.lit("2025-01-02").cast("date")).collect()}
    assert got == {"a": (7, "2025-01-02"), "c": (3, "2025-01-02")}


def plain_segments(rows, gap=10.0, restart=2.0):
    out, segment, last, done = [], 0, None, False
    for ts, message in rows:
        apart = None if last is None else ts - last
        cut = apart is not None and (apart > gap or (done and message == START and apart > restart))
        segment += cut
        done = (done and not cut) or message == COMPLETE
        out.append(segment)
        last = ts
    return out


def test_procedure_segments_equal_the_fold(spark):
    rng = random.Random(3)
    sessions = {}
    for s in range(120):
        ts, rows = 0.0, []
        for _ in range(rng.randint(1, 25)):
            ts += rng.choice([0.5, 1.0, 2.5, 4.0, 11.0]) if rows else 0
            rows.append((ts, rng.choice([COMPLETE, START, OTHER])))
        sessions[s if s else None] = rows
    flat = [(s, ts, i, s_i, m) for s_i, (s, rows) in enumerate(sessions.items()) for i, (ts, m) in enumerate(rows)]
    df = spark.createDataFrame([(s, ts, i, 1000 * k + i, m) for s, ts, i, k, m in flat], "s long, ts double, frame_number long, message_uid long, message string").repartition(3)
    for least in (1, 12):
        got = {}
        for r in seeds.procedure_segments(df, ["s"], least_rows=least).orderBy("ts", "frame_number").collect():
            got.setdefault(r["s"], []).append(r["segment"])
        assert got == {s: plain_segments(rows) if len(rows) >= least else [0] * len(rows) for s, rows in sessions.items()}


def test_matching_equals_greedy(spark):
    rng = random.Random(5)
    labels, protocols = ["A", "B", None], [["SIP"], ["SIP", "GTP"], ["GTP"], []]
    some = lambda: Row(rca_label=rng.choice(labels), protocols=rng.choice(protocols), technologies=rng.choice([["IMS"], []]), methods=[])
    sessions = [(f"c{c}", f"s{i:02d}", some()) for c in range(12) for i in range(rng.randint(0, 9))]
    expected = [(f"c{c}", i, some()) for c in range(12) for i in range(rng.randint(1, 5))]
    kind = "struct<rca_label:string,protocols:array<string>,technologies:array<string>,methods:array<string>>"
    got = {r["case"]: (r["expected"], r["matched"]) for r in evaluation.match_expected(spark.createDataFrame(sessions, f"case string, session_id string, s {kind}"), spark.createDataFrame(expected, f"case string, expected_id int, e {kind}")).collect()}
    fits = lambda s, e: (s.rca_label is None or e.rca_label is None or s.rca_label == e.rca_label) and all(set(e[k]) <= set(s[k]) for k in ("protocols", "technologies", "methods"))
    want = {}
    for c in {x[0] for x in expected}:
        used, wants = set(), sorted((i, e) for k, i, e in expected if k == c)
        for _, e in wants:
            used |= set(sorted(n for k, n, s in sessions if k == c and n not in used and fits(s, e))[:1])
        want[c] = (len(wants), len(used))
    assert got == want


def test_folds(spark):
    rng = random.Random(2)
    rows = [(g, f"g{g}" if g else None, rng.choice("ab"), float(rng.random())) for g in range(23) for _ in range(1 + g % 5)]
    df = spark.createDataFrame(rows, "n long, capture string, label string, x double")
    dealt, k, how = models.cross_validation_folds(df, "label", "capture", 4)
    found = dealt.collect()
    assert (k, how, len(found)) == (4, "groups", len(rows))
    by_group, by_fold = {}, {}
    for r in found:
        by_group.setdefault(r["capture"], set()).add(r["fold"])
        by_fold[r["fold"]] = by_fold.get(r["fold"], 0) + 1
    assert all(len(x) == 1 for x in by_group.values()) and max(by_fold.values()) - min(by_fold.values()) <= 1
    assert models.cross_validation_folds(df.where("n < 3"), "label", "capture", 5)[1:] == (3, "one group left out")
    dealt, k, how = models.cross_validation_folds(df.where("n = 4"), "label", "capture", 5)
    assert how in ("labels", "too few labels") and k in (0, 2)
    dealt, k, how = models.cross_validation_folds(df, "label", None, 5)
    counts = {(r["label"], r["fold"]): r["count"] for r in dealt.groupBy("label", "fold").count().collect()}
    assert (k, how) == (2, "labels") and all(abs(counts[x, 0] - counts[x, 1]) <= 1 for x in "ab")


def test_cross_validation_by_group(spark):
    rows = [(f"c{i % 3}", "A" if i % 2 else "B", float(i % 2), float(i)) for i in range(60)]
    found = models.cross_validate(spark.createDataFrame(rows, "capture string, rca_label string, x double, y double"), ["x", "y"], group="capture", trees=5, depth=2)
    assert [(r["fold"], r["rows"], r["how"]) for r in found] == [(0, 20, "one group left out"), (1, 20, "one group left out"), (2, 20, "one group left out")]
    assert all(r["accuracy"] == 1.0 for r in found)


def plain_embedding(r):
    tokens = [f"proto:{x}" for x in r["protocols"]] + [f"tech:{x}" for x in r["technologies"]] + [f"seq:{x}" for x in r["sequence"][:20]] + [f"rca:{r['rca_label']}", f"fail:{r['signature'] or 'unknown'}"] + [f"timer:{x}" for x in r["timer_anomalies"] or []]
    v = np.zeros(scoring.DIMENSIONS)
    for token in tokens:
        h = hashlib.sha256(token.encode()).digest()
        v[h[0] % scoring.DIMENSIONS] += (1 if h[1] % 2 == 0 else -1) * (1 + h[2] / 255)
    numbers = [r["duration_ms"] / 10000, r["dia_failure_count"], r["inap_count"], r["protocol_count"], r["technology_count"], r["cross_protocol_hops"], r["timer_anomaly_count"]]
    v[: len(numbers)] += numbers
    return v / np.linalg.norm(v)


def test_embedding_equals_plain(spark):
    schema = "session_id string, protocols array<string>, technologies array<string>, sequence array<string>, rca_label string, signature string, timer_anomalies array<string>, duration_ms double, dia_failure_count int, inap_count int, protocol_count int, technology_count int, cross_protocol_hops int, timer_anomaly_count int"
    rows = [("a", ["SIP", "GTP"], ["IMS"], [f"SIP:{i}" for i in range(30)], "NORMAL_CALL", None, None, 12345.5, 0, 1, 2, 1, 3, 0), ("b", [], [], [], "UNKNOWN", "é:1", ["slow_gap:SIP:x", "slow_gap:SIP:x"], 0.0, 2, 0, 0, 0, 0, 2)]
    df = spark.createDataFrame(rows, schema)
    got = {r["session_id"]: r["embedding"] for r in scoring.embedding(df, ["session_id"]).collect()}
    for r in df.collect():
        assert np.allclose(got[r["session_id"]], plain_embedding(r), atol=1e-6)
