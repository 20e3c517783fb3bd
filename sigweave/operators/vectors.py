"""Cosine work on vectors in blocks: a greedy cover by the most important ones, and clusters of near ones.

No task holds a group: vectors are dealt into parts of a bounded size, and a task compares two parts, or a part with a bounded number of leaders, by a
matrix product. Vectors without length are near nothing. All vectors must have one size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.operators.pairs import saved

#: Vectors in a part, and leaders that are settled at once in a group.
PART, LEADERS = 4096, 1024
_ORDER = [("place", "ascending"), ("id", "ascending")]


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length 1, one a row; zero rows for those without length."""
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _settle(similarity: float):
    """Some vectors of a group in order: each joins the first before it that stands alone and is near, or stands alone."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        near = (x := _units(table["vector"])) @ x.T >= similarity
        alone: list[int] = []
        of = np.arange(len(x))
        for i in range(len(x)):
            hits = near[i, alone]
            if hits.any():
                of[i] = alone[int(hits.argmax())]
            else:
                alone.append(i)
        return pa.table({"group": table["group"], "id": table["id"], "leader": table["id"].take(pa.array(of))})

    return fold


def _join_leaders(similarity: float):
    """The vectors of a part that are near a leader of their group, and the first such leader."""

    def meet(rows: pa.Table, leaders: pa.Table) -> pa.Table:
        if not len(rows) or not len(leaders):
            return pa.table({"group": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "leader": pa.array([], pa.string())})
        leaders = leaders.sort_by(_ORDER)
        near = _units(rows["vector"]) @ _units(leaders["vector"]).T >= similarity
        hit = np.flatnonzero(near.any(axis=1))
        return pa.table({"group": rows["group"].take(pa.array(hit)), "id": rows["id"].take(pa.array(hit)), "leader": leaders["id"].take(pa.array(near[hit].argmax(axis=1)))})

    return meet


def greedy_cover(rows: DataFrame, similarity: float, leaders: int = LEADERS, part: int = PART) -> DataFrame:
    """(group, id, leader): each vector of a group, in order of ``place`` and id, joins the first earlier one that leads and is near enough, or leads itself.

    rows: group (long), id (string, unique in a group), place (double), vector. The fold is done in rounds: the first ``leaders`` open vectors of every group are settled
    among themselves, which is right because whatever an earlier leader takes in is no longer open; then all open vectors that are near one of the new leaders join it."""
    schema = "group long, id string, leader string"
    left = saved(rows.select("group", "id", "place", "vector"))
    done = None
    while not left.isEmpty():
        order = Window.partitionBy("group").orderBy("place", "id")
        first = saved(left.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= leaders).drop("_row"))
        settled = saved(first.groupBy("group").applyInArrow(_settle(similarity), schema))
        rest = saved(left.join(first.select("group", "id"), ["group", "id"], "left_anti"))
        new = first.join(settled.where("id = leader").select("group", "id"), ["group", "id"], "left_semi")
        parts = rest.groupBy("group").agg(F.count("*").alias("n")).select("group", F.ceil(F.col("n") / part).cast("long").alias("parts"))
        dealt = rest.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        sent = new.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        keys = ["group", "part"]
        joined = saved(dealt.drop("parts").groupBy(*keys).cogroup(sent.drop("parts").groupBy(*keys)).applyInArrow(_join_leaders(similarity), schema))
        left = saved(rest.join(joined.select("group", "id"), ["group", "id"], "left_anti"))
        some = settled.unionByName(joined)
        done = some if done is None else done.unionByName(some)
    return rows.sparkSession.createDataFrame([], schema) if done is None else done


def _forest(similarity: float, table: pa.Table) -> pa.Table:
    """Links between near vectors of a part and another (or the same) part: enough to connect what is connected."""
    order = table.sort_by([("right", "ascending"), ("id", "ascending")])
    right, ids = order["right"].to_numpy(), order["id"].to_numpy()
    x = _units(order["vector"])
    cut = int(np.searchsorted(right, True))
    one, other = (x, x) if cut == len(x) else (x[:cut], x[cut:])
    shift = 0 if cut == len(x) else cut
    up = np.arange(len(x))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    links = []
    for k in range(0, len(one), 512):
        for i, j in np.argwhere(one[k : k + 512] @ other.T >= similarity).tolist():
            a, b = top(k + i), top(shift + j)
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((int(ids[k + i]), int(ids[shift + j])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b: long) is connected with.

    In every round each node points to its smallest neighbour, pointers are followed, and links are drawn anew between what they point to."""
    links = saved(links.select("a", "b").where("a != b").distinct())
    labels = saved(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node")))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        up = saved(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("upper")), "up").select("a", F.col("upper").alias("up")))
        side = lambda x: up.select(F.col("a").alias(x), F.col("up").alias(f"to_{x}"))
        links = saved(links.join(side("a"), "a").join(side("b"), "b").where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        labels = saved(labels.join(side("component"), "component", "left").select("node", F.coalesce("to_component", "component").alias("component")))
    return labels


def near_clusters(vectors: DataFrame, distance: float = 0.25, part: int = PART) -> DataFrame:
    """(id, cluster): clusters by density with two vectors as the least, by cosine distance. cluster: the smallest id in it; null if no other vector is near.

    vectors: id (long, unique), vector. With a least of two every vector that has a neighbour is a core point, so clusters are the connected components of near vectors.
    Equal vectors are compared once; each pair of parts gives a spanning forest of its links. A vector that is null or has no length is alone."""
    there = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
    named = vectors.select("id", F.when(there, F.col("vector")).alias("vector"))
    classes = saved(named.where("vector is not null").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    parts = max(1, -(-classes.count() // part))
    dealt = classes.select(F.col("first").alias("id"), "vector", F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int").alias("p"))
    pairs = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # a part meets every part; of two parts the smaller stands left
    met = pairs.select(F.least("p", "q").alias("one"), F.greatest("p", "q").alias("other"), (F.col("p") > F.col("q")).alias("right"), "id", "vector")
    links = met.groupBy("one", "other").applyInArrow(lambda t: _forest(1 - distance, t), "a long, b long")
    labels = connected(links)
    found = classes.join(labels.select(F.col("node").alias("first"), "component"), "first", "left").select("vector", F.when(F.col("component").isNotNull() | (F.col("n") > 1), F.coalesce("component", "first")).alias("cluster"))
    return named.join(found, "vector", "left").select("id", "cluster")
