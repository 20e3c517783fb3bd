"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn once, on the driver, from the
multivariate hypergeometric law that a uniform permutation implies: the matrix has the partitions'
row counts as row sums and the shard sizes as column sums. Each partition permutes its rows and deals
them out by its row of the matrix, rows are exchanged, and each shard permutes what it got. No
global sort and no global numbering takes place; shard sizes are exact by construction.

Rows are permuted by hashes of their columns and the seed, so a repeated run, or a task that runs
again on another executor, gives the same shards. The matrix has partitions x shards cells, whatever
the corpus. Slots are numbered in blocks of a shard, so no task holds a shard.

Only DataFrame functions are used. Results for odd input: null texts have size 1 and CRC 0; identical
rows get slots of their own; input columns named shard or slot are refused; an empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.shared import stash

SHARDS, SEED = 16, 7
ROWS_PER_BLOCK = 500_000
LEAST_PARTITIONS, MOST_PARTITIONS = 256, 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` of good + bad, drawn without return; by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    p_mode = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    u = rng.random() - p_mode
    up, p_up, down, p_down = mode, p_mode, mode, p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:  # what rounding has left over
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows by partition, columns by shard; shard sizes differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        left, free, row = n, sum(room), []
        for s in range(shards):
            x = hypergeometric(rng, room[s], free - room[s], left)
            free -= room[s]
            left -= x
            row.append(x)
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def exact_shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with shard (int) and slot (long, gapless from 0 in each shard), uniformly permuted."""
    spark, columns = rows.sparkSession, rows.columns
    if clash := {"shard", "slot"} & {c.lower() for c in columns}:
        raise ValueError(f"rename the column {clash.pop()}: the result has one of this name")
    rows = stash(rows, "rows")
    total = rows.count()
    partitions = min(MOST_PARTITIONS, max(LEAST_PARTITIONS, total // ROWS_PER_BLOCK))
    names = [f"_sigweave_{x}" for x in ("part", "draw", "at", "ends", "block", "row", "first")]
    part, draw, at, ends, block, row, first = names
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(partitions)))
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shards, seed)
    sums = [(p, [sum(m[: s + 1]) for s in range(shards)]) for p, m in zip(order, matrix, strict=True)]
    table = spark.createDataFrame(sums, f"{part} long, {ends} array<long>")
    local = Window.partitionBy(part).orderBy(draw, *columns)
    dealt = dealt.withColumn(draw, F.xxhash64(F.lit(seed + 1), *columns)).withColumn(at, F.row_number().over(local))
    dealt = dealt.join(F.broadcast(table), part).withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(at))))
    # the second permutation, within each shard
    blocks = max(16, total // shards // ROWS_PER_BLOCK)
    dealt = dealt.withColumn(draw, F.xxhash64(F.lit(seed + 2), part, at)).withColumn(block, F.pmod(F.col(draw), F.lit(blocks)))
    dealt = stash(dealt.select(*columns, "shard", draw, block, part, at), "dealt")
    sizes = dealt.groupBy("shard", block).agg(F.count("*").alias(row))
    before = sizes.withColumn(first, F.coalesce(F.sum(row).over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(row)
    numbered = dealt.withColumn(row, F.row_number().over(Window.partitionBy("shard", block).orderBy(draw, part, at)))
    numbered = numbered.join(before, ["shard", block])
    return numbered.select(*columns, F.col("shard").cast("int").alias("shard"), (F.col(first) + F.col(row) - 1).cast("long").alias("slot"))
