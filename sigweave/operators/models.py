"""Model training and scoring with Spark ML: labels, priorities, calibration, detectors."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.operators.pairs import saved

TREES, DEPTH = 200, 6
RANK_ROUNDS, RANK_RATE = 80, 0.05


def training_rows(rows: DataFrame, label: str = "rca_label") -> DataFrame:
    return rows.where(F.col(label).isNotNull() & (F.col(label) != "UNKNOWN"))


def with_noise(rows: DataFrame, label: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """The numeric label moved to another class in a share of the rows."""
    columns = rows.columns
    classes = rows.agg((F.max(label) + 1).alias("_classes"))
    # drawn from the row itself, so that a task that runs again moves the same rows
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), *columns), F.lit(1_000_000))
    moved = F.pmod(F.col(label) + 1 + F.pmod(draw(0), F.greatest(F.col("_classes") - 1, F.lit(1))), F.col("_classes")).cast(rows.schema[label].dataType)
    return rows.join(F.broadcast(classes)).withColumn(label, F.when((draw(1) < share * 1_000_000) & (F.col("_classes") > 1), moved).otherwise(F.col(label))).drop("_classes")


def group_split(rows: DataFrame, group: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """A group is wholly in the training or in the test rows, by the MD5 of its name; a missing group is one named "unknown"."""
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit("unknown"))), 1, 8), 16, 10).cast("long") % 1000
    return rows.where(bucket >= int(1000 * test_share)), rows.where(bucket < int(1000 * test_share))


def _numbered(items: DataFrame, key: str, within: str, blocks: int = 200) -> DataFrame:
    """Adds _rank (0, 1, ...) of items within a column, counted in blocks by hash, so that no value of it is numbered in one task."""
    block = items.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    sizes = block.groupBy(within, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(within, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(within, "_block").orderBy(key)
    return block.join(starts, [within, "_block"]).withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1).drop("_block", "_start")


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Adds fold (0 to folds - 1): a group is wholly in one fold, and folds are balanced by rows; a missing group is one named "unknown".

    Groups go to the lightest fold, largest first. Only how many groups there are of each size is placed on the driver; groups of one size are alike, and take their places by rank."""
    named = rows.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    sizes = named.groupBy("_group").agg(F.count("*").alias("_size"))
    heap = [(0, f) for f in range(folds)]
    places: list[tuple[int, int, int, int]] = []
    for size, n in sorted(((r[0], r[1]) for r in sizes.groupBy("_size").count().collect()), reverse=True):
        took = Counter()
        for _ in range(n):
            weight, f = heapq.heappop(heap)
            took[f] += 1
            heapq.heappush(heap, (weight + size, f))
        start = 0
        for f in sorted(took):
            places.append((size, f, start, start + took[f]))
            start += took[f]
    table = rows.sparkSession.createDataFrame(places, "_size long, fold int, _from long, _to long")
    ranked = _numbered(sizes, "_group", "_size").join(F.broadcast(table), "_size").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return named.join(ranked.select("_group", "fold"), "_group").drop("_group")


def label_folds(rows: DataFrame, label: str, folds: int) -> DataFrame:
    """Adds fold: the rows of each label are dealt evenly, in an order drawn from their hash."""
    named = rows.withColumn("_row", F.struct(*rows.columns)).withColumn("_draw", F.xxhash64("_row"))
    return _numbered(named, "_draw", label).withColumn("fold", F.pmod(F.col("_rank"), F.lit(folds)).cast("int")).drop("_row", "_draw", "_rank")


def cross_validation_folds(rows: DataFrame, label: str, group: str | None = None, folds: int = 5) -> tuple[DataFrame | None, int, str]:
    """(rows with fold, number of folds, how). By groups if there are two or more of them, one fold for each if they are fewer than ``folds``; else by label, with at most as many folds as
    labels or rows; (None, 0, ...) if that leaves no two folds."""
    if group:
        n = rows.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown"))).distinct().count()
        if n >= 2:
            k = min(folds, n)
            return group_folds(rows, group, k), k, "groups" if n >= folds else "one group left out"
    k = min(folds, rows.select(label).distinct().count(), rows.count())
    return (label_folds(rows, label, k), k, "labels") if k >= 2 else (None, 0, "too few labels")


def cross_validate(rows: DataFrame, features: list[str], label: str = "rca_label", group: str | None = None, folds: int = 5, **settings) -> list[dict]:
    """A dict for each fold: fold, rows, correct, accuracy of a classifier trained on the others, how. A label that the others lack counts as wrong."""
    dealt, k, how = cross_validation_folds(training_rows(rows, label), label, group, folds)
    if not k:
        return []
    dealt = saved(dealt)
    out = []
    for f in range(k):
        model = train_classifier(dealt.where(F.col("fold") != f), features, label, **settings)
        test = dealt.where(F.col("fold") == f)
        predicted = predict(test, model, features).agg(F.count_if(F.col("predicted") == F.col(label)).alias("correct")).first()[0]
        n = test.count()
        out.append({"fold": f, "rows": n, "correct": predicted, "accuracy": predicted / n if n else None, "how": how})
    return out


def train_classifier(rows: DataFrame, features: list[str], label: str = "rca_label", trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> PipelineModel:
    stages = [StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"), VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows.na.fill(0, features))


def predict(rows: DataFrame, model: PipelineModel | None, features: list[str], fallback: str = "rca_label") -> DataFrame:
    """predicted, confidence_pct: of the model, or of the rules if there is none."""
    if model is None:
        return rows.withColumn("predicted", F.col(fallback))
    scored = model.transform(rows.na.fill(0, features))
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    p = vector_to_array("probability")
    return scored.withColumns({"predicted": F.get(names, F.col("prediction").cast("int")), "confidence_pct": F.round(F.array_max(p) * 100, 1)}).drop("_label", "_features", "rawPrediction", "probability", "prediction")


def top_classes(rows: DataFrame, model: PipelineModel, features: list[str], keys: list[str], k: int = 5) -> DataFrame:
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    scored = model.transform(rows.na.fill(0, features)).select(*keys, F.posexplode(vector_to_array("probability")).alias("class", "p"))
    from sigweave.operators.analytics import top_k

    return top_k(scored.select(*keys, F.get(names, F.col("class")).alias("label"), "p"), keys, [F.desc("p"), F.col("label")], k)


def importances(model: PipelineModel, features: list[str], k: int = 15) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def train_ranker(rows: DataFrame, features: list[str], target: str, rounds: int = RANK_ROUNDS, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), GBTRegressor(labelCol=target, featuresCol="_features", maxIter=rounds, stepSize=RANK_RATE, seed=seed)]).fit(rows.na.fill(0, features))


def blended_priority(rows: DataFrame, model: PipelineModel | None, features: list[str], heuristic: str = "priority_score", weight: float = 0.7) -> DataFrame:
    """Seven tenths of the learned priority and three of the heuristic one; without a model the heuristic."""
    if model is None:
        return rows
    scored = model.transform(rows.na.fill(0, features))
    blend = F.greatest(F.lit(0.0), F.least(F.lit(99.0), weight * F.col("prediction") + (1 - weight) * F.col(heuristic)))
    return scored.withColumn(heuristic, blend).drop("_features", "prediction")


def train_calibrator(rows: DataFrame, score: str, label: str):
    """Monotone calibration of a score; with one class only, anchors at both ends are added."""
    pairs = rows.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")).where("score is not null and label is not null")
    ends = rows.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "score double, label double")
    if pairs.select("label").distinct().limit(2).count() < 2:
        pairs = pairs.unionByName(ends)
    return IsotonicRegression(labelCol="label", featuresCol="features").fit(pairs.withColumn("features", array_to_vector(F.array("score"))))


def calibrate(rows: DataFrame, model, score: str, output: str) -> DataFrame:
    scored = model.transform(rows.withColumn("features", array_to_vector(F.array(F.col(score).cast("double")))))
    return scored.withColumn(output, F.greatest(F.lit(0.02), F.least(F.lit(0.99), F.col("prediction")))).drop("features", "prediction")


def detector_ensemble(rows: DataFrame, features: list[str], clusters: int = 4, seed: int = 42) -> DataFrame:
    """Adds ensemble_score (0 to 1): the mean of two detectors fitted on the population: distance to the nearest centre, and unlikeliness under a mixture."""
    vectors = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(rows.na.fill(0, features))
    centres = [c.tolist() for c in KMeans(k=clusters, featuresCol="_features", predictionCol="_cluster", seed=seed).fit(vectors).clusterCenters()]
    values = vector_to_array("_features")
    distance = F.array_min(F.array(*[F.sqrt(F.aggregate(F.zip_with(values, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in centres]))
    mixed = GaussianMixture(k=2, featuresCol="_features", predictionCol="_mix", probabilityCol="_p", seed=seed).fit(vectors).transform(vectors)
    scored = mixed.withColumns({"_d": distance, "_u": 1 - F.array_max(vector_to_array("_p"))})
    top = scored.agg(F.max("_d").alias("_most"))
    return scored.join(F.broadcast(top)).withColumn("ensemble_score", (F.when(F.col("_most") > 0, F.col("_d") / F.col("_most")).otherwise(0.0) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_u")))) / 2).drop("_features", "_mix", "_p", "_d", "_u", "_most")
