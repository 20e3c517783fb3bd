"""Quality metrics, benchmark gates, distribution drift and promotion rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_metrics(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Ratios and averages of labelled sessions per group."""
    return sessions.groupBy(*by).agg(F.count("*").alias("sessions"), F.avg((F.col("rca_label") == "UNKNOWN").cast("int")).alias("unknown_ratio"), F.avg((~F.col("rca_label").isin("NORMAL_CALL", "UNKNOWN")).cast("int")).alias("abnormal_ratio"), F.avg("confidence_pct").alias("avg_confidence"), F.avg((F.size("protocols") > 1).cast("int")).alias("cross_protocol_ratio"))


def _counts(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, a map of each value to how many rows have it)."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias(name))


def case_metrics(sessions: DataFrame, by: list[str], matched: DataFrame | None = None) -> DataFrame:
    """What the gates of a case look at, in one row for each case.

    sessions: rca_label, methods (an array), priority_score, confidence_pct, dia_correlation, gtp_correlation. matched: by, expected and matched
    (as match_expected gives them); without it nothing was expected."""
    fallback = lambda x: F.coalesce(F.lower(x).rlike("time_cluster|time_only"), F.lit(False))
    kind = lambda prefix: F.exists("methods", lambda m: m.startswith(prefix))
    rows = sessions.withColumn("rca_label", F.upper(F.coalesce("rca_label", F.lit("UNKNOWN")))).withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
    abnormal = F.col("rca_label") != "NORMAL_CALL"
    facts = rows.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("rca_label") == "UNKNOWN").alias("unknown"), F.count_if(abnormal).alias("abnormal"),
        F.coalesce(F.max("priority_score"), F.lit(0.0)).alias("top_priority"), F.coalesce(F.avg("priority_score"), F.lit(0.0)).alias("avg_priority"), F.coalesce(F.avg(F.when(abnormal, F.col("priority_score"))), F.lit(0.0)).alias("abnormal_priority"),
        F.coalesce(F.avg("confidence_pct"), F.lit(0.0)).alias("avg_confidence"), F.count_if(kind("identity:")).alias("identity_sessions"), F.count_if(kind("state:")).alias("stateful_sessions"),
        F.count_if(F.exists("methods", fallback) | fallback(F.col("dia_correlation")) | fallback(F.col("gtp_correlation"))).alias("time_fallback_sessions"), F.avg(F.size("methods")).alias("avg_methods"),
    )
    labels = _counts(rows, by, "rca_label", "label_counts")
    methods = _counts(rows.select(*by, F.explode(F.array_distinct("methods")).alias("method")), by, "method", "method_counts")
    out = facts.join(labels, by).join(methods, by, "left")
    top = F.array_sort(F.transform(F.map_entries("label_counts"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label"))))
    out = out.withColumn("top_label", top[0]["label"]).withColumn("unknown_ratio", F.col("unknown") / F.col("sessions"))
    if matched is None:
        out = out.withColumns({"expected": F.lit(0), "matched": F.lit(0)})
    else:
        out = out.join(matched, by, "left").withColumns({"expected": F.coalesce("expected", F.lit(0)), "matched": F.coalesce("matched", F.lit(0))})
    asked = F.col("expected") > 0
    precision, recall = F.when(asked, F.col("matched") / F.col("sessions")).otherwise(0.0), F.when(asked, F.col("matched") / F.col("expected")).otherwise(0.0)
    out = out.withColumns({"precision": precision, "recall": recall, "unexpected": F.when(asked, F.greatest(F.col("sessions") - F.col("matched"), F.lit(0))).otherwise(0)})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(key, share) of a column's values."""
    counts = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("key", (F.col("n") / F.col("total")).alias("share"))


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: half the sum of absolute differences of two distributions."""
    both = a.withColumnRenamed("share", "_a").join(b.withColumnRenamed("share", "_b"), "key", "full_outer")
    return both.agg((F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("distance"))


def reference_profile(sessions: DataFrame, cases: DataFrame) -> DataFrame:
    """(measure, key, value): what the sessions of a suite's cases look like together, as a baseline for drift: their number, mean duration, and the counts of labels, protocols and technologies.

    cases: (case, capture_id); a case whose capture is null is not resolved, and one capture of several cases counts once for each. A suite without sessions has number and duration 0."""
    rows = sessions.join(cases.where("capture_id is not null").select("case", "capture_id"), "capture_id")
    totals = rows.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.bround(F.avg("duration_ms"), 2), F.lit(0.0)).alias("d"))
    one = totals.select(F.explode(F.array(F.struct(F.lit("sessions").alias("measure"), F.lit("").alias("key"), F.col("n").alias("value")), F.struct(F.lit("avg_duration_ms").alias("measure"), F.lit("").alias("key"), F.col("d").alias("value")))).alias("e")).select("e.*")
    tagged = lambda name, c: F.transform(c, lambda v: F.struct(F.lit(name).alias("measure"), v.alias("key")))
    every = F.concat(tagged("label", F.array(F.coalesce("rca_label", F.lit("UNKNOWN")))), tagged("protocol", F.coalesce("protocols", F.array().cast("array<string>"))), tagged("technology", F.coalesce("technologies", F.array().cast("array<string>"))))
    counts = rows.select(F.explode(every).alias("e")).groupBy("e.measure", "e.key").agg(F.count("*").cast("double").alias("value"))
    return one.unionByName(counts)


def drift_report(reference: DataFrame, current: DataFrame, limits: dict | None = None) -> DataFrame:
    """(check, value, limit, passed): label, protocol and technology distributions and the ratio of mean durations."""
    limits = limits or {"label": 0.55, "protocol": 0.6, "technology": 0.6, "duration": 2.5}
    spread = lambda df, c: distribution(df.select(F.explode(c).alias("v")), "v")
    parts = [
        total_variation(distribution(reference, "rca_label"), distribution(current, "rca_label")).select(F.lit("label").alias("check"), F.col("distance").alias("value")),
        total_variation(spread(reference, "protocols"), spread(current, "protocols")).select(F.lit("protocol").alias("check"), F.col("distance").alias("value")),
        total_variation(spread(reference, "technologies"), spread(current, "technologies")).select(F.lit("technology").alias("check"), F.col("distance").alias("value")),
    ]
    means = reference.agg(F.avg("duration_ms").alias("_a")).crossJoin(current.agg(F.avg("duration_ms").alias("_b")))  # two rows of one each
    ratio = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.greatest(F.col("_a") / F.col("_b"), F.col("_b") / F.col("_a"))).otherwise(1.0)
    parts.append(means.select(F.lit("duration").alias("check"), ratio.alias("value")))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("check"))
    return reduce(DataFrame.unionByName, parts).withColumn("limit", limit).withColumn("passed", F.col("value") <= F.col("limit"))


def resolve_cases(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Benchmark cases with their file: named path, then candidates, then a file of the case's name. files: path."""
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("base"))
    direct = cases.select("name", F.col("pcap").alias("want"), F.lit(1).alias("priority"))
    candidates = cases.select("name", F.explode_outer("candidates").alias("want"), F.lit(2).alias("priority"))
    by_name = cases.select("name", F.col("pcap_name").alias("want"), F.lit(3).alias("priority"))
    wants = direct.unionByName(candidates).unionByName(by_name).where("want is not null")
    found = wants.join(named, F.element_at(F.split(wants["want"], "/"), -1) == named["base"])
    w = Window.partitionBy("name").orderBy("priority", "path")
    return cases.join(found.withColumn("_row", F.row_number().over(w)).where("_row = 1").select("name", "path"), "name", "left")


def session_matches(session: str, expected: str) -> Column:
    """Label equal, and the required protocols, technologies and methods all there."""
    s, e = F.col(session), F.col(expected)
    subset = lambda c: F.coalesce(F.size(F.array_except(e[c], s[c])) == 0, F.lit(True))
    return F.coalesce(s["rca_label"] == e["rca_label"], F.lit(True)) & subset("protocols") & subset("technologies") & subset("methods")


def match_expected(sessions: DataFrame, expected: DataFrame, case: str = "case") -> DataFrame:
    """(case, expected, matched): how many expected sessions of a case, in order of their ids, find a session of their own; each takes the matching one of least id.

    sessions and expected: the case, an id and a struct ``s`` or ``e``. Requirements are tested once for each distinct signature of a case's sessions, and of a signature only as many least
    ids are looked at as the case expects sessions, since no more can be taken; so what is gathered of a case depends on its expectations alone, which come from a suite's file."""
    signature = F.xxhash64("s")
    wanted = expected.groupBy(case).agg(F.count("*").alias("wanted"))
    kinds = sessions.groupBy(case, "s").agg(F.count("*").alias("n")).withColumn("signature", signature)
    fits = expected.join(kinds, case).where(session_matches("s", "e")).select(case, "expected_id", "signature", F.col("s").alias("kind"))
    first = Window.partitionBy(case, "signature").orderBy("session_id")
    ids = sessions.select(case, "session_id", F.col("s").alias("kind_of"), signature.alias("signature")).join(wanted, case).withColumn("_row", F.row_number().over(first)).where(F.col("_row") <= F.col("wanted"))
    least = Window.partitionBy(case, "expected_id").orderBy("session_id")
    options = fits.join(ids, [case, "signature"]).where(F.col("kind").eqNullSafe(F.col("kind_of"))).withColumn("_row", F.row_number().over(least)).where(F.col("_row") <= F.col("wanted"))
    pairs = options.groupBy(case, "expected_id").agg(F.array_sort(F.collect_set("session_id")).alias("options"))
    lists = expected.join(pairs, [case, "expected_id"], "left").groupBy(case).agg(F.array_sort(F.collect_list(F.struct("expected_id", F.coalesce("options", F.array().cast("array<string>")).alias("options")))).alias("wants"))
    taken = F.aggregate("wants", F.array().cast("array<string>"), lambda used, w: F.concat(used, F.slice(F.array_except(w["options"], used), 1, 1)))
    return lists.select(case, F.size("wants").alias("expected"), F.size(taken).alias("matched"))


#: A case's limit: (what the reason says, metric, limit, is the limit a least value).
LIMITS = [
    ("too few sessions", "sessions", "min_sessions", True), ("too many unknown", "unknown", "max_unknown", False), ("unknown ratio too high", "unknown_ratio", "max_unknown_ratio", False), ("confidence too low", "avg_confidence", "min_confidence", True),
    ("too few by identity", "identity_sessions", "min_identity_sessions", True), ("too few by state", "stateful_sessions", "min_stateful_sessions", True), ("too many by time alone", "time_fallback_sessions", "max_time_fallback_sessions", False),
    ("precision too low", "precision", "min_precision", True), ("recall too low", "recall", "min_recall", True), ("f1 too low", "f1", "min_f1", True), ("too many unexpected", "unexpected", "max_unexpected", False),
]


def _fewer(counts: str):
    return lambda e: F.coalesce(F.try_element_at(counts, e["key"]), F.lit(0)) < e["value"]


def _says(word: str):
    return lambda e: F.concat(F.lit(f"too few of {word} "), e["key"])


def case_gate(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """Each case with missing, passed and reasons. cases: case, dominant_label, required_labels and required_methods (maps to least counts), and the
    limits of LIMITS; a column that is not there, or null, sets no limit. A case without sessions is missing and fails."""
    both = cases.join(metrics, "case", "left")
    here = F.col("sessions").isNotNull()
    tests = [F.when(~here, F.lit("no sessions"))]
    for says, metric, limit, least in LIMITS:
        if limit in cases.columns:
            tests.append(F.when(here & (F.col(metric) < F.col(limit) if least else F.col(metric) > F.col(limit)), F.lit(says)))
    if "dominant_label" in cases.columns:
        tests.append(F.when(here & (F.upper("top_label") != F.upper("dominant_label")), F.lit("other dominant label")))
    reasons = F.array_compact(F.array(*tests))
    for wanted, counts, word in (("required_labels", "label_counts", "label"), ("required_methods", "method_counts", "method")):
        if wanted in cases.columns:
            named = F.transform(F.array_sort(F.filter(F.map_entries(wanted), _fewer(counts))), _says(word))
            reasons = F.concat(reasons, F.when(here, F.coalesce(named, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return both.select("case", (~here).alias("missing"), F.size(reasons).cast("int").alias("failed_checks"), (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"))


def suite(gated: DataFrame) -> DataFrame:
    """One row: how many cases passed, failed and had no sessions, and the share that passed."""
    return gated.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("missing").alias("missing"), F.count("*").alias("cases"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def promotion_gate(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: whether a candidate may replace the current model. Both: one row with pass_rate, failed, abnormal_priority."""
    both = current.select(*[F.col(c).alias(f"old_{c}") for c in current.columns]).crossJoin(candidate)  # one row each
    tests = [(F.col("pass_rate") < 1.0, "pass rate"), (F.col("pass_rate") < F.col("old_pass_rate"), "pass rate fell"), (F.col("failed") > F.col("old_failed"), "more failures"), (F.col("old_abnormal_priority") - F.col("abnormal_priority") > 3, "priority fell")]
    reasons = F.array_compact(F.array(*[F.when(t, r) for t, r in tests]))
    return both.select((F.size(reasons) == 0).alias("promote"), F.array_join(reasons, "; ").alias("reasons"))


def seed_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(check, passed) of a learning cycle. Both: one row with sessions, unknown, pending, patterns, benchmark_passed."""
    both = before.select(*[F.col(c).alias(f"old_{c}") for c in before.columns]).crossJoin(after)  # one row each
    checks = {"new_sessions": F.col("sessions") > 0, "unknown_ratio": F.col("unknown") / F.greatest("sessions", F.lit(1)) <= 0.35, "queue_growth": F.col("pending") - F.col("old_pending") <= 25, "pattern_drop": F.col("old_patterns") <= F.col("patterns"), "benchmark": F.col("benchmark_passed")}
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(t, F.lit(False)).alias("passed")) for n, t in checks.items()])).alias("c")).select("c.*")


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) from the confusion counts."""
    c = confusion(rows, actual, predicted)
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    r = c.groupBy(F.col("actual").alias("label")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("given"))
    both = r.join(p, "label", "full_outer").na.fill(0)
    precision, recall = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return both.select("label", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), "support")
