"""Metrics, gates, drift and reports over labelled sessions and labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import evaluation as E
from sigweave.plans.batch import labelled
from sigweave.plans.testviews import GAP, SESSIONS_SQL, messages


def _rows(s, d):
    return labelled(messages(s, d), GAP)


def session_metrics(s, d):
    m = E.session_metrics(_rows(s, d), ["capture_id"])
    return m.select("capture_id", "sessions", *[F.round(c, 6).alias(c) for c in ("unknown_ratio", "abnormal_ratio", "avg_confidence", "cross_protocol_ratio")])


def reference_profile(s, d):
    """The profile of a suite of a case for each even capture, one for capture 0 again, and one that is not resolved."""
    rows = _rows(s, d)
    cases = rows.select("capture_id").distinct().where("cast(substring(capture_id, 5, 1) as int) % 2 = 0").select(F.col("capture_id").alias("case"), "capture_id")
    again = cases.where("capture_id = 'cap-0'").select(F.explode(F.array(F.struct(F.lit("again").alias("case"), F.col("capture_id")), F.struct(F.lit("lost").alias("case"), F.lit(None).cast("string").alias("capture_id")))).alias("c")).select("c.*")
    return E.reference_profile(rows, cases.unionByName(again)).withColumn("value", F.round("value", 1))


def profile(s, d):
    return E.distribution(_rows(s, d), "rca_label").withColumn("share", F.round("share", 6))


def drift(s, d):
    rows = _rows(s, d)
    even = F.substring("capture_id", 5, 1).cast("int") % 2 == 0
    return E.drift_report(rows.where(even), rows.where(~even)).withColumn("value", F.round("value", 6))


def _actual(s, d) -> DataFrame:
    """Labelled sessions with the methods that held them together."""
    held = F.array_compact(F.array(F.when(F.col("call_id").isNotNull(), "identity:call_id"), F.when(F.col("imsi").isNotNull() & (F.size("protocols") > 1), "state:cross_protocol"), F.when(F.col("gtp_count") == 1, "time_only")))
    rows = _rows(s, d).withColumn("methods", held)
    return rows.withColumnRenamed("capture_id", "case").withColumns({"priority_score": F.col("confidence_pct") * 0.5, "dia_correlation": F.when(F.col("dia_count") > 2, "time_cluster"), "gtp_correlation": F.lit(None).cast("string")})


def _expected(s, d) -> DataFrame:
    n = F.col("n_nationkey")
    return s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("cap-"), (n % 10).cast("string")).alias("case"), n.alias("expected_id"), F.struct(F.when(n % 2 == 0, "USER_BUSY").otherwise("SERVER_ERROR").alias("rca_label"), F.array(F.lit("SIP")).alias("protocols"), F.array(F.lit("IMS")).alias("technologies"), F.array(F.lit("identity:call_id")).alias("methods")).alias("e"))


def expected_matching(s, d):
    actual = _actual(s, d).select("case", "session_id", F.struct("rca_label", "protocols", "technologies", "methods").alias("s"))
    return E.match_expected(actual, _expected(s, d))


def case_metrics(s, d):
    m = E.case_metrics(_actual(s, d), ["case"], expected_matching(s, d))
    whole = ["case", "sessions", "unknown", "abnormal", "identity_sessions", "stateful_sessions", "time_fallback_sessions", "top_label"]
    return m.select(*whole, F.col("expected").cast("long").alias("expected"), F.col("matched").cast("long").alias("matched"), F.col("unexpected").cast("long").alias("unexpected"), F.element_at("label_counts", F.lit("NORMAL_CALL")).alias("normal"), *[F.round(c, 6).alias(c) for c in ("unknown_ratio", "abnormal_priority", "avg_confidence", "avg_methods", "precision", "recall", "f1")])


def case_gates(s, d):
    cases = s.range(12).select(F.concat(F.lit("cap-"), F.col("id").cast("string")).alias("case"), F.lit("NORMAL_CALL").alias("dominant_label"))
    number = F.substring("case", 5, 2).cast("int")
    cases = cases.withColumns({
        "min_sessions": F.when(number % 2 == 0, 560), "max_unknown": F.when(number % 3 == 0, 5), "max_unknown_ratio": F.lit(0.05), "min_confidence": F.when(number < 5, 79.0), "min_identity_sessions": F.lit(300), "min_stateful_sessions": F.when(number % 2 == 1, 400),
        "max_time_fallback_sessions": F.when(number % 4 == 0, 100), "min_precision": F.when(number == 1, 0.5), "min_recall": F.lit(0.4), "min_f1": F.when(number == 2, 0.1), "max_unexpected": F.when(number == 3, 1),
        "required_labels": F.when(number < 8, F.create_map(F.lit("NORMAL_CALL"), F.lit(200), F.lit("USER_BUSY"), 10 * number)), "required_methods": F.create_map(F.lit("identity:call_id"), F.lit(250), F.lit("time_only"), F.lit(60)),
    })
    return E.case_gate(E.case_metrics(_actual(s, d), ["case"], expected_matching(s, d)), cases)


def per_class(s, d):
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").withColumn("predicted", F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1))
    m = E.per_class(rows, "quality", "predicted")
    return m.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _metrics_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("sessions"), F.count_if(F.col("rca_label") == "UNKNOWN").alias("unknown"), F.lit(0).alias("pending"), F.count_distinct("rca_label").alias("patterns"), F.lit(True).alias("benchmark_passed"))


def seed_gate(s, d):
    rows = _rows(s, d)
    return E.seed_gate(_metrics_of(rows.where("capture_id = 'cap-0'")), _metrics_of(rows))


def suite(s, d):
    return E.suite(case_gates(s, d)).withColumn("pass_rate", F.round("pass_rate", 6))


_DIST = "SELECT {c} AS key, count(*) / (SELECT count(*) FROM {t} WHERE {w}) AS share FROM {t} WHERE {w} GROUP BY 1"
_EVEN, _ODD = "CAST(substr(capture_id, 5, 1) AS INT) % 2 = 0", "CAST(substr(capture_id, 5, 1) AS INT) % 2 = 1"


def _tv(c: str, t: str) -> str:
    return f"(SELECT sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2 FROM ({_DIST.format(c=c, t=t, w=_EVEN)}) a FULL JOIN ({_DIST.format(c=c, t=t, w=_ODD)}) b ON a.key = b.key)"


_CASES = SESSIONS_SQL + """, im AS (
  SELECT capture_id, session_id, bool_or(call_id IS NOT NULL) AS by_call FROM s GROUP BY 1, 2
), ac AS (
  SELECT r.*, by_call, len(protocols) > 1 AS by_state, gtp_count = 1 AS by_time, dia_count > 2 AS dia_time, CAST(by_call AS INT) + CAST(len(protocols) > 1 AS INT) + CAST(gtp_count = 1 AS INT) AS methods FROM rca r JOIN im USING (capture_id, session_id)
), wn AS (
  SELECT 'cap-' || (n_nationkey % 10) AS "case", CASE WHEN n_nationkey % 2 = 0 THEN 'USER_BUSY' ELSE 'SERVER_ERROR' END AS lab, count(*) AS n FROM nation GROUP BY 1, 2
), mt AS (
  SELECT "case", sum(n) AS expected, sum(least(n, (SELECT count(*) FROM ac WHERE capture_id = "case" AND rca_label = lab AND list_contains(protocols, 'SIP') AND list_contains(technologies, 'IMS') AND by_call))) AS matched FROM wn GROUP BY 1
), lc AS (
  SELECT capture_id AS "case", rca_label, count(*) AS n FROM ac GROUP BY 1, 2
), x0 AS (
  SELECT capture_id AS "case", count(*) AS sessions, count(*) FILTER (rca_label = 'UNKNOWN') AS unknown, count(*) FILTER (rca_label <> 'NORMAL_CALL') AS abnormal, count(*) FILTER (by_call) AS identity_sessions, count(*) FILTER (by_state) AS stateful_sessions,
    count(*) FILTER (by_time OR dia_time) AS time_fallback_sessions, count(*) FILTER (by_time) AS time_only, avg(confidence_pct) AS avg_confidence, avg(methods) AS avg_methods, coalesce(avg(confidence_pct * 0.5) FILTER (rca_label <> 'NORMAL_CALL'), 0) AS abnormal_priority,
    count(*) FILTER (rca_label = 'NORMAL_CALL') AS normal, count(*) FILTER (rca_label = 'USER_BUSY') AS busy
  FROM ac GROUP BY 1
), x AS (
  SELECT x0.*, unknown / sessions AS unknown_ratio, (SELECT rca_label FROM lc WHERE lc."case" = x0."case" ORDER BY n DESC, rca_label LIMIT 1) AS top_label, coalesce(expected, 0) AS expected, coalesce(matched, 0) AS matched,
    CASE WHEN expected > 0 THEN greatest(sessions - matched, 0) ELSE 0 END AS unexpected, CASE WHEN expected > 0 THEN matched / sessions ELSE 0 END AS precision, CASE WHEN expected > 0 THEN matched / expected ELSE 0 END AS recall
  FROM x0 LEFT JOIN mt USING ("case")
), xf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM x
)"""
_GATE = _CASES + """, cs AS (
  SELECT 'cap-' || i AS "case", i FROM range(12) t(i)
), gt AS (
  SELECT cs."case", sessions IS NULL AS missing, list_filter([CASE WHEN sessions IS NULL THEN 'no sessions' END, CASE WHEN i % 2 = 0 AND sessions < 560 THEN 'too few sessions' END, CASE WHEN i % 3 = 0 AND unknown > 5 THEN 'too many unknown' END, CASE WHEN unknown_ratio > 0.05 THEN 'unknown ratio too high' END,
    CASE WHEN i < 5 AND avg_confidence < 79 THEN 'confidence too low' END, CASE WHEN identity_sessions < 300 THEN 'too few by identity' END, CASE WHEN i % 2 = 1 AND stateful_sessions < 400 THEN 'too few by state' END, CASE WHEN i % 4 = 0 AND time_fallback_sessions > 100 THEN 'too many by time alone' END,
    CASE WHEN i = 1 AND precision < 0.5 THEN 'precision too low' END, CASE WHEN recall < 0.4 THEN 'recall too low' END, CASE WHEN i = 2 AND f1 < 0.1 THEN 'f1 too low' END, CASE WHEN i = 3 AND unexpected > 1 THEN 'too many unexpected' END, CASE WHEN top_label <> 'NORMAL_CALL' THEN 'other dominant label' END,
    CASE WHEN i < 8 AND normal < 200 THEN 'too few of label NORMAL_CALL' END, CASE WHEN i < 8 AND busy < 10 * i THEN 'too few of label USER_BUSY' END, CASE WHEN identity_sessions < 250 THEN 'too few of method identity:call_id' END, CASE WHEN time_only < 60 THEN 'too few of method time_only' END], lambda v: v IS NOT NULL) AS r
  FROM cs LEFT JOIN xf USING ("case")
)"""
QUERIES = [
    ("a28_session_metrics", session_metrics, f"WITH {SESSIONS_SQL} SELECT capture_id, count(*) AS sessions, round(avg(CAST(rca_label = 'UNKNOWN' AS INT)), 6) AS unknown_ratio, round(avg(CAST(rca_label NOT IN ('NORMAL_CALL', 'UNKNOWN') AS INT)), 6) AS abnormal_ratio, round(avg(confidence_pct), 6) AS avg_confidence, round(avg(CAST(len(protocols) > 1 AS INT)), 6) AS cross_protocol_ratio FROM rca GROUP BY 1"),
    ("a51_reference_profile", reference_profile, f"""WITH {SESSIONS_SQL}, r AS (
  SELECT *, (end_ts - start_ts) * 1000 AS ms FROM rca WHERE CAST(substr(capture_id, 5, 1) AS INT) % 2 = 0 UNION ALL SELECT *, (end_ts - start_ts) * 1000 FROM rca WHERE capture_id = 'cap-0'
)
SELECT 'sessions' AS measure, '' AS key, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'avg_duration_ms', '', round(avg(ms), 1) FROM r UNION ALL SELECT 'label', rca_label, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'protocol', unnest(protocols) AS p, count(*) FROM r GROUP BY p UNION ALL SELECT 'technology', unnest(technologies) AS t, count(*) FROM r GROUP BY t"""),
    ("a31_label_profile", profile, f"WITH {SESSIONS_SQL} SELECT rca_label AS key, round(count(*) / (SELECT count(*) FROM rca), 6) AS share FROM rca GROUP BY 1"),
    ("m31_drift_report", drift, f"WITH {SESSIONS_SQL}, p AS (SELECT capture_id, unnest(protocols) AS v FROM rca), tg AS (SELECT capture_id, unnest(technologies) AS v FROM rca), du AS (SELECT avg((end_ts - start_ts) * 1000) FILTER ({_EVEN}) AS a, avg((end_ts - start_ts) * 1000) FILTER ({_ODD}) AS b FROM rca), r AS (SELECT 'label' AS \"check\", {_tv('rca_label', 'rca')} AS value, 0.55 AS lim UNION ALL SELECT 'protocol', {_tv('v', 'p')}, 0.6 UNION ALL SELECT 'technology', {_tv('v', 'tg')}, 0.6 UNION ALL SELECT 'duration', (SELECT greatest(a / b, b / a) FROM du), 2.5) SELECT \"check\", round(value, 6) AS value, CAST(lim AS DOUBLE) AS \"limit\", value <= lim AS passed FROM r"),
    ("a50_case_metrics", case_metrics, f"WITH {_CASES} SELECT \"case\", sessions, unknown, abnormal, identity_sessions, stateful_sessions, time_fallback_sessions, top_label, CAST(expected AS BIGINT) AS expected, CAST(matched AS BIGINT) AS matched, CAST(unexpected AS BIGINT) AS unexpected, nullif(normal, 0) AS normal, round(unknown_ratio, 6) AS unknown_ratio, round(abnormal_priority, 6) AS abnormal_priority, round(avg_confidence, 6) AS avg_confidence, round(avg_methods, 6) AS avg_methods, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM xf"),
    ("a29_case_gates", case_gates, f"WITH {_GATE} SELECT \"case\", missing, CAST(len(r) AS INT) AS failed_checks, len(r) = 0 AS passed, array_to_string(r, '; ') AS reasons FROM gt"),
    ("a30_suite", suite, f"WITH {_GATE} SELECT count(*) FILTER (len(r) = 0) AS passed, count(*) FILTER (len(r) > 0) AS failed, count(*) FILTER (missing) AS missing, count(*) AS cases, round(avg(CAST(len(r) = 0 AS INT)), 6) AS pass_rate FROM gt"),
    ("j24_expected_matching", expected_matching, f"WITH {_CASES} SELECT \"case\", CAST(expected AS INT) AS expected, CAST(matched AS INT) AS matched FROM mt"),
    ("m23_per_class", per_class, "WITH x AS (SELECT quality AS a, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT l AS label, (SELECT count(*) FROM x WHERE a = l AND p = l) AS tp, (SELECT count(*) FROM x WHERE a = l) AS support, (SELECT count(*) FROM x WHERE p = l) AS given FROM (SELECT unnest([0, 1]) AS l)) SELECT label, support, round(tp / given, 6) AS precision, round(tp / support, 6) AS recall, round(2 * (tp / given) * (tp / support) / (tp / given + tp / support), 6) AS f1 FROM c"),
    ("r23_seed_gate", seed_gate, f"WITH {SESSIONS_SQL}, a AS (SELECT count(*) AS n, count(*) FILTER (rca_label = 'UNKNOWN') AS u, count(DISTINCT rca_label) AS p, count(DISTINCT rca_label) FILTER (capture_id = 'cap-0') AS op FROM rca) SELECT 'new_sessions' AS \"check\", n > 0 AS passed FROM a UNION ALL SELECT 'unknown_ratio', u / n <= 0.35 FROM a UNION ALL SELECT 'queue_growth', true FROM a UNION ALL SELECT 'pattern_drop', op <= p FROM a UNION ALL SELECT 'benchmark', true FROM a"),
]
