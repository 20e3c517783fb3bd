"""Similarity search, pattern memory and reviews over the embeddings and the signalling view."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigweave.operators import learning as L
from sigweave.operators.vectors import near_clusters
from sigweave.plans.batch import labelled
from sigweave.plans.testviews import GAP, SESSIONS_SQL, messages


def _vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


def knn(s, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    v = _vectors(s, d)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = L.nearest(queries, v.select(F.col("vec_id").alias("pattern_id"), "embedding"), 5)
    return rows.select("query_id", "pattern_id", F.round("similarity", 4).alias("similarity"))


def knn_blocked(s, d):
    """The same among vectors of the query's label."""
    v = _vectors(s, d)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    rows = L.nearest(queries, v.select(F.col("vec_id").alias("pattern_id"), "embedding", "label"), 3, block="label")
    return rows.select("query_id", "pattern_id", F.round("similarity", 4).alias("similarity"))


def _patterns(s, d):
    """One pattern per capture, label and protocol set of the labelled sessions."""
    rows = labelled(messages(s, d), GAP)
    return rows.groupBy("capture_id", "rca_label", F.array_join("protocols", ",").alias("protocols")).agg(F.count("*").alias("occurrence_count"), F.max("confidence_pct").alias("pct"), F.to_date(F.timestamp_seconds(F.max("end_ts"))).alias("last_seen")).select(
        F.concat_ws("|", "capture_id", "rca_label", "protocols").alias("pattern_id"), F.col("rca_label").alias("root_cause"), "protocols", (F.col("pct") / 100).alias("confidence"), "occurrence_count", "last_seen"
    )


PATTERNS_SQL = SESSIONS_SQL + """, pt AS (
  SELECT capture_id || '|' || rca_label || '|' || array_to_string(protocols, ',') AS pattern_id, rca_label AS root_cause, array_to_string(protocols, ',') AS protocols, max(confidence_pct) / 100 AS confidence, count(*) AS occurrence_count, max(CAST(make_timestamp(CAST(end_ts * 1000000 AS BIGINT)) AS DATE)) AS last_seen FROM rca GROUP BY ALL
)""".replace("GROUP BY ALL", "GROUP BY capture_id, rca_label, array_to_string(protocols, ',')")


def decay(s, d):
    p = _patterns(s, d)
    age = F.greatest(F.datediff(F.lit("2025-01-01").cast("date"), F.col("last_seen")), F.lit(0))
    return p.select("pattern_id", age.alias("age_days"), F.round(L.decayed(F.col("confidence"), age, F.col("occurrence_count")), 6).alias("confidence"))


def reinforce(s, d):
    p = _patterns(s, d).withColumn("status", F.lit("candidate"))
    hits = labelled(messages(s, d), GAP).where("messages > 2").select(F.concat_ws("|", "capture_id", "rca_label", F.array_join("protocols", ",")).alias("pattern_id"))
    return L.reinforce(p, hits).select("pattern_id", F.round("confidence", 6).alias("confidence"), "occurrence_count", "status")


def routes(s, d):
    rows = labelled(messages(s, d), GAP).drop("root_cause").withColumns({"confidence": F.col("confidence_pct") / 100, "is_conflicted": F.lit(False)})
    matches = rows.select("capture_id", "session_id", F.when(F.col("messages") > 1, 0.95).otherwise(0.5).alias("similarity"), F.lit("p").alias("pattern_id"), F.lit("NORMAL_CALL").alias("root_cause"))
    return L.route(rows, matches, ["capture_id", "session_id"]).groupBy("capture_id", "route").agg(F.count("*").alias("n"))


def _queue(s, d):
    labels = s.read.parquet(f"{d}/labels.parquet")
    return labels.select(F.col("doc_id").alias("validation_id"), (F.col("doc_id") % 50).alias("pattern_id"), F.when(F.col("quality") == 1, "approved").when(F.col("toxic") == 1, "rejected").otherwise("pending_review").alias("validation_status"), ((F.col("doc_id") * 37 % 100) / 100).alias("confidence"), ((F.col("doc_id") * 53 % 100) / 100).alias("similarity"), F.col("doc_id").alias("updated_at"))


_QUEUE_SQL = "q AS (SELECT doc_id AS validation_id, doc_id % 50 AS pattern_id, CASE WHEN quality = 1 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE 'pending_review' END AS validation_status, (doc_id * 37 % 100) / 100 AS confidence, (doc_id * 53 % 100) / 100 AS similarity, doc_id AS updated_at FROM labels)"


def audit(s, d):
    p = _patterns(s, d)
    v = p.where(F.col("occurrence_count") > 2).select(F.col("pattern_id").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    return L.audit(p, v, _queue(s, d))


def reconciliation(s, d):
    """What a vector store of every other vector, and of some that no pattern has, lacks and keeps."""
    v = _vectors(s, d)
    patterns = v.select(F.col("vec_id").alias("pattern_id"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    stored = v.select(F.when(F.col("vec_id") % 5 == 0, F.col("vec_id") + 10_000_000).otherwise(F.col("vec_id")).alias("id"), "embedding").where("id % 2 = 0")
    kept, stale, missing = L.reconcile(patterns, stored)
    parts = [df.select(F.lit(name).alias("state"), "id") for name, df in (("kept", kept), ("stale", stale), ("missing", missing))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def knowledge_metrics(s, d):
    return L.metrics(_patterns(s, d).withColumn("status", F.lit("candidate")), _queue(s, d))


def merged_queue(s, d):
    """The queue of labels: open items of one session, pattern and cause become one; some have no session, cause or status, and some notes are blank."""
    i = F.col("validation_id")
    queue = _queue(s, d).withColumns({
        "session_id": F.when(i % 7 != 0, F.concat(F.lit("s"), (i % 5).cast("string"))), "hybrid_root_cause": F.when(i % 3 != 0, F.concat(F.lit("C"), (i % 3).cast("string"))), "pattern_id": F.col("pattern_id") % 4,
        "validation_status": F.when((i % 11 == 0) & (F.col("validation_status") == "pending_review"), None).otherwise(F.col("validation_status")), "note": F.when(i % 2 == 0, "").otherwise(i.cast("string")), "queued_at": i + 1000,
    })
    return L.merge_queue(queue).select("session_id", "pattern_id", "hybrid_root_cause", "validation_status", "validation_id", "queued_at", "note", "updated_at", F.round("confidence", 2).alias("confidence"))


def learning_counters(s, d):
    from sigweave.plans.testviews import messages

    learned = messages(s, d).where("frame_number % 3 = 0").groupBy("capture_id", "protocol").agg(F.count("*").alias("messages"))
    return L.learning_counters(_patterns(s, d), learned)


def compaction(s, d):
    """Vectors of a label folded into the most confident near ones."""
    v = _vectors(s, d)
    p = v.select(F.col("vec_id").cast("string").alias("pattern_id"), F.col("label").cast("string").alias("root_cause"), F.lit("x").alias("protocols"), (0.5 + F.col("vec_id") % 50 / 100).alias("confidence"), F.lit(2).cast("long").alias("occurrence_count"), F.lit("2025-01-01").cast("date").alias("last_seen"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return L.compact(p, F.lit("2025-01-02").cast("date"), similarity=0.3).groupBy("root_cause").agg(F.count("*").alias("patterns"), F.sum("occurrence_count").alias("occurrences"))


def sequence_clusters(s, d):
    """Vectors that a chain of near ones connects; null stands alone."""
    v = _vectors(s, d)
    return near_clusters(v.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")), distance=0.55)


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
COMPACT_SQL = """WITH RECURSIVE v AS (
  SELECT label, CAST(vec_id AS VARCHAR) AS id, round((0.5 + vec_id % 50 / 100) * 364 / 365 * 1.04, 4) AS confidence, embedding::DOUBLE[] AS e FROM embeddings
), o AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY least(0.995, confidence) DESC, id) AS r FROM v
), f AS (
  SELECT label, CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[][]) AS kept FROM (SELECT DISTINCT label FROM embeddings)
  UNION ALL SELECT f.label, o.r, CASE WHEN len(list_filter(kept, lambda k: list_dot_product(k, o.e) / (sqrt(list_dot_product(k, k)) * sqrt(list_dot_product(o.e, o.e))) >= 0.3)) > 0 THEN kept ELSE list_append(kept, o.e) END
  FROM f JOIN o ON o.label = f.label AND o.r = f.r + 1
)
SELECT CAST(label AS VARCHAR) AS root_cause, len(arg_max(kept, r)) AS patterns, 2 * max(r) AS occurrences FROM f GROUP BY label"""

CLUSTERS_SQL = f"""WITH RECURSIVE n AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.45
), w(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT n.b, w.root FROM w JOIN n ON n.a = w.node WHERE w.root < n.b
), c AS (
  SELECT node, min(root) AS root FROM w GROUP BY 1
)
SELECT vec_id AS id, CASE WHEN vec_id IN (SELECT a FROM n) THEN root END AS cluster FROM embeddings JOIN c ON c.node = vec_id"""

QUERIES = [
    ("j23_knn", knn, f"SELECT query_id, pattern_id, round(c, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, pattern_id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS pattern_id, {_COS} AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE r <= 5"),
    ("k05_knn_filtered", knn_blocked, f"SELECT query_id, pattern_id, round(c, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, pattern_id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS pattern_id, {_COS} AS c FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0)) WHERE r <= 3"),
    ("m36_decay", decay, f"WITH {PATTERNS_SQL}, x AS (SELECT *, greatest(DATE '2025-01-01' - last_seen, 0) AS age FROM pt) SELECT pattern_id, CAST(age AS INT) AS age_days, CAST(round(least(0.995, confidence * greatest(0.65, 1 - age / 365) * least(1.15, 1 + occurrence_count / 50)), 6) AS DOUBLE) AS confidence FROM x"),
    ("r19_reinforce", reinforce, f"WITH {PATTERNS_SQL}, h AS (SELECT capture_id || '|' || rca_label || '|' || array_to_string(protocols, ',') AS pattern_id, count(*) AS n FROM rca WHERE messages > 2 GROUP BY 1) SELECT pattern_id, CAST(round(CASE WHEN n > 0 THEN least(0.995, confidence + 0.02 * n) ELSE confidence END, 6) AS DOUBLE) AS confidence, occurrence_count + coalesce(n, 0) AS occurrence_count, CASE WHEN n > 0 AND occurrence_count + n >= 3 THEN 'validated' ELSE 'candidate' END AS status FROM pt LEFT JOIN h USING (pattern_id)"),
    ("r18_routes", routes, f"WITH {SESSIONS_SQL} SELECT capture_id, CASE WHEN confidence_pct < 58 THEN 'review' WHEN messages > 1 AND rca_label = 'NORMAL_CALL' THEN 'reinforce' WHEN messages > 1 THEN 'conflict' ELSE 'candidate' END AS route, count(*) AS n FROM rca GROUP BY 1, 2"),
    ("k04_pending_queue", lambda s, d: L.pending_list(_queue(s, d)).select("validation_id", "confidence", "similarity"), f"WITH {_QUEUE_SQL} SELECT validation_id, confidence, similarity FROM q WHERE validation_status = 'pending_review' ORDER BY confidence, similarity, validation_id LIMIT 8"),
    ("a38_merged_queue", merged_queue, f"""WITH {_QUEUE_SQL}, x AS (
  SELECT validation_id AS i, CASE WHEN validation_id % 7 <> 0 THEN 's' || (validation_id % 5) END AS session_id, pattern_id % 4 AS pattern_id, CASE WHEN validation_id % 3 <> 0 THEN 'C' || (validation_id % 3) END AS hybrid_root_cause, validation_status, CASE WHEN validation_id % 2 = 1 THEN CAST(validation_id AS VARCHAR) END AS filled, round(confidence, 2) AS confidence FROM q
)
SELECT session_id, pattern_id, hybrid_root_cause, validation_status, min(i) AS validation_id, min(i) + 1000 AS queued_at, arg_max(filled, i) FILTER (filled IS NOT NULL) AS note, max(i) AS updated_at, arg_max(confidence, i) AS confidence FROM x WHERE validation_status = 'pending_review' GROUP BY 1, 2, 3, 4
UNION ALL SELECT session_id, pattern_id, hybrid_root_cause, validation_status, i, i + 1000, coalesce(filled, ''), i, confidence FROM x WHERE validation_status <> 'pending_review'"""),
    ("a52_learning_counters", learning_counters, f"WITH {PATTERNS_SQL} SELECT (SELECT count(*) FROM pt) AS patterns, count(DISTINCT capture_id) AS learned_captures, count(*) AS learned_messages FROM m WHERE frame_number % 3 = 0"),
    ("a40_store_audit", audit, f"WITH {PATTERNS_SQL}, {_QUEUE_SQL}, x AS (SELECT (SELECT count(*) FROM pt WHERE occurrence_count <= 2) AS mv, (SELECT count(*) FROM (SELECT pattern_id FROM q WHERE validation_status = 'pending_review' GROUP BY 1 HAVING count(*) > 1)) AS dp) SELECT 'duplicate_pattern_ids' AS \"check\", 0 AS n UNION ALL SELECT 'orphan_vectors', 0 UNION ALL SELECT 'missing_vectors', mv FROM x UNION ALL SELECT 'mixed_dimensions', 0 UNION ALL SELECT 'duplicate_pending', dp FROM x"),
    ("j26_reconciliation", reconciliation, "WITH x AS (SELECT vec_id AS id, vec_id % 7 <> 0 AS own FROM embeddings), st AS (SELECT CASE WHEN vec_id % 5 = 0 THEN vec_id + 10000000 ELSE vec_id END AS id FROM embeddings), s AS (SELECT id FROM st WHERE id % 2 = 0) SELECT 'kept' AS state, id FROM x WHERE id IN (SELECT id FROM s) OR own UNION ALL SELECT 'stale', id FROM s WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT 'missing', id FROM x WHERE id NOT IN (SELECT id FROM s)"),
    ("a37_knowledge_metrics", knowledge_metrics, f"WITH {PATTERNS_SQL}, {_QUEUE_SQL} SELECT (SELECT count(*) FROM pt) AS patterns, 0 AS validated, (SELECT CAST(sum(occurrence_count) AS BIGINT) FROM pt) AS occurrences, count(*) FILTER (validation_status = 'pending_review') AS pending, count(*) FILTER (validation_status = 'approved') AS approved, count(*) FILTER (validation_status = 'rejected') AS rejected FROM q"),
    ("m35_compaction", compaction, COMPACT_SQL),
    ("m05_sequence_clusters", sequence_clusters, CLUSTERS_SQL),
]
