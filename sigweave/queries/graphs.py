"""Topology and knowledge graph over the signalling view, and order graphs over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigweave.operators import graphs as G
from sigweave.operators import sessions
from sigweave.plans.batch import labelled, sessionize
from sigweave.plans.testviews import GAP, MESSAGES_SQL, SESSIONS_SQL, messages

KEYS = ["capture_id", "session_id"]


def failure_topology(s, d):
    return G.failure_topology(sessions.flow(sessionize(messages(s, d), GAP)), KEYS)


def knowledge_nodes(s, d):
    nodes, edges = G.knowledge_facts(labelled(messages(s, d), GAP))
    return G.upsert_graph(nodes, edges)[0]


def knowledge_edges(s, d):
    nodes, edges = G.knowledge_facts(labelled(messages(s, d), GAP))
    return G.upsert_graph(nodes, edges)[1].withColumn("weight", F.round("weight", 4))


def learned_weights(s, d):
    nodes, edges = G.knowledge_facts(labelled(messages(s, d), GAP))
    return G.relation_weights(G.upsert_graph(nodes, edges)[1]).withColumn("learned_weight", F.round("learned_weight", 6))


def graph_metrics(s, d):
    return G.graph_metrics(*G.upsert_graph(*G.knowledge_facts(labelled(messages(s, d), GAP))))


def node_inventory(s, d):
    return G.node_inventory(messages(s, d)).withColumn("confidence", F.round("confidence", 6))


def trade_graph(s, d):
    """Nations as nodes, line items as edges from the supplier's to the customer's nation by priority of the order; those sent back count as failures."""
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    sent = rows.select(F.col("s_nationkey").alias("src_ip"), F.col("c_nationkey").alias("dst_ip"), F.col("o_orderpriority").alias("protocol"), (F.col("l_returnflag") == "R").alias("is_failure"), F.col("l_linestatus").alias("message"))
    return G.topology_edges(sent, []).withColumnsRenamed({"src_ip": "source", "dst_ip": "target", "protocol": "priority"})


_KG = SESSIONS_SQL + """, sl AS (
  SELECT *, 'scenario:' || trim(regexp_replace(lower(rule_id), '[^a-z0-9]+', '-', 'g'), '-') AS sc, 'error:' || trim(regexp_replace(lower(rca_label), '[^a-z0-9]+', '-', 'g'), '-') AS er FROM rca
), fe AS (
  SELECT sc AS source, 'causes' AS relation, er AS target, greatest(1.0, confidence_pct / 25)::DOUBLE AS weight FROM sl
  UNION ALL SELECT 'protocol:' || lower(unnest(protocols)), 'participates', sc, 1.0::DOUBLE FROM sl
  UNION ALL SELECT 'technology:' || lower(unnest(technologies)), 'depends', sc, 0.7::DOUBLE FROM sl
), ge AS (
  SELECT source, relation, target, sum(weight) AS weight, count(*) AS n FROM fe GROUP BY 1, 2, 3
), gn AS (
  SELECT node, count(*) AS n FROM (SELECT unnest([source, target]) AS node FROM fe) GROUP BY 1
)"""

QUERIES = [
    ("g01_capture_nodes", lambda s, d: G.topology_nodes(messages(s, d), ["capture_id"]), f"WITH {MESSAGES_SQL} SELECT capture_id, node, count(*) AS degree, CASE WHEN node LIKE '172.%' THEN 'IMS' ELSE 'CORE' END AS node_class FROM (SELECT capture_id, unnest([src_ip, dst_ip]) AS node FROM m) GROUP BY 1, 2"),
    ("g01_capture_edges", lambda s, d: G.topology_edges(messages(s, d), ["capture_id"]), f"WITH {MESSAGES_SQL} SELECT capture_id, src_ip, dst_ip, protocol, count(*) AS n, count(*) FILTER (is_failure) AS failures, count(DISTINCT message) AS kinds FROM m GROUP BY 1, 2, 3, 4"),
    ("g02_session_edges", lambda s, d: G.topology_edges(sessionize(messages(s, d), GAP), KEYS, 7), f"WITH {SESSIONS_SQL}, c AS (SELECT capture_id, session_id, src_ip, dst_ip, protocol, count(*) AS n, count(*) FILTER (is_failure) AS failures, count(DISTINCT message) AS kinds FROM s GROUP BY 1, 2, 3, 4, 5) SELECT capture_id, session_id, src_ip, dst_ip, protocol, n, failures, kinds FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY failures > 0 DESC, n DESC, protocol, src_ip, dst_ip) AS r FROM c) WHERE r <= 7"),
    ("g03_node_inventory", node_inventory, f"WITH {MESSAGES_SQL}, c AS (SELECT capture_id, CASE protocol WHEN 'SIP' THEN 'CSCF' WHEN 'DIAMETER' THEN 'HSS/OCS' WHEN 'GTP' THEN 'SGW/PGW' WHEN 'HTTP' THEN '5GC NF' ELSE 'AMF' END AS role, dst_ip AS address, count(*) AS n FROM m GROUP BY 1, 2, 3) SELECT capture_id, role, address, round(n / total, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, role ORDER BY n DESC, address) AS r, sum(n) OVER (PARTITION BY capture_id, role) AS total FROM c) WHERE r = 1"),
    ("g05_failure_topology", failure_topology, f"WITH {SESSIONS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY ts, family, frame_number) AS seq FROM s), l AS (SELECT capture_id, session_id, arg_max(src_ip, seq) AS src_ip, arg_max(protocol, seq) AS protocol, arg_max(message, seq) AS message FROM o WHERE is_failure GROUP BY 1, 2), "
     "c AS (SELECT capture_id, session_id, src_ip, dst_ip, protocol, count(*) AS n, count(*) FILTER (is_failure) AS failures FROM s SEMI JOIN l USING (capture_id, session_id) GROUP BY 1, 2, 3, 4, 5) SELECT capture_id, session_id, src_ip, dst_ip, protocol, n, CASE WHEN failures > 0 THEN 'failed' ELSE 'ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY failures > 0 DESC, n DESC, protocol, src_ip, dst_ip) AS r FROM c) WHERE r <= 7 UNION ALL SELECT capture_id, session_id, src_ip, 'failure:' || message, protocol, 1, 'sink' FROM l"),
    ("g06_knowledge_nodes", knowledge_nodes, f"WITH {_KG} SELECT node, n FROM gn"),
    ("g06_knowledge_edges", knowledge_edges, f"WITH {_KG} SELECT source, relation, target, round(weight, 4) AS weight, n FROM ge"),
    ("j29_learned_weights", learned_weights, f"WITH {_KG} SELECT source, relation, target, round(weight / sum(weight) OVER (PARTITION BY source, relation), 6) AS learned_weight FROM ge"),
    ("g08_graph_metrics", graph_metrics, f"WITH {_KG} SELECT 'nodes:' || split_part(node, ':', 1) AS metric, count(*) AS value FROM gn GROUP BY 1 UNION ALL SELECT 'edges:' || relation, count(*) FROM ge GROUP BY 1"),
    ("g09_trade_graph", trade_graph, "SELECT s_nationkey AS source, c_nationkey AS target, o_orderpriority AS priority, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS failures, count(DISTINCT l_linestatus) AS kinds FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3"),
]
