"""Topology, failure graphs and the knowledge graph, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions import fields
from sigweave.operators.analytics import top_k


def topology_nodes(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, node_class, degree): addresses, and how many messages touch them."""
    ends = messages.select(*keys, F.explode(F.array("src_ip", "dst_ip")).alias("node")).where("node is not null")
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree")).withColumn("node_class", fields.address_class("node"))


def topology_edges(messages: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """(keys, src_ip, dst_ip, protocol, n, failures, kinds): edges; with k the first ones of each key: failing first, then the busiest."""
    edges = messages.groupBy(*keys, "src_ip", "dst_ip", "protocol").agg(F.count("*").alias("n"), F.count_if("is_failure").alias("failures"), F.count_distinct("message").alias("kinds"))
    if k is None:
        return edges
    return top_k(edges, keys, [F.desc(F.col("failures") > 0), F.desc("n"), F.col("protocol"), F.col("src_ip"), F.col("dst_ip")], k)


def failure_topology(flow: DataFrame, keys: list[str], k: int = 7) -> DataFrame:
    """The k first edges of each failed session, and one edge from the last failure's address to a failure sink. flow: messages with seq."""
    last = flow.where("is_failure and protocol not in ('TCP', 'UDP', 'SCTP')").groupBy(*keys).agg(F.max_by(F.struct("src_ip", "protocol", "message"), "seq").alias("last"))
    edges = topology_edges(flow.join(last.select(*keys), keys, "left_semi"), keys, k).select(*keys, "src_ip", "dst_ip", "protocol", "n", F.when(F.col("failures") > 0, "failed").otherwise("ok").alias("status"))
    sink = last.select(*keys, F.col("last.src_ip").alias("src_ip"), F.concat(F.lit("failure:"), F.coalesce("last.message", F.lit("?"))).alias("dst_ip"), F.col("last.protocol").alias("protocol"), F.lit(1).cast("long").alias("n"), F.lit("sink").alias("status"))
    return edges.unionByName(sink)


def node_inventory(messages: DataFrame) -> DataFrame:
    """(capture_id, role, address, confidence): the address that most messages of a family go to, as the family's server."""
    roles = F.when(F.col("protocol") == "SIP", "CSCF").when(F.col("protocol") == "DIAMETER", "HSS/OCS").when(F.col("protocol") == "GTP", "SGW/PGW").when(F.col("protocol") == "HTTP", "5GC NF").when(F.col("protocol").isin("NAS_5GS", "NGAP"), "AMF")
    counts = messages.withColumn("role", roles).where("role is not null and dst_ip is not null").groupBy("capture_id", "role", F.col("dst_ip").alias("address")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("capture_id", "role").agg(F.sum("n").alias("total"))
    best = top_k(counts, ["capture_id", "role"], [F.desc("n"), F.col("address")], 1).join(totals, ["capture_id", "role"])
    return best.select("capture_id", "role", "address", (F.col("n") / F.col("total")).alias("confidence"))


def knowledge_facts(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge facts of labelled sessions: scenario causes error, protocols take part, technologies depend."""
    scenario = F.concat(F.lit("scenario:"), fields.slug("rule_id"))
    error = F.concat(F.lit("error:"), fields.slug("rca_label"))
    weight = F.greatest(F.lit(1.0), F.col("confidence_pct") / 25)
    parts = F.concat(
        F.array(F.struct(scenario.alias("source"), F.lit("causes").alias("relation"), error.alias("target"), weight.alias("weight"))),
        F.transform("protocols", lambda p: F.struct(F.concat(F.lit("protocol:"), F.lower(p)).alias("source"), F.lit("participates").alias("relation"), scenario.alias("target"), F.lit(1.0).alias("weight"))),
        F.transform("technologies", lambda t: F.struct(F.concat(F.lit("technology:"), F.lower(t)).alias("source"), F.lit("depends").alias("relation"), scenario.alias("target"), F.lit(0.7).alias("weight"))),
    )
    edges = sessions.select(F.explode(parts).alias("e")).select("e.*")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return nodes, edges


def upsert_graph(nodes: DataFrame, edges: DataFrame, old_nodes: DataFrame | None = None, old_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds facts to the stored totals: (node, n) and (source, relation, target, weight, n)."""
    new_nodes = nodes.groupBy("node").agg(F.count("*").alias("n"))
    new_edges = edges.groupBy("source", "relation", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    if old_nodes is not None:
        new_nodes = new_nodes.unionByName(old_nodes).groupBy("node").agg(F.sum("n").alias("n"))
    if old_edges is not None:
        new_edges = new_edges.unionByName(old_edges).groupBy("source", "relation", "target").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    return new_nodes, new_edges


def relation_weights(edges: DataFrame) -> DataFrame:
    """The share of a relation's edge in all edges of its source: the learned weight of ``event_chain``."""
    totals = edges.groupBy("source", "relation").agg(F.sum("weight").alias("total"))
    return edges.join(totals, ["source", "relation"]).select("source", "relation", "target", (F.col("weight") / F.col("total")).alias("learned_weight"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): nodes by type, edges by relation."""
    a = nodes.groupBy(F.concat(F.lit("nodes:"), F.substring_index("node", ":", 1)).alias("metric")).agg(F.count("*").alias("value"))
    return a.unionByName(edges.groupBy(F.concat(F.lit("edges:"), F.col("relation")).alias("metric")).agg(F.count("*").alias("value")))
