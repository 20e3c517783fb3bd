"""Engine operators over the star schema, documents, pages and conversations: the same functions on other tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigweave.functions import fields
from sigweave.operators import learning, models
from sigweave.operators.analytics import top_k
from sigweave.plans.testviews import MESSAGES_SQL


def _t(s, d, n):
    return s.read.parquet(f"{d}/{n}.parquet")


def customer_activity(s, d):
    """Orders of each customer cut into active periods (gap of 90 days)."""
    from sigweave.operators.seeds import gap_segments

    rows = _t(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("frame_number"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("double").alias("ts"), "o_totalprice")
    cut = gap_segments(rows, ["o_custkey"], 90 * 86400.0)
    return cut.groupBy("o_custkey", "segment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def first_order_join(s, d):
    """As-of: for every line item shipped, the customer's latest order before that date."""
    from sigweave.operators.strategies import latest_before

    orders = _t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").alias("at"))
    events = lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    known = orders.select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("latest"))
    return latest_before(events, known, ["o_custkey"], "at", "latest").select(F.col("o_orderkey").alias("line_order"), "l_linenumber", "latest")


def page_identities(s, d):
    """Addresses, services and slugs of page URLs."""
    pages = _t(s, d, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return pages.select("page_id", host.alias("host"), fields.slug("url").alias("slug"), F.length(F.coalesce("html", F.lit(""))).alias("chars"), fields.size_label(F.length(F.coalesce("html", F.lit("")))).alias("size"))


def document_addresses(s, d):
    """Addresses and long numbers in documents."""
    docs = _t(s, d, "documents")
    return docs.select("doc_id", fields.first_ip("text").alias("ip"), fields.long_number("text").alias("number"))


def conversation_flow(s, d):
    """Turns of each conversation with hops of role and running length."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _t(s, d, "conversations").withColumn("before", F.lag("role").over(w)).withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("before") != F.col("role")).alias("hops"), F.max("chars").alias("chars"))


def top_suppliers(s, d):
    rows = _t(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))
    named = rows.join(_t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return top_k(named, ["s_nationkey"], [F.desc("revenue"), F.col("l_suppkey")], 3)


def group_split(s, d):
    """A group-aware split of labelled documents by source: the side of every source."""
    rows = _t(s, d, "labels").join(_t(s, d, "documents").select("doc_id", "source"), "doc_id")
    train, test = models.group_split(rows, "source")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("source", "side").agg(F.count("*").alias("n"))


def address_ranges(s, d):
    from sigweave.plans.testviews import messages

    rows = messages(s, d)
    return rows.select("frame_number", fields.in_ranges("src_ip", [("10.0.0.0", 15), ("10.0.2.0", 24)]).alias("inside"), fields.ipv4_number("dst_ip").alias("number"), fields.address_class("dst_ip").alias("dst_class"), fields.mask_ip("src_ip").alias("masked"), fields.similarity_key("src_ip").alias("similar"))


def changed_rows(s, d):
    """Lines of the second half of the orders that are not in the first, as a set difference."""
    rows = _t(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    late = _t(s, d, "orders").where("o_orderkey % 2 = 1").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return learning.changed_rows(late, rows)


def group_folds(s, d):
    """Documents in five folds that no language of a source is parted by: rows, groups and, of each fold's groups, the most folds that one is in."""
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("|", "source", "lang").alias("group"))
    dealt = models.group_folds(rows, "group", 5)
    spread = dealt.groupBy("group").agg(F.count_distinct("fold").cast("long").alias("folds"))
    return dealt.join(spread, "group").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups"), F.max("folds").alias("folds_of_a_group"))


FOLDS_SQL = """WITH RECURSIVE g AS (
  SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM (SELECT count(*) AS n FROM documents GROUP BY concat_ws('|', source, lang))
), f AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS groups
  UNION ALL SELECT g.r, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + g.n ELSE x END), list_transform(groups, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + 1 ELSE x END) FROM f JOIN g ON g.r = f.r + 1
), l AS (
  SELECT unnest(load) AS n, unnest(groups) AS groups, unnest([0, 1, 2, 3, 4]) AS fold FROM (SELECT * FROM f ORDER BY r DESC LIMIT 1)
)
SELECT fold, n, groups, 1 AS folds_of_a_group FROM l WHERE groups > 0"""

QUERIES = [
    ("w01_customer_periods", customer_activity, "WITH x AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) AS ts, o_totalprice FROM orders), y AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) > 7776000 THEN 1 ELSE 0 END AS cut FROM x), z AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM y) SELECT o_custkey, segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM z GROUP BY 1, 2"),
    ("j19_latest_order", first_order_join, "SELECT l_orderkey AS line_order, l_linenumber, (SELECT arg_max(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate <= l_shipdate) AS latest FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey"),
    ("p46_page_identities", page_identities, "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, length(coalesce(html, '')) AS chars, CASE WHEN length(coalesce(html, '')) < 1024 THEN printf('%.0f B', length(coalesce(html, ''))::DOUBLE) WHEN length(coalesce(html, '')) < 1048576 THEN printf('%.1f KB', length(coalesce(html, '')) / 1024) ELSE printf('%.1f MB', length(coalesce(html, '')) / 1048576) END AS size FROM pages"),
    ("p29_document_addresses", document_addresses, r"SELECT doc_id, nullif(regexp_extract(text, '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 1), '') AS ip, nullif(regexp_extract(text, '(\d{8,15})', 1), '') AS number FROM documents"),
    ("w10_conversation_flow", conversation_flow, "WITH x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (before <> role) AS hops, CAST(sum(length(text)) AS BIGINT) AS chars FROM x GROUP BY 1"),
    ("k08_top_suppliers", top_suppliers, "WITH x AS (SELECT l_suppkey, s_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT l_suppkey, revenue, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, l_suppkey) AS r FROM x) WHERE r <= 3"),
    ("m22_group_folds", group_folds, FOLDS_SQL),
    ("m21_group_split", group_split, "SELECT source, CASE WHEN CAST('0x' || substr(md5(coalesce(source, 'unknown')), 1, 8) AS BIGINT) % 1000 < 200 THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
    ("p36_addresses", address_ranges, f"WITH {MESSAGES_SQL} SELECT frame_number, substr(src_ip, 1, 5) = '10.0.' AS inside, 172::BIGINT * 16777216 + 16 * 65536 + CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS number, 'IMS' AS dst_class, split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2) || '.x.x' AS masked, '4:' || split_part(src_ip, '.', 3) || '.' || split_part(src_ip, '.', 4) AS similar FROM m"),
    ("u05_changed_rows", changed_rows, "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1"),
]
