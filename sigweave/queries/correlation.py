"""Interval joins, tokens, pair scores and clusters over the signalling view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators import merging, pairs, seeds, sessions, strategies
from sigweave.plans.batch import sessionize
from sigweave.plans.testviews import GAP, MESSAGES_SQL, SEGMENTS_SQL, SESSIONS_SQL, WINDOW, messages

KEYS = ["capture_id", "session_id"]


def calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SIP sessions by Call-ID with their bounds and IMSI, and all messages."""
    rows = messages(spark, folder)
    sip = seeds.grouped(rows.where("protocol = 'SIP'"), F.col("call_id"))
    return sip.groupBy(*KEYS).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("imsi").alias("imsi"), F.min("framed_ip").alias("framed_ip"), F.lit(None).cast("string").alias("msisdn")), rows


CALLS_SQL = MESSAGES_SQL + """, calls AS (
  SELECT capture_id, call_id AS session_id, min(ts) AS start_ts, max(ts) AS end_ts, min(imsi) AS imsi, min(framed_ip) AS framed_ip FROM m WHERE protocol = 'SIP' GROUP BY 1, 2
)"""


def seed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return seeds.seed(messages(spark, folder)).groupBy("capture_id", "session_id").agg(F.count("*").alias("messages"))


def framed_ip_join(spark: SparkSession, folder: str) -> DataFrame:
    s, rows = calls(spark, folder)
    ips = s.select(*KEYS, F.col("framed_ip").alias("ip"), F.lit(0).alias("rank"))
    found = strategies.diameter_fusion(s, ips, rows.where("protocol = 'DIAMETER'"), WINDOW, time_fallback=False)
    return found.select(*KEYS, "message_uid", "strategy", "score")


def _user(imsi="imsi"):
    return F.substring(imsi, 6, 10).cast("long")


def _octets(first: str, u):
    return F.concat(F.lit(first), F.expr("_u div 256").cast("string"), F.lit("."), (u % 256).cast("string"))


def arbitrated_strategies(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and Diameter rows by the best strategy of each call. The seven kinds of subscribers show the strategies one identity each: framed address, similar address,
    outer address, number, end of the number, a number that leads to an IMSI, an access point with the number; a call that none finds takes what is near in time."""
    s, rows = calls(spark, folder)
    number = F.concat(F.lit("49170"), F.lpad(F.col("_u").cast("string"), 7, "0"))
    s = s.withColumn("_u", _user()).withColumn("msisdn", number)
    ips = s.select(*KEYS, F.posexplode(F.array("framed_ip", _octets("192.168.", F.col("_u")))).alias("rank", "ip"))
    kind = F.col("_u") % 7
    dia = rows.where("protocol = 'DIAMETER'").withColumn("_u", _user())
    dia = dia.withColumns({
        "framed_ip": F.when(kind == 0, F.col("framed_ip")).when(kind == 1, _octets("11.99.", F.col("_u"))), "src_ip": F.when(kind == 2, _octets("192.168.", F.col("_u"))).otherwise(F.lit("203.0.113.1")), "dst_ip": F.lit("203.0.113.2"),
        "msisdn": F.when((kind == 3) | ((kind == 5) & (F.col("k") % 5 == 0)), number).when(kind == 4, F.concat(F.lit("33"), F.right(number, F.lit(8)))), "imsi": F.when(kind == 5, F.col("imsi")), "apn": F.when(kind == 6, F.concat(F.lit("IMS."), number, F.lit(".net"))),
    })
    found = strategies.diameter_fusion(s, ips, dia, WINDOW, called=s.select(*KEYS, F.col("msisdn").alias("called")))
    return found.select(*KEYS, "message_uid", "strategy", "score")


def gtp_fusion(spark: SparkSession, folder: str) -> DataFrame:
    s, rows = calls(spark, folder)
    ips = s.select(*KEYS, F.col("framed_ip").alias("ip"), F.lit(0).alias("rank"))
    return strategies.gtp_fusion(s, ips, rows.where("protocol = 'GTP'"), WINDOW).select(*KEYS, "message_uid", "strategy")


def time_cluster(spark: SparkSession, folder: str) -> DataFrame:
    s, rows = calls(spark, folder)
    return strategies.time_window(s, rows.where("protocol = 'GTP'"), 600.0).select(*KEYS, "message_uid")


def endpoint_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    s, rows = calls(spark, folder)
    ips = strategies.candidate_ips(seeds.grouped(rows.where("protocol = 'SIP'"), F.col("call_id")), ["src_ip", "dst_ip"])
    return strategies.endpoint_rows(s, ips, rows.where("protocol = 'HTTP'"), 600.0)


def similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and rows whose addresses agree in the last two octets, in a window."""
    from sigweave.functions import fields

    s, rows = calls(spark, folder)
    keys = s.select(*KEYS, fields.similarity_key("framed_ip").alias("key"), F.lit(0).alias("rank"))
    row_keys = strategies.keys_of(rows.where("protocol = 'NAS_5GS'"), {"similar": fields.similarity_key("framed_ip")})
    return strategies.equi_window(s, keys, row_keys, "similar", "framed_ip_nat_similarity", 108, WINDOW).select(*KEYS, "message_uid")


def session_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.tokens(sessionize(messages(spark, folder), GAP))


TOKENS_SQL = SESSIONS_SQL + """, tk AS (
  SELECT DISTINCT capture_id, session_id, kind, token FROM (
    SELECT capture_id, session_id, unnest(['id', 'id', 'subscriber_id', 'subscriber_ip', 'tunnel', 'ip', 'ip', 'pair', 'technology']) AS kind,
      unnest([call_id, CASE WHEN protocol = 'DIAMETER' THEN 'dia-' || user_id END, imsi, framed_ip, teid, src_ip, dst_ip, least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip), technology]) AS token FROM s
  ) WHERE token IS NOT NULL
)"""


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = sessionize(messages(spark, folder), GAP)
    # what scores ask of a session, written once: pairs look it up on both sides
    records, tokens = pairs.saved(sessions.records(rows).select(*KEYS, "start_ts", "end_ts", "protocols", "technologies", "imsi")), sessions.tokens(rows)
    none = spark.sql("select '' as capture_id, '' as a, '' as b, '' as method where false")
    return records, pairs.score_pairs(records, tokens, window=WINDOW, links=none, hot=50)


def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sessions that share an identity, a tunnel or an address, scored."""
    _, scored = _scored(spark, folder)
    return scored.where("score > 0").select("capture_id", "a", "b", F.col("score").cast("int").alias("score"))


PAIRS_SQL = TOKENS_SQL + """, tp AS (
  SELECT x.capture_id, x.session_id AS a, y.session_id AS b, x.kind, count(*) AS n FROM tk x JOIN tk y ON x.capture_id = y.capture_id AND x.kind = y.kind AND x.token = y.token AND x.session_id < y.session_id WHERE x.kind <> 'technology' GROUP BY 1, 2, 3, 4
), tw AS (
  SELECT capture_id, a, b, coalesce(max(n) FILTER (kind = 'id'), 0) AS id, coalesce(max(n) FILTER (kind = 'subscriber_ip'), 0) AS subscriber_ip, coalesce(max(n) FILTER (kind = 'tunnel'), 0) AS tunnel, coalesce(max(n) FILTER (kind = 'subscriber_id'), 0) AS subscriber_id,
    coalesce(max(n) FILTER (kind = 'pair'), 0) AS pair, coalesce(max(n) FILTER (kind = 'ip'), 0) AS ip FROM tp GROUP BY 1, 2, 3
), tn AS (
  SELECT t.*, greatest(x.start_ts - y.end_ts, y.start_ts - x.end_ts, 0) <= 7200 AS near, list_has_any(x.technologies, y.technologies) AS tech,
    (SELECT min(imsi) FROM s WHERE s.capture_id = t.capture_id AND s.session_id = t.a) AS ia, (SELECT min(imsi) FROM s WHERE s.capture_id = t.capture_id AND s.session_id = t.b) AS ib
  FROM tw t JOIN ss x ON x.capture_id = t.capture_id AND x.session_id = t.a JOIN ss y ON y.capture_id = t.capture_id AND y.session_id = t.b
), tsc AS (
  SELECT capture_id, a, b, CASE WHEN id > 0 THEN 120 WHEN ia <> ib THEN 0 ELSE CASE WHEN near AND subscriber_ip > 0 THEN 110 ELSE 0 END + CASE WHEN near AND tunnel > 0 THEN 105 ELSE 0 END + CASE WHEN near AND subscriber_id > 0 THEN 90 ELSE 0 END
    + CASE WHEN near AND pair > 0 THEN 80 WHEN near AND ip >= 2 THEN 72 WHEN near AND ip > 0 THEN 60 ELSE 0 END + CASE WHEN near AND tech THEN 15 ELSE 0 END END AS score FROM tn
)"""


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions merged over pairs that reach the threshold."""
    records, scored = _scored(spark, folder)
    return pairs.merge_clusters(scored, records)


def merged_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Records of seeded sessions after merging; the SIP calls are forked in two dialogs."""
    rows = messages(spark, folder).withColumn("to_tag", F.when((F.col("protocol") == "SIP") & (F.col("k") % 8 != 0), F.concat(F.lit("t"), (F.col("k") % 2).cast("string"))))
    rows = seeds.seed(rows).withColumn("session_id", F.concat_ws(":to-tag:", "session_id", "to_tag"))
    records = sessions.refresh(rows).join(rows.where("to_tag is not null").select(*KEYS, F.concat_ws("|", "call_id", "to_tag").alias("dialog_key")).distinct(), KEYS, "left")
    of = merging.merge_sessions(records, sessions.tokens(rows), window=WINDOW)
    return sessions.refresh(merging.merged_messages(rows, of)).select(*KEYS, "start_ts", "end_ts", "messages", F.array_join("protocols", ",").alias("protocols"), "sip_count", "dia_count", "gtp_count", "http_count")


CLUSTERS_SQL = PAIRS_SQL.replace("WITH ", "") + """, bp AS (
  SELECT capture_id, b AS session_id, a AS up FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, b ORDER BY score DESC, a) AS r FROM tsc WHERE score >= 70) WHERE r = 1
), walk AS (
  SELECT capture_id, session_id, session_id AS cluster FROM ss WHERE (capture_id, session_id) NOT IN (SELECT capture_id, session_id FROM bp)
  UNION ALL SELECT bp.capture_id, bp.session_id, w.cluster FROM bp JOIN walk w ON w.capture_id = bp.capture_id AND w.session_id = bp.up
)"""

_LINKS = """list_filter(list_transform(range(1, len({w}) + 1), lambda j: list_transform(list_slice(list_filter(range(j + 1, len({w}) + 1), lambda n: len({w}[j].tuns) > 0 AND len({w}[n].tuns) > 0 AND NOT list_has_any({w}[j].tuns, {w}[n].tuns)
    AND {w}[n].st - {w}[j].en <= 21600), 1, 1), lambda n: least({w}[j].name, {w}[n].name) || '|' || greatest({w}[j].name, {w}[n].name))[1]), lambda x: x IS NOT NULL)"""

#: The fold itself: one session after the other, for each subscriber by itself, since in this view no identity or subscriber address is shared by two.
#: All sessions of a subscriber share the IMSI and the address; no session is a segment, and no message completes a procedure.
MERGED_SQL = f"""WITH RECURSIVE {MESSAGES_SQL}, z AS (
  SELECT *, CASE WHEN protocol = 'SIP' AND k % 8 <> 0 THEN 't' || (k % 2) END AS tag FROM m
), seeded AS (
  SELECT *, CASE protocol WHEN 'SIP' THEN 'sip:' || call_id WHEN 'DIAMETER' THEN 'diameter:dia-' || user_id WHEN 'GTP' THEN 'gtp:' || teid ELSE lower(protocol) || ':' || imsi END || coalesce(':to-tag:' || tag, '') AS session_id FROM z
), one AS (
  SELECT capture_id, imsi, session_id, min(ts) AS st, max(ts) AS en, min(call_id || '|' || tag) AS dg, list_distinct(list_concat(list(call_id) FILTER (call_id IS NOT NULL), list('dia-' || user_id) FILTER (protocol = 'DIAMETER'))) AS ids,
    coalesce(list(DISTINCT teid) FILTER (teid IS NOT NULL), []) AS tuns, list_distinct(list_concat(list(src_ip), list(dst_ip))) AS ips, list(DISTINCT least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip)) AS prs, list(DISTINCT technology) AS tech
  FROM seeded GROUP BY ALL
), queue AS (
  SELECT capture_id, imsi, list_sort(list({{'st': st, 'name': session_id, 'en': en, 'dg': dg, 'ids': coalesce(ids, []), 'tuns': tuns, 'ips': ips, 'prs': prs, 'tech': tech, 'members': [session_id]}})) AS w FROM one GROUP BY ALL
), fold AS (
  SELECT capture_id, imsi, 1 AS pass, 1 AS i, w, list_filter(w, lambda x: false) AS done, {_LINKS.format(w="w")} AS links FROM queue
  UNION ALL
  SELECT capture_id, imsi, CASE WHEN more THEN pass ELSE pass + 1 END, CASE WHEN more THEN i + 1 ELSE 1 END, next, CASE WHEN NOT more THEN list_filter(w, lambda x: false) WHEN best >= 70 THEN list_transform(done, lambda c, n: CASE WHEN n = list_position(scores, best) THEN
      {{'st': least(c.st, s.st), 'name': least(c.name, s.name), 'en': greatest(c.en, s.en), 'dg': coalesce(c.dg, s.dg), 'ids': list_distinct(list_concat(c.ids, s.ids)), 'tuns': list_distinct(list_concat(c.tuns, s.tuns)), 'ips': list_distinct(list_concat(c.ips, s.ips)),
        'prs': list_distinct(list_concat(c.prs, s.prs)), 'tech': list_distinct(list_concat(c.tech, s.tech)), 'members': list_concat(c.members, s.members)}} ELSE c END) ELSE list_append(done, s) END,
    CASE WHEN more THEN links ELSE {_LINKS.format(w="next")} END
  FROM (SELECT *, list_max(scores) AS best, CASE WHEN more THEN w ELSE list_sort(done) END AS next FROM (SELECT *, i <= len(w) AS more, w[i] AS s, list_transform(done, lambda c: CASE
      WHEN c.dg <> w[i].dg THEN 0 WHEN list_has_any(c.ids, w[i].ids) THEN 120
      ELSE CASE WHEN list_contains(links, least(c.name, w[i].name) || '|' || greatest(c.name, w[i].name)) THEN 102 ELSE 0 END + CASE WHEN greatest(c.st - w[i].en, w[i].st - c.en, 0) > 7200 THEN 0 ELSE 200 + CASE WHEN list_has_any(c.tuns, w[i].tuns) THEN 105 ELSE 0 END
        + CASE WHEN list_has_any(c.prs, w[i].prs) THEN 80 WHEN len(list_intersect(c.ips, w[i].ips)) >= 2 THEN 72 WHEN list_has_any(c.ips, w[i].ips) THEN 60 ELSE 0 END + CASE WHEN list_has_any(c.tech, w[i].tech) THEN 15 ELSE 0 END END END) AS scores
    FROM fold WHERE i <= len(w) OR (len(done) < len(w) AND pass < 3)))
), named AS (
  SELECT capture_id, d.name AS name, unnest(d.members) AS session_id FROM (SELECT capture_id, unnest(done) AS d FROM fold WHERE i > len(w) AND (len(done) = len(w) OR pass = 3))
)
SELECT x.capture_id, name AS session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols, count(*) FILTER (protocol = 'SIP') AS sip_count, count(*) FILTER (protocol = 'DIAMETER') AS dia_count,
  count(*) FILTER (protocol = 'GTP') AS gtp_count, count(*) FILTER (protocol = 'HTTP') AS http_count
FROM seeded x JOIN named USING (capture_id, session_id) GROUP BY 1, 2"""

STRATEGIES_SQL = f"""WITH {CALLS_SQL}, c AS (
  SELECT *, CAST(substr(imsi, 6) AS BIGINT) AS u, '49170' || lpad(CAST(CAST(substr(imsi, 6) AS BIGINT) AS VARCHAR), 7, '0') AS number FROM calls
), d0 AS (
  SELECT capture_id, frame_number AS uid, ts, k, user_id AS u, imsi, framed_ip, '49170' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS number FROM m WHERE protocol = 'DIAMETER'
), d AS (
  SELECT capture_id, uid, ts, CASE u % 7 WHEN 0 THEN framed_ip WHEN 1 THEN '11.99.' || (u // 256) || '.' || (u % 256) END AS framed, CASE WHEN u % 7 = 2 THEN '192.168.' || (u // 256) || '.' || (u % 256) END AS outer_ip,
    CASE WHEN u % 7 = 3 OR (u % 7 = 5 AND k % 5 = 0) THEN number WHEN u % 7 = 4 THEN '33' || right(number, 8) END AS msisdn, CASE WHEN u % 7 = 5 THEN imsi END AS imsi, CASE WHEN u % 7 = 6 THEN 'ims.' || number || '.net' END AS apn FROM d0
), bridge AS (
  SELECT capture_id, msisdn, arg_min(imsi, ts) AS imsi FROM d WHERE msisdn IS NOT NULL AND imsi IS NOT NULL GROUP BY 1, 2
), near AS (
  SELECT c.capture_id, c.session_id, c.framed_ip, c.number, c.u, d.*, b.imsi AS bridged FROM c JOIN d ON d.capture_id = c.capture_id AND d.ts BETWEEN c.start_ts - 3600 AND c.end_ts + 3600 LEFT JOIN bridge b ON b.capture_id = c.capture_id AND b.msisdn = c.number
), tail AS (
  SELECT *, split_part(framed, '.', 3) || '.' || split_part(framed, '.', 4) = (u // 256) || '.' || (u % 256) AS alike FROM near
), cand AS (
  SELECT capture_id, session_id, uid, CASE WHEN framed = framed_ip THEN 110 WHEN alike THEN 108 WHEN outer_ip = '192.168.' || (u // 256) || '.' || (u % 256) THEN 85 WHEN msisdn = number THEN 80 WHEN right(msisdn, 8) = right(number, 8) THEN 78 WHEN imsi = bridged THEN 75 WHEN contains(apn, number) THEN 70 ELSE 50 END AS score FROM tail
), best AS (
  SELECT capture_id, session_id, max(score) AS score FROM cand GROUP BY 1, 2
), every AS (
  SELECT capture_id, session_id, uid, score FROM cand UNION SELECT capture_id, session_id, uid, 108 FROM tail WHERE alike UNION SELECT capture_id, session_id, uid, 78 FROM tail WHERE right(msisdn, 8) = right(number, 8) UNION SELECT capture_id, session_id, uid, 75 FROM tail WHERE imsi = bridged
)
SELECT DISTINCT capture_id, session_id, uid AS message_uid, score, CASE score WHEN 110 THEN 'framed_ip_fusion' WHEN 108 THEN 'framed_ip_nat_similarity' WHEN 85 THEN 'ip_layer_match' WHEN 80 THEN 'msisdn_exact' WHEN 78 THEN 'msisdn_suffix' WHEN 75 THEN 'imsi_bridge' WHEN 70 THEN 'apn_match' ELSE 'time_cluster' END AS strategy
FROM every JOIN best USING (capture_id, session_id, score)"""

QUERIES = [
    ("a04_seed_sessions", seed_sessions, f"WITH {MESSAGES_SQL} SELECT capture_id, CASE protocol WHEN 'SIP' THEN 'sip:' || call_id WHEN 'DIAMETER' THEN 'diameter:dia-' || user_id WHEN 'GTP' THEN 'gtp:' || teid ELSE lower(protocol) || ':' || imsi END AS session_id, count(*) AS messages FROM m GROUP BY 1, 2"),
    ("j04_framed_ip_join", framed_ip_join, f"WITH {CALLS_SQL} SELECT c.capture_id, c.session_id, m.frame_number AS message_uid, 'framed_ip_fusion' AS strategy, 110 AS score FROM calls c JOIN m ON m.capture_id = c.capture_id AND m.framed_ip = c.framed_ip AND m.protocol = 'DIAMETER' AND m.ts BETWEEN c.start_ts - 3600 AND c.end_ts + 3600"),
    ("j12_arbitrated_strategies", arbitrated_strategies, STRATEGIES_SQL),
    ("j13_gtp_fusion", gtp_fusion, f"WITH {CALLS_SQL} SELECT c.capture_id, c.session_id, m.frame_number AS message_uid, 'imsi_fusion' AS strategy FROM calls c JOIN m ON m.capture_id = c.capture_id AND m.imsi = c.imsi AND m.protocol = 'GTP' AND m.ts BETWEEN c.start_ts - 3600 AND c.end_ts + 3600"),
    ("j11_time_cluster", time_cluster, f"WITH {CALLS_SQL} SELECT c.capture_id, c.session_id, m.frame_number AS message_uid FROM calls c JOIN m ON m.capture_id = c.capture_id AND m.protocol = 'GTP' AND m.ts BETWEEN c.start_ts - 600 AND c.end_ts + 600"),
    ("j15_endpoint_semi_join", endpoint_semi_join, f"WITH {CALLS_SQL}, ends AS (SELECT DISTINCT capture_id, call_id AS session_id, unnest([src_ip, dst_ip]) AS ip FROM m WHERE protocol = 'SIP') SELECT DISTINCT c.capture_id, c.session_id, m.frame_number AS message_uid FROM calls c JOIN ends e USING (capture_id, session_id) JOIN m ON m.capture_id = c.capture_id AND m.protocol = 'HTTP' AND (m.src_ip = e.ip OR m.dst_ip = e.ip) AND m.ts BETWEEN c.start_ts - 600 AND c.end_ts + 600"),
    ("j05_similarity_join", similarity_join, f"WITH {CALLS_SQL} SELECT c.capture_id, c.session_id, m.frame_number AS message_uid FROM calls c JOIN m ON m.capture_id = c.capture_id AND m.protocol = 'NAS_5GS' AND split_part(m.framed_ip, '.', 3) || '.' || split_part(m.framed_ip, '.', 4) = split_part(c.framed_ip, '.', 3) || '.' || split_part(c.framed_ip, '.', 4) AND m.ts BETWEEN c.start_ts - 3600 AND c.end_ts + 3600"),
    ("a10_session_tokens", session_tokens, f"WITH {TOKENS_SQL} SELECT capture_id, session_id, kind, token FROM tk"),
    ("j16_pair_scores", pair_scores, f"WITH {PAIRS_SQL} SELECT capture_id, a, b, score FROM tsc WHERE score > 0"),
    ("g07_session_clusters", clusters, f"WITH RECURSIVE {CLUSTERS_SQL} SELECT capture_id, session_id, cluster FROM walk"),
    ("a18_merged_sessions", merged_sessions, MERGED_SQL),
]
