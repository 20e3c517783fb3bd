"""Small fixtures with the values that operators must give."""

from pyspark.sql import functions as F

from sigweave.functions import fields, predicates
from sigweave.operators import evaluation, learning, normalize, pairs, rules, seeds, sessions, strategies
from sigweave.plans.batch import labelled
from sigweave.schemas import conform


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_fields(spark):
    x = lambda e: one(spark, e)
    lit = F.lit
    assert x(fields.first_present(lit(" "), lit(None).cast("string"), lit(" a "))) == "a"
    assert x(fields.to_int(lit("3.0"))) is None and x(fields.to_int(lit(" 3 "))) == 3
    assert x(fields.as_bool(lit("True"))) is True and x(fields.as_bool(lit("maybe"))) is None
    assert x(fields.supi(lit("x supi=imsi-262011234567890 y"))) == "imsi-262011234567890"
    assert x(fields.suci(lit("SUCI-0-262-01-0-0-0-1234'"))) is not None
    assert x(fields.gpsi(lit("tel:+4917012345"))) == "msisdn-4917012345"
    assert x(fields.sbi_service(lit("/nudm-sdm/v2/x"))) == "nudm-sdm" and x(fields.sbi_service(lit("/nothing/v2"))) is None
    assert x(fields.plain_payload(lit("a%2Fb+c"))) == "a/b+c" and x(fields.plain_payload(lit("50% off"))) == "50% off"
    assert x(fields.decode_hex(lit("68:65:6c:6c:6f:20:79:6f:75"))) == "hello you" and x(fields.decode_hex(lit("6865"))) is None
    assert x(fields.tbcd(lit("621021"))) == "260112" and x(fields.tbcd(lit("62102"))) is None
    assert x(fields.first_ip(lit("to [2001:db8::1]:5060"))) == "2001:db8::1" and x(fields.first_ip(lit("via 10.1.2.3;x"))) == "10.1.2.3"
    assert x(fields.header_param(lit("<sip:a@b>;tag=xyz;q=1"), "tag")) == "xyz"
    assert x(fields.clean_uri(lit('"A" <sip:+49170@ims.org;user=phone>'))) == "sip:+49170@ims.org"
    assert x(fields.uri_user(lit("sip:+49170@ims.org"))) == "+49170" and x(fields.uri_user(lit("tel:+49170;x=1"))) == "+49170"
    assert x(fields.msisdn(lit("0170123"))) == "49170123" and x(fields.msisdn(lit("0049170"))) == "49170"
    assert x(fields.q850_cause(lit('Q.850;cause=17;text="busy"'))) == 17
    assert x(fields.in_ranges(lit("10.1.2.3"), [("10.1.0.0", 16)])) is True and x(fields.in_ranges(lit("x"), [("10.1.0.0", 16)])) is False
    assert x(fields.similarity_key(lit("10.1.2.3"))) == x(fields.similarity_key(lit("192.0.2.3")))
    assert x(fields.plmn(lit("epc.mnc01.mcc262.3gppnetwork.org"))) == "262-01"
    assert x(fields.subscription_ids(F.array(lit("262011234567890"), lit("49170123456"))))["msisdn"] == "49170123456"
    assert x(fields.subscription_ids(F.array().cast("array<string>"))) == (None, None)
    assert x(fields.json_scalars(lit('{"a": 1, "b": ["x", "y"]}'))) == ["a", "1", "b", "x", "y"]
    assert x(fields.mask_ip(lit("10.1.2.3"))) == "10.1.x.x" and x(fields.size_label(lit(2048))) == "2.0 KB"


def raw(spark, rows):
    return spark.createDataFrame(rows, "capture_id string, protocol string, fields map<string,string>")


def test_normalize_families(spark):
    rows = normalize.normalize(raw(spark, [
        ("c", "sip", {"sip.Call-ID": "a", "sip.Method": "invite", "frame.number": "1", "sip.To": "<sip:b@x>;tag=t1"}),
        ("c", "sip", {"sip.Method": "invite", "frame.number": "2"}),
        ("c", "diameter", {"diameter.Session-Id": "s", "diameter.cmd.code": "272", "diameter.Result-Code": "5003", "frame.number": "3"}),
        ("c", "gtp", {"gtpv2.message_type": "32", "gtpv2.cause_value": "64", "frame.number": "4"}),
        ("c", "http", {"http2.headers.path": "/nudm-sdm/v2/imsi-262010000000001/x", "http2.headers.method": "GET", "frame.number": "5"}),
        ("c", "dns", {}),
    ])).collect()
    by = {r["frame_number"]: r for r in rows}
    assert set(by) == {1, 3, 4, 5}
    assert by[1]["method"] == "INVITE" and by[1]["to_tag"] == "t1"
    assert by[3]["is_failure"] and by[3]["is_charging_failure"] and by[3]["is_auth_failure"] and by[3]["command_name"] == "CCR"
    assert by[4]["message"] == "Create Session Request" and by[4]["is_failure"]
    assert by[5]["technology"] == "5G" and by[5]["imsi"] == "262010000000001"


def test_forked_dialogs_share_untagged_messages(spark):
    rows = spark.createDataFrame([("c", "x", None, 1), ("c", "x", "a", 2), ("c", "x", "b", 3), ("c", "y", "z", 4)], "capture_id string, call_id string, to_tag string, frame_number long")
    got = {(r["session_id"], r["frame_number"]) for r in seeds.sip_seed(rows).collect()}
    assert got == {("x:to-tag:a", 1), ("x:to-tag:a", 2), ("x:to-tag:b", 1), ("x:to-tag:b", 3), ("y", 4)}


def msg(spark, rows, schema):
    return conform(spark.createDataFrame(rows, schema))


def test_gap_and_procedure_segments(spark):
    rows = spark.createDataFrame([("c", "k", float(t), i, i, m) for i, (t, m) in enumerate([(0, "Attach Request"), (1, "x"), (2, "Attach Complete"), (5, "Attach Request"), (6, "x"), (30, "x")])], "capture_id string, k string, ts double, frame_number long, message_uid long, message string")
    assert [r["segment"] for r in seeds.gap_segments(rows, ["capture_id", "k"], 15).orderBy("ts").collect()] == [0, 0, 0, 0, 0, 1]
    assert [r["segment"] for r in seeds.procedure_segments(rows, ["capture_id", "k"], least_rows=2).orderBy("ts").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r["segment"] for r in seeds.procedure_segments(rows, ["capture_id", "k"]).orderBy("ts").collect()] == [0] * 6


SESSION = "capture_id string, imsi string, ts double, frame_number long, protocol string, message string, method string, status_code string, cause_code string, result_code string, command_name string, icmp_type string, icmp_code string, is_failure boolean"


def rule_of(spark, *messages):
    keys = ["protocol", "message", "method", "status_code", "cause_code", "result_code", "command_name", "icmp_type", "icmp_code", "is_failure"]
    rows = [("c", "i", float(k), k, *[m.get(c) for c in keys]) for k, m in enumerate(messages)]
    return labelled(msg(spark, rows, SESSION)).first()["rule_id"]


def test_rules(spark):
    sip = lambda **k: {"protocol": "SIP", **k}
    assert rule_of(spark, sip(method="INVITE"), sip(status_code="200"), sip(method="BYE")) == "R1_NORMAL"
    assert rule_of(spark, sip(method="INVITE"), sip(status_code="180"), sip(status_code="487")) == "R2_487_TIMEOUT"
    assert rule_of(spark, sip(method="INVITE"), sip(status_code="487"), sip(method="CANCEL")) == "R2_CANCEL"
    assert rule_of(spark, {"protocol": "DIAMETER", "result_code": "5004", "is_failure": True}) == "R0_ROAMING_DENIED"
    assert rule_of(spark, {"protocol": "DIAMETER", "command_name": "CLR", "result_code": None, "is_failure": False}) == "R0AA_DIAMETER_HOUSEKEEPING"
    assert rule_of(spark, {"protocol": "GTP", "cause_code": "16", "message": "Release Access Bearers Request"}, {"protocol": "ICMP", "icmp_type": "3", "icmp_code": "3", "is_failure": True}) == "R0D_BENIGN_ICMP_CLEANUP"
    pfcp = lambda name: {"protocol": "PFCP", "message": f"Session {name}"}
    assert rule_of(spark, pfcp("Establishment Request"), pfcp("Establishment Response"), pfcp("Deletion Request"), pfcp("Deletion Response")) == "R0E_PFCP_HEALTHY"
    tau = [{"protocol": "NAS_EPS", "message": f"Tracking Area Update {x}"} for x in ("Request", "Accept", "Complete")]
    assert rule_of(spark, *tau, {"protocol": "S1AP", "message": "eNB Status Transfer"}, {"protocol": "GTP", "cause_code": "16"}, {"protocol": "GTP", "cause_code": "16"}) == "R0B_LTE_MOBILITY_SUCCESS"
    assert rule_of(spark, {"protocol": "MAP", "message": "sendAuthenticationInfo"}, {"protocol": "MAP", "message": "updateLocation"}, {"protocol": "MAP", "message": "insertSubscriberData"}) == "R0C_LEGACY_MOBILITY_SUCCESS"
    assert rule_of(spark, {"protocol": "NAS_5GS", "message": "Registration Reject"}) == "R3B_NAS"
    assert rule_of(spark, {"protocol": "TCP", "message": "TCP"}) == "R7_UNKNOWN"
    assert len(rules.RULES) == 33


def test_noise_is_left_out(spark):
    rows = msg(spark, [("c", None, 1.0, 1, "SCTP", "HEARTBEAT"), ("c", None, 2.0, 2, "SCTP", "HEARTBEAT_ACK")], "capture_id string, imsi string, ts double, frame_number long, protocol string, message string").withColumn("session_id", F.lit("s"))
    assert sessions.low_value(rows).count() == 1
    assert sessions.low_value(rows.withColumn("imsi", F.lit("1"))).count() == 0


def test_arbitration_prefers_the_strongest_strategy(spark):
    s = spark.createDataFrame([("c", "s", 10.0, 12.0, "49170123456", "i1")], "capture_id string, session_id string, start_ts double, end_ts double, msisdn string, imsi string")
    ips = spark.createDataFrame([("c", "s", "10.0.0.1", 0)], "capture_id string, session_id string, ip string, rank int")
    dia = msg(spark, [("c", 1, 11.0, "10.0.0.1", None, "49170123456", "i1"), ("c", 2, 11.0, "10.9.0.1", None, "49170123456", "i1"), ("c", 3, 99.0, "10.0.0.1", None, None, None)], "capture_id string, message_uid long, ts double, framed_ip string, apn string, msisdn string, imsi string")
    got = strategies.diameter_fusion(s, ips, dia).select("message_uid", "strategy").collect()
    assert [tuple(r) for r in got] == [(1, "framed_ip_fusion")]


def test_blocking_loses_no_pair_and_merging_is_idempotent(spark):
    rows = [("c", f"s{i}", float(10 * i), float(10 * i + 5), ["GTP"], ["LTE"], "i%d" % (i % 3)) for i in range(12)]
    records = spark.createDataFrame(rows, "capture_id string, session_id string, start_ts double, end_ts double, protocols array<string>, technologies array<string>, imsi string")
    toks = spark.createDataFrame([("c", r[1], "subscriber_id", r[6]) for r in rows] + [("c", r[1], "ip", "1.1.1.1") for r in rows], "capture_id string, session_id string, kind string, token string")
    none = spark.createDataFrame([], "capture_id string, a string, b string, method string")
    for hot in (5, 1000):
        scored = pairs.score_pairs(records, toks, window=20.0, links=none, hot=hot)
        got = {(r["a"], r["b"]) for r in scored.where("score >= 70").collect()}
        want = set()
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                if x[6] == y[6] and max(y[2] - x[3], x[2] - y[3], 0) <= 40:
                    want.add(tuple(sorted((x[1], y[1]))))
        assert got == want
    merged = pairs.merge_clusters(scored, records)
    greedy = pairs.greedy_merge(scored, records)
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in greedy.collect()}


def test_reviews_and_reinforcement(spark):
    p = spark.createDataFrame([("p", "X", 0.5, 2, "candidate"), ("q", "Y", 0.99, 1, "candidate")], "pattern_id string, root_cause string, confidence double, occurrence_count long, status string")
    hits = spark.createDataFrame([("p",), ("q",)], "pattern_id string")
    got = {r["pattern_id"]: r for r in learning.reinforce(p, hits).collect()}
    assert got["p"]["status"] == "validated" and got["q"]["confidence"] == 0.995
    queue = spark.createDataFrame([(1, "p", "pending_review"), (2, "q", "pending_review")], "validation_id long, pattern_id string, validation_status string")
    decisions = spark.createDataFrame([(1, "approve", "Z"), (2, "reject", None)], "validation_id long, decision string, label string")
    new_queue, patterns, feedback = learning.review(queue, p, decisions)
    assert {r["validation_id"]: r["validation_status"] for r in new_queue.collect()} == {1: "approved", 2: "rejected"}
    assert {r["pattern_id"]: r["root_cause"] for r in patterns.collect()} == {"p": "Z", "q": "Y"} and feedback.count() == 2


def test_drift_and_promotion(spark):
    a = spark.createDataFrame([("X",), ("Y",)], "v string")
    b = spark.createDataFrame([("X",), ("X",)], "v string")
    assert evaluation.total_variation(evaluation.distribution(a, "v"), evaluation.distribution(b, "v")).first()[0] == 0.5
    row = lambda *v: spark.createDataFrame([v], "pass_rate double, failed long, abnormal_priority double")
    assert evaluation.promotion_gate(row(1.0, 0, 50.0), row(1.0, 0, 49.0)).first()["promote"]
    assert not evaluation.promotion_gate(row(1.0, 0, 50.0), row(1.0, 0, 40.0)).first()["promote"]


def test_flow_failure(spark):
    f = lambda p, s=None, r=None, c=None: one(spark, predicates.flow_failure(F.lit(p), F.lit(s).cast("string"), F.lit(r).cast("string"), F.lit(c).cast("string"), F.lit(False)))
    assert f("SIP", "486") and not f("SIP", "401") and f("DIAMETER", r="5004") and not f("DIAMETER", r="2001") and f("GTP", c="64") and not f("GTP", c="16")


def test_nearest_searches_all_blocks(spark, monkeypatch):
    from sigweave.operators import learning

    rows = [(i, [float(i % 7 - 3), float(i % 5), float(i % 11 - 5)]) for i in range(40)]
    patterns = spark.createDataFrame(rows, "pattern_id long, embedding array<double>").coalesce(2)
    queries = patterns.where("pattern_id % 9 = 1").withColumnRenamed("pattern_id", "query_id")
    search = lambda: {tuple(r) for r in learning.nearest(queries, patterns, k=4).select("query_id", "pattern_id", "similarity", "rank").collect()}
    want = search()
    monkeypatch.setattr(learning, "BROADCAST_PATTERNS", 15)
    assert len(want) == 20 and search() == want


def test_orphans_find_their_host_among_many_sharers(spark):
    from sigweave.operators import pairs

    def attached(others):
        rows = [("c", "host", 0.0, 1.0, ["SIP"]), ("c", "orphan", 4.0, 5.0, ["TCP"])] + [("c", f"other{i}", 1000.0 + 10 * i, 1001.0 + 10 * i, ["SIP"]) for i in range(others)]
        sessions = spark.createDataFrame([(*r, ["IMS"]) for r in rows], "capture_id string, session_id string, start_ts double, end_ts double, protocols array<string>, technologies array<string>")
        tokens = sessions.selectExpr("capture_id", "session_id", "'pair' as kind", "'a|b' as token")
        return {(r["session_id"], r["host"]) for r in pairs.attach_orphans(sessions, tokens, window=0.5, hot=5).collect()}

    assert attached(0) == attached(20) == {("orphan", "host")}


def test_benign_messages_are_low_value(spark):
    from sigweave.operators import sessions
    from sigweave.schemas import conform

    def low(texts, ips=("10.0.0.1", "10.0.0.2")):
        rows = spark.createDataFrame([("c", "s", "TCP", t, *ips, i) for i, t in enumerate(texts)], "capture_id string, session_id string, protocol string, message string, src_ip string, dst_ip string, frame_number long")
        return sessions.low_value(conform(rows).withColumn("session_id", F.lit("s"))).count() == 1

    assert low(["TCP", "TCP"]) and not low(["TCP", "TLS ALERT"]) and not low(["TCP"] * 5)
    assert low(["TCP"] * 5, ("127.0.0.1", "127.0.0.1")) and not low(["TLS ALERT"] * 5, ("127.0.0.1", "127.0.0.1"))


def test_identities_in_payloads(spark):
    from sigweave.functions import fields

    lit = F.lit
    texts = {
        '{"supiOrSuci": "262011234567890"}': ("imsi-262011234567890", None, None),
        "/nudm-uecm/v1/imsi-262011234567890/registrations?x=1": ("imsi-262011234567890", None, None),
        "imsi-12345 supi=nai-x": (None, None, None),
        '{"ueId":"suci-0-262-01-0-0-0-1234","gpsi":"msisdn-491701234567"}': (None, "suci-0-262-01-0-0-0-1234", "msisdn-491701234567"),
        "tel:+491701234567;phone-context=x": (None, None, "msisdn-491701234567"),
        "msisdn 12345": (None, None, None),
    }
    for text, want in texts.items():
        got = spark.range(1).select(fields.supi(lit(text)), fields.suci(lit(text)), fields.gpsi(lit(text))).first()
        assert tuple(got) == want, text


def test_vectors_are_reconciled(spark):
    from sigweave.operators import learning

    patterns = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", None)], "pattern_id string, embedding array<double>")
    vectors = spark.createDataFrame([("a", [9.0]), ("z", [8.0])], "id string, embedding array<double>")
    kept, stale, missing = learning.reconcile(patterns, vectors)
    assert {r["id"]: r["embedding"] for r in kept.collect()} == {"a": [9.0], "b": [2.0]}
    assert {r["id"] for r in stale.collect()} == {"z"} and {r["id"] for r in missing.collect()} == {"b", "c"}
