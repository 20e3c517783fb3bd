"""Generic sessions, states within sessions, findings, advice and capture details on small made-up messages: nulls, ties, empty tables."""

import pytest

from sigweave.operators import analytics, findings, seeds, sessions, stateful
from sigweave.schemas import conform

KEYS = ["capture_id", "session_id"]
COLUMNS = "capture_id string, session_id string, frame_number long, ts double, protocol string, message string, imsi string, src_ip string, dst_ip string, teids array<string>, subscriber_ips array<string>, access_ids array<string>, sbi_service string, supi string, transaction_id string, stream_id string, ike_inner_ips array<string>"
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]
IMSI = "262020000000001"


def rows_of(spark, *rows):
    return conform(spark.createDataFrame([tuple(r.get(c, "c" if c == "capture_id" else "s" if c == "session_id" else None) for c in NAMES) for r in rows], COLUMNS))


def gtp(frame, ts, teid, **over):
    return {"frame_number": frame, "ts": ts, "protocol": "GTP", "message": "Create Session Response", "imsi": IMSI, "teids": [teid], **over}


@pytest.mark.parametrize(
    "messages,chained",
    [
        ([gtp(1, 0.0, "a", subscriber_ips=["10.0.0.1"]), gtp(2, 20.0, "b", subscriber_ips=["10.0.0.1"])], True),
        ([gtp(1, 0.0, "a", subscriber_ips=["10.0.0.1"]), gtp(2, 10.0, "b", subscriber_ips=["10.0.0.1"])], False),  # one part
        ([gtp(1, 0.0, "a", subscriber_ips=["10.0.0.1"]), gtp(2, 20.0, "a", subscriber_ips=["10.0.0.1"])], False),  # the same tunnel
        ([gtp(1, 0.0, "a"), gtp(2, 20.0, "b")], False),  # nothing to support it
        ([gtp(1, 0.0, "a"), gtp(2, 20.0, "b", message="Modify Bearer Request")], True),
        ([gtp(1, 0.0, "a", access_ids=["u"]), gtp(2, 20.0, "b", access_ids=["u"])], True),
        ([gtp(1, 0.0, "a", access_ids=["u"]), gtp(2, 20.0, "b", access_ids=["u"], imsi="262020000000002")], False),  # another subscriber
        ([gtp(1, 0.0, "a", access_ids=["u"]), gtp(2, 20.0, None, teids=None), gtp(3, 40.0, "b", access_ids=["u"])], False),  # a part without a tunnel between
        ([gtp(1, 0.0, "a", access_ids=["u"], imsi=None), gtp(2, 20.0, "b", access_ids=["u"], imsi=None)], False),
    ],
)
def test_tunnel_chains(spark, messages, chained):
    assert stateful.tunnel_chains(rows_of(spark, *messages), KEYS).count() == int(chained)


def test_stateful_evidence(spark):
    got = stateful.stateful_evidence(rows_of(
        spark, {"protocol": "S1AP", "access_ids": ["z", "e"], "imsi": IMSI, "ts": 1.0}, {"protocol": "HTTP", "sbi_service": "nudm-sdm", "supi": "imsi-" + IMSI, "ts": 2.0},
        {"session_id": "bare", "protocol": "TCP"}, {"session_id": "unnamed", "protocol": "S1AP", "access_ids": ["e"]},
    ), KEYS)
    assert {r["session_id"]: (r["methods"], r["evidence"]) for r in got.collect()} == {"s": (["access_subscriber", "sbi_subscriber"], ["access id e goes with the subscriber", "subscriber named by service nudm-sdm"]), "bare": ([], []), "unnamed": ([], [])}
    assert stateful.stateful_evidence(rows_of(spark).limit(0), KEYS).count() == 0


def test_generic_keys(spark):
    rows = rows_of(
        spark, {"protocol": "HTTP", "sbi_service": "nausf", "supi": "imsi-" + IMSI, "transaction_id": "9", "frame_number": 1}, {"protocol": "NAS_5GS", "imsi": IMSI, "frame_number": 2}, {"protocol": "IKEV2", "ike_inner_ips": ["10.1.1.2", "10.1.1.1"], "frame_number": 3},
        {"protocol": "IKEV2", "transaction_id": "i", "frame_number": 4}, {"protocol": "DNS", "transaction_id": "t", "imsi": IMSI, "frame_number": 5}, {"protocol": "TCP", "stream_id": "7", "frame_number": 6}, {"protocol": "UDP", "src_ip": "b", "dst_ip": "a", "frame_number": 7}, {"protocol": "RADIUS", "supi": "user@realm", "frame_number": 8},
    )
    got = {r["frame_number"]: r["key"] for r in rows.select("frame_number", seeds.generic_key().alias("key")).collect()}
    assert got == {1: f"sbi:imsi:{IMSI}", 2: f"5gs:imsi:{IMSI}", 3: "10.1.1.1", 4: "i", 5: "t", 6: "7", 7: "a|b|7", 8: "id:user@realm"}


def test_generic_sessions_are_cut_by_procedure(spark):
    legacy = [{"protocol": "RANAP", "transaction_id": "x", "ts": float(t), "frame_number": i, "message": m, "src_ip": f"s{i}", "dst_ip": f"d{i}"} for i, (t, m) in enumerate([(0, "Attach Request"), (0.2, "Attach Complete"), (1.0, "Attach Request"), (30, None)])]
    other = [{"protocol": "NGAP", "transaction_id": "x", "ts": float(100 * i), "frame_number": 50 + i, "message": "m"} for i in range(20)]
    got = {r["session_id"]: r for r in seeds.generic_sessions(rows_of(spark, *legacy, *other)).collect()}
    assert {k: r["messages"] for k, r in got.items()} == {"RANAP:x": 2, "RANAP:x:seg2": 1, "RANAP:x:seg3": 1, "NGAP:x": 20}
    assert got["RANAP:x"]["flow"] == "Attach Request → Attach Complete" and (got["RANAP:x"]["calling"], got["RANAP:x"]["called"]) == ("s0", "d1")
    assert got["RANAP:x:seg3"]["flow"] == "RANAP" and got["NGAP:x"]["flow"].count("→") == 7
    assert seeds.generic_sessions(rows_of(spark).limit(0)).count() == 0


def test_family_counts_take_any_case_and_null(spark):
    row = sessions.family_counts(rows_of(spark, {"protocol": "dns"}, {"protocol": None}, {"protocol": "SIP"}, {"protocol": "RADIUS"})).collect()[0]
    assert (row["dns"], row["radius"], sum(row[b.lower()] for b in sessions.BUCKETS)) == (1, 1, 2)


def test_findings(spark):
    ddl = "capture_id string, message_uid long, protocol string, result_code string, is_failure boolean, command_name string, command_code string, src_ip string, dst_ip string, origin_host string, origin_realm string, destination_realm string"
    realm = "epc.mnc01.mcc262.3gppnetwork.org"
    rows = spark.createDataFrame([
        ("c", 1, "DIAMETER", "5550", True, "ULR", "316", "a", "b", "hss1", None, None), ("c", 2, "DIAMETER", "5999", True, None, "316", "a", "b", "udm1", None, None), ("c", 3, "DIAMETER", "5999", True, None, None, None, None, None, realm, realm.replace("mnc01", "mnc02")),
        ("c", 4, "DIAMETER", "5999", True, None, None, None, None, None, None, None), ("c", 5, "DIAMETER", None, True, None, None, None, None, None, None, None), ("c", 6, "DIAMETER", "2001", False, None, None, None, None, None, None, None), ("c", 7, "DIAMETER", "5999", None, None, None, None, None, None, None, None),
    ], ddl)
    got = {r["message_uid"]: r for r in findings.diameter_findings(rows).collect()}
    assert {k: (r["family"], r["network_side"], r["score"]) for k, r in got.items()} == {1: ("subscriber_absent", True, 100), 2: ("unknown_non_success", True, 60), 3: ("unknown_non_success", False, 70), 4: ("unknown_non_success", False, 60)}
    assert got[2]["fault_domain"].startswith("HSS/HLR") and got[2]["evidence"] == "316 with 5999 from udm1 to b" and got[4]["evidence"] == "an answer with 5999 from ? to ?" and got[4]["title"] == "Diameter code 5999"
    ranked = findings.ranked_findings(findings.diameter_findings(rows), ["capture_id"], 2).orderBy("place").collect()
    assert [(r["place"], r["family"]) for r in ranked] == [(1, "subscriber_absent"), (2, "unknown_non_success")]
    assert ranked[1]["title"] == "Diameter code 5999" and ranked[1]["n"] == 2


def test_advice_covers_every_label(spark):
    from sigweave.operators.rules import RULES

    assert {r[1] for r in RULES} <= set(findings.ADVICE)
    got = {r["rca_label"]: r["title"] for r in findings.with_advice(spark.createDataFrame([("USER_BUSY",), (None,), ("NEW",)], "rca_label string")).collect()}
    assert got == {"USER_BUSY": "Called party busy", None: "Unknown cause", "NEW": "Unknown cause"}


def test_transport_issues_count_each_message_once(spark):
    rows = spark.createDataFrame([("c", "TCP", True, True), ("c", "TCP", False, True), ("c", "TCP", None, True), ("c", "TCP", None, None), ("c", "SIP", True, True), ("d", "TCP", None, None)], "capture_id string, protocol string, reset boolean, retransmission boolean")
    assert [tuple(r) for r in findings.transport_issues(rows, ["capture_id"]).collect()] == [("c", 3, "2 retransmission, 1 reset")]


def test_capture_details(spark):
    frames = lambda capture, *ps: [{"capture_id": capture, "protocol": p, "frame_number": i, "ts": float(i)} for i, p in enumerate(ps)]
    rows = rows_of(spark, *frames("a", "TCP", "TCP", "SIP", "DIAMETER"), *frames("b", "TCP", "SCTP"), *frames("c", None), *frames("d", "NGAP", "S1AP", "S1AP"))
    got = {r["capture_id"]: r for r in analytics.capture_details(rows, rows.where("capture_id = 'a'").select(*KEYS).distinct()).collect()}
    assert {k: (r["trace_type"], r["dominant_protocol"], r["sessions"]) for k, r in got.items()} == {"a": ("IMS call trace", "Diameter", 1), "b": ("Mixed telecom trace", "SCTP", 0), "c": ("Mixed telecom trace", "UNKNOWN", 0), "d": ("Multi-RAT 5G/4G signalling trace", "S1AP", 0)}
    assert got["a"]["top_protocols"] == "TCP,DIAMETER,SIP" and got["c"]["headline"].endswith("unknown technologies")
    assert analytics.capture_details(rows.limit(0), rows.limit(0)).count() == 0


def test_similar_addresses_in_any_spelling(spark):
    from sigweave.functions import fields

    rows = spark.createDataFrame([(1, "2001:db8::1"), (2, "2001:0db8:0:0:0:0:0:2"), (3, "2001:DB8:0:0::9"), (4, "2001:db8:0:1::1"), (5, "::1"), (6, "0:0:0:0:0:0:0:5"), (7, "64:ff9b::1.2.3.4"), (8, "64:ff9b:0:0:0:0:1.2.3.5"), (9, "10.1.2.3"), (10, "11.9.2.3"), (11, "x"), (12, None)], "n int, a string")
    got = {r["n"]: r["key"] for r in rows.select("n", fields.similarity_key("a").alias("key")).collect()}
    assert got[1] == got[2] == got[3] == "6:2001:db8:0:0" and got[4] == "6:2001:db8:0:1" and got[5] == got[6] == "6:0:0:0:0" and got[7] == got[8] and got[9] == got[10] == "4:2.3" and got[11] is got[12] is None


def test_info_texts(spark):
    from sigweave.functions import fields

    rows = spark.createDataFrame([(1, "MAP", "invoke  sendRoutingInfo"), (2, "MAP", "invoke"), (3, "MAP", None), (4, "S1AP", "UE Context Release, SACK (Ack=1, Arwnd=2)"), (5, "NGAP", "DATA, "), (6, "SIP", "a, b")], "n int, p string, x string")
    got = {r["n"]: r["t"] for r in rows.select("n", fields.informative_segment("x", "p").alias("t")).collect()}
    assert got == {1: "MAP sendRoutingInfo", 2: None, 3: None, 4: "UE Context Release", 5: None, 6: "a, b"}


def test_anchors_name_forwarding_tunnels_and_public_identities(spark):
    from sigweave.operators import details

    rows = rows_of(spark, gtp(1, 0.0, "t")).drop("f_teid", "gtp_tid", "gpsi").selectExpr("*", "'f' AS f_teid", "' ' AS gtp_tid", "'msisdn-49' AS gpsi")
    got = [(r["label"], r["value"]) for r in details.anchors(conform(rows), KEYS).orderBy("place").collect()]
    assert got == [("Tunnel ID (TEID)", "t"), ("GTP F-TEID", "f"), ("GPSI", "msisdn-49"), ("IMSI", IMSI), ("Session-ID", "s")]


def test_queue_merges_open_items_by_four_fields(spark):
    from sigweave.operators import learning

    ddl = "session_id string, pattern_id string, hybrid_root_cause string, validation_status string, validation_id string, queued_at string, note string, updated_at int"
    rows = [
        ("s", "p", "C", "pending_review", "v1", "q1", "old", 1), ("s", "p", "C", None, "v2", "q2", "", 2), ("s", "p", "D", None, "v3", None, None, 3), (None, "p", None, None, "v4", None, "a", 4), (None, "p", None, "pending_review", "v5", "q5", "b", 5),
        ("s", "p", "C", "approved", "v6", "q6", "x", 6), ("s", "p", "C", "approved", "v7", "q7", "", 7),
    ]
    got = sorted((r["validation_id"], r["queued_at"], r["note"], r["updated_at"], r["validation_status"]) for r in learning.merge_queue(spark.createDataFrame(rows, ddl)).collect())
    assert got == [("v1", "q1", "old", 2, "pending_review"), ("v3", None, None, 3, "pending_review"), ("v4", "q5", "b", 5, "pending_review"), ("v6", "q6", "x", 6, "approved"), ("v7", "q7", "", 7, "approved")]
    assert learning.merge_queue(spark.createDataFrame([], ddl)).count() == 0


def test_nearest_of_a_block_over_many_broadcasts(spark, monkeypatch):
    from sigweave.operators import learning

    monkeypatch.setattr(learning, "BROADCAST_PATTERNS", 4)
    patterns = spark.createDataFrame([(i, "xy"[i % 5 == 0], [1.0, i / 10]) for i in range(20)] + [(99, None, [1.0, 0.0])], "pattern_id long, label string, embedding array<double>")
    queries = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [1.0, 2.0]), (3, "z", [1.0, 0.0]), (4, None, [1.0, 0.0])], "query_id long, label string, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["pattern_id"]) for r in learning.nearest(queries, patterns, 2, "label").collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 15), (2, 2, 10)]


def test_profile_of_a_suite(spark):
    from sigweave.operators import evaluation

    sessions_ = spark.createDataFrame([("a", "USER_BUSY", ["SIP"], ["IMS"], 10.0), ("a", None, None, None, None), ("b", "X", ["SIP"], ["IMS"], 99.0)], "capture_id string, rca_label string, protocols array<string>, technologies array<string>, duration_ms double")
    cases = spark.createDataFrame([("1", "a"), ("2", None), ("3", "gone")], "case string, capture_id string")
    got = {(r["measure"], r["key"]): r["value"] for r in evaluation.reference_profile(sessions_, cases).collect()}
    assert got == {("sessions", ""): 2.0, ("avg_duration_ms", ""): 10.0, ("label", "USER_BUSY"): 1.0, ("label", "UNKNOWN"): 1.0, ("protocol", "SIP"): 1.0, ("technology", "IMS"): 1.0}
    none = {(r["measure"], r["key"]): r["value"] for r in evaluation.reference_profile(sessions_, cases.limit(0)).collect()}
    assert none == {("sessions", ""): 0.0, ("avg_duration_ms", ""): 0.0}


def test_split_keeps_missing_groups_together(spark):
    from sigweave.operators import models

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 40}") for i in range(200)], "i int, g string")
    train, test = (x.select("g").distinct().collect() for x in models.group_split(rows, "g", 0.3))
    assert not {r["g"] for r in train} & {r["g"] for r in test} and test and len(train) > len(test)
