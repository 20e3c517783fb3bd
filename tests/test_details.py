"""Detail rows and feedback on small made-up sessions."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sigweave.operators import details, feedback
from sigweave.schemas import conform

IMSI, OTHER = "262010000000001", "262010000000002"


def test_focus_prefers_abnormal_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("c", "b", "USER_BUSY", 50.0, 90, None), ("c", "a", "USER_BUSY", 50.0, 90, None), ("c", "n", "NORMAL_CALL", 99.0, 99, 1.0), ("d", "u", None, None, None, None)], "capture_id string, session_id string, rca_label string, priority_score double, confidence_pct int, duration_ms double")
    assert {r["capture_id"]: r["session_id"] for r in details.focus_failures(rows, ["capture_id"]).collect()} == {"c": "a", "d": "u"}


def test_networks(spark):
    rows = spark.createDataFrame([("1", IMSI, None), ("2", None, "0171 1234567"), ("3", "310150000000001", "+1 555"), ("4", None, None), ("5", OTHER, None)], "session_id string, imsi string, msisdn string")
    domains = spark.createDataFrame([("5", "262077")], "session_id string, plmn string")
    got = {r["session_id"]: r["network"] for r in details.party_networks(rows, ["session_id"], domains).collect()}
    assert got == {"1": "Deutsche Telekom Germany", "2": "Deutsche Telekom Germany (heuristic)", "3": "Unknown", "4": "Unknown", "5": "PLMN 262-077"}


def test_anchors_begin_with_the_selected_filter(spark):
    rows = conform(spark.createDataFrame([("c", "s", 1.0, 1, "SIP", "call", IMSI), ("c", "s", 2.0, 2, "SIP", "later", IMSI)], "capture_id string, session_id string, ts double, frame_number long, protocol string, call_id string, imsi string"))
    chosen = spark.createDataFrame([("c", "s", "IMSI", IMSI)], "capture_id string, session_id string, label string, value string")
    got = [(r["label"], r["value"]) for r in details.anchors(rows, ["capture_id", "session_id"], chosen).orderBy("place").collect()]
    assert got == [("IMSI", IMSI), ("Call-ID", "call"), ("Session-ID", "s")]


def _record(action, snapshot=True, **over):
    snap = Row(session_id="s", protocols=["SIP"], technologies=["IMS"], duration_ms=1.0, rca_label=over.get("label", "USER_BUSY"), confidence_pct=70.0, raw_confidence_pct=130.0, priority_score=over.get("priority", 40.0), features=Row(**dict.fromkeys(feedback.SNAPSHOT_FEATURES, 1.0)))
    return Row(session_id="s", review_action=action, resolved_root_cause=over.get("resolved"), hybrid_root_cause="H", knowledge_root_cause=None, rule_root_cause=None, session_snapshot=snap if snapshot else None)


RECORD = "session_id string, review_action string, resolved_root_cause string, hybrid_root_cause string, knowledge_root_cause string, rule_root_cause string, session_snapshot struct<session_id: string, protocols: array<string>, technologies: array<string>, duration_ms: double, rca_label: string, confidence_pct: double, raw_confidence_pct: double, priority_score: double, features: struct<" + ", ".join(f"{c}: double" for c in feedback.SNAPSHOT_FEATURES) + ">>"


def test_training_sessions(spark):
    rows = spark.createDataFrame([_record("APPROVE"), _record("reject", resolved="X"), _record(None, label=None, priority=98.0), _record("approve", snapshot=False)], RECORD)
    training = feedback.training_sessions(rows)
    assert sorted((r["rca_label"], r["priority_label"], r["confidence_label"]) for r in training.collect()) == [("H", 98.0, 0), ("USER_BUSY", 40.0, 1), ("X", 82.0, 0)]
    assert sorted(map(tuple, feedback.calibration_rows(training).collect())) == [(1.0, 0), (1.0, 0), (1.0, 1)]


def test_retraining_stops_and_promotes(spark, tmp_path):
    live = str(tmp_path / "ranker")
    few = spark.createDataFrame([_record("approve")], RECORD)
    enough = spark.createDataFrame([_record("approve"), _record("reject"), _record("reject", priority=90.0)], RECORD)
    base = feedback.training_sessions(enough)
    summary = lambda _: spark.createDataFrame([(1.0, 0, 50.0)], "pass_rate double, failed int, abnormal_priority double")
    worse = lambda m: spark.createDataFrame([(1.0 if m is None else 0.5, 0, 50.0)], "pass_rate double, failed int, abnormal_priority double")
    assert feedback.retrain(few, base, summary, live)["reason"] == "insufficient_feedback_samples"
    assert feedback.retrain(enough, base.withColumn("rca_label", F.lit("OTHER")), summary, live)["reason"] == "feedback_drift_exceeds_limit"
    refused = feedback.retrain(enough, base, worse, live)
    assert refused["retrained"] and not refused["promoted"] and feedback.load(spark, live) is None
    assert feedback.retrain(enough, base, summary, live)["promoted"]
    assert feedback.load(spark, live) is not None


@pytest.mark.parametrize("kept", [[], ["NORMAL_CALL"]])
def test_abnormal(spark, kept):
    rows = spark.createDataFrame([(x,) for x in (None, "", "unknown", "NORMAL_END", *kept)], "rca_label string")
    assert rows.where(details.is_abnormal()).count() == 0
