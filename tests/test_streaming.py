"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from sigweave.operators import models
from sigweave.sources import files
from sigweave.streaming import messages as S


def rows_for(spark):
    rows = [(i, "a" if i % 2 else "b", 1000.0 + t, "SIP", "Attach Request", i % 3 == 0) for i, t in enumerate([0, 5, 20, 35, 36, 80, 600])]
    return spark.createDataFrame(rows, "message_uid long, session_id string, ts double, protocol string, message string, is_failure boolean")


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream_of(spark, df, tmp_path):
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return S.timed(S.source(spark, f"{tmp_path}/in", df.schema))


def test_gap_sessions(spark, tmp_path):
    got = run(spark, S.gap_sessions(stream_of(spark, rows_for(spark), tmp_path), ["protocol"]), "gaps")
    assert sorted(r["messages"] for r in got.where("end < '1970-01-01 00:26:00'").collect()) == [1, 5]


def test_deduplication_and_counts(spark, tmp_path):
    df = rows_for(spark)
    stream = stream_of(spark, df.unionByName(df), tmp_path)
    assert run(spark, S.deduplicated(stream), "dedup").count() == df.count()


def test_failure_counts_and_segments(spark, tmp_path):
    stream = stream_of(spark, rows_for(spark), tmp_path)
    got = run(spark, S.failure_counts(stream), "fails")
    assert {r["failures"] for r in got.collect()} <= {1, 2}
    segments = run(spark, S.procedure_segments(stream), "segs")
    by = {r["message_uid"]: r["segment"] for r in segments.collect()}
    assert len(by) == 7 and by[0] == 0 and by[6] > 0


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "d.csv").write_text('1|"a"| \n2|b|c\n')
    rows = files.scan_decoded(spark, str(tmp_path / "d.csv"), ["frame.number", "x", "y"])
    assert [tuple(r)[:3] for r in rows.orderBy("`frame.number`").collect()] == [("1", "a", None), ("2", "b", "c")]
    assert files.decoded_rows(rows, "c", "SIP").first()["fields"] == {"frame.number": "1", "x": "a"}
    m = files.union_protocols([rows_for(spark).withColumn("capture_id", F.lit("c"))])
    files.save_messages(m, f"{tmp_path}/m")
    assert files.load_messages(spark, f"{tmp_path}/m").count() == 7
    (tmp_path / "f.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert files.load_feedback(spark, str(tmp_path / "f.jsonl"), "a int").count() == 2
    t = spark.createDataFrame([(1,)], "v int")
    files.save_snapshot(t, str(tmp_path / "s"), "p", 1)
    files.save_snapshot(t.withColumn("v", F.lit(5)), str(tmp_path / "s"), "p", 2)
    assert [r["v"] for r in files.load_snapshot(spark, str(tmp_path / "s"), "p", "v int").collect()] == [5]
    assert files.load_snapshot(spark, str(tmp_path / "s"), "none", "v int").count() == 0
    assert files.discover(spark, str(tmp_path), "*.csv").count() == 1


def test_models(spark):
    rows = spark.createDataFrame([(f"g{i % 7}", float(i % 2), float(i % 5), "A" if i % 2 else "B", float(i % 2)) for i in range(60)], "g string, f1 double, f2 double, rca_label string, y double")
    model = models.train_classifier(rows, ["f1", "f2"], trees=5, depth=3)
    scored = models.predict(rows, model, ["f1", "f2"])
    assert scored.where("predicted != rca_label").count() == 0
    assert models.importances(model, ["f1", "f2"])[0][0] == "f1"
    calibrator = models.train_calibrator(rows, "f1", "y")
    assert models.calibrate(rows, calibrator, "f1", "p").agg(F.max("p")).first()[0] <= 0.99
    train, test = models.group_split(rows, "g", 0.3)
    assert not {r[0] for r in train.select("g").distinct().collect()} & {r[0] for r in test.select("g").distinct().collect()}
    assert models.detector_ensemble(rows, ["f1", "f2"]).where("ensemble_score between 0 and 1").count() == 60
