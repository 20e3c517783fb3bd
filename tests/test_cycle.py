"""Learning cycles: accepted, held, killed and repeated; and streams that go on after a pause."""

import pytest
from pyspark.sql import functions as F

from sigweave.operators import seeds
from sigweave.sources import files
from sigweave.streaming import cycle
from sigweave.streaming import messages as S

SCHEMAS = {"patterns": "word string, n long", "queue": "word string"}


def learn(pending, old):
    rows = pending.sparkSession.read.text([r["path"] for r in pending.collect()])
    counts = rows.groupBy(F.col("value").alias("word")).agg(F.count("*").alias("n")).unionByName(old["patterns"]).groupBy("word").agg(F.sum("n").alias("n"))
    return {"patterns": counts, "queue": counts.where("n = 1").select("word")}


def gate(old, new):
    return ["bad word"] if new["patterns"].where("word = 'bad'").count() else []


def words(spark, root):
    return {r["word"]: r["n"] for r in cycle.load(spark, root, "patterns", SCHEMAS["patterns"]).collect()}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(place, name, *lines):
    (place / "in" / name).write_text("".join(f"{x}\n" for x in lines))
    return (str(place / "in" / name), f"sig-{name}")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, signature string")


def test_accept_hold_and_take_held_files_up_again(spark, place):
    root = str(place / "store")
    a, b, c = put(place, "a", "x", "y"), put(place, "b", "bad"), put(place, "c", "x")
    run = lambda v, *rows: cycle.run_cycle(spark, root, v, frame(spark, *rows), SCHEMAS, learn, gate)
    assert run(0, a) == "accepted" and words(spark, root) == {"x": 1, "y": 1}
    assert run(1, b) == "held" and words(spark, root) == {"x": 1, "y": 1}
    assert run(2, a) == "held"  # nothing new but the held file
    (place / "in" / "b").write_text("good\n")
    assert run(3, c) == "accepted" and words(spark, root) == {"x": 2, "y": 1, "good": 1}
    assert {r["signature"] for r in cycle.manifest(spark, root).collect()} == {"sig-a", "sig-b", "sig-c"}
    assert run(4, a) == "idle" and run(3, c) == "accepted" and words(spark, root) == {"x": 2, "y": 1, "good": 1}


@pytest.mark.parametrize("dies", ["learning", "gate"])
def test_killed_and_repeated_cycle_leaves_the_same_tables(spark, place, dies):
    root = str(place / "store")
    a, b = put(place, "a", "x"), put(place, "b", "x", "z")
    cycle.run_cycle(spark, root, 0, frame(spark, a), SCHEMAS, learn, gate)

    def half(pending, old):
        return learn(pending, old) | {"queue": old["queue"].select(F.raise_error(F.lit("killed")).cast("string").alias("word")).unionByName(pending.select(F.raise_error(F.lit("killed")).cast("string").alias("word")))}

    def broken(old, new):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        cycle.run_cycle(spark, root, 1, frame(spark, b), SCHEMAS, half if dies == "learning" else learn, broken if dies == "gate" else gate)
    assert words(spark, root) == {"x": 1}
    assert cycle.run_cycle(spark, root, 1, frame(spark, b), SCHEMAS, learn, gate) == "accepted"
    assert words(spark, root) == {"x": 2, "z": 1} and {r["word"] for r in cycle.load(spark, root, "queue", SCHEMAS["queue"]).collect()} == {"z"}


def test_watching_a_folder(spark, place):
    root = str(place / "store")
    put(place, "a.txt", "x"), put(place, "b.txt", "y"), put(place, "c.other", "no")
    for _ in range(2):  # a second start finds nothing new
        cycle.watch(cycle.file_stream(spark, str(place / "in"), "*.txt"), root, str(place / "checkpoint"), SCHEMAS, learn, gate).awaitTermination(120)
        assert words(spark, root) == {"x": 1, "y": 1}
    put(place, "d.txt", "x")
    cycle.watch(cycle.file_stream(spark, str(place / "in"), "*.txt"), root, str(place / "checkpoint"), SCHEMAS, learn, gate).awaitTermination(120)
    assert words(spark, root) == {"x": 2, "y": 1}


def test_stream_segments_go_on_after_a_pause(spark, place):
    rows = [(i, "a" if i % 3 else "b", 1000.0 + t, m, i) for i, (t, m) in enumerate([(0, "Attach Request"), (1, "Attach Complete"), (2, "x"), (5, "Attach Request"), (6, "x"), (900, "x"), (905, "Attach Complete"), (3000, "x"), (3003, "Attach Request"), (3010, "x")])]
    df = spark.createDataFrame(rows, "message_uid long, session_id string, ts double, message string, frame_number long")
    for k, part in enumerate(("ts < 1100", "ts between 1100 and 2000", "ts > 2000")):
        df.where(part).coalesce(1).write.parquet(f"{place}/stream/part={k}")
    stream = S.timed(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/stream/part=*"))
    q = S.procedure_segments(stream).writeStream.format("memory").queryName("paused").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["message_uid"]: r["segment"] for r in spark.table("paused").collect()}
    want = {r["message_uid"]: r["segment"] for r in seeds.procedure_segments(df, ["session_id"], least_rows=1).collect()}
    assert got == want and max(want.values()) == 2


def test_optional_tables(spark, place):
    spark.range(3).write.parquet(f"{place}/there")
    assert files.optional(spark, f"{place}/none", "id long").count() == 0
    assert files.optional(spark, f"{place}/none", "id long", fallback=f"{place}/there").count() == 3
    with pytest.raises(Exception):
        files.optional(spark, "nosuchscheme://x/y", "id long")
    (place / "sip.csv").write_text('1|"a"\n')
    found = files.load_collections(spark, {"SIP": f"{place}/sip.csv", "GTP": f"{place}/gtp.csv"}, ["frame.number", "x"], "c")
    assert [(r["protocol"], r["fields"]) for r in found.collect()] == [("SIP", {"frame.number": "1", "x": "a"})]
    assert files.load_collections(spark, {"GTP": f"{place}/gtp.csv"}, ["x"], "c").count() == 0
