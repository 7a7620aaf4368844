import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from voxquarry.streaming import pool as P
from voxquarry.streaming import turns as S


def run(spark, tmp_path, batches, schema, build, out):
    """Feeds batches of rows as files, one micro-batch each, and returns what the query emits."""
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
        for f in glob.glob(f"{src}/b{i}/*.parquet"):  # files are taken in order of their times
            os.utime(f, (1_000_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = build(stream).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(out).collect()


def test_turns(spark, tmp_path):
    schema = "session string, seq long, kind string, text string"
    batches = [
        [("a", 0, "start", None), ("a", 1, "interim", "he"), ("a", 2, "final", "hello"), ("b", 0, "interim", "wai")],
        [("a", 3, "final", "there"), ("a", 4, "complete", None), ("b", 1, "complete", None), ("a", 5, "interim", "x"), ("a", 6, "start", None)],
        [("a", 7, "final", "bye"), ("a", 8, "complete", None)],
    ]
    got = run(spark, tmp_path, batches, schema, S.assemble_turns, "turns_out")
    assert sorted(map(tuple, got)) == [("a", 0, "hello there", False), ("a", 1, "bye", False), ("b", 0, "wai", True)]


def test_decode_state(spark, tmp_path):
    schema = "utt string, seq long, token long, last boolean"
    batches = [[("u", i, i, False) for i in range(5)], [("u", 5, 5, False), ("v", 0, 7, True)], [("u", 6, 6, True)]]
    got = run(spark, tmp_path, batches, schema, lambda s: S.decode_streams(s, 3, lambda p: [int(p["token"].sum())]), "decode_out")
    assert sorted(map(tuple, got)) == [("u", 7, "3 12 6"), ("v", 1, "7")]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, value double"
    sec = lambda s: spark.sql(f"SELECT timestamp_seconds({s})").first()[0]
    batches = [[(sec(0), 1.0), (sec(30), 2.0)], [(sec(600), 1.0)], [(sec(700), 1.0)], [(sec(5), 9.0), (sec(1300), 1.0)], [(sec(3000), 1.0)]]
    got = run(spark, tmp_path, batches, schema, lambda s: S.tumbling(s, "ts", "1 minute", "2 minutes").select(F.unix_seconds("window.start").alias("at"), "n", "total"), "late_out")
    assert {r["at"]: (r["n"], r["total"]) for r in got}[0] == (2, 3.0)


def test_quarantine(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(6).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    S.quarantine(stream, str(tmp_path / "good"), str(tmp_path / "bad"), F.col("id") % 3 != 0, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [0, 3]


def model():
    """A function that gives a token for each window, which depends on what the stream has seen: sums stand for a model."""
    return lambda windows, states: ([[round(sum(x for x in w if x >= 0) + 100 * s[0])] for w, s in zip(windows, states, strict=True)], [[s[0] + 1] for s in states])


def alone(frames, chunk, overlap, tail):
    """The tokens of one utterance that is decoded by itself."""
    x, out, state = [*frames, *[P.SILENCE] * (overlap + tail)], [], [0.0]
    for at in range(0, len(x), chunk):
        tokens, states = model()([x[at : at + chunk + overlap]], [state])
        out, state = out + tokens[0], states[0]
    return " ".join(map(str, out))


@pytest.mark.parametrize("active", [1, 2, 5])
def test_pool_equals_single_decoding_and_keeps_its_bound(spark, tmp_path, active):
    rng = random.Random(active)
    utts = {f"u{i}": (i % 2, i, [float(rng.randrange(9)) for _ in range(rng.randrange(20))]) for i in range(14)}
    schema = "lane long, num long, utt string, frames array<double>"
    rows = [(lane, n, u, f) for u, (lane, n, f) in utts.items()]
    batches = [rows[:5][::-1], rows[5:6], rows[6:], [(0, None, None, None), (1, None, None, None)]]
    with P.with_rocksdb(spark):
        got = run(spark, tmp_path, batches, schema, lambda s: P.decode_pool(s, active, 4, model(), [0.0], overlap=2, tail=3), f"pool_{active}")
    assert sorted(r["utt"] for r in got) == sorted(utts)
    for r in got:
        lane, _, frames = utts[r["utt"]]
        assert (r["lane"], r["frames"], r["hyp"]) == (lane, len(frames), alone(frames, 4, 2, 3)) and r["chunks"] == r["end"] - r["begin"] == len(r["hyp"].split())
    for lane in (0, 1):
        own = [r for r in got if r["lane"] == lane]
        most = max(sum(r["begin"] <= t < r["end"] for r in own) for t in range(max(r["end"] for r in own)))
        assert most == min(active, 7)
        begun = [r["begin"] for r in sorted(own, key=lambda r: utts[r["utt"]][1])]
        assert begun == sorted(begun)  # admitted in order


def test_an_idle_lane_is_drained(spark, tmp_path):
    schema = "lane long, num long, utt string, frames array<double>"
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, "a", [1.0, 2.0])], schema).coalesce(1).write.parquet(src)
    with P.with_rocksdb(spark):
        stream = P.decode_pool(spark.readStream.schema(schema).parquet(src), 4, 2, model(), [0.0], overlap=0, tail=0, idle_ms=1500)
        q = stream.writeStream.format("memory").queryName("idle_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("idle_out").count():
                break
            time.sleep(0.5)
        assert [(r["utt"], r["hyp"]) for r in spark.table("idle_out").collect()] == [("a", "3")]
    finally:
        q.stop()
