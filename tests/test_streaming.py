"""Streams over the given tables: the same rows as in a batch."""

from pyspark.sql import functions as F

from trackloom.functions.geometry import bin_of
from trackloom.operators import binning, motion
from trackloom.sources.tracks import events_track
from trackloom.streaming import live


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, sf, tmp_path):
    rows = events_track(spark, sf).withColumn("bin", bin_of("x", [0.0, 20.0, 60.0, 1e6])).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(1).sortWithinPartitions("agent", "t").write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_steps(spark, sf, tmp_path):
    rows, stream = source(spark, sf, tmp_path)
    got = {(r.agent, r.t): r.step for r in run(spark, live.live_steps(stream), "steps", "append").collect()}
    want = motion.relative_velocity(rows, "x", ["agent"], "t").select("agent", (F.col("t") + 1).alias("t"), "x_d1").where("x_d1 is not null").collect()
    assert {(r.agent, r.t): r.x_d1 for r in want} == {k: v for k, v in got.items() if v is not None}


def test_moments_and_transitions(spark, sf, tmp_path):
    rows, stream = source(spark, sf, tmp_path)
    r = run(spark, live.live_moments(stream, "x"), "moments", "complete").first()
    assert r.n == rows.where("x is not null").count()
    got = run(spark, live.live_transitions(stream), "moves", "append").groupBy("from_bin", "to_bin").count().collect()
    want = binning.transitions(rows, "bin", ["agent"], "t").collect()
    assert {(r.from_bin, r.to_bin): r["count"] for r in got} == {(r.from_bin, r.to_bin): r.n for r in want}


def test_sessions(spark, sf, tmp_path):
    _, stream = source(spark, sf, tmp_path)
    out = run(spark, live.live_sessions(stream), "live_sessions", "append")
    assert out.count() > 0 and out.where("n < 1").count() == 0
