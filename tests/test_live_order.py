"""Streams in several micro-batches, rows out of order and late, against the batch form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from trackloom.operators import binning
from trackloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def track(seed=1):
    """(agent, t, ts, bin): three agents with gaps of t and of time."""
    rng = random.Random(seed)
    rows = []
    for agent in range(3):
        t, at = 0, T0 + dt.timedelta(minutes=rng.randrange(60))
        for _ in range(60):
            t += rng.choice([1, 1, 1, 1, 1, 2])
            at += dt.timedelta(minutes=rng.choice([10, 20, 40])) if rng.random() > 0.06 else dt.timedelta(hours=15)
            rows.append((agent, t, at, rng.randrange(3)))
    return rows


def run(spark, tmp_path, name, rows, make):
    """Rows in batches of arrival; in each, rows are in no order, and some come a batch later than their neighbours."""
    rng = random.Random(7)
    arrivals = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.choice([0, 0, 0, 180])))
    far = [(99, 0, T0 + dt.timedelta(days=400), 0), (99, 1, T0 + dt.timedelta(days=800), 0)]
    # the last two batches move the watermark past everything
    batches = [arrivals[i : i + 25] for i in range(0, len(arrivals), 25)] + [[far[0]], [far[1]]]
    schema = "agent int, t long, ts timestamp, bin int"
    for i, b in enumerate(batches):
        rng.shuffle(b)
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert len(q.recentProgress) >= len(batches)
    return spark.table(name).where("agent < 99").collect()


def test_flags_of_rows_out_of_order(spark, tmp_path):
    rows = track()
    got = run(spark, tmp_path, "flags", rows, lambda s: live.live_flags(s, late="6 hours"))
    want, last, session = [], {}, {}
    for agent, t, ts, _ in sorted(rows):
        start = agent not in last or t != last[agent][0] + 1 or ts - last[agent][1] > dt.timedelta(hours=12)
        session[agent] = t if start else session[agent]
        last[agent] = (t, ts)
        want.append((agent, t, ts, start, session[agent]))
    assert sorted(tuple(r) for r in got) == want
    assert sum(r[3] for r in want) > 10


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [(0, t, T0 + dt.timedelta(hours=t), 0) for t in range(60)]
    late = (0, 5, T0 + dt.timedelta(hours=5), 1)
    schema = "agent int, t long, ts timestamp, bin int"
    for i, b in enumerate(([r for r in rows[:40] if r != late and r[1] != 5], rows[40:], [late], [(99, 0, T0 + dt.timedelta(days=400), 0)], [(99, 1, T0 + dt.timedelta(days=800), 0)])):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.live_flags(stream, late="2 hours").writeStream.format("memory").queryName("behind").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table("behind").where("agent = 0").collect()
    assert sorted(r.t for r in got) == [t for t in range(60) if t != 5]
    assert {r.t for r in got if r.isstart} == {0, 6}
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1
    # the agent's state has gone with its silence
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_tumbling_transitions_are_those_of_each_window(spark, tmp_path):
    rows = track(3)
    got = run(spark, tmp_path, "tumbling", rows, lambda s: live.tumbling_transitions(s, "6 hours", late="6 hours"))
    found = {}
    for r in got:
        k = (r.window, r.from_bin, r.to_bin)
        found[k] = found.get(k, 0) + r.n
    want, before = {}, {}
    for agent, t, ts, b in sorted(rows):
        if agent in before and before[agent][0] + 1 == t:
            start = T0 + (ts - T0) // dt.timedelta(hours=6) * dt.timedelta(hours=6)
            k = (start, before[agent][1], b)
            want[k] = want.get(k, 0) + 1
        before[agent] = (t, b)
    assert found == want
    whole = binning.transitions(spark.createDataFrame(rows, "agent int, t long, ts timestamp, bin int"), "bin", ["agent"], "t").agg(F.sum("n")).first()[0]
    assert sum(want.values()) == whole
