"""Trajectory operators on boundary cases: gaps, id changes, wraps, edges, empty bins, ties."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import agents, augment, binning, evaluation, filters, motion, pose, projections, sequences, stats
from trackloom.plans import dataset
from trackloom.plans.stages import Discretize, FeatureFrame, Fusion, Identity, OddRoot, Roll, Stage, Steps, ZScore, replay
from trackloom.sources import tracks


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def series(spark, rows, schema="agent long, t long, x double"):
    return spark.createDataFrame(rows, schema)


def test_angles(spark):
    r = one(spark, g.mod2pi(F.lit(3.2)), g.mod2pi(F.lit(-math.pi)), g.mod2pi(F.lit(math.pi)), g.modrange(F.lit(-1.0), 0, 5))
    assert r.c0 == pytest.approx(3.2 - 2 * math.pi) and r.c1 == pytest.approx(-math.pi) and r.c2 == pytest.approx(-math.pi) and r.c3 == 4


def test_rotation_and_polar_undo(spark):
    x, y = g.rotate(F.lit(1.0), F.lit(2.0), F.lit(0.7))
    a, b = g.rotate(x, y, F.lit(-0.7))
    px, py = g.polar(F.lit(1.0), F.lit(1.0), F.lit(math.pi / 2), F.lit(2.0))
    r = one(spark, a, b, px, py)
    assert (r.c0, r.c1, r.c2, r.c3) == pytest.approx((1, 2, 1, 3))


def test_dct_is_orthonormal(spark):
    values = [1.0, -2.0, 0.5, 4.0]
    r = one(spark, *g.idct(g.dct([F.lit(v) for v in values])))
    assert list(r) == pytest.approx(values)
    rows = np.array(g.dct_rows(7))
    assert np.allclose(rows @ rows.T, np.eye(7))


def test_scalings(spark):
    r = one(spark, g.zscore(F.lit(3.0), 1.0, 0.0), g.odd_power(g.odd_root(F.lit(-5.0))), g.clip(F.lit(None).cast("double"), 0.0, 1.0), g.signed_square(g.signed_sqrt(F.lit(-2.25), 9.0)), g.cos_sin_to_angle(F.lit(0.0), F.lit(1e-9)))
    assert r.c0 is None and r.c1 == pytest.approx(-5) and r.c2 is None and r.c3 == pytest.approx(-2.25) and r.c4 == 0


def test_circle_line(spark):
    f, b = g.circle_line(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), 3.0)
    miss, _ = g.circle_line(F.lit(0.0), F.lit(9.0), F.lit(1.0), F.lit(0.0), 3.0)
    r = one(spark, f, b, miss, *g.ellipse(F.lit(4.0), F.lit(0.0), F.lit(1.0), 1.0))
    assert (r.c0, r.c1, r.c2) == (2, -4, None) and (r.c3, r.c4, r.c5) == pytest.approx((2, 1, 0))


def test_bins_on_edges(spark):
    xs = [-1.0, 0.0, 0.5, 1.0, 2.0, 9.0, None]
    rows = series(spark, [(0, i, x) for i, x in enumerate(xs)])
    assert [r.b for r in rows.orderBy("t").select(g.bin_of("x", [0.0, 1.0, 2.0]).alias("b")).collect()] == [0, 0, 0, 1, 1, 1, None]
    assert rows.where("x is null").select(g.bin_of("x", [0.0, 1.0, 2.0], True).alias("b")).first().b == 1


def test_starts_and_sessions(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 5, 2), (0, 6, 3), (1, 0, 9)], "agent int, t long, id int")
    flags = {(r.agent, r.t): r.isstart for r in sequences.start_flags(rows, id="id").collect()}
    assert flags == {(0, 0): True, (0, 1): False, (0, 2): True, (0, 5): True, (0, 6): True, (1, 0): True}


@pytest.mark.parametrize("n, want", [(3, 0), (4, 1), (5, 1), (8, 2)])
def test_chunks_by_length(spark, n, want):
    rows = series(spark, [(0, t, float(t)) for t in range(n)]).withColumn("isstart", F.col("t") == 0).withColumn("mask", F.col("t") == 1)
    s = sequences.sessions(rows, F.col("x").isNotNull())
    assert sequences.chunks(s, 4).count() == want
    within = sequences.session_rows(rows, F.col("x").isNotNull())
    assert sequences.chunk_examples(within, ["x"], 4).count() == want
    assert sequences.chunk_examples(within, ["x"], 4, mask="mask").count() == min(want, 1)
    assert sequences.sliding_windows(s, 4).count() == max(0, n - 3)


def test_missing_value_splits_session(spark):
    rows = series(spark, [(0, t, None if t == 3 else 1.0) for t in range(7)] + [(1, t, None) for t in range(3)]).withColumn("isstart", F.col("t") == 0)
    assert sorted(map(tuple, sequences.sessions(rows, F.col("x").isNotNull()).collect())) == [(0, 0, 3), (0, 4, 3)]


def test_spaced_chunks_equal_a_scan(spark):
    rng = np.random.default_rng(3)
    n, length, npad = 400, 5, 2
    valid, start = rng.random(n) > 0.06, rng.random(n) < 0.04
    start[0] = True
    rows = spark.createDataFrame([(0, t, bool(valid[t]), bool(start[t])) for t in range(n)], "agent int, t long, ok boolean, isstart boolean")
    got = sorted(r.t0 for r in sequences.spaced_chunks(rows, F.col("ok"), length, npad).collect())
    can = [t + length + npad <= n and valid[t : t + length + npad].all() and not start[t + 1 : t + length + npad].any() for t in range(n)]
    want, t = [], 0
    while t < n:
        if can[t]:
            want.append(t)
            nxt = t + length
            if nxt < n and can[nxt] and all(can[t : nxt + 1]):
                t = nxt
                continue
            t += 1
            while t < n and can[t] and all(can[want[-1] : t + 1]):
                t += 1
        else:
            t += 1
    assert got == want


def test_turns_may_exceed_half_a_turn(spark):
    rows = series(spark, [(0, 0, 3.1), (0, 1, -3.1), (0, 2, -1.0), (0, 3, 1.0), (0, 4, 3.0)])
    out = motion.relative_velocity(rows, "x", ["agent"], "t", [1, 4], True).orderBy("t").collect()
    assert out[0].x_d1 == pytest.approx(2 * math.pi - 6.2) and out[0].x_d4 == pytest.approx(2 * math.pi - 6.2 + 6.1) and out[0].x_d4 > math.pi and out[1].x_d4 is None


def test_gap_stops_look_ahead(spark):
    rows = series(spark, [(0, 0, 1.0), (0, 1, 2.0), (0, 3, 9.0)])
    assert [r.x_d1 for r in motion.relative_velocity(rows, "x", ["agent"], "t").orderBy("t").collect()] == [1.0, None, None]


def test_outputs_do_not_depend_on_later_rows(spark):
    rows = series(spark, [(0, t, float(t * t)) for t in range(20)])
    later = rows.withColumn("x", F.when(F.col("t") >= 12, 0.0).otherwise(F.col("x")))
    a, b = (motion.aligned_inputs(d, "x", ["agent"], "t").where("t < 12").orderBy("t").collect() for d in (rows, later))
    assert a == b


def test_roll_both_ways(spark):
    rows = series(spark, [(0, t, float(t)) for t in range(5)])
    assert [r.rolled for r in motion.roll(rows, "x", 2, ["agent"], "t", True).orderBy("t").collect()] == [3, 4, 0, 1, 2]
    assert [r.rolled for r in motion.roll(rows, "x", -1, ["agent"], "t").orderBy("t").collect()] == [1, 2, 3, 4, None]


def test_stages_fit_write_read_undo(spark):
    rows = series(spark, [(0, t, float(t % 5) - 2) for t in range(40)])
    frame = FeatureFrame(rows).then(Identity("first")).then(Steps(column="x", keys=["agent"], t="t")).then(Fusion(parts=[[["x"], ZScore("z", columns=["x"]).to_dict()], [["x_step"], OddRoot("r", columns=["x_step"]).to_dict()]]))
    assert frame.find("z").params["stats"]["x"][1] > 0 and [s.name for s in frame.after("first")] == ["steps", "fusion"] and frame.before("steps")[0].name == "first"
    again = replay(rows, frame.to_json())
    assert json.loads(frame.to_json())[2]["kind"] == "fusion"
    assert [r.x for r in again.invert_to().df.orderBy("t").collect()] == pytest.approx([r.x for r in rows.orderBy("t").collect()])
    with pytest.raises(ValueError):
        Stage.from_dict({"kind": "os.system", "name": "x", "params": {}})
    with pytest.raises(ValueError):
        Fusion(parts=[[["x"], Identity().to_dict()], [["x"], Identity().to_dict()]]).apply(rows)
    binned = FeatureFrame(rows).then(Discretize(column="x", bins=5))
    assert {r.x for r in binned.invert_to().df.collect()} == {-2, -1, 0, 1, 2}
    rolled = Roll(column="x", dt=3, keys=["agent"], t="t", circular=True)
    assert [r.x for r in rolled.invert(rolled.apply(rows)).orderBy("t").collect()] == [r.x for r in rows.orderBy("t").collect()]


def test_merged_statistics(spark):
    rows = series(spark, [(i % 3, i, float(i * i % 17)) for i in range(100)] + [(9, 0, None)])
    merged = stats.merge_moments(stats.moments(rows, ["x"], ["agent"]), []).first()
    xs = np.array([float(i * i % 17) for i in range(100)])
    assert merged.n == 100 and merged["mean"] == pytest.approx(xs.mean()) and merged.sd == pytest.approx(xs.std())


def test_constant_feature_has_no_zscore(spark):
    rows = series(spark, [(0, t, 4.0) for t in range(5)])
    assert {r.x for r in FeatureFrame(rows).then(ZScore(columns=["x"])).df.collect()} == {None}


def test_soft_bins_sum_to_one_and_invert(spark):
    edges = [0.0, 1.0, 3.0, 4.0]
    rows = series(spark, [(0, i, x) for i, x in enumerate([-5.0, 0.0, 0.5, 0.9, 2.0, 2.9, 4.0, 9.0])])
    soft = binning.soft_bins(rows, "x", edges)
    assert {round(r.w, 9) for r in soft.groupBy("t").agg(F.sum("weight").alias("w")).collect()} == {1.0}
    by_t = {r.t: {} for r in soft.collect()}
    for r in soft.collect():
        by_t[r.t][r.bin] = r.weight
    assert by_t[2] == {0: 1.0} and by_t[4] == {1: 1.0} and by_t[0] == {0: 1.0} and by_t[3] == pytest.approx({0: 0.6, 1: 0.4})
    empty = binning.bin_statistics(rows.where("x > 3"), "x", edges).where("bin = 0").first()
    assert (empty.n, empty["mean"], empty.median) == (0, 0.5, 0.5)
    draws = binning.sample_bins(soft, ["t"], binning.bin_samples(rows, "x", edges, 4, ["t"]), 4)
    assert all(r.bin in by_t[r.t] and r.value is not None for r in draws.collect())


def test_optimal_edges_find_two_states(spark):
    rng = np.random.default_rng(0)
    x, rows = 0, []
    for t in range(3000):
        x = x if rng.random() < 0.95 else 1 - x
        rows.append((0, t, float(x * 7 + rng.random() * (3 if x else 7))))
    edges = binning.optimal_edges(series(spark, rows), "x", ["agent"], "t", 2, 100)
    assert edges[1] == pytest.approx(7, abs=0.2)


def test_minimum_width(spark):
    rows = series(spark, [(0, t, float(t % 100)) for t in range(500)])
    for width in (0.0, 3.0, 50.0):
        edges = binning.minimum_width_edges(rows, "x", 5, width)
        assert len(edges) == 6 and all(b - a >= min(width, (edges[-1] - edges[0]) / 5) - 1e-9 for a, b in zip(edges, edges[1:]))


def kp_rows(spark, points, agent=0, t=0):
    return spark.createDataFrame([(agent, t, agent, [(float(x), float(y)) for x, y in points])], "agent int, t long, id int, kp array<struct<x: double, y: double>>")


def fly(shift=(0.0, 0.0), turn=0.0):
    """A symmetric body whose derived lengths agree with its own sizes."""
    p = {"left_front_thorax": (0.5, 0), "right_front_thorax": (-0.5, 0), "base_thorax": (0, -1), "tip_abdomen": (0.1, -2.5), "left_eye": (0.4, 0.5), "right_eye": (-0.4, 0.5), "antennae_midpoint": (0, 0.8), "wing_left": (0.6, -3), "wing_right": (-0.6, -3)}
    for side, s in (("left", 1), ("right", -1)):
        p |= {f"{side}_middle_femur_base": (0.5 * s, -0.5), f"{side}_middle_femur_tibia_joint": (1.0 * s, -0.3), f"{side}_middle_leg_tip": (1.5 * s, -1), f"{side}_front_leg_tip": (0.8 * s, 0.9), f"{side}_back_leg_tip": (0.9 * s, -2)}
    c, s = math.cos(turn), math.sin(turn)
    return [(x * c - y * s + shift[0], x * s + y * c + shift[1]) for x, y in (p[n] for n in pose.KEYPOINTS)]


def test_pose_round_trip(spark):
    points = fly((3, -4), 2.0)
    kp = kp_rows(spark, points)
    sizes = pose.scales(kp)
    back = pose.keypoints(pose.pose_features(kp, sizes).drop("kp"), sizes).first().kp
    worst = {n: math.hypot(b.x - x, b.y - y) for n, b, (x, y) in zip(pose.KEYPOINTS, back, points)}
    assert max(worst.values()) < 0.02, worst
    assert len(pose.POSE) == 29


def test_flip_twice_is_identity(spark):
    kp = kp_rows(spark, fly((2, 1), 0.4))
    twice = pose.flip(pose.flip(kp, centre=3.0), centre=3.0).first().kp
    assert [c for p in twice for c in p] == pytest.approx([c for p in kp.first().kp for c in p])
    assert [pose.flip_order()[i] for i in pose.flip_order()] == list(range(19))


def test_vision_behind_alone_and_close(spark):
    me = kp_rows(spark, fly())
    assert agents.vision(me, ["t"]).where("value <> 0").count() == 0
    behind = me.unionByName(kp_rows(spark, fly((0, -12)), 1))
    seen = sorted(r.sector for r in agents.vision(behind, ["t"]).where("agent = 0 and value > 0").collect())
    assert seen and 0 in seen and 71 in seen and 36 not in seen


def test_touch_needs_another_agent(spark):
    both = kp_rows(spark, fly()).unionByName(kp_rows(spark, fly((3, 0)), 1))
    rows = both.unionByName(kp_rows(spark, fly(), 2, 1))
    assert agents.touch(rows, ["t"]).groupBy("t", "agent").count().orderBy("agent").select("agent", "count").collect() == [(0, 95), (1, 95)]


def test_wall_heights(spark):
    kp = kp_rows(spark, [(17.5, 0), (agents.ARENA_RADIUS, 0), (40, 0), (0, 0)])
    assert agents.wall_touch(kp).first().wall == pytest.approx([3.5, 0, 0, 3.5])


def test_percentiles_of_a_whole_table_pass_through_no_single_task(spark):
    xs = [float((i * 7919) % 1009) - 300 for i in range(2000)]
    rows = series(spark, [(0, i, x) for i, x in enumerate([*xs, None])])
    probs = [0.0, 0.25, 0.5, 1.0]
    q = stats.percentiles(rows, "x", probs)
    assert "percentile" not in q._jdf.queryExecution().executedPlan().toString().lower()
    assert q.first().q == pytest.approx(list(np.quantile(xs, probs)))
    assert stats.percentiles(rows.where("x is null"), "x", probs).first().q is None
    tails = stats.tail_percentiles(rows, "x", [0.5]).first()
    assert (tails.up, tails.down) == ([np.median([x for x in xs if x >= 0])], [np.median([x for x in xs if x <= 0])])
    angles = rows.withColumn("x", F.col("x") / 1000)
    whole, one = stats.circular(angles, "x", [0.1, 0.9]).first(), stats.circular(angles, "x", [0.1, 0.9], ["agent"]).first()
    assert whole.q == pytest.approx(one.q) and (whole.n, whole.mean, whole.sd) == (one.n, pytest.approx(one["mean"]), pytest.approx(one.sd))
    moved = stats.rms_difference(rows, rows.withColumn("x", F.col("x") * 2), ["agent", "t"], ["x"], 0.5).first()
    assert moved.scale == np.median(np.abs(xs))


def test_category_predicates(spark):
    rows = spark.createDataFrame([(1, 0), (0, 1), (None, 1)], "female int, courtship int")
    value = {c: F.col(c) for c in ("female", "courtship")}
    assert [r.m for r in rows.select(filters.category_mask(["male", "courtship==1"], value).alias("m")).collect()] == [False, True, False]
    with pytest.raises(ValueError):
        filters.category_mask(["a=b"], value)


def test_masks(spark):
    rows = spark.range(400).select((F.col("id") / 8).cast("long").alias("c"), (F.col("id") % 8).alias("pos"), F.lit(1.0).alias("x"))
    for masked in (augment.block_mask(rows, ["c"], "pos", 8, 3), augment.row_mask(rows, ["c"], "pos", 0.1)):
        assert masked.groupBy("c").agg(F.count_if("mask").alias("n")).where("n < 1").count() == 0
    assert augment.apply_mask(augment.last_mask(rows, "pos", 8), ["x"]).agg(F.sum("x")).first()[0] == 350


def test_noise_is_taken_back(spark):
    rows = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(2.0).alias("dx"))
    out = augment.compensated_noise(rows, ["x"], {"x": "dx"}, 0.5, 0.5, ["id"]).collect()
    assert all(r.x + r.dx == pytest.approx(r.id + 2) for r in out) and 5 < sum(r.dx != 2 for r in out) < 45


def test_table_comparison(spark):
    a = series(spark, [(0, 0, 1.0), (0, 1, 2.0), (0, 2, None)])
    b = series(spark, [(0, 1, 2.5), (0, 2, 3.0), (0, 3, 4.0)])
    r = evaluation.compare_tables(a, b, ["agent", "t"], ["x"], 0.1).first()
    assert (r.only_left, r.only_right, r.null_mismatch, r.largest, r.within) == (1, 1, 1, 0.5, False)


def test_transition_matrices(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 0, 1), (2, 0, 0), (2, 5, 1)], "agent int, t long, bin int")
    out = sorted(map(tuple, binning.transitions(rows, "bin", ["agent"], "t").collect()))
    assert out == [(1, 0, 1, 0.5), (1, 1, 1, 0.5)]


def test_archive_ingest(spark, tmp_path):
    x = np.arange(2 * 2 * 3 * 2, dtype=float).reshape(2, 2, 3, 2)
    x[0, 0, 0, 0] = np.nan
    raw = io.BytesIO()
    np.savez(raw, X=x, videoidx=np.zeros((3, 1), int), ids=np.array([[1, -1], [1, 2], [1, 2]]), frames=np.arange(3)[:, None], y=np.ones((1, 3, 2)), categories=np.array(["female"]))
    (tmp_path / "a.npz").write_bytes(raw.getvalue())
    rows = tracks.read_archives(spark, str(tmp_path / "a.npz")).orderBy("agent", "t").collect()
    assert [(r.agent, r.t, r.id) for r in rows] == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 1, 1), (1, 2, 1)]
    assert rows[0].kp[0].x is None and rows[0].kp[0].y == x[0, 1, 0, 0] and rows[0].y == {"female": 1}
    tracks.write_tracks(tracks.read_archives(spark, str(tmp_path / "a.npz")), str(tmp_path / "out"))
    assert tracks.load_tracks(spark, str(tmp_path / "out"), ["t", "id"]).count() == 5


def test_training_data_parameters_are_reused(spark):
    rows = series(spark, [(a, t, float((t * (a + 3)) % 11)) for a in range(3) for t in range(40)]).withColumn("isstart", F.col("t") == 0)
    chunks, frame = dataset.build_dataset(rows.where("agent < 2"), "x", F.col("x").isNotNull(), 8, 4)
    again, used = dataset.build_dataset(rows.where("agent = 2"), "x", F.col("x").isNotNull(), 8, fitted=frame)
    assert chunks.count() == 2 * 4 and again.count() == 4 and used.to_json() == frame.to_json()
    assert dataset.map_chunks(chunks, lambda b: b[["agent"]].assign(n=b["rows"].map(len)), "agent long, n long").agg(F.min("n")).first()[0] == 8


def test_labels_are_binned_as_they_are(spark):
    rows = series(spark, [(a, t, (t * t * (a + 3) % 101) / 100) for a in range(3) for t in range(60)]).withColumn("isstart", F.col("t") == 0)
    chunks, frame = dataset.build_dataset(rows, "x", F.col("x").isNotNull(), 6, 5)
    labels = sorted(r.raw_label for r in frame.df.collect())
    edges = frame.find("discretize").params["edges"]
    assert edges[0] == labels[0] and edges[-1] == labels[-1] and edges == pytest.approx(list(np.quantile(labels, [i / 5 for i in range(6)])))
    found = chunks.select(F.inline("rows")).collect()
    assert found and [r.label_bin for r in found] == [min(max(sum(e <= r.raw_label for e in edges) - 1, 0), 4) for r in found]
    assert sorted({round(r.label, 12) for r in frame.invert_to().df.collect()}) == pytest.approx(frame.find("discretize").params["means"])


def test_a_constant_label_has_one_bin(spark):
    rows = series(spark, [(0, t, 4.0) for t in range(12)]).withColumn("isstart", F.col("t") == 0)
    chunks, _ = dataset.build_dataset(rows, "x", F.col("x").isNotNull(), 5)
    assert [(r.x, r.input, r.label_bin, r.raw_label) for r in chunks.select(F.inline("rows")).collect()] == [(None, None, 0, 0.0)] * 10


def test_blocks_and_areas(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    joined = projections.blocks_together(["k"], {"in": a, "out": a.withColumn("x", F.lit(3.0))})
    assert joined.columns == ["k", "in_x", "out_x"] and projections.block(joined, ["k"], "out").first().x == 3
    marked = projections.mark_discrete(joined, "in_x", "x")
    assert [d.columns for d in projections.split_discrete(marked, ["k"])] == [["k", "in_x"], ["k", "out_x"]]
    square = kp_rows(spark, [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])
    assert projections.hull_area(square).first().area == 4
    assert projections.map_arrays(spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("v")), ["v"], lambda x: x * 2).first().v == [2, 4]


def test_holdout_and_subsample(spark):
    seqs = spark.range(200).select("id", (F.col("id") % 3).alias("w"))
    held = stats.weighted_holdout(seqs, "id", "w", 20).where("held_out").collect()
    assert len(held) == 20 and all(r.w > 0 for r in held)
    chosen = sequences.subsample_sequences(seqs.withColumn("n", F.lit(10)), "id", "n", 95).collect()
    assert len(chosen) == 10
