"""Dataset assembly, exact ranks, joint edges and the way back, against brute force and round trips."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import agents, binning, motion, pose, ranks
from trackloom.plans import assembly
from trackloom.plans.stages import FeatureFrame, Stage
from trackloom.plans.vectors import VectorBins, VectorSplit, VectorZScore
from trackloom.sources import tracks


@pytest.fixture(scope="module")
def kp(spark, sf):
    return tracks.embedding_keypoints(spark, sf).persist()


@pytest.fixture(scope="module")
def sizes(kp):
    return pose.scales(kp).persist()


@pytest.fixture(scope="module")
def rows(kp, sizes):
    return assembly.feature_rows(kp, sizes, (F.col("agent") * 31 + F.col("t")) % 23 != 5).persist()


@pytest.fixture(scope="module")
def made(rows):
    return assembly.assemble(rows, 6, bins=4, widths={"turn": 0.05})


# ---- ranks and edges


@pytest.mark.parametrize(("cells", "hold"), [(256, 100_000), (4, 3), (16, 1)])
def test_exact_percentiles(spark, monkeypatch, cells, hold):
    monkeypatch.setattr(ranks, "CELLS", cells)
    monkeypatch.setattr(ranks, "HOLD", hold)
    rng = random.Random(3)
    data = {"even": [rng.random() for _ in range(200)], "ties": [1.0] * 150 + [2.0, 2.0, -7.5], "one": [4.25], "wide": [10.0 ** rng.randrange(-200, 200) for _ in range(60)] + [-1e300]}
    long = [(k, float(v)) for k, vs in data.items() for v in vs] + [("even", None), ("ties", float("nan"))]
    rng.shuffle(long)
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    found = ranks.exact_percentiles(spark.createDataFrame(long, "key string, x double"), probs)
    assert set(found) == set(data)
    for k, vs in data.items():
        assert np.allclose(found[k], np.quantile(vs, probs), rtol=1e-12, atol=0)


def test_percentiles_stay_between_their_two_values(spark):
    rng = random.Random(5)
    data = {}
    for k in range(40):
        a = rng.uniform(-3, 3)
        data[k] = [a] * rng.randrange(2, 60) + [math.nextafter(a, 9.0)] * rng.randrange(2, 60) * (k % 2)
    long = [(k, v) for k, vs in data.items() for v in vs]
    probs = [i / 10 for i in range(11)]
    for k, found in ranks.exact_percentiles(spark.createDataFrame(long, "key long, x double"), probs).items():
        at = [p * (len(data[k]) - 1) for p in probs]
        assert all(data[k][math.floor(x)] <= q <= data[k][math.ceil(x)] for q, x in zip(found, at))


def test_exact_percentiles_of_nothing(spark):
    assert ranks.exact_percentiles(spark.createDataFrame([("a", None)], "key string, x double"), [0.5]) == {}


def brute_merge(counts, n, k):
    cells, edges = [counts.get(i, 0) for i in range(n)], list(range(n + 1))
    while len(cells) > k:
        i = min(range(len(cells) - 1), key=lambda j: cells[j] + cells[j + 1])
        cells[i : i + 2] = [cells[i] + cells[i + 1]]
        del edges[i + 1]
    return edges


def test_merged_cells_against_brute_force():
    rng = random.Random(4)
    for _ in range(800):
        n = rng.randrange(1, 40)
        counts = {i: rng.randrange(1, 5) for i in range(n) if rng.random() < rng.choice([0.1, 0.5, 0.9])}
        k = rng.randrange(1, n + 3)
        assert binning.merged_cells(counts, n, k) == brute_merge(counts, n, k), (counts, n, k)


def test_as_many_merged_cells_as_may_come():
    rng = random.Random(5)
    counts = {rng.randrange(10**9): rng.randrange(1, 1000) for _ in range(binning.MAX_CELLS)}
    edges = binning.merged_cells(counts, 10**9, 25)
    assert len(edges) == 26 and edges[0] == 0 and edges[-1] == 10**9 and edges == sorted(edges)


def test_joint_edges_take_each_rule(spark):
    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1), rng.gauss(5, 2), rng.random(), 3.0 if i % 2 else None]) for i in range(400)]
    df = spark.createDataFrame(data, "i int, v array<double>")
    edges = binning.joint_edges(df, "v", 5, [0.0, 0.4, 0.9, 0.0], outlier=0.0)
    columns = [[r[k] for _, r in data if r[k] is not None] for k in range(4)]
    assert np.allclose(edges[0], np.quantile(columns[0], np.linspace(0, 1, 6)))
    assert all(b - a >= 0.4 - 1e-9 for a, b in zip(edges[1], edges[1][1:])) and len(edges[1]) == 6
    assert np.allclose(edges[2], np.linspace(min(columns[2]), max(columns[2]), 6))
    assert edges[3] == [3.0] * 6
    means = binning.joint_means(df, "v", edges[:3] + [[2.0, 3.0, 4.0, 5.0, 6.0, 7.0]])
    b = np.clip(np.searchsorted(edges[1], columns[1], "right") - 1, 0, 4)
    assert np.allclose(means[1], [np.mean(np.array(columns[1])[b == i]) for i in range(5)])
    assert means[3] == [2.5, 3.0, 4.5, 5.5, 6.5]
    assert binning.with_boundary([0.0, 1.0, 2.0, 9.0], -5.0, 5.0) == [-5.0, 0.0, 1.0, 2.0, 5.0]


def test_too_many_cells_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(binning, "MAX_CELLS", 10)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="larger widths"):
        binning.minimum_width_edges(df, "x", 5, 1.0, 0.0)


# ---- stages on arrays


def vectors_frame(spark):
    return spark.createDataFrame([(0, [1.0, 5.0, 7.0]), (1, [3.0, 5.0, None]), (2, [8.0, 5.0, 1.0]), (3, None)], "i int, v array<double>")


def test_vector_zscore_round_trip(spark):
    df = vectors_frame(spark)
    frame = FeatureFrame(df).then(VectorZScore("z", columns=["v"]))
    z = {r.i: r.v for r in frame.df.collect()}
    assert math.isclose(z[0][0], (1 - 4) / np.std([1, 3, 8])) and z[0][1] is None and z[1][2] is None and z[3] is None
    assert math.isclose(frame.find("z").deviations("v")[0], np.std([1, 3, 8]))
    back = {r.i: r.v for r in frame.invert_to().df.collect()}
    assert np.allclose(back[0], [1, 5, 7]) and back[1][:2] == [3.0, 5.0] and back[3] is None
    again = Stage.from_dict(frame.lineage[0].to_dict())
    assert {r.i: r.v for r in again.apply(df).collect()} == z


def test_parts_must_cover_all_features(spark):
    df = vectors_frame(spark)
    names = ["a", "b", "c"]
    frame = FeatureFrame(df).then(VectorSplit("s", column="v", names=names, parts={"x": ["c", "a"], "y": ["b"]}))
    assert {r.i: (r.v_x, r.v_y) for r in frame.df.collect()}[0] == ([7.0, 1.0], [5.0])
    assert {r.i: r.v for r in frame.invert_to().df.collect()}[0] == [1.0, 5.0, 7.0]
    for parts, what in (({"x": ["a"], "y": ["b"]}, r"in no part: \['c'\]"), ({"x": names, "y": ["b"]}, r"in two parts: \['b'\]"), ({"x": [*names, "d"]}, r"unknown: \['d'\]")):
        with pytest.raises(ValueError, match=what):
            FeatureFrame(df).then(VectorSplit("s", column="v", names=names, parts=parts))


def test_vector_bins_keep_edges_and_go_back_to_means(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(20)], "i int, v array<double>")
    frame = FeatureFrame(df).then(VectorBins("b", column="v", bins=4, widths=[0.0, 0.0], outlier=0.0))
    bins = {r.i: r.v_bins for r in frame.df.collect()}
    assert bins[0] == [0, 0] and bins[19] == [3, 3] and bins[7] == [1, 1]
    back = {r.i: r.v for r in frame.invert_to().df.collect()}
    assert back[0][0] == np.mean([i for i in bins if bins[i][0] == 0])
    given = VectorBins("b", column="v", bins=2, edges=[[0.0, 10.0, 19.0], [0.0, 100.0, 361.0]]).fit(df)
    assert given.params["edges"][1] == [0.0, 100.0, 361.0] and len(given.params["means"][0]) == 2


# ---- senses


def test_an_agent_alone_senses_nothing_and_nearest_counts(spark, kp):
    alone = kp.where("t = 3 and agent = 1 or t = 4")
    out = {(r.t, r.agent): r for r in agents.senses(alone, ["t"]).collect()}
    assert len(out) == 6
    assert set(out[3, 1].vision) == {0.0} and set(out[3, 1].touch) == {0.0} and len(out[3, 1].vision) == 72 and len(out[3, 1].touch) == 95
    pts = {r.agent: [(p.x, p.y) for p in r.kp] for r in alone.where("t = 4").collect()}
    touched = [pose.KEYPOINTS.index(n) for n in agents.TOUCHED]
    own, other = 7, 2
    d = min(math.dist(pts[2][own], pts[a][touched[other]]) for a in pts if a != 2)
    assert math.isclose(out[4, 2].touch[own * 5 + other], 1 - min(1, agents.TOUCH_FACTOR * d**1.3), abs_tol=1e-12)


# ---- poses, look-aheads


def test_pose_velocity_integrates_back(rows):
    start = rows.withColumn("start", F.col("pose"))
    back = motion.integrate_pose(start, "velocity", "start", assembly.ANGLES, ["agent", "session"], "t", "back")
    worst = 0.0
    for r in back.select("pose", "back").collect():
        for a, b, angle in zip(r.pose, r.back, assembly.ANGLES):
            d = a - b
            worst = max(worst, abs(math.remainder(d, 2 * math.pi)) if angle else abs(d))
    assert worst < 1e-9


def test_split_and_merge_of_poses(rows):
    a, b = assembly.split_pose()
    out = rows.select("pose", "relative_pose", a.alias("g"), b.alias("r")).select("*", assembly.merge_pose("g", "r").alias("m")).first()
    assert out.m == out.pose and len(out.g) == 3 and out.r == out.relative_pose and len(out.r) == len(assembly.RELATIVE)


def test_relative_lookaheads_round_trip(kp, sizes):
    """Changes over 1 .. 6 frames, their transform and back to the later frames' values."""
    f, n = ["abdomen_angle", "left_front_leg_tip_dist"], 6
    posed = pose.pose_features(kp, sizes).select("agent", "t", *pose.POSE)
    out = motion.movement(posed, *pose.POSE[:3], f, f[:1], ["agent"], "t", [1], relative_dct=n)
    back = motion.relative_future(out, f, f[:1], n).select("agent", "t", *[f"{x}_future" for x in f]).collect()
    value = {(r.agent, r.t): r for r in posed.collect()}
    assert len(back) == len(value) - 5 * n
    for r in back:
        for k in range(n):
            later = value[r.agent, r.t + k + 1]
            assert abs(math.remainder(r[f"{f[0]}_future"][k] - later[f[0]], 2 * math.pi)) < 1e-9
            assert abs(r[f"{f[1]}_future"][k] - later[f[1]]) < 1e-9


# ---- chunks and back


def test_widths_and_chunks(made):
    assert made.inputs == {"velocity_before": 29, "relative_pose": 26, "vision": 72, "touch": 95, "wall": 19}
    assert made.input_slices()["touch"] == (127, 222) and made.labels == {"velocity_discrete_bins": 3, "velocity_continuous": 26}
    for c in made.chunks.limit(20).collect():
        assert [r.pos for r in c.rows] == list(range(6)) and len(c.start) == 29
        for r in c.rows:
            assert [len(r[g]) for g in made.inputs] == list(made.inputs.values())
            assert len(r.velocity_discrete_bins) == 3 and all(0 <= b < 4 for b in r.velocity_discrete_bins) and len(r.velocity_continuous) == 26


def test_inputs_are_the_labels_of_the_frame_before(made, rows):
    velocity = {(r.agent, r.t): r.velocity for r in rows.collect()}
    mean, sd = made.frame.find("scale").params["stats"]["velocity_before"]
    for c in made.chunks.limit(10).collect():
        for r in c.rows:
            before = velocity[c.agent, c.chunk_start + r.pos - 1]
            assert np.allclose([z * s + m for z, m, s in zip(r.velocity_before, mean, sd)], before, atol=1e-9)


def test_least_widths_are_in_units_of_the_label(made):
    """widths are divided by the label's deviation, as the edges are those of z-scores."""
    stage, sd = made.frame.find("bins"), made.frame.find("scale").deviations("velocity")[2]
    turn = stage.params["edges"][2]
    assert math.isclose(stage.params["widths"][2], 0.05 / sd) and min(b - a for a, b in zip(turn, turn[1:])) * sd > 0.05 - 1e-9


def test_fitted_stages_treat_other_data_alike(made, rows):
    again = assembly.assemble(rows, 6, fitted=made.params())
    key = lambda c: (c.agent, c.chunk_start)
    assert sorted(made.chunks.collect(), key=key) == sorted(again.chunks.collect(), key=key)
    half = assembly.assemble(rows.where("agent < 2"), 6, fitted=made.frame).chunks.collect()
    assert sorted(half, key=key) == sorted((c for c in made.chunks.collect() if c.agent < 2), key=key)


def test_given_edges_are_kept(rows):
    edges = {n: [-50.0, -1.0, 1.0, 50.0] for n in assembly.DISCRETE}
    d = assembly.assemble(rows, 6, bins=3, edges=edges)
    mean, sd = d.frame.find("scale").params["stats"]["velocity"]
    assert np.allclose([e * sd[1] + mean[1] for e in d.frame.find("bins").params["edges"][1]], edges["sideways"])


def test_mask_keeps_chunks_with_a_row_in_it(rows):
    masked = assembly.assemble(rows.withColumn("wanted", F.col("t") == 40), 6, bins=3, mask="wanted").chunks.collect()
    assert masked and all(c.chunk_start <= 40 < c.chunk_start + 6 for c in masked)


def test_items_go_back_to_velocities_and_tracks(spark, made, kp, sizes):
    frame = assembly.item_frame(made.chunks, made.frame).invert_to()
    velocity = {(c.agent, c.chunk_start + r.pos): r.velocity for c in made.chunks.collect() for r in c.rows}
    stage, (mean, sd) = made.frame.find("bins"), made.frame.find("scale").params["stats"]["velocity"]
    back = frame.df.collect()
    assert len(back) == len(velocity)
    for r in back:
        want = velocity[r.agent, r.t]
        assert np.allclose(r.velocity[3:], want[3:], atol=1e-9)
        for i in range(3):  # the bin's mean, within the bin of the value
            edges = [e * sd[i] + mean[i] for e in stage.params["edges"][i]]
            inside = min(max(want[i], edges[0]), edges[-1])
            k = min(max(int(np.searchsorted(edges, inside, "right")) - 1, 0), 3)
            means = stage.params["means"][i][k] * sd[i] + mean[i]
            assert math.isclose(r.velocity[i], means, abs_tol=1e-6)
    # with the exact velocities in place of the bins, a chunk gives back its keypoints
    exact = made.chunks.select("agent", "session", "chunk_start", "id", "start", F.inline("rows")).withColumn("t", F.col("chunk_start") + F.col("pos"))
    posed = motion.integrate_pose(exact, "velocity", "start", assembly.ANGLES, ["agent", "session", "chunk_start"], "t")
    wide = posed.select("agent", "t", "id", *[F.get("pose", F.lit(i)).alias(n) for i, n in enumerate(pose.POSE)])
    tracked = pose.keypoints(wide, sizes).select("agent", "t", "kp").collect()
    truth = {(r.agent, r.t): r.kp for r in kp.collect()}
    i = pose.KEYPOINTS.index("left_front_leg_tip")
    assert tracked and max(math.dist(r.kp[i], truth[r.agent, r.t][i]) for r in tracked) < 1e-6


def test_predictions_in_the_form_of_chunks(spark, made, sizes):
    """A prediction of no motion at all stays where its chunk starts."""
    mean, sd = made.frame.find("scale").params["stats"]["velocity"]
    still = [-m / s for m, s in zip(mean, sd)][3:]
    rows_ = F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), r["velocity_discrete_bins"].alias("velocity_discrete_bins"), F.array(*[F.lit(v) for v in still]).alias("velocity_continuous")))
    back = assembly.item_poses(made.chunks.limit(3).withColumn("rows", rows_), made.params(), sizes)
    for r in back.join(made.chunks.select("agent", "chunk_start", F.col("start").alias("_start")), ["agent", "chunk_start"]).collect():
        assert all(abs(math.remainder(a - b, 2 * math.pi)) < 1e-6 if angle else abs(a - b) < 1e-6 for a, b, angle in list(zip(r.pose, r._start, assembly.ANGLES))[3:])
