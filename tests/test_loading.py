"""Archives, training rows, the chunk cache and noise."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import agents, evaluation, pose, sequences, stats
from trackloom.plans import assembly, cache, loading
from trackloom.plans.stages import FeatureFrame, ZScore
from trackloom.sources import archives, tracks


def archive(path, seed=0, frames=30, slots=3, **more):
    rng = np.random.default_rng(seed)
    ids = np.tile(np.arange(1, slots + 1), (frames, 1))
    ids[frames // 2 :, 0] = slots + 1  # another animal takes the slot
    if slots > 1:
        ids[5, 1] = -1
    numbers = np.arange(frames)
    numbers[20:] += 4  # a jump of the camera
    a = {"X": rng.normal(size=(19, 2, frames, slots)), "videoidx": np.full((frames, 1), seed), "ids": ids, "frames": numbers[:, None], "y": (rng.random((2, frames, slots)) < 0.7).astype(float), "categories": np.array(["female", "walking"]), **more}
    raw = io.BytesIO()
    np.savez_compressed(raw, **a)
    path.write_bytes(raw.getvalue())
    return a


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deeper").mkdir(parents=True)
    return tmp_path / "in"


def test_several_archives_with_flags(spark, folder):
    made = {7: archive(folder / "a.npz", 7), 8: archive(folder / "deeper" / "b.npz", 8, frames=12)}
    (folder / "notes.txt").write_text("no archive")
    out = tracks.read_archives(spark, str(folder))
    assert out.rdd.getNumPartitions() == 2
    rows = {(r.videoidx, r.agent, r.t): r for r in out.collect()}
    assert len(rows) == 30 * 3 - 1 + 12 * 3 - 1
    for (video, slot, t), r in rows.items():
        a = made[video]
        ids, frames = a["ids"] - (a["ids"] >= 0), a["frames"].ravel()
        assert r.id == ids[t, slot] and r.frame == frames[t] and r.isdata and r.useoutputmask
        assert r.isstart == (t == 0 or ids[t, slot] != ids[t - 1, slot] or frames[t] != frames[t - 1] + 1)
        assert [(p.x, p.y) for p in r.kp] == [tuple(p) for p in a["X"][:, :, t, slot]]
        assert r.y == {"female": int(a["y"][0, t, slot]), "walking": int(a["y"][1, t, slot])}


def test_only_members_that_are_needed(spark, folder):
    """An archive without points serves columns that need none."""
    archive(folder / "a.npz", 1, X=np.zeros(0))
    out = tracks.read_archives(spark, str(folder), ["id", "t"])
    assert out.columns == ["id", "t"] and out.count() == 89
    with pytest.raises(Exception, match="a.npz"):
        tracks.read_archives(spark, str(folder)).collect()


def test_a_broken_archive_is_named(spark, folder):
    archive(folder / "a.npz", 1)
    (folder / "torn.npz").write_bytes((folder / "a.npz").read_bytes()[:2000])
    with pytest.raises(Exception, match="torn.npz"):
        tracks.read_archives(spark, str(folder)).count()
    with pytest.raises(Exception, match="nowhere"):
        tracks.read_archives(spark, str(folder / "nowhere")).count()


def test_missing_points_and_no_archive(spark, folder):
    assert tracks.read_archives(spark, str(folder)).count() == 0
    x = np.ones((19, 2, 4, 1))
    x[3, 0, 2, 0] = np.nan
    archive(folder / "a.npz", 1, frames=4, slots=1, X=x, ids=np.ones((4, 1), int))
    r = tracks.read_archives(spark, f"file://{folder}").where("t = 2").first()
    assert r.kp[3].x is None and r.kp[3].y == 1.0
    assert [a.path.rsplit("/", 1)[1] for a in archives.archives_in(str(folder))] == ["a.npz"]


def test_training_rows_from_archives(spark, folder):
    made = archive(folder / "a.npz", 3)
    archive(folder / "b.npz", 4, y=np.zeros((2, 30, 3)))  # nobody female
    x = made["X"]
    rows, sizes = loading.training_rows(tracks.read_archives(spark, str(folder)), ["female"], ["walking==0"], mirror=True)
    out = rows.collect()
    assert {r.videoidx for r in out} == {3, 7}  # 3 and its mirror image: the other one has no data
    # categories fill over the next ones when their animal's file has none; ids go on after the greatest
    own = [r for r in out if r.videoidx == 3]
    assert {r.id for r in own} == {0, 1, 2, 3} and {r.id for r in out if r.videoidx == 7} == {4, 5, 6, 7}
    for r in own:
        assert r.isdata == (made["y"][0, r.t, r.agent] == 1) and r.useoutputmask == (made["y"][1, r.t, r.agent] == 0)
    mirrored = next(r for r in out if r.videoidx == 7 and r.t == 9 and r.agent == 2)
    i, j = pose.KEYPOINTS.index("left_eye"), pose.KEYPOINTS.index("right_eye")
    assert (mirrored.kp[i].x, mirrored.kp[i].y) == (-x[j, 0, 9, 2], x[j, 1, 9, 2])
    known = {r.id: r for r in sizes.collect()}
    assert set(known) == set(range(8)) and np.isclose(known[0].thorax_width, known[4].thorax_width)


def test_archives_to_chunks_and_back(spark, folder):
    """The whole way: two archives whose slots and frames are alike, mirrored, measured, assembled and undone."""
    archive(folder / "a.npz", 3, frames=40)
    archive(folder / "b.npz", 4, frames=40)
    rows, sizes = loading.training_rows(tracks.read_archives(spark, str(folder)), mirror=True)
    features = assembly.feature_rows(rows, sizes, F.col("isdata"), frame=["videoidx", "t"], agent="track")
    made = assembly.assemble(features, 5, bins=3, agent="track")
    chunks = made.chunks.collect()
    # sessions end where a slot's animal changes (slot 0), where the camera jumps and where an animal is missing
    want = 0
    for cuts in ([(0, 20), (20, 40)], [(0, 5), (6, 20), (20, 40)], [(0, 20), (20, 40)]):
        want += sum((b - a - 2) // 5 for a, b in cuts)
    assert len(chunks) == 4 * want and {c.track.split("/")[0] for c in chunks} == {"3", "4", "8", "9"}
    back = assembly.item_poses(made.chunks, made.params(), sizes, agent="track").where("t = chunk_start")
    truth = {(r.track, r.t): r.kp for r in rows.collect()}
    i = pose.KEYPOINTS.index("left_back_leg_tip")
    got = back.collect()
    assert len(got) == len(chunks)
    for r in got:  # the first row of a chunk is where it starts, whatever its bins lose
        assert np.allclose([r.kp[i].x, r.kp[i].y], [truth[r.track, r.t][i].x, truth[r.track, r.t][i].y], atol=1e-6)


def test_individuals_that_cannot_be_measured_are_no_data(spark):
    p = [(float(i), float(i * i)) for i in range(19)]
    blind = [None if n in ("left_eye",) else v for n, v in zip(pose.KEYPOINTS, p)]
    rows = [(0, 0, t, 0, p, {"female": 1}) for t in range(3)] + [(0, 1, t, 1, blind, {"female": 1}) for t in range(3)] + [(0, 2, 0, 2, [None] * 19, {"female": 1})]
    df = spark.createDataFrame(rows, "videoidx int, agent int, t long, id int, kp array<struct<x: double, y: double>>, y map<string, int>").withColumns({"isdata": F.lit(True), "useoutputmask": F.lit(True)})
    out, sizes = loading.training_rows(df)
    assert {r.id for r in sizes.collect()} == {0} and {(r.agent, r.isdata) for r in out.collect()} == {(0, True)}


# ---- cache


def test_cache_hits_misses_and_broken_writes(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(5).select(F.col("id").cast("double").alias("x")).coalesce(1).write.parquet(source)
    frame = FeatureFrame(spark.read.parquet(source)).then(ZScore(columns=["x"]))
    made = []

    def make(fail=False):
        made.append(1)
        return frame.df.withColumn("x", F.when(F.lit(fail), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x")))

    key = cache.cache_key(spark, frame, [source], length=8)
    with pytest.raises(Exception, match="broken"):
        cache.cached(spark, folder, key, lambda: make(True))
    assert not (tmp_path / "cache" / key).exists()
    assert cache.cached(spark, folder, key, make).count() == 5 and cache.cached(spark, folder, key, make).count() == 5 and len(made) == 2
    # a folder without its mark is not read
    (tmp_path / "cache" / key / "_SUCCESS").unlink()
    assert cache.cached(spark, folder, key, make).count() == 5 and len(made) == 3
    assert cache.cache_key(spark, frame.to_json(), [source], length=8) != cache.cache_key(spark, frame.to_json(), [source], length=9)
    other = FeatureFrame(frame.df).then(ZScore(columns=["x"]))
    assert cache.cache_key(spark, other, [source], length=8) != key
    spark.range(1).select(F.lit(1.0).alias("x")).write.mode("append").parquet(source)
    changed = cache.cache_key(spark, frame, [source], length=8)
    assert changed != key and cache.cached(spark, folder, changed, make).columns == ["x"] and len(made) == 4


# ---- noise


def test_correlated_noise_has_its_covariance(spark):
    cov = [[2.0, 0.9, 0.0], [0.9, 1.0, -0.3], [0.0, -0.3, 0.5]]
    rows = spark.range(20_000).select("id", F.array(*[F.lit(0.0)] * 3).alias("v"))
    noise = np.array([r.v for r in stats.correlated_noise(rows, "v", cov, ["id"], 1).collect()])
    assert np.allclose(noise.mean(0), 0, atol=0.04) and np.allclose(np.cov(noise.T), cov, atol=0.06)
    again = stats.correlated_noise(rows.repartition(7), "v", cov, ["id"], 1).where("id = 77").first().v
    assert again == stats.correlated_noise(rows, "v", cov, ["id"], 1).where("id = 77").first().v


@pytest.mark.parametrize("together", [True, False])
def test_resampled_noise_draws_from_the_table(spark, together):
    errors = spark.createDataFrame([(i, [float(i), float(10 * i)]) for i in range(6)], "idx long, error array<double>")
    rows = spark.range(600).select("id", F.array(F.lit(100.0), F.lit(200.0)).alias("v"))
    out = [r.v for r in stats.resampled_noise(rows, "v", errors, 6, ["id"], 2, together).collect()]
    assert len(out) == 600
    pairs = {(a - 100, (b - 200) / 10) for a, b in out}
    assert pairs == {(i, i) for i in range(6)} if together else len(pairs) > 25
    assert {a - 100 for a, _ in out} == set(range(6))


# ---- offsets and axes


def test_running_offsets_over_many_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("w")).repartition(9)
    out = sorted(sequences.running_offsets(rows, ["k"], "w").collect())
    total = 0
    for r in out:
        assert r.offset == total
        total += r.w
    assert [r.offset for r in sorted(sequences.running_offsets(rows.select("k"), ["k"]).collect())] == list(range(1000))


def test_limits_of_labels_and_predictions_together(spark):
    rows = spark.range(101).select(F.col("id").cast("double").alias("a"), (F.col("id") + 100.0).alias("b"))
    assert np.allclose(evaluation.common_limits(rows, ["a", "b"], 0.25), np.quantile([*range(101), *range(100, 201)], [0.25, 0.75]))


def test_one_axis_without_gap_or_rows(spark):
    rows = spark.createDataFrame([("b", 3, 1.0), ("a", 5, 2.0), ("a", 4, 3.0)], "s string, t long, y double")
    assert sorted(map(tuple, evaluation.one_axis(rows, ["s"], "t", ["y"], 0).collect())) == [(0, "a", 3.0), (1, "a", 2.0), (2, "b", 1.0)]
    assert evaluation.one_axis(rows.limit(0), ["s"], "t", ["y"], 2).count() == 0


def test_touch_factor_by_ranks(spark, sf):
    kp = tracks.embedding_keypoints(spark, sf).where("t < 10")
    assert agents.touch_factor(kp, ["t"]).first().factor > 0
