"""Small operators that no query calls, against their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import binning, evaluation, filters, motion, pose, stats
from trackloom.plans import assembly, dataset
from trackloom.plans.stages import FeatureFrame, Select, ZScore
from trackloom.sources import tracks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_labelled_sequences_and_smallest_without(spark):
    df = frame(spark, [("a", 1, None, 9), ("a", 2, 5, 7), ("b", 1, None, 3), ("c", 1, 6, 1), ("c", 2, None, 4), ("b", 2, None, 3)], "k string, t int, label int, size int")
    assert {(r.k, r.t) for r in filters.labelled_sequences(df, "k", "label").collect()} == {("a", 1), ("a", 2), ("c", 1), ("c", 2)}
    assert {(r.k, r.t) for r in filters.smallest_without(df, F.col("label").isNull(), "size").collect()} == {("b", 1), ("b", 2)}  # ties stay
    assert filters.smallest_without(df, F.lit(False), "size").count() == 0


def test_drop_incomplete_narrows_isdata(spark):
    df = frame(spark, [(1, True), (2, True), (2, False), (3, True)], "id int, isdata boolean")
    sizes = frame(spark, [(1, 1.0, 2.0), (2, None, 2.0)], "id int, a double, b double")
    assert sorted((r.id, r.isdata) for r in filters.drop_incomplete(df, sizes, "id", ["a", "b"]).collect()) == [(1, True), (2, False), (2, False), (3, True)]


def test_random_rows_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    chosen = [r.id for r in filters.random_rows(df, ["id"], 20, 3).collect()]
    assert len(set(chosen)) == 20 and chosen == [r.id for r in filters.random_rows(df.repartition(7), ["id"], 20, 3).collect()]
    assert chosen != [r.id for r in filters.random_rows(df, ["id"], 20, 4).collect()] and filters.random_rows(df.limit(3), ["id"], 20).count() == 3


def test_segment_faults(spark):
    rows = [("s", 0, True, 1), ("s", 1, False, 1), ("u", 0, True, 2), ("u", 1, True, 2), ("v", 0, True, 3), ("v", 1, False, 4)]
    df = frame(spark, rows, "segment string, t int, isstart boolean, id int")
    bad = evaluation.segment_faults(df, ["segment"], F.col("isstart"), F.col("t") == 0, "id").collect()
    assert {r.segment for r in bad} == {"u", "v"}


def test_least_of_states(spark):
    df = frame(spark, [(1, "a", 3.0), (1, "b", 2.0), (1, "c", None), (2, "b", 0.5), (2, "a", 0.5)], "k int, s string, e double")
    out = evaluation.least_of_states(df.where("e is not null"), ["k"], "s", "e").collect()
    assert {r.k: (r.s, r.e) for r in out} == {1: ("b", 2.0), 2: ("a", 0.5)}  # a tie: the first state


def test_circle_rotation_and_head_points(spark):
    r = spark.range(1).select(g.circle_rotation(F.lit(3.0), F.lit(5.0), 1.0, 3.0).alias("a"), *[c.alias(f"{n}{k}") for n, p in g.head_points(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(0.5), F.lit(0.7)).items() for k, c in zip("xy", p)]).first()
    assert math.isclose(r.a, math.pi / 4)
    assert np.allclose([r.leftx, r.lefty, r.rightx, r.righty, r.frontx, r.fronty], [1.5, 2, 0.5, 2, 1, 2.7])


def test_move_edge_regroups_counts(spark):
    counts = frame(spark, [(0, 5), (1, 6), (2, 7)], "cell int, n long")
    out = binning.move_edge(counts, F.when(F.col("cell") < 2, 0).otherwise(1))
    assert {r.bin: r.n for r in out.collect()} == {0: 11, 1: 7}


def test_regularize_holds_limits(spark):
    df = frame(spark, [(3.0, 3.0), (0.5, -3.0)], "x double, a double")
    out = pose.regularize(df, {"x": (1.0, 0.0, 2.0, False), "a": (3.0, 2.0, 4.0, True)}, 0.5).collect()
    assert [r.x for r in out] == [2.0, 0.75]
    # an angle is drawn the short way round: -3 is 0.283 beyond 3
    assert math.isclose(math.remainder(out[1].a - (3.0 + (2 * math.pi - 6) / 2), 2 * math.pi), 0, abs_tol=1e-9)


def test_select_cannot_be_undone(spark):
    df = frame(spark, [(1.0, 2.0)], "x double, y double")
    made = FeatureFrame(df).then(Select(columns=["x"]))
    assert made.df.columns == ["x"]
    with pytest.raises(TypeError):
        made.invert_to()


def test_batches_and_their_collation(spark):
    examples = spark.range(95).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    numbered = dataset.batches(examples, ["id"], 10)
    assert numbered.select("batch").distinct().count() == 10
    whole = dataset.collated(examples, ["id"], 10).collect()
    assert sum(len(r.rows) for r in whole) == 95 and all(len(r.rows) <= 10 for r in whole)
    assert sorted(e.x[0] for r in whole for e in r.rows) == [float(i) for i in range(95)]
    again = dataset.collated(examples.repartition(5), ["id"], 10).collect()
    assert {r.batch: [e.id for e in r.rows] for r in whole} == {r.batch: [e.id for e in r.rows] for r in again}
    assert dataset.collated(examples.limit(0), ["id"], 10).count() == 0


def test_balanced_rows(spark):
    df = frame(spark, [(i, "a" if i < 6 else "b", 1 if i == 0 else None) for i in range(8)], "i int, kind string, flag int")
    out = {r.i: r.weight for r in stats.balanced_rows(df, ["kind", "flag"]).collect()}
    # kinds: 8 rows, 2 values: 8/(2*6) and 8/(2*2); flag: one value, weight 1
    assert math.isclose(out[0], (8 / 12 + 1) / 2) and math.isclose(out[3], 8 / 12) and math.isclose(out[7], 2.0)


def test_steps_between_poses_and_back(spark, sf):
    kp = tracks.embedding_keypoints(spark, sf)
    posed = pose.pose_features(kp, pose.scales(kp)).select("agent", "t", F.array(*pose.POSE).alias("pose"))
    out = motion.future_poses(posed, "pose", ["agent"], "t", [1, 4]).withColumn("v", motion.step_velocity(F.col("pose"), F.get("future", F.lit(0)), assembly.ANGLES))
    out = out.withColumn("back", motion.next_pose(F.col("pose"), F.col("v"), assembly.ANGLES)).collect()
    at = {(r.agent, r.t): r.pose for r in out}
    seen = 0
    for r in out:
        assert r.future == [at.get((r.agent, r.t + 1)), at.get((r.agent, r.t + 4))]
        if r.future[0]:
            seen += 1
            assert all(abs(math.remainder(a - b, 2 * math.pi)) < 1e-9 if angle else abs(a - b) < 1e-9 for a, b, angle in zip(r.back, r.future[0], assembly.ANGLES))
    assert seen == len(out) - 5


def test_two_plans_of_one_feature_agree(spark, sf):
    """The combined velocity against the global one and the changes of single features."""
    kp = tracks.embedding_keypoints(spark, sf)
    posed = pose.pose_features(kp, pose.scales(kp)).select("agent", "t", *pose.POSE)
    one = motion.pose_velocity(posed.withColumn("pose", F.array(*pose.POSE)), "pose", assembly.ANGLES, ["agent"], "t")
    one = one.select("agent", "t", *[F.get("velocity", F.lit(i)).alias(n) for i, n in ((0, "fwd_1"), (1, "side_1"), (2, "turn_1"), (3, "abdomen_angle_d1"), (9, "right_front_leg_tip_dist_d1"))])
    other = motion.global_velocity(posed, *pose.POSE[:3], ["agent"], "t")
    other = motion.relative_velocity(other, "abdomen_angle", ["agent"], "t", [1], angle=True)
    f = pose.POSE[9]
    other = motion.relative_velocity(other, f, ["agent"], "t").withColumnRenamed(f"{f}_d1", "right_front_leg_tip_dist_d1")
    names = [c for c in one.columns if c not in ("agent", "t")]
    for r in evaluation.compare_tables(one, other, ["agent", "t"], names, 1e-9).collect():
        assert (r.only_left, r.only_right, r.null_mismatch, r.within) == (0, 0, 0, True), r
