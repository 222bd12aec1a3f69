"""Body-centred poses: keypoints to features and back, individual sizes, mirroring. All column expressions.

Keypoints come as array<struct<x, y>> in the order of KEYPOINTS. Sizes come from a small table with one row per individual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import PI, mod2pi, polar, rotate

# The keypoints and their order, and the sizes of an individual.
KEYPOINTS = (
    "wing_right", "wing_left", "antennae_midpoint", "right_eye", "left_eye", "left_front_thorax", "right_front_thorax", "base_thorax", "tip_abdomen",
    "right_middle_femur_base", "right_middle_femur_tibia_joint", "left_middle_femur_base", "left_middle_femur_tibia_joint", "right_front_leg_tip",
    "right_middle_leg_tip", "right_back_leg_tip", "left_front_leg_tip", "left_middle_leg_tip", "left_back_leg_tip",
)
SCALES = ("thorax_width", "thorax_length", "abdomen_length", "wing_length", "head_width", "head_height")
Point = tuple[Column, Column]


def at(name: str, kp: Column | str = "kp") -> Point:
    p = F.get(F.col(kp) if isinstance(kp, str) else kp, F.lit(KEYPOINTS.index(name)))
    return p["x"], p["y"]


def middle(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def length(v: Point) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1])


def angle(v: Point) -> Column:
    return F.atan2(v[1], v[0])


def heading(kp: str = "kp") -> tuple[Point, Column]:
    """Origin (middle of the front of the thorax) and heading of the body."""
    front = middle(at("left_front_thorax", kp), at("right_front_thorax", kp))
    return front, mod2pi(angle(minus(front, at("base_thorax", kp))) - PI / 2)


def body_centric(df: DataFrame, kp: str = "kp") -> DataFrame:
    """df with ox, oy, theta and body: the points about the origin, the body's axis pointing up."""
    (ox, oy), theta = heading(kp)
    out = df.withColumn("ox", ox).withColumn("oy", oy).withColumn("theta", theta)

    def turned(p: Column) -> Column:
        x, y = rotate(p["x"] - F.col("ox"), p["y"] - F.col("oy"), F.col("theta"))
        return F.struct(x.alias("x"), y.alias("y"))

    return out.withColumn("body", F.transform(kp, turned))


def size_expressions(kp: str = "kp") -> dict[str, Column]:
    """Each row's measure of each size; wings and their pair are pooled by scales()."""
    front = middle(at("left_front_thorax", kp), at("right_front_thorax", kp))
    base = at("base_thorax", kp)
    mid = middle(front, base)
    return {
        "thorax_width": length(minus(at("right_front_thorax", kp), at("left_front_thorax", kp))), "thorax_length": length(minus(front, base)), "abdomen_length": length(minus(base, at("tip_abdomen", kp))),
        "wing_left": length(minus(at("wing_left", kp), mid)), "wing_right": length(minus(at("wing_right", kp), mid)), "head_width": length(minus(at("right_eye", kp), at("left_eye", kp))),
        "head_height": length(minus(middle(at("right_eye", kp), at("left_eye", kp)), at("antennae_midpoint", kp))),
    }


def scales(df: DataFrame, id: str = "id", kp: str = "kp") -> DataFrame:
    """(id, SCALES): medians over each individual's rows; the wing's over both wings."""
    rows = df.select(id, *[c.alias(n) for n, c in size_expressions(kp).items()])
    # both wings in one array per row keep one pass: each row goes twice, with half the measures
    twice = rows.withColumn("_w", F.explode(F.array("wing_left", "wing_right")))
    med = lambda n: F.percentile(n, 0.5).alias(n)
    # doubling all values of the others does not change their medians
    return twice.groupBy(id).agg(*[med(n) if n != "wing_length" else F.percentile("_w", 0.5).alias(n) for n in SCALES])


def _shift(p: Point, dy: Column) -> Point:
    return p[0], p[1] + dy


def pose_features(df: DataFrame, sizes: DataFrame, id: str = "id", kp: str = "kp") -> DataFrame:
    """df joined to its individual's thorax length, with the 29 pose features as columns."""
    b = body_centric(df.join(F.broadcast(sizes.select(id, F.col("thorax_length").alias("_L"))), id), kp)
    p = {n: at(n, "body") for n in KEYPOINTS}
    L = F.col("_L")
    rear, mid = {n: _shift(p[n], L) for n in p}, {n: _shift(p[n], L / 2) for n in p}
    eyes = middle(p["left_eye"], p["right_eye"])
    left = lambda v: mod2pi(PI - angle(v))
    out: dict[str, Column] = {
        "thorax_front_x": F.col("ox"), "thorax_front_y": F.col("oy"), "orientation": F.col("theta"),
        "abdomen_angle": mod2pi(angle(rear["tip_abdomen"]) + PI / 2), "head_base_x": eyes[0], "head_base_y": eyes[1],
        "head_angle": angle(minus(p["antennae_midpoint"], eyes)) - PI / 2,
        "left_front_leg_tip_dist": length(p["left_front_leg_tip"]), "left_front_leg_tip_angle": left(p["left_front_leg_tip"]),
        "right_front_leg_tip_dist": length(p["right_front_leg_tip"]), "right_front_leg_tip_angle": angle(p["right_front_leg_tip"]),
    }
    base_l, base_r = mid["left_middle_femur_base"], mid["right_middle_femur_base"]
    joint_l, joint_r = minus(p["left_middle_femur_tibia_joint"], p["left_middle_femur_base"]), minus(p["right_middle_femur_tibia_joint"], p["right_middle_femur_base"])
    tip_l, tip_r = minus(p["left_middle_leg_tip"], p["left_middle_femur_tibia_joint"]), minus(p["right_middle_leg_tip"], p["right_middle_femur_tibia_joint"])
    bl, br, al, ar = left(base_l), angle(base_r), left(joint_l), angle(joint_r)
    out |= {
        "left_middle_femur_base_dist": length(base_l), "left_middle_femur_base_angle": bl, "right_middle_femur_base_dist": length(base_r), "right_middle_femur_base_angle": br,
        "left_middle_femur_tibia_joint_dist": length(joint_l), "left_middle_femur_tibia_joint_angle": mod2pi(al - bl), "right_middle_femur_tibia_joint_dist": length(joint_r), "right_middle_femur_tibia_joint_angle": mod2pi(ar - br),
        "left_middle_leg_tip_dist": length(tip_l), "left_middle_leg_tip_angle": mod2pi(PI - angle(tip_l) - al), "right_middle_leg_tip_dist": length(tip_r), "right_middle_leg_tip_angle": mod2pi(angle(tip_r) - ar),
        "left_back_leg_tip_dist": length(rear["left_back_leg_tip"]), "left_back_leg_tip_angle": left(rear["left_back_leg_tip"]), "right_back_leg_tip_dist": length(rear["right_back_leg_tip"]), "right_back_leg_tip_angle": angle(rear["right_back_leg_tip"]),
        "left_wing_angle": mod2pi(angle(mid["wing_left"]) - PI), "right_wing_angle": -angle(mid["wing_right"]),
    }
    return b.withColumns(out).drop("ox", "oy", "theta", "body", "_L")


POSE = ("thorax_front_x", "thorax_front_y", "orientation", "abdomen_angle", "head_base_x", "head_base_y", "head_angle") + tuple(
    f"{side}_{leg}_{m}" for leg in ("front_leg_tip", "middle_femur_base", "middle_femur_tibia_joint", "middle_leg_tip", "back_leg_tip") for side in ("left", "right") for m in ("dist", "angle")
) + ("left_wing_angle", "right_wing_angle")


def keypoints(df: DataFrame, sizes: DataFrame, id: str = "id", name: str = "kp") -> DataFrame:
    """Keypoints from pose features and sizes: the inverse, where lengths that are no feature are the individual's medians."""
    d = df.join(F.broadcast(sizes.select(id, *[F.col(s).alias(f"_{s}") for s in SCALES])), id)
    c, zero = F.col, F.lit(0.0)
    L = c("_thorax_length")
    half = c("_thorax_width") / 2
    hb, ha = (c("head_base_x"), c("head_base_y")), c("head_angle")
    leg = lambda n: (c(f"{n}_dist"), c(f"{n}_angle"))
    from_ = lambda o, dist, ang: polar(o[0], o[1], ang, dist)
    rear, mid, origin = (zero, -L), (zero, -L / 2), (zero, zero)
    p: dict[str, Point] = {"left_front_thorax": (half, zero), "right_front_thorax": (-half, zero), "base_thorax": rear}
    p["tip_abdomen"] = from_(rear, c("_abdomen_length"), c("abdomen_angle") - PI / 2)
    p["left_eye"], p["right_eye"] = from_(hb, c("_head_width") / 2, ha), from_(hb, -c("_head_width") / 2, ha)
    p["antennae_midpoint"] = from_(hb, c("_head_height"), ha + PI / 2)
    for side, turn in (("left", lambda a: PI - a), ("right", lambda a: a)):
        p[f"{side}_front_leg_tip"] = from_(origin, leg(f"{side}_front_leg_tip")[0], turn(leg(f"{side}_front_leg_tip")[1]))
        p[f"{side}_back_leg_tip"] = from_(rear, leg(f"{side}_back_leg_tip")[0], turn(leg(f"{side}_back_leg_tip")[1]))
        base, joint, tip = (leg(f"{side}_middle_{n}") for n in ("femur_base", "femur_tibia_joint", "leg_tip"))
        p[f"{side}_middle_femur_base"] = from_(mid, base[0], turn(base[1]))
        p[f"{side}_middle_femur_tibia_joint"] = from_(p[f"{side}_middle_femur_base"], joint[0], turn(joint[1] + base[1]))
        p[f"{side}_middle_leg_tip"] = from_(p[f"{side}_middle_femur_tibia_joint"], tip[0], turn(tip[1] + joint[1] + base[1]))
    p["wing_left"], p["wing_right"] = from_(mid, c("_wing_length"), c("left_wing_angle") + PI), from_(mid, c("_wing_length"), -c("right_wing_angle"))

    def placed(q: Point) -> Column:
        x, y = rotate(q[0], q[1], -c("orientation"))
        return F.struct((x + c("thorax_front_x")).alias("x"), (y + c("thorax_front_y")).alias("y"))

    return d.withColumn(name, F.array(*[placed(p[n]) for n in KEYPOINTS])).drop(*[f"_{s}" for s in SCALES])


def flip_order() -> list[int]:
    """For each keypoint, the one on the other side."""
    other = lambda n: n.replace("right", "#").replace("left", "right").replace("#", "left")
    return [KEYPOINTS.index(other(n)) for n in KEYPOINTS]


def flip(df: DataFrame, kp: str = "kp", centre: float = 0.0, axis: str = "x") -> DataFrame:
    """Mirrored keypoints: one coordinate reflected about the centre, left and right exchanged."""
    def point(i: int) -> Column:
        p = F.get(F.col(kp), F.lit(i))
        x = F.lit(2 * centre) - p["x"] if axis == "x" else p["x"]
        y = F.lit(2 * centre) - p["y"] if axis == "y" else p["y"]
        return F.struct(x.alias("x"), y.alias("y"))

    return df.withColumn(kp, F.array(*[point(i) for i in flip_order()]))


def regularize(df: DataFrame, stats: dict[str, tuple[float, float, float, bool]], dampen: float) -> DataFrame:
    """Features drawn towards their mean by ``dampen`` and held between their limits: feature -> (mean, lo, hi, is angle)."""
    out = {}
    for f, (mean, lo, hi, is_angle) in stats.items():
        d = F.col(f) - mean
        d = mod2pi(d) if is_angle else d
        d = F.greatest(F.least(d * dampen, F.lit(hi - mean)), F.lit(lo - mean))
        out[f] = mod2pi(d + mean) if is_angle else d + mean
    return df.withColumns(out)
