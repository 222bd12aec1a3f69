"""Velocities at look-aheads, their integration, and other windowed operators on tracks.

``keys`` name a session: look-aheads end with it by themselves. Angle columns are radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.functions.geometry import dct, dct_rows, mod2pi, rotate


def _w(keys: list[str], t: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(t)


def ahead(x: Column | str, tau: int, w: WindowSpec, t: str) -> Column:
    """The value ``tau`` frames on; NULL if that frame is missing."""
    return F.when(F.lead(t, tau).over(w) == F.col(t) + tau, F.lead(x, tau).over(w)) if tau >= 0 else F.when(F.lag(t, -tau).over(w) == F.col(t) + tau, F.lag(x, -tau).over(w))


def relative_velocity(df: DataFrame, feature: str, keys: list[str], t: str, taus: list[int] = (1,), angle: bool = False) -> DataFrame:
    """<feature>_d<tau>: the change over each look-ahead; of an angle, the sum of its wrapped one-step changes."""
    w = _w(keys, t)
    out = df
    if angle:
        out = out.withColumn("_d", mod2pi(ahead(feature, 1, w, t) - F.col(feature)))
        return out.select("*", *[rolling_sum("_d", n, w).alias(f"{feature}_d{n}") for n in taus]).drop("_d")
    return out.select("*", *[(ahead(feature, n, w, t) - F.col(feature)).alias(f"{feature}_d{n}") for n in taus])


def rolling_sum(x: str, n: int, w: WindowSpec) -> Column:
    """Sum of this row and the next n-1; NULL unless all are there."""
    frame = w.rowsBetween(0, n - 1)
    return F.when(F.count(x).over(frame) == n, F.sum(x).over(frame))


def global_velocity(df: DataFrame, x: str, y: str, theta: str, keys: list[str], t: str, taus: list[int] = (1,)) -> DataFrame:
    """fwd_<tau>, side_<tau>, turn_<tau>: displacement in the frame of the heading at t, and the sum of wrapped one-step turns."""
    w = _w(keys, t)
    out = df.withColumn("_turn", mod2pi(ahead(theta, 1, w, t) - F.col(theta)))
    cols = []
    for n in taus:
        side, fwd = rotate(ahead(x, n, w, t) - F.col(x), ahead(y, n, w, t) - F.col(y), F.col(theta))
        cols += [fwd.alias(f"fwd_{n}"), side.alias(f"side_{n}"), rolling_sum("_turn", n, w).alias(f"turn_{n}")]
    return out.select("*", *cols).drop("_turn")


def pose_velocity(df: DataFrame, pose: str, angles: list[bool], keys: list[str], t: str, name: str = "velocity") -> DataFrame:
    """The combined velocity of a pose array (x, y, heading, relative features): forward, sideways and turn in the frame of the heading
    at t, and the one-step change of every relative feature, wrapped where ``angles`` says so. NULL without a next frame."""
    out = df.withColumn("_q", ahead(pose, 1, _w(keys, t), t))
    return out.withColumn(name, F.when(F.col("_q").isNotNull(), step_velocity(F.col(pose), F.col("_q"), angles))).drop("_q")


def step_velocity(pose: Column, following: Column, angles: list[bool]) -> Column:
    """The velocity array of a step from one pose array to another."""
    p, q = (lambda i: F.get(pose, F.lit(i))), (lambda i: F.get(following, F.lit(i)))
    side, fwd = rotate(q(0) - p(0), q(1) - p(1), p(2))
    steps = [mod2pi(q(i) - p(i)) if wrapped else q(i) - p(i) for i, wrapped in enumerate(angles) if i > 2]
    return F.array(fwd, side, mod2pi(q(2) - p(2)), *steps)


def next_pose(pose: Column, velocity: Column, angles: list[bool]) -> Column:
    """The pose array that a velocity array leads to."""
    p, v = (lambda i: F.get(pose, F.lit(i))), (lambda i: F.get(velocity, F.lit(i)))
    dx, dy = rotate(v(1), v(0), -p(2))
    rest = [mod2pi(p(i) + v(i)) if wrapped else p(i) + v(i) for i, wrapped in enumerate(angles) if i > 2]
    return F.array(p(0) + dx, p(1) + dy, mod2pi(p(2) + v(2)), *rest)


def future_poses(df: DataFrame, pose: str, keys: list[str], t: str, taus: list[int], name: str = "future") -> DataFrame:
    """<name>: the poses at several look-aheads, NULL where the track or its video (one of the keys) has ended by then."""
    w = _w(keys, t)
    return df.withColumn(name, F.array(*[ahead(pose, n, w, t) for n in taus]))


def integrate_pose(df: DataFrame, velocity: str, start: str, angles: list[bool], keys: list[str], t: str, name: str = "pose") -> DataFrame:
    """The pose of every row from one-step velocities and the pose ``start`` of each first row: the way back of pose_velocity."""
    w = _w(keys, t)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    v = lambda i: F.get(F.col(velocity), F.lit(i))
    first = lambda i: F.get(F.first(start).over(w), F.lit(i))
    run = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    out = df.withColumn("_th", first(2) + run(v(2)))
    dx, dy = rotate(v(1), v(0), -F.col("_th"))
    out = out.withColumns({"_dx": dx, "_dy": dy})
    rest = [first(i) + run(v(i)) for i in range(3, len(angles))]
    values = [first(0) + run("_dx"), first(1) + run("_dy"), mod2pi("_th"), *[mod2pi(c) if a else c for c, a in zip(rest, angles[3:])]]
    return out.withColumn(name, F.array(*values)).drop("_th", "_dx", "_dy")


def relative_lookaheads(df: DataFrame, feature: str, keys: list[str], t: str, n: int, angle: bool = False, name: str | None = None) -> DataFrame:
    """<feature>_ahead: array of the changes over 1 .. n frames; of an angle, sums of its wrapped one-step changes. NULL unless all are there."""
    w = _w(keys, t)
    step = ahead(feature, 1, w, t) - F.col(feature)
    frame = w.rowsBetween(0, n - 1)
    out = df.withColumn("_d", mod2pi(step) if angle else step)
    whole = F.count("_d").over(frame) == n
    # running totals of the list, so that one window serves all look-aheads
    steps = F.collect_list("_d").over(frame)
    total = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(F.col("_s"), 1, k), F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("_s", F.when(whole, steps)).withColumn(name or f"{feature}_ahead", F.when(F.col("_s").isNotNull(), total)).drop("_d", "_s")


def _by_rows(values: Column, rows: list[list[float]]) -> Column:
    matrix = F.array(*[F.array(*[F.lit(w) for w in row]) for row in rows])
    return F.when(values.isNotNull(), F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, values, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))


def dct_array(values: Column, n: int) -> Column:
    """DCT of an array of n look-aheads."""
    return _by_rows(values, dct_rows(n))


def idct_array(values: Column, n: int) -> Column:
    rows = dct_rows(n)
    return _by_rows(values, [[rows[k][i] for k in range(n)] for i in range(n)])


def future_values(current: Column, ahead_: Column, angle: bool = False) -> Column:
    """The values at each look-ahead: the current one and its changes, angles wrapped."""
    return F.transform(ahead_, lambda d: mod2pi(current + d) if angle else current + d)


def integrate_global(df: DataFrame, x0: str, y0: str, theta0: str, fwd: str, side: str, turn: str, keys: list[str], t: str) -> DataFrame:
    """x, y, theta from one-step velocities and the values of each session's first row: two running sums, headings first."""
    w = _w(keys, t)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.withColumn("_theta", F.first(theta0).over(w) + zero(F.sum(turn).over(before)))
    dx, dy = rotate(F.col(side), F.col(fwd), -F.col("_theta"))
    out = out.withColumn("_dx", dx).withColumn("_dy", dy)
    return out.select("*", (F.first(x0).over(w) + zero(F.sum("_dx").over(before))).alias("int_x"), (F.first(y0).over(w) + zero(F.sum("_dy").over(before))).alias("int_y"), mod2pi("_theta").alias("int_theta")).drop("_dx", "_dy", "_theta")


def integrate_relative(df: DataFrame, first: str, step: str, keys: list[str], t: str, angle: bool = False, name: str = "integrated") -> DataFrame:
    """Running sum of steps from the first row's value."""
    w = _w(keys, t)
    total = F.first(first).over(w) + F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn(name, mod2pi(total) if angle else total)


def roll(df: DataFrame, x: str, dt: int, keys: list[str], t: str, circular: bool = False, name: str = "rolled") -> DataFrame:
    """x shifted by dt rows within the keys; where circular, the last dt values come first."""
    w = _w(keys, t)
    shifted = F.lag(x, dt).over(w) if dt >= 0 else F.lead(x, -dt).over(w)
    if not circular:
        return df.withColumn(name, shifted)
    # the row that wraps around, found by its number from the other end
    every = Window.partitionBy(*keys)
    n = F.count("*").over(every)
    numbered = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", n)
    source = numbered.select(*keys, F.pmod(F.col("_r") + dt, F.col("_n")).alias("_r"), F.col(x).alias(name))
    return numbered.join(source, [*keys, "_r"]).drop("_r", "_n")


def future_pairs(df: DataFrame, angle: str, keys: list[str], t: str, taus: list[int]) -> DataFrame:
    """cos_<tau>, sin_<tau> of an angle at each look-ahead."""
    w = _w(keys, t)
    return df.select("*", *[c for n in taus for c in (F.cos(ahead(angle, n, w, t)).alias(f"cos_{n}"), F.sin(ahead(angle, n, w, t)).alias(f"sin_{n}"))])


def movement(df: DataFrame, x: str, y: str, theta: str, relative: list[str], angles: list[str], keys: list[str], t: str, taus: list[int], use_dct: bool = False, relative_dct: int = 0) -> DataFrame:
    """The label vector of each row that has every look-ahead: global look-aheads at ``taus`` (and their DCT if asked), and
    <feature>_d1 of the relative features.

    With ``relative_dct`` = n, each relative feature also has <feature>_dct, the DCT of its changes over 1 .. n frames; relative_future goes
    back from there.
    """
    out = global_velocity(df, x, y, theta, keys, t, taus)
    for f in relative:
        out = relative_lookaheads(out, f, keys, t, max(1, relative_dct), f in angles, f"_{f}")
    whole = [F.col(f"turn_{max(taus)}").isNotNull(), F.col(f"fwd_{max(taus)}").isNotNull(), *[F.col(f"_{f}").isNotNull() for f in relative]]
    for c in whole:
        out = out.where(c)
    new = {f"{f}_d1": F.get(F.col(f"_{f}"), F.lit(0)) for f in relative} | ({f"{f}_dct": dct_array(F.col(f"_{f}"), relative_dct) for f in relative} if relative_dct else {})
    if use_dct:
        for part in ("fwd", "side", "turn"):
            new |= {f"{part}_dct{k}": c for k, c in enumerate(dct([F.col(f"{part}_{n}") for n in taus]))}
    return out.withColumns(new).drop(*[f"_{f}" for f in relative])


def relative_future(df: DataFrame, relative: list[str], angles: list[str], n: int) -> DataFrame:
    """<feature>_future: the relative pose at 1 .. n frames ahead, from the row's own and the DCT of its changes."""
    return df.withColumns({f"{f}_future": future_values(F.col(f), idct_array(F.col(f"{f}_dct"), n), f in angles) for f in relative})


def first_rows(df: DataFrame, keys: list[str], t: str, n: int = 2) -> DataFrame:
    """The first n rows of each session: where integration begins."""
    return df.withColumn("_r", F.row_number().over(_w(keys, t))).where(F.col("_r") <= n).drop("_r")


def future_positions(df: DataFrame, x: str, y: str, theta: str, keys: list[str], t: str, taus: list[int]) -> DataFrame:
    """One row per row and look-ahead: (keys, t, tau, x, y, theta) predicted from the look-ahead displacement."""
    moved = global_velocity(df, x, y, theta, keys, t, taus)
    options = F.array(*[F.struct(F.lit(n).alias("tau"), F.col(f"fwd_{n}").alias("fwd"), F.col(f"side_{n}").alias("side"), F.col(f"turn_{n}").alias("turn")) for n in taus])
    rows = moved.select(*keys, t, x, y, theta, F.explode(options).alias("o")).where(F.col("o.fwd").isNotNull())
    dx, dy = rotate(F.col("o.side"), F.col("o.fwd"), -F.col(theta))
    return rows.select(*keys, t, F.col("o.tau").alias("tau"), (F.col(x) + dx).alias("future_x"), (F.col(y) + dy).alias("future_y"), mod2pi(F.col(theta) + F.col("o.turn")).alias("future_theta"))


def every_of(flag: Column, before: int, after: int, w: WindowSpec) -> Column:
    """All rows of a frame around this one are true, and the frame is whole."""
    frame = w.rowsBetween(before, after)
    return F.coalesce(F.bool_and(flag).over(frame) & (F.count(flag).over(frame) == after - before + 1), F.lit(False))


def any_of(flag: Column, before: int, after: int, w: WindowSpec) -> Column:
    return F.coalesce(F.bool_or(flag).over(w.rowsBetween(before, after)), F.lit(False))


def speed_events(df: DataFrame, x: str, keys: list[str], t: str, limit: float, n: int) -> DataFrame:
    """speed, starts_moving (slow for the last n rows, fast within the next n) and stays_stopped (slow for n before and after)."""
    w = _w(keys, t)
    out = df.withColumn("speed", F.abs(F.col(x) - ahead(x, -1, w, t)))
    slow = F.col("speed") < limit
    return out.select("*", (every_of(slow, -(n - 1), 0, w) & any_of(~slow, 1, n, w)).alias("starts_moving"), (every_of(slow, -(n - 1), 0, w) & every_of(slow, 1, n, w)).alias("stays_stopped"))


def smoothed(df: DataFrame, x: str, keys: list[str], t: str, sigma: float = 2.0, reach: float = 4.0, name: str = "smooth") -> DataFrame:
    """Gaussian smoothing over rows within ``reach`` deviations, reflected at the ends of a session."""
    w = _w(keys, t)
    r = int(reach * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total, n = sum(weights), F.count("*").over(Window.partitionBy(*keys))
    values = F.collect_list(x).over(w.rowsBetween(-r, r))
    at = F.least(F.row_number().over(w) - 1, F.lit(r))
    out = df.withColumn("_v", values).withColumn("_at", at).withColumn("_n", n)
    # position k of the kernel, mirrored into the rows at hand (half-sample symmetric)
    size = F.size("_v")
    def mirrored(i: Column) -> Column:
        i = F.when(i < 0, -i - 1).otherwise(i)
        return F.get(F.col("_v"), F.when(i >= size, 2 * size - i - 1).otherwise(i))
    value = sum((mirrored(F.col("_at") + k) * (wt / total) for k, wt in zip(range(-r + 1, r + 1), weights[1:])), mirrored(F.col("_at") - r) * (weights[0] / total))
    return out.withColumn(name, F.when(F.col("_n") > 2 * r, value)).drop("_v", "_at", "_n")


def aligned_inputs(df: DataFrame, label: str, keys: list[str], t: str, name: str = "label_before") -> DataFrame:
    """Each row with the label of the frame before it; rows without one are left out."""
    w = _w(keys, t)
    return df.withColumn(name, ahead(label, -1, w, t)).where(F.col(name).isNotNull())
