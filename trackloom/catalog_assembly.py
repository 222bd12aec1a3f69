"""Registered queries of dataset assembly, look-aheads of relative poses and the way back from chunks, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.catalog import KP, LENGTH, POSE_PARTS, POSES, d6, query, r6, wrap
from trackloom.functions import geometry as g
from trackloom.operators import agents, binning, evaluation, motion, pose, sequences, stats
from trackloom.plans import assembly, loading
from trackloom.sources import tracks

BINS, OUTLIER, AHEAD = 5, 0.001, 4
#: Two relative features, an angle and a length.
TURNING, STRETCHING = "abdomen_angle", "left_front_leg_tip_dist"


def _valid() -> Column:
    """Some rows of every agent are missing, so tracks fall into sessions."""
    return (F.col("agent") * 31 + F.col("t")) % 23 != 5


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kp = tracks.embedding_keypoints(spark, d)
    sizes = pose.scales(kp)
    return assembly.feature_rows(kp, sizes, _valid()), sizes


# ---- the same in SQL: poses, sessions, velocities and senses

_STEP = {n: wrap(f"lead({n}) OVER w - {n}") if a else f"lead({n}) OVER w - {n}" for n, a in zip(pose.POSE, assembly.ANGLES)}
_DX, _DY = "(lead(thorax_front_x) OVER w - thorax_front_x)", "(lead(thorax_front_y) OVER w - thorax_front_y)"
_VELOCITY = [f"{_DY} * cos(orientation) - {_DX} * sin(orientation)", f"{_DX} * cos(orientation) + {_DY} * sin(orientation)", wrap("lead(orientation) OVER w - orientation"), *[_STEP[n] for n in assembly.RELATIVE]]
ROWS = (
    POSES + ", pf AS (SELECT agent, t, " + ", ".join(f"{POSE_PARTS[n]} AS {n}" for n in pose.POSE) + " FROM b WHERE (agent * 31 + t) % 23 <> 5),\n"
    "si AS (SELECT *, t - row_number() OVER (PARTITION BY agent ORDER BY t) AS island FROM pf),\n"
    "se AS (SELECT *, min(t) OVER (PARTITION BY agent, island) AS session FROM si),\n"
    "ve AS (SELECT *, CASE WHEN lead(t) OVER w IS NOT NULL THEN [" + ", ".join(_VELOCITY) + "] END AS velocity, [" + ", ".join(assembly.RELATIVE) + "] AS relative_pose FROM se WINDOW w AS (PARTITION BY agent, session ORDER BY t)),\n"
    "fr AS (SELECT *, lag(velocity) OVER (PARTITION BY agent, session ORDER BY t) AS velocity_before FROM ve)"
)
_LIST = lambda names: "[" + ", ".join(f"{{'x': {n}_x, 'y': {n}_y}}" for n in names) + "]"
_HEAD = wrap("atan2((left_front_thorax_y + right_front_thorax_y) / 2 - base_thorax_y, (left_front_thorax_x + right_front_thorax_x) / 2 - base_thorax_x) - pi() / 2")
SENSED = f""", ok AS (SELECT * FROM kp WHERE (agent * 31 + t) % 23 <> 5),
ey AS (SELECT agent, t, antennae_midpoint_x AS ex, antennae_midpoint_y AS ey, {_HEAD} + pi() / 2 AS th FROM ok), so AS (SELECT agent AS other, t, unnest({_LIST(agents.SEEN)}) AS p FROM ok),
sm AS (SELECT ey.t, ey.agent, other, (p.x - ex) * cos(th) + (p.y - ey) * sin(th) AS x, (p.y - ey) * cos(th) - (p.x - ex) * sin(th) AS y FROM ey JOIN so ON ey.t = so.t AND ey.agent <> so.other),
sa AS (SELECT t, agent, other, atan2(y, x) AS a, sqrt(x * x + y * y) AS d FROM sm), sk AS (SELECT *, least(floor((a + pi()) / (2 * pi() / 72)), 71)::INT AS s FROM sa),
sg AS (SELECT t, agent, other, min(d) AS d, min(s) AS lo, max(s) AS hi, bool_or(a > pi() / 2) AND bool_or(a < -pi() / 2) AND NOT bool_or(abs(a) <= pi() / 2) AS behind, max(s) FILTER (a < 0) AS neg, min(s) FILTER (a >= 0) AS pos FROM sk GROUP BY ALL),
sh AS (SELECT t, agent, d, unnest(CASE WHEN behind THEN list_concat(range(0, neg + 1), range(pos, 72)) ELSE range(lo, hi + 1) END)::INT AS sector FROM sg), sz AS (SELECT t, agent, sector, min(d) AS d FROM sh GROUP BY ALL),
vi AS (SELECT agent, t, sector AS idx, 1 - least(1.0, {agents.VISION_FACTOR!r}::DOUBLE * pow(d, {agents.VISION_EXPONENT})) AS x FROM sz),
ta AS (SELECT agent, t, unnest(range(0, 19))::INT AS own, unnest(kp) AS p FROM ok), tb AS (SELECT agent, t, unnest(range(0, 5))::INT AS other, unnest({_LIST(agents.TOUCHED)}) AS q FROM ok),
tm AS (SELECT ta.t, ta.agent, own * 5 + other AS idx, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM ta JOIN tb ON ta.t = tb.t AND ta.agent <> tb.agent GROUP BY ALL),
to_ AS (SELECT agent, t, idx, 1 - least(1.0, {agents.TOUCH_FACTOR!r}::DOUBLE * pow(d, {agents.TOUCH_EXPONENT})) AS x FROM tm),
wa AS (SELECT agent, t, own AS idx, least(greatest({agents.CHAMBER_HEIGHT} - (sqrt(p.x * p.x + p.y * p.y) - {agents.INNER_RADIUS}) * {agents.CHAMBER_HEIGHT} / {agents.ARENA_RADIUS - agents.INNER_RADIUS!r}::DOUBLE, 0), {agents.CHAMBER_HEIGHT}) AS x FROM ta)"""
_GRID = lambda name, n, table: f"SELECT '{name}' AS grp, gr.agent, gr.t, gr.idx, coalesce({table}.x, 0) AS x FROM (SELECT agent, t, unnest(range(0, {n}))::INT AS idx FROM fr) gr LEFT JOIN {table} USING (agent, t, idx)"
_LONG = lambda name, n: f"SELECT '{name}' AS grp, agent, t, unnest(range(0, {n}))::INT AS idx, unnest({name}) AS x FROM fr WHERE {name} IS NOT NULL"
DATASET = ROWS + SENSED + f""", lo AS ({" UNION ALL ".join([_LONG("velocity", 29), _LONG("velocity_before", 29), _LONG("relative_pose", 26), _GRID("vision", 72, "vi"), _GRID("touch", 95, "to_"), _GRID("wall", 19, "wa")])}),
mo AS (SELECT grp, idx, avg(x) AS mean, stddev_pop(x) AS sd FROM lo GROUP BY grp, idx),
zs AS (SELECT lo.grp, agent, t, lo.idx, (x - mean) / nullif(sd, 0) AS z FROM lo JOIN mo ON lo.grp = mo.grp AND lo.idx = mo.idx),
qe AS (SELECT idx, quantile_cont(z, {[OUTLIER + (1 - 2 * OUTLIER) * i / BINS for i in range(BINS + 1)]}) AS edges FROM zs WHERE grp = 'velocity' AND idx < 3 GROUP BY idx),
bi AS (SELECT agent, t, zs.idx, least(greatest(len(list_filter(edges, lambda v: v <= z)) - 1, 0), {BINS - 1})::INT AS bin FROM zs JOIN qe ON zs.idx = qe.idx WHERE grp = 'velocity'),
su AS (SELECT agent, t, grp, sum(z * (idx + 1)) AS total FROM zs WHERE grp <> 'velocity' GROUP BY agent, t, grp UNION ALL SELECT agent, t, 'continuous', sum(z * (idx - 2)) FROM zs WHERE grp = 'velocity' AND idx > 2 GROUP BY agent, t),
wi AS (SELECT agent, t, {", ".join(f"max(total) FILTER (grp = '{c}') AS {c}" for c in (*assembly.INPUTS, "continuous"))} FROM su GROUP BY agent, t),
wb AS (SELECT agent, t, max(bin) FILTER (idx = 0) AS forward_bin, max(bin) FILTER (idx = 1) AS sideways_bin, max(bin) FILTER (idx = 2) AS turn_bin FROM bi GROUP BY agent, t),
ch AS (SELECT agent, t, session + 1 AS session, session + 1 + ((t - session - 1) // {LENGTH}) * {LENGTH} AS chunk_start, thorax_front_x, orientation FROM fr WHERE velocity IS NOT NULL AND velocity_before IS NOT NULL),
cn AS (SELECT *, count(*) OVER (PARTITION BY agent, session, chunk_start) AS found FROM ch)"""
_TOTALS = (*assembly.INPUTS, "continuous")


@query(DATASET + f" SELECT cn.agent, session, chunk_start, (cn.t - chunk_start)::INT AS pos, round(min_by(thorax_front_x, cn.t) OVER c, 5) + 0.0 AS start_x, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _TOTALS) + f", forward_bin, sideways_bin, turn_bin FROM cn JOIN wi USING (agent, t) JOIN wb USING (agent, t) WHERE found = {LENGTH} WINDOW c AS (PARTITION BY cn.agent, session, chunk_start)")
def assembled_dataset(spark, d):
    """All input and label groups of the chunks: bins as they are, every other group as the sum of its features times their places."""
    rows, _ = _features(spark, d)
    made = assembly.assemble(rows, LENGTH, BINS, outlier=OUTLIER)
    out = made.chunks.select("agent", "session", "chunk_start", F.get("start", F.lit(0)).alias("x"), F.inline("rows"))
    weighted = lambda c: F.aggregate(F.zip_with(c, F.sequence(F.lit(1), F.size(c)), lambda z, i: F.coalesce(z * i, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    totals = [(F.round(weighted(c), 4) + 0.0).alias(n) for n, c in zip(_TOTALS, (*assembly.INPUTS, "velocity_continuous"))]
    bins = [F.get("velocity_discrete_bins", F.lit(i)).alias(f"{n}_bin") for i, n in enumerate(assembly.DISCRETE)]
    return out.select("agent", "session", "chunk_start", "pos", (F.round("x", 5) + 0.0).alias("start_x"), *totals, *bins)


@query(ROWS + " SELECT agent, t, session, " + ", ".join(f"round(velocity[{i + 1}], 5) + 0.0 AS {n}" for i, n in enumerate(assembly.VELOCITY)) + " FROM fr")
def pose_velocity(spark, d):
    rows, _ = _features(spark, d)
    return rows.select("agent", "t", "session", *[(F.round(F.get("velocity", F.lit(i)), 5) + 0.0).alias(n) for i, n in enumerate(assembly.VELOCITY)])


_CHUNKED = ROWS + f""", ch AS (SELECT *, session + 1 + ((t - session - 1) // {LENGTH}) * {LENGTH} AS chunk_start FROM fr WHERE velocity IS NOT NULL AND velocity_before IS NOT NULL),
cn AS (SELECT *, count(*) OVER (PARTITION BY agent, session, chunk_start) AS found FROM ch)"""
_BACK = [n for n, a in zip(pose.POSE, assembly.ANGLES) if n in assembly.RELATIVE]


@query(_CHUNKED + " SELECT agent, chunk_start, t, " + ", ".join((f"round(cos({n}), 5) + 0.0" if n.endswith("_angle") else f"round({n}, 5) + 0.0") + f" AS {n}" for n in _BACK) + f" FROM cn WHERE found = {LENGTH}")
def item_relative_poses(spark, d):
    """Relative poses of the tracks that chunks are undone to, from their scaled labels and start poses alone: those of the data.
    Angles as cosines, as they come back wrapped."""
    rows, sizes = _features(spark, d)
    made = assembly.assemble(rows, LENGTH, BINS, outlier=OUTLIER)
    back = assembly.item_poses(made.chunks, made.params(), sizes)
    value = lambda n: F.get("pose", F.lit(pose.POSE.index(n)))
    return back.select("agent", "chunk_start", "t", *[(F.round(F.cos(value(n)) if n.endswith("_angle") else value(n), 5) + 0.0).alias(n) for n in _BACK])


def _lookahead_rows(spark: SparkSession, d: str) -> DataFrame:
    kp = tracks.embedding_keypoints(spark, d)
    return pose.pose_features(kp, pose.scales(kp)).select("agent", "t", *pose.POSE[:3], TURNING, STRETCHING)


_AHEAD = (
    POSES + f", pf AS (SELECT agent, t, {POSE_PARTS['thorax_front_x']} AS x, {POSE_PARTS[TURNING]} AS a, {POSE_PARTS[STRETCHING]} AS l FROM b),\n"
    f"st AS (SELECT *, {wrap('lead(a) OVER w - a')} AS da, lead(l) OVER w - l AS dl FROM pf WINDOW w AS (PARTITION BY agent ORDER BY t)),\n"
    "ah AS (SELECT *, " + ", ".join(f"sum({s}) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS {s}{k + 1}" for s in ("da", "dl") for k in range(AHEAD)) + f", count(da) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND {AHEAD - 1} FOLLOWING) AS found, lead(x, 5) OVER (PARTITION BY agent ORDER BY t) AS far FROM st)"
)


def _dct_sql(s: str, k: int) -> str:
    return " + ".join(f"{s}{i + 1} * {w!r}::DOUBLE" for i, w in enumerate(g.dct_rows(AHEAD)[k]))


@query(_AHEAD + f" SELECT agent, t, {d6('da1')} AS angle_d1, {d6('dl1')} AS length_d1, " + ", ".join(f"{d6(_dct_sql(s, k))} AS {n}_dct{k}" for s, n in (("da", "angle"), ("dl", "length")) for k in range(AHEAD)) + f" FROM ah WHERE found = {AHEAD} AND far IS NOT NULL")
def movement_relative_dct(spark, d):
    """Relative features' changes over the next frames as DCT, of rows that have all look-aheads, global ones to 5 frames too."""
    out = motion.movement(_lookahead_rows(spark, d), *pose.POSE[:3], [TURNING, STRETCHING], [TURNING], ["agent"], "t", [1, 5], relative_dct=AHEAD)
    names = {"angle": TURNING, "length": STRETCHING}
    return out.select("agent", "t", *[r6(f"{f}_d1").alias(f"{n}_d1") for n, f in names.items()], *[r6(F.get(f"{f}_dct", F.lit(k))).alias(f"{n}_dct{k}") for n, f in names.items() for k in range(AHEAD)])


@query(_AHEAD + f", le AS (SELECT *, " + ", ".join(f"lead(a, {k + 1}) OVER w AS a{k + 1}, lead(l, {k + 1}) OVER w AS l{k + 1}" for k in range(AHEAD)) + f" FROM ah WINDOW w AS (PARTITION BY agent ORDER BY t)) SELECT agent, t, " + ", ".join(f"{d6(f'cos(a{k + 1})')} AS cos_angle{k + 1}, {d6(f'l{k + 1}')} AS length{k + 1}" for k in range(AHEAD)) + f" FROM le WHERE found = {AHEAD} AND far IS NOT NULL")
def relative_future(spark, d):
    """Future relative poses from the current one and the DCT of its changes: they are what the later frames hold."""
    out = motion.movement(_lookahead_rows(spark, d), *pose.POSE[:3], [TURNING, STRETCHING], [TURNING], ["agent"], "t", [1, 5], relative_dct=AHEAD)
    out = motion.relative_future(out, [TURNING, STRETCHING], [TURNING], AHEAD)
    at = lambda f, k: F.get(f"{f}_future", F.lit(k))
    return out.select("agent", "t", *[c for k in range(AHEAD) for c in (r6(F.cos(at(TURNING, k))).alias(f"cos_angle{k + 1}"), r6(at(STRETCHING, k)).alias(f"length{k + 1}"))])


@query(KP + ", lo AS (SELECT unnest(range(0, 4)) AS key, unnest([wing_right_x, wing_right_y, wing_left_x, wing_left_y]) AS x FROM kp), q AS (SELECT key, quantile_cont(x, [0.01, 0.255, 0.5, 0.745, 0.99]) AS e FROM lo GROUP BY key) SELECT key::INT AS key, unnest(range(0, 5))::INT AS edge, round(unnest(e), 6) + 0.0 AS value FROM q")
def joint_quantile_edges(spark, d):
    """Edges of several columns from the same passes: exact ranks by refinement."""
    kp = tracks.embedding_keypoints(spark, d)
    rows = kp.select(F.array(*pose.at("wing_right"), *pose.at("wing_left")).alias("v"))
    edges = binning.joint_edges(rows, "v", 4, outlier=0.01)
    return spark.createDataFrame([(k, i, round(v, 6) + 0.0) for k, e in enumerate(edges) for i, v in enumerate(e)], "key int, edge int, value double")


# ---- loading, noise, comparison of predictions


def _videos(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints as an archive gives them: videos of 20 frames, categories by agent and frame."""
    kp = tracks.embedding_keypoints(spark, d)
    y = F.create_map(F.lit("female"), (F.col("agent") % 2).cast("int"), F.lit("resting"), (F.col("t") % 3 == 0).cast("int"))
    return kp.withColumns({"videoidx": F.floor(F.col("t") / 20).cast("int"), "y": y, "isdata": F.col("t") % 40 < 25, "useoutputmask": F.lit(True)})


@query(KP + """, v AS (SELECT agent, t, id, (t // 20)::INT AS videoidx, agent % 2 = 1 AND t % 40 < 25 AS isdata, t % 3 = 0 AS useoutputmask, tip_abdomen_x AS x FROM kp),
k AS (SELECT * FROM v WHERE videoidx IN (SELECT videoidx FROM v WHERE isdata)), m AS (SELECT agent, t, id, videoidx, isdata, useoutputmask, x FROM k UNION ALL SELECT agent, t, id + (SELECT max(id) FROM k) + 1, videoidx + (SELECT max(videoidx) FROM k) + 1, isdata, useoutputmask, -x FROM k)
SELECT agent, t, id::INT AS id, videoidx::INT AS videoidx, isdata, useoutputmask, """ + d6("x") + " AS tip_x FROM m WHERE id IN (SELECT id FROM m WHERE isdata)")
def training_rows(spark, d):
    """Filtered by category, condensed to videos with data, mirrored, and without individuals that cannot be measured."""
    rows, _ = loading.training_rows(_videos(spark, d), ["female"], ["resting"], mirror=True)
    # the abdomen's tip lies on the body's axis, so its mirror image is its own
    return rows.select("agent", "t", "id", "videoidx", "isdata", "useoutputmask", r6(pose.at("tip_abdomen")[0]).alias("tip_x"))


_COV = [[0.04, 0.01, 0.0], [0.01, 0.02, -0.005], [0.0, -0.005, 0.01]]
_CHOL = np.linalg.cholesky(np.array(_COV)).tolist()


def _u(salt: str, part: int, seed: int) -> str:
    return f"((('0x' || substr(md5(agent::VARCHAR || ':' || t::VARCHAR || ':{seed}:' || {salt}), {1 + 12 * part}, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


_NORMAL = [f"(sqrt(-2 * ln({_u(repr(str(j)), 0, 3)})) * cos(6.283185307179586::DOUBLE * {_u(repr(str(j)), 1, 3)}))" for j in range(3)]
_PERTURBED = KP + ", z AS (SELECT agent, t, tip_abdomen_x AS a, tip_abdomen_y AS b, base_thorax_x AS c, " + ", ".join(f"{z} AS z{j}" for j, z in enumerate(_NORMAL)) + " FROM kp), n AS (SELECT agent, t, a, b, c, " + ", ".join(f"{x} + " + " + ".join(f"z{j} * {_CHOL[i][j]!r}::DOUBLE" for j in range(i + 1)) + f" AS p{i}" for i, x in enumerate("abc")) + " FROM z)"


def _points3(spark: SparkSession, d: str) -> DataFrame:
    kp = tracks.embedding_keypoints(spark, d)
    return kp.select("agent", "t", F.array(*pose.at("tip_abdomen"), pose.at("base_thorax")[0]).alias("v"))


@query(_PERTURBED + " SELECT agent, t, " + ", ".join(f"{d6(f'p{i}')} AS p{i}" for i in range(3)) + " FROM n")
def correlated_noise(spark, d):
    """Coordinates with noise of a given covariance."""
    out = stats.correlated_noise(_points3(spark, d), "v", _COV, ["agent", "t"], 3)
    return out.select("agent", "t", *[r6(F.get("v", F.lit(i))).alias(f"p{i}") for i in range(3)])


@query(_PERTURBED + ", s AS (SELECT *, lead(a) OVER w - a AS da, lead(p0) OVER w - p0 AS dp, lead(b) OVER w - b AS db, lead(p1) OVER w - p1 AS dq FROM n WINDOW w AS (PARTITION BY agent ORDER BY t)) SELECT 'a' AS feature, " + d6("sqrt(avg((dp - da) ** 2))") + " AS scale FROM s UNION ALL SELECT 'b', " + d6("sqrt(avg((dq - db) ** 2))") + " FROM s")
def noise_scale_correlated(spark, d):
    """How far correlated noise of the points moves their one-step changes: root mean squares."""
    def steps(rows: DataFrame) -> DataFrame:
        out = rows.select("agent", "t", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))
        for c, n in (("x", "a"), ("y", "b")):
            out = motion.relative_velocity(out, c, ["agent"], "t").withColumnRenamed(f"{c}_d1", n)
        return out

    rows = _points3(spark, d)
    out = stats.rms_difference(steps(rows), steps(stats.correlated_noise(rows, "v", _COV, ["agent", "t"], 3)), ["agent", "t"], ["a", "b"])
    return out.select("feature", r6("scale").alias("scale"))


_ERRORS = ", e AS (SELECT row_number() OVER (ORDER BY agent, t) - 1 AS idx, wing_left_x / 100 AS e0, wing_left_y / 100 AS e1, wing_right_x / 100 AS e2 FROM kp WHERE agent = 0)"


@query(KP + _ERRORS + f", i AS (SELECT agent, t, tip_abdomen_x AS a, tip_abdomen_y AS b, base_thorax_x AS c, floor({_u(repr('row'), 0, 4)} * (SELECT count(*) FROM e))::BIGINT AS idx FROM kp) SELECT agent, t, {d6('a + e0')} AS p0, {d6('b + e1')} AS p1, {d6('c + e2')} AS p2 FROM i JOIN e USING (idx)")
def resampled_noise(spark, d):
    """Coordinates with errors drawn from a table, a whole error vector to a row."""
    kp = tracks.embedding_keypoints(spark, d)
    errors = kp.where("agent = 0").select("agent", "t", F.transform(F.array(*pose.at("wing_left"), pose.at("wing_right")[0]), lambda v: v / 100).alias("error"))
    errors = sequences.running_offsets(errors, ["agent", "t"], name="idx")
    out = stats.resampled_noise(_points3(spark, d), "v", errors, errors.count(), ["agent", "t"], 4)
    return out.select("agent", "t", *[r6(F.get("v", F.lit(i))).alias(f"p{i}") for i in range(3)])


@query(KP + ", m AS (SELECT min(tip_abdomen_x) AS lo, max(tip_abdomen_x) AS hi FROM kp), v AS (SELECT true AS is_label, tip_abdomen_x AS x FROM kp UNION ALL SELECT false, base_thorax_x FROM kp), b AS (SELECT is_label, least(floor((x - lo) / ((hi - lo) / 8)), 7)::INT AS bin FROM v, m WHERE x BETWEEN lo AND hi), g AS (SELECT unnest(range(0, 8))::INT AS bin) SELECT g.bin, count(*) FILTER (is_label) AS labels, count(*) FILTER (NOT is_label) AS predictions FROM g LEFT JOIN b USING (bin) GROUP BY g.bin")
def paired_histogram(spark, d):
    """Labels and predictions over the same bins."""
    kp = tracks.embedding_keypoints(spark, d).select(pose.at("tip_abdomen")[0].alias("y"), pose.at("base_thorax")[0].alias("p"))
    return stats.paired_histogram(kp, "y", "p", bins=8).select("bin", "labels", "predictions")


@query(KP + ", s AS (SELECT agent, t // 7 AS part, t, tip_abdomen_x AS y, base_thorax_x AS p FROM kp), n AS (SELECT agent, part, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT *, coalesce(sum(n + 2) OVER (ORDER BY agent, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n), r AS (SELECT (b + row_number() OVER (PARTITION BY agent, part ORDER BY t) - 1)::BIGINT AS axis, agent, part, y, p FROM s JOIN o USING (agent, part) UNION ALL SELECT unnest([b + n, b + n + 1])::BIGINT, agent, part, NULL, NULL FROM o) SELECT axis, agent, part, " + d6("y") + " AS y, " + d6("p") + " AS p FROM r")
def one_axis(spark, d):
    """Labels and predictions of many segments on one axis, with two empty rows after each."""
    kp = tracks.embedding_keypoints(spark, d).select("agent", F.floor(F.col("t") / 7).alias("part"), "t", pose.at("tip_abdomen")[0].alias("y"), pose.at("base_thorax")[0].alias("p"))
    return evaluation.one_axis(kp, ["agent", "part"], "t", ["y", "p"], gap=2).withColumns({"y": r6("y"), "p": r6("p")})
