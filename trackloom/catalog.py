"""Registered queries over the given tables, and their DuckDB SQL.

Doubles are rounded to 6 places on both sides, since the two engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import agents, augment, binning, evaluation, filters, motion, pose, projections, sequences, stats
from trackloom.plans import dataset
from trackloom.plans.stages import FeatureFrame, OddRoot, ZScore, replay
from trackloom.sources import tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LENGTH, TAUS = 8, [1, 2, 5]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def draw(keys: list[str], seed: int, salt: str, part: int = 0) -> str:
    """The number in (0, 1) that stats.hash_draw makes, in SQL."""
    text = " || ':' || ".join([*[f"({k})::VARCHAR" for k in keys], f"'{seed}'", f"'{salt}'"])
    return f"((('0x' || substr(md5({text}), {1 + 12 * part}, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def normal(keys: list[str], seed: int, salt: str) -> str:
    return f"(sqrt(-2 * ln({draw(keys, seed, salt)})) * cos(6.283185307179586::DOUBLE * {draw(keys, seed, salt, 1)}))"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# ---- views of the given tables in SQL

TRACK = """WITH RECURSIVE track AS (SELECT user_id AS agent, row_number() OVER w - 1 AS t, value AS x, event_type AS category, event_type <> 'error' AS isdata,
  coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000, true) AS isstart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
RUNS = TRACK + """,
v AS (SELECT *, isdata AND x IS NOT NULL AS ok FROM track),
n AS (SELECT *, CASE WHEN isstart OR NOT coalesce(lag(ok) OVER w, false) THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY agent ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY agent ORDER BY t) AS island FROM n),
r AS (SELECT agent, t, x, category, isstart, min(t) OVER (PARTITION BY agent, island) AS session FROM i WHERE ok),
s AS (SELECT agent, session AS start, count(*) AS duration FROM r GROUP BY agent, session)"""
SEQ = """WITH seq AS (SELECT l_suppkey AS seq, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos, l_extendedprice::DOUBLE AS x, l_quantity::DOUBLE AS quantity FROM lineitem)"""
_P = {n: (f"(embedding[{2 * i + 1}]::DOUBLE * 100)", f"(embedding[{2 * i + 2}]::DOUBLE * 100)") for i, n in enumerate(pose.KEYPOINTS)}
KP = "WITH kp AS (SELECT (vec_id % 5)::INT AS agent, (vec_id // 5)::BIGINT AS t, (vec_id % 5)::INT AS id, list_transform(range(0, 19), lambda i: {'x': embedding[2 * i + 1]::DOUBLE * 100, 'y': embedding[2 * i + 2]::DOUBLE * 100}) AS kp, " + ", ".join(f"{x} AS {n}_x, {y} AS {n}_y" for n, (x, y) in _P.items()) + " FROM embeddings)"


def wrap(x: str) -> str:
    return f"(({x}) - 2 * pi() * floor((({x}) + pi()) / (2 * pi())))"


def d6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _track(spark, d):
    return tracks.events_track(spark, d)


def _valid():
    return F.col("isdata") & F.col("x").isNotNull()


def _rows(spark, d):
    return sequences.session_rows(_track(spark, d), _valid())


def _sessions(spark, d):
    return sequences.sessions(_track(spark, d), _valid())


# ---- sequences and windows


@query(TRACK + " SELECT agent, t, isdata, isstart FROM track")
def sequence_start_flags(spark, d):
    return _track(spark, d).select("agent", "t", "isdata", "isstart")


@query(TRACK + """, w AS (SELECT agent, t, isdata, coalesce(isdata IS DISTINCT FROM lag(isdata) OVER o, true) AS isstart FROM track WINDOW o AS (PARTITION BY agent ORDER BY t)) SELECT agent, t, isstart FROM w""")
def start_flags_by_id(spark, d):
    """A new sequence where the identity (here the row's validity) changes."""
    return sequences.start_flags(_track(spark, d).drop("isstart"), id="isdata").select("agent", "t", "isstart")


@query(RUNS + " SELECT agent, start, duration FROM s")
def sessions(spark, d):
    return _sessions(spark, d)


@query(RUNS + f" SELECT agent, start, unnest(generate_series(start, start + duration - {LENGTH}, {LENGTH})) AS chunk_start FROM s WHERE duration >= {LENGTH}")
def chunks(spark, d):
    return sequences.chunks(_sessions(spark, d), LENGTH).select("agent", "start", "chunk_start")


@query(RUNS + f", c AS (SELECT *, session + 2 + ((t - session - 2) // {LENGTH}) * {LENGTH} AS c FROM r WHERE t >= session + 2) SELECT agent, session, c AS chunk_start, {d6('sum(x)')} AS total, {d6('min_by(x, t)')} AS first_x FROM c GROUP BY agent, session, c HAVING count(*) = {LENGTH} AND bool_or(category = 'purchase')")
def chunk_examples(spark, d):
    """Chunks with an offset of two rows, kept where any row is a purchase."""
    rows = _rows(spark, d).withColumn("mask", F.col("category") == "purchase")
    out = sequences.chunk_examples(rows, ["x", "mask"], LENGTH, 2, "mask")
    return out.select("agent", "session", "chunk_start", r6(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["x"])).alias("total"), r6(F.get("rows", F.lit(0))["x"]).alias("first_x"))


@query(RUNS + f" SELECT agent, start, unnest(generate_series(0, duration - {LENGTH})) AS \"window\", start + unnest(generate_series(0, duration - {LENGTH})) AS window_start FROM s WHERE duration >= {LENGTH}")
def sliding_windows(spark, d):
    return sequences.sliding_windows(_sessions(spark, d), LENGTH).select("agent", "start", "window", "window_start")


@query(RUNS + f" SELECT agent, start, count(*) AS windows FROM (SELECT agent, start, unnest(generate_series(0, duration - {LENGTH}, 3)) FROM s WHERE duration >= {LENGTH}) GROUP BY agent, start")
def strided_windows(spark, d):
    return sequences.sliding_windows(_sessions(spark, d), LENGTH, 3).groupBy("agent", "start").agg(F.count("*").alias("windows"))


@query(RUNS + f", w AS (SELECT agent, start, unnest(generate_series(0, duration - {LENGTH}, 3)) AS o FROM s WHERE duration >= {LENGTH}), f AS (SELECT r.agent, r.session, r.t, max(o) AS o FROM w JOIN r ON r.agent = w.agent AND r.session = w.start AND r.t BETWEEN start + o AND start + o + {LENGTH - 1} GROUP BY ALL) SELECT f.agent, f.session, f.t, {d6('r.x + f.o')} AS value FROM f JOIN r USING (agent, session, t)")
def stitch_windows(spark, d):
    """Windows at a stride of 3, each value marked with its window's offset, stitched with the last window on top."""
    rows = _rows(spark, d)
    w = Window.partitionBy("agent", "session").orderBy("t")
    values = F.collect_list("x").over(w.rowsBetween(0, LENGTH - 1))
    wins = rows.withColumn("o", F.col("t") - F.col("session")).withColumn("v", values).where((F.size("v") == LENGTH) & (F.col("o") % 3 == 0)).select("agent", "session", "o", "t", F.transform("v", lambda x: x + F.col("o")).alias("v"))
    return sequences.stitch(wins.withColumnRenamed("t", "s"), ["agent", "session"], "o", "s", "v").select("agent", "session", "t", r6("value").alias("value"))


@query(TRACK + ", k AS (SELECT agent, t, sum((isdata)::INT) OVER w AS n, count(*) OVER w AS c FROM track WINDOW w AS (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT agent, t, n = 5 AND c = 5 AS every FROM k")
def interval_all(spark, d):
    return _track(spark, d).select("agent", "t", sequences.interval_all(F.col("isdata"), 5, ["agent"], "t").alias("every"))


@query(TRACK + ", k AS (SELECT agent, t, t - row_number() OVER (PARTITION BY agent ORDER BY t) AS island FROM track WHERE isdata) SELECT agent, min(t) AS first, max(t) + 1 AS \"end\" FROM k GROUP BY agent, island")
def run_ends(spark, d):
    return sequences.run_ends(_track(spark, d), F.col("isdata"), ["agent"], "t")


@query(TRACK + """, k AS (SELECT agent, t, sum((isdata AND x IS NOT NULL)::INT) OVER w AS n, count(*) OVER w AS c, sum(isstart::INT) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS breaks FROM track WINDOW w AS (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
c AS (SELECT agent, t, t - row_number() OVER (PARTITION BY agent ORDER BY t) AS island FROM k WHERE n = 7 AND c = 7 AND breaks = 0), e AS (SELECT agent, min(t) AS a, max(t) AS b FROM c GROUP BY agent, island) SELECT agent, unnest(generate_series(a, b, 5)) AS t0 FROM e""")
def spaced_chunks(spark, d):
    return sequences.spaced_chunks(_track(spark, d), _valid(), 5, 2)


@query(TRACK + " SELECT agent AS id, min(t) AS t0, max(t) - min(t) + 1 AS n FROM track WHERE isdata GROUP BY agent HAVING max(t) - min(t) + 1 >= 20")
def segments_by_id(spark, d):
    return sequences.segments_by_id(_track(spark, d).where("isdata"), "agent", "t", 20).withColumnRenamed("agent", "id")


@query(TRACK + """, k AS (SELECT agent, category AS id, t, coalesce(lag(category) OVER w = category, false) AS back, isdata FROM track WINDOW w AS (PARTITION BY agent ORDER BY t)),
i AS (SELECT *, t - row_number() OVER (PARTITION BY agent, id ORDER BY t) AS island FROM k WHERE isdata) SELECT agent, id, min(t) - min_by(back, t)::INT AS first, max(t) + 1 AS "end" FROM i GROUP BY agent, id, island""")
def intervals_by_id(spark, d):
    return sequences.intervals_by_id(_track(spark, d).withColumnRenamed("category", "id"), F.col("isdata"))


@query(TRACK + ", k AS (SELECT agent, t, t - row_number() OVER (PARTITION BY agent ORDER BY t) AS island FROM track WHERE isdata AND x IS NOT NULL) SELECT agent, min(t) AS first, count(*) AS n FROM k GROUP BY agent, island HAVING count(*) >= 2")
def complete_runs(spark, d):
    return sequences.complete_runs(_track(spark, d).withColumn("x", F.when(F.col("isdata"), F.col("x"))), "x", ["agent"], "t")


@query(SEQ + f", l AS (SELECT seq, count(*) AS n, {draw(['seq'], 3, 'order')} AS h FROM seq GROUP BY seq), o AS (SELECT seq, n, coalesce(sum(n) OVER (ORDER BY h, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM l) SELECT seq, n FROM o WHERE run < (SELECT count(*) // 2 FROM lineitem)")
def subsample_sequences(spark, d):
    """Whole sequences in a seeded order until half of all rows are reached."""
    per = tracks.lineitem_sequences(spark, d).groupBy("seq").agg(F.count("*").alias("n"))
    half = spark.read.parquet(f"{d}/lineitem.parquet").count() // 2
    return sequences.subsample_sequences(per, "seq", "n", half, 3)


@query(TRACK + """, k AS (SELECT agent, t, sum((isdata AND x IS NOT NULL)::INT) OVER w AS n, count(*) OVER w AS c, sum((NOT isstart OR t = 0)::INT) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b, count(*) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS bc FROM track WINDOW w AS (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT agent, min(t) AS t0 FROM k WHERE n = 5 AND c = 5 AND b = 3 AND bc = 3 GROUP BY agent""")
def startable_frames(spark, d):
    return sequences.startable(_track(spark, d), _valid(), 5, 3, ["agent"], "t", "isstart")


@query(SEQ + ", k AS (SELECT seq, pos, count(*) OVER (PARTITION BY seq) AS n FROM seq) SELECT seq, CASE WHEN pos + 1 <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS part, count(*) AS n FROM k GROUP BY ALL")
def split_by_position(spark, d):
    return sequences.split_by_position(tracks.lineitem_sequences(spark, d), ["seq"], ["pos"]).groupBy("seq", "part").agg(F.count("*").alias("n"))


# ---- motion

_LEAD = ", ".join(f"lead(x, {n}) OVER w AS x{n}" for n in TAUS)


@query(RUNS + f" SELECT agent, t, {d6('lead(x) OVER w - x')} AS step FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)")
def step_velocity(spark, d):
    return motion.relative_velocity(_rows(spark, d), "x", ["agent", "session"], "t").select("agent", "t", r6("x_d1").alias("step"))


@query(RUNS + ", " + f"q AS (SELECT agent, t, x, {_LEAD} FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)) SELECT agent, t, " + ", ".join(f"{d6(f'x{n} - x')} AS x_d{n}" for n in TAUS) + " FROM q")
def multi_tau_velocity(spark, d):
    out = motion.relative_velocity(_rows(spark, d), "x", ["agent", "session"], "t", TAUS)
    return out.select("agent", "t", *[r6(f"x_d{n}").alias(f"x_d{n}") for n in TAUS])


@query(RUNS + f", a AS (SELECT agent, t, session, {wrap('x / 20')} AS theta FROM r), b AS (SELECT *, {wrap('lead(theta) OVER w - theta')} AS dt FROM a WINDOW w AS (PARTITION BY agent, session ORDER BY t)) SELECT agent, t, " + ", ".join(f"round(CASE WHEN count(dt) OVER (PARTITION BY agent, session ORDER BY t ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) = {n} THEN sum(dt) OVER (PARTITION BY agent, session ORDER BY t ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END, 6) + 0.0 AS theta_d{n}" for n in TAUS) + " FROM b")
def angle_velocity(spark, d):
    """Turns over look-aheads: sums of wrapped one-step changes, which may exceed half a turn."""
    rows = _rows(spark, d).withColumn("theta", g.mod2pi(F.col("x") / 20))
    out = motion.relative_velocity(rows, "theta", ["agent", "session"], "t", TAUS, True)
    return out.select("agent", "t", *[r6(f"theta_d{n}").alias(f"theta_d{n}") for n in TAUS])


def _planar(spark, d):
    """A point and heading per frame of each agent, from the keypoints."""
    kp = tracks.embedding_keypoints(spark, d)
    (x, y), theta = pose.heading()
    return kp.select("agent", "t", x.alias("px"), y.alias("py"), theta.alias("theta"))


_FX, _FY = "((left_front_thorax_x + right_front_thorax_x) / 2)", "((left_front_thorax_y + right_front_thorax_y) / 2)"
_TH = wrap(f"atan2({_FY} - base_thorax_y, {_FX} - base_thorax_x) - pi() / 2")
PLANAR = KP + f", planar AS (SELECT agent, t, {_FX} AS px, {_FY} AS py, {_TH} AS theta FROM kp), turns AS (SELECT *, {wrap('lead(theta) OVER w - theta')} AS turn, " + ", ".join(f"lead(px, {n}) OVER w - px AS dx{n}, lead(py, {n}) OVER w - py AS dy{n}" for n in TAUS) + " FROM planar WINDOW w AS (PARTITION BY agent ORDER BY t)), moved AS (SELECT agent, t, px, py, theta, " + ", ".join(f"dy{n} * cos(theta) - dx{n} * sin(theta) AS fwd_{n}, dx{n} * cos(theta) + dy{n} * sin(theta) AS side_{n}, CASE WHEN count(turn) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) = {n} THEN sum(turn) OVER (PARTITION BY agent ORDER BY t ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS turn_{n}" for n in TAUS) + " FROM turns)"
_PARTS = [f"{p}_{n}" for n in TAUS for p in ("fwd", "side", "turn")]


@query(PLANAR + " SELECT agent, t, " + ", ".join(f"{d6(p)} AS {p}" for p in _PARTS) + " FROM moved")
def global_velocity(spark, d):
    out = motion.global_velocity(_planar(spark, d), "px", "py", "theta", ["agent"], "t", TAUS)
    return out.select("agent", "t", *[r6(p).alias(p) for p in _PARTS])


@query(PLANAR + f" SELECT agent, t, {d6('px')} AS int_x, {d6('py')} AS int_y, {d6('theta')} AS int_theta FROM moved")
def integrate_roundtrip(spark, d):
    """Velocities integrated from the first row give the positions back."""
    v = motion.global_velocity(_planar(spark, d), "px", "py", "theta", ["agent"], "t")
    out = motion.integrate_global(v, "px", "py", "theta", "fwd_1", "side_1", "turn_1", ["agent"], "t")
    return out.select("agent", "t", r6("int_x").alias("int_x"), r6("int_y").alias("int_y"), r6("int_theta").alias("int_theta"))


@query(PLANAR + f", f AS (SELECT *, unnest([1, 2, 5]) AS tau, unnest([fwd_1, fwd_2, fwd_5]) AS fwd, unnest([side_1, side_2, side_5]) AS side, unnest([turn_1, turn_2, turn_5]) AS turn FROM moved) SELECT agent, t, tau, {d6('px + side * cos(theta) - fwd * sin(theta)')} AS future_x, {d6('py + fwd * cos(theta) + side * sin(theta)')} AS future_y, {d6(wrap('theta + turn'))} AS future_theta FROM f WHERE fwd IS NOT NULL")
def future_positions(spark, d):
    out = motion.future_positions(_planar(spark, d), "px", "py", "theta", ["agent"], "t", TAUS)
    return out.select("agent", "t", "tau", *[r6(c).alias(c) for c in ("future_x", "future_y", "future_theta")])


def _dct_sql(part: str) -> list[str]:
    return [d6(" + ".join(f"{part}_{n} * {w!r}::DOUBLE" for n, w in zip(TAUS, row))) + f" AS {part}_dct{k}" for k, row in enumerate(g.dct_rows(len(TAUS)))]


@query(PLANAR + " SELECT agent, t, " + ", ".join(c for p in ("fwd", "side", "turn") for c in _dct_sql(p)) + " FROM moved WHERE turn_5 IS NOT NULL AND fwd_5 IS NOT NULL")
def movement_dct(spark, d):
    out = motion.movement(_planar(spark, d), "px", "py", "theta", [], [], ["agent"], "t", TAUS, use_dct=True)
    return out.select("agent", "t", *[r6(f"{p}_dct{k}").alias(f"{p}_dct{k}") for p in ("fwd", "side", "turn") for k in range(len(TAUS))])


@query(PLANAR + f" SELECT {d6('avg(abs(fwd_1))')} AS mean_step, 0.0::DOUBLE AS difference FROM moved WHERE turn_5 IS NOT NULL AND fwd_5 IS NOT NULL")
def dct_consistency(spark, d):
    """The first look-ahead from the inverse transform against the one taken directly."""
    out = motion.movement(_planar(spark, d), "px", "py", "theta", [], [], ["agent"], "t", TAUS, use_dct=True)
    back = g.idct([F.col(f"fwd_dct{k}") for k in range(len(TAUS))])[0]
    return out.agg(r6(F.avg(F.abs("fwd_1"))).alias("mean_step"), r6(F.avg(F.abs(back - F.col("fwd_1")))).alias("difference"))


@query(RUNS + f", q AS (SELECT agent, t, session, lead(x / 20, 2) OVER w AS a FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)) SELECT agent, t, {d6('cos(a)')} AS cos_2, {d6('sin(a)')} AS sin_2 FROM q")
def future_pairs(spark, d):
    out = motion.future_pairs(_rows(spark, d).withColumn("a", F.col("x") / 20), "a", ["agent", "session"], "t", [2])
    return out.select("agent", "t", r6("cos_2").alias("cos_2"), r6("sin_2").alias("sin_2"))


@query(RUNS + f", q AS (SELECT agent, t, first_value(x) OVER w AS a, x FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)) SELECT agent, t, {d6('x')} AS integrated FROM q")
def integrate_relative(spark, d):
    v = motion.relative_velocity(_rows(spark, d), "x", ["agent", "session"], "t")
    return motion.integrate_relative(v, "x", "x_d1", ["agent", "session"], "t").select("agent", "t", r6("integrated").alias("integrated"))


@query(TRACK + f", q AS (SELECT agent, t, x, count(*) OVER (PARTITION BY agent) AS n FROM track) SELECT a.agent, a.t, {d6('b.x')} AS rolled FROM q a JOIN q b ON b.agent = a.agent AND b.t = (a.t - 3 + a.n) % a.n")
def roll_circular(spark, d):
    return motion.roll(_track(spark, d), "x", 3, ["agent"], "t", circular=True).select("agent", "t", r6("rolled").alias("rolled"))


@query(RUNS + f" SELECT agent, t, {d6('lag(x, 2) OVER w')} AS rolled FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)")
def roll_by_session(spark, d):
    return motion.roll(_rows(spark, d), "x", 2, ["agent", "session"], "t").select("agent", "t", r6("rolled").alias("rolled"))


@query(RUNS + f" SELECT agent, t, {d6('CASE WHEN count(x) OVER w = 4 THEN sum(x) OVER w END')} AS total FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)")
def rolling_sum(spark, d):
    w = Window.partitionBy("agent", "session").orderBy("t")
    return _rows(spark, d).select("agent", "t", r6(motion.rolling_sum("x", 4, w)).alias("total"))


@query(TRACK + """, q AS (SELECT agent, t, abs(x - lag(x) OVER w) AS speed FROM track WINDOW w AS (PARTITION BY agent ORDER BY t)),
k AS (SELECT agent, t, coalesce(bool_and(speed < 60) OVER a AND count(speed) OVER a = 3, false) AS still, coalesce(bool_or(NOT speed < 60) OVER b, false) AS go, coalesce(bool_and(speed < 60) OVER b AND count(speed) OVER b = 3, false) AS stay FROM q
  WINDOW a AS (PARTITION BY agent ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY agent ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT agent, t, still AND go AS starts_moving, still AND stay AS stays_stopped FROM k""")
def event_starts_moving(spark, d):
    return motion.speed_events(_track(spark, d), "x", ["agent"], "t", 60.0, 3).select("agent", "t", "starts_moving", "stays_stopped")


_K = [math.exp(-0.5 * k * k) for k in range(-4, 5)]


@query(TRACK + f", q AS (SELECT agent, t, x, count(*) OVER (PARTITION BY agent) AS n FROM track), k AS (SELECT q.agent, q.t, unnest(range(-4, 5)) AS k, unnest({[w / sum(_K) for w in _K]}::DOUBLE[]) AS w, n FROM q), m AS (SELECT agent, t, w, n, CASE WHEN t + k < 0 THEN -(t + k) - 1 WHEN t + k >= n THEN 2 * n - (t + k) - 1 ELSE t + k END AS s FROM k WHERE n > 8) SELECT m.agent, m.t, {d6('sum(w * q.x)')} AS smooth FROM m JOIN q ON q.agent = m.agent AND q.t = m.s GROUP BY m.agent, m.t")
def gaussian_smooth(spark, d):
    return motion.smoothed(_track(spark, d), "x", ["agent"], "t", 1.0).where("smooth is not null").select("agent", "t", r6("smooth").alias("smooth"))


@query(RUNS + f" SELECT agent, t, {d6('before')} AS label_before FROM (SELECT agent, t, lag(x) OVER (PARTITION BY agent, session ORDER BY t) AS before FROM r) WHERE before IS NOT NULL")
def aligned_inputs(spark, d):
    return motion.aligned_inputs(_rows(spark, d), "x", ["agent", "session"], "t").select("agent", "t", r6("label_before").alias("label_before"))


@query(RUNS + f" SELECT agent, session, t, {d6('x')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY agent, session ORDER BY t) AS k FROM r) WHERE k <= 2")
def first_poses(spark, d):
    return motion.first_rows(_rows(spark, d), ["agent", "session"], "t").select("agent", "session", "t", r6("x").alias("x"))


# ---- statistics


@query(SEQ + f" SELECT feature, count(x) AS n, {d6('avg(x)')} AS mean, {d6('stddev_pop(x)')} AS sd FROM (SELECT 'x' AS feature, x FROM seq UNION ALL SELECT 'quantity', quantity FROM seq) GROUP BY feature")
def zscore_stats(spark, d):
    return stats.moments(tracks.lineitem_sequences(spark, d), ["x", "quantity"]).select("feature", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(SEQ + f", m AS (SELECT seq, pos, x, avg(x) OVER () AS a, stddev_pop(x) OVER () AS b FROM seq) SELECT seq, pos, {d6('(x - a) / nullif(b, 0)')} AS z FROM m")
def zscore_apply(spark, d):
    out = FeatureFrame(tracks.lineitem_sequences(spark, d)).then(ZScore(columns=["x"]))
    return out.df.select("seq", "pos", r6("x").alias("z"))


@query(SEQ + f" SELECT seq, pos, {d6('x')} AS x FROM seq")
def stage_roundtrip(spark, d):
    """Fitted stages written as JSON, read back, applied and undone."""
    rows = tracks.lineitem_sequences(spark, d)
    made = FeatureFrame(rows).then(ZScore(columns=["x"])).then(OddRoot(columns=["x"]))
    return replay(rows, made.to_json()).invert_to().df.select("seq", "pos", r6("x").alias("x"))


@query(SEQ + f" SELECT seq, pos, {d6('sign(x - 30000) * pow(abs(x - 30000), 1.0::DOUBLE / 3)')} AS root FROM seq")
def oddroot(spark, d):
    return tracks.lineitem_sequences(spark, d).select("seq", "pos", r6(g.odd_root(F.col("x") - 30000)).alias("root"))


@query(SEQ + f" SELECT count(x) AS n, {d6('avg(x)')} AS mean, round(stddev_pop(x), 4) + 0.0 AS sd FROM seq")
def merged_moments(spark, d):
    """Statistics of every sequence, merged to those of all."""
    parts = stats.moments(tracks.lineitem_sequences(spark, d), ["x"], ["seq"])
    return stats.merge_moments(parts, []).select("n", r6("mean").alias("mean"), (F.round("sd", 4) + 0.0).alias("sd"))


@query(SEQ + ", q AS (SELECT seq, quantile_cont(x, [0.05, 0.5, 0.95]) AS q FROM seq GROUP BY seq) SELECT seq, round(q[1], 4) AS lo, round(q[2], 4) AS mid, round(q[3], 4) AS hi FROM q")
def feature_percentiles(spark, d):
    q = stats.percentiles(tracks.lineitem_sequences(spark, d), "x", [0.05, 0.5, 0.95], ["seq"])
    return q.select("seq", *[F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


@query(TRACK + ", c AS (SELECT agent, x - 50 AS x FROM track), q AS (SELECT agent, quantile_cont(x, [0.5, 0.9]) FILTER (x >= 0) AS u, quantile_cont(-x, [0.5, 0.9]) FILTER (x <= 0) AS v FROM c GROUP BY agent) SELECT agent, round(u[1], 6) + 0.0 AS up_50, round(u[2], 6) + 0.0 AS up_90, round(-v[1], 6) + 0.0 AS down_50, round(-v[2], 6) + 0.0 AS down_90 FROM q")
def tail_percentiles(spark, d):
    q = stats.tail_percentiles(_track(spark, d).withColumn("x", F.col("x") - 50), "x", [0.5, 0.9], ["agent"])
    return q.select("agent", *[r6(F.get(c, F.lit(i))).alias(f"{c}_{p}") for c in ("up", "down") for i, p in enumerate((50, 90))])


_LOG = stats.log_edges(1.0, 1000.0, 12)


@query(TRACK + f", e AS (SELECT unnest(range(0, 12))::INT AS bin, unnest({_LOG[:-1]}::DOUBLE[]) AS lo, unnest({_LOG[1:]}::DOUBLE[]) AS hi), b AS (SELECT least(len(list_filter({_LOG}::DOUBLE[], lambda v: v <= x)) - 1, 11)::INT AS bin FROM track WHERE x >= {_LOG[0]!r}::DOUBLE AND x <= {_LOG[-1]!r}::DOUBLE), c AS (SELECT e.bin, lo, hi, count(b.bin) + 1 AS n FROM e LEFT JOIN b USING (bin) GROUP BY ALL) SELECT bin, n, {d6('n / sum(n) OVER ()')} AS share, {d6('n / sum(n) OVER () / (hi - lo)')} AS density FROM c")
def histogram_log(spark, d):
    return stats.histogram(_track(spark, d), "x", _LOG, smooth=1).select("bin", "n", r6("share").alias("share"), r6("density").alias("density"))


@query(TRACK + f", a AS (SELECT agent, x / 20 AS a FROM track), m AS (SELECT agent, count(a) AS n, avg(sin(a)) AS s, avg(cos(a)) AS c FROM a GROUP BY agent), k AS (SELECT agent, n, atan2(s, c) AS mean, sqrt(-2 * ln(sqrt(s * s + c * c))) AS sd FROM m), r AS (SELECT a.agent, n, mean, sd, {wrap('a - mean')} AS r FROM a JOIN k USING (agent)) SELECT agent, n, {d6('mean')} AS mean, {d6('sd')} AS sd, {d6('quantile_cont(r, 0.1)')} AS lo, {d6('quantile_cont(r, 0.9)')} AS hi FROM r GROUP BY agent, n, mean, sd")
def circular_stats(spark, d):
    q = stats.circular(_track(spark, d).withColumn("a", F.col("x") / 20), "a", [0.1, 0.9], ["agent"])
    return q.select("agent", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6(F.get("q", F.lit(0))).alias("lo"), r6(F.get("q", F.lit(1))).alias("hi"))


_CATS = "WITH c AS (SELECT doc_id, 'quality' AS category, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels), n AS (SELECT category, value, count(*) AS n, count(DISTINCT doc_id) AS sequences FROM c WHERE value IS NOT NULL GROUP BY ALL)"


@query(_CATS + " SELECT category, value, n, sequences FROM n")
def class_counts(spark, d):
    return stats.value_counts(tracks.unpivot_labels(spark, d), "category", "value", "doc_id")


@query(_CATS + f" SELECT category, value, n, {d6('least(greatest(sum(n) OVER w / (count(*) OVER w * n), 0.1), 100)')} AS weight FROM n WINDOW w AS (PARTITION BY category)")
def class_weights(spark, d):
    counts = stats.value_counts(tracks.unpivot_labels(spark, d), "category", "value")
    return stats.class_weights(counts).select("category", "value", "n", r6("weight").alias("weight"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, 'quantity' AS label, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT o_orderkey, 0, 'status', (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::DOUBLE FROM orders), q AS (SELECT label, l_orderkey, l_linenumber, min(v) AS a, max(v) AS b FROM p GROUP BY ALL), s AS (SELECT label, l_orderkey, bool_or(a <> b) AS f, min(a) <> max(b) AS s FROM q GROUP BY ALL) SELECT label, CASE WHEN bool_or(f) THEN 'frame' WHEN bool_or(s) THEN 'target' ELSE 'sequence' END AS granularity FROM s GROUP BY label")
def label_granularity(spark, d):
    """Of two labels of orders: one constant per order, one that differs between its lines."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.lit("quantity").alias("label"), F.col("l_quantity").cast("double").alias("v"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("status").alias("label"), F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0).alias("v"))
    return stats.granularity(li.unionByName(o), "l_orderkey", "l_linenumber", "v", ["label"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def label_report(spark, d):
    return stats.label_report(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag", "l_linestatus"])


@query(TRACK + f", m AS (SELECT category, avg(x) AS a, stddev_pop(x) AS b, median(x) AS c FROM track GROUP BY category) SELECT category, {d6('a')} AS mean, {d6('b')} AS sd, {d6('c')} AS median, {d6('avg(abs(x - c))')} AS scale FROM track JOIN m USING (category) GROUP BY category, a, b, c")
def distribution_fits(spark, d):
    return stats.distribution_fits(_track(spark, d), "x", ["category"]).select("category", *[r6(c).alias(c) for c in ("mean", "sd", "median", "scale")])


@query("WITH c AS (SELECT l_extendedprice::DOUBLE AS p, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS s FROM lineitem) SELECT a, b, round(v, 3) + 0.0 AS cov FROM (SELECT unnest(['p', 'p', 'p', 'q', 'q', 's']) AS a, unnest(['p', 'q', 's', 'q', 's', 's']) AS b, unnest([covar_samp(p, p), covar_samp(p, q), covar_samp(p, s), covar_samp(q, q), covar_samp(q, s), covar_samp(s, s)]) AS v FROM c)")
def error_covariance(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("p"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("s"))
    return stats.covariance(li, ["p", "q", "s"]).select("a", "b", (F.round("cov", 3) + 0.0).alias("cov"))


_GRID = [(float(a), float(b)) for a in (-4, 0, 4) for b in (-4, 0, 4)]


@query(PLANAR + f", c AS (SELECT unnest({[a for a, _ in _GRID]}::DOUBLE[]) AS cx, unnest({[b for _, b in _GRID]}::DOUBLE[]) AS cy), e AS (SELECT agent, cx, cy, avg(sqrt((px - cx) ** 2 + (py - cy) ** 2)) AS radius, stddev_pop(sqrt((px - cx) ** 2 + (py - cy) ** 2)) AS err FROM planar, c GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY err, cx, cy) AS k FROM e) SELECT agent, cx, cy, {d6('radius')} AS radius, {d6('err')} AS err FROM o WHERE k = 1")
def circle_fit(spark, d):
    return stats.fit_circle(_planar(spark, d), "px", "py", _GRID, ["agent"]).select("agent", "cx", "cy", r6("radius").alias("radius"), r6("err").alias("err"))


@query(SEQ + f", l AS (SELECT seq, count(*) AS n FROM seq GROUP BY seq), o AS (SELECT seq, n, row_number() OVER (ORDER BY -ln({draw(['seq'], 1, 'held')}) / n, seq) AS nth FROM l) SELECT seq, n, nth <= 5 AS held_out FROM o")
def weighted_holdout(spark, d):
    per = tracks.lineitem_sequences(spark, d).groupBy("seq").agg(F.count("*").alias("n"))
    return stats.weighted_holdout(per, "seq", "n", 5, 1)


_EX, _EY = [-100.0, 0.0, 20.0, 40.0, 60.0, 2000.0], [-2000.0, -20.0, 0.0, 20.0, 2000.0]


@query(RUNS + f", q AS (SELECT x, lead(x) OVER (PARTITION BY agent, session ORDER BY t) - x AS y FROM r), b AS (SELECT least(greatest(len(list_filter({_EX}::DOUBLE[], lambda v: v <= x)) - 1, 0), 4)::INT AS bx, least(greatest(len(list_filter({_EY}::DOUBLE[], lambda v: v <= y)) - 1, 0), 3)::INT AS \"by\" FROM q WHERE y IS NOT NULL), c AS (SELECT bx, \"by\", count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, sum(n) OVER () AS total FROM c) SELECT bx, \"by\", n, round(n / (total * list_extract({_EX}::DOUBLE[], bx + 2) - total * list_extract({_EX}::DOUBLE[], bx + 1)) / (list_extract({_EY}::DOUBLE[], \"by\" + 2) - list_extract({_EY}::DOUBLE[], \"by\" + 1)), 9) AS density FROM k WHERE bx > 0 AND bx < 4 AND \"by\" > 0 AND \"by\" < 3")
def density_2d(spark, d):
    v = motion.relative_velocity(_rows(spark, d), "x", ["agent", "session"], "t").withColumnRenamed("x_d1", "y")
    return stats.density_2d(v, "x", "y", _EX, _EY).select("bx", "by", "n", F.round("density", 9).alias("density"))


@query(TRACK + f", q AS (SELECT agent, count(*) AS n, avg((category = 'click')::INT) AS share, quantile_cont(x, [0.5, 0.9]) AS q FROM track GROUP BY agent) SELECT agent, n, {d6('share')} AS share, {d6('q[1]')} AS mid, {d6('q[2]')} AS high, CASE WHEN n < 10 THEN NULL WHEN share >= 0.95 THEN 'flagged' WHEN share <= 0.05 THEN 'plain' END AS kind FROM q")
def individual_summary(spark, d):
    out = stats.individual_summary(_track(spark, d), "agent", F.col("category") == "click", "x", [0.5, 0.9])
    return out.select("agent", "n", r6("share").alias("share"), r6(F.get("q", F.lit(0))).alias("mid"), r6(F.get("q", F.lit(1))).alias("high"), "kind")


@query(PLANAR + f", nz AS (SELECT agent, t, theta, px, py, px + 0.1::DOUBLE * {normal(['agent', 't'], 1, 'px')} AS qx, py + 0.1::DOUBLE * {normal(['agent', 't'], 1, 'py')} AS qy FROM planar), dn AS (SELECT theta, lead(px) OVER w - px AS dx, lead(py) OVER w - py AS dy, lead(qx) OVER w - qx AS ex, lead(qy) OVER w - qy AS ey FROM nz WINDOW w AS (PARTITION BY agent ORDER BY t)), df AS (SELECT (ey - dy) * cos(theta) - (ex - dx) * sin(theta) AS f, (ex - dx) * cos(theta) + (ey - dy) * sin(theta) AS s FROM dn) SELECT 'fwd_1' AS feature, {d6('sqrt(avg(f * f))')} AS scale FROM df UNION ALL SELECT 'side_1', {d6('sqrt(avg(s * s))')} FROM df")
def noise_scale(spark, d):
    """Movement of perturbed positions against that of the given ones: root mean square differences."""
    rows = _planar(spark, d)
    a = motion.global_velocity(rows, "px", "py", "theta", ["agent"], "t")
    b = motion.global_velocity(stats.noisy(rows, ["px", "py"], 0.1, ["agent", "t"], 1), "px", "py", "theta", ["agent"], "t")
    return stats.rms_difference(a, b, ["agent", "t"], ["fwd_1", "side_1"]).select("feature", r6("scale").alias("scale"))


# ---- bins

_EDGES = [0.0, 10.0, 20.0, 40.0, 80.0, 160.0]
_BIN = f"least(greatest(len(list_filter({_EDGES}::DOUBLE[], lambda v: v <= x)) - 1, 0), 4)::INT"


@query(SEQ + ", q AS (SELECT quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM seq) SELECT unnest(range(0, 5))::INT AS edge, round(unnest(q), 4) AS value FROM q")
def quantile_edges(spark, d):
    q = stats.percentiles(tracks.lineitem_sequences(spark, d), "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(F.posexplode("q").alias("edge", "value")).select("edge", F.round("value", 4).alias("value"))


@query(TRACK + f" SELECT agent, t, {_BIN} AS bin FROM track")
def hard_bins(spark, d):
    return _track(spark, d).select("agent", "t", g.bin_of("x", _EDGES).alias("bin"))


@query(TRACK + f", b AS (SELECT {_BIN} AS bin, x FROM track), s AS (SELECT bin, avg(x) AS mean, median(x) AS median, count(*) AS n FROM b GROUP BY bin), e AS (SELECT unnest(range(0, 5))::INT AS bin, unnest({_EDGES[:-1]}::DOUBLE[]) AS lo, unnest({_EDGES[1:]}::DOUBLE[]) AS hi) SELECT bin, lo, hi, (lo + hi) / 2 AS centre, {d6('coalesce(mean, (lo + hi) / 2)')} AS mean, {d6('coalesce(median, (lo + hi) / 2)')} AS median, coalesce(n, 0) AS n FROM e LEFT JOIN s USING (bin)")
def bin_stats(spark, d):
    return binning.bin_statistics(_track(spark, d), "x", _EDGES).withColumns({"mean": r6("mean"), "median": r6("median")})


_SOFT = TRACK + f", b AS (SELECT agent, t, x, {_BIN} AS b FROM track), c AS (SELECT *, (list_extract({_EDGES}::DOUBLE[], b + 1) + list_extract({_EDGES}::DOUBLE[], b + 2)) / 2 AS centre, list_extract({_EDGES}::DOUBLE[], b + 2) - list_extract({_EDGES}::DOUBLE[], b + 1) AS width FROM b), e AS (SELECT *, (least(greatest(x, 0.0), 160.0) - centre) / width AS s FROM c), f AS (SELECT *, b + CASE WHEN s < 0 THEN -1 ELSE 1 END AS o FROM e), h AS (SELECT *, CASE WHEN o < 0 OR o > 4 THEN 0.0::DOUBLE ELSE abs(s) END AS w FROM f), soft AS (SELECT agent, t, b AS bin, 1 - w AS weight FROM h WHERE 1 - w > 0 UNION ALL SELECT agent, t, o, w FROM h WHERE w > 0)"


@query(_SOFT + f" SELECT agent, t, bin::INT AS bin, {d6('weight')} AS weight FROM soft")
def soft_bins(spark, d):
    return binning.soft_bins(_track(spark, d), "x", _EDGES).select("agent", "t", "bin", r6("weight").alias("weight"))


@query(_SOFT + f", v AS (SELECT agent, t, sum(weight) AS w, sum(weight * (list_extract({_EDGES}::DOUBLE[], bin + 1) + list_extract({_EDGES}::DOUBLE[], bin + 2)) / 2) AS v FROM soft GROUP BY ALL) SELECT agent, t, {d6('CASE WHEN abs(w - 1) < 0.001 THEN v / w END')} AS value FROM v")
def bin_expectation(spark, d):
    rows = _track(spark, d)
    bins = binning.bin_statistics(rows, "x", _EDGES)
    return binning.expectation(binning.soft_bins(rows, "x", _EDGES), ["agent", "t"], bins).select("agent", "t", r6("value").alias("value"))


@query()
def bin_sampling(spark, d):
    rows = _track(spark, d)
    samples = binning.bin_samples(rows, "x", _EDGES, 16, ["agent", "t"], 3)
    return binning.sample_bins(binning.soft_bins(rows, "x", _EDGES), ["agent", "t"], samples, 16, 4)


_TRANS = TRACK + f", b AS (SELECT agent, t, {_BIN} AS bin FROM track), c AS (SELECT bin AS from_bin, lead(bin) OVER (PARTITION BY agent ORDER BY t) AS to_bin FROM b), n AS (SELECT from_bin, to_bin, count(*) AS n FROM c WHERE to_bin IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_bin) AS p FROM n)"


def _transitions(spark, d):
    return binning.transitions(_track(spark, d).withColumn("bin", g.bin_of("x", _EDGES)), "bin", ["agent"], "t")


@query(_TRANS + f" SELECT from_bin, to_bin, n, {d6('p')} AS p FROM p")
def transition_matrix(spark, d):
    return _transitions(spark, d).withColumn("p", r6("p"))


@query(_TRANS + f" SELECT sum(n)::BIGINT AS n, {d6(f'sum(n * (ln(p) - ln(list_extract({_EDGES}::DOUBLE[], to_bin + 2) - list_extract({_EDGES}::DOUBLE[], to_bin + 1))))')} AS loglik FROM p")
def markov_loglik(spark, d):
    return binning.log_likelihood(_transitions(spark, d), _EDGES).withColumn("loglik", r6("loglik"))


@query(TRACK + f", b AS (SELECT agent % 2 AS part, agent, t, {_BIN} AS bin FROM track), c AS (SELECT part, bin AS f, lead(bin) OVER (PARTITION BY agent ORDER BY t) AS o FROM b), n AS (SELECT part, f, o, count(*) AS n FROM c WHERE o IS NOT NULL GROUP BY ALL), p AS (SELECT part, f, o, n / sum(n) OVER (PARTITION BY part, f) AS p FROM n), j AS (SELECT coalesce(x.p, 0) - coalesce(y.p, 0) AS d FROM (SELECT * FROM p WHERE part = 0) x FULL JOIN (SELECT * FROM p WHERE part = 1) y ON x.f = y.f AND x.o = y.o) SELECT count(*) AS cells, {d6('sqrt(sum(d * d))')} AS frobenius, {d6('max(abs(d))')} AS largest FROM j")
def compare_transitions(spark, d):
    """The transition matrices of two halves of the agents, compared: the operator's feature is the split."""
    rows = _track(spark, d).withColumn("bin", g.bin_of("x", _EDGES))
    a, b = (binning.transitions(rows.where(F.col("agent") % 2 == k), "bin", ["agent"], "t") for k in (0, 1))
    return evaluation.compare_transitions(a, b).withColumns({"frobenius": r6("frobenius"), "largest": r6("largest")})


@query()
def minimum_width_edges(spark, d):
    edges = binning.minimum_width_edges(_track(spark, d), "x", 8, 2.0)
    return binning.bin_statistics(_track(spark, d), "x", edges)


@query()
def optimal_edges(spark, d):
    """Edges by likelihood, and the transition counts that the whole table has under them."""
    rows = _track(spark, d)
    edges = binning.optimal_edges(rows, "x", ["agent"], "t", 5, 200)
    return binning.transitions(rows.withColumn("bin", g.bin_of("x", edges)), "bin", ["agent"], "t")


@query()
def kmeans_edges(spark, d):
    return binning.bin_statistics(_track(spark, d), "x", binning.kmeans_edges(_track(spark, d), "x", 5))


@query()
def kmeans_tokens(spark, d):
    rows = motion.global_velocity(_planar(spark, d), "px", "py", "theta", ["agent"], "t")
    return binning.tokens(rows, ["fwd_1", "side_1", "turn_1"], 8).select("agent", "t", "token")


# ---- poses

_SIZES = {
    "thorax_width": "sqrt((right_front_thorax_x - left_front_thorax_x) ** 2 + (right_front_thorax_y - left_front_thorax_y) ** 2)",
    "thorax_length": f"sqrt(({_FX} - base_thorax_x) ** 2 + ({_FY} - base_thorax_y) ** 2)",
    "abdomen_length": "sqrt((base_thorax_x - tip_abdomen_x) ** 2 + (base_thorax_y - tip_abdomen_y) ** 2)",
    "head_width": "sqrt((right_eye_x - left_eye_x) ** 2 + (right_eye_y - left_eye_y) ** 2)",
    "head_height": "sqrt(((right_eye_x + left_eye_x) / 2 - antennae_midpoint_x) ** 2 + ((right_eye_y + left_eye_y) / 2 - antennae_midpoint_y) ** 2)",
}
_MX, _MY = f"(({_FX} + base_thorax_x) / 2)", f"(({_FY} + base_thorax_y) / 2)"
SIZES = KP + ", z AS (SELECT id, " + ", ".join(f"median({v}) AS {k}" for k, v in _SIZES.items()) + f" FROM kp GROUP BY id), y AS (SELECT id, median(w) AS wing_length FROM (SELECT id, unnest([sqrt((wing_left_x - {_MX}) ** 2 + (wing_left_y - {_MY}) ** 2), sqrt((wing_right_x - {_MX}) ** 2 + (wing_right_y - {_MY}) ** 2)]) AS w FROM kp) GROUP BY id), sizes AS (SELECT * FROM z JOIN y USING (id))"


def _kp(spark, d):
    return tracks.embedding_keypoints(spark, d)


@query(SIZES + " SELECT id, " + ", ".join(f"{d6(s)} AS {s}" for s in pose.SCALES) + " FROM sizes")
def scale_medians(spark, d):
    return pose.scales(_kp(spark, d)).select("id", *[r6(s).alias(s) for s in pose.SCALES])


@query(PLANAR.replace("planar AS (SELECT agent, t,", "planar AS (SELECT agent, t, kp AS points,") + f", q AS (SELECT agent, t, px, py, theta, unnest(range(0, 19))::INT AS point, unnest(points) AS p FROM planar) SELECT agent, t, point, {d6('(p.x - px) * cos(theta) + (p.y - py) * sin(theta)')} AS x, {d6('(p.y - py) * cos(theta) - (p.x - px) * sin(theta)')} AS y FROM q")
def body_centric(spark, d):
    out = pose.body_centric(_kp(spark, d)).select("agent", "t", F.posexplode("body").alias("point", "p"))
    return out.select("agent", "t", "point", r6("p.x").alias("x"), r6("p.y").alias("y"))


def _pose_parts() -> tuple[str, dict[str, str]]:
    """The pose features written out from their definitions, apart from the operator's code: a table b and an expression for each."""
    b = {n: (f"(({n}_x - ox) * cos(th) + ({n}_y - oy) * sin(th))", f"(({n}_y - oy) * cos(th) - ({n}_x - ox) * sin(th))") for n in pose.KEYPOINTS}
    body = ", ".join(f"{x} AS {n}_x, {y} AS {n}_y" for n, (x, y) in b.items())
    dist = lambda x, y: f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    ang = lambda x, y: f"atan2({y}, {x})"
    hx, hy = "((left_eye_x + right_eye_x) / 2)", "((left_eye_y + right_eye_y) / 2)"
    f = {"thorax_front_x": "ox", "thorax_front_y": "oy", "orientation": "th", "abdomen_angle": wrap(ang("tip_abdomen_x", "tip_abdomen_y + L") + " + pi() / 2"), "head_base_x": hx, "head_base_y": hy, "head_angle": ang(f"antennae_midpoint_x - {hx}", f"antennae_midpoint_y - {hy}") + " - pi() / 2"}
    for side, how in (("left", lambda a: wrap(f"pi() - {a}")), ("right", lambda a: a)):
        base = (f"{side}_middle_femur_base_x", f"({side}_middle_femur_base_y + L / 2)")
        joint = tuple(f"({side}_middle_femur_tibia_joint_{c} - {side}_middle_femur_base_{c})" for c in "xy")
        tip = tuple(f"({side}_middle_leg_tip_{c} - {side}_middle_femur_tibia_joint_{c})" for c in "xy")
        front, back = (f"{side}_front_leg_tip_x", f"{side}_front_leg_tip_y"), (f"{side}_back_leg_tip_x", f"({side}_back_leg_tip_y + L)")
        a_base, a_joint = how(ang(*base)), how(ang(*joint))
        f |= {f"{side}_front_leg_tip_dist": dist(*front), f"{side}_front_leg_tip_angle": how(ang(*front)), f"{side}_middle_femur_base_dist": dist(*base), f"{side}_middle_femur_base_angle": a_base, f"{side}_middle_femur_tibia_joint_dist": dist(*joint), f"{side}_middle_femur_tibia_joint_angle": wrap(f"{a_joint} - {a_base}"), f"{side}_middle_leg_tip_dist": dist(*tip), f"{side}_middle_leg_tip_angle": wrap(f"pi() - {ang(*tip)} - {a_joint}") if side == "left" else wrap(f"{ang(*tip)} - {a_joint}"), f"{side}_back_leg_tip_dist": dist(*back), f"{side}_back_leg_tip_angle": how(ang(*back))}
    f |= {"left_wing_angle": wrap(ang("wing_left_x", "wing_left_y + L / 2") + " - pi()"), "right_wing_angle": "-" + ang("wing_right_x", "wing_right_y + L / 2")}
    return SIZES + f", o AS (SELECT kp.*, {_FX} AS ox, {_FY} AS oy, {_TH} AS th, s.thorax_length AS L FROM kp JOIN sizes s USING (id)), b AS (SELECT agent, t, ox, oy, th, L, {body} FROM o)", f


POSES, POSE_PARTS = _pose_parts()


@query(POSES + " SELECT agent, t, " + ", ".join(f"round({POSE_PARTS[n]}, 5) + 0.0 AS {n}" for n in pose.POSE) + " FROM b")
def pose_features(spark, d):
    kp = _kp(spark, d)
    return pose.pose_features(kp, pose.scales(kp)).select("agent", "t", *[(F.round(n, 5) + 0.0).alias(n) for n in pose.POSE])


@query(KP + f" SELECT agent, t, {d6('left_front_leg_tip_x')} AS x, {d6('left_front_leg_tip_y')} AS y FROM kp")
def pose_roundtrip(spark, d):
    """A point whose distance and angle are features comes back from them."""
    kp = _kp(spark, d)
    sizes = pose.scales(kp)
    back = pose.keypoints(pose.pose_features(kp, sizes).drop("kp"), sizes)
    return back.select("agent", "t", r6(pose.at("left_front_leg_tip")[0]).alias("x"), r6(pose.at("left_front_leg_tip")[1]).alias("y"))


@query(KP + ", f AS (SELECT agent, t, unnest(range(0, 19))::INT AS point, kp FROM kp), o AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j})" for i, j in enumerate(pose.flip_order())) + f") v(point, other)) SELECT agent, t, f.point, {d6('-kp[other + 1].x')} AS x, {d6('kp[other + 1].y')} AS y FROM f JOIN o ON o.point = f.point")
def flip_points(spark, d):
    out = pose.flip(_kp(spark, d)).select("agent", "t", F.posexplode("kp").alias("point", "p"))
    return out.select("agent", "t", "point", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query(KP + " SELECT id, count(*) AS n FROM (SELECT id FROM kp UNION ALL SELECT id + (SELECT max(id) FROM kp) + 1 FROM kp) GROUP BY id")
def flip_augment(spark, d):
    return augment.with_mirrored(_kp(spark, d), ["id"]).groupBy("id").agg(F.count("*").alias("n"))


# ---- agents


@query(KP + f", q AS (SELECT agent, t, unnest(range(0, 19))::INT AS point, unnest(kp) AS p FROM kp) SELECT agent, t, point, {d6(f'least(greatest({agents.CHAMBER_HEIGHT} - (sqrt(p.x * p.x + p.y * p.y) - {agents.INNER_RADIUS}) * {agents.CHAMBER_HEIGHT} / {agents.ARENA_RADIUS - agents.INNER_RADIUS!r}::DOUBLE, 0), {agents.CHAMBER_HEIGHT})')} AS wall FROM q")
def wall_touch(spark, d):
    out = agents.wall_touch(_kp(spark, d)).select("agent", "t", F.posexplode("wall").alias("point", "wall"))
    return out.select("agent", "t", "point", r6("wall").alias("wall"))


_BODY3 = "[" + ", ".join(f"{{'x': {n}_x, 'y': {n}_y}}" for n in ("antennae_midpoint", "base_thorax", "tip_abdomen")) + "]"
_D2 = KP + f", p AS (SELECT agent, t, unnest({_BODY3}) AS p FROM kp), d AS (SELECT a.t, a.agent, b.agent AS other_agent, min((a.p.x - b.p.x) ** 2 + (a.p.y - b.p.y) ** 2) AS d2 FROM p a JOIN p b ON a.t = b.t AND a.agent <> b.agent GROUP BY ALL)"


@query(_D2 + f" SELECT t, agent, other_agent, {d6('d2')} AS d2 FROM d")
def interagent_distance(spark, d):
    return agents.agent_distances(_kp(spark, d), ["t"]).withColumn("d2", r6("d2"))


@query(_D2 + f", k AS (SELECT *, row_number() OVER (PARTITION BY t, agent ORDER BY d2, other_agent)::INT AS rank FROM d) SELECT t, agent, other_agent, {d6('d2')} AS d2, rank FROM k WHERE rank <= 2")
def nearest_agents(spark, d):
    return agents.nearest_agents(agents.agent_distances(_kp(spark, d), ["t"]), ["t"], 2).withColumn("d2", r6("d2"))


_TOUCHED = "[" + ", ".join(f"{{'x': {n}_x, 'y': {n}_y}}" for n in agents.TOUCHED) + "]"


@query(KP + f", a AS (SELECT agent, t, unnest(range(0, 19))::INT AS own, unnest(kp) AS p FROM kp), b AS (SELECT agent, t, unnest(range(0, 5))::INT AS other, unnest({_TOUCHED}) AS q FROM kp), m AS (SELECT a.t, a.agent, own, other, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM a JOIN b ON a.t = b.t AND a.agent <> b.agent GROUP BY ALL) SELECT t, agent, own, other, {d6(f'1 - least(1.0, {agents.TOUCH_FACTOR!r}::DOUBLE * pow(d, {agents.TOUCH_EXPONENT}))')} AS value FROM m")
def touch(spark, d):
    return agents.touch(_kp(spark, d), ["t"]).withColumn("value", r6("value"))


@query(KP + f", a AS (SELECT agent, t, unnest(range(0, 19)) AS own, unnest(kp) AS p FROM kp), b AS (SELECT agent, t, unnest({_TOUCHED}) AS q FROM kp), m AS (SELECT a.t, a.agent, b.agent AS o, own, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM a JOIN b ON a.t = b.t AND a.agent <> b.agent GROUP BY ALL), k AS (SELECT max(d) AS d FROM m GROUP BY t, agent, o) SELECT {d6(f'1 / pow(quantile_cont(d, 0.99), {agents.TOUCH_EXPONENT})')} AS factor FROM k")
def touch_factor(spark, d):
    return agents.touch_factor(_kp(spark, d), ["t"]).select(r6("factor").alias("factor"))


_SEEN = "[" + ", ".join(f"{{'x': {n}_x, 'y': {n}_y}}" for n in agents.SEEN) + "]"


@query(KP + f""", e AS (SELECT agent, t, antennae_midpoint_x AS ex, antennae_midpoint_y AS ey, {_TH} + pi() / 2 AS th FROM kp), o AS (SELECT agent AS other, t, unnest({_SEEN}) AS p FROM kp),
m AS (SELECT e.t, e.agent, other, (p.x - ex) * cos(th) + (p.y - ey) * sin(th) AS x, (p.y - ey) * cos(th) - (p.x - ex) * sin(th) AS y FROM e JOIN o ON e.t = o.t AND e.agent <> o.other),
a AS (SELECT t, agent, other, atan2(y, x) AS a, sqrt(x * x + y * y) AS d FROM m), k AS (SELECT *, least(floor((a + pi()) / (2 * pi() / 72)), 71)::INT AS s FROM a),
g AS (SELECT t, agent, other, min(d) AS d, min(s) AS lo, max(s) AS hi, bool_or(a > pi() / 2) AND bool_or(a < -pi() / 2) AND NOT bool_or(abs(a) <= pi() / 2) AS behind, max(s) FILTER (a < 0) AS neg, min(s) FILTER (a >= 0) AS pos FROM k GROUP BY ALL),
h AS (SELECT t, agent, d, unnest(CASE WHEN behind THEN list_concat(range(0, neg + 1), range(pos, 72)) ELSE range(lo, hi + 1) END)::INT AS sector FROM g), z AS (SELECT t, agent, sector, min(d) AS d FROM h GROUP BY ALL),
y AS (SELECT t, agent, unnest(range(0, 72))::INT AS sector FROM kp) SELECT y.t, y.agent, y.sector, {d6(f"coalesce(1 - least(1.0, {agents.VISION_FACTOR!r}::DOUBLE * pow(d, {agents.VISION_EXPONENT})), 0)")} AS value FROM y LEFT JOIN z USING (t, agent, sector)""")
def vision(spark, d):
    return agents.vision(_kp(spark, d), ["t"]).select("t", "agent", "sector", r6("value").alias("value"))


def _arena(spark, d):
    """Positions moved into the arena."""
    return _planar(spark, d).withColumns({"px": 20 * F.sin("px"), "py": 15 * F.cos("py")})


_ARENA = PLANAR + ", a AS (SELECT agent, t, 20 * sin(px) AS x, 15 * cos(py) AS y, theta FROM planar)"
_HIT = lambda dx, dy: f"(-(x * ({dx}) + y * ({dy})) + sqrt((x * ({dx}) + y * ({dy})) ** 2 - (x * x + y * y - {agents.ARENA_RADIUS} ** 2)))"


@query(_ARENA + f" SELECT agent, t, {d6(f'{agents.ARENA_RADIUS} - sqrt(x * x + y * y)')} AS wall_min, {d6(_HIT('cos(theta)', 'sin(theta)'))} AS wall_forward, {d6(_HIT('-sin(theta)', 'cos(theta)'))} AS wall_left, {d6(_HIT('sin(theta)', '-cos(theta)'))} AS wall_right, {d6('cos(atan2(y, x) - theta)')} AS wall_cos FROM a")
def wall_features(spark, d):
    out = agents.wall_features(_arena(spark, d), F.col("px"), F.col("py"), F.col("theta"))
    return out.select("agent", "t", *[r6(c).alias(c) for c in ("wall_min", "wall_forward", "wall_left", "wall_right", "wall_cos")])


@query(KP + f", c AS (SELECT t // 10 AS clip, {_FX} AS ox, {_FY} AS oy, atan2({_FY} - base_thorax_y, {_FX} - base_thorax_x) - pi() / 2 AS th FROM kp WHERE agent = 0 AND t % 10 = 5) SELECT clip, agent, t % 10 AS pos, {d6('(tip_abdomen_x - ox) * cos(th) + (tip_abdomen_y - oy) * sin(th)')} AS x, {d6('(tip_abdomen_y - oy) * cos(th) - (tip_abdomen_x - ox) * sin(th)')} AS y FROM kp JOIN c ON c.clip = t // 10")
def egocentric_clips(spark, d):
    rows = _kp(spark, d).withColumns({"clip": F.floor(F.col("t") / 10), "pos": F.col("t") % 10, "target": F.lit(0)})
    out = agents.egocentric(rows, ["clip"], "pos", "agent", "target", 10)
    return out.select("clip", "agent", "pos", r6(pose.at("tip_abdomen")[0]).alias("x"), r6(pose.at("tip_abdomen")[1]).alias("y"))


# ---- filters


@query(TRACK + " SELECT agent, t, isdata AND category = 'click' AND NOT category = 'view' AS mask FROM track")
def category_filter(spark, d):
    rows = _track(spark, d)
    value = {c: (F.col("category") == c).cast("int") for c in ("click", "view")}
    return filters.with_category_mask(rows.withColumn("mask", F.col("isdata")), "mask", ["click", "view==0"], value).select("agent", "t", "mask")


@query(TRACK + " SELECT agent, count(*) AS n FROM track WHERE agent IN (SELECT agent FROM track WHERE category = 'purchase' AND x > 90) GROUP BY agent")
def condense(spark, d):
    return filters.condense(_track(spark, d), "agent", (F.col("category") == "purchase") & (F.col("x") > 90)).groupBy("agent").agg(F.count("*").alias("n"))


@query(TRACK + f", k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY t) AS k FROM track WHERE agent IN (SELECT DISTINCT agent FROM track ORDER BY agent LIMIT 20)) SELECT agent, t, {d6('x')} AS x FROM k WHERE k <= 5")
def first_n_per_group(spark, d):
    return filters.first_rows_per_key(_track(spark, d), "agent", ["t"], 5, 20).select("agent", "t", r6("x").alias("x"))


@query(TRACK + " SELECT agent FROM track GROUP BY agent HAVING count(CASE WHEN isdata THEN x END) > 0")
def real_agents(spark, d):
    return filters.real_agents(_track(spark, d).withColumn("x", F.when(F.col("isdata"), F.col("x"))), "agent", "x")


@query(RUNS + f" SELECT s.agent, s.start, r.t, {d6('r.x')} AS x FROM s JOIN track r ON r.agent = s.agent AND r.t >= s.start AND r.t < s.start + s.duration WHERE s.duration >= 10")
def time_slices(spark, d):
    s = _sessions(spark, d).where("duration >= 10")
    return filters.time_slices(_track(spark, d), s).select("agent", "start", "t", r6("x").alias("x"))


@query(TRACK + " SELECT count(*) AS rows, count(*) FILTER (isdata) AS valid_rows, count(DISTINCT agent) AS ids, count(DISTINCT agent) FILTER (isdata) AS valid_ids FROM track")
def filter_counts(spark, d):
    return filters.filter_counts(_track(spark, d), F.col("isdata"), "agent")


@query(TRACK + f" SELECT agent, t, {d6('x')} AS x FROM track WHERE t % 4 = 0")
def every_kth_frame(spark, d):
    return filters.every_kth(_track(spark, d), "t", 4).select("agent", "t", r6("x").alias("x"))


@query(TRACK + f" SELECT agent, t, {d6('x')} AS x FROM track WHERE agent NOT IN (SELECT agent FROM track WHERE category = 'error') ")
def remove_sequences(spark, d):
    rows = _track(spark, d)
    return filters.rows_by_key(rows, rows.where("category = 'error'"), ["agent"], keep=False).select("agent", "t", r6("x").alias("x"))


@query("WITH k AS (SELECT l_linestatus AS session, l_returnflag AS trial, l_quantity::DOUBLE AS x FROM lineitem), i AS (SELECT session, trial, row_number() OVER (ORDER BY session, trial) - 1 AS agent FROM (SELECT DISTINCT session, trial FROM k)) SELECT agent, session, trial, count(*) AS n FROM k JOIN i USING (session, trial) GROUP BY ALL")
def concat_trials(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linestatus").alias("session"), F.col("l_returnflag").alias("trial"), F.col("l_quantity").cast("double").alias("x"))
    parts = [li.where("trial = 'R'"), li.where("trial <> 'R'")]
    return tracks.concat_trials(parts).groupBy(F.col("agent").cast("long").alias("agent"), "session", "trial").agg(F.count("*").alias("n"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def unmatched_keys(spark, d):
    return tracks.unmatched_keys(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


# ---- evaluation

_ERR = TRACK + ", q AS (SELECT agent, category, x AS a, lag(x) OVER (PARTITION BY agent ORDER BY t) AS b FROM track), m AS (SELECT category, stddev_pop(x) AS sd FROM track GROUP BY category)"


@query(_ERR + f" SELECT category, count(*) AS n, {d6('avg(abs(a - b))')} AS l1, {d6('avg((a - b) ** 2)')} AS l2, {d6('avg(abs((a - b) / sd))')} AS l1_z, {d6('avg(((a - b) / sd) ** 2)')} AS l2_z FROM q JOIN m USING (category) WHERE b IS NOT NULL GROUP BY category")
def errors_l1_l2(spark, d):
    """The value of the row before as prediction, by category."""
    rows = _track(spark, d)
    w = Window.partitionBy("agent").orderBy("t")
    truth = rows.select("agent", "t", "category", F.col("x").alias("value"))
    guess = rows.select("agent", "t", "category", F.lag("x").over(w).alias("value"))
    sd = stats.moments(rows, ["x"], ["category"]).select("category", "sd")
    out = evaluation.errors(truth, guess, ["agent", "t", "category"], ["category"], sd)
    return out.select("category", "n", *[r6(c).alias(c) for c in ("l1", "l2", "l1_z", "l2_z")])


@query(_ERR + f", e AS (SELECT agent, count(*) AS n, avg(abs(a - b)) AS l1 FROM q WHERE b IS NOT NULL GROUP BY agent) SELECT sum(n)::BIGINT AS n, {d6('sum(l1 * n) / sum(n)')} AS l1 FROM e")
def combine_errors(spark, d):
    rows = _track(spark, d)
    w = Window.partitionBy("agent").orderBy("t")
    parts = rows.withColumn("b", F.lag("x").over(w)).where("b is not null").groupBy("agent").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("x") - F.col("b"))).alias("l1"))
    return evaluation.combine_errors(parts, ["l1"]).select("n", r6("l1").alias("l1"))


@query(RUNS + ", " + ", ".join(f"q{n} AS (SELECT {n} AS tau, x AS a, lag(x, {n}) OVER (PARTITION BY agent, session ORDER BY t) AS b FROM r)" for n in TAUS) + f", u AS ({' UNION ALL '.join(f'SELECT * FROM q{n}' for n in TAUS)}) SELECT tau, count(*) AS n, {d6('avg(abs(a))')} AS zero, {d6('avg(abs(a - b))')} AS constant FROM u WHERE b IS NOT NULL GROUP BY tau")
def baseline_constant_velocity(spark, d):
    out = evaluation.baselines(_rows(spark, d), "x", ["agent", "session"], "t", TAUS)
    return out.select("tau", "n", r6("zero").alias("zero"), r6("constant").alias("constant"))


_DRAWS = RUNS + ", q AS (SELECT category, x AS a, [lag(x) OVER w, lag(x, 2) OVER w, lag(x, 3) OVER w] AS v, lag(x, 3) OVER w IS NOT NULL AS ok FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)), e AS (SELECT category, a, v, list_transform(v, lambda y: abs(y - a)) AS g FROM q WHERE ok)"


def _draws(spark, d):
    """Each row with three guesses of its value: the three rows before."""
    w = Window.partitionBy("agent", "session").orderBy("t")
    return _rows(spark, d).withColumn("v", F.array(*[F.lag("x", n).over(w) for n in (1, 2, 3)])).where(F.get("v", F.lit(2)).isNotNull())


@query(_DRAWS + f" SELECT category, {d6('avg(list_sum(g) / 3)')} AS l1_mean, {d6('avg(list_min(g))')} AS l1_best, {d6('avg(list_sum(list_transform(g, lambda y: y * y)) / 3)')} AS l2_mean FROM e GROUP BY category")
def sample_errors(spark, d):
    out = evaluation.sample_errors(_draws(spark, d), "x", "v", ["category"])
    return out.select("category", *[r6(c).alias(c) for c in ("l1_mean", "l1_best", "l2_mean")])


@query(RUNS + f", u AS (SELECT agent, t, x, unnest([1, 2, 3])::INT AS sample, unnest([lag(x) OVER w, lag(x, 2) OVER w, lag(x, 3) OVER w]) AS v FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)), k AS (SELECT *, abs(v - x) AS e, row_number() OVER (PARTITION BY agent, t ORDER BY abs(v - x), sample) AS k FROM u WHERE v IS NOT NULL) SELECT agent, t, {d6('v')} AS v, {d6('e')} AS error FROM k WHERE k = 1")
def closest_sample(spark, d):
    w = Window.partitionBy("agent", "session").orderBy("t")
    wide = _rows(spark, d).select("agent", "t", "x", F.array(*[F.lag("x", n).over(w) for n in (1, 2, 3)]).alias("v"))
    rows = wide.select("agent", "t", "x", F.posexplode("v").alias("sample", "v")).where("v is not null")
    out = evaluation.closest_sample(rows, ["agent", "t"], "sample", F.abs(F.col("v") - F.col("x")), "v")
    return out.select("agent", "t", r6("v").alias("v"), r6("error").alias("error"))


@query(_SOFT + f", p AS (SELECT agent, t, list_transform(range(0, 5), lambda i: (i - 2) * 0.5::DOUBLE) AS logits FROM track), l AS (SELECT soft.agent, soft.t, sum(weight * (ln(list_sum(list_transform(logits, lambda v: exp(v)))) - list_extract(logits, (bin + 1)::INT))) AS ce FROM soft JOIN p ON p.agent = soft.agent AND p.t = soft.t GROUP BY ALL) SELECT track.category, {d6('avg(ce)')} AS cross_entropy FROM l JOIN track ON track.agent = l.agent AND track.t = l.t GROUP BY track.category")
def cross_entropy(spark, d):
    """Soft bins against fixed logits, by category."""
    soft = binning.soft_bins(_track(spark, d), "x", _EDGES).groupBy("agent", "t", "category").agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"))
    rows = soft.select("category", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("w"), F.array(*[F.lit((i - 2) * 0.5) for i in range(5)]).alias("l"))
    return evaluation.cross_entropy(rows, "w", "l", ["category"]).select("category", r6("cross_entropy").alias("cross_entropy"))


@query(RUNS + f", f AS (SELECT *, first_value(x) OVER (PARTITION BY agent, session ORDER BY t) AS x0 FROM r) SELECT t - session AS horizon, count(*) AS n, {d6('avg(abs(x - x0))')} AS l1 FROM f GROUP BY 1")
def horizon_errors(spark, d):
    """The session's first value held on to, against what came, by how long ago it was."""
    rows = _rows(spark, d)
    truth = rows.select("agent", "t", F.col("x").alias("value"))
    held = motion.integrate_relative(rows.withColumn("zero", F.lit(0.0)), "x", "zero", ["agent", "session"], "t", name="value").select("agent", "t", (F.col("t") - F.col("session")).alias("horizon"), "value")
    return evaluation.horizon_errors(truth, held, ["agent", "t"], "horizon").withColumn("l1", r6("l1"))


@query(_ERR + f" SELECT category, count(*) AS n, {d6('avg(abs(a - b))')} AS l1, {d6('avg(ln(1 + abs(a - b)))')} AS ce, {d6('0.75 * avg(abs(a - b)) + 0.25 * avg(ln(1 + abs(a - b)))')} AS objective FROM q WHERE b IS NOT NULL GROUP BY category")
def mixed_objective(spark, d):
    w = Window.partitionBy("agent").orderBy("t")
    rows = _track(spark, d).withColumn("b", F.lag("x").over(w))
    gap = F.abs(F.col("x") - F.col("b"))
    out = evaluation.mixed_objective(rows, gap, F.ln(1 + gap), 0.25, F.col("b").isNotNull(), ["category"])
    return out.select("category", "n", *[r6(c).alias(c) for c in ("l1", "ce", "objective")])


@query(TRACK + f", a AS (SELECT agent, t, x FROM track WHERE category <> 'error'), b AS (SELECT agent, t, x + 0.5 AS x FROM track WHERE category <> 'view') SELECT 'x' AS \"column\", count(*) FILTER (b.t IS NULL) AS only_left, count(*) FILTER (a.t IS NULL) AS only_right, 0::BIGINT AS null_mismatch, {d6('max(abs(a.x - b.x))')} AS largest, max(abs(a.x - b.x)) <= 0.6 AS within FROM a FULL JOIN b ON a.agent = b.agent AND a.t = b.t")
def compare_tables(spark, d):
    rows = _track(spark, d)
    a, b = rows.where("category <> 'error'"), rows.where("category <> 'view'").withColumn("x", F.col("x") + 0.5)
    return evaluation.compare_tables(a, b, ["agent", "t"], ["x"], 0.6).withColumn("largest", r6("largest"))


@query(TRACK + " SELECT 'x' AS feature, count(*) FILTER (isdata <> (x IS NOT NULL)) AS violations FROM track")
def missing_iff_invalid(spark, d):
    return evaluation.missing_iff_invalid(_track(spark, d), F.col("isdata"), ["x"])


# ---- column shapes

_MELT = PLANAR + ", q AS (SELECT agent, t, unnest(['fwd', 'fwd', 'fwd', 'side', 'side', 'side']) AS feature, unnest([1, 2, 5, 1, 2, 5])::INT AS tau, unnest([fwd_1, fwd_2, fwd_5, side_1, side_2, side_5]) AS value FROM moved)"


@query(_MELT + f" SELECT agent, t, feature, tau, {d6('value')} AS value FROM q")
def melt_lookaheads(spark, d):
    moved = motion.global_velocity(_planar(spark, d), "px", "py", "theta", ["agent"], "t", TAUS)
    return projections.melt_lookaheads(moved, ["agent", "t"], ["fwd", "side"], TAUS).withColumn("value", r6("value"))


@query(PLANAR + f" SELECT agent, t, {', '.join(f'{d6(p)} AS {p}' for p in _PARTS if 'turn' not in p)} FROM moved")
def spread_lookaheads(spark, d):
    """Melted and spread again: the columns as they were."""
    moved = motion.global_velocity(_planar(spark, d), "px", "py", "theta", ["agent"], "t", TAUS)
    back = projections.spread_lookaheads(projections.melt_lookaheads(moved, ["agent", "t"], ["fwd", "side"], TAUS), ["agent", "t"], ["fwd", "side"], TAUS)
    return back.select("agent", "t", *[r6(p).alias(p) for p in _PARTS if "turn" not in p])


@query("WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM (SELECT DISTINCT c_custkey FROM customer)) SELECT o_orderkey, coalesce(idx, -1)::INT AS idx FROM orders LEFT JOIN k ON o_custkey = c_custkey")
def dimension_index(spark, d):
    orders, customers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    return projections.index_in(orders.select("o_orderkey", "o_custkey"), "o_custkey", customers, "c_custkey").select("o_orderkey", F.col("idx").cast("int").alias("idx"))


@query()
def similarity_sigma(spark, d):
    """Each frame against the frame before, by keypoint, in units of the hull's area."""
    kp = _kp(spark, d)
    return projections.similarity_sigma(kp, kp.withColumn("t", F.col("t") + 1), ["agent", "t"])


# ---- masks and datasets


@query(RUNS + f", c AS (SELECT agent, session, (t - session) % {LENGTH} AS pos, x FROM r) SELECT agent, session, {d6(f'sum(CASE WHEN pos = {LENGTH - 1} THEN 0 ELSE x END)')} AS total, sum(CASE WHEN pos = {LENGTH - 1} THEN 1.0::DOUBLE ELSE 0 END) AS masked FROM c GROUP BY ALL")
def mask_last(spark, d):
    rows = _rows(spark, d).withColumn("pos", (F.col("t") - F.col("session")) % LENGTH)
    out = augment.apply_mask(augment.last_mask(rows, "pos", LENGTH), ["x"])
    return out.groupBy("agent", "session").agg(r6(F.sum("x")).alias("total"), F.sum("mask_flag").alias("masked"))


_CHUNK = ["agent", "session", "chunk"]


@query(RUNS + f", c AS (SELECT agent, session, (t - session) // {LENGTH} AS chunk, (t - session) % {LENGTH} AS pos FROM r), b AS (SELECT *, (floor({draw(_CHUNK, 1, 'n')} * 3) + 1)::INT AS n, {draw(_CHUNK, 1, 'at')} AS u, {draw([*_CHUNK, 'pos'], 2, '')} AS v FROM c), f AS (SELECT *, floor(u * ({LENGTH} - n + 1))::INT AS first, min(v) OVER (PARTITION BY agent, session, chunk) AS least FROM b) SELECT agent, session, chunk, count(*) FILTER (pos >= first AND pos < first + n) AS block, count(*) FILTER (v < 0.2 OR v = least) AS rows FROM f GROUP BY agent, session, chunk")
def mask_random(spark, d):
    """Masked rows per chunk for block and row masks: at least one of each."""
    rows = _rows(spark, d).withColumns({"chunk": F.floor((F.col("t") - F.col("session")) / LENGTH), "pos": (F.col("t") - F.col("session")) % LENGTH})
    keys = ["agent", "session", "chunk"]
    block = augment.block_mask(rows, keys, "pos", LENGTH, 3, 1).withColumnRenamed("mask", "block")
    return augment.row_mask(block, keys, "pos", 0.2, 2).groupBy(*keys).agg(F.count_if("block").alias("block"), F.count_if("mask").alias("rows"))


@query(RUNS + f", cv AS (SELECT agent, t, x, lead(x) OVER (PARTITION BY agent, session ORDER BY t) - x AS x_d1, 0.5::DOUBLE * {normal(['agent', 't'], 7, '_zx')} AS z, {draw(['agent', 't'], 7, 'row')} < 0.3 AS hit FROM r) SELECT agent, t, {d6('CASE WHEN hit THEN x + z ELSE x END')} AS x, {d6('CASE WHEN hit THEN x_d1 - z ELSE x_d1 END')} AS x_d1 FROM cv")
def compensated_noise(spark, d):
    """Noise on a value and its step: their sum, the next value, stays as it was."""
    v = motion.relative_velocity(_rows(spark, d), "x", ["agent", "session"], "t")
    return augment.compensated_noise(v, ["x"], {"x": "x_d1"}, 0.5, 0.3, ["agent", "t"], 7).select("agent", "t", r6("x").alias("x"), r6("x_d1").alias("x_d1"))


@query(SEQ + " SELECT seq, n FROM (SELECT seq, count(*) AS n FROM seq GROUP BY seq)")
def window_scores(spark, d):
    """A user's scorer over the whole series of each sequence: here its length."""
    w = Window.partitionBy("seq").orderBy("pos").rowsBetween(-31, 0)
    rows = tracks.lineitem_sequences(spark, d).withColumn("v", F.collect_list("x").over(w)).select("seq", "pos", "v")
    out = dataset.score_windows(rows, ["seq", "pos"], "v", lambda s: s.map(len).astype("int64"), "long")
    return out.groupBy("seq").agg(F.count_if(F.col("scored") > 0).alias("n"))


_DATASET = RUNS + f""",
d AS (SELECT agent, session, t, x, lead(x) OVER w - x AS label FROM r WINDOW w AS (PARTITION BY agent, session ORDER BY t)),
f AS (SELECT *, lag(label) OVER w AS input FROM d WINDOW w AS (PARTITION BY agent, session ORDER BY t)),
k AS (SELECT * FROM f WHERE label IS NOT NULL AND input IS NOT NULL),
m AS (SELECT avg(x) AS xa, stddev_pop(x) AS xs, avg(input) AS ia, stddev_pop(input) AS isd, avg(label) AS la, stddev_pop(label) AS ls FROM k),
z AS (SELECT agent, session + 1 AS session, t, label AS raw_label, (x - xa) / nullif(xs, 0) AS x, (input - ia) / nullif(isd, 0) AS input, (label - la) / nullif(ls, 0) AS label FROM k, m),
q AS (SELECT quantile_cont(label, {[i / 10 for i in range(11)]}) AS edges FROM z),
b AS (SELECT z.*, least(greatest(len(list_filter(edges, lambda v: v <= label)) - 1, 0), 9)::INT AS label_bin, session + ((t - session) // {LENGTH}) * {LENGTH} AS chunk_start FROM z, q),
g AS (SELECT *, count(*) OVER (PARTITION BY agent, session, chunk_start) AS found FROM b)
SELECT agent, session, chunk_start, (t - chunk_start)::INT AS pos, {d6("x")} AS x, {d6("input")} AS input, label_bin, {d6("raw_label")} AS raw_label FROM g WHERE found = {LENGTH}"""


@query(_DATASET)
def training_chunks(spark, d):
    """The dataset of the track: the rows of its chunks with z-scored inputs and binned labels."""
    chunks_, _ = dataset.build_dataset(_track(spark, d), "x", _valid(), LENGTH)
    rows = chunks_.select("agent", "session", "chunk_start", F.inline("rows"))
    return rows.withColumns({c: r6(c) for c in ("x", "input", "raw_label")})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Start flags, sessions, steps, z-scores, bins, and the transition matrix of the bins."""
    rows = motion.relative_velocity(_rows(spark, d), "x", ["agent", "session"], "t").withColumnRenamed("x_d1", "step").where("step is not null")
    frame = FeatureFrame(rows).then(ZScore(columns=["step"]))
    binned = frame.df.withColumn("bin", g.bin_of("step", [-1e9, -1.0, -0.25, 0.25, 1.0, 1e9]))
    return binning.transitions(binned, "bin", ["agent", "session"], "t")
