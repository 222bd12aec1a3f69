"""Discretisation and binned Markov models. Spark makes the counts; searches run on tables whose size the number of bins fixes."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import bin_of, signed_sqrt
from trackloom.operators.ranks import exact_percentiles

#: Occupied histogram cells that come to the driver at most, over all keys.
MAX_CELLS = 1 << 18


def _keyed(df: DataFrame, x: str) -> DataFrame:
    """(key, x): the values of a column under key 0, those of an array column under their places."""
    if dict(df.dtypes)[x].startswith("array"):
        return df.select(F.posexplode(x).alias("key", "x"))
    return df.select(F.lit(0).alias("key"), F.col(x).alias("x"))


def _even(k: int, outlier: float) -> list[float]:
    return [outlier + (1 - 2 * outlier) * i / k for i in range(k + 1)]


def quantile_edges(df: DataFrame, x: str, k: int, outlier: float = 0.0) -> list[float]:
    """k+1 edges at even quantiles between the two tails cut off (shares, not per cent)."""
    return exact_percentiles(_keyed(df, x), _even(k, outlier)).get(0, [])


def uniform_edges(lo: float, hi: float, k: int) -> list[float]:
    return [lo + (hi - lo) * i / k for i in range(k + 1)]


def boundary_edges(df: DataFrame, x: str, widen: float = 1e-6) -> tuple[float, float]:
    """Least and greatest value, moved apart by a share of their distance."""
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    pad = widen * (r.hi - r.lo)
    return r.lo - pad, r.hi + pad


def kmeans_edges(df: DataFrame, x: str, k: int, seed: int = 0) -> list[float]:
    """Edges half-way between the centres of k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[x], outputCol="_v").transform(df.where(F.col(x).isNotNull()).select(F.col(x).cast("double")))
    centres = sorted(float(c[0]) for c in KMeans(k=k, seed=seed, featuresCol="_v").fit(rows).clusterCenters())
    lo, hi = boundary_edges(df, x)
    return [lo, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], hi]


def merged_cells(counts: dict[int, int], n: int, k: int) -> list[int]:
    """Borders (0 .. n) of k bins made of n cells, of which ``counts`` has the occupied ones: the least populated neighbours merge, of
    equal ones the first, until k are left. Empty stretches are one item, so the work depends on the occupied cells alone."""
    if n <= k:
        return list(range(n + 1))
    # items: first cell, cells, rows; an empty stretch counts as the merges that close it
    first, rows, at = [], [], 0
    for c in sorted(counts):
        if c > at:
            first.append(at)
            rows.append(0)
        first.append(c)
        rows.append(counts[c])
        at = c + 1
    if at < n:
        first.append(at)
        rows.append(0)
    size = [b - a for a, b in zip(first, [*first[1:], n])]
    left = n - k
    # cells of a stretch meet at no cost, the first stretch first
    borders: list[int] = []
    for i, (f, z) in enumerate(zip(first, size)):
        if rows[i] == 0 and z > 1:
            merged = min(left, z - 1)
            left -= merged
            borders += range(f + merged + 1, f + z)
    if not left:
        return sorted({0, n, *first, *borders})
    m = len(first)
    after, before = [*range(1, m), -1], [-1, *range(m - 1)]
    # one number to a pair, rows of both and then its place: the heap's order is that of least rows, first place
    shift = m.bit_length()
    place, pop, push = (1 << shift) - 1, heapq.heappop, heapq.heappush
    heap = [(x + y) << shift | i for i, (x, y) in enumerate(zip(rows, rows[1:]))]
    heapq.heapify(heap)
    alive = [True] * m
    while left:
        top = pop(heap)
        i = top & place
        j = after[i]
        if j < 0 or not alive[i] or rows[i] + rows[j] != top >> shift:
            continue  # one of them has merged since
        rows[i] += rows[j]
        alive[j] = False
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            push(heap, (rows[i] + rows[k]) << shift | i)
        h = before[i]
        if h >= 0:
            push(heap, (rows[h] + rows[i]) << shift | h)
        left -= 1
    return [*[f for f, a in zip(first, alive) if a], n]


def joint_edges(df: DataFrame, column: str, k: int, widths: list[float] | None = None, outlier: float = 0.001) -> list[list[float]]:
    """k+1 edges for each place of an array column (a plain column is one place), all from the same passes.

    No two edges are closer than the place's width: uniform edges if it is too large for k bins, quantiles if it is 0, and else a
    fine histogram whose least populated neighbours merge (merged_cells). At most MAX_CELLS occupied cells come to the driver.
    """
    values = _keyed(df, column)
    found = exact_percentiles(values, _even(k, outlier))
    out: dict[int, list[float]] = {}
    fine: dict[int, tuple[float, float, int]] = {}
    for key, q in found.items():
        width = widths[key] if widths else 0.0
        lo, hi = q[0], q[-1]
        n = int((hi - lo) / width) if width > 0 else 0
        if width <= 0:
            out[key] = q
        elif n <= k:
            out[key] = uniform_edges(lo, hi, k)
        else:
            fine[key] = (lo, hi, n)
    if fine:
        table = df.sparkSession.createDataFrame([(key, *f) for key, f in fine.items()], "key int, lo double, hi double, n long")
        cell = F.greatest(F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("n"))), F.col("n") - 1), F.lit(0))
        cells = values.join(F.broadcast(table), "key").where("x between lo and hi").groupBy("key", cell.alias("cell")).agg(F.count("*").alias("rows"))
        rows = cells.limit(MAX_CELLS + 1).collect()
        if len(rows) > MAX_CELLS:
            raise ValueError(f"over {MAX_CELLS} cells of the given widths are occupied: use larger widths")
        counts: dict[int, dict[int, int]] = {}
        for r in rows:
            counts.setdefault(r.key, {})[r.cell] = r["rows"]
        for key, (lo, hi, n) in fine.items():
            out[key] = [lo + (hi - lo) * i / n for i in merged_cells(counts.get(key, {}), n, k)]
    return [out[key] for key in sorted(out)]


def joint_means(df: DataFrame, column: str, edges: list[list[float]]) -> list[list[float]]:
    """The mean of every bin of every place of an array column; an empty bin has its midpoint."""
    nested = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])
    binned = _keyed(df, column).where("x is not null").select("key", "x", bin_of(F.col("x"), F.get(nested, F.col("key"))).alias("bin"))
    found = {(r.key, r.bin): r["mean"] for r in binned.groupBy("key", "bin").agg(F.avg("x").alias("mean")).collect()}
    return [[found.get((i, b), (lo + hi) / 2) for b, (lo, hi) in enumerate(zip(e, e[1:]))] for i, e in enumerate(edges)]


def minimum_width_edges(df: DataFrame, x: str, k: int, width: float, outlier: float = 0.001) -> list[float]:
    """k+1 edges no closer than ``width``: joint_edges of one column."""
    return joint_edges(df, x, k, [width], outlier)[0]


def with_boundary(edges: list[float], lo: float, hi: float) -> list[float]:
    """The edges between fixed outer ones, in which outliers fall: inner edges beyond them are left out."""
    return [lo, *[e for e in edges if lo < e < hi], hi]


def bin_statistics(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, centre, mean, median, n) of every bin; an empty one has its midpoint as mean and median."""
    binned = df.where(F.col(x).isNotNull()).select(bin_of(x, edges).alias("bin"), F.col(x).alias("x"))
    agg = binned.groupBy("bin").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    medians = exact_percentiles(binned.withColumnRenamed("bin", "key"), [0.5])
    grid = df.sparkSession.createDataFrame([(i, float(a), float(b), (a + b) / 2, medians.get(i, [None])[0]) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double, centre double, median double")
    return grid.join(agg, "bin", "left").select("bin", "lo", "hi", "centre", F.coalesce("mean", "centre").alias("mean"), F.coalesce("median", "centre").alias("median"), F.coalesce("n", F.lit(0)).alias("n"))


def bin_samples(df: DataFrame, x: str, edges: list[float], n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """(bin, idx, value): n values drawn with replacement from each bin, by hashes of the rows' keys: each draw takes the row
    whose hash is least for its number, so no bin is collected."""
    rows = df.where(F.col(x).isNotNull()).select(*keys, bin_of(x, edges).alias("bin"), F.col(x).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    return rows.groupBy("bin", "idx").agg(F.min_by("value", F.xxhash64(*keys, "idx", F.lit(seed))).alias("value"))


def soft_bins(df: DataFrame, x: str, edges: list[float], soften_to_ends: bool = False) -> DataFrame:
    """The rows with (bin, weight), one or two for each: 1-d for the own bin and d for the neighbour on the value's side, where
    d is the distance from the bin's centre in widths. Beyond the outer centres there is no neighbour, unless softened."""
    k = len(edges) - 1
    b = bin_of(x, edges)
    pick = lambda xs, i: F.get(F.array(*[F.lit(float(v)) for v in xs]), i)
    out = df.where(F.col(x).isNotNull()).withColumn("_b", b)
    centre, width = pick([(a + c) / 2 for a, c in zip(edges, edges[1:])], F.col("_b")), pick([c - a for a, c in zip(edges, edges[1:])], F.col("_b"))
    inside = F.greatest(F.least(F.col(x), F.lit(float(edges[-1]))), F.lit(float(edges[0])))
    out = out.withColumn("_d", (inside - centre) / width)
    side = F.col("_b") + F.when(F.col("_d") < 0, -1).otherwise(1)
    d = F.when((side < 0) | (side >= k) , F.lit(0.0)).otherwise(F.abs("_d"))
    if soften_to_ends:
        side = F.greatest(F.least(side, F.lit(k - 1)), F.lit(0))
    parts = F.array(F.struct(F.col("_b").alias("bin"), (1 - d).alias("weight")), F.struct(side.cast("int").alias("bin"), d.alias("weight")))
    return out.withColumn("_p", F.explode(F.filter(parts, lambda p: p["weight"] > 0))).select(*df.columns, "_p.bin", "_p.weight")


def expectation(weights: DataFrame, keys: list[str], bins: DataFrame, value: str = "centre", slack: float = 1e-3) -> DataFrame:
    """(keys, value): the mean of the bins' values by weight; NULL unless the weights add up to 1."""
    joined = weights.join(F.broadcast(bins.select("bin", F.col(value).alias("_v"))), "bin")
    w = F.sum("weight")
    return joined.groupBy(*keys).agg(F.when(F.abs(w - 1) < slack, F.try_divide(F.sum(F.col("weight") * F.col("_v")), w)).alias("value"))


def sample_bins(weights: DataFrame, keys: list[str], samples: DataFrame, n_samples: int, seed: int = 0) -> DataFrame:
    """(keys, bin, value): a bin drawn by weight (the first whose running sum reaches the draw) and one of its stored samples."""
    w = Window.partitionBy(*keys).orderBy("bin")
    u = lambda k: (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    total = F.sum("weight").over(Window.partitionBy(*keys))
    run = weights.withColumn("_cdf", F.sum("weight").over(w)).withColumn("_u", u(0) * total)
    drawn = run.groupBy(*keys).agg(F.min(F.when(F.col("_cdf") >= F.col("_u"), F.col("bin"))).alias("bin")).withColumn("idx", F.floor(u(1) * n_samples).cast("int"))
    return drawn.join(F.broadcast(samples), ["bin", "idx"], "left").drop("idx")


def transitions(df: DataFrame, bin_: str, keys: list[str], t: str) -> DataFrame:
    """(from_bin, to_bin, n, p) of consecutive rows of a sequence."""
    w = Window.partitionBy(*keys).orderBy(t)
    steps = df.select(F.col(bin_).alias("from_bin"), F.lead(bin_).over(w).alias("to_bin"), (F.lead(t).over(w) == F.col(t) + 1).alias("_next")).where("_next and from_bin is not null and to_bin is not null")
    counts = steps.groupBy("from_bin", "to_bin").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_bin")))


def log_likelihood(counts: DataFrame, edges: list[float]) -> DataFrame:
    """(n, loglik) of transition counts: sum of n (ln p - ln width of the target bin)."""
    widths = F.get(F.array(*[F.lit(math.log(b - a)) for a, b in zip(edges, edges[1:])]), F.col("to_bin"))
    return counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.ln("p") - widths)).alias("loglik"))


def optimal_edges(df: DataFrame, x: str, keys: list[str], t: str, k: int, cells: int = 500, sweeps: int = 6) -> list[float]:
    """k+1 edges that make the binned Markov model likelier: coordinate descent over the inner edges.

    Spark counts transitions between ``cells`` fine cells once; the search works on that table (cells squared at most), moving
    one edge at a time to the best cell border between its neighbours, until a sweep changes nothing.
    """
    lo, hi = boundary_edges(df, x)
    fine = uniform_edges(lo, hi, cells)
    cell = F.greatest(F.least(F.floor((F.col(x) - lo) / ((hi - lo) / cells)), F.lit(cells - 1)), F.lit(0)).cast("int")
    rows = transitions(df.withColumn("_cell", cell), "_cell", keys, t).select("from_bin", "to_bin", "n").collect()
    counts = np.zeros((cells, cells))
    for r in rows:
        counts[r.from_bin, r.to_bin] = r.n
    sums = np.zeros((cells + 1, cells + 1))
    sums[1:, 1:] = counts.cumsum(0).cumsum(1)
    mass = counts.sum(0).cumsum()
    cuts = np.unique([0, *[int(np.searchsorted(mass, mass[-1] * i / k)) for i in range(1, k)], cells])
    cuts = np.array([0, *range(1, k), cells]) if len(cuts) < k + 1 else cuts

    def score(c: np.ndarray) -> float:
        n = np.diff(np.diff(sums[np.ix_(c, c)], axis=0), axis=1)
        rows_ = n.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(n > 0, n * np.log(n / rows_), 0).sum()
        return ll - (n.sum(0) * np.log(np.diff(c))).sum()

    best = score(cuts)
    for _ in range(sweeps):
        moved = False
        for i in range(1, k):
            for at in range(cuts[i - 1] + 1, cuts[i + 1]):
                trial = cuts.copy()
                trial[i] = at
                if (s := score(trial)) > best + 1e-9:
                    best, cuts, moved = s, trial, True
        if not moved:
            break
    return [fine[i] for i in cuts]


def tokens(df: DataFrame, features: list[str], k: int, limit: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows with token: k-means over signed square roots of the features, and their distance from its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    roots = [f"_r{i}" for i in range(len(features))]
    rows = df.dropna(subset=features).withColumns({r: signed_sqrt(f, limit) for r, f in zip(roots, features)})
    rows = VectorAssembler(inputCols=roots, outputCol="_v").transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="token").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    out = model.transform(rows)
    error = F.zip_with(vector_to_array("_v"), F.get(centres, F.col("token")), lambda a, b: F.abs(a - b))
    return out.withColumn("token_error", error).drop(*roots, "_v")


def move_edge(counts: DataFrame, mapping: Column, source: str = "cell") -> DataFrame:
    """Counts of fine cells re-aggregated under another map of cells to bins: what an edge that moves needs."""
    return counts.withColumn("bin", mapping).groupBy("bin").agg(F.sum("n").alias("n"))
