"""Aggregates and fitted statistics. Fits return one row per feature or group; nothing else comes to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import bin_of, mod2pi
from trackloom.operators.ranks import exact_percentiles


def moments(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """(feature, n, mean, sd) with the population deviation; missing values do not count."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select(*by, "s.feature", "s.x")
    return long.groupBy(*by, "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def vector_moments(df: DataFrame, columns: list[str]) -> dict[str, list[list[float]]]:
    """{column: [means, population deviations]} of array columns, place by place; missing values do not count. One pass over all."""
    # one place to a row: hundreds of aggregates side by side would not compile into one method
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("values")) for i, c in enumerate(columns)]))
    long = df.select(named.alias("g")).select("g.column", F.posexplode("g.values").alias("place", "x"))
    found = long.groupBy("column", "place").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()  # one row per feature
    out: dict[str, list[list[float]]] = {c: [[], []] for c in columns}
    for r in sorted(found, key=lambda r: (r["column"], r.place)):
        for to, value in zip(out[columns[r["column"]]], (r["mean"], r.sd)):
            to.append(value)
    return out


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """(n, mean, sd) of parts as those of their union (Chan): restartable and safe to update."""
    p = parts.where("n > 0").withColumn("m2", F.col("sd") * F.col("sd") * F.col("n")).withColumn("total", F.col("n") * F.col("mean"))
    agg = p.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("between"))
    mean = F.col("total") / F.col("n")
    return agg.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest((F.col("m2") + F.col("between")) / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


def percentiles(df: DataFrame, x: str, probs: list[float], by: list[str] = (), approximate: bool = False) -> DataFrame:
    """q: the percentiles with linear interpolation; approximate for groups whose distinct values are too many to hold.

    Those of a whole table come by ranks, so no task holds its values; NULL and NaN do not count.
    """
    if not by and not approximate:
        found = exact_percentiles(df.select(F.lit(0).alias("key"), F.col(x).alias("x")), probs)
        return df.sparkSession.createDataFrame([(found.get(0),)], "q array<double>")
    q = F.percentile_approx(x, probs, 100_000) if approximate else F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))
    return df.groupBy(*by).agg(q.alias("q"))


def tail_percentiles(df: DataFrame, x: str, probs: list[float], by: list[str] = ()) -> DataFrame:
    """Percentiles of the values from 0 up and, mirrored, of those from 0 down."""
    up, down = F.when(F.col(x) >= 0, F.col(x)), F.when(F.col(x) <= 0, -F.col(x))
    if not by:
        sides = F.explode(F.array(F.struct(F.lit("up").alias("key"), up.alias("x")), F.struct(F.lit("down").alias("key"), down.alias("x"))))
        found = exact_percentiles(df.select(sides.alias("s")).select("s.*"), probs)
        return df.sparkSession.createDataFrame([(found.get("up"), [-v for v in found["down"]] if "down" in found else None)], "up array<double>, down array<double>")
    a = F.array(*[F.lit(float(p)) for p in probs])
    return df.groupBy(*by).agg(F.percentile(up, a).alias("up"), F.transform(F.percentile(down, a), lambda v: -v).alias("down"))


def histogram(df: DataFrame, x: str, edges: list[float], by: list[str] = (), smooth: int = 0) -> DataFrame:
    """(by, bin, n, share, density): rows between the edges, empty bins too; ``smooth`` is added to every count."""
    k = len(edges) - 1
    inside = df.where((F.col(x) >= edges[0]) & (F.col(x) <= edges[-1]))
    counts = inside.groupBy(*by, bin_of(x, edges).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    grid = df.select(*by).distinct().join(F.broadcast(every)) if by else every
    full = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + smooth)
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    share = F.try_divide(F.col("n").cast("double"), total)
    widths = F.element_at(F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:])]), F.col("bin") + 1)
    return full.withColumn("share", share).withColumn("density", F.col("share") / widths)


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    return [lo * (hi / lo) ** (i / n) for i in range(n + 1)]


def circular(df: DataFrame, angle: str, probs: list[float], by: list[str] = ()) -> DataFrame:
    """mean and deviation of an angle, and percentiles about the mean: a second pass over wrapped residuals."""
    first = df.groupBy(*by).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"), F.count(angle).alias("n"))
    stats = first.select(*by, "n", F.atan2("_s", "_c").alias("mean"), F.sqrt(-2 * F.ln(F.hypot("_s", "_c"))).alias("sd"))
    joined = df.join(F.broadcast(stats) if not by else stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    rest = joined.withColumn("_r", mod2pi(F.col(angle) - F.col("mean")))
    if not by:
        return stats.crossJoin(F.broadcast(percentiles(rest, "_r", probs))).select("n", "mean", "sd", "q")
    return rest.groupBy(*by, "n", "mean", "sd").agg(F.transform(F.percentile("_r", F.array(*[F.lit(float(p)) for p in probs])), lambda v: v).alias("q"))


def value_counts(df: DataFrame, category: str, value: str, sequence: str | None = None) -> DataFrame:
    """Rows per category and value, and in how many sequences the value comes."""
    more = [F.countDistinct(sequence).alias("sequences")] if sequence else []
    return df.where(F.col(value).isNotNull()).groupBy(category, value).agg(F.count("*").alias("n"), *more)


def class_weights(counts: DataFrame, category: str = "category", lo: float = 0.1, hi: float = 100.0) -> DataFrame:
    """weight: inverse share of each value of its category over the number of values, within [lo, hi]."""
    w = Window.partitionBy(category)
    raw = F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))
    return counts.withColumn("weight", F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)))


def balanced_rows(df: DataFrame, categories: list[str], lo: float = 0.1, hi: float = 100.0) -> DataFrame:
    """The rows with weight: the mean of their values' weights over all categories; NULL values weigh nothing and count for nothing."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in categories])).alias("s")).select("s.*")
    weights = class_weights(long.where("value is not null").groupBy("category", "value").agg(F.count("*").alias("n")), "category", lo, hi)
    out = df
    for i, c in enumerate(categories):
        # one row per class
        part = weights.where(F.col("category") == c).select(F.col("value").alias(f"_v{i}"), F.col("weight").alias(f"_w{i}"))
        out = out.join(part, out[c].cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    known = [F.col(f"_w{i}") for i in range(len(categories))]
    total, n = sum((F.coalesce(w, F.lit(0.0)) for w in known), F.lit(0.0)), sum((w.isNotNull().cast("int") for w in known), F.lit(0))
    return out.withColumn("weight", F.try_divide(total, n)).drop(*[f"_w{i}" for i in range(len(categories))])


def granularity(df: DataFrame, sequence: str, target: str, value: str, by: list[str] = ()) -> DataFrame:
    """Of a label: constant per sequence, per target within it, or changing by frame."""
    per_target = df.groupBy(*by, sequence, target).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    per_sequence = per_target.groupBy(*by, sequence).agg(F.bool_or(F.col("a") != F.col("b")).alias("frame"), (F.min("a") != F.max("b")).alias("seq"))
    out = per_sequence.groupBy(*by).agg(F.coalesce(F.bool_or("frame"), F.lit(False)).alias("f"), F.coalesce(F.bool_or("seq"), F.lit(False)).alias("s"))
    return out.select(*by, F.when(F.col("f"), "frame").when(F.col("s"), "target").otherwise("sequence").alias("granularity"))


def label_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for every combination of the keys and all their totals."""
    return df.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def distribution_fits(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Normal (mean, sd) and Laplace (median, mean absolute deviation from it), in two passes."""
    rows = df.select(*by, F.to_json(F.struct(*by)).alias("key") if by else F.lit("").alias("key"), F.col(x).alias("x"))
    medians = {k: v[0] for k, v in exact_percentiles(rows, [0.5]).items()}
    # one row per group
    table = df.sparkSession.createDataFrame(list(medians.items()), "key string, median double")
    return rows.join(table, "key", "left").groupBy(*by, "median").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.avg(F.abs(F.col("x") - F.col("median"))).alias("scale"))


def covariance(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, cov): sample covariance of every pair, as one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def fit_circle(df: DataFrame, x: str, y: str, centres: list[tuple[float, float]], by: list[str] = ()) -> DataFrame:
    """cx, cy, radius, err: the centre of the grid with the least deviation of radii, one pass for all of them."""
    grid = F.array(*[F.struct(F.lit(float(a)).alias("cx"), F.lit(float(b)).alias("cy")) for a, b in centres])
    rows = df.select(*by, x, y, F.explode(grid).alias("g")).withColumn("_r", F.hypot(F.col(x) - F.col("g.cx"), F.col(y) - F.col("g.cy")))
    per = rows.groupBy(*by, "g").agg(F.avg("_r").alias("radius"), F.stddev_pop("_r").alias("err"))
    best = per.groupBy(*by).agg(F.min_by(F.struct("g", "radius", "err"), F.struct("err", "g")).alias("b"))
    return best.select(*by, "b.g.cx", "b.g.cy", "b.radius", "b.err")


def weighted_holdout(sequences: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """held_out: k sequences drawn without replacement with chances by weight (key -ln(u)/w, the k least), by a hash of the key."""
    drawn = sequences.withColumn("_e", -F.ln(hash_draw([key], seed, "held")) / F.col(weight))
    # k rows at most: the top of a bounded sort
    chosen = drawn.where(F.col(weight) > 0).orderBy("_e", key).limit(k).select(F.col(key).alias("_k"))
    return drawn.join(F.broadcast(chosen), F.col(key) == F.col("_k"), "left").withColumn("held_out", F.col("_k").isNotNull()).drop("_e", "_k")


def density_2d(df: DataFrame, x: str, y: str, ex: list[float], ey: list[float]) -> DataFrame:
    """(bx, by, density) over two sets of edges, the first and last bins of each left out."""
    binned = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(bin_of(x, ex).alias("bx"), bin_of(y, ey).alias("by")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    width = lambda e, b: F.element_at(F.array(*[F.lit(float(q - p)) for p, q in zip(e, e[1:])]), F.col(b) + 1)
    out = binned.withColumn("density", F.col("n") / (total * width(ex, "bx") * width(ey, "by")))
    return out.where(f"bx > 0 and bx < {len(ex) - 2} and by > 0 and by < {len(ey) - 2}")


def individual_summary(df: DataFrame, id: str, flag: Column, x: str, probs: list[float], margin: float = 0.05, least: int = 10) -> DataFrame:
    """(id, n, share, q, kind): rows, the share of a flag, percentiles; kind by the share's margin where rows are enough."""
    out = df.groupBy(id).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("share"), F.percentile(x, F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    return out.withColumn("kind", F.when(F.col("n") < least, None).when(F.col("share") >= 1 - margin, "flagged").when(F.col("share") <= margin, "plain"))


def rms_difference(a: DataFrame, b: DataFrame, keys: list[str], features: list[str], prob: float | None = None) -> DataFrame:
    """(feature, scale): root mean square (or a percentile of the size) of how features differ between two tables."""
    d = a.select(*keys, *features).join(b.select(*keys, *[F.col(f).alias(f"_{f}") for f in features]), keys)
    if prob is not None:
        sizes = d.select(F.explode(F.array(*[F.struct(F.lit(f).alias("key"), F.abs(F.col(f"_{f}") - F.col(f)).alias("x")) for f in features])).alias("s")).select("s.*")
        found = exact_percentiles(sizes, [prob])
        return d.sparkSession.createDataFrame([(f, found[f][0] if f in found else None) for f in features], "feature string, scale double")
    one = d.agg(*[F.sqrt(F.avg((F.col(f"_{f}") - F.col(f)) * (F.col(f"_{f}") - F.col(f)))).alias(f) for f in features])
    return one.unpivot([], features, "feature", "scale")


def noisy(df: DataFrame, columns: list[str], sigma: float, keys: list[str], seed: int = 0) -> DataFrame:
    """Columns with Gaussian noise drawn from a hash of the keys: the same for any partitioning."""
    return df.withColumns({c: F.col(c) + sigma * normal_draw(keys, seed, c) for c in columns})


def hash_draw(keys: list[str], seed: int, salt: Column | str, part: int = 0) -> Column:
    """A number in (0, 1) from the md5 of keys, seed and salt; ``part`` 0 or 1 takes other digits of the same hash."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)), salt if isinstance(salt, Column) else F.lit(salt))), 1 + 12 * part, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal_draw(keys: list[str], seed: int, salt: Column | str) -> Column:
    """A standard normal number from a hash (Box-Muller): the same for any partitioning."""
    return F.sqrt(-2 * F.ln(hash_draw(keys, seed, salt, 0))) * F.cos(6.283185307179586 * hash_draw(keys, seed, salt, 1))


def correlated_noise(df: DataFrame, values: str, covariance: list[list[float]], keys: list[str], seed: int = 0) -> DataFrame:
    """An array column with normal noise of the given covariance: its Cholesky factor times independent draws."""
    factor = np.linalg.cholesky(np.asarray(covariance, float))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in factor])
    draws = F.array(*[normal_draw(keys, seed, str(j)) for j in range(len(factor))])
    noise = F.transform(rows, lambda row: F.aggregate(F.zip_with(row, F.col("_z"), lambda a, z: a * z), F.lit(0.0), lambda s, v: s + v))
    return df.withColumn("_z", draws).withColumn(values, F.zip_with(values, noise, lambda x, e: x + e)).drop("_z")


def resampled_noise(df: DataFrame, values: str, errors: DataFrame, n_errors: int, keys: list[str], seed: int = 0, together: bool = True) -> DataFrame:
    """An array column with errors drawn from a table (idx from 0, error array): one error vector to a row, or, not ``together``, each
    place from a row of its own. Rows meet their errors by a hashed index in an equi-join."""
    index = lambda salt: F.floor(hash_draw(keys, seed, salt) * n_errors).cast("long")
    table = errors.select(F.col("idx").cast("long").alias("_idx"), F.col("error").alias("_e"))
    if together:
        met = df.withColumn("_idx", index("row")).join(table, "_idx", "left")
        return met.withColumn(values, F.zip_with(values, "_e", lambda x, e: x + e)).select(*df.columns)
    long = df.select(*keys, F.posexplode(values).alias("_place", "_x")).withColumn("_idx", index(F.col("_place").cast("string")))
    each = long.join(table.select("_idx", F.posexplode("_e").alias("_place", "_e")), ["_idx", "_place"], "left")
    sums = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", (F.col("_x") + F.col("_e")).alias("v")))), lambda p: p["v"]).alias("_new"))
    return df.join(sums, keys).withColumn(values, F.col("_new")).select(*df.columns)


def paired_histogram(df: DataFrame, label: str, prediction: str, edges: list[float] | None = None, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, labels, predictions): both columns over the same edges, by default even ones between the labels' extremes.

    Values outside the edges are in no bin; one pass counts both.
    """
    if edges is None:
        r = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
        edges = [r.lo + (r.hi - r.lo) * i / bins for i in range(bins + 1)]
    both = df.select(F.explode(F.array(F.struct(F.lit(True).alias("is_label"), F.col(label).alias("x")), F.struct(F.lit(False).alias("is_label"), F.col(prediction).alias("x")))).alias("v")).select("v.*")
    counts = both.where(F.col("x").between(edges[0], edges[-1])).groupBy(bin_of("x", edges).alias("bin")).agg(F.count_if("is_label").alias("labels"), F.count_if(~F.col("is_label")).alias("predictions"))
    grid = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    return grid.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("predictions", F.lit(0)).alias("predictions"))
