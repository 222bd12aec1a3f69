"""Error measures and simple baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.motion import ahead
from trackloom.operators.ranks import exact_percentiles
from trackloom.operators.sequences import running_offsets


def errors(truth: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] = ("feature",), sd: DataFrame | None = None) -> DataFrame:
    """(by, n, l1, l2, and of z-scored values l1_z, l2_z): mean absolute and squared error of ``value`` over rows with both."""
    joined = truth.select(*keys, F.col("value").alias("_a")).join(predicted.select(*keys, F.col("value").alias("_b")), keys).where("_a is not null and _b is not null")
    d = F.col("_a") - F.col("_b")
    aggs = [F.count("*").alias("n"), F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2")]
    if sd is not None:
        joined = joined.join(F.broadcast(sd.select(*by, "sd")), list(by))
        z = F.try_divide(d, F.col("sd"))
        aggs += [F.avg(F.abs(z)).alias("l1_z"), F.avg(z * z).alias("l2_z")]
    return joined.groupBy(*by).agg(*aggs)


def sample_errors(samples: DataFrame, truth: str, values: str, by: list[str]) -> DataFrame:
    """Over arrays of drawn values: mean over draws of the error, and the error of the best draw, both averaged over rows."""
    gap = F.transform(values, lambda v: F.abs(v - F.col(truth)))
    n = F.size(values)
    mean = F.aggregate(gap, F.lit(0.0), lambda a, v: a + v) / n
    mean2 = F.aggregate(gap, F.lit(0.0), lambda a, v: a + v * v) / n
    return samples.groupBy(*by).agg(F.avg(mean).alias("l1_mean"), F.avg(F.array_min(gap)).alias("l1_best"), F.avg(mean2).alias("l2_mean"), F.avg(mean * mean).alias("l1_mean_squared"))


def closest_sample(samples: DataFrame, keys: list[str], sample: str, error: Column, value: str) -> DataFrame:
    """Of several draws of a row, the one with the least error (summed over features by the caller)."""
    return samples.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(error, F.col(sample))).alias(value), F.min(error).alias("error"))


def cross_entropy(df: DataFrame, weights: str, logits: str, by: list[str]) -> DataFrame:
    """Mean of -sum w (logit - log sum exp): soft targets against logits, both arrays."""
    top = F.array_max(logits)
    lse = top + F.ln(F.aggregate(F.transform(logits, lambda v: F.exp(v - F.array_max(logits))), F.lit(0.0), lambda a, v: a + v))
    terms = F.zip_with(weights, logits, lambda w, v: w * v)
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    return df.groupBy(*by).agg(F.avg(lse * total - F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)).alias("cross_entropy"))


def combine_errors(parts: DataFrame, measures: list[str], by: list[str] = ()) -> DataFrame:
    """Errors of segments, weighted by their rows."""
    n = F.sum("n")
    return parts.groupBy(*by).agg(n.alias("n"), *[F.try_divide(F.sum(F.col(m) * F.col("n")), n).alias(m) for m in measures])


def baselines(df: DataFrame, label: str, keys: list[str], t: str, taus: list[int]) -> DataFrame:
    """(tau, n, zero, constant): mean absolute error of predicting 0, and of the label tau frames earlier."""
    w = Window.partitionBy(*keys).orderBy(t)
    wide = df.select(F.col(label).alias("a"), *[ahead(label, -n, w, t).alias(f"b{n}") for n in taus])
    rows = F.array(*[F.struct(F.lit(n).alias("tau"), F.col(f"b{n}").alias("b")) for n in taus])
    long = wide.select("a", F.explode(rows).alias("r")).where("r.b is not null and a is not null")
    return long.groupBy(F.col("r.tau").alias("tau")).agg(F.count("*").alias("n"), F.avg(F.abs("a")).alias("zero"), F.avg(F.abs(F.col("a") - F.col("r.b"))).alias("constant"))


def mixed_objective(df: DataFrame, l1: Column, ce: Column, weight: float, mask: Column, by: list[str] = ()) -> DataFrame:
    """(1-w) L1 + w CE over masked rows."""
    return df.where(mask).groupBy(*by).agg(F.count("*").alias("n"), F.avg(l1).alias("l1"), F.avg(ce).alias("ce"), ((1 - weight) * F.avg(l1) + weight * F.avg(ce)).alias("objective"))


def least_of_states(df: DataFrame, keys: list[str], state: str, error: str) -> DataFrame:
    """Each row's best state and its error."""
    return df.groupBy(*keys).agg(F.min(error).alias(error), F.min_by(state, F.struct(error, state)).alias(state))


def horizon_errors(truth: DataFrame, integrated: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """Mean absolute error of an integrated value by how far it was integrated."""
    j = truth.select(*keys, F.col("value").alias("_a")).join(integrated.select(*keys, horizon, F.col("value").alias("_b")), keys)
    return j.groupBy(horizon).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("l1"))


def compare_transitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cells, frobenius, largest): how two transition matrices differ; a missing cell is 0."""
    j = a.select("from_bin", "to_bin", F.col("p").alias("pa")).join(b.select("from_bin", "to_bin", F.col("p").alias("pb")), ["from_bin", "to_bin"], "full_outer")
    d = F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))
    return j.agg(F.count("*").alias("cells"), F.sqrt(F.sum(d * d)).alias("frobenius"), F.max(F.abs(d)).alias("largest"))


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], bound: float | None = None) -> DataFrame:
    """(column, only_left, only_right, null_mismatch, largest, within): keys that one table lacks, and the largest difference."""
    x = a.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    y = b.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    j = x.join(y, keys, "full_outer")
    per = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("d"), (F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())).alias("m")) for c in columns])
    out = j.select("_a", "_b", F.explode(per).alias("r")).groupBy(F.col("r.column").alias("column")).agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if("r.m").alias("null_mismatch"), F.max("r.d").alias("largest"))
    return out.withColumn("within", F.coalesce(F.col("largest") <= bound, F.lit(True))) if bound is not None else out


def missing_iff_invalid(df: DataFrame, valid: Column, features: list[str]) -> DataFrame:
    """(feature, violations): rows where a feature is missing though valid, or there though not."""
    one = df.agg(*[F.count_if(valid != F.col(f).isNotNull()).alias(f) for f in features])
    return one.unpivot([], features, "feature", "violations")


def segment_faults(df: DataFrame, segment: list[str], start: Column, first: Column, id: str) -> DataFrame:
    """Segments with a start inside, or with more than one individual."""
    return df.groupBy(*segment).agg(F.count_if(start & ~first).alias("inner_starts"), F.countDistinct(id).alias("ids")).where("inner_starts > 0 or ids <> 1")


def one_axis(df: DataFrame, segment: list[str], t: str, values: list[str], gap: int = 1) -> DataFrame:
    """(axis, segment, values): many segments side by side on one axis, in the order of their keys, with ``gap`` empty rows after each.

    A segment begins at the running total of the lengths before it, so rows are placed by a join with one row per segment.
    """
    lengths = df.groupBy(*segment).agg(F.count("*").alias("_n"), F.min(t).alias("_t0")).withColumn("_wide", F.col("_n") + gap)
    begins = running_offsets(lengths, segment, "_wide", "_begin")
    w = Window.partitionBy(*segment).orderBy(t)
    placed = df.withColumn("_k", F.row_number().over(w) - 1).join(begins, segment)
    rows = placed.select((F.col("_begin") + F.col("_k")).alias("axis"), *segment, *values)
    kinds = dict(df.dtypes)
    empty = begins.where(F.lit(gap > 0)).select(F.explode(F.sequence(F.col("_begin") + F.col("_n"), F.col("_begin") + F.col("_n") + F.lit(max(gap, 1) - 1))).alias("axis"), *segment, *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    return rows.unionByName(empty)


def common_limits(df: DataFrame, columns: list[str], share: float = 0.01) -> tuple[float, float]:
    """The percentiles ``share`` and 1 - ``share`` of several columns taken together."""
    long = df.select(F.lit(0).alias("key"), F.explode(F.array(*columns)).alias("x"))
    return tuple(exact_percentiles(long, [share, 1 - share])[0])
