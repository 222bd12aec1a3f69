"""Column blocks, label shapes and lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.sequences import running_offsets


def block(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The keys and the columns of one named block (prefix_name), as name."""
    cut = len(prefix) + 1
    return df.select(*keys, *[F.col(f"`{c}`").alias(c[cut:]) for c in df.columns if c.startswith(f"{prefix}_")])


def blocks_together(keys: list[str], parts: dict[str, DataFrame]) -> DataFrame:
    """Tables with the same keys as one, every column under its block's prefix."""
    out = None
    for name, df in parts.items():
        named = df.select(*keys, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = named if out is None else out.join(named, keys)
    return out


def mark_discrete(df: DataFrame, column: str, feature: str) -> DataFrame:
    """A bin column that says in its metadata which feature it came from."""
    return df.withMetadata(column, {"kind": "bin", "feature": feature})


def split_discrete(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The bin columns and all others, by the metadata."""
    bins = [f.name for f in df.schema if f.metadata.get("kind") == "bin"]
    return df.select(*keys, *bins), df.select(*[c for c in df.columns if c not in bins])


def melt_lookaheads(df: DataFrame, keys: list[str], features: list[str], taus: list[int]) -> DataFrame:
    """feature_tau columns as rows (keys, feature, tau, value)."""
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(n).alias("tau"), F.col(f"{f}_{n}").cast("double").alias("value")) for f in features for n in taus]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.feature", "r.tau", "r.value")


def spread_lookaheads(long: DataFrame, keys: list[str], features: list[str], taus: list[int]) -> DataFrame:
    """The inverse of melt_lookaheads, as one aggregation over listed columns."""
    picks = [F.max(F.when((F.col("feature") == f) & (F.col("tau") == n), F.col("value"))).alias(f"{f}_{n}") for f in features for n in taus]
    return long.groupBy(*keys).agg(*picks)


def index_in(df: DataFrame, column: str, big: DataFrame, value: str, name: str = "idx") -> DataFrame:
    """Place of each value in a sorted dimension without repeats, -1 if it is not in it."""
    ranked = running_offsets(big.select(F.col(value).alias("_v")).distinct(), ["_v"], name=name)
    return df.join(ranked, F.col(column) == F.col("_v"), "left").withColumn(name, F.coalesce(name, F.lit(-1))).drop("_v")


def map_arrays(df: DataFrame, columns: list[str], function: Callable[[Column], Column]) -> DataFrame:
    """An expression over every element of several array columns."""
    return df.withColumns({c: F.transform(c, function) for c in columns})


def hull_area(df: DataFrame, kp: str = "kp") -> DataFrame:
    """df with area: that of the convex hull of each row's points, in Arrow batches (monotone chain)."""

    def area(points: np.ndarray) -> float:
        p = sorted(map(tuple, points[~np.isnan(points).any(1)]))
        if len(p) < 3:
            return 0.0

        def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
            out: list[tuple[float, float]] = []
            for q in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                    out.pop()
                out.append(q)
            return out[:-1]

        h = np.array(half(p) + half(p[::-1]))
        return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], 1)) - np.dot(h[:, 1], np.roll(h[:, 0], 1))) / 2)

    @F.pandas_udf("double")
    def areas(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([area(np.stack([np.asarray(x, float), np.asarray(y, float)], 1)) for x, y in zip(xs, ys)], dtype="float64")

    return df.withColumn("area", areas(F.transform(kp, lambda p: p["x"]), F.transform(kp, lambda p: p["y"])))


def similarity_sigma(truth: DataFrame, predicted: DataFrame, keys: list[str], kp: str = "kp") -> DataFrame:
    """(point, sigma): root mean of the squared error of each keypoint over the area of its row's hull."""
    both = hull_area(truth, kp).join(predicted.select(*keys, F.col(kp).alias("_b")), keys)
    pairs = both.select("area", F.posexplode(F.arrays_zip(F.col(kp).alias("a"), F.col("_b").alias("b"))).alias("point", "p"))
    d2 = F.pow(F.col("p.a.x") - F.col("p.b.x"), 2) + F.pow(F.col("p.a.y") - F.col("p.b.y"), 2)
    return pairs.groupBy("point").agg(F.sqrt(F.avg(F.try_divide(d2, F.col("area")))).alias("sigma"))
