"""Stages on array columns: a column is a named group of features (velocity, pose, what is seen), one array<double> to a row.

Groups keep tables narrow: a stage on hundreds of features is one expression, and what it learns is one list for each column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import binning, stats
from trackloom.plans.stages import Stage


def doubles(values: list[float | None]) -> Column:
    return F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values])


class VectorZScore(Stage):
    """params: columns (arrays); learned in one pass over all of them: stats {column: [means, deviations]}. NULL where a deviation is 0."""

    kind = "vector_zscore"

    def fit(self, df: DataFrame) -> VectorZScore:
        return self if "stats" in self.params else VectorZScore(self.name, **self.params, stats=stats.vector_moments(df, self.params["columns"]))

    def apply(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            mean, sd = self.params["stats"][c]
            return F.zip_with(c, F.arrays_zip(doubles(mean).alias("m"), doubles(sd).alias("s")), lambda x, p: F.try_divide(x - p["m"], p["s"]))

        return df.withColumns({c: scaled(c) for c in self.params["columns"]})

    def invert(self, df: DataFrame) -> DataFrame:
        def back(c: str) -> Column:
            mean, sd = self.params["stats"][c]
            # a feature without deviation was its mean
            return F.zip_with(c, F.arrays_zip(doubles(mean).alias("m"), doubles(sd).alias("s")), lambda x, p: F.when(p["s"] == 0, p["m"]).otherwise(x * p["s"] + p["m"]))

        return df.withColumns({c: back(c) for c in self.params["columns"] if c in df.columns})

    def deviations(self, column: str) -> list[float]:
        return self.params["stats"][column][1]


class VectorSplit(Stage):
    """An array as one array for each part, <column>_<part>, and back by names. params: column, names, parts {part: [names]}.

    The parts must cover all names, each once.
    """

    kind = "vector_split"

    def _indices(self) -> dict[str, list[int]]:
        names, parts = self.params["names"], self.params["parts"]
        given = [n for part in parts.values() for n in part]
        twice = sorted({n for n in given if given.count(n) > 1})
        if twice:
            raise ValueError(f"{self.name}: in two parts: {twice}")
        if set(given) != set(names):
            raise ValueError(f"{self.name}: in no part: {sorted(set(names) - set(given))}; unknown: {sorted(set(given) - set(names))}")
        return {part: [names.index(n) for n in members] for part, members in parts.items()}

    def fit(self, df: DataFrame) -> VectorSplit:
        self._indices()
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        c = self.params["column"]
        return df.withColumns({f"{c}_{part}": F.when(F.col(c).isNotNull(), F.array(*[F.get(F.col(c), F.lit(i)) for i in at])) for part, at in self._indices().items()}).drop(c)

    def invert(self, df: DataFrame) -> DataFrame:
        c, found = self.params["column"], {}
        for part, at in self._indices().items():
            found |= {i: F.get(F.col(f"{c}_{part}"), F.lit(k)) for k, i in enumerate(at)}
        return df.withColumn(c, F.array(*[found[i] for i in sorted(found)])).drop(*[f"{c}_{part}" for part in self.params["parts"]])


class VectorBins(Stage):
    """An array as the numbers of its values' bins, <column>_bins, and back as the bins' means.

    params: column, bins, outlier, and widths: the least width of each feature's bins (in units of the column, so that a z-scored
    one takes widths / deviation), or edges to be used as they are; learned for all features together: edges and means of each.
    """

    kind = "vector_bins"

    def fit(self, df: DataFrame) -> VectorBins:
        p = self.params
        if "means" in p:
            return self
        edges = p.get("edges") or binning.joint_edges(df, p["column"], p["bins"], p.get("widths"), p.get("outlier", 0.0))
        return VectorBins(self.name, **{**p, "edges": edges}, means=binning.joint_means(df, p["column"], edges))

    def apply(self, df: DataFrame) -> DataFrame:
        c = self.params["column"]
        edges = F.array(*[doubles(e) for e in self.params["edges"]])
        return df.withColumn(f"{c}_bins", F.zip_with(c, edges, lambda x, e: binning.bin_of(x, e))).drop(c)

    def invert(self, df: DataFrame) -> DataFrame:
        c = self.params["column"]
        means = F.array(*[doubles(m) for m in self.params["means"]])
        return df.withColumn(c, F.zip_with(f"{c}_bins", means, lambda b, m: F.get(m, b))).drop(f"{c}_bins")
