"""Composable stages: fit, apply, invert, and a frame that remembers which stages made it.

A stage holds plain parameters and makes a DataFrame of a DataFrame. Fits run one aggregation; what they learn is a dictionary
that goes to JSON and back, so that training parameters can be applied to other data, later or elsewhere.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import odd_power, odd_root, unzscore, zscore
from trackloom.operators import binning, motion, stats

_KINDS: dict[str, type[Stage]] = {}


class Stage:
    """A named operation on columns. Subclasses set ``kind`` and are found by it when a pipeline is read back."""

    kind = "stage"

    def __init_subclass__(cls) -> None:
        _KINDS[cls.kind] = cls

    def __init__(self, name: str | None = None, **params):
        self.name, self.params = name or self.kind, params

    def fit(self, df: DataFrame) -> Stage:
        """The stage with what it learns from ``df``; already learned parameters stay."""
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def invert(self, df: DataFrame) -> DataFrame:
        raise TypeError(f"{self.name} has no inverse")

    def to_dict(self) -> dict:
        return {"kind": self.kind, "name": self.name, "params": self.params}

    @staticmethod
    def from_dict(d: dict) -> Stage:
        if d["kind"] not in _KINDS:
            raise ValueError(f"unknown stage {d['kind']!r}")
        return _KINDS[d["kind"]](d["name"], **d["params"])


class Identity(Stage):
    kind = "identity"

    def apply(self, df: DataFrame) -> DataFrame:
        return df

    invert = apply


class Select(Stage):
    """Keep columns; what is gone cannot come back. params: columns."""

    kind = "select"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.params["columns"])


class ZScore(Stage):
    """params: columns; learned: stats {column: [mean, sd]}."""

    kind = "zscore"

    def fit(self, df: DataFrame) -> ZScore:
        if "stats" in self.params:
            return self
        rows = stats.moments(df, self.params["columns"]).collect()  # one row per column
        return ZScore(self.name, **self.params, stats={r.feature: [r.mean, r.sd] for r in rows})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: zscore(c, *self.params["stats"][c]) for c in self.params["columns"]})

    def invert(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: unzscore(c, *self.params["stats"][c]) for c in self.params["columns"]})


class OddRoot(Stage):
    """params: columns, root."""

    kind = "odd_root"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: odd_root(c, self.params.get("root", 3)) for c in self.params["columns"]})

    def invert(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: odd_power(c, self.params.get("root", 3)) for c in self.params["columns"]})


class Roll(Stage):
    """params: column, dt, keys, t, circular."""

    kind = "roll"

    def _by(self, df: DataFrame, dt: int) -> DataFrame:
        p = self.params
        out = motion.roll(df, p["column"], dt, p["keys"], p["t"], p.get("circular", False), "_rolled")
        return out.withColumn(p["column"], F.col("_rolled")).drop("_rolled")

    def apply(self, df: DataFrame) -> DataFrame:
        return self._by(df, self.params["dt"])

    def invert(self, df: DataFrame) -> DataFrame:
        return self._by(df, -self.params["dt"])


class Steps(Stage):
    """One-step changes of a column, with the first value beside them, and back. params: column, keys, t, angle."""

    kind = "steps"

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.params
        return motion.relative_velocity(df, p["column"], p["keys"], p["t"], [1], p.get("angle", False)).withColumnRenamed(f"{p['column']}_d1", f"{p['column']}_step")

    def invert(self, df: DataFrame) -> DataFrame:
        p = self.params
        out = motion.integrate_relative(df, p["column"], f"{p['column']}_step", p["keys"], p["t"], p.get("angle", False), "_back")
        return out.withColumn(p["column"], F.col("_back")).drop("_back", f"{p['column']}_step")


class Discretize(Stage):
    """A column as its bin's number and, back, the bin's mean. params: column, bins, outlier; learned: edges, means."""

    kind = "discretize"

    def fit(self, df: DataFrame) -> Discretize:
        if "edges" in self.params:
            return self
        edges = binning.quantile_edges(df, self.params["column"], self.params["bins"], self.params.get("outlier", 0.0))
        if edges and edges[0] == edges[-1]:
            edges = edges[:2]  # one value alone has one bin
        rows = binning.bin_statistics(df, self.params["column"], edges).collect()  # one row per bin
        return Discretize(self.name, **self.params, edges=edges, means=[r["mean"] for r in sorted(rows, key=lambda r: r.bin)])

    def apply(self, df: DataFrame) -> DataFrame:
        c = self.params["column"]
        return df.withColumn(f"{c}_bin", binning.bin_of(c, self.params["edges"])).drop(c)

    def invert(self, df: DataFrame) -> DataFrame:
        c = self.params["column"]
        means = F.array(*[F.lit(float(m)) for m in self.params["means"]])
        return df.withColumn(c, F.get(means, F.col(f"{c}_bin"))).drop(f"{c}_bin")


class Fusion(Stage):
    """Different stages on groups of columns that do not overlap. params: parts [[columns, stage as dict], ...]."""

    kind = "fusion"

    def _parts(self) -> list[tuple[list[str], Stage]]:
        seen: set[str] = set()
        for columns, _ in self.params["parts"]:
            if seen & set(columns):
                raise ValueError(f"columns in two groups: {sorted(seen & set(columns))}")
            seen |= set(columns)
        return [(columns, Stage.from_dict(d)) for columns, d in self.params["parts"]]

    def fit(self, df: DataFrame) -> Fusion:
        return Fusion(self.name, parts=[[columns, stage.fit(df).to_dict()] for columns, stage in self._parts()])

    def apply(self, df: DataFrame) -> DataFrame:
        for _, stage in self._parts():
            df = stage.apply(df)
        return df

    def invert(self, df: DataFrame) -> DataFrame:
        for _, stage in reversed(self._parts()):
            df = stage.invert(df)
        return df


@dataclass(frozen=True)
class FeatureFrame:
    """A DataFrame and the fitted stages that made it, in order."""

    df: DataFrame
    lineage: tuple[Stage, ...] = field(default=())

    def then(self, stage: Stage) -> FeatureFrame:
        fitted = stage.fit(self.df)
        return FeatureFrame(fitted.apply(self.df), (*self.lineage, fitted))

    def find(self, name: str) -> Stage | None:
        """A stage by its name, within fusions too."""
        for s in self.lineage:
            if s.name == name:
                return s
            if isinstance(s, Fusion):
                for _, inner in s._parts():
                    if inner.name == name:
                        return inner
        return None

    def before(self, name: str) -> list[Stage]:
        names = [s.name for s in self.lineage]
        return list(self.lineage[: names.index(name)])

    def after(self, name: str) -> list[Stage]:
        names = [s.name for s in self.lineage]
        return list(self.lineage[names.index(name) + 1 :])

    def invert_to(self, name: str | None = None) -> FeatureFrame:
        """Undo the stages after the named one (all of them without a name), the last first."""
        stop = 0 if name is None else [s.name for s in self.lineage].index(name) + 1
        df = self.df
        for s in reversed(self.lineage[stop:]):
            df = s.invert(df)
        return replace(self, df=df, lineage=self.lineage[:stop])

    def to_json(self) -> str:
        return json.dumps([s.to_dict() for s in self.lineage])

    def apply_to(self, df: DataFrame, done: int = 0) -> FeatureFrame:
        """The fitted stages on other data; ``done`` of them have been applied to it before."""
        return replay(df, list(self.lineage), done)


def replay(df: DataFrame, stages: list[Stage] | str, done: int = 0) -> FeatureFrame:
    """Fitted stages, or their JSON, applied to a table without learning anything."""
    if isinstance(stages, str):
        stages = [Stage.from_dict(d) for d in json.loads(stages)]
    for s in stages[done:]:
        df = s.apply(df)
    return FeatureFrame(df, tuple(stages))
