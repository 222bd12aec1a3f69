"""Exact percentiles of many keys at once, by refining histograms.

A percentile needs two order statistics. One pass counts each key's values and their range; further passes split only the cells that
hold a wanted rank into ``CELLS`` finer ones, until a cell holds so few values that they fit a task, or one value alone. What comes to
the driver in a pass is at most CELLS rows for each cell that is split, so neither tasks nor driver see more for longer tables, and
many copies of one value are no group of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a pass splits a cell into, and values that may be sorted in one task.
CELLS, HOLD = 256, 100_000


@dataclass
class _Cell:
    """Values of a key between a and b: n of them, ``below`` ones under a; ranks: what is wanted of them."""

    key: object
    a: float
    b: float
    n: int
    below: int
    ranks: list[int] = field(default_factory=list)


def _inside(values: DataFrame, cells: list[_Cell]) -> DataFrame:
    """The values that lie in a cell, with its number. The cells are as few as the wanted ranks."""
    kind = values.schema["key"].dataType.simpleString()
    table = values.sparkSession.createDataFrame([(c.key, i, c.a, c.b) for i, c in enumerate(cells)], f"key {kind}, cell int, a double, b double")
    return values.join(F.broadcast(table), "key").where("x between a and b")


def _split(values: DataFrame, cells: list[_Cell]) -> list[_Cell]:
    part = F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * CELLS), F.lit(CELLS - 1))
    rows = _inside(values, cells).groupBy("cell", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
    out = []
    for i, c in enumerate(cells):
        below = c.below
        for r in sorted((r for r in rows if r["cell"] == i), key=lambda r: r.part):
            ranks = [k for k in c.ranks if below <= k < below + r.n]
            if ranks:
                out.append(_Cell(c.key, r.a, r.b, r.n, below, ranks))
            below += r.n
    return out


def order_statistics(values: DataFrame, wanted: dict[object, list[int]], known: dict[object, tuple[int, float, float]]) -> dict[tuple[object, int], float]:
    """The values at the wanted ranks (from 0) of each key of ``values`` (key, x); ``known``: their number, least and greatest."""
    cells = [_Cell(k, known[k][1], known[k][2], known[k][0], 0, sorted(set(r))) for k, r in wanted.items() if r]
    found: dict[tuple[object, int], float] = {}
    small: list[_Cell] = []
    while cells:
        for c in cells:
            if c.a == c.b:
                found |= {(c.key, r): c.a for r in c.ranks}
        cells = [c for c in cells if c.a != c.b]
        small += [c for c in cells if c.n <= HOLD]
        cells = [c for c in cells if c.n > HOLD]
        cells = _split(values, cells) if cells else []
    if small:
        lists = _inside(values, small).groupBy("cell").agg(F.sort_array(F.collect_list("x")).alias("v"))
        places = F.array(*[F.array(*[F.lit(r - c.below) for r in c.ranks]) for c in small])
        picks = F.transform(F.get(places, F.col("cell")), lambda i: F.get(F.col("v"), i))
        for r in lists.select("cell", picks.alias("picks")).collect():
            c = small[r["cell"]]
            found |= {(c.key, k): v for k, v in zip(c.ranks, r.picks)}
    return found


def exact_percentiles(values: DataFrame, probs: list[float]) -> dict[object, list[float]]:
    """For each key of ``values`` (key, x): the percentiles at ``probs`` (shares) with linear interpolation. NULL and NaN do not count."""
    values = values.select("key", F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x)")
    known = {r.key: (r.n, r.a, r.b) for r in values.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()}
    at = {k: [p * (n - 1) for p in probs] for k, (n, _, _) in known.items()}
    found = order_statistics(values, {k: [r for x in xs for r in (math.floor(x), math.ceil(x))] for k, xs in at.items()}, known)

    def between(k: object, x: float) -> float:
        lo, hi = math.floor(x), math.ceil(x)
        a, b = found[k, lo], found[k, hi]
        # never beyond the two values by rounding: above equal ones, an edge would cut off all their copies
        return a if a == b else min(max((hi - x) * a + (x - lo) * b, a), b)

    return {k: [between(k, x) for x in xs] for k, xs in at.items()}
