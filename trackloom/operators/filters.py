"""Predicates and row selections on tracks: all pushed down or joined as semi and anti joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_mask(categories: list[str], value: dict[str, Column]) -> Column:
    """All of ``name`` (is 1), ``name==v``; male is female negated. value: the column of each known category."""
    out = F.lit(True)
    for item in categories:
        m = re.fullmatch(r"\s*(\w+)\s*(?:==\s*(-?\d+)\s*)?", item)
        if not m:
            raise ValueError(f"not a category predicate: {item!r}")
        name, v = m[1], int(m[2] or 1)
        if name == "male" and "male" not in value:
            name, v = "female", 1 - v
        out = out & (value[name] == v)
    return F.coalesce(out, F.lit(False))


def with_category_mask(df: DataFrame, mask: str, categories: list[str], value: dict[str, Column]) -> DataFrame:
    """The mask column (isdata or the output mask) narrowed by predicates."""
    return df.withColumn(mask, F.col(mask) & category_mask(categories, value))


def condense(df: DataFrame, key: str, valid: Column) -> DataFrame:
    """Rows of the keys (videos) that have a valid row at all."""
    return df.join(df.where(valid).select(key).distinct(), key, "left_semi")


def real_agents(df: DataFrame, agent: str, x: str) -> DataFrame:
    """Agents with any value."""
    return df.groupBy(agent).agg(F.bool_or(F.col(x).isNotNull()).alias("_any")).where("_any").select(agent)


def drop_incomplete(df: DataFrame, sizes: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """isdata narrowed to individuals all of whose sizes are known."""
    bad = sizes.where(" or ".join(f"{c} is null" for c in columns)).select(F.col(id).alias("_bad"))
    return df.join(F.broadcast(bad), F.col(id) == F.col("_bad"), "left").withColumn("isdata", F.col("isdata") & F.col("_bad").isNull()).drop("_bad")


def first_rows_per_key(df: DataFrame, key: str, order: list[str], n: int, max_keys: int | None = None) -> DataFrame:
    """The first n rows of each of the first keys: a feature for trying things out."""
    out = df
    if max_keys is not None:
        first = df.select(key).distinct().orderBy(key).limit(max_keys)
        out = df.join(F.broadcast(first), key, "left_semi")
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def time_slices(df: DataFrame, slices: DataFrame, agent: str = "agent", t: str = "t") -> DataFrame:
    """Rows of each (agent, start, duration) slice, with the slice's columns."""
    s = slices.withColumnRenamed(agent, "_agent")
    return df.join(s, (F.col(agent) == F.col("_agent")) & (F.col(t) >= F.col("start")) & (F.col(t) < F.col("start") + F.col("duration"))).drop("_agent")


def rows_by_key(df: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose key is listed, or is not."""
    return df.join(keys.select(*on).distinct(), on, "left_semi" if keep else "left_anti")


def labelled_sequences(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of sequences with any label."""
    good = df.groupBy(key).agg(F.count(label).alias("n")).where("n > 0").select(key)
    return df.join(good, key, "left_semi")


def every_kth(df: DataFrame, t: str, k: int) -> DataFrame:
    return df.where(F.col(t) % k == 0)


def smallest_without(df: DataFrame, absent: Column, size: str) -> DataFrame:
    """Rows where something is absent and whose size is the least of those."""
    rows = df.where(absent)
    least = rows.agg(F.min(size).alias("_least"))
    return rows.join(F.broadcast(least), F.col(size) == F.col("_least")).drop("_least")


def filter_counts(df: DataFrame, mask: Column, id: str) -> DataFrame:
    """Valid rows and individuals before and after a filter."""
    return df.agg(F.count("*").alias("rows"), F.count_if(mask).alias("valid_rows"), F.countDistinct(id).alias("ids"), F.countDistinct(F.when(mask, F.col(id))).alias("valid_ids"))


def random_rows(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of their key: without replacement, the same for any partitioning."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
