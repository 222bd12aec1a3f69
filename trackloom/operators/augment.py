"""Augmentation, masking and noise. Draws come from hashes of keys and a seed, so partitioning does not change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.pose import flip
from trackloom.operators.stats import hash_draw, noisy


def uniform(keys: list[str], seed: int, salt: str = "") -> Column:
    return hash_draw(keys, seed, salt)


def with_mirrored(df: DataFrame, ids: list[str], kp: str = "kp", centre: float = 0.0) -> DataFrame:
    """The rows and their mirror images, whose ids go on from the greatest ones."""
    top = df.agg(*[F.max(c).alias(f"_{c}") for c in ids])
    copy = flip(df, kp, centre).join(F.broadcast(top))
    copy = copy.withColumns({c: (F.col(c) + F.col(f"_{c}") + 1).cast(dict(df.dtypes)[c]) for c in ids}).drop(*[f"_{c}" for c in ids])
    return df.withColumn("mirrored", F.lit(False)).unionByName(copy.withColumn("mirrored", F.lit(True)))


def block_mask(df: DataFrame, chunk: list[str], pos: str, length: int, longest: int, seed: int = 0) -> DataFrame:
    """mask: one run of up to ``longest`` rows of each chunk of ``length``, its place and length drawn per chunk."""
    n = (F.floor(uniform(chunk, seed, "n") * longest) + 1).cast("int")
    first = F.floor(uniform(chunk, seed, "at") * (F.lit(length) - n + 1)).cast("int")
    return df.withColumn("mask", (F.col(pos) >= first) & (F.col(pos) < first + n))


def row_mask(df: DataFrame, chunk: list[str], pos: str, share: float, seed: int = 0) -> DataFrame:
    """mask: each row by chance, and at least one of each chunk: the one with the least draw."""
    u = uniform([*chunk, pos], seed)
    least = F.min("_u").over(Window.partitionBy(*chunk))
    return df.withColumn("_u", u).withColumn("mask", (F.col("_u") < share) | (F.col("_u") == least)).drop("_u")


def last_mask(df: DataFrame, pos: str, length: int) -> DataFrame:
    return df.withColumn("mask", F.col(pos) == length - 1)


def apply_mask(df: DataFrame, inputs: list[str], mask: str = "mask") -> DataFrame:
    """Inputs to 0 where masked, and the mask as a number beside them."""
    return df.withColumns({c: F.when(F.col(mask), F.lit(0.0)).otherwise(F.col(c)) for c in inputs}).withColumn("mask_flag", F.col(mask).cast("double"))


def compensated_noise(df: DataFrame, inputs: list[str], steps: dict[str, str], sigma: float, share: float, keys: list[str], seed: int = 0) -> DataFrame:
    """Noise on inputs of a random part of the rows; the step of each (input -> step column) takes it back."""
    drawn = noisy(df.withColumns({f"_z{c}": F.lit(0.0) for c in inputs}), [f"_z{c}" for c in inputs], sigma, keys, seed)
    hit = uniform(keys, seed, "row") < share
    out = {c: F.when(hit, F.col(c) + F.col(f"_z{c}")).otherwise(F.col(c)) for c in inputs}
    out |= {s: F.when(hit, F.col(s) - F.col(f"_z{c}")).otherwise(F.col(s)) for c, s in steps.items()}
    return drawn.withColumns(out).drop(*[f"_z{c}" for c in inputs])
