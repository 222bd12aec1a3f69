"""Mixing sources to target weights.

Tokens are summed per source, each source's repetition rate is its target over its size, and every document goes out
floor(rate) times plus once more with a probability equal to the fraction, drawn from a hash of its id: reruns, retries and
other partitionings agree.

Sources are ordered by code point, null last, and weigh 5, 2, 1, 5, 2, 1, ... A target stops at ``max_repeat`` times the
source's size; what it leaves is shared again among the others by weight until no target is above its stop.

Defined results: a null text has size 0; a null source is a source of its own; a null id draws like an empty one; repeated
rows are mixed each for itself with equal draws; a source without words has target 0 and its documents are taken 0 times; an
empty table gives an empty result; other columns pass through. In the plan, columns named like the added ones are replaced; the
mixed table keeps all columns of the caller as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Sources at most that are broadcast; with more, the join is left to shuffle.
BROADCAST_SOURCES = 10_000


def doc_size(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: one row per source.

    The reshared targets have a closed form: with the sources in order of cap / weight, the capped ones are a prefix, and the
    rest gets weight * (total - their caps) / (total weight - their weights).
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source, not over documents
    every = Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_repeat))
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    shared = ranked.withColumn("left_over", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level rises while capped sources leave and would fall again after them: the highest one is right
    level = F.max(F.try_divide(F.col("left_over"), F.col("weight_left"))).over(every)
    return shared.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", seed: int = 11, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with size, source_size, target and copies: how often each document is taken."""
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", doc_size(F.col(text)))
    # one row per source; written, since its number of rows decides how it is joined
    targets = materialize(source_targets(sized.select("source", "size"), weights, max_repeat), "targets")
    return _with_copies(sized, targets, seed, max_repeat)


def _with_copies(sized: DataFrame, targets: DataFrame, seed: int, max_repeat: int) -> DataFrame:
    few = targets.count() <= BROADCAST_SOURCES
    right = (F.broadcast(targets) if few else targets).alias("t")
    joined = sized.alias("d").join(right, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(max_repeat)))
    # 48 bits of an md5 as a number in [0, 1)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return joined.withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix_sources(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed table: ``docs`` with every document as often as the plan takes it; the columns of ``docs``."""
    # the caller's columns travel in one, so that none of them meets a name of the plan
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    plan = mix_plan(docs.select("doc_id", "source", F.col(text).alias("text"), row), **options).where(F.col("copies") > 0)
    return plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
