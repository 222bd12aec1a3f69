"""Dataset assembly: tracks to training chunks, lazily planned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import motion, sequences
from trackloom.plans.stages import Discretize, FeatureFrame, ZScore


def build_dataset(tracks: DataFrame, feature: str, valid: Column, length: int, bins: int = 10, fitted: FeatureFrame | None = None, agent: str = "agent", t: str = "t") -> tuple[DataFrame, FeatureFrame]:
    """(chunks, frame): sessions, steps, the last step as input, binned labels, z-scored inputs, and chunks of ``length`` rows.

    ``fitted``: the frame of the training data, whose parameters are used instead of learning new ones.
    """
    rows = sequences.session_rows(tracks, valid, agent, t)
    steps = motion.relative_velocity(rows, feature, [agent, "session"], t, [1]).withColumnRenamed(f"{feature}_d1", "label")
    steps = motion.aligned_inputs(steps, "label", [agent, "session"], t, "input").where(F.col("label").isNotNull())
    steps = steps.withColumn("raw_label", F.col("label"))
    # bins are those of the labels as they are: z-scores keep the order, but by the fit's last bits some neighbours become equal
    frame = fitted.apply_to(steps) if fitted else FeatureFrame(steps).then(Discretize(column="label", bins=bins)).then(ZScore(columns=[feature, "input"]))
    # chunks count from the first row that has all columns
    again = frame.df.withColumn("session", F.col("session") + 1)
    return sequences.chunk_examples(again, [feature, "input", "label_bin", "raw_label"], length, agent=agent, t=t), frame


def map_chunks(chunks: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function over batches of chunks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b)

    return chunks.mapInPandas(each, schema)


def score_windows(windows: DataFrame, keys: list[str], values: str, score: Callable[[pd.Series], pd.Series], kind: str = "array<double>") -> DataFrame:
    """A user's scorer over the values of every window: (keys, scored)."""

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield score(s)

    return windows.select(*keys, scored(values).alias("scored"))


def batches(examples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The examples with a batch number, by a hash of the keys: about ``size`` of them each."""
    n = max(1, -(-examples.count() // size))
    return examples.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(n)))


def collated(examples: DataFrame, keys: list[str], size: int, seed: int = 0) -> DataFrame:
    """(batch, rows): batches of ``size`` whole examples in a hashed order, each one row with an array of structs; the last may be smaller.

    Places in the order are running offsets, so no task sees all examples; a batch holds ``size`` of them at most.
    """
    placed = sequences.running_offsets(examples.withColumn("_h", F.xxhash64(*keys, F.lit(seed))), ["_h", *keys], name="_at")
    one = F.struct("_at", F.struct(*examples.columns).alias("example"))
    rows = placed.groupBy(F.floor(F.col("_at") / size).alias("batch")).agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    return rows.select("batch", F.transform("_rows", lambda r: r["example"]).alias("rows"))
