"""Sources: tracking tables, their ingest from archives, and the adapters over the given tables.

A track row is (agent, t, x, ...), a keypoint row (agent, t, id, kp array<struct<x, y>>); missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackloom.functions.geometry import not_nan
from trackloom.sources import archives

GAP_SECONDS = 12 * 3600
N_POINTS = 19


def events_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks of their users: t counts a user's events, a gap of over 12 hours starts a new sequence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return e.select(
        F.col("user_id").alias("agent"), (F.row_number().over(w) - 1).cast("long").alias("t"), not_nan(F.col("value")).alias("x"), "ts",
        F.col("event_type").alias("category"), (F.col("event_type") != "error").alias("isdata"), F.coalesce(gap > GAP_SECONDS * 1_000_000, F.lit(True)).alias("isstart"),
    )


def lineitem_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, x): a supplier's line items in the order of their shipping dates."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return li.select(F.col("l_suppkey").alias("seq"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_extendedprice").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("quantity"))


def point(values: Column, i: int) -> Column:
    return F.struct((F.get(values, F.lit(2 * i)).cast("double") * 100).alias("x"), (F.get(values, F.lit(2 * i + 1)).cast("double") * 100).alias("y"))


def embedding_keypoints(spark: SparkSession, sf_dir: str, agents: int = 5) -> DataFrame:
    """Embeddings as keypoints of five agents: (agent, t, id, kp), 19 points from the first 38 numbers."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return e.select((F.col("vec_id") % agents).cast("int").alias("agent"), F.floor(F.col("vec_id") / agents).alias("t"), (F.col("vec_id") % agents).cast("int").alias("id"), F.array(*[point(F.col("embedding"), i) for i in range(N_POINTS)]).alias("kp"))


def unpivot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, category, value) of the label table."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").unpivot("doc_id", ["quality", "toxic"], "category", "value")


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tracking archives (.npz) as long rows, one partition per archive; with ``columns``, only the members that they need are unpacked."""
    spark.dataSource.register(archives.TrackArchives)
    reader = spark.read.format("track_archives")
    if columns:
        kinds = {f.name: f for f in StructType.fromDDL(archives.SCHEMA).fields}
        reader = reader.schema(StructType([kinds[c] for c in columns]))
    return reader.load(path)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Parquet by video, so that later reads can leave videos out."""
    tracks.write.mode("overwrite").partitionBy("videoidx").parquet(path)


def load_tracks(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """Written tracks, or just the named columns of them."""
    tracks = spark.read.parquet(path)
    return tracks.select(*features) if features else tracks


def concat_trials(trials: list[DataFrame], keys: tuple[str, str] = ("session", "trial")) -> DataFrame:
    """Trials as one table, with a fresh agent number for each (session, trial)."""
    out = trials[0]
    for t in trials[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    # the numbers come from the distinct keys, so that no window sees all rows
    ids = out.select(*keys).distinct().withColumn("agent", F.dense_rank().over(Window.orderBy(*keys)) - 1)
    return out.drop("agent").join(ids, list(keys))


def unmatched_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that just one of two tables has: (key, side)."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))
