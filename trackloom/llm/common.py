"""Helpers that the document operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's switch for deleting a query's shuffle files as soon as it is over, not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(col, _UPPER, _UPPER.lower())


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    In local mode, where one machine is all there is, a temporary folder serves if neither is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: whatever follows survives lost executors and does not recompute what came before. Nor does anything read the
    shuffle files of the write again, so they go with it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/trackloom-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing that is still to run reads it."""
    if df is not None:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


_Batch = TypeVar("_Batch")
#: What operators remember in a Python worker from task to task, by operator.
_REMEMBERED: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """A dictionary that a Python worker keeps for ``owner`` until another operator has a task there (see ``tended``)."""
    return _REMEMBERED.setdefault(owner, {})


def give_back() -> None:
    """Return to the system what Arrow's and C's allocators have free: a worker waits beside the executor for the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tended(batches: Iterator[_Batch], owner: str) -> Iterator[_Batch]:
    """``batches`` of a task of ``owner``. Workers serve one stage after another: what other operators remembered there goes, and
    memory is given back after each batch."""
    for name, kept in _REMEMBERED.items():
        if name != owner:
            kept.clear()
    for b in batches:
        yield b
        del b
        give_back()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 17) -> DataFrame:
    """Whole texts of at most ``per_class`` labelled documents of each class: columns text, label.

    ``docs`` has doc_id and text and holds only rows that may be learned from. The choice is by a hash of the id, so reruns
    and other partitionings agree. Rows without label or id are never chosen; of several labels of one id the largest counts, of several texts the least.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    # ids only: the texts of a few thousand documents are read in a second pass
    ids = docs.select("doc_id").join(known, "doc_id").distinct()
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = None
    for value in (0, 1):
        part = ids.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids: a size bound that does not depend on the input
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), order.alias("k")).groupBy("k").agg(F.min(F.struct("text", "label")).alias("r")).orderBy("k").select("r.text", "r.label")


def class_counts(docs: DataFrame, labels: DataFrame, label: str) -> tuple[int, int]:
    """Number of labelled rows of class 0 and 1 among ``docs``: the prior."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    row = docs.select("doc_id").join(known, "doc_id").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    return row.n0, row.n1
