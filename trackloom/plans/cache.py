"""Tables that are made once: a cache in a folder, by what made them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans.stages import FeatureFrame, Stage


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def input_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(name, size, time of change) of every file below the paths, in order, in any store that Spark reads."""
    found = []
    for path in paths:
        p, system = _path(spark, path)
        if system.getFileStatus(p).isDirectory():
            files = system.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        else:
            f = system.getFileStatus(p)
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def cache_key(spark: SparkSession, stages: FeatureFrame | list[Stage] | str, inputs: list[str], **options) -> str:
    """A hash of the stages, of options, and of the input files' names, sizes and times."""
    made = stages if isinstance(stages, str) else json.dumps([s.to_dict() for s in (stages.lineage if isinstance(stages, FeatureFrame) else stages)], sort_keys=True)
    return hashlib.sha256(json.dumps([made, options, input_files(spark, inputs)], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``key`` in ``folder``; if it is not there, ``make`` makes it.

    It is written aside and renamed when whole, so a broken write is never read; of two that write at once, one stays.
    """
    p, system = _path(spark, f"{folder}/{key}")
    if not system.exists(_path(spark, f"{folder}/{key}/_SUCCESS")[0]):
        aside = f"{folder}/.{key}-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        q, _ = _path(spark, aside)
        # a folder without its mark is what an older, broken write left
        if system.exists(p) and not system.exists(_path(spark, f"{folder}/{key}/_SUCCESS")[0]):
            system.delete(p, True)
        if system.exists(p) or not system.rename(q, p):
            system.delete(q, True)
    return spark.read.parquet(f"{folder}/{key}")
