"""Tracking archives (.npz) as a data source of their own: one partition to an archive, members read only as far as they are asked for.

    spark.dataSource.register(TrackArchives)
    spark.read.format("track_archives").schema("t long, agent int, id int").load("hdfs://store/archives")

An archive has X (points, 2, frames, slots), videoidx, ids, frames, and y with categories. Rows are sparse: a slot without an animal has
none. Ids are shifted to begin at 0. isstart is true where the slot's id or the run of frame numbers changes, isdata for all rows that
there are, useoutputmask for all at first; missing points are NULL. Paths are opened by Arrow's file systems: local folders, hdfs, s3, gs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = (
    "videoidx int, t long, frame long, agent int, id int, isstart boolean, isdata boolean, useoutputmask boolean, kp array<struct<x: double, y: double>>, y map<string, int>"
)
#: Rows of one slot that are made at once.
BLOCK = 4096


@dataclass
class Archive(InputPartition):
    path: str
    file_system: str


def archives_in(path: str) -> list[Archive]:
    """The .npz files of a folder, or the file itself, in order of their names."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    root = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [Archive(f.path, root) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".npz")]


class TrackArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "track_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.wanted, self.path = schema, path

    def partitions(self) -> Sequence[Archive]:
        return archives_in(self.path) or [Archive("", "")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        try:
            yield from self._rows(partition)
        except Exception as e:
            raise ValueError(f"archive {partition.file_system}{partition.path}: {e}") from e

    def _rows(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(partition.file_system + partition.path)[0] if partition.file_system else fs.LocalFileSystem()
        kinds, columns = to_arrow_schema(self.wanted), self.wanted.names
        with system.open_input_file(partition.path) as f, np.load(io.BufferedReader(f) if not f.seekable() else f, allow_pickle=False) as a:
            # a member is unpacked at its first use: what no column needs is not
            ids = a["ids"].astype(np.int64)
            known = ids >= 0
            ids = np.where(known, ids - (ids[known].min() if known.any() else 0), -1)
            frames = a["frames"].ravel().astype(np.int64) if {"frame", "isstart"} & set(columns) else None
            video = a["videoidx"].ravel() if "videoidx" in columns else None
            x = a["X"] if "kp" in columns else None
            y, names = (a["y"], [str(c) for c in a["categories"]]) if "y" in columns and "y" in a else (None, [])
            starts = None
            if "isstart" in columns:
                starts = np.ones(ids.shape, bool)
                starts[1:] = (ids[1:] != ids[:-1]) | (frames[1:] != frames[:-1] + 1)[:, None]
            for slot in range(ids.shape[1]):
                rows = np.flatnonzero(known[:, slot])
                for at in range(0, len(rows), BLOCK):
                    t = rows[at : at + BLOCK]
                    made = {
                        "videoidx": lambda: video[t], "t": lambda: t, "frame": lambda: frames[t], "agent": lambda: np.full(len(t), slot), "id": lambda: ids[t, slot],
                        "isstart": lambda: starts[t, slot], "isdata": lambda: np.ones(len(t), bool), "useoutputmask": lambda: np.ones(len(t), bool),
                        "kp": lambda: _points(x[:, :, t, slot]), "y": lambda: [[(n, int(v)) for n, v in zip(names, row) if v == v] for row in y[:, t, slot].T] if y is not None else [[]] * len(t),
                    }
                    yield pa.RecordBatch.from_arrays([made[c]() if c == "kp" else pa.array(made[c](), kinds.field(c).type) for c in columns], schema=kinds)


def _points(x: np.ndarray) -> pa.Array:
    """(points, 2, rows) as one list of points to a row, NaN as NULL."""
    n, _, rows = x.shape
    flat = [np.ascontiguousarray(x[:, k].T, np.float64).ravel() for k in (0, 1)]
    both = pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=np.isnan(v)) for v in flat], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * rows + 1, n), pa.int32()), both)
