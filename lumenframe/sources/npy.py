"""Vectors of .npy matrices as a Spark data source: a file is read by many tasks, each a range of its rows.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("paths", json_list_of_files).load()

Which file counts for a video is settled from names alone; planning reads headers, tasks read only
the bytes of their rows. Files are opened through Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import vector_files

#: Bytes of vectors of a partition, and of a batch; bytes that hold any header.
SPLIT, BATCH, HEADER = 64 << 20, 4 << 20, 1 << 16


def _opened(path: str) -> pa.NativeFile:
    system, inside = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(inside)


def header(path: str) -> tuple[int, int, str, int] | None:
    """Rows, dimensions, type and first byte of a matrix; null for what isn't one of numbers in row order."""
    try:
        with _opened(path) as f:
            head = io.BytesIO(f.read(HEADER))
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(head)]
        shape, by_columns, kind = read(head)
    except (OSError, ValueError, KeyError):
        return None
    if len(shape) != 2 or by_columns or kind.kind not in "fiu":
        return None
    return shape[0], shape[1], kind.str, head.tell()


class Rows(InputPartition):
    def __init__(self, path: str, video: str, begin: int, end: int, dims: int, kind: str, offset: int):
        self.path, self.video, self.begin, self.end, self.dims, self.kind, self.offset = path, video, begin, end, dims, kind, offset


class NpyReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, str]], split: int):
        self.files, self.split = files, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for video, path in self.files:
            if (told := header(path)) is not None:
                rows, dims, kind, offset = told
                step = max(1, self.split // max(1, dims * np.dtype(kind).itemsize))
                out += [Rows(path, video, a, min(a + step, rows), dims, kind, offset) for a in range(0, rows, step)]
        return out or [Rows("", "", 0, 0, 1, "<f4", 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.begin:
            return
        width = partition.dims * np.dtype(partition.kind).itemsize
        step = max(1, BATCH // max(1, width))
        with _opened(partition.path) as f:
            f.seek(partition.offset + partition.begin * width)
            for a in range(partition.begin, partition.end, step):
                n = min(step, partition.end - a)
                raw = f.read(n * width)
                n = len(raw) // width if width else n  # a file that ends early gives what it has
                x = np.frombuffer(raw, partition.kind, n * partition.dims).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.dims), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([partition.video] * n), pa.array(np.arange(a, a + n, dtype=np.int32)), vectors], ["video_id", "frame_idx", "embedding"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "video_id string, frame_idx int, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader([tuple(f) for f in json.loads(self.options["paths"])], int(self.options.get("split", SPLIT)))


def scan_vectors(spark: SparkSession, root: str, without: tuple[str, ...] = (), split: int = SPLIT) -> DataFrame:
    """``video_id, frame_idx, embedding`` from the .npy matrices under ``root``; of two files of one name the later path counts."""
    spark.dataSource.register(NpySource)
    files = [(r.video_id, r.path) for r in vector_files(spark, root, without).orderBy("video_id").collect()]  # names, one a video
    return spark.read.format("npy").option("paths", json.dumps(files)).option("split", str(split)).load()
