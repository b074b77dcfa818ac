"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: What a session may set to cross in other batches than of 16 MB.
BATCH_BYTES = "lumenframe.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset (tests, a single machine) a
    temporary folder is made and set for the session's context.
    """
    bounded_batches(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    folder = configured or tempfile.mkdtemp(prefix="lumenframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return configured or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def bounded_batches(spark: SparkSession) -> None:
    """Rows cross to Python in batches of bounded size, however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get(BATCH_BYTES, "16m"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: for what is read more than once, and is too wide to recompute."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(df: DataFrame, name: str) -> tuple[str, ...]:
    """Write ``df`` to the shared folder and have every executor fetch its Parquet files; their names, for ``SparkFiles``."""
    return ship_written(written(df, name))


def ship_written(df: DataFrame) -> tuple[str, ...]:
    """The same for what ``written`` has returned."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    return tuple(f.rpartition("/")[2] for f in files)


def freed(run: Run) -> Run:
    """``run`` for a worker that gives its free memory back to the system at the task's end, as workers outlive tasks."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
