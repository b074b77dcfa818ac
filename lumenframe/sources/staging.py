"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, on a single machine only, a temporary folder for the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: for what a plan uses more than once and is dear to make."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Rows cross to Python in batches of bounded size, however wide they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shipped(df: DataFrame, name: str) -> tuple[str, ...]:
    """``df`` written to the shared folder, and its files fetched by every executor; their names, for ``SparkFiles``."""
    files = sorted(staged(df, name).inputFiles())
    for f in files:
        df.sparkSession.sparkContext.addFile(f)
    return tuple(f.rpartition("/")[2] for f in files)
