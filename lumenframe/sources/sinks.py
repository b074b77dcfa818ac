"""Sinks: prediction files, archives, and incremental outputs that skip what exists."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted_for_csv


def task_rows(predictions: DataFrame, task: str) -> DataFrame:
    """The columns of a task's CSV: events' frames joined by semicolons, an answer only where it is asked for."""
    rows = predictions.where(F.col("task") == task)
    frame = F.when(F.lit(task == "task3"), F.array_join("frame_ids", ";")).otherwise(F.col("frame_id"))
    return rows.select("query_id", "rank", "video_id", frame.alias("frame_id"), *(["answer"] if task == "task2" else []))


def write_task_csv(predictions: DataFrame, path: str) -> None:
    for task in ("task1", "task2", "task3"):
        task_rows(predictions, task).sort("query_id", "rank").write.mode("overwrite").option("header", "true").csv(f"{path}/{task}")


def prediction_json(predictions: DataFrame) -> DataFrame:
    """``task, query_id, json``: a query's predictions in order."""
    row = F.struct("rank", "video_id", "frame_id", "answer", "frame_ids")
    return predictions.groupBy("task", "query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("rank"))).alias("json"))


def _plain(number: Column) -> Column:
    """Digits as a whole number, other ids as they are."""
    return F.when(number.rlike(r"^\d+$"), number.cast("bigint").cast("string")).otherwise(number)


def submission_lines(predictions: DataFrame) -> DataFrame:
    """``query_id, rank, line`` of headerless per-query files, fields parted by comma and space."""
    frames = F.array_join(F.transform("frame_ids", _plain), ", ")
    line = F.when(F.col("task") == "task3", F.concat_ws(", ", "video_id", frames)).when(F.col("task") == "task2", F.concat_ws(", ", "video_id", _plain(F.col("frame_id")), quoted_for_csv(F.col("answer"))))
    return predictions.select("query_id", "rank", line.otherwise(F.concat_ws(", ", "video_id", _plain(F.col("frame_id")))).alias("line"))


def write_submission(predictions: DataFrame, path: str) -> None:
    """A folder a query; its lines in order."""
    lines = submission_lines(predictions).repartition("query_id").sortWithinPartitions("query_id", "rank")
    lines.select("query_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("query_id").text(path)


def zip_folder(folder: str, archive: str) -> None:
    """A written folder's files as ``submission/<name>``, on the driver; predictions are as few as queries."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(Path(folder).rglob("part-*")):
            query = f.parent.name.partition("=")[2] or f.parent.name
            out.write(f, f"submission/{query}.csv")


def frame_texts_json(texts: DataFrame) -> DataFrame:
    """``video_id, json`` of ``texts(video_id, frame_id, text)``: an object of frames, in their order, with characters as they are; of two texts of a frame the smaller counts."""
    rows = texts.groupBy("video_id", "frame_id").agg(F.min("text").alias("text"))
    in_object = lambda x: F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("x")))
    quoted = lambda x: F.substring(in_object(x), F.lit(6), F.length(in_object(x)) - 6)
    member = F.concat(quoted(F.col("frame_id").cast("string")), F.lit(":"), quoted(F.col("text")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", member.alias("m")))), lambda s: s["m"])
    return rows.groupBy("video_id").agg(F.concat(F.lit("{"), F.array_join(joined, ","), F.lit("}")).alias("json"))


def write_frame_texts(texts: DataFrame, path: str, spark: SparkSession) -> None:
    """A JSON file a video, in a folder of its own; videos that have one are left as they are."""
    try:
        done = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"video_id=([^/]+)/", 1).alias("video_id")).distinct()
        done.schema  # noqa: B018  asks for the folder
        texts = texts.join(done, texts["video_id"].cast("string") == done["video_id"], "left_anti")
    except Exception as e:  # the folder's absence has no class of its own
        if "PATH_NOT_FOUND" not in str(e):
            raise
    frame_texts_json(texts).select("video_id", F.col("json").alias("value")).write.mode("append").partitionBy("video_id").text(path)


def not_yet_written(rows: DataFrame, path: str, spark: SparkSession, key: str = "video_id") -> DataFrame:
    """Rows whose key is not in the Parquet table at ``path`` (all of them if there is none)."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
        done.schema  # noqa: B018  asks for the table
    except Exception as e:  # the table's absence has no class of its own
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows
    return rows.join(done, key, "left_anti")


def formatted_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[F.format_number(c, 4).alias(c) for c in metrics.columns])
