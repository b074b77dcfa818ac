"""Evaluation of ranked predictions against ground truth: R@k, query scores and global means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answers_match

CUTS = (1, 5, 20, 50, 100)


def whole_number(text: Column) -> Column:
    """A frame id as a number; null unless it is digits with an optional sign."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))


def frame_hit(video: Column, frame: Column, wanted_video: Column, start: Column, end: Column) -> Column:
    inside = F.coalesce(whole_number(frame).between(start, end), F.lit(False))
    return (F.coalesce(video == wanted_video, F.lit(False)) & inside).cast("double")


def answer_hit(video: Column, frame: Column, answer: Column, wanted_video: Column, start: Column, end: Column, wanted: Column) -> Column:
    return frame_hit(video, frame, wanted_video, start, end) * answers_match(answer, wanted).cast("double")


def event_hit(video: Column, frames: Column, wanted_video: Column, events: Column) -> Column:
    """Share of ``events(frame_start, frame_end)`` whose frame lies within; 0 if the numbers differ. No events count as one of [0, 0]."""
    none = F.array(F.struct(F.lit(0).alias("frame_start"), F.lit(0).alias("frame_end")))
    pairs = F.transform(events, lambda e: F.struct(e["frame_start"].cast("int").alias("frame_start"), e["frame_end"].cast("int").alias("frame_end")))
    wanted = F.when(F.size(pairs) > 0, pairs).otherwise(none)
    hits = F.aggregate(F.zip_with(frames, wanted, lambda f, e: F.coalesce(whole_number(f).between(e["frame_start"], e["frame_end"]), F.lit(False)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    fits = F.coalesce(video == wanted_video, F.lit(False)) & (F.size(frames) == F.size(wanted))
    return F.when(fits, hits / F.size(wanted)).otherwise(0.0)


def query_metrics(relevances: DataFrame, truth: DataFrame) -> DataFrame:
    """``task, query_id, r1 .. r100, score`` for every query of ``truth(task, query_id)``, zeros where nothing was predicted."""
    best = relevances.groupBy("task", "query_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("relevance")).otherwise(0.0)).alias(f"r{k}") for k in CUTS])
    joined = truth.select("task", "query_id").distinct().join(best, ["task", "query_id"], "left")
    cols = [F.coalesce(f"r{k}", F.lit(0.0)).alias(f"r{k}") for k in CUTS]
    out = joined.select("task", "query_id", *cols)
    return out.withColumn("score", sum((F.col(f"r{k}") for k in CUTS[1:]), F.col("r1")) / len(CUTS))


def global_metrics(by_query: DataFrame) -> DataFrame:
    """One row: the means over all queries of all tasks; zeros without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return by_query.agg(mean("score").alias("final_score"), *[mean(f"r{k}").alias(f"r{k}") for k in CUTS])


def latest_truth(items: DataFrame) -> DataFrame:
    """The last of several items of one id, by ``ord``; a dict's key stands for an unknown id."""
    named = items.withColumn("query_id", F.when((F.col("query_id") == "unknown") & F.col("key").isNotNull(), F.col("key")).otherwise(F.col("query_id")))
    rest = [c for c in named.columns if c not in ("task", "query_id", "ord", "key")]
    return named.groupBy("task", "query_id").agg(F.max_by(F.struct(*rest), "ord").alias("x")).select("task", "query_id", "x.*")
