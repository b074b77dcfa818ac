"""Event-sequence alignment: one frame an event, in order, with a least gap, by chained windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import similarity
from .select import frame_ids

#: Fixed value: the gap between events at most.
MOST_GAP = 8


def event_scores(frames: DataFrame, events: DataFrame) -> DataFrame:
    """``query_id, event_idx, video_id, frame_idx, score`` of ``events(query_id, event_idx, embedding)``."""
    scores = similarity(frames, events.withColumnRenamed("event_idx", "prompt_idx"))
    return scores.withColumnRenamed("prompt_idx", "event_idx")


def _wide(scores: DataFrame, n_events: int) -> DataFrame:
    cols = [F.max(F.when(F.col("event_idx") == k, F.col("score"))).alias(f"s{k}") for k in range(n_events)]
    wide = scores.groupBy("query_id", "video_id", "frame_idx").agg(*cols)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "video_id"))
    return wide.withColumn("t", n.cast("int"))


def align(scores: DataFrame, n_events: int) -> DataFrame:
    """``query_id, video_id, path, score`` of ``scores`` for queries that all have ``n_events`` events.

    The best increasing choice of frames with a gap of at least g = min(8, max(1, (T - N) / N));
    on ties the earlier frame. One chain of running maxima; what lies a gap back is chosen among
    the eight gaps. With fewer frames than events: the frames, the last one repeated, and score 0.
    """
    wide = _wide(scores, n_events)
    gap = F.least(F.lit(MOST_GAP), F.greatest(F.lit(1), F.floor((F.col("t") - n_events) / n_events))).cast("int")
    long = wide.where(F.col("t") >= n_events).withColumn("g", gap)
    over = Window.partitionBy("query_id", "video_id").orderBy("frame_idx")
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = lambda total, path: F.struct(F.round(total, 9).alias("o"), (-F.col("frame_idx")).alias("j"), total.alias("sc"), path.alias("path"))
    state = long.withColumn("d", F.max(key(F.col("s0"), F.array("frame_idx"))).over(upto))
    for k in range(1, n_events):
        state = state.withColumn("p", F.coalesce(*[F.when(F.col("g") == g, F.lag("d", g).over(over)) for g in range(1, MOST_GAP + 1)]))
        step = F.when(F.col("p").isNotNull(), key(F.col("p.sc") + F.col(f"s{k}"), F.concat("p.path", F.array("frame_idx"))))
        state = state.withColumn("d", F.max(step).over(upto))
    last = state.groupBy("query_id", "video_id").agg(F.max_by("d", "frame_idx").alias("d"))
    found = last.select("query_id", "video_id", F.col("d.path").alias("path"), F.col("d.sc").alias("score"))
    few = wide.where(F.col("t") < n_events).groupBy("query_id", "video_id").agg(F.max("t").alias("t"))
    path = F.transform(F.sequence(F.lit(0), F.lit(n_events - 1)), lambda i: F.least(i, F.col("t") - 1))
    return found.unionByName(few.select("query_id", "video_id", path.alias("path"), F.lit(0.0).alias("score")))


def aligned_predictions(candidates: DataFrame, scores: DataFrame, n_events: int, frame_map: DataFrame, budget: int = 100) -> DataFrame:
    """``query_id, rank, video_id, frame_ids``: every candidate's frames up to the budget; 0000 where a video has no vectors."""
    found = align(scores, n_events)
    steps = found.select("query_id", "video_id", F.posexplode("path").alias("event_idx", "frame_idx"))
    named = frame_ids(steps, frame_map).groupBy("query_id", "video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "frame_id"))), lambda s: s["frame_id"]).alias("frame_ids"))
    none = F.array_repeat(F.lit("0000"), n_events)
    kept = candidates.where(F.col("rank") <= budget).join(named, ["query_id", "video_id"], "left")
    return kept.select("query_id", "rank", "video_id", F.coalesce("frame_ids", none).alias("frame_ids"))
