"""Frame selection: spaced peaks, spread around them, key frames and prediction lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import convolved, gaussian, series

#: Distance and number of peaks; steps around them by rank; length of a list.
MIN_DISTANCE, MAX_PEAKS = 12, 5
STEPS_FIRST, STEPS_NEXT, STEPS_LATER = (0, -3, 3, -6, 6, -10, 10, -15, 15), (0, -4, 4, -8, 8), (0, -4, 4)
BUDGET, NO_FRAME, NO_VIDEO = 100, "0000", "none"
QUANTILES, KEY_FRAMES = (0.05, 0.25, 0.50, 0.75, 0.95), 8
FRAMES_A_MAP_STEP = 25


def gaussian_smoothed(frame_scores: DataFrame) -> DataFrame:
    """``gauss``: the score under a Gaussian of sigma 1.5, padded with zeros; series under three frames stay."""
    return frame_scores.withColumn("gauss", convolved(F.col("score"), gaussian(), series()))


def frame_order(gauss: DataFrame) -> DataFrame:
    """``query_id, video_id, n_frames, ordered``: frames by falling smoothed score, later ones first on ties."""
    key = F.struct((-F.round("gauss", 9)).alias("k"), (-F.col("frame_idx")).alias("j"), F.col("frame_idx"))
    return gauss.groupBy("query_id", "video_id").agg(F.count("*").cast("int").alias("n_frames"), F.transform(F.array_sort(F.collect_list(key)), lambda s: s["frame_idx"]).alias("ordered"))


def spaced_peaks(ordered: Column, distance: int = MIN_DISTANCE, most: int = MAX_PEAKS) -> Column:
    """Greedy: a frame is taken if all taken ones are far enough."""
    empty = F.array().cast("array<int>")
    return F.aggregate(ordered, empty, lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda p: F.abs(p - x) < distance), acc).otherwise(F.concat(acc, F.array(x))))


def _around(peaks: Column, n_frames: Column, steps: tuple[int, ...]) -> Column:
    near = F.flatten(F.transform(peaks, lambda p: F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: p + s)))
    return F.array_distinct(F.filter(near, lambda f: (f >= 0) & (f < n_frames)))


def even_frames(n_frames: Column, count: int = 6) -> Column:
    """Up to ``count`` frames from the first to the last, evenly."""
    k = F.least(n_frames, F.lit(count))
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(F.round(i * (n_frames - 1) / (k - 1), 9)).cast("int"))
    return F.when(k > 1, spread).otherwise(F.array(F.lit(0)))


def frames_to_take(rank: Column, peaks: Column, n_frames: Column) -> Column:
    """Frames of a candidate by its rank (from 0): many around the first one's peaks, few of late ones."""
    first = F.array_distinct(F.concat(_around(F.slice(peaks, 1, 3), n_frames, STEPS_FIRST), even_frames(n_frames)))
    return (
        F.when(rank == 0, first)
        .when(rank < 4, _around(F.slice(peaks, 1, 2), n_frames, STEPS_NEXT))
        .when(rank < 12, _around(F.slice(peaks, 1, 2), n_frames, STEPS_LATER))
        .otherwise(F.slice(peaks, 1, 2))
    )


def frame_ids(df: DataFrame, frame_map: DataFrame) -> DataFrame:
    """``frame_id`` (text) of ``video_id, frame_idx``: from the map, else 25 frames a step, 1 for the first."""
    known = frame_map.select("video_id", "frame_idx", F.col("frame_id").cast("string").alias("mapped"))
    guess = F.when(F.col("frame_idx") > 0, F.col("frame_idx") * FRAMES_A_MAP_STEP).otherwise(1).cast("string")
    return df.join(known, ["video_id", "frame_idx"], "left").withColumn("frame_id", F.coalesce("mapped", guess)).drop("mapped")


def diverse_predictions(candidates: DataFrame, gauss: DataFrame, frame_map: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``query_id, rank, video_id, frame_id``: candidates' frames in order up to the budget, padded with frame 0000 of the first one.

    ``candidates(query_id, video_id, rank)``, rank from 1. A candidate without frames gives its first frame.
    """
    picked = candidates.join(frame_order(gauss), ["query_id", "video_id"], "left")
    peaks = spaced_peaks(F.col("ordered"))
    frames = F.when(F.col("ordered").isNull(), F.array(F.lit(0))).otherwise(frames_to_take(F.col("rank") - 1, peaks, F.col("n_frames")))
    rows = picked.select("query_id", "video_id", F.col("rank").alias("candidate"), F.posexplode(frames).alias("at", "frame_idx"))
    order = Window.partitionBy("query_id").orderBy("candidate", "at")
    kept = frame_ids(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget), frame_map).select("query_id", "rank", "video_id", "frame_id")
    first = candidates.groupBy("query_id").agg(F.min_by("video_id", "rank").alias("video_id"))
    counts = kept.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    missing = first.join(counts, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < budget)
    padding = missing.select("query_id", F.explode(F.sequence(F.col("n") + 1, F.lit(budget))).alias("rank"), "video_id", F.lit(NO_FRAME).alias("frame_id"))
    return kept.unionByName(padding)


def peak_frames(gauss: DataFrame) -> DataFrame:
    """``query_id, video_id, frame_idx``: the best smoothed frame, on ties the earlier one."""
    return gauss.groupBy("query_id", "video_id").agg(F.max_by("frame_idx", F.struct(F.round("gauss", 9), -F.col("frame_idx"))).alias("frame_idx"))


def best_frames(candidates: DataFrame, gauss: DataFrame) -> DataFrame:
    """The first candidate's best smoothed frame of every query."""
    return candidates.where("rank = 1").select("query_id", "video_id").join(peak_frames(gauss), ["query_id", "video_id"], "left")


def _segmented(gauss: DataFrame, parts: int = 3) -> DataFrame:
    whole = Window.partitionBy("query_id", "video_id")
    n = F.count(F.lit(1)).over(whole)
    length = F.floor(n / parts)
    segment = F.when(length > 0, F.least(F.floor(F.col("frame_idx") / length), F.lit(parts - 1))).otherwise(0)
    return gauss.withColumn("n_frames", n.cast("int")).withColumn("segment", segment.cast("int"))


def _peaks(gauss: DataFrame) -> DataFrame:
    """Peak of each third, and of all, as one row a video."""
    key = F.struct(F.round("gauss", 9), -F.col("frame_idx"))
    by_segment = _segmented(gauss).groupBy("query_id", "video_id", "segment").agg(F.max_by(F.struct("frame_idx", "gauss"), key).alias("p"), F.max("n_frames").alias("n_frames"))
    every = F.array_sort(F.collect_list(F.struct(F.col("p.frame_idx").alias("frame_idx"), F.round("p.gauss", 9).alias("gauss"))))
    top = F.max_by("p.frame_idx", F.struct(F.round("p.gauss", 9), -F.col("p.frame_idx")))
    return by_segment.groupBy("query_id", "video_id").agg(F.max("n_frames").alias("n_frames"), F.transform(every, lambda s: s["frame_idx"]).alias("peaks"), top.alias("top"))


def segment_peaks(gauss: DataFrame) -> DataFrame:
    """``peaks``: one frame of each third; all of a series of three or fewer. The overall peak is always one of them."""
    return _peaks(gauss).select("query_id", "video_id", F.when(F.col("n_frames") <= 3, F.sequence(F.lit(0), F.col("n_frames") - 1)).otherwise(F.col("peaks")).alias("peaks"))


def key_frames(gauss: DataFrame, budget: int = KEY_FRAMES) -> DataFrame:
    """``frames``: quantile positions, peaks of thirds and the overall peak with two neighbours each side; the best ``budget`` of them."""
    p = _peaks(gauss)
    n = F.col("n_frames")
    spread = F.array(*[F.floor(F.round(n * q, 6)).cast("int") for q in QUANTILES])
    around = F.transform(F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]), lambda d: F.col("top") + d)
    wanted = F.array_distinct(F.filter(F.concat(spread, F.col("peaks"), around), lambda f: (f >= 0) & (f < n)))
    chosen = p.select("query_id", "video_id", n, F.explode(F.when(n <= budget, F.sequence(F.lit(0), n - 1)).otherwise(wanted)).alias("frame_idx"))
    scored = chosen.join(gauss.select("query_id", "video_id", "frame_idx", "gauss"), ["query_id", "video_id", "frame_idx"])
    best = Window.partitionBy("query_id", "video_id").orderBy(F.desc(F.round("gauss", 9)), "frame_idx")
    kept = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= budget)
    return kept.groupBy("query_id", "video_id").agg(F.array_sort(F.collect_list("frame_idx")).alias("frames"))
