"""Dense retrieval: similarity of frames to prompts, fusion, smoothing, peaks and top-k.

Tables: ``frames(video_id, frame_idx, embedding)``, ``prompts(query_id, prompt_idx, embedding)``;
every step keeps one row a query, video and frame, and all queries go through one plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prompts that are held in a plan at most; more of them are scanned in several passes.
PROMPTS_A_PASS = 4096
#: Scores that a task makes at once.
MOST_SCORES = 1 << 20
#: Smoothing weights, share of the smoothed score, width of the Gaussian.
KERNEL = (0.1, 0.2, 0.4, 0.2, 0.1)
SMOOTH_SHARE = 0.6
SIGMA = 1.5


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def unit(v: Column) -> Column:
    """``v`` by its length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1e-10)).otherwise(norm))


def normalised(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, unit(doubles(F.col(column))))


def mean_query(prompts: DataFrame) -> DataFrame:
    """``query_id, embedding``: the unit mean of each query's prompts."""
    dims = prompts.select("query_id", F.posexplode(doubles(F.col("embedding"))).alias("i", "x")).groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    packed = dims.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return normalised(packed.select("query_id", F.transform("v", lambda s: s["x"]).alias("embedding")))


def similarity(frames: DataFrame, prompts: DataFrame) -> DataFrame:
    """``query_id, prompt_idx, video_id, frame_idx, score``: inner products of unit vectors, a matrix product a batch.

    Prompts are the queries' side: they are read in blocks of a bounded size, each one pass over
    the frames, which stay where they are. Frames without a vector, or of another length, score null.
    """
    out = None
    for block in _blocks(prompts):
        part = _scan(frames, block)
        out = part if out is None else out.unionByName(part)
    return frames.sparkSession.createDataFrame([], "query_id string, prompt_idx int, video_id string, frame_idx int, score double") if out is None else out


def _blocks(prompts: DataFrame) -> Iterator[list]:
    held: list = []
    for row in normalised(prompts).select("query_id", "prompt_idx", "embedding").orderBy("query_id", "prompt_idx").toLocalIterator():
        held.append((row[0], row[1], row[2]))
        if len(held) == PROMPTS_A_PASS:
            yield held
            held = []
    if held:
        yield held


def _scan(frames: DataFrame, block: list) -> DataFrame:
    names, numbers = [b[0] for b in block], [b[1] for b in block]
    matrix = np.array([b[2] for b in block], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(names)
        for batch in (b.slice(at, rows) for b in batches for rows in (max(1, MOST_SCORES // m),) for at in range(0, b.num_rows, rows)):
            vectors = batch.column(2)
            fits = pc.equal(pc.list_value_length(vectors), matrix.shape[1]).fill_null(False).to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, matrix.shape[1]))
            if fits.any():
                x[fits] = np.array(vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False), float).reshape(int(fits.sum()), -1)
            norm = np.sqrt((x * x).sum(1))
            x /= np.where(norm == 0, 1e-10, norm)[:, None]
            scores = x @ matrix.T
            take = pa.array(np.repeat(np.arange(batch.num_rows), m))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(names, object)[np.tile(np.arange(m), batch.num_rows)], pa.string()), pa.array(np.tile(np.array(numbers, np.int32), batch.num_rows)),
                batch.column(0).take(take), batch.column(1).take(take), pa.array(scores.ravel(), mask=np.repeat(~fits, m)),
            ], ["query_id", "prompt_idx", "video_id", "frame_idx", "score"])

    given = frames.select(F.col("video_id").cast("string"), F.col("frame_idx").cast("int"), F.col("embedding").cast("array<float>"))
    return given.mapInArrow(run, "query_id string, prompt_idx int, video_id string, frame_idx int, score double")


def fused_prompts(scores: DataFrame) -> DataFrame:
    """Half the best and half the mean of a frame's prompt scores."""
    return scores.groupBy("query_id", "video_id", "frame_idx").agg((0.5 * F.max("score") + 0.5 * F.avg("score")).alias("score"))


def series(*extra: str) -> Window:
    """A query's frames of one video in order; later steps reuse the exchange."""
    return Window.partitionBy("query_id", "video_id", *extra).orderBy("frame_idx")


def convolved(score: Column, weights: tuple[float, ...], over: Window) -> Column:
    """Centred, padded with zeros; series of fewer than three frames stay as they are."""
    half = len(weights) // 2
    terms = [F.coalesce(score if k == 0 else F.lag(score, -k).over(over), F.lit(0.0)) * w for k, w in zip(range(-half, half + 1), weights, strict=True)]
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "video_id"))
    return F.when(n >= 3, reduce(lambda a, b: a + b, terms)).otherwise(score)


def gaussian(sigma: float = SIGMA) -> tuple[float, ...]:
    """Normalised weights up to three sigma."""
    radius = int(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return tuple((w / w.sum()).tolist())


def smoothed(fused: DataFrame, weights: tuple[float, ...] = KERNEL) -> DataFrame:
    return fused.withColumn("smooth", convolved(F.col("score"), weights, series()))


def video_peaks(smooth: DataFrame) -> DataFrame:
    """``query_id, video_id, best_frame, score, n_frames``: the first largest smoothed frame; short series take their raw maximum."""
    key = F.struct(F.round("smooth", 9), -F.col("frame_idx"))
    best = smooth.groupBy("query_id", "video_id").agg(F.max_by(F.struct("frame_idx", "score", "smooth"), key).alias("b"), F.count("*").alias("n_frames"))
    mixed = SMOOTH_SHARE * F.col("b.smooth") + (1 - SMOOTH_SHARE) * F.col("b.score")
    return best.select("query_id", "video_id", F.col("b.frame_idx").alias("best_frame"), F.when(F.col("n_frames") >= 3, mixed).otherwise(F.col("b.score")).alias("score"), "n_frames")


def ranked(df: DataFrame, score: str = "score", k: int | None = None, by: str | list[str] = "query_id", tie: str = "video_id", digits: int = 6) -> DataFrame:
    """``rank`` from 1 by the rounded score, ties by id; a limit becomes a per-group top-k in the plan."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, digits)), tie)
    out = df.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def dense_search(frames: DataFrame, prompts: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked videos, and the frame series that later steps join."""
    frame_scores = smoothed(fused_prompts(similarity(frames, prompts)))
    return ranked(video_peaks(frame_scores), k=k), frame_scores

