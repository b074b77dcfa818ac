"""Exact nearest frames by pruning: pivot partitions, bounds by the triangle inequality, best partitions first.

Frames go to the nearest of some pivots and lie there by their angle to it, in blocks of bounded size.
A block knows the least and greatest angle to its pivot, its own centre, and how far from that its
frames reach. Angles between unit vectors obey the triangle inequality, so a query's angles to pivot
and centre bound the similarity of all of a block's frames. Every query looks into the blocks with the
best bounds first; its kth score there says which others it has to look into, and no more are opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import bounded_batches, partitions, shipped, staged
from .dense import ranked
from .framepass import prompt_blocks, ship_prompts

#: Frames of a block; frames that pivots are fitted on, and pivots, at most (fewer or more change the work, not the result).
BLOCK, SAMPLE, PIVOTS = 256, 16_384, 1024
#: Blocks that a query opens first; what rounding may add to a similarity.
FIRST, MARGIN = 4, 2e-6
KEYS = ["query_id", "prompt_idx"]


@dataclass(frozen=True)
class PivotIndex:
    """``blocks(block, pivot, low, high, radius, centre, n, videos, places, vectors)``, written, and the pivots."""

    blocks: DataFrame
    pivots: np.ndarray


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of arrays that all have ``dims`` numbers."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm == 0, 1e-10, norm)[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _fitted(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: means of a few rounds of nearest assignment, from evenly spaced vectors of the sample."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(4):
        nearest = (sample @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(1))
        pivots = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], pivots)
    return pivots


def pivot_index(frames: DataFrame) -> PivotIndex:
    """The index of ``frames(video_id, frame_idx, embedding)``; frames without a vector, or with one of another length than most, take no part."""
    spark = frames.sparkSession
    bounded_batches(spark)
    given = frames.select("video_id", F.col("frame_idx").cast("int"), F.col("embedding").cast("array<float>")).where("embedding IS NOT NULL AND size(embedding) > 0")
    sizes = given.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return PivotIndex(spark.createDataFrame([], f"block long, pivot int, low double, high double, radius double, centre array<double>, n int, videos array<{dict(frames.dtypes)['video_id']}>, places array<int>, vectors array<array<float>>"), np.empty((0, 1)))
    dims, count = sizes
    given = given.where(F.size("embedding") == dims)
    drawn = given.where(F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(1 << 20)) < int(SAMPLE * 0.9 / count * (1 << 20)) + 1) if count > SAMPLE else given
    sample = pa.array([r[0] for r in drawn.select("embedding").limit(SAMPLE).collect()], pa.list_(pa.float32()))
    pivots = _fitted(_matrix(sample, dims), max(1, min(PIVOTS, int(np.sqrt(count)))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _matrix(batch.column(2), dims) @ pivots.T
            pivot = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(_angle(cosine[np.arange(len(pivot)), pivot]))], ["video_id", "frame_idx", "embedding", "pivot", "angle"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(whole: pa.Table) -> pa.RecordBatch:
            angle = whole.column("angle").to_numpy()
            vectors = whole.column("embedding").combine_chunks()
            x = _matrix(vectors, dims)
            centre = x.sum(0)
            centre /= max(1e-10, float(np.sqrt(centre @ centre)))
            n = len(angle)
            one = [[whole.column("at")[0].as_py()], [whole.column("pivot")[0].as_py()], [angle.min()], [angle.max()], [float(_angle(x @ centre).max())]]
            arrays = [pa.array(v, t) for v, t in zip(one, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v) for v in (whole.column("video_id").combine_chunks(), whole.column("frame_idx").combine_chunks(), vectors)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int32()), *lists], ["block", "pivot", "low", "high", "radius", "centre", "n", "videos", "places", "vectors"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            pivot = batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
            for a, z in zip(edges, edges[1:], strict=False):
                while a < z:
                    if held and (held[0].column(3)[0].as_py() != pivot[a] or sum(map(len, held)) >= BLOCK):
                        yield block(pa.Table.from_batches(held))
                        held = []
                    take = min(z - a, BLOCK - sum(map(len, held)))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield block(pa.Table.from_batches(held))

    order = ["pivot", "angle", "video_id", "frame_idx"]
    kind = dict(given.dtypes)["video_id"]
    placed = given.mapInArrow(dealt, f"video_id {kind}, frame_idx int, embedding array<float>, pivot int, angle double").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = f"block long, pivot int, low double, high double, radius double, centre array<double>, n int, videos array<{kind}>, places array<int>, vectors array<array<float>>"
    blocks = placed.withColumn("at", F.monotonically_increasing_id()).mapInArrow(packed, schema)
    return PivotIndex(staged(blocks, "pivots"), pivots)


def _bounded(pivots: np.ndarray, files: tuple[str, ...], keep: Callable[[np.ndarray, list[str], np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``query_id, prompt_idx, block, bound`` of the pairs that ``keep`` tells from bounds, queries by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, low, high, radius = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            centre = np.array(batch.column(5).to_pylist()).reshape(batch.num_rows, -1)
            for names, starts, matrix, numbers in prompt_blocks(files):
                of = np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(matrix))))
                near = np.maximum(0, _angle(matrix @ centre.T) - radius)
                to_pivot = _angle(matrix @ pivots.T)[:, pivot]
                bound = np.cos(np.maximum(near, np.maximum(low - to_pivot, to_pivot - high)))
                q, b = np.nonzero(keep(bound, [names[i] for i in of], numbers))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of[q])), pa.array(numbers[q].astype(np.int32)), batch.column(0).take(pa.array(b)), pa.array(bound[q, b])], [*KEYS, "block", "bound"])

    return run


def _opened(index: PivotIndex, files: tuple[str, ...], chosen: DataFrame, k: int) -> DataFrame:
    """``query_id, prompt_idx, video_id, frame_idx, score`` of the ``k`` best frames of each chosen block for its queries, with all that rounds to the last."""
    kind = dict(index.blocks.dtypes)["videos"][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                videos, places, vectors, asked = (batch.column(i)[r].values for i in range(4))
                x = _matrix(vectors, len(vectors[0]))
                mine = {(a["query_id"], a["prompt_idx"]) for a in asked.to_pylist()}
                for names, starts, matrix, numbers in prompt_blocks(files):
                    of = np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(matrix))))
                    at = [i for i, (q, p) in enumerate(zip(of.tolist(), numbers.tolist(), strict=True)) if (names[q], p) in mine]
                    if not at:
                        continue
                    scores = matrix[at] @ x.T
                    least = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k, None] if scores.shape[1] > k else -2.0
                    q, f = np.nonzero(scores >= least - MARGIN)
                    who = np.array(at)[q]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of[who])), pa.array(numbers[who].astype(np.int32)), videos.take(pa.array(f)), places.take(pa.array(f)), pa.array(scores[q, f])], [*KEYS, "video_id", "frame_idx", "score"])

    asked = chosen.groupBy("block").agg(F.collect_list(F.struct(*KEYS)).alias("asked"))
    met = index.blocks.join(asked, "block").select("videos", "places", "vectors", "asked")
    return met.mapInArrow(run, f"query_id string, prompt_idx int, video_id {kind}, frame_idx int, score double")


def _best(scored: DataFrame, k: int) -> DataFrame:
    named = scored.withColumn("frame", F.concat_ws("/", F.col("video_id").cast("string"), F.lpad(F.col("frame_idx").cast("string"), 8, "0")))
    return ranked(named, k=k, by=KEYS, tie="frame").drop("frame")


def nearest(index: PivotIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most similar frames of every vector of ``queries(query_id, prompt_idx, embedding)``, with ``rank``; and which blocks each opened."""
    files = ship_prompts(queries)
    told = index.blocks.select("block", "pivot", "low", "high", "radius", "centre")
    schema = "query_id string, prompt_idx int, block long, bound double"

    def best_few(bound: np.ndarray, names: list[str], numbers: np.ndarray) -> np.ndarray:
        return bound >= np.partition(bound, bound.shape[1] - FIRST, 1)[:, bound.shape[1] - FIRST, None] if bound.shape[1] > FIRST else np.ones(bound.shape, bool)

    order = Window.partitionBy(*KEYS).orderBy(F.desc("bound"), "block")
    early = told.mapInArrow(_bounded(index.pivots, files, best_few), schema).withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST).drop("n", "bound")
    early = staged(early, "early")
    head = staged(_opened(index, files, early, k), "head")
    floors = _best(head, k).where(F.col("rank") == k).select(*KEYS, "score")
    held = _shipped_floors(floors)

    def reaching(bound: np.ndarray, names: list[str], numbers: np.ndarray) -> np.ndarray:
        known = held()
        return bound >= np.array([known.get((q, p), -2.0) for q, p in zip(names, numbers.tolist(), strict=True)])[:, None] - MARGIN

    later = staged(told.mapInArrow(_bounded(index.pivots, files, reaching), schema).drop("bound").join(early, [*KEYS, "block"], "left_anti"), "later")
    return _best(head.unionByName(_opened(index, files, later, k)), k), early.unionByName(later)


def _shipped_floors(floors: DataFrame) -> Callable[[], dict[tuple[str, int], float]]:
    """The kth scores found so far, as files for the executors: one row a query."""
    files = shipped(floors, "floors")

    def held() -> dict[tuple[str, int], float]:
        return {(r["query_id"], r["prompt_idx"]): r["score"] for name in files for r in pq.read_table(SparkFiles.get(name)).to_pylist()}

    return held
