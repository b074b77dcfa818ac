"""Dense search in one pass over frames: prompts fused in the row, series smoothed, peaks and the best videos kept, in one worker.

Frames are laid out in blocks: a row has the neighbouring frames of a video, up to a fixed number, and
two more on either side, so that it is smoothed without looking elsewhere and no video is too long. A
pass over blocks gives each task's best videos for every query, and only these are exchanged; frame
series are made afterwards, for the pairs of query and video that are asked for. Frames of a video are
numbered from 0 without gaps, as the sources number them. Prompts go to executors as files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import bounded_batches, shipped
from .dense import KERNEL, PROMPTS_A_PASS, SMOOTH_SHARE, normalised, ranked

#: Frames of a block besides the two on either side; scores that are made at once; prompts that a worker keeps unpacked.
CHUNK, HALO, MOST_SCORES, HELD = 1024, len(KERNEL) // 2, 1 << 21, 1 << 16
#: Scores are ranked by six digits, peaks by nine.
DIGITS, PEAK_DIGITS = 6, 9

PromptBlock = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]  # queries, where their prompts begin, unit vectors, prompts' numbers


def frame_blocks(frames: DataFrame) -> DataFrame:
    """``video_id, chunk, frames`` of ``frames(video_id, frame_idx, embedding)``; no exchange where these lie by video already."""
    bounded_batches(frames.sparkSession)
    chunk, at = F.expr(f"frame_idx div {CHUNK}"), F.col("frame_idx") % CHUNK
    near = F.filter(F.array(chunk, F.when(at < HALO, chunk - 1), F.when(at >= CHUNK - HALO, chunk + 1)), lambda c: c >= 0)
    rows = frames.select("video_id", F.col("frame_idx").cast("int"), F.col("embedding").cast("array<float>"), F.explode(near).alias("chunk"))
    return rows.groupBy("video_id", "chunk").agg(F.collect_list(F.struct("frame_idx", "embedding")).alias("frames"))


def ship_prompts(prompts: DataFrame) -> tuple[str, ...]:
    """Unit vectors of ``prompts(query_id, prompt_idx, embedding)`` as files for the executors, a query's prompts in one."""
    ordered = normalised(prompts.where("embedding IS NOT NULL")).select(F.col("query_id").cast("string"), "prompt_idx", "embedding")
    return shipped(ordered.repartition("query_id").sortWithinPartitions("query_id", "prompt_idx"), "prompts")


def _read_blocks(files: tuple[str, ...]) -> Iterator[PromptBlock]:
    def block(rows: list[pa.RecordBatch]) -> PromptBlock:
        whole = pa.Table.from_batches(rows)
        names = whole.column("query_id").to_pylist()
        starts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
        return [names[i] for i in starts], np.array(starts), np.array(whole.column("embedding").to_pylist(), float), whole.column("prompt_idx").to_numpy()

    for name in files:
        held: list[pa.RecordBatch] = []
        for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(batch_size=PROMPTS_A_PASS):
            ids = batch.column(batch.schema.get_field_index("query_id"))
            if held and held[-1].column(0)[-1] != ids[0]:
                yield block(held)
                held = []
            last = pc.index(ids, ids[-1]).as_py()  # the last query may go on in the next batch
            if last:
                yield block([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield block(held)


@lru_cache(maxsize=2)
def _kept_blocks(files: tuple[str, ...]) -> tuple[list[PromptBlock], bool]:
    """A worker's unpacked prompts, and whether they are all."""
    out, n = [], 0
    for b in _read_blocks(files):
        out.append(b)
        n += len(b[2])
        if n > HELD:
            return out[:1], False
    return out, True


def prompt_blocks(files: tuple[str, ...]) -> Iterator[PromptBlock]:
    kept, whole = _kept_blocks(files)
    yield from kept if whole else _read_blocks(files)


class Frames:
    """The frames of some blocks, in order."""

    def __init__(self, batch: pa.RecordBatch):
        self.videos, self.chunks, lists = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64)
        inner = lists.flatten()
        idx, segment = inner.field(0).to_numpy(), np.repeat(np.arange(batch.num_rows), self.sizes)
        order = np.lexsort((idx, segment))
        self.idx, self.segment, self.vectors = idx[order], segment, inner.field(1).take(pa.array(order))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.own = self.idx // CHUNK == self.chunks[segment]
        self.short = (self.sizes < len(KERNEL) // 2 + 1) & (self.chunks == 0)  # all there is of the video

    def ranges(self, prompts: int) -> Iterator[tuple[int, int]]:
        """Blocks whose scores are made at once."""
        a = 0
        while a < len(self.sizes):
            z, n = a, 0
            while z < len(self.sizes) and (z == a or (n + self.sizes[z]) * prompts <= MOST_SCORES):
                n += self.sizes[z]
                z += 1
            yield a, z
            a = z

    def fused(self, a: int, z: int, block: PromptBlock) -> tuple[np.ndarray, np.ndarray]:
        """Frames by queries: half the best and half the mean of the prompts' scores, and the smoothed series."""
        _, starts, matrix, _ = block
        low, high = self.starts[a], self.starts[z - 1] + self.sizes[z - 1]
        vectors = self.vectors.slice(low, high - low)
        fits = pc.equal(vectors.value_lengths(), matrix.shape[1]).fill_null(False).to_numpy(zero_copy_only=False)
        x = np.full((high - low, matrix.shape[1]), np.nan)
        if fits.any():
            x[fits] = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(fits.sum()), -1)
            norm = np.sqrt((x[fits] ** 2).sum(1))
            x[fits] /= np.where(norm == 0, 1e-10, norm)[:, None]
        scores = x @ matrix.T
        count = np.diff(np.append(starts, len(matrix)))
        raw = 0.5 * np.maximum.reduceat(scores, starts, 1) + 0.5 * np.add.reduceat(scores, starts, 1) / count
        segment, known, smooth = self.segment[low:high], np.nan_to_num(raw), 0.0
        for k, weight in zip(range(-HALO, HALO + 1), KERNEL, strict=True):
            at = np.arange(high - low) + k
            inside = (at >= 0) & (at < high - low)
            inside[inside] = segment[at[inside]] == segment[inside]
            smooth = smooth + weight * np.where(inside[:, None], known[np.clip(at, 0, high - low - 1)], 0)
        return raw, np.where(self.short[segment][:, None], raw, smooth)


PEAKS = ["query_id", "video_id", "best_frame", "raw", "smooth", "n_frames"]
PEAK_SCHEMA = "query_id string, video_id {0}, best_frame int, raw double, smooth double, n_frames long"


def _none(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


class _Best:
    """The best videos of some queries so far, with all that round to the last one's score."""

    def __init__(self, names: list[str], k: int):
        self.names, self.k, self.floor = names, k, np.full(len(names), -np.inf)
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, videos: pa.Array, peaks: tuple[np.ndarray, ...], n: np.ndarray) -> None:
        frame, raw, smooth = peaks
        score = np.where(n[:, None] >= 3, SMOOTH_SHARE * smooth + (1 - SMOOTH_SHARE) * raw, raw)
        value = np.where(np.isnan(score), -np.inf, score)
        v, q = np.nonzero(value >= self.floor - 10.0**-DIGITS)
        self.rows.append((q, value[v, q], videos.take(pa.array(v)), frame[v, q], raw[v, q], smooth[v, q], n[v]))
        self.size += len(q)
        if self.size > 4 * self.k * len(self.names) + (1 << 16):
            self.trim()

    def trim(self) -> None:
        q, value, videos, *rest = (pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((-value, q))
        begins = np.searchsorted(q[order], np.arange(len(self.names) + 1))
        full = np.flatnonzero(np.diff(begins) >= self.k)
        self.floor[full] = value[order][begins[full] + self.k - 1]
        keep = np.flatnonzero(value >= self.floor[q] - 10.0**-DIGITS)
        self.rows = [(q[keep], value[keep], videos.take(pa.array(keep)), *(x[keep] for x in rest))]
        self.size = len(keep)

    def batch(self) -> pa.RecordBatch:
        self.trim()
        q, _, videos, frame, raw, smooth, n = self.rows[0]
        return pa.RecordBatch.from_arrays([pa.array(self.names, pa.string()).take(pa.array(q)), videos, pa.array(frame.astype(np.int32)), _none(raw), _none(smooth), pa.array(n)], PEAKS)


def _peaks(frames: Frames, a: int, z: int, raw: np.ndarray, smooth: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """First largest smoothed frame of each block's own ones, by queries; own frames; whether the block is all of its video."""
    base, key = int(frames.starts[a]), np.round(np.nan_to_num(smooth, nan=-np.inf), PEAK_DIGITS)
    frame, best = np.zeros((z - a, raw.shape[1]), np.int64), np.zeros((z - a, raw.shape[1]), np.int64)
    n, whole = np.zeros(z - a, np.int64), np.zeros(z - a, bool)
    for s in range(a, z):
        low = frames.starts[s] - base
        own = np.flatnonzero(frames.own[frames.starts[s] : frames.starts[s] + frames.sizes[s]])
        n[s - a] = len(own)
        whole[s - a] = frames.chunks[s] == 0 and len(own) == frames.sizes[s]
        if len(own):
            best[s - a] = low + own[0] + key[low + own[0] : low + own[-1] + 1].argmax(0)
            frame[s - a] = frames.idx[base + best[s - a]]
    column = np.arange(raw.shape[1])[None, :]
    return (frame, raw[best, column], smooth[best, column]), n, whole


def peaks_of(blocks: DataFrame, files: tuple[str, ...], k: int | None = None) -> DataFrame:
    """``query_id, video_id, best_frame, score, n_frames``: each task's ``k`` best videos a query (all without ``k``), parts of long videos put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            frames = Frames(batch)
            for b, block in enumerate(prompt_blocks(files)):
                for a, z in frames.ranges(len(block[2])):
                    peaks, n, whole = _peaks(frames, a, z, *frames.fused(a, z, block))
                    kept = np.flatnonzero(whole) if k else np.empty(0, np.int64)
                    if len(kept):
                        best.setdefault(b, _Best(block[0], k)).add(frames.videos.slice(a, z - a).take(pa.array(kept)), tuple(p[kept] for p in peaks), n[kept])
                    rest = np.flatnonzero((n > 0) & ~(whole & bool(k)))
                    if len(rest):
                        v, q = np.repeat(rest, len(block[0])), np.tile(np.arange(len(block[0])), len(rest))
                        frame, raw, smooth = (p[v, q] for p in peaks)
                        yield pa.RecordBatch.from_arrays([pa.array(block[0], pa.string()).take(pa.array(q)), frames.videos.slice(a, z - a).take(pa.array(v)), pa.array(frame.astype(np.int32)), _none(raw), _none(smooth), pa.array(n[v])], PEAKS)
        for held in best.values():
            yield held.batch()

    found = blocks.select("video_id", "chunk", "frames").mapInArrow(run, PEAK_SCHEMA.format(dict(blocks.dtypes)["video_id"]))
    key = F.struct(F.round("smooth", PEAK_DIGITS), -F.col("best_frame"))
    # By query, as the ranking is: one exchange for both.
    merged = found.repartition("query_id").groupBy("query_id", "video_id").agg(F.max_by(F.struct("best_frame", "raw", "smooth"), key).alias("b"), F.sum("n_frames").alias("n_frames"))
    mixed = SMOOTH_SHARE * F.col("b.smooth") + (1 - SMOOTH_SHARE) * F.col("b.raw")
    return merged.select("query_id", "video_id", "b.best_frame", F.when(F.col("n_frames") >= 3, mixed).otherwise(F.col("b.raw")).alias("score"), "n_frames")


def top_videos(blocks: DataFrame, files: tuple[str, ...], k: int | None = None) -> DataFrame:
    """``peaks_of`` with ``rank`` from 1."""
    return ranked(peaks_of(blocks, files, k), k=k)


def frame_series(blocks: DataFrame, files: tuple[str, ...], pairs: DataFrame | None = None) -> DataFrame:
    """``query_id, video_id, frame_idx, score, smooth`` of ``pairs(query_id, video_id)``, or of all."""
    schema = f"query_id string, video_id {dict(blocks.dtypes)['video_id']}, frame_idx int, score double, smooth double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = Frames(batch)
            asked = batch.column(3) if batch.num_columns > 3 else None
            for block in prompt_blocks(files):
                names, starts, matrix, numbers = block
                ends = np.append(starts, len(matrix))
                for a, z in frames.ranges(len(matrix)) if asked is None else ((s, s + 1) for s in range(batch.num_rows)):
                    part = block
                    if asked is not None:
                        mine = np.flatnonzero(np.isin(np.array(names, object), np.array(asked[a].as_py(), object)))
                        if not len(mine):
                            continue
                        sizes = ends[mine + 1] - starts[mine]
                        part = [names[i] for i in mine], np.cumsum(sizes) - sizes, np.concatenate([matrix[starts[i] : ends[i + 1]] for i in mine]), numbers
                    raw, smooth = frames.fused(a, z, part)
                    base = int(frames.starts[a])
                    own = np.flatnonzero(frames.own[base : base + len(raw)])
                    n, q = np.repeat(own, len(part[0])), np.tile(np.arange(len(part[0])), len(own))
                    videos = frames.videos.take(pa.array(frames.segment[base + n]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()).take(pa.array(q)), videos, pa.array(frames.idx[base + n]), _none(raw[n, q]), _none(smooth[n, q])], ["query_id", "video_id", "frame_idx", "score", "smooth"])

    given = blocks.select("video_id", "chunk", "frames")
    if pairs is not None:
        given = given.join(pairs.groupBy("video_id").agg(F.collect_set(F.col("query_id").cast("string")).alias("asked")), "video_id")
    return given.mapInArrow(run, schema)
