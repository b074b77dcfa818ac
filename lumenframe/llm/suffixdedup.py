"""Exact substring deduplication by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere. Only suffixes
that can matter are sorted. Every start belongs to the anchor of its window, the position of the
smallest hash in it, so equal windows have equal anchors. Starts of one anchor are a block, cut
into steps and single starts; a unit of starts stands for one suffix, as long as all its windows
together. Units whose hash occurs once cannot repeat and stay out: finer units are looked at only
where a coarser class of possible partners holds one that is not settled. Hashes, kept in bounded
bit filters, only ever leave out what is certainly unique.

What is left is sorted: tasks sort their distinct suffixes into runs, cut them at sampled
splitters and exchange them front-coded; a loser tree that carries common prefixes merges the runs
of a range, and whatever stands there with an equal neighbour is a repetition. A suffix is sorted
by its first bytes, and by two 64-bit hashes of all of it where those are equal: windows of one
region overlap almost wholly, and exchanging every one in full would cost many times the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, freed, partitions, ship, written
from .shipped import BitFilter, bit_filter

LENGTH = 400
#: Bytes of a window's hashed grams, and starts of a step.
GRAM, STEP = 16, 16
#: Bytes that are worked on together, and margin on both sides of a part of a longer text.
CHUNK = 1 << 19
#: Bytes of suffixes in a run, splitters sampled for each range, and bytes that a suffix is sorted by before its digest.
RUN, SAMPLES, HEAD = 16 << 20, 40, 32
#: Suffixes that hashes took for repetitions in error: so many are told to all tasks (some MB); if there are more, texts are joined with what is repeated.
MOST_SINGLE = 1_000_000
_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Chunk:
    """Some texts, or a part of a long one, with hashes of all their substrings."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, offset: np.ndarray, length: int):
        """Texts are data[begins:ends]; starts from low to high (exclusive) are this chunk's; offset: what to add for places in the text."""
        self.data, self.begins, self.ends, self.offset, self.length = data, begins, ends, offset, length
        n = len(data)
        size = 1 << max(20, n.bit_length())
        self.up, down = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=self.sums[1:])
        self.half = length // 2
        self._find_blocks(low, high)

    def hash(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the bytes from ``at``; never 0."""
        end = at + size
        h = (self.sums[end] - self.sums[at]) * self.up[end - 1] + np.uint64(1) * np.asarray(size, np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h ^ (h >> np.uint64(32))) | np.uint64(1)

    def _find_blocks(self, low: np.ndarray, high: np.ndarray) -> None:
        """Per block: text, anchor, first and last start."""
        n, width = len(self.data), self.length - GRAM + 1
        empty = np.empty(0, np.int64)
        self.text = self.anchor = self.first = self.last = empty
        if n < self.length or not len(low):
            return
        h = (self.sums[GRAM:] - self.sums[:-GRAM]) * self.up[GRAM - 1 : n]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // width)
        padded = np.full(rows * width, (1 << 64) - 1, np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.length + 1
        anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & _LOW).astype(np.int64)
        mine = np.zeros(n + 1, np.int32)
        keep = high > low
        np.add.at(mine, low[keep], np.arange(len(low), dtype=np.int32)[keep] + 1)
        np.add.at(mine, high[keep], -(np.arange(len(low), dtype=np.int32)[keep] + 1))
        mine = np.cumsum(mine[:starts]) - 1  # the text of each start, -1: none of its own
        edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (mine[1:] != mine[:-1]))))
        stop = np.concatenate((edge[1:], [starts])) - 1
        own = mine[edge] >= 0
        self.first, self.last = edge[own], stop[own]
        self.text, self.anchor = mine[self.first].astype(np.int64), anchor[self.first]

    def block_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each block's whole suffix, and of the half length before and from its anchor (0: beyond the text)."""
        a, half = self.anchor, self.half
        whole = self.hash(self.first, self.last - self.first + self.length)
        left, right = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        has = a - half >= self.begins[self.text]
        left[has] = self.hash(a[has] - half, half) * np.uint64(3)
        has = a + self.length - half <= self.ends[self.text]
        right[has] = self.hash(a[has], self.length - half) * np.uint64(5)
        return whole, left, right

    def steps(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some blocks: block, first own start and number of them, whole hash, core hash.

        Steps are counted from the anchor; of one that reaches beyond its block only the block's
        starts are its own. Its core is what all windows of the whole step have in common, and so
        the same wherever one of them stands.
        """
        a = self.anchor[blocks]
        j0, j1 = (a - self.last[blocks]) // STEP, (a - self.first[blocks]) // STEP
        n = j1 - j0 + 1
        b = np.repeat(blocks, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(j0, n)
        last = self.anchor[b] - STEP * j
        low, high = np.maximum(last - STEP + 1, self.first[b]), np.minimum(last, self.last[b])
        return b, low, high - low + 1, self.hash(low, high - low + self.length), self.hash(last, self.length - STEP + 1) * np.uint64(7)

    def singles(self, blocks: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some steps: block, each own start, its window's hash."""
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(blocks, n), at, self.hash(at, self.length)

    def units(self, filters: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start in the chunk, size and hash of every suffix to be sorted."""
        whole, left, right = self.block_keys()
        every = np.arange(len(whole))
        parts = [(every[ok := filters.repeated(whole)], self.first[ok], (self.last - self.first)[ok] + self.length, whole[ok])]
        b, low, n, step, core = self.steps(every[filters.sides(left) | filters.sides(right)])
        ok = filters.repeated(step)
        parts.append((b[ok], low[ok], n[ok] - 1 + self.length, step[ok]))
        ok = filters.cores(core)
        b, at, one = self.singles(b[ok], low[ok], n[ok])
        ok = filters.repeated_one(one)
        parts.append((b[ok], at[ok], np.full(ok.sum(), self.length), one[ok]))
        block, start, size, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        # A block can be one step or one start: the same suffix of the same place must not meet itself.
        _, once = np.unique(start.astype(np.int64) << 32 | size.astype(np.int64), return_index=True)
        return self.text[block[once]], start[once], size[once], key[once]


class Filters:
    """What has been learnt: repeated whole suffixes, sides and cores of unsettled classes."""

    def __init__(self) -> None:
        self.blocks = self.steps = self.ones = self.sides = self.cores = BitFilter((), 64)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return self.blocks(keys) | self.steps(keys)

    def repeated_one(self, keys: np.ndarray) -> np.ndarray:
        return self.ones(keys)


def chunks(texts: list[bytes], length: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, Chunk]]:
    """Numbers of the texts in each chunk, and the chunk. Texts shorter than ``length`` are left out."""
    margin = 2 * length

    def made(items: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, Chunk]:
        """items: text, place of the part, its first own start and the end of its own starts."""
        raw, begins, low, high, at = [], [], [], [], 0
        for number, begin, first, stop in items:
            text = texts[number]
            part = text[begin : min(len(text), stop + length + margin)]
            raw.append(part)
            begins.append(at)
            low.append(at + first - begin)
            high.append(at + stop - begin)
            at += len(part)
        sizes = np.array([len(x) for x in raw])
        starts = np.array(begins)
        return np.array([i[0] for i in items]), Chunk(np.frombuffer(b"".join(raw), np.uint8), starts, starts + sizes, np.array(low), np.array(high), np.array([i[1] for i in items]) - starts, length)

    held, size = [], 0
    for number, text in enumerate(texts):
        if len(text) < length:
            continue
        last = len(text) - length + 1
        for first in range(0, last, chunk):
            stop = min(last, first + chunk)
            begin = max(0, first - margin)
            here = min(len(text), stop + length + margin) - begin
            if held and size + here > chunk + 4 * margin:
                yield made(held)
                held, size = [], 0
            held.append((number, begin, first, stop))
            size += here
    if held:
        yield made(held)


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


# ---- sorted runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, which share their first ``known`` bytes."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end  # equal up to low, different before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_coded(rows: list[tuple[bytes, int]]) -> bytes:
    """Sorted distinct suffixes and their counts: shared prefix, rest and count of each."""
    heads, tails, before = np.empty((len(rows), 3), "<u4"), [], b""
    for k, (text, count) in enumerate(rows):
        shared = common_prefix(before, text)
        heads[k] = shared, len(text) - shared, count
        tails.append(text[shared:])
        before = text
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(rows)).tobytes() + heads.tobytes() + b"".join(tails))


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Suffix, what it shares with the one before, and count."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    heads = np.frombuffer(raw, "<u4", 3 * n, 4).reshape(n, 3).tolist()
    at, before = 4 + 12 * n, b""
    for shared, size, count in heads:
        before = before[:shared] + raw[at : at + size]
        at += size
        yield before, shared, count


def merged(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """The runs as one sorted sequence: suffix, what it shares with the one before, count.

    A loser tree. Every suffix in it carries the length of the prefix it shares with the last
    winner it was compared with or against; of two suffixes the one that shares more with the
    winner is smaller, and only equals are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[tuple[bytes, int] | None] = [None] * k
    share = [0] * k
    for i, run in enumerate(runs):
        got = next(run, None)
        if got:
            head[i] = (got[0], got[2])

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes that with the winner."""
        a, b = head[i], head[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if share[i] != share[j]:
            return (i, j) if share[i] > share[j] else (j, i)
        x, y = a[0], b[0]
        n = common_prefix(x, y, share[i])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            share[j] = n
            return i, j
        share[i] = n
        return j, i

    losers = [0] * k
    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        for p in range(level):
            winners[p], losers[level + p] = play(winners[2 * p], winners[2 * p + 1])
    top = winners[0]
    while (best := head[top]) is not None:
        yield best[0], share[top], best[1]
        got = next(runs[top], None)
        # A run's next suffix shares with the last winner, its predecessor, what the run says.
        head[top], share[top] = ((got[0], got[2]), got[1]) if got else (None, 0)
        node, now = (top + k) // 2, top
        while node:
            now, losers[node] = play(now, losers[node])
            node //= 2
        top = now


def _identity(key: int, text: bytes) -> bytes:
    """Two independent 64-bit hashes of a suffix, of which ``key`` is the first."""
    return key.to_bytes(8, "little") + xxhash.xxh3_64_digest(text)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, most_single: int = MOST_SINGLE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row; with ``keep_text`` also ``kept`` and ``rest``, a struct of the row's other columns.

    Texts are their UTF-8 bytes, null texts empty; strings never cross texts and are judged on the
    input. ``spans`` are the removed runs as (start, end). ``kept`` is what is left, decoded with
    replacement where a cut parts a character. Repeated rows repeat each other's strings, whatever
    their ids; null ids and further columns do not matter, an empty table gives an empty one.
    Texts of any length are taken whole, in parts that overlap.
    """
    if length < 2 * GRAM + STEP:
        raise ValueError(f"length is at least {2 * GRAM + STEP}")
    other = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if keep_text else []
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*(other or [F.lit(0).alias("none")])).alias("rest"))
    rows = every.select("doc_id", "text")
    filters = Filters()

    # Blocks: sides that may have a partner and hold a block whose own suffix is unique.
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks(_texts(batch, 1), length):
                yield _longs(*c.block_keys(), names=["whole", "left", "right"])

    counted = cut(rows.mapInArrow(freed(blocks), "whole long, left long, right long").groupBy("whole", "left", "right").agg(F.count("*").alias("n")))
    n_blocks = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sides = counted.select(F.explode(F.array("left", "right")).alias("k"), "n").where("k <> 0").groupBy("k").agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    filters.blocks = bit_filter(cut(counted.groupBy(F.col("whole").alias("k")).agg(F.sum("n").alias("n")).where("n > 1").select("k")))
    filters.sides = bit_filter(cut(sides.where("all > 1 AND least = 1").select("k")))

    # Steps of those blocks, in the same way.
    def steps(batches: Iterator[pa.RecordBatch], f: Filters = _copy(filters)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks(_texts(batch, 1), length):
                _, left, right = c.block_keys()
                _, _, _, whole, core = c.steps(np.flatnonzero(f.sides(left) | f.sides(right)))
                yield _longs(whole, core, names=["whole", "core"])

    counted = cut(rows.mapInArrow(freed(steps), "whole long, core long").groupBy("whole", "core").agg(F.count("*").alias("n")))
    cores = counted.groupBy(F.col("core").alias("k")).agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    filters.steps = bit_filter(cut(counted.groupBy(F.col("whole").alias("k")).agg(F.sum("n").alias("n")).where("n > 1").select("k")))
    filters.cores = bit_filter(cut(cores.where("all > 1 AND least = 1").select("k")))

    # Single starts of those steps.
    def singles(batches: Iterator[pa.RecordBatch], f: Filters = _copy(filters)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks(_texts(batch, 1), length):
                _, left, right = c.block_keys()
                b, low, n, _, core = c.steps(np.flatnonzero(f.sides(left) | f.sides(right)))
                ok = f.cores(core)
                yield _longs(c.singles(b[ok], low[ok], n[ok])[2], names=["k"])

    filters.ones = bit_filter(cut(rows.mapInArrow(freed(singles), "k long").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")))

    sorted_ = written(_sort(rows, filters, length, n_blocks), "suffixes")
    span = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"
    rest = [every.schema["rest"]] if keep_text else []
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, " + span).fields, *rest])
    single = sorted_.where("NOT repeated")
    if single.count() <= most_single:
        # Few that only hashes took for repetitions: all tasks know them, and no text moves.
        known = Singles(ship(single.select("name", "key").coalesce(1), "single"))

        def finish_alone(batches: Iterator[pa.RecordBatch], f: Filters = _copy(filters)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = _texts(batch, 1)
                found: list[list[tuple[int, int]]] = [[] for _ in texts]
                for numbers, c in chunks(texts, length):
                    text, start, size, keys = c.units(f)
                    keep = known.repeated(c, start, size, keys)
                    text, start, size = text[keep], start[keep], size[keep]
                    for t, a, s in zip(numbers[text].tolist(), (start + c.offset[text]).tolist(), size.tolist(), strict=True):
                        found[t].append((a, a + s))
                rows_ = [_cut_out(t, spans, None, keep_text) for t, spans in zip(texts, found, strict=True)]
                yield _finished(batch.column(0), rows_, batch.columns[2:])

        done = (every if keep_text else rows).mapInArrow(freed(finish_alone), schema)
        return done if keep_text else done.drop("kept")
    repeated = sorted_.where("repeated").select("name")

    # Each text that holds a sorted suffix meets what has been found of it.
    def places(batches: Iterator[pa.RecordBatch], f: Filters = _copy(filters)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _texts(batch, 1)
            for numbers, c in chunks(texts, length):
                text, start, size, keys = c.units(f)
                if not len(text):
                    continue
                raw = c.data.tobytes()
                order = np.argsort(text, kind="stable")
                edges = [0, *(np.flatnonzero(np.diff(text[order])) + 1).tolist(), len(order)]
                out: list[tuple] = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    t = int(text[order[a]])
                    at, names = int(numbers[t]), {}
                    for i, s, key in zip(*(x[order[a:b]].tolist() for x in (start, size, keys)), strict=True):
                        names.setdefault(_identity(key, raw[i : i + s]), (s, []))[1].append(i + int(c.offset[t]))
                    mark = _mark(texts[at])
                    out += [(ids[at], mark, name, s, starts) for name, (s, starts) in names.items()]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "mark", "name", "size", "starts"])

    found = rows.mapInArrow(freed(places), "doc_id long, mark long, name binary, size long, starts array<long>").join(repeated, "name", "left_semi")
    found = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("size", "starts")).alias("found"))
    found = found.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "found")

    def split(batches: Iterator[pa.RecordBatch], f: Filters = _copy(filters)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, 1)
            touched = set()
            for numbers, c in chunks(texts, length):
                touched.update(numbers[np.unique(c.units(f)[0])].tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([_mark(t) if i in touched else None for i, t in enumerate(texts)], pa.int64()), pa.array([t if i in touched or keep_text else None for i, t in enumerate(texts)], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([None if i in touched else hashlib.sha256(t).hexdigest() for i, t in enumerate(texts)], pa.string()),
                *batch.columns[2:],
            ], ["doc_id", "mark", "text", "n_bytes", "sha", *["rest"] * keep_text])

    given = (every if keep_text else rows).mapInArrow(freed(split), T.StructType([*T.StructType.fromDDL("doc_id long, mark long, text binary, n_bytes long, sha string").fields, *rest]))
    joined = given.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("doc_id", "text", "n_bytes", "sha", "found", *["rest"] * keep_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, shas, got = (batch.column(i).to_pylist() for i in range(1, 5))
            rows_ = []
            for text, n, sha, found in zip(texts, sizes, shas, got, strict=True):
                spans = [(a, a + g["size"]) for g in found or () for a in g["starts"]]
                rows_.append((n, 0, 0, sha, [], None) if text is None else _cut_out(text, spans, sha, keep_text))
            yield _finished(batch.column(0), rows_, batch.columns[5:])

    done = joined.mapInArrow(freed(finish), schema)
    return done if keep_text else done.drop("kept")


def _cut_out(text: bytes, found: list[tuple[int, int]], sha: str | None, keep_text: bool) -> tuple:
    spans: list[dict] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(b, spans[-1]["end"])
        else:
            spans.append({"start": a, "end": b})
    edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text
    return len(text), sum(s["end"] - s["start"] for s in spans), len(spans), sha or hashlib.sha256(kept).hexdigest(), spans, kept.decode(errors="replace") if keep_text else None


def _finished(ids: pa.Array, rows: list[tuple], rest: list[pa.Array]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", *["rest"] * len(rest)]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *rest], names)


class Singles:
    """Sorted suffixes that turned out to stand alone: by one hash, then by both."""

    def __init__(self, files: tuple[str, ...]):
        self.files = files

    def repeated(self, chunk: Chunk, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        hashes, names = _singles(self.files)
        out = np.ones(len(keys), bool)
        for i in np.flatnonzero(np.isin(keys, hashes)).tolist():
            out[i] = _identity(int(keys[i]), chunk.data[start[i] : start[i] + size[i]].tobytes()) not in names
        return out


@lru_cache(maxsize=1)
def _singles(files: tuple[str, ...]) -> tuple[np.ndarray, frozenset]:
    rows = [pq.read_table(SparkFiles.get(name)) for name in files]
    keys = np.concatenate([t.column("key").to_numpy().view(np.uint64) for t in rows])
    return keys, frozenset(x for t in rows for x in t.column("name").to_pylist())


def _mark(text: bytes) -> int:
    """Tells rows of one id apart; equal rows have equal results."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _copy(filters: Filters) -> Filters:
    """As they are now, for a task's closure."""
    new = Filters()
    new.__dict__.update(filters.__dict__)
    return new


def _sort(rows: DataFrame, filters: Filters, length: int, blocks: int) -> DataFrame:
    """``name, key, repeated``: both hashes of the sorted suffixes, the first of them, and whether they occur at two starts or more."""
    ranges = partitions(rows.sparkSession)
    f = _copy(filters)

    def run_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, int]]:
        run: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for _, c in chunks(_texts(batch, 1), length):
                _, start, sizes, keys = c.units(f)
                _, first, times = np.unique(keys, return_index=True, return_counts=True)
                raw = c.data.tobytes()
                for a, s, n, key in zip(start[first].tolist(), sizes[first].tolist(), times.tolist(), keys[first].tolist(), strict=True):
                    text = raw[a : a + HEAD] + _identity(key, raw[a : a + s])
                    if text in run:
                        run[text] += n
                    else:
                        run[text] = n
                        size += len(text)
                if size > RUN:
                    yield run
                    run, size = {}, 0
        if run:
            yield run

    # Splitters: starts of blocks of as many texts as the ranges need, whatever the input's size.
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks(_texts(batch, 1), length):
                raw, tags = c.data.tobytes(), c.hash(c.first, 32)
                near = np.argsort(tags)[: 4 * SAMPLES]
                yield pa.RecordBatch.from_arrays([pa.array([raw[a : a + HEAD] for a in c.first[near].tolist()], pa.binary()), pa.array(tags[near].view(np.int64))], ["s", "tag"])

    spread = max(1, blocks // (4 * SAMPLES * ranges))
    taken = rows.where(F.pmod(F.xxhash64("text"), F.lit(spread)) == 0).mapInArrow(freed(some), "s binary, tag long").orderBy("tag").limit(SAMPLES * ranges).collect()
    ordered = sorted({bytes(r.s) for r in taken})
    splitters = [ordered[len(ordered) * (i + 1) // ranges] for i in range(ranges - 1) if len(ordered) > ranges]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in run_of(batches):
            ordered = sorted(run.items())
            parts: dict[int, list[tuple[bytes, int]]] = {}
            for row in ordered:
                parts.setdefault(bisect_right(splitters, row[0]), []).append(row)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([front_coded(p) for p in parts.values()], pa.binary())], ["range", "run"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            names, keys, often, before, total = [], [], [], None, 0

            def close() -> None:
                if before is not None:
                    names.append(before[HEAD:])
                    keys.append(int.from_bytes(before[HEAD : HEAD + 8], "little", signed=True))
                    often.append(total > 1)

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(keys, pa.int64()), pa.array(often, pa.bool_())], ["name", "key", "repeated"])

            for text, shared, count in merged([decoded(b) for b in blobs]):
                if before is not None and shared == len(text) == len(before):
                    total += count
                else:
                    close()
                    before, total = text, count
                    if len(names) == 20_000:
                        yield batch()
                        names, keys, often = [], [], []
            close()
            yield batch()

        held, now = [], None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and part != now:
                    yield from judged(held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield from judged(held)

    dealt = rows.mapInArrow(freed(runs), "range int, run binary").repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(freed(merge), "name binary, key long, repeated boolean")
