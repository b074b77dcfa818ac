"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every word of the training texts with its exact count, higher levels the n-grams
that occur often enough. An entry of a higher level is its context's place in the level below and
its last word; entries stand in that order, are kept relative to their shard's first context, and
monotone pointers tell each context's children, among which a successor search finds a word.

Texts are taken apart once, into chunks of numbered words. Levels are counted from chunks: sorted
runs of distinct n-grams go to ranges between sampled splitters, where their counts are summed
and a shard is made. Shards are written to the shared folder, fetched once by every executor and
memory-mapped there by its workers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, ship_written, written
from .eliasfano import EliasFano
from .shipped import laid_out

#: Stands for the end of a text; no word holds a line break.
END = b"\n"
ADD = 0.1
ORDER = 3
#: n-grams of words that occur less often, after contexts that do, or that do themselves, are left to the lower level,
#: however large the input is; what an n-gram that occurs twice is made of does so too, so that only n-grams seen once are left out.
MIN_WORD, MIN_CONTEXT, MIN_NGRAM = 2, 2, 2
DISCOUNT = 0.6
#: Bytes of text in a chunk; longer texts are parted at white space.
TOGETHER = 8 << 20
#: Entries that a task gathers before it sends them on, that a range gets from all tasks, and that a chunk gives as a sample.
GATHERED, RANGE, SAMPLE = 1 << 20, 3 << 19, 2048
#: Chunks that splitters are sampled from, at least and at most (a hundredth of all between that); bytes of a model that an executor maps at most.
SAMPLED, MOST_BYTES = (8, 1000), 200 << 30
#: Probabilities are kept as 16-bit steps of their logarithm, counts in 16 bits with a list of those beyond.
STEPS, WIDE = 4000.0, 65535
#: Shares that contexts' children use are kept in these parts of one.
SHARE = float(1 << 52)
_ZERO, _ONE = np.uint64(0), np.uint64(1)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
CHUNK_SCHEMA = "row array<long>, doc_id array<long>, held_out array<boolean>, size array<int>, lead int, opens boolean, ends boolean, codes binary, hashes binary, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# ---- chunks


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Every word's number, words a text, and the distinct words by number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten().dictionary_encode()
    codes, sizes = flat.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy().astype(np.int64)
    known = flat.dictionary.cast(pa.binary())
    raw = known.buffers()[2].to_pybytes() if len(known) and known.buffers()[2] else b""
    edges = np.frombuffer(known.buffers()[1], np.int32, len(known) + 1, 4 * known.offset).tolist() if len(known) else [0]
    words = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    if b"" in words:  # beside white space at a text's edge
        none = codes == words.index(b"")
        before = np.concatenate(([0], np.cumsum(none)))
        to = np.cumsum(sizes)
        sizes -= before[to] - before[to - sizes]
        codes = codes[~none]
    return codes, sizes, words


def _parts(text: bytes, together: int) -> Iterator[tuple[bytes, bool]]:
    """A text in parts that end at white space, and whether it ends there."""
    at = 0
    while len(text) - at > together and (gap := _GAP.search(text, at + together)):
        yield text[at : gap.start()], False
        at = gap.start()
    yield text[at:], True


def _chunked(order: int, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(row, doc_id, held_out, text)`` to chunks. A part of a text begins with the last words before it, as many as a context has."""
    lead = max(1, order - 1)

    def made(rows: pa.RecordBatch, texts: pa.Array, ends: bool = True, before: tuple[bytes, ...] = (), opens: bool = True) -> tuple[pa.RecordBatch, tuple[bytes, ...]]:
        codes, sizes, words = _words(texts)
        words = [*words, END]
        if ends:
            whole = np.full(len(codes) + len(sizes), len(words) - 1, np.int32)
            inside = np.ones(len(whole), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            whole[inside] = codes
            codes, sizes = whole, sizes + 1
        train = codes[np.repeat(~rows.column(2).to_numpy(zero_copy_only=False), sizes)]
        counts = np.bincount(train, minlength=len(words))
        last = (*before, *(words[c] for c in codes[-lead:].tolist()))[-lead:] if not ends else ()
        if before:
            number = {w: i for i, w in enumerate(words)}
            for w in before:
                number.setdefault(w, len(number))
            codes = np.concatenate((np.array([number[w] for w in before], np.int32), codes))
            words, counts = list(number), np.concatenate((counts, np.zeros(len(number) - len(counts), counts.dtype)))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        columns = [pa.array([x]) for x in (rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist())]
        columns[1] = pa.array([rows.column(1).to_pylist()], pa.list_(pa.int64()))
        packed = [pa.array([_packed(x)], pa.binary()) for x in (codes.astype("<u4"), hashes, counts.astype("<u8"))]
        out = [*columns, pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([len(before)], pa.int32()), pa.array([opens]), pa.array([ends]), *packed]
        return pa.RecordBatch.from_arrays(out, ["row", "doc_id", "held_out", "size", "lead", "opens", "ends", "codes", "hashes", "counts"]), last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).fill_null("")
            sizes = pc.binary_length(texts).to_numpy()
            at = 0
            while at < len(sizes):
                if sizes[at] > together:
                    before, seen, opens = (), 0, True
                    for part, ends in _parts(texts[at].as_py().encode(), together):
                        piece, last = made(batch.slice(at, 1), pa.array([part], pa.binary()).cast(pa.string()), ends, before, opens)
                        size = piece.column(3)[0].as_py()[0]
                        if size:
                            yield piece
                        seen, before = seen + size, last
                        opens = seen <= lead
                    at += 1
                    continue
                to, size = at, 0
                while to < len(sizes) and size + sizes[to] <= together:
                    size += sizes[to]
                    to += 1
                yield made(batch.slice(at, to - at), texts.slice(at, to - at))[0]
                at = to

    return run


class Chunk:
    """A chunk's texts as numbers of words."""

    def __init__(self, row: dict):
        self.row, self.doc_id, self.held_out = row["row"], row["doc_id"], np.array(row["held_out"], bool)
        self.sizes, self.lead, self.opens = np.array(row["size"], np.int64), row["lead"], row["opens"]
        self.codes, self.hashes = _unpacked(row["codes"], "<u4"), _unpacked(row["hashes"], "<u8")
        self.starts = np.cumsum(self.sizes) - self.sizes + self.lead
        self.train = np.repeat(~self.held_out, self.sizes)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])


# ---- sorted runs of (context, word)

Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # contexts, words, counts


def _order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The order of pairs."""
    if not len(hi):
        return np.empty(0, np.int64)
    first, radix = hi.min(), int(lo.max()) + 1
    if int(hi.max() - first) == 0:
        return np.argsort(lo, kind="stable")
    if (int(hi.max() - first) + 1) * radix < 1 << 64:
        return np.argsort((hi - first) * np.uint64(radix) + lo, kind="stable")
    return np.lexsort((lo, hi))


def _summed(parts: list[Run]) -> Run:
    """Runs as one: sorted distinct pairs, and sums of their counts."""
    hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(hi):
        return hi, lo, n
    order = _order(hi, lo)
    hi, lo, n = hi[order], lo[order], n[order]
    edge = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    return hi[edge], lo[edge], np.add.reduceat(n, edge)


def _cuts(hi: np.ndarray, lo: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Where each splitter would stand among sorted pairs, before its equals."""
    low, high = np.searchsorted(hi, splitters[0], side="left"), np.searchsorted(hi, splitters[0], side="right")
    return [a if a == b else a + int(np.searchsorted(lo[a:b], w)) for a, b, w in zip(low.tolist(), high.tolist(), splitters[1], strict=True)]


def _sent(run: Run, splitters: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A run by ranges, packed: steps between contexts, words and counts."""
    hi, lo, n = run
    edges = [0, *_cuts(hi, lo, splitters), len(hi)]
    ranges = [i for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    columns = [[], [], []]
    for i in ranges:
        a, b = edges[i], edges[i + 1]
        columns[0].append(_packed(np.diff(hi[a:b], prepend=_ZERO)))
        columns[1].append(_packed(lo[a:b]))
        columns[2].append(_packed(n[a:b].astype("<u8")))
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["range", "steps", "words", "counts"])


def _runs(parts: Iterator[Run], splitters: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= GATHERED:
            yield _sent(_summed(held), splitters)
            held, size = [], 0
    if size:
        yield _sent(_summed(held), splitters)


# ---- levels


@dataclass(frozen=True)
class Level:
    """Where a level is: files that ``SparkFiles`` knows, its number of entries, and the sum of their counts."""

    files: tuple[str, ...] = ()
    size: int = 0
    total: int = 0


def _padded(x: bytes) -> bytes:
    return x + bytes(-len(x) % 8)


def _shards(run: Run, context_counts: np.ndarray | None, radix: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """First context and word, entries, sum of counts and bytes of the shards of a range; contexts of one shard lie so close that its values fit 64 bits."""
    hi, lo, n = run
    apart = (hi - hi[0]) // np.uint64(((1 << 64) - 1) // radix) if radix > 1 else np.zeros(len(hi), np.uint64)
    for a, b in zip(begin := np.flatnonzero(np.concatenate(([True], apart[1:] != apart[:-1]))).tolist(), [*begin[1:], len(hi)], strict=True):
        h, w, c = hi[a:b], lo[a:b], n[a:b]
        wide = np.flatnonzero(c >= WIDE)
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        head = np.array([len(h), len(wide), len(edge)], "<u8").tobytes()
        parts = [head, EliasFano.encode((h - h[0]) * np.uint64(radix) + w), _padded(np.minimum(c, WIDE).astype("<u2").tobytes()), wide.astype("<i8").tobytes(), c[wide].astype("<u8").tobytes()]
        if context_counts is not None:
            t = np.maximum(context_counts[a:b], c)
            terms = np.minimum(65535, np.rint(-STEPS * np.log10(np.maximum(c - DISCOUNT, 1e-3) / t)))
            # Whole numbers of the last place of a double: a context that goes on in the next shard sums to the same, wherever it is parted.
            used = np.add.reduceat(np.rint(SHARE * 10 ** (-terms / STEPS)).astype(np.int64), edge)
            pointers = np.concatenate((edge, [len(h)])).astype(np.uint64)
            parts += [_padded(terms.astype("<u2").tobytes()), used.astype("<i8").tobytes(), EliasFano.encode(h[edge] - h[0]), EliasFano.encode(pointers)]
        yield int(h[0]), int(w[0]), b - a, int(c.sum()), b"".join(parts)


class Shard:
    """A mapped shard: values relative to the first context, counts, and, above words, logarithms, and for each context that occurs the share its children use and a pointer to them."""

    def __init__(self, path: str, above: bool):
        raw = np.memmap(path, np.uint8, "r")
        n, wide, contexts = raw[:24].view("<u8").tolist()
        self.keys = EliasFano(raw[24:])
        at = 24 + self.keys.nbytes

        def taken(count: int, kind: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            at += -(-size // 8) * 8
            return raw[at - -(-size // 8) * 8 :][:size].view(kind)

        self.counts, self.wide, self.more = taken(n, "<u2"), taken(wide, "<i8"), taken(wide, "<u8")
        if above:
            self.terms, self.used = taken(n, "<u2"), taken(contexts, "<i8")
            self.contexts = EliasFano(raw[at:])
            self.pointers = EliasFano(raw[at + self.contexts.nbytes :])

    def count(self, at: np.ndarray) -> np.ndarray:
        out = self.counts[at].astype(np.int64)
        high = np.flatnonzero(out == WIDE)
        out[high] = self.more[np.searchsorted(self.wide, at[high])]
        return out


class MappedLevel:
    """A level's shards, memory-mapped."""

    def __init__(self, level: Level, radix: int):
        self.radix, self.above = np.uint64(radix), radix > 1
        told = _laid_out(level.files) if level.files else []
        self.shards = [Shard(path, self.above) for *_, path in told]
        self.first = tuple(np.array([t[i] for t in told], np.uint64) for i in (0, 1))
        self.offset = np.cumsum([0, *(t[2] for t in told)])

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the level (-1: not there) and logarithm of the discounted probability of each pair; pairs are sorted."""
        place, term = np.full(len(hi), -1, np.int64), np.full(len(hi), -np.inf)
        edges = [*_cuts(hi, lo, self.first), len(hi)]
        for shard, ahead, first, a, b in zip(self.shards, self.offset.tolist(), self.first[0], edges[:-1], edges[1:], strict=False):
            if a == b:
                continue
            context = hi[a:b] - first
            at, within = np.arange(b - a), None
            if self.above:  # only contexts with children are searched, among these
                edge = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                own, sizes = shard.contexts.find(context[edge]), np.diff(np.concatenate((edge, [b - a])))
                at, own, sizes = at[np.repeat(own >= 0, sizes)], own[own >= 0], sizes[own >= 0]
                if shard.keys.sparse(len(at)):
                    ends = shard.pointers.get(np.concatenate((own, own + 1))).astype(np.int64)
                    within = (np.repeat(ends[: len(own)], sizes), np.repeat(ends[len(own) :], sizes))
            got = shard.keys.find(context[at] * self.radix + lo[a:b][at], within)
            at, got = at[got >= 0], got[got >= 0]
            place[a + at] = got + ahead
            if self.above:
                term[a + at] = shard.terms[got] / -STEPS
        return place, term

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Counts of entries by their places (-1: 0)."""
        out = np.zeros(len(places), np.int64)
        owner = np.searchsorted(self.offset, places, side="right") - 1
        for k in np.unique(owner[places >= 0]).tolist():
            at = np.flatnonzero(owner == k)
            out[at] = self.shards[k].count(places[at] - self.offset[k])
        return out

    def left(self, contexts: np.ndarray) -> np.ndarray:
        """Share that each context leaves to the level below; a context may go on in the next shard, contexts that are -1 leave all."""
        used = np.zeros(len(contexts), np.int64)
        if not self.shards:
            return np.ones(len(contexts))
        asked = contexts.astype(np.uint64)
        # Shards that may hold a context: from the last that begins before it to the last that begins with it.
        low = np.maximum(0, np.searchsorted(self.first[0], asked, side="left") - 1)
        high = np.searchsorted(self.first[0], asked, side="right") - 1
        low[contexts < 0], high[contexts < 0] = 1, 0
        order = np.argsort(low.astype(np.min_scalar_type(len(self.shards))), kind="stable")
        while len(order := order[low[order] <= high[order]]):
            edges = np.searchsorted(low[order], np.arange(low[order[0]], low[order[-1]] + 2))
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), int(low[order[0]])):
                if a == b:
                    continue
                at = order[a:b]
                own = self.shards[k].contexts.find(asked[at] - self.first[0][k])
                used[at[own >= 0]] += self.shards[k].used[own[own >= 0]]
            low[order] += 1
        return np.maximum(1e-9, 1 - used / SHARE)


def _laid_out(files: tuple[str, ...]) -> list[tuple[int, int, int, str]]:
    """First context and word, entries and mapped file of each shard."""

    def lay(folder: str) -> None:
        rows = []
        for name in files:
            for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    with open(f"{folder}/{len(rows)}", "wb") as out:
                        out.write(row["blob"])
                    rows.append(f"{row['hi']} {row['lo']} {row['n']} {len(rows)}")
        with open(f"{folder}/shards", "w") as out:
            out.write("\n".join(rows))

    folder = laid_out(files, lay)
    with open(f"{folder}/shards") as lines:
        rows = [x.split() for x in lines]
    return sorted((int(h), int(w), int(n), f"{folder}/{k}") for h, w, n, k in rows)


@lru_cache(maxsize=4)
def _mapped(level: Level, radix: int) -> MappedLevel:
    return MappedLevel(level, radix)


class Walk:
    """The levels found so far, along a chunk's words."""

    def __init__(self, chunk: Chunk, levels: list[Level], min_word: int, min_context: int, min_ngram: int, logs: bool = False):
        order = np.argsort(chunk.hashes)
        words = _mapped(levels[0], 1)
        own = np.empty(len(order), np.int64)
        own[order] = words.find(np.zeros(len(order), np.uint64), chunk.hashes[order])[0]
        count = words.counts(own)
        self.counts = count[chunk.codes] if logs else None
        self.radix = levels[0].size + 1
        self.fresh = chunk.starts if chunk.opens else chunk.starts[1:]
        if chunk.opens and chunk.lead:
            self.fresh = np.concatenate(([0], self.fresh[1:]))
        self.words = np.where(count >= min_word, own, -1)[chunk.codes]
        #: Place of the n-gram that ends at each word, in the highest level so far.
        self.found = self.words
        # A text's beginning is a context of its own, behind all words.
        self.context = self.after(np.where(count >= min_context, own, -1)[chunk.codes], levels[0].size)
        self.logs: list[tuple[np.ndarray, np.ndarray]] = []  # of each higher level: term, share left to what is below
        for level in levels[1:]:
            hi, lo, known = self.keys(np.arange(len(self.words)))
            order = _order(hi, lo)
            found, log = np.full(len(self.words), -1, np.int64), np.full(len(self.words) if logs else 0, -np.inf)
            mapped = _mapped(level, self.radix)
            place, term = mapped.find(hi[order], lo[order])
            found[known[order]] = place
            if logs:
                log[known[order]] = term
                self.logs.append((log, mapped.left(self.context)))
            self.found = found
            self.context = self.after(found if min_context <= min_ngram else np.where(mapped.counts(found) >= min_context, found, -1), -1)

    def after(self, x: np.ndarray, first: int) -> np.ndarray:
        """The value at the word before; ``first`` where a text begins."""
        y = np.concatenate(([-1], x[:-1]))
        y[self.fresh] = first
        return y

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of the next level's n-grams that end ``at`` and may be known there: their parts are."""
        at = at[(self.context[at] >= 0) & (self.found[at] >= 0)]
        return self.context[at].astype(np.uint64), self.words[at].astype(np.uint64), at


def _level(chunks: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[Run]], splitters: tuple[np.ndarray, np.ndarray], least: int, radix: int, below: tuple[Level, int, int] | None) -> Level:
    """A level from the runs that ``parts`` makes of chunks; ``below``: the level of its contexts, that level's radix and the count of texts."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _runs(parts(batches), splitters)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(run: Run) -> Iterator[pa.RecordBatch]:
            run = tuple(x[run[2] >= least] for x in run)
            if len(run[0]):
                counts = None
                if below:
                    level, below_radix, texts = below
                    places = run[0].astype(np.int64)
                    counts = np.where(places == level.size, texts, _mapped(level, below_radix).counts(np.where(places == level.size, -1, places)))
                for hi, lo, n, total, blob in _shards(run, counts, radix):
                    yield pa.RecordBatch.from_arrays([pa.array([str(hi)]), pa.array([str(lo)]), pa.array([n]), pa.array([total]), pa.array([blob], pa.binary())], ["hi", "lo", "n", "total", "blob"])

        now, held = None, []
        for batch in batches:
            for part, steps, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield from made(_summed(held))
                    held = []
                now = part
                held.append((np.cumsum(_unpacked(steps, "<u8"), dtype=np.uint64), _unpacked(words, "<u8"), _unpacked(counts, "<u8").astype(np.int64)))
        if held:
            yield from made(_summed(held))

    dealt = chunks.mapInArrow(freed(runs), "range int, steps binary, words binary, counts binary").repartition(len(splitters[0]) + 1, "range").sortWithinPartitions("range")
    blobs = written(dealt.mapInArrow(freed(merge), "hi string, lo string, n long, total long, blob binary"), "level")
    told = blobs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.length("blob").cast("long")), F.lit(0)).alias("bytes")).first()
    if told.bytes > MOST_BYTES:
        raise ValueError("the model is larger than an executor may map; raise MIN_WORD or MIN_NGRAM")
    return Level(ship_written(blobs), told.n, told.total) if told.n else Level()


def train_and_score(docs: DataFrame, order: int = ORDER, min_word: int = MIN_WORD, min_context: int = MIN_CONTEXT, min_ngram: int = MIN_NGRAM, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from rows whose crc32(id as text) mod ``folds`` is not 0 (and from those with a null
    id). ``base_score`` is the add-0.1 unigram log10 probability, ``score`` the interpolated
    n-gram model's. A null or empty text is its end alone. Repeated rows count and are scored as
    often as they occur; with nothing to learn from, every token has probability one. Texts of any
    length are taken whole, in parts that know the words before them. Columns other than the id
    and the text are not looked at, whatever their names; an empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    chunks = written(rows.mapInArrow(freed(_chunked(order, together)), CHUNK_SCHEMA), "chunks")
    ended = F.when(F.col("ends"), F.size(F.filter("held_out", lambda x: ~x))).otherwise(0)
    told = chunks.agg(F.count("*").alias("n"), F.max("lead").alias("lead"), F.coalesce(F.sum(ended), F.lit(0)).alias("texts")).first()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
        for batch in batches:
            for hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = _unpacked(hashes, "<u8"), _unpacked(counts, "<u8").astype(np.int64)
                yield np.zeros((n > 0).sum(), np.uint64), h[n > 0], n[n > 0]

    sample = chunks.where(F.pmod(F.xxhash64(F.element_at("row", 1), "lead"), F.lit(max(1, told.n // min(SAMPLED[1], max(SAMPLED[0], told.n // 100))))) == 0)

    def splitters(of: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[Run]]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that cut what all chunks send into ranges of about ``RANGE`` entries, from evenly spaced pairs of some chunks."""

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for hi, lo, _ in parts(batches):
                at = np.unique(np.linspace(0, len(hi) - 1, min(len(hi), SAMPLE)).astype(np.int64)) if len(hi) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(hi)]), pa.array([hi[at].tobytes()], pa.binary()), pa.array([lo[at].tobytes()], pa.binary())], ["n", "hi", "lo"])

        taken = of.mapInArrow(some, "n long, hi binary, lo binary").collect()
        hi, lo = (np.frombuffer(b"".join(bytes(r[c]) for r in taken), np.uint64) for c in ("hi", "lo"))
        if not len(hi):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        ordered = _order(hi, lo)
        ranges = max(4, -(-sum(r.n for r in taken) * told.n // (len(taken) * RANGE)))
        at = np.unique(len(ordered) * np.arange(1, min(ranges, len(ordered))) // min(ranges, len(ordered)))
        return hi[ordered[at]], lo[ordered[at]]

    levels = [_level(chunks.select("hashes", "counts"), words, splitters(sample.select("hashes", "counts"), words), 1, 1, None)]
    v, n = levels[0].size, levels[0].total
    for _ in range(2, order + 1) if v else ():
        before = list(levels)

        def ngrams(batches: Iterator[pa.RecordBatch], before: list[Level] = before) -> Iterator[Run]:
            for chunk in _chunks(batches):
                walk = Walk(chunk, before, min_word, min_context, min_ngram)
                hi, lo, _ = walk.keys(chunk.lead + np.flatnonzero(chunk.train))
                yield _summed([(hi, lo, np.ones(len(hi), np.int64))])

        levels.append(_level(chunks, ngrams, splitters(sample, ngrams), min_ngram, v + 1, (levels[-1], v + 1 if len(levels) > 1 else 1, told.texts)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            walk = Walk(chunk, levels, min_word, min_context, min_ngram, logs=True)
            p = (walk.counts + ADD) / (n + ADD * (v + 1))
            base = np.add.reduceat(np.log10(p), chunk.starts)
            for term, left in walk.logs:
                p = 10**term + left * p
            total = np.add.reduceat(np.log10(p), chunk.starts)
            known = np.add.reduceat((walk.counts > 0).astype(np.int64), chunk.starts)
            columns = [pa.array(chunk.row, pa.int64()), pa.array(chunk.doc_id, pa.int64()), pa.array(chunk.held_out), *map(pa.array, (chunk.sizes, known, np.full(len(base), n), base, total))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = chunks.mapInArrow(freed(score), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    if told.lead:  # texts in parts
        sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")] + [F.max("train_tokens").alias("train_tokens")] + [F.sum(c).alias(c) for c in ("base_score", "score")]
        scored = scored.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *sums)
    return scored.drop("row")
