"""SimHash near-duplicate detection with multi-index hashing.

A fingerprint has three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most
four bits differ in at most one bit of the first or of the second segment, or in none of the
third (2 + 2 + 1 = 5 > 4), so Hamming balls of radius 1, 1 and 0 find every link. Of the two ends
of a one-bit difference only the one with the 0 bit enumerates, which halves the ball.

Copies are folded to one fingerprint before any exchange. In a bucket, links are verified by
complete distances, in blocks, and leave as a spanning forest: a bucket of n fingerprints gives at
most n - 1 links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, partitions, written
from .components import connected_components

SEED = 42
WIDTHS = (22, 21, 21)
RADII = (1, 1, 0)
MAX_BITS = sum(r + 1 for r in RADII) - 1
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15
#: Buckets above this size are walked breadth-first instead of pair by pair.
SMALL = 48


def fingerprint(text: bytes | None, k: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word ``k``-shingles of UTF-8 ``text``, A-Z lower-cased; 0 without words."""
    words = (text or b"").lower().split()  # bytes: only ASCII letters and white space are special
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits in a signed long. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, k) for x in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(run), "doc_id long, fp long")


Rules = tuple[tuple[tuple[int, ...], int], ...]  # columns, and how many bits may differ in them together


def _near(a: list[np.ndarray], b: list[np.ndarray], rules: Rules) -> np.ndarray:
    ok: np.ndarray | bool = True
    for columns, limit in rules:
        ok = ok & (sum(np.bitwise_count(a[c] ^ b[c]).astype(np.int16) for c in columns) <= limit)
    return ok


def _forest(marks: list[np.ndarray], rules: Rules) -> list[tuple[int, int]]:
    """Links (by row) of a spanning forest of rows that are linked by ``rules``."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(marks[0]))
    at = lambda rows, shape: [m[rows].reshape(shape) for m in marks]
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, (1 << 21) // len(rest))
            some, front = front[:step], front[step:]
            near = _near(at(some, (-1, 1)), at(rest, (1, -1)), rules)
            hit = near.any(0)
            if hit.any():
                found = rest[hit]
                links += zip(some[near[:, hit].argmax(0)].tolist(), found.tolist(), strict=True)
                rest, front = rest[~hit], np.concatenate((front, found))
    return links


def _bucket_links(keys: np.ndarray, marks: list[np.ndarray], rules: Rules) -> np.ndarray:
    """Links (by row) within runs of equal ``keys`` (sorted), none that follows from others of the call."""
    links: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edge)
    for d in range(1, SMALL):  # rows d apart in a small bucket, all buckets at once
        live = (sizes > d) & (sizes <= SMALL)
        if not live.any():
            break
        count, first = sizes[live] - d, edge[:-1][live]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        at = at[_near([m[at] for m in marks], [m[at + d] for m in marks], rules)]
        links += zip(at.tolist(), (at + d).tolist(), strict=True)
    for i in np.flatnonzero(sizes > SMALL):
        first = edge[i]
        links += ((a + first, b + first) for a, b in _forest([m[first : edge[i + 1]] for m in marks], rules))
    return np.array(links, np.int64).reshape(-1, 2)


def _spanning(links: list[list[int]] | list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join something not yet joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def link_fingerprints(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``fps(fp)``, distinct, to ``(u, v)``: links whose closure is that of all pairs at ``bits`` or fewer differing bits."""
    return _linked(fps.select(F.col("fp").alias("node"), F.col("fp").alias("m0")), RADII, (((0,), bits),))


def _linked(marks: DataFrame, radii: tuple[int, ...], rules: Rules) -> DataFrame:
    """Links of ``marks(node, m0, ...)``; ``m0`` is what balls of ``radii`` are enumerated of.

    With radius 1, the end that has the 0 bit enumerates; with 2, both ends flip one bit and meet.
    """
    rows, shift = [], 0
    for seg, (width, radius) in enumerate(zip(WIDTHS, radii, strict=True)):
        key = F.shiftrightunsigned("m0", shift).bitwiseAND(F.lit((1 << width) - 1))
        tagged = key + F.lit(seg << 22)
        rows.append(F.array(tagged))
        bit = lambda b, key=key: key.bitwiseAND(F.lit(1 << b))
        if radius == 1:
            rows.append(F.array_compact(F.array(*[F.when(bit(b) == 0, tagged + F.lit(1 << b)) for b in range(width)])))
        elif radius == 2:
            rows.append(F.array(*[F.when(bit(b) == 0, tagged + F.lit(1 << b)).otherwise(tagged - F.lit(1 << b)) for b in range(width)]))
        shift += width
    names = [c for c in marks.columns if c != "node"]
    probes = marks.select(F.explode(F.concat(*rows).cast("array<int>")).alias("bucket"), *marks.columns)
    spread = probes.repartition(partitions(marks.sparkSession), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int32), *[np.empty(0, np.int64) for _ in range(1 + len(names))]]

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, nodes, *rest = columns
            if len(keys) > 1 and len(links := _bucket_links(keys, [m.view(np.uint64) for m in rest], rules)):
                ends = _spanning([x for x in nodes[links].tolist() if x[0] != x[1]])
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in ends], pa.int64()), pa.array([v for _, v in ends], pa.int64())], ["u", "v"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) < 1 << 17:
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            yield from out([h[:whole] for h in held])
            held = [h[whole:] for h in held]
        yield from out(held)

    return spread.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of ``bits`` or fewer differing bits,
    the row's own included. Texts of any length are taken whole. Null and empty texts have fingerprint zero and link like any other.
    Rows with a null id keep their row; they take the component of their fingerprint, null only
    if no row in it has an id. Repeated rows are returned as often as they occur. An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    if bits > MAX_BITS:
        raise ValueError(f"the balls cover {MAX_BITS} differing bits")
    marked = cut(fingerprints(docs, id_col, text_col, k))
    # As text: ids and counts by fingerprint are combined before the exchange, so copies cost a row a task.
    folded = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    if folded.where("low IS NULL").isEmpty():
        # Fingerprints are linked under their smallest ids, so a component's label is its smallest id.
        labels = connected_components(_linked(folded.select(F.col("low").alias("node"), F.col("fp").alias("m0")), RADII, (((0,), bits),)))
        by_fp = folded.join(labels, F.col("node") == F.col("low"), "left").select("fp", F.coalesce("label", "low").alias("component_id"))
    else:
        labels = connected_components(link_fingerprints(folded.select("fp"), bits))
        placed = folded.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
        lowest = placed.groupBy("label").agg(F.min("low").alias("component_id"))
        by_fp = placed.join(lowest, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Jaccard similarity of distinct word shingles, as a fraction, that makes two documents near copies.
NEAR = (4, 5)
#: Bands of as many minima of the shingles' hashes: two sets at a similarity of 0.8 share a band with probability 0.998, whatever was edited.
BANDS, BAND_ROWS = 16, 5
#: Nodes of a group of candidates that meet in one task; hubs of a bucket that a larger group's nodes are compared with; rounds in which labels go along what is linked.
MEETING, HUBS, ROUNDS = 2000, 4, 2


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word ``k``-shingles (of all words if they are fewer); empty without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    distinct = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in distinct), np.uint64, len(distinct)))


_DRAWN = np.random.default_rng(SEED).integers(0, (1 << 64) - 1, (3, BANDS * BAND_ROWS, 1), np.uint64, endpoint=True)


def _bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band, for hashes of one set."""
    turn, odd, mix = _DRAWN[0], _DRAWN[1] | np.uint64(1), _DRAWN[2, :, 0] | np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096] ^ turn) * odd).min(1))
    return ((least ^ least >> np.uint64(31)) * mix).reshape(BANDS, BAND_ROWS).sum(1, dtype=np.uint64)


def _packed_set(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, as steps by planes of bytes."""
    steps = np.diff(np.unique(hashes >> np.uint64(16)), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def _unpacked_set(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _similar(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets, none of which is empty, are near copies of ``x``."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    low, high = np.minimum(sizes, len(x)), np.maximum(sizes, len(x))
    out = low * NEAR[1] >= high * NEAR[0]
    rows = np.flatnonzero(out)
    step = max(1, (1 << 20) // max(1, 2 * len(x)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        every = np.concatenate([others[y] for y in some.tolist()])
        place = np.minimum(np.searchsorted(x, every), len(x) - 1)
        both = np.add.reduceat((x[place] == every).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
        out[some] = both * NEAR[1] >= (sizes[some] + len(x) - both) * NEAR[0]
    return out


def _near_links(sets: list[np.ndarray], bands: np.ndarray) -> list[tuple[int, int]]:
    """Links (by row) of a spanning forest of rows that share a band and are near copies."""
    links: list[tuple[int, int]] = []
    bucket_of = [np.unique(b, return_inverse=True)[1] for b in bands]
    buckets = [np.split(np.argsort(b, kind="stable"), np.cumsum(np.bincount(b))[:-1]) for b in bucket_of]
    fresh = np.ones(len(sets), bool)
    for first in range(len(sets)):
        front = [first] if fresh[first] else []
        fresh[first] = False
        while front:
            x = front.pop()
            met = []
            for of, rows_of in zip(bucket_of, buckets, strict=True):
                if len(rows := rows_of[of[x]]):
                    rows_of[of[x]] = rows = rows[fresh[rows]]  # what is linked already is not met again
                    met.append(rows)
            if not met:
                continue
            rows = np.unique(np.concatenate(met))
            found = rows[_similar(sets[x], [sets[y] for y in rows.tolist()])]
            fresh[found] = False
            links += ((x, y) for y in found.tolist())
            front += found.tolist()
    return links


def _met_links(sets: list[np.ndarray], bands: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Links (by row) of each row that is ``asked`` with every row that shares a band and is a near copy."""
    links: list[tuple[int, int]] = []
    for x in np.flatnonzero(asked).tolist():
        rows = np.flatnonzero((bands == bands[:, x : x + 1]).any(0))
        rows = rows[rows != x]
        links += ((x, y) for y in rows[_similar(sets[x], [sets[y] for y in rows.tolist()])].tolist())
    return links


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spanning forests of links among ``rows(*keys, node, bands, hashes, asked)`` that have equal keys: of links of rows that are asked, or, where ``asked`` is null, of all."""
    spread = rows.select(*keys, "node", "bands", "hashes", "asked").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, bands, sets, asked = None, [], [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                marks = np.array(bands, np.int64).T.copy()
                ends = _near_links(sets, marks) if asked[0] is None else _spanning(_met_links(sets, marks, np.array(asked, bool)))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[u] for u, _ in ends], pa.int64()), pa.array([nodes[v] for _, v in ends], pa.int64())], ["u", "v"])

        for batch in batches:
            for *key, node, band, hashes, ask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield from out()
                    now, nodes, bands, sets, asked = key, [], [], [], []
                if nodes and nodes[-1] == node:  # documents with equal shingles follow each other
                    asked[-1] = asked[-1] or ask
                else:
                    nodes.append(node)
                    bands.append(band)
                    sets.append(_unpacked_set(hashes))
                    asked.append(ask)
        yield from out()

    return spread.mapInArrow(freed(verify), "u long, v long")


def _large_links(nodes: DataFrame, together: int) -> DataFrame:
    """Links of large groups of candidates, ``nodes(group, node, bands, hashes)``, whose closure is that of all near copies in them.

    Each node is compared with some hubs of its fullest bucket, and labels go along what is linked;
    that joins most of a group. What has not the label of a group's largest part is compared with
    all of the group, in blocks. No task gets more than two blocks of a group.
    """
    nodes = written(nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("group", "bands", "hashes")]), "large")
    probes = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node")
    hubs = probes.groupBy("bucket").agg(F.count("*").alias("n"), F.array(*[F.min_by("node", F.xxhash64("node", F.lit(r))) for r in range(HUBS)]).alias("hubs"))
    fullest = probes.join(hubs, "bucket").groupBy("node").agg(F.max_by("hubs", F.struct("n", "bucket")).alias("hubs"))
    asked = fullest.select("node", F.explode(F.array_distinct("hubs")).alias("hub")).where("node <> hub")
    sets = nodes.select("node", "hashes")
    both = asked.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("hashes").alias("others")), "hub").select("node", "hub", "hashes", "others")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, known = [], {}
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b not in known:
                    known = {b: _unpacked_set(b)}  # a hub's rows follow each other
                hits.append(bool(_similar(_unpacked_set(a), [known[b]])[0]))
            yield from pa.Table.from_batches([batch.select([0, 1]).rename_columns(["u", "v"])]).filter(pa.array(hits, pa.bool_())).to_batches()

    links = cut(both.mapInArrow(freed(compare), "u long, v long"))
    parts = nodes.select("group", "node", F.col("node").alias("part"))
    ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    for _ in range(ROUNDS):
        least = ends.join(parts.select(F.col("node").alias("v"), "part"), "v").groupBy("u").agg(F.min("part").alias("least"))
        parts = parts.join(least, F.col("node") == F.col("u"), "left").select("group", "node", F.least("part", "least").alias("part"))
    parts = cut(parts)
    sizes = parts.groupBy("group", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    open_ = main.where("n > most")
    if open_.isEmpty():
        return links
    rows = nodes.join(parts.select("node", "part"), "node").join(open_, "group").withColumn("asked", F.col("part") != F.col("main"))
    blocks, lists = F.ceil(F.col("n") / together).cast("int"), F.ceil((F.col("n") - F.col("most")) / together).cast("int")
    of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = rows.select("*", F.array(of(blocks)).alias("in"), F.sequence(F.lit(0), lists - 1).alias("by"), F.lit(False).alias("ask"))
    query = rows.where("asked").select("*", F.sequence(F.lit(0), blocks - 1).alias("in"), F.array(of(lists)).alias("by"), F.lit(True).alias("ask"))
    dealt = every.unionByName(query).drop("asked").withColumnRenamed("ask", "asked").withColumn("in", F.explode("in")).withColumn("by", F.explode("by"))
    return links.unionByName(_met(dealt, ["group", "in", "by"]))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, together: int = MEETING) -> DataFrame:
    """``doc_id, component_id`` of documents whose distinct word ``k``-shingles have a Jaccard similarity of 0.8 or more.

    Candidates share a band of minima. What candidates join, up to ``together`` of it, meets in one
    task, larger groups in blocks; similarities are counted from 48 bits of the shingles' hashes.
    Components and odd rows are as in
    ``near_duplicates``; documents with equal shingles are folded first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_hashes(x, k) for x in part.column(1).cast(pa.binary()).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                # Copies in one task tell their shingles once.
                first = [n for n in dict.fromkeys(nodes.tolist()) if n not in told]
                told.update(first)
                mine = dict.fromkeys(first, True)
                fresh = [mine.pop(n, False) and len(x) > 0 for n, x in zip(nodes.tolist(), sets, strict=True)]
                bands = [_bands(x).view(np.int64).tolist() if f else None for f, x in zip(fresh, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), pa.array(bands, pa.list_(pa.int64())), pa.array([_packed_set(x) if f else None for f, x in zip(fresh, sets, strict=True)], pa.binary())], ["doc_id", "node", "bands", "hashes"])

    marks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(run), "doc_id long, node long, bands array<long>, hashes binary")
    marked = written(marks, "shingles")
    folded = cut(marked.groupBy("node").agg(F.min("doc_id").alias("low")))
    probes = marked.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node").distinct()
    # A node and the hubs of its buckets are joined to the smallest of those hubs: that many nodes share few hubs keeps links few.
    hubs = probes.join(probes.groupBy("bucket").agg(F.min("node").alias("hub")), "bucket").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    least = hubs.select("node", "hubs", F.array_min("hubs").alias("v"))
    ends = least.select("node", "v").unionByName(least.select(F.explode("hubs").alias("node"), "v"))
    groups = cut(connected_components(ends.select(F.col("node").alias("u"), "v").where("u <> v").distinct()))
    sizes = cut(groups.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > together))
    asked = marked.where("hashes IS NOT NULL").join(groups, "node").select(F.col("label").alias("group"), "node", "bands", "hashes", F.lit(None).cast("boolean").alias("asked"))
    if sizes.isEmpty():
        links = _met(asked, ["group"])
    else:
        large = sizes.select(F.col("label").alias("group"))
        links = _met(asked.join(large, "group", "left_anti"), ["group"]).unionByName(_large_links(asked.join(large, "group", "left_semi").drop("asked"), together))
    labels = connected_components(cut(links))
    placed = folded.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    lowest = placed.groupBy("label").agg(F.min("low").alias("component_id"))
    return marked.select("doc_id", "node").join(placed.join(lowest, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of ``docs``, whole, without those whose component has a smaller id; a repeated id keeps one row, rows without an id stay.

    Components are those of ``near_duplicates``, by SimHash; those of ``near_copies`` add what lies further apart.
    """
    grouped = near_duplicates(docs, id_col, text_col).select("doc_id", "component_id").unionByName(near_copies(docs, id_col, text_col, k))
    judged = cut(grouped.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count("*").alias("n")))
    gone = judged.where("low < doc_id").select("doc_id")
    kept = docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
    if judged.where("n > 2").isEmpty():  # each row is told of twice
        return kept
    named = kept.where(F.col(f"`{id_col}`").isNotNull())
    return named.dropDuplicates([id_col]).unionByName(kept.where(F.col(f"`{id_col}`").isNull()))
