"""Keyword search by block-max pruning: all queries at once, without scoring every text that shares a word.

Texts are dealt to shards of bounded size, and a shard's texts to small blocks. An index row holds a
word's postings in a shard, block after block, and each block's greatest frequency and least text
length: what its postings can score at most, whatever the mean length becomes. In a shard, a query adds
up its words' greatest impacts for every block and walks the blocks from the highest bound on, until no
bound reaches its kth score; postings of the others are never looked at. The best blocks of some shards
go first: the kth score there is a floor for all shards, which then return next to nothing beyond what is
asked for. Results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import raw_words, tokens_of
from ..sources.staging import bounded_batches, partitions, staged
from .dense import ranked
from .sparse import K1, B, weights_of

#: Texts of a shard and of a block; what rounding may add to a score.
SHARD, BLOCK, MARGIN = 4096, 4, 1e-5
#: Bytes of words that a worker packs at once: a shard of long texts is cut into parts, which are shards of their own; parts of a shard at most.
PACKED, PARTS = 1 << 25, 1 << 20
#: Of so many shards one gives floors, but so many do at least.
SAMPLED, LEAST = 32, 64
#: No word: its row has a shard's texts and their lengths.
TEXTS = ""


@dataclass(frozen=True)
class BlockIndex:
    """``rows``, written: a row a shard and word; ``terms(token, df, idf)``; the mean length of texts."""

    rows: DataFrame
    terms: DataFrame
    mean: float
    shards: int


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


NAMES = ["shard", "token", "n", "n_blocks", "total", "packed", "ids"]


def _packed(shard: int, ids: pa.Array, blocks: np.ndarray, words: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """Index rows of a shard, whose texts come in order of their blocks.

    A row's 32-bit numbers: texts and frequencies of its postings, then of each block its number, its
    postings, the greatest frequency and the least length; of the texts' own row, the lengths.
    """
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    n_texts, n_words = len(ids), len(coded.dictionary)
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_texts + np.repeat(np.arange(n_texts), lengths), return_counts=True)
    word, doc = pairs // n_texts, pairs % n_texts
    run = word * (int(blocks[-1]) + 1) + blocks[doc]  # a word's postings in a block
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    n, m = np.bincount(word, minlength=n_words), np.bincount(word[first], minlength=n_words)
    size = 2 * n + 4 * m
    base = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int32)
    for k, x in enumerate((doc, tf)):
        out[_ranges(base + k * n, n)] = x
    for k, x in enumerate((blocks[doc[first]], np.diff(np.concatenate((first, [len(run)]))), np.maximum.reduceat(tf, first), np.minimum.reduceat(lengths[doc], first))):
        out[_ranges(base + 2 * n + k * m, m)] = x
    texts = [pa.array([shard]), pa.array([TEXTS]), *(pa.array([x], t) for x, t in ((n_texts, pa.int32()), (0, pa.int32()), (int(lengths.sum()), pa.int64()), (lengths.astype(np.int32).tobytes(), pa.binary())))]
    yield pa.RecordBatch.from_arrays([*texts, pa.ListArray.from_arrays(pa.array([0, n_texts], pa.int32()), ids)], NAMES)
    blobs = pa.Array.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(np.append(4 * base, out.nbytes).astype(np.int32)), pa.py_buffer(out)])
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n_words, shard)), coded.dictionary, pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(n), blobs, pa.nulls(n_words, pa.list_(ids.type))], NAMES)


def _packing(packed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Index rows of shards, part ``n`` of shard ``s`` under the number ``s * PARTS + n``; a part has no more bytes than ``packed``, or one text."""

    def made(held: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        one = [whole.column(c).chunk(0) for c in ("id", "block", "words")]
        yield from _packed(held[0].column(0)[0].as_py() * PARTS + part, one[0], one[1].to_numpy(), one[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = part = 0
        for batch in batches:
            shards, lists = batch.column(0).to_numpy(), batch.column(3)
            ends = np.append(0, pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64).cumsum())
            upto = ends[np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum())]  # bytes of the texts before each
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and b > a and held[0].column(0)[0].as_py() != shards[a]:
                    yield from made(held, part)
                    held, size, part = [], 0, 0
                while a < b:
                    z = min(b, max(a + 1, int(np.searchsorted(upto, upto[a] + packed - size, "right")) - 1))
                    if held and size + upto[z] - upto[a] > packed:
                        yield from made(held, part)
                        held, size, part = [], 0, part + 1
                        continue
                    held.append(batch.slice(a, z - a))
                    size, a = size + int(upto[z] - upto[a]), z
        if held:
            yield from made(held, part)

    return run


def block_index(media: DataFrame, shard: int = SHARD, block: int = BLOCK, packed: int = PACKED) -> BlockIndex:
    """The index of ``media(video_id, text)``, one row an id; texts without words are left out."""
    spark = media.sparkSession
    bounded_batches(spark)
    n = media.count()
    shards = max(-(-n // shard), 2 * partitions(spark))
    blocks = max(1, n // shards // block)
    words = media.select("video_id", raw_words(F.col("text")).alias("w")).select("video_id", tokens_of(F.col("w")).alias("words")).where(F.size("words") > 0)
    placed = words.select(F.pmod(F.xxhash64("video_id"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("video_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.col("video_id").alias("id"), "words")
    ordered = placed.repartition("shard").sortWithinPartitions("shard", "block", "id")
    rows = staged(ordered.mapInArrow(_packing(packed), f"shard long, token string, n int, n_blocks int, total long, packed binary, ids array<{dict(media.dtypes)['video_id']}>"), "blocks")
    texts = rows.where(F.col("token") == TEXTS).agg(F.sum("n").alias("n"), F.sum("total").alias("length")).first()
    df = rows.where(F.col("token") != TEXTS).groupBy("token").agg(F.sum("n").alias("df"))
    return BlockIndex(rows, staged(weights_of(df, F.lit(texts.n)), "terms"), texts.length / texts.n if texts.n else 1.0, shards)


def _impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _walk(mean: float, k: int, first: bool) -> Callable[[pa.Table], pa.Table]:
    """A shard's best texts for every query, or of its ``first`` blocks only; and a row (without a score) that tells how many of its postings were looked at."""

    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        column = {c: data.column(c).chunk(0) for c in data.column_names}
        at = int(np.flatnonzero(column["token"].to_numpy(zero_copy_only=False) == TEXTS)[0])
        ids, lengths = column["ids"][at].values, np.frombuffer(column["packed"][at].as_py(), np.int32)
        packed = column["packed"]
        offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset)
        numbers = np.frombuffer(packed.buffers()[2], np.int32, int(offsets[-1]) // 4)
        base, n, m = offsets[:-1].astype(np.int64) // 4, column["n"].to_numpy().astype(np.int64), column["n_blocks"].to_numpy().astype(np.int64)
        of_block = np.repeat(np.arange(data.num_rows), m)
        begins = np.cumsum(m) - m  # of each row's blocks, among all rows'
        blocks, sizes, most, least = (numbers[_ranges(base + 2 * n + k * m, m)] for k in range(4))
        tops, block_range = _impact(most, least, mean), int(blocks.max(initial=0)) + 1
        before = np.concatenate(([0], np.cumsum(sizes)))
        posting = base[of_block] + before[:-1] - np.repeat(before[begins], m)  # where each block's postings begin
        flat = column["asked"].flatten()
        asked, weights, floors = flat.field(0).dictionary_encode(), flat.field(1).to_numpy(), flat.field(2).to_numpy(zero_copy_only=False)
        of_row = np.repeat(np.arange(data.num_rows), column["asked"].value_lengths().to_numpy())
        codes = asked.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(asked.dictionary) + 1))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        looked = []
        for q, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            mine = order[a:b]
            rows, w = of_row[mine], weights[mine]
            part, weight = _ranges(begins[rows], m[rows]), np.repeat(w, m[rows])
            bound = np.bincount(blocks[part], np.maximum(weight, 0) * tops[part], block_range)
            floor = floors[mine[0]]
            floor = -np.inf if np.isnan(floor) else floor
            ahead = np.argsort(-bound, kind="stable")
            done, step, read = 0, max(4, -(-2 * k // BLOCK)), 0
            found_docs, found = np.empty(0, np.int64), np.empty(0)
            while done < (1 if first else len(ahead)):
                some = ahead[done : done + step]
                some = some[(bound[some] > 0) & (bound[some] >= floor - MARGIN)]
                if not len(some):
                    break
                wanted = np.zeros(block_range, bool)
                wanted[some] = True
                taken = wanted[blocks[part]]
                here, size = part[taken], sizes[part[taken]]
                place = _ranges(posting[here], size)
                doc, tf = numbers[place], numbers[place + np.repeat(n[of_block[here]], size)]
                total = np.bincount(doc, np.repeat(weight[taken], size) * _impact(tf, lengths[doc], mean), len(lengths))
                good = np.flatnonzero(total > 0)
                found_docs, found = np.concatenate((found_docs, good)), np.concatenate((found, total[good]))
                if len(found) >= k:
                    floor = max(floor, np.partition(found, len(found) - k)[len(found) - k])
                    keep = found >= floor - MARGIN
                    found_docs, found = found_docs[keep], found[keep]
                read += len(place)
                done, step = done + step, 2 * step
            keep = found >= floor - MARGIN
            out.append((q, found_docs[keep], found[keep]))
            looked.append((q, read, int(sizes[part].sum())))
        names = pa.array([q for q, d, _ in out for _ in d] + [q for q, *_ in looked], pa.int32())
        place = pa.array([x for _, d, _ in out for x in d.tolist()], pa.int32())
        n = len(place)
        none = pa.nulls(n, pa.int64())
        return pa.table({
            "query_id": asked.dictionary.take(names), "video_id": pa.concat_arrays([ids.take(place), pa.nulls(len(looked), ids.type)]),
            "score": pa.array([x for *_, s in out for x in s.tolist()] + [None] * len(looked), pa.float64()),
            "read": pa.concat_arrays([none, pa.array([r for _, r, _ in looked], pa.int64())]), "postings": pa.concat_arrays([none, pa.array([p for *_, p in looked], pa.int64())]),
        })

    return run


def block_max_search(index: BlockIndex, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best texts with a positive score for ``asked(query_id, token, qtf)``; and ``query_id, read, postings``, what was looked at.

    Words whose weight is negative can only lower a score, so they add nothing to a bound. Asked words
    are a stated query set; a word's queries meet its rows in an equi-join.
    """
    kinds = dict(asked.dtypes)["query_id"], dict(index.rows.dtypes)["ids"][len("array<") : -1]
    wanted = staged(asked.join(index.terms, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight")), "wanted")

    def searched(rows: DataFrame, told: DataFrame, first: bool) -> DataFrame:
        by_word = told.groupBy("token").agg(F.collect_list(F.struct("query_id", "weight", "floor")).alias("asked"))
        named = by_word.unionByName(by_word.sparkSession.createDataFrame([(TEXTS, [])], by_word.schema))
        walked = rows.join(named, "token").groupBy("shard").applyInArrow(_walk(index.mean, k, first), f"query_id {kinds[0]}, video_id {kinds[1]}, score double, read long, postings long")
        return staged(walked, "walked")

    early = index.rows.where(F.expr(f"shard div {PARTS}") % max(1, min(SAMPLED, index.shards // LEAST)) == 0)
    head = searched(early, wanted.withColumn("floor", F.lit(None).cast("double")), True)
    floors = ranked(head.where("score IS NOT NULL"), k=k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    done = searched(index.rows, wanted.join(floors, "query_id", "left"), False)
    found = done.where(F.round("score", 6) > 0).select("query_id", "video_id", "score")
    looked = head.where("score IS NULL").select("query_id", "read", F.lit(0).cast("long").alias("postings")).unionByName(done.where("score IS NULL").select("query_id", "read", "postings"))
    return ranked(found, k=k), looked.groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))
