"""Sum-of-squares packing of tokenised documents into sequences.

Lengths are dealt at random into shards of a fixed size, so each task packs a bounded number of
pieces, whatever their source; a shard's last, badly filled sequences are the only loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import cut, freed, partitions
from .tokencount import DEFAULT, groups, tokenizer_path

CAPACITY = 2048
#: Pieces that one shard packs.
SHARD = 30_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids, ``end_id`` last.

    Documents longer than ``capacity`` are cut into pieces of that length, of which the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(tokenizer_path(tokenizer)), np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple[int | None, int, int, int, int]] = []
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(texts):
                for doc, ids in zip(docs_[a:b], bpe.ids_of([t or "" for t in texts[a:b]]), strict=True):
                    raw = np.concatenate((ids.astype("<u4"), end)).tobytes()
                    n = len(raw) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        out.append((doc, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                        at, k = at + size, k + 1
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, by the sum-of-squares rule.

    With N[g] open bins of residual gap g, a piece goes to the open bin with which the sum of
    N[g]^2 becomes smallest, on a tie to the smallest gap; a bin is opened only where none fits.
    Long pieces come first, so that short ones are left to fill the gaps.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    bins, far = 0, np.int64(1) << 40
    for k in order.tolist():
        size = int(lengths[k])
        if size > capacity:
            raise ValueError("a piece is longer than a sequence")
        gap = 0
        held = counts[size:capacity]
        if held.any():
            # From gap g to g - size: 2 N[g - size] - 2 N[g] + 2; a gap that is filled is not counted any more.
            change = 2 * (counts[: capacity - size] - held) + 2
            change[0] = 1 - 2 * held[0]
            change[held == 0] = far
            best = int(change.argmin())
            gap = best + size
        if gap:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            b, gap = bins, capacity
            bins += 1
        bin_of[k], offset[k] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            counts[gap - size] += 1
    return bin_of, offset


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    Null and empty texts are one piece that holds the end id alone. Repeated rows and rows with a
    null id are packed as often as they occur; an empty table gives no pieces. Texts of any length
    are taken whole; columns other than the id and the text are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, capacity, tokenizer, end_id, id_col, text_col))
    shards = max(1, -(-cutted.count() // shard))
    # By a number of the row, so that equal rows do not meet.
    dealt = cutted.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(max(shards, partitions(spark)), "shard").sortWithinPartitions("shard")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            bins, offsets = pack(rows.column("length").to_numpy(), capacity)
            got = rows.select(names).append_column("sequence_id", pa.array(bins + (number << 32))).append_column("offset", pa.array(offsets))
            return got.to_batches()[0]

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            marks = batch.column(5).to_numpy()
            edges = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and int(marks[a]) != now:
                    yield packed(held, now)
                    held = []
                now = int(marks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(held, now)

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
