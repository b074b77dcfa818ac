"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are dealt into blocks of a bounded size, each of which goes to one task and sorts every
dimension once; queries follow it there and are streamed through. A query walks all lists of a
block in step, best contribution first, scores whatever it meets in full, and stops as soon as no
unseen vector of the block can reach its kth score. Blocks give k rows a query each, of which the
best k are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, partitions

#: Vectors of a block at most, and at least where there are fewer blocks than tasks.
BLOCK, LEAST = 1 << 15, 1 << 12
#: Depth of the first round; each further round doubles it.
FIRST = 32
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` with ``v = floor(scale * x)``; rows without an id, null vectors and vectors with a null or non-finite component are left out."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("w")).where("vec_id IS NOT NULL AND w IS NOT NULL")
    rows = rows.where(~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return rows.select("vec_id", F.transform("w", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


class Lists:
    """A block of vectors, and each dimension's order of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.largest = float(np.abs(vectors.astype(float)).max(initial=0))
        self.tables: dict = {}

    def table(self, kind: type) -> np.ndarray:
        if kind not in self.tables:
            self.tables[kind] = self.vectors.astype(kind)
        return self.tables[kind]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """``(query, vector, score)`` of each query's best ``k`` rows in this block, ties to the smaller id, its own id left out."""
        n, dims = self.vectors.shape
        top = self.largest * float(np.abs(queries.astype(float)).max(initial=0)) * max(dims, 1)
        kind = np.float64 if top < 2**52 else object  # floats hold these integers exactly
        ids, order, table, asks = self.ids, self.order, self.table(kind), queries.astype(kind)
        out: list[tuple[int, int, int]] = []
        for own, query in zip(query_ids.tolist(), asks, strict=True):
            used = np.flatnonzero(query)
            rising = query[used] < 0
            unseen = ids != own
            got_ids, got = np.empty(0, np.int64), np.empty(0, kind)
            depth, step = 0, FIRST
            while True:
                to = min(n, depth + step)
                rows = np.concatenate((order[depth:to, used[rising]].ravel(), order[n - to : n - depth, used[~rising]].ravel())) if len(used) else np.arange(n)
                fresh = np.zeros(n, bool)
                fresh[rows] = True
                fresh &= unseen
                unseen &= ~fresh
                at = np.flatnonzero(fresh)
                if len(at):
                    got, got_ids = np.concatenate((got, table[at] @ query)), np.concatenate((got_ids, ids[at]))
                    if len(got) > k:
                        best = np.lexsort((got_ids, -got))[:k]
                        got, got_ids = got[best], got_ids[best]
                if to == n or not len(used) or not unseen.any():
                    break
                last = np.where(rising, table[order[to - 1, used], used], table[order[n - to, used], used])
                if len(got) == k and got[-1] > (last * query[used]).sum():  # an equal score could still have a smaller id
                    break
                depth, step = to, step * 2
            best = np.lexsort((got_ids, -got))[:k]
            out += [(own, int(got_ids[b]), min(max(int(got[b]), -(1 << 63)), (1 << 63) - 1)) for b in best.tolist()]
        return out


def top_k(vectors: DataFrame, query_every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries: rows whose id is divisible by ``query_every``.

    Scores are integer inner products of the quantised vectors; ties go to the smaller id. Rows
    that have a query's id are not its candidates. A query id that occurs in several rows is asked
    once, with the smallest of its vectors. Vectors of different lengths do not meet. Null ids
    and vectors that are null or hold a null or non-finite component take no part. Components and
    scores beyond 64 bits are the nearest number of 64 bits; within a block, scores are ranked before
    that. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vector_col).withColumn("dims", F.size("v"))
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id", "dims").agg(F.min("v").alias("v"))
    n = rows.count()
    blocks = max(1, -(-n // block), min(partitions(spark), -(-n // least)))
    # Rows are dealt by their number, so that equal rows do not meet; queries go to every block, behind its vectors.
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "dims", F.lit(0).alias("asks"), "vec_id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dims", F.lit(1).alias("asks"), "vec_id", "v")
    spread = dealt.unionByName(every).repartition(max(blocks, partitions(spark)), "block").sortWithinPartitions("block", "dims", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                where, dims, asks = tuple(keys[a, :2].tolist()), int(keys[a, 1]), int(keys[a, 2])
                if where != now:
                    now, held, lists = where, [], None
                part = batch.slice(a, b - a)
                ids, matrix = part.column(3).to_numpy(), part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dims)
                if not asks:
                    held.append((ids, matrix))
                elif held or lists:
                    if lists is None:
                        lists = Lists(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held = []
                    cols = list(zip(*lists.search(ids, matrix, k), strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query_id", "vec_id", "score"])

    near = spread.mapInArrow(freed(search), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
