"""Weighted reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, dense_weight: Column | float = 1.0, sparse_weight: Column | float = 1.0, k: int = RRF_K) -> DataFrame:
    """``query_id, video_id, rrf_score, dense_rank, sparse_rank``: sum of weight / (k + rank) over both lists, ranks from 1.

    A union and one grouping stand for the full outer join; a video that a list holds twice counts twice.
    """

    def part(df: DataFrame, weight: Column | float, name: str) -> DataFrame:
        other = "sparse_rank" if name == "dense_rank" else "dense_rank"
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        return df.select("query_id", "video_id", (weight / (k + F.col("rank"))).alias("w"), F.col("rank").alias(name), F.lit(None).cast("int").alias(other))

    both = part(dense, dense_weight, "dense_rank").unionByName(part(sparse, sparse_weight, "sparse_rank"))
    return both.groupBy("query_id", "video_id").agg(F.sum("w").alias("rrf_score"), F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))


def attach_dense(fused: DataFrame, dense: DataFrame) -> DataFrame:
    """Best frame and dense score of every fused video, also of those only the keyword list holds."""
    return fused.join(dense.select("query_id", "video_id", "best_frame", F.col("score").alias("dense_score")), ["query_id", "video_id"], "left")


def fused_order(fused: DataFrame, k: int | None = None) -> DataFrame:
    """``rank`` from 1 by score; ties in the dense list's order, then in the keyword list's."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 9)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "video_id")
    out = fused.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out
