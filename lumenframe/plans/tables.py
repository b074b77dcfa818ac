"""The engine's tables, derived from the generic ones; each has a SQL twin of the same name.

``embeddings`` stand for frames (so many in a row are a video), ``documents`` for media texts,
``benchmark`` for queries, ``events`` for detections. Prompts are vectors made by a rule, three for
every query. No video grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROMPTS, DIMS = 3, 64
#: Frames and texts of a video, detections of a frame.
FRAMES_A_VIDEO, TEXTS_A_VIDEO, DETECTIONS_A_FRAME = 50, 100, 5
EVENTS = ("view", "click", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video_of(column: str, size: int) -> Column:
    return F.concat(F.lit("v"), F.expr(f"{column} div {size}"))


def rounded(x: Column, digits: int = 6) -> Column:
    """As SQL rounds: small negative numbers become negative zeros, which Spark's ``round`` has none of."""
    return F.signum(x) * F.abs(F.round(x, digits))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("video_id", video_of("vec_id", FRAMES_A_VIDEO))
    return rows.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1).alias("frame_idx"), "embedding")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component i of prompt p of benchmark item q: ((i (7q + 3p + 1) + p) mod 11 - 5) / 10."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(PROMPTS - 1))).alias("p"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: ((i * (7 * F.col("q") + 3 * F.col("p") + 1) + F.col("p")) % 11 - 5) / F.lit(10.0))
    return rows.select(F.concat(F.lit("q"), "q").alias("query_id"), F.col("p").alias("prompt_idx"), vector.alias("embedding"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def media_of_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined into videos, of so many each."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]), " ")
    return table(spark, sf_dir, "documents").groupBy(video_of("doc_id", TEXTS_A_VIDEO).alias("video_id")).agg(text.alias("text"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many in a row are a frame's, as so many frames are a video's: no key grows with the table."""
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    frame = F.expr(f"CAST(event_id div {DETECTIONS_A_FRAME} % {FRAMES_A_VIDEO} AS INT)")
    return rows.select(video_of("event_id", FRAMES_A_VIDEO * DETECTIONS_A_FRAME).alias("video_id"), frame.alias("frame_idx"), F.col("event_type").alias("entity"), (F.col("event_id") % 100 / 100.0).alias("score"))


def frame_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original frame numbers, for even places only: what has none is estimated."""
    return frames(spark, sf_dir).where("frame_idx % 2 = 0").select("video_id", "frame_idx", (F.col("frame_idx") * 25 + 3).cast("long").alias("frame_id"))


FRAMES_SQL = f"""frames AS (
    SELECT 'v' || (vec_id // {FRAMES_A_VIDEO}) AS video_id, CAST(row_number() OVER (PARTITION BY vec_id // {FRAMES_A_VIDEO} ORDER BY vec_id) - 1 AS INTEGER) AS frame_idx,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), unit_frames AS (
    SELECT video_id, frame_idx, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) = 0 THEN 1e-10 ELSE sqrt(list_dot_product(e, e)) END) AS e FROM frames
)"""
PROMPTS_SQL = f"""raw_prompts AS (
    SELECT q, p, list_transform(range({DIMS}), lambda i: ((i * (7 * q + 3 * p + 1) + p) % 11 - 5) / CAST(10 AS DOUBLE)) AS e
    FROM (SELECT item_id AS q FROM benchmark), range({PROMPTS}) b(p)
), prompts AS (
    SELECT 'q' || q AS query_id, CAST(p AS INTEGER) AS prompt_idx, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM raw_prompts
)"""
SIMILARITY_SQL = f"""{FRAMES_SQL}, {PROMPTS_SQL}, sims AS (
    SELECT query_id, prompt_idx, video_id, frame_idx, list_dot_product(f.e, p.e) AS score FROM unit_frames f, prompts p
), fused AS (
    SELECT query_id, video_id, frame_idx, 0.5 * max(score) + 0.5 * avg(score) AS score FROM sims GROUP BY ALL
)"""


def convolution_sql(source: str, name: str, weights: tuple[float, ...]) -> str:
    half = len(weights) // 2
    terms = " + ".join(f"{w!r} * coalesce({'lag' if k < 0 else 'lead'}(score, {abs(k)}) OVER w, 0)" if k else f"{w!r} * score" for k, w in zip(range(-half, half + 1), weights, strict=True))
    return f"(SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id, video_id) >= 3 THEN {terms} ELSE score END AS {name} FROM {source} WINDOW w AS (PARTITION BY query_id, video_id ORDER BY frame_idx))"

