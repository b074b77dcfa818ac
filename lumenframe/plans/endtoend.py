"""Registered queries of whole runs, from queries to predictions, and of what prepares them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as N
from ..sources import files as S
from ..sources import sinks as K
from . import pipeline as L
from . import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _corpus(spark: SparkSession, sf: str) -> L.Corpus:
    return L.Corpus(T.frames(spark, sf), T.media_of_videos(spark, sf), T.frame_map(spark, sf), T.detections(spark, sf))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as scenes, questions and sequences of three events in turn."""
    task = F.element_at(F.array(F.lit("kis"), F.lit("qa"), F.lit("trake")), (F.col("item_id") % 3 + 1).cast("int"))
    events = F.array(*[F.substring("text", at, 40) for at in (1, 41, 81)])
    rows = T.table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), task.alias("task"), F.col("text").alias("query"), events.alias("e"))
    question = F.when(F.col("task") == "qa", "màu gì?").otherwise("")
    return rows.select("query_id", "task", "query", question.alias("question"), F.when(F.col("task") == "trake", F.col("e")).otherwise(F.array().cast("array<string>")).alias("events"))


@register("P2_query_to_predictions")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks in one call, by stand-in models: search, boosting, frames, answers and sequences."""
    return L.predictions(_queries(spark, sf), _corpus(spark, sf))


@register("K9_interactive_search")
def k9(spark: SparkSession, sf: str) -> DataFrame:
    return L.search(_corpus(spark, sf), "a dog with a cup", 5)


@register("D10_picture_features", """WITH p AS (SELECT 'v' || (page_id // 50) AS video_id, lpad(CAST(page_id AS VARCHAR), 8, '0') || '.jpg' AS path FROM pages WHERE page_id % 7 <> 3 AND html <> '')
    SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY path) - 1 AS INTEGER) AS frame_idx, path, CAST(64 AS INTEGER) AS dims, CAST(1 AS DOUBLE) AS norm FROM p""")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' bytes stand for pictures; every seventh is empty, fails and lets those behind it move up."""
    content = F.when(F.col("page_id") % 7 == 3, F.lit(b"")).otherwise(F.col("html").cast("binary"))
    pictures = T.table(spark, sf, "pages").select(T.video_of("page_id", 50).alias("video_id"), F.concat(F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("path"), content.alias("content"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return S.picture_features(pictures).select("video_id", "frame_idx", "path", F.size("embedding").alias("dims"), F.round(norm, 5).alias("norm"))


DOMAINS = {"que": "people who talk", "the": "a street", "die": "a hall"}


@register("Q15_domain_prompts", "WITH t AS (SELECT item_id, ' ' || lower(text) || ' ' AS x FROM benchmark) SELECT item_id, " + "list_concat(".join(["", *[""] * (len(DOMAINS) - 1)]) + ", ".join(
    f"CASE WHEN regexp_matches(x, '[^\\p{{L}}\\p{{N}}_]{w}[^\\p{{L}}\\p{{N}}_]') THEN ['{d}', 'a photo of {d}', 'a video scene of {d}'] ELSE CAST([] AS VARCHAR[]) END" + (")" if k else "") for k, (w, d) in enumerate(DOMAINS.items())
) + " AS prompts, 0 AS without FROM t")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    """With words that are known to show something; the map that is given has none, and adds nothing."""
    none = F.array().cast("array<string>")
    return T.table(spark, sf, "benchmark").select("item_id", N.with_domain_prompts(none, F.col("text"), DOMAINS).alias("prompts"), F.size(N.with_domain_prompts(none, F.col("text"))).alias("without"))


@register("K7_frame_texts", """WITH t AS (SELECT conv_id AS video_id, turn, min(text) AS text FROM conversations GROUP BY ALL)
    SELECT video_id, '{' || string_agg('"' || turn || '":' || CAST(to_json(coalesce(text, '')) AS VARCHAR), ',' ORDER BY turn) || '}' AS json FROM t GROUP BY ALL""")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations stand for videos whose frames hold text."""
    return K.frame_texts_json(T.table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_id"), "text"))
