"""Object detections: target classes of a query, their weights, and candidate boosting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions.text import contains_any
from ..sources.staging import staged
from .keywords import keyword_hits

BOOSTED, FRAMES = 30, 12
#: No weight reaches it, so the bonus for a matched subject is never paid; kept as the rule is stated.
TIER1_MATCH_THRESHOLD = 4.0


def targets(texts: DataFrame) -> DataFrame:
    """``query_id, entity``: distinct classes that ``texts(query_id, text)`` ask for, by keyword and by English class names.

    A keyword of several meanings is no hit where only others of them are spoken of.
    """
    lexicon = lexicon_table(texts.sparkSession)
    classes = [c for c in X.CLASSES if re.fullmatch("[a-z]{3,}", c)]
    words = texts.sparkSession.createDataFrame([(c,) for c in classes], "keyword string")
    hits = keyword_hits(texts, lexicon.select("keyword").unionByName(words))
    low = F.lower("text")
    other = [F.when(contains_any(low, others) & ~contains_any(low, cues), keyword) for keyword, (others, cues) in X.HOMONYMS.items()]
    meant = hits.join(texts.select("query_id", F.explode(F.array_compact(F.array(*other))).alias("keyword")), ["query_id", "keyword"], "left_anti")
    named = meant.join(lexicon, "keyword").select("query_id", "entity")
    return named.unionByName(hits.where(F.col("keyword").isin(*classes)).select("query_id", F.col("keyword").alias("entity"))).distinct()


def target_lists(texts: DataFrame) -> DataFrame:
    """``query_id, entities``: the same as a sorted list for every text."""
    found = targets(texts).groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return texts.select("query_id").join(found, "query_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def saliency(entity: Column) -> Column:
    e = F.lower(F.trim(entity))
    return F.when(e.isin(*X.GENERIC), X.GENERIC_WEIGHT).when(e.isin(*X.PROPS), X.PROP_WEIGHT).otherwise(X.SUBJECT_WEIGHT)


def tiers(entities: Column) -> Column:
    """``struct(tier1, tier2, tier3)`` of sorted classes."""
    within = lambda low, high: F.filter(entities, lambda e: (saliency(e) >= low) & (saliency(e) < high))
    return F.struct(within(3.0, 99.0).alias("tier1"), within(1.5, 3.0).alias("tier2"), within(0.0, 1.5).alias("tier3"))


def lexicon_table(spark: SparkSession) -> DataFrame:
    """``keyword, entity``."""
    return spark.createDataFrame([(k, e.lower()) for k, es in X.ENTITIES.items() for e in es], "keyword string, entity string")


def boost(candidates: DataFrame, frame_scores: DataFrame, detections: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with detections of target classes gain, those without a wanted subject lose.

    ``candidates(query_id, video_id, rank, rrf_score)``, ``frame_scores(query_id, video_id,
    frame_idx, score)``, ``detections(video_id, frame_idx, entity, score)``, ``targets(query_id,
    entity)``; gives ``query_id, video_id, rank, rrf_score, best_frame, max_score, bonus``. Only the
    first 30 candidates with frames and detections, and their 12 best frames, are looked at.
    """
    keys = ["query_id", "video_id"]
    candidates = staged(candidates, "candidates")
    head = candidates.where(F.col("rank") <= BOOSTED).select(*keys, "rrf_score")
    seen = detections.select("video_id").distinct()
    wants = targets.groupBy("query_id").agg(F.max((saliency(F.col("entity")) >= 3.0).cast("int")).alias("wants_subject"))
    frames = staged(frame_scores.join(head, keys).join(seen, "video_id", "left_semi").join(wants, "query_id"), "frames")
    best_first = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), F.desc("frame_idx"))
    top = frames.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= FRAMES).select(*keys, "frame_idx")
    objects = detections.select("video_id", "frame_idx", F.lower("entity").alias("entity"), F.col("score").alias("confidence"))
    matched = top.join(objects, ["video_id", "frame_idx"]).join(targets, ["query_id", "entity"], "left_semi").withColumn("weight", saliency(F.col("entity")))
    by_frame = matched.groupBy(*keys, "frame_idx").agg(F.sum(F.col("confidence") * F.col("weight") / 2).alias("m"))
    by_video = matched.groupBy(*keys).agg(F.countDistinct("entity").alias("kinds"), F.max((F.col("weight") >= TIER1_MATCH_THRESHOLD).cast("int")).alias("subject"))
    bonuses = by_frame.where("m > 0").groupBy(*keys).agg(F.sum(F.col("m") * 0.04).alias("frame_bonus"))
    lifted = frames.join(by_frame, [*keys, "frame_idx"], "left").withColumn("score", F.col("score") * (1 + 0.12 * F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0))))
    peak = lifted.groupBy(*keys).agg(
        F.max_by(F.struct("frame_idx", "score"), F.struct(F.round("score", 9), -F.col("frame_idx"))).alias("p"),
        F.first("wants_subject").alias("wants_subject"),
    )
    gate = F.when(F.col("rrf_score") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.4), F.col("rrf_score") * 15))).otherwise(F.lit(0.5))
    kinds, subject = F.coalesce("kinds", F.lit(0)), F.coalesce("subject", F.lit(0)) == 1
    bonus = F.coalesce("frame_bonus", F.lit(0.0)) + F.when(kinds >= 2, 0.15 * kinds).otherwise(0.0) + F.when(subject, 0.25 * gate).when(F.col("wants_subject") == 1, -0.08 * gate).otherwise(0.0)
    joined = candidates.join(peak, keys, "left").join(bonuses, keys, "left").join(by_video, keys, "left")
    added = F.when(F.col("p").isNotNull(), bonus)
    return joined.select(*keys, "rank", (F.col("rrf_score") + F.coalesce(added * gate, F.lit(0.0))).alias("rrf_score"), F.col("p.frame_idx").alias("best_frame"), F.col("p.score").alias("max_score"), added.alias("bonus"))


def reordered(boosted: DataFrame) -> DataFrame:
    """By the new score; ties keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 9)), "rank")
    return boosted.withColumn("new_rank", F.row_number().over(order))
