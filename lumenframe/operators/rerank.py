"""Re-ranking of the first candidates by verification scores, and multi-candidate answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_score

#: Candidates that are verified; score that keeps the first; score without a picture; weight of a verification.
VERIFIED, KEEP_FIRST, NO_PICTURE, WEIGHT = 5, 5.5, 5.0, 0.08
ANSWERED = 4


def verified(candidates: DataFrame, frame_verdicts: DataFrame, first: int = VERIFIED) -> DataFrame:
    """``vlm_score`` and ``boosted_score`` of the first candidates: the best verdict of their frames, null for the rest."""
    best = frame_verdicts.groupBy("query_id", "video_id").agg(F.max("verdict").alias("best"))
    score = F.when(F.col("rank") <= first, F.coalesce("best", F.lit(NO_PICTURE)))
    joined = candidates.join(best, ["query_id", "video_id"], "left").withColumn("vlm_score", score).drop("best")
    return joined.withColumn("boosted_score", F.col("rrf_score") + (F.col("vlm_score") - 5.0) / 10.0 * WEIGHT)


def gated_order(scored: DataFrame, first: int = VERIFIED) -> DataFrame:
    """``new_rank``: a first candidate of 5.5 or more stays first; the verified ones by boosted score, the rest as they are."""
    group = F.when((F.col("rank") == 1) & (F.col("vlm_score") >= KEEP_FIRST), 0).when(F.col("rank") <= first, 1).otherwise(2)
    boosted = F.when(group == 1, F.round("boosted_score", 9))
    order = Window.partitionBy("query_id").orderBy(group, F.desc_nulls_last(boosted), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))


def best_answers(answers: DataFrame, first: int = ANSWERED) -> DataFrame:
    """The most confident answer of the first candidates; ties to the earlier one. ``answers(query_id, rank, video_id, frame_id, answer)``, rank from 1."""
    scored = answers.where(F.col("rank") <= first).withColumn("quality", answer_score(F.col("answer"), F.col("rank") - 1))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("rank", "video_id", "frame_id", "answer", "quality"), F.struct("quality", -F.col("rank"))).alias("b"))
    return best.select("query_id", (F.col("b.rank") - 1).alias("promoted_idx"), "b.video_id", "b.frame_id", "b.answer", "b.quality")


def promoted(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """The winner moves to the front, others keep their order."""
    marked = candidates.join(winners.select("query_id", (F.col("promoted_idx") + 1).alias("won")), "query_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce((F.col("rank") != F.col("won")).cast("int"), F.lit(1)), "rank")
    return marked.withColumn("new_rank", F.row_number().over(order)).drop("won")


def answer_predictions(winners: DataFrame, candidates: DataFrame, padding_answer: str | None = "none") -> DataFrame:
    """Best answer first, then all candidates but the first with frame 0000; ``padding_answer`` None repeats the best answer."""
    rest = candidates.where("rank > 1").join(winners.select("query_id", F.col("answer").alias("a")), "query_id")
    rest = rest.select("query_id", "rank", "video_id", F.lit("0000").alias("frame_id"), (F.lit(padding_answer) if padding_answer is not None else F.col("a")).alias("answer"))
    return winners.select("query_id", F.lit(1).alias("rank"), "video_id", "frame_id", "answer").unionByName(rest)
