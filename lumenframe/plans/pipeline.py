"""The whole retrieval pipeline, one plan for all queries of a task, with the choices that its drivers differ in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as N
from ..operators import align as A
from ..operators import blockmax as M
from ..operators import dense as D
from ..operators import framepass as W
from ..operators import fusion as R
from ..operators import objects as O
from ..operators import rerank as V
from ..operators import select as S
from ..operators import sparse as B
from ..sources.staging import staged


@dataclass(frozen=True)
class Options:
    """How many hits each search gives, what is fused and boosted, and how answers are padded."""

    dense_k: int | None = 100
    sparse_k: int | None = 50
    intent_weights: bool = True
    question_in_keywords: bool = True
    fixed_question_weights: bool = True
    object_boost: bool = True
    verify: bool = True
    diverse_answers: bool = True
    padding_answer: str | None = None
    #: Whether what only the keyword search found has frame scores too.
    sparse_frames: bool = True


#: The drivers: local evaluation, full batch, plain export, interactive search.
LOCAL = Options(20, 20, True, False, False, False, False, False, "none", False)
BATCH = Options()
EXPORT = Options(30, 30, True, False, False, False, False, False, None, False)
INTERACTIVE = Options(10, 10, False, False, False, False, False, False, None, False)


@dataclass(frozen=True)
class Corpus:
    """The tables that queries run over; ``detections`` and ``verdicts`` only where they are asked for."""

    frames: DataFrame
    media: DataFrame
    frame_map: DataFrame
    detections: DataFrame | None = None
    verdicts: DataFrame | None = None


def understood(queries: DataFrame) -> DataFrame:
    """``queries(query_id, task, query, question, events)`` with translation, prompts and intent."""
    english = N.without_stutter(P.translate(N.substitute(F.col("query"))))
    return queries.withColumn("english", english).withColumn("prompts", N.prompts(F.col("english"))).withColumn("intent", N.intent(F.col("query")))


def prompt_vectors(queries: DataFrame, encoder=P.hash_encoder) -> DataFrame:
    rows = queries.select("query_id", F.posexplode("prompts").alias("prompt_idx", "prompt"))
    return rows.select("query_id", "prompt_idx", P.encode(F.col("prompt"), encoder).alias("embedding"))


def _weights(options: Options) -> tuple[Column, Column]:
    is_qa = (F.col("task") == "qa") & F.lit(options.fixed_question_weights)
    pick = lambda name, fixed: F.when(is_qa, fixed).otherwise(F.col(f"intent.{name}") if options.intent_weights else F.lit(1.0))
    return pick("dense_weight", 0.4), pick("sparse_weight", 0.6)


def candidates(queries: DataFrame, corpus: Corpus, options: Options, encoder=P.hash_encoder) -> tuple[DataFrame, DataFrame]:
    """Fused, boosted and verified candidates ``query_id, task, video_id, rank, rrf_score``, and the frame series."""
    known = understood(queries)
    dense_weight, sparse_weight = _weights(options)
    weights = known.select("query_id", "task", dense_weight.alias("dw"), sparse_weight.alias("sw"))
    blocks, files = W.frame_blocks(corpus.frames), W.ship_prompts(prompt_vectors(known, encoder))
    dense = staged(W.top_videos(blocks, files, options.dense_k), "dense")
    words = F.when((F.col("task") == "qa") & F.lit(options.question_in_keywords), F.concat_ws(" ", "query", "question")).otherwise(F.col("query"))
    asked = known.select("query_id", words.alias("query"))
    sparse = M.block_max_search(M.block_index(corpus.media), B.query_terms(asked), options.sparse_k)[0] if options.sparse_k else B.sparse_search(corpus.media, asked)
    fused = R.fused_order(R.reciprocal_rank_fusion(dense.join(weights, "query_id"), sparse.join(weights, "query_id"), F.col("dw"), F.col("sw")))
    ranked = staged(fused.select("query_id", "video_id", "rank", "rrf_score"), "fused")
    seen = ranked if options.sparse_frames else ranked.join(dense, ["query_id", "video_id"], "left_semi")
    series = staged(W.frame_series(blocks, files, seen.select("query_id", "video_id")), "series")
    if options.object_boost and corpus.detections is not None:
        targets = O.targets(known.select("query_id", F.concat_ws(" ", "query", "english").alias("text")))
        boosted = O.reordered(O.boost(ranked, series, corpus.detections, targets))
        ranked = boosted.select("query_id", "video_id", F.col("new_rank").alias("rank"), "rrf_score")
    ranked = ranked.join(weights.select("query_id", "task"), "query_id")
    if options.verify and corpus.verdicts is not None:
        kis, rest = ranked.where("task = 'kis'"), ranked.where("task <> 'kis'")
        checked = V.gated_order(V.verified(kis, corpus.verdicts))
        ranked = checked.select("query_id", "video_id", F.col("new_rank").alias("rank"), "rrf_score", "task").unionByName(rest)
    return ranked, series


def search(corpus: Corpus, text: str, k: int = 5, encoder=P.hash_encoder) -> DataFrame:
    """The interactive driver: ``video_id, rank, rrf_score, best_frame, dense_score`` of the first ``k`` (1 to 20) videos for one text."""
    query = corpus.frames.sparkSession.createDataFrame([("q", "kis", text, "", [])], "query_id string, task string, query string, question string, events array<string>")
    ranked, series = candidates(query, corpus, INTERACTIVE, encoder)
    best = D.video_peaks(series).select("query_id", "video_id", "best_frame", F.col("score").alias("dense_score"))
    return ranked.where(F.col("rank") <= max(1, min(20, k))).join(best, ["query_id", "video_id"], "left").select("video_id", "rank", "rrf_score", "best_frame", "dense_score")


def predictions(queries: DataFrame, corpus: Corpus, options: Options = BATCH, encoder=P.hash_encoder, verifier=P.hash_verifier) -> DataFrame:
    """From queries to what is handed in: ``task, query_id, rank, video_id, frame_id, answer, frame_ids``.

    ``queries(query_id, task, query, question, events)`` of all tasks go through one search; scenes
    get frames, questions the answer of the best of four videos, event sequences a frame an event.
    """
    ranked, series = candidates(queries, corpus, options, encoder)
    ranked = staged(ranked, "ranked")
    none, no_frames = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    out = scenes(ranked, series, corpus).select(F.lit("kis").alias("task"), "query_id", "rank", "video_id", "frame_id", none.alias("answer"), no_frames.alias("frame_ids"))
    asked = ranked.where("task = 'qa'").where(F.col("rank") <= V.ANSWERED).join(queries.select("query_id", "question"), "query_id")
    best = S.peak_frames(S.gaussian_smoothed(series))
    told = asked.join(S.frame_ids(best, corpus.frame_map).select("query_id", "video_id", "frame_id"), ["query_id", "video_id"], "left")
    said = N.clean_opening(P.verify(F.concat_ws(" ", N.neutral_question(F.col("question")), "video_id", "frame_id"), verifier), F.coalesce("question", F.lit("")))
    answered = told.select("query_id", "rank", "video_id", F.coalesce("frame_id", F.lit("0000")).alias("frame_id"), N.finish_answer(P.without_openings(said)).alias("answer"))
    found = answers(ranked, series, corpus, staged(answered, "answered"), options)
    out = out.unionByName(found.select(F.lit("qa").alias("task"), "query_id", "rank", "video_id", "frame_id", "answer", no_frames.alias("frame_ids")))
    lengths = queries.where("task = 'trake'").select(F.size("events").alias("n")).where("n > 0").distinct().sort("n")
    for n in (r.n for r in lengths.collect()):  # one plan for all sequences of a length
        rows = sequences(ranked, queries, corpus, n, encoder)
        out = out.unionByName(rows.select(F.lit("trake").alias("task"), "query_id", "rank", "video_id", none.alias("frame_id"), none.alias("answer"), "frame_ids"))
    return out


def scenes(ranked: DataFrame, series: DataFrame, corpus: Corpus) -> DataFrame:
    """Known-item predictions: up to a hundred frames a query."""
    return S.diverse_predictions(ranked.where("task = 'kis'").select("query_id", "video_id", "rank"), S.gaussian_smoothed(series), corpus.frame_map)


def answers(ranked: DataFrame, series: DataFrame, corpus: Corpus, answered: DataFrame, options: Options) -> DataFrame:
    """Answer predictions from ``answered(query_id, rank, video_id, frame_id, answer)`` of the first candidates."""
    asked = ranked.where("task = 'qa'").select("query_id", "video_id", "rank")
    best = V.best_answers(answered)
    if not options.diverse_answers:
        return V.answer_predictions(best, asked, options.padding_answer)
    moved = V.promoted(asked, best).select("query_id", "video_id", F.col("new_rank").alias("rank"))
    frames = S.diverse_predictions(moved, S.gaussian_smoothed(series), corpus.frame_map)
    return frames.join(best.select("query_id", "answer"), "query_id", "left")


def sequences(ranked: DataFrame, queries: DataFrame, corpus: Corpus, n_events: int, encoder=P.hash_encoder) -> DataFrame:
    """Event-sequence predictions of the queries that have ``n_events`` events."""
    some = queries.where((F.col("task") == "trake") & (F.size("events") == n_events))
    events = some.select("query_id", F.posexplode("events").alias("event_idx", "event")).select("query_id", "event_idx", P.encode(P.translate(F.col("event")), encoder).alias("embedding"))
    wanted = ranked.join(some.select("query_id"), "query_id", "left_semi").select("query_id", "video_id", "rank")
    return A.aligned_predictions(wanted, A.event_scores(corpus.frames, events), n_events, corpus.frame_map)
