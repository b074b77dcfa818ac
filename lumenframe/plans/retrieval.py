"""Registered queries of retrieval: dense, keyword, fusion, detections, selection and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions.text import raw_words, tokens, tokens_of
from ..operators import align as A
from ..operators import blockmax as M
from ..operators import dense as D
from ..operators import framepass as P
from ..operators import fusion as R
from ..operators import nearest as K
from ..operators import objects as O
from ..operators import select as S
from ..operators import sparse as B
from ..sources.staging import staged
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


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: T.rounded(F.col(c)) for c in columns})


def long(*columns: str) -> dict:
    return {c: F.col(c).cast("long") for c in columns}


SMOOTH_SQL = f"{T.SIMILARITY_SQL}, smooth AS {T.convolution_sql('fused', 'smooth', D.KERNEL)}"
GAUSS_SQL = f"{T.SIMILARITY_SQL}, gauss AS {T.convolution_sql('fused', 'gauss', D.gaussian())}"
PEAKS_SQL = f"""{SMOOTH_SQL}, peaks AS (
    SELECT query_id, video_id, frame_idx AS best_frame, n AS n_frames, CASE WHEN n >= 3 THEN {D.SMOOTH_SHARE} * smooth + {1 - D.SMOOTH_SHARE} * score ELSE score END AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(smooth, 9) DESC, frame_idx) AS k, count(*) OVER (PARTITION BY query_id, video_id) AS n FROM smooth) WHERE k = 1
), dense AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, video_id) AS rank FROM peaks
)"""
#: Words as both dialects find them; unfiltered where nothing but stop-words is left.
WORDS_SQL = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def tokens_sql(column: str) -> str:
    words = WORDS_SQL.format(column)
    kept = f"list_filter({words}, lambda w: NOT list_contains({STOP_LIST}, w) AND length(w) > 1)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END"


def bm25_sql(media: str, queries: str) -> str:
    return f"""counted AS MATERIALIZED (SELECT video_id, token, count(*) AS tf FROM (SELECT video_id, unnest({WORDS_SQL.format('text')}) AS token FROM {media}) GROUP BY ALL),
    judged AS MATERIALIZED (SELECT c.*, s.word IS NULL AND length(token) > 1 AS good FROM counted c LEFT JOIN (SELECT DISTINCT unnest({STOP_LIST}) AS word) s ON s.word = c.token),
    sized AS (SELECT video_id, bool_or(good) AS any_good, CAST(coalesce(sum(tf) FILTER (good), sum(tf)) AS BIGINT) AS dl FROM judged GROUP BY ALL),
    post AS MATERIALIZED (SELECT video_id, token, tf, dl FROM judged JOIN sized USING (video_id) WHERE good OR NOT any_good),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT video_id, max(dl) AS dl FROM post GROUP BY ALL)),
    raw_idf AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM post GROUP BY ALL), corpus),
    terms AS (SELECT token, df, CASE WHEN raw < 0 THEN {B.EPSILON} * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf),
    asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query')}) AS token FROM {queries}) GROUP BY ALL),
    bm25 AS (SELECT query_id, video_id, sum(qtf * idf * tf * {B.K1 + 1} / (tf + {B.K1} * ({1 - B.B} + {B.B} * dl / avgdl))) AS score
             FROM post JOIN terms USING (token) JOIN asked USING (token), corpus GROUP BY ALL),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, video_id) AS rank FROM bm25 WHERE round(score, 6) > 0)"""


MEDIA_SQL = "media AS (SELECT doc_id AS video_id, text FROM documents), queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
BM25_SQL = f"{MEDIA_SQL}, {bm25_sql('media', 'queries')}"


# ---- dense


@register("D1_normalize", f"WITH {T.FRAMES_SQL} SELECT video_id, frame_idx, list_transform(e, lambda x: round(x, 6)) AS embedding FROM unit_frames")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return D.normalised(T.frames(spark, sf)).withColumn("embedding", F.transform("embedding", lambda x: T.rounded(x)))


@register("D3_mean_query", f"""WITH {T.PROMPTS_SQL}, dims AS (SELECT query_id, i, avg(e[i + 1]) AS x FROM prompts, range({T.DIMS}) t(i) GROUP BY ALL),
    m AS (SELECT query_id, list(x ORDER BY i) AS v FROM dims GROUP BY ALL) SELECT query_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS embedding FROM m""")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return D.mean_query(D.normalised(T.prompts(spark, sf))).withColumn("embedding", F.transform("embedding", lambda x: T.rounded(x)))


def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    return D.similarity(T.frames(spark, sf), T.prompts(spark, sf))


def _dense(spark: SparkSession, sf: str, k: int | None = None) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Ranked videos, and the blocks and prompts that series are made of."""
    blocks, files = P.frame_blocks(T.frames(spark, sf)), P.ship_prompts(T.prompts(spark, sf))
    return P.top_videos(blocks, files, k), blocks, files


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return P.frame_series(P.frame_blocks(T.frames(spark, sf)), P.ship_prompts(T.prompts(spark, sf)))


def _gauss(spark: SparkSession, sf: str) -> DataFrame:
    return S.gaussian_smoothed(_series(spark, sf).drop("smooth"))


@register("D4_similarity", f"WITH {T.SIMILARITY_SQL} SELECT query_id, prompt_idx, video_id, frame_idx, round(score, 6) AS score FROM sims")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_similarity(spark, sf), "score")


@register("D5_prompt_fusion", f"WITH {T.SIMILARITY_SQL} SELECT query_id, video_id, frame_idx, round(score, 6) AS score FROM fused")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_series(spark, sf).drop("smooth"), "score")


@register("D6_smooth5", f"WITH {SMOOTH_SQL} SELECT query_id, video_id, frame_idx, round(score, 6) AS score, round(smooth, 6) AS smooth FROM smooth")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_series(spark, sf), "score", "smooth")


@register("D7_video_peak", f"WITH {PEAKS_SQL} SELECT query_id, video_id, best_frame, n_frames, round(score, 6) AS score FROM peaks")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return r6(P.peaks_of(P.frame_blocks(T.frames(spark, sf)), P.ship_prompts(T.prompts(spark, sf))), "score")


@register("D8_topk_videos", f"WITH {PEAKS_SQL} SELECT query_id, rank, video_id, best_frame, round(score, 6) AS score FROM dense WHERE rank <= 5")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_dense(spark, sf, 5)[0], "score").select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", "best_frame", "score")


@register("D9_frame_series", f"WITH {PEAKS_SQL} SELECT query_id, rank, video_id, frame_idx, round(s.score, 6) AS score FROM dense d JOIN smooth s USING (query_id, video_id) WHERE rank <= 3")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    hits, blocks, files = _dense(spark, sf, 3)
    hits = staged(hits.select("query_id", "video_id", F.col("rank").cast("long").alias("rank")), "hits")
    return r6(hits.join(P.frame_series(blocks, files, hits).drop("smooth"), ["query_id", "video_id"]), "score")


@register("D11_knn", f"""WITH {T.SIMILARITY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, prompt_idx ORDER BY round(score, 6) DESC, video_id || '/' || lpad(CAST(frame_idx AS VARCHAR), 8, '0')) AS rank FROM sims)
    SELECT query_id, prompt_idx, rank, video_id, frame_idx, round(score, 6) AS score FROM r WHERE rank <= 10""")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    near = K.nearest(K.pivot_index(T.frames(spark, sf)), T.prompts(spark, sf), 10)[0]
    return r6(near, "score").select("query_id", "prompt_idx", F.col("rank").cast("long").alias("rank"), "video_id", "frame_idx", "score")


# ---- keywords


@register("B1_tokens", f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token FROM t")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    t = T.table(spark, sf, "documents").select("doc_id", raw_words(F.col("text")).alias("w")).select("doc_id", tokens_of(F.col("w")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


@register("B2_term_stats", f"WITH {BM25_SQL} SELECT token, df, round(idf, 6) AS idf FROM terms")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return r6(B.term_statistics(B.postings(T.media(spark, sf))), "idf")


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    post = B.postings(T.media(spark, sf))
    return B.bm25(post, B.term_statistics(post), B.query_terms(T.text_queries(spark, sf), tokens(F.col("query"))))


@register("B3_bm25", f"WITH {BM25_SQL} SELECT query_id, video_id, round(score, 5) AS score FROM bm25")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).withColumn("score", T.rounded(F.col("score"), 5))


@register("B7_bm25_topk", f"WITH {BM25_SQL} SELECT query_id, rank, video_id, round(score, 5) AS score FROM sparse WHERE rank <= 20")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    asked = B.query_terms(T.text_queries(spark, sf), tokens(F.col("query")))
    top = M.block_max_search(M.block_index(T.media(spark, sf)), asked, 20)[0]
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", T.rounded(F.col("score"), 5).alias("score"))


# ---- fusion: the videos' frames and joined texts; text query n is prompt query n

VIDEO_QUERIES = "video_queries AS (SELECT 'q' || item_id AS query_id, text AS query FROM benchmark)"
VIDEO_MEDIA = f"video_media AS (SELECT 'v' || (doc_id // {T.TEXTS_A_VIDEO}) AS video_id, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY ALL)"
FUSED_SQL = f"""{PEAKS_SQL}, {VIDEO_QUERIES}, {VIDEO_MEDIA}, {bm25_sql('video_media', 'video_queries')}, parts AS (
    SELECT query_id, video_id, 0.75 / (60 + rank) AS w, rank AS dense_rank, NULL AS sparse_rank FROM dense
    UNION ALL SELECT query_id, video_id, 0.25 / (60 + rank), NULL, rank FROM sparse
), rrf AS (SELECT query_id, video_id, sum(w) AS rrf_score, min(dense_rank) AS dense_rank, min(sparse_rank) AS sparse_rank FROM parts GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, video_id) AS rank FROM rrf)"""


def _video_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts are the text side of the prompt queries."""
    return T.text_queries(spark, sf).select(F.concat(F.lit("q"), "query_id").alias("query_id"), "query")


def _rrf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, tuple[str, ...]]]:
    dense, *series = _dense(spark, sf)
    sparse = B.sparse_search(T.media_of_videos(spark, sf), _video_queries(spark, sf), None, tokens(F.col("query")))
    return R.reciprocal_rank_fusion(dense, sparse, 0.75, 0.25), dense, series


@register("F1_rrf", f"WITH {FUSED_SQL} SELECT query_id, video_id, round(rrf_score, 6) AS rrf_score, dense_rank, CAST(sparse_rank AS BIGINT) AS sparse_rank FROM rrf")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_rrf(spark, sf)[0], "rrf_score").withColumns(long("dense_rank", "sparse_rank"))


@register("F2_dense_attach", f"WITH {FUSED_SQL} SELECT r.query_id, r.video_id, round(rrf_score, 6) AS rrf_score, best_frame, round(d.score, 6) AS dense_score FROM rrf r LEFT JOIN dense d USING (query_id, video_id)")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    fused, dense, _ = _rrf(spark, sf)
    return r6(R.attach_dense(fused, dense), "rrf_score", "dense_score").select("query_id", "video_id", "rrf_score", "best_frame", "dense_score")


@register("F3_fused_order", f"WITH {FUSED_SQL} SELECT query_id, rank, video_id, round(rrf_score, 6) AS rrf_score FROM ordered")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return r6(R.fused_order(_rrf(spark, sf)[0]), "rrf_score").select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", "rrf_score")


@register("P1_hybrid_search", f"WITH {FUSED_SQL} SELECT o.query_id, o.rank, o.video_id, round(rrf_score, 6) AS rrf_score, best_frame, round(d.score, 6) AS dense_score FROM ordered o LEFT JOIN dense d USING (query_id, video_id) WHERE o.rank <= 10")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and keyword search, fused, with each video's best frame."""
    fused, dense, _ = _rrf(spark, sf)
    out = R.attach_dense(R.fused_order(fused, 10), dense)
    return r6(out, "rrf_score", "dense_score").select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", "rrf_score", "best_frame", "dense_score")


# ---- joins

MAP_SQL = "frame_map AS (SELECT video_id, frame_idx, CAST(frame_idx * 25 + 3 AS BIGINT) AS frame_id FROM frames WHERE frame_idx % 2 = 0)"
ID_SQL = "coalesce(CAST(m.frame_id AS VARCHAR), CAST(CASE WHEN {0} > 0 THEN {0} * 25 ELSE 1 END AS VARCHAR))"


@register("J1_frame_lookup", f"WITH {T.FRAMES_SQL}, {MAP_SQL} SELECT f.video_id, f.frame_idx, {ID_SQL.format('f.frame_idx')} AS frame_id FROM frames f LEFT JOIN frame_map m USING (video_id, frame_idx)")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return S.frame_ids(T.frames(spark, sf).select("video_id", "frame_idx"), T.frame_map(spark, sf))


DETECTIONS_SQL = f"detections AS (SELECT 'v' || (event_id // {T.FRAMES_A_VIDEO * T.DETECTIONS_A_FRAME}) AS video_id, CAST(event_id // {T.DETECTIONS_A_FRAME} % {T.FRAMES_A_VIDEO} AS INTEGER) AS frame_idx, event_type AS entity, event_id % 100 / CAST(100 AS DOUBLE) AS score FROM events WHERE user_id IS NOT NULL)"
TARGETS = "(SELECT 'q' || item_id AS query_id, unnest(CASE item_id % 4 WHEN 0 THEN ['click', 'view'] WHEN 1 THEN ['purchase'] WHEN 2 THEN ['person'] ELSE [] END) AS entity FROM benchmark) AS t"


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """Two wanted classes of every fourth query, one of the next two, none of the last."""
    wanted = F.array(F.array(F.lit("click"), F.lit("view")), F.array(F.lit("purchase")), F.array(F.lit("person")), F.array().cast("array<string>"))
    return T.table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.explode(F.get(wanted, F.col("item_id") % 4)).alias("entity"))


@register("J2_entity_semi", f"WITH {DETECTIONS_SQL} SELECT video_id, entity, count(*) AS n, round(sum(score), 4) AS total FROM detections WHERE entity IN (SELECT entity FROM {TARGETS}) GROUP BY ALL")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.detections(spark, sf).join(_targets(spark, sf).select("entity").distinct(), "entity", "left_semi")
    return hits.groupBy("video_id", "entity").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@register("J3_boxes", "SELECT event_id, event_type AS entity, {'x': CAST(event_id % 7 AS DOUBLE), 'y': CAST(event_id % 5 AS DOUBLE), 'w': CAST(event_id % 11 + 1 AS DOUBLE), 'h': CAST(event_id % 13 + 1 AS DOUBLE)} AS box FROM events WHERE event_id % 100 / CAST(100 AS DOUBLE) > 0.4")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from corners (y, x, y, x) to place and size, of confident detections."""
    e = T.table(spark, sf, "events")
    corner = F.array(F.col("event_id") % 5, F.col("event_id") % 7, F.col("event_id") % 5 + F.col("event_id") % 13 + 1, F.col("event_id") % 7 + F.col("event_id") % 11 + 1)
    rows = e.where(F.col("event_id") % 100 / 100.0 > 0.4).select("event_id", F.col("event_type").alias("entity"), F.transform(corner, lambda x: x.cast("double")).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    return rows.select("event_id", "entity", F.struct(at(1).alias("x"), at(0).alias("y"), (at(3) - at(1)).alias("w"), (at(2) - at(0)).alias("h")).alias("box"))


@register("J4_ordinal_join", f"WITH {T.FRAMES_SQL}, named AS (SELECT 'v' || (vec_id // {T.FRAMES_A_VIDEO}) AS video_id, 'k' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS name FROM embeddings), placed AS (SELECT video_id, name, CAST(row_number() OVER (PARTITION BY video_id ORDER BY name) - 1 AS INTEGER) AS frame_idx FROM named) SELECT video_id, name, frame_idx, round(e[1], 6) AS first FROM placed JOIN frames USING (video_id, frame_idx)")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """Key frame names, in order, meet vectors by their place."""
    named = T.table(spark, sf, "embeddings").select(T.video_of("vec_id", T.FRAMES_A_VIDEO).alias("video_id"), F.concat(F.lit("k"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("name"))
    placed = named.withColumn("frame_idx", F.row_number().over(D.Window.partitionBy("video_id").orderBy("name")) - 1)
    return placed.join(T.frames(spark, sf), ["video_id", "frame_idx"]).select("video_id", "name", "frame_idx", T.rounded(F.get("embedding", F.lit(0)).cast("double")).alias("first"))


# ---- detections

CANDIDATES_SQL = f"{FUSED_SQL}, {DETECTIONS_SQL}, targets AS (SELECT * FROM {TARGETS})"
WEIGHT_SQL = f"CASE WHEN {{0}} IN ({', '.join(repr(x) for x in X.GENERIC)}) THEN {X.GENERIC_WEIGHT} WHEN {{0}} IN ({', '.join(repr(x) for x in X.PROPS)}) THEN {X.PROP_WEIGHT} ELSE {X.SUBJECT_WEIGHT} END"
BOOST_SQL = f"""{CANDIDATES_SQL}, wants AS (SELECT query_id, max(CASE WHEN {WEIGHT_SQL.format('entity')} >= 3 THEN 1 ELSE 0 END) AS wants FROM targets GROUP BY ALL),
looked AS (SELECT s.query_id, s.video_id, s.frame_idx, s.score, o.rrf_score, wants, row_number() OVER (PARTITION BY s.query_id, s.video_id ORDER BY round(s.score, 9) DESC, s.frame_idx DESC) AS k
           FROM smooth s JOIN ordered o USING (query_id, video_id) JOIN wants USING (query_id) WHERE o.rank <= 30 AND video_id IN (SELECT video_id FROM detections)),
matched AS (SELECT l.query_id, l.video_id, l.frame_idx, d.entity, d.score * {WEIGHT_SQL.format('d.entity')} / 2 AS m FROM looked l JOIN detections d USING (video_id, frame_idx) JOIN targets t ON t.query_id = l.query_id AND t.entity = d.entity WHERE k <= 12),
frame_m AS (SELECT query_id, video_id, frame_idx, sum(m) AS m FROM matched GROUP BY ALL),
video_m AS (SELECT query_id, video_id, sum(m) * 0.04 AS b FROM frame_m WHERE m > 0 GROUP BY ALL),
kinds AS (SELECT query_id, video_id, count(DISTINCT entity) AS kinds FROM matched GROUP BY ALL),
lifted AS (SELECT l.query_id, l.video_id, l.frame_idx, l.score * (1 + 0.12 * coalesce(m, 0)) AS score, rrf_score, wants FROM looked l LEFT JOIN frame_m USING (query_id, video_id, frame_idx)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, frame_idx) AS k FROM lifted) WHERE k = 1),
boosted AS (SELECT o.query_id, o.video_id, o.rank, o.rrf_score AS before, frame_idx AS best_frame, b.score AS max_score,
            CASE WHEN o.rrf_score > 0 THEN least(1.0, greatest(0.4, o.rrf_score * 15)) ELSE 0.5 END AS gate,
            CASE WHEN b.query_id IS NOT NULL THEN coalesce(v.b, 0) + CASE WHEN coalesce(kinds, 0) >= 2 THEN 0.15 * kinds ELSE 0 END
                 - CASE WHEN b.wants = 1 THEN 0.08 * (CASE WHEN o.rrf_score > 0 THEN least(1.0, greatest(0.4, o.rrf_score * 15)) ELSE 0.5 END) ELSE 0 END END AS bonus
            FROM ordered o LEFT JOIN best b USING (query_id, video_id) LEFT JOIN video_m v USING (query_id, video_id) LEFT JOIN kinds USING (query_id, video_id)),
final AS (SELECT *, before + coalesce(bonus * gate, 0) AS rrf FROM boosted)"""


def _boosted(spark: SparkSession, sf: str) -> DataFrame:
    fused, _, (blocks, files) = _rrf(spark, sf)
    ranked = staged(R.fused_order(fused), "ranked")
    series = P.frame_series(blocks, files, ranked.where(F.col("rank") <= O.BOOSTED))
    return O.boost(ranked, series, T.detections(spark, sf), _targets(spark, sf))


@register("O3_weights", f"SELECT entity, {WEIGHT_SQL.format('entity')}::DOUBLE AS weight FROM (SELECT DISTINCT event_type AS entity FROM events UNION SELECT * FROM (VALUES ('person'), ('bowl'), ('dog'), ('hat')) t(entity))")
def o3(spark: SparkSession, sf: str) -> DataFrame:
    more = spark.createDataFrame([("person",), ("bowl",), ("dog",), ("hat",)], "entity string")
    names = T.table(spark, sf, "events").select(F.col("event_type").alias("entity")).unionByName(more).distinct()
    return names.select("entity", O.saliency(F.col("entity")).alias("weight"))


@register("O5_boost", f"WITH {BOOST_SQL} SELECT query_id, video_id, rank, round(rrf, 6) AS rrf_score, best_frame, round(max_score, 6) AS max_score, round(bonus, 6) AS bonus FROM final")
def o5(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_boosted(spark, sf), "rrf_score", "max_score", "bonus").withColumns(long("rank"))


@register("O6_reorder", f"WITH {BOOST_SQL} SELECT query_id, video_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, rank) AS new_rank FROM final")
def o6(spark: SparkSession, sf: str) -> DataFrame:
    return O.reordered(_boosted(spark, sf)).select("query_id", "video_id", "rank", "new_rank").withColumns(long("rank", "new_rank"))


# ---- selection

ORDERED_FRAMES = f"{GAUSS_SQL}, series AS (SELECT query_id, video_id, CAST(count(*) AS INTEGER) AS n, list(frame_idx ORDER BY round(gauss, 9) DESC, frame_idx DESC) AS o FROM gauss GROUP BY ALL)"
#: Greedy choice as a fold over frames in order.
NMS_SQL = "list_reduce(list_prepend(CAST([] AS INTEGER[]), list_transform(o, lambda x: [x])), lambda a, b: CASE WHEN len(a) >= 5 OR len(list_filter(a, lambda p: abs(p - b[1]) < 12)) > 0 THEN a ELSE list_concat(a, b) END)"


@register("T1_gauss9", f"WITH {GAUSS_SQL} SELECT query_id, video_id, frame_idx, round(gauss, 6) AS gauss FROM gauss")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_gauss(spark, sf), "gauss").select("query_id", "video_id", "frame_idx", "gauss")


@register("T2_best_frame", f"WITH {GAUSS_SQL}, {PEAKS_SQL.replace(SMOOTH_SQL + ', ', f'smooth AS {T.convolution_sql("fused", "smooth", D.KERNEL)}, ')}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(gauss, 9) DESC, frame_idx) AS k FROM gauss) SELECT d.query_id, d.video_id, b.frame_idx FROM dense d JOIN b USING (query_id, video_id) WHERE d.rank = 1 AND k = 1")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return S.best_frames(_dense(spark, sf)[0], _gauss(spark, sf))


@register("T3_nms", f"WITH {ORDERED_FRAMES} SELECT query_id, video_id, {NMS_SQL} AS peaks FROM series")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return S.frame_order(_gauss(spark, sf)).select("query_id", "video_id", S.spaced_peaks(F.col("ordered")).alias("peaks"))


def _around_sql(first: int, steps: tuple[int, ...]) -> str:
    return f"list_filter(flatten(list_transform(peaks[1:{first}], lambda p: list_transform([{', '.join(map(str, steps))}], lambda s: p + s))), lambda f: f >= 0 AND f < n)"


EVEN_SQL = "CASE WHEN n > 1 THEN list_transform(range(least(n, 6)), lambda i: CAST(floor(round(i * (n - 1) / (least(n, 6) - 1), 9)) AS INTEGER)) ELSE [0] END"
#: First occurrences, in order.
DISTINCT_SQL = "list_transform(list_filter(list_zip({0}, range(len({0}))), lambda z: list_position({0}, z[1]) = z[2] + 1), lambda z: z[1])"
TAKE_SQL = f"CASE WHEN r = 0 THEN list_concat({_around_sql(3, S.STEPS_FIRST)}, {EVEN_SQL}) WHEN r < 4 THEN {_around_sql(2, S.STEPS_NEXT)} WHEN r < 12 THEN {_around_sql(2, S.STEPS_LATER)} ELSE peaks[1:2] END"
EXPANDED_SQL = f"""{ORDERED_FRAMES}, {PEAKS_SQL.replace(SMOOTH_SQL + ', ', f'smooth AS {T.convolution_sql("fused", "smooth", D.KERNEL)}, ')}, picked AS (
    SELECT d.query_id, d.video_id, CAST(d.rank - 1 AS INTEGER) AS r, n, {NMS_SQL} AS peaks FROM dense d JOIN series USING (query_id, video_id)
), taken AS (SELECT query_id, video_id, r, {TAKE_SQL} AS f FROM picked), expanded AS (SELECT query_id, video_id, r, {DISTINCT_SQL.format('f')} AS frames FROM taken)"""


@register("T4_expand", f"WITH {EXPANDED_SQL} SELECT query_id, video_id, r AS rank, frames FROM expanded")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    hits = _dense(spark, sf)[0].select("query_id", "video_id", (F.col("rank") - 1).alias("rank"))
    joined = hits.join(S.frame_order(_gauss(spark, sf)), ["query_id", "video_id"])
    return joined.select("query_id", "video_id", "rank", S.frames_to_take(F.col("rank"), S.spaced_peaks(F.col("ordered")), F.col("n_frames")).alias("frames"))


@register("T5_budget100", f"""WITH {EXPANDED_SQL}, {MAP_SQL}, flat AS (SELECT query_id, video_id, r, unnest(frames) AS frame_idx, unnest(range(len(frames))) AS pos FROM expanded),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, pos) AS rank FROM flat),
    kept AS (SELECT query_id, rank, n.video_id, {ID_SQL.format('n.frame_idx')} AS frame_id FROM numbered n LEFT JOIN frame_map m USING (video_id, frame_idx) WHERE rank <= 100),
    slots AS (SELECT DISTINCT query_id, s AS rank FROM dense, range(1, 101) t(s)), tops AS (SELECT query_id, video_id FROM dense WHERE rank = 1)
    SELECT s.query_id, s.rank, coalesce(k.video_id, t.video_id) AS video_id, coalesce(k.frame_id, '0000') AS frame_id FROM slots s JOIN tops t USING (query_id) LEFT JOIN kept k ON k.query_id = s.query_id AND k.rank = s.rank""")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    out = S.diverse_predictions(_dense(spark, sf)[0].select("query_id", "video_id", "rank"), _gauss(spark, sf), T.frame_map(spark, sf))
    return out.withColumns(long("rank"))


SEGMENTS_SQL = f"""{GAUSS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY query_id, video_id) AS n FROM gauss),
seg AS (SELECT *, CASE WHEN n // 3 > 0 THEN least(frame_idx // (n // 3), 2) ELSE 0 END AS s FROM sized),
ps AS (SELECT query_id, video_id, s, n, frame_idx, gauss FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, s ORDER BY round(gauss, 9) DESC, frame_idx) AS k FROM seg) WHERE k = 1),
tops AS (SELECT query_id, video_id, max(n) AS n, list(frame_idx ORDER BY frame_idx) AS peaks, first(frame_idx ORDER BY round(gauss, 9) DESC, frame_idx) AS top FROM ps GROUP BY ALL)"""


@register("T6_keyframes", f"""WITH {SEGMENTS_SQL}, wanted AS (SELECT query_id, video_id, n, unnest(list_distinct(list_concat(list_concat(list_transform([0.05, 0.25, 0.5, 0.75, 0.95], lambda q: CAST(floor(round(n * q, 6)) AS INTEGER)), peaks), list_transform([-2, -1, 0, 1, 2], lambda d: top + d)))) AS frame_idx FROM tops),
    ok AS (SELECT w.query_id, w.video_id, w.frame_idx, row_number() OVER (PARTITION BY w.query_id, w.video_id ORDER BY round(gauss, 9) DESC, w.frame_idx) AS k FROM wanted w JOIN gauss USING (query_id, video_id, frame_idx) WHERE n > 8)
    SELECT query_id, video_id, list(frame_idx ORDER BY frame_idx) AS frames FROM ok WHERE k <= 8 GROUP BY ALL UNION ALL SELECT query_id, video_id, list_transform(range(n), lambda i: CAST(i AS INTEGER)) FROM tops WHERE n <= 8""")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return S.key_frames(_gauss(spark, sf))


@register("V1_segment_peaks", f"WITH {SEGMENTS_SQL} SELECT query_id, video_id, CASE WHEN n <= 3 THEN list_transform(range(n), lambda i: CAST(i AS INTEGER)) ELSE peaks END AS peaks FROM tops")
def v1(spark: SparkSession, sf: str) -> DataFrame:
    return S.segment_peaks(_gauss(spark, sf))


# ---- alignment: the prompts of a query are its events


def _events(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return T.prompts(spark, sf).where(F.col("prompt_idx") < n).withColumnRenamed("prompt_idx", "event_idx")


def _event_scores(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return A.event_scores(T.frames(spark, sf), _events(spark, sf, n))


def align_sql(n: int) -> str:
    """All choices of frames by a chain of joins that keeps the best way to every last frame."""
    parts = [f"sized AS (SELECT *, count(*) OVER (PARTITION BY query_id, video_id, prompt_idx) AS t FROM sims), g AS (SELECT *, least(8, greatest(1, (t - {n}) // {n})) AS g FROM sized)"]
    parts.append("a0 AS (SELECT query_id, video_id, frame_idx, score, [frame_idx] AS path FROM g WHERE prompt_idx = 0)")
    for k in range(1, n):
        parts.append(f"""a{k} AS (SELECT query_id, video_id, frame_idx, score, path FROM (SELECT x.query_id, x.video_id, x.frame_idx, b.score + x.score AS score, list_append(b.path, x.frame_idx) AS path,
            row_number() OVER (PARTITION BY x.query_id, x.video_id, x.frame_idx ORDER BY round(b.score, 9) DESC, b.frame_idx) AS k
            FROM g x JOIN a{k - 1} b ON b.query_id = x.query_id AND b.video_id = x.video_id AND b.frame_idx <= x.frame_idx - x.g WHERE x.prompt_idx = {k}) WHERE k = 1)""")
    parts.append(f"aligned AS (SELECT query_id, video_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, frame_idx) AS k FROM a{n - 1}) WHERE k = 1)")
    return f"{T.SIMILARITY_SQL}, " + ", ".join(parts)


@register("T13_event_matrix", f"WITH {T.SIMILARITY_SQL} SELECT query_id, prompt_idx AS event_idx, video_id, frame_idx, round(score, 6) AS score FROM sims")
def t13(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_event_scores(spark, sf, 3), "score")


def _aligned(n: int):
    return lambda spark, sf: r6(A.align(_event_scores(spark, sf, n), n), "score")


for _n in (2, 3):
    register(f"T14_align{_n}", f"WITH {align_sql(_n)} SELECT query_id, video_id, path, round(score, 6) AS score FROM aligned")(_aligned(_n))


def _trake_sql(limit: int) -> str:
    smooth = f'smooth AS {T.convolution_sql("fused", "smooth", D.KERNEL)}, '
    return f"""WITH {align_sql(3)}, {PEAKS_SQL.replace(SMOOTH_SQL + ', ', smooth)}, {MAP_SQL},
    steps AS (SELECT query_id, video_id, unnest(path) AS frame_idx, unnest(range(len(path))) AS k FROM aligned),
    named AS (SELECT s.query_id, s.video_id, list({ID_SQL.format('s.frame_idx')} ORDER BY k) AS frame_ids FROM steps s LEFT JOIN frame_map m USING (video_id, frame_idx) GROUP BY ALL)
    SELECT d.query_id, d.rank, d.video_id, coalesce(frame_ids, ['0000', '0000', '0000']) AS frame_ids FROM dense d LEFT JOIN named USING (query_id, video_id) WHERE d.rank <= {limit}"""


def _trake(limit: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        hits = _dense(spark, sf)[0].select("query_id", "video_id", "rank")
        return A.aligned_predictions(hits, _event_scores(spark, sf, 3), 3, T.frame_map(spark, sf), limit).withColumns(long("rank"))

    return run


register("T15_batch_alignment", _trake_sql(100))(_trake(100))
register("T16_single_alignment", _trake_sql(1))(_trake(1))
