"""Registered queries that run the rules of sources, answers, outputs and evaluation over whole tables.

``understanding`` holds the same rules against hand-made rows; here inputs are made from table
columns, and the twins state each rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import providers as P
from ..functions import text as N
from ..operators import evaluate as E
from ..sources import files as S
from ..sources import items as I
from ..sources import sinks as K
from . import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "events")


def text(column: str) -> str:
    return f"CAST({column} AS STRING)"


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
MATCHES = f"a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR list_has_any({WORDS.format('a')}, {WORDS.format('b')}))"
PAIRS = f"pairs AS (SELECT doc_id, {STRIP.format('lower(substring(text, 1, 30))')} AS a, {STRIP.format('lower(substring(text, 20, 12))')} AS b FROM documents)"


@register("E1_frame_hit_table", """SELECT event_id, CAST(CASE WHEN event_id % 11 <> 0 AND 'v' || (user_id % 5) = 'v' || (event_id % 5) AND event_id % 97 BETWEEN event_id % 50 AND event_id % 50 + 20 THEN 1 ELSE 0 END AS DOUBLE) AS relevance FROM events""")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).selectExpr("event_id", "concat('v', user_id % 5) AS video", f"CASE WHEN event_id % 11 = 0 THEN 'none' ELSE {text('event_id % 97')} END AS frame", "concat('v', event_id % 5) AS wanted", "event_id % 50 AS a", "event_id % 50 + 20 AS b")
    return rows.select("event_id", E.frame_hit(F.col("video"), F.col("frame"), F.col("wanted"), F.col("a"), F.col("b")).alias("relevance"))


@register("E2_answer_hit_table", f"WITH {PAIRS} SELECT doc_id, CAST(CASE WHEN doc_id % 97 BETWEEN doc_id % 50 AND doc_id % 50 + 30 AND {MATCHES} THEN 1 ELSE 0 END AS DOUBLE) AS relevance FROM pairs")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "documents").selectExpr("doc_id", f"{text('doc_id % 97')} AS frame", "doc_id % 50 AS a", "doc_id % 50 + 30 AS b", "substring(text, 1, 30) AS given", "substring(text, 20, 12) AS wanted")
    return rows.select("doc_id", E.answer_hit(F.lit("v"), F.col("frame"), F.col("given"), F.lit("v"), F.col("a"), F.col("b"), F.col("wanted")).alias("relevance"))


@register("E3_answer_match_table", f"WITH {PAIRS} SELECT doc_id, coalesce({MATCHES}, false) AS hit FROM pairs")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", N.answers_match(F.substring("text", 1, 30), F.substring("text", 20, 12)).alias("hit"))


@register("E4_event_hit_table", """SELECT event_id, round(CASE WHEN user_id % 5 = event_id % 5 AND event_id % 9 <> 0 THEN ((CASE WHEN event_id % 30 BETWEEN 0 AND 10 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 40 BETWEEN 10 AND 25 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 50 BETWEEN 20 AND 45 THEN 1 ELSE 0 END)) / CAST(3 AS DOUBLE) ELSE 0 END, 6) AS relevance FROM events""")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*[F.struct(F.lit(a).alias("frame_start"), F.lit(b).alias("frame_end")) for a, b in ((0, 10), (10, 25), (20, 45))])
    frames = F.array(*[(F.col("event_id") % n).cast("string") for n in (30, 40, 50)])
    rows = _events(spark, sf).select("event_id", (F.col("user_id") % 5).alias("video"), (F.col("event_id") % 5).alias("of"), F.when(F.col("event_id") % 9 == 0, F.slice(frames, 1, 2)).otherwise(frames).alias("frames"))
    return rows.select("event_id", F.round(E.event_hit(F.col("video"), F.col("frames"), F.col("of"), wanted), 6).alias("relevance"))


@register("V3_parse_score_table", f"SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN least(CAST((event_id % 12) || '.' || (event_id % 10) AS DOUBLE), 10) WHEN 1 THEN least(event_id % 15, 10) WHEN 2 THEN 8 ELSE 1 END AS DOUBLE) AS score FROM events")
def v3(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 5 == 0, F.concat(F.lit("Score: "), e % 12, F.lit("."), e % 10)).when(e % 5 == 1, F.concat(F.lit("score:"), e % 15)).when(e % 5 == 2, F.lit(X.AGREEING[0])).when(e % 5 == 3, F.lit("none of it"))
    return _events(spark, sf).select("event_id", N.verification_score(said).alias("score"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    frame = F.lpad((e % 100).cast("string"), 4, "0")
    return _events(spark, sf).select(
        F.concat(F.lit("task"), e % 3 + 1).alias("task"), e.alias("query_id"), F.lit(1).alias("rank"), F.concat(F.lit("v"), e % 7).alias("video_id"), frame.alias("frame_id"), F.col("event_type").alias("answer"), F.array(frame, F.lit("x")).alias("frame_ids"),
    )


@register("K1_task_rows_table", "SELECT event_id AS query_id, CAST(1 AS INTEGER) AS rank, 'v' || (event_id % 7) AS video_id, lpad(CAST(event_id % 100 AS VARCHAR), 4, '0') || ';x' AS frame_id FROM events WHERE event_id % 3 = 2")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return K.task_rows(_predictions(spark, sf), "task3")


@register("K3_lines_table", """SELECT event_id AS query_id, CAST(1 AS INTEGER) AS rank, 'v' || (event_id % 7) || ', ' || (event_id % 100) || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', "' || event_type || '"' ELSE ', x' END AS line FROM events""")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return K.submission_lines(_predictions(spark, sf))


@register("K4_quote_table", f"""WITH a AS (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t FROM documents), b AS (SELECT doc_id, CASE WHEN t IN ('', '""', '''''', 'None') THEN '{X.UNKNOWN}' ELSE t END AS t FROM a),
    c AS (SELECT doc_id, {STRIP.format("replace(trim(trim(t, chr(34)), chr(39)), chr(10), ' ')")} AS t FROM b), d AS (SELECT doc_id, CASE WHEN length(t) > 100 THEN {STRIP.format('substring(t, 1, 100)')} ELSE t END AS t FROM c)
    SELECT doc_id, '"' || replace(CASE WHEN t = '' THEN '{X.UNKNOWN}' ELSE t END, '"', '""') || '"' AS field FROM d""")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", N.quoted_for_csv(F.col("text")).alias("field"))


@register("U4_ocr_text_table", "SELECT event_id, concat_ws(' ', CASE WHEN event_id % 100 > 30 THEN event_type END, CASE WHEN event_id % 7 > 2 THEN 'x' END) AS text FROM events")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(*[F.struct(t.alias("text"), c.alias("confidence")) for t, c in ((F.col("event_type"), F.col("event_id") % 100 / 100.0), (F.lit("x"), F.col("event_id") % 7 / 7.0))])
    return _events(spark, sf).select("event_id", P.ocr_text(parts).alias("text"))


@register("S5_detections_table", """SELECT event_id, event_type AS entity, event_id % 100 / CAST(100 AS DOUBLE) AS score, [CAST(0.1 AS DOUBLE), 0.2, 0.3, 0.4] AS box FROM events WHERE event_id % 100 >= 15
    UNION ALL SELECT event_id, 'Cat', CAST(0.5 AS DOUBLE), [CAST(0.5 AS DOUBLE), 0.5, 0.9, 0.8] FROM events WHERE event_id % 3 <> 0 AND event_id % 10 <> 7""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as text and as numbers, fewer boxes than classes, and JSON that is cut off."""
    e = F.col("event_id")
    first = F.concat(F.lit('{"detection_class_entities": ["'), "event_type", F.lit('", "Cat"], "detection_scores": ["'), F.format_string("0.%02d", e % 100), F.lit('", '), F.when(e % 10 == 7, "0.1").otherwise("0.5"), F.lit('], "detection_boxes": [[0.1, 0.2, 0.3, 0.4]'))
    raw = F.concat(first, F.when(e % 3 != 0, ", [0.5, 0.5, 0.9, 0.8]").otherwise(""), F.lit("]}"))
    return S.detections_of(_events(spark, sf).select("event_id", raw.alias("raw")))


@register("S6_frame_names_table", f"WITH {T.FRAMES_SQL} SELECT video_id, frame_idx, lpad(CAST(frame_idx + 1 - frame_idx % 2 AS VARCHAR), 3, '0') AS frame_key FROM frames")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """Every other frame has detections, under its place from 1: the others fall back to their neighbour's."""
    frames = T.frames(spark, sf).select("video_id", "frame_idx")
    known = frames.where("frame_idx % 2 = 0").select("video_id", F.lpad((F.col("frame_idx") + 1).cast("string"), 3, "0").alias("frame_key"))
    return S.resolve_frames(frames, known)


@register("S3_media_text_table", "SELECT 'L' || conv_id AS video_id, ' ' || string_agg(' x' || turn || ' a b', ' ' ORDER BY turn || '.json') AS text FROM conversations GROUP BY ALL")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "conversations")
    raw = F.concat(F.lit('{"k": "x'), "turn", F.lit('", "n": 5, "l": ["a", {"z": "b"}, null]}'))
    return S.grouped_media(rows.select(F.concat(F.lit("/m/L"), "conv_id", F.lit("."), "turn", F.lit(".json")).alias("path"), raw.alias("raw")))


@register("Q1_normalize_table", """SELECT 'task' || (item_id % 3 + 1) AS task, CASE WHEN item_id % 4 = 0 THEN 'unknown' ELSE 'i' || item_id END AS query_id, 't' || item_id AS query, CASE WHEN item_id % 2 = 0 THEN 'why?' ELSE '' END AS question, 'L' || item_id AS video_id,
    CAST(item_id AS INTEGER) AS frame_start, CAST(item_id + 5 AS INTEGER) AS frame_end, CAST(item_id % 3 AS INTEGER) AS n_events FROM benchmark""")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    """Aliased names of every field, an absent id, and events as text and as objects."""
    i = F.col("item_id")
    events = F.when(i % 3 == 0, "[]").when(i % 3 == 1, '["go"]').otherwise('["go", {"event_name": "stop", "start": 5, "frame_end": 8}]')
    name = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit('"id": "i'), i, F.lit('", '))).when(i % 4 == 2, F.concat(F.lit('"query_id": "i'), i, F.lit('", '))).otherwise(F.concat(F.lit('"qid": "i'), i, F.lit('", ')))
    asked = F.when(i % 2 == 0, '"q": "why?", ').otherwise("")
    json = F.concat(F.lit("{"), name, asked, F.lit('"text": "t'), i, F.lit('", "vid": "L'), i, F.lit('", "from": '), i, F.lit(', "to": '), i + 5, F.lit(', "events": '), events, F.lit("}"))
    rows = T.table(spark, sf, "benchmark").select(F.concat(F.lit("task"), i % 3 + 1).alias("task"), json.alias("json"))
    return I.normalised_items(rows).withColumn("n_events", F.size("events")).drop("events", "answer")
