"""Registered queries of query understanding, sources, answers, evaluation and outputs.

Small fixtures are given inline, with hand-made expectations or SQL; what can be run over a table
is run over all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import providers as P
from ..functions import text as N
from ..operators import evaluate as E
from ..operators import objects as O
from ..operators import rerank as V
from ..operators.keywords import keyword_hits, words_of
from ..sources import files as S
from ..sources import items as I
from ..sources import sinks as K
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


def quoted(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quoted, value)) + "]"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, int) else "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def expected(columns: str, *rows: tuple) -> str:
    """SQL of literal rows: what a fixture must give."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


def given(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# ---- normalisation

ITEMS = (
    ('task1', '{"id": "x", "text": "t", "frame_start": 0, "start": 7}'),
    ('task1', '{"query_id": "a", "query": "find", "video": "L01", "from": 3, "to": 9}'),
    ('task2', '{"qid": "b", "prompt": "p", "q": "why?", "vid": "L02", "ans": "yes", "end": 4}'),
    ('task3', '{"query": "", "caption": "c", "events": ["go", {"event_name": "stop", "start": 5, "frame_end": 8}]}'),
    ('task1', '"plain"'),
    ('task1', '{}'),
)


@register("Q1_Q3_normalize", expected(
    "task, query_id, query, question, video_id, frame_start, frame_end, answer, n_events",
    ("task1", "x", "t", "", "", 7, 0, "", 0), ("task1", "a", "find", "", "L01", 3, 9, "", 0), ("task2", "b", "p", "why?", "L02", 0, 4, "yes", 0),
    ("task3", "unknown", "c", "", "", 0, 0, "", 2), ("task1", "unknown", "plain", "", "", 0, 0, "", 0), ("task1", "unknown", "", "", "", 0, 0, "", 0),
))
def q1(spark: SparkSession, sf: str) -> DataFrame:
    return I.normalised_items(given(spark, "task string, json string", *ITEMS)).withColumn("n_events", F.size("events")).drop("events")


@register("Q2_events", expected("query_id, pos, name, frame_start, frame_end", ("unknown", 0, "go", 0, 0), ("unknown", 1, "stop", 5, 8)))
def q2(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.normalised_items(given(spark, "task string, json string", *ITEMS))
    return rows.select("query_id", F.posexplode("events").alias("pos", "e")).select("query_id", "pos", "e.*")


@register("Q4_route", """WITH n AS (SELECT lower(query_id) AS q, query_id FROM (SELECT item_id || CASE item_id % 6 WHEN 0 THEN '-KIS' WHEN 1 THEN '_qa' WHEN 2 THEN '-vqa-2' WHEN 3 THEN '_event_1' WHEN 4 THEN 'trake' ELSE '-x' END AS query_id FROM benchmark))
    SELECT query_id, CASE WHEN ends_with(q, 'kis') OR contains(q, '-kis-') OR contains(q, '_kis_') THEN 'kis' WHEN ends_with(q, 'qa') OR contains(q, '-qa-') OR contains(q, '_qa_') OR contains(q, '-vqa-') OR contains(q, '_vqa_') THEN 'qa'
    WHEN ends_with(q, 'trake') OR ends_with(q, 'event') OR contains(q, '-trake-') OR contains(q, '_trake_') OR contains(q, '-event-') OR contains(q, '_event_') THEN 'trake' END AS task FROM n""")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("-KIS", "_qa", "-vqa-2", "_event_1", "trake", "-x")]), (F.col("item_id") % 6 + 1).cast("int"))
    rows = T.table(spark, sf, "benchmark").select(F.concat(F.col("item_id").cast("string"), suffix).alias("query_id"))
    return rows.select("query_id", N.task_of_name(F.col("query_id")).alias("task"))


FILES = (
    ("d/10-qa.txt", "Một cảnh phố. Người đi bộ.\nCâu hỏi: Áo màu gì?"),
    ("d/9-kis.txt", "Dòng một\n\nDòng hai "),
    ("d/2-trake.txt", "E1: mở cửa\n2. bước vào\n(3) ngồi xuống"),
    ("d/11.txt", "Cảnh bếp\nCó bao nhiêu người?\nTrả lời ngắn"),
    ("d/12.txt", "1. bước đầu\n2. giữa\n3. cuối"),
    ("d/7.txt", "Một con mèo"),
    ("d/8-qa.txt", "Chỉ có cảnh"),
)


def _parsed(spark: SparkSession) -> DataFrame:
    return S.parsed_queries(given(spark, "path string, text string", *FILES))


@register("Q5_Q9_parse", expected(
    "query_id, task, query, question",
    ("10-qa", "qa", "Một cảnh phố. Người đi bộ.", "Áo màu gì?"), ("9-kis", "kis", "Dòng một Dòng hai", ""), ("2-trake", "trake", "mở cửa bước vào ngồi xuống", ""),
    ("11", "qa", "Cảnh bếp", "Có bao nhiêu người? Trả lời ngắn"), ("12", "trake", "bước đầu giữa cuối", ""), ("7", "kis", "Một con mèo", ""), ("8-qa", "qa", "Chỉ có cảnh", "Chỉ có cảnh"),
))
def q5(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark).select("query_id", "task", "query", "question")


@register("Q6_event_lines", expected("query_id, events", ("2-trake", ["mở cửa", "bước vào", "ngồi xuống"]), ("12", ["bước đầu", "giữa", "cuối"])))
def q6(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark).where("task = 'trake'").select("query_id", "events")


@register("S11_natural_order", expected("query_id, ord", ("2-trake", 1), ("7", 2), ("8-qa", 3), ("9-kis", 4), ("10-qa", 5), ("11", 6), ("12", 7)))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark).select("query_id", "ord")


@register("Q10_substitute", expected("id, text", (1, "lion dance performance ở phố"), (2, "lau chùi bảo dưỡng máy ảnh và asparagus"), (3, "man và woman"), (4, "múa lânx")))
def q10(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, text string", (1, "Múa lân ở phố"), (2, "vệ sinh ống kính và măng tây"), (3, "người đàn ông và NGƯỜI PHỤ NỮ"), (4, "múa lânx"))
    return rows.select("id", N.substitute(F.col("text")).alias("text"))


@register("Q11_translate")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "benchmark").select("item_id", "text")
    return rows.select("item_id", N.without_stutter(P.translate(N.substitute(F.col("text")))).alias("english"))


@register("Q12_dedup", """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations),
    k AS (SELECT conv_id, turn, list_filter(list_zip(ws, range(len(ws))), lambda z: z[2] < 2 OR NOT (lower(ws[z[2]]) = lower(z[1]) AND lower(ws[z[2] - 1]) = lower(z[1]))) AS kept FROM w)
    SELECT conv_id, turn, array_to_string(list_transform(kept, lambda z: z[1]), ' ') AS text FROM k""")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "conversations").select("conv_id", "turn", N.without_stutter(F.col("text")).alias("text"))


@register("Q13_intent", expected("id, intent, dense_weight, sparse_weight", *[(i, "OCR_TEXT", 0.4, 0.6) for i in (2, 3, 4, 5)], *[(i, "VISUAL_SCENE", 0.75, 0.25) for i in (1, 6)]))
def q13(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, text string", (1, "Tìm cảnh một người đang mở laptop trong văn phòng."), (2, "logo FANA"), (3, "Cảnh tại HTV9 buổi sáng"), (4, "phóng viên Nguyễn Văn nói chuyện"), (5, 'có chỗ ghi "mở cửa"'), (6, "Nguyễn đi bộ"))
    return rows.select("id", N.intent(F.col("text")).alias("i")).select("id", "i.*")


@register("Q13_intent_table", f"""WITH s AS (SELECT item_id, text, list_transform(regexp_split_to_array(text, '[.?!\\n]+'), lambda x: regexp_replace(trim(x), '^\\S+\\s*', '')) AS parts FROM benchmark),
    f AS (SELECT item_id, ({' OR '.join(f"contains(lower(text), '{c}')" for c in X.TEXT_CUES)}) OR regexp_matches(' ' || text || ' ', '[^\\p{{L}}\\p{{N}}_](\\p{{Lu}}{{2,}}[0-9\\-]*|\\p{{Lu}}+-[0-9]+)[^\\p{{L}}\\p{{N}}_]')
        OR len(list_filter(parts, lambda p: regexp_matches(' ' || p || ' ', '[^\\p{{L}}\\p{{N}}_]\\p{{Lu}}\\p{{Ll}}+(\\s+\\p{{Lu}}\\p{{Ll}}+)+[^\\p{{L}}\\p{{N}}_]'))) > 0 OR regexp_matches(text, '["“][^"”]{{3,}}["”]') AS o FROM s)
    SELECT item_id, CASE WHEN o THEN 'OCR_TEXT' ELSE 'VISUAL_SCENE' END AS intent FROM f""")
def q13_table(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "benchmark").select("item_id", N.intent(F.col("text"))["intent"].alias("intent"))


@register("Q14_prompts", expected(
    "id, prompts",
    (1, ["a cat sleeps", "a photo of a cat sleeps", "a video scene showing a cat sleeps", "a high quality shot of a cat sleeps", "a close-up view of a cat sleeps"]),
    (2, ["a man walks in; he sits down now", "a photo of a man walks in; he sits down now", "a video scene showing a man walks in; he sits down now", "a high quality shot of a man walks in; he sits down now", "a close-up view of a man walks in; he sits down now",
         "a man walks in", "a photo of a man walks in", "a video scene of a man walks in", "he sits down now", "a photo of he sits down now", "a video scene of he sits down now"]),
))
def q14(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, text string", (1, "Find a video of a cat sleeps."), (2, "a man walks in; he sits down now"))
    return rows.select("id", N.prompts(F.col("text")).alias("prompts"))


@register("Q16_Q17_search_text", "SELECT item_id, 'qa' AS task, text || ' ' || 'màu gì?' AS sparse_text, CAST(0.4 AS DOUBLE) AS dense_weight, CAST(0.6 AS DOUBLE) AS sparse_weight FROM benchmark")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    """A question's keyword search has context and question, and fixed weights; its dense search the context alone."""
    rows = T.table(spark, sf, "benchmark").select("item_id", F.lit("qa").alias("task"), F.col("text").alias("query"), F.lit("màu gì?").alias("question"))
    kind, is_qa = N.intent(F.col("query")), F.col("task") == "qa"
    return rows.select("item_id", "task", F.when(is_qa, F.concat_ws(" ", "query", "question")).otherwise(F.col("query")).alias("sparse_text"),
                       F.when(is_qa, 0.4).otherwise(kind["dense_weight"]).alias("dense_weight"), F.when(is_qa, 0.6).otherwise(kind["sparse_weight"]).alias("sparse_weight"))


@register("Q18_neutral_question", expected("id, question", (1, "hình ảnh ai đang hát?"), (2, "hình ảnh này có gì?"), (3, "videos?")))
def q18(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, question string", (1, "Trong đoạn video có ai đang hát?"), (2, "clip này có gì?"), (3, "videos?"))
    return rows.select("id", N.neutral_question(F.col("question")).alias("question"))


@register("B4_B6_boosts", expected(
    "id, token, n", (1, "cat", 1), (1, "in", 1), (1, "paris", 4), (2, "covid", 1), (2, "19", 1), (2, "news", 1), (2, "covid-19", 4), (3, "sign", 1), (3, "open", 5), (3, "now", 5), (4, "paris", 1), (4, "cat", 1),
))
def b4(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, query string", (1, "cat in Paris"), (2, "COVID-19 news"), (3, 'sign "open now"'), (4, "Paris cat"))
    return rows.select("id", F.explode(N.boosted_tokens(F.col("query"))).alias("token")).groupBy("id", "token").agg(F.count("*").cast("int").alias("n"))


@register("B1_stop_words", expected("id, tokens", (1, ["múa", "lân", "covid", "19"]), (2, ["video", "clip"])))
def b1(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, text string", (1, "Đoạn video Múa lân COVID-19 a"), (2, "video clip"))
    return rows.select("id", N.tokens(F.col("text")).alias("tokens"))


# ---- detections and files

DETECTED = (
    ("v1", "001", '{"detection_class_entities": ["Dog", "Cat", "Car"], "detection_scores": ["0.10", 0.15], "detection_boxes": [[0.1, 0.2, 0.3, 0.4], [0.5, 0.5, 0.9, 0.8]]}'),
    ("v1", "002", '{"detection_class_entities": ["Hat"], "detection_scores": [0.9], "detection_boxes": [[0, 0, 1, 1]]}'),
    ("v1", "003", '{"broken"'),
    ("v1", "004", "{}"),
)


@register("S5_detections", expected("video_id, frame_key, entity, score, box", ("v1", "001", "Cat", 0.15, [0.5, 0.5, 0.9, 0.8]), ("v1", "002", "Hat", 0.9, [0.0, 0.0, 1.0, 1.0])))
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections_of(given(spark, "video_id string, frame_key string, raw string", *DETECTED))


@register("S6_frame_names", expected("video_id, frame_idx, frame_key", ("v1", 0, "001"), ("v1", 1, "001"), ("v1", 2, "002"), ("v2", 5, "00005")))
def s6(spark: SparkSession, sf: str) -> DataFrame:
    known = given(spark, "video_id string, frame_key string", ("v1", "001"), ("v1", "002"), ("v2", "00005"), ("v2", "6"))
    return S.resolve_frames(given(spark, "video_id string, frame_idx int", ("v1", 0), ("v1", 1), ("v1", 2), ("v1", 7), ("v2", 5)), known)


@register("S3_media_text", expected("video_id, text", ("L01", "  a b  c"), ("L02", "  x")))
def s3(spark: SparkSession, sf: str) -> DataFrame:
    files = given(spark, "path string, raw string", ("/m/L01.json", '{"k": ["a", 1, {"z": "b"}]}'), ("/m/L01_ocr.json", '{"001": "c"}'), ("/m/L02.info.json", '["x", null, true]'), ("/m/L03.json", "{broken"))
    return S.grouped_media(files)


@register("S4_json_leaves", "SELECT event_id, '' AS text FROM events WHERE props IS NOT NULL")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Events' properties hold numbers only: no string leaves."""
    return T.table(spark, sf, "events").where("props IS NOT NULL").select("event_id", S.json_text(F.col("props")).alias("text"))


@register("S4_nested_json_leaves", """SELECT conv_id, turn, ' ' || role || ' ' || text || ' ' || role || ' last' AS text FROM conversations""")
def s4_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Strings at several depths, in objects and arrays, among numbers, nulls and flags; keys are not text."""
    inner = F.struct(F.col("text").alias("a"), F.array(F.col("role")).alias("b"), F.col("turn").alias("c"))
    json = F.to_json(F.struct(F.col("role").alias("role"), F.array(inner).alias("list"), F.lit(True).alias("flag"), F.lit("last").alias("z")))
    return T.table(spark, sf, "conversations").select("conv_id", "turn", S.json_text(json).alias("text"))


@register("S9_items", expected("task, query_id, query", ("task1", "a", "x"), ("task2", "unknown", "y"), ("task1", "b", "z"), ("task3", "c", "w")))
def s9(spark: SparkSession, sf: str) -> DataFrame:
    raw = given(spark, "raw string", ('{"task1": [{"id": "a", "query": "x"}], "task2": {"k1": {"query": "y"}}}',), ('[{"id": "b", "text": "z", "task": "other"}, {"id": "c", "text": "w", "task": "TASK3"}]',))
    return I.normalised_items(I.items_of_json(raw)).select("task", "query_id", "query")


@register("S10_csv_routing", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'task1' WHEN event_type = 'click' THEN 'task2' ELSE 'task1' END AS task FROM events")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("event_type") == "click", "Task2").when(F.col("event_type") == "error", "none")
    return T.table(spark, sf, "events").select("event_id", I.routed(named).alias("task"))


@register("S13_pictures", expected("video_id, frame_idx, path", ("v1", 0, "/k/v1/001.jpg"), ("v1", 1, "/k/v1/001.jpg"), ("v1", 9, "/k/v1/003.jpg"), ("v2", 4, "/k/v2/b.jpg"), ("v3", 0, None)))
def s13(spark: SparkSession, sf: str) -> DataFrame:
    pictures = given(spark, "video_id string, path string", ("v1", "/k/v1/001.jpg"), ("v1", "/k/v1/003.jpg"), ("v2", "/k/v2/a.jpg"), ("v2", "/k/v2/b.jpg"))
    return S.resolve_pictures(given(spark, "video_id string, frame_idx int", ("v1", 0), ("v1", 1), ("v1", 9), ("v2", 4), ("v3", 0)), pictures)


@register("S15_keyframe_parts", "SELECT vec_id, 'v' || label AS video_id, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS frame FROM embeddings")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/data/keyframes/v"), "label", F.lit("/"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".jpg"))
    video, frame = S.keyframe_parts(path)
    return T.table(spark, sf, "embeddings").select("vec_id", video.alias("video_id"), frame.alias("frame"))


@register("S16_every_fifth_frame", f"WITH {T.FRAMES_SQL} SELECT video_id, frame_idx FROM frames WHERE frame_idx % 5 = 0")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator of text recognition: every fifth frame."""
    return T.frames(spark, sf).where("frame_idx % 5 = 0").select("video_id", "frame_idx")


@register("U4_ocr_text", expected("id, text", (1, "a c"), (2, "")))
def u4(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, found array<struct<text:string,confidence:double>>", (1, [("a", 0.9), ("b", 0.3), ("c", 0.31)]), (2, []))
    return rows.select("id", P.ocr_text(F.col("found")).alias("text"))


@register("U4_found_texts", """SELECT page_id AS key, array_to_string(list_filter(list_transform(string_split(coalesce(html, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND length(x) % 101 > 30), ' ') AS text FROM pages""")
def u4_table(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' bytes stand for pictures: a table function called by a lateral join, confident parts joined."""
    return P.found_texts(T.table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.col("html").cast("binary").alias("content")))


@register("D2_encode")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "benchmark").select("item_id", P.encode(F.col("text")).alias("embedding"))


@register("V2_verify")
def v2(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "benchmark").select("item_id", P.verify(F.col("text")).alias("answer"))
    return rows.withColumn("score", N.verification_score(F.col("answer")))


# ---- entities

ASKED = ((1, "Một con chó và người phụ nữ đi xe đạp"), (2, "đàn bò trên cánh đồng"), (3, "chơi đàn cho đàn bò"), (4, "hình tượng trưng"), (5, "tượng đài lớn"), (6, "a dog with a cup"), (7, "không gì"))


@register("O1_targets", expected(
    "query_id, entities",
    (1, ["animal", "bicycle", "carnivore", "dog", "mammal", "person", "vehicle", "woman"]), (2, ["animal", "cattle", "cow", "livestock", "mammal"]), (3, ["animal", "cattle", "cow", "livestock", "mammal", "musical instrument"]),
    (4, []), (5, ["art", "sculpture", "statue"]), (6, ["cup", "dog"]), (7, []),
))
def o1(spark: SparkSession, sf: str) -> DataFrame:
    return O.target_lists(given(spark, "query_id int, text string", *ASKED))


@register("O4_tiers", expected("query_id, tier1, tier2, tier3", (1, ["bicycle", "carnivore", "dog", "mammal"], [], ["animal", "person", "vehicle", "woman"]), (6, ["dog"], ["cup"], [])))
def o4(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "query_id int, text string", *[a for a in ASKED if a[0] in (1, 6)])
    return O.target_lists(rows).select("query_id", O.tiers(F.col("entities")).alias("t")).select("query_id", "t.*")


#: Words, and what stands between them, in turn.
PARTS_SQL = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
PAIRS_SQL = "list_transform(list_filter(range(1, len(p) - 1), lambda i: p[i + 1] = ' ' AND regexp_matches(p[i], '[\\p{L}\\p{N}_]')), lambda i: p[i] || ' ' || p[i + 2])"
WORDS_OF_SQL = "list_filter(p, lambda x: regexp_matches(x, '[\\p{L}\\p{N}_]'))"


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the labelled documents, and every two words of the benchmark between which a space stands: a lexicon that grows with the tables."""
    words = words_of(T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), T.table(spark, sf, "labels").select(F.col("doc_id").alias("id")))
    pairs = rf"(?=(?:^|[^\p{{L}}\p{{N}}_])({N.WORD} {N.WORD})(?:[^\p{{L}}\p{{N}}_]|$))"
    phrases = T.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pairs), 1)).alias("keyword"))
    return words.unionByName(phrases).distinct()


@register("J6_keywords", f"""WITH d AS (SELECT doc_id, {PARTS_SQL.format('text')} AS p FROM documents), b AS (SELECT {PARTS_SQL.format('text')} AS p FROM benchmark),
    lexicon AS (SELECT unnest({WORDS_OF_SQL}) AS keyword FROM d WHERE doc_id IN (SELECT doc_id FROM labels) UNION SELECT unnest({PAIRS_SQL}) FROM b),
    said AS (SELECT doc_id, unnest(list_concat({WORDS_OF_SQL}, {PAIRS_SQL})) AS keyword FROM d)
    SELECT DISTINCT doc_id AS query_id, keyword FROM said WHERE keyword IN (SELECT keyword FROM lexicon)""")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_hits(T.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text"), _lexicon(spark, sf))


TOLD = [*X.ENTITIES, "đàn bò", "chơi đàn", "người đàn ông", "tượng trưng", "bức tượng", "hình tượng trưng đá"]
SAID = ("a dog", "person.", "xbus", "Cat_", "đi")


@register("O1_targets_table", f"""WITH texts AS (SELECT event_id, lower({quoted(TOLD)}[event_id % {len(TOLD)} + 1] || ' ' || {quoted(SAID)}[event_id % 5 + 1] || ', ' || {quoted(TOLD)}[event_id * 7 % {len(TOLD)} + 1]) AS t FROM events),
    every AS (SELECT DISTINCT t, ' ' || replace(replace(t, ',', ' , '), '.', ' . ') || ' ' AS spaced FROM texts), lexicon AS (SELECT * FROM (VALUES {', '.join(f"({quoted(k)}, {quoted([e.lower() for e in es])})" for k, es in X.ENTITIES.items())}) l(k, es)),
    stands AS (SELECT t, k, es FROM every, lexicon WHERE contains(spaced, ' ' || k || ' ')),
    meant AS (SELECT t, unnest(es) AS e FROM stands WHERE NOT ({' OR '.join(f"k = {quoted(k)} AND ({' OR '.join(f'contains(t, {quoted(o)})' for o in others)}) AND NOT ({' OR '.join(f'contains(t, {quoted(c)})' for c in cues)})" for k, (others, cues) in X.HOMONYMS.items())})),
    named AS (SELECT t, c AS e FROM every, (SELECT unnest({quoted(list(X.CLASSES))}) AS c) WHERE regexp_full_match(c, '[a-z]{{3,}}') AND contains(spaced, ' ' || c || ' ')),
    lists AS (SELECT t, list(DISTINCT e ORDER BY e) AS entities FROM (SELECT * FROM meant UNION ALL SELECT * FROM named) GROUP BY t)
    SELECT event_id AS query_id, coalesce(entities, CAST([] AS VARCHAR[])) AS entities FROM texts LEFT JOIN lists USING (t)""")
def o1_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two keywords, or homonyms in and out of their contexts, and words that hold a class name or are one."""
    e = F.col("event_id")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))
    text = F.concat(pick(TOLD, e), F.lit(" "), pick(SAID, e), F.lit(", "), pick(TOLD, e * 7))
    return O.target_lists(T.table(spark, sf, "events").select(e.alias("query_id"), text.alias("text")))


# ---- verification and answers


@register("V3_parse_score", expected("id, score", (1, 9.5), (2, 8.0), (3, 1.0), (4, 10.0), (5, 0.0)))
def v3(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, answer string", (1, "Score: 9.5"), (2, "đúng rồi"), (3, "no"), (4, "Score: 42"), (5, "score:0"))
    return rows.select("id", N.verification_score(F.col("answer")).alias("score"))


def _ranked_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as candidates: ten queries, ranked by id."""
    rows = T.table(spark, sf, "labels").select((F.col("doc_id") % 10).alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("video_id"), "doc_id", "quality")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).withColumn("rrf_score", 1.0 / (60 + F.col("rank")))


RANKED_SQL = "ranked AS (SELECT doc_id % 10 AS query_id, 'd' || doc_id AS video_id, doc_id, quality, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS rank FROM labels), cands AS (SELECT *, CAST(1 AS DOUBLE) / (60 + rank) AS rrf_score, CAST(doc_id * 7 % 11 AS DOUBLE) AS verdict FROM ranked), scored AS (SELECT *, CASE WHEN rank <= 5 THEN verdict END AS vlm_score FROM cands), boosted AS (SELECT *, rrf_score + (vlm_score - 5.0) / 10.0 * 0.08 AS boosted_score FROM scored)"


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    cands = _ranked_labels(spark, sf)
    verdicts = cands.select("query_id", "video_id", (F.col("doc_id") * 7 % 11).cast("double").alias("verdict"))
    return V.verified(cands, verdicts)


@register("V4_verify_boost", f"WITH {RANKED_SQL} SELECT query_id, video_id, rank, vlm_score, round(boosted_score, 6) AS boosted_score FROM boosted")
def v4(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("query_id", "video_id", F.col("rank").cast("long").alias("rank"), "vlm_score", F.round("boosted_score", 6).alias("boosted_score"))


@register("V5_gate", f"WITH {RANKED_SQL} SELECT query_id, video_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 1 AND vlm_score >= 5.5 THEN 0 WHEN rank <= 5 THEN 1 ELSE 2 END, CASE WHEN rank <= 5 AND NOT (rank = 1 AND vlm_score >= 5.5) THEN round(boosted_score, 9) END DESC NULLS LAST, rank) AS new_rank FROM boosted")
def v5(spark: SparkSession, sf: str) -> DataFrame:
    return V.gated_order(_verified(spark, sf)).select("query_id", "video_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


ANSWERS = (
    (1, "Đáp án là: Màu xanh.", "Màu gì?"), (2, "", "q"), (3, "Tôi không biết", "q"), (4, 'Trong hình, có một tấm biển lớn với nội dung chính là "Mở cửa" được viết bằng sơn đỏ', "Biển ghi gì?"),
    (5, "Cô gái mặc áo gì là áo dài trắng", "Cô gái mặc áo gì?"), (6, "hình ảnh", None),
)


@register("T8_clean_answer", expected("id, answer", (1, "Màu xanh"), (2, "Không rõ"), (3, "Không rõ"), (4, "Mở cửa"), (5, "áo dài trắng"), (6, "hình ảnh")))
def t8(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, answer string, question string", *ANSWERS)
    opened = N.clean_opening(F.col("answer"), F.coalesce("question", F.lit("")))
    return rows.select("id", N.finish_answer(P.without_openings(opened)).alias("answer"))


@register("T9_answer_score", "SELECT doc_id, CASE WHEN text = '' THEN -100.0 WHEN length(text) BETWEEN 3 AND 70 THEN 60.0 - 3 * (doc_id % 4) WHEN length(text) > 100 THEN 40.0 - 3 * (doc_id % 4) ELSE 50.0 - 3 * (doc_id % 4) END::DOUBLE AS score FROM documents")
def t9(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", N.answer_score(F.col("text"), F.col("doc_id") % 4).alias("score"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, "không rõ").when(F.col("doc_id") % 3 == 1, "màu xanh").otherwise(F.repeat(F.lit("x"), 80))
    return _ranked_labels(spark, sf).select("query_id", "rank", "video_id", F.lit("0012").alias("frame_id"), said.alias("answer"))


BEST_SQL = f"{RANKED_SQL}, said AS (SELECT query_id, rank, video_id, '0012' AS frame_id, CASE doc_id % 3 WHEN 0 THEN 'không rõ' WHEN 1 THEN 'màu xanh' ELSE repeat('x', 80) END AS answer FROM ranked), judged AS (SELECT *, CAST(CASE WHEN answer = 'không rõ' THEN -100 WHEN answer = 'màu xanh' THEN 60 - 3 * (rank - 1) ELSE 50 - 3 * (rank - 1) END AS DOUBLE) AS quality FROM said WHERE rank <= 4), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, rank) AS k FROM judged) WHERE k = 1)"


@register("T10_best_answer", f"WITH {BEST_SQL} SELECT query_id, rank - 1 AS promoted_idx, video_id, frame_id, answer, quality FROM best")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    return V.best_answers(_answers(spark, sf)).withColumn("promoted_idx", F.col("promoted_idx").cast("long"))


@register("T11_promote", f"WITH {BEST_SQL} SELECT r.query_id, r.video_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank <> b.rank, r.rank) AS new_rank FROM ranked r JOIN best b USING (query_id)")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    out = V.promoted(_ranked_labels(spark, sf), V.best_answers(_answers(spark, sf)))
    return out.select("query_id", "video_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


@register("T12_answer_padding", f"WITH {BEST_SQL} SELECT query_id, CAST(1 AS BIGINT) AS rank, video_id, frame_id, answer FROM best UNION ALL SELECT query_id, rank, video_id, '0000', 'none' FROM ranked WHERE rank > 1")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    out = V.answer_predictions(V.best_answers(_answers(spark, sf)), _ranked_labels(spark, sf))
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("T7_single_video_answer")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    """The provider's cleaned answer for a video's first key frame."""
    rows = T.frames(spark, sf).where("frame_idx = 0").select("video_id", F.concat(F.lit("Describe "), "video_id").alias("prompt"))
    return rows.select("video_id", N.finish_answer(P.without_openings(P.verify(F.col("prompt")))).alias("answer"))


# ---- evaluation


@register("E1_frame_hit", expected("id, relevance", (1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 1.0), (6, 0.0)))
def e1(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, video string, frame string, wanted string, a int, b int", (1, "v", "500", "v", 500, 510), (2, "w", "500", "v", 500, 510), (3, "v", "12.0", "v", 0, 99), (4, "v", "none", "v", 0, 99), (5, "v", "0000", "v", 0, 0), (6, None, None, "v", 0, 9))
    return rows.select("id", E.frame_hit(F.col("video"), F.col("frame"), F.col("wanted"), F.col("a"), F.col("b")).alias("relevance"))


@register("E2_answer_hit", expected("id, relevance", (1, 1.0), (2, 0.0), (3, 0.0)))
def e2(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, frame string, answer string", (1, "5", "xanh lá"), (2, "50", "xanh lá"), (3, "5", "đỏ"))
    return rows.select("id", E.answer_hit(F.lit("v"), F.col("frame"), F.col("answer"), F.lit("v"), F.lit(0), F.lit(9), F.lit("màu xanh")).alias("relevance"))


@register("E3_answer_match", expected("id, hit", (1, True), (2, False), (3, True), (4, True), (5, False)))
def e3(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, a string, b string", (1, "xanh lá", "màu xanh"), (2, "", "x"), (3, " ABC ", "abc"), (4, "bc", "abcd"), (5, "đỏ", "xanh"))
    return rows.select("id", N.answers_match(F.col("a"), F.col("b")).alias("hit"))


@register("E4_event_hit", expected("id, relevance", (1, 0.75), (2, 0.0), (3, 0.0), (4, 1.0)))
def e4(spark: SparkSession, sf: str) -> DataFrame:
    events = [("a", 95, 105), ("b", 145, 155), ("c", 195, 205), ("d", 245, 255)]
    rows = given(spark, "id int, video string, frames array<string>, events array<struct<name:string,frame_start:int,frame_end:int>>", (1, "v", ["100", "150", "200", "1"], events), (2, "v", ["100", "150", "200"], events), (3, "w", ["100", "150", "200", "250"], events), (4, "v", ["0"], []))
    return rows.select("id", E.event_hit(F.col("video"), F.col("frames"), F.lit("v"), F.col("events")).alias("relevance"))


def _relevances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Quality labels as relevances of ten queries' rankings; four more queries have no prediction."""
    rel = _ranked_labels(spark, sf).where("rank % 3 <> 1").select(F.lit("task1").alias("task"), F.col("query_id").cast("string").alias("query_id"), "rank", F.col("quality").cast("double").alias("relevance"))
    truth = spark.range(14).select(F.lit("task1").alias("task"), F.col("id").cast("string").alias("query_id"))
    return rel, truth


METRICS_SQL = f"{RANKED_SQL}, rel AS (SELECT CAST(query_id AS VARCHAR) AS query_id, rank, CAST(quality AS DOUBLE) AS relevance FROM ranked WHERE rank % 3 <> 1), truth AS (SELECT CAST(i AS VARCHAR) AS query_id FROM range(14) t(i)), m AS (SELECT 'task1' AS task, t.query_id, " + ", ".join(f"coalesce(max(CASE WHEN rank <= {k} THEN relevance ELSE 0 END), 0)::DOUBLE AS r{k}" for k in E.CUTS) + " FROM truth t LEFT JOIN rel USING (query_id) GROUP BY ALL), q AS (SELECT *, (r1 + r5 + r20 + r50 + r100) / 5 AS score FROM m)"


@register("E5_E6_query_metrics", f"WITH {METRICS_SQL} SELECT task, query_id, r1, r5, r20, r50, r100, round(score, 6) AS score FROM q")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return E.query_metrics(*_relevances(spark, sf)).withColumn("score", F.round("score", 6))


@register("E7_global", f"WITH {METRICS_SQL} SELECT " + ", ".join(f"round(avg({a}), 6) AS {b}" for a, b in (("score", "final_score"), *((f"r{k}", f"r{k}") for k in E.CUTS))) + " FROM q")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    out = E.global_metrics(E.query_metrics(*_relevances(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("E8_truth", expected("task, query_id, video_id, frame_start", ("task1", "a", "v2", 5), ("task2", "k1", "v3", 0)))
def e8(spark: SparkSession, sf: str) -> DataFrame:
    raw = given(spark, "raw string", ('{"task1": [{"id": "a", "video_id": "v1"}, {"id": "a", "video_id": "v2", "start": 5}], "task2": {"k1": {"video_id": "v3"}}}',))
    items = I.normalised_items(I.items_of_json(raw))
    return E.latest_truth(items).select("task", "query_id", "video_id", "frame_start")


@register("J5_predictions_truth", f"WITH {RANKED_SQL}, t AS (SELECT query_id, 'd' || min(doc_id) AS wanted FROM ranked GROUP BY ALL) SELECT query_id, rank, video_id, video_id = wanted AS hit FROM t LEFT JOIN ranked USING (query_id)")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    cands = _ranked_labels(spark, sf)
    truth = cands.groupBy("query_id").agg(F.concat(F.lit("d"), F.min("doc_id")).alias("wanted"))
    return truth.join(cands, "query_id", "left").select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", (F.col("video_id") == F.col("wanted")).alias("hit"))


# ---- outputs

PREDICTED = (
    ("task1", "a", 1, "v1", "0500", None, None), ("task1", "a", 2, "v2", "0000", None, None), ("task2", "b", 1, "v3", "12", 'say "hi"\n', None), ("task2", "b", 2, "v3", "x1", "", None),
    ("task3", "c", 1, "v4", None, None, ["10", "0020", "x"]),
)


def _predictions(spark: SparkSession) -> DataFrame:
    return given(spark, "task string, query_id string, rank int, video_id string, frame_id string, answer string, frame_ids array<string>", *PREDICTED)


@register("K1_task_rows", expected("query_id, rank, video_id, frame_id", ("c", 1, "v4", "10;0020;x")))
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return K.task_rows(_predictions(spark), "task3")


@register("K2_json")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    return K.prediction_json(_predictions(spark))


@register("K3_lines", expected("query_id, rank, line", ("a", 1, "v1, 500"), ("a", 2, "v2, 0"), ("b", 1, 'v3, 12, "say ""hi"'), ("b", 2, 'v3, x1, "Không rõ"'), ("c", 1, "v4, 10, 20, x")))
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return K.submission_lines(_predictions(spark))


@register("K4_quote", expected("id, field", (1, '"say ""hi"'), (2, '"Không rõ"'), (3, '"a b"'), (4, '"Không rõ"'), (5, '"' + "y" * 100 + '"')))
def k4(spark: SparkSession, sf: str) -> DataFrame:
    rows = given(spark, "id int, answer string", (1, 'say "hi"\n'), (2, ""), (3, "a\nb"), (4, "None"), (5, "y" * 130))
    return rows.select("id", N.quoted_for_csv(F.col("answer")).alias("field"))


@register("K6_skip_written", "SELECT vec_id FROM embeddings WHERE label NOT IN (1, 3)")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    """What an incremental output still has to write: an anti-join on what is there."""
    done = spark.createDataFrame([(1,), (3,)], "label int")
    return T.table(spark, sf, "embeddings").join(done, "label", "left_anti").select("vec_id")


@register("K8_metrics_text", expected("final_score, r1", ("0.8000", "0.0000")))
def k8(spark: SparkSession, sf: str) -> DataFrame:
    return K.formatted_metrics(given(spark, "final_score double, r1 double", (0.8, 0.0)))
