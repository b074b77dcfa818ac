"""Properties and edges of the retrieval operators."""

import itertools
import json
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import providers as P
from lumenframe.functions import text as N
from lumenframe.operators import align as A
from lumenframe.operators import dense as D
from lumenframe.operators import evaluate as E
from lumenframe.operators import fusion as R
from lumenframe.operators import keywords as K
from lumenframe.operators import select as S
from lumenframe.operators import sparse as B
from lumenframe.operators.keywords import keyword_hits
from lumenframe.plans import tables as T
from lumenframe.plans.registry import QUERIES
from lumenframe.sources import files, items, sinks


def series(spark, *scores):
    return spark.createDataFrame([("q", f"v{n}", i, float(x)) for n, s in enumerate(scores) for i, x in enumerate(s)], "query_id string, video_id string, frame_idx int, score double")


def test_smoothing_is_a_convolution(spark):
    rng = np.random.default_rng(0)
    many = [rng.random(n) for n in (9, 12, 30)] + [[1, 0, 0, 0, 0], [0.2, 0.7], [0.4]]
    rows = S.gaussian_smoothed(D.smoothed(series(spark, *many))).collect()
    for n, values in enumerate(many):
        mine = sorted((r for r in rows if r.video_id == f"v{n}"), key=lambda r: r.frame_idx)
        for weights, got in ((D.KERNEL, [r.smooth for r in mine]), (D.gaussian(), [r.gauss for r in mine])):
            want = np.convolve(np.pad(values, len(weights) // 2), weights, "valid") if len(values) >= 3 else values
            assert np.allclose(got, want)


def test_short_series_peak(spark):
    got = D.video_peaks(D.smoothed(series(spark, [0.2, 0.7], [0.4]))).orderBy("video_id").collect()
    assert [(r.best_frame, r.score) for r in got] == [(1, 0.7), (0, 0.4)]


def test_spaced_peaks(spark):
    rows = spark.createDataFrame([([30, 31, 50, 10],), ([],), ([5],)], "o array<int>")
    assert [r[0] for r in rows.select(S.spaced_peaks(F.col("o"))).collect()] == [[30, 50, 10], [], [5]]


def test_expansion_fixture(spark):
    row = spark.range(1).select(S.frames_to_take(F.lit(0), F.array(F.lit(20), F.lit(5)), F.lit(40)).alias("f")).first()
    assert row.f == [20, 17, 23, 14, 26, 10, 30, 5, 35, 2, 8, 11, 15, 0, 7, 31, 39]


def test_bm25_fixture(spark):
    media = spark.createDataFrame([("d1", "cat sat mat"), ("d2", "cat cat dog"), ("d3", "bird"), ("d4", "cat fish")], "video_id string, text string")
    queries = spark.createDataFrame([("q", "cat dog")], "query_id string, query string")
    got = {r.video_id: r.score for r in B.sparse_search(media, queries).collect()}
    assert got == pytest.approx({"d1": 0.122797, "d2": 0.918995, "d4": 0.148649}, abs=1e-5)


def test_empty_corpus(spark):
    media = spark.createDataFrame([], "video_id string, text string")
    queries = spark.createDataFrame([("q", "cat")], "query_id string, query string")
    assert B.sparse_search(media, queries).count() == 0


def test_fusion_fixture(spark):
    ranks = lambda *v: spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(v)], "query_id string, video_id string, rank int")
    got = {r.video_id: r.rrf_score for r in R.reciprocal_rank_fusion(ranks("A", "B"), ranks("B", "C"), 0.75, 0.25).collect()}
    assert got == pytest.approx({"B": 0.016195, "A": 0.012295, "C": 0.004032}, abs=1e-6)


def brute_alignment(scores, gap):
    best = None
    n, t = len(scores), len(scores[0])
    for path in itertools.combinations(range(t), n):
        if all(b - a >= gap for a, b in itertools.pairwise(path)):
            key = (round(sum(scores[k][f] for k, f in enumerate(path)), 9), tuple(-f for f in reversed(path)))
            best = max(best or key, key)
    return best[0], [-x for x in reversed(best[1])]


def test_alignment_is_optimal(spark):
    rng = np.random.default_rng(3)
    cases = {f"v{k}": rng.integers(0, 5, (3, int(rng.integers(3, 12)))) / 4 for k in range(12)}
    rows = [("q", e, v, f, float(x)) for v, m in cases.items() for e, line in enumerate(m) for f, x in enumerate(line)]
    scores = spark.createDataFrame(rows, "query_id string, event_idx int, video_id string, frame_idx int, score double")
    got = {r.video_id: r for r in A.align(scores, 3).collect()}
    for v, m in cases.items():
        t = m.shape[1]
        assert (got[v].score, got[v].path) == brute_alignment(m.tolist(), min(8, max(1, (t - 3) // 3)))


def test_alignment_with_few_frames(spark):
    scores = spark.createDataFrame([("q", e, "v", f, 1.0) for e in range(3) for f in range(2)], "query_id string, event_idx int, video_id string, frame_idx int, score double")
    assert [(r.path, r.score) for r in A.align(scores, 3).collect()] == [([0, 1, 1], 0.0)]


def test_frame_ids_without_a_map(spark):
    frames = spark.createDataFrame([("v", 7), ("v", 0), ("v", 2)], "video_id string, frame_idx int")
    known = spark.createDataFrame([("v", 2, 60)], "video_id string, frame_idx int, frame_id long")
    assert {r.frame_idx: r.frame_id for r in S.frame_ids(frames, known).collect()} == {7: "175", 0: "1", 2: "60"}


def test_recall_grows_with_k(spark):
    rel = spark.createDataFrame([("t", "q", 2, 1.0), ("t", "q", 30, 0.5)], "task string, query_id string, rank int, relevance double")
    truth = spark.createDataFrame([("t", "q"), ("t", "none")], "task string, query_id string")
    rows = {r.query_id: r for r in E.query_metrics(rel, truth).collect()}
    assert [rows["q"][f"r{k}"] for k in E.CUTS] == [0, 1, 1, 1, 1] and rows["q"].score == 0.8 and rows["none"].score == 0
    assert E.global_metrics(E.query_metrics(rel, truth)).first().final_score == 0.4
    assert E.global_metrics(E.query_metrics(rel, truth.limit(0))).first().final_score == 0


def test_null_and_odd_vectors(spark):
    frames = spark.createDataFrame([("v", 0, [0.0, 0.0]), ("v", 1, None), ("v", 2, [3.0, 4.0]), ("v", 3, [1.0])], "video_id string, frame_idx int, embedding array<float>")
    prompts = spark.createDataFrame([("q", 0, [0.0, 2.0])], "query_id string, prompt_idx int, embedding array<float>")
    got = {r.frame_idx: r.score for r in D.similarity(frames, prompts).collect()}
    assert got[0] == 0 and got[1] is None and got[2] == pytest.approx(0.8) and got[3] is None
    assert D.similarity(frames, prompts.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)))
def test_string_leaves(value):
    def leaves(x):
        if isinstance(x, str):
            return " " + x
        if isinstance(x, list):
            return "".join(map(leaves, x))
        return "".join(map(leaves, x.values())) if isinstance(x, dict) else ""

    assert files.string_leaves(json.loads(json.dumps(value))) == leaves(json.loads(json.dumps(value)))


def test_file_sources(spark, tmp_path):
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "L01.npy", np.arange(6, dtype="float32").reshape(3, 2))
    (tmp_path / "npy" / "bad.npy").write_bytes(b"no")
    got = files.read_vectors(spark, str(tmp_path / "npy")).orderBy("frame_idx").collect()
    assert [(r.video_id, r.frame_idx, r.embedding) for r in got] == [("L01", 0, [0, 1]), ("L01", 1, [2, 3]), ("L01", 2, [4, 5])]
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "L01.csv").write_text("n,pts,Frame_idx\n1,0.0,12\n2,0.5,37\n")
    assert [(r.frame_idx, r.frame_id) for r in files.read_frame_maps(spark, str(tmp_path / "maps")).collect()] == [(0, 12), (1, 37)]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "L01.json").write_text('{"a": ["x", {"b": "y"}]}')
    (tmp_path / "meta" / "local_val_gt.json").write_text('{"a": "z"}')
    assert [tuple(r) for r in files.read_media_text(spark, str(tmp_path / "meta")).collect()] == [("L01", "  x y")]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "2-kis.txt").write_text("a\nb")
    (tmp_path / "q" / "10-kis.txt").write_text("c")
    assert [r.query_id for r in files.read_query_files(spark, str(tmp_path / "q")).orderBy("ord").collect()] == ["2-kis", "10-kis"]
    (tmp_path / "gt.json").write_text('{"task1": [{"id": "a", "query": "x"}]}')
    assert [(r.task, r.query_id, r.query) for r in items.read_items(spark, str(tmp_path / "gt.json")).collect()] == [("task1", "a", "x")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("task1", "a", 1, "v", "7", None, None), ("task3", "c", 1, "v", None, None, ["1", "2"])], "task string, query_id string, rank int, video_id string, frame_id string, answer string, frame_ids array<string>")
    sinks.write_submission(rows, str(tmp_path / "out"))
    sinks.zip_folder(str(tmp_path / "out"), str(tmp_path / "out.zip"))
    import zipfile

    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert {n: z.read(n).decode().strip() for n in z.namelist()} == {"submission/a.csv": "v, 7", "submission/c.csv": "v, 1, 2"}
    sinks.write_task_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv" / "task3")).first().frame_id == "1;2"
    done = str(tmp_path / "done")
    assert sinks.not_yet_written(rows, done, spark, "query_id").count() == 2
    rows.where("query_id = 'a'").write.parquet(done)
    assert sinks.not_yet_written(rows, done, spark, "query_id").count() == 1


def test_streaming_ingestion(spark, tmp_path):
    from lumenframe.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "L01.json").write_text('{"a": "red cat"}')
    for _ in range(2):
        ingest.ingest_postings(ingest.metadata_stream(spark, str(tmp_path / "in")), str(tmp_path / "post"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.video_id, r.token) for r in spark.read.parquet(str(tmp_path / "post")).collect()} == {("L01", "red"), ("L01", "cat")}


def test_answers_and_encoder(spark):
    rows = spark.createDataFrame([("Trong hình, đáp án là: xanh",)], "a string")
    assert rows.select(P.without_openings(F.col("a"))).first()[0] == "xanh"
    v = rows.select(P.encode(F.lit("a b")).alias("v")).first().v
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6)
    assert rows.select(N.quoted_for_csv(F.lit(None).cast("string"))).first()[0] == '"Không rõ"'


def test_places_of_files(spark, tmp_path):
    for name, text in (("a/x.json", "{}"), ("b/truth.json", '{"task1": []}'), ("m/1/keyframes/v.npy", ""), ("m/my_objects/1.json", ""), ("m/small_objects/1.json", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for n in range(7):
        (tmp_path / f"m/my_objects/{n}.json").write_text("{}")
    paths = [str(tmp_path / x) for x in ("none.json", "a/x.json", "b/truth.json")]
    assert files.first_usable(spark, paths) == paths[2] and files.first_usable(spark, paths[:2]) is None
    assert files.first_folder(spark, [str(tmp_path / "none"), str(tmp_path / "a")]) == str(tmp_path / "a")
    assert files.first_folder(spark, [str(tmp_path / "none")], str(tmp_path / "m")).endswith("/m/my_objects")
    np.save(tmp_path / "m/1/w.npy", np.eye(3, dtype="float32"))
    got = files.read_vectors_of(spark, [str(tmp_path / "none"), str(tmp_path / "a")], str(tmp_path / "m"))
    assert sorted((r.video_id, r.frame_idx) for r in got.collect()) == [("w", 0), ("w", 1), ("w", 2)]


def test_frame_texts_skip_what_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 2, 'é "x"'), ("v1", 10, "b\n"), ("v2", 1, None)], "video_id string, frame_id int, text string")
    path = str(tmp_path / "ocr")
    sinks.write_frame_texts(rows.where("video_id = 'v1'"), path, spark)
    sinks.write_frame_texts(rows.withColumn("text", F.lit("new")), path, spark)
    got = {f.parent.name: f.read_text() for f in (tmp_path / "ocr").glob("*/part-*")}
    assert got == {"video_id=v1": '{"2":"é \\"x\\"","10":"b\\n"}\n', "video_id=v2": '{"1":"new"}\n'}


def test_pictures_that_fail_move_others_up(spark, tmp_path):
    for name, content in (("v/1.jpg", b"a"), ("v/2.jpg", b""), ("v/3.jpg", b"c"), ("w/1.png", b"d")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {(r.video_id, r.frame_idx): r.path.rpartition("/")[2] for r in files.picture_features(files.read_pictures(spark, str(tmp_path))).collect()}
    assert got == {("v", 0): "1.jpg", ("v", 1): "3.jpg", ("w", 0): "1.png"}


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    values = [-1e-7, -0.0, 0.0, 1e-7, 5e-7, -5e-7, -0.125]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(T.rounded(F.col("x")).alias("x")).collect()
    want = duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert [repr(r.x) for r in got] == [repr(x) for (x,) in want]
    spark.createDataFrame([(0, [-1e-7, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert repr(QUERIES["D1_normalize"](spark, str(tmp_path)).first().embedding) == "[-0.0, 1.0]"


def test_postings_of_a_text_lie_together(spark):
    media = spark.range(400).select(F.col("id").alias("video_id"), F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") * k % 97).cast("string")) for k in range(1, 30)]).alias("text"))
    post = B.postings(media)
    where = post.withColumn("file", F.input_file_name()).groupBy("video_id").agg(F.countDistinct("file").alias("files"), F.sum("tf").alias("words"), F.max("dl").alias("dl"))
    assert where.where("files > 1 OR words <> dl").isEmpty() and where.count() == 400


def test_texts_of_one_id_are_one_text(spark):
    media = spark.createDataFrame([(1, "red cat"), (1, "cat sat"), (2, "a"), (3, None), (4, "the")], "video_id long, text string")
    got = sorted((r.video_id, r.token, r.tf, r.dl) for r in B.postings(media).collect())
    assert got == [(1, "cat", 2, 4), (1, "red", 1, 4), (1, "sat", 1, 4), (2, "a", 1, 1), (4, "the", 1, 1)]


def test_bm25_is_alike_however_asked_words_meet(spark, monkeypatch):
    media = spark.createDataFrame([(n, f"red cat {n} dog {n % 3}x") for n in range(50)], "video_id long, text string")
    asked = spark.createDataFrame([("a", "red 1x"), ("b", "dog 7"), ("c", "2x 2x cat")], "query_id string, query string")
    post = B.postings(media)
    found = []
    for sent in (B.SENT, 0):
        monkeypatch.setattr(B, "SENT", sent)
        found.append(sorted((r.query_id, r.video_id, round(r.score, 9)) for r in B.bm25(post, B.term_statistics(post), B.query_terms(asked)).collect()))
    assert found[0] == found[1] and len(found[0]) == 150


def test_keywords_in_passes(spark):
    words = [f"w{n}" for n in range(60)] + ["w1 w2"]
    texts = spark.createDataFrame([(n, f"w{n} W{n + 1} w1 w2 xw3") for n in range(20)] + [(99, None)], "query_id long, text string")
    keywords = spark.createDataFrame([(w,) for w in [*words, None, "", "w5"]], "keyword string")
    hits = [sorted(map(tuple, keyword_hits(texts, keywords, most).collect())) for most in (1000, 9)]
    assert hits[0] == hits[1] and len(set(hits[1])) == len(hits[1]) > 60


def test_keywords_take_one_pass(spark):
    texts = spark.createDataFrame([(1, "w5 and w299999"), (2, "w300000, W7")], "query_id long, text string")
    hits = keyword_hits(texts, spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("keyword")))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, hits.collect())) == [(1, "w299999"), (1, "w5"), (2, "w7")]


@pytest.mark.parametrize("alike", [False, True])
def test_keywords_of_any_parts(monkeypatch, alike):
    if alike:  # hashes that many keywords share
        monkeypatch.setattr(K, "_hashes", lambda codes, start: np.diff(start, append=len(codes)).astype("<u8"))
    rng = random.Random(2)
    chars = ["a", "b", "é", " ", " ", "_", ",", ".", "1", "ab", " a", "中"]
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 40))) for _ in range(60)]
    words = sorted({"".join(rng.choices(chars, k=rng.randint(1, 6))) for _ in range(500)})
    edges = [(w, re.compile("(?<![^\\W])" + re.escape(w) + "(?![^\\W])")) for w in words]

    class Table(K._Table):
        def __init__(self, rows):
            kept = [k or "" for _, k in rows]
            ends, byte_ends = (np.cumsum([0, *sizes]) for sizes in (map(len, kept), (len(k.encode()) for k in kept)))
            self._map(np.array([h for h, _ in rows], np.int64), ends, np.frombuffer("".join(kept).encode("utf-32-le"), "<u4"), byte_ends, np.frombuffer("".join(kept).encode(), "u1"))

    made = {(r["many"], r["h"], r["keyword"]) for b in K._entries([pa.RecordBatch.from_arrays([pa.array(words)], ["keyword"])]) for r in b.to_pylist()}
    one, more = (Table(sorted(((h, k) for m, h, k in made if m == many), key=lambda r: r[0])) for many in (False, True))
    for size in (1 << 20, 7):
        got = set()
        for block in K._blocks(pa.array(texts), max(map(len, words)), size):
            numbers, hits = K.found(block, one, more)
            some = list(zip(numbers.tolist(), hits.to_pylist(), strict=True))
            assert len(set(some)) == len(some)
            got |= set(some)
        assert got == {(n, w) for n, t in enumerate(texts) for w, p in edges if p.search(t)}


def test_words_of_chosen_texts_without_exchange_of_texts(spark):
    texts = spark.createDataFrame([(1, "A b"), (2, "c"), (3, None), (None, "d"), (7, "b, é_1")], "id long, text string")
    words = K.words_of(texts, spark.createDataFrame([(7,), (1,), (1,), (3,), (None,), (9,)], "id long"))
    assert "Join" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.keyword for r in words.collect()) == ["a", "b", "é_1"]
    assert K.words_of(texts, spark.createDataFrame([], "id long")).count() == 0
