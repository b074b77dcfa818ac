"""Searches that leave out what cannot win, against searches that look at everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.text import tokens
from lumenframe.operators import blockmax as M
from lumenframe.operators import dense as D
from lumenframe.operators import framepass as P
from lumenframe.operators import nearest as K
from lumenframe.operators import sparse as B


def ranks(df):
    return sorted((r.query_id, r["rank"], r.video_id, round(r.score, 5)) for r in df.collect())


@pytest.fixture(scope="module")
def common_words():
    """Texts of a few hundred common and many rare words: 8,000 of 5 to 60 words."""
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 2001) ** 1.05
    words = rng.choice([f"w{i}x" for i in range(2000)], (8000, 60), p=share / share.sum())
    texts = [" ".join(row[: rng.integers(5, 61)]) for row in words]
    queries = [f"w{rng.integers(0, 3)}x w{rng.integers(3, 40)}x w{rng.integers(200, 2000)}x w{rng.integers(200, 2000)}x" for _ in range(40)]
    return texts, [*queries, "w0x", "w0x w1x w2x", "unknown", ""]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_block_max_search_is_exact_and_looks_at_little(spark, common_words, kind):
    texts, asked = common_words
    media = spark.createDataFrame(list(enumerate(texts)), "video_id long, text string").withColumn("video_id", F.col("video_id").cast(kind)).repartition(5)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    terms = B.query_terms(queries, tokens(F.col("query")))
    index = M.block_index(media, shard=1024)
    for k in (1, 10):
        found, walk = M.block_max_search(index, terms, k)
        assert ranks(found) == ranks(B.sparse_search(media, queries, k, tokens(F.col("query"))))
        rows = {r.query_id: r for r in walk.collect()}
        mixed = [rows[q] for q in range(40)]
        assert sum(r.read for r in mixed) < 0.2 * sum(r.postings for r in mixed)


def test_block_max_search_with_repeated_words_and_nothing_to_find(spark, common_words):
    media = spark.createDataFrame([("a", "cat cat sat"), ("b", "cat"), ("c", ""), ("d", None), ("e", "dog " * 5000), ("f", "Cat dog"), *((str(i), f"other{i} words") for i in range(9))], "video_id string, text string")
    queries = spark.createDataFrame([("q", "cat dog dog"), ("r", "bird")], "query_id string, query string")
    terms = B.query_terms(queries)
    found, walk = M.block_max_search(M.block_index(media), terms, 3)
    assert ranks(found) == ranks(B.sparse_search(media, queries, 3)) != []
    assert [r.query_id for r in walk.collect()] == ["q"]
    assert M.block_max_search(M.block_index(media.limit(0)), terms, 3)[0].count() == 0
    assert M.block_max_search(M.block_index(media), terms.limit(0), 3)[0].count() == 0


def test_shards_of_long_texts_are_packed_in_parts(spark, common_words):
    texts, asked = common_words
    media = spark.createDataFrame(list(enumerate(texts)), "video_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = M.block_index(media, packed=3000)
    totals = index.rows.where(F.col("token") == M.TEXTS).select("n", "total").collect()
    assert max(r.total for r in totals if r.n > 1) <= 3000 and sum(r.n for r in totals) == sum(bool(t) for t in texts) and len(totals) > 2 * index.shards
    assert ranks(M.block_max_search(index, B.query_terms(queries, tokens(F.col("query"))), 5)[0]) == ranks(B.sparse_search(media, queries, 5, tokens(F.col("query"))))


# ---- one pass over frames


@pytest.fixture(scope="module")
def long_videos(spark):
    """Videos around the bounds of a block, of one to three frames, a frame without a vector and one of another length."""
    rng = np.random.default_rng(3)
    sizes = [P.CHUNK - 1, P.CHUNK, P.CHUNK + 1, P.CHUNK + 2, 2 * P.CHUNK + 3, 1, 2, 3, 40]
    rows = [(f"v{v}", i, x.tolist()) for v, n in enumerate(sizes) for i, x in enumerate(rng.normal(size=(n, 6)).astype("f4"))]
    rows += [("odd", 0, None), ("odd", 1, [1.0] * 6), ("odd", 2, [0.0] * 6), ("odd", 3, [1.0] * 5), ("odd", 4, [2.0, 0.0, 1.0, 0.0, 0.0, 1.0])]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, embedding array<float>").repartition(6)
    prompts = spark.createDataFrame([(f"q{q}", p, rng.normal(size=6).tolist()) for q in range(15) for p in range(1 + q % 4)], "query_id string, prompt_idx int, embedding array<double>")
    return frames, prompts


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:-1] == y[:-1] and (x[-1] == y[-1] or x[-1] == pytest.approx(y[-1], abs=1e-9)), (x, y)


def test_one_pass_equals_the_chain_of_windows(spark, long_videos):
    frames, prompts = long_videos
    hits, series = D.dense_search(frames, prompts, 3)
    want = sorted((r.query_id, r["rank"], r.video_id, r.best_frame, r.n_frames, r.score) for r in hits.collect())
    blocks, files = P.frame_blocks(frames), P.ship_prompts(prompts)
    got = P.top_videos(blocks, files, 3)
    near(sorted((r.query_id, r["rank"], r.video_id, r.best_frame, r.n_frames, r.score) for r in got.collect()), want)
    every = sorted((r.query_id, r.video_id, r.best_frame, r.n_frames, r.score or 0) for r in D.video_peaks(series).collect())
    near(sorted((r.query_id, r.video_id, r.best_frame, r.n_frames, r.score or 0) for r in P.peaks_of(blocks, files).collect()), every)
    pairs = spark.createDataFrame([("q1", "v4"), ("q14", "v4"), ("q3", "v7"), ("q3", "odd"), ("q0", "none"), ("none", "v1")], "query_id string, video_id string")
    for column in ("score", "smooth"):
        told = sorted((r.query_id, r.video_id, r.frame_idx, r[column] or 0) for r in series.join(pairs, ["query_id", "video_id"]).collect())
        near(sorted((r.query_id, r.video_id, r.frame_idx, r[column] or 0) for r in P.frame_series(blocks, files, pairs).collect()), told)


def test_best_videos_are_all_that_is_exchanged(spark, long_videos, capsys):
    frames, prompts = long_videos
    top = P.top_videos(P.frame_blocks(frames.where("frame_idx < 40").repartition("video_id")), P.ship_prompts(prompts), 2)
    top.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow (") and "Exchange hashpartitioning" not in plan.split("MapInArrow")[0]
    assert top.groupBy("query_id").count().where("count <> 2").isEmpty()


def test_prompts_of_many_queries_come_in_blocks(spark, long_videos, monkeypatch):
    frames, _ = long_videos
    rng = np.random.default_rng(5)
    prompts = spark.createDataFrame([(f"q{q:05}", p, rng.normal(size=6).tolist()) for q in range(2500) for p in range(3)], "query_id string, prompt_idx int, embedding array<double>")
    some = frames.where("video_id IN ('v5', 'v6', 'v7', 'odd')")
    files = P.ship_prompts(prompts.coalesce(1))
    got = P.peaks_of(P.frame_blocks(some), files).collect()
    assert len(got) == 2500 * 4
    want = {(r.query_id, r.video_id): r.score for r in D.video_peaks(D.smoothed(D.fused_prompts(D.similarity(some, prompts)))).collect()}
    assert all((r.score or 0) == pytest.approx(want[r.query_id, r.video_id] or 0, abs=1e-9) for r in got)


# ---- nearest frames


def test_nearest_frames_are_exact_and_few_blocks_are_opened(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 12_000)] + 0.25 * rng.normal(size=(12_000, 24))).astype("f4")
    x[100:160] = x[99]  # ties
    frames = spark.createDataFrame([(f"v{i % 50}", i // 50, v.tolist()) for i, v in enumerate(x)] + [("none", 0, None), ("none", 1, [1.0, 2.0])], "video_id string, frame_idx int, embedding array<float>").repartition(5)
    asked = [(f"q{i}", p, (x[rng.integers(0, 12_000)] + 0.1 * rng.normal(size=24)).tolist()) for i in range(25) for p in range(2)] + [("tie", 0, x[99].tolist())]
    queries = spark.createDataFrame(asked, "query_id string, prompt_idx int, embedding array<double>")
    index = K.pivot_index(frames)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    names = np.array([f"v{i % 50}/{i // 50:08}" for i in range(12_000)])
    for k in (1, 15):
        found, opened = K.nearest(index, queries, k)
        got = {}
        for r in found.collect():
            got.setdefault((r.query_id, r.prompt_idx), {})[r["rank"]] = (f"{r.video_id}/{r.frame_idx:08}", round(r.score, 6))
        for q, p, v in asked:
            score = np.round(unit @ (np.array(v) / np.sqrt(np.dot(v, v))), 6)
            order = sorted(range(12_000), key=lambda i: (-score[i], names[i]))[:k]
            assert [got[q, p][n + 1] for n in range(k)] == [(names[i], pytest.approx(score[i], abs=2e-6)) for i in order]
        assert opened.count() < 0.25 * index.blocks.count() * len(asked)
    assert index.blocks.agg(F.sum("n"), F.max("n")).first() == (12_000, K.BLOCK)


def test_nearest_of_few_and_no_frames(spark):
    frames = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 0.0]), ("b", 0, [0.0, 2.0])], "video_id string, frame_idx int, embedding array<float>")
    queries = spark.createDataFrame([("q", 0, [1.0, 1.0]), ("q", 3, [3.0, 0.0])], "query_id string, prompt_idx int, embedding array<double>")
    got = [(r.prompt_idx, r["rank"], r.video_id, r.frame_idx, round(r.score, 6)) for r in K.nearest(K.pivot_index(frames), queries, 2)[0].orderBy("prompt_idx", "rank").collect()]
    assert got == [(0, 1, "a", 0, 0.707107), (0, 2, "b", 0, 0.707107), (3, 1, "a", 0, 1.0), (3, 2, "a", 1, 0.0)]
    assert K.nearest(K.pivot_index(frames.limit(0)), queries, 2)[0].count() == 0
