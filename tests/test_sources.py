"""Sources that read parts of files, and keywords and texts found by tables."""

import json
import random
import re

import numpy as np
import pytest

from lumenframe.functions import providers

from lumenframe.operators import keywords
from lumenframe.sources import files, npy


@pytest.fixture
def matrices(tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "z").mkdir()
    (tmp_path / "keyframes").mkdir()
    np.save(tmp_path / "z" / "v1.npy", rng.normal(size=(1000, 7)).astype("f4"))
    np.save(tmp_path / "v1.npy", rng.normal(size=(5, 7)).astype("f4"))  # an earlier path of the same name
    np.save(tmp_path / "v2.npy", rng.normal(size=(33, 3)))
    np.save(tmp_path / "v3.npy", np.arange(12, dtype="i2").reshape(4, 3))
    np.save(tmp_path / "none.npy", np.empty((0, 4), "f4"))
    np.save(tmp_path / "flat.npy", np.arange(5.0))
    np.save(tmp_path / "columns.npy", np.asfortranarray(rng.normal(size=(6, 2))))
    np.save(tmp_path / "keyframes" / "v9.npy", np.ones((2, 2), "f4"))
    (tmp_path / "v4.NPY").write_bytes((tmp_path / "v2.npy").read_bytes())
    (tmp_path / "bad.npy").write_bytes(b"not a matrix")
    (tmp_path / "v5.npy").write_bytes((tmp_path / "v2.npy").read_bytes()[:-100])
    return tmp_path


def rows(df):
    return sorted((r.video_id, r.frame_idx, tuple(r.embedding)) for r in df.collect())


def test_a_matrix_is_read_by_many_tasks(spark, matrices):
    got = npy.scan_vectors(spark, str(matrices), split=1 << 10)
    assert got.rdd.getNumPartitions() > 20
    whole = [r for r in rows(files.read_vectors(spark, str(matrices))) if r[0] != "columns"]
    mine = rows(got)
    assert [r for r in mine if r[0] != "v5"] == whole and len(whole) == 1000 + 33 + 4 + 33 + 2
    assert [r[1] for r in mine if r[0] == "v5"] == list(range(28))  # what a file that was cut off has
    assert "v9" not in {r[0] for r in rows(npy.scan_vectors(spark, str(matrices), without=("keyframe",)))}
    assert npy.scan_vectors(spark, str(matrices / "z"), without=("v1",)).count() == 0


def test_names_are_settled_before_bytes_are_read(spark, matrices, capsys):
    files.vector_files(spark, str(matrices)).explain("formatted")
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[-1]
    paths = json.dumps([("x", str(matrices / "v3.npy"))])
    spark.dataSource.register(npy.NpySource)
    assert [r.embedding for r in spark.read.format("npy").option("paths", paths).load().orderBy("frame_idx").collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]


def test_keywords_equal_patterns(spark):
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", "_", ",", "中", "1", "ab", " a"]
    texts = [(n, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for n in range(400)] + [(400, None), (401, "A É"), (401, "a é")]
    words = sorted({"".join(rng.choices(parts[:4] + parts[6:], k=rng.randint(1, 4))).strip() for _ in range(60)} - {""})
    got = {tuple(r) for r in keywords.keyword_hits(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame([(w,) for w in [*words, words[0], ""]], "keyword string")).collect()}
    edges = [(w, re.compile("(?<![^\\W])" + re.escape(w) + "(?![^\\W])")) for w in words]

    assert got == {(n, w) for n, t in texts if t is not None for w, p in edges if p.search(t.lower())}
    assert keywords.keyword_hits(spark.createDataFrame(texts, "query_id long, text string"), spark.createDataFrame([], "keyword string")).count() == 0


def test_found_texts(spark):
    long = "x" * 60
    pictures = spark.createDataFrame([(1, f"{long}\n\n no \n{long}y ".encode()), (2, b""), (3, None)], "key long, content binary")
    assert sorted(map(tuple, providers.found_texts(pictures).collect())) == [(1, f"{long} {long}y"), (2, ""), (3, "")]
