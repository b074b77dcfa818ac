"""The corpus pipeline, stage by stage, on planted rows."""

import corpus_pipeline as pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm.common import written

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out.append(written(stage(spark, out[-1], DATA), f"test{k}"))
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)
        assert 0 < after.count() <= before.count() and after.select("doc_id").subtract(before.select("doc_id")).isEmpty()


def test_decisions(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = {r.doc_id for r in stages[1].collect()}
    assert sum((i in good) == (q == 1) for i, q in labels.items()) >= 0.98 * len(labels)
    texts = [r.text for r in stages[2].collect()]
    assert len(texts) == len(set(texts)) < stages[1].count()
    n = pipeline.PASSAGE
    before, seen, again = {r.doc_id: r.text for r in stages[2].collect()}, {}, set()
    for i, t in before.items():
        b = t.encode()
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                again |= {i, seen[w]}
            seen[w] = i
    assert {r.doc_id for r in stages[3].collect() if r.text != before[r.doc_id]} == again
    items = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r.text.split()).lower() for r in stages[4].collect() for i in items)
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", None), (2, "", "x"), (3, "w " * 3000, "x"), (3, "w " * 3000, "x")], "doc_id long, text string, score string")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 5


def test_rows_cross_in_small_batches(spark):
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.expr("repeat(' some words', 5000)")).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for _, stage in pipeline.STAGES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        stage(spark, docs.limit(0), DATA)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 4 << 20  # 22 MB in all
