"""A corpus pipeline over the training-data operators.

Each stage gets what its predecessor kept, written as Parquet in the shared folder and read
again, and all but the last return the columns of ``documents``: junk goes, near-duplicates keep
one document of each group, repeated passages are cut out of texts, documents with benchmark
passages go, and what is left is packed into sequences. No stage needs a column beyond doc_id and
text; null and empty texts pass through, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import BATCH_BYTES, bounded_batches, table, written
from lumenframe.llm.decontam import drop_leaks
from lumenframe.llm.packing import pack_documents
from lumenframe.llm.quality import keep_good
from lumenframe.llm.simhash import keep_one_of_each
from lumenframe.llm.suffixdedup import remove_repeats

#: Bytes of a passage that is cut out where it repeats; most passages of fifty words are longer (README).
PASSAGE = 256
#: Bytes that cross to Python together. The stages share executors, which keep the native memory of buffers that grow to twice as much.
BATCH = "3m"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """``stage``, in a session whose rows cross to Python in batches of ``BATCH``, also when its result is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, BATCH)
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


@small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; ``n_chars`` follows."""
    done = remove_repeats(docs, PASSAGE, keep_text=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the ``documents`` of ``sf_dir``; the packed pieces of what is kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
