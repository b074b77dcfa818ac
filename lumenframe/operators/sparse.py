"""Keyword retrieval: BM25 over media texts, all queries in one plan.

A text's words are counted where it lies, without an exchange. Statistics are grouped by word with
map-side sums; asked words go to the postings, and a text's hits are added up before they are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boosted_tokens, raw_words, tokens_of
from ..sources.staging import bounded_batches, staged
from .dense import ranked

#: Saturation, length share, and what replaces negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Asked words that are sent to all tasks; more of them meet the postings in an exchange.
SENT = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``video_id, token, tf, dl`` of texts, each a list of its words."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = batch.column(1).flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text = pairs // n
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), coded.dictionary.take(pa.array(pairs % n)), pa.array(tf), pa.array(lengths[text])], ["video_id", "token", "tf", "dl"])


def postings(media: DataFrame) -> DataFrame:
    """``video_id, token, tf, dl`` of ``media(video_id, text)``; a text's length stays with its rows, which spares a join.

    Written once, as all statistics and the search read it: every text is parted into words and counted
    in one scan, where it lies, so its postings lie together. Texts of one id are taken as one.
    """
    bounded_batches(media.sparkSession)
    if not media.groupBy("video_id").count().where("count > 1").isEmpty():
        media = media.groupBy("video_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    words = media.select("video_id", raw_words(F.col("text")).alias("w")).select("video_id", tokens_of(F.col("w")).alias("t"))
    return staged(words.mapInArrow(_counted, f"video_id {dict(media.dtypes)['video_id']}, token string, tf long, dl long"), "postings")


def corpus_statistics(post: DataFrame) -> DataFrame:
    """One row: texts and mean length."""
    return post.groupBy("video_id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_statistics(post: DataFrame) -> DataFrame:
    """``token, df, idf``: negative weights become a share of the mean weight."""
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    n = F.broadcast(corpus_statistics(post).select("n"))  # one row
    return weights_of(df.join(n), F.col("n"))


def weights_of(df: DataFrame, n: Column) -> DataFrame:
    """The same of ``df(token, df)`` among ``n`` texts."""
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
    return raw.join(mean).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, words: Column | None = None) -> DataFrame:
    """``query_id, token, qtf`` of ``queries(query_id, query)``: names, codes and quotes weigh more."""
    words = boosted_tokens(F.col("query")) if words is None else words
    return queries.select("query_id", F.explode(words).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _small(wanted: DataFrame) -> DataFrame:
    """Asked words, to be sent to the postings where they are not too many: a text's hits are then added up where it lies."""
    wanted = staged(wanted, "wanted")
    return F.broadcast(wanted) if wanted.count() <= SENT else wanted


def bm25(post: DataFrame, terms: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, video_id, score`` of every text that shares a word with the query."""
    wanted = asked.join(terms.select("token", "idf"), "token")
    average = F.broadcast(corpus_statistics(post).select("avgdl"))  # one row
    hits = post.join(_small(wanted), "token").join(average)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "video_id").agg(F.sum(part).alias("score"))


def sparse_search(media: DataFrame, queries: DataFrame, k: int | None = None, words: Column | None = None) -> DataFrame:
    """Ranked texts with a positive score."""
    post = postings(media)
    scored = bm25(post, term_statistics(post), query_terms(queries, words))
    return ranked(scored.where(F.round("score", 6) > 0), k=k)
