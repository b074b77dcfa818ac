"""Importance resampling towards a target distribution, by hashed n-gram features.

DuckDB counts in every partition: SQL unnests words and a window pairs them into n-grams, a
registered zlib function gives each distinct n-gram its bucket, and each document's bucket counts
are spilled to Parquet in the shared folder, with a row of the task's totals besides. Spark merges
the totals of raw and target texts into a gain for every bucket, scores the spilled documents, and
ranks them by a range-partitioned sort; so every text is taken apart once.

What is defined for odd rows: a null or wordless text has no feature, weight 0 and is never drawn; a
null ``doc_id`` hashes as an empty one and loses ties; repeated rows are scored and drawn each, in any
order among equals; an empty target leaves the sums of its buckets at 0; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, freed, partitions, written

BUCKETS = 10_000
#: Documents with fewer words are not drawn; of the others so many in a hundred are.
MIN_WORDS, SHARE, SEED = 20, 25, 7
#: Characters of text that DuckDB takes apart at once; longer texts are parted.
TOGETHER = 4 << 20
#: DuckDB's memory in a task; what it holds is bounded by TOGETHER, and it may spill nowhere.
MEMORY = "768MB"
_OTHERS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words, pairs of neighbours, distinct features, buckets, counts.
COUNTS = rf"""
    WITH split AS (
        SELECT n, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
    ), words AS (
        SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
    ), paired AS (
        SELECT n, word, word || ' ' || lead(word) OVER (PARTITION BY n ORDER BY place) AS pair FROM words
    ), features AS (
        SELECT n, word AS feature FROM paired UNION ALL SELECT n, pair FROM paired WHERE pair IS NOT NULL
    ), counted AS (
        SELECT n, feature, count(*) AS c FROM features GROUP BY n, feature
    ), hashed AS (
        SELECT feature, crc(feature) % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM counted)
    )
    SELECT CAST(n AS BIGINT) AS n, CAST(bucket AS BIGINT) AS bucket, CAST(sum(c) AS BIGINT) AS c FROM counted JOIN hashed USING (feature) GROUP BY n, bucket ORDER BY n, bucket
"""
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def parts(text: str, most: int) -> Iterator[str]:
    """The words of a long text in parts of about ``most`` characters; each part after the first begins with the last word of the one before."""
    text = _OTHERS.sub(" ", text).strip(" ")
    begin = end = 0
    while end < len(text):
        end = text.find(" ", max(begin + most, end + 1))
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = text.rfind(" ", 0, end) + 1


class Counter:
    """A task's DuckDB connection."""

    def __init__(self):
        import duckdb

        def crc(features: pa.ChunkedArray) -> pa.Array:
            return pa.array([zlib.crc32(f) for f in features.cast(pa.binary()).to_pylist()], pa.int64())

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.con.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")

    def __call__(self, texts: list[str | None]) -> Counts:
        """``n, bucket, count`` of lower-cased texts, in order."""
        self.con.register("texts", pa.table({"n": pa.array(range(len(texts)), pa.int32()), "text": pa.array(texts, pa.string())}))
        done = self.con.sql(COUNTS).to_arrow_table()
        self.con.unregister("texts")
        return tuple(done.column(c).to_numpy() for c in ("n", "bucket", "c"))

    def long(self, text: str, together: int) -> Counts:
        """The same of one text that is parted; the word that two parts share counts once."""
        totals = np.zeros(BUCKETS, np.int64)
        for k, part in enumerate(parts(text, together)):
            _, bucket, c = self([part])
            totals[bucket] += c
            if k:
                totals[zlib.crc32(part.partition(" ")[0].encode()) % BUCKETS] -= 1
        known = np.flatnonzero(totals)
        return np.zeros(len(known), np.int64), known, totals[known]


def spilled(texts: DataFrame, rest: list[str], together: int = TOGETHER) -> DataFrame:
    """``texts`` with ``text`` replaced by its ``buckets`` and ``counts``, and a row with null ``at`` for each task's totals; Parquet in the shared folder."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, totals = None, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            lowered = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            lowered = [t.translate(_TO_LOWER) if t else t for t in lowered]
            begin = 0
            while begin < len(lowered):
                end, size = begin, 0
                while end < len(lowered) and (end == begin or size + len(lowered[end] or "") <= together):
                    size += len(lowered[end] or "")
                    end += 1
                count = count or Counter()
                some = count.long(lowered[begin], together) if size > together else count(lowered[begin:end])
                np.add.at(totals, some[1], some[2])
                ends = np.searchsorted(some[0], np.arange(end - begin + 1)).astype(np.int32)
                values = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (some[1].astype(np.int32), some[2])]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns[:-1], *values], names)
                begin = end
        if totals.any():
            known = np.flatnonzero(totals)
            values = [pa.array([known.astype(np.int32)], pa.list_(pa.int32())), pa.array([totals[known]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in batch.schema)][:-1] + values, names)

    given = texts.select(F.monotonically_increasing_id().alias("at"), *[F.col(f"`{c}`") for c in rest], F.col("text").cast("string"))
    names = [*given.columns[:-1], "buckets", "counts"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]) + ", buckets array<int>, counts array<long>"
    return written(given.mapInArrow(freed(run), schema), "buckets")


def bucket_sums(counted: DataFrame, name: str) -> DataFrame:
    """``bucket, <name>``: the tasks' totals merged; at most so many rows as there are buckets."""
    pairs = counted.where("at IS NULL").select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias(name))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` of every bucket."""
    all_buckets = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = all_buckets.join(bucket_sums(raw, "s"), "bucket", "left").join(bucket_sums(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    d = lambda c, more: F.col(c).cast("double") + more
    ratio = d("t", 1) * d("all_s", BUCKETS) / (d("s", 1) * d("all_t", BUCKETS))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(seed: int) -> Column:
    """Gumbel noise of a document, by a digest of its id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def weighted(counted: DataFrame, gain: np.ndarray, rest: list[str]) -> DataFrame:
    """``rest`` columns with ``n_features`` and ``weight``, the floored mean of the features' gains."""
    fields = {f.name: f.dataType.simpleString() for f in counted.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            sizes = buckets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at, c = buckets.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            n, worth = (np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (c, gain[at] * c))
            weight = np.where(n > 0, worth // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n), pa.array(weight)], [*batch.schema.names[:-2], "n_features", "weight"])

    docs = counted.where("at IS NOT NULL")
    return docs.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in ("at", *rest)) + ", n_features long, weight long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``rank`` of the ``drawn`` highest scores: a sort over ranges, whose sizes say where each range's ranks begin."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]
    ranges = scored.where("eligible").repartitionByRange(partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(ranges.withColumn("place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a task of the sort
    begins = sizes.select("part", F.coalesce(before, F.lit(0)).alias("begin"))
    rank = F.col("begin") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = [*scored.columns, "rank"]
    return numbered.select(columns).unionByName(scored.where("NOT eligible").withColumn("rank", F.lit(None).cast("long")).select(columns))


def resample(documents: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, with_text: bool = False, together: int = TOGETHER) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document, and its text where asked for; the ranked ones are the sample."""
    rest = ["doc_id", "given"] if with_text else ["doc_id"]
    raw = spilled(documents.select("doc_id", F.col("text").alias("given"), "text"), rest, together)
    wanted = spilled(target.select("text"), [], together)
    gain = np.zeros(BUCKETS, np.int64)
    for row in gains(raw, wanted).collect():  # as many rows as buckets, whatever the tables hold
        gain[row.bucket] = row.gain
    # Of w words there are 2 w - 1 features.
    eligible = F.col("n_features") >= 2 * min_words - 1
    scored = written(weighted(raw, gain, rest).withColumn("score", F.col("weight") + noise(seed)).withColumn("eligible", eligible), "scored")
    drawn = share * scored.where("eligible").count() // 100
    done = ranked(scored, drawn)
    return done.select("doc_id", "n_features", "weight", "score", "rank", *([F.col("given").alias("text")] if with_text else []))
