"""The training-data operators as registered queries: thin wrappers that derive each contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import find_leaks
from .htmltext import extract_text
from .licenses import scan_licenses
from .ngramlm import train_and_score
from .packing import pack_documents
from .quality import quality_scores
from .resample import resample
from .simhash import near_duplicates
from .suffixdedup import remove_repeats
from .tokencount import count_tokens
from .topk import top_k
from .turns import repair
from .urlfilter import filter_urls


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_exact_topk": op5_exact_topk,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_scores": op10_ngram_scores,
    "op11_turn_repair": op11_turn_repair,
    "op12_html_text": op12_html_text,
    "op13_resampling": op13_resampling,
}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings WHERE embedding IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op13_resampling": r"""
        WITH crcs AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
        ), texts AS (
            SELECT 'd' AS side, row_number() OVER () AS n, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
        ), split AS (
            SELECT side, n, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts WHERE text IS NOT NULL
        ), features AS (
            SELECT side, n, unnest(w) AS f FROM split
            UNION ALL SELECT side, n, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM split WHERE len(w) > 1
        ), counted AS (
            SELECT side, n, f, count(*) AS c FROM features GROUP BY ALL
        ), bytes AS (
            SELECT f, list_transform(range(1, 2 * strlen(f), 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b
            FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted))
        ), hashed AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crcs
        ), placed AS (
            SELECT side, n, bucket, c FROM counted JOIN hashed USING (f)
        ), sums AS (
            SELECT bucket, sum(c) FILTER (side = 'd') AS s, sum(c) FILTER (side = 'b') AS t FROM placed GROUP BY bucket
        ), totals AS (
            SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM sums
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * (ss + 10000) / ((coalesce(s, 0) + CAST(1 AS DOUBLE)) * (tt + 10000)))) AS BIGINT) AS gain FROM sums, totals
        ), weights AS (
            SELECT n, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(sum(c * gain) / sum(c)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY n
        ), digests AS (
            SELECT n, doc_id, substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM texts WHERE side = 'd'
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_sum(list_transform(range(8), lambda i: (strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) * (1::BIGINT << (28 - 4 * i)))) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
            FROM digests LEFT JOIN weights USING (n)
        ), fit AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 39) AS m FROM scored
        )
        SELECT doc_id, n_features, weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 39 AND r <= 25 * m // 100 THEN r END AS rank FROM fit
    """,
}
