"""Exact token counts at every prefix of a text, by dynamic programming; truncation and budgets need no second encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import freed

DEFAULT = "byte_bpe_50k.json"
#: Characters of text that are worked on together.
TOGETHER = 1 << 22


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers by its name, or the path itself."""
    return name if "/" in name else public_tokenizers.path(name)


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= TOGETHER:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_prefixes(docs: DataFrame, tokenizer: str = DEFAULT, id_col: str = "doc_id", text_col: str = "text", budget: int = 512, keep: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_chars, n_tokens, within, prefix_counts``.

    ``prefix_counts[i]`` (from 0; only with ``keep``, else null) is the number of tokens of the
    text's first i + 1 characters, exactly as the tokenizer's library would count that prefix on
    its own; ``n_tokens`` is its last entry. ``within`` is the length in characters of the longest
    prefix of at most ``budget`` tokens. Null and empty texts have no characters and no tokens.
    Null ids, repeated rows and further columns do not matter; an empty table gives an empty one.
    """
    name = tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path(name))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups(texts):
                rows = []
                for counts in bpe.prefix_counts_of([t or "" for t in texts[a:b]]):
                    n = int(counts[-1]) if len(counts) else 0
                    fit = np.flatnonzero(counts <= budget) if n > budget else ()
                    rows.append((len(counts), n, len(counts) if n <= budget else int(fit[-1]) + 1 if len(fit) else 0, counts.astype(np.int32) if keep else None))
                cols = list(zip(*rows, strict=True))
                sizes = pc.binary_length(batch.column(1).slice(a, b - a)).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), sizes, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int32()))], ["doc_id", "n_bytes", "n_chars", "n_tokens", "within", "prefix_counts"])

    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, within long, prefix_counts array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(run), schema)


def tokens_of_prefix(chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters, from a row of ``token_prefixes``."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size("prefix_counts"))
    return F.when(n <= 0, F.lit(0)).otherwise(F.element_at("prefix_counts", n.cast("int")))


def longest_within(budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from a row of ``token_prefixes``."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform("prefix_counts", lambda c, i: F.when(c <= limit, i + 1))), F.lit(0))


def count_tokens(docs: DataFrame, limit: int = 512, tokenizer: str = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, and ``within``: where to cut a text that is over the limit."""
    counted = token_prefixes(docs, tokenizer, id_col, text_col, limit, keep=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "within")
