"""Model providers: encoders, translation, picture questions and text in pictures.

A provider maps a pandas Series to a Series and is made once a worker. No model is part of this
package: the stand-ins below are deterministic and say nothing about any model's quality.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StringType

from . import lexicon as X

Provider = Callable[[pd.Series], pd.Series]


def column(provider: Callable[[], Provider], kind: DataType) -> Callable[[Column], Column]:
    """A column function of what ``provider()`` returns; it is called once for each task."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = provider()
        for batch in batches:
            yield run(batch)

    return apply


def hash_encoder(dims: int = 64) -> Provider:
    """Words' signs, seeded by their checksum, summed to a unit vector."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(dims)
        for word in (text or "").lower().split():
            v += np.random.default_rng(crc32(word.encode())).choice((-1.0, 1.0), dims)
        n = np.linalg.norm(v)
        return (v / n if n else v).astype("float32").tolist()

    return lambda s: s.map(one)


def picture_encoder(dims: int = 64) -> Provider:
    """A unit vector seeded by a picture's checksum; null for what is no picture (here: empty)."""

    def one(content: bytes | None) -> list[float] | None:
        if not content:
            return None
        v = np.random.default_rng(crc32(content)).choice((-1.0, 1.0), dims)
        return (v / np.linalg.norm(v)).astype("float32").tolist()

    return lambda s: s.map(one)


def identity_translator() -> Provider:
    return lambda s: s


def hash_verifier() -> Provider:
    """``Score: x`` from a checksum."""
    return lambda s: s.map(lambda t: f"Score: {crc32((t or '').encode()) % 101 / 10}")


def ocr_text(found: Column) -> Column:
    """Text of ``array<struct<text, confidence>>``: confident parts, parted by spaces."""
    return F.array_join(F.transform(F.filter(found, lambda x: x["confidence"] > 0.3), lambda x: x["text"]), " ")


def encode(text: Column, provider: Callable[[], Provider] = hash_encoder) -> Column:
    return column(provider, ArrayType(FloatType()))(text)


def encode_picture(content: Column, provider: Callable[[], Provider] = picture_encoder) -> Column:
    return column(provider, ArrayType(FloatType()))(content)


def translate(text: Column, provider: Callable[[], Provider] = identity_translator) -> Column:
    """The provider's text; the source where that has fewer than two words."""
    out = column(provider, StringType())(text)
    return F.when(F.size(F.filter(F.split(F.coalesce(out, F.lit("")), r"\s+"), lambda w: w != "")) < 2, text).otherwise(out)


def verify(prompt: Column, provider: Callable[[], Provider] = hash_verifier) -> Column:
    return column(provider, StringType())(prompt)


_OPENINGS = [re.compile("^" + p, re.IGNORECASE) for p in X.ANSWER_OPENINGS]


def without_openings(answers: Column) -> Column:
    """Answers without their openings, again and again until none is left; an opening that is all of it stays."""

    def one(text: str | None) -> str | None:
        before = None
        while text is not None and text != before:
            before = text
            for p in _OPENINGS:
                text = p.sub("", text).strip() or text
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(answers)


@F.udtf(returnType="part int, text string, confidence double", useArrow=True)
class FoundTexts:
    """A picture's texts as rows, for a lateral join: what a recogniser gives, one part after the other.

    The stand-in takes lines of the bytes for texts, and a rest of each one's length for its confidence.
    """

    def eval(self, content: bytes | None) -> Iterator[tuple[int, str, float]]:
        for part, line in enumerate((content or b"").decode("utf-8", "replace").split("\n")):
            if line.strip():
                yield part, line.strip(), len(line.strip()) % 101 / 100


def found_texts(pictures: DataFrame, least: float = 0.3) -> DataFrame:
    """``key, text`` of ``pictures(key, content)``: confident parts, in order, parted by spaces; empty where there is none."""
    pictures.sparkSession.udtf.register("found_texts", FoundTexts)
    rows = pictures.sparkSession.sql("SELECT key, part, text FROM {pictures}, LATERAL found_texts(content) WHERE confidence > {least}", pictures=pictures, least=least)
    joined = rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), " ").alias("text"))
    return pictures.select("key").join(joined, "key", "left").withColumn("text", F.coalesce("text", F.lit("")))
