"""What executors fetch from the shared folder and map into memory; bounded bit filters among it."""

from __future__ import annotations

import fcntl
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bits a key, bits of a filter at most (4 GB on an executor's disk, mapped, for 2 billion keys; beyond that it lets more pass, and nothing is lost), and its files.
BITS_A_KEY, MOST_BITS, FILES = 16, 1 << 35, 4
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def laid_out(files: tuple[str, ...], lay: Callable[[str], None]) -> str:
    """The folder where ``lay`` has put what is in fetched ``files``; the first worker of an executor does it, and drops the files.

    A new executor fetches them from the shared folder again.
    """
    done = f"{SparkFiles.getRootDirectory()}/mapped-{files[0]}"
    with open(f"{done}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(f"{done}/ready"):
            os.makedirs(done, exist_ok=True)
            lay(done)
            with open(f"{done}/ready", "w"):
                pass
            for name in files:
                os.remove(SparkFiles.get(name))
    return done


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits.bit_length() + 1)
    return [((keys * odd) ^ (keys >> np.uint64(29)) * odd) >> shift for odd in _ODD]


class BitFilter:
    """Says for many 64-bit keys at once whether they may be among those it was made of. Picklable: file names and a size."""

    def __init__(self, files: tuple[str, ...], bits: int):
        self.files, self.bits = files, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not self.files:
            return np.zeros(len(keys), bool)
        words = _loaded(self.files, self.bits)
        out = np.ones(len(keys), bool)
        for at in _places(keys, self.bits):
            out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


@lru_cache(maxsize=8)
def _loaded(files: tuple[str, ...], bits: int) -> np.ndarray:
    def lay(folder: str) -> None:
        words = np.memmap(f"{folder}/bits", "<u8", "w+", shape=(bits // 64,))
        for name in files:
            for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches():
                words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
        words.flush()

    return np.memmap(f"{laid_out(files, lay)}/bits", "<u8", "r")


def bit_filter(keys: DataFrame) -> BitFilter:
    """A filter of the distinct keys in ``keys(k)``."""
    n = keys.count()
    if not n:
        return BitFilter((), 64)
    bits = min(MOST_BITS, max(1 << 12, 1 << (n * BITS_A_KEY - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)))
            if len(at):
                word, one = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(np.bitwise_or.reduceat(one, first).view(np.int64))], ["w", "b"])

    words = keys.select("k").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    return BitFilter(ship(words.coalesce(FILES), "filter"), bits)
