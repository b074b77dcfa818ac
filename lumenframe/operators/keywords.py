"""Keywords of a table in texts: parts of texts are looked up in mapped tables of all keywords, in one pass over the texts."""

from __future__ import annotations

import fcntl
import os
import re
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import bounded_batches, shipped, staged

#: Hits that are returned at once.
TOGETHER = 1 << 16
#: Characters of texts that are looked up at once.
BLOCK = 1 << 21
#: A word, and the rest of one.
WORD, REST = re.compile(r"\w+"), re.compile(r"\w*")
#: Stands before, between and after texts; no character.
EDGE = 0x110000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Of a text: its number, itself, and where the piece begins, where no keyword begins any more, and where none goes on.
Piece = tuple[int, str, int, int, int]


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


@lru_cache(maxsize=1)
def _of_words() -> np.ndarray:
    """Which characters are parts of words, by code."""
    return np.array([*(_inside(chr(c)) for c in range(EDGE)), False])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def _hashes(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each part: the sum of its mixed characters by powers of an odd number."""
    length = np.diff(start, append=len(codes))
    powers = np.full(length.max(), _ODD[1])
    powers[0] = 1
    at = np.arange(len(codes)) - np.repeat(start, length)
    return _mixed(np.add.reduceat(_mixed((codes + np.uint64(1)) * _ODD[1]) * np.cumprod(powers)[at], start))


def _chained(before: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Hashes of several parts, from those of all but the last and of the last."""
    return _mixed(before + part * _ODD[1])


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each between edges; where parts (a word, or any other character) start; their hashes."""
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le"), "<u4").copy()
    codes[np.cumsum([0, *(len(t) + 1 for t in texts)])] = EDGE
    word = _of_words()[codes]
    start = np.flatnonzero(np.concatenate(([True], ~(word[1:] & word[:-1]))))
    return codes, start, _hashes(codes, start)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``many, h, keyword``: whether a keyword has several parts, and their hash; if it has, its beginnings besides, without a keyword."""
    for batch in batches:
        every = batch.column(0).to_pylist()
        if not every:
            continue
        codes, start, parts = _cut(every)
        edges = np.flatnonzero(codes[start] == EDGE)
        h, several = parts[edges[:-1] + 1], np.diff(edges) > 2
        many, hashes, keywords = several.tolist(), [h], list(every)
        for k in np.flatnonzero(several):
            before = h[k : k + 1].copy()
            for part in range(edges[k] + 2, edges[k + 1]):
                many.append(True)
                hashes.append(before)
                keywords.append(None)
                before = _chained(before, parts[part : part + 1])
            h[k] = before[0]
        yield pa.RecordBatch.from_arrays([pa.array(many), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(keywords, pa.string())], ["many", "h", "keyword"])


def _laid_out(files: tuple[str, ...], lay: Callable[[str, tuple[str, ...]], None]) -> str:
    """The folder where an executor's first worker has laid out what is in fetched files."""
    folder = f"{SparkFiles.getRootDirectory()}/mapped-{files[0]}"
    with open(f"{folder}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(f"{folder}/ready"):
            os.makedirs(folder, exist_ok=True)
            lay(folder, files)
            with open(f"{folder}/ready", "w"):
                pass
            for name in files:
                os.remove(SparkFiles.get(name))
    return folder


class _Table:
    """Keywords ordered by hashes, mapped, so that a worker's memory doesn't grow with them; a beginning has no characters."""

    #: Hashes; where keywords end, after a zero, and their characters by code; the same of their bytes.
    FILES = {"h": "<i8", "ends": "<i8", "codes": "<u4", "byte_ends": "<i8", "utf8": "u1"}

    def __init__(self, files: tuple[str, ...]):
        folder = _laid_out(files, self._lay)
        self._map(*(np.memmap(f"{folder}/{name}", kind, "r") if os.path.getsize(f"{folder}/{name}") else np.empty(0, kind) for name, kind in self.FILES.items()))

    def _map(self, h: np.ndarray, ends: np.ndarray, codes: np.ndarray, byte_ends: np.ndarray, utf8: np.ndarray) -> None:
        self.size, self.h, self.ends, self.codes = len(h), h, ends, codes
        self.strings = pa.Array.from_buffers(pa.large_string(), self.size, [None, pa.py_buffer(byte_ends), pa.py_buffer(utf8)])

    @classmethod
    def _lay(cls, folder: str, files: tuple[str, ...]) -> None:
        with ExitStack() as opened:
            h, ends, codes, byte_ends, utf8 = (opened.enter_context(open(f"{folder}/{name}", "wb")) for name in cls.FILES)
            for out in (ends, byte_ends):
                out.write(bytes(8))
            for name in files:
                for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches():
                    some = [k or "" for k in batch.column(1).to_pylist()]
                    h.write(batch.column(0).to_numpy().astype("<i8").tobytes())
                    ends.write((codes.tell() // 4 + np.cumsum([len(k) for k in some], dtype="<i8")).tobytes())
                    codes.write("".join(some).encode("utf-32-le"))
                    byte_ends.write((utf8.tell() + np.cumsum([len(k.encode()) for k in some], dtype="<i8")).tobytes())
                    utf8.write("".join(some).encode())

    def at(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``hashes``, each once, and an entry of that hash; again while further entries share it."""
        if self.size:
            wanted = hashes.view(np.int64)
            place, entry = np.arange(len(wanted)), np.searchsorted(self.h, wanted)
            while True:
                here = (self.h[np.minimum(entry, self.size - 1)] == wanted[place]) & (entry < self.size)
                place, entry = place[here], entry[here]
                if not len(place):
                    break
                yield place, entry
                entry = entry + 1

    def spans(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ends[entries], self.ends[entries + 1]

    def keywords(self, entries: np.ndarray) -> pa.Array:
        return self.strings.take(pa.array(entries)).cast(pa.string())

    def equal(self, entries: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which keywords are the characters there."""
        mine, stop = self.spans(entries)
        same = stop - mine == end - begin
        length = (end - begin)[same]
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) - np.repeat(first, length)
        alike = codes[np.repeat(begin[same], length) + at] == self.codes[np.repeat(mine[same], length) + at]
        same[same] = np.logical_and.reduceat(alike, first) if len(first) else True
        return same


@lru_cache(maxsize=4)
def _table(files: tuple[str, ...]) -> _Table:
    return _Table(files)


def stands(keyword: str, text: str) -> bool:
    """Whether a keyword stands in a text between word edges."""
    at = text.find(keyword)
    while at >= 0:
        end = at + len(keyword)
        if not (at and _inside(text[at - 1])) and not (end < len(text) and _inside(text[end])):
            return True
        at = text.find(keyword, at + 1)
    return False


def _blocks(texts: pa.Array, longest: int, size: int) -> Iterator[list[Piece]]:
    """Pieces of texts, of about ``size`` characters together, at most one of a text in a block."""
    block, chars = [], 0
    for n, text in enumerate(texts):
        text, begin = text.as_py(), 0
        while begin < len(text):
            end = REST.match(text, min(len(text), begin + size)).end()
            block.append((n, text, begin, end, min(len(text), end + longest + 1)))
            chars += end - begin
            begin = end
            if chars >= size:
                yield block
                block, chars = [], 0
    if block:
        yield block


def found(block: list[Piece], one: _Table, more: _Table) -> tuple[np.ndarray, pa.Array]:
    """Numbers of texts, and keywords that begin in their pieces and stand between word edges, each once a piece."""
    codes, start, hashes = _cut([text[begin:over] for _, text, begin, _, over in block])
    stop = np.append(start[1:], len(codes))
    edge = codes[start] == EDGE
    owner = np.cumsum(edge) - 1
    sizes = np.array([over - begin for _, _, begin, _, over in block])
    first = np.cumsum(sizes + 1) - sizes
    word = _of_words()[codes[start]]
    may_begin, may_end = word.copy(), word.copy()
    may_begin[1:] |= ~word[:-1]
    may_end[:-1] |= ~word[1:]
    after_word = [k for k, (_, text, begin, _, _) in enumerate(block) if begin and _inside(text[begin - 1])]
    cut = np.searchsorted(start, first[after_word])
    may_begin[cut] &= word[cut]
    may_begin &= ~edge & (start < np.append(first + [end - begin for _, _, begin, end, _ in block], 0)[owner])

    numbers, keywords = [np.empty(0, np.int64)], [pa.array([], pa.string())]

    def hit(table: _Table, begin: np.ndarray, last: np.ndarray, entry: np.ndarray) -> None:
        pairs, at = np.unique(owner[begin] * table.size + entry, return_index=True)
        who, entry = np.divmod(pairs, table.size)
        right = table.equal(entry, codes, start[begin[at]], stop[last[at]])
        for n in np.flatnonzero(~right):  # another text of that hash; the keyword may stand after it
            right[n] = stands(table.keywords(entry[n : n + 1])[0].as_py(), block[who[n]][1])
        numbers.append(who[right])
        keywords.append(table.keywords(entry[right]))

    order = np.argsort(hashes)
    new = np.append(True, np.diff(hashes[order]) != 0)
    distinct, ids = hashes[order][new], np.empty(len(hashes), np.int64)
    ids[order] = np.cumsum(new) - 1
    for place, entry in one.at(distinct):
        known = np.full(len(distinct), -1)
        known[place] = entry
        at = np.flatnonzero(may_begin & may_end & (known[ids] >= 0))
        hit(one, at, at, known[ids[at]])

    goes_on = np.zeros(len(distinct), bool)
    for place, entry in more.at(distinct):
        begin, end = more.spans(entry)
        goes_on[place[begin == end]] = True
    begin = np.flatnonzero(may_begin & goes_on[ids])
    last, h = begin, hashes[begin]
    while len(begin):
        last = last + 1
        inner = ~edge[last]
        begin, last = begin[inner], last[inner]
        h = _chained(h[inner], hashes[last])
        goes = np.zeros(len(begin), bool)
        for place, entry in more.at(h):
            b, e = more.spans(entry)
            goes[place[b == e]] = True
            whole = (b < e) & may_end[last[place]]
            hit(more, begin[place[whole]], last[place[whole]], entry[whole])
        begin, last, h = begin[goes], last[goes], h[goes]
    return np.array([n for n, *_ in block])[np.concatenate(numbers)], pa.concat_arrays(keywords)


def _lay_ids(folder: str, files: tuple[str, ...]) -> None:
    with open(f"{folder}/ids", "wb") as out:
        for name in files:
            for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches():
                out.write(batch.column(0).to_numpy().astype("<i8").tobytes())


@lru_cache(maxsize=1)
def _ids(files: tuple[str, ...]) -> np.ndarray:
    path = f"{_laid_out(files, _lay_ids)}/ids"
    return np.memmap(path, "<i8", "r") if os.path.getsize(path) else np.empty(0, "<i8")


def words_of(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``keyword``: every lower-case word of those ``texts(id, text)`` whose whole number ``id`` is in ``chosen(id)``.

    Executors fetch these ids in order and map them, so no text is exchanged.
    """
    bounded_batches(texts.sparkSession)
    files = shipped(chosen.where("id IS NOT NULL").select(F.col("id").cast("long")).distinct().orderBy("id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = _ids(files), batch.column(0).to_numpy()
            here = np.zeros(len(wanted), bool)
            if len(ids):
                here = ids[np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)] == wanted
            some = batch.column(1).filter(pa.array(here))
            yield pa.RecordBatch.from_arrays([pa.array({w for text in some for w in WORD.findall(text.as_py())}, pa.string())], ["keyword"])

    return texts.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long"), F.lower("text").alias("text")).mapInArrow(run, "keyword string").distinct()


def keyword_hits(texts: DataFrame, keywords: DataFrame, block: int = BLOCK) -> DataFrame:
    """``query_id, keyword`` for every lower-case keyword of ``keywords(keyword)`` that stands in ``texts(query_id, text)``.

    One pass over the texts, about ``block`` characters at once; every executor fetches the
    keywords as files and maps them. A keyword at an edge of which another letter, number or underscore
    stands is no hit; keywords within keywords all count; null and empty ones never.
    """
    bounded_batches(texts.sparkSession)
    lexicon = keywords.select("keyword").where("keyword <> ''").distinct()
    entries = staged(lexicon.mapInArrow(_entries, "many boolean, h long, keyword string"), "lexicon")
    longest = entries.agg(F.max(F.length("keyword"))).first()[0] or 0
    one = shipped(entries.where("NOT many").select("h", "keyword").orderBy("h"), "keywords")
    more = shipped(entries.where("many").select("h", "keyword").distinct().orderBy("h"), "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if longest else ():
            seen: set[str] = set()  # in the pieces so far of a text that goes on
            for pieces in _blocks(batch.column(1), longest, block):
                numbers, hits = found(pieces, _table(one), _table(more))
                if pieces[0][2]:
                    new = np.array([n != pieces[0][0] or k not in seen for n, k in zip(numbers, hits.to_pylist(), strict=True)], bool)
                    numbers, hits = numbers[new], hits.filter(pa.array(new))
                n, text, begin, end, _ = pieces[-1]
                if end < len(text):
                    seen = (seen if begin else set()) | set(hits.filter(pa.array(numbers == n)).to_pylist())
                for at in range(0, len(hits), TOGETHER):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(numbers[at : at + TOGETHER])), hits.slice(at, TOGETHER)], ["query_id", "keyword"])

    return texts.where("text IS NOT NULL").select("query_id", F.lower("text").alias("text")).mapInArrow(run, f"query_id {dict(texts.dtypes)['query_id']}, keyword string")
