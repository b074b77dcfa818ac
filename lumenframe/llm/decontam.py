"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A CGK walk reads a string from its first character and, by random bits of step and character,
stays or goes on; an edit shifts two walks apart only for a while, so small edit distance becomes
small Hamming distance of what they read. Item-sized windows are met at every word of theirs: a
walk starts at every word of a text and of an item, and at every character of three bytes or more,
as scripts without spaces have, and sampled steps of it are hashed. A window that one of an item's
hashes is met in, at its place, is a candidate of the item; it is left if it holds fewer of the
item's trigrams than so many edits can leave, and else verified by exact edit distance.

Items too short for walks are searched exactly: by that number of trigrams (or pairs) alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed

#: Steps of a walk, sampled ones of each, walks with bits of their own.
STEPS, SAMPLED, WALKS = 32, 13, 7
#: Hits that make a window a candidate, at least, and one for so many characters of the item; sampled steps after which walks that begin like no item's are given up.
HITS, CHARS_A_HIT, CHECKS = 2, 60, (4, 7, 10)
#: Items of fewer characters are searched by trigrams alone, of fewer than PAIRS by pairs.
SHORT, PAIRS = 80, 10
#: Bytes of text that are worked on together; bytes of items that one pass holds.
CHUNK, PASS_BYTES = 1 << 21, 16 << 20
#: Windows that are verified together.
TOGETHER = 4096
SEED = 20240607
GRAM_BITS = 13


def normalised(text: str | None) -> str:
    """A-Z lower-cased, white space as single spaces."""
    return b" ".join((text or "").encode().lower().split()).decode()


@dataclass(frozen=True)
class Item:
    number: int
    text: str

    @property
    def size(self) -> int:
        return len(self.text.encode())


class Walks:
    """Hashes of sampled steps of random walks, for many starts at once."""

    def __init__(self, steps: int = STEPS, sampled: int = SAMPLED, walks: int = WALKS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (walks, steps, 256)).astype(np.int32)
        self.bits[:, :, 0] = 0  # beyond the end of a text a walk stands still
        self.sampled = [set(np.sort(rng.choice(steps, sampled, replace=False)).tolist()) for _ in range(walks)]

    def hashes(self, walk: int, data: np.ndarray, starts: np.ndarray, known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Hashes of one walk from ``starts``, which starts they are of, and what was hashed at ``CHECKS``.

        With ``known``, walks go on only while a check's hash may be among those known there.
        """
        bits, sampled = self.bits[walk], self.sampled[walk]
        at, h, live = starts.astype(np.int32), np.zeros(len(starts), np.uint64), np.arange(len(starts))
        seen, told = 0, []
        for step in range(max(sampled) + 1):
            char = data[at]
            if step in sampled:
                h = (h + char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                seen += 1
                if seen in CHECKS:
                    if known is None:
                        told.append(h.copy())
                    else:
                        ok = np.flatnonzero(known[CHECKS.index(seen)][h >> np.uint64(44)])
                        at, h, live, char = at[ok], h[ok], live[ok], char[ok]
            at += bits[step][char]
        return h, live, told


def _word_starts(data: np.ndarray) -> np.ndarray:
    """Places of characters behind a space or a text's end, and of all that have three bytes or more."""
    inside = data > 32
    return np.flatnonzero((inside[1:] & ~inside[:-1]) | (data[1:] >= 0xE0)) + 1


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A number of ``GRAM_BITS`` bits for every run of ``q`` bytes."""
    h = np.zeros(len(data) - q + 1, np.uint32)
    for i in range(q):
        h = h * np.uint32(0x01000193) + data[i : len(data) - q + 1 + i]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


def infix_distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and where the first such ends (bit-parallel)."""
    m = len(pattern)
    if not m:
        return 0, 0
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        eq = where.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(across | plus) & full), plus & across
        score += (up & high > 0) - (down & high > 0)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (~(vertical | up) & full), up & vertical
        if score < best:
            best, end = score, k
    return best, end


def infix_distances(patterns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``infix_distance`` of many pairs at once; no pattern is empty."""
    best, end = np.empty(len(texts), np.int64), np.zeros(len(texts), np.int64)
    words = np.array([-(-len(p) // 64) for p in patterns], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.lexsort((sizes, words))
    at = 0
    while at < len(order):
        to = int(np.searchsorted(words[order], words[order[at]], side="right"))
        to = min(to, at + TOGETHER)
        some = order[at:to]
        best[some], end[some] = _infix_distances([patterns[i] for i in some], [texts[i] for i in some], int(words[order[at]]))
        at = to
    return best, end


def _infix_distances(patterns: list[str], texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for patterns of equally many 64-bit words: the bit-parallel columns of all pairs in step."""
    numbers: dict[str, int] = {}
    masks, alphabets = [np.zeros((1, words), np.uint64)], []
    for p in patterns:
        if p not in numbers:
            numbers[p] = len(alphabets)
            codes = np.frombuffer(p.encode("utf-32-le"), "<u4")
            known, back = np.unique(codes, return_inverse=True)
            mask = np.zeros((len(known), words), np.uint64)
            place = np.arange(len(codes))
            np.bitwise_or.at(mask, (back, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            alphabets.append((sum(map(len, masks)), known))
            masks.append(mask)
    table = np.concatenate(masks)
    n, sizes = len(texts), np.array([len(t) for t in texts])
    longest = int(sizes.max(initial=0))
    rows = np.zeros((longest, n), np.int32)
    for i, (p, t) in enumerate(zip(patterns, texts, strict=True)):
        base, known = alphabets[numbers[p]]
        codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
        found = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        rows[: len(codes), i] = np.where(known[found] == codes, base + found, 0)
    length = np.array([len(p) for p in patterns], np.int64)
    high = np.uint64(1) << ((length - 1) & 63).astype(np.uint64)
    plus, minus = np.full((words, n), (1 << 64) - 1, np.uint64), np.zeros((words, n), np.uint64)
    score, best, end = length.copy(), length.copy(), np.zeros(n, np.int64)
    one, top = np.uint64(1), np.uint64(63)
    for k in range(longest):
        live = sizes > k
        up_in = down_in = np.zeros(n, np.uint64)  # a text's prefix is skipped for free
        for w in range(words):
            eq, p, m = table[rows[k], w], plus[w], minus[w]
            vertical = eq | m
            eq = eq | down_in
            across = (((eq & p) + p) ^ p) | eq
            up, down = m | ~(across | p), p & across
            if w == words - 1:
                score += ((up & high) != 0).astype(np.int64) - ((down & high) != 0)
            up_out, down_out = up >> top, down >> top
            up, down = (up << one) | up_in, (down << one) | down_in
            plus[w], minus[w] = down | ~(vertical | up), up & vertical
            up_in, down_in = up_out, down_out
        better = live & (score < best)
        best[better], end[better] = score[better], k + 1
    return best, end


class Finder:
    """The items' walks, by hash, and their trigrams."""

    def __init__(self, items: list[Item], similarity: float):
        self.items, self.similarity, self.walks = items, similarity, Walks()
        parts, at, owner, offset = [b"\0"], 1, [], []
        self.sizes = np.array([i.size for i in items], np.int64)
        lengths = np.array([len(i.text) for i in items], np.int64)
        self.allowed = np.array([int((1 - similarity) * n + 1e-9) for n in lengths.tolist()], np.int64)
        #: How far a window may reach beyond an item, in bytes.
        self.slack = self.allowed * np.array([max((len(c.encode()) for c in set(i.text)), default=1) for i in items], np.int64)
        walked = lengths >= SHORT
        self.needed = np.maximum(HITS, lengths // CHARS_A_HIT)
        for k, item in enumerate(items):
            raw = item.text.encode()
            starts = _word_starts(np.frombuffer(b"\0" + raw + b"\0", np.uint8)) - 1 if walked[k] else np.empty(0, np.int64)
            # A walk that runs out of its item would have to meet an end in the text.
            starts = starts[(starts + STEPS // 2 <= len(raw)) | (starts == 0)]
            owner.append(np.full(len(starts), k))
            offset.append(starts)
            parts.append(raw + b"\0")
        bases = np.cumsum([1] + [len(p) for p in parts[1:-1]]) if items else np.empty(0, np.int64)
        data = np.frombuffer(b"".join(parts) + bytes(STEPS), np.uint8)
        owner, offset = (np.concatenate(x) if items else np.empty(0, np.int64) for x in (owner, offset))
        self.tables = []
        if len(owner):
            for walk in range(len(self.walks.sampled)):
                h, _, told = self.walks.hashes(walk, data, bases[owner] + offset)
                order = np.argsort(h, kind="stable")
                known = [np.zeros(1 << 20, bool) for _ in (*told, h)]
                for maybe, x in zip(known, (*told, h), strict=True):
                    maybe[x >> np.uint64(44)] = True
                self.tables.append((h[order], owner[order], offset[order], known))
        # One edit of a character takes away q + (its bytes) - 1 grams of q bytes at most.
        self.q = np.where(lengths < PAIRS, 2, 3)
        self.least = self.sizes - self.q + 1 - (self.slack + self.allowed * (self.q - 1))
        self.short = np.flatnonzero(~walked).tolist()
        self.held: dict[int, np.ndarray] = {}

    def grams_of(self, k: int) -> np.ndarray:
        """Which grams item ``k`` holds."""
        if k not in self.held:
            held = np.zeros(1 << GRAM_BITS, np.uint8)
            raw = np.frombuffer(self.items[k].text.encode(), np.uint8)
            if len(raw) >= self.q[k]:
                held[_grams(raw, int(self.q[k]))] = 1
            self.held[k] = held
        return self.held[k]

    def candidates(self, data: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, smallest and largest diagonal (from the text's beginning) of windows with a hit and trigrams enough."""
        none = np.empty(0, np.int64)
        if not self.tables:
            return none, none, none, none
        text_of, items, diagonals = [], [], []
        for walk, (keys, owner, offset, known) in enumerate(self.tables):
            h, live, _ = self.walks.hashes(walk, data, starts, known)
            live, h = live[known[-1][h >> np.uint64(44)]], h[known[-1][h >> np.uint64(44)]]
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            n = high - low
            live, low, n = live[n > 0], low[n > 0], n[n > 0]
            place = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(starts[live], n)
            text = np.searchsorted(begins, at, side="right") - 1
            text_of.append(text)
            items.append(owner[place])
            diagonals.append(at - begins[text] - offset[place])
        text, item, diagonal = (np.concatenate(x).astype(np.int64) for x in (text_of, items, diagonals))
        if not len(text):
            return none, none, none, none
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        # A window begins at a hit that enough others follow within an item's allowance; of windows that begin in one such stretch, the first and the last count for all.
        last = np.arange(len(text)) + self.needed[item] - 1
        inside, last = last < len(text), np.minimum(last, len(text) - 1)
        at = np.flatnonzero(inside & (text[last] == text) & (item[last] == item) & (diagonal[last] - diagonal <= np.maximum(1, self.slack[item])))
        if not len(at):
            return none, none, none, none
        text, item, low = text[at], item[at], diagonal[at]
        stretch = low // np.maximum(1, self.slack[item])
        edge = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (stretch[1:] != stretch[:-1]))))
        high = low[np.concatenate((edge[1:], [len(low)])) - 1] + np.maximum(1, self.slack[item[edge]])
        text, item, low = text[edge], item[edge], low[edge]
        keep = self._full(data, begins[text] + low - self.slack[item], begins[text] + high + self.sizes[item] + self.slack[item], item)
        return text[keep], item[keep], low[keep], high[keep]

    def _full(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which windows from ``a`` to ``b`` hold trigrams enough of their items."""
        grams = _grams(data, 3)
        a, b = np.maximum(0, a), np.minimum(len(grams), b)
        out = np.ones(len(a), bool)
        own = {k: i for i, k in enumerate(np.unique(item).tolist())}
        held = np.stack([self.grams_of(k) for k in own])
        row = np.searchsorted(np.fromiter(own, np.int64, len(own)), item)
        step = max(1, (1 << 21) // max(1, int((b - a).max())))
        for i in range(0, len(a), step):
            n = np.maximum(1, (b - a)[i : i + step])
            at = np.repeat(a[i : i + step] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hits = held[np.repeat(row[i : i + step], n), grams[np.minimum(at, len(grams) - 1)]]
            out[i : i + step] = np.add.reduceat(hits, np.cumsum(n) - n, dtype=np.int64) >= self.least[item[i : i + step]]
        return out

    def short_candidates(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, and the part of the text (from its beginning) where a window of a short item may be; loses none."""
        grams: dict[int, np.ndarray] = {}
        for k in self.short:
            q, size, least = int(self.q[k]), int(self.sizes[k]), int(self.least[k])
            width = size + int(self.slack[k]) - q + 1
            if least <= 0 or width <= 0:  # too short for any gram to be sure: all of every text
                for t, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                    yield t, k, 0, b - a
                continue
            if q not in grams:
                grams[q] = _grams(data, q)
            sums = np.concatenate(([0], np.cumsum(self.grams_of(k)[grams[q]], dtype=np.int32)))
            to = np.minimum(np.arange(len(grams[q])) + width, len(grams[q]))
            here = np.flatnonzero(sums[to] - sums[:-1] >= least)
            if not len(here):
                continue
            text = np.searchsorted(begins, here + width, side="right") - 1  # windows may begin before their text does
            edge = np.flatnonzero(np.concatenate(([True], (here[1:] - here[:-1] > 1) | (text[1:] != text[:-1]))))
            stop = np.concatenate((edge[1:], [len(here)])) - 1
            for a, b in zip(here[edge].tolist(), here[stop].tolist(), strict=True):
                first, last = int(np.searchsorted(begins, a, side="right")) - 1, int(np.searchsorted(begins, b + width + q, side="right")) - 1
                for t in range(max(0, first), last + 1):
                    low, high = max(0, a - int(begins[t])), min(int(ends[t] - begins[t]), b + width + q - int(begins[t]))
                    if high > low:
                        yield t, k, low, high

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, item, edits, end (in characters of the normalised text) and similarity of verified windows."""
        raws = [t.encode() for t in texts]
        sizes = np.array([len(r) + 1 for r in raws])
        begins = np.cumsum(sizes) - sizes + 1
        data = np.frombuffer(b"\0" + b"".join(r + b"\0" for r in raws) + bytes(STEPS), np.uint8)
        best: dict[tuple[int, int], tuple[int, int, float]] = {}
        found = zip(*(x.tolist() for x in self.candidates(data, _word_starts(data) if self.tables else begins, begins)), strict=True)
        windows = ((t, k, low - int(self.slack[k]) - 4, high + int(self.sizes[k]) + int(self.slack[k]) + 4) for t, k, low, high in found)
        asked: dict[tuple[int, str], list[tuple[int, int]]] = {}  # the same passage often stands in many texts

        def verify() -> None:
            pairs = list(asked)
            for (item, window), edits, end in zip(pairs, *(x.tolist() for x in infix_distances([self.items[k].text for k, _ in pairs], [w for _, w in pairs])), strict=True):
                if edits <= self.allowed[item]:
                    size = len(self.items[item].text)
                    for text, a in asked[item, window]:
                        if edits < best.get((text, item), (1 << 30, 0, 0.0))[0]:
                            best[text, item] = (edits, len(raws[text][:a].decode(errors="ignore")) + end, 1 - edits / size)
            asked.clear()

        for text, item, a, b in chain(windows, self.short_candidates(data, begins, begins + sizes - 1)):
            raw = raws[text]
            a, b = max(0, a), min(len(raw), b)
            while a > 0 and raw[a] & 0xC0 == 0x80:  # not within a character
                a -= 1
            asked.setdefault((item, raw[a:b].decode(errors="ignore")), []).append((text, a))
            if len(asked) >= TOGETHER:
                verify()
        verify()
        for (text, item), (edits, end, similarity) in best.items():
            yield text, self.items[item].number, edits, end, similarity


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """Items in blocks of bounded size; each block is one pass over the texts, however many items there are."""
    held, size = [], 0
    for row in items.select(F.col(id_col).cast("long").alias("number"), F.col(text_col).alias("text")).where("number IS NOT NULL").orderBy("number", "text").toLocalIterator():
        text = normalised(row.text)
        if not text:
            continue
        held.append(Item(row.number, text))
        size += len(text)
        if size >= PASS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, similarity, end`` for every document and benchmark item that a window of it resembles.

    ``similarity`` is 1 - edits / item length, in characters of normalised texts; candidates are
    found with high probability (items of fewer than ``SHORT`` characters: all), and verified exactly.
    One row a pair, its best window's, on ties one of them; a repeated document row gives repeated
    rows. Texts of any length are taken whole; columns beside id and text are not looked at. Null, empty and blank texts and items, and items with
    a null id, match nothing; documents with a null id are found under it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits long, similarity double, end long"
    found = rows.sparkSession.createDataFrame([], schema)
    for block in _item_blocks(items, item_id_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            finder = _finder(tuple(block), similarity)

            def some(ids: list, texts: list[str]) -> pa.RecordBatch:
                got = [(ids[t], i, e, s, end) for t, i, e, end, s in finder.matches(texts)]
                cols = list(zip(*got, strict=True)) or [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "similarity", "end"])

            for batch in batches:
                ids, texts, size = [], [], 0
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    texts.append(normalised(text))
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield some(ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    yield some(ids, texts)

        found = found.unionByName(rows.mapInArrow(freed(run), schema))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that resemble no benchmark item in the sense of ``find_leaks``."""
    for block in _item_blocks(items, item_id_col, item_text_col):
        docs = docs.where(_clean(block, similarity)(F.col(text_col)))
    return docs


@lru_cache(maxsize=1)
def _finder(block: tuple[Item, ...], similarity: float) -> Finder:
    """One a worker: tasks of a pass share it."""
    return Finder(list(block), similarity)


def _clean(block: list[Item], similarity: float):
    """A column function: whether a text resembles none of the items."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        finder = _finder(tuple(block), similarity)
        out, some, first, size = np.ones(len(texts), bool), [], 0, 0
        for k, text in enumerate(texts.to_pylist()):
            some.append(normalised(text))
            size += len(some[-1])
            if size >= CHUNK or k + 1 == len(texts):
                for at, *_ in finder.matches(some):
                    out[first + at] = False
                some, first, size = [], k + 1, 0
        return pa.array(out)

    return clean
