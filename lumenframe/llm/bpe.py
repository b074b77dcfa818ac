"""Byte-level BPE by units, with the exact token count at every prefix.

A text is cut where a single space stands between two other characters: a byte-level BPE
tokenizer always starts a new piece there, so units are encoded on their own. Of some texts at a
time, every distinct unit is encoded once, and texts are put together from numbers of units. Some
units are remembered for later texts; what is remembered is bounded, and only speeds things up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Units that a worker remembers (some 60 MB), and the length in characters up to which it does.
REMEMBERED, SHORT = 400_000, 48
#: Longer texts are worked on in parts of so many characters.
LONG = 1 << 22
#: The pattern of the byte-level pre-tokenizer (fixed by the tokenizer's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern's ``\s`` holds for, which is not all that ``str.isspace`` does (U+001C to U+001F). A piece is white space if it ends so.
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Pieces of up to so many bytes are worked on together.
BATCH_BYTES = 40
BASE, MIX, MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), (1 << 64) - 1
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stays, the rest is moved above 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """A tokenizer file of the library ``tokenizers``: ids of texts, and token counts of all their prefixes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token not in self.specials}
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.size_of[i] = len(b)
        self.longest = max(map(len, ranks))
        self._counts: dict[str, bytes] = {}
        self._pieces: dict[bytes, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self._pattern = regex.compile(PATTERN)
        self._powers: np.ndarray | None = None

    # ---- units of many texts

    def _entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], pa.Array]:
        """Where each text's units begin and how many they are, each unit's number, first units of texts, and the others' distinct ones.

        Numbers below the count of distinct units are theirs, the others those of first units, which no space precedes.
        """
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        lengths = pc.binary_length(flat).to_numpy()
        edged = (lengths == 0) | (lengths != pc.binary_length(pc.utf8_trim_whitespace(flat)).to_numpy())
        order = np.arange(len(texts))
        slow = np.add.reduceat(edged, np.cumsum(sizes) - sizes, dtype=np.int64) > 0
        if slow.any():  # a space beside white space is no cut
            parted = [CUT.split(texts[i]) for i in np.flatnonzero(slow).tolist()]
            flat = pa.concat_arrays([flat.filter(pa.array(np.repeat(~slow, sizes))), pa.array([u for us in parted for u in us], pa.string())])
            sizes = np.concatenate((sizes[~slow], np.array([len(us) for us in parted])))
            order = np.concatenate((order[~slow], order[slow]))
        begins = np.cumsum(sizes) - sizes
        rest = np.ones(len(flat), bool)
        rest[begins] = False
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        entries = np.empty(len(flat), np.int64)
        entries[rest] = coded.indices.to_numpy(zero_copy_only=False)
        entries[begins] = len(coded.dictionary) + np.arange(len(texts))
        heads = flat.take(pa.array(begins)).to_pylist()
        place, count = np.empty_like(begins), np.empty_like(sizes)
        place[order], count[order] = begins, sizes
        return place, count, entries, heads, coded.dictionary

    @staticmethod
    def _spread(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``pool`` holds of each entry, one after another; where each entry's begins, and its size."""
        n = sizes[entries]
        ends = np.cumsum(n)
        at = ends - n
        index = np.repeat((starts[entries] - at).astype(np.int32), n)
        index += np.arange(len(index), dtype=np.int32)
        return pool[index], at, n

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG and (cut := CUT.search(text, at + LONG)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _plain(self, text: str) -> bool:
        return len(text) <= LONG and (self.special is None or not self.special.search(text))

    # ---- ids

    def ids(self, text: str) -> np.ndarray:
        """The ids that the library gives without added special tokens; special strings in the text are special."""
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [*map(self._plain_ids, self._parts(text[at : m.start()])), np.array([self.specials[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, *map(self._plain_ids, self._parts(text[at:]))])

    def _plain_ids(self, text: str) -> np.ndarray:
        return self._some_ids([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """``ids`` of each text."""
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, ids in zip(plain, self._some_ids([texts[i] for i in plain]), strict=True):
            out[i] = ids
        return [self.ids(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def _some_ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        place, count, entries, heads, units = self._entries(texts)
        pool, sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(units):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), " ")[0].as_py()
            pool = np.asarray(self.core.encode_to_numpy(" " + joined, disallowed_special=()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.size_of[pool]), np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64) + 1)) + 1
            sizes = np.diff(ends, prepend=0)
        first = [self.core.encode_ordinary(h) for h in heads]
        pool = np.concatenate((pool, np.fromiter(chain.from_iterable(first), np.uint32)))
        sizes = np.concatenate((sizes, np.fromiter(map(len, first), np.int64, len(first))))
        ids, at, n = self._spread(pool, np.cumsum(sizes) - sizes, sizes, entries)
        ends = at + n
        return [ids[at[a] : ends[a + k - 1]] for a, k in zip(place.tolist(), count.tolist(), strict=True)]

    # ---- counts at prefixes

    def prefix_counts(self, text: str) -> np.ndarray:
        """At i: how many tokens the library gives for ``text[: i + 1]``."""
        parts, at, before = [], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            # Until its last character, a special string is ordinary text.
            inside = self._long_counts(text[at : m.end() - 1])
            ahead = int(inside[m.start() - at - 1]) if m.start() > at else 0
            parts += [inside + before, np.array([before + ahead + 1])]
            before, at = before + ahead + 1, m.end()
        return np.concatenate([*parts, self._long_counts(text[at:]) + before])

    def _long_counts(self, text: str) -> np.ndarray:
        parts, before = [np.empty(0, np.int64)], 0
        for part in self._parts(text):
            counts = self._some_counts([part])[0].astype(np.int64)
            parts.append(counts + before)
            before += int(counts[-1]) if len(counts) else 0
        return np.concatenate(parts)

    def prefix_counts_of(self, texts: list[str]) -> list[np.ndarray]:
        """``prefix_counts`` of each text."""
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, counts in zip(plain, self._some_counts([texts[i] for i in plain]), strict=True):
            out[i] = counts
        return [self.prefix_counts(t) if counts is None else counts for t, counts in zip(texts, out, strict=True)]

    def _some_counts(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        place, count, entries, heads, distinct = self._entries(texts)
        units, known = distinct.to_pylist(), self._counts
        rows = list(map(known.get, units))
        missing = [i for i, r in enumerate(rows) if r is None]
        for i, row in zip(missing, self.learn([units[i] for i in missing]), strict=True):
            rows[i] = row
        # What is too long to be remembered, and first units, are behind the others.
        rows += [bytes(self._unit(h)) if len(h) <= SHORT else None for h in heads]
        long = {i: np.array(self._unit(" " + units[i] if i < len(units) else heads[i - len(units)]), np.int32) for i, r in enumerate(rows) if r is None}
        sizes = np.fromiter((len(long[i]) if r is None else len(r) for i, r in enumerate(rows)), np.int64, len(rows))
        inside = np.array([r is not None for r in rows])
        starts = np.empty(len(rows), np.int64)
        starts[inside] = np.cumsum(sizes[inside]) - sizes[inside]
        starts[~inside] = sizes[inside].sum() + np.cumsum(sizes[~inside]) - sizes[~inside]
        pool = np.concatenate((np.frombuffer(b"".join(r for r in rows if r is not None), np.uint8).astype(np.int32), *long.values()))
        total = np.zeros(len(rows), np.int64)
        total[sizes > 0] = pool[(starts + sizes - 1)[sizes > 0]]
        counts, at, n = self._spread(pool, starts, sizes, entries)
        before = np.cumsum(total[entries]) - total[entries]
        before -= np.repeat(before[np.sort(place)], count[np.argsort(place)])
        counts += np.repeat(before.astype(np.int32), n)
        ends = at + n
        return [counts[at[a] : ends[a + k - 1]] for a, k in zip(place.tolist(), count.tolist(), strict=True)]

    def learn(self, units: list[str]) -> list[bytes | None]:
        """The counts of distinct ``units`` (None: too long), all new pieces in one pass; they are remembered, the oldest units are not."""
        split = {u: self._pattern.findall(" " + u) for u in units if len(u) <= SHORT}
        if len(self._pieces) > REMEMBERED // 4:
            self._pieces.clear()
        pieces, out = self._pieces, []
        raws = {r for ps in split.values() for p in ps if (r := p.encode()) not in pieces and 1 < len(r) <= 4 * SHORT}
        self._learn_pieces([r for r in raws if len(r) <= BATCH_BYTES])
        for u in units:
            if (ps := split.get(u)) is None:
                out.append(None)
                continue
            rows = [pieces.get(p.encode()) for p in ps]
            if len(ps) <= 2 and rows[0] is not None and rows[-1] is not None and ps[0][-1] not in SPACES and ps[-1] not in CONTRACTIONS:
                out.append(rows[0] if len(ps) == 1 else rows[0] + bytes([rows[0][-1] + c for c in rows[1]]))
            else:
                out.append(bytes(self._unit(" " + u)))
        known = self._counts
        if len(known) + len(split) > REMEMBERED:
            for u in list(islice(known, max(0, len(known) + len(split) - REMEMBERED // 2))):
                del known[u]
        known.update(zip(islice(split, REMEMBERED // 2), (r for r in out if r is not None), strict=False))
        return out

    def _unit(self, unit: str) -> list[int]:
        """Counts at the prefixes of a unit; where white space ends a prefix it is one piece, whatever follows."""
        out: list[int] = []
        before = 0
        for m in self._pattern.finditer(unit):
            start, end = m.span()
            piece = m[0]
            counts = self._piece(piece)
            if piece in CONTRACTIONS:
                counts = [counts[0], self._piece("'")[0] + self._piece(piece[1])[0], counts[2]]
            done = len(out)  # beyond start, if a run of white space reached into this piece
            out += [before + c for c in counts[max(0, done - start) :]]
            if piece[-1] in SPACES and end < len(unit):
                stop = end
                while stop < len(unit) and unit[stop] in SPACES:
                    stop += 1
                if stop > end and stop > len(out):
                    run = self._piece(unit[start:stop])
                    out += [before + c for c in run[len(out) - start :]]
            before += counts[-1]
        return out

    def _piece(self, piece: str) -> list[int]:
        """Counts at the character prefixes of one piece, by dynamic programming over its bytes.

        The tokens of a prefix end in the one token that is compatible with the last token of
        what stands before it: two tokens are compatible if their bytes together encode to them.
        """
        raw = piece.encode()
        if len(raw) == 1:
            return [1]
        hit = self._pieces.get(raw)
        if hit is not None:
            return list(hit)
        ranks, pairs, bytes_of, size = self.ranks, self._pairs, self.bytes_of, len(raw)
        last, count = [-1] * (size + 1), [0] * (size + 1)
        encode = self.core._core_bpe.encode_single_piece
        for i in range(1, size + 1):
            for j in range(max(0, i - self.longest), i):
                token = ranks.get(raw[j:i])
                if token is None:
                    continue
                if j == 0:
                    last[i], count[i] = token, 1
                    break
                before = last[j]
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= 4 * REMEMBERED:
                        pairs.clear()
                    fits = pairs[key] = encode(bytes_of[before] + bytes_of[token]) == [before, token]
                if fits:
                    last[i], count[i] = token, count[j] + 1
                    break
        return count[1:] if len(raw) == len(piece) else [count[i + 1] for i in range(size) if i + 1 == size or raw[i + 1] & 0xC0 != 0x80]

    # ---- the same dynamic programme for many pieces at once

    def _prepare_batches(self) -> None:
        self._powers = np.cumprod(np.array([1] + [int(BASE)] * BATCH_BYTES, np.uint64))
        tokens = [(b, i) for b, i in self.ranks.items() if len(b) <= BATCH_BYTES]
        hashes = np.zeros(len(tokens), np.uint64)
        for k, (b, _) in enumerate(tokens):
            h = len(b)
            for c in b:
                h = (h * int(BASE) + c + 1) & MASK
            hashes[k] = h
        order = np.argsort(hashes)
        self._hashes, self._tokens = hashes[order], np.array([i for _, i in tokens], np.int64)[order]
        if (self._hashes[1:] == self._hashes[:-1]).any():
            raise ValueError("two tokens share a hash")
        self._maybe = np.zeros(1 << 22, bool)
        self._maybe[(self._hashes * MIX) >> np.uint64(42)] = True
        self._pair_key, self._pair_fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it; -1 before: nothing stands there."""
        keys = (before << 20) | token
        slot = ((keys.astype(np.uint64) * MIX) >> np.uint64(44)).astype(np.int64)
        seen = self._pair_key[slot] == keys
        out = self._pair_fits[slot]
        if not seen.all():
            new, back = np.unique(keys[~seen], return_inverse=True)
            encode, bytes_of = self.core._core_bpe.encode_single_piece, self.bytes_of
            fits = np.array([encode(bytes_of[k >> 20] + bytes_of[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF] for k in new.tolist()], bool)
            out[~seen] = fits[back]
            self._pair_key[slot[~seen]], self._pair_fits[slot[~seen]] = keys[~seen], fits[back]
            # Where two new keys share a slot the last one holds it, key and value alike.
            self._pair_fits[slot[~seen]] = np.where(self._pair_key[slot[~seen]] == keys[~seen], fits[back], self._pair_fits[slot[~seen]])
        return out

    def _learn_pieces(self, raws: list[bytes]) -> None:
        if self._powers is None:  # ids do without these tables
            self._prepare_batches()
        raws.sort(key=len, reverse=True)
        for at in range(0, len(raws), 1 << 14):
            self._learn_some(raws[at : at + (1 << 14)])

    def _learn_some(self, raws: list[bytes]) -> None:
        m, size = len(raws), len(raws[0])
        sizes = np.fromiter(map(len, raws), np.int64, m)
        chars = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(m, size).T
        prefix = np.zeros((size + 1, m), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * BASE + chars[i] + np.uint64(1)
        last, count = np.zeros((size + 1, m), np.int64), np.zeros((size + 1, m), np.uint8)
        for i in range(1, size + 1):
            open_ = np.arange(int(np.searchsorted(-sizes, -i, side="right")))  # pieces of i bytes at least stand first
            for width in range(min(i, self.longest), 0, -1):
                power = self._powers[width]
                h = prefix[i, open_] - prefix[i - width, open_] * power + self._powers[width : width + 1] * np.uint64(width)
                here = np.flatnonzero(self._maybe[(h * MIX) >> np.uint64(42)])
                if not len(here):
                    continue
                found = np.minimum(np.searchsorted(self._hashes, h[here]), len(self._hashes) - 1)
                real = self._hashes[found] == h[here]
                here, token = here[real], self._tokens[found[real]]
                if not len(here):
                    continue
                at = open_[here]
                if width < i:
                    fits = self._fits(last[i - width, at], token)
                    here, token, at = here[fits], token[fits], at[fits]
                last[i, at], count[i, at] = token, count[i - width, at] + 1
                open_ = np.delete(open_, here)
        rows = count[1:].T
        for k, raw in enumerate(raws):
            row = rows[k, : len(raw)]
            if not raw.isascii():
                row = row[[i for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]]
            self._pieces[raw] = row.tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer a worker process."""
    return ByteBpe(path)
