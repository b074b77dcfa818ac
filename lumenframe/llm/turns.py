"""Repair of conversation structure: cheapest edits by Dijkstra on the lattice of (turn index, grammar state).

A conversation's roles have to follow ``(s?(ua)+)?`` by their initials. A node of the lattice is how
many turns are read and which state the grammar is in; edges are the edits, and nodes are opened in
order of (cost, audit), the audit being the edits' initials so far, until an accepting end node comes
first. Two ways to one node at equal cost never have audits of which one begins the other: letters
fix the cost, and all but inserts read a turn each. So the least audit to a node is part of the
least audit through it, and a long conversation may be parted into blocks: each block tells the best
edits from every state to every state, and blocks are chained in order.

What is defined for odd rows: nulls count as one space (a null ``conv_id`` is a conversation of its
own, null turns come first); turns of one number are ordered by role and text; equal rows are
duplicates of the first; a conversation that has no turns left is returned with zeros; an empty table
gives an empty result; no column besides the four is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, partitions, shared_dir, written

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after the system's turn, after the user's, after the assistant's. What a turn that is put in or given a role leads to, and that role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ACCEPTING = (0, 3)
#: Conversations beyond these many turns or bytes are worked on in blocks of at most so many turns.
MOST_TURNS, MOST_BYTES, BLOCK_BITS = 4096, 16 << 20, 10
BLANKS = " \t\n\x0b\x0c\r"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def lattice(signature: str, entry: int = 0, every: bool = False, times: dict[int, int] | None = None) -> dict[int, tuple[int, str]]:
    """Cheapest ``(cost, audit)`` from state ``entry`` through turns to an accepting state, or to each state.

    A turn is its role's initial (``x`` for what the grammar does not know), in upper case if
    truncated, or ``d`` if it has to go; ``times`` has how many equal ones stand for one ``d``.
    """
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    done: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    n = len(signature)
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if every or state in ACCEPTING:
                ends[state] = (cost, audit)
                if not every or len(ends) == 4:
                    return ends
        else:
            turn = signature[i]
            if turn == "d":
                m = times.get(i, 1) if times else 1
                heappush(heap, (cost + DELETE * m, audit + "D" * m, i + 1, state))
            else:
                extra = TRUNCATED if turn.isupper() else 0
                to = KEEP.get(turn.lower(), (None,) * 4)[state]
                if to is not None:
                    heappush(heap, (cost + extra, audit + "K", i + 1, to))
                heappush(heap, (cost + REROLE + extra, audit + "R", i + 1, NEXT[state]))
                heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if (i, NEXT[state]) not in done:
            heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state]))
    return ends


@lru_cache(maxsize=1 << 15)
def _short(signature: str) -> tuple[int, str]:
    return next(iter(lattice(signature).values()))


def cheapest(signature: str) -> tuple[int, str]:
    """``(cost, audit)`` of a whole conversation; short ones are found once each."""
    return _short(signature) if len(signature) <= 24 else next(iter(lattice(signature).values()))


def applied(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """``turns`` of (role, text) after the edits, from a grammar state on."""
    out, rest = [], iter(turns)
    for edit in audit:
        if edit == "I":
            out.append((ROLE[state], ""))
            state = NEXT[state]
            continue
        role, text = next(rest)
        if edit == "D":
            continue
        out.append((role if edit == "K" else ROLE[state], text))
        state = KEEP[role[0]][state] if edit == "K" else NEXT[state]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times, mark`` of damaged rows; a dropped one stays with ``times`` 0, so that its conversation does.

    ``mark`` is a turn as ``lattice`` has it, not knowing of duplicates; a blank one is ``b``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind < 2, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times")).withColumn("mark", _mark())


def _mark() -> Column:
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    known = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    return F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), known).otherwise(F.upper(known))


def _in_order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


class _Counts:
    """What is counted along a conversation; parts of it can be put one after the other."""

    def __init__(self):
        self.low = self.high = self.last_turn = self.first_turn = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def turn(self, number: int | None) -> None:
        if number is not None:
            if self.low is None:
                self.low = self.first_turn = number
            self.turns += number != self.last_turn
            self.high = self.last_turn = number

    def role(self, initial: str) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


def _conversation(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """Statistics, audit and repaired turns of ``(turn, role, text, times, mark)`` in order."""
    counts, seen, signature, turns = _Counts(), set(), [], []
    for number, role, text, times, mark in rows:
        for _ in range(times):
            counts.turn(number)
            counts.role(role[:1])
            turns.append((role, text))
            if mark == "b":
                counts.blank += 1
            elif (role, text) in seen:
                counts.duplicate += 1
            else:
                seen.add((role, text))
                counts.truncated += mark.isupper()
                signature.append(mark)
                continue
            signature.append("d")
    cost, audit = cheapest("".join(signature))
    return [counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost], audit, applied(turns, audit)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, rows)`` of rows that come in order of their first column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def _digest(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def _whole(rows: DataFrame, turns: bool) -> DataFrame:
    """One exchange on ``conv_id``; conversations stream through in order."""
    named = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, {SUMMARY}, turns array<struct<role string, text string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        of_ids = None

        def packed() -> pa.RecordBatch:
            ids, stats, audits, digests, repaired = zip(*out, strict=True)
            numbers = [pa.array(list(c), pa.int64()) for c in zip(*stats, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, of_ids), *numbers, pa.array(audits), pa.array(digests), pa.array(repaired, pa.list_(named))], ["conv_id", *STATS, "audit", "repaired_sha256", "turns"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal of_ids
            for batch in batches:
                of_ids = batch.schema.field(0).type
                yield batch

        for conv_id, held in _groups(typed()):
            stats, audit, repaired = _conversation(held)
            out.append((conv_id, stats, audit, _digest(repaired), [{"role": r, "text": t} for r, t in repaired] if turns else None))
            size += sum(len(t) for _, t in repaired) if turns else 200
            if size > 4 << 20:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    ordered = rows.repartition("conv_id").sortWithinPartitions(*_in_order())
    return ordered.mapInArrow(freed(run), schema)


def _pieces(cells: DataFrame) -> DataFrame:
    """Each block's counts, and its best edits from every state to every state."""
    schema = (
        f"conv_id {dict(cells.dtypes)['conv_id']}, block long, low long, high long, first_turn long, last_turn long, turns long, first string, last string, "
        "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
    )

    def run(data: pa.Table) -> pa.Table:
        rows = sorted(zip(*(data.column(c).to_pylist() for c in ("at", "turn", "initial", "times", "mark", "again")), strict=True))
        counts, signature, times = _Counts(), [], {}
        for _, number, initial, n, mark, again in rows:
            counts.turn(number)
            counts.role(initial)
            counts.illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
            gone = n if mark == "b" or again else n - 1
            if mark == "b":
                counts.blank += n
            else:
                counts.duplicate += gone
            if gone < n:
                counts.truncated += mark.isupper()
                signature.append(mark)
            if gone:
                times[len(signature)] = gone
                signature.append("d")
        costs, audits = [None] * 16, [None] * 16
        for entry in range(4):
            for state, (cost, audit) in lattice("".join(signature), entry, True, times).items():
                costs[4 * entry + state], audits[4 * entry + state] = cost, audit
        one = {k: [v] for k, v in vars(counts).items()} | {"costs": [costs], "audits": [audits]}
        fields = [(c, t) for c, t in (("low", pa.int64()), ("high", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())))]
        keys = [data.column(c).slice(0, 1).combine_chunks() for c in ("conv_id", "block")]
        return pa.Table.from_arrays([*keys, *(pa.array(one[c], t) for c, t in fields)], ["conv_id", "block", *(c for c, _ in fields)])

    narrow = cells.select("conv_id", "block", "at", "turn", F.substring("role", 1, 1).alias("initial"), "times", "mark", "again")
    return narrow.groupBy("conv_id", "block").applyInArrow(run, schema)


def _chained(pieces: DataFrame) -> DataFrame:
    """A conversation's blocks one after the other: a row with its summary, and a row a block with the states it goes from and to."""
    ids = dict(pieces.dtypes)["conv_id"]
    fields = ["low", "high", "first_turn", "last_turn", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal", "costs", "audits"]

    def chain(rows: Iterator[tuple]) -> tuple[list, str, list[tuple[int, int, int]]]:
        total, best, back, blocks = _Counts(), {0: (0, "")}, [], []
        for block, *values in rows:
            b = dict(zip(fields, values, strict=True))
            if b["low"] is not None:
                total.turns += b["turns"] - (b["first_turn"] == total.last_turn)
                total.low = b["low"] if total.low is None else total.low
                total.high, total.last_turn = b["high"], b["last_turn"]
            total.role(b["first"])
            total.last = b["last"]
            for c in ("blank", "duplicate", "truncated", "illegal"):
                setattr(total, c, getattr(total, c) + b[c])
            ways = [(cost + b["costs"][4 * s + t], audit + b["audits"][4 * s + t], t, s) for s, (cost, audit) in best.items() for t in range(4) if b["costs"][4 * s + t] is not None]
            best, came = {}, {}
            for cost, audit, t, s in sorted(ways):
                if t not in best:
                    best[t], came[t] = (cost, audit), s
            back.append(came)
            blocks.append(block)
        (cost, audit), state = min((best[s], s) for s in ACCEPTING if s in best)
        path = []
        for block, came in zip(reversed(blocks), reversed(back), strict=True):
            path.append((block, came[state], state))
            state = came[state]
        return [total.gaps(), total.blank, total.duplicate, total.truncated, total.illegal, cost], audit, path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_ids = None

        def rows() -> Iterator[tuple]:
            nonlocal of_ids
            for batch in batches:
                of_ids = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        stream = rows()
        row = next(stream, None)
        while row is not None:
            key = row[0]

            def same(key=key) -> Iterator[tuple]:  # no more than a block is held
                nonlocal row
                while row is not None and row[0] == key:
                    yield row[1:]
                    row = next(stream, None)

            stats, audit, path = chain(same())
            n = len(path)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * (n + 1), of_ids), *(pa.array([None, *c], pa.int64()) for c in zip(*path, strict=True)), *(pa.array([x] + [None] * n, pa.int64()) for x in stats), pa.array([audit] + [None] * n, pa.string())],
                ["conv_id", "block", "entry", "state", *STATS, "audit"],
            )

    ordered = pieces.select("conv_id", "block", *fields).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "block")
    return ordered.mapInArrow(run, f"conv_id {ids}, block long, entry long, state long, {', '.join(f'{c} long' for c in STATS)}, audit string")


def _in_blocks(rows: DataFrame, turns: bool) -> DataFrame:
    """The same for long conversations: sorted over many tasks, repaired in blocks; only their digest, which is one stream, goes through one task each."""
    spark, ids = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    there = rows.where("times > 0").groupBy("conv_id", "turn", "role", "text", "mark").agg(F.sum("times").alias("times")).withColumn("key", F.md5("text"))
    there = written(there, "turns")
    number = F.struct(F.col("turn").isNotNull().alias("given"), "turn")  # nulls first
    first = there.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(number).alias("first"))
    marked = there.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))).withColumn("again", number != F.col("first"))
    ordered = marked.select("conv_id", "turn", "role", "text", "times", "mark", "again").repartitionByRange(partitions(spark), *_in_order()).sortWithinPartitions(*_in_order())
    cells = written(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", BLOCK_BITS)), "cells")
    pieces = written(_pieces(cells), "blocks")
    chained = written(_chained(pieces), "chained")

    def repaired(data: pa.Table, how: pa.Table) -> pa.Table:
        lines = sorted(zip(*(data.column(c).to_pylist() for c in ("at", "role", "text", "times")), strict=True))
        # Of equal rows at most the first stays.
        done = applied([(r, t) for _, r, t, n in lines for _ in range(n)], how.column("audit")[0].as_py(), how.column("entry")[0].as_py())
        named = pa.struct([("role", pa.string()), ("text", pa.string())])
        return pa.Table.from_arrays([*(how.column(c).slice(0, 1).combine_chunks() for c in ("conv_id", "block")), pa.array([[{"role": r, "text": t} for r, t in done]], pa.list_(named))], ["conv_id", "block", "turns"])

    steps = chained.where("block IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "state")
    ways = pieces.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "entry", F.element_at("audits", (4 * F.col("entry") + F.col("state") + 1).cast("int")).alias("audit"))
    texts = written(cells.groupBy("conv_id", "block").cogroup(ways.groupBy("conv_id", "block")).applyInArrow(repaired, f"conv_id {ids}, block long, turns array<struct<role string, text string>>"), "repaired")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, started = None, None, False
        for batch in batches:
            done = []
            for conv_id, some in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is None or conv_id != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha, started = conv_id, hashlib.sha256(), False
                for t in some:
                    sha.update((("\n" if started else "") + f"{t['role']}:{t['text']}").encode())
                    started = True
            of_ids = batch.schema.field(0).type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], of_ids), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], of_ids), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    hashed = texts.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "block").mapInArrow(digests, f"conv_id {ids}, repaired_sha256 string")
    out = _joined(chained.where("block IS NULL").drop("block", "entry", "state"), hashed)
    none = F.lit(None).cast("array<struct<role string, text string>>").alias("turns")
    if turns:
        packed = texts.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "turns"))), lambda s: s["turns"])).alias("turns"))
        return _joined(out, packed)
    return out.select("*", none)


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repair(conversations: DataFrame, turns: bool = False, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for every ``conv_id``: faults of its damaged turns, the cheapest edits, and the digest of the repaired conversation.

    With ``turns`` also the repaired turns, as an array of (role, text). Conversations of up to
    ``most_turns`` turns and ``most_bytes`` bytes meet in one task; longer ones are repaired in blocks
    over many tasks, with the same results.
    """
    shared_dir(conversations.sparkSession)
    rows = damaged(conversations)
    sizes = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("c")), "long")
    if long.isEmpty():
        done = _whole(rows, turns)
    else:  # one row a long conversation: Spark broadcasts it only where its files are small
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        done = _whole(rows.join(long, same, "left_anti"), turns).unionByName(_in_blocks(rows.join(long, same, "left_semi"), turns))
    return done if turns else done.drop("turns")
