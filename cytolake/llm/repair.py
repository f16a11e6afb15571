"""Conversation structure repair with the least edits.

A conversation is right when its role initials are `(s?(ua)+)?`.  Rows may be
kept, given another role, deleted, or put in; the cheapest edits are found over a
graph of (rows done, what may come next), and of several cheapest ones those whose
initials are least as a string.

That choice is by prefix doubling: the arcs of cheapest paths are ranked by the
first letter of what can be written from them on, then by 2, 4, 8 … letters,
each rank being that of the pair (the first half, the half that its pointer leads to);
the pointers double with the lengths.  At the end the least-ranked arc of a place
starts the least path, and the pointers spell it out.

A conversation is cut into blocks of rows in its order, so that one that holds a
third of all rows is spread over the tasks.  A block has a min-plus matrix of
costs between its four entries and exits; a pass over the blocks of a conversation, not its
rows, gives the costs from each exit to the end; then every block ranks its own arcs,
for each entry.  A path through a block ends with the edit of its last row, so no path's
letters begin another's, and the least letters are decided block by block.  Only the last
step, which hashes the repaired text, reads a conversation as a stream in its order, as
the hash needs; it holds one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.llm._spark import WS_CHARS, small_batches, written

#: Rows and characters of a block at most (a longer row is a block of its own).
BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 20

LEGAL = ("su", "ua", "au")
#: Places: 0 nothing yet, 1 after s, 2 after u, 3 after a.  What may be kept there, and where that leads.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Where a row of the only other fitting role leads, and that role.
TURN = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
PLACES = 4
#: Letters in their order; 0 is the end.
LETTERS = "\0DIKR"
FAR = 1 << 40


class Costs(NamedTuple):
    """Cost of each edit; `truncated` is added for a truncated row that stays.  An inserted row costs something."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def tail(self) -> tuple[int, ...]:
        """From each place to a right end, without further rows."""
        return (0, 2 * self.insert, self.insert, 0)


class Steps:
    """One row's step of the cost recursion, remembered by the kind of row and the costs after it (less their least, so there are few)."""

    def __init__(self, costs: Costs):
        if costs.insert <= 0:
            raise ValueError("an inserted row costs something")
        self.costs = costs
        self.known: dict[tuple[str, tuple[int, ...]], tuple[int, tuple[int, ...], int]] = {}
        self.arcs: list[list[list[int]]] = []

    def __call__(self, kind: str, onward: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
        """What is added, the costs before the row less that, and the number of the arcs.

        kind: b blank, d duplicate, else the initial (o for others), a capital if truncated.
        """
        found = self.known.get((kind, onward))
        if found is None:
            found = self.known[kind, onward] = self._made(kind, onward)
        return found

    def _made(self, kind: str, onward: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
        c = self.costs
        options: list[list[tuple[int, int, int]]] = []  # cost, letter, place (4 more: after the row)
        for s in range(PLACES):
            here = [(c.delete + onward[s], 1, PLACES + s)]
            if kind not in "bd":
                more = c.truncated if kind.isupper() else 0
                if kind.lower() in KEPT[s]:
                    t = KEPT[s][kind.lower()]
                    here.append((c.keep + more + onward[t], 3, PLACES + t))
                here.append((c.rerole + more + onward[TURN[s]], 4, PLACES + TURN[s]))
            options.append(here)
        value = [min(x[0] for x in here) for here in options]
        for _ in range(PLACES):
            value = [min(v, c.insert + value[TURN[s]]) for s, v in enumerate(value)]
        for s, here in enumerate(options):
            here.append((c.insert + value[TURN[s]], 2, TURN[s]))
        self.arcs.append([[next((t for x, k, t in here if k == letter and x == v), -1) for letter in (1, 2, 3, 4)] for here, v in zip(options, value, strict=True)])
        least = min(value)
        return least, tuple(v - least if v < FAR // 2 else FAR for v in value), len(self.arcs) - 1

    def back(self, kinds: str, onward: tuple[int, ...]) -> tuple[tuple[int, ...], list[int]]:
        """Costs before the first of some rows from those after the last, and the arcs of each row, the last first."""
        total = min(onward)
        onward = tuple(v - total if v < FAR // 2 else FAR for v in onward)
        arcs = []
        for kind in reversed(kinds):
            added, onward, number = self(kind, onward)
            total += added
            arcs.append(number)
        return tuple(v + total if v < FAR // 2 else FAR for v in onward), arcs

    def matrix(self, kinds: str) -> list[int]:
        """Costs from each place before some rows to each place after them, by rows."""
        columns = [self.back(kinds, tuple(0 if s == exit_ else FAR for s in range(PLACES)))[0] for exit_ in range(PLACES)]
        return [columns[j][i] for i in range(PLACES) for j in range(PLACES)]


def least_paths(steps: Steps, blocks: list[list[int]]) -> list[tuple[list[str], list[int]]]:
    """For blocks of rows (the numbers of their arcs in order): the least letters from each entry, and the exit that they lead to.

    The arcs of a place have different letters, so the arc that a pointer of length one goes to is known from the first ranks.
    """
    if not blocks:
        return []
    table = np.array(steps.arcs, np.int64)  # arcs, place, letter
    sizes = np.array([len(b) for b in blocks])
    first = PLACES * (np.cumsum(sizes + 1) - (sizes + 1))  # the node of each block's place 0 before its first row
    layer = np.concatenate([f + PLACES * np.arange(n) for f, n in zip(first, sizes, strict=True)])
    to = table[np.concatenate([np.array(b, np.int64) for b in blocks])]
    node = layer[:, None, None] + np.arange(PLACES)[None, :, None] + np.zeros_like(to)
    there = to >= 0
    tail, head = node[there], (layer[:, None, None] + to)[there]  # sorted by node, then letter
    letter = np.broadcast_to(np.arange(1, 5), to.shape)[there]
    end = len(tail)  # the arc that follows the last one
    nodes = int(first[-1] + PLACES * (sizes[-1] + 1))

    def least(rank: np.ndarray) -> np.ndarray:
        """The least-ranked arc of each node; `end` where none leaves it."""
        out = np.full(nodes, end)
        order = np.lexsort((rank[:end], tail))
        starts = np.flatnonzero(np.diff(tail[order], prepend=-1))
        out[tail[order][starts]] = order[starts]
        return out

    rank = np.append(letter, 0)
    follow = [np.append(least(rank)[head], end)]
    while (follow[-1] != end).any():
        _, rank = np.unique(rank * (rank.max() + 1) + rank[follow[-1]], return_inverse=True)
        follow.append(follow[-1][follow[-1]])
    path = least(rank)[(first[:, None] + np.arange(PLACES)).ravel()][:, None]
    for jump in follow:
        path = np.concatenate([path, jump[path]], axis=1)
    codes = np.frombuffer(LETTERS.encode(), np.uint8)[np.append(letter, 0)[path]]
    last = path[np.arange(len(path)), (path != end).sum(1) - 1]
    exits = (head[last] % PLACES).reshape(-1, PLACES).tolist()
    words = [row.tobytes().rstrip(b"\0").decode() for row in codes]
    return [(words[PLACES * k : PLACES * (k + 1)], exits[k]) for k in range(len(blocks))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows as blocks: conv_id, b, roles, texts, kinds, the keys seen first in the block with their places, turns and initials."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    conv, b, chars = None, 0, 0

    def made() -> tuple:
        seen: set = set()
        kinds, at, k1, k2 = [], [], [], []
        for i, (_, role, text, end, x, y) in enumerate(held):
            if end is None:
                kinds.append("b")
                continue
            if (x, y) in seen:
                kinds.append("d")
                continue
            seen.add((x, y))
            at.append(i)
            k1.append(x)
            k2.append(y)
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds.append(kind if end in ".!?" else kind.upper())
        turns = [t for t, *_ in held if t is not None]
        initials = [r[:1] for _, r, *_ in held]
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
        return (conv, part, b, [r for _, r, *_ in held], [t for _, _, t, *_ in held], "".join(kinds), at, k1, k2,
                turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), illegal, initials[0], initials[-1])

    for batch in batches:
        for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and (c != conv or len(held) == BLOCK_ROWS or chars + len(row[2]) > BLOCK_CHARS):
                yield made()
                b, chars = b + 1, 0
                held.clear()
            conv = c
            held.append(tuple(row))
            chars += len(row[2])
    if held:
        yield made()


def _arrow(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def damage(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows conv_id, turn, role, text with faults put in, by crc32(`conv_id:turn`) modulo 20: 0 drops the row, 1 empties its text, 2 takes
    its `.!?` away, 3 repeats it, 4 makes its role user.  Null role and text, and a null in the key, are one space; conv_id and turn stay null."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))) % 20
    text_ = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    times = F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.when(fault == 4, "user").otherwise(space(role)).alias("role"), text_.alias("text"), F.explode(times).alias("_")).drop("_")


_BLOCK = "part int, b int, roles array<string>, texts array<string>, kinds string, at array<int>, k1 array<long>, k2 array<long>, t_first long, t_last long, turns long, illegal long, i_first string, i_last string"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, ids: DataFrame | None = None, *, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of `rows` and each conv_id of `ids`.

    rows: conv_id, turn (a whole number), role, text.  A conversation is read by turn, nulls first; equal
    turns by role, then text (64 characters, then its hash); rows that repeat stay beside each other.  Null role and text are one space.
    A row's first fault counts: blank (no word), duplicate (role and text came before), truncated
    (ends without `.!?`).  gaps: turns missing between the least and the largest.  illegal:
    neighbours whose initials are not su, ua or au.  cost and audit: the cheapest edits and their
    initials (Delete, Insert, Keep, Rerole); blank and duplicate rows are deleted.  A role that
    doesn't begin with s, u or a (an empty one too) can't be kept.  repaired_sha256: of `role:text` lines.
    A conversation without rows has zeros and the hash of nothing.  Texts may be of any length; other columns are left out.
    Equal texts are told by two 64-bit hashes.
    """
    spark = rows.sparkSession
    small_batches(spark)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    trimmed = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_id"))
    head, hashed = F.left("text", F.lit(64)), F.xxhash64("text")
    order = ["conv_id", "turn", "role", head, hashed, "_id"]
    last = F.when(trimmed != "", F.right(trimmed, F.lit(1)))
    keys = F.xxhash64("conv_id", "role", "text"), F.xxhash64(F.lit(1), "conv_id", "role", "text")
    placed = source.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", last.alias("last"), keys[0].alias("k1"), keys[1].alias("k2"))
    conv_type = placed.schema["conv_id"].dataType
    block_schema = StructType([placed.schema["conv_id"], *StructType.fromDDL(_BLOCK).fields])
    names = block_schema.fieldNames()
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
    conv_arrow = pa.int64() if conv_type.typeName() == "long" else pa.int32() if conv_type.typeName() == "integer" else pa.string()
    kinds_of = [conv_arrow, pa.int32(), pa.int32(), strings, strings, pa.string(), pa.list_(pa.int32()), longs, longs, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _arrow(_blocks(batches), names, kinds_of, 64)

    blocks = written(placed.mapInArrow(cut, block_schema), "repair-blocks")

    # Duplicates of rows in earlier blocks: the first block of each key, and the places of its later ones.
    seen = blocks.select("part", "b", F.explode(F.arrays_zip("at", "k1", "k2")).alias("x")).select("part", "b", "x.at", "x.k1", "x.k2")
    firsts = seen.groupBy("k1", "k2").agg(F.min(F.struct("part", "b")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    later = seen.join(firsts, ["k1", "k2"]).filter((F.col("part") != F.col("first.part")) | (F.col("b") != F.col("first.b"))).groupBy("part", "b").agg(F.collect_list("at").alias("again"))
    shapes = blocks.select("conv_id", "part", "b", "kinds").join(later, ["part", "b"], "left").select("conv_id", "part", "b", "kinds", "again")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(costs)
        for batch in batches:
            kinds = []
            for word, again in zip(batch.column("kinds").to_pylist(), batch.column("again").to_pylist(), strict=True):
                letters = list(word)
                for i in again or ():
                    letters[i] = "d"
                kinds.append("".join(letters))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds), pa.array([steps.matrix(k) for k in kinds], longs)], names=["conv_id", "part", "b", "kinds", "matrix"])

    shape_schema = StructType([block_schema["conv_id"], *StructType.fromDDL("part int, b int, kinds string, matrix array<long>").fields])
    cost_tables = shapes.mapInArrow(matrices, shape_schema).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("b"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, costs_after = object(), costs.tail()
        for batch in batches:
            out = []
            for conv, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if conv != at:
                    at, costs_after = conv, costs.tail()
                out.append(list(costs_after))
                costs_after = tuple(min(FAR, *(matrix[PLACES * s + t] + costs_after[t] for t in range(PLACES))) for s in range(PLACES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, longs)], names=["conv_id", "part", "b", "kinds", "onward"])

    ends = cost_tables.mapInArrow(onward, StructType([*shape_schema.fields[:4], *StructType.fromDDL("onward array<long>").fields])).repartition("part", "b")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(costs)
        for batch in batches:
            found: dict[int, tuple] = {}
            by_size: dict[int, list[tuple[int, list[int], tuple[int, ...]]]] = {}
            for k, (word, after) in enumerate(zip(batch.column("kinds").to_pylist(), batch.column("onward").to_pylist(), strict=True)):
                before, arcs = steps.back(word, tuple(after))
                by_size.setdefault(len(word).bit_length(), []).append((k, arcs[::-1], before))
            for same in by_size.values():  # blocks of like size are ranked together
                for (k, _, before), (letters, exits) in zip(same, least_paths(steps, [x[1] for x in same]), strict=True):
                    found[k] = letters, exits, list(before)
            columns = list(zip(*(found[k] for k in range(batch.num_rows)), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(columns[0], strings), pa.array(columns[1], longs), pa.array(columns[2], longs)], names=["conv_id", "part", "b", "kinds", "letters", "exits", "before"])

    paths = ends.mapInArrow(ranked, StructType([*shape_schema.fields[:4], *StructType.fromDDL("letters array<string>, exits array<long>, before array<long>").fields]))
    heads = (rows if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))).select("conv_id").distinct()
    text_columns = ["roles", "texts", "t_first", "t_last", "turns", "illegal", "i_first", "i_last"]
    stream = heads.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).alias("b")).unionByName(paths, True).unionByName(blocks.select("conv_id", "part", "b", *text_columns), True)
    stream = stream.select("conv_id", "part", "b", F.col("roles").isNotNull().alias("text_row"), "kinds", "letters", "exits", "before", *text_columns)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "b", "text_row")
    result_schema = StructType([block_schema["conv_id"], *StructType.fromDDL(_RESULT).fields])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result = [conv_arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
        return _arrow(_joined(batches, costs), result_schema.fieldNames(), result)

    return stream.mapInArrow(joined, result_schema)


class _Whole:
    """A conversation as its blocks pass by."""

    def __init__(self, conv, costs: Costs):
        self.conv, self.costs = conv, costs
        self.place, self.cost = 0, None
        self.letters: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0
        self.counts = dict.fromkeys("bdt", 0)
        self.low, self.high, self.turns, self.illegal, self.initial = None, None, 0, 0, None

    def line(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
        self.lines += 1

    def path(self, kinds: str, letters: list[str], exits: list[int], before: list[int]) -> None:
        if self.cost is None:
            self.cost = before[0]
        self.kinds, self.word, self.exit = kinds, letters[self.place], exits[self.place]
        self.letters.append(self.word)
        self.counts["b"] += kinds.count("b")
        self.counts["d"] += kinds.count("d")
        self.counts["t"] += sum(k.isupper() for k in kinds)

    def texts(self, roles: list[str], texts: list[str], first, last, turns: int, illegal: int, i_first: str, i_last: str) -> None:
        row = 0
        for letter in self.word:
            if letter == "D":
                row += 1
                continue
            role, text = (roles[row], texts[row]) if letter != "I" else ("", "")
            self.place = KEPT[self.place][role[:1]] if letter == "K" else TURN[self.place]
            self.line(role if letter == "K" else ROLE[self.place], text)
            row += letter != "I"
        if self.place != self.exit:
            raise AssertionError("edits and places don't agree")
        self.turns += turns - (first is not None and first == self.high)
        self.low = first if self.low is None else self.low
        self.high = last if last is not None else self.high
        self.illegal += illegal + (self.initial is not None and self.initial + i_first not in LEGAL)
        self.initial = i_last

    def row(self) -> tuple:
        while self.place in (1, 2):
            self.letters.append("I")
            self.place = TURN[self.place]
            self.line(ROLE[self.place], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost or 0, "".join(self.letters), self.hash.hexdigest()


def _joined(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    whole = None
    for batch in batches:
        for conv, part, _, text_row, kinds, letters, exits, before, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if whole is None or conv != whole.conv:
                if whole is not None:
                    yield whole.row()
                whole = _Whole(conv, costs)
            if part < 0:
                continue
            if text_row:
                whole.texts(*texts)
            else:
                whole.path(kinds, letters, exits, before)
    if whole is not None:
        yield whole.row()
