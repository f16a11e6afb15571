"""Byte-level BPE by a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the pattern; each is merged by itself, lowest
rank first and leftmost among equals.  Pairs wait in buckets, one for each
merge rank; a bucket holds the linked-list positions of its pairs.  Three
levels of bitmaps say which buckets hold anything: a find-first-set a level
gives the next rank.  A position whose pair has changed meanwhile is stale and
skipped when its bucket is opened.

The distinct pre-tokens of a batch share one queue, so that a bucket is merged
in all of them at once with array operations.  A very long pre-token has a
queue of its own, whose buckets are heaps: n log n at most, whatever it repeats.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from cytolake.llm._spark import small_batches
from cytolake.llm._text import chunks

#: Bytes from which a pre-token has a queue of its own.
LONG = 256
#: Bytes of text whose pre-tokens share one queue.
CHUNK = 4 << 20


class Vocabulary(NamedTuple):
    """Ranks as arrays: what each id stands for, and which pairs of ids merge to which rank.  Its size is that of the rank file."""

    ranks: dict[bytes, int]
    blob: np.ndarray
    start: np.ndarray
    length: np.ndarray
    of_byte: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    #: Ids that may be part of a token of lower rank: after such a merge a lower bucket may come first.
    early: np.ndarray
    pattern: str
    #: Characters that `regex` takes for letters or numbers and the pattern's library doesn't.
    newer: str

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 if they don't merge (id -1: nothing there)."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)


def _newer() -> str:
    """Letters and numbers of a later Unicode than the tokenizer library's, as ranges of a character class."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    ranks = {bytes([i]): i for i in range(256)}
    more: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        known = bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)).decode()
        more |= set(regex.findall(kind, every)) - set(known)
    codes = np.array(sorted(map(ord, more)), np.int64)
    if not len(codes):
        return ""
    first = np.concatenate([[True], np.diff(codes) != 1])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(codes[first], codes[np.concatenate([first[1:], [True]])], strict=True))


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """Read a file of lines `base64 rank`: with a scheme (`…://`) by Spark, else from the driver's own disk."""
    if "://" in path:
        lines = bytes(spark.read.format("binaryFile").load(path).first()["content"]).splitlines()
    else:
        with open(path, "rb") as file:
            lines = file.read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("a byte-level vocabulary has a rank for every byte")
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    found = np.array([pairs[k] for k in keys.tolist()], np.int64)
    size = max(ranks.values()) + 1
    early = np.zeros(size, bool)
    for part in (keys >> 32, keys & 0xFFFFFFFF):
        early[part[found < part]] = True
    by_rank = sorted((b, a) for a, b in ranks.items())
    length = np.zeros(size, np.int64)
    length[[b for b, _ in by_rank]] = [len(a) for _, a in by_rank]
    blob = np.frombuffer(b"".join(a for _, a in by_rank), np.uint8)
    of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    return Vocabulary(ranks, blob, np.cumsum(length) - length, length, of_byte, keys, found, early, pattern, _newer())


class RankQueue:
    """Buckets of positions by rank, as chains of runs in one table of positions, under three levels of bitmaps."""

    def __init__(self, ranks: int, entries: int):
        self.levels = [np.zeros((ranks >> 6 * (k + 1)) + 1, np.uint64) for k in range(3)]
        self.head = np.full(ranks, -1, np.int64)
        self.at = np.empty(entries, np.int64)
        self.start, self.stop, self.link = (np.empty(1024, np.int64) for _ in range(3))
        self.size = self.runs = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        n = len(ranks)
        if not n:
            return
        if self.size + n > len(self.at):
            self.at = np.resize(self.at, 2 * len(self.at) + n)
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        self.at[self.size : self.size + n] = positions[order]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        if self.runs + len(first) > len(self.start):
            self.start, self.stop, self.link = (np.resize(x, 2 * len(x) + len(first)) for x in (self.start, self.stop, self.link))
        own = slice(self.runs, self.runs + len(first))
        bit = ranks[first]
        self.start[own] = first + self.size
        self.stop[own] = np.append(first[1:], n) + self.size
        self.link[own] = self.head[bit]
        self.head[bit] = np.arange(own.start, own.stop)
        for level in self.levels:
            np.bitwise_or.at(level, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
            bit = bit >> 6
        self.size += n
        self.runs = own.stop

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that has a bucket, and the positions in it; the bucket is empty then."""
        low, middle, top = self.levels
        at = 0
        for k, word in enumerate(top.tolist()):
            if word:
                at = (k << 6) + (word & -word).bit_length() - 1
                break
        else:
            return None
        for level in (middle, low):
            word = int(level[at])
            at = (at << 6) + (word & -word).bit_length() - 1
        rank = at
        for level in (low, middle, top):
            word = int(level[at >> 6]) & ~(1 << (at & 63))
            level[at >> 6] = word
            if word:
                break
            at >>= 6
        start, stop, link = map(memoryview, (self.start, self.stop, self.link))
        found, run = [], int(self.head[rank])
        while run >= 0:
            found.append(self.at[start[run] : stop[run]])
            run = link[run]
        self.head[rank] = -1
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


def merge_all(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)  # also the place before the first and after the last position of a word
    token = np.append(v.of_byte[data], -1)
    word = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1], before[ends - lengths] = n, n
    pair = np.append(v.merged(token[:n], token[after[:n]]), -1)
    alive = np.ones(n, bool)
    queue = RankQueue(len(v.length), 3 * n + 1)
    start = np.flatnonzero(pair >= 0)
    queue.push(pair[start], start)
    while (bucket := queue.pop()) is not None:
        rank, p = bucket
        p = p[pair[p] == rank]  # the others are stale
        if len(p) > 1:
            p.sort()
            same = word[p[1:]] == word[p[:-1]]
            if same.any() and (v.early[rank] or (after[p[:-1]] == p[1:]).any()):  # the leftmost of each word, the others later
                first = np.append(True, ~same)
                queue.push(np.full(len(p) - first.sum(), rank), p[~first])
                p = p[first]
        if not len(p):
            continue
        gone = after[p]
        follows = after[gone]
        token[p] = rank
        alive[gone], pair[gone] = False, -1
        after[p], before[follows] = follows, p
        precedes = before[p]
        new = v.merged(np.concatenate([token[precedes], token[p]]), np.concatenate([token[p], token[follows]]))
        where = np.concatenate([precedes, p])
        pair[where] = new
        pair[n] = -1
        there = (new >= 0) & (where < n)
        queue.push(new[there], where[there])
    return token[:n][alive], np.bincount(word[alive], minlength=len(words))


def merge_one(data: bytes, v: Vocabulary) -> list[int]:
    """Ids of one very long word: the same queue, a merge at a time."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    ids = v.of_byte[raw]
    token, length = ids.tolist(), [1] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [*v.merged(ids[:-1], ids[1:]).tolist(), -1]
    low, middle, top = ([0] * ((len(v.length) >> 6 * k) + 1) for k in (1, 2, 3))
    buckets: dict[int, list[int]] = {}

    def push(rank: int, at: int) -> None:
        bucket = buckets.get(rank)
        if bucket:
            heappush(bucket, at)
            return
        buckets[rank] = [at]
        low[rank >> 6] |= 1 << (rank & 63)
        middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        top[rank >> 18] |= 1 << (rank >> 12 & 63)

    for at, rank in enumerate(pair):
        if rank >= 0:
            push(rank, at)
    while True:
        a = next((k for k, x in enumerate(top) if x), -1)
        if a < 0:
            break
        b = (a << 6) + (top[a] & -top[a]).bit_length() - 1
        c = (b << 6) + (middle[b] & -middle[b]).bit_length() - 1
        rank = (c << 6) + (low[c] & -low[c]).bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            low[c] &= ~(1 << (rank & 63))
            if not low[c]:
                middle[b] &= ~(1 << (c & 63))
                if not middle[b]:
                    top[a] &= ~(1 << (b & 63))
        if pair[at] != rank:
            continue
        gone = after[at]
        token[at], length[at] = rank, length[at] + length[gone]
        pair[gone], length[gone] = -1, 0
        after[at] = follows = after[gone]
        pair[at] = -1
        for left, right in ((before[at], at), (at, follows)):
            if 0 <= left and right < n:
                whole = data[left : left + length[left] + length[right]]
                pair[left] = new = v.ranks.get(whole, -1)
                if new >= 0:
                    push(new, left)
        if follows < n:
            before[follows] = at
    out, at = [], 0
    while at < n:
        out.append(token[at])
        at = after[at]
    return out


class Splitter:
    """Cuts texts into pre-tokens as the tokenizer library does, whose letters and numbers are those of an older Unicode."""

    def __init__(self, v: Vocabulary):
        self.usual = regex.compile(v.pattern)
        self.newer = regex.compile(f"[{v.newer}]") if v.newer else None
        strict = v.pattern.replace(r"\p{L}", rf"[\p{{L}}--[{v.newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{v.newer}]]")
        self.strict = regex.compile(strict, regex.V1) if v.newer else self.usual

    def __call__(self, text: str) -> list[str]:
        pattern = self.strict if self._rare(text) else self.usual
        return [m.group() for m in pattern.finditer(text)] if pattern.groups else pattern.findall(text)

    def _rare(self, text: str) -> bool:
        if self.newer is None:
            return False
        try:
            text.encode("latin-1")  # no character of Latin-1 is newer than the library
        except UnicodeEncodeError:
            return self.newer.search(text) is not None
        return False


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes start[i] … start[i] + length[i] - 1 for each i in turn."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def encode_texts(texts: list[str], v: Vocabulary, split: Splitter) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each has."""
    seen: dict[str, int] = defaultdict(count().__next__)  # a word that is new gets the next number
    words = [split(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    used = np.fromiter(map(seen.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
    del words
    whole = np.full(len(seen), -1, np.int64)
    short, long = ([], []), ([], [])
    for i, x in enumerate(seen):
        data = x.encode()
        rank = v.ranks.get(data)
        if rank is not None:
            whole[i] = rank
        else:
            at, words = long if len(data) >= LONG else short
            at.append(i)
            words.append(data)
    counts = (whole >= 0).astype(np.int64)
    flat = [whole[whole >= 0]]
    order = [np.flatnonzero(whole >= 0)]
    if short[0]:
        ids, n = merge_all(short[1], v)
        flat.append(ids)
        order.append(np.array(short[0]))
        counts[short[0]] = n
    for i, data in zip(*long, strict=True):
        ids = merge_one(data, v)
        flat.append(np.array(ids))
        order.append(np.array([i]))
        counts[i] = len(ids)
    ids, order = np.concatenate(flat), np.concatenate(order)
    start = np.zeros(len(seen), np.int64)
    start[order] = np.cumsum(counts[order]) - counts[order]
    lengths = counts[used]
    out = ids[gather(start[used], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    stops = ends[np.cumsum(sizes)]
    return out, np.diff(stops, prepend=0)


def encode(documents: DataFrame, v: Vocabulary, *, text: str = "text", ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (all, if none are named) and array<int> `ids` of each whole text.

    The ids are those of the tokenizer library with these ranks and this pattern,
    without special tokens: the string of a special token is ordinary text.  A null
    or empty text has no ids.  Rows that repeat are rows of their own, and texts may be as
    long as a string can be; work grows with their length times the logarithm of a pre-token's.
    A column of the input named `ids` is replaced.  What is sent to the tasks is the vocabulary alone.
    """
    spark = documents.sparkSession
    small_batches(spark)
    carry = [c for c in (documents.columns if carry is None else carry) if c != ids]
    source = documents.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias(f"_{ids}_text"))
    schema = StructType([*source.schema.fields[:-1], StructField(ids, ArrayType(IntegerType(), False), False)])
    sent = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        split = Splitter(known)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for c in chunks(texts, CHUNK):
                part = b.slice(c.row, c.n)
                flat, n = encode_texts([x or "" for x in texts.slice(c.row, c.n).to_pylist()], known, split)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*carry, ids])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, v: Vocabulary, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and `decoded`: the bytes that the ids stand for.  Null or empty ids: no bytes.  An id without a rank is an error."""
    schema = StructType([*(f for f in encoded.schema.fields if f.name != decoded), StructField(decoded, BinaryType(), False)])
    columns = [f.name for f in schema.fields[:-1]]
    sent = encoded.sparkSession.sparkContext.broadcast(v._replace(ranks={}, pair_keys=None, pair_ranks=None, early=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            lists = b.column(columns.index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(known.length) or not known.length[flat].all()):
                raise ValueError("an id has no rank")
            length = known.length[flat]
            data = known.blob[gather(known.start[flat], length)]
            ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(np.concatenate([[0], n]))]
            out = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns, out.cast(pa.binary())], names=[*columns, decoded])

    return encoded.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
