"""Katz backoff language model over words, and the score of every text.

P_n(w | h), h the n - 1 words before, is the Good-Turing discounted count of the
n-gram over that of its history where the n-gram was seen; elsewhere it is
alpha(h) P_{n-1}(w | h without its first word), evaluated level by level down to
words.  alpha(h) is such that the probabilities after h sum to one exactly; a
history that was never followed has alpha 1.  P_1(w) is the discounted relative
count of the word; what the discounts free goes to one event, the unknown word.

Everything is counted, without a limit on the vocabulary:

1. Texts are read in batches of some million tokens.  A batch's tokens go to a table;
   its different words, by 64-bit hash, go to buckets, which sum the counts of all batches.
2. Words get ids in the order of their counts, so that an id tells its count by a
   short table of the different counts.  Each batch gets the ids of its words.
3. For each level, a batch sends its different n-grams, as (id of the history, id of the
   word), to the history's bucket.  A bucket keeps its part of the table of n-grams, and
   answers each batch: counts, and for each history what its alpha is made of.  A
   batch then knows P_n of all its tokens; the n-grams' ids are the next level's histories.

Rows go by batch and bucket, whatever the number of texts.  The n-grams of the most
frequent histories (at most `HOT`) are dealt by the whole n-gram, and what their alphas are made of is summed
over the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm._spark import dropped, small_batches, written
from cytolake.llm._text import Chunk, U, chunks, mix, pack, pack_sorted, runs, signed, unpack, unpack_sorted, words

END = U(1)
UNKNOWN, START, FIRST = 0, 1, 2  # ids: of what training doesn't have, of a text's begin, of the most frequent word
K = 5  # counts up to this are discounted
HOT = 1024
BATCH_TOKENS = 1_000_000
SELF, TABLE, ASKED = 0, 1, 2  # kinds of rows
PARTS = "kind int, bucket int, batch long, a binary, b binary, c binary, d binary"


def stream(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of every token of a chunk; each row ends with END."""
    w = words(chunk)
    cuts = np.searchsorted(w.row, np.arange(chunk.n + 1))
    token, row = np.empty(len(w.hash) + chunk.n, U), np.repeat(np.arange(chunk.n), np.diff(cuts) + 1)
    token[np.arange(len(w.hash)) + w.row] = w.hash
    token[cuts[1:] + np.arange(chunk.n)] = END
    return row, token


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r up to K, by Katz, of the numbers n[r] of things counted r times; d[0] stands for more (1).

    Where the counts don't allow Good-Turing (an empty class, a factor that is
    not in (0, 1]), it is (r - 1/2) / r.
    """
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = good if 0 < good <= 1 else (r - 0.5) / r
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0)


class Words(NamedTuple):
    """What all tasks know of the words: the different counts, most frequent first, and the first id of each."""

    count: np.ndarray
    first: np.ndarray
    total: int  # training tokens
    types: int  # distinct training tokens
    discount: np.ndarray
    mass: float  # what discounted counts are divided by
    unknown: float  # probability of the unknown word

    def counts(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.zeros(len(ids), np.int64)
        return np.where(ids >= FIRST, self.count[np.maximum(np.searchsorted(self.first, ids, "right") - 1, 0)], 0)

    def p(self, ids: np.ndarray) -> np.ndarray:
        c = self.counts(ids)
        return np.where(c > 0, _discounted(c, self.discount) / self.mass, self.unknown)

    def base(self, ids: np.ndarray) -> np.ndarray:
        return np.log10((self.counts(ids) + 0.5) / (self.total + 0.5 * (self.types + 1)))


def _row(kind: int, bucket: np.ndarray | int, batch: np.ndarray | int, *parts: list[bytes | None]) -> pa.RecordBatch:
    """Rows of PARTS; parts left out are null."""
    size = len(parts[0])
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), size))
    columns = [pa.array(p, pa.binary()) for p in parts] + [pa.nulls(size, pa.binary())] * (4 - len(parts))
    return pa.RecordBatch.from_arrays([full(kind, np.int32), full(bucket, np.int32), full(batch, np.int64), *columns], names=["kind", "bucket", "batch", "a", "b", "c", "d"])


def _batches(rows: DataFrame, buckets: int) -> DataFrame:
    """PARTS and ids: a SELF row of each batch (its tokens as numbers of its words, its rows' lengths, which of them train), and ASKED rows of its words (hashes, training counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0

        def emitted(ids: list[pa.Array], train: list[np.ndarray], lengths: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal done
            batch = (TaskContext.get().partitionId() << 32) + done
            done += 1
            n, learn = np.concatenate(lengths), np.concatenate(train)
            u, at = np.unique(np.concatenate(tokens), return_inverse=True)
            count = np.bincount(at[np.repeat(learn, n)], minlength=len(u))
            one = pa.concat_arrays(ids)
            listed = lambda b, x: pa.RecordBatch.from_arrays([*b.columns, x], names=[*b.schema.names, "ids"])
            yield listed(_row(SELF, -1, batch, [pack(at)], [pack(2 * n + learn)]), pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one))
            bucket = ((u >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(u))
            asked = _row(ASKED, bucket[cut], batch, [pack_sorted(u[s:e]) for s, e in zip(cut, ends, strict=True)], [pack(count[s:e]) for s, e in zip(cut, ends, strict=True)])
            yield listed(asked, pa.nulls(len(cut), pa.list_(one.type)))

        parts: list[list] = [[], [], [], []]
        size = 0
        for b in batches:
            learn = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for c in chunks(b.column(1)):
                row, token = stream(c)
                for held, x in zip(parts, (b.column(0).slice(c.row, c.n), learn[c.row : c.row + c.n], np.bincount(row, minlength=c.n), token), strict=True):
                    held.append(x)
                size += len(token)
                if size >= BATCH_TOKENS:
                    yield from emitted(*parts)
                    parts, size = [[], [], [], []], 0
        if size:
            yield from emitted(*parts)

    return rows.mapInArrow(run, f"{PARTS}, ids array<{dict(rows.dtypes)['doc_id']}>")


def _parts(table: pa.Table, name: str) -> list[bytes | None]:
    return table[name].to_pylist()


def _word_table(asked: DataFrame) -> DataFrame:
    """bucket, a and b: the training words of each bucket, sorted by hash, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in runs(batches, "bucket"):
            u, at = np.unique(np.concatenate([unpack_sorted(x) for x in _parts(table, "a")]), return_inverse=True)
            c = np.bincount(at, np.concatenate([unpack(x) for x in _parts(table, "b")]), len(u)).astype(np.int64)
            u, c = u[c > 0], c[c > 0]
            yield _row(TABLE, bucket, -1, [pack_sorted(u)], [pack(c)])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PARTS)


def _word_ids(table: DataFrame) -> tuple[DataFrame, Words]:
    """The table with the words' ids in place of their counts, and what all tasks know."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c, n = np.unique(unpack(x.as_py()).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), bucket, np.int32)), pa.array(c), pa.array(n)], names=["bucket", "c", "n"])

    by = written(table.select("bucket", "b").mapInArrow(classes, "bucket int, c long, n long"), "word-classes")
    of = by.groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).toArrow()  # as many rows as there are different counts
    c, n = of["c"].to_numpy().astype(np.int64), of["n"].to_numpy().astype(np.int64)
    total, types = int((c * n).sum()), int(n.sum())
    small = np.zeros(K + 2)
    small[c[c <= K + 1]] = n[c <= K + 1]
    d = discounts(small)
    freed = float(sum(r * small[r] * (1 - d[r]) for r in range(1, K + 1)))
    # where no count is small, half a token is set aside for the unknown word
    freed, mass = (freed, float(total)) if freed else (0.5, total + 0.5)
    known = Words(c, FIRST + np.cumsum(n) - n, total, types, d, mass, freed / mass)
    shared = table.sparkSession.sparkContext.broadcast(known)
    # of each class, the first bucket's words come first, then the next one's
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by.withColumn("s", before).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("starts"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for bucket, a, x, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                count = unpack(x.as_py()).astype(np.int64)
                start = s.values
                u, at = np.unique(count, return_inverse=True)
                order = np.argsort(at, kind="stable")
                rank = np.empty(len(at), np.int64)
                rank[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
                ids = known.first[np.searchsorted(-known.count, -u)][at] + start.field("s").to_numpy()[at] + rank
                yield _row(TABLE, bucket, -1, [a.as_py()], [pack(ids)])

    return written(table.select("bucket", "a", "b").join(starts, "bucket").mapInArrow(numbered, PARTS), "word-ids"), known


def _answered_words(asked: DataFrame, table: DataFrame) -> DataFrame:
    """The ids of each ASKED row's words, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, ids = None, np.zeros(0, U), np.zeros(0, np.int64)
        for b in batches:
            out = []
            for kind, bucket, batch, x, y in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == TABLE:
                    at, key, ids = bucket, unpack_sorted(x), unpack(y).astype(np.int64)
                    continue
                u = unpack_sorted(x)
                found = np.zeros(len(u), np.int64)
                if bucket == at and len(key):
                    i = np.minimum(np.searchsorted(key, u), len(key) - 1)
                    found = np.where(key[i] == u, ids[i], UNKNOWN)
                out.append((bucket, batch, pack(found)))
            if out:
                x = list(zip(*out, strict=True))
                yield _row(ASKED, np.array(x[0]), np.array(x[1]), list(x[2]))

    return asked.unionByName(table).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, PARTS)


def _packed_keys(h: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes]:
    """Keys in the order of h, then w."""
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    step = np.diff(w, prepend=0)
    return pack(np.diff(h, prepend=0)), pack(np.where(same, step, w))


def _unpacked_keys(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, step = unpack(a).astype(np.int64), unpack(b).astype(np.int64)
    h = np.cumsum(gap)
    new = np.ones(len(h), bool)
    new[1:] = gap[1:] > 0
    total = np.cumsum(step)
    first = np.flatnonzero(new)
    return h, total - np.repeat(total[first] - step[first], np.diff(np.append(first, len(h))))


def _distinct(bucket: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each different (bucket, h, w) in this order, and the number of each one's key."""
    bits = [int(x.max(initial=0)).bit_length() for x in (bucket, h, w)]
    if sum(bits) < 64:  # one number to sort by
        key = (bucket.astype(U) << U(bits[1] + bits[2])) | (h.astype(U) << U(bits[2])) | w.astype(U)
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        return first, at
    order = np.lexsort((w, h, bucket))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(bucket[order]) != 0) | (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


class Level(NamedTuple):
    """What all tasks know of a level's n-grams."""

    n: int
    buckets: int
    hot: np.ndarray  # histories whose n-grams are dealt by the whole n-gram, sorted
    discount: np.ndarray = np.ones(K + 1)
    sums: np.ndarray = np.zeros((0, K + 2))  # of each of `hot`: what `_sums` gives

    def bucket(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            name = mix(h.astype(U) + U(self.n << 56))
            spread = np.isin(h, self.hot)
            name[spread] = mix(name[spread] + w[spread].astype(U))
        return (name % U(self.buckets)).astype(np.int64)

    def asked(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens with a known history: which, bucket and first of each different key (an unknown word is a key too), and each one's key."""
        own = np.flatnonzero(h != UNKNOWN)
        bucket = self.bucket(h[own], w[own])
        first, at = _distinct(bucket, h[own], w[own])
        return own, bucket[first], own[first], at

    def alpha(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 alpha, and what counts are divided by, of histories with these sums.

        A history none of whose n-grams is discounted leaves nothing to back off with;
        half a count is set aside for it.
        """
        follow, lower = sums[:, 0], sums[:, 1]
        small = sums[:, 2:] * np.arange(1, K + 1)
        got = np.maximum(follow, 0.5)
        seen = (follow - small.sum(1) + (small * self.discount[1:]).sum(1)) / got
        full = seen > 1 - 1e-9
        seen = np.where(full, seen * got / (got + 0.5), seen)
        a = np.log10((1 - seen) / np.maximum(1 - lower, 1e-12))
        return np.where(follow > 0, a, 0.0), np.where(full, got + 0.5, got)


def _sums(h: np.ndarray, c: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories, and for each how often it was followed, the sum of its n-grams' lower probabilities, and how many were counted 1 to K times."""
    u, at = np.unique(h, return_inverse=True)
    classes = [np.bincount(at, c == r, len(u)) for r in range(1, K + 1)]
    return u, np.stack([np.bincount(at, c, len(u)), np.bincount(at, lower, len(u)), *classes], 1)


def _state(table: pa.Table, bucket: np.ndarray) -> tuple[pa.Table, pa.Table]:
    """A batch's SELF row and the answers to it, by bucket."""
    table = table.take(pa.array(np.argsort(table["bucket"].to_numpy(), kind="stable")))
    return table.slice(0, 1), table.slice(1)


def _previous(x: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """The value before each token; `start` at the begin of a row."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    ends = np.cumsum(n)
    out[(ends - n)[n > 0]] = start
    return out


def _level_parts(state: DataFrame, shared, level, first: bool, buckets: int) -> DataFrame:
    """SELF rows of batches with all that is known now, and ASKED rows of the level's n-grams.

    SELF: words' ids, histories' ids, rows, and P of the level below (not for the first level, where ids tell it).
    ASKED: keys, training counts, and P of the level below of each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = shared.value, level.value
        for batch, table in runs(batches, "batch"):
            own, answers = _state(table, table["bucket"].to_numpy())
            lengths = unpack(_parts(own, "b")[0]).astype(np.int64)
            n, learn = lengths >> 1, (lengths & 1).astype(bool)
            if first:
                ids = np.concatenate([unpack(x).astype(np.int64) for x in _parts(answers, "a")])
                w = ids[unpack(_parts(own, "a")[0]).astype(np.int64)]
                h, p = _previous(w, n, START), None
            else:
                w, h, p = _solved(known, level.value[1], own, answers, n)
                now = level.value[0]
            which, bucket, key, at = now.asked(h, w)
            count = np.bincount(at, np.repeat(learn, n)[which], len(key)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            spans = list(zip(cut, np.append(cut[1:], len(bucket)), strict=True))
            keys = [_packed_keys(h[key[s:e]], w[key[s:e]]) for s, e in spans]
            lower = [None if p is None else pa.compress(np.power(10.0, p[key[s:e]]).tobytes(), "zstd", asbytes=True) for s, e in spans]
            listed = lambda b, x: pa.RecordBatch.from_arrays([*b.columns, x], names=[*b.schema.names, "ids"])
            yield listed(_row(SELF, -1, batch, [pack(w)], [_parts(own, "b")[0]], [None if p is None else pack(h)], [None if p is None else pa.compress(p.tobytes(), "zstd", asbytes=True)]), own["ids"].combine_chunks())
            if len(cut):
                yield listed(_row(ASKED, bucket[cut], batch, [a for a, _ in keys], [b for _, b in keys], [pack(count[s:e]) for s, e in spans], lower), pa.nulls(len(cut), own["ids"].type))

    return state.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(run, f"{PARTS}, ids {dict(state.dtypes)['ids']}")


def _counted(asked: DataFrame, shared, level: Level, last: bool) -> DataFrame:
    """kind, bucket, batch and parts: the TABLE of each bucket's n-grams (keys, counts, and the bucket's share of the sums of `hot`), and answers to each batch.

    Answer: counts of its keys (a), their ids (b; not on the last level), and the sums of each of its histories in order (c, d); those of `hot` are left out.
    """
    columns = f"{PARTS}, classes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for bucket, table in runs(batches, "bucket"):
            batch, a, b, c, d = (_parts(table, x) for x in ("batch", "a", "b", "c", "d"))
            keys = [_unpacked_keys(x, y) for x, y in zip(a, b, strict=True)]
            size = np.array([len(h) for h, _ in keys])
            h, w = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
            first, at = _distinct(np.zeros(len(h), np.int64), h, w)
            count = np.bincount(at, np.concatenate([unpack(x) for x in c]), len(first)).astype(np.int64)
            p = known.p(w[first]) if d[0] is None else np.concatenate([np.frombuffer(pa.decompress(x, 8 * int(n), "zstd"), np.float64) for x, n in zip(d, size, strict=True)])[first]
            own = np.flatnonzero(count > 0)
            ids = np.zeros(len(first), np.int64)
            ids[own] = FIRST + np.arange(len(own)) * level.buckets + bucket
            th, tw, tc = h[first[own]], w[first[own]], count[own]
            classes = np.bincount(np.minimum(tc, K + 2), minlength=K + 3)[: K + 2]
            told = lambda x, n, y: pa.RecordBatch.from_arrays([*x.columns, y if y is not None else pa.nulls(n, pa.list_(pa.int64()))], names=[*x.schema.names, "classes"])
            x, y = _packed_keys(th, tw)
            u, sums = _sums(th, tc, p[own])
            frequent = np.isin(u, level.hot)
            yield told(_row(TABLE, bucket, -1, [x], [y], [pack(tc)], [np.concatenate([u[frequent, None].astype(float), sums[frequent]], 1).tobytes()]), 1, pa.array([classes.tolist()], pa.list_(pa.int64())))
            out, ends = [], np.cumsum(size)
            for i, (s, e) in enumerate(zip(ends - size, ends, strict=True)):
                asks = np.unique(h[s:e])
                asks = asks[~np.isin(asks, level.hot)]
                got = np.zeros((len(asks), K + 2))
                if len(u):
                    j = np.minimum(np.searchsorted(u, asks), len(u) - 1)
                    got[u[j] == asks] = sums[j[u[j] == asks]]
                whole = np.delete(got, 1, 1).astype(np.int64)
                out.append((batch[i], pack(count[at[s:e]]), None if last else pack(ids[at[s:e]]), pack(whole.ravel()), pa.compress(got[:, 1].tobytes(), "zstd", asbytes=True)))
            x = list(zip(*out, strict=True))
            yield told(_row(ASKED, bucket, np.array(x[0]), *map(list, x[1:])), len(out), None)

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, columns)


def _solved(known: Words, level: Level, own: pa.Table, answers: pa.Table, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the ids of the level's n-grams as the next level's histories, and log10 P of the level, of a batch's tokens.

    The recursion's step: the discounted n-gram where it was seen, else alpha times the level below.
    """
    w = unpack(_parts(own, "a")[0]).astype(np.int64)
    c, d = _parts(own, "c")[0], _parts(own, "d")[0]
    h = _previous(w, n, START) if c is None else unpack(c).astype(np.int64)
    p = np.log10(known.p(w)) if d is None else np.frombuffer(pa.decompress(d, 8 * len(w), "zstd"), np.float64).copy()
    which, bucket, key, at = level.asked(h, w)
    if not len(which):
        return w, np.zeros(len(w), np.int64), p
    count = np.concatenate([unpack(x).astype(np.int64) for x in _parts(answers, "a")])
    asked = _parts(answers, "b")
    ids = None if asked[0] is None else np.concatenate([unpack(x).astype(np.int64) for x in asked])
    whole = np.concatenate([unpack(x).astype(np.float64).reshape(-1, K + 1) for x in _parts(answers, "c")])
    lower = np.concatenate([np.frombuffer(pa.decompress(x, 8 * len(unpack(y)) // (K + 1), "zstd"), np.float64) for x, y in zip(_parts(answers, "d"), _parts(answers, "c"), strict=True)])
    sums = np.insert(whole, 1, lower, axis=1)
    # histories come bucket by bucket, each once; those of `hot` are known to all
    new = np.ones(len(key), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (h[key[1:]] != h[key[:-1]])
    hot = np.isin(h[key], level.hot)
    number = np.cumsum(new & ~hot) - 1
    each = np.zeros((len(key), K + 2))
    each[~hot] = sums[number[~hot]]
    if hot.any():
        each[hot] = level.sums[np.searchsorted(level.hot, h[key[hot]])]
    alpha, follow = level.alpha(each)
    seen = np.log10(np.maximum(_discounted(count, level.discount), 1e-300) / follow)
    p[which] = np.where(count[at] > 0, seen[at], alpha[at] + p[which])
    gram = np.zeros(len(w), np.int64)
    if ids is not None:
        gram[which] = ids[at]
    return w, _previous(gram, n, UNKNOWN), p


def _hot_sums(table: DataFrame, level: Level) -> np.ndarray:
    """The sums of `hot`, over all buckets; as many rows as there are hot histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                part = np.frombuffer(x.as_py(), np.float64).reshape(-1, K + 3)
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].astype(np.int64)), *(pa.array(part[:, i + 1]) for i in range(K + 2))], names=["h", *names])

    names = [f"s{i}" for i in range(K + 2)]
    got = table.select("d").mapInArrow(run, "h long, " + ", ".join(f"{x} double" for x in names)).groupBy("h").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    out = np.zeros((len(level.hot), K + 2))
    out[np.searchsorted(level.hot, got["h"].to_numpy())] = np.stack([got[x].to_numpy() for x in names], 1) if got.num_rows else 0
    return out


def _hot_grams(table: DataFrame, buckets: int, least: float) -> np.ndarray:
    """Ids of the n-grams counted more often than `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i = np.flatnonzero(unpack(x) > least)
                yield pa.RecordBatch.from_arrays([pa.array(FIRST + i * buckets + bucket)], names=["h"])

    return np.sort(table.select("bucket", "c").mapInArrow(run, "h long").toArrow()["h"].to_numpy().astype(np.int64))


def score(documents: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", order: int = 2, buckets: int = 256, bucket_tokens: int = 1 << 23) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    train: which rows the model learns from.  Words are `[^\\x20\\x09-\\x0D]+`
    with A-Z lower-cased; every text has an end token besides, so a null or
    empty text has one token.  base_score is the sum of log10((c + 0.5) / (N +
    0.5 (V + 1))); score the model's log10 probability.  order: words of the longest n-gram, 2 at least.
    Rows that repeat count as often as they are there and get the same scores.  Without training
    texts every word is unknown.  A text is worked on whole by one task.  Other columns are left out.

    buckets: of the tables, at least; there are more when a bucket would have over `bucket_tokens` training tokens.
    """
    spark = documents.sparkSession
    small_batches(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    parts = written(_batches(rows, buckets), "batches", by="kind")
    asked = parts.filter(F.col("kind") == ASKED).drop("ids")
    table, known = _word_ids(written(_word_table(asked), "words"))
    shared = spark.sparkContext.broadcast(known)
    none = F.lit(None).cast(dict(parts.dtypes)["ids"]).alias("ids")
    state = parts.filter(F.col("kind") == SELF).unionByName(_answered_words(asked, table).withColumn("ids", none))
    buckets = max(buckets, -(-known.total // bucket_tokens))
    least = max(known.total / HOT, 1)
    classes = int((known.count > least).sum())
    many = (int(known.first[classes]) - FIRST if classes < len(known.first) else known.types) if classes else 0
    level = Level(2, buckets, np.concatenate([[START], np.arange(FIRST, FIRST + many)]))
    told: tuple | Level = level
    for n in range(2, order + 1):
        more = written(_level_parts(state, shared, spark.sparkContext.broadcast(told), n == 2, buckets), f"level-{n}", by="kind")
        dropped(parts)
        asked = more.filter(F.col("kind") == ASKED).drop("ids")
        counted = written(_counted(asked, shared, level, n == order), f"grams-{n}", by="kind")
        dropped(more, f"kind={ASKED}/")
        grams = counted.filter(F.col("kind") == TABLE)
        of = [x or 0 for x in grams.agg(*(F.sum(F.get("classes", F.lit(r))) for r in range(K + 2))).first()]
        level = level._replace(discount=discounts(np.array(of, float)), sums=_hot_sums(grams, level))
        answers = counted.filter(F.col("kind") == ASKED).select(*parts.drop("ids").columns, none)
        parts = more.filter(F.col("kind") == SELF)
        state = parts.unionByName(answers)
        if n < order:
            following = Level(n + 1, buckets, _hot_grams(grams, buckets, least))
            told, level = (following, level), following
    solved = spark.sparkContext.broadcast(level)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = shared.value, solved.value
        for _, table in runs(batches, "batch"):
            own, answers = _state(table, table["bucket"].to_numpy())
            n = unpack(_parts(own, "b")[0]).astype(np.int64) >> 1
            w, _, p = _solved(known, level, own, answers, n)
            row = np.repeat(np.arange(len(n)), n)
            sums = lambda v, row=row, n=n: pa.array(np.bincount(row, v, len(n)).astype(float))
            ids = own["ids"].combine_chunks().flatten()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.bincount(row, w != UNKNOWN, len(n)).astype(np.int64)), pa.array(np.full(len(n), known.total)), sums(known.base(w)), sums(p)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return state.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(scored, out)
