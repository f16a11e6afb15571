"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Two documents link when the Jaccard similarity of their sets of word n-grams is
at least `percent`/100.  Documents of one set are a class and are joined once.

1. A pass over the texts gives the class of each document and the n-grams of each
   batch, which are counted.  Two tables of fixed size tell which n-grams several
   sets have, and how many.  Those of one set come first, then rarer ones,
   then more frequent ones, then by hash: one order for all documents.
2. A pass emits what each class's prefix shares with others: similar sets share an
   n-gram of their prefixes.  Lists of classes that share one are kept where a pair in them
   passes the length and the positional filter.
3. The sets of the classes left (of each class's first document) are fetched in a
   third pass, past a bit table of fixed size, with a histogram of each set for the suffix filter.
4. Classes meet in blocks at the least of their n-grams under another order, in
   large groups under several orders, and are verified there; links merge into
   components.  What matters is connection, so a large group of near copies
   costs its blocks, not its pairs.
5. Pairs left, of different components: those of short lists that pass the length, positional and
   suffix filters are verified exactly, once; the classes of long lists meet in blocks, each two blocks
   once, and are verified there.

No text is shuffled, only prefix hashes, and sets of the classes that have a
candidate.  Lists and blocks are cut to a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm._spark import small_batches, written
from cytolake.llm._text import Chunk, U, chunks, mix, pack_sorted, signed, unpack_sorted, windows, words
from cytolake.llm.components import components

DEALT = 1 << 19  # n-grams that are dealt out at once
BUCKET_BITS = 8
SHARED_BITS = 19  # of a bucket's places
RANK_BITS = 12
BLOOM_BITS = 23
BINS = 512
LIST_ROWS = 1024
BLOCK_ROWS = 512
BLOCK_GRAMS = 1 << 20
SMALL_LIST = 32
ROUNDS = 3  # homes of a set
LARGE_HOME = 64


def sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct n-grams of each row, sorted; fewer words than k are one n-gram."""
    w = words(chunk)
    h, first = windows(w, k)
    rows, out = [w.row[first]], [h]
    n = np.bincount(w.row, minlength=chunk.n)
    for m in range(1, k):
        h, first = windows(w, m)
        own = n[w.row[first]] == m
        with np.errstate(over="ignore"):
            out.append(mix(h[own] + U(m)))
        rows.append(w.row[first][own])
    row, h = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _signatures(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's n-grams begin, and two sums that stand for its set."""
    cuts = np.searchsorted(row, np.arange(n + 1))
    with np.errstate(over="ignore"):
        a = np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)])
        b = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
        return cuts, a[cuts[1:]] - a[cuts[:-1]], b[cuts[1:]] - b[cuts[:-1]]


def _nodes(ids: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """A 64-bit name for the document's id together with its set."""
    with np.errstate(over="ignore"):
        return mix(mix(s1 + ids.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)) ^ s2)


def names(ids: pa.Array, texts: pa.Array, k: int) -> np.ndarray:
    """The nodes of documents, as `join` gives them."""
    ids, out = ids.fill_null(0).to_numpy(zero_copy_only=False), [np.zeros(0, U)]
    for c in chunks(texts):
        _, s1, s2 = _signatures(*sets(c, k), c.n)
        out.append(_nodes(ids[c.row : c.row + c.n], s1, s2))
    return signed(np.concatenate(out))


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100)"""
    return -(-percent * n // 100)


def _classes_and_grams(rows: DataFrame, k: int) -> DataFrame:
    """id, n, s1, s2 and node of every row; and the different n-grams of some texts at a time, dealt into buckets.

    For the counts 40 bits of an n-gram's hash do: what they confuse counts as more
    frequent than it is, which only makes the order less sharp.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "s1", "s2", "n", "node", "bucket", "grams"]

        def dealt(grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token = np.concatenate(grams)
            token.sort()
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            at = np.flatnonzero(new)
            token = (token[at] << U(1)) | (np.diff(np.append(at, len(token))) > 1).astype(U)  # the last bit: met twice here
            bucket = (token >> U(41 - BUCKET_BITS)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            packed = [pack_sorted(token[x:y]) for x, y in zip(cut, [*cut[1:], len(token)], strict=True)]
            none = pa.nulls(len(cut)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(bucket[cut]), pa.array(packed, pa.binary())], names=names)

        for b in batches:
            seen: set[tuple[int, int]] = set()
            grams, size = [], 0
            ids = b.column(0).fill_null(0).to_numpy()
            for c in chunks(b.column(1)):
                row, h = sets(c, k)
                cuts, s1, s2 = _signatures(row, h, c.n)
                node = _nodes(ids[c.row : c.row + c.n], s1, s2)
                none = pa.nulls(c.n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.row, c.n), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(np.diff(cuts)), pa.array(signed(node)), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
                new = np.array([not (key in seen or seen.add(key)) for key in zip(s1.tolist(), s2.tolist(), strict=True)], bool)
                grams.append(h[new[row]] >> U(24))
                size += len(grams[-1])
                if size >= DEALT:
                    yield from dealt(grams)
                    grams, size = [], 0
            if size:
                yield from dealt(grams)

    return rows.mapInArrow(run, "id long, s1 long, s2 long, n long, node long, bucket int, grams binary")


def _slots(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of 40-bit tokens, and two places in the bucket's bits."""
    mask = U((1 << SHARED_BITS) - 1)
    m = mix(token)
    return (token >> U(40 - BUCKET_BITS)).astype(np.int64), (m & mask).astype(np.int64), ((m >> U(SHARED_BITS)) & mask).astype(np.int64)


def _shared_grams(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, bits of the n-grams that are in two sets or more, and the order of magnitude of the frequent ones by place.

    Both tables have a fixed size; the more n-grams share a place, the less sharp is the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            token, twice = np.concatenate(parts) >> U(1), np.concatenate(parts) & U(1)
            u, at = np.unique(token, return_inverse=True)
            df = np.bincount(at, 1 + twice, len(u))
            u, df = u[df > 1], df[df > 1]
            _, a, b = _slots(u)
            bits, rank = np.zeros(1 << SHARED_BITS, bool), np.zeros(1 << RANK_BITS, np.uint8)
            bits[a], bits[b] = True, True
            np.maximum.at(rank, a >> (SHARED_BITS - RANK_BITS), np.log2(df).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([rank.tobytes()], pa.binary())], names=["bucket", "bits", "rank"])

        at, parts = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if bucket != at and at is not None:
                    yield finish(at, parts)
                    parts = []
                at = bucket
                parts.append(unpack_sorted(data.as_py()))
        if at is not None:
            yield finish(at, parts)

    found = grams.select("bucket", "grams").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, bits binary, rank binary").toArrow()
    bits, rank = np.zeros((1 << BUCKET_BITS, 1 << (SHARED_BITS - 3)), np.uint8), np.zeros((1 << BUCKET_BITS, 1 << RANK_BITS), np.uint8)
    for bucket, x, y in zip(*(found[c].to_pylist() for c in ("bucket", "bits", "rank")), strict=True):
        bits[bucket], rank[bucket] = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    return bits, rank


def _rank(h: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for an n-gram of one set; else 1 and more, the more sets the higher."""
    bits, rank = tables
    bucket, a, b = _slots(h >> U(24))
    has = lambda x: (bits[bucket, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
    return np.where(has(a) & has(b), 1 + np.maximum(rank[bucket, a >> (SHARED_BITS - RANK_BITS)], 1), 0).astype(np.uint8)


def _prefixes(rows: DataFrame, k: int, percent: int, rarity) -> DataFrame:
    """tok, node, n, pos: what is shared of the prefix of each class, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, seen = rarity.value, set()
        for b in batches:
            ids = b.column(0).to_numpy()
            for c in chunks(b.column(1)):
                row, h = sets(c, k)
                cuts, s1, s2 = _signatures(row, h, c.n)
                node, n = signed(_nodes(ids[c.row : c.row + c.n], s1, s2)), np.diff(cuts)
                new = np.zeros(c.n, bool)
                for i, key in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                    if n[i] and key not in seen:
                        seen.add(key)
                        new[i] = True
                own = new[row]
                row, h = row[own], h[own]
                rank = _rank(h, tables)
                order = np.lexsort((h, rank, row))
                row, h = row[order], h[order]
                pos = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (pos <= n[row] - _needed(n[row], percent)) & (rank[order] > 0)
                row, h, pos = row[keep], h[keep], pos[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(node[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["tok", "node", "n", "pos"])

    return rows.mapInArrow(run, "tok long, node long, n int, pos int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of a stream sorted by `keys`, and where the groups begin."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for key in keys:
            x = table[key].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < 4096:
            continue
        table = pa.Table.from_batches(held)
        starts = cut(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            held, size = table.slice(starts[-1]).combine_chunks().to_batches(), table.num_rows - starts[-1]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _pairs(starts: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in one group, some at a time."""
    group = np.zeros(rows, np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    i = np.arange(rows - 1)
    d = 1
    while True:
        i = i[i < rows - d]
        i = i[group[i] == group[i + d]]  # a row without partner at distance d has none further on
        if not len(i):
            return
        yield i, i + d
        d += 1


def _possible(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter of two sets that share the n-grams at these prefix positions."""
    most = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _in_blocks(lists: DataFrame, rows: int) -> DataFrame:
    """Lists cut to blocks of about `rows` rows; every two blocks of a list meet under one (tok, i, j)."""
    counted = lists.groupBy("tok").agg(F.count("*").alias("c"))
    blocks = F.ceil(F.col("c") / rows)
    own = lists.join(counted, "tok").withColumn("blk", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    return own.withColumn("o", other).select(*[x for x in lists.columns], "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))


def _with_partner(lists: DataFrame, percent: int) -> DataFrame:
    """The rows of (tok, rep, n, pos) that pass both filters with another row of their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["tok", "i", "j"]):
            n, pos, blk = (table[x].to_numpy().astype(np.int64) for x in ("n", "pos", "blk"))
            across = table["i"].to_numpy() != table["j"].to_numpy()
            keep = np.zeros(len(n), bool)
            for a, b in _pairs(starts, len(n)):
                ok = _possible(n[a], pos[a], n[b], pos[b], percent) & (~across[a] | (blk[a] != blk[b]))
                keep[a[ok]] = True
                keep[b[ok]] = True
            yield from table.select(["tok", "rep", "n", "pos"]).filter(pa.array(keep)).to_batches()

    found = _in_blocks(lists, LIST_ROWS).repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")
    return found.mapInArrow(run, "tok long, rep long, n int, pos int").distinct()


def _bloom(classes: DataFrame) -> np.ndarray:
    """Bits of the names of the classes' first documents; of fixed size."""
    mask = (1 << BLOOM_BITS) - 1
    bits = classes.select(F.explode(F.array(F.col("rep").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("rep", BLOOM_BITS).bitwiseAND(F.lit(mask)))).alias("bit"))
    words_ = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    out = np.zeros(1 << (BLOOM_BITS - 6), U)
    got = words_.toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(U)
    return out


def _sets(rows: DataFrame, k: int, bloom) -> DataFrame:
    """rep, grams, bins and the homes of the documents that hit the bit table.

    A home is the least n-gram under another order; sets that are similar have
    the same with the probability of their similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = bloom.value, U((1 << BLOOM_BITS) - 1)

        def has(bit: np.ndarray) -> np.ndarray:
            return (table[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) > 0

        for b in batches:
            ids = b.column(0).to_numpy()
            for c in chunks(b.column(1)):
                row, h = sets(c, k)
                cuts, s1, s2 = _signatures(row, h, c.n)
                node = _nodes(ids[c.row : c.row + c.n], s1, s2)
                out = []
                for i in np.flatnonzero(has(node & mask) & has((node >> U(BLOOM_BITS)) & mask) & (np.diff(cuts) > 0)):
                    own = h[cuts[i] : cuts[i + 1]]
                    bins = np.minimum(np.bincount((own >> U(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8)
                    out.append((signed(node)[i], own.tobytes(), bins.tobytes(), [int(signed(mix(own ^ U(r * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))).min()) for r in range(1, ROUNDS + 1)]))
                if out:
                    x = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.binary()), pa.array(x[2], pa.binary()), pa.array(x[3], pa.list_(pa.int64()))], names=["rep", "grams", "bins", "homes"])

    return rows.mapInArrow(run, "rep long, grams binary, bins binary, homes array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(grams: list[np.ndarray], percent: int, side: np.ndarray | None = None, comp: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components among some sets, each pair verified once.

    side: pairs within one side other than -1 are met elsewhere.  comp: what is linked already.
    """
    m = len(grams)
    size = np.array([len(g) for g in grams])
    token, owner = np.concatenate(grams), np.repeat(np.arange(m), size)
    _, column, n = np.unique(token, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m), np.float32)
    width, top = 4096, int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((m, min(width, top - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    ok = np.triu((100 + percent) * both.astype(np.float64) >= percent * (size[:, None] + size[None, :]), 1)
    if side is not None:
        ok &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    root = list(range(m)) if comp is None else np.unique(comp, return_index=True)[1][np.unique(comp, return_inverse=True)[1]].tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*(i.tolist() for i in np.nonzero(ok)), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _block_count(rows: Column, grams: Column) -> Column:
    """Blocks, so that none has many more than BLOCK_ROWS sets or BLOCK_GRAMS n-grams."""
    return F.ceil(F.greatest(rows / BLOCK_ROWS, grams / BLOCK_GRAMS)).cast("int")


def _met(found: DataFrame, percent: int) -> DataFrame:
    """Links among the classes of one home.

    Everyone goes to its first home.  Where that is a large one, so that its
    classes meet in several blocks, they also go to their further homes.
    """
    own = found.select("rep", (F.octet_length("grams") / 8).alias("n"), F.posexplode("homes").alias("r", "home"))
    sized = own.groupBy("r", "home").agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter(F.col("c") > LARGE_HOME)
    large = written(sized.select("r", "home", _block_count(F.col("c"), F.col("n")).alias("blocks")), "large-homes")  # few; Spark sees how many
    each = found.select("rep", "grams", F.col("homes")[0].alias("h0"), F.posexplode("homes").alias("r", "home"))
    first = large.filter("r = 0").select(F.col("home").alias("h0"), F.lit(True).alias("many"))
    going = each.join(first, "h0", "left").filter("r = 0 or many").drop("h0", "many").join(large, ["r", "home"], "left")
    met = going.select(F.xxhash64("r", "home").alias("home"), F.pmod(F.xxhash64("rep", "r"), F.coalesce("blocks", F.lit(1))).cast("int").alias("blk"), "rep", "grams").repartition("home", "blk").sortWithinPartitions("home", "blk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["home", "blk"]):
            rep, grams = table["rep"].to_numpy(), [np.frombuffer(x.as_buffer(), U) for c in table["grams"].chunks for x in c]
            out = []
            for s, e in zip(starts, [*starts[1:], len(rep)], strict=True):
                if e - s > 1:
                    out += [(rep[s + a], rep[s + b]) for a, b in _block_links(grams[s:e], percent)]
            if out:
                x = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with each row's component."""
    own = lists.drop("comp").join(roots.select(F.col("a").alias("rep"), F.col("b").alias("_c")), "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")
    mixed = own.groupBy("tok").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).filter("_l <> _h").select("tok")
    return own.join(mixed, "tok", "left_semi")


def _rest(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between components, from all pairs that pass the filters in a list.

    Short lists give their pairs, a few for each row; long lists give pairs of blocks.
    """
    sized = lists.groupBy("tok").agg(F.count("*").alias("c"))
    lists = written(lists.join(sized, "tok"), "open-lists")
    return _from_short(lists.filter(F.col("c") <= SMALL_LIST), found, percent).unionByName(_from_long(lists.filter(F.col("c") > SMALL_LIST), found, percent))


def _from_short(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Verified links of the pairs of short lists.  The pairs are written, so that Spark sees how many there are when it picks the joins with the sets."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["tok"]):
            n, pos, rep, comp = (table[x].to_numpy().astype(np.int64) for x in ("n", "pos", "rep", "comp"))
            bins = np.frombuffer(b"".join(x.as_py() for c in table["bins"].chunks for x in c), np.uint8).reshape(-1, BINS).astype(np.int16)
            out = []
            for a, b in _pairs(starts, len(n)):
                ok = (comp[a] != comp[b]) & _possible(n[a], pos[a], n[b], pos[b], percent)
                a, b = a[ok], b[ok]
                for s in range(0, len(a), 4096):
                    x, y = a[s : s + 4096], b[s : s + 4096]
                    apart = np.abs(bins[x] - bins[y]).sum(1)  # at most what the sets differ by
                    near = (100 + percent) * (n[x] + n[y] - apart) >= 2 * percent * (n[x] + n[y])
                    out.append(np.stack([rep[x[near]], rep[y[near]]], 1))
            if out:
                x = np.concatenate(out)
                x = np.unique(np.sort(x, 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["x", "y"])

    rows = lists.join(found.select("rep", "bins"), "rep").select("tok", "rep", "n", "pos", "comp", "bins")
    pairs = written(rows.repartition("tok").sortWithinPartitions("tok").mapInArrow(candidates, "x long, y long").distinct(), "pairs")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U), percent) for p, q in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = found.select(F.col("rep").alias("x"), F.col("grams").alias("p"))
    two = found.select(F.col("rep").alias("y"), F.col("grams").alias("q"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "p", "q").mapInArrow(verified, "a long, b long")


def _from_long(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links of the classes of long lists, verified block by block.

    A class belongs to the longest list it is in, and there to a block.  Two blocks
    meet, once, if any list has classes of both; their sets go there whole, and only
    links that span what isn't connected yet come out.  So rows grow with the blocks
    that meet and not with the pairs.
    """
    own = lists.groupBy("rep").agg(F.max(F.struct("c", "tok")).alias("m"), F.first("n").alias("n"), F.first("comp").alias("comp")).select("rep", "n", "comp", F.col("m.tok").alias("home"))
    blocks = own.groupBy("home").agg(_block_count(F.count("*"), F.sum("n")).alias("blocks"))
    members = written(own.join(blocks, "home").select("rep", "n", "comp", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("unit")), "members")
    seen = lists.join(members.select("rep", "unit"), "rep").select("tok", "unit").distinct()
    pairs = written(seen.alias("a").join(seen.alias("b"), "tok").filter("a.unit <= b.unit").select(F.col("a.unit").alias("u"), F.col("b.unit").alias("v")).distinct(), "block-pairs")
    going = pairs.select(F.explode(F.when(F.col("u") == F.col("v"), F.array("u")).otherwise(F.array("u", "v"))).alias("unit"), "u", "v")
    met = members.join(found.select("rep", "grams"), "rep").join(going, "unit").select("u", "v", "unit", "rep", "comp", "grams").repartition("u", "v").sortWithinPartitions("u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["u", "v"]):
            u, v, unit, rep, comp = (table[x].to_numpy() for x in ("u", "v", "unit", "rep", "comp"))
            grams = [np.frombuffer(x.as_buffer(), U) for c in table["grams"].chunks for x in c]
            out = []
            for s, e in zip(starts, [*starts[1:], len(rep)], strict=True):
                side = np.full(e - s, -1) if u[s] == v[s] else (unit[s:e] == v[s]).astype(int)
                out += [(rep[s + a], rep[s + b]) for a, b in _block_links(grams[s:e], percent, side, comp[s:e])]
            if out:
                x = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def join(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, nodes: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; and on demand its node, a 64-bit name for its id together with its set, and root, one of its component.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.  component_id is the
    smallest id reachable by links.  Texts of fewer than k words are one
    n-gram; null texts and texts without words have none and link with nothing.
    Ids are integers; a row with a null id has component_id null.  Rows that
    repeat link with each other.  Other columns are left out.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    first = written(_classes_and_grams(rows, k), "classes")
    docs = first.filter("bucket is null").select("id", "s1", "s2", "n", "node")
    reps = docs.filter("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min(F.struct("id", "node")).alias("m")).select("s1", "s2", F.col("m.id").alias("least"), F.col("m.node").alias("rep"))
    rarity = spark.sparkContext.broadcast(_shared_grams(first.filter("bucket is not null")))
    valid = rows.filter("id is not null")
    prefixes = _prefixes(valid, k, percent, rarity).repartition("tok")
    shared = written(prefixes.withColumn("c", F.count("*").over(Window.partitionBy("tok"))).filter("c > 1").drop("c"), "shared")
    rarity.destroy()  # what it was for is written; the driver holds one such table less
    rep_of = docs.join(reps, ["s1", "s2"]).select("node", "rep").distinct()
    named = shared.join(rep_of, "node").groupBy("tok", "rep").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    lists = written(_with_partner(written(named, "named"), percent), "lists")
    wanted = lists.select("rep").distinct()
    bloom = spark.sparkContext.broadcast(_bloom(wanted))
    # rows that repeat have the same name and set
    found = written(_sets(valid, k, bloom), "sets")
    bloom.destroy()
    names = first.filter("bucket is null and id is not null").groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    again = written(names.join(wanted, F.col("node") == F.col("rep"), "left_semi"), "names")
    if again.head(1):  # the same row twice: one of its sets is enough
        twice = found.join(again, F.col("rep") == F.col("node"), "left_semi").dropDuplicates(["rep"])
        found = written(found.join(again, F.col("rep") == F.col("node"), "left_anti").unionByName(twice), "sets")
    roots = components(_met(found, percent))
    roots = components(roots.unionByName(_rest(_open_lists(lists, roots), found, percent)))
    rooted = reps.join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("least").alias("c"))
    labelled = rooted.join(least, "root").select("s1", "s2", "c", "root")
    out = docs.join(labelled, ["s1", "s2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id"))).alias("component_id"), *(["node", "root"] if nodes else []))
