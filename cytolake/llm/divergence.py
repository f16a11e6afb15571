"""Source divergence audit: how far the words of each source are from those of the others and of its language.

Texts become partial counts where they are read: lower-casing, splitting,
dictionary encoding and grouping are Arrow compute functions on whole batches.
The partial counts meet by language and term, are summed, and the terms that
are in enough documents are kept as columnar shards.  Each shard then compares
its terms in all pairs of a language's sources, and what is left to sum or rank is a
number a pair and shard, and ten terms a group and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm._spark import small_batches, written
from cytolake.llm._text import chunks

#: Partial counts that a task holds before it sends them on.
HELD_ROWS = 1 << 19
#: Bytes of text that are split at once.
CHUNK = 8 << 20
#: Cells (terms x sources) that are compared at once.
CELLS = 1 << 20
#: Kept counts of a shard, about.
SHARD_ROWS = 1 << 18
#: Sources of a language that one task compares with all others.
SOURCES = 256
SCALE = 1_000_000_000

_COUNTED = "lang string, source string, term string, n long, docs long"


def _grouped(t: pa.Table) -> pa.Table:
    t = t.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(["lang", "source", "term", "n", "docs"])


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in turn, and the row of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), r"[^a-z\x{80}-\x{10FFFF}]+")
    terms, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(terms, "")
    return terms.filter(some), rows.filter(some)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lang, source, text into rows of _COUNTED; a key may come again in a later batch or another task."""
    held: list[pa.Table] = []
    for b in batches:
        for c in chunks(b.column("text"), CHUNK):
            part = b.slice(c.row, c.n)
            terms, rows = _terms(part.column("text"))
            coded = terms.dictionary_encode()
            each = pa.table({"row": rows, "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
            langs, sources = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            pairs = pc.add(pc.multiply(langs.indices.cast(pa.int64()), len(sources.dictionary)), sources.indices.cast(pa.int64()))
            groups = pairs.dictionary_encode()
            of_group = groups.indices.take(each["row"])
            sums = pa.table({"group": of_group, "code": each["code"], "n": each["count_all"]}).group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
            first = pc.index_in(pa.array(np.arange(len(groups.dictionary)), pa.int32()), groups.indices)  # a row of each group
            row = first.take(sums["group"].combine_chunks())
            held.append(pa.table({
                "lang": part.column("lang").take(row), "source": part.column("source").take(row), "term": coded.dictionary.take(sums["code"].combine_chunks()),
                "n": sums["n_sum"].cast(pa.int64()), "docs": sums["count_all"].cast(pa.int64()),
            }))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                one = _grouped(pa.concat_tables(held))
                held = [one]
                if one.num_rows > HELD_ROWS // 2:
                    yield from one.to_batches(max_chunksize=1 << 16)
                    held = []
    if held:
        yield from _grouped(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)


def kept_counts(documents: DataFrame, *, lang: str, source: str, text: str, least_docs: int) -> DataFrame:
    """lang, term, source, n: occurrences of the terms that at least `least_docs` documents of the language have."""
    source_rows = documents.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = source_rows.mapInArrow(partial_counts, _COUNTED)
    merged = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return merged.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("all") >= least_docs).select("lang", "term", "source", "n")


def _share(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), three digits at a time, so that no product leaves 64 bits."""
    below = total + 2 * kept
    rest, out = n.astype(np.int64) + 2, np.zeros(n.shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Shard:
    """The sources of a language, and what its terms of one shard add up to."""

    def __init__(self, lang: str, block: int, first: bool, ranks: int):
        self.lang, self.block, self.first, self.ranks = lang, block, first, ranks
        self.names: list[str] = []
        self.totals: list[int] = []
        self.kept, self.total = 0, 0
        self.at: dict[str, int] = {}

    def source(self, name: str, total: int, kept: int) -> None:
        self.at[name] = len(self.names)
        self.names.append(name)
        self.totals.append(total)
        self.kept, self.total = kept, self.total + total

    def ready(self) -> None:
        self.mine = range(min(len(self.names), self.block * SOURCES), min(len(self.names), (self.block + 1) * SOURCES))
        self.sums = np.zeros((len(self.mine), len(self.names)), np.int64)
        self.best: dict[int, list[tuple[int, bytes]]] = {i: [] for i in self.mine}

    def add(self, terms: list[str], which: np.ndarray, sources: np.ndarray, n: np.ndarray) -> None:
        """Compare some terms: n occurrences of terms[which] in a source each."""
        counts = np.zeros((len(self.names), len(terms)), np.int64)
        counts[sources, which] = n
        p = np.stack([_share(c, t, self.kept) for c, t in zip(counts, self.totals, strict=True)])
        q = _share(counts.sum(0), self.total, self.kept)
        for k, i in enumerate(self.mine):
            self.sums[k] += _distance(p[i], p).sum(1)
            there = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = _distance(p[i][there], q[there])
            if len(value) > self.ranks:  # all that tie with the last one stay
                few = value >= np.partition(value, -self.ranks)[-self.ranks]
                there, value = there[few], value[few]
            found = self.best[i] + [(-v, terms[t].encode()) for v, t in zip(value.tolist(), there.tolist(), strict=True)]
            self.best[i] = sorted(found)[: self.ranks]

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        for k, i in enumerate(self.mine):
            for j, name in enumerate(self.names):
                if j != i and (self.first or self.sums[k, j]):
                    yield self.lang, self.names[i], "pair", name, int(self.sums[k, j])
            for value, term in self.best[i]:
                yield self.lang, self.names[i], "term", term.decode(), -value


def _compare(ranks: int):
    """Streams sorted by lang, shard, block; in each the sources come first (no term), then the counts by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key = None, None
        terms: list[str] = []
        which: list[int] = []
        sources: list[int] = []
        counts: list[int] = []

        def flush() -> None:
            if terms:
                at.add(terms, np.array(which), np.array(sources), np.array(counts, np.int64))
                for held in (terms, which, sources, counts):
                    held.clear()

        def out(shard: _Shard) -> Iterator[pa.RecordBatch]:
            held = []
            for row in shard.rows():
                held.append(row)
                if len(held) == 1 << 16:
                    yield made(held)
                    held = []
            yield made(held)

        def made(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["lang", "source", "part", "item", "value"])

        for b in batches:
            for lang, shard, block, first, term, source, n, kept in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, shard, block) != key:
                    if at is not None:
                        if key_open:
                            at.ready()
                        flush()
                        yield from out(at)
                    key, key_open = (lang, shard, block), True
                    at = _Shard(lang, block, first, ranks)
                if term is None:
                    at.source(source, n, kept)
                    continue
                if key_open:
                    at.ready()
                    key_open = False
                if not terms or terms[-1] != term:
                    if len(terms) * len(at.names) >= CELLS:
                        flush()
                    terms.append(term)
                which.append(len(terms) - 1)
                sources.append(at.at[source])
                counts.append(n)
        if at is not None:
            if key_open:
                at.ready()
            flush()
            yield from out(at)

    return run


def audit(documents: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, ranks: int = 10) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    A term is a run of ASCII letters and other characters than ASCII, A-Z lower-cased; a
    language keeps those that are in at least `least_docs` of its documents.  A group is a
    language and a source that occur; its p of a kept term is 1 + floor(10^9 (n + 2) / (N + 2 V)), n
    its occurrences there, N their sum over the V kept terms, and q is the same for the whole
    language.  The distance is floor((p - q)^2 / (p + q)).  part `pair`: each other source of the
    language, distances summed over all kept terms (0 if there is none).  part `term`: the `ranks`
    kept terms with n > 0, p > q and the largest distance.  rank: from 1, by value
    descending, then item by its UTF-8 bytes.

    Integers only.  Null lang, source and text are empty strings.  Rows that repeat are
    documents of their own; texts may be of any length.  A language with one source has no pairs, an empty table no rows.
    Other columns are left out.  The pairs of a language are the square of its sources, as
    the result is; beyond SOURCES a task compares a block of them with all others.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kept = written(kept_counts(documents, lang=lang, source=source, text=text, least_docs=least_docs), "divergence-shards")
    groups = documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n")).unionByName(groups).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"))
    most = totals.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    shards, blocks = 1 + kept.count() // SHARD_ROWS, F.explode(F.sequence(F.lit(0), F.lit(max(most - 1, 0) // SOURCES))).alias("block")
    none = F.lit(None).cast("string")
    heads = totals.join(terms, "lang", "left").select("lang", "source", "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    heads = heads.select("lang", "shard", blocks, (F.col("shard") == 0).alias("first"), none.alias("term"), "source", "n", "kept")
    rows = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), blocks, F.lit(False).alias("first"), "term", "source", "n", F.lit(0).cast("long").alias("kept"))
    sorted_rows = heads.unionByName(rows).repartition("lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", F.col("term").asc_nulls_first(), "source")
    found = sorted_rows.mapInArrow(_compare(ranks), "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return summed.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
