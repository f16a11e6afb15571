"""Benchmark decontamination by a prefix-filtered set join.

Every item of a benchmark is cut into windows of `window` consecutive words
(an item of fewer words is one window).  A window is the set of its `shingle`
word shingles.  Containment in a document must be whole, so one necessary
prefix token per window is enough: its rarest shingle, by counts over the whole
corpus.

1. A pass over the documents counts the shingles that benchmark windows have.  A bit table of fixed
   size tells tasks which may be any; the counts meet the benchmark's shingles in a join.
2. Windows are a table, with the rarest shingle as prefix token and its place in the window, by which
   every window that has the token is told apart.  A pass over the documents emits, where a
   token occurs (again by a bit table), the windows that may lie around it: their bounds follow from the token's place
   (positional bound) and from the window's length (length bound).  They are joined with the table on
   token, place and the words of the whole window, by two 64-bit hashes.
3. Spans are merged for each document.  Only documents with a hit meet them in a join.

The benchmark may be of any size: it is read twice by Spark, and nothing of it but
bit tables of fixed size goes to the driver or to all tasks.  Documents are read three times, whatever its size,
and never shuffled.  Frequent tokens are spread, as the join is on the window too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolake.llm._spark import small_batches, written
from cytolake.llm._text import IS_WORD_ALNUM, U, Words, chunks, mix, signed, windows, words
from cytolake.llm.suffix import bit_table, in_table

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the first word of all windows of `size` words in one row."""
    h, first = windows(w, size)
    with np.errstate(over="ignore"):
        other = windows(w._replace(hash=mix(w.hash + U(0x632BE59BD9B4E019))), size)[0]
    return h, other, first


def _named(h: np.ndarray, size: int) -> np.ndarray:
    """Shingles of different sizes have different names."""
    with np.errstate(over="ignore"):
        return mix(h + U(size))


def _benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """item, size, w1, w2 (the window's hashes), token, place: every shingle of every window of an item, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                w = words(c, IS_WORD_ALNUM)
                n = np.bincount(w.row, minlength=c.n)
                for size in np.unique(np.minimum(n[n > 0], window)).tolist():
                    own = (np.minimum(n, window) == size)[w.row]
                    part = Words(w.hash[own], w.row[own], w.start[own], w.end[own])
                    w1, w2, first = _windows(part, size)
                    q = min(size, shingle)
                    token, at = windows(part, q)
                    index = np.full(len(part.hash) + 1, -1)
                    index[at] = np.arange(len(at))
                    for place in range(size - q + 1):
                        t = _named(token[index[first + place]], q)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(c.row + part.row[first])), pa.array(np.full(len(first), size, np.int32)), pa.array(signed(w1)), pa.array(signed(w2)), pa.array(signed(t)), pa.array(np.full(len(first), place, np.int32))], names=["item", "size", "w1", "w2", "token", "place"]
                        )

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("None")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "item string, size int, w1 long, w2 long, token long, place int")


def _counts(texts: DataFrame, sizes: list[int], shared) -> DataFrame:
    """token and n: how often shingles occur in the corpus that the bit table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(0)):
                w = words(c, IS_WORD_ALNUM)
                found = [_named(windows(w, q)[0], q) for q in sizes]
                token = np.concatenate(found) if found else np.zeros(0, U)
                u, n = np.unique(token[in_table(token, shared.value)], return_counts=True)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], names=["token", "n"])

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _met(named: DataFrame, kinds: list[tuple[int, int]], shared) -> DataFrame:
    """d1, d2, token, place, size, w1, w2, start: the windows around every prefix token in a document, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "token", "place", "size", "w1", "w2", "start"]
        for b in batches:
            d1, d2 = b.column(0), b.column(1)
            for c in chunks(b.column(2)):
                w = words(c, IS_WORD_ALNUM)
                cuts = np.searchsorted(w.row, np.arange(c.n + 1))
                hits = {}
                for q in {q for _, q in kinds}:
                    token, at = windows(w, q)
                    token = _named(token, q)
                    own = in_table(token, shared.value)
                    hits[q] = token[own], at[own]
                for size, q in kinds:
                    token, at = hits[q]
                    if not len(token):
                        continue
                    w1, w2, first = _windows(w, size)
                    index = np.full(len(w.hash) + 1, -1)
                    index[first] = np.arange(len(first))
                    for place in range(size - q + 1):
                        start = at - place
                        i = np.where(start >= 0, index[np.maximum(start, 0)], -1)
                        ok = (i >= 0) & (w.row[np.maximum(start, 0)] == w.row[at])  # the window lies in the token's document
                        if ok.any():
                            row = w.row[at[ok]]
                            which = pa.array(c.row + row)
                            size_ = np.full(len(row), size, np.int32)
                            yield pa.RecordBatch.from_arrays([d1.take(which), d2.take(which), pa.array(signed(token[ok])), pa.array(np.full(len(row), place, np.int32)), pa.array(size_), pa.array(signed(w1[i[ok]])), pa.array(signed(w2[i[ok]])), pa.array(start[ok] - cuts[row])], names=names)

    return named.mapInArrow(run, "d1 long, d2 int, token long, place int, size int, w1 long, w2 long, start long")


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 4) -> DataFrame:
    """All rows and columns of `documents`, with n_words, hit_spans and items.

    hit_spans: disjoint [first word, past last word] of what benchmark windows
    cover, ascending; items: ids (as strings, sorted) of the items any of whose
    windows occur.  Words are `[0-9a-z]` and non-ASCII runs after lower-casing
    A-Z.  A null or empty text has no words and no hits; null item texts and
    items without words have no windows; a null item id is the string "None".
    Items that repeat count once per id.  An empty benchmark gives no hits.
    Texts may be of any length.  Input columns named like the three results are replaced by them.
    """
    spark = documents.sparkSession
    small_batches(spark)
    keep = [f for f in documents.schema.fields if f.name not in HITS.names]
    if text not in [f.name for f in keep]:
        raise ValueError(f"no text column {text!r} besides the result columns")
    own = documents.select(F.struct(*[F.col(f"`{f.name}`") for f in keep]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    named = own.select(F.xxhash64("t").alias("d1"), F.hash("t").alias("d2"), "t", "row")
    table = written(_benchmark_windows(benchmark, item_id, item_text, window, shingle), "benchmark-windows")
    kinds = sorted({(r["size"], min(r["size"], shingle)) for r in table.select("size").distinct().collect()})  # at most `window` rows
    tokens = spark.sparkContext.broadcast(bit_table(table.select("token").distinct(), "token"))
    counts = written(_counts(named.select("t"), sorted({q for _, q in kinds}), tokens), "shingle-counts")
    tokens.destroy()
    counted = table.select("size", "w1", "w2", "token", "place").distinct().join(counts, "token")  # a shingle that never occurs can't be in a document
    rarest = counted.groupBy("size", "w1", "w2").agg(F.min(F.struct("n", "token", "place")).alias("m"), F.count("*").alias("found"))
    whole = rarest.filter(F.col("found") == F.col("size") - F.least(F.col("size"), F.lit(shingle)) + 1)  # all of a window's shingles must occur
    prefixes = written(whole.select("size", "w1", "w2", F.col("m.token").alias("token"), F.col("m.place").alias("place")), "prefixes")
    marks = spark.sparkContext.broadcast(bit_table(prefixes.select("token").distinct(), "token"))
    # equal texts have equal hits, so that texts are their own names
    met = _met(named.select("d1", "d2", "t"), kinds, marks).join(prefixes, ["token", "place", "size", "w1", "w2"]).select("d1", "d2", "size", "w1", "w2", "start").distinct()
    met = written(met, "benchmark-hits")
    marks.destroy()
    owners = met.select("d1", "d2", "size", "w1", "w2").distinct().join(table.select("size", "w1", "w2", "item").distinct(), ["size", "w1", "w2"])
    items = owners.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = met.groupBy("d1", "d2").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"))
    hits = written(spans.join(items, ["d1", "d2"]), "hits")
    losing = spark.sparkContext.broadcast(bit_table(hits.select("d1"), "d1"))

    def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for c in chunks(b.column(2)):
                n[c.row : c.row + c.n] = np.bincount(words(c, IS_WORD_ALNUM).row, minlength=c.n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n), pa.array(in_table(b.column(0).to_numpy(), losing.value))], names=["d1", "d2", "row", "n_words", "hit"])

    seen = named.mapInArrow(counted_words, T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.IntegerType()), named.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("hit", T.BooleanType())]))
    step = lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.element_at(a, -1)[1]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array(F.element_at(a, -1)[0], F.greatest(F.element_at(a, -1)[1], s["stop"]))))).otherwise(F.concat(a, F.array(F.array(s["start"], s["stop"]))))
    merged = F.aggregate("spans", F.array().cast(HITS["hit_spans"].dataType), step)
    with_hits = seen.filter("hit").join(hits, ["d1", "d2"], "left").select("row.*", "n_words", F.coalesce(merged, F.array().cast(HITS["hit_spans"].dataType)).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    without = seen.filter("not hit").select("row.*", "n_words", F.array().cast(HITS["hit_spans"].dataType).alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    return without.unionByName(with_hits)


def contamination(hits: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the rows of `benchmark_hits`.

    contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    out = hits.withColumn("n_hit", n_hit)
    return out.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")),
        }
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `documents` that aren't contaminated, with their own columns unchanged."""
    kept = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(options.get("text", "text")).alias("text"))
    return contamination(benchmark_hits(kept, benchmark, **{**options, "text": "text"})).filter(~F.col("contaminated")).select("row.*")
