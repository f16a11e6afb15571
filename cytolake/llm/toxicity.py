"""Toxicity classifier, regularised by counterfactuals.

A logistic model over the words of a text and the beginnings of its words
(insults are inflected).  It is fitted on a bounded sample of labelled rows: at
most `positives` and `negatives` of them, the first by hash.  Words that name a
group of people are swapped for others of their kind in each labelled sentence
that has one; the fit penalises the squared change of the sentence's score, so
that a mention of a group is no sign of toxicity by itself.

Features are chosen by a distributed count over the sample, the fit runs over
the chosen ones, and every text is scored where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._spark import small_batches
from cytolake.llm._text import _HASH_LOWER, _RINV, IS_WORD_ALNUM, Chunk, U, _power, chunks, mix, prefix_hash, signed, words

#: Group names by kind; a term is swapped for the others of its tuple.
IDENTITY = (
    ("woman", "women", "man", "men", "girl", "girls", "boy", "boys", "female", "male", "frau", "frauen", "mann", "männer", "femme", "femmes", "homme", "hommes", "mujer", "mujeres", "hombre", "hombres"),
    ("christian", "christians", "muslim", "muslims", "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists", "christ", "christen", "muslime", "jude", "juden", "jüdisch", "chrétien", "chrétiens", "musulman", "musulmans", "juif", "juifs", "cristiano", "cristianos", "musulmán", "musulmanes", "judío", "judíos"),
    ("gay", "straight", "lesbian", "lesbians", "bisexual", "heterosexual", "homosexual", "transgender", "queer", "schwul", "lesbisch", "lesbienne", "lesbiana"),
    ("black", "white", "asian", "asians", "latino", "latina", "african", "africans", "european", "europeans", "indian", "indians", "arab", "arabs"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "native", "natives", "einwanderer", "flüchtling", "flüchtlinge", "ausländer", "immigré", "immigrés", "réfugié", "réfugiés", "étranger", "étrangers", "inmigrante", "inmigrantes", "refugiado", "refugiados", "extranjero", "extranjeros"),
    ("deaf", "blind", "disabled", "autistic", "taub", "behindert", "sourd", "aveugle", "sordo", "ciego"),
    ("old", "young", "elderly", "alt", "jung", "vieux", "jeune", "viejo", "joven"),
)
PREFIXES = (4, 5, 6, 8)  # bytes
SENTENCE = re.compile(r"[^.!?\n]+")


class Model(NamedTuple):
    feature: np.ndarray  # sorted hashes
    weight: np.ndarray
    bias: float


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning of a chunk."""
    w = words(chunk, IS_WORD_ALNUM)
    rows, out = [w.row], [w.hash]
    with np.errstate(over="ignore"):
        h = prefix_hash(chunk.data, _HASH_LOWER)
        inverse = _power(_RINV, len(chunk.data) + 1)
        for n in PREFIXES:
            long = w.end - w.start > n
            s = w.start[long]
            rows.append(w.row[long])
            out.append(mix((h[s + n] - h[s]) * inverse[s] + U(n << 32)))
    return np.concatenate(rows), np.concatenate(out)


def _swaps(text: str, kinds: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(sentence, sentence with one group name swapped), for each other name of its kind, for the sentences that have one."""
    out = []
    for s in SENTENCE.findall(text.lower()):
        for term in sorted(set(re.findall(r"\w+", s)) & kinds.keys()):
            named = re.compile(rf"\b{re.escape(term)}\b")
            out += [(s, named.sub(x, s)) for x in kinds[term] if x != term]
    return out


def _sample(labels: DataFrame, train, doc_id: str, label: str, positives: int, negatives: int) -> DataFrame:
    rows = labels.filter(train & F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y"))
    one = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    first = lambda y, n: one.filter(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit("sample")), "_id").limit(n)
    return first(1, positives).unionByName(first(0, negatives))


def fit(
    documents: DataFrame, labels: DataFrame, train, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = 4000, negatives: int = 8000, most_features: int = 4000, least: int = 4, l2: float = 1.0, counterfactual: float = 5.0, steps: int = 300
) -> Model:
    """A model of the labelled rows for which the column `train` of doc_id is true.

    Rows without label, id or document are passed over; of several labels for an
    id the highest counts.  Without any labelled row the model scores all 1/2 below
    the threshold; with one class only it learns nothing but that class's bias.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sample = F.broadcast(_sample(labels, train, doc_id, label, positives, negatives))  # at most positives + negatives ids
    own = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("t"))
    texts = own.join(sample, "_id").select("_y", "t")
    kinds = {t: group for group in IDENTITY for t in group}

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1)):
                row, h = features(c)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(y[c.row + row].astype(np.int32))], names=["f", "y"])

    sizes = dict(texts.groupBy("_y").count().collect())
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    none = Model(np.zeros(0, U), np.zeros(0), -1.0 if not n1 else 1.0 if not n0 else 0.0)
    if not n1 or not n0:
        return none
    seen = texts.mapInArrow(emitted, "f long, y int").groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("n"))
    expected = F.col("n") * (n1 / (n1 + n0))
    best = seen.filter(F.col("n") >= least).withColumn("chi", F.pow(F.col("a") - expected, 2) / expected).orderBy(F.desc("chi"), "f").limit(most_features)
    chosen = np.sort(np.array([r["f"] for r in best.select("f").collect()], np.int64).view(U))
    shared = spark.sparkContext.broadcast(chosen)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value

        def found(texts: list[str]) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in texts]
            for c in chunks(pa.array(texts, pa.string())):
                row, h = features(c)
                at, ok = _lookup(h, keep)
                for r, i in zip(row[ok], at[ok], strict=True):
                    out[c.row + r].append(int(i))
            return [sorted(set(x)) for x in out]

        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            pairs = [(i, a, z) for i, t in enumerate(texts) for a, z in _swaps(t, kinds)]
            kind = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(found(texts), pa.list_(pa.int32())), pa.array([None] * len(texts), pa.list_(pa.int32()))], names=["y", "f", "g"])
            if pairs:
                f, g = found([a for _, a, _ in pairs]), found([z for _, _, z in pairs])
                yield pa.RecordBatch.from_arrays([pa.array([kind[i] for i, _, _ in pairs], pa.int32()), pa.array(f, pa.list_(pa.int32())), pa.array(g, pa.list_(pa.int32()))], names=["y", "f", "g"])

    rows = texts.mapInArrow(reduced, "y int, f array<int>, g array<int>").toArrow()  # bounded by the sample
    own = rows.filter(pa.compute.is_null(rows["g"]))
    swapped = rows.filter(pa.compute.is_valid(rows["g"]))
    return _descend(chosen, own["y"].to_numpy().astype(float), own["f"].to_pylist(), list(zip(swapped["f"].to_pylist(), swapped["g"].to_pylist(), strict=True)), l2, counterfactual, steps)


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([i for x in rows for i in x], np.int64)


def _descend(chosen: np.ndarray, y: np.ndarray, own: list[list[int]], swaps: list[tuple[list[int], list[int]]], l2: float, counterfactual: float, steps: int) -> Model:
    """Full-batch Adam on the logistic loss, the ridge, and the squared score changes of the swaps."""
    at, feature = _csr(own)
    sa, sf = _csr([a for a, _ in swaps])
    za, zf = _csr([z for _, z in swaps])
    m = len(chosen)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(m), 0.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[feature], len(y)) + b
        residual = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.bincount(feature, residual[at], m) + l2 * w / len(y)
        if swaps:
            change = (np.bincount(za, w[zf], len(swaps)) - np.bincount(sa, w[sf], len(swaps))) * (2 * counterfactual / len(swaps))
            g += np.bincount(zf, change[za], m) - np.bincount(sf, change[sa], m)
        g = np.append(g, residual.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:m], b - step[m]
    return Model(chosen, w, float(b))


def _lookup(h: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(among, h)
    at[at == len(among)] = 0
    return at, among[at] == h if len(among) else np.zeros(len(h), bool)


def score(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row; a null or empty text has the score of the bias alone.

    Rows that repeat get the same score; other columns are left out.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(m.feature & U((1 << 20) - 1)).astype(np.int64)] = True
        for b in batches:
            z = np.full(b.num_rows, m.bias)
            for c in chunks(b.column(1)):
                row, h = features(c)
                near = maybe[(h & U((1 << 20) - 1)).astype(np.int64)]
                row, h = row[near], h[near]
                at, ok = _lookup(h, m.feature)
                pair = np.unique(row[ok] * (len(m.feature) + 1) + at[ok])  # each feature counts once a text
                z[c.row : c.row + c.n] += np.bincount(pair // (len(m.feature) + 1), m.weight[pair % (len(m.feature) + 1)] if len(pair) else None, c.n)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
