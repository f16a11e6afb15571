"""Text retrieval: cleaning, chunks, hybrid search, reranking, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_text(html: Column) -> Column:
    """A page's text: scripts, styles and page parts go with what they hold, other tags become spaces, white space collapses."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), "[ \\t\\n\\r\\f]+", " "))


def sentences(text: Column) -> Column:
    """Sentences end in . ! or ? before white space and a capital or digit; white space collapses."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " ")), "(?<=[.!?]) (?=[A-Z0-9])"), lambda s: s != "")


def packed(parts: Column, most: int = 900, overlap: int = 150) -> Column:
    """Chunks of whole sentences of at most `most` characters; each begins with the last `overlap` characters of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(a: Column, s: Column) -> Column:
        fits = (a["cur"] == "") | (F.length(a["cur"]) + F.length(s) + 1 <= most)
        joined = F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s))
        tail = F.when(F.length(a["cur"]) > overlap, F.substring(a["cur"], -overlap, overlap)).otherwise(a["cur"])
        return F.when(fits, F.struct(a["out"].alias("out"), joined.alias("cur"))).otherwise(F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), F.concat(tail, F.lit(" "), s).alias("cur")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def sections(text: Column, most: int = 1100, overlap: int = 150) -> Column:
    """Chunks of at most `most` characters (and the overlap's share) along blank lines, headers and lines.

    Blocks are cut at blank lines and at headers; a block that is too long is cut into lines, and a line
    that is too long into windows that overlap. Pieces are put together while they fit; a chunk begins with
    the last `overlap` characters of the one before.
    """
    blocks = F.split(text, "\\n\\s*\\n|\\n#{1,6}\\s")
    lines = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > most, F.split(b, "\\n")).otherwise(F.array(b))))
    clean = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    step = most - overlap
    windows = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.length(x) - most) / step), F.lit(0)).cast("int")), lambda i: F.substring(x, i * step + 1, F.lit(most)))
    pieces = F.flatten(F.transform(clean, windows))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(a: Column, p: Column) -> Column:
        full = (a["cur"] != "") & (F.length(a["cur"]) + F.length(p) + 1 > most)
        tail = F.when(F.length(a["cur"]) > overlap, F.substring(a["cur"], -overlap, overlap)).otherwise(a["cur"])
        joined = F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit(" "), p))
        return F.when(full, F.struct(F.concat(a["out"], F.array(F.trim(a["cur"]))).alias("out"), F.concat(tail, F.lit(" "), p).alias("cur"))).otherwise(F.struct(a["out"].alias("out"), joined.alias("cur")))

    return F.aggregate(pieces, start, add, lambda a: F.when(F.trim(a["cur"]) == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.trim(a["cur"])))))


def articles(xml: DataFrame) -> DataFrame:
    """pmid, title, abstract, authors, year, journal of article records (column xml: one record a row); without an abstract they are left out, of a repeated pmid the first by `ordinal` counts.

    authors: "first et al." of several.
    """
    tag = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("xml", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), "<[^>]+>", "")), F.lit(""))
    names = F.regexp_extract_all("xml", F.lit(r"<LastName>([^<]+)</LastName>"), F.lit(1))
    parts = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, "<[^>]+>", "")))
    authors = F.when(F.size(names) > 1, F.concat(F.get(names, F.lit(0)), F.lit(" et al."))).otherwise(F.get(names, F.lit(0)))
    out = xml.select("ordinal", tag("PMID").alias("pmid"), tag("ArticleTitle").alias("title"), F.nullif(F.array_join(parts, " "), F.lit("")).alias("abstract"), authors.alias("authors"), F.nullif(F.regexp_extract("xml", r"(?s)<PubDate>.*?<Year>(\d{4})", 1), F.lit("")).try_cast("int").alias("year"), tag("Title").alias("journal"))
    first = Window.partitionBy("pmid").orderBy("ordinal")
    return out.filter("abstract is not null").withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i", "ordinal")


def context(hits: DataFrame, most: int = 6) -> DataFrame:
    """rank, ref, line of the first `most` hits (kind, pmid, document, section, content, score): a tag to cite and a snippet."""
    from cytolake.functions.text import citation

    best = hits.orderBy(F.desc("score"), "content").limit(most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "content")))  # `most` rows
    ref = citation(F.col("kind"), F.col("pmid"), F.col("document"), F.col("section"))
    return ranked.select("rank", ref.alias("ref"), F.concat(F.lit("["), ref, F.lit("] "), snippet(F.col("content"))).alias("line"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """All rows by key, those of `new` in the place of old ones; of several new ones for a key the last by `order`."""
    last = new.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_i = 1").drop("_i")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def term_rank(text: Column, terms: list[str]) -> Column:
    """Sum over the query's terms of tf / (tf + 1); words are runs of ASCII letters and digits, in small letters."""
    words = F.split(F.lower(text), "[^a-z0-9]+")

    def part(t: str) -> Column:
        tf = F.size(F.filter(words, lambda w: w == t)).cast("double")
        return tf / (tf + 1.0)

    return sum((part(t) for t in dict.fromkeys(terms)), F.lit(0.0))


def hybrid_search(chunks: DataFrame, terms: list[str], vector: list[float], k: int, *, keep: Column | None = None, weight: float = 0.7) -> DataFrame:
    """The k best chunks by weight * cosine + (1 - weight) * term rank over the largest term rank; chunks without a vector don't compete."""
    pool = chunks.filter(F.col("embedding").isNotNull() & (F.lit(True) if keep is None else keep))
    scored = pool.withColumns({"vsim": cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector))), "trank": term_rank(F.col("text"), terms)})
    top = scored.agg(F.max("trank").alias("_m"))
    out = scored.join(F.broadcast(top)).withColumn("score", weight * F.col("vsim") + (1 - weight) * F.coalesce(F.try_divide("trank", "_m"), F.lit(0.0)))  # top is one row
    return out.drop("_m").orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def reranked(found: DataFrame, score: Column | None, k: int) -> DataFrame:
    """The k best by another score, or in the order they had where there is none."""
    return found.orderBy(F.desc(F.round("score" if score is None else score, 9)), "doc_id").limit(k)


# Words that send a question to a source.
ROUTES = {
    "literature": (
        "marker", "express", "expression of", "pathway", "disease", "lupus", "cancer", "tumor", "immune", "what is known", "literature", "study", "studies", "paper", "associated with", "role of", "function of", "known to", "implicated",
        "biology", "mechanism", "signature", "interferon", "cytokine", "receptor",
    ),
    "docs": (
        "how do i", "how to", "why ", "should i", "what does", "parameter", "resolution", "normalize", "normalisation", "normalization", "log transform", "scale", "scaling", "pca", "umap", "t-sne", "tsne", "neighbors", "n_neighbors",
        "batch correction", "harmony", "integrate", "integration", "qc", "quality control", "filter", "threshold", "doublet", "highly variable", "hvg", "workflow", "pipeline", "step", "recommend", "cluster the", "clustering", "interpret",
        "read this", "dot plot", "violin", "heatmap",
    ),
    "data": (
        "my data", "this dataset", "this cluster", "my cluster", "what cell types", "how many cells", "what did i run", "what was run", "my results", "my markers", "my umap", "this gene", "these cells", "current dataset", "annotation",
        "what's in my", "whats in my",
    ),
}


def routed(text: Column, routes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The sources whose words a question holds, or data if none."""
    q = F.lower(text)
    routes = ROUTES if routes is None else routes
    hits = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)), F.lit(name)) for name, words in sorted(routes.items()))))
    return F.when(F.size(hits) == 0, F.array(F.lit("data"))).otherwise(hits)


def snippet(text: Column, most: int = 500) -> Column:
    clean = F.trim(F.regexp_replace(text, "\\n", " "))
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most)), F.lit("…"))).otherwise(clean)
