"""Quality rules, and divergence from language references.

Each text is counted once: characters by class (small letters, capitals,
digits, white space, symbols, other ASCII, the rest) and, by its language, how
often each of some common words occurs, and how many other words there are.  The references are the sums of these
counts over all texts of the language that pass the rules and are long enough,
so they cover the whole corpus.  A text is rejected when the Jensen-Shannon
distance (base 2, its root, 0 to 1) of its character histogram or of its
common-word histogram from the reference is above a limit.  Short texts stray by chance, so
each histogram is judged from a minimum of characters or words on.

Column expressions only.  The texts are read once and never shuffled; the
counts are written to the shared folder, and the references, one row a language of `COMMON`, are
joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.llm._spark import WS_CHARS, WS_CLASS, bind, text_of, written

# Frequent function words of each language.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "werden"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "or", "from", "at", "not", "have", "but"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es", "lo", "como", "más", "o"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "il"),
}
WORDS = 25  # bins of a language's words: the common ones, and all others
CLASSES = ("small", "capital", "digit", "space", "symbol", "ascii", "other")
WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Limits of the distances, and from how many characters or words on they are judged.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.30, 50


def _left(t: Column, pattern: str) -> Column:
    """Characters left when what matches goes."""
    return F.length(F.regexp_replace(t, pattern, "")).cast("long")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more in the array (a lambda variable).

    Windows are compared by 64-bit hash.  An array of distinct windows is done
    there; else the windows are sorted with their positions, and those equal to
    a neighbour cover min(k, gap to the next) words each.
    """
    n = F.size(words)
    shifted = F.arrays_zip(*(F.slice(words, F.lit(j + 1), n - k + 1).alias(str(j)) for j in range(k)))
    hashes = F.when(n >= k, F.transform(shifted, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    paired = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, i, x: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

    def covered(s: Column) -> Column:
        hits = F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, i, x)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(hits, start, lambda a, i: F.struct((i + k).alias("end"), (a["sum"] + i + k - F.greatest(a["end"], i)).alias("sum")), lambda a: a["sum"])

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(paired(h), covered))).cast("long")


def _common_words(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, and of all others: the words that are any are set apart by two spaces, then each is removed."""

    def of(common: tuple[str, ...]) -> Column:
        found = F.filter(words, lambda w: F.lower(w).isin(*common))
        times = lambda s, w: F.floor((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2))
        each = lambda s: F.array(*(times(s, w) for w in common), (F.size(words) - F.size(found)).cast("long"))
        return bind(F.lower(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))), each)

    out = F.lit(None).cast("array<long>")
    for name, common in COMMON.items():
        out = F.when(lang == name, of(common)).otherwise(out)
    return out


def counts(documents: DataFrame, *, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns, and the counts of each text: the rules' and the two histograms (language null: none of COMMON)."""
    carry = documents.columns if carry is None else carry
    known = F.when(F.col(f"`{lang}`").isin(*COMMON), F.col(f"`{lang}`"))

    def of(t: Column, words: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(WS_CHARS)) != "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.length(t).cast("long").alias("n"), _left(t, f"[^{SYMBOLS}]+").alias("n_symbols"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
            *(_left(t, f"[^{inside}]+").alias(name) for name, inside in (("small", "a-z"), ("capital", "A-Z"), ("digit", "0-9"))), _left(t, "[^\\x00-\\x7F]+").alias("all_ascii"), _common_words(words, known).alias("common"),
        )

    def split(t: Column) -> Column:
        return bind(F.trim(t, F.lit(WS_CHARS)), lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, f"[{WS_CLASS}]+")))

    out = documents.select(*[F.col(f"`{c}`") for c in carry], known.alias("_lang"), bind(text_of(text), lambda t: bind(split(t), lambda w: of(t, w))).alias("_m"))
    m = lambda x: F.col(f"_m.{x}")
    space = m("n") - m("word_chars")
    ascii_ = m("all_ascii") - m("small") - m("capital") - m("digit") - space - m("n_symbols")
    return out.select(
        *[F.col(f"`{c}`") for c in carry], m("n_words"), m("word_chars"), m("n_symbols"), m("n_dup_lines"), m("n_repeat_words"), "_lang",
        F.array(m("small"), m("capital"), m("digit"), space, m("n_symbols"), ascii_, m("n") - m("all_ascii")).alias("_chars"), m("common").alias("_common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def references(counted: DataFrame) -> DataFrame:
    """Summed histograms by language, over the texts that pass the rules and the length guards."""
    good = counted.filter(F.col("_lang").isNotNull() & ~base_failed() & (F.col("n_words") >= MIN_WORDS))
    sums = lambda c, n: F.array(*(F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)))
    return good.groupBy("_lang").agg(sums("_chars", len(CLASSES)).alias("_ref_chars"), sums("_common", WORDS).alias("_ref_common"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(a: Column, b: Column) -> Column:
    """Root of the Jensen-Shannon divergence (base 2) of two count arrays; null if either is empty."""
    na, nb = _total(a), _total(b)
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x / na).alias("p"), (y / nb).alias("q")))
    side = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    sums = F.aggregate(pairs, F.lit(0.0), lambda s, z: s + (side(z["p"], (z["p"] + z["q"]) / 2.0) + side(z["q"], (z["p"] + z["q"]) / 2.0)) / 2.0)
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(sums, F.lit(0.0))))


def judge(documents: DataFrame, *, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (all, if none are named) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the two distances.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated
    5-word windows.  kept: not base_failed, and neither distance judged above
    its limit.  A text without a known language, or of a language without
    reference, is judged by its rules alone; one without any common word is as far from its
    language as its other words make it.  Null text: no words.  Columns of the input with the names of the results are replaced.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"}
    carry = [c for c in (documents.columns if carry is None else carry) if c not in made]
    counted = written(counts(documents, text=text, lang=lang, carry=carry), "quality-counts")
    joined = counted.join(F.broadcast(references(counted)), "_lang", "left")  # a row for each language of COMMON at most
    judged = joined.withColumns({"char_distance": js_distance(F.col("_chars"), F.col("_ref_chars")), "word_distance": js_distance(F.col("_common"), F.col("_ref_common")), "_n": _total(F.col("_chars")), "base_failed": base_failed()})
    strange = ((F.col("_n") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    kept = ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))
    return judged.select(*[F.col(f"`{c}`") for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")
