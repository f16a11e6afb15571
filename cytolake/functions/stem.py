"""English words as index terms: stop words, and Porter's stemmer (1980) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual English stop words of full-text search.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# The suffixes of the published algorithm's steps 2, 3 and 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# A y that is a consonant is written Y, so that a class of letters tells vowels.
V, C = "[aeiouy]", "[^aeiouy]"
SOME = f"^{C}*{V}+{C}"  # m > 0
MORE = f"^{C}*{V}+{C}+{V}+{C}"  # m > 1
ONE = f"^{C}*{V}+{C}+{V}*$"  # m = 1
SHORT = f"{C}{V}[^aeiouywxY]$"  # *o


def _longest(word: Column, rules: list[tuple[str, str]], condition: str) -> Column:
    """The word with its longest suffix of `rules` replaced, where what stands before the suffix meets the condition."""
    out = word
    for suffix, new in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        stem = F.left(word, F.length(word) - len(suffix))
        fits = stem.rlike(condition)
        if suffix == "ion":
            fits = fits & stem.rlike("[st]$")
        out = F.when(F.endswith(word, F.lit(suffix)), F.when(fits, F.concat(stem, F.lit(new))).otherwise(word)).otherwise(out)
    return out


def _plurals(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("sses")) | F.endswith(w, F.lit("ies")), _cut(w, 2)).when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), _cut(w, 1)).otherwise(w)


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _mended(c: Column) -> Column:
    """What is left of a word without ed or ing."""
    double = c.rlike(r"([^aeiouy])\1$") & ~c.rlike("[lsz]$")
    return F.when(c.rlike("(at|bl|iz)$") | (c.rlike(ONE) & c.rlike(SHORT)), F.concat(c, F.lit("e"))).when(double, _cut(c, 1)).otherwise(c)


def _participles(w: Column) -> Column:
    ed = F.endswith(w, F.lit("ed")) & _cut(w, 2).rlike(V)
    ing = F.endswith(w, F.lit("ing")) & _cut(w, 3).rlike(V)
    return F.when(F.endswith(w, F.lit("eed")), F.when(_cut(w, 3).rlike(SOME), _cut(w, 1)).otherwise(w)).when(ed, _bind(_cut(w, 2), _mended)).when(ing, _bind(_cut(w, 3), _mended)).otherwise(w)


def _bind(value: Column, f) -> Column:
    """f(value), the value computed once and the expression no longer than f's."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


STEPS = [
    lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "(?<=[aeiou])y", "Y"), "(?<=[^aeiouyY])yy", "yY"),
    _plurals,
    _participles,
    lambda w: F.when(w.rlike("[yY]$") & _cut(w, 1).rlike(V), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
    lambda w: _longest(w, STEP2, SOME),
    lambda w: _longest(w, STEP3, SOME),
    lambda w: _longest(w, [(s, "") for s in STEP4], MORE),
    lambda w: F.when(F.endswith(w, F.lit("e")) & (_cut(w, 1).rlike(MORE) | (_cut(w, 1).rlike(ONE) & ~_cut(w, 1).rlike(SHORT))), _cut(w, 1)).otherwise(w),
    lambda w: F.when(F.endswith(w, F.lit("ll")) & _cut(w, 1).rlike(MORE), _cut(w, 1)).otherwise(w),
    F.lower,
]


def stem(word: Column) -> Column:
    """The stem of a word in small letters.  Words of one or two letters, and those with other characters than a-z, stay; null stays null.

    After a consonant a run of three y or more counts its third as a vowel; English has none.
    """
    out = word
    for step in STEPS:
        out = _bind(out, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), out).otherwise(word)
