"""The source divergence audit against exact integers in plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from cytolake.llm import divergence

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(rows, least_docs, ranks):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        p = {}
        for s in sources:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n + 2) // (sum(whole.values()) + 2 * len(kept)) for t, n in whole.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < ranks]
    return Counter(out)


def collected(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return Counter(map(tuple, frame.collect()))


@pytest.mark.parametrize(("least", "ranks"), [(1, 10), (3, 2), (10, 10), (10_000, 10)])
def test_matches_plain_integers(hard, least, ranks):
    rows = [(r["lang"], r["source"], r["text"]) for r in hard.collect()]
    assert collected(divergence.audit(hard, least_docs=least, ranks=ranks)) == plain(rows, least, ranks)


def test_in_small_pieces(hard, monkeypatch):
    """Partial counts sent on at once, few cells, and sources dealt in blocks of three."""
    for name, value in (("HELD_ROWS", 50), ("CELLS", 40), ("SHARD_ROWS", 100), ("SOURCES", 3), ("CHUNK", 2000)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(r["lang"], r["source"], r["text"]) for r in hard.collect()]
    assert collected(divergence.audit(hard, least_docs=2)) == plain(rows, 2, 10)


def test_ties_clashing_names_and_odd_characters(spark):
    rows = [(lang, s, t) for lang in ("en", None, "a\0b") for s, t in (("x", "Äb zz É é yy"), ("x", "zz yy"), ("x", "zz yy"), ("y\0z", "ww"), ("y", None), (None, "ÀÀ 𝔘x"))]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, value int, term string")
    for least in (1, 2):
        assert collected(divergence.audit(frame, least_docs=least, ranks=2)) == plain(rows, least, 2)


def test_very_long_text_and_one_source(spark):
    rows = [("en", "only", "word other " * 200_000), ("en", "only", "x" * 1_000_000), ("de", "a", ""), ("de", "b", "ein Wort")]
    assert collected(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=1)) == plain(rows, 1, 10)


def test_empty_table(empty):
    assert divergence.audit(empty).count() == 0


def test_shares_of_large_counts_are_exact():
    import numpy as np

    n = np.array([0, 1, 10**12, 7 * 10**14 + 3])
    assert divergence._share(n, 9 * 10**14, 10**7).tolist() == [1 + 10**9 * (int(x) + 2) // (9 * 10**14 + 2 * 10**7) for x in n]
