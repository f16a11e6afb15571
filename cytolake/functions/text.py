"""Small text rules: numbers, names, citations, colours."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def p_value(p: Column) -> Column:
    """Three decimals, or exponential below 0.001."""
    return F.when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.3f", p))


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "_")


def capped(text: Column, most: int = 1300) -> Column:
    return F.left(text, F.lit(most))


def pretty_label(name: Column) -> Column:
    """What a column is called on screen: `x_celltypeAnno` and `cluster_<method>_r<resolution>` in words, others as they are."""
    own = F.regexp_extract(name, "^cluster_(leiden|louvain)_r([0-9._]+)$", 1)
    resolution = F.replace(F.regexp_extract(name, "^cluster_(leiden|louvain)_r([0-9._]+)$", 2), F.lit("_"), F.lit("."))
    kinds = F.regexp_extract(name, "^(.*)_celltypeAnno$", 1)
    return F.when(own != "", F.concat(F.initcap(own), F.lit(" (res "), resolution, F.lit(")"))).when(F.endswith(name, F.lit("_celltypeAnno")), F.concat(kinds, F.lit(" · cell types"))).otherwise(F.coalesce(name, F.lit("")))


def overlap(text: Column) -> Column:
    """`k/n` as overlap and set_size; null where it isn't."""
    part = lambda i: F.get(F.split(text, "/"), F.lit(i)).try_cast("long")
    return F.struct(part(0).alias("overlap"), part(1).alias("set_size"))


def genes_of(text: Column) -> Column:
    """The names of a list with semicolons."""
    return F.filter(F.transform(F.split(text, ";"), lambda g: F.trim(g)), lambda g: g != "")


# A published polynomial of the viridis map, lowest power first, for red, green and blue.
VIRIDIS = {
    "r": (0.267004, 0.003263, -2.2956, 14.4694, -25.5699, 14.7853),
    "g": (0.004874, 0.8383, 1.6024, -9.1894, 14.4694, -6.7275),
    "b": (0.329415, 1.5023, -5.4402, 9.3068, -7.9672, 2.3286),
}


def viridis(share: Column) -> Column:
    """r, g, b (0 to 255) of a share, held within 0 and 1; null is 0."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share.cast("double"), F.lit(0.0))))

    def channel(powers: tuple[float, ...]) -> Column:
        value = F.lit(powers[-1])
        for p in reversed(powers[:-1]):
            value = p + s * value
        return F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).cast("int")

    return F.struct(*(channel(p).alias(k) for k, p in VIRIDIS.items()))


def vector_text(v: Column) -> Column:
    """[1.0,2.5]"""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("double").cast("string")), ","), F.lit("]"))


def citation(kind: Column, pmid: Column, document: Column, section: Column) -> Column:
    """lit:PMID:… for literature, doc:…#section for documents."""
    return F.when(kind == "literature", F.concat(F.lit("lit:PMID:"), pmid)).otherwise(F.concat(F.lit("doc:"), document, F.coalesce(F.concat(F.lit("#"), section), F.lit(""))))


def parsed_citation(tag: Column) -> Column:
    parts = F.split(tag, ":")
    return F.struct(parts[0].alias("kind"), F.nullif(F.regexp_extract(tag, "PMID:(\\d+)", 1), F.lit("")).alias("pmid"))


def listed(names: list[str]) -> str:
    """a, b and c"""
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}" if names else ""


def labels_from_reply(reply: str, clusters: list[str]) -> dict[str, str]:
    """`cluster: label` lines of a model's reply; clusters without a line take the lines left in order, or Unknown."""
    found, rest = {}, []
    for line in reply.splitlines():
        m = re.match(r"^\s*[-*]?\s*(?:cluster\s+)?(.+?)\s*:\s*(.+?)\s*$", line, re.I)
        if m and m[1] in clusters:
            found[m[1]] = m[2]
        elif line.strip():
            rest.append(line.strip("-* \t"))
    left = iter(rest)
    return {c: found.get(c) or next(left, "Unknown") for c in clusters}
