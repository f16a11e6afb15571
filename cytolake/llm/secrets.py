"""Secret scan: fixed shapes, and a randomness battery for what has no shape.

Three shapes are found wherever they occur: assignments to a password-like
name, access keys, and long hexadecimal runs.  Besides, every run of 20 or more
key characters that has letters and digits is taken as a string in the
narrowest encoding that holds it (hex, base32, base36, base62, base64) and put
to three tests of the hypothesis that its symbols are random: a chi-squared
test of uniformity over the alphabet, a runs test about the alphabet's middle
and a lag-one serial correlation.  Fisher's method makes one p-value of them:
even on (0, 1) for a random string, near 0 for a structured one.

How well the tests tell them apart depends on length, so acceptance is per
encoding and length class.  Over all documents, the p-values above 1/2 tell how
many random strings a class has; what a threshold accepts beyond the random
strings' share counts as false, and a class uses the lowest threshold whose
false share is at most `q` (none, if there is no such threshold).  Spans that
overlap a fixed shape are left to it.

Column expressions only.  The text is read once; what is kept per row (spans
and candidates) is written to the shared folder, and the thresholds, at most one for each
encoding and length class, are joined back as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.llm._spark import bind, text_of, written

# The shapes, as the contract of the scan words them.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # 20 characters and more
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: name, what a token must match, its alphabet; the first that matches is inferred.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128)
GRID = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
SPAN = "array<struct<start:int,kind:int,stop:int,token:string>>"


def _pieces(array: Column) -> Column:
    """An array cut into about as many pieces as each has entries: what grows by an entry at a time is short then."""
    size = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(array) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(array, i * size + 1, size))


def _before(values: Column, zero: Column, both) -> Column:
    """For each value, `both` (associative) over all values before it, from `zero` on."""

    def grown(v: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(v, first, lambda a, x: F.struct(both(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def joined(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda p: F.aggregate(p, zero, both))
        return bind(grown(totals, zero), lambda starts: F.flatten(F.zip_with(pieces, starts, grown)))

    return bind(_pieces(values), joined)


def _found(t: Column, pattern: str, kind: int, group: int = 0, least: int = 0, first: str = "") -> Column:
    """Spans of the leftmost non-overlapping matches whose `group` has `least` characters.

    A match comes with the gap before it: \\G ties each search to the end of
    the match before, so texts are read once however few matches they have.
    first: what any match begins with, to pass over other places quickly.
    """
    gap = F.regexp_extract_all(t, F.lit(f"(?s)\\G(.*?)(?:{pattern})"), F.lit(1))
    full = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else full
    parts = F.arrays_zip(gap.alias("g"), full.alias("f"), judged.alias("j"))

    def placed(parts: Column) -> Column:
        before = _before(F.transform(parts, lambda x: F.length(x["g"]) + F.length(x["f"])), F.lit(0), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            s = at + F.length(x["g"])
            return F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(x["f"])).alias("stop"), x["f"].alias("token"), F.length(x["j"]).alias("n"))

        long = F.filter(F.zip_with(parts, before, span), lambda x: x["n"] >= least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["token"].alias("token")))

    return F.when(t.rlike(first + pattern), bind(parts, placed)).otherwise(F.array().cast(SPAN))


def _touches(spans: Column, c: Column) -> Column:
    """Whether any of some disjoint spans, in order, overlaps span c: the first that stops behind c's start, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int") + 1)
    low = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")),
        lambda a, _: bind(((a["lo"] + a["hi"]) / 2).cast("int"), lambda m: F.when(a["lo"] >= a["hi"], a).when(F.get(spans, m)["stop"] > c["start"], F.struct(a["lo"].alias("lo"), m.alias("hi"))).otherwise(F.struct((m + 1).alias("lo"), a["hi"].alias("hi")))),
        lambda a: a["lo"],
    )
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, low)["start"] < c["stop"], F.lit(False))


def normal_tail(z: Column) -> Column:
    """P(N > z), by a published rational approximation (error below 8e-8)."""
    a = F.abs(z)
    k = 1.0 / (1.0 + 0.2316419 * a)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-a * a / 2.0) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def battery(token: Column, alphabet: Column) -> Column:
    """The combined p-value of a token's randomness over an alphabet."""
    n, size = F.length(token).cast("double"), F.length(alphabet).cast("double")
    chars = F.split(token, "(?!^)")
    codes = F.transform(chars, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))
    squares = F.aggregate(F.split(alphabet, "(?!^)"), F.lit(0.0), lambda a, c: bind(n - F.length(F.replace(token, c, F.lit(""))), lambda k: a + k * k))
    chi, df = size / n * squares - n, size - 1.0
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
    p_chi = normal_tail(z)
    lag = F.struct(F.lit(-1.0).alias("last"), *(F.lit(0.0).alias(x) for x in ("high", "runs", "s", "ss", "sp")), F.lit(0.0).alias("first"))

    def step(a: Column, x: Column) -> Column:
        started = a["last"] >= 0
        up, was = x >= size / 2.0, a["last"] >= size / 2.0
        return F.struct(
            x.alias("last"), (a["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"), (a["runs"] + F.when(~started | (up != was), 1.0).otherwise(0.0)).alias("runs"), (a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"),
            (a["sp"] + F.when(started, x * a["last"]).otherwise(0.0)).alias("sp"), F.when(started, a["first"]).otherwise(x).alias("first"),
        )

    def p(a: Column) -> Column:
        low = n - a["high"]
        mean = 2.0 * a["high"] * low / n + 1.0
        var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        p_runs = F.when(var > 0, 2.0 * normal_tail(F.abs(a["runs"] - mean) / F.sqrt(var))).otherwise(0.0)
        m = a["s"] / n
        total = a["ss"] - n * m * m
        cov = a["sp"] - m * (2.0 * a["s"] - a["first"] - a["last"]) + (n - 1.0) * m * m
        p_lag = F.when(total > 1e-9, 2.0 * normal_tail(F.abs(cov / total + 1.0 / n) * F.sqrt(n))).otherwise(0.0)
        half = -(F.log(F.greatest(p_chi, F.lit(1e-300))) + F.log(F.greatest(p_runs, F.lit(1e-300))) + F.log(F.greatest(p_lag, F.lit(1e-300))))
        return F.exp(-half) * (1.0 + half + half * half / 2.0)

    return F.aggregate(codes, lag, step, p)


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shape, _ in reversed(ENCODINGS):
        out = F.when(token.rlike(shape), F.lit(name)).otherwise(out)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), out)


def _alphabet(encoding: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, letters in ENCODINGS:
        out = F.when(encoding == name, F.lit(letters)).otherwise(out)
    return out


def _length_class(token: Column) -> Column:
    out = F.lit(LENGTHS[0])
    for n in LENGTHS[1:]:
        out = F.when(F.length(token) >= n, F.lit(n)).otherwise(out)
    return out


def scan_spans(documents: DataFrame, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns with `base` (spans of the fixed shapes) and `tested` (the other candidates and their p-values)."""
    carry = documents.columns if carry is None else carry
    mixed = lambda c: c["token"].rlike("[0-9]") & c["token"].rlike("[A-Za-z]")

    def tested(runs: Column, base: list[Column]) -> Column:
        free = F.filter(runs, lambda c: mixed(c) & ~_touches(base[0], c) & ~_touches(base[1], c) & ~_touches(base[2], c))
        named = F.filter(F.transform(free, lambda c: F.struct(c.alias("c"), _encoding(c["token"]).alias("e"))), lambda x: x["e"].isNotNull())
        return F.transform(named, lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["stop"].alias("stop"), F.concat(x["e"], F.lit(":"), _length_class(x["c"]["token"]).cast("string")).alias("class"), battery(x["c"]["token"], _alphabet(x["e"])).alias("p")))

    def spans(t: Column) -> Column:
        kinds = (_found(t, ASSIGN, 0, 2, 6, "(?=[PpSsTtAa])"), _found(t, ACCESS, 1), _found(t, HEX, 2))
        return bind(F.struct(*(k.alias(str(i)) for i, k in enumerate(kinds))), lambda b: F.struct(F.array_sort(F.concat(b["0"], b["1"], b["2"])).alias("base"), tested(_found(t, CANDIDATE, 3), [b["0"], b["1"], b["2"]]).alias("tested")))

    out = documents.select(*[F.col(f"`{c}`") for c in carry], bind(text_of(text), spans).alias("_s"))
    return out.select(*[F.col(f"`{c}`") for c in carry], "_s.base", "_s.tested")


def thresholds(scanned: DataFrame, q: float) -> DataFrame:
    """One row, `accept`: the threshold of each class that has one.

    For a threshold t, a class accepts n(p >= t) strings, of which (1 - t)
    times the number of random ones are expected to be random; that number is
    twice the count above 1/2.  One is added to the false ones, so that a class
    with few strings accepts none.
    """
    each = scanned.select(F.explode("tested").alias("c")).select(F.col("c.class").alias("class"), F.col("c.p").alias("p"))
    counts = each.groupBy("class").agg(F.count(F.when(F.col("p") > 0.5, 1)).alias("high"), *(F.count(F.when(F.col("p") >= t, 1)).alias(f"n{i}") for i, t in enumerate(GRID)))
    chosen = F.lit(None).cast("double")
    for i, t in reversed(list(enumerate(GRID))):
        false = F.greatest(F.lit(0.0), F.col(f"n{i}") - 2.0 * (1.0 - t) * F.col("high")) + 1.0
        chosen = F.when((F.col(f"n{i}") > 0) & (false <= q * F.col(f"n{i}")), F.lit(t)).otherwise(chosen)
    found = counts.withColumn("t", chosen).filter("t is not null")
    return found.agg(F.map_from_entries(F.collect_list(F.struct("class", "t"))).alias("accept"))


def find_secrets(documents: DataFrame, *, text: str = "text", carry: list[str] | None = None, q: float = 0.05) -> DataFrame:
    """`carry` columns (all, if none are named) with `base` and `secrets`: arrays of spans, sorted by start, then kind.

    kind counts as in KINDS; positions are code points, the end exclusive.
    `base` has the fixed shapes, `secrets` also the strings found random.
    Null and empty texts have no secrets.  Columns of the input called base,
    tested, accept, one or secrets are replaced.
    """
    own = [c for c in (documents.columns if carry is None else carry) if c not in ("base", "tested", "accept", "one", "secrets")]
    scanned = written(scan_spans(documents, text=text, carry=own), "secret-spans")
    one = thresholds(scanned, q)
    joined = scanned.withColumn("one", F.lit(1)).join(one.withColumn("one", F.lit(1)), "one")
    accepted = F.filter("tested", lambda c: c["p"] >= F.coalesce(F.col("accept")[c["class"]], F.lit(2.0)))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    more = F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    return joined.withColumn("secrets", F.array_sort(F.concat(plain, more))).select(*[F.col(f"`{c}`") for c in own], "base", "secrets")


def _written_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans of each row of `find_secrets`."""
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return found.withColumns(
        {"n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": F.sha2(_written_spans(F.col("base")), 256), "spans": _written_spans(F.col("secrets"))}
    )


def redact(documents: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", q: float = 0.05) -> DataFrame:
    """The rows of `documents` with every secret replaced by [SECRET]; n_chars, if there is one, counts the new text.

    Overlapping spans are one.  Rows without a secret are unchanged, null texts stay null.
    """
    columns = documents.columns
    kept = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = find_secrets(kept, text="text", carry=["row", "text"], q=q)

    def cut(t: Column, spans: Column) -> Column:
        """Spans that overlap are one; each that begins behind all before it ends the gap before it."""
        ends = _before(F.transform(spans, lambda s: s["stop"]), F.lit(0), lambda a, b: F.greatest(a, b))
        gaps = F.filter(F.zip_with(spans, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("to"))), lambda g: g["to"] >= g["at"])

        def piece(own: Column) -> Column:  # gaps that follow each other, cut from the part of the text they are in
            from_ = F.get(own, F.lit(0))["at"]
            part = F.substring(t, from_ + 1, F.element_at(own, -1)["to"] - from_)
            return bind(part, lambda p: F.array_join(F.transform(own, lambda g: F.concat(F.substring(p, g["at"] - from_ + 1, g["to"] - g["at"]), F.lit("[SECRET]"))), ""))

        body = bind(gaps, lambda g: F.array_join(F.transform(_pieces(g), piece), ""))
        return F.concat(body, F.substring(t, F.array_max(F.transform(spans, lambda s: s["stop"])) + 1, F.length(t)))

    cleaned = cut(F.col("text"), F.col("secrets"))
    new = F.when(F.size("secrets") > 0, cleaned).otherwise(F.col("text"))
    out = found.select("row", new.alias("new"))
    dtype = dict(documents.dtypes)
    fields = [F.col("new").alias(c) if c == text else F.when(F.col(f"row.`{text}`").eqNullSafe(F.col("new")), F.col(f"row.`{c}`")).otherwise(F.length("new")).cast(dtype[c]).alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c) for c in columns]
    return out.select(*fields)
