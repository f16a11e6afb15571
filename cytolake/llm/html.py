"""Main text of web pages by tag-path ratios, learned over all pages of a table.

A page is read as blocks of text, each with its root-to-leaf tag path (tags with
their class, id and role names).  Four things decide which paths are content:

1. Ratios: text length and punctuation are summed per path over the pages of a site, and over all pages.
   Per page that has the path they give a length ratio log(1 + length) and a punctuation ratio
   1 + log(1 + marks); what a site has of a path counts together with `PRIOR` pages of what all sites have of
   it, that with `PRIOR` pages of what its tags and names let expect (`EXPECTED`).  So names decide where
   nothing else is known, as for a page on its own, and mean nothing for a path of many pages.
   The share of text in links is the page's own.
2. Smoothing: a path's own ratio with that of all text below its parent and
   its grandparent, as weighted in `SMOOTH` (within a node by text; the body and what is above it don't count).
   So a heading or a short list goes with the paragraphs next to it.
3. Fusing: the smoothed ratios and the share of text that isn't links are
   multiplied; tags and names move the product by a third at most (`BOOST` inside of an
   article or main element, `CUT` for navigation, adverts, comments and the like).
4. Threshold: paths with at least `THRESHOLD` of the page's best score are content.

The text is the blocks of the content paths, in page order.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._spark import small_batches, written

# HTML elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = frozenset("head button select option dialog svg object canvas".split())  # controls and what isn't shown
PAGE_PARTS = frozenset("nav aside form menu header footer".split())
CONTAINERS = frozenset("article main".split())
#: Words in class, id or role that name what is no part of an article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments disqus replies cookie cookies consent notice notices popup modal newsletter subscribe subscription share sharing social related widget login signup search contentinfo complementary alert dialog toolbar".split()
)
PAGE_NAMED = frozenset("header masthead footer".split())
#: What a start tag closes, and within which elements only.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
NAME_WORD = re.compile(r"[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、]")

#: Weights of what tags and names say, and the share of the best score that makes a path content.
BOOST, CUT, THRESHOLD = 4 / 3, 2 / 3, 0.3
#: Pages that an expectation counts as, and the (length, marks) expected of content and of what isn't.
PRIOR, EXPECTED = 4, {True: (1000.0, 20.0), False: (0.0, 0.0)}
#: Paths of sites that are broadcast at most (8 MB); more are joined.
MOST_PATHS = 1 << 17
SUMS = ("n", "size", "marks", "all_n", "all_size", "all_marks")
SMOOTH = (0.4, 0.2, 0.4)  # own, parent, grandparent
P_SCOPE = frozenset("body article main section div td th li blockquote dd figure header footer aside nav form".split())


class Path:
    """A node of the page's tree of tag paths, and the sums over the blocks that end in it."""

    __slots__ = ("above", "boosted", "children", "cut", "key", "linked", "marks", "parent", "size")

    def __init__(self, parent: Path | None, label: str, tag: str, names: set[str]):
        self.parent, self.children = parent, {}
        self.key = hashlib.blake2b((parent.key if parent else b"") + label.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        inside = parent is not None and parent.boosted
        self.boosted = inside or tag in CONTAINERS or "main" in names
        own = tag in PAGE_PARTS and not (inside and tag == "header") or bool(names & NAMED) and tag not in ("body", "html", *CONTAINERS) or not inside and bool(names & PAGE_NAMED)
        self.cut = own or (parent is not None and parent.cut)
        self.above = tag in ("", "html", "body")
        self.size = self.marks = self.linked = 0

    def child(self, tag: str, attributes: str) -> Path:
        names = {w for m in ATTRIBUTE.finditer(attributes) for w in NAME_WORD.findall((m[2] or m[3] or m[4] or "").lower())} if "=" in attributes else set()
        label = ".".join([tag, *sorted(x for x in names if not x.isdigit())])
        if label not in self.children:
            self.children[label] = Path(self, label, tag, names)
        return self.children[label]

    def at(self, site: str) -> int:
        """Name of the path on a site, in 64 bits."""
        return _long(hashlib.blake2b(site.encode("utf-8", "surrogatepass") + b"\0" + self.key, digest_size=8).digest())


def _long(key: bytes) -> int:
    return int.from_bytes(key, "little", signed=True)


class _Element:
    """An open element: its path, the block element it is in, and whether it is in a link or not shown."""

    __slots__ = ("block", "inline_cut", "link", "off", "path", "tag")

    def __init__(self, parent: _Element | None, tag: str, attributes: str, path: Path):
        self.tag, self.path = tag, path
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.link = tag == "a" or (parent is not None and parent.link)
        self.off = tag in NOT_TEXT or bool(attributes and HIDDEN.search(attributes)) or (parent is not None and parent.off)
        # an advert in a span is no part of the paragraph it stands in
        self.inline_cut = tag not in BLOCK and parent is not None and (parent.inline_cut or path.cut and not parent.path.cut)


def blocks(page: str) -> list[tuple[Path, str]]:
    """Path and text of each block that is shown, in page order; the paths have their sums."""
    root = _Element(None, "", "", Path(None, "", "", set()))
    stack, out, at = [root], [], 0
    opened: Counter[str] = Counter()
    text: list[str] = []
    where, linked = root, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                p = where.block.path
                p.size, p.marks, p.linked = p.size + len(words), p.marks + len(PUNCTUATION.findall(words)), p.linked + min(linked, len(words))
                out.append((p, words))
        text, linked = [], 0

    def add(part: str) -> None:
        nonlocal where, linked
        top = stack[-1]
        if not part or top.off or top.inline_cut:
            return
        if not text:
            where = top
        decoded = entities.unescape(part)
        text.append(decoded)
        if top.link:
            linked += len(decoded.strip())

    def close(to: int) -> None:
        if any(s.tag in BLOCK for s in stack[to:]):
            flush()
        opened.subtract(s.tag for s in stack[to:])
        del stack[to:]

    def close_first(shut: frozenset[str] | set[str], within: frozenset[str] | set[str], every: bool = False) -> None:
        """Close the innermost open element of `shut` that is no further out than one of `within`."""
        if not any(opened[x] for x in shut):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in shut:
                close(i)
                if not every:
                    return
            elif stack[i].tag in within:
                return

    last = page.rfind(">") + 1  # no tag ends after it
    while at < last and (m := TOKEN.search(page, at, last)):
        add(page[at : m.start()])
        at = m.end() if not m[0].startswith("<!--") or m[0].endswith("-->") else len(page)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
            close_first({"p"}, P_SCOPE)
        if tag in CLOSES:
            close_first(*CLOSES[tag], every=tag == "tr")
        elif stack[-1].tag == "head" and tag in BLOCK:
            close(len(stack) - 1)
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            shut = page.find(">", end.start()) if end else -1
            at = len(page) if shut < 0 else shut + 1
            continue
        if not attributes.endswith("/") or tag in BLOCK:
            up = stack[-1]
            stack.append(_Element(up, tag, attributes, up.path.child(tag, attributes)))
            opened[tag] += 1
    add(page[at:])
    flush()
    return out


Learned = Callable[[Path], "tuple[float, ...] | None"]


def scores(found: list[tuple[Path, str]], learned: Learned | None = None) -> dict[Path, float]:
    """The smoothed and fused score of every path that has blocks; `learned` has the SUMS of a path, without it the page is all there is."""
    paths = list(dict.fromkeys(p for p, _ in found))

    def means(p: Path) -> tuple[float, float]:
        n, size, marks, all_n, all_size, all_marks = (learned and learned(p)) or (1, p.size, p.marks) * 2
        if p.cut or p.boosted:
            expected = EXPECTED[not p.cut]
            all_n, all_size, all_marks = all_n + PRIOR, all_size + PRIOR * expected[0], all_marks + PRIOR * expected[1]
        return (size + PRIOR * all_size / all_n) / (n + PRIOR), (marks + PRIOR * all_marks / all_n) / (n + PRIOR)

    raw = {}
    for p in paths:
        size, marks = means(p)
        raw[p] = (math.log1p(size), 1 + math.log1p(marks), p.linked / p.size)
    below: dict[Path, list[float]] = {}  # text, and ratios times text, below a node
    for p in paths:
        node = p
        for _ in range(len(SMOOTH)):
            node = node.parent
            if node is None or node.above:
                break
            s = below.setdefault(node, [0.0] * 4)
            for i, x in enumerate((1.0, *raw[p])):
                s[i] += x * p.size
    # text further below than a grandchild counts with its own kin only

    def smoothed(p: Path, i: int) -> float:
        total, weight, node = SMOOTH[0] * raw[p][i], SMOOTH[0], p
        for w in SMOOTH[1:]:
            node = node.parent
            if node is None or node.above:
                break
            total, weight = total + w * below[node][i + 1] / below[node][0], weight + w
        return total / weight

    return {p: smoothed(p, 0) * smoothed(p, 1) * (1 - smoothed(p, 2)) * (BOOST if p.boosted else 1.0) * (CUT if p.cut else 1.0) for p in paths}


def main_text(page: str | None, learned: Learned | None = None) -> str:
    """The blocks of the content paths, joined by newlines; empty if there is none."""
    found = blocks(page or "")
    score = scores(found, learned)
    if all(p.cut for p in score):
        return ""  # a page of nothing but navigation, notices and the like
    least = THRESHOLD * max(score.values())
    return "\n".join(t for p, t in found if score[p] > 0 and score[p] >= least)


def _sums(rows: DataFrame) -> DataFrame:
    """key (a path on a site) and its SUMS: of the site's pages and of all pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[int, int], list[int]] = {}
            for site, page in zip(b.column("site"), b.column("html")):
                for p in dict.fromkeys(p for p, _ in blocks(page.as_py() or "")):
                    s = sums.setdefault((p.at(site.as_py()), _long(p.key)), [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + 1, s[1] + p.size, s[2] + p.marks
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(("key", "path", "n", "size", "marks"), zip(*((*k, *v) for k, v in sums.items())) if sums else [[]] * 5)})

    of_site = rows.select("site", "html").mapInArrow(count, "key long, path long, n long, size long, marks long").groupBy("key", "path").agg(*(F.sum(c).alias(c) for c in SUMS[:3]))
    of_site = written(of_site, "paths")
    of_all = of_site.groupBy("path").agg(*(F.sum(c).alias(f"all_{c}") for c in SUMS[:3]))
    salted = of_site.withColumn("salt", F.pmod("key", F.lit(16)).cast("int"))  # a path may be that of most sites
    return written(salted.join(of_all.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["path", "salt"]).select("key", *SUMS), "path_sums")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", most_paths: int = MOST_PATHS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; a null or empty page has an empty text.

    Pages are read twice: for the sums of their paths, then for the text.  Sums of up to `most_paths` paths of
    sites are broadcast; if there are more, those of a page are joined to it by its content.
    Pages without url are those of one site.  Pages of any length are read whole; a task holds a few of them.
    Rows that repeat give rows that repeat, and count as often; other columns are left out.
    """
    small_batches(pages.sparkSession)
    site = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), site.alias("site"))
    sums = _sums(rows)
    out = f"page_id {dict(rows.dtypes)['page_id']}, url {dict(rows.dtypes)['url']}, text string, n_chars long"

    def batch(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if sums.count() <= most_paths:
        found = sums.toArrow().sort_by("key")
        known = pages.sparkSession.sparkContext.broadcast((found["key"].to_numpy(), np.stack([found[c].to_numpy() for c in SUMS], 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = known.value
            for b in batches:
                yield batch(b, [main_text(x.as_py(), lambda p, s=s.as_py(): tuple(values[np.searchsorted(keys, p.at(s))].tolist())) for x, s in zip(b.column("html"), b.column("site"))])

        return rows.mapInArrow(run, out)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = {(h, g, p.at(s)) for h, g, s, page in zip(*(b.column(c).to_pylist() for c in ("h", "g", "site", "html"))) for p, _ in blocks(page or "")}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(("h", "g", "key"), zip(*each) if each else [[]] * 3)})

    rows = rows.withColumns({"h": F.xxhash64("site", "html"), "g": F.xxhash64("html", "site", F.lit(1))})
    needed = rows.select("h", "g", "site", "html").mapInArrow(named, "h long, g long, key long").distinct().withColumn("salt", F.pmod("h", F.lit(16)).cast("int"))
    salts = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    lists = needed.join(salts, ["key", "salt"]).groupBy("h", "g").agg(F.collect_list(F.struct("key", *SUMS)).alias("sums"))  # the paths of one page
    joined = rows.join(lists, ["h", "g"], "left").select("page_id", "url", "html", "site", "sums")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, s, own in zip(b.column("html"), b.column("site"), b.column("sums")):
                by = {r["key"]: tuple(r[c] for c in SUMS) for r in own.as_py() or ()}
                texts.append(main_text(x.as_py(), lambda p, s=s.as_py(), by=by: by[p.at(s)]))
            yield batch(b, texts)

    return joined.mapInArrow(run_joined, out)
