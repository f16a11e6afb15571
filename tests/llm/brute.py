"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter
from html.parser import HTMLParser

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k=4, percent=85):
    """[(id, size, component)] of (id, text) rows; a null id has none."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)]


def repeats(texts, length):
    """[(bytes, removed, runs, sha256 of the rest)]"""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out


def contamination(text, items, window=13):
    w = words(text, ALNUM)
    hit, found = set(), set()
    for item, body in items:
        b = words(body, ALNUM)
        n = min(window, len(b))
        own = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in own:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return tuple(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(text.encode()).hexdigest(), text


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w)


class Katz:
    """A backoff model over token lists, from the definition, without any table but counts."""

    def __init__(self, texts, order, k=5):
        self.order, self.k = order, k
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = ["<s>", *t]
            for i in range(1, len(w)):
                for n in range(1, order + 1):
                    if n == 1 or i - n + 1 >= 0:
                        self.counts[n][tuple(w[i - n + 1 : i + 1])] += 1
        self.total, self.vocabulary = sum(self.counts[1].values()), [w for (w,) in self.counts[1]]
        self.follow, self.grams = [Counter() for _ in range(order + 1)], {}
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                self.follow[n][g[:-1]] += c
                self.grams.setdefault(g[:-1], []).append(g)
        self.d = [None, *(self._discounts(Counter(self.counts[n].values())) for n in range(1, order + 1))]
        freed = sum(c * (1 - self.d[1][c]) for c in self.counts[1].values() if c <= k)
        self.mass = self.total if freed else self.total + 0.5
        self.unknown = (freed or 0.5) / self.mass
        self.memo = {}

    def _discounts(self, n):
        common = (self.k + 1) * n[self.k + 1] / n[1] if n[1] else 1
        out = {}
        for r in range(1, self.k + 1):
            good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            out[r] = good if 0 < good <= 1 else (r - 0.5) / r
        return out

    def discounted(self, n, g):
        c = self.counts[n][g]
        return c * self.d[n].get(c, 1.0)

    def alpha(self, n, h):
        """alpha and divisor of a history."""
        if (n, h) not in self.memo:
            own = self.grams[h]
            f = self.follow[n][h]
            seen = sum(self.discounted(n, g) for g in own) / f
            if seen > 1 - 1e-9:
                seen, f = seen * f / (f + 0.5), f + 0.5
            self.memo[n, h] = (1 - seen) / max(1 - sum(self.p(g[1:]) for g in own), 1e-12), f
        return self.memo[n, h]

    def p(self, g):
        """P of the last word of g after those before it; a word that training doesn't have is the unknown word."""
        n = len(g)
        if n == 1:
            return self.discounted(1, g) / self.mass if self.counts[1][g] else self.unknown
        h = g[:-1]
        if not self.follow[n][h]:
            return self.p(g[1:])
        a, f = self.alpha(n, h)
        return self.discounted(n, g) / f if self.counts[n][g] else a * self.p(g[1:])

    def score(self, t):
        w = ["<s>", *t]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(w)))


CUT_TAGS = {"nav", "aside", "form", "menu", "header", "footer"}
CUT_NAMES = {"ad", "comments", "notice", "sidebar", "menu"}
INLINE = {"a", "b", "i", "em", "span", "strong"}


class _Reader(HTMLParser):
    """Blocks of simple pages: [path as a tuple of (tag, names), text, characters in links]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text, self.linked = [], [], [], 0

    def flush(self):
        words = " ".join("".join(self.text).split())
        if words and not {t for t, _ in self.stack} & {"head", "title", "script", "style"}:
            self.blocks.append((tuple(x for x in self.stack if x[0] not in INLINE), words, min(self.linked, len(words))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        names = frozenset(w for k, v in attrs if k in ("class", "id", "role") for w in re.findall("[a-z0-9]+", (v or "").lower()) if not w.isdigit())
        if tag in ("br", "meta", "link", "img"):
            self.text += [" "] if tag == "br" else []
            return
        if tag not in INLINE:
            self.flush()
            tags = [t for t, _ in self.stack]
            if "p" in tags:
                del self.stack[tags.index("p") :]
        self.stack.append((tag, names))

    def handle_endtag(self, tag):
        tags = [t for t, _ in self.stack]
        if tag not in tags:
            return
        at = len(tags) - 1 - tags[::-1].index(tag)
        if any(t not in INLINE for t in tags[at:]):
            if tag in INLINE:
                return
            self.flush()
        del self.stack[at:]

    def handle_data(self, data):
        self.text.append(data)
        if "a" in [t for t, _ in self.stack]:
            self.linked += len(data.strip())


def main_texts(pages, boost, cut, threshold, smooth, prior, expected):
    """Texts of (site, html) by the definition, ratios computed from all blocks of all pages each time."""
    read = []
    for site, page in pages:
        reader = _Reader()
        reader.feed(page)
        reader.close()
        reader.flush()
        read.append((site, reader.blocks))

    by_path = {}
    for site, found in read:
        for path in {b[0] for b in found}:
            own = [b for b in found if b[0] == path]
            by_path.setdefault(path, []).append((site, sum(len(b[1]) for b in own), sum(len(re.findall("[.,;:!?…。、]", b[1])) for b in own)))
    kinds = {}

    def kind(path):
        if path not in kinds:
            inside = [k for k, (t, names) in enumerate(path) if t in ("article", "main") or "main" in names]
            bad = any((t in CUT_TAGS and not (t == "header" and inside and inside[0] < k)) or (names & CUT_NAMES and t not in ("article", "main")) for k, (t, names) in enumerate(path))
            kinds[path] = bool(inside), bad
        return kinds[path]

    means = {}

    def mean(site, path, i):
        """Length (0) or marks (1) of a page: the site's, with `prior` pages of all sites', with `prior` pages of what names say."""
        if (site, path, i) not in means:
            every = [x[i + 1] for x in by_path[path]]
            own = [x[i + 1] for x in by_path[path] if x[0] == site]
            inside, bad = kind(path)
            if bad or inside:
                all_mean = (sum(every) + prior * expected[not bad][i]) / (len(every) + prior)
            else:
                all_mean = sum(every) / len(every)
            means[site, path, i] = (sum(own) + prior * all_mean) / (len(own) + prior)
        return means[site, path, i]

    def text(site, found):
        def ratio(path, i):
            if i == 2:
                own = [b for b in found if b[0] == path]
                return sum(b[2] for b in own) / sum(len(b[1]) for b in own)
            return i + math.log1p(mean(site, path, i))

        def score(path):
            out = []
            for i in range(3):
                total, weight = smooth[0] * ratio(path, i), smooth[0]
                for up, w in enumerate(smooth[1:], 1):
                    node = path[:-up]
                    if len(node) < 1 or node[-1][0] in ("html", "body"):
                        break
                    near = [b for b in found if b[0][: len(node)] == node and len(b[0]) <= len(node) + len(smooth) and b[0] != node]
                    size = sum(len(b[1]) for b in near)
                    total, weight = total + w * sum(ratio(b[0], i) * len(b[1]) for b in near) / size, weight + w
                out.append(total / weight)
            inside, bad = kind(path)
            return out[0] * out[1] * (1 - out[2]) * (boost if inside else 1.0) * (cut if bad else 1.0)

        every = {path: score(path) for path in dict.fromkeys(b[0] for b in found)}
        if all(kind(path)[1] for path in every):
            return ""
        least = threshold * max(every.values())
        return "\n".join(b[1] for b in found if every[b[0]] > 0 and every[b[0]] >= least)

    return [text(site, found) for site, found in read]
