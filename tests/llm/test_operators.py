"""Every operator against a plain version on hard cases, and on an empty table."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cytolake.llm import chat, decontaminate, html, jaccard, katz, mixing, quality, secrets, suffix, toxicity
from tests.llm import brute
from tests.oracle import SF


def pairs(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(hard, k, percent):
    got = Counter(pairs(jaccard.join(hard, k=k, percent=percent), "doc_id", "n_shingles", "component_id"))
    assert got == Counter(brute.components(pairs(hard, "doc_id", "text"), k, percent))


def test_jaccard_in_small_blocks(hard, monkeypatch):
    for name, value in (("BLOCK_ROWS", 2), ("LARGE_HOME", 1), ("LIST_ROWS", 2), ("SMALL_LIST", 1)):
        monkeypatch.setattr(jaccard, name, value)
    got = Counter(pairs(jaccard.join(hard), "doc_id", "n_shingles", "component_id"))
    assert got == Counter(brute.components(pairs(hard, "doc_id", "text")))


@pytest.mark.parametrize("words", [34, 60])
def test_jaccard_near_copies_of_one_text(spark, words):
    """Copies with one word changed each: linked with the original only (34 words), or with each other too."""
    base = [f"w{i}" for i in range(words)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[: 4 + i % (words - 8)], f"x{i}", *base[5 + i % (words - 8) :]])) for i in range(1, 120)]
    rows += [(1000 + i, " ".join([*base[: 4 + i % (words - 8)], f"y{i}", *base[5 + i % (words - 8) : -4], "a", "b", f"c{i}", f"d{i}"])) for i in range(60)]
    got = Counter(pairs(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80), "doc_id", "n_shingles", "component_id"))
    assert got == Counter(brute.components(rows, 5, 80))


@pytest.mark.parametrize(("length", "gram", "batches"), [(200, 40, 4), (60, 16, 3), (60, 16, 1)])
def test_suffix(hard, length, gram, batches):
    got = Counter(pairs(suffix.digest(suffix.remove_repeats(hard, length=length, gram=gram, batches=batches)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    rows = pairs(hard, "doc_id", "text")
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute.repeats([t for _, t in rows], length), strict=True))


def test_suffix_in_small_pieces(spark, hard, monkeypatch):
    """Few places a row, small pieces, ranges that split a suffix, and the way for frequent suffixes."""
    for name, value in (("PLACES", 2), ("PIECE", 5000), ("MANY", 1)):
        monkeypatch.setattr(suffix, name, value)
    passage = "a passage that very many documents share, word for word, and that is longer than sixty bytes"
    more = spark.createDataFrame([(10_000 + i, f"{i} begins. {passage} {i % 7} ends {i}.") for i in range(300)] + [(20_000 + i, passage * 2) for i in range(200)], "doc_id long, text string").repartition(3)
    docs = hard.select("doc_id", "text").unionByName(more)
    rows = pairs(docs, "doc_id", "text")
    want = Counter((d, *x) for (d, _), x in zip(rows, brute.repeats([t for _, t in rows], 60), strict=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(pairs(suffix.digest(suffix.remove_repeats(docs, length=60, gram=16, batches=3)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_decontamination(spark, hard):
    texts = [t for _, t in pairs(hard, "doc_id", "text") if t]
    items = [(1, texts[2]), (2, " ".join(texts[30].split()[2:9])), (3, "one"), (4, None), (5, ""), (6, "!!"), (7, texts[2]), (8, texts[10] + " tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, *brute.contamination(t, items)) for d, t in pairs(hard, "doc_id", "text"))
    for shingle in (4, 2):
        got = decontaminate.contamination(decontaminate.benchmark_hits(hard, bench, shingle=shingle))
        assert Counter(pairs(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    kept = decontaminate.decontaminated(hard, bench)
    assert kept.columns == hard.columns and kept.count() == sum(not x[-1] for x in want.elements())
    none = decontaminate.contamination(decontaminate.benchmark_hits(hard, bench.limit(0)))
    assert none.filter("contaminated or n_hit > 0").count() == 0


def test_quality(hard):
    got = Counter(pairs(quality.judge(hard), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == Counter((d, *brute.quality(t)) for d, t in pairs(hard, "doc_id", "text"))
    assert quality.judge(hard).filter("kept and base_failed").count() == 0


def test_quality_rejects_words_of_no_language(spark):
    import random

    r = random.Random(2)
    made = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    common = quality.COMMON["en"][:12]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.4 else made() for _ in range(120)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(made() for _ in range(120)), "en") for i in range(5)] + [(200, " ".join(made() for _ in range(120)), "xx"), (201, None, None), (202, "", "en"), (203, "word " * 200_000, "en")]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert kept == {*range(40), 200}


def test_secrets(hard):
    got = {(r["doc_id"], (r["n_assign"], r["n_access"], r["n_hex"]), r["base_sha256"]) for r in secrets.digest(secrets.find_secrets(hard)).collect()}
    assert got == {(d, *brute.secrets(t)[:2]) for d, t in pairs(hard, "doc_id", "text")}
    red = secrets.redact(hard)
    assert red.columns == hard.columns and red.dtypes == hard.dtypes and red.filter("text like '%hunter2%' or text like '%f00dfeed%'").count() == 0
    assert red.filter("text is null").count() == hard.filter("text is null").count()


def test_secrets_in_very_long_tokens_and_many_matches(spark):
    import random
    import time

    r = random.Random(4)
    token = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    many = "".join(f"é token: abcdef{i:06d} x\n" for i in range(100_000))
    overlapping = " ".join("f00dfeedf00dfeedf00dfeed" if i % 3 else f"mysecret=f00dfeedf00dfeedf00dfeed{i}" for i in range(3000))
    mixed = " ".join(f"tail{i}tail1234567890abcdefgh" for i in range(2000)) + " " + overlapping
    docs = spark.createDataFrame([(1, token), (2, many), (3, overlapping), (4, mixed)], "doc_id long, text string")
    began = time.time()
    out = secrets.digest(secrets.find_secrets(docs)).collect()
    red = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.time() - began < 120
    for r in out:
        counts, digest, _ = brute.secrets({1: token, 2: many, 3: overlapping, 4: mixed}[r["doc_id"]])
        assert ((r["n_assign"], r["n_access"], r["n_hex"]), r["base_sha256"]) == (counts, digest)
        text = {1: token, 2: many, 3: overlapping, 4: mixed}[r["doc_id"]]
        want, at = [], 0
        for _, s, e in sorted((int(x[1]), int(x[1]), int(x[2])) for x in (y.split(":") for y in r["spans"].split(",") if y)):
            if s >= at:
                want += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert red[r["doc_id"]] == "".join(want) + text[at:]


def test_random_strings_are_found_and_words_are_not(spark):
    import random

    r = random.Random(3)
    random_ = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(300)]
    structured = ["abcabcabcabc123" * 3 for _ in range(50)] + [f"user_profile_page_view_{i:020d}" for i in range(50)]
    rows = [(i, f"see {x} there") for i, x in enumerate(random_ + structured)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {r["doc_id"] for r in got.filter("exists(secrets, s -> s.kind = 3)").collect()}
    assert len(hit & set(range(300))) > 285 and not hit & set(range(300, 400))


def test_mixing_prefix_and_budgets(hard):
    domain = F.when(F.col("source").isin("src1", "src2"), "a").otherwise("b")
    weights = {("a",): 0.7, ("b",): 0.3}
    got = mixing.mix(hard, domain, weights, budget=4000, max_epochs=2, digits=1).collect()
    leaves, docs = Counter(), mixing.leaf_tokens(hard, domain).collect()
    for r in docs:
        leaves[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
    target = mixing.budgets(dict(leaves), weights, 4000, 2)
    import hashlib

    want = Counter()
    for leaf, t in leaves.items():
        rest = target[leaf]
        for epoch in range(3):
            order = sorted((hashlib.md5(f"17:{epoch}:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["doc_id"] or 0, r["n_tokens"]) for r in docs if (r["domain"], r["lang"], r["source"]) == leaf)
            if rest >= t > 0:
                want[leaf, epoch] += t
                rest -= t
                continue
            run = 0
            for _, _, n in order:
                if run >= rest:
                    break
                want[leaf, epoch] += n
                run += n
            break
    have = Counter()
    for r in got:
        have[(r["domain"], r["lang"], r["source"]), r["epoch"]] += r["n_tokens"]
    assert +have == +want


def test_shortage_goes_to_siblings_first():
    leaves = {("a", "x", "s"): 10, ("a", "x", "t"): 1000, ("b", "x", "u"): 1000}
    got = mixing.budgets(leaves, {("a",): 0.5, ("b",): 0.5}, 400, 1)
    assert got == {("a", "x", "s"): 10, ("a", "x", "t"): 190, ("b", "x", "u"): 200}
    assert mixing.budgets(leaves, {}, 10**9, 2) == {k: 2 * v for k, v in leaves.items()}


def test_leaf_budgets_are_those_of_the_tree(spark):
    import random

    r = random.Random(8)
    for case in range(6):
        leaves = {(d, x, s): r.choice([0, 1, 7, 50, 900]) for d in "abc" for x in "xy" for s in "stuvw" if r.random() < 0.8}
        weights = {("a",): 0.6, ("b",): 0.3, ("c",): r.choice([0.0, 0.1])} | {(d, "x"): r.choice([0.2, 1.0, 3.0]) for d in "abc"} | {("a", "x", "s"): 0.0}
        budget, epochs = r.choice([10, 500, 2000, 10**7]), r.choice([1, 3])
        want = mixing.budgets(leaves, weights, budget, epochs)
        frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, t long")
        got = {tuple(x[:3]): x[4] for x in mixing.leaf_budgets(frame, weights, budget, epochs).collect()}
        assert got == {k: want.get(k, 0) for k in leaves}, case


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 5, "ann", ""), (1, 1, "ann", "hi")]
    rows += [(9, i, "ab"[i % 2], f"turn {i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {}
    for r in chat.rotate_perspectives(frame).orderBy("conv_id", "perspective", "seq").collect():
        t = whole.setdefault((r["conv_id"], r["perspective"]), "")
        assert r["seg_start"] == len(t)
        t += r["segment"]
        assert r["seg_end"] == len(t) and r["in_loss"] == (r["speaker"] == r["perspective"])
        if r["in_loss"]:
            assert t[r["loss_start"] : r["loss_end"]].endswith("<|end|>")
        whole[r["conv_id"], r["perspective"]] = t
    assert set(whole) == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "ann"), (9, "a"), (9, "b")}
    assert whole[1, "bob"].startswith("<|system|>be kind<|end|>\n<|user name=ann|>hi<|end|>\n<|user name=ann|>hi<|end|>\n<|user name=ann|>tie")


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class="ad">Buy, now.</div>{}<aside>More</aside><footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>One,  two.<br><p>Three.</article>", "A & B\nOne, two.\nThree."),
        ('<main><p>Long text, with marks.</p><script>var t="</p>";</script><ul><li>x<li>y</ul><form>f</form><section class="comments"><p>Nice.</p></section></main>', "Long text, with marks.\nx\ny"),
        ('<div id="menu"><a>m</a></div><div class="content"><p>First, a sentence.</p><p>ok</p></div><div class="sidebar">s</div>', "First, a sentence.\nok"),
        ("", ""),
        ("<article>a<!-- no --><p hidden>b</p> c &lt;d&gt;</article>", "a\nc <d>"),
    ],
)
def test_html(body, text):
    assert html.main_text(PAGE.replace("{}", body)) == text


def test_html_paths_decide_without_containers_or_names():
    """Only the ratios differ: the same tags with and without prose."""
    prose = "".join(f"<p>Here is sentence {i}, which goes on for a while. And another one follows, with marks.</p>" for i in range(4))
    page = f"<body><div id=x><section><ul><li>Home</li><li>About</li></ul></section><div><h2>Title of it</h2>{prose}<ul><li>first point</li><li>second point</li></ul></div></div><table><tr><td>1</td><td>2</td></tr></table></body>"
    got = html.main_text(page)
    assert got.startswith("Title of it\nHere is sentence 0") and got.endswith("first point\nsecond point") and "Home" not in got and "1" not in got.split("\n")
    # the same page whose table has the prose: now the table's path is content, and the list of words still isn't
    swapped = page.replace("<td>1</td>", "<td>Long text stands in the cell, and it goes on. More of it follows here, and then some more.</td>")
    assert "stands in the cell" in html.main_text(swapped)
    # a long notice under a telling name stays out, a long unnamed block doesn't
    extra = "<div class=%s>This long block has several sentences. They have marks, and more of them, too.</div>"
    assert "long block" not in html.main_text(page.replace("<table>", extra % "notice" + "<table>")) and "long block" in html.main_text(page.replace("<table>", extra % "body" + "<table>"))


HTML = ("BOOST", "CUT", "THRESHOLD", "SMOOTH", "PRIOR", "EXPECTED")


@pytest.mark.parametrize("most_paths", [1 << 17, 0])
def test_html_by_brute_force(spark, most_paths):
    """Sums are broadcast, or joined to each page: the same texts."""
    given = [(r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("url", "html").collect()]
    given += [(None, PAGE.replace("{}", f"<div class=content><h1>T</h1>{'<p>A sentence, of words.</p>' * n}</div><section class=comments><p>Nice, very nice indeed.</p></section>")) for n in (0, 1, 5)] + given[:3]
    site = [(u or "").partition("://")[2].partition("/")[0].partition("?")[0].partition("#")[0].lower() for u, _ in given]
    expected = brute.main_texts([(s, h) for s, (_, h) in zip(site, given)], *(getattr(html, x) for x in HTML))
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, most_paths=most_paths).collect()}
    assert got == dict(enumerate(expected))
    for page in [h for _, h in given[-8:]]:
        assert html.main_text(page) == brute.main_texts([("", page)], *(getattr(html, x) for x in HTML))[0]


def test_html_pages_of_a_site_decide_against_names(spark):
    """What many pages have is told by its text: an unnamed notice, menu and imprint go, parts of an article under misleading names stay."""
    prose = "".join(f"<p>Here is sentence {i}, which goes on for a while. And another one follows, with marks, as usual.</p>" for i in range(8))
    related = "".join(f"<p>Earlier work {i} is told of here, at length. It has sentences, and they have marks, like all others.</p>" for i in range(6))
    page = "<body><div><p>We use cookies. Accept all of them.</p></div><div><span>Home</span> <span>About</span></div><div class=x1><div><h1>Title %d</h1>" + prose + "<div class=related-work>" + related + "</div></div></div><section><p>Printed in Town.</p></section></body>"
    rows = [(i, f"https://Site.example/{i}?q=1", page % i) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i, text in got.items():
        assert text.startswith(f"Title {i}\nHere is sentence 0") and "Earlier work 0" in text and text.endswith("like all others."), text[-200:]
    # alone, little text under a telling name stays out
    assert "Earlier" not in html.main_text((page % 0).replace(related, "<p>Earlier work.</p>"))


def test_html_deep_and_long_pages():
    import time

    began = time.time()
    for page in ("<ul><li>x" * 20000, "<b>" * 50000 + "text, here." + "</i>" * 50000, "<div>" * 50000 + "a sentence, here." + "</div>" * 50000, "<p>word, and more of it.</p>" * 50000, "<" * 30000, "<a " * 20000, "&amp;" * 200000, "<table>" * 20000 + "<tr>" * 20000):
        html.main_text(page)
    assert time.time() - began < 60


def test_html_rows(spark, empty):
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (2, None, "<p>é</p>", 4)], "page_id long, url string, html string, text int")
    assert Counter(pairs(html.extract(pages), "page_id", "text", "n_chars")) == Counter({(1, "", 0): 2, (2, "é", 1): 1})
    assert html.extract(pages.limit(0)).count() == 0


def test_toxicity_and_swaps(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    rows = []
    for i in range(400):
        toxic = i % 3 == 0
        w = [word() for _ in range(30)] + (["idiot"] if toxic else []) + (["women"] if (toxic and i % 2) or i % 40 == 1 else [])
        r.shuffle(w)
        rows.append((i, " ".join(w) + "."))
    docs = spark.createDataFrame([*rows, (None, None), (1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    train = F.col("doc_id") % 5 != 0
    plain, fair = (toxicity.fit(docs, labels, train, counterfactual=c) for c in (0.0, 20.0))
    out = {r["doc_id"]: r for r in toxicity.score(docs, fair).collect()}
    assert all(out[i]["predicted"] == int(i % 3 == 0) for i in range(0, 400, 5)) and len(out) == 403
    probe = spark.createDataFrame([(0, "the women came."), (1, "the men came.")], "doc_id long, text string")
    gap = lambda m: abs(float.__sub__(*[r["score"] for r in toxicity.score(probe, m).orderBy("doc_id").collect()]))
    assert gap(fair) < gap(plain)
    nothing = toxicity.fit(docs, labels.limit(0), train)
    assert toxicity.score(docs, nothing).filter("predicted = 1").count() == 0


def tokens(text):
    return [*brute.words(text), "</s>"]


def katz_train(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 != 1


def test_toxicity_scores_by_brute_force(spark, hard):
    """A score is the logistic function of the summed weights of the words and word beginnings that a text has, each once."""
    import pyarrow as pa

    from cytolake.llm._text import chunks

    docs = hard.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs.withColumns({"_id": F.lit(1), "_y": F.lit("x")}), labels, F.col("doc_id") % 5 != 0, least=2)
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))

    def hashes(words):
        """Of single words, each a text of its own."""
        out = {}
        for c in chunks(pa.array(words)):
            row, h = toxicity.features(c)
            for r, x in zip(row.tolist(), h.tolist(), strict=True):
                out.setdefault(words[c.row + r], set()).add(x)
        return out

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for d, t in pairs(docs, "doc_id", "text"):
        words = sorted(set(brute.words(t, brute.ALNUM)))
        own = set().union(*hashes(words).values()) if words else set()
        z = model.bias + sum(weight.get(x, 0.0) for x in own)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    # a name is swapped for every other of its kind, sentence by sentence
    kinds = {t: g for g in toxicity.IDENTITY for t in g}
    assert toxicity._swaps("A blind man came. Nobody else.", {t: kinds[t] for t in ("blind",)}) == [("a blind man came", f"a {x} man came") for x in kinds["blind"] if x != "blind"]


@pytest.mark.parametrize(("order", "hot"), [(2, 1024), (2, 8), (3, 1024), (3, 30), (4, 10)])
def test_katz_by_brute_force(spark, hard, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 3000)
    rows = pairs(hard, "doc_id", "text")
    model = brute.Katz([tokens(t) for d, t in rows if katz_train(d)], order)
    n, v = model.total, len(model.vocabulary)
    want = Counter()
    for d, t in rows:
        w = tokens(t)
        c = [model.counts[1][(x,)] for x in w]
        want[d, len(w), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), 6), round(model.score(w), 6)] += 1
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, F.lit(False))
    out = katz.score(hard, train, order=order, buckets=7)
    got = Counter((*r[:4], round(r[4], 6), round(r[5], 6)) for r in pairs(out, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    assert got == want


@pytest.mark.parametrize("order", [2, 3])
def test_katz_sums_to_one_after_each_history(hard, order):
    model = brute.Katz([tokens(t) for d, t in pairs(hard, "doc_id", "text") if katz_train(d)], order)
    histories = [("<s>",), ("the",), ("</s>",), ("never seen",)] if order == 2 else [("<s>", "the"), *list(model.follow[3])[:5], ("the", "never seen")]
    for h in histories:
        assert sum(model.p((*h, w)) for w in [*model.vocabulary, "never seen"]) == pytest.approx(1, abs=1e-9)


def test_katz_without_training(hard, spark):
    assert katz.score(hard, F.lit(False)).filter("n_known > 0 or train_tokens > 0").count() == 0
    long = spark.createDataFrame([(1, "a b c d " * 200_000), (2, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(pairs(katz.score(long, F.lit(True)), "doc_id", "n_tokens", "n_known")) == [(1, 800_001, 800_001), (2, 3, 3), (2, 3, 3)]


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert jaccard.join(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    assert quality.judge(empty).count() == 0
    assert secrets.find_secrets(empty).count() == 0
    assert mixing.mix(empty, F.lit("d"), {}).count() == 0
    assert katz.score(empty, F.lit(True)).count() == 0
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
