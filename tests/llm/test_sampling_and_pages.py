"""Fill-in-middle, importance resampling and page text against plain versions, round trips and planted articles."""

import hashlib
import html
import math
import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from offerloom.llm import op11_fill_in_middle as op11
from offerloom.llm import op12_importance_resampling as op12
from offerloom.llm import op13_html_extraction as op13

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, n string, form string, score string, h1 string, rank string"


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    signs = ["a", "B", "zz", "P", "S", "M", "<", ">", " ", "\n", "7", "ä", "中", "😀", "the ", "Wort "]
    out = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80)))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, "x<S>y"), (n + 3, "a" * 200_000), (n + 4, " 1ä" * 70_000), (n + 5, "one two " * 40_000), (None, "no id at all"), (None, None), (3, out[3][1]), (n + 6, out[5][1])]
    return [(i, x, "x", "x", "x", "x", "x", "x") for i, x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


# fill-in-middle


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in op11.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_op11_equals_a_plain_cut_and_is_restored(docs):
    out = op11.fill_in_middle(docs).withColumn("back", op11.restored(F.col("form"), F.col("output")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain_cut(i, x), x or "") for i, x, *_ in corpus()), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 3, 64])
@pytest.mark.parametrize("sentinels", [op11.SENTINELS, ("|p", "|s", "|m"), ("<fim-a>", "<fim-b>", "<fim-c>")])
def test_units_are_counted_and_found_in_blocks(block, sentinels):
    rnd, units = random.Random(block), op11.Units(sentinels, block)
    for _ in range(400):
        text = "".join(rnd.choice([*sentinels, *sentinels[0], "ab", "P", "<", " ", "ä", "\n"]) for _ in range(rnd.randint(1, 14)))
        want = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        classes = units.classes(text)
        before, sentinel = units.measure(classes)
        assert before[-1] == len(want) and sentinel == any(x in text for x in sentinels)
        assert [units.place(classes, before, k) for k in range(len(want) + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]


def test_op11_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(op11.ORACLE_SQL)
    got = op11.op11_fill_in_middle(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# importance resampling


def plain_draw(docs, target, percent, runs, buckets=10_000):
    def features(text):
        w = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((x for _, x in docs), s), (target, t):
        for x in texts:
            for b in features(x)[0]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        f, words = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    return sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < 20], key=str)


@pytest.mark.parametrize(("percent", "runs"), [(10, 1), (60, 2), (100, 3)])
def test_op12_equals_a_plain_draw(spark, percent, runs):
    rnd = random.Random(runs)
    words = ["Haus", "tree", "x1", "Über", "中文", "STOP", "a", "b", "9"]
    docs = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "!? --"), (None, docs[1][1] + " eins zwei" * 15), (7, docs[7][1]), (153, docs[8][1]), (154, "tree " * 60_000)]
    target = ["tree tree X1 haus", None, "", "Über 中文 tree3 tree4"]
    d = spark.createDataFrame([(i, x, "z", "z") for i, x in docs], "doc_id long, text string, n string, weight string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = op12.importance_resample(d, t, percent=percent, runs=runs)
    assert sorted(map(tuple, got.collect()), key=str) == plain_draw(docs, target, percent, runs)


def test_op12_without_target_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    d = spark.createDataFrame([(i, "wort " * (15 + i)) for i in range(10)], "doc_id long, text string")
    assert op12.importance_resample(none, d).count() == 0
    got = sorted(map(tuple, op12.importance_resample(d, none, percent=40).collect()))
    assert got == [tuple(r) for r in sorted(plain_draw([(i, "wort " * (15 + i)) for i in range(10)], [], 40, 1))] and sum(r[4] is not None for r in got) == 2


def test_op12_on_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, op12.op12_importance_resampling(spark, SF).collect()), key=str) == plain_draw(docs, target, 10, 1)


# pages

WORDS = "the of Straße naïve and R&D <tag> it's “quote” word being less more text long señor".split()
NAV = "<ul class='top'><li><a href='/'>Home</a></li><li><a href='/b'>Business news of the whole world and more</a></li></ul>"
LONG = "We use cookies and similar means to give you the best experience on our site, to measure it, and for other ends. " * 2
TEMPLATES = [
    "<html><head><title>T</title><style>p{{}}</style></head><body><nav>" + NAV + "</nav><article>{0}</article><aside><p>" + LONG + "</p></aside><footer>&copy; Site</footer></body></html>",
    "<body><header><h2>Site</h2></header><div class='cookie-banner'><p>" + LONG + "</p></div><main>{0}</main><section id=comments><p>" + LONG + "</p><p>" + LONG + "</p></section></body>",
    "<body><div id='topMenu'>" + NAV + "</div><div id=wrap class='has-sidebar'><div class=col>{0}</div><div class='sidebar'><p>" + LONG + "</p></div></div><div>&copy; 2024 Site</div>",
    "<div role=navigation>" + NAV + "</div><div><div><section>{0}</section></div></div><form><p>" + LONG + "</p><input name=q></form><script>document.write('<p>" + LONG + "</p>')</script>",
    "<table><tr><td><a href=1>One link</a><td><article class='post'>{0}<div class='share-buttons'>Share on all of these sites</div><section class=comments><p>" + LONG + "</p></section></article></table><div hidden><p>" + LONG * 3 + "</p></div>",
    "<body><div class=topnav>" + NAV + "</div><div class='pageheader'><h1>The Site</h1></div><main><header>{0}</header></main><ol class='commentlist'><li><p>" + LONG + "</p></ol><div id='cookiebar'><p>" + LONG + "</p></div><div class=adbox>Buy</div>",
    "<body><div id=outer><div class='alert alert-info'>Site news</div><div class='post hentry'>{0}<div id=disqus_thread><p>" + LONG + "</p></div><div class='newsletter-signup'><p>" + LONG + "</p></div></div></div><div class='site-footer'><p>" + LONG + "</p></div>",
    "{0}",
]


def article(rnd):
    blocks = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 2, 30, 60, 90]))) for _ in range(rnd.randint(1, 14))] + [" ".join(rnd.choice(WORDS) for _ in range(60))]
    rnd.shuffle(blocks)
    out = []
    for k, x in enumerate(blocks):
        x = html.escape(x, quote=rnd.random() < 0.5).replace(" ", rnd.choice([" ", "\n  ", "&nbsp;", "<br>", " <!-- <p>no</p> -->"]), 2)
        tag = rnd.choice(["h1", "p"] if k == 0 else ["p", "p", "h2", "pre"])
        x = x.replace("word", "<b>word</b>").replace("text", "<a href='x>y'>text</a>")
        out.append(rnd.choice([f"<{tag}>{x}</{tag}>", f"<P class='lead with-ad'>{x}", f"<ul><li>{x}</li></ul>"] if k else [f"<{tag}>{x}</{tag}>"]))
        if rnd.random() < 0.2:
            out.append(rnd.choice(["<aside>Read this too</aside>", "<div class='ad slot'>Buy now</div>", "<script>var a = '<p>x</p>';</script>", "<!-- gone -->", "<noscript><p>Turn it on</p></noscript>"]))
    return "\n".join(out), "\n".join(blocks)


@pytest.mark.parametrize("template", range(len(TEMPLATES)))
def test_op13_finds_planted_articles(template):
    rnd = random.Random(template)
    for _ in range(150):
        inner, want = article(rnd)
        assert op13.main_text(TEMPLATES[template].format(inner)) == want


def test_op13_on_the_tables_and_edges(spark):
    def plain(source):
        inner = re.search("<article>(.*?)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(x).split()) for x in re.split("</?(?:h1|p)>", re.sub("</?b>", "", inner.replace("<br>", " "))))
        return "\n".join(x for x in blocks if x)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r.page_id, r.url, t := plain(r.html), len(t)) for r in pages.collect())
    assert sorted(map(tuple, op13.op13_html_extraction(spark, SF).collect())) == want
    odd = [(0, None, "x"), (1, "", "x"), (2, "<p", "x"), (3, "<nav>a</nav>", "x"), (None, "plain &lt;b&gt; text", "x"), (5, "<p>a &am b<p>c</p>", "x"), (5, "<p>a &am b<p>c</p>", "x"), (6, "<body><div class=comment><p>All there is</p></div>", "x"), (7, "a < b and 3 > 2", "x")]
    d = spark.createDataFrame(odd, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in op13.extract_text(d).collect()), key=str)
    texts = {0: "", 1: "", 2: "", 3: "", None: "plain <b> text", 5: "a &am b\nc", 6: "All there is", 7: "a < b and 3 > 2"}
    assert got == sorted(((i, texts[i], len(texts[i])) for i, *_ in odd), key=str)
    assert op13.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_op13_reads_odd_pages_in_linear_time():
    began = time.time()
    for x in ("<div>a" * 60_000, "<div><p>a b c</p>" * 20_000, "<a href='" * 60_000, "<a '>" * 60_001, "</div>" * 60_000, "<li class=ad>" * 60_000, "&lt;" * 300_000, "<script>" * 60_000, "<!--" * 60_000, "<" * 600_000):
        op13.main_text(x)
    assert time.time() - began < 30
