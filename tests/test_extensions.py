"""Sketches, VARIANT records, the links' table function and the category tree, on small tables with odd rows."""

import random
import time

from pyspark.sql import functions as F

from offerloom.functions import links, variants
from offerloom.operators import extract, sketches
from offerloom.sources import pages

BASE = "https://www.jimms.fi/fi/Product"


def test_sketches_merge_to_those_of_all_rows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(1, 3), rnd.randint(0, 4000), rnd.gauss(100, 20)) for _ in range(20000)] + [("z", 1, None, None)]
    d = spark.createDataFrame(rows, "g string, m int, user long, price double").repartition(4)
    parts = [sketches.sketched(d.where(w), ("g", "m"), "user", "price") for w in ("m < 3", "m >= 3")]
    cube = sketches.cubed(sketches.combined(("g", "m"), *parts), ("g", "m"))
    got = {(r.g, r.m, r.level): r for r in cube.select("g", "m", "level", "n", sketches.distinct_count().alias("users"), sketches.quantile(0.5).alias("median"), sketches.quantile(0.9).alias("high")).collect()}
    groups = {(g, m, 0) for g, m, *_ in rows} | {(g, None, 1) for g, *_ in rows} | {(None, m, 2) for _, m, *_ in rows} | {(None, None, 3)}
    assert set(got) == groups
    for (g, m, level), r in got.items():
        mine = [x for x in rows if (level & 2 or x[0] == g) and (level & 1 or x[1] == m)]
        users, prices = {x[2] for x in mine} - {None}, sorted(x[3] for x in mine if x[3] is not None)
        assert r.n == len(mine) and abs(r.users - len(users)) <= max(1, 0.06 * len(users))
        for value, q in ((r.median, 0.5), (r.high, 0.9)):
            assert value is None if not prices else abs(sum(p <= value for p in prices) / len(prices) - q) <= 0.03
    assert sketches.cubed(sketches.sketched(d.where("false"), ("g",), "user", "price"), ("g",)).where("level = 0").count() == 0


def test_variants_keep_what_is_no_json_apart(spark, tmp_path):
    rows = [(1, '{"title": "T", "price": 5, "inStock": true, "x": [1]}'), (2, "no json"), (3, None), (4, '{"title": 7, "price": "dear", "inStock": null}'), (5, "[]"), (6, '{"title": "T", "title": "U"}')]
    d = spark.createDataFrame(rows, "id int, j string").select("id", variants.parsed(F.col("j")).alias("v"))
    d.write.parquet(f"{tmp_path}/v")
    got = {r.id: r.r for r in spark.read.parquet(f"{tmp_path}/v").select("id", variants.record(F.col("v")).alias("r")).collect()}
    assert (got[1].title, got[1].price, got[1].in_stock, got[1].brand) == ("T", 5.0, True, None)
    assert (got[4].title, got[4].price, got[4].in_stock) == ("7", None, None) and all(set(got[k]) == {None} for k in (2, 3, 5, 6))
    ld = [(1, '{"@type": "product", "name": "A", "brand": "B", "offers": {"price": "7.5", "priceCurrency": "EUR"}}'), (2, '{"@graph": [{"@type": "Product", "name": "C", "brand": {"name": "D"}, "offers": [{"price": 3}]}]}'), (3, '{"mainEntity": {"@type": "Product", "sku": "s"}}'), (4, '{"@type": "Thing"}')]
    shown = spark.createDataFrame(ld, "id int, j string").select("id", variants.ld_product(variants.parsed(F.col("j"))).alias("p")).orderBy("id").collect()
    assert [None if r.p is None else tuple(r.p) for r in shown] == [("A", "B", None, 7.5, "EUR"), ("C", "D", None, 3.0, None), (None, None, "s", None, None), None]


HTML = [
    "<a href='/a'>x</a><A class=k HREF = \"b?c\" >two <b>bold</b>\n </A><article data-href='no' href='/art'>in</a> <a>none</a><a href='/open'>never closed",
    "<a href='/x' href='/y'>last wins</a><a title='>' href='/z'>z</a><a href=''>empty</a> <a href='/q\">'>mixed</a><a href='/fi/Product/List/000-1/x'>K &amp; k</a>",
    '{"url": "/fi/Product/List/000-2/y", "id": 1, "name": "N"} {"href":"/fi/Product/List/000-3/z"} <link href="/fi/Product/List/000-1/x">',
    "<a href='/fi/Product/List/000-1/x'></a><a href='/fi/Product/List/000-1/x/'>Second</a><a href='/fi/Product/List/000-4/w?fq=1'>facet</a><nav><a\nhref='/fi/Product/List/000-5/v'><img></a></nav>",
    "", None, "<a", "<a href='/é'>Ä ö</a><a href='/İ'>İ</a><a href='/k'>KK</a>",
]


def test_links_equal_the_expressions(spark):
    d = spark.createDataFrame([(i, f"{BASE}/List/000-{i}/p", h) for i, h in enumerate(HTML)], "page_id int, url string, html string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(links.page_links(d)) == rows(pages.page_links(d)) and links.page_links(d).count() > 10
    by_array = d.select("url", F.explode(pages.category_links(F.col("html"))).alias("x")).select("url", F.col("x.url").alias("link"), "x.label")
    assert rows(links.category_links(d)) == rows(by_array) and by_array.count() > 5
    assert links.page_links(d.where("false")).count() == 0


def test_many_open_anchors_are_read_in_linear_time():
    began = time.time()
    for x in ("<a href='x'>" * 60_000, "<a href='x'" * 60_000, "<a " * 60_000, "<a href='x'>y</a>" * 60_000, "<a><b>" * 60_000):
        list(links.anchors_of(x))
    assert time.time() - began < 10


def test_category_tree_has_each_category_once(spark):
    edges = [("r", "a"), ("r", "bb"), ("a", "c"), ("bb", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "c"), ("c", "r"), ("a", "a"), ("x", "y"), ("y", "x"), (None, "q"), ("a", None)]
    got = pages.category_tree(spark.createDataFrame(edges, "parent string, link string"), spark.createDataFrame([("r",)], "url string"), depth=4)
    rows = got.collect()
    assert {r.url: (r.parent, r.depth) for r in rows} == tree_of(edges, "r", 4) and len(rows) == len({r.url for r in rows}) == 6


def tree_of(edges, root, depth):
    out, front = {root: (None, 0)}, [root]
    for d in range(1, depth + 1):
        new = {}
        for p, c in edges:
            if p in front and c is not None and c not in out:
                new[c] = min(new.get(c, (99, "")), (len(p), p))
        out |= {c: (p, d) for c, (_, p) in new.items()}
        front = list(new)
    return out


def test_selectors_take_elements_in_their_order():
    page = extract.Page("<h1>one</h1><h1 itemprop='name'>two</h1><span class='a product-name'>three</span><i data-sku='9'>s</i><b data-testid='x-sku' content='t'>u</b>")
    assert page.values(["h1[itemprop='name']", ".product-name", "h1"], "content") == ["two", "three", "one"]
    assert page.values(["[data-sku]", "[data-testid*='sku']"], "content") == ["s", "t"] and page.marked() == {"sku": "t"}
    assert [e.tag for e in page.all("[data-testid*='sku']")] == ["b"] and not list(page.all("p"))
