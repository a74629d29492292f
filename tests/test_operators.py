import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from offerloom.operators import crawl, extract, linking, maintenance, matching, prices, refresh
from offerloom.operators.numbering import numbered
from offerloom.sources import fetch, pages, scratch, snapshots
from offerloom.sources.buckets import Buckets


def test_greedy_linking_equals_a_plain_fold(spark):
    rnd = random.Random(4)
    item = lambda i: (i, rnd.choice(["", "", "s1", "s2", "s3"]), rnd.choice(["", "e1", "e2"]), rnd.choice(["", "t one", "t two", "t three"]))
    products, offers = [item(i) for i in (1, 2, 5)], [item(i) for i in range(10, 60)]
    known, want = [p for p in products], {}
    for o in offers:
        ranks = [(k, p[0]) for p in known for k in (1, 2, 3) if p[k] and p[k] == o[k]]
        ranks = [min((k for k, q in ranks if q == i), default=9) for i in [p[0] for p in known]]
        best = min(range(len(known)), key=lambda j: (ranks[j], known[j][0]))
        if ranks[best] == 9:
            known.append((max(p[0] for p in known) + 1, *o[1:]))
            want[o[0]] = known[-1][0]
        else:
            want[o[0]] = known[best][0]
    got = linking.link_offers(spark.createDataFrame(offers, "offer_id long, sku string, ean string, title string"), spark.createDataFrame(products, "id long, sku string, ean string, title string"))
    assert {r.offer_id: r.product_id for r in got.collect()} == want


def test_json_import_founds_one_product_for_each_group(spark, tmp_path):
    rows = [{"store": f"s{s}", "title": f"Product {p} in {s}", "url": f"u{p}-{s}", "price": 10.0 + p, "shipping": 4.99, "sku": f"SKU{p}", "ean": f"0{p}2345678"} for p in range(5) for s in range(4)]
    path = str(tmp_path / "offers.json")
    (tmp_path / "offers.json").write_text(json.dumps(rows))
    batch = snapshots.read_offers_json(spark, path)
    old = spark.createDataFrame([], "id long, product_id long, store string, url string, title string, price double, shipping double, total double, currency string, brand string, model string, sku string, ean string, mpn string, in_stock int, is_active int, retry_count int, last_error string, last_error_at timestamp, last_status_code int, fetched_at timestamp")
    now = F.lit("2024-01-01").cast("timestamp")
    first = snapshots.upsert(old, batch, now, reset=False)
    assert first.groupBy("op").count().collect() == [("inserted", 20)]
    offers = first.drop("op").withColumnRenamed("id", "offer_id")
    got = linking.link_offers(offers, offers.select(F.col("offer_id").alias("id"), "title", "sku", "ean").where("false"))
    assert got.count() == 20 and got.where("created").count() == 5
    again = snapshots.upsert(first.drop("op"), batch, now)
    assert again.where("op = 'updated' and is_active = 1 and retry_count = 0").count() == 20
    (tmp_path / "offers.json").write_text("{}")
    with pytest.raises(Exception, match="array"):
        snapshots.read_offers_json(spark, path).collect()


def test_upsert_takes_nulls_and_the_last_row(spark):
    old = spark.createDataFrame([(7, "a", "u", 1.0), (8, "a", "v", 2.0)], "id long, store string, url string, price double").withColumn("fetched_at", F.lit(None).cast("timestamp"))
    batch = spark.createDataFrame([(0, "a", "u", 5.0), (1, "a", "u", None), (2, None, "w", 3.0)], "pos int, store string, url string, price double")
    got = {(r.store, r.url): (r.id, r.price, r.op) for r in snapshots.upsert(old, batch, F.current_timestamp()).collect()}
    assert got == {("a", "u"): (7, None, "updated"), ("a", "v"): (8, 2.0, "kept"), (None, "w"): (9, 3.0, "inserted")}


def test_scored_match_rejects_before_identifiers(spark):
    q = spark.createDataFrame([(1, "s1", "Acme Phone X200 blue", "acme", "12345678")], "query_id long, store string, title string, brand string, ean string")
    offers = [(10, "s1", "Acme Phone X200 blue", "acme", None), (11, "s2", "other", "other", "12345678"), (12, "s2", "Phone X300", "", "12345678"), (13, "s2", "zzz", "", "0-12345678"), (14, "s3", "Phone acme X200 blue", "", None)]
    o = spark.createDataFrame(offers, "offer_id long, store string, title string, brand string, ean string").withColumns({"price": F.lit(1.0), "shipping": F.lit(0.0)})
    got = {r.offer_id: (r.match_score, r.match_reason, r.match_rank) for r in matching.compare_fallback(q, o).collect()}
    assert got == {13: (100, "EAN exact match", 1), 14: (80, "strong title overlap", 2)}


def test_fallback_finds_all_that_a_cross_product_finds(spark):
    rnd = random.Random(2)
    words = [f"word{c}" for c in "abcdefgh"]
    row = lambda i: (i, f"s{i % 3}", " ".join(rnd.sample(words, rnd.randint(1, 6))), rnd.choice(["", "b1", "b2"]), rnd.choice([None, "ABC", "ABD"]))
    q = spark.createDataFrame([row(i) for i in range(40)], "query_id long, store string, title string, brand string, sku string")
    o = spark.createDataFrame([row(i) for i in range(60)], "offer_id long, store string, title string, brand string, sku string").withColumns({"price": F.lit(1.0), "shipping": F.lit(0.0)})
    got = {(r.query_id, r.offer_id, r.match_score) for r in matching.compare_fallback(q, o).collect()}
    a, b = matching.scored_fields(q, "q_").withColumnRenamed("store", "qs").drop("title", "brand", "sku"), matching.scored_fields(o, "o_")
    every = a.crossJoin(b).withColumn("s", matching.score_of(matching.match_reason(F.col("qs"), F.col("store")))).where("s >= 75")
    assert got == {(r.query_id, r.offer_id, r.s) for r in every.collect()} and got


def test_compare_plans_have_no_cross_product(spark):
    from offerloom.plans import catalogue

    for name in ("compare_canonical", "compare_fallback", "canonical_match"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    plan = catalogue.QUERIES["price_outliers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "partial_count" in plan  # two rows of a product leave each task


def test_outliers_and_state(spark):
    r = spark.createDataFrame([(1, 10.0, 1), (1, 100.0, 2), (2, 5.0, 3), (3, 1.0, 4), (3, 40.0, 5)], "p long, price double, id long")
    assert [(x.p, x.price, x.second_price) for x in prices.price_outliers(r, "p", "price", ("id",)).collect()] == [(1, 10.0, 100.0)]
    s = maintenance.migrated(spark.createDataFrame([(1, 3), (2, None)], "offer_id long, retry_count int"))
    assert [(x.offer_id, x.is_active) for x in maintenance.mark_stale(s, 0).orderBy("offer_id").collect()] == [(1, 0), (2, 1)]


def test_pages(spark):
    html = "<header><a href='/h'>h</a></header><main>one <a href='/fi/Product/List/000-1/x?fq=1'>a <b>b</b></a></main><main>two</main>"
    r = spark.createDataFrame([(html, '"pid":"5","name":"N\\u00e4ytt\\u00f6 1"')], "h string, j string")
    got = r.select(pages.main_content(F.col("h")), pages.anchors(F.col("h")), pages.embedded_products(F.col("j"), "power.fi")).first()
    assert got[0].startswith("<main>one ") and got[0].endswith("\n<main>two</main>") and [tuple(x) for x in got[1]] == [("/h", "h"), ("/fi/Product/List/000-1/x?fq=1", "a b")]
    assert got[2] == ["https://www.power.fi/naytto-1/p-5/"]
    assert r.select(pages.sitemap_urls(F.lit("<LOC> a&amp;b </LOC><loc></loc>"))).first()[0] == ["a&b"]


def test_product_records(spark):
    ld = {"@type": ["Thing", "PRODUCT"], "name": "N", "offers": {"price": 0, "shippingDetails": {"shippingRate": {"value": "3.5"}}, "availability": "SoldOut"}}
    rows = [
        ("a", f"<script type='application/ld+json'>{json.dumps({'mainEntity': ld})}</script><h1>T</h1><p class='price'>12,50 €</p>"),
        ("b", "<h1>T</h1><p data-price='1 299,00 €'></p><div class='shipping-cost'>Ilmainen</div><p class='availability'>Unavailable</p>"),
        ("c", None),
        ("d", "<p class=price>x<script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"Z\",\"offers\":{\"shippingDetails\":{\"shippingRate\":null}}}</script>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string").withColumn("store", F.lit("jimms.fi"))
    got = {r.url: r.product for r in extract.product_records(df).collect()}
    assert (got["a"].title, got["a"].price, got["a"].shipping, got["a"].total, got["a"].in_stock) == ("N", 12.5, 3.5, 16.0, False)
    assert (got["b"].price, got["b"].shipping, got["b"].in_stock) == (1299.0, 0.0, True)
    assert (got["c"].title, got["c"].price, got["c"].shipping, got["c"].currency) == ("", None, 0.0, "EUR")
    assert got["d"].title == ""
    assert {r.url: r.product.title for r in extract.product_records(df, browser=True).collect()}["a"] == "T"
    assert not {r.url: r.product for r in extract.product_records(df, strict_stock=True).collect()}["b"].in_stock


def test_stores_without_selectors_and_the_browser_side(spark):
    ld = json.dumps({"@type": "Product", "name": "N", "sku": "S"})
    page = f"<script type='application/ld+json'>{ld}</script><div class='product-title'>G</div><p class='price'>5 kr</p><p><p><p><b itemprop='gtin13'>99</b><i data-testid='x-brand'>B</i>"
    df = spark.createDataFrame([("a", "amazon.de", page), ("b", "power.fi", page), ("c", "power.fi", "<h2 class='product-title'>G</h2><p>")], "url string, store string, html string")
    got = {r.url: r.product for r in extract.product_records(df).collect()}
    assert got["a"] is None and got["b"].title == "N" and (got["b"].currency, got["b"].ean, got["c"].title) == ("EUR", "99", "")
    got = {r.url: r.product for r in extract.product_records(df, browser=True).collect()}
    assert got["a"] is None and (got["b"].title, got["b"].currency, got["b"].sku, got["b"].ean, got["b"].brand) == ("N", "SEK", "S", "99", "B") and got["c"].title == "G"
    assert [r.url for r in extract.product_records(df).where(extract.is_valid(F.col("product"))).collect()] == ["b"]
    assert extract.product_records(df.where("store = 'amazon.de'")).count() == 1


def test_many_open_elements_are_read_in_linear_time():
    page = extract.Page("<p>" * 20000 + "x " * 20000)
    assert page.text(page.elements[-1]).count("x") == 20000


def test_links_of_a_shop(spark):
    html = """<a href='/fi/Product/List/000-1/x'></a><a href='/fi/Product/List/000-1/x'>Best</a><a href='/fi/Product/List/000-1/x?fq=1'>no</a><link href='/fi/Product/List/000-2/y/'>
      <a href='/fi/Product/Show/5/a?x'>p</a> "https:\\/\\/www.jimms.fi\\/fi\\/Product\\/Show\\/6\\/b" {"href":"/fi/Product/List/000-3/z","q":1,"title":"Z"} <a href='/fi/Product/List/000-1/x?page=2'>2</a><a href='/fi/Product/List/000-2/x?page=3'>3</a>"""
    r = spark.createDataFrame([(html,)], "h string").select(pages.category_links(F.col("h")), pages.product_links(F.col("h")), pages.pagination_links(F.col("h"), F.lit("https://www.jimms.fi/fi/Product/List/000-1/x"))).first()
    base = "https://www.jimms.fi/fi/Product"
    assert [tuple(x) for x in r[0]] == [(f"{base}/List/000-1/x", "Best"), (f"{base}/List/000-3/z", "Z"), (f"{base}/List/000-2/y", "")]
    assert r[1] == [f"{base}/Show/5/a", f"{base}/Show/6"] and r[2] == [f"{base}/List/000-1/x?page=2"]
    blocks = "<nav>n</nav><div class='a listing'>one</div>x<section id='Results'>two</section>"
    assert spark.createDataFrame([(blocks,)], "h string").select(pages.main_content(F.col("h"))).first()[0] == "<div class='a listing'>one</div>\n<section id='Results'>two</section>"


def test_short_categories_score_by_the_whole_address(spark):
    links = [("https://www.jimms.fi/fi/Product/List/B1/a", f"/fi/Product/List/B2{x}") for x in ("/b/c", "/b/c/d")]
    got = [r.score for r in pages.ranked_categories(spark.createDataFrame(links, "parent string, link string")).orderBy("rank").collect()]
    assert got == [7, 5]


def test_sources_in_turn_and_caps(spark):
    a = spark.createDataFrame([("s", "u1"), ("s", "u1"), ("s", "k"), ("s", "u2"), ("s", "u3")], "store string, url string").withColumns({"file": F.lit(0), "pos": F.monotonically_increasing_id()}).coalesce(1)
    b = spark.createDataFrame([("s", "z"), ("t", "z")], "store string, url string").withColumns({"file": F.lit(0), "pos": F.lit(0).cast("long")})
    both = pages.first_source(a, b)
    assert {(r.store, r.source) for r in both.select("store", "source").distinct().collect()} == {("s", 0), ("t", 1)}
    rows = spark.createDataFrame([("s", "u1", 0, 0), ("s", "u1", 0, 1), ("s", "k", 0, 2), ("s", "u2", 0, 3), ("s", "u3", 0, 4), ("s", "u3", 1, 0), ("t", "v", 0, 0)], "store string, url string, file int, pos int")
    kept, counts = pages.capped_urls(rows, spark.createDataFrame([("s", "k")], "store string, url string"), 2, ("file", "pos"))
    assert {(r.store, r.url, r.n) for r in kept.collect()} == {("s", "u1", 1), ("s", "u2", 2), ("t", "v", 1)}
    assert {(r.store, r.looked_at) for r in counts.collect()} == {("s", 5), ("t", 1)}


def test_crawl_keeps_its_budgets(spark):
    base = "https://www.jimms.fi/fi/Product"
    link, show = (lambda n, q="": f"<a href='/fi/Product/List/{n}/x{q}'>l</a>"), lambda n: f"<a href='/fi/Product/Show/{n}'>p</a>"
    rows = {
        "A": link("B") + link("C") + show(1) + link("A", "?page=2"), "A?page=2": show(2) + show(1), "A?page=3": show(3),
        "B": show(4) + link("D"), "C": show(1) + show(5) + link("A"), "D": show(6) + link("E"), "E": show(7), "E?page=2": show(8),
    }
    at = lambda n: f"{base}/List/{n[0]}/x{n[1:]}"
    site = crawl.site(spark.createDataFrame([*((at(n), f"<main>{h}</main>") for n, h in rows.items()), (None, "x"), ("https://www.jimms.fi/fi", link("Z"))], "url string, html string"))
    known = spark.createDataFrame([(f"{base}/Show/4",)], "url string")
    queue = spark.createDataFrame([(at("A"), 5), (at("Q"), 4), (at("A"), 1)], "url string, score int")

    def run(**limits):
        got = crawl.crawl_categories(site, queue, known, **limits)
        depths = {r.url.split("/")[-2]: r.depth for r in got.categories.collect()}
        return [r.url.rsplit("/")[-1] for r in got.products.orderBy("place").collect()], depths, got.pages.count()

    assert run() == (["1", "2", "3", "5", "6", "7", "8"], {"A": 0, "Q": 0, "B": 1, "C": 1, "D": 2, "E": 3}, 8)
    assert run(depth=0) == (["1", "2", "3"], {"A": 0, "Q": 0}, 3)
    assert run(depth=2, budget=1)[0] == ["1", "2", "5", "6"] and run(budget=3)[0] == ["1", "2", "3", "5", "6", "7", "8"]
    assert run(per_category=1)[0] == ["1", "5", "6", "7"] and run(products=2)[0] == ["1", "2"]
    assert run(categories=3)[1] == {"A": 0, "Q": 0, "B": 1} and run(noisy=1)[1] == {"A": 0, "Q": 0, "B": 1, "D": 2, "E": 3}
    none = site.where("false")
    assert crawl.crawl_categories(none, queue, known).products.count() == 0


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert [(r.k, r.n) for r in numbered(df, "k").orderBy("k").collect()] == [(k, k + 1) for k in range(1000)]
    assert numbered(df.where("false"), "k").count() == 0


def test_tables_of_a_run_are_deleted(spark, tmp_path):
    with scratch.run_folder(spark) as folder:
        kept = scratch.stored(spark.range(5), "kept")
        numbered(kept.withColumnRenamed("id", "k"), "k").write.parquet(f"{tmp_path}/out")
        at = Path(folder.removeprefix("file:").replace("//", "/"))
        assert scratch.scratch_dir(spark) == folder and sum(1 for _ in at.iterdir()) == 2
    assert not at.exists() and scratch.scratch_dir(spark) != folder and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_requests(spark):
    r = spark.createDataFrame([(1, " T ", ["b", "c"], " 007 ", "1.299,00"), (2, None, [], "a7", "5,5 e"), (3, "", None, None, "x")], "q int, title string, brand array<string>, sku string, price string")
    got = refresh.request_fields(r).orderBy("q").collect()
    assert [tuple(x) for x in got] == [(1, "T", "b", "", 1.299), (2, "", "", "a7", 5.5), (3, "", "", "", None)]


def test_jobs_choose_their_offers(spark):
    rows = [(1, 9, "A", "Tv one", "u1", 10.0, 1, None), (2, 9, "A", "tv two", "u2", 100.0, None, None), (3, 9, "A", "x", "", 1.0, 1, None), (4, 8, "A", "TV", "u4", 1.0, 0, None)]
    o = spark.createDataFrame(rows, "id long, product_id long, store string, title string, url string, price double, is_active int, fetched_at timestamp")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(refresh.known_offers(o)) == [1, 2] and ids(refresh.offers_by_title(o, "tv")) == [1, 2, 4] and ids(refresh.suspicious_offers(o)) == [1]
    asked = refresh.offers_by_url(o, spark.createDataFrame([("u1",), ("u1",), ("zz",), (None,)], "url string"))
    assert {(r.url, r.id) for r in asked.collect()} == {("u1", 1), ("zz", None)}
    m = spark.createDataFrame([(1, f"u{k}", k) for k in range(1, 6)], "query_id int, url string, match_rank int")
    assert refresh.requested(m, limit=9).count() == 3 and refresh.requested(m, limit=0).count() == 1


def test_refresh_and_its_stream(spark, tmp_path):
    now = F.lit("2024-01-31").cast("timestamp")
    page = lambda p: f"<h1>T{p}</h1><p class='price'>{p},50 €</p><div class='availability'>varastossa</div>"
    offers = spark.createDataFrame([(1, "www.jimms.fi", "https://jimms.fi/1"), (2, "power.fi", "https://power.fi/2"), (3, "x.de", "https://x.de/3"), (4, "power.fi", "https://evil.com/4")], "id long, store string, url string")
    for f in snapshots.OFFERS.split(", "):
        name, kind = f.split(" ")
        if name not in offers.columns:
            offers = offers.withColumn(name, F.lit(None).cast(kind))
    raw, products = (spark.createDataFrame([], s) for s in (snapshots.RAW_PRODUCTS, snapshots.PRODUCTS))
    pages_ = spark.createDataFrame([("https://jimms.fi/1", page(1), 200, "OK"), ("https://power.fi/2", None, 503, "Busy"), ("https://evil.com/4", page(4), 200, "OK")], "url string, html string, status int, status_text string")
    done = refresh.refresh(offers, raw, products, refresh.known_offers(offers), pages_, now, unsupported="failed")
    got = {r.url: r for r in done.results.collect()}
    assert {u: r.status for u, r in got.items()} == {"https://jimms.fi/1": "refreshed", "https://power.fi/2": "failed", "https://x.de/3": "failed", "https://evil.com/4": "failed"}
    assert got["https://power.fi/2"].error == "Power request failed: 503 Busy" and got["https://power.fi/2"].status_code == 503 and not got["https://jimms.fi/1"].was_updated
    rows = {(r.store, r.url): r for r in done.offers.collect()}  # the store's name as the extractor writes it is another key
    assert len(rows) == 5 and rows["jimms.fi", "https://jimms.fi/1"].id == 5 and rows["jimms.fi", "https://jimms.fi/1"].price == 1.5 and rows["jimms.fi", "https://jimms.fi/1"].in_stock == 1
    assert rows["power.fi", "https://power.fi/2"].retry_count == 1 and rows["x.de", "https://x.de/3"].retry_count == 0
    assert [r.title for r in done.products.collect()] == ["T1"] and rows["jimms.fi", "https://jimms.fi/1"].product_id == 1 and done.raw.count() == 1
    store = refresh.Store(f"file://{tmp_path}", buckets=16)
    store.begin(offers, raw, products)
    asked = [["https://jimms.fi/1", "nowhere", None], ["https://power.fi/2", "https://jimms.fi/1"], ["https://power.fi/2", "https://evil.com/4", ""]]
    for k, urls_ in enumerate(asked):
        spark.createDataFrame([(u,) for u in urls_], "url string").coalesce(1).write.json(f"file://{tmp_path}/asked/{k}")
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"file://{tmp_path}/asked")
    refresh.refresh_stream(stream, store, pages_, now, f"file://{tmp_path}/state").awaitTermination()
    results = [{r.url: r.status for r in spark.read.parquet(store.results(v)).collect()} for v in (1, 2, 3)]
    assert results == [{"https://jimms.fi/1": "refreshed", "nowhere": "missing"}, {"https://power.fi/2": "failed", "https://jimms.fi/1": "refreshed"}, {"https://power.fi/2": "failed", "https://evil.com/4": "failed"}]
    state = {r.url: r for r in store.offers.read(spark, 3).where("store <> 'www.jimms.fi'").collect()}
    assert state["https://power.fi/2"].retry_count == 2 and state["https://evil.com/4"].retry_count == 1 and state["https://jimms.fi/1"].product_id == 1
    assert store.offers.read(spark, 3).count() == 5 and store.products.read(spark, 3).count() == 1 and store.raw.read(spark, 3).count() == 1
    # a version holds the buckets of the addresses that it changed, and no others
    bucket = {r.url: r.b for r in offers.select("url", store.offers.number().alias("b")).collect()}
    held = lambda t, v: sorted(t._folders(spark, t._path(v), "bucket="))
    assert [held(store.offers, v) for v in (1, 2, 3)] == [sorted({bucket[u] for u in us if u in bucket}) for us in asked]
    assert held(store.products, 3) == [] and store.offers.top(spark, 3) == 5


def test_buckets_keep_versions(spark, tmp_path):
    t = Buckets(f"file://{tmp_path}/t", "id long, url string, x int", 32)
    rows = lambda *x: spark.createDataFrame([(i, f"u{i}", v) for i, v in x], t.schema)
    assert t.write(rows(*((i, 0) for i in range(200))), 0) == 199
    batch = rows((3, 1), (70, 1), (140, 1))
    touched = t.touched(batch)
    before = t.read(spark, 0, touched)
    assert len(touched) <= 3 and before.count() < 60 and set(t.touched(before)) == set(touched)
    merged = before.join(batch.select("id"), "id", "left_anti").unionByName(batch)
    for _ in range(2):  # a batch that runs again replaces its version
        assert t.write(merged, 1, t.top(spark, 0)) == 199
    assert sorted(t._folders(spark, t._path(1), "bucket=")) == touched
    assert t.read(spark, 1).where("x = 1").count() == 3 and t.read(spark, 1).count() == 200 and t.read(spark, 0).where("x = 1").count() == 0
    (tmp_path / "t" / "v=00000002" / "bucket=0").mkdir(parents=True)  # a write that did not end
    assert t.versions(spark) == [0, 1] and t.read(spark, 5).count() == 200
    assert t.vacuum(spark, 1) == len(touched) and t.read(spark, 1).count() == 200 and t.vacuum(spark, 1) == 0
    empty = Buckets(f"file://{tmp_path}/e", t.schema)
    assert empty.write(rows(), 0) == 0 and empty.read(spark, 0).count() == 0 and empty.read(spark, 0, [1]).columns == ["id", "url", "x"]


def test_tables_are_created_once_and_checked(spark):
    snapshots.create_tables(spark, "shop_test")
    snapshots.create_tables(spark, "shop_test")
    assert spark.table("shop_test.offers").columns[:3] == ["id", "product_id", "store"] and spark.table("shop_test.products").count() == 0
    spark.sql("DROP DATABASE shop_test CASCADE")
    with pytest.raises(Exception, match="required"):
        snapshots.checked(spark.createDataFrame([(None,)], "title string"), "products").collect()


def plain_fold(offers):
    """Whom each offer (id, keys in the order of rank) joins, one after the other."""
    first, out = {}, {}
    for i, keys in sorted(offers):
        found = next((first[k] for k in keys if k in first), None)
        out[i] = i if found is None else found
        if found is None:
            for k in keys:
                first[k] = i
    return out


@pytest.mark.parametrize(("per_range", "rounds"), [(10_000, 1), (600, 6)])
def test_linking_of_a_real_chain(spark, monkeypatch, per_range, rounds):
    # offer i has the sku of i - 1 and i, so each of a thousand hangs on the one before
    chain = [(i, f"K{i - i % 2}", f"t{i + i % 2}") for i in range(1000)]
    hot = [(2000 + i, "hot", f"hot{i}") for i in range(300)]
    seen = []
    plain = linking.stored
    monkeypatch.setattr(linking, "stored", lambda df, name, *a, **k: (seen.append(name), plain(df, name, *a, **k))[1])
    offers = spark.createDataFrame(chain + hot, "offer_id long, sku string, title string")
    got = {r.offer_id: (r.product_id, r.created) for r in linking.link_offers(offers, spark.createDataFrame([], "id long, sku string, title string"), per_range).collect()}
    want = plain_fold([(i, (f"sku {s}", f"title {t}")) for i, s, t in chain + hot])
    number = {i: n for n, i in enumerate(sorted({f for f in want.values()}), 1)}
    assert got == {i: (number[f], i == f) for i, f in want.items()}
    assert seen.count("founders") <= rounds


def test_linking_equals_the_fold_in_any_ranges(spark):
    rnd = random.Random(4)
    rows = [(i, f"s{rnd.randint(0, 60)}" if rnd.random() < 0.6 else "", f"t{rnd.randint(0, 90)}" if rnd.random() < 0.8 else "") for i in range(250)]
    offers = spark.createDataFrame(rows, "offer_id long, sku string, title string")
    keys = linking.canonical_keys(offers, "offer_id").select("id", F.struct("rank", "key").alias("key"))
    want = plain_fold([(i, [k for k in (s and f"sku {s}", t and f"title {t}") if k]) for i, s, t in rows])
    founds = {f for i, f in want.items() if f == i and (rows[i][1] or rows[i][2])}
    for per_range in (40, 1000):
        assert {r.id for r in linking.founders(keys, keys.where("false"), per_range).collect()} == founds


def test_failed_offers_come_newest_first(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    rows = [(1, 0, None, None, 404, "2020-01-01"), (2, 1, "e", "2024-01-30", 500, None), (3, 2, "e", "2024-01-30", 500, None), (4, 9, "e", "2024-01-01", 500, None), (5, 0, "e", None, None, "2024-01-29")]
    df = spark.createDataFrame(rows, "offer_id int, retry_count int, last_error string, last_error_at string, last_status_code int, fetched_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("last_error_at", "fetched_at")})
    assert [r.offer_id for r in maintenance.failed(df, now).collect()] == [3, 2, 5, 1]


def test_fetched_pages_keep_their_status(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Shop(BaseHTTPRequestHandler):
        def do_GET(self):
            gone = self.path == "/gone"
            self.send_response(404 if gone else 200)
            self.send_header("content-type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"" if gone else f"<h1>Näyttö {self.headers['user-agent']}</h1>".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Shop)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    wanted = spark.createDataFrame([(f"{base}/a",), (f"{base}/a",), (f"{base}/gone",), ("http://127.0.0.1:1/x",), ("file:///etc/hosts",), (None,)], "url string")
    got = {r.url: r for r in fetch.fetch_pages(wanted, "test", timeout_ms=3000, delay_ms=0).collect()}
    server.shutdown()
    assert len(got) == 3 and (got[f"{base}/a"].html, got[f"{base}/a"].status) == ("<h1>Näyttö test</h1>", 200)
    assert (got[f"{base}/gone"].html, got[f"{base}/gone"].status, got[f"{base}/gone"].status_text) == (None, 404, "Not Found") and got["http://127.0.0.1:1/x"].status is None


def test_summaries_add_up(spark):
    a = spark.createDataFrame([(1, 2.0)], "inserted long, failed double")
    b = spark.createDataFrame([(4, float("nan"), 3)], "inserted long, failed double, updated long")
    assert maintenance.merged_summary(a, b).first().asDict() == {"inserted": 5, "failed": 2.0, "updated": 3}
