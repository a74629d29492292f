"""Queries over stored offers and their sources: crawls, refresh streams over bucketed tables, jobs, selectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import crawl, extract, linking, refresh
from ..sources import pages, snapshots
from ..sources.scratch import scratch_dir, stored
from .catalogue import ADDRESS_SQL, ANCHORS_SQL, LINK_SCORE_SQL, REFRESHED_SQL, SITE_LINKS, bare_offers, shop, store_site
from .registry import SQL, query
from .views import OFFERS_SQL, PRODUCTS_SQL, dealt, offers, products, table

_LIST = "https://www.jimms.fi/fi/Product/List/B"
#: Limits of the crawl query: at the larger sizes each of them cuts.
CATEGORIES, PER_CATEGORY, BUDGET, PRODUCTS = 70, 3, 40, 150
#: Rows of a bucket of the refresh stream's tables.
PER_BUCKET = 200_000


def paged_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop's pages (url, html): one for each brand, and numbered ones with three parts each for the sizes of a brand."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
    link = F.format_string("<a href='/fi/Product/List/B%s/koko %s/'>Koko %s</a>", "b", "size", "size")
    brands = p.groupBy("b").agg(F.concat(F.lit("<nav><a href='/fi/Product/List/X1/out'>x</a></nav><main>"), joined(link), F.lit("</main>")).alias("html")).select(F.concat(F.lit(_LIST), "b", F.lit("/merkki")).alias("url"), "html")
    of = p.groupBy("b", "size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts")).select("b", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 3).cast("int")), lambda k: F.slice("parts", k * 3 + 1, 3))).alias("n", "parts"))
    shown = F.array_join(F.transform("parts", lambda k: F.concat(F.lit("<a href='/fi/Product/Show/"), k.cast("string"), F.lit("/osa'>o</a>"))), "")
    at = F.concat(F.lit(_LIST), "b", F.lit("/koko%20"), "size", F.when(F.col("n") > 0, F.concat(F.lit("?page="), (F.col("n") + 1).cast("string"))).otherwise(""))
    return brands.union(of.select(at, F.concat(F.lit("<main>"), shown, F.lit("<a href='/fi/Product/List/B"), F.col("b"), F.lit("/merkki'>takaisin</a></main>"))))


@query(f"""
WITH p AS (SELECT p_partkey, p_size AS size, regexp_extract(p_brand, '([0-9]+)', 1) AS b, (row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1) // 3 + 1 AS n, (row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1) % 3 AS pos FROM part),
r0 AS (SELECT b, '{_LIST}' || b || '/merkki' AS url, row_number() OVER (ORDER BY length('{_LIST}' || b || '/merkki'), b) AS place FROM (SELECT DISTINCT b FROM p)),
c1 AS (SELECT DISTINCT b, size, '{_LIST}' || b || '/koko%20' || size AS url FROM p), n0 AS (SELECT count(*) AS n FROM r0),
k1 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY length(url), url) AS k FROM c1),
r1 AS (SELECT * FROM (SELECT b, size, url, row_number() OVER (ORDER BY length(url), url) AS place FROM k1 WHERE k <= 100) WHERE place <= {CATEGORIES} - (SELECT n FROM n0)),
g AS (SELECT DISTINCT place, r1.url, b, size, n FROM r1 JOIN p USING (b, size) WHERE n <= {PER_CATEGORY}),
q AS (SELECT *, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (ORDER BY place, n) AS extra FROM g),
s AS (SELECT p_partkey, q.place, q.n, pos FROM q JOIN p USING (b, size, n) WHERE (n = 1 OR extra <= {BUDGET}) AND p_partkey % 10 <> 0)
SELECT CAST(row_number() OVER (ORDER BY place, n, pos) AS INTEGER) AS place, 'https://www.jimms.fi/fi/Product/Show/' || p_partkey || '/osa' AS url FROM s ORDER BY place LIMIT {PRODUCTS}""")
def category_crawl(spark, sf_dir):
    """The new products that a crawl of the shop from its brands finds, as its budgets allow; every tenth is known."""
    shown = stored(paged_site(spark, sf_dir), "shop", compression="zstd")
    known = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("https://www.jimms.fi/fi/Product/Show/"), F.col("p_partkey").cast("string"), F.lit("/osa")).alias("url"))
    queue = shown.where(F.col("url").endswith("/merkki")).select("url", pages.keyword_score(F.col("url"), F.lit("")).alias("score"))
    return crawl.crawl_categories(crawl.site(shown), queue, known, categories=CATEGORIES, per_category=PER_CATEGORY, budget=BUDGET, products=PRODUCTS).products


@query(f"""
WITH RECURSIVE {SITE_LINKS}, w AS (SELECT 'https://www.jimms.fi/fi' AS url, 0 AS depth UNION SELECT link, depth + 1 FROM w JOIN links l ON l.url = w.url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY url""")
def crawl_depths(spark, sf_dir):
    """How many steps each address of a shop is from its front page, by a crawl of three rounds over its pages' links."""
    found = store_site(spark, sf_dir).select(F.col("url").alias("parent"), F.explode(pages.category_links(F.col("html"))).alias("x")).select("parent", F.col("x.url").alias("link"))
    front = table(spark, sf_dir, "nation").agg(F.lit("https://www.jimms.fi/fi").alias("url"))
    return pages.crawl(stored(found, "links"), front, pages=None)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS title, p_brand AS brand, CAST(NULL AS VARCHAR) AS model, 'SKU-' || p_partkey AS sku, CAST(p_partkey AS BIGINT) AS offer, 'u' || p_partkey AS url, CAST(0 AS BIGINT) AS n_raw FROM part")
def stored_tables(spark, sf_dir):
    """The parts as rows of the library's own tables, made in a database of their own, filled, read and dropped."""
    name = f"offers_{uuid.uuid4().hex}"
    snapshots.create_tables(spark, name)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"))
    columns = lambda rows, t: snapshots.checked(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast(k)).alias(c) for c, k in spark.table(f"{name}.{t}").dtypes]), t)
    columns(p, "products").write.insertInto(f"{name}.products")
    columns(bare_offers(p.select("id", F.lit("jimms.fi").alias("store"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))), "offers").write.insertInto(f"{name}.offers")
    raw = spark.table(f"{name}.raw_store_products").agg(F.count("*").alias("n_raw"))
    both = spark.table(f"{name}.products").join(spark.table(f"{name}.offers").select(F.col("id").alias("offer"), "url"), F.col("id") == F.col("offer"))
    out = stored(both.select("id", "title", "brand", "model", "sku", "offer", "url", raw.scalar().alias("n_raw")), "tables")
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return out


def buckets_for(rows: int) -> int:
    """So many buckets that one fits a task and that all cores have some to write in a large table."""
    return max(8, -(-rows // PER_BUCKET))


def _streamed(spark: SparkSession, sf_dir: str, batches: int = 3) -> tuple[refresh.Store, int]:
    """The shop's offers after a stream that asks for all addresses in batches; the store and its last version."""
    shown, old, raw, catalogue, fetched, now = shop(spark, sf_dir)
    root = f"{scratch_dir(spark)}/refresh-{uuid.uuid4().hex}"
    store = refresh.Store(root, buckets=buckets_for(table(spark, sf_dir, "part").count()))
    store.begin(old, raw, catalogue)
    # each file is a batch; its name orders it
    shown.select("url", F.pmod("id", F.lit(batches)).alias("batch")).repartition(batches, "batch").write.partitionBy("batch").parquet(f"{root}/asked")
    files = sorted(spark.read.parquet(f"{root}/asked").inputFiles())
    fetched = stored(fetched, "fetched", compression="zstd")
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/asked")
    refresh.refresh_stream(stream, store, fetched, now, f"{root}/state").awaitTermination()
    return store, len(files)


@query(f"SELECT url, status FROM ({REFRESHED_SQL})")
def refresh_stream(spark, sf_dir):
    """The shop's addresses refreshed by a stream in several batches: the status of each."""
    store, n = _streamed(spark, sf_dir)
    return spark.read.parquet(*[store.results(k) for k in range(1, n + 1)]).select("url", "status")


@query(f"SELECT url, title, price, retry_count, linked, stored FROM ({REFRESHED_SQL}) WHERE status <> 'missing'")
def refresh_stream_state(spark, sf_dir):
    """The offers and raw rows that the stream's batches left in their buckets."""
    store, n = _streamed(spark, sf_dir)
    raw = store.raw.read(spark, n).where(F.get_json_object("extracted_json", "$.inStock") == "true").select("url", F.lit(True).alias("in_raw"))
    state = store.offers.read(spark, n).select("url", "title", "price", "retry_count", F.col("product_id").isNotNull().alias("linked"))
    return state.join(raw, "url", "left").withColumn("stored", F.coalesce("in_raw", F.lit(False))).drop("in_raw")


@query(f"WITH {OFFERS_SQL} SELECT offer_id, store, url FROM offers WHERE url <> '' AND coalesce(is_active, 1) = 1")
def known_offers(spark, sf_dir):
    """The offers that a job over all known ones refreshes."""
    return refresh.known_offers(offers(spark, sf_dir).withColumnRenamed("offer_id", "id")).withColumnRenamed("id", "offer_id")


@query(f"WITH {OFFERS_SQL} SELECT offer_id, store, url FROM offers WHERE lower(title) LIKE '%re_%uusi%' AND url <> '' ORDER BY fetched_at DESC, offer_id LIMIT 50")
def offers_by_title(spark, sf_dir):
    """The offers that a job by a title's words refreshes: the 50 newest."""
    return refresh.offers_by_title(offers(spark, sf_dir).withColumnRenamed("offer_id", "id"), "Re_%uusi", 50).withColumnRenamed("id", "offer_id")


_WORD = f"list_extract([{', '.join(repr(w) for w in pages.PRIORITY)}], CAST((page_id + pos) % {len(pages.PRIORITY)} + 1 AS BIGINT))"


@query(f"""WITH {ANCHORS_SQL}, x AS (SELECT link, page_id * 100000 + pos AS pos, lower(link || ' ' || label || ' ' || {_WORD}) AS t FROM links), s AS (SELECT link, pos, {LINK_SCORE_SQL} + CASE WHEN contains(t, '?fq=') THEN 0 ELSE 3 END + CASE WHEN contains(t, '/fi/product/list/') THEN 2 ELSE 0 END AS score FROM x)
SELECT link AS url, 0 AS depth, max(score) AS score FROM s GROUP BY link ORDER BY max(score) DESC, min(pos), link LIMIT 240""")
def crawl_queue(spark, sf_dir):
    """Where a crawl begins: each address of the pages' links with the best score of its labels, the 240 best."""
    word = F.get(F.array(*[F.lit(w) for w in pages.PRIORITY]), F.pmod(F.col("page_id") + F.col("pos"), F.lit(len(pages.PRIORITY))).cast("int"))
    found = pages.page_links(table(spark, sf_dir, "pages")).select(F.col("link").alias("url"), F.concat_ws(" ", "label", word).alias("label"), (F.col("page_id") * 100000 + F.col("pos")).alias("pos"))
    return pages.first_queue(found)


_HOST = "regexp_extract({0}, '^[a-z]+://([^/?#]+)', 1)"


@query(f"""WITH {ANCHORS_SQL}, p AS (SELECT page_id, {ADDRESS_SQL} AS url FROM pages), m AS (SELECT 0 AS source, page_id AS file, 0 AS pos, url FROM p UNION ALL SELECT 1, page_id, pos, link FROM links WHERE link LIKE '%://%'),
f AS (SELECT {_HOST.format('url')} AS store, url, min((source, file, pos)) AS spot FROM m WHERE url NOT IN (SELECT url FROM p WHERE page_id % 2 = 0) GROUP BY ALL)
SELECT store, url, n FROM (SELECT store, url, CAST(row_number() OVER (PARTITION BY store ORDER BY spot) AS INTEGER) AS n FROM f) WHERE n <= 4""")
def sitemap_then_links(spark, sf_dir):
    """New addresses of each host under one cap: those of its sitemap first, then those that its pages link."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("store")
    listed = p.select(F.lit(0).alias("source"), F.col("page_id").alias("file"), F.lit(0).alias("pos"), urls.strip_address(F.col("url")).alias("url"))
    xml = listed.select("source", "file", F.concat(F.lit("<urlset><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></urlset>")).alias("xml"))
    sitemap = xml.select("source", "file", F.posexplode(pages.sitemap_urls(F.col("xml"))).alias("pos", "url"))
    linked = pages.page_links(p).where(F.col("link").contains("://")).select(F.lit(1).alias("source"), F.col("page_id").alias("file"), "pos", F.col("link").alias("url"))
    known = listed.where("file % 2 = 0").select(host, "url")
    return pages.capped_urls(sitemap.unionByName(linked).select(host, "url", "source", "file", "pos"), known, 4)[0]


@query(f"""WITH {ANCHORS_SQL}, own AS (SELECT page_id, {_HOST.format('url')} AS store, {ADDRESS_SQL} AS url FROM pages),
m AS (SELECT store, url, 0 AS source FROM own WHERE length(store) % 2 = 0 UNION ALL SELECT {_HOST.format('link')}, link, 1 FROM links WHERE link LIKE '%://%'), best AS (SELECT store, min(source) AS source FROM m GROUP BY store)
SELECT store, url, source FROM m JOIN best USING (store, source)""")
def source_fallback(spark, sf_dir):
    """The addresses of each host from its sitemap, or, for hosts without one, from the links of its pages."""
    p, host = table(spark, sf_dir, "pages"), lambda c: F.regexp_extract(c, "^[a-z]+://([^/?#]+)", 1).alias("store")
    sitemap = p.select(host("url"), urls.strip_address(F.col("url")).alias("url")).where("length(store) % 2 = 0")
    linked = pages.page_links(p).where(F.col("link").contains("://")).select(host("link"), F.col("link").alias("url"))
    return pages.first_source(sitemap, linked)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id + 1 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 12 ELSE CASE WHEN user_id >= 1 THEN user_id ELSE 7 END END AS n FROM events")
def option_numbers(spark, sf_dir):
    """Numbers of options as they are typed, with a fallback for what is none or below 1."""
    k, e = F.pmod("event_id", F.lit(5)), F.col("event_id")
    typed = F.when(k == 0, F.concat(F.lit(" +"), (e + 1).cast("string"))).when(k == 1, F.concat(F.lit("x"), e.cast("string"))).when(k == 2, F.concat(F.lit("-"), e.cast("string"))).when(k == 3, "12.5abc").otherwise(F.concat(F.lit("00"), F.col("user_id").cast("string"), F.lit(" rows")))
    return table(spark, sf_dir, "events").select("event_id", text.positive_int(typed, 7).alias("n"))


_WRAPPED = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<Header>top</Header><div id=\"x content\">' || html || '</div><aside>a</aside><section class=''listing''>b</section>' ELSE '<main>' || html || '</MAIN><p>after</p><main id=m>more</main>' END"
_REST = "html"
for _tag in pages.OUTSIDE:
    _REST = f"regexp_replace({_REST}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
_CONTENT = pages.CONTENT.replace("'", "''")


@query(f"""WITH w AS (SELECT page_id, {_WRAPPED} AS html FROM pages), r AS (SELECT page_id, {_REST} AS rest FROM w), x AS (SELECT page_id, rest, regexp_extract_all(rest, '{pages.MAIN}') AS m, regexp_extract_all(rest, '{_CONTENT}') AS c FROM r)
SELECT page_id, md5(CASE WHEN len(m) > 0 THEN array_to_string(m, chr(10)) WHEN len(c) > 0 THEN array_to_string(c, chr(10)) ELSE rest END) AS content FROM x""")
def main_contents(spark, sf_dir):
    """The main content of all pages: as they are, in a block that looks like content, or in main elements."""
    k, h = F.pmod("page_id", F.lit(3)), F.col("html")
    block = F.concat(F.lit('<Header>top</Header><div id="x content">'), h, F.lit("</div><aside>a</aside><section class='listing'>b</section>"))
    mains = F.concat(F.lit("<main>"), h, F.lit("</MAIN><p>after</p><main id=m>more</main>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(pages.main_content(F.when(k == 0, h).when(k == 1, block).otherwise(mains))).alias("content"))


@query(f"""WITH l AS ({SQL['link_offers_full']}) SELECT l.product_id AS id, p_name || ' ' || p_type AS title, p_brand AS brand, CAST(p_size AS VARCHAR) AS model, 'S/' || p_partkey AS sku, '' AS ean, '' AS mpn FROM l JOIN part ON l.offer_id = p_partkey WHERE created""")
def founded_records(spark, sf_dir):
    """The products that link_offers_full founds, with the fields of the offers that found them; no two skus are equal."""
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(key.alias("offer_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("model"), F.concat(F.lit("S/"), key.cast("string")).alias("sku"))
    top = p.groupBy("brand").agg(F.max(F.col("model").cast("int")).cast("string").alias("model")).select(F.regexp_extract("brand", "([0-9]+)", 1).cast("long").alias("id"), F.lit("").alias("title"), "brand", "model")
    return linking.founded_products(p, linking.link_offers(p, top))


def _element(selector: str, value: Column) -> Column:
    """An element that a selector names, with a value as its text, or as its content where it is a meta element."""
    tag, cls, attr, op, named = extract.parsed(selector)
    inside = (f" class='a {cls} b'" if cls else "") + (f" {attr}='{'x-' if op == '*=' else ''}{named}'" if op else f" {attr}" if attr else "")
    if tag == "meta":
        return F.concat(F.lit(f"<meta{inside} content='"), value, F.lit("'>"))
    return F.concat(F.lit(f"<{tag or 'span'}{inside}>"), value, F.lit(f"</{tag or 'span'}>"))


def _one_of(selectors: list[str], number: Column, value: Column) -> Column:
    """The element of the selector of a number, in turn."""
    return F.get(F.array(*[_element(s, value) for s in selectors]), F.pmod(number, F.lit(len(selectors))).cast("int"))


def selector_pages(spark: SparkSession, sf_dir: str, browser: bool) -> DataFrame:
    """Each part as a page of one of four stores, whose elements are named by the store's selectors in turn.

    On the browser side every third page has elements that only the fallback's selectors name.
    """
    p = dealt(products(spark, sf_dir), "id")
    turn, number = F.floor(F.col("id") / 4), F.call_function("format_number", F.col("list_price"), F.lit("0.00"))
    store = F.get(F.array(*[F.lit(s) for s in extract.STORES]), F.pmod("id", F.lit(4)).cast("int"))
    by_store = lambda lists, name, value: F.coalesce(*[F.when(store == s, _one_of(lists[s][name], turn, value)) for s in lists])
    lists = extract.PAGE_STORES if browser else extract.STORES
    title, price = by_store(lists, "title", F.col("title")), by_store(lists, "price", F.concat(number, F.lit(" €")))
    if browser:
        fall = F.pmod(turn, F.lit(3)) == 0
        named = [s for s in extract.PAGE_FALLBACK["title"] if not any(s in x["title"] for x in extract.PAGE_STORES.values())]
        title = F.when(fall, _one_of(named, turn, F.col("title"))).otherwise(title)
        price = F.when(fall, _one_of(extract.PAGE_FALLBACK["price"], turn, F.concat(number, F.lit(" €")))).otherwise(price)
    ids = [_one_of(extract.IDENTIFIERS[k], turn, F.col(k)) for k in extract.IDENTIFIERS]
    stock = F.when(F.pmod("id", F.lit(5)) == 0, "Loppu").otherwise("Varastossa")
    parts = [title, price, by_store(extract.STORES, "shipping", F.lit("4,90 €")), by_store(extract.STORES, "stock", stock), *ids]
    return p.select("id", store.alias("store"), F.lit("u").alias("url"), F.concat(F.lit("<html><body>"), *parts, F.lit("</body></html>")).alias("html"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, ['gigantti.fi', 'jimms.fi', 'power.fi', 'verkkokauppa.com'][id % 4 + 1] AS store, title, list_price AS price, brand, model, sku, ean, mpn, 4.9 AS shipping, 'EUR' AS currency, id % 5 <> 0 AS in_stock FROM products")
def store_selectors(spark, sf_dir):
    """Products from pages of four stores, by each of the stores' selectors."""
    r = extract.product_records(selector_pages(spark, sf_dir, False))
    return r.select("id", *[f"product.{c}" for c in ("store", "title", "price", "brand", "model", "sku", "ean", "mpn", "shipping", "currency", "in_stock")])


@query(f"WITH {PRODUCTS_SQL} SELECT id, title, list_price AS price, CASE WHEN id // 4 % 3 = 1 THEN '' ELSE brand END AS brand, CASE WHEN id // 4 % 3 = 2 THEN model ELSE '' END AS model, CASE WHEN id // 4 % 3 = 1 THEN '' ELSE sku END AS sku, CASE WHEN id // 4 % 3 = 1 THEN '' ELSE mpn END AS mpn, CASE WHEN id // 4 % 4 = 2 THEN '' ELSE ean END AS ean FROM products")
def browser_selectors(spark, sf_dir):
    """The same as the browser side reads them: data attributes name no identifiers there, and a model's itemprop neither."""
    r = extract.product_records(selector_pages(spark, sf_dir, True), browser=True)
    return r.select("id", *[f"product.{c}" for c in ("title", "price", "brand", "model", "sku", "mpn", "ean")])
