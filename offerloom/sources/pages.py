"""Addresses from sitemaps, embedded JSON and links: regular expressions over page text, no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .scratch import stored

#: Words of categories that are crawled first.
PRIORITY = ("kannettava", "laptop", "apple", "mac", "emolevy", "motherboard", "prosessori", "cpu", "naytonohjain", "näytönohjain", "gpu", "ssd", "kiintolevy", "hard drive", "virtalahde", "virtalähde", "power supply", "kotelo", "case")


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex\b")


def is_url_set(xml: Column) -> Column:
    return xml.rlike(r"(?i)<urlset\b")


def sitemap_urls(xml: Column) -> Column:
    """The addresses between <loc> tags, entities decoded, empty ones dropped."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: text.decode_entities(text.trim_ws(x))), lambda x: x != "")


#: How a page's JSON names products, how its script texts write product addresses, and category links in JSON.
EMBEDDED = r'"pid":"(\d+)","name":"((?:\\.|[^"\\])+)"'
ESCAPED = r'https?:\\/\\/www\.jimms\.fi\\/(?:fi|FI)\\/Product\\/Show\\/\d+[^"\\s<]*'
JSON_LINK = r'(?i)"(?:url|href)"\s*:\s*"(/fi/Product/List/[^"\\]+)"(?:[^{}]{0,180}?"(?:name|title|label)"\s*:\s*"([^"\\]*)")?'
#: Attributes, anchors and content blocks of HTML.
HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""
ANCHOR = r"""(?is)<a[^>]+href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
OUTSIDE = ("header", "footer", "nav", "aside")
MAIN = r"(?is)<main\b.*?</main>"
CONTENT = r"""(?is)<(?:section|div)\b[^>]*(?:id|class)\s*=\s*["'][^"']*(?:content|main|category|product-list|listing|results)[^"']*["'][^>]*>.*?</(?:section|div)>"""


def _groups(c: Column, pattern: str, *names: str) -> Column:
    """An array of structs of a pattern's groups, in the order of its matches."""
    return F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)])


def embedded_products(raw: Column, store: str = "power.fi") -> Column:
    """Addresses made of the "pid" and "name" pairs in a page's JSON; a name that stands for nothing is 'tuote'."""

    def address(p: Column) -> Column:
        name = text.json_text(p["name"])
        return F.concat(F.lit(f"https://www.{store}/"), text.slug(F.when(name == "", "tuote").otherwise(name)), F.lit("/p-"), p["pid"], F.lit("/"))

    return F.transform(_groups(raw, EMBEDDED, "pid", "name"), address)


def hrefs(html: Column) -> Column:
    """What the page's href attributes hold, entities decoded."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: text.decode_entities(text.trim_ws(x), "&#39;"))


def product_links(html: Column, store: str = "jimms.fi") -> Column:
    """Distinct product addresses that a page's hrefs or script texts hold, rebuilt by urls.show_url."""
    linked = F.filter(hrefs(html), lambda x: x.rlike(r"(?i)/Product/Show/\d+"))
    escaped = F.transform(F.regexp_extract_all(html, F.lit(ESCAPED), F.lit(0)), lambda x: F.replace(F.replace(x, F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&")))
    rebuilt = F.transform(F.concat(linked, escaped), lambda x: urls.show_url(x, store))
    return F.array_distinct(F.filter(rebuilt, lambda x: x.isNotNull() & urls.is_product(x, store)))


def category_links(html: Column, json_links: bool = True, allow_query: bool = False) -> Column:
    """Array of (url, label): category addresses of a page's anchors, JSON pairs and hrefs, each with its first label.

    Addresses are rebuilt by urls.category_url without a page number. Links with a query (unless allowed) and facet links
    are left out. The order is that of the addresses' first places: anchors, then JSON, then hrefs.
    """
    named = lambda url, label: F.struct(url.alias("link"), label.alias("label"))
    lists = lambda x: x["link"].rlike("(?i)/fi/Product/List/")
    parts = [F.filter(F.transform(anchors(html), lambda x: named(x["href"], x["label"])), lists)]
    if json_links:
        parts.append(F.transform(_groups(html, JSON_LINK, "link", "label"), lambda x: named(text.json_text(x["link"], lenient=True), text.trim_ws(text.json_text(x["label"], lenient=True)))))
    parts.append(F.filter(F.transform(hrefs(html), lambda x: named(x, F.lit(""))), lists))
    usable = F.filter(F.concat(*parts), lambda x: ~urls.is_facet(x["link"]) & (F.lit(allow_query) | ~urls.has_query(x["link"])))
    rebuilt = F.filter(F.transform(usable, lambda x: F.struct(urls.category_url(x["link"]).alias("url"), x["label"].alias("label"))), lambda x: x["url"].isNotNull())

    def first_labels(all_links: Column) -> Column:
        distinct = F.array_distinct(F.transform(all_links, lambda x: x["url"]))
        return F.transform(distinct, lambda u: F.struct(u.alias("url"), F.coalesce(F.get(F.filter(all_links, lambda x: (x["url"] == u) & (x["label"] != "")), 0)["label"], F.lit("")).alias("label")))

    return text.bound(rebuilt, first_labels)


def pagination_links(html: Column, current: Column) -> Column:
    """Distinct addresses of numbered pages of the current category that a page's hrefs hold."""
    rebuilt = F.transform(hrefs(html), lambda x: urls.category_url(x, keep_page=True))
    key = urls.category_key(urls.category_url(current))
    return F.array_distinct(F.filter(rebuilt, lambda x: x.isNotNull() & (urls.category_key(x) == key) & urls.is_pagination(x)))


def anchors(html: Column) -> Column:
    """(href, label) of the anchors; labels are text without tags."""
    return F.transform(_groups(html, ANCHOR, "href", "label"), lambda x: F.struct(text.decode_entities(text.trim_ws(x["href"]), "&#39;").alias("href"), text.html_text(x["label"]).alias("label")))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, pos, link, label) of each page's anchors, links as seen from the page."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__base"), F.posexplode(anchors(F.col(html_col))).alias("pos", "a"))
    return rows.select(id_col, "pos", urls.absolute(F.col("a.href"), F.col("__base")).alias("link"), F.col("a.label").alias("label"))


def best_label(links: DataFrame, url: str = "link", label: str = "label", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Per address: the first label that is not empty, or ''."""
    return links.groupBy(url).agg(F.coalesce(F.min_by(F.when(F.col(label) != "", F.col(label)), F.when(F.col(label) != "", F.struct(*order))), F.lit("")).alias(label), F.count("*").alias("n_links"))


def keyword_score(url: Column, label: Column) -> Column:
    """10 for each priority word, 3 without a ?fq=, 2 for a list address."""
    t = F.lower(F.concat_ws(" ", url, label))
    score = F.lit(0)
    for word in PRIORITY:
        score = score + F.when(t.contains(word), 10).otherwise(0)
    return score + F.when(t.contains("?fq="), 0).otherwise(3) + F.when(t.contains("/fi/product/list/"), 2).otherwise(0)


def main_content(html: Column) -> Column:
    """All <main> elements, else the blocks that look like content, else all; without header, footer, nav and aside."""
    rest = html
    for tag in OUTSIDE:
        rest = F.regexp_replace(rest, rf"(?is)<{tag}\b.*?</{tag}>", " ")

    def part(rest: Column) -> Column:
        mains, blocks = (F.regexp_extract_all(rest, F.lit(p), F.lit(0)) for p in (MAIN, CONTENT))
        return F.when(F.size(mains) > 0, F.array_join(mains, "\n")).when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(rest)

    return text.bound(F.coalesce(rest, F.lit("")), part)


def category_rank(url: Column, parent: Column) -> Column:
    """A category's score as seen from its parent: keyword score, 10 with the parent's base, 8 with its code, 2 if short."""
    near = F.when(urls.category_key(url) == urls.category_key(parent), 10).otherwise(0) + F.when(urls.category_code(url) == urls.category_code(parent), 8).otherwise(0)
    return keyword_score(url, F.lit("")) + near + F.when(F.size(F.split(url, "/")) <= 9, 2).otherwise(0)


def ranked_categories(links: DataFrame, parent: str = "parent", url: str = "link", limit: int = 100) -> DataFrame:
    """(parent, url, score, rank): per parent its categories, best first, then the shortest address, then by address.

    Links and parents are rebuilt by urls.category_url first; links that are no category, facets and the parent itself
    are left out; limit of each parent stay.
    """
    rows = links.select(F.coalesce(urls.category_url(F.col(parent)), F.col(parent)).alias(parent), urls.category_url(F.col(url)).alias(url)).distinct()
    u, p = F.col(url), F.col(parent)
    best = rows.where(u.isNotNull() & (u != p) & ~urls.is_facet(u)).withColumn("score", category_rank(u, p))
    order = Window.partitionBy(parent).orderBy(F.desc("score"), F.length(url), F.asc(url))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def first_queue(links: DataFrame, url: str = "url", label: str = "label", pos: str = "pos", limit: int = 240) -> DataFrame:
    """(url, depth 0, score) to begin a crawl with: of each address the best score with its labels, best first, limit rows."""
    scored = links.select(url, pos, keyword_score(F.col(url), F.col(label)).alias("score")).groupBy(url).agg(F.max("score").alias("score"), F.min(pos).alias(pos))
    return scored.orderBy(F.desc("score"), pos, url).limit(limit).select(url, F.lit(0).alias("depth"), "score")


def sitemap_sources(candidates: DataFrame, fetched: DataFrame, limit: int = 10) -> DataFrame:
    """(store, pos, url): the sitemaps of each store, from its first candidate that can be read as one.

    candidates: (store, pos, url); fetched: (url, xml), null where it could not be read. An index gives its addresses, a
    list of addresses itself; limit of each store at most.
    """
    xml = candidates.join(fetched, "url").where(is_sitemap_index(F.col("xml")) | is_url_set(F.col("xml")))
    first = xml.groupBy("store").agg(F.min_by(F.struct("url", "xml"), F.struct("pos", "url")).alias("x"))
    listed = F.when(is_sitemap_index(F.col("x.xml")), sitemap_urls(F.col("x.xml"))).otherwise(F.array("x.url"))
    return first.select("store", F.posexplode(F.slice(listed, 1, limit)).alias("pos", "url"))


def first_source(*found: DataFrame, by: str = "store") -> DataFrame:
    """For each store the rows of the first table that has any for it; the tables have the same columns."""
    every = found[0].withColumn("source", F.lit(0))
    for k, more in enumerate(found[1:], 1):
        every = every.unionByName(more.withColumn("source", F.lit(k)))
    first = every.groupBy(by).agg(F.min("source").alias("source"))
    return every.join(first, [by, "source"])


def capped_urls(found: DataFrame, known: DataFrame, cap: int = 200, order: tuple[str, ...] = ("source", "file", "pos")) -> tuple[DataFrame, DataFrame]:
    """The new addresses of each store, cap at most, in the order of found; and its counter of addresses looked at.

    found: (store, url) and the order columns, of which the last is the place in a file; known: (store, url). The first is
    (store, url, n). The second, (store, looked_at), counts duplicates and known ones too, up to the capth new address
    and one more if its file goes on: a reader stops only when it meets the next one.
    """
    place = F.struct(*order)
    rows = found.select("store", "url", place.alias("place"))
    fresh = rows.groupBy("store", "url").agg(F.min("place").alias("place")).join(known.select("store", "url").distinct(), ["store", "url"], "left_anti")
    n = F.row_number().over(Window.partitionBy("store").orderBy("place"))
    kept = fresh.withColumn("n", n).where(F.col("n") <= cap)
    last = kept.where(F.col("n") == cap).select("store", F.col("place").alias("last"))
    seen = rows.join(last, "store", "left")
    file = lambda c: F.struct(*[F.col(c)[x] for x in order[:-1]])
    within = F.col("last").isNull() | (F.col("place") <= F.col("last"))
    goes_on = F.max(F.when(~within & (file("place") == file("last")), 1).otherwise(0))
    return kept.select("store", "url", "n"), seen.groupBy("store").agg((F.count_if(within) + goes_on).alias("looked_at"))


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 3, pages: int | None = 120) -> DataFrame:
    """Best-first over a table of links (parent, link): (url, depth) of what is reached from seeds (url).

    Each round takes the links of the pages of the last one, without those known: all of them, or, of best keyword score
    first, up to pages in all. At most depth rounds, each written once; the link table is only joined.
    """
    front = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "crawl-round")
    seen, left = front, None if pages is None else pages - front.count()
    for d in range(1, depth + 1):
        if left is not None and left <= 0:
            break
        found = links.join(front.select(F.col("url").alias("parent")), "parent").select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti")
        if left is not None:
            found = found.orderBy(F.desc(keyword_score(F.col("url"), F.lit(""))), F.length("url"), "url").limit(left)
        front = stored(found.withColumn("depth", F.lit(d)), "crawl-round")
        n = front.count()
        if not n:
            break
        seen, left = seen.unionByName(front), None if left is None else left - n
    return seen


_WALKS = """
WITH RECURSIVE walk (url, depth) MAX RECURSION LEVEL {levels} AS (
  SELECT url, 0 FROM {roots}
  UNION ALL
  SELECT DISTINCT l.link, w.depth + 1 FROM walk w JOIN {links} l ON l.parent = w.url WHERE w.depth < {depth})
SELECT url, min(depth) AS depth FROM walk GROUP BY url
"""


def category_tree(links: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(url, parent, depth) of all that links (parent, link) lead to from roots (url) in depth steps, by a recursive common
    table expression.

    depth is the least number of steps, parent the page one step before with the shortest address, then the first by address.
    A level of the recursion holds an address once, whatever many ways lead there, so that the levels are depth joins of
    as many rows as there are addresses at most. Nulls are left out; what no root leads to is in no tree.
    """
    spark = links.sparkSession
    known = stored(links.where("parent is not null and link is not null").select("parent", "link").distinct(), "tree-links")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the levels are bounded by the addresses
    try:
        walked = spark.sql(_WALKS, levels=depth + 1, depth=depth, roots=stored(roots.where("url is not null").select("url").distinct(), "tree-roots"), links=known)
        found = stored(walked, "tree")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    above = known.join(found.select(F.col("url").alias("parent"), F.col("depth").alias("above")), "parent").select(F.col("link").alias("url"), "parent", (F.col("above") + 1).alias("depth"))
    parents = found.join(above, ["url", "depth"]).groupBy("url").agg(F.min(F.struct(F.length("parent").alias("n"), "parent"))["parent"].alias("parent"))
    return found.join(parents, "url", "left").select("url", "parent", "depth")
