"""A crawl of a store's categories as rounds over a whole frontier: each ranks, cuts and joins DataFrames, and budgets are window sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import pages as p
from ..sources.scratch import stored


def site(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(category, number, products, links) of each category page, its links read once for all rounds.

    category is the page's address without a page number, number the page's own, products the addresses in the page's order,
    links (url, score, plain) those to other categories in the main content, with their scores as seen from the page and
    by their words alone. Other pages, and pages with a null url or html, are left out; of two with one address one stays.
    """
    read = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).dropDuplicates([url]).withColumns({"category": urls.category_url(F.col(url)), "number": urls.page_number(F.col(url))})
    found = F.filter(p.category_links(p.main_content(F.col(html)), json_links=False), lambda x: x["url"] != F.col("category"))
    links = F.transform(found, lambda x: F.struct(x["url"].alias("url"), p.category_rank(x["url"], F.col("category")).alias("score"), p.keyword_score(x["url"], F.lit("")).alias("plain")))
    return stored(read.where("category is not null").select("category", "number", p.product_links(F.col(html)).alias("products"), links.alias("links")), "site", compression="zstd")


@dataclass
class Crawled:
    """categories: (url, score, depth, place); pages: (url, depth, place, number); products: (place, url), numbered from 1."""

    categories: DataFrame
    pages: DataFrame
    products: DataFrame


def crawl_categories(site: DataFrame, queue: DataFrame, known: DataFrame, depth: int = 3, categories: int = 120, per_category: int = 25, budget: int = 240, products: int = 500, noisy: int = 100) -> Crawled:
    """What a crawl reads from the categories of queue (url, score) on, and the products that known (url) lacks.

    Round d reads the d-th ring of the frontier whole: its categories, best score first, as many as are left of categories;
    of each the pages numbered up to per_category; and of all pages but the first ones as many as are left of budget, in
    the ring's order. Links of what was read, noisy of each category at most, that no ring has are the next ring, their
    score less 2 for each step down. products are numbered in the order of ring, category, page and place.

    A ring is bounded by the budgets (categories * per_category rows), so that its sums run in one task and it is broadcast;
    the site's table is only joined, once a round, and the rounds are depth + 1 at most. The driver holds two counts.
    """
    best = F.struct(-F.col("score"), F.length("url"), "url")
    front = queue.groupBy("url").agg(F.max("score").alias("score"))
    seen = pages = None
    for d in range(depth + 1):
        first = front.orderBy(best).limit(categories)
        ring = stored(first.withColumns({"depth": F.lit(d), "place": F.row_number().over(Window.orderBy(best))}), "ring")
        read = site.join(F.broadcast(ring.select(F.col("url").alias("category"), "place")), "category").withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy("number")))
        within = F.sum(F.when(F.col("nth") > 1, 1).otherwise(0)).over(Window.orderBy("place", "nth"))
        read = stored(read.where(F.col("nth") <= per_category).withColumn("extra", within).where((F.col("nth") == 1) | (F.col("extra") <= budget)).withColumn("depth", F.lit(d)), "ring-pages")
        seen, pages = (ring, read) if seen is None else (seen.unionByName(ring), pages.unionByName(read))
        used = read.agg(F.count("*").alias("n"), F.count_if(F.col("nth") > 1).alias("extra")).first()
        categories, budget = categories - ring.count(), budget - used["extra"]
        if not used["n"] or categories <= 0:
            break
        linked = read.select("category", F.explode("links").alias("x")).groupBy("category", "x.url").agg(F.max("x.score").alias("score"), F.max("x.plain").alias("plain"))
        kept = linked.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(best))).where(F.col("n") <= noisy)
        front = kept.groupBy("url").agg((F.max("plain") - 2 * (d + 1)).alias("score")).join(seen, "url", "left_anti")
    shown = pages.select(F.posexplode("products").alias("pos", "url"), "depth", "place", "nth")
    first = shown.groupBy("url").agg(F.min(F.struct("depth", "place", "nth", "pos")).alias("at")).join(known.select("url").distinct(), "url", "left_anti")
    # the pages read are bounded, and so are their products: as many as their links
    numbered = first.orderBy("at", "url").limit(products).select(F.row_number().over(Window.orderBy("at", "url")).alias("place"), "url")
    return Crawled(seen, pages.select(F.col("category").alias("url"), "depth", "place", "number"), numbered)
