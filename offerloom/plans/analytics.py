"""Queries beyond what the shop's own jobs ask: joins over time, neighbours of vectors, sketches, VARIANT, table functions and
recursion. They extend the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links, variants
from ..operators import extract, sketches, temporal, vectors
from ..sources import pages
from ..sources.scratch import stored
from .catalogue import SITE_LINKS, product_pages, store_site
from .registry import SQL, query
from .views import table

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"""
WITH p AS (SELECT l_partkey, l_shipdate AS priced_at, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
SELECT {', '.join('l.' + c for c in _LINE)}, l.l_shipdate, p.priced_at, p.price FROM lineitem l ASOF LEFT JOIN p ON l.l_partkey = p.l_partkey AND l.l_shipdate >= p.priced_at WHERE l.l_linenumber % 2 = 1""")
def asof_prices(spark, sf_dir):
    """The last price of a part before or at each attempt to ship it; lines of even numbers are prices, others attempts."""
    l = table(spark, sf_dir, "lineitem")
    known = l.where("l_linenumber % 2 = 0").select("l_partkey", F.col("l_shipdate").alias("priced_at"), F.col("l_extendedprice").alias("price"))
    asked = l.where("l_linenumber % 2 = 1").select(*_LINE, "l_shipdate")
    return temporal.asof_join(asked, known, "l_partkey", "l_shipdate", "priced_at", ("priced_at", "price"), tie="price")


def _valid_prices(spark, sf_dir) -> DataFrame:
    """(l_partkey, valid_from, valid_to, price): a part's price holds until its next one; the last one's end is open."""
    # as many rows of a part as it has days of shipping
    days = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_shipdate").cast("timestamp").alias("valid_from")).agg(F.max("l_extendedprice").alias("price"))
    return days.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("l_partkey").orderBy("valid_from")))


_VALID = "v AS (SELECT *, lead(valid_from) OVER (PARTITION BY l_partkey ORDER BY valid_from) AS valid_to FROM (SELECT l_partkey, l_shipdate AS valid_from, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL))"


@query(f"WITH {_VALID} SELECT {', '.join('l.' + c for c in _LINE)}, o_orderdate, price, valid_from FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN v ON l.l_partkey = v.l_partkey AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to)")
def prices_at_order(spark, sf_dir):
    """The price of each ordered part that was valid on the day of the order."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    asked = l.select(*_LINE).join(o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return temporal.interval_join(_valid_prices(spark, sf_dir), asked, "valid_from", "valid_to", "o_orderdate", by="l_partkey").drop("valid_to")


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("id % 50 = 0")


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def vector_neighbours_exact(spark, sf_dir):
    """The ten vectors nearest to each of the ids that 50 divides, from all cells."""
    index = vectors.build(table(spark, sf_dir, "embeddings"))
    return vectors.neighbours(index, _queries(index.rows), probes=len(index.centres))


@query()
def vector_neighbours(spark, sf_dir):
    """The same from the nearest three quarters of the cells: an index search, whose recall a test measures.

    The table's vectors have no clusters, so that fewer probes miss more: a half finds 0.85, a third 0.72 of the ten.
    """
    index = vectors.build(table(spark, sf_dir, "embeddings"))
    return vectors.neighbours(index, _queries(index.rows), probes=-(-3 * len(index.centres) // 4))


_BY = ("nation", "segment", "month")


def _sales(spark, sf_dir) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("month"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))


@query("""
SELECT n_name AS nation, c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, grouping(n_name, c_mktsegment, strftime(o_orderdate, '%Y-%m'))::INTEGER AS level, count(*) AS n_orders, true AS customers_close, true AS median_close
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment, strftime(o_orderdate, '%Y-%m'))""")
def price_sketches(spark, sf_dir):
    """Customers and prices of all groupings of nation, segment and month from sketches of two loads, held against exact ones.

    Close: the distinct count within 6 % (or 1), the median between the exact quantiles 0.45 and 0.55.
    """
    sales = stored(_sales(spark, sf_dir), "sales")
    loads = [stored(sketches.sketched(sales.where(part), _BY, "customer", "price"), "sketches") for part in ("month < '1998-06'", "month >= '1998-06'")]
    cube = sketches.cubed(sketches.combined(_BY, *loads), _BY).select(*_BY, "level", F.col("n").alias("n_orders"), sketches.distinct_count().alias("customers"), sketches.quantile(0.5).alias("median"))
    # each apart: together every customer of a group would have a map of prices
    level = F.grouping_id().cast("int")
    customers = sales.cube(*_BY).agg(level.alias("e_level"), F.count_distinct("customer").alias("e_customers")).withColumnsRenamed({c: f"e_{c}" for c in _BY})
    prices = sales.cube(*_BY).agg(level.alias("p_level"), F.percentile("price", F.array(F.lit(0.45), F.lit(0.55))).alias("e_prices")).withColumnsRenamed({c: f"p_{c}" for c in _BY})

    def same(x: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{x}_{c}")) for c in _BY], F.col("level") == F.col(f"{x}_level"))

    near = F.abs(F.col("customers") - F.col("e_customers")) <= F.greatest(F.lit(1.0), 0.06 * F.col("e_customers"))
    # of a few prices the sketch names one of them, and the exact quantile lies between two
    between = (F.col("n_orders") < 20) | F.col("median").between(F.col("e_prices")[0], F.col("e_prices")[1])
    return cube.join(customers, same("e")).join(prices, same("p")).select(*_BY, "level", "n_orders", near.alias("customers_close"), between.alias("median_close"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_props(spark, sf_dir):
    """Events by their type and a field of their properties, which are stored as VARIANT and read by path."""
    e = stored(table(spark, sf_dir, "events").select("event_type", "value", variants.parsed(F.col("props")).alias("props")), "event-props")
    k = F.try_variant_get("props", "$.k", "long")
    return e.groupBy("event_type", F.pmod(k, F.lit(10)).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"SELECT id, title, price, brand, model, sku, ean, shipping, currency, in_stock, title AS ld_name, price AS ld_price FROM ({SQL['jsonld_roundtrip']})")
def stored_records(spark, sf_dir):
    """The records that extraction writes as JSON, kept as VARIANT and read back; and the pages' own JSON-LD by path."""
    r = extract.product_records(product_pages(spark, sf_dir, True))
    p = F.col("product")
    json = F.to_json(F.struct(*[p[c].alias("inStock" if c == "in_stock" else c) for c in ("store", "title", "price", "shipping", "total", "currency", "url", "brand", "model", "sku", "ean", "mpn", "in_stock")]), {"ignoreNullFields": "false"})
    ld = F.element_at(F.regexp_extract_all("html", F.lit(r"(?s)<script type='application/ld\+json'>(.*?)</script>"), F.lit(1)), -1)
    raw = stored(r.select("id", variants.parsed(json).alias("record"), variants.parsed(ld).alias("ld")), "records")
    back = raw.select("id", variants.record(F.col("record")).alias("r"), variants.ld_product(F.col("ld")).alias("p"))
    return back.select("id", *[f"r.{c}" for c in ("title", "price", "brand", "model", "sku", "ean", "shipping", "currency", "in_stock")], F.col("p.name").alias("ld_name"), F.col("p.price").alias("ld_price"))


@query(SQL["page_links"])
def page_links_lateral(spark, sf_dir):
    """The links of all pages by a table function."""
    return links.page_links(table(spark, sf_dir, "pages"))


@query(SQL["category_links"])
def category_links_lateral(spark, sf_dir):
    """The category links of a shop's pages by a table function."""
    return links.category_links(store_site(spark, sf_dir))


@query(f"""
WITH RECURSIVE {SITE_LINKS}, w AS (SELECT 'https://www.jimms.fi/fi' AS url, 0 AS depth UNION SELECT link, depth + 1 FROM w JOIN links l ON l.url = w.url WHERE depth < 4),
d AS (SELECT url, min(depth) AS depth FROM w GROUP BY url)
SELECT d.url, d.depth, arg_min(l.url, (length(l.url), l.url)) AS parent FROM d LEFT JOIN (links l JOIN d a ON l.url = a.url) ON l.link = d.url AND a.depth = d.depth - 1 GROUP BY d.url, d.depth""")
def category_tree(spark, sf_dir):
    """The categories of a shop below its front page, from the links of its pages."""
    found = links.category_links(store_site(spark, sf_dir)).select(F.col("url").alias("parent"), "link")
    front = table(spark, sf_dir, "nation").agg(F.lit("https://www.jimms.fi/fi").alias("url"))
    return pages.category_tree(found, front)
