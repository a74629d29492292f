"""The registered queries of the product-offer operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text, urls
from ..operators import extract, linking, maintenance, matching, prices, refresh
from ..sources import pages, snapshots
from ..sources.scratch import scratch_dir, stored
from ..streaming import retries
from .registry import NOW, QUERIES, SQL, query
from .views import ATTEMPTS_SQL, MATCH_TEXT, OFFERS_SQL, PRODUCTS_SQL, QUERIES_SQL, REASON_SQL, SCORE_SQL, STATES_SQL, attempts, canonical_sql, dealt, offer_states, offers, products, queries_view, scored_sql, table

TIES = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


def js_round(x: str) -> str:
    return f"(CASE WHEN ({x}) * 8 = floor(({x}) * 8) THEN round({x}, 2) ELSE CAST(printf('%.2f', {x}) AS DOUBLE) END)"


@query("""
WITH r AS (SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber, l_suppkey, l_quantity, row_number() OVER w AS rn, lead(l_extendedprice) OVER w AS second_price, count(*) OVER (PARTITION BY l_partkey) AS offer_count
  FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey, l_quantity))
SELECT l_partkey, l_extendedprice, l_orderkey, l_linenumber, l_suppkey, l_quantity, second_price, offer_count FROM r
WHERE rn = 1 AND offer_count >= 2 AND second_price >= 50 AND l_extendedprice < second_price * 0.25 ORDER BY second_price DESC, l_extendedprice, l_partkey LIMIT 200""")
def price_outliers(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", *TIES)
    return prices.price_outliers(l, "l_partkey", "l_extendedprice", TIES)


@query("""
WITH r AS (SELECT l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_partkey) AS c FROM lineitem)
SELECT l_partkey, max(CASE WHEN rn = 1 THEN l_extendedprice END) AS lowest_price, max(CASE WHEN rn = 2 THEN l_extendedprice END) AS second_price, max(c) AS offer_count FROM r GROUP BY l_partkey""")
def second_price_by_product(spark, sf_dir):
    return prices.second_prices(table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", *TIES), "l_partkey", "l_extendedprice", *TIES)


@query(f"WITH {OFFERS_SQL}, t AS (SELECT product_id, offer_id, store, price, {js_round('price + shipping')} AS total FROM offers WHERE product_id IS NOT NULL) SELECT product_id, offer_id, store, price, total FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY total, offer_id) AS n FROM t) x WHERE n = 1")
def cheapest_offer_per_product(spark, sf_dir):
    o = offers(spark, sf_dir).where("product_id is not null").select("product_id", "offer_id", "store", "price", money.total(F.col("price"), F.col("shipping")).alias("total"))
    return matching.cheapest(o, "product_id", "total", "offer_id")


@query(f"WITH {OFFERS_SQL} SELECT offer_id, {js_round('price + shipping')} AS fresh_total, {js_round('price / 7')} AS rounded, price <= {js_round('price * 0.95 + shipping')} AS cheapest, coalesce(total, {js_round('price + shipping')}) AS stored FROM offers")
def offer_totals(spark, sf_dir):
    price, shipping = F.col("price"), F.col("shipping")
    lower = money.total(price * 0.95, shipping)
    return offers(spark, sf_dir).select("offer_id", money.total(price, shipping).alias("fresh_total"), money.round2(price / 7).alias("rounded"), money.cheaper_now(price, lower).alias("cheapest"), money.stored_total(F.col("total"), price, shipping).alias("stored"))


_MATCH_TEXT = MATCH_TEXT.format("text")


@query(f"SELECT doc_id, md5({_MATCH_TEXT}) AS match_text, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS canon_title FROM documents")
def normalize_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_text(F.col("text"))).alias("match_text"), F.md5(text.canon_title(F.col("text"))).alias("canon_title"))


@query("""
SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS match_id, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS canon_id, regexp_replace(lower(p_name), '[-\\s]+', '', 'g') AS canon_model,
 CASE WHEN length(ltrim('00' || (p_partkey * 1000003), '0')) >= 8 THEN ltrim('00' || (p_partkey * 1000003), '0') END AS match_ean, ltrim('00' || (p_partkey * 1000003), '0') AS lookup_ean, lower(p_brand) AS match_brand_raw,
 CASE p_partkey % 3 WHEN 0 THEN 'hp' WHEN 1 THEN 'wd' ELSE 'brand ' || p_partkey END AS match_brand FROM part""")
def normalize_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ean = F.concat(F.lit("0-0 "), (F.col("p_partkey") * 1000003).cast("string"))
    brand = F.when(F.col("p_partkey") % 3 == 0, " Hewlett  Packard").when(F.col("p_partkey") % 3 == 1, "WD (Blue)").otherwise(F.concat(F.lit("Brand#"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", text.match_id(F.col("p_brand")).alias("match_id"), text.canon_id(F.col("p_brand")).alias("canon_id"), text.canon_model(F.col("p_name")).alias("canon_model"), text.match_ean(ean).alias("match_ean"), text.lookup_ean(ean).alias("lookup_ean"), text.canon_text(F.col("p_brand")).alias("match_brand_raw"), text.match_brand(brand).alias("match_brand"))


@query(f"""WITH t AS (SELECT doc_id, {_MATCH_TEXT} AS m FROM documents)
SELECT doc_id, len(list_distinct(list_filter(string_split(m, ' '), lambda x: length(x) > 2 AND x NOT IN ('with', 'from', 'for', 'the', 'and', 'musta', 'white', 'black')))) AS n_tokens,
 md5(array_to_string(list_sort(list_distinct(list_filter(string_split(m, ' '), lambda x: length(x) > 2 AND x NOT IN ('with', 'from', 'for', 'the', 'and', 'musta', 'white', 'black')))), ' ')) AS tokens,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(m, '\\b[a-z]*\\d+[a-z0-9.-]*\\b'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> ''))), ' ') AS models FROM t""")
def title_tokens(spark, sf_dir):
    fields = text.bound(text.title_fields(F.col("text")), lambda x: F.struct(F.size(x["tokens"]).alias("n_tokens"), F.md5(F.array_join(F.array_sort(x["tokens"]), " ")).alias("tokens"), F.array_join(F.array_sort(x["models"]), " ").alias("models")))
    return table(spark, sf_dir, "documents").select("doc_id", fields.alias("x")).select("doc_id", "x.*")


@query("""
WITH t AS (SELECT DISTINCT list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda x: length(x) > 2))) AS s FROM (SELECT p_name, p_type, replace(p_brand, '#', ' ') AS p_brand FROM part) q),
p AS (SELECT a.s AS x, b.s AS y, len(list_intersect(a.s, b.s)) AS i, len(list_distinct(list_concat(a.s, b.s))) AS u FROM t a JOIN t b ON a.s < b.s)
SELECT array_to_string(x, ' ') AS a, array_to_string(y, ' ') AS b, CAST(i AS DOUBLE) / u AS jaccard FROM p WHERE CAST(i AS DOUBLE) / u >= 0.6""")
def title_jaccard_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.array_sort(text.title_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("t"))
    pairs = matching.token_pairs(p, p, 0.6).where("a_tokens < b_tokens")
    return pairs.select(F.array_join("a_tokens", " ").alias("a"), F.array_join("b_tokens", " ").alias("b"), text.jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("jaccard"))


@query(f"""WITH {PRODUCTS_SQL}, {QUERIES_SQL}, {canonical_sql('asked', 'query_id')}
SELECT query_id AS item_id, product_id, coalesce(match_rank, 99) AS match_rank, CASE match_rank WHEN 1 THEN 'Exact SKU match' WHEN 2 THEN 'Exact EAN match' WHEN 3 THEN 'Exact MPN match' WHEN 4 THEN 'Exact brand + model match' WHEN 5 THEN 'Strict normalized title match' ELSE 'No strong canonical match' END AS match_reason FROM asked LEFT JOIN hits ON query_id = item_id""")
def canonical_match(spark, sf_dir):
    """A query for every product, each with some fields, against all products."""
    return matching.canonical_match(queries_view(spark, sf_dir), products(spark, sf_dir), "query_id")


_COMPARED = f"""WITH {OFFERS_SQL}, {QUERIES_SQL}, {canonical_sql('asked', 'query_id')},
found AS (SELECT item_id AS query_id, h.product_id AS hit, offer_id FROM hits h JOIN offers o ON h.product_id = o.product_id UNION
  SELECT item_id, h.product_id, offer_id FROM hits h JOIN products p ON h.product_id = p.id JOIN offers o ON o.ean <> '' AND ltrim(replace(o.ean, ' ', ''), '0') = ltrim(regexp_replace(p.ean, '[^0-9]', '', 'g'), '0')),
{scored_sql('q', 'asked', 'query_id', 'store', 'currency')}, {scored_sql('o', 'offers', 'offer_id', 'store', 'currency', f"coalesce(total, {js_round('price + shipping')}) AS total")},
m AS (SELECT query_id, hit AS product_id, offer_id, o.total, {REASON_SQL} AS match_reason FROM found JOIN q USING (query_id) JOIN o USING (offer_id) WHERE q.store <> o.store AND (q.currency = '' OR o.currency = '' OR q.currency = o.currency)),
s AS (SELECT *, {SCORE_SQL} AS match_score FROM m),
best AS (SELECT query_id, product_id, offer_id, match_score, match_reason, total, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, total, offer_id) AS match_rank FROM s WHERE match_score >= 60)"""


@query(f"{_COMPARED} SELECT * FROM best")
def compare_canonical(spark, sf_dir):
    return matching.compare_canonical(queries_view(spark, sf_dir), products(spark, sf_dir), offers(spark, sf_dir))


@query(f"""{_COMPARED}
SELECT query_id, offer_id, to_json({{'id': offer_id, 'store': store, 'currency': currency, 'url': url, 'matchScore': match_score, 'matchReason': match_reason}}) AS match FROM best JOIN offers USING (offer_id)""")
def compare_response(spark, sf_dir):
    """What an interface gets for each match; numbers are left out, as engines write them in different ways."""
    matches = matching.compare_canonical(queries_view(spark, sf_dir), products(spark, sf_dir), offers(spark, sf_dir), carry=("store", "currency", "url"))
    return snapshots.response_json(matches.drop("total"))


def _listed(spark, sf_dir):
    """Every part as an item; parts of a brand and size share one identifier of one of three kinds, every fifth has no brand."""
    key = F.col("p_partkey")
    kind, pair = F.pmod(key, F.lit(3)), F.concat(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    named = lambda k, c: F.when(kind == k, c).otherwise("")
    # sizes have the form s<digits>: they are model tokens, and words of three letters or more from 10 on
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("title"), F.when(F.pmod(key, F.lit(5)) == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.concat(F.lit("store"), F.pmod(key, F.lit(7)).cast("string")).alias("store"),
        named(0, F.concat(F.lit("0-64000"), pair)).alias("ean"), named(1, F.concat(F.lit("m/"), pair)).alias("mpn"), named(2, F.concat(F.lit("k "), pair)).alias("sku"), F.col("p_retailprice").alias("price"),
    )


@query(f"""
WITH pairs AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' s' || p_size AS title, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS brand, 'store' || (p_partkey % 7) AS store, regexp_extract(p_brand, '([0-9]+)', 1) || lpad(CAST(p_size AS VARCHAR), 3, '0') AS pair, p_retailprice AS total FROM part),
listed AS (SELECT *, CASE WHEN id % 3 = 0 THEN '0-64000' || pair ELSE '' END AS ean, CASE WHEN id % 3 = 1 THEN 'm/' || pair ELSE '' END AS mpn, CASE WHEN id % 3 = 2 THEN 'k ' || pair ELSE '' END AS sku FROM pairs),
{scored_sql('q', 'listed', 'id', 'store')}, {scored_sql('o', 'listed', 'id', 'store', 'total')},
m AS (SELECT q.id AS query_id, o.id AS offer_id, o.total, {REASON_SQL} AS match_reason FROM q JOIN o ON q.store <> o.store),
s AS (SELECT *, {SCORE_SQL} AS match_score FROM m)
SELECT query_id, offer_id, match_score, match_reason, total, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, total, offer_id) AS match_rank FROM s WHERE match_score >= 75""")
def compare_fallback(spark, sf_dir):
    """Every part as a query against every part as an offer."""
    p = _listed(spark, sf_dir)
    return matching.compare_fallback(p.withColumnRenamed("id", "query_id"), p.withColumnRenamed("id", "offer_id").withColumn("shipping", F.lit(0.0)))


@query("""
WITH k AS (SELECT p_partkey AS offer_id, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')) AS title FROM part),
f AS (SELECT title, min(offer_id) AS owner FROM k GROUP BY title),
n AS (SELECT title, owner, row_number() OVER (ORDER BY owner) AS product_id FROM f)
SELECT offer_id, product_id, offer_id = owner AS created FROM k JOIN n ON k.title = n.title""")
def link_offers(spark, sf_dir):
    """Every part as an offer with a title alone, linked into an empty catalogue."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("title"))
    return linking.link_offers(p, p.select(F.col("offer_id").alias("id"), "title").where("false"))


@query("""
WITH k AS (SELECT p_partkey AS offer_id, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')) AS title FROM part),
n AS (SELECT owner, row_number() OVER (ORDER BY owner) AS id FROM (SELECT min(offer_id) AS owner FROM k GROUP BY title))
SELECT id, p_name AS title, '' AS brand, '' AS model, '' AS sku, '' AS ean, '' AS mpn FROM n JOIN k ON owner = offer_id""")
def founded_products(spark, sf_dir):
    """The products that the parts' titles found in an empty catalogue."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("title"))
    return linking.founded_products(p, linking.link_offers(p, p.select(F.col("offer_id").alias("id"), "title").where("false")))


@query("""
WITH RECURSIVE top AS (SELECT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS id, max(p_size) AS size FROM part GROUP BY ALL),
o AS (SELECT p_partkey AS id, lower(p_brand) || '|' || p_size AS pair, p_name || ' ' || lower(p_type) AS title, p_brand, p_size FROM part),
k AS (SELECT id, 4 AS rank, pair AS key FROM o UNION ALL SELECT id, 5, title FROM o),
earlier AS (SELECT a.id, list_distinct(list(b.id)) AS ids FROM k a JOIN k b ON a.rank = b.rank AND a.key = b.key AND b.id < a.id GROUP BY a.id),
todo AS (SELECT o.id, row_number() OVER (ORDER BY o.id) AS n, ids FROM o LEFT JOIN earlier USING (id) LEFT JOIN top t ON o.p_brand = t.p_brand AND o.p_size = t.size WHERE t.id IS NULL),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS founders UNION ALL SELECT t.n, CASE WHEN t.ids IS NOT NULL AND list_has_any(t.ids, founders) THEN founders ELSE list_append(founders, t.id) END FROM f JOIN todo t ON t.n = f.n + 1),
found AS (SELECT id, row_number() OVER (ORDER BY id) + (SELECT max(id) FROM top) AS new_id FROM (SELECT unnest(founders) AS id FROM f WHERE n = (SELECT max(n) FROM f))),
ways AS (SELECT o.id, 4 AS rank, -1 AS founder, t.id AS product FROM o JOIN top t ON o.p_brand = t.p_brand AND o.p_size = t.size UNION ALL SELECT a.id, a.rank, g.id, g.new_id FROM k a JOIN k b ON a.rank = b.rank AND a.key = b.key AND b.id < a.id JOIN found g ON b.id = g.id),
best AS (SELECT id, arg_min(product, rank * 10000000000 + founder) AS product FROM ways GROUP BY id)
SELECT o.id AS offer_id, coalesce(new_id, product) AS product_id, new_id IS NOT NULL AS created FROM o LEFT JOIN found USING (id) LEFT JOIN best USING (id)""")
def link_offers_full(spark, sf_dir):
    """Every part as an offer with brand, model and title, linked into a catalogue of each brand's largest size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").alias("model"))
    top = p.groupBy("brand").agg(F.max("model").alias("model")).select(F.regexp_extract("brand", "([0-9]+)", 1).cast("long").alias("id"), F.lit("").alias("title"), "brand", F.col("model").cast("string").alias("model"))
    return linking.link_offers(p.withColumn("model", F.col("model").cast("string")), top)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS first FROM lineitem WHERE l_linestatus = 'F'),
o AS (SELECT ps_s, ps_p, price FROM (SELECT l_suppkey AS ps_s, l_partkey AS ps_p, max(l_extendedprice) AS price FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) x)
SELECT coalesce(l_suppkey, ps_s) AS store_key, coalesce(l_partkey, ps_p) AS part_key, CASE WHEN r.l_suppkey IS NOT NULL THEN l_extendedprice ELSE price END AS price, CASE WHEN r.l_suppkey IS NULL THEN 'kept' WHEN ps_s IS NULL THEN 'inserted' ELSE 'updated' END AS op
FROM (SELECT * FROM r WHERE n = 1) r FULL JOIN o ON l_suppkey = ps_s AND l_partkey = ps_p""")
def upsert_latest(spark, sf_dir):
    """Offers of open lines as the old snapshot, closed lines as the batch written over it."""
    l = table(spark, sf_dir, "lineitem").withColumns({"store": F.col("l_suppkey").cast("string"), "url": F.col("l_partkey").cast("string")})
    old = l.where("l_linestatus = 'O'").groupBy("store", "url").agg(F.max("l_extendedprice").alias("price"))
    old = old.withColumns({"id": F.xxhash64("store", "url"), "is_active": F.lit(0), "retry_count": F.lit(2), "fetched_at": F.lit(NOW).cast("timestamp")})
    batch = l.where("l_linestatus = 'F'").select("store", "url", F.col("l_extendedprice").alias("price"), "l_shipdate", "l_orderkey", "l_linenumber")
    out = snapshots.upsert(old, batch, F.lit(NOW).cast("timestamp"), order=("l_shipdate", "l_orderkey", "l_linenumber"))
    return out.select(F.col("store").cast("long").alias("store_key"), F.col("url").cast("long").alias("part_key"), "price", "op")


ADDRESS_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END"


@query(f"SELECT page_id, {ADDRESS_SQL} AS address, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') AS store, contains(url, '?') AS has_query, contains(url, 'page=') AS paged, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER), 1) AS page FROM pages")
def normalize_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.strip_address(u).alias("address"), urls.store_of(F.lit(""), u).alias("store"), urls.has_query(u).alias("has_query"), urls.is_pagination(u).alias("paged"), urls.page_number(u).alias("page"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE lower('%Re_%') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 50")
def search_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(text.contains_term(F.col("p_name"), "Re_"))
    return p.orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(50).select("p_partkey", "p_name")


@query(f"WITH {STATES_SQL} SELECT offer_id, CASE WHEN retry_count >= 3 OR coalesce(last_status_code, 0) = 404 THEN 0 ELSE coalesce(is_active, 1) END AS is_active, retry_count FROM states")
def stale_offers(spark, sf_dir):
    return maintenance.mark_stale(maintenance.migrated(offer_states(spark, sf_dir))).select("offer_id", "is_active", "retry_count")


@query(f"WITH {STATES_SQL} SELECT offer_id, retry_count, last_error, last_error_at, last_status_code FROM states WHERE coalesce(last_status_code = 404, false) OR (coalesce(last_error, '') <> '' AND coalesce(last_error_at, fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)")
def failed_offers(spark, sf_dir):
    return maintenance.failed(offer_states(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("offer_id", "retry_count", "last_error", "last_error_at", "last_status_code")


@query(f"WITH {STATES_SQL} SELECT offer_id, retry_count > 0 OR coalesce(last_status_code, 0) <> 0 OR fetched_at IS NULL OR fetched_at <= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR AS refresh FROM states")
def needs_refresh(spark, sf_dir):
    return offer_states(spark, sf_dir).select("offer_id", maintenance.needs_refresh(F.lit(NOW).cast("timestamp")).alias("refresh"))


@query(f"WITH {STATES_SQL} SELECT offer_id, retry_count, last_error_at, fetched_at FROM states")
def retry_state(spark, sf_dir):
    return maintenance.retry_state(attempts(spark, sf_dir)).select("offer_id", F.col("retry_count").cast("long").alias("retry_count"), "last_error_at", "fetched_at")


@query(f"WITH {ATTEMPTS_SQL} SELECT attempt_id, CAST(nullif(regexp_extract(message, '\\b(\\d{{3}})\\b', 1), '') AS INTEGER) AS status_code FROM attempts")
def status_codes(spark, sf_dir):
    return attempts(spark, sf_dir).select("attempt_id", text.status_code(F.col("message")).alias("status_code"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice AS euro, l_extendedprice AS plain, CAST(floor(l_extendedprice) AS DOUBLE) AS grouped, CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'EUR' END AS currency,
 CASE l_linenumber % 3 WHEN 2 THEN 'SEK' WHEN 0 THEN 'USD' ELSE 'GBP' END AS page_currency FROM lineitem""")
def parse_prices(spark, sf_dir):
    """Prices written in three ways and read again."""
    price = F.col("l_extendedprice")
    euro = F.concat(F.translate(F.call_function("format_number", price, F.lit("#,##0.00")), ",.", "\u00a0,"), F.lit(" €"))
    plain = F.concat(F.lit("nyt "), F.call_function("format_number", price, F.lit("0.00")))
    grouped = F.concat(F.translate(F.call_function("format_number", F.floor(price), F.lit("#,##0")), ",", "."), F.lit(",-"))
    sign = F.element_at(F.array(F.lit("$ 5"), F.lit("£5"), F.lit("5 kr")), F.col("l_linenumber") % 3 + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", money.parse_price(euro).alias("euro"), money.parse_price(plain).alias("plain"), money.parse_price(grouped).alias("grouped"), money.currency(sign).alias("currency"), money.currency(sign, nordic=True).alias("page_currency"))


_ANCHOR = """'(?is)<a[^>]+href\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>'"""
ANCHORS_SQL = f"""a AS (SELECT page_id, url, regexp_extract_all(html, {_ANCHOR}, 1) AS h, regexp_extract_all(html, {_ANCHOR}, 2) AS t, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages),
z AS (SELECT page_id, origin, unnest(list_zip(range(len(h)), h, t)) AS x FROM a),
b AS (SELECT page_id, origin, x[1] AS pos, replace(replace(replace(replace(replace(trim(x[2]), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS href, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x[3], '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM z),
links AS (SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN origin || href ELSE href END AS link, label FROM b)"""


@query(f"WITH {ANCHORS_SQL} SELECT page_id, pos, link, label FROM links")
def page_links(spark, sf_dir):
    return pages.page_links(table(spark, sf_dir, "pages"))


@query(f"WITH {ANCHORS_SQL} SELECT link, coalesce(arg_min(label, page_id * 100000 + pos) FILTER (WHERE label <> ''), '') AS label, count(*) AS n_links FROM links GROUP BY link")
def best_label_per_url(spark, sf_dir):
    return pages.best_label(pages.page_links(table(spark, sf_dir, "pages")), order=("page_id", "pos"))


LINK_SCORE_SQL = " + ".join(f"CASE WHEN contains(t, '{w}') THEN 10 ELSE 0 END" for w in pages.PRIORITY)


_WORDS = ", ".join(f"'{w}'" for w in pages.PRIORITY)


@query(f"WITH {ANCHORS_SQL}, x AS (SELECT *, lower(link || ' ' || label || ' ' || list_extract([{_WORDS}], CAST((page_id + pos) % {len(pages.PRIORITY)} + 1 AS BIGINT))) AS t FROM links) SELECT page_id, pos, {LINK_SCORE_SQL} + CASE WHEN contains(t, '?fq=') THEN 0 ELSE 3 END + CASE WHEN contains(t, '/fi/product/list/') THEN 2 ELSE 0 END AS score FROM x")
def link_scores(spark, sf_dir):
    """The links of all pages, each with one more of the words in its label."""
    word = F.get(F.array(*[F.lit(w) for w in pages.PRIORITY]), F.pmod(F.col("page_id") + F.col("pos"), F.lit(len(pages.PRIORITY))).cast("int"))
    return pages.page_links(table(spark, sf_dir, "pages")).select("page_id", "pos", pages.keyword_score(F.col("link"), F.concat_ws(" ", "label", word)).alias("score"))


@query(f"WITH {ANCHORS_SQL}, known AS (SELECT {ADDRESS_SQL} AS url FROM pages) SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT url FROM known)")
def new_urls_anti(spark, sf_dir):
    """The links of all pages that are no page's address."""
    p = table(spark, sf_dir, "pages")
    known = p.select(F.lit("s").alias("store"), urls.strip_address(F.col("url")).alias("url"))
    return snapshots.new_urls(pages.page_links(p).select(F.lit("s").alias("store"), F.col("link").alias("url")), known).select("url")


@query(f"WITH {ANCHORS_SQL} SELECT link AS url FROM links UNION SELECT {ADDRESS_SQL} FROM pages")
def known_urls_union(spark, sf_dir):
    """The distinct addresses that are linked or are a page's."""
    p = table(spark, sf_dir, "pages")
    return pages.page_links(p).select(F.col("link").alias("url")).union(p.select(urls.strip_address(F.col("url")))).distinct()


@query(f"""WITH {ANCHORS_SQL}, r AS (SELECT CAST(row_number() OVER (ORDER BY link) AS BIGINT) + 1000000 AS id, 's' AS store, link AS url FROM (SELECT DISTINCT link FROM links WHERE link NOT IN (SELECT {ADDRESS_SQL} FROM pages)))
SELECT * FROM r UNION ALL SELECT page_id, 's', {ADDRESS_SQL} FROM pages""")
def frontier(spark, sf_dir):
    """The pages as the raw table, with a row appended for each new link."""
    p = table(spark, sf_dir, "pages")
    raw = p.select(F.col("page_id").alias("id"), F.lit("s").alias("store"), urls.strip_address(F.col("url")).alias("url"), "html")
    known = raw.unionByName(spark.range(1).select(F.lit(1000000).cast("long").alias("id"), F.lit("s").alias("store"), F.lit("last").alias("url"), F.lit("").alias("html")))
    return snapshots.append_urls(known, pages.page_links(p).select(F.lit("s").alias("store"), F.col("link").alias("url"))).where("url <> 'last'").select("id", "store", "url")


@query("SELECT page_id, url FROM pages WHERE url <> ''")
def sitemap_urls(spark, sf_dir):
    """Addresses written into one sitemap each and read again."""
    escaped = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&apos;"))
    xml = F.concat(F.lit("<?xml version='1.0'?><urlset><url><loc>\n "), escaped, F.lit(" </loc></url><url><LOC></LOC></url></urlset>"))
    rows = table(spark, sf_dir, "pages").select("page_id", xml.alias("xml")).where(pages.is_url_set(F.col("xml")) & ~pages.is_sitemap_index(F.col("xml")))
    return rows.select("page_id", F.explode(pages.sitemap_urls(F.col("xml"))).alias("url"))


def product_pages(spark: SparkSession, sf_dir: str, json_ld: bool) -> DataFrame:
    """Each part as a store's product page."""
    p = dealt(products(spark, sf_dir), "id").withColumn("price", F.round(F.col("list_price") + 0.25, 2))
    if json_ld:
        node = F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), F.struct("brand").withField("name", F.col("brand")).dropFields("brand").alias("brand"), "model", "sku", F.concat(F.lit("000"), F.col("id").cast("string")).alias("gtin13"), F.array(F.struct(F.col("price").alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))).alias("offers"))
        body = F.concat(F.lit("<html><head><script type='application/ld+json'>{broken</script><script type='application/ld+json'>"), F.to_json(F.struct(F.array(node).alias("@graph"))), F.lit("</script></head><body><h1>other</h1></body></html>"))
    else:
        body = F.concat(F.lit("<html><body><h1 itemprop='name'> "), F.col("title"), F.lit("</h1><span class='old'>9</span><span class='x price'>"), F.translate(F.call_function("format_number", F.col("price"), F.lit("#,##0.00")), ",.", "\u00a0,"), F.lit(" €</span><div class='delivery-cost'>4,99 €</div><p class='availability'>Varastossa</p><meta itemprop='brand' content='"), F.col("brand"), F.lit("'><i data-sku='1'>"), F.col("sku"), F.lit("</i></body></html>"))
    return p.select("id", F.lit("jimms.fi").alias("store"), F.lit("u").alias("url"), body.alias("html"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_size AS title, round(p_retailprice + 0.25, 2) AS price, p_brand AS brand, p_type || '-' || p_size AS model, 'SKU-' || p_partkey AS sku, '000' || p_partkey AS ean, 0.0 AS shipping, 'EUR' AS currency, true AS in_stock FROM part")
def jsonld_roundtrip(spark, sf_dir):
    r = extract.product_records(product_pages(spark, sf_dir, True))
    return r.select("id", *[f"product.{c}" for c in ("title", "price", "brand", "model", "sku", "ean", "shipping", "currency", "in_stock")])


@query("SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_size AS title, round(p_retailprice + 0.25, 2) AS price, p_brand AS brand, 'SKU-' || p_partkey AS sku, 4.99 AS shipping, 'EUR' AS currency, true AS in_stock FROM part")
def dom_roundtrip(spark, sf_dir):
    r = extract.product_records(product_pages(spark, sf_dir, False))
    return r.select("id", *[f"product.{c}" for c in ("title", "price", "brand", "sku", "shipping", "currency", "in_stock")])


@query("SELECT doc_id, md5(trim(regexp_replace(replace(lower(strip_accents(replace(text, 'ß', '\u2026'))), '&', ' ja '), '[^a-z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.slug(F.col("text"))).alias("slug"))


@query(f"WITH {ATTEMPTS_SQL} SELECT count(*) FILTER (WHERE ok) AS updated, count(*) FILTER (WHERE NOT ok) AS failed, 0 AS inserted, 0 AS linked, 0 AS created, 0 AS skipped, count(*) AS total FROM attempts")
def run_summary(spark, sf_dir):
    return maintenance.run_summary(attempts(spark, sf_dir).select(F.when(F.col("ok"), "updated").otherwise("failed").alias("status")))


@query(f"WITH {ATTEMPTS_SQL} SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS attempts, count(*) FILTER (WHERE NOT ok) AS failures FROM attempts GROUP BY 1, 2")
def window_failures(spark, sf_dir):
    return retries.window_failures(attempts(spark, sf_dir))


_LIST = "https://www.jimms.fi/fi/Product/List/B"


def store_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop's pages (url, html): its front page, one for each brand, and one for each size of a brand with its parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("size"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
    front = p.groupBy().agg(F.concat(F.lit("<nav>"), joined(F.format_string("<a href='/fi/Product/List/B%s/merkki'>Merkki <b>%s</b></a>", "b", "b")), F.lit("</nav>")).alias("html")).select(F.lit("https://www.jimms.fi/fi").alias("url"), "html")
    sizes = joined(F.format_string("<a class='k' href='/FI/product/list/B%s/koko %s/'>Koko\n <b>%s</b></a><a href='/fi/Product/List/B%s/koko?sort=%s'>s</a>", "b", "size", "size", "b", "size"))
    brands = p.groupBy("b").agg(F.concat(F.lit("<header><a href='/fi/Product/List/X1/out'>x</a></header><main>"), sizes, F.lit('<script>{"url":"/fi/Product/List/B'), F.col("b"), F.lit('/json","id":1,"name":"J&S"}</script></main>')).alias("html"))
    shown = joined(F.format_string("<a href='/fi/Product/Show/%s/%s?from=list'>%s</a>", "p_partkey", "p_name", "p_name"))
    # a task that reads pages holds all their links: the pages are dealt by their number, not by their bytes
    parts = dealt(p, "b", "size").groupBy("b", "size").agg(F.concat(F.lit("<main>"), shown, F.lit("<a href='/fi/Product/List/B"), F.col("b"), F.lit("/merkki#top'> takaisin </a></main>")).alias("html"))
    return front.union(brands.select(F.concat(F.lit(_LIST), "b", F.lit("/merkki")), "html")).union(parts.select(F.concat(F.lit(_LIST), "b", F.lit("/koko%20"), "size"), "html"))


SITE_LINKS = f"""t AS (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1) AS b, p_size FROM part), brands AS (SELECT DISTINCT b FROM t),
links AS (SELECT 'https://www.jimms.fi/fi' AS url, '{_LIST}' || b || '/merkki' AS link, 'Merkki ' || b AS label FROM brands
 UNION ALL SELECT '{_LIST}' || b || '/merkki', '{_LIST}' || b || '/koko%20' || p_size, 'Koko ' || p_size FROM t UNION ALL SELECT '{_LIST}' || b || '/merkki', 'https://www.jimms.fi/fi/Product/List/X1/out', 'x' FROM brands
 UNION ALL SELECT '{_LIST}' || b || '/merkki', '{_LIST}' || b || '/json', 'J&S' FROM brands UNION ALL SELECT '{_LIST}' || b || '/koko%20' || p_size, '{_LIST}' || b || '/merkki', 'takaisin' FROM t)"""


@query(f"WITH {SITE_LINKS} SELECT * FROM links")
def category_links(spark, sf_dir):
    return store_site(spark, sf_dir).select("url", F.explode(pages.category_links(F.col("html"))).alias("x")).select("url", F.col("x.url").alias("link"), "x.label")


@query(f"""WITH {SITE_LINKS}, s AS (SELECT url AS parent, link, 7 + CASE WHEN regexp_extract(url, '/List/([^/]+)', 1) = regexp_extract(link, '/List/([^/]+)', 1) THEN 18 ELSE 0 END AS score FROM links)
SELECT * FROM (SELECT parent, link, score, row_number() OVER (PARTITION BY parent ORDER BY score DESC, length(link), link) AS rank FROM s) WHERE rank <= 100""")
def ranked_categories(spark, sf_dir):
    links = store_site(spark, sf_dir).select(F.col("url").alias("parent"), F.explode(pages.category_links(F.col("html"))).alias("x"))
    return pages.ranked_categories(links.select("parent", F.col("x.url").alias("link")))


@query(f"SELECT '{_LIST}' || regexp_extract(p_brand, '([0-9]+)', 1) || '/koko%20' || p_size AS url, 'https://www.jimms.fi/fi/Product/Show/' || p_partkey || '/' || replace(p_name, ' ', '%20') AS product FROM part")
def product_urls(spark, sf_dir):
    return store_site(spark, sf_dir).select("url", F.explode(pages.product_links(F.col("html"))).alias("product"))


@query("SELECT p_partkey, 'https://www.power.fi/' || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'naytto-ja-' || replace(lower(p_name), ' ', '-') END || '/p-' || p_partkey || '/' AS url FROM part")
def embedded_products(spark, sf_dir):
    name = F.when(F.pmod("p_partkey", F.lit(10)) == 0, r"\u0020").otherwise(F.concat(F.lit('N\\u00e4ytt\\u00f6 & \\"'), F.col("p_name")))
    raw = F.concat(F.lit('[{"pid":"'), F.col("p_partkey").cast("string"), F.lit('","name":"'), name, F.lit('","x":1}]'))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(pages.embedded_products(raw)).alias("url"))


@query("""WITH s AS (SELECT n_name AS store, n_nationkey % 3 AS k, 'https://' || n_nationkey || '.example/' AS root FROM nation)
SELECT store, 0 AS pos, root || 'a.xml' AS url FROM s WHERE k = 0 UNION ALL SELECT store, CAST(n AS INTEGER), root || 's' || n || '.xml?a&b' FROM s, range(10) r(n) WHERE k = 1""")
def sitemap_sources(spark, sf_dir):
    """Stores whose first sitemap is a list, an index behind one that can't be read, and none."""
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("store"), F.pmod("n_nationkey", F.lit(3)).alias("k"), F.concat(F.lit("https://"), F.col("n_nationkey").cast("string"), F.lit(".example/")).alias("at"))
    candidates = s.select("store", F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.concat("at", F.lit(f"{x}.xml")).alias("url")) for n, x in enumerate("abc")])).alias("c")).select("store", "c.*")
    index = F.concat(F.lit("<SitemapIndex >"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: F.concat(F.lit("<sitemap><loc> "), F.col("at"), F.lit("s"), n.cast("string"), F.lit(".xml?a&amp;b</loc></sitemap>"))), ""), F.lit("</SitemapIndex>"))
    listed = F.lit("<urlset><url><loc>x</loc></url></urlset>")
    fetched = s.select(F.concat("at", F.lit("a.xml")).alias("url"), F.when(F.col("k") == 0, listed).when(F.col("k") == 1, "<html>").alias("xml")).union(s.select(F.concat("at", F.lit("b.xml")), F.when(F.col("k") < 2, index)))
    return pages.sitemap_sources(candidates, fetched)


_CAP = 5
_FOUND = f"{ANCHORS_SQL}, f AS (SELECT regexp_extract(link, '^[a-z]+://([^/?#]+)', 1) AS store, link AS url, page_id AS file, pos FROM links WHERE link LIKE '%://%'), n AS (SELECT store, url, min(file * 100000 + pos) AS spot FROM f WHERE url NOT IN (SELECT {ADDRESS_SQL} FROM pages) GROUP BY ALL), k AS (SELECT store, url, spot, row_number() OVER (PARTITION BY store ORDER BY spot) AS n FROM n)"


def _found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages")
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/?#]+)", 1)
    found = pages.page_links(p).where(F.col("link").contains("://")).select(host("link").alias("store"), F.col("link").alias("url"), F.col("page_id").alias("file"), "pos")
    known = p.select(urls.strip_address(F.col("url")).alias("url")).select(host("url").alias("store"), "url")
    return pages.capped_urls(found, known, _CAP, ("file", "pos"))


@query(f"WITH {_FOUND} SELECT store, url, n FROM k WHERE n <= {_CAP}")
def capped_urls(spark, sf_dir):
    """The first new links of each host, in the order of pages and places."""
    return _found(spark, sf_dir)[0]


@query(f"WITH {_FOUND}, l AS (SELECT store, spot FROM k WHERE n = {_CAP}) SELECT f.store, count(*) FILTER (WHERE spot IS NULL OR file * 100000 + pos <= spot) + max(CASE WHEN file * 100000 + pos > spot AND file = spot // 100000 THEN 1 ELSE 0 END) AS looked_at FROM f LEFT JOIN l ON f.store = l.store GROUP BY f.store")
def looked_at_urls(spark, sf_dir):
    """How many links of each host a reader looks at until it has its new ones."""
    return _found(spark, sf_dir)[1]


@query("""SELECT p_partkey, p_name AS title, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'K' || p_partkey END AS sku, '' AS ean, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN floor(p_retailprice / 1000) + 0.299 END AS price FROM part""")
def request_normalised(spark, sf_dir):
    """Requests as they come: padded titles, lists, an sku of digits, prices with commas or none."""
    key = F.col("p_partkey")
    price = F.when(key % 3 == 0, F.translate(F.call_function("format_number", "p_retailprice", F.lit("0.00")), ".", ",")).when(key % 3 == 1, F.concat(F.floor(F.col("p_retailprice") / 1000).cast("string"), F.lit(".299,00 €"))).otherwise("noin 5")
    r = table(spark, sf_dir, "part").select(key, F.concat(F.lit("\u00a0 "), "p_name", F.lit("\n")).alias("title"), F.array("p_brand", F.lit("x")).alias("brand"), F.when(key % 2 == 0, F.format_string(" 00%s ", key)).otherwise(F.format_string("K%s", key)).alias("sku"), F.lit(None).cast("string").alias("ean"), price.alias("price"))
    return refresh.request_fields(r)


REFRESHED_SQL = f"""
WITH b AS (SELECT p_partkey AS k, ['gigantti.fi', 'jimms.fi', 'power.fi', 'verkkokauppa.com', 'amazon.de', 'gone.fi'][p_partkey % 6 + 1] AS store, p_name || ' ' || p_type || ' ' || p_size AS name, round(p_retailprice + 0.25, 2) AS new_price, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS retries FROM part),
s AS (SELECT *, CASE WHEN store = 'gone.fi' THEN 'missing' WHEN k % 5 = 0 AND retries = 0 THEN 'skipped' WHEN store = 'amazon.de' THEN 'skipped' WHEN k % 13 = 0 OR k % 11 = 0 THEN 'failed' ELSE 'refreshed' END AS status FROM b)
SELECT 'https://www.' || store || '/p/' || k AS url, status, CASE WHEN status = 'skipped' THEN CASE WHEN k % 5 = 0 AND retries = 0 THEN 'fresh' ELSE 'unsupported-store' END END AS reason, CASE WHEN status = 'refreshed' THEN true END AS was_updated, CASE WHEN status = 'failed' AND k % 13 <> 0 THEN 404 END AS status_code,
 CASE WHEN status <> 'failed' THEN NULL WHEN k % 13 = 0 THEN 'fetch failed' ELSE upper(store[1]) || split_part(store[2:], '.', 1) || ' request failed: 404 Not Found' END AS error, CASE WHEN status = 'refreshed' THEN name WHEN status <> 'missing' THEN 'old' END AS title, CASE WHEN status = 'refreshed' THEN new_price WHEN status <> 'missing' THEN 1.0 END AS price,
 CASE WHEN status = 'refreshed' THEN 0 WHEN status = 'failed' THEN retries + 1 WHEN status <> 'missing' THEN retries END AS retry_count, CASE WHEN status <> 'missing' THEN status = 'refreshed' END AS linked, CASE WHEN status <> 'missing' THEN status = 'refreshed' END AS stored FROM s"""


@query(REFRESHED_SQL)
def refresh_pipeline(spark, sf_dir):
    """Every part as an offer of one of five stores, or of none, refreshed from its page, which may be missing or gone."""
    shown, old, raw, catalogue, fetched, now = shop(spark, sf_dir)
    done = refresh.refresh(old, raw, catalogue, refresh.offers_by_url(old, shown.select("url")), fetched, now, fresh_hours=12)
    state = done.offers.select("url", "title", "price", "retry_count", F.col("product_id").isNotNull().alias("linked"))
    there = done.raw.where(F.get_json_object("extracted_json", "$.inStock") == "true").select("url", F.lit(True).alias("in_raw"))
    rows = done.results.drop("offer_id").join(state, "url", "left").join(there, "url", "left")
    return rows.withColumn("stored", F.when(F.col("status") != "missing", F.coalesce("in_raw", F.lit(False)))).drop("in_raw")


def shop(spark, sf_dir):
    """Pages of the parts at six stores, offers of five of them, empty raw and product tables, fetched pages and a time."""
    key, now = F.col("id"), F.lit(NOW).cast("timestamp")
    shown = product_pages(spark, sf_dir, True).withColumn("store", F.get(F.array(*[F.lit(x) for x in ("gigantti.fi", "jimms.fi", "power.fi", "verkkokauppa.com", "amazon.de", "gone.fi")]), F.pmod(key, F.lit(6)).cast("int")))
    shown = shown.withColumn("url", F.concat(F.lit("https://www."), "store", F.lit("/p/"), key.cast("string")))
    age = F.when(key % 5 == 0, F.make_dt_interval(F.lit(0), F.lit(1))).otherwise(F.make_dt_interval(F.lit(2)))
    old = bare_offers(shown.where("store <> 'gone.fi'").select("id", "store", "url", F.when(key % 7 == 0, 1).otherwise(0).alias("retry_count"), (now - age).alias("fetched_at")))
    fetched = shown.where(key % 13 != 0).select("url", "html", F.when(key % 11 == 0, 404).otherwise(200).alias("status"), F.when(key % 11 == 0, "Not Found").otherwise("OK").alias("status_text"))
    raw, catalogue = (spark.createDataFrame([], schema) for schema in (snapshots.RAW_PRODUCTS, snapshots.PRODUCTS))
    return shown, old, raw, catalogue, fetched, now


def bare_offers(rows: DataFrame) -> DataFrame:
    """Offers (id, store, url and what else is there) with all columns of the table; old ones, of price 1."""
    have = {"title": F.lit("old"), "price": F.lit(1.0), "is_active": F.lit(1)}
    kinds = dict(x.split(" ") for x in snapshots.OFFERS.split(", "))
    return rows.select(*[F.col(c) if c in rows.columns else have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


@query(f"""
WITH s AS (SELECT p_partkey, p_name, round(p_retailprice + 0.25, 2) AS price, p_name || ' ' || p_type || ' ' || p_size AS title, p_size, '{_LIST}' || regexp_extract(p_brand, '([0-9]+)', 1) || '/koko%20' || p_size AS page, 'https://www.jimms.fi/fi/Product/Show/' || p_partkey || '/' || replace(p_name, ' ', '%20') AS url FROM part),
n AS (SELECT *, row_number() OVER (ORDER BY page, CAST(p_partkey AS VARCHAR) || '/') AS n FROM s WHERE p_size <= 25)
SELECT url, CASE WHEN p_partkey % 11 = 0 THEN 'failed' ELSE 'refreshed' END AS status, CASE WHEN p_partkey % 11 <> 0 THEN false END AS was_updated, CASE WHEN p_partkey % 11 <> 0 THEN title END AS title, CASE WHEN p_partkey % 11 <> 0 THEN price END AS price FROM n WHERE n <= 500""")
def discover_pipeline(spark, sf_dir):
    """The first 500 new products of a shop's category pages, read and stored; those of large sizes are known."""
    key = F.col("p_partkey").cast("string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.concat(F.lit("https://www.jimms.fi/fi/Product/Show/"), key, F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20"))).alias("url"))
    old = bare_offers(p.where("p_size > 25").select("id", F.lit("jimms.fi").alias("store"), "url"))
    found = store_site(spark, sf_dir).select(F.col("url").alias("file"), F.posexplode(pages.product_links(F.col("html"))).alias("pos", "url")).withColumn("store", F.lit("jimms.fi"))
    new = pages.capped_urls(found, old, 500, ("file", "pos"))[0]
    fetched = product_pages(spark, sf_dir, True).select("id", "html").join(p, "id").select("url", "html", F.when(F.col("id") % 11 == 0, 500).otherwise(200).alias("status"), F.lit("").alias("status_text"))
    raw, catalogue = (spark.createDataFrame([], schema) for schema in (snapshots.RAW_PRODUCTS, snapshots.PRODUCTS))
    done = refresh.refresh(old, raw, catalogue, refresh.discovered(new), fetched, F.lit(NOW).cast("timestamp"), unknown="insert")
    return done.results.select("url", "status", "was_updated").join(done.offers.select("url", "title", "price"), "url", "left")


@query(f"""WITH {OFFERS_SQL}, u AS (SELECT offer_id, product_id, price FROM offers WHERE product_id IS NOT NULL AND is_active = 1),
r AS (SELECT *, row_number() OVER w AS n, lead(price) OVER w AS second, count(*) OVER (PARTITION BY product_id) AS c FROM u WINDOW w AS (PARTITION BY product_id ORDER BY price, offer_id))
SELECT offer_id FROM r WHERE n = 1 AND c >= 2 AND second >= 50 AND price < second * 0.25""")
def suspicious_offers(spark, sf_dir):
    """The active offers that are far cheaper than the next one of their product."""
    return refresh.suspicious_offers(offers(spark, sf_dir).withColumnRenamed("offer_id", "id"), limit=None).select(F.col("id").alias("offer_id"))


@query("""SELECT 'jimms.fi' AS store, p_name AS title, p_retailprice AS price, 0.0 AS shipping, p_retailprice AS total, 'EUR' AS currency, 'u' || p_partkey AS url, p_brand AS brand, '' AS model, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS in_stock, 'inserted' AS op FROM part""")
def import_json(spark, sf_dir):
    """The parts as JSON files of one array each, by brand, read and written over an empty table."""
    p = table(spark, sf_dir, "part")
    item = F.struct(F.lit("jimms.fi").alias("store"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False).alias("inStock"))
    folder = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    p.groupBy(F.regexp_extract("p_brand", "([0-9]+)", 1).alias("b")).agg(F.to_json(F.collect_list(item)).alias("value")).write.partitionBy("b").text(folder)
    read = snapshots.read_offers_json(spark, f"{folder}/*")
    out = snapshots.upsert(spark.createDataFrame([], snapshots.OFFERS), read, F.lit(NOW).cast("timestamp"), reset=False)
    return out.select("store", "title", "price", "shipping", "total", "currency", "url", "brand", "model", "in_stock", "op")


@query("SELECT p_partkey, replace(replace(regexp_replace(regexp_replace(format('{:,.2f}', p_retailprice), '0+$', ''), '[.]$', ''), ',', chr(160)), '.', ',') || CASE WHEN p_partkey % 2 = 0 THEN ' EUR' ELSE ' SEK' END AS shown FROM part")
def format_prices(spark, sf_dir):
    code = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "").otherwise("SEK")
    return table(spark, sf_dir, "part").select("p_partkey", money.format_price(F.col("p_retailprice"), code).alias("shown"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_size AS title, round(p_retailprice + 0.25, 2) AS price, p_brand AS brand, '' AS sku, 'EUR' AS currency FROM part")
def browser_roundtrip(spark, sf_dir):
    """The parts' pages as the browser side reads them: identifiers count only where itemprop or data-testid names them."""
    r = extract.product_records(product_pages(spark, sf_dir, False), browser=True).where(extract.is_valid(F.col("product")))
    return r.select("id", *[f"product.{c}" for c in ("title", "price", "brand", "sku", "currency")])


_URLS = ["https://WWW.gigantti.fi/product/a b/{0}?x=1#y", "https://www.jimms.fi/FI/product/show/{0}/N%C3%A4ytt%C3%B6?ref=a", "https://power.fi/tv/p-{0}/", "http://m.verkkokauppa.com/fi/product/{0}/x?y", "https://www.jimms.fi/fi/Product/List/000-1/x/{0}?page=3", "https://www.jimms.fi/fi/Product/Show/x{0}"]


@query("""SELECT p_partkey, ['gigantti.fi', 'jimms.fi', 'power.fi', 'verkkokauppa.com', 'jimms.fi', 'jimms.fi'][p_partkey % 6 + 1] AS store, p_partkey % 6 < 4 AS product, p_partkey % 6 = 4 AS facet,
 CASE p_partkey % 6 WHEN 0 THEN 'https://www.gigantti.fi/product/a%20b/' || p_partkey WHEN 1 THEN 'https://www.jimms.fi/fi/Product/Show/' || p_partkey || '/N%C3%A4ytt%C3%B6' WHEN 2 THEN 'https://www.power.fi/tv/p-' || p_partkey || '/' WHEN 3 THEN 'https://www.verkkokauppa.com/fi/product/' || p_partkey || '/x' END AS address,
 CASE WHEN p_partkey % 6 = 4 THEN 'https://www.jimms.fi/fi/Product/List/000-1/x/' || p_partkey || '?page=3' END AS category, CASE WHEN p_partkey % 6 = 4 THEN 'fi/product/list/000-1' END AS category_key, CASE WHEN p_partkey % 6 = 4 THEN 'https://www.jimms.fi/fi/Product/List/000-1/x/' || p_partkey || '?p=4' END AS next_page FROM part""")
def store_urls(spark, sf_dir):
    """Addresses of four stores as they are written, told apart and rebuilt."""
    key = F.pmod("p_partkey", F.lit(6)).cast("int")
    url = F.get(F.array(*[F.replace(F.lit(u), F.lit("{0}"), F.col("p_partkey").cast("string")) for u in _URLS]), key)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.replace(url, F.lit(" "), F.lit("%20")).alias("u"))
    u, store = F.col("u"), urls.supported_store(F.col("u"))
    own = lambda f: F.coalesce(*[F.when(store == s, f(s)) for s in urls.PRODUCT_PATHS])
    address = own(lambda s: urls.show_url(u) if s == "jimms.fi" else urls.product_url(u, s, force_www=True, any_containing=s == "verkkokauppa.com"))
    category = urls.category_url(u, keep_page=True)
    return rows.select("p_partkey", store.alias("store"), own(lambda s: urls.is_product(u, s)).alias("product"), urls.is_facet(u).alias("facet"), address.alias("address"), category.alias("category"), F.when(category.isNotNull(), urls.category_key(category)).alias("category_key"), F.get(urls.page_candidates(category, F.lit(4)), 1).alias("next_page"))
