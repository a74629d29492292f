"""Offers, products and attempts as views of the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt by key to all cores. A table of short rows is one file split, while the pages that a query makes of
    them are much work."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def ean_of(key: Column) -> Column:
    return F.concat(F.lit("0"), (key + 640000000000).cast("string"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", size).alias("title"), F.col("p_brand").alias("brand"), F.concat_ws("-", "p_type", size).alias("model"),
        F.concat(F.lit("SKU-"), key).alias("sku"), ean_of(F.col("p_partkey")).alias("ean"), F.concat(F.lit("MPN/"), key).alias("mpn"), F.col("p_retailprice").alias("list_price"),
    )


PRODUCTS_SQL = "products AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_size AS title, p_brand AS brand, p_type || '-' || p_size AS model, 'SKU-' || p_partkey AS sku, '0' || (p_partkey + 640000000000) AS ean, 'MPN/' || p_partkey AS mpn, p_name, p_type, p_retailprice AS list_price FROM part)"


def _by(number: Column, value: Column, *cases: int) -> Column:
    """value where number is one of cases, else ''."""
    return F.when(number.isin(*cases), value).otherwise("")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer for each lineitem, with identifiers, currencies and links to products that depend on the line's number.

    offer_id is a struct-like text key, as no column of the table is a key.
    """
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    # the texts of products come last, so that they are not dealt again with each line
    rows = l.join(s.select("s_suppkey", "s_name"), l.l_suppkey == s.s_suppkey).join(products(spark, sf_dir).drop("list_price"), l.l_partkey == F.col("id"))
    key = F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    n = F.col("l_linenumber")
    return rows.select(
        key.alias("offer_id"), F.when(n != 4, F.col("l_partkey")).alias("product_id"), F.col("s_name").alias("store"),
        F.concat("title", F.when(n == 5, " uusi malli").otherwise("")).alias("title"), F.when(n == 7, F.concat(F.lit("other "), "brand")).otherwise(F.col("brand")).alias("brand"), "model",
        _by(n, F.col("sku"), 1, 2, 5, 6, 7).alias("sku"), _by(n, F.concat_ws(" ", F.substring("ean", 1, 5), F.substring("ean", 6, 20)), 1, 4).alias("ean"), _by(n, F.col("mpn"), 1, 3, 7).alias("mpn"),
        F.col("l_extendedprice").alias("price"), (F.col("l_tax") * 100).alias("shipping"), F.when(n == 2, F.round(F.col("l_extendedprice"), 0) + 1).alias("total"),
        F.when(n == 6, "SEK").when(n == 3, "").otherwise("EUR").alias("currency"),
        F.concat(F.lit("https://www.store"), F.col("l_suppkey").cast("string"), F.lit(".example/fi/Product/Show/"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_active"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("in_stock"), F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
    )


OFFERS_SQL = f"""
{PRODUCTS_SQL},
offers AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS offer_id,
  CASE WHEN l_linenumber <> 4 THEN l_partkey END AS product_id, s_name AS store, title || CASE WHEN l_linenumber = 5 THEN ' uusi malli' ELSE '' END AS title, CASE WHEN l_linenumber = 7 THEN 'other ' ELSE '' END || brand AS brand, model,
  CASE WHEN l_linenumber IN (1, 2, 5, 6, 7) THEN sku ELSE '' END AS sku, CASE WHEN l_linenumber IN (1, 4) THEN ean[:5] || ' ' || ean[6:] ELSE '' END AS ean, CASE WHEN l_linenumber IN (1, 3, 7) THEN mpn ELSE '' END AS mpn,
  l_extendedprice AS price, l_tax * 100 AS shipping, CASE WHEN l_linenumber = 2 THEN round(l_extendedprice) + 1 END AS total, CASE l_linenumber WHEN 6 THEN 'SEK' WHEN 3 THEN '' ELSE 'EUR' END AS currency,
  'https://www.store' || l_suppkey || '.example/fi/Product/Show/' || l_partkey AS url, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_active, l_shipdate AS fetched_at
  FROM lineitem JOIN products ON l_partkey = id JOIN supplier ON l_suppkey = s_suppkey)
"""


def queries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each product, asked from a store, that lacks one field more or other from key to key."""
    p = products(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type"), "id")
    store = F.concat(F.lit("Supplier#"), F.lpad(F.pmod("id", F.lit(10)).cast("string"), 9, "0"))
    k = F.pmod("id", F.lit(8))
    return p.select(
        F.col("id").alias("query_id"), store.alias("store"), _by(k, F.lit("EUR"), 0, 1, 2, 3, 4, 5, 7).alias("currency"), F.when(k == 7, F.concat_ws(" ", "p_name", "p_type", F.lit("x999"))).otherwise(F.col("title")).alias("title"),
        _by(k, F.col("brand"), 0, 1, 2, 3, 4, 6, 7).alias("brand"), _by(k, F.col("model"), 0, 1, 2, 3, 5, 6, 7).alias("model"), _by(k, F.col("sku"), 0, 5, 6, 7).alias("sku"), _by(k, F.col("ean"), 0, 1, 5, 6, 7).alias("ean"), _by(k, F.col("mpn"), 0, 1, 2, 5, 6, 7).alias("mpn"),
    )


QUERIES_SQL = """
asked AS (SELECT id AS query_id, 'Supplier#' || lpad(CAST(id % 10 AS VARCHAR), 9, '0') AS store, CASE WHEN id % 8 = 6 THEN '' ELSE 'EUR' END AS currency, CASE WHEN id % 8 = 7 THEN p_name || ' ' || p_type || ' x999' ELSE title END AS title,
  CASE WHEN id % 8 = 5 THEN '' ELSE brand END AS brand, CASE WHEN id % 8 = 4 THEN '' ELSE model END AS model, CASE WHEN id % 8 IN (0, 5, 6, 7) THEN sku ELSE '' END AS sku, CASE WHEN id % 8 IN (0, 1, 5, 6, 7) THEN ean ELSE '' END AS ean, CASE WHEN id % 8 IN (0, 1, 2, 5, 6, 7) THEN mpn ELSE '' END AS mpn FROM products)
"""


def canonical_sql(items: str, item_id: str) -> str:
    """hits (item_id, match_rank, product_id): the canonical match of a table of items with products."""

    def keys(source: str, key: str) -> str:
        pair = "CASE WHEN trim(lower(brand)) <> '' AND regexp_replace(lower(model), '[-\\s]+', '', 'g') <> '' THEN trim(lower(brand)) || chr(1) || regexp_replace(lower(model), '[-\\s]+', '', 'g') ELSE '' END"
        ways = [f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')" for c in ("sku", "ean", "mpn")] + [pair, "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"]
        return " UNION ALL ".join(f"SELECT {key} AS id, {k} AS rank, {w} AS key FROM {source}" for k, w in enumerate(ways, 1))

    return f"""
ikeys AS (SELECT * FROM ({keys(items, item_id)}) WHERE key <> ''), pkeys AS (SELECT rank, key, min(id) AS product_id FROM ({keys('products', 'id')}) WHERE key <> '' GROUP BY rank, key),
hits AS (SELECT id AS item_id, rank AS match_rank, product_id FROM (SELECT i.id, i.rank, p.product_id, row_number() OVER (PARTITION BY i.id ORDER BY i.rank, p.product_id) AS n FROM ikeys i JOIN pkeys p ON i.rank = p.rank AND i.key = p.key) WHERE n = 1)
"""


#: The scored matcher's text of a column.
MATCH_TEXT = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9åäö+\\-.]+', ' ', 'g'))"
_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 2 AND x NOT IN ('with', 'from', 'for', 'the', 'and', 'musta', 'white', 'black')))"
_MODELS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '\\b[a-z]*\\d+[a-z0-9.-]*\\b'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> ''))"


def scored_sql(name: str, source: str, *columns: str) -> str:
    """name: the columns of source and its fields as the scored matcher sees them."""
    m = MATCH_TEXT.format("title")
    ids = [f"CASE WHEN length(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')) >= 3 THEN regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g') END AS {c}" for c in ("sku", "mpn")]
    digits = "ltrim(regexp_replace(ean, '[^0-9]', '', 'g'), '0')"
    return f"{name} AS (SELECT {', '.join(columns)}, coalesce({MATCH_TEXT.format('brand')}, '') AS brand, CASE WHEN length({digits}) >= 8 THEN {digits} END AS ean, {', '.join(ids)}, {_TOKENS.format(m)} AS tokens, {_MODELS.format(m)} AS models FROM {source})"


#: Reason and score of a pair of scored rows q and o of other stores.
_JACCARD = "(len(list_intersect(q.tokens, o.tokens)) / len(list_distinct(list_concat(q.tokens, o.tokens))))"
REASON_SQL = f"""CASE WHEN q.brand <> '' AND o.brand <> '' AND q.brand <> o.brand THEN 'brand mismatch' WHEN len(q.models) > 0 AND len(o.models) > 0 AND NOT list_has_any(q.models, o.models) THEN 'model token mismatch'
 WHEN q.ean = o.ean THEN 'EAN exact match' WHEN q.brand <> '' AND o.brand <> '' AND q.mpn = o.mpn THEN 'brand + MPN exact match' WHEN q.brand <> '' AND o.brand <> '' AND q.sku = o.sku THEN 'brand + SKU exact match'
 WHEN len(q.tokens) > 0 AND len(o.tokens) > 0 AND {_JACCARD} >= 0.75 THEN 'strong title overlap' WHEN len(q.tokens) > 0 AND len(o.tokens) > 0 AND {_JACCARD} >= 0.55 THEN 'possible title match' ELSE 'too weak' END"""
SCORE_SQL = "CASE match_reason WHEN 'EAN exact match' THEN 100 WHEN 'brand + MPN exact match' THEN 97 WHEN 'brand + SKU exact match' THEN 88 WHEN 'strong title overlap' THEN 80 WHEN 'possible title match' THEN 68 ELSE -1 END"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: an error event is a failed one of the offer that the user id stands for; some were not found."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.pmod("event_id", F.lit(7)) == 0, 404).otherwise(F.regexp_extract("props", r"(\d+)", 1).cast("int") + 350)
    return e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("offer_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("request failed: "), code, F.lit(" status")).alias("message"))


ATTEMPTS_SQL = "attempts AS (SELECT event_id AS attempt_id, user_id AS offer_id, ts, event_type <> 'error' AS ok, 'request failed: ' || CASE WHEN event_id % 7 = 0 THEN 404 ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) + 350 END || ' status' AS message FROM events)"


def offer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with their maintenance columns from the attempts; some are not active, of some it isn't known."""
    from ..functions import text
    from ..operators.maintenance import retry_state

    a = attempts(spark, sf_dir)
    last = a.groupBy("offer_id").agg(F.max_by(F.struct("ok", "message"), F.struct("ts", "attempt_id")).alias("x"))
    s = retry_state(a).join(last, "offer_id")
    bad = ~F.col("x.ok")
    active = F.when(F.pmod("offer_id", F.lit(9)) == 0, 0).when(F.pmod("offer_id", F.lit(9)) > 1, 1)
    return s.select("offer_id", active.alias("is_active"), "retry_count", F.when(bad, F.col("x.message")).alias("last_error"), "last_error_at", F.when(bad, text.status_code(F.col("x.message"))).alias("last_status_code"), "fetched_at")


STATES_SQL = f"""{ATTEMPTS_SQL},
runs AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY offer_id ORDER BY ts, attempt_id) AS run, row_number() OVER (PARTITION BY offer_id ORDER BY ts DESC, attempt_id DESC) AS back FROM attempts),
lastrun AS (SELECT offer_id, max(run) AS run FROM runs GROUP BY offer_id),
retry AS (SELECT r.offer_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS retry_count, max(CASE WHEN NOT ok THEN ts END) AS last_error_at, max(CASE WHEN ok THEN ts END) AS fetched_at FROM runs r JOIN lastrun l ON r.offer_id = l.offer_id AND r.run = l.run GROUP BY r.offer_id),
states AS (SELECT t.offer_id, CASE WHEN t.offer_id % 9 = 0 THEN 0 WHEN t.offer_id % 9 > 1 THEN 1 END AS is_active, retry_count, CASE WHEN NOT b.ok THEN b.message END AS last_error, last_error_at, CASE WHEN NOT b.ok THEN CAST(regexp_extract(b.message, '\\b(\\d{{3}})\\b', 1) AS INTEGER) END AS last_status_code, fetched_at FROM retry t JOIN runs b ON t.offer_id = b.offer_id AND b.back = 1)
"""
