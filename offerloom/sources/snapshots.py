"""Tables of offers as versioned snapshots, with upserts by (store, url), and the JSON file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money
from ..operators.numbering import numbered
from .scratch import stored

#: The three stored tables. Timestamps are UTC.
PRODUCTS = "id long, title string, brand string, model string, sku string, ean string, mpn string, created_at timestamp, updated_at timestamp"
OFFERS = (
    "id long, product_id long, store string, title string, price double, shipping double, total double, currency string, url string, brand string, model string, sku string, ean string, mpn string, "
    "in_stock int, is_active int, retry_count int, last_error string, last_error_at timestamp, last_status_code int, fetched_at timestamp"
)
RAW_PRODUCTS = "id long, store string, url string, html string, extracted_json string, fetched_at timestamp"
#: Columns without nulls, by table.
REQUIRED = {"products": ("title",), "offers": ("store", "title", "url"), "raw_store_products": ("store", "url")}
OFFER_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("store", "title")]
    + [T.StructField(c, T.DoubleType()) for c in ("price", "shipping", "total")]
    + [T.StructField(c, T.StringType()) for c in ("currency", "url", "brand", "model", "sku", "ean", "mpn")]
    + [T.StructField("inStock", T.BooleanType())]
)
KEY = ("store", "url")
#: Columns that an upsert sets from a new row, even to null.
DATA = ("title", "price", "shipping", "total", "currency", "brand", "model", "sku", "ean", "mpn", "in_stock", "extracted_json")


def create_tables(spark: SparkSession, database: str) -> None:
    """The three tables, empty, in a database; those that are there stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in (("products", PRODUCTS), ("offers", OFFERS), ("raw_store_products", RAW_PRODUCTS)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def checked(df: DataFrame, table: str) -> DataFrame:
    """df, whose rows raise an error where a required column of the table is null."""
    bad = F.lit(False)
    for c in REQUIRED[table]:
        bad = bad | F.col(c).isNull()
    first = REQUIRED[table][0]
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit(f"a required column of {table} is null"))).otherwise(F.col(first)))


def read_offers_json(spark: SparkSession, path: str) -> DataFrame:
    """Offers of JSON files that hold one array each; another top-level value is an error. pos is the place in the file.

    A file's objects are parsed one by one as they are read, so that no file is a string. Its first sign that is not blank is
    looked up apart, in the pieces between commas.
    """
    piece = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.regexp_extract("value", r"^\uFEFF?\s*(\S)", 1).alias("sign"))
    kinds = piece.where("sign <> ''").groupBy("file").agg(F.min_by("sign", "at").alias("sign"))
    fault = F.raise_error(F.lit("the file must hold an array of offers"))
    # an empty file has no first sign; the files themselves are few beside their rows
    checked = kinds.select("file", F.when(F.col("sign") == "[", True).otherwise(fault.cast("boolean")).alias("is_array"))
    read = spark.read.schema(OFFER_SCHEMA).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("__n"))
    of = read.join(checked, "file").where("is_array")
    rows = of.withColumn("pos", (F.col("__n") - F.min("__n").over(Window.partitionBy("file"))).cast("int")).drop("file", "__n", "is_array")
    text = {c: F.coalesce(c, F.lit("")) for c in ("store", "title", "url", "brand", "model", "sku", "ean", "mpn")}
    out = rows.withColumns(text | {"currency": F.coalesce("currency", F.lit("EUR")), "shipping": F.coalesce("shipping", F.lit(0.0)), "in_stock": F.col("inStock").cast("int")})
    return out.withColumn("total", F.coalesce("total", money.total(F.col("price"), F.col("shipping")))).drop("inStock")


def last_of_batch(batch: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key, as if the rows were written one after the other; seen is the first one's place."""
    return batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("x"), F.min(F.struct(*order)).alias("seen")).select("x.*", "seen")


def upsert(old: DataFrame, batch: DataFrame, now, reset: bool = True, order: tuple[str, ...] = ("pos",), top: int | None = None) -> DataFrame:
    """old with the batch's rows written over it by key: the columns of old and op (kept, updated, inserted).

    A new row's data columns win even where null; id and product_id stay. reset (a scrape, not an import) also sets
    is_active 1, retry_count 0 and no last error. New keys get ids after top, or after the largest old one, in batch order.
    Null keys match null keys. The batch's last rows are written once; only new keys and their places are numbered.
    """
    new = stored(last_of_batch(batch, KEY, *order), "upsert-batch")
    renamed = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_there"))
    same = F.col("store").eqNullSafe(F.col("n_store")) & F.col("url").eqNullSafe(F.col("n_url"))
    there = F.col("n_there").isNotNull()
    highest = old.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top is None else F.lit(top).cast("long")
    fresh = renamed.select("n_store", "n_url", "n_seen").join(old.select("store", "url"), same, "left_anti")
    ids = numbered(fresh, "n_seen", "n_store", "n_url", name="__n").select(F.col("n_store").alias("__store"), F.col("n_url").alias("__url"), (highest + F.col("__n")).alias("__id"))
    inserted = renamed.join(ids, F.col("n_store").eqNullSafe(F.col("__store")) & F.col("n_url").eqNullSafe(F.col("__url")))

    given = {c: F.col(f"n_{c}") for c in DATA if c in old.columns and c in new.columns} | {"fetched_at": now}
    if reset:
        blank = {"is_active": F.lit(1), "retry_count": F.lit(0), "last_error": F.lit(None), "last_error_at": F.lit(None), "last_status_code": F.lit(None)}
        given |= {c: v for c, v in blank.items() if c in old.columns}
    kind = lambda c: old.schema[c].dataType
    first = {"id": F.col("__id"), "store": F.col("n_store"), "url": F.col("n_url")} | given
    kept = old.join(renamed, same, "left").select(*[F.when(there, given[c].cast(kind(c))).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns], F.when(there, "updated").otherwise("kept").alias("op"))
    return kept.unionByName(inserted.select(*[first.get(c, F.lit(None)).cast(kind(c)).alias(c) for c in old.columns], F.lit("inserted").alias("op")))


def new_urls(found: DataFrame, *known: DataFrame) -> DataFrame:
    """Distinct (store, url) of found that no known table has."""
    all_known = known[0].select("store", "url")
    for k in known[1:]:
        all_known = all_known.union(k.select("store", "url"))
    return found.select("store", "url").distinct().join(all_known.distinct(), ["store", "url"], "left_anti")


def version_path(root: str, version: int) -> str:
    return f"{root}/v={version:08d}"


def write_snapshot(df: DataFrame, root: str, version: int, again: bool = False) -> str:
    """A new folder for each version; nothing that is read is written over. again: a version may be written once more."""
    path = version_path(root, version)
    df.write.mode("overwrite" if again else "errorifexists").parquet(path)
    return path


def append_urls(old: DataFrame, found: DataFrame, *known: DataFrame) -> DataFrame:
    """The raw table old with a row for each address of found that neither it nor known has: no html, no JSON, ids after
    the largest old one in the order of (store, url)."""
    new = new_urls(found, old, *known).where("store is not null and url is not null")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = numbered(new, "store", "url").withColumn("id", top + F.col("n"))
    empty = [F.col(c) if c in ("id", "store", "url") else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    return old.unionByName(rows.select(*empty))


def response_json(matches: DataFrame) -> DataFrame:
    """One JSON object for each match, with the names an interface expects; null fields are left out."""
    shown = [c for c in ("store", "title", "price", "shipping", "total", "currency", "url") if c in matches.columns]
    fetched = [F.col("fetched_at").alias("fetchedAt")] if "fetched_at" in matches.columns else []
    fields = F.struct(F.col("offer_id").alias("id"), *shown, *fetched, F.col("match_score").alias("matchScore"), F.col("match_reason").alias("matchReason"))
    return matches.select("query_id", "offer_id", F.to_json(fields).alias("match"))
