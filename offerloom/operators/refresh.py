"""Refreshing offers from fetched pages: choose, extract, store, link, with a status for each address that was asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text, urls
from ..sources import snapshots
from ..sources.buckets import Buckets
from ..sources.scratch import stored
from . import extract, linking, maintenance, prices

STATUSES = ("missing", "skipped", "refreshed", "failed")
#: Fixed value: so many addresses a request may have refreshed.
MOST = 3
TEXTS = ("title", "brand", "model", "sku", "ean", "mpn")


def request_fields(requests: DataFrame) -> DataFrame:
    """requests as a comparison asks for them: text columns trimmed, '' for null, an sku of digits alone ''.

    A column may be an array, of which the first counts. price is the number that its text begins with, the first comma
    taken for a dot, or null. Columns that a request doesn't have are left out; other columns stay.
    """

    def first(c: str) -> Column:
        kind = requests.schema[c].dataType.simpleString()
        return (F.get(F.col(c), 0) if kind.startswith("array") else F.col(c)).cast("string")

    out = {c: text.trim_ws(F.coalesce(first(c), F.lit(""))) for c in (*TEXTS, "store", "currency", "url") if c in requests.columns}
    if "sku" in out:
        out["sku"] = text.bound(out["sku"], lambda t: F.when(t.rlike("^[0-9]+$"), "").otherwise(t))
    if "price" in requests.columns:
        number = F.regexp_extract(F.regexp_replace(first("price"), "^([^,]*),", "$1."), rf"^{text.WS}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
        out["price"] = text.bound(number, lambda t: F.when(t != "", t).cast("double"))
    return requests.withColumns(out)


def scraped(products: DataFrame) -> DataFrame:
    """Extracted products as they are stored: '' for missing texts, EUR, shipping 0, a rounded total, in_stock 0 or 1."""
    shipping = F.coalesce("shipping", F.lit(0.0))
    total = F.coalesce(money.round2(F.col("total")), money.total(F.col("price"), shipping))
    texts = {c: F.coalesce(c, F.lit("")) for c in TEXTS}
    return products.withColumns(texts | {"shipping": shipping, "total": total, "currency": F.when(F.coalesce("currency", F.lit("")) == "", "EUR").otherwise(F.col("currency")), "in_stock": F.coalesce(F.col("in_stock"), F.lit(False)).cast("int")})


def known_offers(offers: DataFrame) -> DataFrame:
    """The active offers with an address, as a job over all of them takes them."""
    return offers.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("is_active", F.lit(1)) == 1)).select("id", "store", "url")


def offers_by_title(offers: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """The newest offers with an address whose title holds a term."""
    found = offers.where(text.contains_term(F.col("title"), term) & (F.coalesce("url", F.lit("")) != ""))
    return found.orderBy(F.desc_nulls_last("fetched_at"), "id").limit(limit).select("id", "store", "url")


def suspicious_offers(offers: DataFrame, ratio: float = 0.25, least_second: float = 50.0, limit: int | None = 200) -> DataFrame:
    """The offers whose price is far below the next one of their product (see prices.price_outliers)."""
    rows = offers.where(prices.usable(F.col("url"), F.col("is_active"), F.col("price"), F.col("product_id")))
    return prices.price_outliers(rows.select("product_id", "price", "id", "store", "url"), "product_id", "price", ("id",), ratio, least_second, limit).select("id", "store", "url")


def offers_by_url(offers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per distinct address of wanted (url): the first offer of it, with null id and store where there is none."""
    first = offers.groupBy("url").agg(F.min_by(F.struct("id", "store"), "id").alias("x")).select("url", "x.*")
    return wanted.select("url").where("url <> ''").distinct().join(first, "url", "left").select("id", "store", "url")


def requested(matches: DataFrame, by: str = "query_id", order: str = "match_rank", limit: int = MOST) -> DataFrame:
    """The addresses of each request's best matches that are refreshed after it was answered: 1 to MOST of them."""
    return matches.where(F.col(order) <= max(1, min(limit, MOST))).where("url <> ''").select(by, "url")


@dataclass
class Refreshed:
    """Tables after a refresh, the products it founded, and results: url, status, reason, offer_id, was_updated,
    status_code, error."""

    offers: DataFrame
    raw: DataFrame
    products: DataFrame
    results: DataFrame
    founded: DataFrame


def refresh(offers: DataFrame, raw: DataFrame, products: DataFrame, chosen: DataFrame, pages: DataFrame, now: Column, fresh_hours: int | None = None, unsupported: str = "skipped", unknown: str = "missing", tops: tuple[int | None, int | None] = (None, None)) -> Refreshed:
    """Offers written anew from their pages, the raw table, products founded by linking, and a result for each chosen row.

    chosen: (id, store, url), one row for each address, null ids for unknown ones: these are missing, or, if unknown is
    "insert", read and stored as new offers. pages: (url, html, status,
    status_text); a null html or a status outside 200 to 299 is a failure, as is no row at all. fresh_hours skips offers
    that are fresh (maintenance.needs_refresh). An offer of a store without an extractor is skipped, or failed if
    unsupported says so. Failures add one to the offer's retries and leave its data as it is. Refreshed offers are linked
    in the order of their ids; a match before stays where linking finds no other. Empty tables give empty results.
    offers and raw may be the parts of larger tables that hold all rows of the chosen addresses; tops are then the largest
    ids of the two whole tables. What linking and failures change is joined to the rows that were asked for; all other
    rows only pass through.
    """
    state = maintenance.migrated(offers)
    store = urls.store_of(F.col("store"), F.col("url"))
    fresh = F.lit(False) if fresh_hours is None else F.col("id").isNotNull() & ~maintenance.needs_refresh(now, fresh_hours)
    chosen = stored(chosen.select("url", "store", "id"), "refresh-chosen")
    asked = chosen.join(state.select("id", "retry_count", "last_status_code", "fetched_at"), "id", "left").withColumns({"store": store, "fresh": fresh})
    known = F.col("store").isin(*extract.STORES)
    # of the pages only those that were asked for are told apart: others are not sorted with their html
    read = pages.select("url", "html", "status", "status_text").join(chosen.select("url"), "url", "left_semi").dropDuplicates(["url"])
    got = asked.join(read.withColumn("read", F.lit(True)), "url", "left")
    right_host = F.coalesce(urls.host(F.col("url")).contains(F.col("store")), F.lit(False))
    fine = F.col("html").isNotNull() & F.col("status").between(200, 299)
    name = F.initcap(F.substring_index("store", ".", 1))
    error = (
        F.when(~right_host, F.concat(F.lit("only supports "), "store", F.lit(" URLs")))
        .when(F.col("read").isNull(), "fetch failed")
        .when(~fine, F.concat(name, F.lit(" request failed: "), F.coalesce(F.col("status").cast("string"), F.lit("")), F.lit(" "), F.coalesce("status_text", F.lit(""))))
    )
    judged = got.withColumn("error", F.when(known, error)).withColumn(
        "status",
        F.when(F.col("id").isNull() & F.lit(unknown == "missing"), "missing").when(F.col("fresh"), "skipped").when(~known, unsupported).when(F.col("error").isNotNull(), "failed").otherwise("refreshed"),
    )
    reason = F.when(F.col("status") == "missing", None).when(F.col("fresh"), "fresh").when(~known, "unsupported-store")
    judged = stored(judged.withColumn("reason", reason).select("url", "store", "id", "status", "reason", F.when(F.col("status") == "failed", F.col("error")).alias("error"), F.when(F.col("status") == "refreshed", F.col("html")).alias("html")), "refresh-judged", compression="zstd")
    records = stored(extract.product_records(judged.where("status = 'refreshed'")).select(F.col("id").alias("pos"), "product.*"), "refresh-records")

    written = stored(snapshots.upsert(state, scraped(records), now, top=tops[0]), "refresh-offers")
    batch = records.select("pos", "store", "url", F.to_json(F.struct(*[c for c in records.columns if c not in ("pos", "in_stock")], F.col("in_stock").alias("inStock")), {"ignoreNullFields": "false"}).alias("extracted_json"))
    new_raw = snapshots.upsert(raw, batch, now, reset=False, top=tops[1]).drop("op")

    touched = written.where("op <> 'kept'").withColumn("offer_id", F.col("id"))
    linked = stored(linking.link_offers(touched, products), "refresh-linked")
    founded = linking.founded_products(touched, linked)
    fk = linked.select(F.col("offer_id").alias("id"), F.col("product_id").alias("linked_to"))
    failures = judged.where("status = 'failed' and error is not null").select("id", F.col("error").alias("new_error"), text.status_code(F.col("error")).alias("new_code"))
    changes = fk.join(failures, "id", "full")
    both = written.join(changes, "id", "left").withColumn("product_id", F.coalesce("linked_to", "product_id")).drop("linked_to")
    done = maintenance.with_failures(both, now).select(*state.columns)

    upserted = written.where("op <> 'kept'").select("url", "store", F.col("id").alias("offer_id"), (F.col("op") == "updated").alias("was_updated"))
    results = judged.drop("html").join(upserted, ["url", "store"], "left").select("url", "status", "reason", F.coalesce("offer_id", "id").alias("offer_id"), "was_updated", text.status_code(F.col("error")).alias("status_code"), "error")
    return Refreshed(done, new_raw, products.unionByName(founded, allowMissingColumns=True), results, founded)


def discovered(found: DataFrame) -> DataFrame:
    """The addresses (store, url) that a discovery found, as refresh takes them with unknown="insert"."""
    return found.select(F.lit(None).cast("long").alias("id"), "store", "url")


def summary(done: Refreshed) -> DataFrame:
    """One row of counters of a refresh (see maintenance.run_summary)."""
    fresh = F.when(F.col("status") == "refreshed", F.when(F.col("was_updated"), "updated").otherwise("inserted")).when(F.col("status") == "failed", "failed").otherwise("skipped")
    return maintenance.run_summary(done.results.select(fresh.alias("status")))


@dataclass(frozen=True)
class Store:
    """The tables of a refresh stream under one root: offers, raw and products in buckets, results by batch."""

    root: str
    buckets: int = 64

    @property
    def offers(self) -> Buckets:
        return Buckets(f"{self.root}/offers", snapshots.OFFERS, self.buckets)

    @property
    def raw(self) -> Buckets:
        return Buckets(f"{self.root}/raw", snapshots.RAW_PRODUCTS, self.buckets)

    @property
    def products(self) -> Buckets:
        return Buckets(f"{self.root}/products", snapshots.PRODUCTS, self.buckets, "id")

    def results(self, version: int) -> str:
        return snapshots.version_path(f"{self.root}/results", version)

    def begin(self, offers: DataFrame, raw: DataFrame, products: DataFrame) -> None:
        """Write the tables as version 0."""
        for table, rows in ((self.offers, offers), (self.raw, raw), (self.products, products)):
            table.write(rows, 0)

    def apply(self, batch: DataFrame, n: int, pages: DataFrame, now: Column, fresh_hours: int | None = 12) -> None:
        """Refresh the offers of a batch (url) against version n, and write version n + 1.

        Of offers and raw only the buckets of the batch's addresses are read, and only those of addresses that were
        refreshed or failed are written. Products are read for their keys; of a bucket of theirs that gets new ones a new
        folder is written.
        """
        spark = batch.sparkSession
        asked = stored(batch.select("url").where("url <> ''").distinct(), "asked")
        touched = self.offers.touched(asked)
        offers, raw = (t.read(spark, n, touched) for t in (self.offers, self.raw))
        products = self.products.read(spark, n)
        tops = [t.top(spark, n) for t in (self.offers, self.raw, self.products)]
        done = refresh(offers, raw, products, offers_by_url(offers, asked), pages, now, fresh_hours, tops=(tops[0], tops[1]))
        results = stored(done.results, "refresh-results")
        changed = self.offers.touched(results.where("status in ('refreshed', 'failed')"))
        number = self.offers.number()
        self.offers.write(done.offers.where(number.isin(changed)), n + 1, tops[0])
        self.raw.write(done.raw.where(number.isin(changed)), n + 1, tops[1])
        founded = stored(_as_schema(done.founded, snapshots.PRODUCTS), "refresh-founded")
        grown = self.products.touched(founded)
        self.products.write(self.products.read(spark, n, grown).unionByName(founded) if grown else founded, n + 1, tops[2])
        results.write.mode("overwrite").parquet(self.results(n + 1))


def _as_schema(rows: DataFrame, schema: str) -> DataFrame:
    kinds = dict(x.split(" ") for x in schema.split(", "))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def refresh_stream(requests: DataFrame, store: Store, pages: DataFrame, now: Column, checkpoint: str, fresh_hours: int | None = 12, vacuum_every: int = 20):
    """A streaming query that refreshes the offers a stream of (url) asks for, batch by batch.

    Version 0 of the store's tables is there at the start (Store.begin). Batch n reads version n and writes version n + 1,
    so that a batch that runs again writes the same again. Folders that only older versions read go now and then.
    """

    def step(batch: DataFrame, n: int) -> None:
        store.apply(batch, n, pages, now, fresh_hours)
        if vacuum_every and n and n % vacuum_every == 0:
            for t in (store.offers, store.raw, store.products):
                t.vacuum(batch.sparkSession, n)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
