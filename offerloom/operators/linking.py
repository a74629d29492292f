"""Entity linking: each offer, in id order, joins the best canonical product so far or founds a new one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import delete, new_path, stored
from .matching import FIELDS, canonical_keys
from .numbering import numbered

#: Rows come in the order of (kind, id): products, then offers.
PRODUCT, OFFER = 0, 1
#: Keys of a range of open rows: they bound what a task holds.
PER_RANGE = 200_000


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of open rows (id, keys) in order: those that are decided within it, and whether they found.

    A row under a key that a founder of the range has is matched. Else, where an open row before the range, or one that is
    undecided, has one of its keys, it is undecided; else it founds.
    """
    begins, taken, unsure = None, set(), set()
    for batch in batches:
        ids, founds = [], []
        for i, keys in zip(batch.column("id").to_pylist(), batch.column("keys").to_pylist()):
            begins = i if begins is None else begins
            names = [k["key"] for k in keys]
            if not taken.isdisjoint(names):
                ids.append(i)
                founds.append(False)
            elif not unsure.isdisjoint(names) or any(k["least"] < begins for k in keys):
                unsure.update(names)
            else:
                taken.update(names)
                ids.append(i)
                founds.append(True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(founds, pa.bool_())], names=["id", "founds"])


def founders(keys: DataFrame, products: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The ids of the rows of (id, key) that found a product: those that share no key with a founder before them, nor one
    of products (key).

    Rows come in the order of their ids. In each round the open rows are dealt by ranges of per_range keys; within a range
    they are decided one after the other, but for those that hang on open rows of earlier ranges (see settle). So the
    first range is decided whole in each round, and of the others what is not chained to earlier ones: a chain of n rows
    takes n / per_range rounds at most. Rows with the same keys are one from the start on, by the first of them. A key that very many rows
    share is met by one aggregate and is in no group; each round is written to the shared folder.
    """
    spark = keys.sparkSession
    alike = keys.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys")).groupBy("keys").agg(F.min("id").alias("id"))
    every = alike.select("id", F.explode("keys").alias("key"))
    matched = every.join(products.select("key").distinct(), "key", "left_semi").select("id").distinct()
    path, out = new_path(spark, "open"), None
    still_open = stored(every.join(matched, "id", "left_anti"), "round", path)
    while n := still_open.count():
        least = still_open.groupBy("key").agg(F.min("id").alias("least"))
        rows = still_open.join(least, "key").groupBy("id").agg(F.collect_list(F.struct(F.concat_ws("|", "key.rank", "key.key").alias("key"), "least")).alias("keys"))
        decided = stored(rows.repartitionByRange(-(-n // per_range), "id").sortWithinPartitions("id").mapInArrow(settle, "id long, founds boolean"), "founders")
        first = decided.where("founds").select("id")
        out = first if out is None else out.unionByName(first)
        taken = still_open.join(first, "id", "left_semi").select("key").distinct()
        gone = decided.select("id").union(still_open.join(taken, "key", "left_semi").select("id")).distinct()
        after = new_path(spark, "open")
        still_open = stored(still_open.join(gone, "id", "left_anti"), "round", after)
        delete(spark, path)
        path = after
    delete(spark, path)
    return keys.where("false").select("id") if out is None else out


def link_offers(offers: DataFrame, products: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """(offer_id, product_id, created): the product of each offer, and whether the offer founded it.

    Linking is a fold over offers: whom an offer joins depends on products founded before. But an offer founds one just
    where no founder before it shares a key with it, so founders() finds all founders in rounds of joins; an offer then
    joins, of the founders before it, the first under the best of its keys. A new product's id follows the largest old
    one in the order of its founders. Offers without any key found a product each. Offers of one id are one offer with
    all their keys; null ids are left out. Of the products only those under a key of some offer are written on the way.
    Empty tables give empty results.
    """
    row = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"))
    offers = offers.where("offer_id is not null")
    named = lambda d, c: canonical_keys(d, c).select(F.col("id").cast("long").alias("id"), F.struct("rank", "key").alias("key"))
    asked_for = stored(named(offers, "offer_id"), "link-keys")
    known = stored(named(products.where("id is not null"), "id").join(asked_for.select("key").distinct(), "key", "left_semi"), "link-products")
    new = founders(asked_for, known, per_range)
    first = known.select("key", row(PRODUCT, "id").alias("row")).unionByName(asked_for.join(new, "id", "left_semi").select("key", row(OFFER, "id").alias("row"))).groupBy("key").agg(F.min("row").alias("founder"))
    asked = asked_for.select("key", row(OFFER, "id").alias("row")).join(first, "key").where(F.col("founder") < F.col("row"))
    best = asked.groupBy("row").agg(F.min(F.struct(F.col("key.rank").alias("rank"), "founder")).alias("best")).select(F.col("row.id").alias("offer_id"), "best.founder")
    owned = stored(offers.select(F.col("offer_id").cast("long").alias("offer_id")).distinct().join(best, "offer_id", "left").withColumn("founder", F.coalesce("founder", row(OFFER, "offer_id"))), "link-owners")
    created = owned.where(F.col("founder") == row(OFFER, "offer_id"))
    top = products.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ids = numbered(created.select("offer_id"), "offer_id").select(F.struct(F.lit(OFFER).alias("kind"), F.col("offer_id").alias("id")).alias("founder"), (top + F.col("n")).alias("new_id"))
    out = owned.join(ids, "founder", "left")
    return out.select("offer_id", F.coalesce("new_id", F.col("founder.id")).alias("product_id"), (F.col("founder") == row(OFFER, "offer_id")).alias("created"))


def founded_products(offers: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of the products that link_offers founded: id and the founder's title, brand, model, sku, ean and mpn.

    Fields that the founder lacks are ''.
    """
    fields = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in offers.columns else F.lit("").alias(f) for f in FIELDS]
    new = linked.where("created").select("offer_id", F.col("product_id").alias("id"))
    return new.join(offers.dropDuplicates(["offer_id"]).select("offer_id", *fields), "offer_id").drop("offer_id")
