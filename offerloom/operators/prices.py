"""Price analytics: the lowest two prices of each product and suspiciously low ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lowest_two(offers: DataFrame, product: str, price: str, *ties: str) -> DataFrame:
    """Per product: x (price, ties and the other columns of its cheapest row), second_price (null with one row), offer_count.

    Each task keeps two rows of a product before they are dealt, and its counts are summed up before that, so a product with
    very many offers costs no more than others.
    """
    order = Window.partitionBy(product).orderBy(F.asc(price), *[F.asc(t) for t in ties])
    two = offers.withColumn("__rank", F.row_number().over(order)).where("__rank <= 2")
    first, second = (F.max(F.when(F.col("__rank") == k, x)) for k, x in ((1, F.struct(*offers.columns)), (2, F.col(price))))
    lowest = two.groupBy(product).agg(first.alias("x"), second.alias("second_price"))
    return lowest.join(offers.groupBy(product).agg(F.count("*").alias("offer_count")), product)


def usable(url: Column, active: Column, price: Column, product: Column) -> Column:
    """Linked, priced, with an address, and active (null counts as active)."""
    return product.isNotNull() & price.isNotNull() & (F.coalesce(url, F.lit("")) != "") & (F.coalesce(active, F.lit(1)) == 1)


def price_outliers(offers: DataFrame, product: str, price: str, ties: tuple[str, ...], ratio: float = 0.25, least_second: float = 50.0, limit: int | None = 200) -> DataFrame:
    """The cheapest offer of each product with two or more, where the second price is least_second or more and ratio
    times it is over the cheapest. Highest second price first, then lowest price, then product and ties; limit rows.
    """
    top = lowest_two(offers.where(F.col(product).isNotNull() & F.col(price).isNotNull()), product, price, *ties).where("offer_count >= 2")
    low = top.where((F.col("second_price") >= least_second) & (F.col("x")[price] < F.col("second_price") * ratio)).select("x.*", "second_price", "offer_count")
    return low if limit is None else low.orderBy(F.desc("second_price"), F.asc(price), F.asc(product), *[F.asc(t) for t in ties]).limit(limit)


def second_prices(offers: DataFrame, product: str, price: str, *ties: str) -> DataFrame:
    """Per product: lowest_price, second_price (null with one offer) and offer_count."""
    return lowest_two(offers, product, price, *ties).select(product, F.col("x")[price].alias("lowest_price"), "second_price", "offer_count")
