"""JSON kept as VARIANT: parsed once, read by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a stored product record, by path, as an extractor wrote them.
RECORD = {
    "store": "string", "title": "string", "price": "double", "shipping": "double", "total": "double", "currency": "string", "url": "string",
    "brand": "string", "model": "string", "sku": "string", "ean": "string", "mpn": "string", "inStock": "boolean",
}


def parsed(json: Column) -> Column:
    """The text as VARIANT; null where it is null or no JSON."""
    return F.try_parse_json(json)


def record(v: Column) -> Column:
    """A stored product record as a struct; a field that is missing, or of another kind, is null."""
    return F.struct(*[F.try_variant_get(v, f"$.{name}", kind).alias("in_stock" if name == "inStock" else name) for name, kind in RECORD.items()])


def ld_product(v: Column) -> Column:
    """name, brand, sku, price, currency of a JSON-LD product at the usual places: itself, mainEntity, or first in @graph.

    Products deeper than that need extract.product_records, which walks the whole value.
    """

    def at(root: str) -> Column:
        text = lambda path: F.try_variant_get(v, f"{root}.{path}", "string")
        number = lambda path: F.try_variant_get(v, f"{root}.{path}", "double")
        fields = F.struct(
            text("name").alias("name"), F.coalesce(text("brand.name"), text("brand")).alias("brand"), text("sku").alias("sku"),
            F.coalesce(number("offers[0].price"), number("offers.price")).alias("price"), F.coalesce(text("offers[0].priceCurrency"), text("offers.priceCurrency")).alias("currency"),
        )
        return F.when(F.lower(F.try_variant_get(v, f'{root}["@type"]', "string")) == "product", fields)

    return F.coalesce(at("$"), at('$["@graph"][0]'), at("$.mainEntity"))
