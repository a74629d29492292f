"""Prices: rounding, totals, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BOUNDARY, WS, bound

#: How currencies are named.
CURRENCIES = {"USD": rf"\$|(?i:{BOUNDARY}USD{BOUNDARY})", "GBP": f"£|(?i:{BOUNDARY}GBP{BOUNDARY})", "SEK": f"kr|(?i:{BOUNDARY}(?:SEK|NOK|DKK){BOUNDARY})"}
#: Fixed value: a number with thousands groups or plain, with up to two decimals.
PRICE = r"(?:\d{1,3}(?:[.,\s]\d{3})+|\d+)(?:[.,]\d{1,2})?"


def round2(c: Column) -> Column:
    """Two decimals of the exact binary value, ties away from zero.

    Ties exist only at multiples of 1/8, which round() treats so; all other values have one nearest. Null and
    values that are not finite give null.
    """
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    v = F.when(finite, c)
    return F.when(v * 8 == F.floor(v * 8), F.round(v, 2)).otherwise(F.call_function("format_number", v, F.lit("0.00")).cast("double"))


def total(price: Column, shipping: Column) -> Column:
    """Price and shipping (null: 0), rounded; null without a price."""
    return round2(price + F.coalesce(shipping, F.lit(0.0)))


def stored_total(stored: Column, price: Column, shipping: Column) -> Column:
    """The stored total, or a total in which a null price counts as 0."""
    return F.coalesce(stored, round2(F.coalesce(price, F.lit(0.0)) + F.coalesce(shipping, F.lit(0.0))))


def price_number(t: Column) -> Column:
    """'1.299,00' and the like with a dot for decimals and no groups.

    With both signs the later one is decimal. A sign that occurs twice or more, or once before three or no
    digits, parts thousands.
    """
    return bound(F.translate(t, " \t\n\x0b\f\r", ""), _plain_number)


def _plain_number(t: Column) -> Column:
    dots, commas = (F.length(t) - F.length(F.translate(t, sign, "")) for sign in ".,")
    after = F.when(dots > 0, F.length(F.substring_index(t, ".", -1))).otherwise(F.length(F.substring_index(t, ",", -1)))
    bare = F.translate(t, ".,", "")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    return (
        F.when((dots > 0) & (commas > 0), F.when(comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))))
        .when((dots + commas > 1) | ((dots + commas == 1) & after.isin(0, 3)), bare)
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )


def parse_price(c: Column) -> Column:
    """The first price in a text as a double, or null."""
    t = F.regexp_replace(c, f"{WS}+", " ")
    return bound(F.regexp_extract(t, PRICE, 0), lambda found: F.when(found != "", price_number(found).cast("double")))


def currency(c: Column, nordic: bool = False) -> Column:
    """USD or GBP by sign or code, with nordic also SEK for crowns, else EUR."""
    out = F.when(c.rlike(CURRENCIES["USD"]), "USD").when(c.rlike(CURRENCIES["GBP"]), "GBP")
    if nordic:
        out = out.when(c.rlike(CURRENCIES["SEK"]), "SEK")
    return out.otherwise("EUR")


def cheaper_now(current: Column, cheapest: Column) -> Column:
    """The current price is a number and no higher than the cheapest total."""
    return F.coalesce(~F.isnan(current) & (current <= cheapest), F.lit(False))


def format_price(value: Column, code: Column) -> Column:
    """Grouped by no-break spaces, a decimal comma, at most two decimals, then the currency (EUR if none)."""
    v = F.coalesce(value, F.lit(0.0))
    grouped = F.translate(F.call_function("format_number", v, F.lit("#,##0.##")), ",.", "\u00a0,")
    shown = F.when(F.isnan(v) | (F.abs(v) == float("inf")), v.cast("string")).otherwise(grouped)
    return F.concat(shown, F.lit(" "), F.when(F.coalesce(code, F.lit("")) == "", "EUR").otherwise(code))
