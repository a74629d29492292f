"""Expected values were worked out by hand from the rules in the docstrings."""

import math

import pytest
from pyspark.sql import functions as F

from offerloom.functions import money, text, urls


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value, want", [("1 299,00 €", 1299.0), ("1 299,00 €", 1299.0), ("1.299,50", 1299.5), ("1,299.50", 1299.5), ("12.990", 12990.0), ("0.125", 125.0), ("-5,9", 5.9), ("99,-", 99.0), ("1234.567", 1234.56), ("no", None), (None, None), ("", None)])
def test_parse_price(spark, value, want):
    assert one(spark, money.parse_price, value) == want


@pytest.mark.parametrize("value, want", [(1.005, 1.0), (2.675, 2.67), (0.125, 0.13), (-0.125, -0.13), (1e15, 1e15), (None, None), (math.nan, None), (math.inf, None)])
def test_round2(spark, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(money.round2(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("value, want", [("$5", "USD"), ("5 GBP", "GBP"), ("5 kr", "EUR"), (None, "EUR")])
def test_currency(spark, value, want):
    assert one(spark, money.currency, value) == want


def test_totals(spark):
    r = spark.createDataFrame([(10.0, None, None), (None, 1.0, None), (1.0, 2.0, 9.0)], "p double, s double, t double")
    got = r.select(money.total(F.col("p"), F.col("s")), money.stored_total(F.col("t"), F.col("p"), F.col("s"))).collect()
    assert [tuple(x) for x in got] == [(10.0, 10.0), (None, 1.0), (3.0, 9.0)]


@pytest.mark.parametrize("value, code, want", [(1299.5, "EUR", "1 299,5 EUR"), (None, None, "0 EUR"), (4.0, "SEK", "4 SEK")])
def test_format_price(spark, value, code, want):
    assert spark.createDataFrame([(value, code)], "v double, c string").select(money.format_price(F.col("v"), F.col("c"))).first()[0] == want


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.clean, "  nan ", None), (text.clean, "[object Object]", None), (text.clean, " a﻿", "a"),
        (text.match_text, "A&B (C) é ÄÖ-1.5", "a and b c äö-1.5"), (text.match_text, None, ""),
        (text.match_brand, "Hewlett  Packard", "hp"), (text.match_brand, "Acme", "acme"),
        (text.match_id, "a-1", None), (text.match_id, "ab-12", "AB12"),
        (text.match_ean, "00 1234-5678", "12345678"), (text.match_ean, "1234567", None), (text.lookup_ean, "00-12", "12"),
        (text.title_tokens, "The Big big PC for Äiti", ["big", "äiti"]),
        (text.model_tokens, "näppäin3 RTX-4090 x5", ["in3", "4090", "x5"]),
        (text.canon_title, "Näyttö  27", "n ytt 27"), (text.canon_model, " X-1 b", "x1b"), (text.canon_id, "00-Ab", "00ab"),
        (text.decode_entities, "&amp;lt;", "<"), (text.html_text, "<b>a</b>&amp;  b", "a & b"),
        (text.json_text, "a\\u00e4\\/b", "aä/b"), (text.slug, "Älä & Öö!", "ala-ja-oo"),
        (text.status_code, "failed: 404 Not", 404), (text.status_code, "1234", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_sets(spark):
    r = spark.createDataFrame([(["a", "b"], ["b"], [])], "a array<string>, b array<string>, e array<string>")
    got = r.select(text.jaccard(F.col("a"), F.col("b")), text.jaccard(F.col("a"), F.col("e")), text.model_conflict(F.col("a"), F.col("b")), text.model_conflict(F.col("a"), F.col("e")), text.model_conflict(F.col("b"), F.array(F.lit("x")))).first()
    assert tuple(got) == (0.5, 0.0, False, False, True)


LIST = "https://www.jimms.fi/fi/Product/List/000-0K5/laptops"


@pytest.mark.parametrize(
    "f, value, want",
    [
        (urls.host, "https://WWW.Jimms.fi/x", "jimms.fi"), (urls.host, "not a url", None),
        (lambda u: urls.store_of(F.lit(""), u), "https://www.a.fi/", "a.fi"), (lambda u: urls.store_of(F.lit("WWW.B.fi"), u), "x", "b.fi"),
        (lambda u: urls.product_url(u, "power.fi", True), "https://power.fi/a/p-1?x#y", "https://www.power.fi/a/p-1"), (lambda u: urls.product_url(u, "power.fi"), "https://evil.fi/p-1", None),
        (urls.page_number, LIST + "?Page=3", 3), (urls.page_number, LIST + "?p=0", 1), (urls.is_pagination, LIST, False),
        (urls.category_key, LIST, "fi/product/list/000-0k5"), (urls.category_code, LIST, "000-0k5"),
        (urls.is_facet, LIST + "?fq=1", True), (urls.is_facet, "https://x.fi/?fq=1", False),
        (lambda u: urls.category_url(u, keep_page=True), LIST + "?p=2", LIST + "?page=2"), (urls.category_url, LIST + "?p=2#x", LIST), (urls.category_url, "https://x.fi/", None),
        (urls.category_url, "https://evil.fi/fi/Product/List/000-0K5/laptops", None), (urls.category_url, "/FI/product/LIST/a b/%C3%A4%2fx//", "https://www.jimms.fi/fi/Product/List/a%20b/%C3%A4/x"), (urls.category_url, "/fi/Product/List/%zz", None),
        (urls.show_url, "https://Jimms.fi/FI/product/SHOW/12/Näyttö 27(b)?x=1", "https://www.jimms.fi/fi/Product/Show/12/N%C3%A4ytt%C3%B6%2027(b)"), (urls.show_url, "/fi/Product/Show/7", "https://www.jimms.fi/fi/Product/Show/7"),
        (urls.show_url, "/fi/Product/Show/x7", None), (urls.show_url, "https://evil.fi/fi/Product/Show/7", None), (urls.show_url, "/x/fi/Product/List/7", None),
        (lambda u: urls.product_url(u, "verkkokauppa.com", True, True), "http://cdn.verkkokauppa.com/fi/product/1/a?x", "https://www.verkkokauppa.com/fi/product/1/a"),
        (lambda u: urls.is_product(u, "jimms.fi"), "https://www.jimms.fi/fi/Product/Show/12/", False),
        (lambda u: urls.absolute(u, F.lit("https://a.fi/b/c/d")), "../e/./f?x=/../y", "https://a.fi/b/e/f?x=/../y"), (lambda u: urls.absolute(u, F.lit("https://a.fi/b/c")), "?p=2", "https://a.fi/b/c?p=2"), (lambda u: urls.absolute(u, F.lit("https://a.fi/b/c")), "/x/..", "https://a.fi/"),
        (lambda u: urls.is_product(u, "jimms.fi"), "https://www.jimms.fi/fi/Product/Show/12/a", True), (lambda u: urls.is_product(u, "power.fi"), "https://power.fi/x", False),
        (urls.supported_store, "https://m.power.fi/", "power.fi"), (urls.supported_store, "https://notpower.fi/", None),
        (lambda u: urls.absolute(u, F.lit("https://a.fi/b/c")), "d", "https://a.fi/b/d"), (lambda u: urls.absolute(u, F.lit("https://a.fi/b/c")), "/d", "https://a.fi/d"),
        (lambda u: urls.page_candidates(u, F.lit(2)), "https://a.fi/l?x=1", ["https://a.fi/l?page=2", "https://a.fi/l?p=2"]),
    ],
)
def test_urls(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.slug, "Łódź & Ŝtîgő ẞ ș ğ ệ", "odz-ja-stigo-s-g-e"), (text.slug, "A\u0308--Å", "a-a"), (text.slug, "", ""),
        (text.json_text, r"a\u0026\/b", "a&/b"), (text.json_text, r"bad\q\/", r"bad\q\/"), (lambda c: text.json_text(c, lenient=True), r"bad\q\/\u0026", r"bad\q/&"), (lambda c: text.json_text(c, lenient=True), 'a "b"', 'a "b"'),
        (text.clean, "\u00a0 NaN\n", None), (text.clean, "[object Object]", None), (text.clean, " \ufeff ", None), (text.clean, " nan1 ", "nan1"), (text.clean, None, None),
        (text.match_text, "A&B (X/200)\u00a0Ääni+1.5-x |", "a and b x 200 ääni+1.5-x"), (text.match_text, None, ""), (text.canon_title, "Näyttö  27\" (X)", "n ytt 27 x"),
        (lambda c: text.title_fields(c)["models"], "TV OLED55-c3.4 ja 12kk", ["oled55c34", "12kk"]), (lambda c: text.title_fields(c)["tokens"], "The tv tv12 with tv12", ["tv12"]),
        (text.last_json_object, 'log {x\n{"a": {"b": 1}} \n', '{"a": {"b": 1}}'), (text.last_json_object, 'log {"a": 1}\n', '{"a": 1}'), (text.last_json_object, "none {", None), (text.last_json_object, None, None),
        (lambda c: text.positive_int(c, 7), " 12x", 12), (lambda c: text.positive_int(c, 7), "0", 7), (lambda c: text.positive_int(c, 7), "-3", 7), (lambda c: text.positive_int(c, 7), "x", 7), (lambda c: text.positive_int(c, 7), None, 7),
        (money.currency, "5 usd", "USD"), (money.currency, "USDT", "EUR"), (lambda c: money.currency(c, nordic=True), "5 kr", "SEK"), (lambda c: money.currency(c, nordic=True), "KR", "EUR"), (money.currency, "5 kr", "EUR"),
        (money.parse_price, "1\u00a0299,00 €", 1299.0), (money.parse_price, "12.990", 12990.0), (money.parse_price, "0.125", 125.0), (money.parse_price, "1234.567", 1234.56), (money.parse_price, "-5,9", 5.9), (money.parse_price, "99,-", 99.0), (money.parse_price, "x", None),
    ],
)
def test_text_and_money(spark, f, value, want):
    assert one(spark, f, value) == want
