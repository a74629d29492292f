"""Product records from pages: JSON-LD first, then elements that a store's selectors name.

The page is read once, by one Arrow UDF that returns raw strings; prices, stock and defaults are built-in
expressions on these.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text

#: The selectors of each store. All stores share DELIVERY, STOCK and IDENTIFIERS but for the lists below.
DELIVERY = ["[data-testid='delivery-cost']", "[data-testid='shipping-cost']", "[data-testid*='delivery']", ".delivery-cost", ".shipping-cost"]
STOCK = ["[data-testid*='availability']", "[data-testid*='stock']", "[itemprop='availability']", ".availability", ".stock-status"]
PRICES = ["[data-testid='price-current']", "[itemprop='price']", "meta[property='product:price:amount']", "[data-price]", ".price"]
IDENTIFIERS = {
    "brand": ["[itemprop='brand']", "[data-brand]", "[data-testid*='brand']"],
    "model": ["[itemprop='model']", "[data-model]", "[data-testid*='model']"],
    "sku": ["[itemprop='sku']", "[data-sku]", "[data-testid*='sku']"],
    "mpn": ["[itemprop='mpn']", "[data-mpn]", "[data-testid*='mpn']"],
    "ean": ["[itemprop='gtin13']", "[itemprop='gtin']", "[data-ean]", "[data-testid*='ean']"],
}
STORES = {
    "gigantti.fi": {"title": ["[data-testid='product-name']", "h1[data-testid='product-title']", "h1", "meta[property='og:title']"], "price": PRICES, "shipping": DELIVERY, "stock": STOCK},
    "jimms.fi": {
        "title": ["h1[itemprop='name']", ".product-name", "h1", "meta[property='og:title']"],
        "price": ["[itemprop='price']", "meta[property='product:price:amount']", ".product-price", ".price", "[data-price]"],
        "shipping": [*DELIVERY, ".delivery-price"],
        "stock": STOCK,
    },
    "power.fi": {"title": ["h1[data-testid='product-name']", ".pdp-product-title", "h1", "meta[property='og:title']"], "price": [*PRICES, ".product-price"], "shipping": [*DELIVERY, ".delivery-price"], "stock": STOCK},
    "verkkokauppa.com": {"title": ["h1[data-testid='product-name']", ".product__name", "h1", "meta[property='og:title']"], "price": [*PRICES, ".product-price"], "shipping": [*DELIVERY, ".delivery-price"], "stock": STOCK},
}
#: The selectors of the browser side, which reads the page before its JSON-LD, and those that it falls back to.
PAGE_STORES = {
    "gigantti.fi": {"title": ["[data-testid='product-name']", "h1[data-testid='product-title']", "h1"], "price": ["[data-testid='price-current']", "[itemprop='price']", "[data-price]", ".price"]},
    "verkkokauppa.com": {"title": ["h1[data-testid='product-name']", ".product__name", "h1"], "price": ["[data-testid='price-current']", "[itemprop='price']", "[data-price]", ".price"]},
    "power.fi": {"title": ["h1[data-testid='product-name']", ".pdp-product-title", "h1"], "price": ["[data-testid='price-current']", "[itemprop='price']", "[data-price]", ".price"]},
    "jimms.fi": {"title": ["h1[itemprop='name']", ".product-name", "h1"], "price": ["[itemprop='price']", ".product-price", ".price", "[data-price]"]},
}
PAGE_FALLBACK = {
    "title": ["h1", "[itemprop='name']", "[data-testid='product-title']", ".product-title", ".product-name", "meta[property='og:title']"],
    "price": ["[itemprop='price']", "meta[property='product:price:amount']", "[data-price]", ".product-price", ".price"],
}
PAGE_IDENTIFIERS = [
    ["[itemprop='sku']", "[data-sku]", "[data-testid*='sku']"],
    ["[itemprop='mpn']", "[data-mpn]", "[data-testid*='mpn']"],
    ["[itemprop='gtin13']", "[itemprop='gtin']", "[data-ean]", "[data-testid*='ean']"],
    ["[itemprop='brand']", "[data-brand]", "[data-testid*='brand']"],
    ["[data-model]", "[data-testid*='model']"],
]
PAGE_MARKS = {"sku": ("sku",), "mpn": ("mpn",), "ean": ("gtin", "ean"), "brand": ("brand",), "model": ("model",)}
#: What a stock text says.
IN_STOCK, OUT_OF_STOCK = "instock|in stock|varastossa|available", "outofstock|out of stock|loppu|ei saatavilla|unavailable"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Element:
    tag: str
    attrs: dict
    start: int  # of its text among the page's pieces
    end: int | None = None


class Page(HTMLParser):
    """The elements of a page in document order; each one's text is a range of the page's pieces of text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.pieces: list[str] = []
        self.feed(html)
        self.close()
        self.named: dict[tuple[str, str], list[Element]] = {}  # elements by tag, class and attribute
        for e in self.elements:
            self.named.setdefault(("tag", e.tag), []).append(e)
            for c in dict.fromkeys(e.attrs["class"].split()) if e.attrs.get("class") else ():
                self.named.setdefault(("class", c), []).append(e)
            for a in e.attrs:
                self.named.setdefault(("attr", a), []).append(e)

    def handle_starttag(self, tag, attrs):
        self.elements.append(Element(tag, dict(attrs), len(self.pieces), len(self.pieces) if tag in VOID else None))
        if tag not in VOID:
            self.open.append(self.elements[-1])

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), None)
        if at is not None:
            for e in self.open[at:]:
                e.end = len(self.pieces)
            del self.open[at:]

    def handle_data(self, data):
        self.pieces.append(data)

    def text(self, e: Element) -> str:
        return "".join(self.pieces[e.start : e.end])

    def all(self, selector: str) -> Iterator[Element]:
        """The elements that a selector names."""
        tag, cls, attr, op, value = parsed(selector)
        for e in self.named.get(rarest(selector), ()):
            have = e.attrs.get(attr) if attr else ""
            if (not tag or e.tag == tag) and (not cls or cls in (e.attrs.get("class") or "").split()) and (not attr or attr in e.attrs):
                if not op or (have or "") == value or (op == "*=" and value in (have or "")):
                    yield e

    def values(self, selectors: list[str], *names: str) -> list[str]:
        """Per selector, the first of the named attributes, or the text, of its first element that is not blank."""
        out = []
        for s in selectors:
            if rarest(s) in self.named and (e := next(self.all(s), None)):
                out.append(next((v for v in (*(e.attrs.get(n) for n in names), self.text(e)) if v and v.strip()), ""))
        return out

    def marked(self) -> dict[str, str]:
        """Identifiers of all elements that PAGE_IDENTIFIERS names, by what their itemprop or data-testid says."""
        out: dict[str, str] = {}
        for selectors in PAGE_IDENTIFIERS:
            named = {id(e) for s in selectors if rarest(s) in self.named for e in self.all(s)}
            for e in (e for e in self.elements if id(e) in named) if named else ():
                value = (e.attrs.get("content") or self.text(e)).strip()
                mark = (e.attrs.get("itemprop") or e.attrs.get("data-testid") or "").lower()
                for name, signs in PAGE_MARKS.items():
                    if value and any(s in mark for s in signs):
                        out.setdefault(name, value)
        return out


@cache
def parsed(selector: str) -> tuple[str, str, str, str, str]:
    """tag, class, attribute, operator and value of a simple selector."""
    m = re.fullmatch(r"([a-z0-9]*)(?:\.([\w-]+))?(?:\[([\w:-]+)(?:(\*?=)'([^']*)')?\])?", selector)
    return tuple(x or "" for x in m.groups())


@cache
def rarest(selector: str) -> tuple[str, str]:
    """What a page looks a selector's elements up by: its attribute, else its class, else its tag."""
    tag, cls, attr, _, _ = parsed(selector)
    return ("attr", attr) if attr else ("class", cls) if cls else ("tag", tag)


def find_product(value, exact: bool = False) -> dict | None:
    """The first Product in a JSON-LD value: itself, in a list, under @graph or mainEntity.

    exact: the type must be the one word, as written, and a graph without a product ends the search.
    """
    if isinstance(value, list):
        return next((p for p in (find_product(v, exact) for v in value) if p), None)
    if not isinstance(value, dict):
        return None
    kinds, graph = value.get("@type"), value.get("@graph")
    if exact:
        if kinds == "Product":
            return value
        return find_product(graph if isinstance(graph, list) else value.get("mainEntity"), exact)
    if any(str(k).lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
        return value
    return (find_product(graph) if isinstance(graph, list) else None) or find_product(value.get("mainEntity"))


def json_ld(page: Page, exact: bool = False) -> dict:
    """Raw strings of the first block with a product; blocks that don't parse, or have a null rate, are skipped."""
    for e in page.elements:
        if e.tag != "script" or e.attrs.get("type") != "application/ld+json":
            continue
        try:
            p = find_product(json.loads(page.text(e)), exact)
            if not p:
                continue
            if exact:
                p = {k: v for k, v in p.items() if k != "offers"}
            offer = p.get("offers") or {}
            offer = (offer[0] if offer else {}) if isinstance(offer, list) else offer
            details = offer.get("shippingDetails") or {}
            details = (details[0] if details else {}) if isinstance(details, list) else details
            rate = details.get("shippingRate", 0)
            rate = rate["value"] if isinstance(rate, dict) else rate
            if rate is None:
                raise TypeError("null rate")
            brand = p.get("brand")
            ean = next((p[k] for k in ("gtin13", "gtin12", "gtin14", "gtin") if p.get(k)), None)
            raw = {"title": p.get("name"), "brand": brand.get("name") if isinstance(brand, dict) else brand, "model": p.get("model"), "sku": p.get("sku"), "mpn": p.get("mpn"), "ean": ean, "price": offer.get("price"), "currency": offer.get("priceCurrency"), "availability": offer.get("availability"), "shipping": rate}
            return {k: None if v is None or isinstance(v, (dict, list)) else str(v) for k, v in raw.items()}
        except (ValueError, TypeError, KeyError, AttributeError):
            continue
    return {}


LD = ("title", "brand", "model", "sku", "mpn", "ean", "price", "currency", "availability", "shipping")
RAW = "supported boolean, ld_found boolean, " + ", ".join(f"ld_{k} string" for k in LD) + ", title array<string>, price array<string>, shipping array<string>, stock array<string>, " + ", ".join(f"{k} array<string>" for k in IDENTIFIERS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in RAW.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def raw_product(html: pd.Series, store: pd.Series) -> pd.DataFrame:
    """What the selectors of each page's store name, and its JSON-LD; nothing for a store without selectors."""
    rows = []
    for h, s in zip(html, store):
        lists = STORES.get(s)
        if lists is None:
            rows.append({"supported": False})
            continue
        page = Page(h or "")
        ld = json_ld(page)
        rows.append(
            {"supported": True, "ld_found": bool(ld), **{f"ld_{k}": ld.get(k) for k in LD}, "title": page.values(lists["title"], "content"), "price": page.values(lists["price"], "content", "data-price"), "shipping": page.values(lists["shipping"]), "stock": page.values(lists["stock"], "content")}
            | {k: page.values(v, "content") for k, v in IDENTIFIERS.items()}
        )
    return _frame(rows)


def raw_page_product(html: pd.Series, store: pd.Series) -> pd.DataFrame:
    """The same by the browser side's selectors; the fallback's are used where neither they nor JSON-LD give a title."""
    rows = []
    for h, s in zip(html, store):
        if s not in PAGE_STORES:
            rows.append({"supported": False})
            continue
        page = Page(h or "")
        ld = json_ld(page, exact=True)
        lists = PAGE_STORES[s]
        if not any(page.values(lists["title"], "content")) and not ld.get("title"):
            lists = PAGE_FALLBACK
        marked = page.marked()
        rows.append({"supported": True, "ld_found": bool(ld), **{f"ld_{k}": ld.get(k) for k in LD}, "title": page.values(lists["title"], "content"), "price": page.values(lists["price"], "content", "data-price"), "shipping": [], "stock": []} | {k: [v] if (v := marked.get(k)) else [] for k in IDENTIFIERS})
    return _frame(rows)


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(values, text.trim_ws), lambda x: x != ""), 0), F.lit(""))


def in_stock(values: Column, strict: bool = False) -> Column:
    """The first value that says either; what is available counts before what is not, so 'unavailable' is in stock.

    strict tests for what is not available first.
    """
    yes, no = IN_STOCK, OUT_OF_STOCK

    def says(v: Column) -> Column:
        v = F.lower(v)
        return F.when(v.rlike(no), False).when(v.rlike(yes), True) if strict else F.when(v.rlike(yes), True).when(v.rlike(no), False)

    return F.coalesce(F.get(F.filter(F.transform(values, says), lambda x: x.isNotNull()), 0), F.lit(False))


def availability(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("instock"), True).when(t.contains("outofstock") | t.contains("soldout"), False)


def product_records(pages: DataFrame, store: str = "store", url: str = "url", html: str = "html", browser: bool = False, strict_stock: bool = False) -> DataFrame:
    """pages with a struct product of 13 fields, null for a store without selectors.

    browser reads a page as the browser side does: its own selectors before JSON-LD, for the title and the price, and
    currencies of the north; stock and shipping are not read there. A null or broken page gives a product with empty
    fields, no price and shipping 0.
    """
    r, dom, price, shipping = map(F.col, ("__raw", "__dom", "__price", "__shipping"))
    some = lambda c: F.when(F.coalesce(text.trim_ws(c), F.lit("")) != "", text.trim_ws(c))
    dom_prices = F.filter(F.transform(r["price"], lambda x: F.struct(money.parse_price(x).alias("price"), money.currency(x, nordic=browser).alias("currency"))), lambda x: x["price"].isNotNull())
    ld_price = F.when(r["ld_price"].rlike(r"^\s*-?[0-9.]+([eE][+-]?\d+)?\s*$"), r["ld_price"].cast("double"))
    ld_price = F.when(ld_price != 0, ld_price)
    costs = F.filter(F.transform(F.filter(r["shipping"], lambda x: text.trim_ws(x) != ""), lambda x: F.when(x.rlike("(?i)free|ilmainen"), F.lit(0.0)).otherwise(money.parse_price(x))), lambda x: x.isNotNull())
    ld_ship = F.when(r["ld_found"], F.coalesce(F.when(r["ld_shipping"].rlike(r"^\s*[0-9.]+\s*$"), r["ld_shipping"].cast("double")), F.lit(0.0)))
    order = (lambda a, b: F.coalesce(b, a)) if browser else (lambda a, b: F.coalesce(a, b))
    # columns of their own, as each is used several times
    once = [{"__dom": F.get(dom_prices, 0)}, {"__price": order(ld_price, dom["price"]), "__shipping": F.coalesce(ld_ship, F.get(costs, 0), F.lit(0.0))}]
    fields = {
        "store": F.col(store),
        "title": F.coalesce(order(some(r["ld_title"]), some(_first(r["title"]))), F.lit("")),
        "price": price,
        "shipping": shipping,
        "total": money.total(price, shipping),
        "currency": F.coalesce(some(r["ld_currency"]), dom["currency"], F.lit("EUR")),
        "url": F.col(url),
        **{k: F.coalesce(some(r[f"ld_{k}"]), _first(r[k])) for k in ("brand", "model", "sku", "ean", "mpn")},
        "in_stock": F.coalesce(availability(r["ld_availability"]), in_stock(r["stock"], strict_stock)),
    }
    read = pages.withColumn("__raw", F.pandas_udf(raw_page_product if browser else raw_product, RAW)(F.col(html), F.col(store)))
    for columns in once:
        read = read.withColumns(columns)
    return read.withColumn("product", F.when(r["supported"], F.struct(*[v.alias(k) for k, v in fields.items()]))).drop("__raw", *[c for columns in once for c in columns])


def is_valid(product: Column) -> Column:
    """Whether a product record has a title."""
    return F.coalesce(F.length(product["title"]) > 0, F.lit(False))
