"""The links of a page as a table function: one pass over its anchors, JSON pairs and hrefs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import pages
from . import text, urls

_WS = r"[ \t\n\x0b\f\r]*"
_OPEN = re.compile(rf"""<a[^>]+href{_WS}={_WS}["']([^"']+)["'][^>]*>""", re.I | re.A)
_HREF = re.compile(rf"""href{_WS}={_WS}["']([^"']+)["']""", re.I | re.A)
_JSON = re.compile(pages.JSON_LINK.removeprefix("(?i)").replace(r"\s", r"[ \t\n\x0b\f\r]"), re.I | re.A)


def anchors_of(html: str) -> Iterator[tuple[str, str]]:
    """(href, inner text with its tags) of each anchor, up to the next end of one.

    Ends are found once, from left to right, so a page of many anchors without an end is read in linear time.
    """
    lower, at, end = html.lower() if html.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), html), 0, -1
    while (at := lower.find("<a", at)) >= 0:
        if html.find(">", at) < 0:
            return
        opened = _OPEN.match(html, at)
        if opened is None:
            at += 2
            continue
        if end < opened.end():
            end = lower.find("</a>", opened.end())
            if end < 0:
                return
        yield opened[1], html[opened.end() : end]
        at = end + 4


class Links:
    """(kind, pos, href, label) of a page: anchors, then JSON pairs, then hrefs, each in the page's order."""

    def eval(self, html: str):
        if html is None:
            return
        for pos, (href, inner) in enumerate(anchors_of(html)):
            yield "anchor", pos, href, inner
        for pos, m in enumerate(_JSON.finditer(html)):
            yield "json", pos, m[1], m[2] or ""
        for pos, m in enumerate(_HREF.finditer(html)):
            yield "href", pos, m[1], ""


#: A table function for lateral joins.
extract_links = F.udtf(Links, returnType="kind string, pos int, href string, label string", useArrow=True)


def links_of(rows: DataFrame, html: str = "html") -> DataFrame:
    """rows, without the html, with each of its links; hrefs and labels are as the page writes them."""
    return rows.lateralJoin(extract_links(F.col(html).outer())).drop(html)


def page_links(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The same as pages.page_links."""
    found = links_of(rows.select(id_col, F.col(url_col).alias("__base"), html_col), html_col).where("kind = 'anchor'")
    href = text.decode_entities(text.trim_ws(F.col("href")), "&#39;")
    return found.select(id_col, "pos", urls.absolute(href, F.col("__base")).alias("link"), text.html_text(F.col("label")).alias("label"))


def category_links(rows: DataFrame, id_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, link, label): what pages.category_links gives for each page, a row for each address."""
    found = links_of(rows.select(id_col, html_col), html_col)
    kind = F.col("kind")
    json = kind == "json"
    link = F.when(json, text.json_text(F.col("href"), lenient=True)).otherwise(text.decode_entities(text.trim_ws(F.col("href")), "&#39;"))
    label = F.when(json, text.trim_ws(text.json_text(F.col("label"), lenient=True))).when(kind == "anchor", text.html_text(F.col("label"))).otherwise("")
    named = found.select(id_col, F.struct(F.when(kind == "anchor", 0).when(json, 1).otherwise(2).alias("kind"), "pos").alias("at"), link.alias("raw"), label.alias("label"))
    lists = named.where((F.col("at.kind") == 1) | F.col("raw").rlike("(?i)/fi/Product/List/")).where(~urls.is_facet(F.col("raw")) & ~urls.has_query(F.col("raw")))
    rebuilt = lists.withColumn("link", urls.category_url(F.col("raw"))).where("link is not null")
    return rebuilt.groupBy(id_col, "link").agg(F.coalesce(F.min_by(F.when(F.col("label") != "", F.col("label")), F.when(F.col("label") != "", F.col("at"))), F.lit("")).alias("label"))
