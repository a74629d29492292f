"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines: one for each block, and blank ones where an element begins or ends that groups blocks. Sums of
text lengths over windows of lines rise from nothing at a surge point and fall to nothing at a dive point. The surge with the
most text shows where the article lies; its ends are then moved to those of the element that holds it, and all lines between
them are the text. Menus, footers and their like leave no lines at all.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Lines of a window. As many blank lines stand between two groups, so that some window there holds no text.
WINDOW = 3
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=[\s/]|\Z)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GROUPS = frozenset("html body main article section div ul ol dl table form fieldset figure details blockquote center td th li dd header footer aside nav menu dialog address".split())
_LINES = _GROUPS - {"td", "th"} | frozenset("p h1 h2 h3 h4 h5 h6 dt tr caption pre hr figcaption summary legend option thead tbody tfoot".split())
#: Groups that may stand within an article's run of blocks and make no gap in it.
_WITHIN = frozenset("ul ol dl table figure details blockquote td th li dd address".split())
_GONE = frozenset("head script style noscript template svg math iframe object audio video canvas map nav footer aside form button select textarea fieldset dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
#: Words of class names and ids of what is no part of an article.
_NAMES = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside rail widget widgets notice notices cookie cookies consent gdpr banner banners popup modal overlay "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus discussion replies responses form search searchbox toolbar pagination pager copyright alert alerts toast paywall skiplink".split()
)
#: The like with which longer words begin or end, as in commentlist, topnav or adbox.
_BEGINS = ("comment", "sidebar", "footer", "navbar", "navigation", "menu", "cookie", "breadcrumb", "newsletter", "advert", "sponsor", "masthead", "promo", "popup", "related", "social")
_ENDS = ("nav", "menu", "sidebar", "footer", "comment", "comments", "banner", "notice", "cookie", "cookies", "popup", "widget")
_SLOTS = re.compile("ads?(?:box|slot|unit|wrap|wrapper|space|block|container|bygoogle|sense)|share(?:bar|box|buttons|links)")
_NOT_THERE = frozenset("no non not without has have with is".split())
_KEPT = frozenset("html body main".split())


@dataclass
class Node:
    tag: str
    parent: int
    chars: int = 0


@dataclass
class Line:
    text: str
    own: int
    node: int
    gap: bool
    heading: bool


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1)])
    lines: list[Line] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _not_article(tag: str, attributes: str, in_article: bool, by_name: bool) -> bool:
    """Whether an element is no part of an article, by its tag, role, visibility, or the words of its class and id."""
    if tag in _GONE or (tag == "header" and not in_article):
        return True
    if tag in _KEPT or "=" not in attributes and "hidden" not in attributes:
        return False
    found = _attributes(attributes)
    if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if not by_name:
        return False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        if _NOT_THERE.intersection(words):
            continue
        if _NAMES.intersection(words) or any(w.startswith(_BEGINS) or w.endswith(_ENDS) or _SLOTS.fullmatch(w) for w in words):
            return True
        if not in_article and any(w == "header" or w.endswith("header") for w in words) or {"skip", "link"} <= set(words):
            return True
    return False


def lines_of(source: str, by_name: bool = True) -> Page:
    """The lines of a page and the elements that hold them."""
    page, at = Page(), 0
    nodes, lines = page.nodes, page.lines
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, whether it is left out
    opened: dict[str, int] = {}
    parts: list[str] = []
    own = links = articles = gone = 0
    gap, heading = True, False

    def flush() -> None:
        nonlocal own, gap, heading
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, own, stack[-1][1], gap, heading))
            gap = heading = False
        parts.clear()
        own = 0

    def take(text: str) -> None:
        nonlocal own
        text = html.unescape(text)
        parts.append(text)
        if not links:
            own += len("".join(text.split()))

    def close() -> None:
        nonlocal gone, articles, gap
        tag, _, out = stack.pop()
        opened[tag] -= 1
        gone -= out
        articles -= tag in ("article", "main")
        gap |= tag not in _WITHIN and (tag in _GROUPS or (out and not articles))

    source = source[: source.rfind(">") + 1] if source.rfind("<") > source.rfind(">") else source
    while m := _TOKEN.search(source, at):
        if not gone and m.start() > at:
            take(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "td", "th") and not gone:
            parts.append(" ")
        if tag in _LINES and not gone:
            flush()
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in _LINES and stack[-1][0] == "p" or tag in ("li", "dd", "dt") and stack[-1][0] == tag:
            close()
        if tag in _VOID or m[3].endswith("/") and tag not in _LINES:
            continue
        out = not gone and _not_article(tag, m[3], articles > 0, by_name)
        if tag in _GROUPS or out:
            if not gone and (tag not in _WITHIN and not out or out and not articles):
                gap = True
            node = stack[-1][1]
            if not gone and not out:
                nodes.append(Node(tag, node))
                node = len(nodes) - 1
            stack.append((tag, node, out))
            opened[tag] = opened.get(tag, 0) + 1
            gone += out
            articles += tag in ("article", "main")
        heading |= tag == "h1" and not gone
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
    if not gone:
        take(source[at:])
    flush()
    return page


def _article(page: Page, window: int) -> tuple[int, int]:
    """The lines (first, end) of the element in which the surge with the most text lies."""
    nodes, lines = page.nodes, page.lines
    chars = [x.own for x in lines] if any(x.own for x in lines) else [len(x.text) for x in lines]
    gaps = np.array([window * x.gap for x in lines])
    place = np.arange(len(lines)) + np.cumsum(gaps)
    length = np.zeros(place[-1] + window + 1, np.int64)
    length[place] = chars
    total = np.concatenate(([0], np.cumsum(length)))
    sums = total[window:] - total[:-window]  # of the window that begins at each line
    full = np.concatenate(([False], sums > 0, [False]))
    surges, dives = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(full[:-1] & ~full[1:]) + window - 1
    text = total[np.minimum(dives, len(length))] - total[surges]
    best = int(np.argmax(text))
    first, end = np.searchsorted(place, (surges[best], dives[best]))

    for n, x in zip(chars, lines):
        nodes[x.node].chars += n
    last = list(range(len(nodes)))  # elements are numbered as they begin: those inside k are k + 1 to last[k]
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].chars += nodes[k].chars
        last[nodes[k].parent] = max(last[nodes[k].parent], last[k])

    spanned = [x.node for x in lines[first:end]]
    above = [min(spanned)]
    while above[-1]:
        above.append(nodes[above[-1]].parent)
    common = [k for k in above if last[k] >= max(spanned)]
    named = next((k for tag in ("article", "main") for k in common if nodes[k].tag == tag), None)
    holder = common[0] if named is None else named
    for k in common[1:] if named is None else ():
        if nodes[k].chars >= (2 if nodes[k].tag in ("body", "html", "") else 1.5) * nodes[holder].chars or nodes[holder].tag in _WITHIN:
            holder = k
    held = [i for i, x in enumerate(lines) if holder <= x.node <= last[holder]]
    first, end = held[0], held[-1] + 1
    if named is None and first and lines[first - 1].heading:
        first -= 1
    return first, end


def main_text(source: str | None, window: int = WINDOW) -> str:
    """The blocks of a page's article, a line each, white space inside a block turned into one space."""
    page = lines_of(source or "")
    if not page.lines:
        page = lines_of(source or "", by_name=False)
    if not page.lines:
        return ""
    first, end = _article(page, window)
    return "\n".join(x.text for x in page.lines[first:end])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", window: int = WINDOW) -> DataFrame:
    """The columns of pages but the html, then text and n_chars (code points); columns of these two names are replaced.

    A null or empty html, and a page of markup alone, gives an empty text and 0; repeated rows get the same, null ids are
    rows like others, an empty table gives an empty one. Pages are read whole, about 512 KB or one longer page at a time,
    each in time that grows with its length; there is no shuffle. A page cut off inside a tag loses that tag.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join([f"c{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)] + ["text string, n_chars long"])

    def read(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(x, window) for x in batch.column("html").to_pylist()]
            columns = [batch.column(f"c{k}") for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*(f"c{k}" for k in range(len(kept))), "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], F.col(html_col).alias("html"))
    out = rows.mapInArrow(read, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], "text", "n_chars")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
