"""URLs: hosts, store names, product and category addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: The parts of a list address that say it is a filter and not a category.
FACETS = ("?", "&fq=", "?fq=", "sort=", "order=", "minprice=", "maxprice=", "brand=", "manufacturer=", "availability=", "instock=", "view=", "perpage=", "limit=")
#: How a product address of a store looks.
PRODUCT_PATHS = {
    "gigantti.fi": "/product/",
    "jimms.fi": r"(?i)^/fi/Product/Show/\d+(?:/[^/]+)*$",
    "power.fi": r"(?i)/p-\d+/?$",
    "verkkokauppa.com": r"^/fi/product/[^/]+/[^/]+",
}


def host(url: Column) -> Column:
    """Lower-case host without a leading www., or null."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def store_of(store: Column, url: Column) -> Column:
    """The store, or the URL's host; lower case, without www.; '' if neither is there."""
    named = F.when(store != "", store)
    return F.coalesce(F.regexp_replace(F.lower(named), r"^www\.", ""), host(url), F.lit(""))


def _parts(url: Column) -> Column:
    """The path's segments that are not empty."""
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")


def _rewritten(segment: Column) -> Column:
    """A segment decoded and encoded anew, all but A-Z a-z 0-9 - _ . ! ~ * ' ( ) by percent; null if it can't be decoded."""
    plain = F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))
    out = F.url_encode(plain)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def product_url(url: Column, store: str, force_www: bool = False, any_containing: bool = False) -> Column:
    """A store's own address without query and fragment, or null for other hosts.

    force_www writes the store's www address for the origin. any_containing takes any host that contains the store's name.
    """
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    scheme = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))))
    base = F.lit(f"https://www.{store}") if force_www else scheme
    own = host(url).contains(store) if any_containing else host(url) == store
    return F.when(own, F.concat(base, F.when(path == "", "/").otherwise(path)))


def _legal(link: Column) -> Column:
    """A link whose signs that no address may hold are written by percent, as browsers do; a backslash becomes a slash."""
    for sign, code in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("^", "%5E"), ("`", "%60"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D"), ("\\", "/")):
        link = F.replace(link, F.lit(sign), F.lit(code))
    return link


def show_url(link: Column, store: str = "jimms.fi") -> Column:
    """A link to a product rebuilt as https://www.<store>/fi/Product/Show/<number>/<tail>, or null.

    Relative links are taken from the store's root. The tail's segments are encoded anew; other hosts, links without
    product, show and a number in a row, and tails that can't be decoded give null.
    """
    url = absolute(_legal(link), F.lit(f"https://www.{store}/"))

    def rebuilt(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, F.lower), "product").cast("int")
        tail = F.transform(F.slice(parts, at + 3, F.greatest(F.size(parts), F.lit(1))), _rewritten)
        fits = (at > 0) & (F.lower(F.get(parts, at)) == "show") & F.get(parts, at + 1).rlike(r"^[0-9]+$") & ~F.exists(tail, lambda x: x.isNull())
        return F.when(fits, F.concat(F.lit(f"https://www.{store}/"), F.array_join(F.concat(F.array(F.lit("fi"), F.lit("Product"), F.lit("Show"), F.get(parts, at + 1)), tail), "/")))

    return F.when(host(url) == store, bound(_parts(url), rebuilt))


def strip_address(url: Column) -> Column:
    """Scheme, lower-case host and path of any address."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), F.when(path == "", "/").otherwise(path))


def _without_dots(path: Column) -> Column:
    """A path in which . and .. segments are resolved."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", F.when(F.size(done) > 1, up).otherwise(done)).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    resolved = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(resolved, F.lit("/"))).otherwise(resolved)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), closed).otherwise(path)


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from a page: full, //host, /path, ?query, or relative to the page's folder; . and .. are resolved."""
    scheme = F.try_parse_url(base, F.lit("PROTOCOL"))
    origin = F.concat(scheme, F.lit("://"), F.try_parse_url(base, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("/"))
    folder = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    whole = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(path, link)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), link))
    inside = bound(whole, lambda x: F.concat(origin, _without_dots(F.regexp_extract(x, "^[^?#]*", 0)), F.regexp_extract(x, "(?s)[?#].*$", 0)))
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(inside)


def has_query(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")) != "", url.contains("?"), F.lit(False))


def page_param(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def is_pagination(url: Column) -> Column:
    return F.coalesce(page_param(url, "page"), page_param(url, "p"), page_param(url, "Page")).isNotNull()


def page_number(url: Column) -> Column:
    """page, p or Page if it begins as a positive number, else 1."""
    first = F.coalesce(*[F.when(page_param(url, n) != "", page_param(url, n)) for n in ("page", "p", "Page")])
    n = F.regexp_extract(first, r"^\s*\+?(\d{1,9})", 1)
    return F.coalesce(F.when((n != "") & (F.when(n != "", n).cast("int") > 0), F.when(n != "", n).cast("int")), F.lit(1))


def page_candidates(url: Column, page: Column) -> Column:
    """The two usual addresses of a numbered page of a list."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    return F.array(F.concat(base, F.lit("?page="), page.cast("string")), F.concat(base, F.lit("?p="), page.cast("string")))


def category_key(url: Column) -> Column:
    """The first four path segments in lower case."""
    return F.lower(F.array_join(F.slice(_parts(url), 1, 4), "/"))


def category_code(url: Column) -> Column:
    """The fourth path segment, or ''."""
    return F.coalesce(F.lower(F.get(_parts(url), 3)), F.lit(""))


def is_list(url: Column) -> Column:
    """Whether an address holds the path of category lists."""
    return F.coalesce(F.lower(url).contains("/fi/product/list/"), F.lit(False))


def is_facet(url: Column) -> Column:
    """A list address with any of the facet marks; other addresses are none."""
    return is_list(url) & F.exists(F.array(*[F.lit(x) for x in FACETS]), lambda mark: F.lower(url).contains(mark))


def category_url(link: Column, keep_page: bool = False, store: str = "jimms.fi") -> Column:
    """A link to a category as <origin>/fi/Product/List/<tail>, or null for another host or path.

    Relative links are taken from the store's root. The tail's segments are encoded anew, query and fragment go.
    keep_page leaves a page number over 1 (of page, p or Page) as ?page=.
    """
    url = absolute(_legal(link), F.lit(f"https://www.{store}/"))
    origin = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))))

    def rebuilt(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), lambda x: F.replace(_rewritten(x), F.lit("%2F"), F.lit("/")))
        fits = (F.size(parts) >= 4) & (F.lower(F.array_join(F.slice(parts, 1, 3), "/")) == "fi/product/list") & ~F.exists(tail, lambda x: x.isNull())
        return F.when(fits, F.concat(F.lit("/fi/Product/List/"), F.rtrim(F.array_join(tail, "/"), F.lit("/"))))

    base = F.when(host(url) == store, F.concat(origin, bound(_parts(url), rebuilt)))
    return F.concat(base, F.when(page_number(url) > 1, F.concat(F.lit("?page="), page_number(url).cast("string"))).otherwise("")) if keep_page else base


def is_product(url: Column, store: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")).rlike(PRODUCT_PATHS[store]), F.lit(False))


def supported_store(url: Column, stores: tuple[str, ...] = tuple(PRODUCT_PATHS)) -> Column:
    """The first store that is the host or its parent domain, or null."""
    h = host(url)
    return F.coalesce(*[F.when((h == s) | h.endswith("." + s), s) for s in stores])
