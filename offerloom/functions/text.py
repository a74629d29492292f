"""Text, identifier and title normalisers.

White space and word boundaries follow the dialect of the data's origin: white space is Unicode's, with the no-break
space and the byte-order mark; word characters at a boundary are ASCII only. Java's defaults are the other way round.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space class, its characters, and the ASCII word boundary, in Java's syntax.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_SIGNS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Fixed value: what parts the words of the scored matcher's text.
PARTS_WORDS = r"[^a-z0-9åäö+\-.]+"
#: Title words that say nothing about a product.
STOP_WORDS = ("with", "from", "for", "the", "and", "musta", "white", "black")
#: Brand aliases.
BRAND_ALIASES = {
    "hewlett packard": "hp",
    "hp inc": "hp",
    "logitech g": "logitech",
    "western digital": "wd",
    "wd black": "wd",
    "wd blue": "wd",
    "wd red": "wd",
}


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_SIGNS))


def collapse(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"{WS}+", " "))


def clean(c: Column) -> Column:
    """Trimmed text, or null for '', any 'nan' and '[object Object]'."""
    return F.when(~c.rlike(rf"^{WS}*+(?:[nN][aA][nN]|\[object Object\])?{WS}*+$"), trim_ws(c))


def match_text(c: Column) -> Column:
    """The scored matcher's text: lower case, & as 'and', Nordic letters kept, runs of other signs and of white space as
    one blank; '' for null."""
    t = F.replace(F.lower(clean(c)), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.trim(F.regexp_replace(t, PARTS_WORDS, " ")), F.lit(""))


def match_brand(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in BRAND_ALIASES.items() for x in pair])
    return bound(match_text(c), lambda t: F.coalesce(aliases[t], t))


def match_id(c: Column) -> Column:
    """Upper-case letters and digits; null for fewer than three."""
    return bound(F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9]+", ""), lambda t: F.when(F.length(t) >= 3, t))


def match_ean(c: Column) -> Column:
    """Digits without leading zeros; null for fewer than eight."""
    return bound(lookup_ean(clean(c)), lambda t: F.when(F.length(t) >= 8, t))


def lookup_ean(c: Column) -> Column:
    """Digits without leading zeros, of any length."""
    return F.ltrim(F.regexp_replace(c, "[^0-9]+", ""), F.lit("0"))


def _tokens(t: Column) -> Column:
    return F.array_distinct(F.filter(F.split(t, " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


#: Fixed value: what looks like a model number, a digit within letters, digits, dots and dashes.
MODEL = BOUNDARY + r"([a-z]*\d+[a-z0-9.-]*)" + BOUNDARY


def _models(t: Column) -> Column:
    found = F.regexp_extract_all(t, F.lit(MODEL), F.lit(1))
    bare = F.array_distinct(F.filter(F.transform(found, lambda w: F.translate(w, ".-", "")), lambda w: w != ""))
    return F.when(t.rlike("[0-9]"), bare).otherwise(F.array().cast("array<string>"))


def title_tokens(c: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return _tokens(match_text(c))


def model_tokens(c: Column) -> Column:
    """Distinct words that look like model numbers, without dots and dashes."""
    return bound(match_text(c), _models)


def title_fields(c: Column) -> Column:
    """Struct of title_tokens (tokens) and model_tokens (models), from one pass over the title."""
    return bound(match_text(c), lambda t: F.struct(_tokens(t).alias("tokens"), _models(t).alias("models")))


def model_conflict(a: Column, b: Column) -> Column:
    """Both have model tokens and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def canon_text(c: Column) -> Column:
    return F.coalesce(trim_ws(F.lower(c)), F.lit(""))


def canon_title(c: Column) -> Column:
    """Only a-z, 0-9 and single blanks; Nordic letters become blanks here."""
    return F.trim(F.regexp_replace(canon_text(c), "[^a-z0-9]+", " "))


def canon_model(c: Column) -> Column:
    return F.regexp_replace(canon_text(c), f"(?:-|{WS})+", "")


def canon_id(c: Column) -> Column:
    """Lower-case letters and digits, of any length, leading zeros kept."""
    return F.regexp_replace(canon_text(c), "[^a-z0-9]+", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_term(c: Column, term: str) -> Column:
    """LIKE '%term%' with ASCII case folding; % and _ in the term stay wild."""
    folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in term)
    return ascii_lower(c).like("%" + folded.replace("\\", "\\\\") + "%")


def decode_entities(c: Column, apostrophe: str = "&apos;") -> Column:
    """Five entities, &amp; first, so that what it uncovers is decoded too."""
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), (apostrophe, "'")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def html_text(c: Column) -> Column:
    """Decoded text without tags, white space collapsed."""
    return collapse(F.regexp_replace(decode_entities(c, "&#39;"), "<[^>]+>", " "))


def json_text(c: Column, lenient: bool = False) -> Column:
    r"""What a JSON string literal's inside stands for; if it is none, the text itself.

    lenient: bare quotes are taken for signs of the text, and where it is no literal \/ becomes / and \u0026 becomes &.
    """
    inside = F.replace(c, F.lit('"'), F.lit('\\"')) if lenient else c
    parsed = F.from_json(F.concat(F.lit('{"x":"'), inside, F.lit('"}')), "x string")["x"]
    raw = F.replace(F.replace(c, F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&")) if lenient else c
    return F.coalesce(parsed, raw)


@cache
def _marked() -> tuple[str, str]:
    """All letters that are an ASCII letter or digit with marks, by their canonical decomposition, and these."""
    marked, plain = [], []
    for cp in range(0x80, 0x110000):
        parts = unicodedata.normalize("NFD", chr(cp))
        bare = "".join(x for x in parts if not "\u0300" <= x <= "\u036f")
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            marked.append(chr(cp))
            plain.append(bare)
    return "".join(marked), "".join(plain)


def slug(c: Column) -> Column:
    """Letters without marks, lower case, & as 'ja', runs of all but a-z and 0-9 as single dashes."""
    t = F.regexp_replace(F.translate(c, *_marked()), r"[\u0300-\u036f]+", "")
    t = F.replace(F.lower(t), F.lit("&"), F.lit(" ja "))
    return F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "-"), F.lit("-"))


@F.pandas_udf(T.StringType())
def last_json_object(c: pd.Series) -> pd.Series:
    """The JSON object that a text ends with (white space may follow), tried from the last { backwards; null if none parses."""

    def last(t: str | None) -> str | None:
        at = len(t or "")
        while (at := (t or "").rfind("{", 0, at)) >= 0:
            try:
                return json.dumps(json.loads(t[at:]), ensure_ascii=False)
            except ValueError:
                continue
        return None

    return c.map(last, na_action="ignore").astype(object).where(c.notna(), None)


def positive_int(c: Column, fallback: int) -> Column:
    """The whole number that a text begins with if it is 1 or more, else fallback."""
    return bound(F.try_to_number(F.regexp_extract(c, rf"^{WS}*\+?([0-9]{{1,18}})", 1), F.lit("999999999999999999")).cast("long"), lambda n: F.when(n >= 1, n).otherwise(fallback))


def status_code(c: Column) -> Column:
    """The first number of exactly three digits, or null."""
    return bound(F.regexp_extract(c, BOUNDARY + r"(\d{3})" + BOUNDARY, 1), lambda n: F.when(n != "", n).cast("int"))
