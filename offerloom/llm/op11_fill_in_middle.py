"""Fill-in-middle: texts cut in three at unit ranks, and put together again with sentinels in prefix or suffix order.

A unit is a run of ASCII letters or one other character. One Aho-Corasick automaton reads a text's classes and reports
where letters begin or end, and sentinels. Between two such events lie letters, which are one unit, or others, which are
as many units as characters: so counts and ranks come from the events alone.
"""

from __future__ import annotations

from itertools import chain, product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
_CHANGE, _SENTINEL = 1, 2


class Units:
    """Counts and places of the units of texts, block by block, so that memory beside a text is a block's events."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS, block: int = 1 << 16):
        letters = bytes(range(ord("A"), ord("Z") + 1)) + bytes(range(ord("a"), ord("z") + 1))
        kept = set("".join(sentinels).encode("ascii"))
        other = set(range(128)) - set(letters)
        # a letter and another sign stand for all that no sentinel holds
        some_letter, some_other = (min(x - kept, default=min(x)) for x in (set(letters), other))
        self.table = bytes(c if c in kept else some_letter if c in letters else some_other for c in range(256))
        self.letters = {c for c in letters if c in kept} | {some_letter}
        others = {c for c in other if c in kept} | {some_other}
        self.automaton = ahocorasick.Automaton()
        for a, b in chain(product(self.letters, others), product(others, self.letters)):
            self.automaton.add_word(chr(a) + chr(b), _CHANGE)
        for x in sentinels:
            # a sentinel of two signs may be a change of class too
            self.automaton.add_word(x, self.automaton.get(x, 0) | _SENTINEL)
        self.automaton.make_automaton()
        self.reach, self.block = max(1, *(len(x) - 1 for x in sentinels)), block

    def classes(self, text: str) -> bytes:
        """A byte for each code point: itself where sentinels hold it, else one that stands for its class."""
        return text.encode("ascii", "replace").translate(self.table)

    def scan(self, classes: bytes, a: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Of the block at a: where its runs begin, how many units begin in each, and whether a sentinel ends in it."""
        b, begin = min(len(classes), a + self.block), max(0, a - self.reach)
        end, kind = np.fromiter(chain.from_iterable(self.automaton.iter(classes[begin:b].decode("ascii"))), np.int64).reshape(-1, 2).T
        end, kind = end + begin, np.where(end + begin >= a, kind, 0)
        change = end[kind & _CHANGE > 0]
        fresh = a == 0 or (len(change) > 0 and change[0] == a)
        runs = change if a and fresh else np.concatenate(([a], change))
        letter = (np.arange(len(runs)) % 2 == 0) == (classes[a] in self.letters)
        units = np.where(letter, 1, np.diff(runs, append=b))
        if letter[0] and not fresh:
            units[0] = 0
        return runs, units, bool((kind & _SENTINEL).any())

    def measure(self, classes: bytes) -> tuple[np.ndarray, bool]:
        """How many units begin before each block and in all, and whether the text holds a sentinel."""
        counts, sentinel = [0], False
        for a in range(0, len(classes), self.block):
            _, units, found = self.scan(classes, a)
            counts.append(int(units.sum()))
            sentinel |= found
        return np.cumsum(counts), sentinel

    def place(self, classes: bytes, before: np.ndarray, rank: int) -> int:
        """Where the unit of a rank (from 0) begins; the text's length for the rank after the last."""
        if rank >= before[-1]:
            return len(classes)
        block = int(np.searchsorted(before, rank, side="right")) - 1
        runs, units, _ = self.scan(classes, block * self.block)
        ends, rest = np.cumsum(units), rank - int(before[block])
        run = int(np.searchsorted(ends, rest, side="right"))
        return int(runs[run] + rest - (ends[run] - units[run]))


def fill_in_middle(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, seed: int = 1, percent: int = 90, suffix_first: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    The ends of prefix and middle are drawn from the units' ranks 0 to n by a hash of seed and id; percent of the texts
    are cut, and of these suffix_first per cent are "spm" (suffix, prefix, middle), the others "psm". A text that is empty
    or holds a sentinel stays "plain". Null texts count as empty, a null id as the empty id; repeated rows get the same, an
    empty table gives an empty result, other columns are not read. No shuffle: a scan task takes its own rows, about
    512 KB or one longer text at a time. Sentinels are ASCII and begin with a sign that is nowhere else in them, so that
    restored() finds them.
    """
    p, s, m = sentinels
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def cut(batches):
        units = Units(sentinels)
        for batch in slices(batches, "text"):
            out = []
            draws = zip(*(batch.column(f"h{k}").to_pylist() for k in range(1, 5)))
            for text, (h1, h2, h3, h4) in zip(batch.column("text").to_pylist(), draws):
                text = text or ""
                classes = units.classes(text)
                before, sentinel = units.measure(classes)
                n = int(before[-1])
                if not text or sentinel or h3 % 100 >= percent:
                    out.append((n, "plain", None, None, text))
                    continue
                a, b = (units.place(classes, before, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                if h4 % 100 < suffix_first:
                    out.append((n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))))
                else:
                    out.append((n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns, types)], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *numbers)
    return rows.mapInArrow(cut, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle made an output of."""

    def between(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        b, c = F.locate(second, output), F.locate(third, output)
        at = b + len(second)
        return output.substr(F.lit(len(first) + 1), b - len(first) - 1), output.substr(at, c - at), output.substr(c + len(third), F.length(output))

    p, s, m = sentinels
    prefix, suffix, middle = between(p, s, m)
    suffix2, prefix2, middle2 = between(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    text = restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
