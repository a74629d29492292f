"""Benchmark decontamination: shared character q-grams are counted in overlapping diagonal bands, then aligned.

A probe of n characters that lies in a text with k edits or less shares at least n - q + 1 - k * q of its q-grams
with it (the q-gram lemma), on diagonals at most k apart. Only bands with so many are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, passing, slices, stored
from .words import _letters, mix

#: Characters of a gram, of a probe at most, and from one probe of a long item to the next.
Q, PROBE, STRIDE = 8, 128, 64
#: Edits allowed, as a share of the probe's length.
EDITS = 0.1
#: Items are searched in blocks of about so many characters: what a task holds of the benchmark at a time.
BLOCK_CHARS = 4_000_000
#: So many blocks are sent with one scan of the texts; a larger benchmark takes another scan.
SCAN_BLOCKS = 16
#: A task reads so many bytes of texts before it goes through the blocks.
HELD_BYTES = 1 << 25
_FILTER = 1 << 22


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters in lower case and digits, any run of others as one blank, texts parted by code 1.

    Returns the codes, each one's character offset in its text, and where each text begins (one more than texts).
    """
    is_letter, lower = _letters()
    codes = np.frombuffer("\x01".join(x.replace("\x01", " ") for x in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    word = is_letter[codes] | ((codes >= 48) & (codes <= 57))
    out = np.where(word, lower[codes], np.where(codes == 1, 1, 32)).astype(np.uint64)
    keep = np.concatenate(([True], ~((out[1:] == 32) & (out[:-1] == 32)))) if len(out) else np.empty(0, bool)
    at = np.flatnonzero(keep)
    place = np.searchsorted(at, begins)
    owner = np.searchsorted(begins, at, side="right") - 1
    return out[at], at - begins[owner], place


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each place where Q codes begin, and whether all of these lie in one text."""
    n = max(0, len(codes) - Q + 1)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(Q):
        part = codes[j : j + n]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        whole &= part != 1
    return mix(h), whole


@dataclass
class Index:
    """The probes of a block of items and their grams."""

    items: list
    item: np.ndarray  # of each probe
    codes: list[np.ndarray]  # of each probe
    edits: np.ndarray
    need: np.ndarray  # grams that must be shared
    grams: np.ndarray  # ascending
    first: np.ndarray  # where a gram's places begin, one more than grams
    probe: np.ndarray
    offset: np.ndarray
    seen: np.ndarray  # a filter by the grams' upper bits


def build_index(items: list, texts: list[str]) -> Index:
    """Items of fewer than Q normal characters have no gram and are never found."""
    owner, codes = [], []
    for k, text in enumerate(texts):
        c = normal([text.strip()])[0]
        starts = list(range(0, max(1, len(c) - PROBE + 1), STRIDE))
        if len(c) > PROBE and starts[-1] + PROBE < len(c):
            starts.append(len(c) - PROBE)
        for a in starts if len(c) >= Q else ():
            owner.append(k)
            codes.append(c[a : a + PROBE])
    n = np.array([len(c) for c in codes], np.int64)
    edits = np.maximum(0, np.minimum((n * EDITS).astype(np.int64), (n - Q) // Q))
    hashes = [grams(c)[0] for c in codes]
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    unique, first = np.unique(h[order], return_index=True)
    seen = np.zeros(_FILTER, bool)
    seen[(unique >> np.uint64(42)).astype(np.int64)] = True
    probe = np.repeat(np.arange(len(codes)), [len(x) for x in hashes])[order]
    offset = (np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64))[order]
    return Index(items, np.array(owner, np.int64), codes, edits, n - Q + 1 - edits * Q, unique, np.append(first, len(h)), probe, offset, seen)


def align(patterns: np.ndarray, lengths: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edits of each pattern anywhere in its region, and where the best match ends. Rows are padded with 0."""
    width = regions.shape[1]
    step = np.arange(width + 1)
    row = np.zeros((len(patterns), width + 1), np.int64)
    final = row.copy()
    for i in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (regions != patterns[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
        done = lengths == i + 1
        final[done] = row[done]
    return final.min(axis=1), final.argmin(axis=1)


def search(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) for each item found in a text: from its first to its last probe's place, and
    the edits of the best probe. Offsets are in characters; the start is exact up to the edits."""
    codes, place, begins = normal(texts)
    if not len(index.grams) or len(codes) < Q:
        return []
    h, whole = grams(codes)
    at = np.flatnonzero(index.seen[(h >> np.uint64(42)).astype(np.int64)] & whole)
    found = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
    same = index.grams[found] == h[at]
    at, found = at[same], found[same]
    times = index.first[found + 1] - index.first[found]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    posting = np.repeat(index.first[found], times) + nth
    probe = index.probe[posting]
    wide = index.edits[probe] + 1
    diagonal = np.repeat(at, times) - index.offset[posting] + 2 * PROBE
    band = diagonal // wide
    base = len(codes) + 4 * PROBE
    key, count = np.unique(np.concatenate((probe * base + band, probe * base + band - 1)), return_counts=True)
    probe, band = key // base, key % base
    enough = count >= index.need[probe]
    probe, band = probe[enough], band[enough]
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a in range(0, len(probe), 256):
        p, b = probe[a : a + 256], band[a : a + 256]
        k = index.edits[p]
        n = np.array([len(index.codes[x]) for x in p])
        low = b * (k + 1) - 2 * PROBE - k
        width = int((n + 4 * k + 2).max())
        where = low[:, None] + np.arange(width)
        regions = np.where((where >= 0) & (where < len(codes)), codes[np.clip(where, 0, len(codes) - 1)], 1)
        patterns = np.zeros((len(p), int(n.max())), np.uint64)
        for i, x in enumerate(p):
            patterns[i, : n[i]] = index.codes[x]
        edits, end = align(patterns, n, regions)
        for i in np.flatnonzero(edits <= k):
            last = int(low[i] + end[i]) - 1
            doc = int(np.searchsorted(begins, last, side="right")) - 1
            start = max(int(begins[doc]), last + 1 - int(n[i]))
            hit = (int(place[start]), int(place[last]) + 1, int(edits[i]))
            old = out.get((doc, int(index.item[p[i]])), hit)
            out[doc, int(index.item[p[i]])] = (min(old[0], hit[0]), max(old[1], hit[1]), min(old[2], hit[2]))
    return [(doc, item, *x) for (doc, item), x in sorted(out.items())]


def blocks(benchmark: DataFrame, folder: str, text_col: str = "text") -> Iterator[tuple[list[str], list[str]]]:
    """(keys, texts) of the benchmark's different texts, block by block, each of about block_chars characters.

    A text's key is its sha256. Copies are one text from the start, so a block does not grow with them. Where there are
    several blocks they are written to folder, one part each, so that each is read once.
    """
    texts = benchmark.where(F.length(text_col) >= Q).select(F.col(text_col).alias("text")).distinct()
    total = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    keyed = texts.select(F.sha2("text", 256).alias("key"), "text")
    if n > 1:
        block = F.pmod(F.xxhash64("text"), F.lit(n))
        keyed.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
        keyed = benchmark.sparkSession.read.schema("key string, text string, block long").parquet(folder)
    for k in range(n):
        own = (keyed.where(F.col("block") == k) if n > 1 else keyed).orderBy("key").collect()
        yield [r.key for r in own], [r.text for r in own]


def searching(sent: list, found, text_col: str):
    """What mapInArrow runs; found(batch, hits) gives the batch that comes of one and its hits, those of search() with
    the text's key for its number. A task holds the index of one block of sent at a time: where there are more, it goes
    through them for each HELD_BYTES of texts."""

    def run(batches):
        only = build_index(*sent[0].value) if len(sent) == 1 else None

        def through(held):
            hits: list[list] = [[] for _ in held]
            for block in sent:
                index = only or build_index(*block.value)
                for mine, batch in zip(hits, held):
                    mine += [(h[0], index.items[h[1]], *h[2:]) for h in search([x or "" for x in batch.column(text_col).to_pylist()], index)]
            return [found(batch, mine) for batch, mine in zip(held, hits)]

        held, size = [], 0
        for batch in slices(batches, text_col):
            held.append(batch)
            size += batch.column(text_col).nbytes
            if only or size >= HELD_BYTES:
                yield from through(held)
                held, size = [], 0
        if held:
            yield from through(held)

    return run


def scans(docs: DataFrame, benchmark: DataFrame, each, item_text_col: str) -> list[DataFrame]:
    """each(docs, sent, last) for every scan of the texts, where sent are the blocks that the scan searches.

    A scan's blocks are broadcast: SCAN_BLOCKS * BLOCK_CHARS characters at most, whatever the benchmark's size. A larger
    benchmark takes more scans, one after the other; each but the last writes what it finds, and its blocks are
    given up before the next ones are sent.
    """
    spark, out = docs.sparkSession, []
    with passing(spark, "items") as folder:
        left = blocks(benchmark, folder, item_text_col)
        block = next(left, None)
        while block is not None:
            sent = []
            while block is not None and len(sent) < SCAN_BLOCKS:
                sent.append(spark.sparkContext.broadcast(block))
                block = next(left, None)
            found = each(docs, sent, out)
            if block is not None:
                found = stored(found, "scanned")
                for x in sent:
                    x.destroy()
            out.append(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document and item found in it: id, item, start, end (characters) and edits.

    The items' different texts are searched in each text where it is scanned, whole, block by block; the hits alone are
    joined with the items of these texts. Null and empty texts, and null or short items, give nothing; equal items are
    found each; repeated rows give their rows again; an empty table on either side gives an empty result. Other columns
    are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, key string, start long, end long, edits int"

    def found(batch, hits):
        doc, key, start, end, edits = zip(*hits) if hits else ((),) * 5
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc, pa.int64())), pa.array(key, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())], names=["id", "key", "start", "end", "edits"])

    parts = scans(rows, benchmark, lambda d, sent, _: d.mapInArrow(searching(sent, found, "text"), schema), item_text_col)
    if not parts:
        return docs.sparkSession.createDataFrame([], f"id {kind}, item {item_kind}, start long, end long, edits int").withColumnsRenamed({"id": id_col, "item": item_col})
    items = benchmark.where(F.length(item_text_col) >= Q).select(F.col(item_col).alias("item"), F.sha2(item_text_col, 256).alias("key"))
    return reduce(DataFrame.unionByName, parts).join(items, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """docs without those that hold an item; all columns stay, whatever their names. Null and empty texts hold none."""

    def clean(batch, hits):
        stay = np.ones(batch.num_rows, bool)
        stay[[x[0] for x in hits]] = False
        return batch.filter(pa.array(stay))

    schema = T.StructType(docs.schema.fields)
    left = scans(docs, benchmark, lambda d, sent, before: (before[-1] if before else d).mapInArrow(searching(sent, clean, text_col), schema), item_text_col)
    return left[-1] if left else docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
