"""Substring dedup: paragraphs that repeat, near or exact, by MinHash bands, exact Jaccard and components; and runs of
words that repeat exactly anywhere in a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, passing, slices, stored
from .setjoin import close_edges, salted, signatures, verified, wanted, with_blocks
from .words import byte_words, distinct_sets, mix, placed_words, run_hashes, shingles

#: Tuned for recall at a Jaccard of 0.8: 1 - (1 - 0.8 ** 4) ** 14 = 0.9994 of such pairs share a band.
BANDS, ROWS = 14, 4
#: Shorter paragraphs are common phrases; they are left alone. 1 compares all.
LEAST_WORDS = 20
#: Runs of so many words are compared anywhere in a text, across lines; of as many starts in a row one at least is taken,
#: so every passage of 2 * RUN - 1 words that repeats exactly is found.
RUN = 20
#: Words whose hash decides whether a run starts there.
HEAD = 3
#: A task works on so many bytes of texts at a time.
SLICE_BYTES = 1 << 18
#: A paragraph or run says something if its words are this share of them different ones; the like of one word over and
#: over is no passage. 0 takes all.
VARIED = 0.4


def _hashed(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and their texts' first ones, a key of each text's sequence of words, its distinct shingles and where they begin."""
    words, first = byte_words(parts)
    key = run_hashes(words, first[:-1], first[1:]).view(np.int64)
    h, begins = distinct_sets(*shingles(words, first))
    return words, first, key, h, begins


def _bands(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(parts, BANDS) keys; every part has a shingle."""
    out = np.zeros((len(begins) - 1, BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93), begins[:-1])
        out[:, k // ROWS] = mix(out[:, k // ROWS] + least)
    return mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def paragraph_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in characters of the paragraphs of a text that are not empty; "\\n" ends one."""
    out, at = [], 0
    for line in text.split("\n"):
        if line:
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def paragraphs(docs: DataFrame, least_words: int = LEAST_WORDS, varied: float = VARIED) -> DataFrame:
    """(id, start, end, node, n, bands, sig) of the varied paragraphs of least_words words or more of (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "start", "end", "node", "n", "bands", "sig"]

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            at, where, parts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b in paragraph_places(text or ""):
                    if b - a >= 2 * least_words - 1:
                        at.append(i)
                        where.append((a, b))
                        parts.append(text[a:b])
            words, first, key, h, begins = _hashed(parts)
            different = np.diff(distinct_sets(words, first)[1])
            own = (np.diff(first) >= max(1, least_words)) & (different >= varied * np.minimum(np.diff(first), 2 * least_words))
            ok = np.flatnonzero(own)
            if not len(ok):
                continue
            n = np.diff(begins)[ok]
            h, begins = h[np.repeat(own, np.diff(begins))], np.concatenate(([0], np.cumsum(n)))
            place = np.array(where, np.int64)[ok]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * BANDS), pa.array(_bands(h, begins).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.array(at)[ok])), pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array(key[ok]), pa.array(n), bands, pa.array(signatures(h, begins), pa.binary())], names=names)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, start long, end long, node long, n long, bands array<long>, sig binary")


def run_starts(words: np.ndarray, first: np.ndarray, size: int = RUN, varied: float = VARIED) -> np.ndarray:
    """Words at which runs of size words start: the least head of any size starts in a row of a text (winnowing).

    Whether a run starts is decided by the 2 * size - 1 words around it, so of 2 * size - 1 words or more that two texts
    share both have a run, and a text's runs leave no word between them out. Unless varied is 0, equal heads close
    together, as repeated words have, are thinned out to half of size, and runs of few different words are left out.
    """
    if len(words) < 2 * size - 1:
        return np.empty(0, np.int64)
    head = min(HEAD, size)
    at = np.arange(len(words) - head + 1)
    heads = run_hashes(words, at, at + head)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.flatnonzero(np.arange(len(words)) + 2 * size - 1 <= first[1:][own])
    windows = np.lib.stride_tricks.sliding_window_view(heads, size)
    found = np.unique(begin + windows[begin].argmin(1)) if len(begin) else begin
    if not varied:
        return found
    same = np.concatenate(([False], (heads[found[1:]] == heads[found[:-1]]) & (found[1:] - found[:-1] < size // 2) & (own[found[1:]] == own[found[:-1]])))
    if same.any():
        keep, last = np.ones(len(found), bool), 0
        for k in range(len(found)):
            if same[k] and found[k] - found[last] < size // 2:
                keep[k] = False
            else:
                last = k
        found = found[keep]
    if not len(found):
        return found
    inside = np.sort(np.lib.stride_tricks.sliding_window_view(words, size)[found], axis=1)
    return found[1 + (inside[:, 1:] != inside[:, :-1]).sum(1) >= varied * size]


def runs(docs: DataFrame, size: int = RUN, varied: float = VARIED) -> DataFrame:
    """(id, start, end, node) of the runs of (id, text) that begin at run_starts; node is a key of a run's words."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            words, first, start, end = placed_words([x or "" for x in batch.column("text").to_pylist()])
            at = run_starts(words, first, size, varied)
            owner = np.searchsorted(first, at, side="right") - 1
            node = run_hashes(words, at, at + size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(start[at]), pa.array(end[at + size - 1]), pa.array(node)], names=["id", "start", "end", "node"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, start long, end long, node long")


def repeated_runs(docs: DataFrame, size: int = RUN, varied: float = VARIED) -> DataFrame:
    """(id, start, end, first) of the runs whose words an earlier run has, by id and start; first is the earliest.

    Runs are counted by their keys alone, summed up before they are dealt; only those that repeat keep their places. A key
    that very many texts share meets one row, in a stage of its own, which Spark can split. A run that overlaps the
    first in its own text stays.
    """
    with passing(docs.sparkSession, "runs") as folder:
        found = stored(runs(docs, size, varied), "all", folder, compression="zstd")
        twice = stored(found.groupBy("node").agg(F.count("*").alias("count"), F.min("id").alias("least")).where("count > 1").select("node", "least"), "twice", folder)
        again = stored(found.join(twice, "node"), "repeated-runs", compression="zstd")
    first = again.where("id = least").groupBy("node").agg(F.min(F.struct("id", "start", "end")).alias("first"))
    later = (F.col("id") != F.col("first.id")) | (F.col("start") >= F.col("first.end"))
    return again.join(stored(first, "first-runs"), "node").where(later).select("id", "start", "end", "first")


def _texts(rows: DataFrame) -> DataFrame:
    """(node, text) of the paragraphs wanted: node, start and end in (text, wanted)."""

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            parts, nodes = [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                parts += [text[x["start"] : x["end"]] for x in places]
                nodes += [x["node"] for x in places]
            own = pa.array(_hashed(parts)[2] == np.array(nodes, np.int64))  # an id may have several texts
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parts, pa.string())], names=["node", "text"]).filter(own)

    return rows.select("text", "wanted").mapInArrow(run, "node long, text string")


def _sets(texts: list[str]) -> list[np.ndarray]:
    *_, h, begins = _hashed(texts)
    return [h[a:b] for a, b in zip(begins, begins[1:])]


def near_paragraphs(rows: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS, varied: float = VARIED) -> DataFrame:
    """Per paragraph of (id, text) that a class has before: id, start, end, n, keep (first, node of the class), exact.

    Paragraphs of equal words are one node from the start. Nodes that share a band are compared by sizes and parity
    signatures there; those that these don't tell apart are a group, in which sets of five-word shingles are compared
    exactly. The links' components are the classes, and the first paragraph of each, by id and start, is kept.
    """
    parts = stored(paragraphs(rows, least_words, varied), "paragraphs", compression="zstd")
    place = F.struct("id", "start", "end")
    classes = stored(parts.groupBy("node", "n").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")), "paragraph-classes", compression="zstd")
    postings = salted(classes.select("node", "n", F.explode("bands").alias("h")))
    with passing(rows.sparkSession, "paragraph-keys") as folder:
        groups = components(close_edges(postings, classes.select("node", "n", "sig"), folder, percent)).select("node", F.col("root").alias("comp"))
    candidates = stored(groups.join(classes.select("node", "n", "first", "copies"), "node"), "paragraph-candidates")
    blocks = with_blocks(candidates.select("comp", "node", "n", "copies"))
    places = candidates.groupBy(F.col("first.id").alias("id")).agg(F.collect_list(F.struct("node", F.col("first.start").alias("start"), F.col("first.end").alias("end"))).alias("wanted"))
    links = stored(verified(_texts(wanted(rows, places.select("id")).join(places, "id")).join(blocks, "node"), _sets, percent), "paragraph-links")
    repeated = classes.select("node", "first", "last").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = repeated.groupBy("root").agg(F.min(F.struct("first", "node")).alias("keep"), F.max("last").alias("last")).where(F.col("keep.first") != F.col("last"))
    of = stored(repeated.join(first.drop("last"), "root").select("node", "keep"), "paragraph-kept")
    later = parts.select("id", "start", "end", "node", "n").join(of, "node").where(place != F.col("keep.first"))
    return later.select("id", "start", "end", "n", "keep", (F.col("node") == F.col("keep.node")).alias("exact"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = LEAST_WORDS, run: int = RUN, varied: float = VARIED) -> DataFrame:
    """Per passage to remove: id, start, end (characters), n_shingles, exact, and the kept one's first_<id>, first_start.

    Passages are paragraphs of least_words words or more that are a copy, near (a Jaccard of percent or more over
    five-word shingles) or exact (exact says that the words are the kept one's), of an earlier paragraph's class, and
    runs of run words that an earlier run repeats exactly, wherever they lie, so every passage of 2 * run - 1 words or more
    is found. Rows may lie within others; remove their union. Passages of few different words (varied) are left
    alone. With least_words 1 and varied 0 no paragraph and no run is left out. Null and empty texts and null ids give no rows; repeated rows of one id and text are the same passages; an
    empty table gives an empty result. Other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = [F.col("id").alias(id_col), F.col("start"), F.col("end")]
    whole = near_paragraphs(rows, percent, least_words, varied).select(*kept, F.col("n").alias("n_shingles"), F.col("keep.first.id").alias(f"first_{id_col}"), F.col("keep.first.start").alias("first_start"), "exact")
    inside = repeated_runs(rows, run, varied).select(*kept, F.lit(max(1, run - 4)).cast("long").alias("n_shingles"), F.col("first.id").alias(f"first_{id_col}"), F.col("first.start").alias("first_start"), F.lit(True).alias("exact"))
    return whole.unionByName(inside)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
