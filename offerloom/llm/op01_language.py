"""Language ID: scripts narrow the candidates, then Viterbi over per-word scores labels spans of mixed texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

BINS = 1 << 16
#: Words are worked on in blocks of so many, side by side.
BLOCK = 64
#: First and last code point of the blocks in which scripts have their letters.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
N_SCRIPTS = len(SCRIPTS) + 2  # 0: no letter; the last: any other script


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script's number, 0 for no letter; the lower-case code point where that is one."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            script[cp] = N_SCRIPTS - 1
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    for k, blocks in enumerate(SCRIPTS.values(), 1):
        for a, b in blocks:
            own = script[a : b + 1]
            own[own > 0] = k
    return script, lower


@dataclass
class Words:
    """The words of some texts: runs of letters of one script."""

    bins: np.ndarray  # of each letter's trigram, with the word's ends marked
    first: np.ndarray  # of each word, its first letter's index in bins
    doc: np.ndarray
    script: np.ndarray
    start: np.ndarray  # character offsets in the word's text
    end: np.ndarray


def words_of(texts: list[str]) -> Words:
    script_of, lower = _tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))[:-1]
    script = script_of[codes]
    before = np.concatenate(([0], script[:-1])) if len(script) else script
    after = np.concatenate((script[1:], [0])) if len(script) else script
    at = np.flatnonzero(script)
    head, tail = (before != script)[at], (after != script)[at]
    low = lower[codes[at]]
    left, right = np.concatenate(([0], low[:-1])).astype(np.uint32), np.concatenate((low[1:], [0])).astype(np.uint32)
    left[head[: len(left)]] = 0
    right[tail[: len(right)]] = 0
    left, right = left[: len(low)], right[: len(low)]
    mixed = left * np.uint32(0x9E3779B1) ^ low * np.uint32(0x85EBCA77) ^ right * np.uint32(0xC2B2AE3D)
    bins = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    start, end = at[head], at[tail] + 1
    doc = np.searchsorted(begins, start, side="right") - 1
    return Words(bins, np.flatnonzero(head), doc, script[start], start - begins[doc], end - begins[doc])


@dataclass
class LanguageModel:
    """Log probabilities of trigram bins by language, and which languages a script may hold."""

    langs: list[str]
    logp: np.ndarray  # (BINS, languages)
    allowed: np.ndarray  # (scripts, languages)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = 5000, max_langs: int = 200, share: float = 0.01) -> LanguageModel:
    """Learn from about per_lang rows of each language at most, taken by a hash of the id.

    Trigram counts are summed by Spark; languages times BINS sums come to the driver, of max_langs languages at
    most (more: an error). A language may use a script that holds at least share of its letters. Rows with a null
    text or language are left out. No rows: a model without languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(lang_col).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((BINS, 0), np.float32), np.ones((N_SCRIPTS, 0), bool))
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    fraction = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    sample = rows.where(part < fraction[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        sums = {}
        for batch in slices(batches, "text"):
            names = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            w = words_of(batch.column("text").to_pylist())
            if len(w.first):
                lang = names[w.doc]
                letters = np.diff(np.append(w.first, len(w.bins)))
                key = np.repeat(lang, letters).astype(np.int64) * BINS + w.bins
                for base, keys in ((0, key), (1 << 40, np.repeat(lang.astype(np.int64) * N_SCRIPTS + w.script, letters))):
                    k, n = np.unique(keys, return_counts=True)
                    for a, b in zip((k + base).tolist(), n.tolist()):
                        sums[a] = sums.get(a, 0) + b
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])

    totals = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = totals["key"].to_numpy(np.int64), totals["n"].to_numpy(np.int64)
    counts, letters = np.zeros((len(langs), BINS)), np.zeros((len(langs), N_SCRIPTS))
    low = key < 1 << 40
    counts.ravel()[key[low]] = n[low]
    letters.ravel()[key[~low] - (1 << 40)] = n[~low]
    smooth = 0.1
    logp = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BINS)).T.astype(np.float32)
    return LanguageModel(langs, logp, (letters >= share * np.maximum(1, letters.sum(1, keepdims=True))).T & (letters.T > 0))


def word_scores(words: Words, model: LanguageModel, most: float = 12.0) -> np.ndarray:
    """(words, languages): at most 0, for the best language 0, never under -most; 0 for all where the script is unknown."""
    scores = np.add.reduceat(model.logp[words.bins], words.first, axis=0) if len(words.first) else np.zeros((0, len(model.langs)), np.float32)
    allowed = model.allowed[words.script]
    scores = np.where(allowed, scores, -np.inf)
    best = scores.max(axis=1, keepdims=True)
    known = np.isfinite(best)
    return np.where(known, np.maximum(scores - np.where(known, best, 0), -most), 0).astype(np.float32)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word when each change inside a text costs penalty.

    doc: the text of each word, ascending. Blocks of words are worked on side by side: first each block's best
    sums from any state before it to any at its end, then these are chained, then paths are traced back.
    """
    n, k = scores.shape
    if not n or k < 2:
        return np.zeros(n, np.int64)
    head = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin = np.flatnonzero(head)[np.cumsum(head) - 1]
    place = np.arange(n) - begin
    first = np.flatnonzero(place % BLOCK == 0)
    blocks, length = len(first), np.diff(np.append(first, n))
    nth = place[first] // BLOCK
    grid = np.zeros((BLOCK, blocks, k), np.float32)
    owner = np.repeat(np.arange(blocks), length)
    grid[place % BLOCK, owner] = scores
    live = np.arange(BLOCK)[:, None] < length
    sums = np.where(np.eye(k, dtype=bool), 0, -penalty).astype(np.float32)[None] + grid[0][:, None, :]
    for t in range(1, BLOCK):
        on = np.flatnonzero(live[t])
        if not len(on):
            break
        old = sums[on]
        sums[on] = np.maximum(old, old.max(axis=2, keepdims=True) - penalty) + grid[t, on][:, None, :]
    entry = np.zeros((blocks, k), np.float32)
    leave = np.zeros((blocks, k), np.float32)
    for b in range(int(nth.max()) + 1):
        on = np.flatnonzero(nth == b) if b < 2 else on[np.append(nth[1:], 0)[on] == b] + 1
        if b:
            entry[on] = leave[on - 1]
        leave[on] = (entry[on][:, :, None] + sums[on]).max(axis=1)
    stays, heads, value = np.zeros((BLOCK, blocks, k), bool), np.zeros((BLOCK, blocks), np.int64), entry
    for t in range(BLOCK):
        on = live[t][:, None]
        top = value.max(axis=1)
        heads[t] = value.argmax(axis=1)
        stays[t] = value >= (top - penalty)[:, None]
        value = np.where(on, np.maximum(value, (top - penalty)[:, None]) + grid[t], value)
    path = np.zeros((BLOCK, blocks, k), np.int16)
    state = np.broadcast_to(np.arange(k), (blocks, k)).copy()
    rows = np.arange(blocks)[:, None]
    for t in range(BLOCK - 1, -1, -1):
        path[t] = state
        state = np.where(live[t][:, None], np.where(stays[t][rows, state], state, heads[t][:, None]), state)
    last = np.append(nth[1:], 0) == 0
    final = np.where(last, leave.argmax(axis=1), 0)
    for b in range(int(nth.max()), 0, -1):
        on = np.flatnonzero(nth == b)
        final[on - 1] = state[on, final[on]]
    return path[place % BLOCK, owner, final[owner]].astype(np.int64)


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """Per row: id, lang_pred, score, and spans (start, end in characters, lang) if asked for.

    lang_pred has most letters of the text; score is its share of them. A null text, or one without a letter, has
    und and score 0; letters of a script that no language was learned with count for none, and a text of such
    letters alone has the first language and score 0. Ties go to the first language. The model, of languages times
    BINS numbers, is sent to each task; texts are not shuffled. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = sent.value
        n = len(model.langs)
        for batch in slices(batches, "text", (1 << 20) // max(1, n // 16)):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            w = words_of(texts)
            letters = np.diff(np.append(w.first, len(w.bins)))
            some = np.bincount(w.doc, letters, len(texts)) > 0
            if not n:
                some[:] = False
                n_pred, share, runs = np.zeros(len(texts), np.int64), np.zeros(len(texts)), [[] for _ in texts]
            else:
                best = viterbi(word_scores(w, model), w.doc, penalty)
                known = letters * model.allowed[w.script].any(axis=1)
                by = np.bincount(w.doc * n + best, known, len(texts) * n).reshape(-1, n)
                n_pred = by.argmax(axis=1)
                share = by.max(axis=1) / np.maximum(1, np.bincount(w.doc, letters, len(texts)))
                runs = [[] for _ in texts]
                if spans and len(best):
                    new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (w.doc[1:] != w.doc[:-1]))))
                    ends = w.end[np.append(new[1:], len(best)) - 1]
                    for d, a, b, x in zip(w.doc[new].tolist(), w.start[new].tolist(), ends.tolist(), best[new].tolist()):
                        runs[d].append({"start": a, "end": b, "lang": model.langs[x]})
            pred = [model.langs[p] if s else "und" for p, s in zip(n_pred.tolist(), some.tolist())]
            out = [batch.column("id"), pa.array(pred, pa.string()), pa.array(np.where(some, share, 0.0), pa.float64())]
            if spans:
                out.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=["id", "lang_pred", "score", "spans"][: len(out)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    return rows.mapInArrow(label, schema).withColumnRenamed("id", id_col)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = fit(docs.where(~held_out))
    return label_languages(docs, model, spans=False).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
