"""Toxicity: a factorization machine over hashed terms, which learns how pairs of terms act together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_names, slices, stored
from .words import byte_words, distinct_sets, mix, run_hashes, stem_terms

#: Words, and so many first letters of longer words, which forms of one word share, are hashed to so many bins.
BINS, STEMS = 1 << 20, (3, 4, 5, 6, 7)
#: A term is a bin that a text has so often or more, or twice or more and once in so many words or more: number
#: k * BINS + bin for the kth of these.
TIMES, RATES = (1, 2, 4), (100, 50, 25)
#: Each sampled text has the least hashes of its words under BANDS * ROWS seeds. Two texts are compared if all ROWS of a
#: band agree, and are copies if SAME of all of them do: so much is the Jaccard of their word sets, to about 0.05.
BANDS, ROWS, SAME = 16, 4, 0.85
#: A document is predicted toxic from this score on.
REJECT = 0.7
#: The share of the clean rows that calibration may let be taken at most.
CLEAN_LOSS = 0.002
FOLDS = 4


def terms_of(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for each term of each text, by text and term; of the bins that known marks alone, if it is given."""
    hashes, doc, words = stem_terms(texts, STEMS)
    bins = (hashes % np.uint64(BINS)).astype(np.int64)
    if known is not None:
        doc, bins = doc[known[bins]], bins[known[bins]]
    pairs, count = np.unique(doc * BINS + bins, return_counts=True)
    often = [pairs[count >= n] for n in TIMES] + [pairs[(count >= 2) & (count * r >= words[pairs // BINS])] for r in RATES]
    doc = np.concatenate([x // BINS for x in often])
    term = np.concatenate([x % BINS + k * BINS for k, x in enumerate(often)])
    order = np.lexsort((term, doc))
    return doc[order], term[order]


@dataclass
class FactorizationMachine:
    """score = sigmoid(w0 + sum w + sum over pairs of <v_i, v_j>) over the chosen terms of a text."""

    terms: np.ndarray  # chosen, ascending
    w0: float
    w: np.ndarray
    v: np.ndarray  # (terms, factors)

    def scores(self, texts: list[str]) -> np.ndarray:
        known = np.zeros(BINS, bool)
        known[self.terms % BINS] = True
        doc, term = terms_of(texts, known)
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        own = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        d, t = doc[own], at[own]
        linear = np.bincount(d, self.w[t], len(texts))
        both = np.zeros(len(texts))
        for f in range(self.v.shape[1]):
            x = self.v[t, f]
            both += np.bincount(d, x, len(texts)) ** 2 - np.bincount(d, x * x, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.w0 + linear + both / 2, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, factors: int, rounds: int, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the weighted logistic loss over the whole (rows, terms) 0/1 matrix."""
    rng = np.random.default_rng(7)
    p = [np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], factors))]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        xv = x @ p[2]
        z = p[0] + x @ p[1] + (xv**2 - x @ p[2] ** 2).sum(1) / 2
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        xg = x.T @ g
        grads = [g.sum(keepdims=True), xg + l2 * p[1], x.T @ (g[:, None] * xv) - xg[:, None] * p[2] + l2 * p[2]]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.999 * s[i] + 0.001 * d * d
            p[i] = p[i] - 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """The (id, y, text) that are no copies, as (id, y, terms): a text goes if one of less id has its label y and its words.

    Words are what white space parts, in lower case. Equal word sets are grouped first. Then each band's first text is compared with the band's others by their least
    hashes, so texts that only share some are kept; the first of all texts that are copies of each other stays.
    Texts without letters go.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches):
        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            doc, term = terms_of(texts)
            terms = np.split(term.astype(np.int32), np.searchsorted(doc, np.arange(1, len(texts))))[: len(texts)]
            h, begins = distinct_sets(*byte_words(texts))
            words = run_hashes(h, begins[:-1], begins[1:]).view(np.int64)
            least = [[int(mix(h[a:b] ^ np.uint64(seed)).min() >> np.uint64(33)) for seed in range(BANDS * ROWS)] if b > a else None for a, b in zip(begins, begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array(words), pa.array(least, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.int32()))],
                names=["id", "y", "words", "least", "terms"],
            )

    found = rows.select("id", "y", "text").mapInArrow(read, f"id {kind}, y int, words long, least array<int>, terms array<int>").where("size(terms) > 0")
    sets = stored(found.groupBy("y", "words").agg(F.min_by(F.struct("id", "least", "terms"), "id").alias("x")).select("y", "words", "x.*"), "toxicity-sets")
    bands = sets.select("y", "words", "id", "least", F.posexplode(F.array(*[F.xxhash64(*[F.col("least")[k * ROWS + j] for j in range(ROWS)]) for k in range(BANDS)])).alias("k", "band"))
    head = bands.groupBy("y", "k", "band").agg(F.min(F.struct("id", "words", "least")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.size(F.filter(F.arrays_zip("least", F.col("head.least").alias("other")), lambda x: x["least"] == x["other"]))
    copies = bands.join(F.broadcast(head), ["y", "k", "band"]).where((F.col("words") != F.col("head.words")) & (same >= SAME * BANDS * ROWS))
    return sets.join(copies.select("y", "words").distinct(), ["y", "words"], "left_anti").select("id", "y", "terms")


def _logit(share: float) -> float:
    return float(np.log(share / (1 - share)))


def decision(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reject: float = REJECT, clean_loss: float = CLEAN_LOSS) -> float:
    """The log-odds from which rows are best taken, the log-odds of reject at most, from scores of rows not learned from.

    It takes most toxic rows less clean ones, counted by weight, and no more clean rows than leave clean_loss likely:
    of n clean rows, one fewer than clean_loss * (n + 1). It lies midway to the next lower score.
    """
    top = _logit(reject)
    clean = y == 0
    allowed = clean_loss * (weight[clean].sum() + 1) - 1
    order = np.argsort(-z, kind="stable")
    z, gain, lost = z[order], np.cumsum(np.where(clean, -weight, weight)[order]), np.cumsum(np.where(clean, weight, 0)[order])
    last = np.append(z[1:] != z[:-1], True) if len(z) else np.empty(0, bool)
    now = gain[z >= top][-1] if (z >= top).any() else 0.0
    fits = np.flatnonzero(last & (z < top) & (lost <= allowed) & (gain > now))
    if not len(fits):
        return top
    best = fits[np.argmax(gain[fits])]
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, max_terms: int = 512, least_z: float = 4.0, least_df: int = 8, factors: int = 4) -> FactorizationMachine:
    """Learn from about per_class labelled documents of each class at most, taken by a hash of the id.

    The sample's ids, 2 * per_class rows, are broadcast to the scan. Of copies with one label, near or exact, one
    stays (see distinct_texts), so that a group of copies teaches no words of its own. Spark counts in how many
    sampled documents of each class a term is; terms whose shares differ by least_z standard errors, in least_df
    documents or more, are chosen, max_terms of them at most. Only these, for the sample, go to the driver.
    The same is done with each of FOLDS parts of the sample left out; their scores, of rows not learned from, tell from which
    log-odds on rows are best taken (see decision), and the model is moved so that these are the score REJECT.
    A document with several labels is toxic if one says so; null ids and labels are left out. Without labels of
    both classes the score of every text is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    none = FactorizationMachine(np.empty(0, np.int64), float(np.log((pos + 1) / (neg + 1))), np.empty(0), np.empty((0, factors)))
    if not pos or not neg:
        return none
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(part < F.when(F.col("y") == 1, per_class / pos).otherwise(per_class / neg))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    fold = F.pmod(F.xxhash64("terms"), F.lit(FOLDS)).cast("int").alias("fold")
    kept = stored(distinct_texts(rows).select("y", fold, "terms"), "toxicity-terms")
    size = {(r.y, r.fold): r["count"] for r in kept.groupBy("y", "fold").count().collect()}
    n1, n0 = (sum(size.get((k, f), 0) for f in range(FOLDS)) for k in (1, 0))
    if not n1 or not n0:
        return none
    counts = [F.count_if((F.col("y") == k) & (F.col("fold") == f)).alias(f"d{k}_{f}") for k in (1, 0) for f in range(FOLDS)]
    df = stored(kept.select("y", "fold", F.explode("terms").alias("term")).groupBy("term").agg(*counts), "toxicity-counts")

    def chosen(out: int | None) -> np.ndarray:
        """The terms that tell the classes apart best without a fold."""
        folds = [f for f in range(FOLDS) if f != out]
        d1, d0 = (sum((F.col(f"d{k}_{f}") for f in folds), F.lit(0)) for k in (1, 0))
        m1, m0 = (sum(size.get((k, f), 0) for f in folds) for k in (1, 0))
        if not m1 or not m0:
            return np.empty(0, np.int64)
        share = (d1 + d0) / float(m1 + m0)
        z = F.try_divide(d1 / m1 - d0 / m0, F.sqrt(share * (1 - share) * (1 / m1 + 1 / m0)))  # null for a bin of all
        best = df.where(d1 + d0 >= least_df).select("term", F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(max_terms)
        return np.array(sorted(r["term"] for r in best.collect()), np.int64)

    by_fold = {f: chosen(f) for f in (None, *range(FOLDS))}
    terms = by_fold[None]
    if not len(terms):
        return none
    every = np.unique(np.concatenate(list(by_fold.values())))
    only = F.array(*[F.lit(int(t)) for t in every])
    data = kept.select("y", "fold", F.array_intersect("terms", only).alias("terms")).groupBy("y", "fold", F.array_sort("terms").alias("terms")).count().orderBy("y", "fold", "terms").collect()
    x = np.zeros((len(data), len(every)))
    for i, r in enumerate(data):
        x[i, np.searchsorted(every, r["terms"])] = 1
    y, of = np.array([r["y"] for r in data], float), np.array([r["fold"] for r in data])
    times = np.array([r["count"] for r in data], float)
    weight = times * np.where(y == 1, pos / n1, neg / n0)  # as common as in the labels

    def learned(out: int | None) -> FactorizationMachine:
        here = of != out if out is not None else np.ones(len(y), bool)
        at = np.searchsorted(every, by_fold[out])
        w = weight[here]
        return FactorizationMachine(by_fold[out], *_descend(x[here][:, at], y[here], w / w.mean() / here.sum(), factors, 400, 1e-5))

    model = learned(None)
    unseen = np.full(len(y), -np.inf)
    for f in range(FOLDS):
        if len(by_fold[f]) and (of == f).any():
            m, rows_x = learned(f), x[of == f][:, np.searchsorted(every, by_fold[f])]
            unseen[of == f] = m.w0 + rows_x @ m.w + ((rows_x @ m.v) ** 2 - rows_x @ m.v**2).sum(1) / 2
    model.w0 += _logit(REJECT) - decision(unseen, y, times)
    return model


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), reject: float = REJECT) -> DataFrame:
    """Per row: id, the keep columns, score in 0 to 1, predicted (1 from reject on).

    Null and empty texts have the score of a text without terms. Rows are scored where they are scanned, repeated
    ones each; the model, of max_terms rows, is sent to each task. Keep columns named score or predicted are replaced;
    other columns are not read. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c.lower() not in ("score", "predicted"))
    (text,) = free_names((id_col, *keep), "text_read")

    def predict(batches):
        for batch in slices(batches, text):
            s = sent.value.scores([x or "" for x in batch.column(text).to_pylist()])
            names = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(s)], names=[*names, "score"])

    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias(text))
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema).withColumn("predicted", (F.col("score") >= reject).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
