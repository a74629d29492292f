"""Importance resampling towards a target: hashed word counts of corpus and target, a gain for each bucket, and a draw."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import documents, slices, stored

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Buckets(dict):
    """The bucket of each feature (its UTF-8 bytes); those met before are kept, up to a limit."""

    def __init__(self, buckets: int, limit: int = 400_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found

    def of(self, texts: list[str | None], runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of the features of all texts, and how many features and words each text has."""
        found, features, words = [], [], []
        for text in texts:
            # bytes.lower changes A to Z only
            w = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
            every = w if runs == 1 else [b" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
            found.append(np.fromiter(map(self.__getitem__, every), np.int64, len(every)))
            features.append(len(every))
            words.append(len(w))
        return np.concatenate([*found, np.empty(0, np.int64)]), np.array(features, np.int64), np.array(words, np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", runs: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Each scan task adds up one vector of buckets numbers, and a tree of tasks adds these: the driver gets a few.
    """

    def count(batches):
        total, memo = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in slices(batches, "text"):
            total += np.bincount(memo.of(batch.column("text").to_pylist(), runs)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r.counts), np.int64))
    return vectors.treeReduce(np.add, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor(1000 * ln of its share of the target over its share of the source), one added to each count."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = ((target + 1.0) * float(s + n)) / ((source + 1.0) * float(t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Per row: id, n_features, weight, score, rank.

    weight is the floored mean of the gains of a text's features, 0 without any; score adds a Gumbel number, drawn by a hash
    of seed and id, so that the percent highest of the rows with least_words words are a draw without replacement by
    weight. rank numbers them from 1, ties by the smaller id; the others' is null. Null texts have no words, a null id
    hashes as the empty id and comes first in ties, repeated rows are drawn each, empty tables give an empty result or
    counts of 0, other columns are not read.

    Two passes over the texts: the first adds up the counts, the second gathers the broadcast gains (8 bytes a bucket). Only
    ids and numbers are written and dealt by ranges of the score for the ranks; no text is.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_col, runs, buckets)))

    def weigh(batches):
        memo = Buckets(buckets)
        for batch in slices(batches, "text"):
            found, features, words = memo.of(batch.column("text").to_pylist(), runs)
            owner = np.repeat(np.arange(batch.num_rows), features)
            total = np.bincount(owner, weights=gain.value[found], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(features), pa.array(words), pa.array(total // np.maximum(features, 1))], names=["id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = rows.mapInArrow(weigh, f"id {kind}, n_features long, n_words long, weight long").withColumn("score", F.col("weight") + gumbel)
    scored = stored(weighed.select("id", "n_features", "weight", "score", (F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("down")), "weights")
    drawn = percent * scored.where("not short").count() // 100
    ranked = numbered(scored, "short", "down", "id")
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("n") <= drawn, F.col("n")).alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
