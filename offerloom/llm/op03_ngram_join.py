"""N-gram Jaccard join: a blocked sparse product of documents by shingles, within groups that share rare shingles.

Two sets with a Jaccard of t or more share members among the first of each, in any one order of all shingles (see
setjoin.key_count). The order here puts frequent shingles last. Documents that share enough of such first shingles, and
whose sizes and parity signatures allow the Jaccard, are joined to groups, and within a group (in blocks where it is
large) the product of the incidence matrix counts overlaps, discarding pairs that can't reach what their sizes ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, passing, slices, stored
from .setjoin import SALT_BITS, SALTS, close_edges, key_count, signatures, verified, wanted, with_blocks
from .words import byte_words, distinct_sets, mix, shingles

#: Shingles are counted in so many bins to find the frequent ones, of which so many bins at most are put last.
COUNT_BINS, FREQUENT = 1 << 24, 100_000
WORDS = 5


def _sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, where each text's begin, and a key of each text's set (equal for equal sets)."""
    h, begins = distinct_sets(*shingles(*byte_words(texts), size))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)))
    n = np.diff(begins)
    return h, begins, mix((sums[begins[1:]] - sums[begins[:-1]]) ^ n.astype(np.uint64)).view(np.int64)


def _summary(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: for each document (id, node, n, sig); for the task the bins of shingles that it has often."""
    kind = docs.schema["id"].dataType

    def run(batches):
        count = np.zeros(COUNT_BINS, np.uint16)
        for batch in slices(batches, "text"):
            h, begins, node = _sets([x or "" for x in batch.column("text").to_pylist()], size)
            bins, times = np.unique((h >> np.uint64(40)).astype(np.int64), return_counts=True)
            count[bins] = np.minimum(count[bins].astype(np.int64) + times, 65535)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node), pa.array(np.diff(begins)), pa.array(signatures(h, begins), pa.binary()), pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.int64())], names=names)
            id_type = batch.schema.field("id").type
        often = np.flatnonzero(count >= 4)
        if len(often):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), id_type), pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.binary()), pa.array(often, pa.int64()), pa.array(count[often].astype(np.int64))], names=names)

    names = ["id", "node", "n", "sig", "bin", "times"]
    return docs.mapInArrow(run, f"id {kind.simpleString()}, node long, n long, sig binary, bin long, times long")


def _postings(docs: DataFrame, size: int, percent: int, frequent: list[int]) -> DataFrame:
    """(h, node, m) for the first shingles of each document's set: rare bins first, then frequent ones by their rank.

    m holds the set's size and a salt for frequent bins, as shared_keys takes it. Any other bin has few postings.
    """
    by_bin = np.argsort(np.array(frequent, np.int64), kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((np.array(frequent, np.int64)[by_bin], len(frequent) - by_bin))  # the most frequent has the highest

    def run(batches):
        some = np.zeros(COUNT_BINS, bool)
        some[sent.value[0]] = True

        def rank_of(h):
            out, bins = np.zeros(len(h), np.int32), (h >> np.uint64(40)).astype(np.int64)
            at = np.flatnonzero(some[bins])
            out[at] = sent.value[1][np.searchsorted(sent.value[0], bins[at])]
            return out

        for batch in slices(batches, "text"):
            h, begins, node = _sets([x or "" for x in batch.column("text").to_pylist()], size)
            n = np.diff(begins)
            salt = (node.view(np.uint64) % np.uint64(SALTS)).astype(np.int64) + 1
            once = np.zeros(len(n), bool)  # of copies in a batch one stands for all
            once[np.unique(node, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(n)), n)
            rank = rank_of(h)
            order = np.lexsort((h, rank, owner))
            nth = np.arange(len(h)) - begins[:-1][owner]
            first = nth < key_count(n, percent)[owner]
            first &= once[owner]
            h, rank, owner = h[order][first], rank[order][first], owner[first]
            m = n[owner] << SALT_BITS | np.where(rank > 0, salt[owner], 0)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[owner]), pa.array(m)], names=["h", "node", "m"])

    return docs.select("text").mapInArrow(run, "h long, node long, m long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links), n_links (documents linked with).

    Documents of equal sets are one node from the first pass on. Only a node's own key, never its text, is in the
    candidate search; the texts of nodes that share a first shingle are read once more to compare them. What goes
    to the driver is FREQUENT bin numbers, which set the order only: the result is exact for any order. Sets are
    known by 64-bit hashes. Null and empty texts have no set and are linked with nothing. Rows of one id are one
    document with several texts. Rows with a null id are linked with nothing and their component is null. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    summary = stored(_summary(rows, size), "shingle-summary")
    frequent = [r[0] for r in summary.where("bin is not null").groupBy("bin").agg(F.sum("times").alias("t")).orderBy(F.desc("t"), "bin").limit(FREQUENT).collect()]
    nodes = summary.where("bin is null").select("id", "node", "n")
    known = summary.where("n > 0 and id is not null").groupBy("node", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    classes = stored(known, "shingle-classes")
    with passing(docs.sparkSession, "join-keys") as folder:
        edges = close_edges(_postings(rows.where("id is not null"), size, percent, frequent), classes.select("node", "n", "sig"), folder, percent, by_count=True)
        groups = components(edges).select("node", F.col("root").alias("comp"))
    candidates = stored(groups.join(classes.drop("sig"), "node"), "join-candidates")
    blocks = with_blocks(candidates.select("comp", "node", "n", "copies"))
    reps = candidates.select(F.col("rep").alias("id"), "node")
    texts = wanted(rows.where("id is not null"), reps).join(reps.join(blocks, "node"), "id")

    def sets_of(texts: list[str]) -> list[np.ndarray]:
        h, begins, _ = _sets(texts, size)
        return [h[a:b] for a, b in zip(begins, begins[1:])]

    def own(batches):  # an id may have several texts
        for batch in slices(batches, "text"):
            node = _sets([x or "" for x in batch.column("text").to_pylist()], size)[2]
            yield batch.filter(pa.array(node == batch.column("node").to_numpy(zero_copy_only=False)))

    texts = texts.select("group", "side", "node", "copies", "text").mapInArrow(own, "group string, side int, node long, copies long, text string")
    links = stored(verified(texts, sets_of, percent), "links")
    joined = components(links)
    degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    comp = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = comp.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = comp.join(least, "root").join(degree, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = nodes.join(final, "node", "left")
    own = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))
