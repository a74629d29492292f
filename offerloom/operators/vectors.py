"""Nearest neighbours of vectors: cells around k-means centres, probed by cell, and exact scores of what they hold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows and queries that meet in one task at most (about): a block of scores is of this size on each side.
BLOCK = 2048


def _unit(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, of length 1; those of length 0 stay."""
    a = np.array(column.to_pylist(), np.float64)
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


@dataclass
class Index:
    """rows: (id, cell, unit) of every vector; centres: one for each cell."""

    rows: DataFrame
    centres: np.ndarray


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = 50_000, seed: int = 7) -> Index:
    """An index of all vectors that have an id and are not null or empty.

    The centres are fitted on the sample rows with the smallest hash of their id, a bounded part of the table, by k-means
    over unit vectors; every row is then put into the cell of its nearest centre. cells is the square root of the
    number of rows where it is not given, 4096 at most. The centres are broadcast: cells * dimensions numbers.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = stored(rows.select("id", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-300))).alias("unit")), "vectors")
    if cells is None:
        cells = int(min(4096, max(1, rows.count() ** 0.5)))
    some = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(array_to_vector("unit").alias("features"))
    if rows.isEmpty():
        return Index(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(stored(some.withColumn("features", F.col("features")), "vector-sample")).clusterCenters())
    near = _nearest(rows, centres, 1)
    return Index(stored(near.select("id", F.get("cells", 0).alias("cell"), "unit"), "vector-cells"), centres)


def _nearest(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """rows with cells: the n cells whose centres are nearest, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    n = min(n, len(centres))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            a = np.array(batch.column("unit").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            far = (c * c).sum(1) - 2 * (a @ c.T if len(a) else np.empty((0, len(c))))
            cells = np.argsort(far, axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(find, f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, cells array<int>")


def neighbours(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): of each query (id, unit), rows of the index, the k most similar ones by cosine.

    A query meets the rows of its probes nearest cells, all of them; with as many probes as cells the result is exact. Similarities are
    rounded to 6 places, ties go to the smaller id, and a row is no neighbour of itself. The rows of a cell and its queries are dealt in
    blocks, so that a cell with a third of all rows is many tasks, each of block * block scores; each gives its best k of a query.
    """
    asked = _nearest(queries.select("id", "unit"), index.centres, probes).select(F.col("id").alias("query_id"), F.col("unit").alias("query"), F.explode("cells").alias("cell"))
    asked = stored(asked, "vector-queries")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """The number of blocks of each cell: as many rows as there are cells."""
        return df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = blocks(index.rows, "row_blocks").join(blocks(asked, "query_blocks"), "cell")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(F.broadcast(sizes), "cell").select("cell", dealt("id", "row_blocks").alias("rb"), every("query_blocks").alias("qb"), "id", "unit")
    wanted = asked.join(F.broadcast(sizes), "cell").select("cell", dealt("query_id", "query_blocks").alias("qb"), every("row_blocks").alias("rb"), "query_id", "query")

    def score(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if r.empty or q.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        ids = r["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        sims = np.round(np.stack(q["query"]) @ np.stack(r["unit"])[order].T, 6) + 0.0
        ids = ids[order]
        sims[q["query_id"].to_numpy()[:, None] == ids[None, :]] = -2
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(sims, best, 1).ravel()})
        return out[out["similarity"] > -2]

    kind = index.rows.schema["id"].dataType.simpleString()
    group = ["cell", "rb", "qb"]
    scored = rows.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInPandas(score, f"query_id {kind}, id {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
