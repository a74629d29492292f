"""Connected components of a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import delete, new_path, stored


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for each node on an edge; root is the least node of its component.

    Large-star and small-star steps in turn until nothing changes. In each a node's least neighbour is an
    aggregate, summed up before the shuffle, and joined back, so a node with very many edges is never in one
    group. Each round is written to the shared folder, and the one before it deleted: its lineage is short and it
    survives lost executors. Edges with a null end or between equal ends are left out. No edges give an empty result.
    """
    spark = edges.sparkSession
    a, b = F.col(u), F.col(v)
    begin = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path, before = new_path(spark, "edges"), None
    now = stored(begin, "round", path)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        after = new_path(spark, "edges")
        now = stored(small.select(F.greatest("x.u", "x.v").alias("u"), F.least("x.u", "x.v").alias("v")).where("u <> v").distinct(), "round", after)
        delete(spark, path)
        path = after
        sign = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first())
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
