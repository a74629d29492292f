"""Sketches of groups that are kept, added to and rolled up: distinct counts (HLL) and quantiles (KLL) without their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HLL of 2 ** 12 registers: 1.6 % standard error. KLL of k = 200: ranks within 1.7 % in 99 of 100.
LG_K, KLL_K = 12, 200


def sketched(rows: DataFrame, by: tuple[str, ...], distinct: str, value: str) -> DataFrame:
    """by, n (rows), distinct_sketch, value_sketch: one row for each group, some KB each.

    Sketches are built in each task before they are dealt, so that a hot group costs no more than others. Null values and
    null distinct keys are in n alone; null group keys are a group.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch"))


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch")]


def combined(by: tuple[str, ...], *tables: DataFrame) -> DataFrame:
    """Sketch tables of several loads as one: what the sketches of all their rows would be, within the same errors."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy(*by).agg(*_merged())


def cubed(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, level, n and sketches of every grouping of by, from a sketch table alone: no row is read again.

    level has a bit for each column of by, the first the highest; where it is set the column is null and stands for all.
    """
    return table.cube(*by).agg(F.grouping_id().cast("int").alias("level"), *_merged())


def distinct_count() -> Column:
    return F.hll_sketch_estimate("distinct_sketch")


def quantile(q: float) -> Column:
    """The value at a rank from 0 to 1; null for a group without values."""
    return F.when(F.kll_sketch_get_n_double("value_sketch") > 0, F.kll_sketch_get_quantile_double("value_sketch", F.lit(q)))
