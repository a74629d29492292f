"""Consecutive numbers over a whole DataFrame, without bringing its rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with 1, 2, ... by the order columns, which should have no ties.

    Rows are dealt by ranges of the order and counted in each range; only one row of each range meets the others.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(ranged, "numbered").withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = counts.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")
