"""Joins over time without all pairs of a key: the last row before, and the interval around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored


def asof_join(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: tuple[str, ...], tie: str | None = None) -> DataFrame:
    """left with the values of the last row of right that has its key and is not after it; nulls where there is none.

    Of rows of right at one time the one with the largest tie is last. Rows of both sides are dealt by ranges of key and
    time, so a key that holds a third of all rows lies in many ranges. In a range the last values are carried forward;
    into a range whose first key began before it, one row brings that key's last values of the ranges before: as many rows
    as there are ranges. Rows of left with a null key or time stay, with nulls; those of right are left out. Repeated rows
    stay repeated. right's columns must have other names than left's.
    """
    kept = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull())
    value, order = F.struct(*values), F.col(tie) if tie else F.lit(0)
    r = kept.select(F.col(by).alias("__by"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), order.alias("__tie"), F.lit(0).cast("long").alias("__salt"), value.alias("__value"))
    l = left.select(F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.xxhash64(*left.columns).alias("__salt"), F.struct(*left.columns).alias("__row"))
    both = l.unionByName(r, allowMissingColumns=True)
    place = ("__by", "__at", "__side", "__tie", "__salt")
    placed = stored(both.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__place", F.monotonically_increasing_id()), "asof").withColumn("__range", F.shiftright("__place", 33))

    begins = placed.groupBy("__range").agg(F.min_by("__by", "__place").alias("__by")).where("__by is not null")
    ends = placed.where("__side = 0").join(F.broadcast(begins.select("__by").distinct()), "__by", "left_semi").groupBy("__range", "__by").agg(F.max_by("__value", "__place").alias("__last"))
    asks = begins.withColumn("__asks", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy("__by").orderBy("__range", F.col("__asks").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).where("__asks").select("__range", F.col("__by").alias("__key"), "__carry")

    here = Window.partitionBy("__range", "__by").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("__value", F.last("__value", ignorenulls=True).over(here)).where("__side = 1")
    out = seen.join(F.broadcast(carried), "__range", "left").withColumn("__value", F.coalesce("__value", F.when(F.col("__by") == F.col("__key"), F.col("__carry"))))
    return out.select("__row.*", *[F.col("__value")[c].alias(c) for c in values])


def _number(df: DataFrame, c: str) -> Column:
    return F.unix_micros(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)


#: A key of no more intervals meets its points by the key alone: so many comparisons of a point cost less than its copies for bins.
FEW = 128


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, by: str | None = None, width: float = 86_400e6, few: int = FEW) -> DataFrame:
    """The rows of points with those of intervals that hold their time: start <= at < end, and equal by where it is given.

    An interval belongs to the level whose bins, width * 2 ** level wide, are not shorter than it, and lies in two or three of
    them; so one of years costs no more rows than one of a day. A point asks one bin of each level that occurs: an equi-join by
    key, level and bin, then the exact test. Times are timestamps (width in microseconds) or numbers; a null end
    is open, and reaches over all points. Empty intervals, null starts, times or keys are in no pair. Columns of the two
    tables but by have different names.

    Intervals of a key with few of them are joined by key, and only those of the other keys, with these keys' points, by bins.
    """
    if by is None:
        return _binned_join(intervals, points, start, end, at, by, width)
    many = stored(intervals.where(F.col(by).isNotNull()).groupBy(by).count().where(F.col("count") > few).select(by), "many")
    none = many.isEmpty()
    rows = (intervals if none else intervals.join(many, by, "left_anti")).withColumns({"__s": _number(intervals, start), "__e": _number(intervals, end)})
    inside = (F.col("__t") >= F.col("__s")) & (F.col("__e").isNull() | (F.col("__t") < F.col("__e")))
    plain = points.withColumn("__t", _number(points, at)).join(rows, by).where(inside).drop("__s", "__e", "__t")
    if none:
        return plain
    kept = [x.join(many, by, "left_semi") for x in (intervals, points)]
    return plain.unionByName(_binned_join(*kept, start, end, at, by, width))


def _binned_join(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, by: str | None, width: float) -> DataFrame:
    top = points.agg(F.max(_number(points, at))).scalar()
    s, e = _number(intervals, start), F.coalesce(_number(intervals, end), top + 1)
    length = e - s
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(width)))).cast("int")
    keyed = intervals.withColumns({"__s": s, "__e": e}).where("__s < __e").withColumn("__level", level)
    bins = F.lit(width) * F.pow(F.lit(2.0), F.col("__level"))
    of = F.explode(F.sequence(F.floor(F.col("__s") / bins), F.floor(F.col("__e") / bins)))
    rows = keyed.withColumn("__bin", of)
    levels = sorted(r["__level"] for r in keyed.select("__level").distinct().collect())  # logarithms: some tens
    t = _number(points, at)
    asked = points.withColumn("__t", t).withColumn("__ask", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(t / F.lit(width * 2.0**k)).alias("bin")) for k in levels]) if levels else F.expr("array(struct(-1 AS level, 0L AS bin))")))
    asked = asked.select("*", F.col("__ask.level").alias("__level"), F.col("__ask.bin").alias("__bin")).drop("__ask")
    joined = asked.join(rows, [*([by] if by else []), "__level", "__bin"]).where((F.col("__t") >= F.col("__s")) & (F.col("__t") < F.col("__e")))
    return joined.drop("__s", "__e", "__t", "__level", "__bin")
