"""Offer state over time: failures, staleness, freshness, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added by the migration, with the values that rows without them get.
COLUMNS = {"is_active": "int", "retry_count": "int", "last_error": "string", "last_error_at": "timestamp", "last_status_code": "int"}


def migrated(offers: DataFrame) -> DataFrame:
    """offers with all maintenance columns; null is_active becomes 1 and null retry_count 0."""
    for name, kind in COLUMNS.items():
        if name not in offers.columns:
            offers = offers.withColumn(name, F.lit(None).cast(kind))
    return offers.withColumns({"is_active": F.coalesce("is_active", F.lit(1)), "retry_count": F.coalesce("retry_count", F.lit(0))})


def is_stale(least_retries: int = 3) -> Column:
    """Active and failed least_retries times or more, or not found. Below 1 the default holds."""
    n = least_retries if least_retries >= 1 else 3
    return (F.coalesce("is_active", F.lit(1)) == 1) & ((F.coalesce("retry_count", F.lit(0)) >= n) | (F.coalesce("last_status_code", F.lit(0)) == 404))


def mark_stale(offers: DataFrame, least_retries: int = 3) -> DataFrame:
    return offers.withColumn("is_active", F.when(is_stale(least_retries), 0).otherwise(F.col("is_active")))


def failed(offers: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Not found at any time, or with an error in the last days; newest error first, then most retries, then id."""
    at = F.coalesce("last_error_at", "fetched_at")
    recent = (F.coalesce("last_error", F.lit("")) != "") & (at >= now - F.make_dt_interval(F.lit(days)))
    return offers.where(F.coalesce(F.col("last_status_code") == 404, F.lit(False)) | recent).orderBy(at.desc_nulls_last(), F.desc("retry_count"), "offer_id")


def needs_refresh(now: Column, hours: int = 12) -> Column:
    """Retried, with a status, never fetched, or fetched hours ago or longer (all times UTC)."""
    age = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (F.coalesce("retry_count", F.lit(0)) > 0) | (F.coalesce("last_status_code", F.lit(0)) != 0) | F.col("fetched_at").isNull() | (F.col("fetched_at") <= age)


def with_failures(offers: DataFrame, now: Column, error: str = "new_error", code: str = "new_code") -> DataFrame:
    """offers whose error column is not null get one more retry, that error, now as its time, and the code column."""
    bad = F.col(error).isNotNull()
    values = {"retry_count": F.coalesce("retry_count", F.lit(0)) + 1, "last_error": F.col(error), "last_error_at": now, "last_status_code": F.col(code)}
    return offers.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in values.items()}).drop(error, code)


def retry_state(attempts: DataFrame, key: str = "offer_id", at: str = "ts", tie: str = "attempt_id", ok: str = "ok") -> DataFrame:
    """Per key: retry_count (failures since the last success), last_error_at (of these) and fetched_at (last success).

    ok is a boolean column. Two aggregates that are summed up before they are dealt, and a join that Spark can split, so a
    key with very many attempts is in no window; the streaming form of this is in streaming.retries.
    """
    place = F.struct(at, tie)
    good = attempts.groupBy(key).agg(F.max(F.when(F.col(ok), place)).alias("__last"))
    bad = attempts.where(~F.col(ok)).select(key, at, tie).join(good, key).where(F.col("__last").isNull() | (place > F.col("__last")))
    failures = bad.groupBy(key).agg(F.count("*").alias("retry_count"), F.max(at).alias("last_error_at"))
    return good.join(failures, key, "left").select(key, F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "last_error_at", F.col("__last")[at].alias("fetched_at"))


def run_summary(results: DataFrame, status: str = "status") -> DataFrame:
    """One row of counters: inserted, updated, linked, created, skipped, failed and total."""
    names = ("inserted", "updated", "linked", "created", "skipped", "failed")
    return results.agg(*[F.count_if(F.col(status) == n).alias(n) for n in names], F.count("*").alias("total"))


def merged_summary(*summaries: DataFrame) -> DataFrame:
    """One row with the sums of the counters of several runs; a counter that a run lacks, or that is no number, counts 0."""
    names = list(dict.fromkeys(c for s in summaries for c in s.columns))
    every = summaries[0]
    for s in summaries[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c))
    return every.agg(*[F.coalesce(F.sum(number(c)), F.lit(0)).alias(c) for c in names])
