"""When offers fall due for a refresh, over a stream of attempts: event-time timers, and state that expires with them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timers_allowed(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB state store; a streaming query that starts within the block gets it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Freshness(StatefulProcessor):
    """State is the last success of a fresh offer, and a timer for the end of its time; an offer that is due has none.

    Groups are many and small, and each call to the state is a message to the JVM: rows are plain values, the timer is
    known from the state, and what stays as it was is not written.
    """

    def __init__(self, span_us: int):
        self.span = span_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fetched", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.state.get()
        before = fetched = kept[0] if kept else None
        # the attempts of one offer in one batch; those without a time are told and change nothing
        attempts = [(r.us, r.attempt_id is None, r.attempt_id, r.ok) for r in rows]
        changes = [(None, "fetched" if ok else "failed") for us, *_, ok in attempts if us is None]
        for us, _, _, ok in sorted((a for a in attempts if a[0] is not None), key=lambda a: a[:3]):
            if fetched is not None and us >= fetched + self.span:
                changes.append((fetched + self.span, "expired"))
                fetched = None
            changes.append((us, "fetched" if ok else "failed"))
            if fetched is None or us >= fetched:
                fetched = us if ok else None
        if fetched != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            if fetched is None:
                self.state.clear()
            else:
                self.state.update((fetched,))
                self.handle.registerTimer(self._ends(fetched))
        for at, change in changes:
            yield Row(key=key[0], at_us=at, change=change)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = self.state.get()[0] + self.span
        self.state.clear()
        yield Row(key=key[0], at_us=end, change="expired")

    def _ends(self, fetched: int) -> int:
        """The timer of a success: the first millisecond at which its time is over."""
        return -(-(fetched + self.span) // 1000)

    def close(self) -> None:
        pass


def freshness_changes(attempts: DataFrame, hours: int = 12, late: str = "1 hour", key: str = "offer_id", at: str = "ts", tie: str = "attempt_id", ok: str = "ok") -> DataFrame:
    """(key, at, change) over a stream of attempts: fetched and failed as they come, and expired where a success is hours
    old without a later attempt.

    An offer is due from a failed or expired change until it is fetched. An expiry is known when the watermark, late behind
    the newest attempt, has passed it, or when a later attempt of the offer comes. State is one number for each fresh
    offer and goes with its timer, so that it is bounded by the offers fetched within hours. Attempts behind the watermark
    are left out; one that is older than the offer's last success is told but changes nothing. Rows with a null key are
    one offer.
    """
    kind = attempts.schema[key].dataType.simpleString()
    rows = attempts.withWatermark(at, late).select(F.col(key).alias("key"), at, F.unix_micros(at).alias("us"), F.col(tie).alias("attempt_id"), F.col(ok).alias("ok"))
    out = rows.groupBy("key").transformWithState(Freshness(hours * 3_600_000_000), f"key {kind}, at_us long, change string", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at_us").alias("at"), "change")


def due_at(changes: DataFrame, now, key: str = "offer_id") -> DataFrame:
    """(key, due) at a time: whether an offer's last change until then left it due; an attempt counts after an expiry of its time."""
    place = F.struct("at", F.when(F.col("change") == "expired", 0).otherwise(1))
    return changes.where(F.col("at") <= now).groupBy(key).agg((F.max_by("change", place) != "fetched").alias("due"))
