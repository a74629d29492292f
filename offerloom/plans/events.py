"""Queries over events in time: streams in several batches, against SQL over the whole table.

These mechanisms extend what price comparison needs; the streams read the events in batches of days, in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from ..streaming import due, retries, sessions
from .registry import query
from .views import ATTEMPTS_SQL, STATES_SQL, table

#: Events come in this many batches of as many days each.
BATCHES, DAYS = 4, 8
#: Rows of a file of a batch.
PER_FILE = 250_000


def batch_of(at: str) -> Column:
    """The batch of an event: days 1 to 8 of the month are batch 0."""
    return F.least(F.floor((F.dayofmonth(at) - 1) / DAYS), F.lit(BATCHES - 1))


def in_batches(spark: SparkSession, events: DataFrame, batch, per_file: int = PER_FILE) -> tuple[str, Callable[[], DataFrame]]:
    """A folder of its own, and streams over events whose batches are those of the numbers 0, 1, ... of batch.

    A stream takes so many files at a time, so each batch has as many files as the largest one needs, some of them empty
    where it has few rows.
    """
    root = f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    path, schema = f"{root}/events", events.schema
    largest = events.groupBy(batch.alias("batch")).count().agg(F.max("count")).first()[0] or 1
    n = -(-largest // per_file)
    for k in range(BATCHES + 2):  # one after the other, as streams take files by the time they were written
        rows = events.where(batch == k)
        (rows.repartition(n) if n > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
        while n > 1 and len(spark.read.schema(schema).parquet(path).inputFiles()) < (k + 1) * n:  # partitions without rows leave no file
            events.where("false").coalesce(1).write.mode("append").parquet(path)
    return root, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(path)


def drained(out: DataFrame, root: str, name: str, mode: str = "append") -> DataFrame:
    """What a streaming query gives, batch by batch, until its source is used up."""
    spark = out.sparkSession
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/{name}-state").option("path", f"{root}/{name}").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/{name}")


@query(f"WITH {STATES_SQL} SELECT offer_id, retry_count, last_error_at, fetched_at FROM states")
def retry_state_stream(spark, sf_dir):
    """The offers' retry state from a stream of attempts in batches of days, whose updates are appended to a table by batch."""
    root, stream = in_batches(spark, table(spark, sf_dir, "events"), batch_of("ts"))
    rows = stream().select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("offer_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    retries.retry_states(rows).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    got = spark.read.parquet(f"{root}/rows")
    return got.groupBy("offer_id").agg(F.max_by(F.struct("retry_count", "last_error_at", "fetched_at"), "batch").alias("x")).select("offer_id", F.col("x.retry_count").cast("long").alias("retry_count"), "x.last_error_at", "x.fetched_at")


_END = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM attempts)"


@query(f"""
WITH {ATTEMPTS_SQL}, n AS (SELECT *, lead(ts) OVER (PARTITION BY offer_id ORDER BY ts, attempt_id) AS next FROM attempts)
SELECT offer_id, ts AS at, CASE WHEN ok THEN 'fetched' ELSE 'failed' END AS change FROM n
UNION ALL SELECT offer_id, ts + INTERVAL 12 HOUR, 'expired' FROM n WHERE ok AND (next >= ts + INTERVAL 12 HOUR OR (next IS NULL AND ts + INTERVAL 12 HOUR <= {_END}))""")
def freshness_changes(spark, sf_dir):
    """How offers were fetched, failed and fell due after 12 hours, from a stream of attempts in batches of days."""
    root, stream = in_batches(spark, table(spark, sf_dir, "events"), batch_of("ts"))
    e = stream()
    attempts = e.select(F.col("user_id").alias("offer_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("attempt_id"), (F.col("event_type") != "error").alias("ok"))
    with due.timers_allowed(spark):
        return drained(due.freshness_changes(attempts), root, "changes")


#: Every 50th event comes two batches later, every 20th (one on) twice; late is what then lies behind the watermark.
_ARRIVALS = f"""
a AS (SELECT *, least((day(ts) - 1) // {DAYS}, {BATCHES - 1}) AS batch FROM events),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) AS newest FROM a WHERE event_id % 50 <> 0 GROUP BY batch),
t AS (SELECT a.*, event_id % 50 = 0 AND ts <= date_trunc('millisecond', newest) - INTERVAL 1 HOUR AS late FROM a JOIN m ON a.batch = m.batch)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[str, Callable[[], DataFrame]]:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = F.when(F.pmod("event_id", F.lit(20)) == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    every = e.withColumn("copy", F.explode(twice)).drop("copy")
    return in_batches(spark, every, batch_of("ts") + F.when(F.pmod("event_id", F.lit(50)) == 0, 2).otherwise(0))


@query(f"""
WITH {_ARRIVALS}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM t WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g),
d AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events, round(sum(value), 2) AS total, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY user_id, island)
SELECT * FROM d WHERE "end" <= (SELECT date_trunc('millisecond', max(newest)) - INTERVAL 1 HOUR FROM m)""")
def user_sessions(spark, sf_dir):
    """Sessions of users from a stream in which some events come twice and some too late."""
    root, stream = _arrivals(spark, sf_dir)
    return drained(sessions.sessions(stream()), root, "sessions").withColumn("total", F.round("total", 2))


@query(f"WITH {_ARRIVALS} SELECT event_id, user_id, ts, CAST(batch + 2 AS INTEGER) AS batch FROM t WHERE late")
def late_events(spark, sf_dir):
    """The events that come too late for the sessions, from a side table."""
    root, stream = _arrivals(spark, sf_dir)
    side = sessions.LateRows(f"{root}/side")
    stream().writeStream.foreachBatch(side.step).option("checkpointLocation", f"{root}/side-state").trigger(availableNow=True).start().awaitTermination()
    return side.read(spark).select("event_id", "user_id", "ts", "batch")


@query("SELECT c.user_id, c.event_id AS first_id, p.event_id AS then_id, c.ts AS first_at, p.ts AS then_at FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def click_purchases(spark, sf_dir):
    """Purchases within an hour of a click of the same user, from two streams."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root, stream = in_batches(spark, e, batch_of("ts"))
    clicks, purchases = stream().where("event_type = 'click'"), stream().where("event_type = 'purchase'")
    return drained(sessions.followed_within(clicks, purchases), root, "pairs")
