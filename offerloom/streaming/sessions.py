"""Sessions of users over event time, with repeated events left out and late ones told apart, and joins of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", at: str = "ts", key: str = "event_id", value: str = "value") -> DataFrame:
    """(user, start, end, n_events, total, last_event) of each session: events of a user that follow within gap; end is gap
    after the last one.

    Events of one key count once within the watermark's time. On a stream a session comes when the watermark, late behind the
    newest event, has passed its end, and is then final; state is the keys and the open sessions of that time. On a table
    all come at once, and every repeated event is left out. Events without a time or user are in no session.
    """
    rows = events.where(F.col(at).isNotNull() & F.col(user).isNotNull()).select(user, at, key, value)
    if events.isStreaming:
        once = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    else:
        once = rows.dropDuplicates([key])
    of = once.groupBy(user, F.session_window(at, gap).alias("w"))
    out = of.agg(F.count("*").alias("n_events"), F.sum(value).alias("total"), F.max_by(key, F.struct(at, key)).alias("last_event"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "total", "last_event")


class LateRows:
    """Rows behind the watermark, which a stateful stream leaves out, written to a side table by batch.

    step goes into foreachBatch of a stream that is cut into batches like the stateful one, none of them empty. A stateful
    stream leaves out what is behind the watermark of the batch before: late behind the newest row of the batches up to
    the last but one, in whole milliseconds. The newest times are kept by batch, so that one that runs again finds the same.
    """

    def __init__(self, root: str, late_ms: int = 3_600_000, at: str = "ts"):
        self.root, self.late_ms, self.at = root, late_ms, at

    def _newest(self, batch: int) -> str:
        return f"{self.root}/newest/batch={batch}"

    def step(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last, before = (spark.read.parquet(self._newest(batch - k)).first().ms if batch >= k else None for k in (1, 2))
        here = rows.agg(F.max(F.unix_millis(self.at))).first()[0]
        newest = max((x for x in (last, here) if x is not None), default=None)
        late = F.lit(False) if before is None else F.coalesce(F.unix_micros(self.at) <= (before - self.late_ms) * 1000, F.lit(False))
        rows.where(late).write.mode("overwrite").parquet(f"{self.root}/late/batch={batch}")
        spark.createDataFrame([(newest,)], "ms long").coalesce(1).write.mode("overwrite").parquet(self._newest(batch))

    def read(self, spark) -> DataFrame:
        """The late rows, each with its batch."""
        return spark.read.option("basePath", f"{self.root}/late").parquet(f"{self.root}/late/batch=*")


def followed_within(first: DataFrame, then: DataFrame, within: str = "1 hour", late: str = "1 hour", by: str = "user_id", at: str = "ts", key: str = "event_id") -> DataFrame:
    """(by, first_id, then_id, first_at, then_at): pairs of a row of first and one of then with equal by, then at the same time
    or up to within after.

    Two streams or two tables. On streams both have a watermark, late behind their newest rows, and the bounds on the
    times let Spark drop a row of first when no row of then can follow any more, and the other way round: state is what came
    within late and within. Rows with a null key or time are in no pair.
    """
    a = first.select(F.col(by), F.col(key).alias("first_id"), F.col(at).alias("first_at"))
    b = then.select(F.col(by).alias("__by"), F.col(key).alias("then_id"), F.col(at).alias("then_at"))
    if first.isStreaming:
        a, b = a.withWatermark("first_at", late), b.withWatermark("then_at", late)
    close = (F.col("then_at") >= F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(by) == F.col("__by")) & close).select(by, "first_id", "then_id", "first_at", "then_at")
