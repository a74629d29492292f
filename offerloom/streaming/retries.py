"""The retry state of each offer over a stream of attempts: failures add up, a success starts anew."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "retry_count int, last_error_at timestamp, fetched_at timestamp"
#: The number of a missing time.
NO_TIME = np.iinfo("int64").min


def retry_states(attempts: DataFrame, key: str = "offer_id", at: str = "ts", tie: str = "attempt_id", ok: str = "ok") -> DataFrame:
    """Update-mode rows (key, retry_count, last_error_at, fetched_at) whenever an offer had attempts.

    State is one small row for each offer. Attempts of a batch are applied by time; those older than what was seen of
    their offer in an earlier batch are applied when they come, as a late report would be. Of an offer's attempts in a batch
    a task holds the failures after the last success that it has met so far, by time and tie alone.
    """

    def step(k, batches, state: GroupState):
        n, failed_at, fetched_at = state.get if state.exists else (0, None, None)
        success, failures = None, []
        for rows in batches:  # plain values: an offer has few attempts in a batch, and pandas takes its time for each call
            good, times = rows[ok].to_numpy().astype(bool).tolist(), rows[at].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for this, fine in zip(zip(times, rows[tie].tolist()), good):
                if success is None or this > success:
                    if fine:
                        success = this
                    else:
                        failures.append(this)
            failures = [f for f in failures if success is None or f > success]
        if success is not None:
            n, failed_at, fetched_at = 0, None, pd.Timestamp(success[0], unit="us")
        known = [t for t, _ in failures if t != NO_TIME]
        n, failed_at = n + len(failures), pd.Timestamp(max(known), unit="us") if known else failed_at
        state.update((n, failed_at, fetched_at))
        yield pd.DataFrame({key: [k[0]], "retry_count": np.array([n], "int32"), "last_error_at": np.array([failed_at], "datetime64[us]"), "fetched_at": np.array([fetched_at], "datetime64[us]")})

    kind = attempts.schema[key].dataType.simpleString()
    out = f"{key} {kind}, retry_count int, last_error_at timestamp, fetched_at timestamp"
    return attempts.select(key, at, tie, ok).groupBy(key).applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout)


def window_failures(attempts: DataFrame, at: str = "ts", ok: str = "ok", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Attempts and failures by tumbling window, with a watermark of late."""
    return attempts.withWatermark(at, late).groupBy(F.window(at, size).alias("w")).agg(F.count("*").alias("attempts"), F.count_if(~F.col(ok)).alias("failures")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "attempts", "failures")
