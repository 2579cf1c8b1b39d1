"""Observations as a stream: counts per window with late rows dropped, and checks of the expected order of steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHECKED = "run_id string, sequence long, target string, status string"


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Rows per window and key; state of windows older than the watermark is dropped."""
    at = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(at, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def checked_order(stream: DataFrame, expire_ms: int = 30 * 60 * 1000) -> DataFrame:
    """stream (run_id, sequence, target): each row as accepted, repeated or out-of-order against the run's next step.

    State is one number a run; a run without rows for expire_ms is reported expired once and forgotten.
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], due, None, "expired")], columns=["run_id", "sequence", "target", "status"])
            return
        (due,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["sequence", "target"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            status = "accepted" if r.sequence == due else "repeated" if r.sequence < due else "out-of-order"
            due += status == "accepted"
            out.append((key[0], r.sequence, r.target, status))
        state.update((due,))
        state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame(out, columns=["run_id", "sequence", "target", "status"])

    return stream.select("run_id", "sequence", "target").groupBy("run_id").applyInPandasWithState(check, CHECKED, "due long", "append", GroupStateTimeout.ProcessingTimeTimeout)
