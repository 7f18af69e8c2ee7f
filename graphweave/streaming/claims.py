"""The queue as a stream: state changes come in, the current state and stale claims go out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def states(events: DataFrame, late: str = "1 hour", stale_after: str = "5 minutes") -> DataFrame:
    """(key, state, at, n) whenever a key's state changes; a claim that stays silent is discovered again.

    events has key, state, at. Events later than `late` are dropped; a claim times out by event time.
    State is one small row for each key and lives in the state store.
    """
    wait = int(pd.Timedelta(stale_after).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, at, n = state.get if state.exists else ("", 0, 0)
        if state.hasTimedOut:
            if now == "claimed":
                now, at, n = "discovered", at + wait, n + 1
                state.update((now, at, n))
                yield pd.DataFrame({"key": [key[0]], "state": [now], "at": [pd.Timestamp(at, unit="ms")], "n": [n]})
            return
        for part in parts:
            for s, t in sorted(zip(part["state"], part["at"].astype("datetime64[ms]").astype("int64")), key=lambda x: x[1]):
                n += 1
                if t >= at:
                    now, at = s, int(t)
        state.update((now, at, n))
        if now == "claimed":
            state.setTimeoutTimestamp(max(at + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "state": [now], "at": [pd.Timestamp(at, unit="ms")], "n": [n]})

    kind = events.schema["key"].dataType.simpleString()
    return events.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, f"key {kind}, state string, at timestamp, n long", "state string, at long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, state, n) of state changes in each window; in append mode a window is given once, when it is over."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")
