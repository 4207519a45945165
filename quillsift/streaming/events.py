"""Event streams: limiters and run streams with state per key, and event-time windows.

The windows are extensions that the batch engine has no counterpart of; the
others are the streaming forms of ``quillsift.operators.limits``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillsift.operators.limits import REQUESTS, SECONDS, SlidingWindow
from quillsift.schemas import TERMINAL_EVENTS


def limited(events: DataFrame, key: str = "user_id", capacity: int = REQUESTS, seconds: float = SECONDS) -> DataFrame:
    """A stream of (key, at in seconds, tie) with ``accepted``; a key's state is the accepted times inside the window.

    A key without events for as long as the window has no times left that
    count, so its state is evicted.  Events are ordered within a batch; one
    that comes in a later batch with an earlier time is judged on arrival.
    """

    def step(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [(at, 1) for at in state.get[0]] if state.exists else []
        window = SlidingWindow(capacity, seconds, held)
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
        rows["accepted"] = [window.take(at) for at in rows["at"]]
        state.update(([at for at, _ in window.held],))
        state.setTimeoutDuration(max(1, int(seconds * 1000)))
        yield rows[["key", "at", "tie", "accepted"]]

    kind = events.schema[key].dataType.simpleString()
    keyed = events.select(F.col(key).alias("key"), F.col("at").cast("double").alias("at"), F.col("tie").cast("long").alias("tie"))
    return keyed.groupBy("key").applyInPandasWithState(step, f"key {kind}, at double, tie long, accepted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_stream(events: DataFrame, idle_ms: int = 15_000) -> DataFrame:
    """A stream of (run_id, at, seq, event, data) up to each run's first terminal event, with heartbeats after idle time."""
    schema = "run_id string, at double, seq long, event string, data string"

    def step(group: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if state.exists and not state.get[0]:
                yield pd.DataFrame({"run_id": [group[0]], "at": [None], "seq": [None], "event": ["heartbeat"], "data": ["{}"]}).astype({"at": "float64", "seq": "Int64"})
                state.setTimeoutDuration(idle_ms)
            return
        rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
        if state.exists and state.get[0]:
            return
        ends = rows["event"].isin(TERMINAL_EVENTS).to_numpy()
        over = bool(ends.any())
        yield rows.iloc[: ends.argmax() + 1] if over else rows
        state.update((over,))
        if not over:
            state.setTimeoutDuration(idle_ms)

    return events.groupBy("run_id").applyInPandasWithState(step, schema, "over boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, length: str = "1 hour", late: str | None = None, time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum per window and label; with ``late``, a watermark drops later events (streams)."""
    source = events if late is None else events.withWatermark(time, late)
    grouped = source.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", late: str | None = None, time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """The same over overlapping windows."""
    source = events if late is None else events.withWatermark(time, late)
    grouped = source.groupBy(F.window(time, length, slide).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None, time: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    source = events if late is None else events.withWatermark(time, late)
    grouped = source.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
