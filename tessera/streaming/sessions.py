"""Windows over event time, idle sessions and their eviction, in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(df: DataFrame, time: str, length: str, *aggs: Column, slide: str | None = None, by: list[str] = (), delay: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows; ``delay`` bounds lateness in a stream."""
    if delay:
        df = df.withWatermark(time, delay)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w, *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[c for c in _names(df, aggs)])


def _names(df: DataFrame, aggs: tuple[Column, ...]) -> list[str]:
    return df.limit(0).agg(*aggs).columns if not df.isStreaming else [a._jc.expr().name() if hasattr(a._jc, "expr") else str(a) for a in aggs]


def session_windows(df: DataFrame, time: str, gap: str, by: list[str], *aggs: Column, delay: str | None = None) -> DataFrame:
    """Sessions that a gap without events ends; events one gap apart are one session."""
    if delay:
        df = df.withWatermark(time, delay)
    w = F.session_window(time, gap)
    return df.groupBy(w, *by).agg(*aggs).withColumn("start", F.col("session_window.start")).withColumn("end", F.col("session_window.end")).drop("session_window")


def idle_at(events: DataFrame, session: str, time: str, now: Column, timeout_seconds: float) -> DataFrame:
    """``(session, last_seen)`` of sessions idle for longer than the timeout."""
    last = events.groupBy(session).agg(F.max(time).alias("last_seen"))
    return last.where((F.unix_micros(now.cast("timestamp")) - F.unix_micros("last_seen")) > int(timeout_seconds * 1_000_000))


def evictions(stream: DataFrame, session: str, time: str, timeout: str, delay: str) -> DataFrame:
    """``(session, first_seen, last_seen, n)`` when event time has passed a session's timeout; one state row per live session."""
    millis = pd.Timedelta(timeout) // pd.Timedelta("1ms")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({session: [key[0]], "first_seen": [pd.Timestamp(first, unit="ms")], "last_seen": [pd.Timestamp(last, unit="ms")], "n": [n]})
            return
        first, last, n = state.get if state.exists else (1 << 62, 0, 0)
        for f in frames:
            t = f[time].astype("datetime64[ms]").astype("int64")
            first, last, n = min(first, int(t.min())), max(last, int(t.max())), n + len(f)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last + millis, state.getCurrentWatermarkMs() + 1))

    kind = stream.schema[session].dataType.simpleString()
    return stream.select(session, time).withWatermark(time, delay).groupBy(session).applyInPandasWithState(
        step, f"`{session}` {kind}, first_seen timestamp, last_seen timestamp, n bigint", "first bigint, last bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limited(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """The first event of each key in every period of ``seconds``, with ``suppressed``: how many others it had."""
    slot = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    rest = [c for c in events.columns if c not in (key, time)]
    least = events.groupBy(key, slot.alias("__s")).agg(F.min(F.struct(time, *rest)).alias("__r"), (F.count("*") - 1).alias("suppressed"))
    return least.select(key, f"__r.{time}", *[F.col(f"__r.{c}").alias(c) for c in rest], "suppressed")
