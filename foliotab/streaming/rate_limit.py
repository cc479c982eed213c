"""Fixed-window rate limiting over a stream, anchored at a key's first event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as V
from ..functions.values import micros

_OUTPUT = "key string, event_id bigint, us bigint, window_count bigint, allowed boolean, remaining bigint, reset_us bigint"


class FixedWindow(StatefulProcessor):
    """State per key: start of the open window (microseconds) and events counted in it, and the events that wait for the watermark."""

    def __init__(self, limit: int, window_us: int, expire: bool, in_order: bool = False, ttl_ms: int | None = None):
        self.limit, self.window_us, self.expire, self.in_order, self.ttl_ms = limit, window_us, expire, in_order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, n bigint", self.ttl_ms)
        if self.in_order:
            self.waiting = handle.getListState("waiting", "us bigint, event_id bigint")

    def _decided(self, key, us: np.ndarray, event_id: np.ndarray) -> pd.DataFrame:
        """Decisions on ordered events; the open window is kept."""
        held = self.window.get()
        start, n = held if held is not None else (None, 0)
        at, counts, starts = 0, np.empty(len(us), np.int64), np.empty(len(us), np.int64)
        while at < len(us):
            if start is None or start + self.window_us <= us[at]:
                start, n = int(us[at]), 0
            end = int(np.searchsorted(us, start + self.window_us))
            counts[at:end], starts[at:end] = np.arange(n + 1, n + 1 + end - at), start
            n, at = n + end - at, end
        if start is not None:
            self.window.update((start, n))
            if self.expire:
                self.handle.registerTimer(-(-(start + self.window_us) // 1000))
        return pd.DataFrame({
            "key": key[0], "event_id": event_id, "us": us, "window_count": counts, "allowed": counts <= self.limit,
            "remaining": np.maximum(self.limit - counts, 0), "reset_us": starts + self.window_us,
        })

    def _release(self, key, us: np.ndarray, event_id: np.ndarray, watermark_us: int) -> pd.DataFrame:
        """Decide what the watermark has passed, in order, and keep the rest with a timer for its first event."""
        order = np.lexsort((event_id, us))
        us, event_id = us[order], event_id[order]
        ready = int(np.searchsorted(us, watermark_us, "right"))
        out = self._decided(key, us[:ready], event_id[:ready])
        if ready < len(us):
            self.waiting.put(list(zip(us[ready:].tolist(), event_id[ready:].tolist())))
            self.handle.registerTimer(-(-int(us[ready]) // 1000))
        else:
            self.waiting.clear()
        return out

    def _waiting(self) -> tuple[np.ndarray, np.ndarray]:
        found = list(self.waiting.get()) if self.waiting.exists() else []
        return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A key's rows come in several Arrow batches: order all of the micro-batch, not each.
        parts = list(rows)
        us, event_id = (np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in ("us", "event_id"))
        order = np.lexsort((event_id, us))
        us, event_id = us[order], event_id[order]
        if not self.in_order:
            yield self._decided(key, us, event_id)
            return
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        if us[0] > watermark_us:
            # All wait: what waited before is neither read nor written again, its own timer decides it.
            self.waiting.appendList(list(zip(us.tolist(), event_id.tolist())))
            self.handle.registerTimer(-(-int(us[0]) // 1000))
            return
        earlier = self._waiting()
        yield self._release(key, np.append(earlier[0], us), np.append(earlier[1], event_id), watermark_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Decide the events that the watermark has passed; drop the window once it has passed its end."""
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        if self.in_order:
            us, event_id = self._waiting()
            if len(us):
                yield self._release(key, us, event_id, watermark_us)
        held = self.window.get()
        if held is not None and held[0] + self.window_us <= watermark_us:
            self.window.clear()

    def close(self) -> None:
        pass


def rate_limit_stream(
    events: DataFrame,
    limit: int = V.RATE_LIMIT,
    window_seconds: int = V.RATE_WINDOW_SECONDS,
    watermark: str | None = None,
    in_order: bool = False,
    keep_seconds: int | None = None,
) -> DataFrame:
    """Decision per event of a stream ``key, event_id, ts``.

    Needs the RocksDB state store.  A key's events of one micro-batch are put in order before they
    are decided.  An event of an earlier time that comes in a later batch is decided on arrival, in
    the window open then: every event gets a decision, none is dropped as late.  With a
    ``watermark`` delay, windows that ended before it are removed from the state by event-time
    timers.  With ``in_order`` too, events wait in the state until the watermark passes them and are
    decided in order of time, whatever batches they came in; only an event later than the delay is decided on arrival.
    Without a watermark, ``keep_seconds`` removes the window of a key that has had no event for so long; such a
    stream runs until it is stopped, also with a trigger for what is available now.
    """
    if in_order and not watermark:
        raise ValueError("in_order needs a watermark")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    keyed = timed.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("bigint").alias("event_id"),
                         micros("ts").alias("us"))
    out = keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=FixedWindow(limit, window_seconds * 1_000_000, bool(watermark), in_order,
                                      keep_seconds * 1000 if keep_seconds and not watermark else None),
        outputStructType=_OUTPUT, outputMode="Append",
        timeMode="EventTime" if watermark else "ProcessingTime" if keep_seconds else "None",
    )
    return out.select(
        "key", "event_id", F.timestamp_micros("us").alias("ts"), "window_count", "allowed", "remaining",
        F.timestamp_micros("reset_us").alias("reset_at"),
    )
