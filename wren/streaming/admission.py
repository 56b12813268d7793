"""Sliding-window admission of a request stream in event-time order (T4).

Requests arrive in any order within ``delay``.  Each client keeps the requests
that wait for the watermark and the times of its accepted requests of one window
(at most ``limit``) in a RocksDB state store.  A timer at the earliest waiting request fires
when the watermark has passed it; then all requests up to the watermark are
decided in the order of (time, request id), which no later arrival can change,
as older ones count as late.  A client that waits for nothing gets a timer at
the end of its last window, which removes its state.

Decisions therefore equal the batch form whatever the order of files and rows,
and a request is decided once.  The newest requests stay undecided until the
watermark passes them; ``closing_row`` makes an input's last row that moves it on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that keeps keys on disk and supports timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """State of one client: ``waiting`` requests and the ``accepted`` times of the last window."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_us long, request_id long")
        self.accepted = handle.getValueState("accepted", "times array<long>")

    def _timer(self, t_us: int) -> None:
        self.handle.registerTimer(-(-t_us // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            pdf = pdf[pdf["asks"]]
            new += zip(pdf["t_us"].tolist(), pdf["request_id"].tolist())
        if new:
            self.waiting.appendList(new)
            self._timer(min(new)[0])
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] <= until]
        held = self.accepted.get() if self.accepted.exists() else None
        accepted = deque(held[0] if held else ())
        flags = []
        for t, _ in due:
            while accepted and accepted[0] <= t - self.window_us:
                accepted.popleft()
            flags.append(len(accepted) < self.limit)
            if flags[-1]:
                accepted.append(t)
        rest = waiting[len(due):]
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.accepted.update((list(accepted),))
        if rest:
            self._timer(rest[0][0])
        elif accepted and accepted[-1] + self.window_us > until:
            self._timer(accepted[-1] + self.window_us)
        else:
            self.accepted.clear()
        if due:
            yield pd.DataFrame({"request_id": [i for _, i in due], "client_id": [key[0]] * len(due), "accepted": flags})


def closing_row(requests: DataFrame, ts: str, delay_s: int, window_s: int) -> DataFrame:
    """One row without client and request that moves the watermark past every request and the end of every window."""
    last = requests.agg(F.max(F.col(ts).cast("timestamp")).alias(ts))
    moved = last.filter(F.col(ts).isNotNull()).select(
        *[(F.col(ts) + F.make_dt_interval(secs=F.lit(delay_s + window_s + 1))).cast(f.dataType).alias(ts) if f.name == ts
          else F.lit(None).cast(f.dataType).alias(f.name) for f in requests.schema.fields])
    return moved


def admit_stream(requests: DataFrame, limit: int, window_s: int, delay: str, ts: str = "started_at") -> DataFrame:
    """``request_id, client_id, accepted`` of a stream of ``request_id, client_id`` and event time ``ts``.

    Requests more than ``delay`` behind the newest one are late and get no
    decision, nor do those without a time or an id; those without a client share one.
    """
    timed = requests.select("request_id", "client_id", F.col(ts).cast("timestamp").alias("at")).withWatermark("at", delay)
    # No nulls in the numbers, or pandas would make floats of them; rows that ask for nothing still move the watermark.
    rows = timed.select(
        "client_id", "at", (F.col("request_id").isNotNull() & F.col("at").isNotNull()).alias("asks"),
        F.coalesce("request_id", F.lit(0)).alias("request_id"), F.coalesce(F.unix_micros("at"), F.lit(0)).alias("t_us"))
    client = requests.schema["client_id"].dataType.simpleString()
    return rows.groupBy("client_id").transformWithStateInPandas(
        Admission(limit, window_s * 1_000_000), f"request_id long, client_id {client}, accepted boolean",
        "Append", "EventTime")
