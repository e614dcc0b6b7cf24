"""Interviews that pause too long are closed, by event-time timers over the stream of answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

CLOSED = "session_id long, began_ms long, ended_ms long, n long"


class Pauses(StatefulProcessor):
    """Holds an open interview's first and last time and number of events, and a timer for when its pause is too long."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", StructType([StructField(c, LongType(), False) for c in ("began", "ended", "n")]))

    def _closed(self, key, run) -> tuple:
        return key[0], *run

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = tuple(self.run.get()) if self.run.exists() else None
        out = []
        for at in sorted(t for frame in rows for t in frame["at_ms"].tolist()):
            if run is not None and at - run[1] > self.limit:
                out.append(self._closed(key, run))
                run = None
            run = (at, at, 1) if run is None else (run[0], max(run[1], at), run[2] + 1)
        self.run.update(run)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(run[1] + self.limit + 1)
        yield pd.DataFrame(out, columns=["session_id", "began_ms", "ended_ms", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            out.append(self._closed(key, tuple(self.run.get())))
            self.run.clear()
        yield pd.DataFrame(out, columns=["session_id", "began_ms", "ended_ms", "n"])

    def close(self) -> None:
        pass


def closed(events: DataFrame, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """(session_id, began_ms, ended_ms, n) of interviews that ended: no event for more than `seconds`.

    events: (session_id, ts timestamp). An event after such a pause begins the session's next interview; what paused is closed by that event
    or, without one, by a timer once the watermark, which lags by `delay`, has passed it. State goes with its interview, so what is
    held are open ones only. Events without a session or time, and such as are no later than the watermark, are dropped. Run it inside interview.state_store.
    """
    rows = events.where("session_id is not null and ts is not null").withWatermark("ts", delay).selectExpr("session_id", "ts", "unix_millis(ts) AS at_ms")
    return rows.groupBy("session_id").transformWithStateInPandas(Pauses(int(seconds * 1000)), CLOSED, "Append", "EventTime")
