"""Keyed state of streams in typed variables with timers: an alarm that latches, and a gap after what was accepted."""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """While streams with typed state are started: they need a state store on disk, which bounds memory too."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(rows: Iterator[pd.DataFrame]) -> list[tuple[int, int, float]]:
    """Time in microseconds, event and value of all rows in order of time."""
    table = pd.concat(list(rows))
    return sorted(zip(table["ts"].astype("datetime64[us]").astype("int64").tolist(), table["event_id"].tolist(), table["value"].tolist(), strict=True))


class _Timed(StatefulProcessor):
    """State that a timer removes once the stream's own clock is ``idle_ms`` past a key's last event."""

    columns = ""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.columns)

    def _keep(self, state: tuple, last_us: int, clock_ms: int) -> None:
        """Saves the state; of its timers only the newest stands."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(state)
        self.handle.registerTimer(max(last_us // 1000 + self.idle_ms, clock_ms + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Latch(_Timed):
    """M5: tells once when a key's mean, over ``least`` events or more, reaches ``threshold``; that it falls again changes nothing.

    After ``idle_ms`` without an event a key starts anew, by its events' times; the timer only forgets what is over.
    """

    columns = "n long, total double, last long, latched boolean"

    def __init__(self, threshold: float, least: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.threshold, self.least = threshold, least

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total, last, latched = self.state.get() if self.state.exists() else (0, 0.0, None, False)
        told = []
        for at, event, value in _micros(rows):
            if last is not None and at - last > 1000 * self.idle_ms:
                n, total, latched = 0, 0.0, False
            n, total, last = n + 1, total + (value if value == value else 0.0), at if last is None else max(at, last)
            if not latched and n >= self.least and total / n >= self.threshold:
                latched = True
                told.append((key[0], event, n))
        self._keep((n, total, last, latched), last, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(told, columns=["user_id", "event_id", "events"])


class Gap(_Timed):
    """M3: events over ``idle_ms`` after the last accepted one of their key. The state goes once nothing can depend on it."""

    columns = "last long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (last,) = self.state.get() if self.state.exists() else (None,)
        told = []
        for at, event, _ in _micros(rows):
            if last is None or at - last > 1000 * self.idle_ms:
                last = at
                told.append((key[0], event, 1))
        self._keep((last,), last, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(told, columns=["user_id", "event_id", "events"])


def told(events: DataFrame, processor: StatefulProcessor, late: str = "1 hour") -> DataFrame:
    """``user_id, event_id, events`` that the processor tells of each user's events; those later than ``late`` by the clock of the batch before are dropped."""
    rows = events.select("user_id", "event_id", "ts", "value").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, event_id long, events long", "append", "eventTime")
