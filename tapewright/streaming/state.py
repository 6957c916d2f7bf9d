"""Keyed state with timers and times to live: liveness of feeds, and notices that were processed.

State lies in RocksDB, one entry a key, so it is bounded by the feeds or by the notices of one time to live. ``keyed_state`` gives
a query that store; queries outside it keep the session's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.streaming.streams import HISTORY, with_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def keyed_state(spark: SparkSession, *, idle: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and times to live need.

    ``idle`` batches without input let timers of the engine's clock fire; a run over what is available never ends with
    them, so such runs of ``stream_unseen_notices`` go without.
    """
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _IDLE: str(idle).lower()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class _Liveness(StatefulProcessor):
    """What both clocks share: names of the key and rows of the result."""

    def __init__(self, keys: Sequence[str], silence_ms: int) -> None:
        self.keys, self.silence_ms = list(keys), silence_ms

    def rows(self, key: tuple, found: list[tuple[str, int, int | None]]) -> pd.DataFrame:
        out = pd.DataFrame({name: [value] * len(found) for name, value in zip(self.keys, key, strict=True)})
        out["status"] = [f[0] for f in found]
        out["at_ms"] = pd.array([f[1] for f in found], dtype="Int64")
        out["messages"] = pd.array([f[2] for f in found], dtype="Int64")
        return out

    def close(self) -> None:
        pass


class ArrivalLiveness(_Liveness):
    """By the clock of the engine: a feed is stale once nothing has arrived for so long, whether or not others send."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "last_ms bigint, messages bigint, active boolean, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n = sum(len(frame) for frame in rows)
        old = self.state.get()
        active = old is not None and old[2]
        if active:
            self.handle.deleteTimer(old[3])
        timer = now + self.silence_ms
        self.handle.registerTimer(timer)
        self.state.update((now, n + (old[1] if active else 0), True, timer))
        if not active:
            yield self.rows(key, [("active", now, None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, messages, active, timer = self.state.get()
        if active and expiredTimerInfo.getExpiryTimeInMs() >= timer:
            self.state.update((last, messages, False, timer))
            yield self.rows(key, [("stale", last + self.silence_ms, messages)])


def merged_runs(runs: list[tuple[int, int, int, bool]], times: np.ndarray, silence_ms: int) -> list[tuple[int, int, int, bool]]:
    """Runs (start, end, messages, begun) without silence inside, after more messages at these times."""
    times = np.sort(times)
    cuts = np.flatnonzero(np.diff(times) > silence_ms) + 1
    parts = [(int(p[0]), int(p[-1]), len(p), False) for p in np.split(times, cuts) if len(p)]
    out: list[tuple[int, int, int, bool]] = []
    for start, end, n, begun in sorted([*runs, *parts]):
        if out and start - out[-1][1] <= silence_ms:
            first, last, m, before = out[-1]
            out[-1] = (first, max(last, end), m + n, before or begun)
        else:
            out.append((start, end, n, begun))
    return out


class EventLiveness(_Liveness):
    """By the messages' own times: the watermark is the clock, so the result does not depend on how the input is cut into batches.

    A change is told once the watermark has passed it; until then messages may still fill a gap.
    """

    def __init__(self, keys: Sequence[str], silence_ms: int, time_col: str) -> None:
        super().__init__(keys, silence_ms)
        self.time_col = time_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("runs", "start_ms bigint, end_ms bigint, messages bigint, begun boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.concatenate([frame[self.time_col].to_numpy(np.int64) for frame in rows])
        runs = merged_runs([tuple(r) for r in self.state.get()], times, self.silence_ms)
        yield from self._due(key, runs, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from self._due(key, [tuple(r) for r in self.state.get()], passed)

    def _due(self, key: tuple, runs: list[tuple[int, int, int, bool]], passed: int) -> Iterator[pd.DataFrame]:
        found: list[tuple[str, int, int | None]] = []
        left = []
        for start, end, messages, begun in runs:
            if not begun and start <= passed:
                found.append(("active", start, None))
                begun = True
            if begun and end + self.silence_ms <= passed:
                found.append(("stale", end + self.silence_ms, messages))
            else:
                left.append((start, end, messages, begun))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.state.put(left)
            self.handle.registerTimer(min(end + self.silence_ms if begun else start for start, end, _, begun in left))
        else:
            self.state.clear()
        if found:
            yield self.rows(key, found)


def stream_liveness(messages: DataFrame, *, keys: Sequence[str] = ("exchange",), silence_ms: int = 30_000, clock: str = "arrival", time_col: str = "ts_ms", late: str = HISTORY) -> DataFrame:
    """Changes of each feed: (keys, status, at_ms, messages), ``active`` when it starts or returns, ``stale`` once it has been silent.

    ``messages`` counts those of the period that ends. ``clock`` is "arrival" for live feeds or "event" for the messages' own times.
    """
    rows = messages.where(F.col(time_col).isNotNull()).select(*keys, time_col)
    out = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "status string, at_ms bigint, messages bigint"])
    if clock == "arrival":
        return rows.groupBy(*keys).transformWithStateInPandas(ArrivalLiveness(keys, silence_ms), out, "Append", "ProcessingTime")
    if clock != "event":
        raise ValueError(f"no clock {clock}")
    return with_time(rows, time_col, late).groupBy(*keys).transformWithStateInPandas(EventLiveness(keys, silence_ms, time_col), out, "Append", "EventTime")


class _FirstSight(StatefulProcessor):
    def __init__(self, ttl_ms: int, order: str) -> None:
        self.ttl_ms, self.order = ttl_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "processed_ms bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = not self.seen.exists()
        firsts = [frame.sort_values(self.order, kind="stable").head(1) for frame in rows if new]
        if firsts:
            self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield pd.concat(firsts).sort_values(self.order, kind="stable").head(1)

    def close(self) -> None:
        pass


def stream_unseen_notices(notices: DataFrame, *, ttl_ms: int = 86_400_000, id_col: str = "id", order: str = "announced_ms") -> DataFrame:
    """Each notice when it is first processed, and again once its record is older than the time to live.

    The time to live runs from processing, not from announcement; records outlive a restart with the checkpoint.
    """
    return notices.groupBy(id_col).transformWithStateInPandas(_FirstSight(ttl_ms, order), notices.schema, "Append", "ProcessingTime")


def processed_notices(spark: SparkSession, checkpoint: str, id_col: str = "id") -> DataFrame:
    """(id, processed_ms) of the records that ``stream_unseen_notices`` has kept in its checkpoint."""
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "seen").load()
    return kept.select(F.col(f"key.{id_col}").alias("id"), F.col("value.value.processed_ms").alias("processed_ms"))
