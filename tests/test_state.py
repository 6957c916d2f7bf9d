"""Liveness of feeds and processed notices: driven clocks, restarts, times to live."""

import time

import numpy as np
import pandas as pd

from tapewright.operators.announcements import unprocessed
from tapewright.streaming import state as ST


class Clock:
    """Timers and state of one key, driven by hand."""

    def __init__(self, processor):
        self.now, self.value, self.items, self.timers, self.processor = 0, None, [], set(), processor
        processor.init(self)

    getValueState = getListState = lambda self, name, schema, ttl=None: self
    registerTimer = lambda self, ms: self.timers.add(ms)
    deleteTimer = lambda self, ms: self.timers.discard(ms)
    listTimers = lambda self: iter(sorted(self.timers))
    update = lambda self, value: setattr(self, "value", value)
    put = lambda self, items: setattr(self, "items", items)
    clear = lambda self: setattr(self, "items", [])
    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.now

    def get(self):
        return iter(self.items) if self.value is None and self.items else self.value if self.value is not None else iter([]) if isinstance(self.processor, ST.EventLiveness) else None

    def rows(self, *times):
        return self._seen(self.processor.handleInputRows(("binance",), iter([pd.DataFrame({"ts_ms": np.array(times, np.int64)})]), self))

    def to(self, now):
        """Moves the clock and fires what has become due."""
        self.now = now
        out = []
        for timer in sorted(t for t in self.timers if t <= now):
            self.timers.discard(timer)
            out += self._seen(self.processor.handleExpiredTimer(("binance",), self, self))
        return out

    @staticmethod
    def _seen(frames):
        return [tuple(None if pd.isna(v) else v for v in row) for frame in frames for row in frame.itertuples(index=False)]


def test_silence_is_told_once_and_return_again():
    feed = Clock(ST.ArrivalLiveness(["exchange"], 30_000))
    feed.to(1_000)
    assert feed.rows(1, 2) == [("binance", "active", 1_000, None)]
    assert feed.to(20_000) == [] and feed.rows(3) == []
    assert feed.to(31_000) == []  # the first timer went with the second message
    assert feed.to(50_000) == [("binance", "stale", 50_000, 3)]
    assert feed.to(500_000) == []
    assert feed.rows(4) == [("binance", "active", 500_000, None)]
    assert feed.to(530_000) == [("binance", "stale", 530_000, 1)]


def test_periods_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    for _ in range(40):
        times = np.sort(rng.integers(0, 400, 30)) * 10
        want = []
        for run in np.split(times, np.flatnonzero(np.diff(times) > 200) + 1):
            want += [("binance", "active", run[0], None), ("binance", "stale", run[-1] + 200, len(run))]
        feed = Clock(ST.EventLiveness(["exchange"], 200, "ts_ms"))
        # Up to 500 late: each batch is shuffled, and the watermark lies 500 behind the newest.
        late = times + rng.integers(0, 500, len(times))
        order = times[np.argsort(late, kind="stable")]
        got, newest = [], 0
        for part in np.array_split(order, rng.integers(1, 12)):
            got += feed.rows(*part) if len(part) else []
            newest = max([newest, *part])
            got += feed.to(max(feed.now, newest - 500))
        assert got + feed.to(10**6) == want and not feed.timers and not feed.items


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def until(found, n, seconds=60):
    end = time.time() + seconds
    while len(out := found()) < n and time.time() < end:
        time.sleep(0.3)
    return out


def test_live_feed_goes_stale_without_new_input(spark, tmp_path):
    schema = "exchange string, ts_ms bigint"
    write(spark, f"{tmp_path}/in", [("okx", 1), ("okx", 2), ("gate", 1), ("gate", None)], schema)
    with ST.keyed_state(spark):
        changes = ST.stream_liveness(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), silence_ms=4_000)
        query = changes.writeStream.format("memory").queryName("liveness").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        read = lambda: [tuple(r) for r in spark.table("liveness").collect()]
        first = until(read, 4)
        assert sorted((r[0], r[1], r[3]) for r in first) == [("gate", "active", None), ("gate", "stale", 1), ("okx", "active", None), ("okx", "stale", 2)]
        assert all(s[2] - a[2] == 4_000 for v in ("okx", "gate") for a, s in [[r for r in first if r[0] == v]])
        write(spark, f"{tmp_path}/in", [("okx", 9)], schema)
        back = until(read, 6)[4:]
        assert [(r[0], r[1], r[3]) for r in back] == [("okx", "active", None), ("okx", "stale", 1)]
    finally:
        query.stop()


def test_processed_notices_outlive_a_restart_but_not_their_time(spark, tmp_path):
    schema = "id bigint, title string, announced_ms bigint"

    def run(rows):
        write(spark, f"{tmp_path}/in", rows, schema)
        before = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} if (tmp_path / "out").exists() else set()
        with ST.keyed_state(spark, idle=False):
            fresh = ST.stream_unseen_notices(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_ms=18_000)
            fresh.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} - before

    began = time.time()
    assert run([(1, "later", 9), (1, "first", 3), (2, "two", 1)]) == {(1, "first", 3), (2, "two", 1)}
    assert run([(1, "again", 10), (3, "three", 5)]) == ({(3, "three", 5)} if time.time() < began + 17 else {(3, "three", 5), (1, "again", 10)})
    kept = ST.processed_notices(spark, f"{tmp_path}/state")
    assert {1, 2, 3} >= {r["id"] for r in kept.collect()} >= {3}
    given = spark.createDataFrame([(k, "x", 0) for k in range(1, 6)], schema)
    now = round(time.time() * 1000)
    assert {r["id"] for r in unprocessed(given, kept, now, ttl_ms=3_600_000).collect()} == {4, 5}
    assert {r["id"] for r in unprocessed(given, kept, now + 3_600_000, ttl_ms=3_600_000).collect()} == {1, 2, 3, 4, 5}
    time.sleep(max(0.0, began + 40 - time.time()))
    assert run([(2, "much later", 99)]) == {(2, "much later", 99)}
    with ST.keyed_state(spark):
        assert spark.conf.get(ST._PROVIDER).endswith("RocksDBStateStoreProvider")
