"""Streams: the batch operators' columns over unbounded tables, with watermarks that bound their state."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import StreamingQueryListener

from tapewright.functions.numbers import strict_double
from tapewright.functions.symbols import normalize_symbol, symbols_of
from tapewright.schemas import RAW_MESSAGES
from tapewright.sources.venues import REJECTS, decode_all, ingest_trades
from tapewright.sources.writers import trade_rows

#: How long a row may be late; state older than that is dropped.
HISTORY = "20 minutes"
#: Seconds of a bucket in which a listing waits for trades.
BUCKET_S = 5
#: Rows of which a task makes lists at a time, and lists that it hands over at a time.
LIST_ROWS, LIST_BATCH = 100_000, 200


def stream_trades(spark: SparkSession, path: str, **options) -> DataFrame:
    """Normalised trades of raw message files as they arrive."""
    return ingest_trades(spark.readStream.schema(RAW_MESSAGES).json(path), **options)


def with_time(rows: DataFrame, column: str = "ts_ms", late: str = HISTORY) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis(column)).withWatermark("ts", late)


def stream_pumps(trades: DataFrame, *, pct: float = 3.0, width: str = "1 second", min_trades: int = 5, late: str = HISTORY) -> DataFrame:
    """Pump windows, each once its watermark has passed (append mode)."""
    px, qty = strict_double(F.col("price")), strict_double(F.col("quantity"))
    windows = with_time(trades, late=late).groupBy("exchange", "market_type", "symbol", F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("trade_count"), F.min(px).alias("start_price"), F.max(px).alias("peak_price"), F.round(F.coalesce(F.sum(qty), F.lit(0.0)), 6).alias("volume")
    )
    change = (F.col("peak_price") - F.col("start_price")) / F.when(F.col("start_price") > 0, F.col("start_price")) * 100
    found = windows.withColumn("price_change", F.round(change, 6)).where((F.col("trade_count") >= min_trades) & (F.col("start_price") > 0) & (change >= pct))
    return found.select("exchange", "market_type", "symbol", F.unix_millis("window.start").alias("start_ms"), "start_price", "peak_price", "price_change", "volume", "trade_count")


def in_lists(rows: DataFrame, keys: Sequence[str], *, time: str, rest: Sequence[str], name: str, at_most: int = LIST_ROWS) -> DataFrame:
    """Rows of a batch in lists: ``name`` has the ``rest`` and ``time`` of the rows of one key, ``time`` is their greatest.

    A task makes the lists of what it reads, without state, of at most ``at_most`` rows at a time; so a key may have several.
    """
    fields = [*rest, time]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_most:
                yield from listed(held)
                held = []
        if held:
            yield from listed(held)

    def listed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by(list(keys), use_threads=False).aggregate([*((c, "list") for c in fields), (time, "max")]).combine_chunks()
        column = lambda c: found[c].combine_chunks()
        parts = [column(f"{c}_list") for c in fields]
        items = pa.ListArray.from_arrays(parts[0].offsets, pa.StructArray.from_arrays([p.values for p in parts], names=fields))
        return pa.Table.from_arrays([*map(column, keys), column(f"{time}_max"), items], names=[*keys, time, name]).to_batches(max_chunksize=LIST_BATCH)

    of = dict(rows.dtypes)
    item = ", ".join(f"{c}: {of[c]}" for c in fields)
    return rows.select(*keys, *fields).mapInArrow(lists, ", ".join([*(f"{c} {of[c]}" for c in (*keys, time)), f"{name} array<struct<{item}>>"]))


def stream_listing_trades(listings: DataFrame, trades: DataFrame, *, pre: str = "20 seconds", post: str = "20 seconds", late: str = HISTORY) -> DataFrame:
    """Interval join of the two streams; both watermarks bound its state, rows come once the interval is complete.

    A listing waits under each symbol it may have, in each of the time buckets that its interval touches, so a trade is kept once and looks at the
    listings near it, not at all of its coin. Those of one batch wait as lists: the join looks lists up, not pairs of a listing and a trade.
    """
    wanted = listings.select("event_id", F.explode(symbols_of(F.col("symbol"))).alias("listed"), "trigger_ms", F.timestamp_millis("trigger_ms").alias("trigger_ts"))
    bucket = lambda t: F.floor(F.unix_seconds(t) / BUCKET_S)
    wanted = wanted.withColumn("near", F.explode(F.sequence(bucket(F.expr(f"trigger_ts - interval {pre}")), bucket(F.expr(f"trigger_ts + interval {post}")))))
    wanted = in_lists(wanted.repartition("listed", "near"), ["listed", "near"], time="trigger_ms", rest=["event_id"], name="waiting")
    wanted = wanted.select("listed", "near", "waiting", F.timestamp_millis("trigger_ms").alias("newest_ts")).withWatermark("newest_ts", late)
    named = with_time(trades, late=late).withColumns({"name": F.upper("symbol"), "bucket": bucket(F.col("ts"))})
    # Of a bucket, listings and trades are as far apart as an interval and a bucket at most; this bounds the state.
    within = F.expr(f"name = listed and bucket = near and ts between newest_ts - interval {pre} - interval {BUCKET_S} seconds and newest_ts + interval {post} + interval {BUCKET_S} seconds")
    pairs = named.join(wanted, within).select(*trades.columns, "ts", F.inline("waiting"))
    trigger = F.timestamp_millis("trigger_ms")
    return pairs.where(F.col("ts").between(trigger - F.expr(f"interval {pre}"), trigger + F.expr(f"interval {post}"))).select(*trades.columns, "event_id", "trigger_ms")


def stream_dedup_notices(notices: DataFrame, *, ttl: str = "24 hours") -> DataFrame:
    """The first sight of each notice id within the time to live."""
    return notices.withColumn("seen_ts", F.timestamp_millis("announced_ms")).withWatermark("seen_ts", ttl).dropDuplicatesWithinWatermark(["id"]).drop("seen_ts")


def stream_rolling_success(calls: DataFrame, *, width: str = "5 minutes", slide: str = "1 minute", late: str = HISTORY) -> DataFrame:
    rate = F.round(F.avg(F.when(F.col("success"), 100.0).otherwise(0.0)), 4)
    out = with_time(calls, late=late).groupBy("node", F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("calls"), rate.alias("success_percent"))
    return out.select("node", F.unix_millis("window.start").alias("start_ms"), F.unix_millis("window.end").alias("end_ms"), "calls", "success_percent")


#: Horizons of the success rate: name, width and slide of the window.
HORIZONS = (("1m", "1 minute", "30 seconds"), ("5m", "5 minutes", "1 minute"), ("1h", "1 hour", "30 minutes"))


def stream_success_horizons(calls: DataFrame, *, horizons: Sequence[tuple[str, str, str]] = HORIZONS, late: str = HISTORY) -> DataFrame:
    """Success rates over the last minute, five minutes and hour, each window once its watermark has passed."""
    parts = [stream_rolling_success(calls, width=width, slide=slide, late=late).withColumn("horizon", F.lit(name)) for name, width, slide in horizons]
    return reduce(DataFrame.unionByName, parts)


class FeedListener(StreamingQueryListener):
    """Counts what streams have read and calls back on each batch; ``ended`` is set when a stream ends.

    ``observed`` adds up the metrics that streams observe, by name (the largest of those whose name begins with ``max_``). ``on_update``
    gets each batch's metrics and ``on_error`` the error that ended a stream.
    """

    def __init__(self, on_progress: Callable[[str, int, int], None] | None = None, *, on_update: Callable[[str, dict], None] | None = None, on_error: Callable[[str, str], None] | None = None) -> None:
        self.observed: dict[str, dict[str, int]] = {}
        self._on_update, self._on_error = on_update, on_error
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.failures: dict[str, str] = {}
        self.ended, self._on_progress = threading.Event(), on_progress

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        key = str(progress.id)
        self.rows[key] = self.rows.get(key, 0) + progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1
        if self._on_progress is not None:
            self._on_progress(key, progress.batchId, progress.numInputRows)
        for name, row in progress.observedMetrics.items():
            seen = {k: v for k, v in row.asDict().items() if v is not None}
            total = self.observed.setdefault(name, {})
            for metric, value in seen.items():
                total[metric] = max(total.get(metric, value), value) if metric.startswith("max_") else total.get(metric, 0) + value
            if self._on_update is not None and seen:
                self._on_update(name, seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[str(event.id)] = str(event.exception)
            if self._on_error is not None:
                self._on_error(str(event.id), str(event.exception))
        self.ended.set()


def stream_venue_status(trades: DataFrame) -> DataFrame:
    """Last trade and count per exchange and market type (update or complete mode)."""
    return trades.groupBy("exchange", "market_type").agg(F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("trades"))


def stream_sink(trades: DataFrame, path: str, checkpoint: str, *, interval: str | None = "1 second", on_batch: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Day-partitioned writes by micro-batch. A batch that is repeated after a failure replaces its own folder, so no trade is stored twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if on_batch is not None:
            batch = batch.persist()  # two readers
        trade_rows(batch).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/batch={batch_id}")
        if on_batch is not None:
            on_batch(batch, batch_id)
            batch.unpersist()

    writer = trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def stream_feed(raw_messages: DataFrame, path: str, checkpoint: str, *, name: str = "feed", interval: str | None = "1 second") -> DataStreamWriter:
    """Messages are decoded once, and trades and rejected messages written in one pass, in folders ``kind=trade`` and ``kind=reject``.

    The same pass observes, under ``name``: trades, rejects by reason, and the longest time from a trade to its arrival. A
    repeated batch replaces its folder.
    """
    rows = decode_all(raw_messages, keep=["received_ms"])
    of = lambda reason: F.count_if(F.col("reject") == reason).alias(reason)
    lag = F.max(F.when(F.col("reject").isNull(), F.col("received_ms") - F.col("ts_ms")))
    rows = rows.observe(name, F.count_if(F.col("reject").isNull()).alias("trades"), lag.alias("max_lag_ms"), *map(of, REJECTS))
    good = F.col("reject").isNull()
    rows = rows.withColumns({"symbol": normalize_symbol(F.col("symbol")), "kind": F.when(good, "trade").otherwise("reject"), "raw": F.when(~good, F.col("raw"))})

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
