"""Trades around listings: the interval join and what is read off its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import strict_double
from tapewright.functions.symbols import is_valid_exchange, is_valid_market, match_bases
from tapewright.operators.ranges import trades_in_ranges


def trades_between(trades: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return trades.where(F.col("ts_ms").between(from_ms, to_ms))


def trades_for_target(trades: DataFrame, target: str, *, leading_s: bool = True) -> DataFrame:
    return trades.where(F.array_contains(match_bases(F.col("symbol"), leading_s=leading_s), target))


def valid_trades(trades: DataFrame) -> DataFrame:
    """Trades whose price and quantity are numbers, of known venue and market type."""
    return trades.where(
        strict_double(F.col("price")).isNotNull() & strict_double(F.col("quantity")).isNotNull() & is_valid_exchange(F.col("exchange")) & is_valid_market(F.col("market_type"))
    )


def listing_trades(listings: DataFrame, trades: DataFrame, *, pre_ms: int = 20_000, post_ms: int = 20_000, trigger: Column | None = None, leading_s: bool = True, broadcast: bool | None = None) -> DataFrame:
    """Trades of each listing's coin within [trigger - pre, trigger + post], with event_id and trigger_ms, by ``trades_in_ranges``."""
    at = trigger if trigger is not None else F.col("trigger_ms")
    wanted = listings.select("event_id", F.col("symbol").alias("base"), at.alias("trigger_ms"), (at - pre_ms).alias("from_ms"), (at + post_ms).alias("to_ms"))
    return trades_in_ranges(trades, wanted, span_ms=pre_ms + post_ms, leading_s=leading_s, broadcast=broadcast)


def late_listing_trades(listings: DataFrame, trades: DataFrame, *, delay_ms: int = 960_000, **options) -> DataFrame:
    """The same cut around ``detected_ms`` less a known delay of detection."""
    return listing_trades(listings, trades, trigger=F.col("detected_ms") - delay_ms, **options)


def union_markets(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_hot_cold(recent: DataFrame, history: DataFrame, cut_ms: int) -> DataFrame:
    """Recent rows from the cut on and history before it, no trade twice."""
    both = recent.where(F.col("ts_ms") >= cut_ms).unionByName(history.where(F.col("ts_ms") < cut_ms))
    return both.dropDuplicates(["exchange", "market_type", "trade_id", "ts_ms"])


def collection_stats(found: DataFrame) -> DataFrame:
    """Per event and exchange: spot and futures trades, first and last time, connected."""
    spot, futures = F.count_if(F.col("market_type") == "spot"), F.count_if(F.col("market_type") == "futures")
    return found.groupBy("event_id", "exchange").agg(
        spot.alias("spot_trades"), futures.alias("futures_trades"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), (F.count(F.lit(1)) > 0).alias("connected")
    )


def window_stats(windows: DataFrame) -> DataFrame:
    """``collection_stats`` from the windows of each event's markets."""
    of = lambda kind: F.sum(F.when(F.col("market_type") == kind, F.col("trade_count")).otherwise(0))
    return windows.groupBy("event_id", "exchange").agg(
        of("spot").alias("spot_trades"), of("futures").alias("futures_trades"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), (F.sum("trade_count") > 0).alias("connected")
    )


def distinct_events(listings: DataFrame) -> bool:
    """Whether each listing has an event_id of its own, so that ranges may stand for its rows."""
    return listings.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or event_id is null").isEmpty()


def listing_quality(stats: DataFrame) -> DataFrame:
    """Per event, from ``collection_stats`` rows with data_quality: totals, exchanges with trades, mean quality, seconds collected."""
    got = F.col("spot_trades") + F.col("futures_trades")
    return stats.groupBy("event_id").agg(
        F.sum("spot_trades").alias("spot_trades"),
        F.sum("futures_trades").alias("futures_trades"),
        F.array_join(F.sort_array(F.collect_set(F.when(got > 0, F.col("exchange")))), ",").alias("exchanges"),
        F.round(F.avg("data_quality"), 6).alias("data_quality"),
        ((F.max("last_ms") - F.min("first_ms")) / 1000.0).alias("collection_seconds"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], *, tolerance: int = 10) -> DataFrame:
    """Counts of two stores by key; a difference beyond the tolerance is a mismatch."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_count"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_count"))
    both = a.join(b, keys, "full_outer").na.fill(0, ["left_count", "right_count"])
    return both.withColumn("difference", F.col("left_count") - F.col("right_count")).withColumn("mismatch", F.abs("difference") > tolerance)


def latest_per_market(trades: DataFrame, keys: list[str]) -> DataFrame:
    """First and last trade and time range of each market; ties by trade id."""
    order = F.struct("ts_ms", "trade_id")
    return trades.groupBy(*keys).agg(
        F.max_by("trade_id", order).alias("latest_trade"), F.min_by("trade_id", order).alias("oldest_trade"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n")
    )


def trade_at(trades: DataFrame, ts_ms: int) -> DataFrame:
    return trades.where(F.col("ts_ms") == ts_ms)


def keep_last(rows: DataFrame, n: int, *, key: str, time: str, tie: str) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
