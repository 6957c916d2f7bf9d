"""Price pumps in tumbling windows. ``keys`` name what a market is; put event_id among them to analyse many listings in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import floor_window, intensity, relative_seconds, strict_double, time_window_label
from tapewright.functions.symbols import match_bases
from tapewright.operators.ranges import range_pieces
from tapewright.schemas import MARKET_TYPES, VENUES

MARKET = ("exchange", "market_type", "symbol")
EVENT_MARKET = ("event_id", *MARKET)
_WINDOW_TOTALS = {"n": F.sum, "min_price": F.min, "max_price": F.max, "qty": F.sum}


def pump_windows(trades: DataFrame, *, keys: Sequence[str] = MARKET, width_ms: int = 1000) -> DataFrame:
    """Window statistics of each market: all rows count, prices that are no numbers do not."""
    t = trades.select(*keys, floor_window(F.col("ts_ms"), width_ms).alias("start_ms"), strict_double(F.col("price")).alias("px"), strict_double(F.col("quantity")).alias("qty"))
    return t.groupBy(*keys, "start_ms").agg(
        F.count(F.lit(1)).alias("trade_count"), F.min("px").alias("min_price"), F.max("px").alias("max_price"), F.round(F.coalesce(F.sum("qty"), F.lit(0.0)), 6).alias("volume")
    )


def detect_pumps(trades: DataFrame, *, keys: Sequence[str] = MARKET, pct: float = 3.0, width_ms: int = 1000, min_trades: int = 5, market_trades: int | None = None, directional: bool = False) -> DataFrame:
    """Windows whose price range reaches ``pct`` per cent of its low, in markets and windows of enough trades.

    ``directional`` asks for the high after the low. A window with a price of 0 or less is no pump.
    """
    windows = pump_windows(trades, keys=keys, width_ms=width_ms)
    least = min_trades if market_trades is None else market_trades
    if least > min_trades:  # else a window of enough trades makes its market large enough
        enough = windows.groupBy(*keys).agg(F.sum("trade_count").alias("market_count")).where(F.col("market_count") >= least)
        windows = windows.join(enough, list(keys), "left_semi")
    if directional:
        t = trades.select(*keys, floor_window(F.col("ts_ms"), width_ms).alias("start_ms"), strict_double(F.col("price")).alias("px"), "ts_ms").where("px is not null")
        turns = t.groupBy(*keys, "start_ms").agg(F.min_by("ts_ms", F.struct("px", "ts_ms")).alias("low_ms"), F.max_by("ts_ms", F.struct(F.col("px"), -F.col("ts_ms"))).alias("high_ms"))
        windows = windows.join(turns, [*keys, "start_ms"]).where("high_ms > low_ms").drop("high_ms", "low_ms")
    return pumps_in(windows, keys=keys, pct=pct, width_ms=width_ms, min_trades=min_trades)


def pumps_in(windows: DataFrame, *, keys: Sequence[str] = MARKET, pct: float = 3.0, width_ms: int = 1000, min_trades: int = 5) -> DataFrame:
    """Windows of enough trades whose price range reaches ``pct`` per cent of its low."""
    change = (F.col("max_price") - F.col("min_price")) / F.when(F.col("min_price") > 0, F.col("min_price")) * 100
    found = windows.where((F.col("trade_count") >= min_trades) & (F.col("min_price") > 0)).withColumn("change", change).where(F.col("change") >= pct)
    return found.select(
        *keys, "start_ms", (F.col("start_ms") + width_ms).alias("end_ms"), F.lit(width_ms).cast("bigint").alias("duration_ms"), F.col("min_price").alias("start_price"),
        F.col("max_price").alias("peak_price"), F.round("change", 6).alias("price_change"), "volume", "trade_count",
    )


def event_windows(listings: DataFrame, trades: DataFrame, *, pre_ms: int = 20_000, post_ms: int = 20_000, width_ms: int = 1000) -> DataFrame:
    """Window statistics of each listing's markets, as ``pump_windows`` has them of ``listing_trades``, and first and last time.

    No trade is paired with a listing: windows are counted once a market and shared. Listings have an event_id of their own.
    """
    t = F.col("ts_ms")
    ticks = market_ticks(trades).withColumns({"first_ms": t, "last_ms": t})
    totals = _WINDOW_TOTALS | {"first_ms": F.min, "last_ms": F.max}
    pieces = range_pieces(_market_ranges(listings, trades, pre_ms, post_ms, width_ms), ticks, on="symbol", keys=MARKET, totals=totals, width_ms=width_ms)
    return _windows(pieces).select("event_id", "trigger_ms", *MARKET, "start_ms", "trade_count", "min_price", "max_price", "volume", "first_ms", "last_ms")


def event_pumps(listings: DataFrame, ticks: DataFrame, *, symbols: DataFrame | None = None, pre_ms: int = 20_000, post_ms: int = 20_000, width_ms: int = 1000, **rule: float) -> DataFrame:
    """``pumps_in`` of ``event_windows``, from ``market_ticks`` (and ``symbols`` with theirs): a whole window is judged once, not once a listing."""
    shape = lambda rows: pumps_in(_windows(rows), keys=[c for c in rows.columns if c not in ("start_ms", *_WINDOW_TOTALS)], width_ms=width_ms, **rule)
    ranges = _market_ranges(listings, ticks if symbols is None else symbols, pre_ms, post_ms, width_ms)
    found = range_pieces(ranges, ticks, on="symbol", keys=MARKET, totals=_WINDOW_TOTALS, width_ms=width_ms, shape=shape)
    return found.select("event_id", "trigger_ms", *MARKET, "start_ms", "end_ms", "duration_ms", "start_price", "peak_price", "price_change", "volume", "trade_count")


def market_ticks(trades: DataFrame) -> DataFrame:
    """Trades of each market and time: number, least and greatest price, quantity, and notional, in which what is no number counts as 0."""
    # Numbers are a step of their own: each text is read once, however often its number is used.
    t = trades.select(*MARKET, "ts_ms", strict_double(F.col("price")).alias("px"), strict_double(F.col("quantity")).alias("qty"))
    px, qty = F.col("px"), F.col("qty")
    return t.groupBy(*MARKET, "ts_ms").agg(
        F.count(F.lit(1)).alias("n"), F.min(px).alias("min_price"), F.max(px).alias("max_price"), F.sum(qty).alias("qty"), F.sum(F.coalesce(px, F.lit(0.0)) * F.coalesce(qty, F.lit(0.0))).alias("notional")
    )


def _market_ranges(listings: DataFrame, symbols: DataFrame, pre_ms: int, post_ms: int, width_ms: int) -> DataFrame:
    if pre_ms + post_ms < width_ms:
        raise ValueError("a listing's interval must be at least as long as a window")
    names = symbols.select("symbol").distinct().withColumn("base", F.explode(match_bases(F.col("symbol"))))
    return listings.select("event_id", "trigger_ms", F.col("symbol").alias("base")).join(names, "base").select(
        "event_id", "trigger_ms", "symbol", (F.col("trigger_ms") - pre_ms).alias("from_ms"), (F.col("trigger_ms") + post_ms).alias("to_ms")
    )


def _windows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("volume", F.round(F.coalesce("qty", F.lit(0.0)), 6)).withColumnRenamed("n", "trade_count")


def market_results(trades: DataFrame, *, keys: Sequence[str] = MARKET, pct: float = 3.0, width_ms: int = 1000, min_trades: int = 5) -> DataFrame:
    """Markets with pumps: all trades, volume of windows with enough trades, pumps, first and last time."""
    windows = pump_windows(trades, keys=keys, width_ms=width_ms)
    change = (F.col("max_price") - F.col("min_price")) / F.when(F.col("min_price") > 0, F.col("min_price")) * 100
    enough = F.col("trade_count") >= min_trades
    pump = enough & (F.col("min_price") > 0) & (change >= pct)
    times = trades.groupBy(*keys).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    out = windows.groupBy(*keys).agg(
        F.sum("trade_count").alias("total_trades"), F.round(F.sum(F.when(enough, F.col("volume")).otherwise(0.0)), 4).alias("total_volume"), F.count_if(pump).alias("pump_count")
    )
    return out.where((F.col("pump_count") > 0) & (F.col("total_trades") >= min_trades)).join(times, list(keys))


def _rank(order: Sequence[str], column: str) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(len(order) + 1))


def pump_summary(pumps: DataFrame, *, event: str = "event_id") -> DataFrame:
    """Per event: markets with pumps, largest change, first market (ties in the fixed order of venues), span, volume."""
    first = F.struct("start_ms", _rank(VENUES, "exchange"), _rank(MARKET_TYPES, "market_type"))
    market = F.concat_ws("_", "exchange", "market_type")
    return pumps.groupBy(event).agg(
        F.count_distinct(market).alias("markets_with_pumps"), F.count(F.lit(1)).alias("pumps"), F.max("price_change").alias("max_change"), F.min_by(market, first).alias("first_market"),
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.round(F.sum("volume"), 4).alias("total_volume"),
    )


def pump_trades(pumps: DataFrame, trades: DataFrame, *, keys: Sequence[str] = MARKET, width_ms: int = 1000) -> DataFrame:
    """Trades of each pump's window."""
    return trades.withColumn("start_ms", floor_window(F.col("ts_ms"), width_ms)).join(pumps.select(*keys, "start_ms", "price_change"), [*keys, "start_ms"])


def pump_volume_stats(pump_trade_rows: DataFrame, *, keys: Sequence[str] = MARKET) -> DataFrame:
    """Volume, quote volume and volume-weighted price of each pump."""
    px, qty = strict_double(F.col("price"), 0), strict_double(F.col("quantity"), 0)
    sums = pump_trade_rows.groupBy(*keys, "start_ms").agg(F.sum(qty).alias("volume"), F.sum(px * qty).alias("quote_volume"))
    vwap = F.when(F.col("volume") > 0, F.col("quote_volume") / F.when(F.col("volume") > 0, F.col("volume"))).otherwise(0.0)
    return sums.select(*keys, "start_ms", F.round("volume", 4).alias("volume"), F.round("quote_volume", 3).alias("quote_volume"), F.round(vwap, 5).alias("vwap"))


def pump_rollup(pumps: DataFrame) -> DataFrame:
    """Counts and extremes over all pumps, by exchange, by market type and by time label; ``level`` says which.

    ``max_exchange`` is where the largest change was, of equal changes the earliest pump's.
    """
    rows = pumps.withColumn("label", time_window_label(relative_seconds(F.col("start_ms"), F.col("trigger_ms")))).withColumn("strength", intensity(F.col("price_change"), F.lit(1.0))).withColumn("venue", F.col("exchange"))
    sets = rows.groupingSets([[], [F.col("exchange")], [F.col("market_type")], [F.col("label")]], F.col("exchange"), F.col("market_type"), F.col("label"))
    level = F.when(F.grouping("exchange") == 0, "exchange").when(F.grouping("market_type") == 0, "market_type").when(F.grouping("label") == 0, "label").otherwise("all")
    return sets.agg(
        level.alias("level"), F.count(F.lit(1)).alias("pumps"), F.max("price_change").alias("max_change"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"),
        F.round(F.avg("strength"), 4).alias("avg_intensity"), F.round(F.sum("volume"), 4).alias("volume"), F.max_by("venue", F.struct(F.col("price_change"), -F.col("start_ms"), "venue")).alias("max_exchange"),
    )


def pump_metrics(trades: DataFrame, pumps: DataFrame, *, keys: Sequence[str] = MARKET, width_ms: int = 1000) -> DataFrame:
    """Per pump: end price, volume against the market's mean window, trade sizes, buys per sell."""
    px, qty = strict_double(F.col("price")), strict_double(F.col("quantity"), 0)
    t = trades.withColumn("start_ms", floor_window(F.col("ts_ms"), width_ms))
    windows = t.groupBy(*keys, "start_ms").agg(
        F.max_by(px, F.struct("ts_ms", "trade_id")).alias("end_price"), F.sum(qty).alias("v"), F.avg(qty).alias("avg_size"), F.max(qty).alias("max_size"),
        F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"),
    )
    ratio = lambda a, b: F.round(F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0), 5)
    # A row a market: no task gathers a market's windows.
    means = windows.groupBy(*keys).agg(F.avg("v").alias("mean_v"))
    out = windows.join(pumps.select(*keys, "start_ms", "price_change"), [*keys, "start_ms"]).join(means, [*keys])
    return out.select(
        *keys, "start_ms", "price_change", "end_price", ratio(F.col("v"), F.col("mean_v")).alias("volume_spike"), F.round("avg_size", 5).alias("avg_size"), "max_size",
        ratio(F.col("buys").cast("double"), F.col("sells").cast("double")).alias("buy_sell_ratio"),
    )


def block_summary(trades: DataFrame, *, keys: Sequence[str] = ("exchange", "market_type"), width_ms: int = 30_000) -> DataFrame:
    return trades.groupBy(*keys, floor_window(F.col("ts_ms"), width_ms).alias("start_ms")).agg(
        F.count(F.lit(1)).alias("n"), F.min(strict_double(F.col("price"))).alias("min_price"), F.max(strict_double(F.col("price"))).alias("max_price"),
        F.round(F.sum(strict_double(F.col("quantity"))), 4).alias("volume"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"),
    )


def market_first_pump(pumps: DataFrame, *, event: Sequence[str] = ("event_id",)) -> DataFrame:
    """First pump of each exchange, and the order in which exchanges reacted."""
    first = pumps.groupBy(*event, "exchange").agg(F.min("start_ms").alias("first_ms"))
    return first.withColumn("reaction", F.dense_rank().over(Window.partitionBy(*event).orderBy("first_ms")))
