"""Symbol catalogue: which symbols to subscribe to, in which chunks, and how catalogues change."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.symbols import base_symbol


def subscription_list(catalogue: DataFrame, home: DataFrame) -> DataFrame:
    """Catalogue rows (exchange, market_type, symbol) whose base is not in the home list (base)."""
    # A list of one market's coins: thousands of rows at most.
    return catalogue.withColumn("base", base_symbol(F.col("symbol"))).join(F.broadcast(home.select("base").distinct()), "base", "left_anti").select("exchange", "market_type", "symbol")


def split_even(symbols: DataFrame, n: int, *, keys: tuple[str, ...] = ("exchange", "market_type")) -> DataFrame:
    """Chunks 1..n of near-equal size per market, the remainder going to the first ones."""
    return symbols.withColumn("chunk", F.ntile(n).over(Window.partitionBy(*keys).orderBy("symbol")))


def split_fixed(symbols: DataFrame, size: int, most_chunks: int, *, keys: tuple[str, ...] = ("exchange", "market_type")) -> DataFrame:
    """Chunks of ``size`` symbols from 0; rows beyond the last chunk are left out."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("symbol")) - 1
    return symbols.withColumn("chunk", F.floor(nth / size)).where(F.col("chunk") < most_chunks)


def catalogue_stats(catalogue: DataFrame, subscriptions: DataFrame, home: DataFrame) -> DataFrame:
    """One row: home symbols, and per market type the catalogue's and the subscribed symbols."""
    none = F.lit(None).cast("string")
    rows = home.select(F.lit("home").alias("what"), none.alias("market_type"), "base").unionByName(catalogue.select(F.lit("listed").alias("what"), "market_type", none.alias("base")))
    rows = rows.unionByName(subscriptions.select(F.lit("subscribed").alias("what"), "market_type", none.alias("base")))
    count = lambda what, kind: F.count_if((F.col("what") == what) & (F.col("market_type") == kind)).alias(f"{what}_{kind}")
    return rows.agg(F.count_distinct("base").alias("home_symbols"), *[count(what, kind) for what in ("listed", "subscribed") for kind in ("spot", "futures")])


def new_symbols(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    return today.subtract(yesterday)


def delisted_symbols(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    return yesterday.subtract(today)


def common_symbols(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    return today.intersect(yesterday)


_SYMBOL = ("exchange", "market_type", "symbol")


def validity_intervals(snapshots: DataFrame) -> DataFrame:
    """When symbols were listed, from snapshots (taken_ms, exchange, market_type, symbol): (exchange, market_type, symbol, from_ms, until_ms, listing).

    An interval lasts from the snapshot that first shows a symbol to the next one of its market without it, which is when it ends
    (null: still listed). A symbol that comes back gets another interval, counted by ``listing`` from 1. Days without any snapshot of a market say nothing.
    """
    seen = snapshots.select("taken_ms", *_SYMBOL).where("taken_ms is not null").distinct()
    taken = seen.select("exchange", "market_type", "taken_ms").distinct()
    calendar = Window.partitionBy("exchange", "market_type").orderBy("taken_ms")
    taken = taken.select("*", F.row_number().over(calendar).alias("nth"), F.lead("taken_ms").over(calendar).alias("next_ms"))
    rows = seen.join(taken, ["exchange", "market_type", "taken_ms"])
    # Numbers of snapshots and of sightings run side by side while a symbol stays.
    run = F.col("nth") - F.row_number().over(Window.partitionBy(*_SYMBOL).orderBy("taken_ms"))
    found = rows.withColumn("run", run).groupBy(*_SYMBOL, "run").agg(F.min("taken_ms").alias("from_ms"), F.max_by("next_ms", "taken_ms").alias("until_ms"))
    return found.select(*_SYMBOL, "from_ms", "until_ms", F.row_number().over(Window.partitionBy(*_SYMBOL).orderBy("from_ms")).alias("listing"))


def trades_as_listed(trades: DataFrame, intervals: DataFrame) -> DataFrame:
    """Trades with the listing of their own time: ``listed_ms`` and ``listing``, null where the symbol was not listed then.

    An equi-join on the symbol; a symbol has few intervals, of which one at most holds a trade's time.
    """
    of = intervals.select(*_SYMBOL, F.col("from_ms").alias("listed_ms"), "until_ms", "listing")
    within = (trades["ts_ms"] >= of["listed_ms"]) & (of["until_ms"].isNull() | (trades["ts_ms"] < of["until_ms"]))
    same = reduce(and_, (trades[c] == of[c] for c in _SYMBOL))
    return trades.join(of, same & within, "left").select(*(trades[c] for c in trades.columns), "listed_ms", "listing")
