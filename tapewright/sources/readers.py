"""Readers of stored trades, event archives, announcements and symbol catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.numbers import floor_window, parse_notice_time
from tapewright.operators.ranges import range_pieces
from tapewright.schemas import NOTICES_JSON
from tapewright.sources.writers import ARCHIVE_BLOCK_MS


def _day(ms: int) -> Column:
    return F.to_date(F.timestamp_millis(F.lit(ms)))


def read_trades(spark: SparkSession, path: str, from_ms: int, to_ms: int) -> DataFrame:
    """Trades of a time range; days outside it are not listed, let alone read."""
    return spark.read.parquet(path).where(F.col("dt").between(_day(from_ms), _day(to_ms)) & F.col("ts_ms").between(from_ms, to_ms))


ARCHIVED_EVENTS = "event_id string, event string, base string, trigger_ms bigint, from_ms bigint, to_ms bigint"
ARCHIVED_TRADES = "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint, base string, block bigint"


def read_event_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Archived events with their intervals, and the trades of their coins (``base``), each once; ``event_trades`` joins the two."""
    return spark.read.schema(ARCHIVED_EVENTS).json(f"{path}/events"), spark.read.schema(ARCHIVED_TRADES).json(f"{path}/raw")


def event_trades(events: DataFrame, trades: DataFrame) -> DataFrame:
    """Each archived event's own trades: those of its coin within its interval, of the blocks that it touches."""
    touched = F.sequence(floor_window(F.col("from_ms"), ARCHIVE_BLOCK_MS), floor_window(F.col("to_ms"), ARCHIVE_BLOCK_MS), F.lit(ARCHIVE_BLOCK_MS).cast("bigint"))
    near = events.withColumn("block", F.explode(touched))
    return trades.join(near, ["base", "block"]).where(F.col("ts_ms").between(F.col("from_ms"), F.col("to_ms"))).drop("base", "block", "from_ms", "to_ms")


def archived_counts(events: DataFrame, trades: DataFrame) -> DataFrame:
    """Trades and first time of each event, exchange and market type, without a row for each pair of event and trade."""
    keys = ["base", "exchange", "market_type"]
    ticks = trades.groupBy(*keys, "ts_ms").agg(F.count(F.lit(1)).alias("n")).withColumn("first_ms", F.col("ts_ms"))
    pieces = range_pieces(events.select("event_id", "base", "from_ms", "to_ms"), ticks, on="base", keys=keys, totals={"n": F.sum, "first_ms": F.min})
    return pieces.groupBy("event_id", "exchange", "market_type").agg(F.sum("n").alias("trades"), F.min("first_ms").alias("first_ms"))


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Trades of archives laid out as SYMBOL_yyyyMMdd_HHmmss/raw/exchange/market.json, one JSON list per file."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name = F.input_file_name()
    part = lambda k: F.regexp_extract(name, r"([^/]+_\d{8}_\d{6})/raw/([^/]+)/(spot|futures)\.json$", k)
    return rows.withColumns({"event_key": part(1), "file_exchange": part(2), "file_market_type": part(3)})


def parse_announcements(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """One row per notice of successful responses."""
    parsed = json_rows.select(F.from_json(column, NOTICES_JSON).alias("m"))
    rows = parsed.where("m.success").select(F.explode("m.data.notices").alias("n")).select("n.*")
    at = F.unix_millis(parse_notice_time(F.coalesce("listed_at", "first_listed_at")))
    return rows.select("id", "title", "category", at.alias("announced_ms"), F.coalesce("need_new_badge", F.lit(False)).alias("need_new_badge"), F.coalesce("need_update_badge", F.lit(False)).alias("need_update_badge"))


def parse_home_markets(json_rows: DataFrame, column: str = "value", quote: str = "KRW") -> DataFrame:
    """Bases of the home exchange's markets in one quote currency."""
    rows = json_rows.select(F.explode(F.from_json(column, "array<struct<market:string>>")).alias("m"))
    return rows.where(F.col("m.market").startswith(f"{quote}-")).select(F.regexp_replace("m.market", f"^{quote}-", "").alias("base"))


_I = "symbol:string,status:string,state:string,instId:string,quoteAsset:string,quoteCoin:string,quoteCurrency:string,quote:string,id:string,name:string,trade_status:string,enableTrading:boolean,in_delisting:boolean,type:string"
#: How each venue's instruments are wrapped, which of its fields names the symbol, and what makes it a tradable USDT pair.
INSTRUMENT_RULES = {
    ("binance", "spot"): ("symbols", "symbol", "i.quoteAsset = 'USDT' and i.status = 'TRADING'"),
    ("binance", "futures"): ("symbols", "symbol", "i.quoteAsset = 'USDT' and i.status = 'TRADING'"),
    ("bybit", "spot"): ("result.list", "symbol", "i.quoteCoin = 'USDT' and i.status = 'Trading'"),
    ("bybit", "futures"): ("result.list", "symbol", "i.quoteCoin = 'USDT' and i.status = 'Trading'"),
    ("okx", "spot"): ("data", "instId", "i.instId like '%-USDT' and i.state = 'live'"),
    ("okx", "futures"): ("data", "instId", "i.instId like '%-USDT-SWAP' and i.state = 'live'"),
    ("kucoin", "spot"): ("data", "symbol", "i.quoteCurrency = 'USDT' and i.enableTrading"),
    ("kucoin", "futures"): ("data", "symbol", "i.symbol like '%USDTM' and i.status = 'Open'"),
    ("gate", "spot"): ("", "id", "i.quote = 'USDT' and i.trade_status = 'tradable'"),
    ("gate", "futures"): ("", "name", "i.name like '%\\\\_USDT' and not coalesce(i.in_delisting, false)"),
    ("phemex", "spot"): ("data.products", "symbol", "i.status = 'Listed' and i.type = 'Spot' and i.symbol like '%USDT'"),
    ("phemex", "futures"): ("data.products", "symbol", "i.status = 'Listed' and i.type = 'Perpetual' and i.symbol like '%USD'"),
}


def parse_instruments(json_rows: DataFrame) -> DataFrame:
    """(exchange, market_type, symbol) of tradable pairs from rows (exchange, market_type, value); perpetual USD symbols of phemex are read as USDT."""
    parts = []
    for (venue, kind), (wrap, name, rule) in INSTRUMENT_RULES.items():
        schema = f"array<struct<{_I}>>"
        for key in reversed(wrap.split(".") if wrap else []):
            schema = f"struct<{key}:{schema}>"
        rows = json_rows.where((F.col("exchange") == venue) & (F.col("market_type") == kind)).select("exchange", "market_type", F.from_json("value", schema).alias("m"))
        rows = rows.select("exchange", "market_type", F.explode(f"m.{wrap}" if wrap else "m").alias("i")).where(rule)
        symbol = F.col(f"i.{name}")
        parts.append(rows.select("exchange", "market_type", (F.concat(symbol, F.lit("T")) if (venue, kind) == ("phemex", "futures") else symbol).alias("symbol")))
    return reduce(DataFrame.unionByName, parts)


def parse_symbol_lists(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """(exchange, market_type, symbol) of stored catalogues {exchange: {market type: symbols}}; broken JSON gives nothing."""
    rows = json_rows.select(F.explode(F.from_json(column, "map<string,map<string,array<string>>>")).alias("exchange", "kinds"))
    rows = rows.select("exchange", F.explode("kinds").alias("market_type", "symbols"))
    return rows.select("exchange", "market_type", F.explode("symbols").alias("symbol"))


def read_symbol_lists(spark: SparkSession, lists: dict[str, dict[str, list[str]]]) -> DataFrame:
    """A stored catalogue {exchange: {market type: symbols}} as rows (exchange, market_type, symbol); a small file by nature."""
    rows = [(venue, kind, symbol) for venue, kinds in lists.items() for kind, symbols in kinds.items() for symbol in symbols]
    return spark.createDataFrame(rows, "exchange string, market_type string, symbol string")
