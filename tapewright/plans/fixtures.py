"""The given tables mapped to the inputs of the operators, once for Spark and once as SQL for DuckDB.

``events`` stands for trades: event types are exchanges, users are markets and symbols, and time offsets are
divided by 10,000 so that 30 days become 259 seconds. Every 200th event is a listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1704067200000
END_MS = START_MS + 259_200
#: Title forms by number of the listing modulo 5; {b} is the base.
TITLES = ("코인({b})(KRW, BTC, USDT 마켓)", "비체인(VET), 코인({b}) (BTC, USDT 마켓)", "썬더코어(TT), 코인({b}) KRW 마켓", "봉크({b}) KRW 마켓", "KRW 마켓 디지털 자산 추가 ({b}, CARV)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp)) - 1704067200000000L")
    return events(spark, sf_dir).select(
        F.expr("case event_type when 'view' then 'binance' when 'click' then 'bybit' when 'purchase' then 'okx' when 'signup' then 'kucoin' else 'gate' end").alias("exchange"),
        F.expr("case when user_id % 2 = 0 then 'spot' else 'futures' end").alias("market_type"),
        F.expr("concat('SYM', cast(user_id % 3 as string), 'USDT')").alias("symbol"),
        F.col("event_id").cast("string").alias("trade_id"),
        F.format_string("%.4f", 100 + F.col("value") / 10).alias("price"),
        F.get_json_object("props", "$.k").alias("quantity"),
        F.expr("case when event_id % 3 = 0 then 'sell' else 'buy' end").alias("side"),
        (F.lit(START_MS) + (micros - F.pmod(micros, F.lit(10_000_000))) / 10_000_000).cast("bigint").alias("ts_ms"),
    )


TRADES_SQL = """t AS (
  SELECT CASE event_type WHEN 'view' THEN 'binance' WHEN 'click' THEN 'bybit' WHEN 'purchase' THEN 'okx' WHEN 'signup' THEN 'kucoin' ELSE 'gate' END AS exchange,
    CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'futures' END AS market_type,
    concat('SYM', CAST(user_id % 3 AS VARCHAR), 'USDT') AS symbol,
    CAST(event_id AS VARCHAR) AS trade_id,
    printf('%.4f', 100 + value / 10) AS price,
    json_extract_string(props, '$.k') AS quantity,
    CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side,
    CAST(1704067200000 + (epoch_us(ts) - 1704067200000000) // 10000000 AS BIGINT) AS ts_ms,
    CAST(printf('%.4f', 100 + value / 10) AS DOUBLE) AS px,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty
  FROM events)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp)) - 1704067200000000L")
    base = F.expr("concat('SYM', cast(user_id % 3 as string))")
    number = ((F.col("event_id") - F.pmod("event_id", F.lit(200))) / 200).cast("bigint")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.pmod(number, F.lit(5)) + 1).cast("int"))
    return events(spark, sf_dir).where("event_id % 200 = 0").select(
        "event_id", base.alias("base"), F.replace(title, F.lit("{b}"), base).alias("title"),
        (F.lit(START_MS) + (micros - F.pmod(micros, F.lit(10_000_000))) / 10_000_000).cast("bigint").alias("trigger_ms"), "user_id", "value",
    )


LISTED_SQL = """listed AS (
  SELECT event_id, concat('SYM', CAST(user_id % 3 AS VARCHAR)) AS base,
    replace(['코인({b})(KRW, BTC, USDT 마켓)', '비체인(VET), 코인({b}) (BTC, USDT 마켓)', '썬더코어(TT), 코인({b}) KRW 마켓', '봉크({b}) KRW 마켓', 'KRW 마켓 디지털 자산 추가 ({b}, CARV)'][(event_id // 200) % 5 + 1],
      '{b}', concat('SYM', CAST(user_id % 3 AS VARCHAR))) AS title,
    CAST(1704067200000 + (epoch_us(ts) - 1704067200000000) // 10000000 AS BIGINT) AS trigger_ms, user_id, value
  FROM events WHERE event_id % 200 = 0)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"), "title", F.col("base").alias("symbol"), F.array(F.lit("KRW")).alias("markets"), F.col("trigger_ms").alias("announced_ms"),
        (F.col("trigger_ms") + F.round(F.col("value") * 10_000, 0).cast("bigint")).alias("detected_ms"), "trigger_ms",
    )


LISTINGS_SQL = """l AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, title, base, trigger_ms, trigger_ms + CAST(round(value * 10000, 0) AS BIGINT) AS detected_ms FROM listed)"""


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select(
        F.col("event_id").alias("id"), "title", F.col("trigger_ms").alias("announced_ms"), (F.col("user_id") % 2 == 0).alias("need_new_badge"), (F.col("user_id") % 2 == 1).alias("need_update_badge")
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select(
        F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("node"), F.col("event_id").alias("id"), F.col("trigger_ms").alias("announced_ms"),
        (F.col("trigger_ms") + F.round(F.col("value") * 10_000, 0).cast("bigint")).alias("detected_ms"), (F.col("trigger_ms") + F.round(F.col("value") * 10_000, 0).cast("bigint")).alias("processed_ms"),
    )


NOTICES_SQL = """n AS (
  SELECT concat('n', CAST(user_id % 4 AS VARCHAR)) AS node, event_id AS id, trigger_ms AS announced_ms, trigger_ms + CAST(round(value * 10000, 0) AS BIGINT) AS detected_ms,
    trigger_ms + CAST(round(value * 10000, 0) AS BIGINT) AS processed_ms FROM listed)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    status = F.expr("case event_id % 10 when 0 then 0 when 1 then 500 when 2 then 408 else 200 end")
    return events(spark, sf_dir).select(
        F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("node"), F.col("event_id").alias("call_id"), ((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("bigint").alias("ts_ms"),
        (F.col("value") * 50).alias("response_ms"), status.alias("status"), (status == 200).alias("success"), (F.col("event_id") % 101).cast("double").alias("cpu"),
        (F.lit(6000) + F.col("event_id") % 2500).cast("bigint").alias("memory_mb"), (F.col("event_id") % 50 == 0).alias("new_listing"),
    )


CALLS_SQL = """c AS (
  SELECT concat('n', CAST(user_id % 4 AS VARCHAR)) AS node, event_id AS call_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, value * 50 AS response_ms,
    CASE event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 408 ELSE 200 END AS status, event_id % 10 > 2 AS success, CAST(event_id % 101 AS DOUBLE) AS cpu,
    CAST(6000 + event_id % 2500 AS BIGINT) AS memory_mb, event_id % 50 = 0 AS new_listing FROM events)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).select("exchange", "market_type", "symbol").distinct()


CATALOGUE_SQL = "cat AS (SELECT DISTINCT exchange, market_type, symbol FROM t)"


def home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home list: the coin of every third user."""
    return trades(spark, sf_dir).where("symbol = 'SYM0USDT'").select(F.lit("SYM0").alias("base")).distinct()


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written the way each venue sends them, and messages that are no trades."""
    t = trades(spark, sf_dir)
    pair = F.regexp_replace("symbol", "USDT$", "-USDT")
    under = F.regexp_replace("symbol", "USDT$", "_USDT")
    text = lambda form, *cols: F.format_string(form, *cols)
    spot = F.col("market_type") == "spot"
    raw = (
        F.when(F.col("exchange") == "binance", text('{"e":"trade","E":1,"s":"%s","t":%s,"p":"%s","q":"%s","T":%d,"m":%s}', "symbol", "trade_id", "price", "quantity", "ts_ms", (F.col("side") == "buy").cast("string")))
        .when(F.col("exchange") == "bybit", text('{"topic":"publicTrade.%s","type":"snapshot","ts":1,"data":[{"i":"%s","s":"%s","p":"%s","v":"%s","S":"%s","T":%d,"BT":false}]}', "symbol", "trade_id", "symbol", "price", "quantity", F.initcap("side"), "ts_ms"))
        .when(F.col("exchange") == "okx", text('{"arg":{"channel":"trades","instId":"%s"},"data":[{"instId":"%s","tradeId":"%s","px":"%s","sz":"%s","side":"%s","ts":"%d"}]}', pair, pair, "trade_id", "price", "quantity", "side", "ts_ms"))
        .when(
            F.col("exchange") == "kucoin",
            text('{"type":"message","topic":"%s%s","subject":"%s","data":{"symbol":"%s","price":"%s","size":"%s","side":"%s","tradeId":"%s","time":"%d000000"}}',
                 F.when(spot, "/market/match:").otherwise("/contractMarket/execution:"), pair, F.when(spot, "trade.l3match").otherwise("match"), pair, "price", "quantity", "side", "trade_id", "ts_ms"),
        )
        .otherwise(text('{"time":1,"channel":"spot.trades","event":"update","result":{"id":%s,"create_time":%d,"create_time_ms":"%d.02","side":"%s","currency_pair":"%s","amount":"%s","contract":"%s","size":"%s","price":"%s"}}',
                        "trade_id", ((F.col("ts_ms") - F.pmod("ts_ms", F.lit(1000))) / 1000).cast("bigint"), "ts_ms", "side", under, "quantity", under, "quantity", "price"))
    )
    good = t.select("exchange", "market_type", raw.alias("raw"), F.col("ts_ms").alias("received_ms"), "trade_id")
    # Every hundredth message comes again as something that is no trade.
    other = F.element_at(F.array(F.lit('{"result":null,"id":1}'), F.lit('{"op":"pong","success":true}'), F.lit("{broken"), F.lit('{"event":"subscribe","channel":"spot.trades","e":"kline","type":"welcome"}')), (F.pmod(F.col("received_ms"), F.lit(4)) + 1).cast("int"))
    bad = good.where(F.col("trade_id").cast("bigint") % 100 == 0).withColumn("raw", other)
    return good.unionByName(bad).drop("trade_id")


def phemex_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of binance as phemex sends them, two to a message with one item that is too short."""
    t = trades(spark, sf_dir).where("exchange = 'binance'")
    item = F.format_string('[%d000000,"%s","%s","%s"]', "ts_ms", F.initcap("side"), "price", "quantity")
    raw = F.format_string('{"symbol":"%s","sequence":%s,"type":"incremental","trades_p":[%s,["1","Buy","2"]]}', "symbol", "trade_id", item)
    return t.select(F.lit("phemex").alias("exchange"), "market_type", raw.alias("raw"), F.col("ts_ms").alias("received_ms"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool metrics: one pool per exchange and market type of the trades."""
    t = trades(spark, sf_dir)
    n = F.count(F.lit(1))
    sells = F.count_if(F.col("side") == "sell")
    return t.groupBy("exchange", "market_type").agg(
        n.alias("messages"), (n - sells).alias("trades"), sells.alias("errors"), F.count_distinct("symbol").alias("active_workers"), F.lit(4).cast("bigint").alias("total_workers"), F.max("ts_ms").alias("last_ms"), F.lit(True).alias("running")
    )


POOLS_SQL = """pools AS (
  SELECT exchange, market_type, count(*) AS messages, count(*) - count(*) FILTER (side = 'sell') AS trades, count(*) FILTER (side = 'sell') AS errors,
    count(DISTINCT symbol) AS active_workers, CAST(4 AS BIGINT) AS total_workers, max(ts_ms) AS last_ms, true AS running FROM t GROUP BY ALL)"""

_MESSAGES = ("connection reset by peer", "Authentication failed for user", "readMessage panic: out of memory", "out of memory", "timeout awaiting", "table does not exist", "something else")


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for every seventh trade."""
    t = trades(spark, sf_dir).withColumn("k", F.col("trade_id").cast("bigint")).where("k % 7 = 0")
    return t.select("exchange", "market_type", "ts_ms", F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.pmod((F.col("k") / 7).cast("bigint"), F.lit(len(_MESSAGES))) + 1).cast("int")).alias("message"))


ERRORS_SQL = """log AS (
  SELECT exchange, market_type, ts_ms, ['connection reset by peer', 'Authentication failed for user', 'readMessage panic: out of memory', 'out of memory', 'timeout awaiting', 'table does not exist', 'something else'][(CAST(trade_id AS BIGINT) // 7) % 7 + 1] AS message
  FROM t WHERE CAST(trade_id AS BIGINT) % 7 = 0)"""


#: Venue by customer modulo 6, and forms of a symbol by customer modulo 7; {b} is the base.
SPELLINGS = ("{b}USDT", "{b}-USDT", "{b}_USDT", "{b}USDC", "S{b}USDT", "{b}EUR", "{b}ETH")


def spelled_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each customer, at a venue and market type and in one of seven forms; every eleventh base is XBT."""
    k = F.col("c_custkey")
    base = F.when(k % 11 == 0, "XBT").otherwise(F.concat(F.lit("K"), k.cast("string")))
    venue = F.element_at(F.array(*[F.lit(v) for v in ("binance", "bybit", "okx", "kucoin", "phemex", "gate")]), (F.pmod(k, F.lit(6)) + 1).cast("int"))
    form = F.element_at(F.array(*[F.lit(f) for f in SPELLINGS]), (F.pmod(k, F.lit(7)) + 1).cast("int"))
    market = F.when(F.floor(k / 6) % 2 == 0, "spot").otherwise("futures")
    return table(spark, sf_dir, "customer").select(k.alias("id"), venue.alias("exchange"), market.alias("market_type"), F.concat(base, F.lit("USDT")).alias("symbol"), F.replace(form, F.lit("{b}"), base).alias("spelled"))


SPELLED_SQL = """sp AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'XBT' ELSE concat('K', CAST(c_custkey AS VARCHAR)) END AS base, ['binance', 'bybit', 'okx', 'kucoin', 'phemex', 'gate'][c_custkey % 6 + 1] AS exchange,
    CASE WHEN c_custkey // 6 % 2 = 0 THEN 'spot' ELSE 'futures' END AS market_type, c_custkey % 7 AS form FROM customer)"""
