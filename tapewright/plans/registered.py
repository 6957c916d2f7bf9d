"""All registered queries of the market-listing analytics and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import registry
from tapewright.functions import errors as E
from tapewright.functions import numbers as N
from tapewright.functions import symbols as S
from tapewright.operators import actors as A
from tapewright.operators import announcements as P
from tapewright.operators import catalogue as C
from tapewright.operators import collect as J
from tapewright.operators import monitoring as M
from tapewright.operators import pumps as W
from tapewright.plans import fixtures as X
from tapewright.plans import stored as K
from tapewright.sources import open_messages as O
from tapewright.sources import readers as R
from tapewright.sources import venues as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str = "", *ctes: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _SQL[name] = (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pump events of the mapped trades; few trades fall into a window of the smallest tables, hence two."""
    return W.detect_pumps(X.trades(spark, sf_dir), min_trades=2)


T, LD, L, NT, CL, CAT, PL, LG = X.TRADES_SQL, X.LISTED_SQL, X.LISTINGS_SQL, X.NOTICES_SQL, X.CALLS_SQL, X.CATALOGUE_SQL, X.POOLS_SQL, X.ERRORS_SQL
_WIN = """{name} AS (
  SELECT {keys}, ts_ms // 1000 * 1000 AS start_ms, count(*) AS trade_count, min(px) AS min_price, max(px) AS max_price, round(coalesce(sum(qty), 0), 6) AS volume FROM {src} GROUP BY ALL)"""
_PUMP = """{name} AS (
  SELECT {keys}, start_ms, start_ms + 1000 AS end_ms, CAST(1000 AS BIGINT) AS duration_ms, min_price AS start_price, max_price AS peak_price,
    round((max_price - min_price) / min_price * 100, 6) AS price_change, volume, trade_count
  FROM (SELECT *, sum(trade_count) OVER (PARTITION BY {keys}) AS market_count FROM {src})
  WHERE trade_count >= {least} AND market_count >= {least} AND min_price > 0 AND (max_price - min_price) / min_price * 100 >= 3)"""
_M, _EM = "exchange, market_type, symbol", "event_id, trigger_ms, exchange, market_type, symbol"
WIN = _WIN.format(name="w", keys=_M, src="t")
PUMPS = _PUMP.format(name="p", keys=_M, src="w", least=5)
LT = """lt AS (
  SELECT t.*, l.event_id, l.trigger_ms FROM t JOIN l
    ON (l.base = t.symbol OR l.base = regexp_replace(t.symbol, 'USDT$', '') OR l.base = regexp_replace(regexp_replace(t.symbol, '^S', ''), 'USDT$', '')) AND t.ts_ms BETWEEN l.trigger_ms - 20000 AND l.trigger_ms + 20000)"""
EWIN = _WIN.format(name="ew", keys=_EM, src="lt")
EPUMPS = _PUMP.format(name="ep", keys=_EM, src="ew", least=5)
ACT = """aw AS (
  SELECT lt.*, f.first_pump_ms FROM lt JOIN (SELECT event_id, min(start_ms) AS first_pump_ms FROM ep GROUP BY 1) f USING (event_id) WHERE ts_ms BETWEEN first_pump_ms AND first_pump_ms + 10000),
a AS (
  SELECT event_id, concat('user_', CAST(ts_ms AS VARCHAR)) AS actor_id, ts_ms AS first_ms, arg_min(px, (exchange, market_type, trade_id)) AS start_price, arg_max(px, (exchange, market_type, trade_id)) AS end_price,
    sum(px * qty) AS raw_notional, round(sum(px * qty), 3) AS notional, round(sum(qty), 4) AS quantity, count(*) AS trade_count, min(ts_ms - trigger_ms) AS relative_ms, list_sort(list(DISTINCT exchange)) AS exchanges
  FROM aw GROUP BY event_id, ts_ms)"""
EVENTS = (T, LD, L, LT, EWIN, EPUMPS)
ACTORS = (*EVENTS, ACT)
_EKEYS = ("event_id", "trigger_ms", "exchange", "market_type", "symbol")


def _lt(s: SparkSession, d: str) -> DataFrame:
    return J.listing_trades(X.listings(s, d), X.trades(s, d))


def _windows(s: SparkSession, d: str) -> DataFrame | None:
    """Windows of each listing's markets without its trades; None where listings share an id and their trades must be joined."""
    listings = X.listings(s, d)
    return W.event_windows(listings, X.trades(s, d)) if J.distinct_events(listings) else None


def _ep(s: SparkSession, d: str) -> DataFrame:
    listings, trades = X.listings(s, d), X.trades(s, d)
    return W.event_pumps(listings, W.market_ticks(trades), symbols=trades) if J.distinct_events(listings) else W.detect_pumps(_lt(s, d), keys=_EKEYS)


def _stats(s: SparkSession, d: str) -> DataFrame:
    windows = _windows(s, d)
    return J.collection_stats(_lt(s, d)) if windows is None else J.window_stats(windows)


def _ep_act(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pumps and actors of the listings; both come from one interval join, whose result is written once."""
    found = K.saved(s, _lt(s, d), "listing-trades")
    pumps = K.saved(s, W.detect_pumps(found, keys=_EKEYS), "listing-pumps")
    return pumps, A.actors(A.actor_window_trades(found, pumps))


def _by_event(s: SparkSession, d: str, shared: Callable[[DataFrame, DataFrame], DataFrame], joined: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``shared`` of coins' actors and events' spans of them; ``joined`` of pumps and events' actors where listings share an id."""
    listings = K.saved(s, X.listings(s, d), "listings")
    if not J.distinct_events(listings):
        return joined(*_ep_act(s, d))
    trades = X.trades(s, d)
    first = K.saved(s, A.pump_totals(W.event_pumps(listings, W.market_ticks(trades), symbols=trades)), "pump-totals")
    found = K.saved(s, A.coin_actors(listings, trades), "coin-actors")
    return shared(found, K.saved(s, A.actor_spans(listings, first), "actor-spans"))


def _by_exchange(s: SparkSession, d: str, shared: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], joined: Callable[[DataFrame, DataFrame], DataFrame], *, nth: bool = True) -> DataFrame:
    """``shared`` of pumps' totals, coins' actors by exchange and what events have of these, ``joined`` as above; trades are read once."""
    listings = K.saved(s, X.listings(s, d), "listings")
    if not J.distinct_events(listings):
        return joined(*_ep_act(s, d))
    ticks = K.saved(s, W.market_ticks(X.trades(s, d)), "market-ticks")
    totals = K.saved(s, A.pump_totals(W.event_pumps(listings, ticks)), "pump-totals")
    spans = K.saved(s, A.actor_spans(listings, totals), "actor-spans")
    actors = K.saved(s, A.exchange_ticks(A.coin_totals(listings, ticks), nth=nth), "exchange-actors")
    own = A.event_exchanges(actors, spans)
    return shared(totals, actors, K.saved(s, own, "event-actors") if nth else own)


def _insights(s: SparkSession, d: str) -> DataFrame:
    return _by_exchange(s, d, lambda totals, _, own: A.insights_of(totals, own), A.exchange_insights, nth=False)


# Sources


_DECODED = "exchange, market_type, symbol, trade_id, price, quantity, side, ts_ms"
for _venue in ("binance", "bybit", "okx", "kucoin", "gate"):

    def _decode(s: SparkSession, d: str, venue: str = _venue) -> DataFrame:
        return V.ingest_trades(X.raw_messages(s, d).where(F.col("exchange") == venue), decoders={venue: V.DECODERS[venue]})

    _query(f"s0{1 + ('binance', 'bybit', 'okx', 'kucoin', 'gate').index(_venue)}_decode_{_venue}", f"SELECT {_DECODED} FROM t WHERE exchange = '{_venue}'", T)(_decode)


@_query("s06_decode_phemex", "SELECT 'phemex' AS exchange, market_type, symbol, concat(trade_id, '_', CAST(ts_ms AS VARCHAR), '000000') AS trade_id, price, quantity, side, ts_ms FROM t WHERE exchange = 'binance'", T)
def _(s, d):
    return V.ingest_trades(X.phemex_messages(s, d))


@_query("s07_ingest_trades", f"SELECT {_DECODED} FROM t", T)
def _(s, d):
    return V.ingest_trades(X.raw_messages(s, d))


@_query("s07_rejected_messages", "SELECT exchange, count(*) AS rejected FROM t WHERE CAST(trade_id AS BIGINT) % 100 = 0 GROUP BY 1", T)
def _(s, d):
    return V.rejected_messages(X.raw_messages(s, d)).groupBy("exchange").agg(F.count(F.lit(1)).alias("rejected"))


@_query("s10_read_announcements", "SELECT event_id AS id, title, trigger_ms // [1, 1000, 1000, 60000, 86400000][(event_id // 200) % 5 + 1] * [1, 1000, 1000, 60000, 86400000][(event_id // 200) % 5 + 1] AS announced_ms, user_id % 2 = 0 AS need_new_badge, user_id % 2 = 1 AS need_update_badge FROM listed", T, LD)
def _(s, d):
    at = F.timestamp_millis("announced_ms")
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    listed_at = F.element_at(F.array(*[F.date_format(at, form) for form in forms]), (F.pmod((F.col("id") / 200).cast("bigint"), F.lit(5)) + 1).cast("int"))
    rows = X.announcements(s, d).select("id", "title", listed_at.alias("listed_at"), "need_new_badge", "need_update_badge")
    json = rows.select(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(F.struct(*rows.columns)).alias("notices")).alias("data"))).alias("value"))
    return R.parse_announcements(json).select("id", "title", "announced_ms", "need_new_badge", "need_update_badge")


@_query("s11_home_markets", "SELECT DISTINCT replace(symbol, 'USDT', '') AS base FROM t WHERE symbol <> 'SYM1USDT'", T)
def _(s, d):
    names = X.trades(s, d).select("symbol").distinct().select(F.concat(F.when(F.col("symbol") == "SYM1USDT", "BTC-").otherwise("KRW-"), F.replace("symbol", F.lit("USDT"), F.lit(""))).alias("market"))
    return R.parse_home_markets(names.select(F.to_json(F.array(F.struct("market"))).alias("value")))


@_query("s12_instruments", "SELECT exchange, market_type, CASE exchange WHEN 'okx' THEN replace(symbol, 'USDT', CASE market_type WHEN 'spot' THEN '-USDT' ELSE '-USDT-SWAP' END) WHEN 'kucoin' THEN CASE market_type WHEN 'spot' THEN replace(symbol, 'USDT', '-USDT') ELSE concat(symbol, 'M') END WHEN 'gate' THEN replace(symbol, 'USDT', '_USDT') ELSE symbol END AS symbol FROM cat WHERE symbol <> 'SYM2USDT'", T, CAT)
def _(s, d):
    c = X.catalogue(s, d).withColumn("venue_symbol", S.format_symbol(F.col("symbol"), F.col("exchange"), F.col("market_type"))).withColumn("live", F.col("symbol") != "SYM2USDT")
    word = lambda on, off: F.when(F.col("live"), on).otherwise(off)
    v = F.col("venue_symbol")
    spot = F.col("market_type") == "spot"
    item = (
        F.when(F.col("exchange") == "binance", F.to_json(F.struct(F.array(F.struct(v.alias("symbol"), F.lit("USDT").alias("quoteAsset"), word("TRADING", "BREAK").alias("status"))).alias("symbols"))))
        .when(F.col("exchange") == "bybit", F.to_json(F.struct(F.struct(F.array(F.struct(v.alias("symbol"), F.lit("USDT").alias("quoteCoin"), word("Trading", "Closed").alias("status"))).alias("list")).alias("result"))))
        .when(F.col("exchange") == "okx", F.to_json(F.struct(F.array(F.struct(v.alias("instId"), word("live", "suspend").alias("state"))).alias("data"))))
        .when((F.col("exchange") == "kucoin") & spot, F.to_json(F.struct(F.array(F.struct(v.alias("symbol"), F.lit("USDT").alias("quoteCurrency"), F.col("live").alias("enableTrading"))).alias("data"))))
        .when(F.col("exchange") == "kucoin", F.to_json(F.struct(F.array(F.struct(v.alias("symbol"), word("Open", "Paused").alias("status"))).alias("data"))))
        .when(spot, F.to_json(F.array(F.struct(v.alias("id"), F.lit("USDT").alias("quote"), word("tradable", "untradable").alias("trade_status")))))
        .otherwise(F.to_json(F.array(F.struct(v.alias("name"), (~F.col("live")).alias("in_delisting")))))
    )
    return R.parse_instruments(c.select("exchange", "market_type", item.alias("value")))


@_query("s13_stored_catalogue", "SELECT exchange, market_type, symbol FROM cat", T, CAT)
def _(s, d):
    kinds = X.catalogue(s, d).groupBy("exchange", "market_type").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))
    stored = kinds.groupBy("exchange").agg(F.map_from_entries(F.collect_list(F.struct("market_type", "symbols"))).alias("kinds"))
    return R.parse_symbol_lists(stored.select(F.to_json(F.create_map("exchange", "kinds")).alias("value")))


@_query("x01_analyzer_by_name", "SELECT * FROM p", T, WIN, PUMPS)
def _(s, d):
    registry.register_analyzer("strong pumps", lambda trades, **options: registry.analyze(trades, "pumps", **options))
    try:
        return registry.analyze(X.trades(s, d), "strong pumps", min_trades=5)
    finally:
        del registry.ANALYZERS["strong pumps"]


@_query("x02_decoder_by_name", f"SELECT 'mirror' AS exchange, {_DECODED.removeprefix('exchange, ')} FROM t WHERE exchange = 'okx'", T)
def _(s, d):
    registry.register_decoder("mirror", V.decode_okx)
    try:
        mirrored = X.raw_messages(s, d).where("exchange = 'okx'").withColumn("exchange", F.lit("mirror"))
        return V.ingest_trades(mirrored)
    finally:
        del V.DECODERS["mirror"]


# Functions, applied to whole columns


@_query(
    "f01_f08_symbols",
    """SELECT symbol, upper(replace(replace(symbol, '-', ''), '_', '')) AS normal, regexp_replace(symbol, 'USDT$', '') AS base, 'USDT' AS quote, regexp_replace(symbol, 'USDT$', '') AS base_of_pair,
  length(symbol) BETWEEN 2 AND 10 AS valid, concat_ws(',', symbol, regexp_replace(symbol, 'USDT$', ''), regexp_replace(substr(symbol, 2), 'USDT$', '')) AS names, count(*) AS n FROM t GROUP BY ALL""",
    T,
)
def _(s, d):
    c = F.col("symbol")
    pair = S.base_quote(c)
    return X.trades(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", S.normalize_symbol(c).alias("normal"), S.base_symbol(c).alias("base"), pair["quote"].alias("quote"), pair["base"].alias("base_of_pair"), S.is_valid_symbol(S.clean_symbol(c)).alias("valid"), F.array_join(S.match_bases(c), ",").alias("names"), "n"
    )


@_query("f02_f03_venue_symbols", "SELECT exchange, market_type, symbol, symbol AS back FROM cat WHERE NOT (exchange = 'kucoin' AND market_type = 'futures')", T, CAT)
def _(s, d):
    c = X.catalogue(s, d).where("not (exchange = 'kucoin' and market_type = 'futures')")
    spelled = S.format_symbol(F.col("symbol"), F.col("exchange"), F.col("market_type"))
    return c.select("exchange", "market_type", "symbol", S.normalize_symbol_by_venue(F.col("exchange"), spelled).alias("back"))


@_query(
    "f09_f15_times",
    """SELECT event_id, trigger_ms AS ms, CAST(trunc((detected_ms - trigger_ms - 600000) / 1000.0) AS BIGINT) AS relative_s,
  CASE WHEN trunc((detected_ms - trigger_ms - 600000) / 1000.0) <= -15 THEN 'early' WHEN trunc((detected_ms - trigger_ms - 600000) / 1000.0) <= -10 THEN 'mid' WHEN trunc((detected_ms - trigger_ms - 600000) / 1000.0) <= -5 THEN 'late'
    WHEN trunc((detected_ms - trigger_ms - 600000) / 1000.0) <= 0 THEN 'final' ELSE 'post' END AS label,
  concat(base, '_', strftime(make_timestamp(trigger_ms * 1000), '%Y%m%d_%H%M%S')) AS key, base AS key_symbol, trigger_ms // 1000 * 1000 AS key_ms, strftime(make_timestamp(trigger_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS stamp, trigger_ms AS stamp_ms FROM l""",
    T, LD, L,
)
def _(s, d):
    t = F.col("trigger_ms")
    relative = N.relative_seconds(F.col("detected_ms") - 600_000, t)
    key = N.event_key(F.col("symbol"), t)
    return X.listings(s, d).select(
        "event_id", N.to_millis(t * 1_000_000).alias("ms"), relative.alias("relative_s"), N.time_window_label(relative).alias("label"), key.alias("key"), N.event_key_symbol(key).alias("key_symbol"), N.event_key_ms(key).alias("key_ms"),
        N.format_ts(t).alias("stamp"), N.parse_ts(N.format_ts(t)).alias("stamp_ms"),
    )


@_query(
    "f10_f14_numbers",
    """SELECT trade_id, round(CASE WHEN px = 0 THEN 0 ELSE (qty - px) / px * 100 END, 2) AS change, round(CASE WHEN px = 0 OR qty = 0 THEN 0 ELSE (qty - px) / px * 100 END, 4) AS spread, printf('%.8f', px) AS text,
  round(0.7 * px + 0.3 * qty, 6) AS strength, px >= 103 AS significant FROM t""",
    T,
)
def _(s, d):
    px, qty = N.strict_double(F.col("price")), N.strict_double(F.col("quantity"))
    return X.trades(s, d).select(
        "trade_id", N.pct_change(px, qty).alias("change"), N.spread_pct(px, qty).alias("spread"), N.fmt8(px).alias("text"), F.round(N.intensity(px, qty), 6).alias("strength"), N.is_significant(px - 100, F.lit(1000)).alias("significant")
    )


@_query("f16_error_classes", """SELECT message, CASE WHEN message IN ('Authentication failed for user', 'table does not exist') THEN 'fatal' WHEN message IN ('connection reset by peer', 'timeout awaiting') THEN 'temporary' ELSE 'retryable' END AS db_class,
  CASE WHEN message = 'out of memory' THEN 'fatal' ELSE 'recoverable' END AS severity, count(*) AS n FROM log GROUP BY ALL""", T, LG)
def _(s, d):
    m = F.col("message")
    return X.error_log(s, d).groupBy("message").agg(F.count(F.lit(1)).alias("n")).select("message", E.classify_db_error(m).alias("db_class"), E.classify_feed_error(m).alias("severity"), "n")


# Filters and parsing


@_query("p01_trades_between", f"SELECT {_DECODED} FROM t WHERE ts_ms BETWEEN 1704067240000 AND 1704067280000", T)
def _(s, d):
    return J.trades_between(X.trades(s, d), X.START_MS + 40_000, X.START_MS + 80_000)


@_query("p02_trades_for_target", f"SELECT {_DECODED} FROM t WHERE symbol = 'SYM1USDT'", T)
def _(s, d):
    return J.trades_for_target(X.trades(s, d), "YM1")


@_query("p03_eligible_announcements", "SELECT event_id AS id, title FROM listed WHERE 1704067459200 - trigger_ms <= 100000 AND (user_id % 2 = 0 OR contains(lower(title), 'krw') OR contains(title, '신규 거래지원') OR contains(title, '마켓'))", T, LD)
def _(s, d):
    return P.eligible_announcements(X.announcements(s, d), 1704067459200, longest_ms=100_000).select("id", "title")


@_query("p04_newest_only", "SELECT id, title FROM (SELECT event_id AS id, title, trigger_ms, user_id FROM listed ORDER BY trigger_ms DESC, event_id DESC LIMIT 1) WHERE user_id % 2 = 0 AND 1704067340000 - trigger_ms < 15000", T, LD)
def _(s, d):
    return P.newest_only_announcements(X.announcements(s, d), 1704067340000).select("id", "title")


@_query("p05_listing_titles", "SELECT event_id AS id, contains(title, '디지털 자산 추가') AS is_listing FROM listed", T, LD)
def _(s, d):
    return X.announcements(s, d).select("id", P.is_listing_title(F.col("title")).alias("is_listing"))


_KIND = "(event_id // 200) % 5"


@_query(
    "p06_parse_listings",
    f"""SELECT event_id AS id, base AS symbol, CASE {_KIND} WHEN 0 THEN 'KRW,BTC,USDT' WHEN 1 THEN 'BTC,USDT' ELSE 'KRW' END AS markets, {_KIND} <> 1 AS is_krw,
  CASE {_KIND} WHEN 0 THEN 'multiple_coin_market' WHEN 1 THEN 'multiple_coin_market' WHEN 4 THEN 'coin_list_in_parenthesis' ELSE 'market_outside_parenthesis' END AS pattern FROM listed""",
    T, LD,
)
def _(s, d):
    return P.parse_listings(X.announcements(s, d)).select("id", "symbol", F.array_join("markets", ",").alias("markets"), "is_krw", "pattern")


@_query(
    "p07_parse_listings_multi",
    f"""SELECT id, unnest(symbols) AS symbol, markets FROM (SELECT event_id AS id, CASE {_KIND} WHEN 0 THEN [base] WHEN 1 THEN ['VET', base] WHEN 2 THEN ['TT', base] WHEN 3 THEN [base] ELSE [base, 'CARV'] END AS symbols,
  CASE {_KIND} WHEN 0 THEN 'KRW,BTC,USDT' WHEN 1 THEN 'BTC,USDT' ELSE 'KRW' END AS markets FROM listed)""",
    T, LD,
)
def _(s, d):
    return P.parse_listings_multi(X.announcements(s, d)).select("id", "symbol", F.array_join("markets", ",").alias("markets"))


@_query("p08_listing_events", f"SELECT CAST(event_id AS VARCHAR) AS event_id, base AS symbol, trigger_ms, concat('https://upbit.com/service_center/notice?id=', CAST(event_id AS VARCHAR)) AS notice_url FROM listed WHERE {_KIND} <> 1", T, LD)
def _(s, d):
    return P.listing_events(X.announcements(s, d), 1704067459200).select("event_id", "symbol", "trigger_ms", "notice_url")


@_query("p09_valid_trades", f"SELECT {_DECODED} FROM t WHERE px IS NOT NULL AND qty IS NOT NULL", T)
def _(s, d):
    return J.valid_trades(X.trades(s, d))


@_query("p10_search_trades", f"SELECT {_DECODED} FROM t WHERE symbol LIKE '%M2%' ORDER BY ts_ms DESC, trade_id DESC LIMIT 50", T)
def _(s, d):
    return M.search_trades(X.trades(s, d), "M2", 50)


# Joins


@_query("j01_subscription_list", "SELECT * FROM cat WHERE symbol <> 'SYM0USDT'", T, CAT)
def _(s, d):
    return C.subscription_list(X.catalogue(s, d), X.home(s, d))


@_query("j02_listing_trades", "SELECT event_id, exchange, market_type, symbol, trade_id, ts_ms, trigger_ms FROM lt", T, LD, L, LT)
def _(s, d):
    return _lt(s, d).select("event_id", "exchange", "market_type", "symbol", "trade_id", "ts_ms", "trigger_ms")


@_query("j02_listing_trades_binned", "SELECT event_id, exchange, market_type, symbol, trade_id, ts_ms, trigger_ms FROM lt", T, LD, L, LT)
def _(s, d):
    return J.listing_trades(X.listings(s, d), X.trades(s, d), broadcast=False).select("event_id", "exchange", "market_type", "symbol", "trade_id", "ts_ms", "trigger_ms")


@_query("j03_unprocessed", "SELECT event_id AS id, title FROM listed WHERE event_id NOT IN (SELECT id FROM n WHERE processed_ms > 1704067459200 - 60000 AND id % 3 = 0)", T, LD, NT)
def _(s, d):
    return P.unprocessed(X.announcements(s, d), X.notices(s, d).where("id % 3 = 0"), 1704067459200, ttl_ms=60_000).select("id", "title")


@_query(
    "j04_reconcile",
    """SELECT exchange, market_type, left_count, right_count, left_count - right_count AS difference, abs(left_count - right_count) > 10 AS mismatch
FROM (SELECT exchange, market_type, count(*) AS left_count, count(*) FILTER (CAST(trade_id AS BIGINT) % 50 <> 0) AS right_count FROM t GROUP BY ALL)""",
    T,
)
def _(s, d):
    t = X.trades(s, d)
    return J.reconcile(t, t.where("cast(trade_id as bigint) % 50 <> 0"), ["exchange", "market_type"])


@_query("j05_actor_window_trades", "SELECT event_id, exchange, trade_id, ts_ms, first_pump_ms FROM aw", *ACTORS)
def _(s, d):
    windows = _windows(s, d)
    if windows is None:
        found = K.saved(s, _lt(s, d), "listing-trades")
        rows = A.actor_window_trades(found, W.detect_pumps(found, keys=_EKEYS))
    else:
        pumps = K.saved(s, W.pumps_in(windows, keys=_EKEYS), "listing-pumps")
        first = pumps.groupBy("event_id").agg(F.min("start_ms").alias("first_pump_ms"))
        spans = K.saved(s, A.actor_spans(X.listings(s, d), pumps).join(first, "event_id"), "actor-spans")
        rows = A.span_trades(X.trades(s, d), spans)
    return rows.select("event_id", "exchange", "trade_id", "ts_ms", "first_pump_ms")


@_query("j06_pump_trades", "SELECT t.exchange, t.market_type, t.symbol, t.trade_id, p.start_ms, p.price_change FROM t JOIN p ON t.exchange = p.exchange AND t.market_type = p.market_type AND t.symbol = p.symbol AND t.ts_ms // 1000 * 1000 = p.start_ms", T, WIN, PUMPS)
def _(s, d):
    t = X.trades(s, d)
    return W.pump_trades(W.detect_pumps(t), t).select("exchange", "market_type", "symbol", "trade_id", "start_ms", "price_change")


@_query("j07_late_listing_trades", "SELECT l.event_id, t.trade_id, t.ts_ms FROM t JOIN l ON (l.base = regexp_replace(t.symbol, 'USDT$', '')) AND t.ts_ms BETWEEN l.detected_ms - 220000 AND l.detected_ms - 180000", T, LD, L)
def _(s, d):
    return J.late_listing_trades(X.listings(s, d), X.trades(s, d), delay_ms=200_000).select("event_id", "trade_id", "ts_ms")


# Aggregations


@_query("a01_pump_windows", "SELECT * FROM w", T, WIN)
def _(s, d):
    return W.pump_windows(X.trades(s, d))


@_query("a02_detect_pumps", "SELECT * FROM p", T, WIN, PUMPS)
def _(s, d):
    return W.detect_pumps(X.trades(s, d))


@_query("a02_detect_pumps_of_listings", "SELECT * FROM ep", *EVENTS)
def _(s, d):
    return _ep(s, d)


@_query(
    "a02_detect_pumps_directional",
    """SELECT p.* FROM p JOIN (SELECT exchange, market_type, symbol, ts_ms // 1000 * 1000 AS start_ms, arg_min(ts_ms, (px, ts_ms)) AS low_ms, arg_max(ts_ms, (px, -ts_ms)) AS high_ms FROM t GROUP BY ALL) o
  USING (exchange, market_type, symbol, start_ms) WHERE high_ms > low_ms""",
    T, WIN, PUMPS,
)
def _(s, d):
    return W.detect_pumps(X.trades(s, d), directional=True)


@_query(
    "a03_market_results",
    """SELECT exchange, market_type, symbol, CAST(sum(trade_count) AS BIGINT) AS total_trades, round(sum(CASE WHEN trade_count >= 5 THEN volume ELSE 0 END), 4) AS total_volume,
  count(*) FILTER (trade_count >= 5 AND min_price > 0 AND (max_price - min_price) / min_price * 100 >= 3) AS pump_count, any_value(first_ms) AS first_ms, any_value(last_ms) AS last_ms
FROM w JOIN (SELECT exchange, market_type, symbol, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM t GROUP BY ALL) USING (exchange, market_type, symbol) GROUP BY ALL HAVING pump_count > 0 AND total_trades >= 5""",
    T, WIN,
)
def _(s, d):
    return W.market_results(X.trades(s, d))


_ORDER = "list_position(['binance', 'bybit', 'okx', 'kucoin', 'phemex', 'gate'], exchange), list_position(['spot', 'futures'], market_type)"


@_query(
    "a04_pump_summary",
    f"""SELECT event_id, count(DISTINCT concat(exchange, '_', market_type)) AS markets_with_pumps, count(*) AS pumps, max(price_change) AS max_change, arg_min(concat(exchange, '_', market_type), (start_ms, {_ORDER})) AS first_market,
  max(end_ms) - min(start_ms) AS duration_ms, round(sum(volume), 4) AS total_volume FROM ep GROUP BY 1""",
    *EVENTS,
)
def _(s, d):
    return W.pump_summary(_ep(s, d))


@_query(
    "a05_actors",
    """SELECT event_id, actor_id, first_ms, first_ms AS last_ms, CAST(0 AS BIGINT) AS duration_ms, start_price, end_price, round(CASE WHEN quantity > 0 THEN raw_notional / quantity ELSE 0 END, 4) AS vwap, notional, quantity, trade_count, relative_ms, markets
FROM a JOIN (SELECT event_id, ts_ms AS first_ms, string_agg(concat(m, ':', CAST(c AS VARCHAR)), ',' ORDER BY m) AS markets FROM (SELECT event_id, ts_ms, concat(exchange, '_', market_type) AS m, count(*) AS c FROM aw GROUP BY ALL) GROUP BY 1, 2) USING (event_id, first_ms)""",
    *ACTORS,
)
def _(s, d):
    text = F.array_join(F.transform(F.map_entries("exchange_trades"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    named = lambda found: found.withColumn("markets", text).drop("exchange_trades")
    return _by_event(s, d, lambda found, spans: A.placed(named(found), spans), lambda _, found: named(found))


@_query(
    "a06_exchange_insights",
    """SELECT event_id, exchange, first_pump_ms, first_relative_ms, coalesce(pump_count, 0) AS pump_count, max_change, avg_change, coalesce(actor_count, 0) AS actor_count, coalesce(actor_volume, 0) AS actor_volume, fastest_actor, fastest_ms,
  round(CASE WHEN actor_count > 0 THEN coalesce(actor_volume, 0) / actor_count ELSE 0 END, 1) AS volume_per_actor
FROM (SELECT event_id, exchange, min(start_ms) AS first_pump_ms, greatest(min(start_ms - trigger_ms), 0) AS first_relative_ms, count(*) AS pump_count, max(price_change) AS max_change, round(avg(price_change), 4) AS avg_change FROM ep GROUP BY ALL)
FULL JOIN (SELECT event_id, exchange, count(*) AS actor_count, round(sum(notional), 3) AS actor_volume, arg_min(actor_id, (first_ms, actor_id)) AS fastest_actor, min(first_ms) AS fastest_ms FROM (SELECT *, unnest(exchanges) AS exchange FROM a) GROUP BY ALL) USING (event_id, exchange)""",
    *ACTORS,
)
def _(s, d):
    return _insights(s, d)


@_query(
    "a07_actor_behaviour",
    """SELECT event_id, exchange, round(avg(trade_count), 4) AS avg_trades, round(avg(notional), 1) AS avg_volume, CAST(trunc(quantile_cont(entry_ms, 0.5)) AS BIGINT) AS median_entry_ms, count(*) FILTER (entry_ms <= 1000) AS early,
  count(*) FILTER (entry_ms > 1000 AND entry_ms <= 5000) AS regular, count(*) FILTER (entry_ms > 5000) AS late, count(*) FILTER (notional > 1000) AS large
FROM (SELECT *, unnest(exchanges) AS exchange FROM (SELECT *, first_ms - min(first_ms) OVER (PARTITION BY event_id) AS entry_ms FROM a)) GROUP BY ALL""",
    *ACTORS,
)
def _(s, d):
    return _by_exchange(s, d, lambda _, actors, own: A.behaviour_of(actors, own), lambda _, found: A.actor_behaviour(found))


@_query(
    "a08_exchange_comparison",
    """SELECT event_id, arg_min(exchange, (first_pump_ms, exchange)) FILTER (first_pump_ms IS NOT NULL) AS fastest, arg_max(exchange, (first_pump_ms, exchange)) FILTER (first_pump_ms IS NOT NULL) AS slowest,
  arg_max(exchange, (actor_count, exchange)) AS most_active, arg_max(exchange, (actor_volume, exchange)) AS highest_volume, max(first_pump_ms) - min(first_pump_ms) AS spread_ms,
  coalesce(string_agg(exchange, ',' ORDER BY first_pump_ms, exchange) FILTER (first_pump_ms IS NOT NULL), '') AS ranking
FROM (SELECT event_id, exchange, first_pump_ms, coalesce(actor_count, 0) AS actor_count, coalesce(actor_volume, 0) AS actor_volume FROM (SELECT event_id, exchange, min(start_ms) AS first_pump_ms FROM ep GROUP BY ALL)
FULL JOIN (SELECT event_id, exchange, count(*) AS actor_count, round(sum(notional), 3) AS actor_volume FROM (SELECT *, unnest(exchanges) AS exchange FROM a) GROUP BY ALL) USING (event_id, exchange)) GROUP BY 1""",
    *ACTORS,
)
def _(s, d):
    return A.exchange_comparison(_insights(s, d))


@_query(
    "a09_per_exchange_report",
    """SELECT event_id, exchange, coalesce(pump_count, 0) AS pump_count, max_change, coalesce(actor_count, 0) AS actor_count, coalesce(first_actors, '') AS first_actors
FROM (SELECT event_id, exchange, count(*) AS pump_count, max(price_change) AS max_change FROM ep GROUP BY ALL)
FULL JOIN (SELECT event_id, exchange, count(*) AS actor_count, string_agg(actor_id, ',' ORDER BY nth) FILTER (nth <= 10) AS first_actors FROM (SELECT *, row_number() OVER (PARTITION BY event_id, exchange ORDER BY first_ms, actor_id) AS nth FROM (SELECT *, unnest(exchanges) AS exchange FROM a)) GROUP BY ALL) USING (event_id, exchange)""",
    *ACTORS,
)
def _(s, d):
    return _by_exchange(s, d, A.report_of, A.per_exchange_report)


@_query(
    "a10_pump_volume_stats",
    """SELECT exchange, market_type, symbol, start_ms, round(sum(qty), 4) AS volume, round(sum(px * qty), 3) AS quote_volume, round(CASE WHEN sum(qty) > 0 THEN sum(px * qty) / sum(qty) ELSE 0 END, 5) AS vwap
FROM (SELECT *, ts_ms // 1000 * 1000 AS start_ms FROM t) JOIN (SELECT exchange, market_type, symbol, start_ms FROM p) USING (exchange, market_type, symbol, start_ms) GROUP BY ALL""",
    T, WIN, PUMPS,
)
def _(s, d):
    t = X.trades(s, d)
    return W.pump_volume_stats(W.pump_trades(W.detect_pumps(t), t))


@_query(
    "a11_pump_rollup",
    """SELECT exchange, market_type, label, CASE WHEN grouping(exchange) = 0 THEN 'exchange' WHEN grouping(market_type) = 0 THEN 'market_type' WHEN grouping(label) = 0 THEN 'label' ELSE 'all' END AS level, count(*) AS pumps, max(price_change) AS max_change,
  min(start_ms) AS first_ms, max(start_ms) AS last_ms, round(avg(0.7 * price_change + 0.3), 4) AS avg_intensity, round(sum(volume), 4) AS volume, arg_max(exchange, (price_change, -start_ms, exchange)) AS max_exchange
FROM (SELECT *, CASE WHEN trunc((start_ms - trigger_ms) / 1000.0) <= -15 THEN 'early' WHEN trunc((start_ms - trigger_ms) / 1000.0) <= -10 THEN 'mid' WHEN trunc((start_ms - trigger_ms) / 1000.0) <= -5 THEN 'late' WHEN trunc((start_ms - trigger_ms) / 1000.0) <= 0 THEN 'final' ELSE 'post' END AS label FROM ep)
GROUP BY GROUPING SETS ((), (exchange), (market_type), (label)) HAVING count(*) > 0""",
    *EVENTS,
)
def _(s, d):
    return W.pump_rollup(_ep(s, d))


@_query(
    "a12_collection_stats",
    "SELECT event_id, exchange, count(*) FILTER (market_type = 'spot') AS spot_trades, count(*) FILTER (market_type = 'futures') AS futures_trades, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, true AS connected FROM lt GROUP BY ALL",
    T, LD, L, LT,
)
def _(s, d):
    return _stats(s, d)


@_query(
    "a13_listing_quality",
    """SELECT event_id, CAST(sum(spot) AS BIGINT) AS spot_trades, CAST(sum(fut) AS BIGINT) AS futures_trades, string_agg(exchange, ',' ORDER BY exchange) AS exchanges, round(avg(least(1.0, (spot + fut) / 100.0)), 6) AS data_quality, (max(last_ms) - min(first_ms)) / 1000.0 AS collection_seconds
FROM (SELECT event_id, exchange, count(*) FILTER (market_type = 'spot') AS spot, count(*) FILTER (market_type = 'futures') AS fut, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM lt GROUP BY ALL) GROUP BY 1""",
    T, LD, L, LT,
)
def _(s, d):
    stats = _stats(s, d)
    return J.listing_quality(stats.withColumn("data_quality", F.least(F.lit(1.0), (F.col("spot_trades") + F.col("futures_trades")) / 100.0)))


@_query(
    "a14_pump_metrics",
    """SELECT exchange, market_type, symbol, start_ms, price_change, end_price, round(CASE WHEN mean_v > 0 THEN v / mean_v ELSE 0 END, 5) AS volume_spike, round(avg_size, 5) AS avg_size, max_size, round(CASE WHEN sells > 0 THEN buys / sells ELSE 0 END, 5) AS buy_sell_ratio
FROM (SELECT *, avg(v) OVER (PARTITION BY exchange, market_type, symbol) AS mean_v FROM (SELECT exchange, market_type, symbol, ts_ms // 1000 * 1000 AS start_ms, arg_max(px, (ts_ms, trade_id)) AS end_price, sum(qty) AS v, avg(qty) AS avg_size, max(qty) AS max_size,
  count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells FROM t GROUP BY ALL)) JOIN (SELECT exchange, market_type, symbol, start_ms, price_change FROM p) USING (exchange, market_type, symbol, start_ms)""",
    T, WIN, PUMPS,
)
def _(s, d):
    t = X.trades(s, d)
    return W.pump_metrics(t, W.detect_pumps(t))


@_query("a15_block_summary", "SELECT exchange, market_type, ts_ms // 30000 * 30000 AS start_ms, count(*) AS n, min(px) AS min_price, max(px) AS max_price, round(sum(qty), 4) AS volume, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM t GROUP BY ALL", T)
def _(s, d):
    return W.block_summary(X.trades(s, d))


@_query("a16_trades_by_exchange", "SELECT exchange, count(*) AS trades, round(avg(px), 6) AS avg_price FROM t WHERE symbol = 'SYM1USDT' GROUP BY 1", T)
def _(s, d):
    return M.trades_by_exchange(X.trades(s, d), "SYM1USDT")


@_query("a17_recent_activity", "SELECT exchange, market_type, symbol, count(*) AS trades, max(ts_ms) AS last_ms FROM t WHERE ts_ms >= 1704067300000 GROUP BY ALL", T)
def _(s, d):
    return M.recent_activity(X.trades(s, d), 1704067300000)


_STATE = "CASE WHEN {0} IS NULL THEN 'none' WHEN 1704067350000 - {0} <= 30000 THEN 'active' ELSE 'stale' END"


@_query(
    "a18_venue_status",
    f"""SELECT *, {_STATE.format("spot_last_ms")} AS spot_status, {_STATE.format("futures_last_ms")} AS futures_status FROM (SELECT exchange, count(*) FILTER (market_type = 'spot') AS spot_trades, count(*) FILTER (market_type = 'futures') AS futures_trades,
  max(ts_ms) FILTER (market_type = 'spot') AS spot_last_ms, max(ts_ms) FILTER (market_type = 'futures') AS futures_last_ms, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM t GROUP BY 1)""",
    T,
)
def _(s, d):
    return M.venue_status(X.trades(s, d), 1704067350000)


@_query("a19_throughput", "SELECT exchange, count(*) AS trades, round(CASE WHEN max(ts_ms) > min(ts_ms) THEN count(*) / ((max(ts_ms) - min(ts_ms)) / 1000.0) ELSE count(*) END, 6) AS per_second FROM t GROUP BY 1", T)
def _(s, d):
    return M.throughput(X.trades(s, d))


@_query("a19_write_health", "SELECT exchange, market_type, CASE WHEN errors > messages * 0.1 THEN 'warning' ELSE 'healthy' END AS health FROM pools", T, PL)
def _(s, d):
    return X.pools(s, d).select("exchange", "market_type", M.write_health(F.col("messages"), F.col("errors")).alias("health"))


@_query(
    "a20_detection_delay_stats",
    """SELECT node, count(*) AS notices, count(*) FILTER (x > 300000) AS slow, count(*) FILTER (x > 600000) AS very_slow, round(avg(x) FILTER (x > 300000), 3) AS avg_slow_ms, max(x) FILTER (x > 300000) AS max_slow_ms, round(count(*) FILTER (x > 300000) * 100.0 / count(*), 4) AS slow_percent,
  CASE WHEN count(*) FILTER (x > 300000) = 0 THEN 'none' WHEN count(*) FILTER (x > 600000) / count(*) FILTER (x > 300000) > 0.7 THEN 'systematic' ELSE 'sporadic' END AS likely_cause FROM (SELECT *, detected_ms - announced_ms AS x FROM n) GROUP BY 1""",
    T, LD, NT,
)
def _(s, d):
    return P.detection_delay_stats(X.notices(s, d))


@_query(
    "a21_api_metrics",
    """SELECT node, count(*) AS calls, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, min(response_ms) AS min_ms, max(response_ms) AS max_ms, round(avg(response_ms), 6) AS avg_ms, count(*) FILTER (status = 0) AS connection_errors,
  count(*) FILTER (status >= 500) AS http_errors, count(*) FILTER (status = 408) AS timeout_errors FROM c GROUP BY 1""",
    CL,
)
def _(s, d):
    return M.api_metrics(X.calls(s, d))


@_query(
    "a22_error_breakdown",
    """SELECT exchange, CASE WHEN message = 'out of memory' THEN 'fatal' ELSE 'recoverable' END AS severity, CASE WHEN message IN ('Authentication failed for user', 'table does not exist') THEN 'fatal' WHEN message IN ('connection reset by peer', 'timeout awaiting') THEN 'temporary' ELSE 'retryable' END AS db_class,
  count(*) AS n FROM log GROUP BY ALL""",
    T, LG,
)
def _(s, d):
    return M.error_breakdown(X.error_log(s, d))


@_query(
    "a23_api_hourly",
    """SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hour_ms DESC) AS nth FROM (SELECT node, ts_ms // 3600000 * 3600000 AS hour_ms, count(*) AS calls, round(avg(response_ms), 4) AS avg_ms, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_percent,
  round(avg(cpu), 4) AS avg_cpu, round(avg(memory_mb), 4) AS avg_memory_mb, count(*) FILTER (new_listing) AS listings, max(response_ms) AS longest_ms FROM c GROUP BY ALL)) WHERE nth <= 168""",
    CL,
)
def _(s, d):
    return M.api_hourly(X.calls(s, d))


ROLL = """r AS (SELECT *, round(coalesce(avg(CASE WHEN success THEN 100.0 ELSE 0 END) OVER m, 100), 4) AS success_1m, round(coalesce(avg(CASE WHEN success THEN 100.0 ELSE 0 END) OVER f, 100), 4) AS success_5m, round(coalesce(avg(CASE WHEN success THEN 100.0 ELSE 0 END) OVER h, 100), 4) AS success_1h FROM c
  WINDOW m AS (PARTITION BY node ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW), f AS (PARTITION BY node ORDER BY ts_ms RANGE BETWEEN 299999 PRECEDING AND CURRENT ROW), h AS (PARTITION BY node ORDER BY ts_ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW))"""
STREAK = """k AS (SELECT * EXCLUDE (g), CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY node, g ORDER BY ts_ms, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY ts_ms, call_id ROWS UNBOUNDED PRECEDING) AS g FROM r))"""
STATE = """st AS (SELECT node, avg(response_ms) AS avg_ms, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success) AS ok, arg_max(success_1m, (ts_ms, call_id)) AS success_1m, arg_max(streak, (ts_ms, call_id)) AS streak, arg_max(cpu, (ts_ms, call_id)) AS cpu,
  arg_max(memory_mb, (ts_ms, call_id)) AS memory_mb, max(ts_ms) AS last_ms FROM k GROUP BY 1)"""
_CALLS = (CL, ROLL, STREAK, STATE)


@_query(
    "a24_performance_score",
    """SELECT node, CAST(greatest(100 - CASE WHEN avg_ms > 3000 THEN 20 WHEN avg_ms > 1000 THEN 10 ELSE 0 END - CASE WHEN success_1m < 90 THEN 30 WHEN success_1m < 95 THEN 15 ELSE 0 END - CASE WHEN cpu > 80 THEN 15 ELSE 0 END - CASE WHEN memory_mb > 8000 THEN 15 ELSE 0 END, 0) AS BIGINT) AS score FROM st""",
    *_CALLS,
)
def _(s, d):
    return M.performance_score(M.service_state(X.calls(s, d))).select("node", "score")


@_query(
    "a24_threshold_alerts",
    """SELECT node, ts_ms, call_id, unnest(list_filter([CASE WHEN response_ms > 5000 THEN 'response' END, CASE WHEN memory_mb > 8000 THEN 'memory' END, CASE WHEN cpu > 80 THEN 'cpu' END, CASE WHEN success_1m < 95 THEN 'success' END], lambda x: x IS NOT NULL)) AS alert FROM r""",
    CL, ROLL,
)
def _(s, d):
    return M.threshold_alerts(X.calls(s, d))


@_query(
    "a25_health_scores",
    """SELECT node, CAST(100 - CASE WHEN streak > 3 THEN 30 ELSE 0 END - CASE WHEN 1706659500000 - last_ms > 30000 THEN 20 ELSE 0 END - CASE WHEN delay > 300000 THEN 25 ELSE 0 END AS BIGINT) AS monitor_score,
  CAST(greatest(100 - CASE WHEN avg_ms > 3000 THEN 20 ELSE 0 END - CASE WHEN failed > ok // 10 THEN 30 ELSE 0 END - CASE WHEN memory_mb > 7000 THEN 15 ELSE 0 END - CASE WHEN cpu > 80 THEN 20 ELSE 0 END, 0) AS BIGINT) AS system_score
FROM st JOIN (SELECT node, avg(detected_ms - announced_ms) AS delay FROM n GROUP BY 1) USING (node)""",
    T, LD, NT, *_CALLS,
)
def _(s, d):
    delay = X.notices(s, d).groupBy("node").agg(F.avg(F.col("detected_ms") - F.col("announced_ms")).alias("avg_delay_ms"))
    return M.health_scores(M.service_state(X.calls(s, d)).join(delay, "node"), 1706659500000).select("node", "monitor_score", "system_score")


@_query("a25_pool_health", "SELECT exchange, market_type, round(least(greatest(active_workers / total_workers * (1 - 0.5 * errors / messages) * CASE WHEN 1704068000000 - last_ms > 600000 THEN 0.5 ELSE 1 END, 0), 1), 6) AS score FROM pools", T, PL)
def _(s, d):
    return M.pool_health(X.pools(s, d), 1704068000000).select("exchange", "market_type", "score")


@_query("a26_catalogue_stats", "SELECT (SELECT count(DISTINCT symbol) FROM cat WHERE symbol = 'SYM0USDT') AS home_symbols, count(*) FILTER (market_type = 'spot') AS listed_spot, count(*) FILTER (market_type = 'futures') AS listed_futures, count(*) FILTER (market_type = 'spot' AND symbol <> 'SYM0USDT') AS subscribed_spot, count(*) FILTER (market_type = 'futures' AND symbol <> 'SYM0USDT') AS subscribed_futures FROM cat", T, CAT)
def _(s, d):
    c, h = X.catalogue(s, d), X.home(s, d)
    return C.catalogue_stats(c, C.subscription_list(c, h), h)


@_query("a27_feed_stats", "SELECT exchange, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(active_workers) AS BIGINT) AS active_workers FROM pools GROUP BY 1", T, PL)
def _(s, d):
    return M.feed_stats(X.pools(s, d))


@_query(
    "a28_bottlenecks",
    """SELECT node, kind, name, round(value, 4) AS value, likelihood, round(value / full_use * 100, 4) AS utilization
FROM (SELECT node, unnest(['avg_ms', 'streak', 'memory_mb', 'cpu']) AS metric, unnest([avg_ms, CAST(streak AS DOUBLE), CAST(memory_mb AS DOUBLE), cpu]) AS value FROM st)
JOIN (VALUES ('cause', 'High API Response Time', 'avg_ms', 3000::DOUBLE, 85::DOUBLE, NULL::DOUBLE), ('cause', 'Network Connectivity Issues', 'streak', 3, 70, NULL), ('cause', 'High Memory Usage', 'memory_mb', 6000, 60, NULL),
  ('bottleneck', 'Memory', 'memory_mb', 7000, NULL, 8000), ('bottleneck', 'CPU', 'cpu', 80, NULL, 100)) v(kind, name, metric, bound, likelihood, full_use) USING (metric) WHERE value > bound""",
    *_CALLS,
)
def _(s, d):
    return M.bottlenecks_and_causes(M.service_state(X.calls(s, d)))


# Windows, sorts and sets


@_query("w01_rank_actors", "SELECT event_id, actor_id, row_number() OVER (PARTITION BY event_id ORDER BY first_ms, actor_id) AS rank FROM a", *ACTORS)
def _(s, d):
    return _by_event(s, d, lambda found, spans: A.event_ranks(found.select("base", "actor_id", "first_ms", "trade_count", "notional"), spans), lambda _, found: A.rank_actors(found)).select("event_id", "actor_id", F.col("rank").cast("bigint").alias("rank"))


@_query("w02_rolling_success", "SELECT node, call_id, success_1m, success_5m, success_1h FROM r", CL, ROLL)
def _(s, d):
    return M.rolling_success(X.calls(s, d)).select("node", "call_id", "success_1m", "success_5m", "success_1h")


@_query(
    "w03_ewma_delay",
    "SELECT node, round(list_reduce(list(CAST(detected_ms - announced_ms AS DOUBLE) ORDER BY processed_ms, id), lambda a, x: (a + x) / 2), 4) AS ewma_ms, count(*) AS n FROM n GROUP BY 1",
    T, LD, NT,
)
def _(s, d):
    return P.ewma_delay(X.notices(s, d))


@_query("w04_latest_and_oldest", "SELECT exchange, market_type, symbol, arg_max(trade_id, (ts_ms, trade_id)) AS latest_trade, arg_min(trade_id, (ts_ms, trade_id)) AS oldest_trade, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM t GROUP BY ALL", T)
def _(s, d):
    return J.latest_per_market(X.trades(s, d), ["exchange", "market_type", "symbol"])


@_query("w04_trade_at", "SELECT trade_id, ts_ms FROM t WHERE ts_ms = 1704067221772", T)
def _(s, d):
    return J.trade_at(X.trades(s, d), 1704067221772).select("trade_id", "ts_ms")


@_query("w05_split_even", "SELECT exchange, market_type, symbol, ntile(2) OVER (PARTITION BY exchange, market_type ORDER BY symbol) AS chunk FROM cat", T, CAT)
def _(s, d):
    return C.split_even(X.catalogue(s, d), 2).withColumn("chunk", F.col("chunk").cast("bigint"))


@_query("w06_split_fixed", "SELECT * FROM (SELECT exchange, market_type, symbol, (row_number() OVER (PARTITION BY exchange, market_type ORDER BY symbol) - 1) // 2 AS chunk FROM cat) WHERE chunk < 1", T, CAT)
def _(s, d):
    return C.split_fixed(X.catalogue(s, d), 2, 1)


@_query("w07_failure_streak", "SELECT node, call_id, streak FROM k", CL, ROLL, STREAK)
def _(s, d):
    return M.failure_streak(X.calls(s, d)).select("node", "call_id", "streak")


@_query("w08_keep_last", "SELECT node, call_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts_ms DESC, call_id DESC) AS nth FROM c) WHERE nth <= 100", CL)
def _(s, d):
    return J.keep_last(X.calls(s, d), 100, key="node", time="ts_ms", tie="call_id").select("node", "call_id", "ts_ms")


@_query("w09_market_first_pump", "SELECT event_id, exchange, first_ms, dense_rank() OVER (PARTITION BY event_id ORDER BY first_ms) AS reaction FROM (SELECT event_id, exchange, min(start_ms) AS first_ms FROM ep GROUP BY ALL)", *EVENTS)
def _(s, d):
    return W.market_first_pump(_ep(s, d)).withColumn("reaction", F.col("reaction").cast("bigint"))


@_query("t01_top_actors", "SELECT event_id, actor_id, rank FROM (SELECT event_id, actor_id, row_number() OVER (PARTITION BY event_id ORDER BY first_ms, actor_id) AS rank FROM a) WHERE rank <= 10", *ACTORS)
def _(s, d):
    return _by_event(s, d, lambda found, spans: A.event_top_actors(found, spans), lambda _, found: A.top_actors(found)).select("event_id", "actor_id", F.col("rank").cast("bigint").alias("rank"))


@_query("t02_recent_trades", f"SELECT {_DECODED} FROM t ORDER BY ts_ms DESC, trade_id DESC LIMIT 100", T)
def _(s, d):
    return M.recent_trades(X.trades(s, d), 5000)


@_query("t03_recent_listings", "SELECT event_id, base AS symbol, trigger_ms FROM l ORDER BY trigger_ms DESC, event_id DESC LIMIT 20", T, LD, L)
def _(s, d):
    return M.recent_listings(X.listings(s, d), 20).select("event_id", "symbol", "trigger_ms")


@_query("t04_trades_sorted", f"SELECT {_DECODED} FROM t WHERE symbol = 'SYM1USDT' AND ts_ms BETWEEN 1704067220000 AND 1704067260000 ORDER BY ts_ms, trade_id", T)
def _(s, d):
    return M.trades_sorted(X.trades(s, d), "SYM1USDT", 1704067220000, 1704067260000)


@_query("u01_union_markets", f"SELECT {_DECODED} FROM t", T)
def _(s, d):
    t = X.trades(s, d)
    return J.union_markets([t.where(F.col("market_type") == kind) for kind in ("spot", "futures")])


@_query("u02_merge_hot_cold", f"SELECT {_DECODED} FROM t", T)
def _(s, d):
    t = X.trades(s, d)
    return J.merge_hot_cold(t.where("ts_ms >= 1704067250000"), t.where("ts_ms < 1704067300000"), 1704067270000)


@_query("u03_new_symbols", "SELECT * FROM cat WHERE symbol = 'SYM2USDT'", T, CAT)
def _(s, d):
    c = X.catalogue(s, d)
    return C.new_symbols(c, c.where("symbol <> 'SYM2USDT'"))


@_query("u03_common_symbols", "SELECT * FROM cat WHERE symbol = 'SYM1USDT'", T, CAT)
def _(s, d):
    c = X.catalogue(s, d)
    return C.common_symbols(c.where("symbol <> 'SYM2USDT'"), c.where("symbol <> 'SYM0USDT'"))


@_query("u03_delisted_symbols", "SELECT * FROM cat WHERE symbol = 'SYM0USDT'", T, CAT)
def _(s, d):
    c = X.catalogue(s, d)
    return C.delisted_symbols(c.where("symbol <> 'SYM0USDT'"), c)


@_query(
    "lineitem_day_windows",
    """SELECT l_returnflag AS exchange, l_linestatus AS market_type, l_partkey AS symbol, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) // 86400000 * 86400000 AS start_ms, count(*) AS trade_count, min(CAST(l_extendedprice / l_quantity AS DOUBLE)) AS min_price,
  max(CAST(l_extendedprice / l_quantity AS DOUBLE)) AS max_price, round(CAST(sum(l_quantity) AS DOUBLE), 6) AS volume FROM lineitem GROUP BY ALL""",
)
def _(s, d):
    rows = X.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("exchange"), F.col("l_linestatus").alias("market_type"), F.col("l_partkey").alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).cast("string").alias("price"), F.col("l_quantity").cast("string").alias("quantity"),
    )
    return W.pump_windows(rows, width_ms=86_400_000)


# Stored tables and streams


_STORED = "SELECT exchange, market_type, symbol, trade_id, px, qty, ts_ms FROM t"
_query("k01_s08_write_and_read_trades", f"{_STORED} WHERE ts_ms BETWEEN 1704067240000 AND 1704067400000", T)(K.trades_round_trip)
_query("k02_write_listings", "SELECT event_id, base AS symbol, '[\"KRW\"]' AS markets, trigger_ms FROM l", T, LD, L)(K.listings_round_trip)
_query(
    "k03_write_pump_analysis",
    """SELECT CAST(NULL AS BIGINT) AS listing_id, symbol, exchange, market_type, epoch_us(make_timestamp(start_ms * 1000)) AS start_us, epoch_us(make_timestamp(end_ms * 1000)) AS end_us, CAST(duration_ms AS INTEGER) AS duration_ms, start_price, peak_price, end_price,
  price_change AS price_change_percent, volume AS total_volume, round(CASE WHEN mean_v > 0 THEN v / mean_v ELSE 0 END, 5) AS volume_spike_ratio, CAST(trade_count AS INTEGER) AS trade_count, round(avg_size, 5) AS avg_trade_size, max_size AS max_trade_size,
  round(CASE WHEN sells > 0 THEN buys / sells ELSE 0 END, 5) AS buy_sell_ratio, 1704067459200000 AS analyzed_us, '2024-01-01' AS day
FROM p JOIN (SELECT *, avg(v) OVER (PARTITION BY exchange, market_type, symbol) AS mean_v FROM (SELECT exchange, market_type, symbol, ts_ms // 1000 * 1000 AS start_ms, arg_max(px, (ts_ms, trade_id)) AS end_price, sum(qty) AS v, avg(qty) AS avg_size, max(qty) AS max_size,
  count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells FROM t GROUP BY ALL)) USING (exchange, market_type, symbol, start_ms)""",
    T, WIN, PUMPS,
)(K.pumps_round_trip)
_query("k04_write_metrics", "SELECT node AS node_id, CAST(status AS VARCHAR) AS status, count(*) AS n, max(response_ms) AS longest FROM c GROUP BY ALL", CL)(K.metrics_round_trip)
_query("k05_s09_event_archive", "SELECT event_id, exchange, market_type, count(*) AS trades, min(ts_ms) AS first_ms FROM lt GROUP BY ALL", T, LD, L, LT)(K.archive_round_trip)
_query(
    "k05_archive_reports",
    """SELECT event_id, exchanges, CAST(trades AS BIGINT) AS trades, coalesce(pumps, 0) AS pumps, max_change, coalesce(top_actors, 0) AS top_actors
FROM (SELECT event_id, count(DISTINCT exchange) AS exchanges, count(*) AS trades FROM lt GROUP BY 1) LEFT JOIN (SELECT event_id, count(*) AS pumps, max(price_change) AS max_change FROM ep GROUP BY 1) USING (event_id)
LEFT JOIN (SELECT event_id, least(count(*), 10) AS top_actors FROM a GROUP BY 1) USING (event_id)""",
    *ACTORS,
)(K.archive_reports)
_query("k06_export_tables_csv", "SELECT 'trades' AS \"table\", count(*) AS rows, 'success' AS status, 'success' AS run_status FROM t UNION ALL SELECT 'listings', count(*), 'success', 'success' FROM l", T, LD, L)(K.csv_export)
_query("k07_expired_partitions", "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-31' - 20")(K.expired_days)
_query("r01_stream_trades", f"SELECT {_DECODED} FROM t", T)(K.streamed_trades)
_query(
    "r02_r08_stream_pumps",
    """SELECT exchange, market_type, symbol, start_ms, min_price AS start_price, max_price AS peak_price, round((max_price - min_price) / min_price * 100, 6) AS price_change, volume, trade_count FROM w
WHERE trade_count >= 2 AND min_price > 0 AND (max_price - min_price) / min_price * 100 >= 3""",
    T, WIN,
)(K.streamed_pumps)
_query("r03_stream_listing_trades", "SELECT event_id, exchange, market_type, symbol, trade_id, ts_ms, trigger_ms FROM lt", T, LD, L, LT)(K.streamed_listing_trades)
_query("r04_stream_dedup_notices", "SELECT event_id AS id, title, trigger_ms AS announced_ms FROM listed", T, LD)(K.streamed_first_notices)
_query("r05_stream_sink", _STORED, T)(K.streamed_sink)
_query(
    "r06_stream_rolling_success",
    """SELECT horizon, node, start_ms, start_ms + width AS end_ms, count(*) AS calls, round(avg(CASE WHEN success THEN 100.0 ELSE 0 END), 4) AS success_percent
FROM (SELECT c.*, horizon, width, ts_ms // slide * slide - slide * k AS start_ms FROM c, (VALUES ('1m', 60000, 30000), ('5m', 300000, 60000), ('1h', 3600000, 1800000)) h(horizon, width, slide), range(5) r(k) WHERE k < width // slide) GROUP BY ALL""",
    CL,
)(K.streamed_success)
_query("x03_stream_progress", "SELECT exchange, count(*) AS trades, (SELECT count(*) + count(*) FILTER (CAST(trade_id AS BIGINT) % 100 = 0) FROM t) AS read_by_stream FROM t GROUP BY 1", T)(K.streamed_progress)
_query("r07_stream_venue_status", "SELECT exchange, market_type, max(ts_ms) AS last_ms, count(*) AS trades FROM t GROUP BY ALL", T)(K.streamed_venue_status)
_query(
    "r07_stream_liveness",
    """SELECT exchange, symbol, 'active' AS status, min(ts_ms) AS at_ms, CAST(NULL AS BIGINT) AS messages FROM runs GROUP BY exchange, symbol, run
UNION ALL SELECT exchange, symbol, 'stale', max(ts_ms) + 2000, count(*) FROM runs GROUP BY exchange, symbol, run""",
    T,
    """gaps AS (SELECT exchange, symbol, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER w <= 2000 THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_ms))""",
    """runs AS (SELECT *, sum(starts) OVER (PARTITION BY exchange, symbol ORDER BY ts_ms) AS run FROM gaps)""",
)(K.streamed_liveness)
_query("r04_j03_processed_state", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'sent' ELSE 'waiting' END AS status FROM listed", T, LD)(K.processed_state)
_NAMES = """names AS (SELECT event_id, concat(CASE WHEN k = 1 THEN base ELSE concat(base, '-', CAST(k AS VARCHAR)) END, '_', strftime(make_timestamp(trigger_ms * 1000), '%Y%m%d_%H%M%S')) AS event, title, trigger_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY base, trigger_ms // 1000 ORDER BY trigger_ms, event_id) AS k FROM l))"""
_query(
    "k05_event_files",
    """SELECT event, title, coalesce(trades, 0) AS trades, 12 - coalesce(markets, 0) AS empty_markets, coalesce(pumps, 0) AS pumps, coalesce(pump_markets, 0) AS pump_markets, least(coalesce(users, 0), 10) AS top_users, coalesce(users, 0) AS users,
  coalesce(exchange_reports, 0) AS exchange_reports, max_change, pump_exchanges
FROM names LEFT JOIN (SELECT event_id, count(*) AS trades, count(DISTINCT concat(exchange, market_type)) AS markets FROM lt GROUP BY 1) USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS pumps, count(DISTINCT concat(exchange, market_type)) AS pump_markets, max(price_change) AS max_change, count(DISTINCT exchange) AS pump_exchanges FROM ep GROUP BY 1) USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS users FROM a GROUP BY 1) USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS exchange_reports FROM (SELECT event_id, exchange FROM ep UNION SELECT event_id, unnest(exchanges) FROM a) GROUP BY 1) USING (event_id)""",
    *ACTORS, _NAMES,
)(K.event_files)
_query("s09_pruned_event_files", "SELECT event, trade_id FROM lt JOIN names USING (event_id) WHERE market_type = 'spot' AND event = (SELECT event FROM names ORDER BY trigger_ms, event_id LIMIT 1)", T, LD, L, LT, _NAMES)(K.pruned_event_files)
_query(
    "s08_indexed_range",
    "SELECT 'range' AS read, exchange, market_type, symbol, trade_id, px, qty, ts_ms FROM t WHERE symbol = 'SYM1USDT' AND ts_ms BETWEEN 1704067300000 AND 1704067340000 UNION ALL SELECT 'point', exchange, market_type, symbol, trade_id, px, qty, ts_ms FROM t WHERE trade_id = '600'",
    T,
)(K.indexed_range)
_query("r05_ledger_sink", _STORED, T)(K.ledger_sink)
_LAST = "(ts_ms, trade_id, price, quantity, side)"
_query(
    "w04_latest_view",
    f"""SELECT exchange, market_type, symbol, count(*) AS trades, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_max(trade_id, {_LAST}) AS last_trade_id, arg_max(price, {_LAST}) AS last_price, arg_max(quantity, {_LAST}) AS last_quantity,
  arg_max(side, {_LAST}) AS last_side FROM t GROUP BY ALL""",
    T,
)(K.latest_view)
_query(
    "a18_active_totals",
    """SELECT coalesce(exchange, 'all') AS exchange, CAST(sum(spot) AS BIGINT) AS spot_trades, CAST(sum(futures) AS BIGINT) AS futures_trades, CAST(sum(markets) AS BIGINT) AS markets, CAST(sum(active) AS BIGINT) AS active, max(last_ms) AS last_ms
FROM (SELECT exchange, count(*) FILTER (market_type = 'spot') AS spot, count(*) FILTER (market_type = 'futures') AS futures, count(DISTINCT (market_type, symbol)) AS markets, max(ts_ms) AS last_ms,
  CASE WHEN max(ts_ms) >= 1704067459200 - 200 THEN 1 ELSE 0 END AS active FROM t GROUP BY 1) GROUP BY GROUPING SETS ((exchange), ())""",
    T,
)(K.active_totals)
_query(
    "k07_retained_folders",
    """SELECT event AS folder, CASE WHEN trigger_ms // 1000 * 1000 < 1704067320000 THEN 'removed' ELSE 'kept' END AS action FROM names UNION ALL SELECT event, 'would mark' FROM names WHERE trigger_ms // 1000 * 1000 < 1704067320000
UNION ALL SELECT 'trades_export', 'kept'""",
    T, LD, L, _NAMES,
)(K.retained_folders)
_VALID = """snaps AS (SELECT DISTINCT ts_ms // 1000 * 1000 AS taken_ms, exchange, market_type, symbol FROM t WHERE side = 'buy'),
taken AS (SELECT exchange, market_type, taken_ms, row_number() OVER w AS nth, lead(taken_ms) OVER w AS next_ms FROM (SELECT DISTINCT exchange, market_type, taken_ms FROM snaps) WINDOW w AS (PARTITION BY exchange, market_type ORDER BY taken_ms)),
runs AS (SELECT *, nth - row_number() OVER (PARTITION BY exchange, market_type, symbol ORDER BY taken_ms) AS run FROM snaps JOIN taken USING (exchange, market_type, taken_ms)),
valid AS (SELECT exchange, market_type, symbol, min(taken_ms) AS from_ms, arg_max(coalesce(next_ms, 9000000000000), taken_ms) AS end_ms FROM runs GROUP BY exchange, market_type, symbol, run),
listed_at AS (SELECT *, nullif(end_ms, 9000000000000) AS until_ms, row_number() OVER (PARTITION BY exchange, market_type, symbol ORDER BY from_ms) AS listing FROM valid)"""
_query("u03_catalogue_intervals", "SELECT exchange, market_type, symbol, from_ms, until_ms, listing FROM listed_at", T, _VALID)(K.catalogue_intervals)
_query(
    "j01_trades_as_listed",
    "SELECT t.trade_id, v.from_ms AS listed_ms, v.listing FROM t LEFT JOIN listed_at v ON v.exchange = t.exchange AND v.market_type = t.market_type AND v.symbol = t.symbol AND t.ts_ms >= v.from_ms AND t.ts_ms < v.end_ms",
    T, _VALID,
)(K.trades_by_listing)
_query(
    "x03_observed_feed",
    """SELECT what, count(*) AS observed, count(*) AS stored FROM (SELECT 'trades' AS what FROM t UNION ALL SELECT CASE WHEN ts_ms % 4 = 2 AND exchange = 'binance' THEN 'not JSON' ELSE 'not a trade' END FROM t WHERE CAST(trade_id AS BIGINT) % 100 = 0) GROUP BY 1""",
    T,
)(K.observed_feed)


@_query("s07_open_messages", f"SELECT {_DECODED}, trade_id AS id_in_item FROM t", T)
def _(s, d):
    rows = O.ingest_open(X.raw_messages(s, d), keep_item=True)
    item = F.col("item")
    own = F.coalesce(*(O.at(item, path) for path in ("$.t", "$.i", "$.tradeId", "$.id")))
    return rows.withColumn("id_in_item", own).drop("item")


@_query(
    "f02_f03_all_venues",
    """SELECT id, exchange, market_type, concat(base, 'USDT') AS symbol,
  CASE exchange WHEN 'okx' THEN concat(base, CASE market_type WHEN 'futures' THEN '-USDT-SWAP' ELSE '-USDT' END) WHEN 'kucoin' THEN CASE market_type WHEN 'futures' THEN concat(base, 'USDTM') ELSE concat(base, '-USDT') END
    WHEN 'gate' THEN concat(base, '_USDT') WHEN 'phemex' THEN CASE market_type WHEN 'futures' THEN concat(base, 'USD') ELSE concat('s', base, 'USDT') END ELSE concat(base, 'USDT') END AS spelled,
  CASE WHEN exchange = 'kucoin' AND market_type = 'futures' THEN CASE base WHEN 'XBT' THEN 'BTCUSDT' ELSE concat(base, 'USDTM') END ELSE concat(base, 'USDT') END AS back FROM sp""",
    X.SPELLED_SQL,
)
def _(s, d):
    spelled = S.format_symbol(F.col("symbol"), F.col("exchange"), F.col("market_type"))
    return X.spelled_symbols(s, d).select("id", "exchange", "market_type", "symbol", spelled.alias("spelled"), S.normalize_symbol_by_venue(F.col("exchange"), spelled).alias("back"))


@_query(
    "f01_f08_spellings",
    """SELECT id, spelled, upper(replace(replace(spelled, '-', ''), '_', '')) AS normal, CASE form WHEN 4 THEN concat('S', base) WHEN 5 THEN spelled ELSE base END AS base,
  CASE form WHEN 1 THEN concat(base, '-') WHEN 2 THEN concat(base, '_') WHEN 4 THEN concat('S', base) ELSE base END AS base_of_pair, CASE form WHEN 3 THEN 'USDC' WHEN 5 THEN 'EUR' WHEN 6 THEN 'ETH' ELSE 'USDT' END AS quote,
  form NOT IN (1, 2) AND length(spelled) <= 10 AS valid,
  concat_ws(',', spelled, CASE form WHEN 0 THEN base WHEN 1 THEN concat(base, '-,', base) WHEN 2 THEN concat(base, '_,', base) WHEN 4 THEN concat('S', base, ',', base) END) AS names
FROM (SELECT *, replace(['{b}USDT', '{b}-USDT', '{b}_USDT', '{b}USDC', 'S{b}USDT', '{b}EUR', '{b}ETH'][form + 1], '{b}', base) AS spelled FROM sp)""",
    X.SPELLED_SQL,
)
def _(s, d):
    c = F.col("spelled")
    pair = S.base_quote(c)
    return X.spelled_symbols(s, d).select(
        "id", "spelled", S.normalize_symbol(c).alias("normal"), S.base_symbol(c).alias("base"), pair["base"].alias("base_of_pair"), pair["quote"].alias("quote"), S.is_valid_symbol(S.clean_symbol(c)).alias("valid"),
        F.array_join(S.match_bases(c), ",").alias("names"),
    )
