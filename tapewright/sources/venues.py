"""Venue decoders: raw JSON messages to trades, one column program for batch and stream.

A decoder builds a column: from the message and its market type an array of trades, each with ``reject``
(null for a trade, else why the message is none). All venues are decoded in one pass over the messages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.numbers import whole_division
from tapewright.functions.symbols import normalize_side, normalize_symbol

Decoder = Callable[[Column, Column], Column]


def _item(symbol: Column, trade_id: Column, price: Column, quantity: Column, side: Column, ts_ms: Column, reject: Column | None = None) -> Column:
    missing = (
        F.when(symbol.isNull() | (symbol == ""), "no symbol")
        .when(price.isNull() | (price == ""), "no price")
        .when(quantity.isNull() | (quantity == ""), "no quantity")
        .when(ts_ms.isNull(), "no time")
    )
    return F.struct(
        symbol.alias("symbol"), trade_id.alias("trade_id"), price.alias("price"), quantity.alias("quantity"), normalize_side(side).alias("side"), ts_ms.alias("ts_ms"),
        (missing if reject is None else reject).alias("reject"),
    )


def _rejected(why: Column) -> Column:
    none = F.lit(None).cast("string")
    return _item(none, none, none, none, none, F.lit(None).cast("bigint"), why)


def _decoded(message: Column, other: Callable[[Column], Column], items: Callable[[Column], Column]) -> Column:
    """Items of a parsed message, which is parsed once; ``other`` says whether a message is no trade message."""

    def of(m: Column) -> Column:
        why = F.when(m.isNull(), "not JSON").when(F.coalesce(other(m), F.lit(True)), "not a trade")
        return F.when(why.isNotNull(), F.array(_rejected(why))).otherwise(F.coalesce(items(m), F.array(_rejected(F.lit("no data")))))

    return F.flatten(F.transform(F.array(message), of))


def decode_binance(raw: Column, market_type: Column, *, taker_side: bool = False) -> Column:
    """Object e, s, t, p, q, T, m with e = trade; m (buyer is maker) gives buy, or sell with ``taker_side``.

    Keys that differ in case only need a map: field names of structs do not tell them apart.
    """
    maker, taker = ("sell", "buy") if taker_side else ("buy", "sell")
    trade = lambda m: F.array(_item(m["s"], m["t"], m["p"], m["q"], F.when(m["m"] == "true", maker).otherwise(taker), m["T"].try_cast("bigint")))
    return _decoded(F.from_json(raw, "map<string,string>"), lambda m: m["e"] != "trade", trade)


def decode_bybit(raw: Column, market_type: Column) -> Column:
    message = F.from_json(raw, "success boolean, op string, topic string, data array<map<string,string>>")
    other = lambda m: F.coalesce(m["success"], F.lit(False)) | (F.coalesce(m["op"], F.lit("")) != "") | ~m["topic"].contains("publicTrade")
    return _decoded(message, other, lambda m: F.transform(m["data"], lambda d: _item(d["s"], d["i"], d["p"], d["v"], d["S"], d["T"].try_cast("bigint"))))


def decode_okx(raw: Column, market_type: Column) -> Column:
    message = F.from_json(raw, "arg struct<channel:string>, data array<struct<instId:string,tradeId:string,px:string,sz:string,side:string,ts:string>>")
    items = lambda m: F.transform(m["data"], lambda d: _item(d["instId"], d["tradeId"], d["px"], d["sz"], d["side"], d["ts"].try_cast("bigint")))
    return _decoded(message, lambda m: m["arg"]["channel"] != "trades", items)


def decode_kucoin(raw: Column, market_type: Column) -> Column:
    message = F.from_json(raw, "type string, topic string, subject string, data struct<symbol:string,price:string,size:string,side:string,tradeId:string,time:string,ts:string>")

    def other(m: Column) -> Column:
        spot = m["topic"].contains("/market/match:") & m["subject"].contains("trade")
        futures = m["topic"].contains("/contractMarket/execution:") & m["subject"].contains("match")
        return ~((m["type"] == "message") & F.when(market_type == "spot", spot).otherwise(futures))

    def items(m: Column) -> Column:
        d = m["data"]
        return F.array(_item(d["symbol"], d["tradeId"], d["price"], d["size"], d["side"], F.substring(F.coalesce(d["time"], d["ts"]), 1, 13).try_cast("bigint")))

    return _decoded(message, other, items)


def decode_gate(raw: Column, market_type: Column) -> Column:
    message = F.from_json(raw, "event string, channel string, result struct<id:bigint,create_time:bigint,create_time_ms:string,side:string,currency_pair:string,amount:string,contract:string,size:string,price:string>")

    def items(m: Column) -> Column:
        r, spot = m["result"], market_type == "spot"
        ms = F.coalesce(F.substring_index(r["create_time_ms"], ".", 1).try_cast("bigint"), r["create_time"] * 1000)
        return F.array(_item(F.when(spot, r["currency_pair"]).otherwise(r["contract"]), r["id"].cast("string"), r["price"], F.when(spot, r["amount"]).otherwise(r["size"]), r["side"], ms))

    return _decoded(message, lambda m: ~((m["event"] == "update") & m["channel"].contains("trades")), items)


def decode_phemex(raw: Column, market_type: Column) -> Column:
    message = F.from_json(raw, "id bigint, symbol string, sequence bigint, trades_p array<array<string>>")

    def items(m: Column) -> Column:
        def one(d: Column) -> Column:
            at = whole_division(F.get(d, 0).try_cast("bigint"), 1_000_000)
            trade_id = F.concat_ws("_", m["sequence"].cast("string"), F.get(d, 0))
            return F.when(F.size(d) < 4, _rejected(F.lit("short item"))).otherwise(_item(m["symbol"], trade_id, F.get(d, 2), F.get(d, 3), F.get(d, 1), at))

        return F.transform(m["trades_p"], one)

    return _decoded(message, lambda m: (F.coalesce(m["id"], F.lit(0)) != 0) | m["trades_p"].isNull(), items)


#: Decoder of each venue; add one to read another venue.
DECODERS: dict[str, Decoder] = {
    "binance": decode_binance,
    "bybit": decode_bybit,
    "okx": decode_okx,
    "kucoin": decode_kucoin,
    "phemex": decode_phemex,
    "gate": decode_gate,
}


#: Why a message gives no trade.
REJECTS = ("not JSON", "not a trade", "no data", "no symbol", "no price", "no quantity", "no time", "short item", "unknown venue")


def decode_all(raw_messages: DataFrame, decoders: dict[str, Decoder] | None = None, *, keep: Sequence[str] = ()) -> DataFrame:
    """All venues' messages as trades with ``raw`` and ``reject`` (null for trades) and what else is kept of the message; an unknown venue's messages are rejected."""
    items = F.when(F.col("exchange").isNull(), F.array(_rejected(F.lit("unknown venue"))))
    for venue, decode in (decoders or DECODERS).items():
        items = items.when(F.col("exchange") == venue, decode(F.col("raw"), F.col("market_type")))
    rows = raw_messages.select("exchange", "market_type", "raw", *keep, F.explode(items.otherwise(F.array(_rejected(F.lit("unknown venue"))))).alias("d"))
    return rows.select("exchange", "market_type", "d.symbol", "d.trade_id", "d.price", "d.quantity", "d.side", "d.ts_ms", "raw", "d.reject", *keep)


def ingest_trades(raw_messages: DataFrame, *, normalizer: Callable[[Column, Column], Column] | None = None, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Normalised trades of all venues; ``normalizer(venue, symbol)`` replaces the plain symbol normaliser."""
    found = decode_all(raw_messages, decoders).where("reject is null").drop("raw", "reject")
    name = normalizer(F.col("exchange"), F.col("symbol")) if normalizer else normalize_symbol(F.col("symbol"))
    return found.withColumn("symbol", name)


def rejected_messages(raw_messages: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    return decode_all(raw_messages, decoders).where("reject is not null").select("exchange", "market_type", "raw", "reject")
