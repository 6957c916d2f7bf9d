"""Venue messages as ``VARIANT``: parsed once for all venues, whatever they hold, with all fields kept.

``venues`` reads the fields that it knows; a message that gains fields loses them there, and one whose parts change type is read as null as a whole.
Here a message is one parsed value, a trade is one value of it (``item``), and fields are taken by path at the type that is wanted.
New fields are in ``item`` and ``message`` for any later query, without reading the raw text again. A venue is two
conditions and a few paths, so another one needs no schema.

Trades are those of ``venues.ingest_trades``. Text that is no JSON is told apart from messages that are no trades; a key that occurs
twice in an object makes a message no JSON here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.numbers import whole_division
from tapewright.functions.symbols import normalize_side, normalize_symbol


def at(value: Column, path: str, kind: str = "string") -> Column:
    """Part of a parsed value as a type; null where it is missing or of another type."""
    return F.try_variant_get(value, path, kind)


class OpenVenue(NamedTuple):
    """How a venue's messages are read: which are trades, where their items are, and the parts of an item."""

    is_trade: Callable[[Column, Column], Column]  # message, market type
    items: Callable[[Column], Column]
    symbol: Callable[[Column, Column, Column], Column]  # item, message, market type; so are all below
    trade_id: Callable[[Column, Column, Column], Column]
    price: Callable[[Column, Column, Column], Column]
    quantity: Callable[[Column, Column, Column], Column]
    side: Callable[[Column, Column, Column], Column]
    ts_ms: Callable[[Column, Column, Column], Column]


def _of(path: str, kind: str = "string") -> Callable[[Column, Column, Column], Column]:
    return lambda item, message, market_type: at(item, path, kind)


def _list(path: str) -> Callable[[Column], Column]:
    return lambda message: at(message, path, "array<variant>")


def _one(path: str) -> Callable[[Column], Column]:
    return lambda message: F.when(at(message, path, "variant").isNotNull(), F.array(at(message, path, "variant")))


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


def _by_market(spot: str, futures: str) -> Callable[[Column, Column, Column], Column]:
    return lambda item, message, market_type: F.when(market_type == "spot", at(item, spot)).otherwise(at(item, futures))


def _kucoin_trade(m: Column, market_type: Column) -> Column:
    topic, subject = at(m, "$.topic"), at(m, "$.subject")
    spot = topic.contains("/market/match:") & subject.contains("trade")
    return (at(m, "$.type") == "message") & F.when(market_type == "spot", spot).otherwise(topic.contains("/contractMarket/execution:") & subject.contains("match"))


def _gate_ms(item: Column, message: Column, market_type: Column) -> Column:
    return F.coalesce(_number(F.substring_index(at(item, "$.create_time_ms"), ".", 1)), at(item, "$.create_time", "bigint") * 1000)


OPEN_VENUES: dict[str, OpenVenue] = {
    "binance": OpenVenue(
        lambda m, market_type: at(m, "$.e") == "trade", _one("$"), _of("$.s"), _of("$.t"), _of("$.p"), _of("$.q"),
        lambda item, message, market_type: F.when(at(item, "$.m", "boolean"), "buy").otherwise("sell"), _of("$.T", "bigint"),
    ),
    "bybit": OpenVenue(
        lambda m, market_type: at(m, "$.topic").contains("publicTrade") & ~F.coalesce(at(m, "$.success", "boolean"), F.lit(False)) & (F.coalesce(at(m, "$.op"), F.lit("")) == ""), _list("$.data"),
        _of("$.s"), _of("$.i"), _of("$.p"), _of("$.v"), _of("$.S"), _of("$.T", "bigint"),
    ),
    "okx": OpenVenue(lambda m, market_type: at(m, "$.arg.channel") == "trades", _list("$.data"), _of("$.instId"), _of("$.tradeId"), _of("$.px"), _of("$.sz"), _of("$.side"), lambda item, *_: _number(at(item, "$.ts"))),
    "kucoin": OpenVenue(
        _kucoin_trade, _one("$.data"), _of("$.symbol"), _of("$.tradeId"), _of("$.price"), _of("$.size"), _of("$.side"),
        lambda item, *_: _number(F.substring(F.coalesce(at(item, "$.time"), at(item, "$.ts")), 1, 13)),
    ),
    "phemex": OpenVenue(
        lambda m, market_type: (F.coalesce(at(m, "$.id", "bigint"), F.lit(0)) == 0) & at(m, "$.trades_p", "array<variant>").isNotNull(), _list("$.trades_p"),
        lambda item, message, _: at(message, "$.symbol"), lambda item, message, _: F.concat_ws("_", at(message, "$.sequence"), at(item, "$[0]")), _of("$[2]"), _of("$[3]"), _of("$[1]"),
        lambda item, *_: whole_division(_number(at(item, "$[0]")), 1_000_000),
    ),
    "gate": OpenVenue(
        lambda m, market_type: (at(m, "$.event") == "update") & at(m, "$.channel").contains("trades"), _one("$.result"), _by_market("$.currency_pair", "$.contract"), _of("$.id"), _of("$.price"), _by_market("$.amount", "$.size"), _of("$.side"), _gate_ms,
    ),
}


def _parts(venue: OpenVenue, message: Column, market_type: Column, item: Column) -> Column:
    """The parts of a trade, and the whole item."""
    parts = {part: getattr(venue, part)(item, message, market_type) for part in ("symbol", "trade_id", "price", "quantity", "side", "ts_ms")}
    return F.struct(*(column.alias(part) for part, column in parts.items()), item.alias("item"))


def decode_open(raw_messages: DataFrame, venues: dict[str, OpenVenue] | None = None) -> DataFrame:
    """All venues' messages as trades with ``item`` and ``message`` as ``VARIANT``, ``raw``, and ``reject`` (null for trades)."""
    venues = venues or OPEN_VENUES
    kind = F.col("market_type")
    nothing = F.lit(None).cast("array<struct<symbol:string,trade_id:string,price:string,quantity:string,side:string,ts_ms:bigint,item:variant>>")

    def read(m: Column) -> Column:
        """A parsed message with its trades, taken by the paths of its venue; the other venues' are not looked at."""
        known, items = F.lit(False), nothing
        branches: list[tuple[Column, Column, Column]] = []
        for name, venue in venues.items():
            found = F.transform(venue.items(m), partial(_parts, venue, m, kind))
            branches.append((F.col("exchange") == name, F.coalesce(venue.is_trade(m, kind), F.lit(False)), found))
        for hit, good, found in branches:
            known = F.when(hit, good).otherwise(known)
            items = F.when(hit & good, found).otherwise(items)
        why = F.when(~F.coalesce(F.col("exchange").isin(*venues), F.lit(False)), "unknown venue").when(m.isNull(), "not JSON").when(~known, "not a trade")
        return F.struct(m.alias("message"), why.alias("why"), items.alias("items"))

    # The lambda binds the parsed message, so that it is parsed once however often its parts are taken.
    rows = raw_messages.select("exchange", "market_type", "raw", F.explode(F.transform(F.array(F.try_parse_json("raw")), read)).alias("r"))
    rows = rows.select("exchange", "market_type", "raw", "r.message", "r.why", F.explode_outer("r.items").alias("d"))
    missing = F.coalesce(F.col("why"), F.when(F.col("d").isNull(), "no data"))
    for part, reason in (("symbol", "no symbol"), ("price", "no price"), ("quantity", "no quantity")):
        missing = F.coalesce(missing, F.when(F.col(f"d.{part}").isNull() | (F.col(f"d.{part}") == ""), reason))
    missing = F.coalesce(missing, F.when(F.col("d.ts_ms").isNull(), "no time"))
    return rows.select("exchange", "market_type", "d.symbol", "d.trade_id", "d.price", "d.quantity", normalize_side(F.col("d.side")).alias("side"), "d.ts_ms", "d.item", "message", "raw", missing.alias("reject"))


def ingest_open(raw_messages: DataFrame, *, keep_item: bool = False, venues: dict[str, OpenVenue] | None = None) -> DataFrame:
    """Normalised trades of all venues, with the parsed item if asked for."""
    found = decode_open(raw_messages, venues).where("reject is null")
    found = found.withColumn("symbol", normalize_symbol(F.col("symbol")))
    return found.drop("message", "raw", "reject", *([] if keep_item else ["item"]))
