"""Schemas of the tables that operators exchange, as DDL."""

from __future__ import annotations

TRADES = "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint, collected_at_ms bigint"
LISTINGS = "event_id string, title string, symbol string, markets array<string>, announced_ms bigint, detected_ms bigint, trigger_ms bigint, notice_url string, is_krw boolean"
RAW_MESSAGES = "exchange string, market_type string, raw string, received_ms bigint"
API_CALLS = "node string, ts_ms bigint, response_ms double, status int, success boolean, error string, cpu double, memory_mb bigint, new_listing boolean"
NOTICES_JSON = (
    "struct<success:boolean,data:struct<notices:array<struct<id:bigint,title:string,listed_at:string,first_listed_at:string,category:string,"
    "need_new_badge:boolean,need_update_badge:boolean>>>>"
)
#: Venues and market types in the order that breaks ties.
VENUES = ("binance", "bybit", "okx", "kucoin", "phemex", "gate")
MARKET_TYPES = ("spot", "futures")
