"""Ranges of shared windows and actors against the join of every listing with its trades."""

import random

import pytest

from tapewright.operators import actors as A
from tapewright.operators import collect as J
from tapewright.operators import pumps as W
from tapewright.plans import registered

KEYS = ("event_id", "trigger_ms", *W.MARKET)


@pytest.fixture(scope="module")
def tables(spark):
    deal = random.Random(3)
    venues, kinds, symbols = ("binance", "okx", "gate"), ("spot", "futures"), ("AUSDT", "A-USDT", "SBUSDT", "B")
    rows = [(deal.choice(venues), deal.choice(kinds), deal.choice(symbols), str(i), deal.choice(("100", "104", "x", "99.5")), deal.choice(("1", "2", None)), 50_000 + deal.randrange(9_000)) for i in range(900)]
    trades = spark.createDataFrame(rows, "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, ts_ms bigint")
    marks = [("e1", "A", 53_000), ("e2", "A", 53_457), ("e3", "B", 54_999), ("e4", "SB", 50_001), ("e5", "C", 53_000), ("e6", "A", 70_000), ("e7", "B", None), ("e8", "A", 53_457)]
    return spark.createDataFrame(marks, "event_id string, symbol string, trigger_ms bigint").cache(), trades.cache()


def same(got, want):
    columns = sorted(want.columns)
    rows = [sorted((tuple(r[c] for c in columns) for r in x.collect()), key=repr) for x in (got.select(*columns), want.select(*columns))]
    assert rows[0] == rows[1]
    return len(rows[0])


@pytest.mark.parametrize(("pre", "post"), [(2_000, 2_000), (300, 700), (0, 1_500), (1_234, 567)])
def test_windows_of_listings_without_their_trades(tables, pre, post):
    listings, trades = tables
    want = W.pump_windows(J.listing_trades(listings, trades, pre_ms=pre, post_ms=post), keys=KEYS)
    assert same(W.event_windows(listings, trades, pre_ms=pre, post_ms=post).drop("first_ms", "last_ms"), want) > 20
    same(J.window_stats(W.event_windows(listings, trades, pre_ms=pre, post_ms=post)), J.collection_stats(J.listing_trades(listings, trades, pre_ms=pre, post_ms=post)))


def test_actors_of_coins(tables):
    listings, trades = tables
    cut = {"pre_ms": 2_000, "post_ms": 2_000}
    joined = J.listing_trades(listings, trades, **cut)
    pumps = W.detect_pumps(joined, keys=KEYS, min_trades=3).cache()
    want = A.actors(A.actor_window_trades(joined, pumps, span_ms=1_500)).cache()
    found = A.coin_actors(listings, trades).cache()
    spans = A.actor_spans(listings, pumps, span_ms=1_500, **cut).cache()
    text = "cast(map_entries(exchange_trades) as string) as markets"
    assert same(A.placed(found, spans).selectExpr("* except (exchange_trades)", text), want.selectExpr("* except (exchange_trades)", text)) > 100
    of = lambda rows: rows.select("event_id", "actor_id", "rank")
    same(of(A.event_ranks(found, spans)), of(A.rank_actors(want)))
    same(of(A.event_top_actors(found, spans, 4)), of(A.top_actors(want, 4)))
    same(A.event_insights(pumps, found, spans), A.exchange_insights(pumps, want))
    same(A.event_behaviour(found, spans), A.actor_behaviour(want))
    same(A.event_exchange_report(pumps, found, spans), A.per_exchange_report(pumps, want))


def test_pumps_and_actors_of_one_reading(tables):
    """What events have of pumps and of each exchange's actors, from one table of a market's trades by time."""
    listings, trades = tables
    cut = {"pre_ms": 1_234, "post_ms": 2_567}
    joined = J.listing_trades(listings, trades, **cut)
    ticks = W.market_ticks(trades).cache()
    want_pumps = W.detect_pumps(joined, keys=KEYS, min_trades=3).cache()
    pumps = W.event_pumps(listings, ticks, min_trades=3, **cut).cache()
    assert pumps.columns == want_pumps.columns and same(pumps, want_pumps) > 20
    want = A.actors(A.actor_window_trades(joined, want_pumps, span_ms=1_500)).cache()
    totals = A.pump_totals(pumps).cache()
    spans = A.actor_spans(listings, totals, span_ms=1_500, **cut).cache()
    actors = A.exchange_ticks(A.coin_totals(listings, ticks)).cache()
    own = A.event_exchanges(actors, spans).cache()
    assert same(A.insights_of(totals, own.drop("nth")), A.exchange_insights(want_pumps, want)) > 10
    same(A.behaviour_of(actors, own), A.actor_behaviour(want))
    same(A.report_of(totals, actors, own, 3), A.per_exchange_report(want_pumps, want, 3))


@pytest.mark.parametrize("name", ["a06_exchange_insights", "a07_actor_behaviour", "a08_exchange_comparison", "a09_per_exchange_report"])
def test_exchange_reports_read_trades_once(spark, data, monkeypatch, name):
    calls, trades = [], registered.X.trades
    monkeypatch.setattr(registered.X, "trades", lambda s, d: calls.append(d) or trades(s, d))
    assert "event_id" in registered.queries()[name](spark, data).columns and len(calls) == 1


def test_listings_that_share_an_id_are_joined(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.unionByName(events.where("event_id % 400 = 0")).write.parquet(f"{tmp_path}/events.parquet")
    want = J.collection_stats(registered._lt(spark, str(tmp_path)))
    assert same(registered.queries()["a12_collection_stats"](spark, str(tmp_path)), want) > 0
