"""Pairs of trades and ranges, batch and stream: lists of ranges instead of a row per pair."""

import pytest
from pyspark.sql import functions as F

from tapewright.functions import symbols as S
from tapewright.operators import actors as A
from tapewright.operators import collect as J
from tapewright.operators import ranges as R
from tapewright.streaming import streams as Z

TRADE = "exchange string, market_type string, symbol string, trade_id string, ts_ms bigint"
PAIR = ("event_id", "trade_id", "ts_ms", "trigger_ms")


@pytest.fixture(scope="module")
def crowded(spark):
    """Sixty listings of a coin within three seconds, others of odd names and times, and trades of many spellings over two minutes."""
    marks = [(f"e{i}", "A", 60_000 + 50 * i) for i in range(60)] + [("s", "SA", 61_000), ("low", "a", 61_000), ("void", "", 61_000), ("none", None, 61_000), ("when", "A", None), ("dash", "A-", 40_000), ("A2", "A", 99_999)]
    names = ("AUSDT", "A-USDT", "a_usdt", "SAUSDT", "SSAUSDT", "A", "", None, "BUSDT", "USDT")
    rows = [("okx", "spot", names[i % len(names)], str(i), 30_000 + 61 * i) for i in range(1800)] + [("okx", "spot", "AUSDT", f"at{t}", t) for t in (39_999, 40_000, 80_000, 82_950, 82_951)]
    return spark.createDataFrame(marks, "event_id string, symbol string, trigger_ms bigint").cache(), spark.createDataFrame(rows, TRADE).cache()


def pairs(rows):
    return sorted(map(tuple, rows.select(*PAIR).collect()))


def by_hand(listings, trades):
    """The interval join as a condition, for small tables."""
    l, t = listings.withColumnRenamed("symbol", "base"), trades.withColumn("names", S.match_bases(F.col("symbol")))
    return pairs(t.join(l, F.expr("array_contains(names, base) and ts_ms between trigger_ms - 20000 and trigger_ms + 20000")))


def test_symbols_of_turns_match_bases_round(spark):
    names = ["A", "AUSDT", "A-USDT", "A_USDT", "A-", "SA", "SAUSDT", "SUSDT", "S", "USDT", "SSUSDT", "a", "aUSDT", "", "-", "-USDT", "A_-USDT", "ß", "SS", None]
    x = spark.createDataFrame([(n,) for n in names], "symbol string").crossJoin(spark.createDataFrame([(n,) for n in names], "base string"))
    for leading_s in (True, False):
        forth = F.array_contains(S.match_bases(F.col("symbol"), leading_s=leading_s), F.col("base"))
        back = F.array_contains(S.symbols_of(F.col("base"), leading_s=leading_s), F.upper("symbol"))
        assert x.where(F.coalesce(forth, F.lit(False)) != F.coalesce(back, F.lit(False))).collect() == []
        assert x.where(forth).count() > 20


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_joins_of_lists_give_every_pair(spark, crowded, broadcast, monkeypatch):
    listings, trades = crowded
    want = by_hand(listings, trades)
    assert len(want) > 20_000
    found = J.listing_trades(listings, trades, broadcast=broadcast)
    assert found.columns == [*trades.columns, "event_id", "trigger_ms"] and pairs(found) == want
    # Long lists are split, and where names are too many to be broadcast all trades are shuffled.
    monkeypatch.setattr(R, "LISTED", 7)
    monkeypatch.setattr(R, "BROADCAST_RANGES", 3)
    assert pairs(J.listing_trades(listings, trades, broadcast=broadcast)) == want
    ranges = listings.selectExpr("event_id", "symbol base", "trigger_ms - 20000 from_ms", "trigger_ms + 20000 to_ms")
    assert R.listed_ranges(ranges, on="base", width_ms=5_000).select(F.max(F.size("near"))).first()[0] < 30


def test_a_trade_meets_lists_not_listings(spark, crowded):
    """The join puts out a row for each trade and list; the listings of a list are gone through in place."""
    listings, trades = crowded
    ranges = listings.selectExpr("event_id", "symbol base", "trigger_ms - 20000 from_ms", "trigger_ms + 20000 to_ms")
    lists = R.listed_ranges(ranges, on="base", width_ms=5_000)
    assert lists.where("base = 'A'").count() <= 16 and lists.select(F.sum(F.size("near"))).first()[0] > 60 * 8
    for broadcast in (True, False):
        plan = J.listing_trades(listings, trades, broadcast=broadcast)._jdf.queryExecution().executedPlan().toString()
        assert "Generate inline(near" in plan


def test_shuffled_trades_are_those_of_listed_names_and_not_sorted(spark, crowded):
    """Each trade has up to three names, of which mostly one is listed: the others must not be written to disk."""
    listings, trades = crowded
    plan = J.listing_trades(listings, trades, broadcast=False)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_spans_of_actors_are_lists_too(spark, crowded):
    listings, trades = crowded
    spans = listings.selectExpr("event_id", "symbol base", "trigger_ms", "trigger_ms from_ms", "trigger_ms + 10000 to_ms", "trigger_ms first_pump_ms")
    found = A.span_trades(trades, spans)
    assert found.columns == [*trades.columns, "event_id", "trigger_ms", "first_pump_ms"]
    assert "Generate inline(near" in found._jdf.queryExecution().executedPlan().toString()
    assert pairs(found) == [p for p in by_hand(listings, trades) if p[3] <= p[2] <= p[3] + 10_000]


def test_stream_keeps_a_trade_once_and_listings_in_lists(spark, crowded, tmp_path):
    listings, trades = crowded
    streams = []
    for what, rows in (("listings", listings), ("trades", trades)):
        rows.write.parquet(str(tmp_path / what))
        streams.append(spark.readStream.schema(rows.schema).parquet(str(tmp_path / what)))
    found = Z.stream_listing_trades(*streams)
    assert found.columns == [*trades.columns, "event_id", "trigger_ms"]
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert pairs(spark.read.parquet(str(tmp_path / "out"))) == by_hand(listings, trades)
    # Before, a trade waited under each of its names, and a listing by itself in each of its buckets.
    kept = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert kept <= trades.count() + 5 * 3 * 30
