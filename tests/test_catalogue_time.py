"""Catalogues over time, market lists of titles with several coins, and what a feed observes."""

import pytest

from tapewright.operators.announcements import parse_listings_multi
from tapewright.operators.catalogue import trades_as_listed, validity_intervals
from tapewright.schemas import RAW_MESSAGES
from tapewright.sources.writers import export_tables_csv
from tapewright.streaming import streams as Z

SNAPSHOT = "taken_ms bigint, exchange string, market_type string, symbol string"
TRADE = "exchange string, market_type string, symbol string, ts_ms bigint, listing string"


def test_relisted_and_missing_days(spark):
    days = {1: "AB", 2: "A", 4: "AB", 5: "BC", 6: "C"}  # no snapshot on day 3: it says nothing
    rows = [(d, "okx", "spot", s) for d, symbols in days.items() for s in symbols] * 2 + [(1, "gate", "spot", "A"), (9, "gate", "spot", "A"), (None, "okx", "spot", "Z")]
    intervals = validity_intervals(spark.createDataFrame(rows, SNAPSHOT))
    want = {("okx", "A", 1, 5, 1), ("okx", "B", 1, 2, 1), ("okx", "B", 4, 6, 2), ("okx", "C", 5, None, 1), ("gate", "A", 1, None, 1)}
    assert {(r["exchange"], r["symbol"], r["from_ms"], r["until_ms"], r["listing"]) for r in intervals.collect()} == want and intervals.count() == 5
    times = [("okx", "spot", "B", t, "x") for t in (0, 1, 2, 3, 4, 5, 6)] + [("okx", "futures", "B", 1, "x"), ("okx", "spot", "C", 10**15, "x"), ("okx", "spot", None, 1, "x"), ("okx", "spot", "B", None, "x")]
    trades = spark.createDataFrame(times, TRADE).drop("listing")
    got = sorted((str(r["market_type"]), str(r["symbol"]), -1 if r["ts_ms"] is None else r["ts_ms"], r["listed_ms"], r["listing"]) for r in trades_as_listed(trades, intervals).collect())
    of_b = {0: (None, None), 1: (1, 1), 2: (None, None), 3: (None, None), 4: (4, 2), 5: (4, 2), 6: (None, None), -1: (None, None)}
    want = [("spot", "B", t, *of_b[t]) for t in of_b] + [("futures", "B", 1, None, None), ("spot", "C", 10**15, 5, 1), ("spot", "None", 1, None, None)]
    assert got == sorted(want)
    assert validity_intervals(spark.createDataFrame([], SNAPSHOT)).collect() == []


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("비체인(VET), 썬더코어(TT) (BTC USDT 마켓) 디지털 자산 추가", {"VET": ["BTC", "USDT"], "TT": ["BTC", "USDT"]}),
        ("코인(SYM)(KRW, BTC 마켓)", {"SYM": ["KRW", "BTC"]}),
        ("코인(SYM)(Krw BTC,USDT 마켓)", {"SYM": ["Krw", "BTC", "USDT"]}),
        ("봉크(BONK) KRW, USDT 마켓 디지털 자산 추가", {"BONK": ["KRW", "USDT"]}),
    ],
)
def test_markets_are_separated_by_commas_or_blanks(spark, title, want):
    rows = parse_listings_multi(spark.createDataFrame([(1, title)], "id bigint, title string")).collect()
    assert {r["symbol"]: r["markets"] for r in rows} == want


def test_a_feed_tells_updates_and_errors(spark, tmp_path):
    good = '{"e":"trade","E":1,"s":"ABUSDT","t":7,"p":"1.5","q":"2","T":1000,"m":true}'
    rows = [("binance", "spot", good, 1250), ("binance", "spot", good, 1100), ("binance", "spot", "{broken", 5), ("binance", "spot", '{"e":"kline"}', 5), ("nowhere", "spot", "{}", 5)]
    spark.createDataFrame(rows, RAW_MESSAGES).coalesce(1).write.json(f"{tmp_path}/raw")
    updates, errors = [], []
    listener = Z.FeedListener(on_update=lambda name, row: updates.append((name, row)), on_error=lambda _, error: errors.append(error))
    spark.streams.addListener(listener)
    try:
        raw = spark.readStream.schema(RAW_MESSAGES).json(f"{tmp_path}/raw")
        Z.stream_feed(raw, f"{tmp_path}/out", f"{tmp_path}/state", name="feed_of_test", interval=None).start().awaitTermination()
        assert listener.ended.wait(60)
        assert listener.observed["feed_of_test"] == {"trades": 2, "max_lag_ms": 250, "not JSON": 1, "not a trade": 1, "unknown venue": 1} | dict.fromkeys(("no data", "no symbol", "no price", "no quantity", "no time", "short item"), 0)
        assert updates and all(name == "feed_of_test" for name, _ in updates) and not errors
        out = spark.read.parquet(f"{tmp_path}/out")
        assert {(r["kind"], r["symbol"], r["raw"], r["reject"]) for r in out.collect()} == {
            ("trade", "ABUSDT", None, None), ("reject", None, "{broken", "not JSON"), ("reject", None, '{"e":"kline"}', "not a trade"), ("reject", None, "{}", "unknown venue"),
        }
        listener.ended.clear()
        failing = spark.readStream.schema(RAW_MESSAGES).json(f"{tmp_path}/raw").selectExpr("raise_error('gone wrong') as x")
        query = failing.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="gone wrong"):
            query.awaitTermination()
        assert listener.ended.wait(60) and len(errors) == 1 and "gone wrong" in errors[0]
    finally:
        spark.streams.removeListener(listener)


def test_exports_count_rows_and_not_lines(spark, tmp_path):
    tables = {"notes": spark.createDataFrame([(1, "two\nlines"), (2, 'a "quoted"\n\n line')], "id int, text string"), "none": spark.createDataFrame([], "id int"), "bad": spark.range(3).selectExpr("raise_error('no') as x")}
    rows = {r["table"]: (r["rows"], r["status"], r["run_status"]) for r in export_tables_csv(spark, tables, str(tmp_path)).collect()}
    assert rows == {"notes": (2, "success", "partial"), "none": (0, "success", "partial"), "bad": (0, "failed", "partial")}
