"""Hand-written rows for functions, decoders, operators and their documented quirks."""

import datetime
import random

import pytest
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
from tapewright.schemas import RAW_MESSAGES
from tapewright.sources import readers as R
from tapewright.sources import venues as V
from tapewright.sources import writers as K


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_strict_double(spark):
    assert values(spark, N.strict_double(F.col("x")), ["1.5", "-2", ".5", "1e3", "NaN", "1.5d", " 1", "Infinity", "1e999", "", None]) == [1.5, -2.0, 0.5, 1000.0, None, None, None, None, None, None, None]
    assert values(spark, N.strict_double(F.col("x"), 0), ["x", "2"]) == [0.0, 2.0]


def test_times(spark):
    assert values(spark, N.to_millis(F.col("x")), [1704067346546123456, 1704067346546], "x bigint") == [1704067346546, 1704067346546]
    assert values(spark, N.relative_seconds(F.col("x"), F.lit(0)), [-1999, -1000, 999, 1000], "x bigint") == [-1, -1, 0, 1]
    assert values(spark, N.time_window_label(F.col("x")), [-15, -10, -5, 0, 1], "x bigint") == ["early", "mid", "late", "final", "post"]
    forms = ["2024-01-02T03:04:05+09:00", "2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04", "2024-01-02", "nonsense"]
    got = values(spark, N.parse_notice_time(F.col("x")).cast("string"), forms)
    assert got == ["2024-01-01 18:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 00:00:00", None]
    assert values(spark, N.pct_change(F.lit(0.0), F.lit(5.0)), ["a"]) == [0.0]
    assert values(spark, N.spread_pct(F.lit(100.0), F.lit(100.5)), ["a"]) == [0.5]


def test_symbols(spark):
    pairs = [("okx", "BTC-USDT-SWAP"), ("kucoin", "XBTUSDTM"), ("phemex", "sBTCUSDT"), ("phemex", "BTCUSD"), ("gate", "BTC_USDT"), ("binance", "btcusdt")]
    assert values(spark, S.normalize_symbol_by_venue(F.col("v"), F.col("x")), pairs, "v string, x string") == ["BTCUSDT"] * 6
    # The plain normaliser leaves contract suffixes on, so such trades match no target.
    assert values(spark, S.normalize_symbol(F.col("x")), ["BTC-USDT-SWAP"]) == ["BTCUSDTSWAP"]
    assert values(spark, S.base_symbol(F.col("x")), ["BTC-USDT", "BTC_USDT", "ETHUSDT", "XRPBTC", "SOMIUSDTM", "ABC"]) == ["BTC", "BTC", "ETH", "XRP", "SOMIUSDTM", "ABC"]
    got = values(spark, S.base_quote(F.col("x")), ["BTCUSDT", "ABCEUR", "XYZABC", "AB"])
    assert [tuple(r) for r in got] == [("BTC", "USDT"), ("ABC", "EUR"), ("XYZ", "ABC"), ("AB", "")]
    assert values(spark, S.match_bases(F.col("x")), ["SOMIUSDT"]) == [["SOMIUSDT", "SOMI", "OMI"]]
    assert values(spark, S.match_bases(F.col("x"), leading_s=False), ["SOMIUSDT"]) == [["SOMIUSDT", "SOMI"]]
    assert values(spark, S.is_valid_symbol(F.col("x")), ["AB", "A", "ABCDEFGHIJK", "ab"]) == [True, False, False, False]


def test_errors(spark):
    messages = ["Permission denied", "i/o timeout", "odd", "readMessage panic: out of memory", "Out of memory", "connection reset"]
    assert values(spark, E.classify_db_error(F.col("x")), messages) == ["fatal", "temporary", "retryable", "retryable", "retryable", "temporary"]
    assert values(spark, E.classify_feed_error(F.col("x")), messages) == ["recoverable", "recoverable", "recoverable", "recoverable", "fatal", "recoverable"]


@pytest.mark.parametrize(
    "venue, raw, want",
    [
        ("binance", '{"e":"trade","E":1,"s":"SYM0USDT","t":7,"p":"1.0","q":"2","T":1704067200000,"m":true}', ("SYM0USDT", "7", "1.0", "2", "buy", 1704067200000)),
        ("bybit", '{"topic":"publicTrade.SYM0USDT","type":"snapshot","ts":1,"data":[{"i":"7","s":"SYM0USDT","p":"1.0","v":"2","S":"Buy","T":1704067200000,"seq":1,"BT":false}]}', ("SYM0USDT", "7", "1.0", "2", "buy", 1704067200000)),
        ("okx", '{"arg":{"channel":"trades","instId":"SYM0-USDT"},"data":[{"instId":"SYM0-USDT","tradeId":"7","px":"1.0","sz":"2","side":"buy","ts":"1704067200000"}]}', ("SYM0USDT", "7", "1.0", "2", "buy", 1704067200000)),
        ("kucoin", '{"type":"message","topic":"/market/match:SYM0-USDT","subject":"trade.l3match","data":{"symbol":"SYM0-USDT","price":"1.0","size":"2","side":"buy","tradeId":"7","time":"1704067200000000000"}}', ("SYM0USDT", "7", "1.0", "2", "buy", 1704067200000)),
        ("gate", '{"time":1,"channel":"spot.trades","event":"update","result":{"id":7,"create_time":1704067200,"create_time_ms":"1704067200000.02","side":"buy","currency_pair":"SYM0_USDT","amount":"2","price":"1.0"}}', ("SYM0USDT", "7", "1.0", "2", "buy", 1704067200000)),
        ("phemex", '{"symbol":"SYM0USDT","sequence":5,"type":"incremental","trades_p":[[1704067200000000000,"Buy","1.0","2"]]}', ("SYM0USDT", "5_1704067200000000000", "1.0", "2", "buy", 1704067200000)),
    ],
)
def test_decoders(spark, venue, raw, want):
    bad = ['{"result":null,"id":1}', "{broken", '{"success":true,"op":"subscribe"}', '{"event":"pong"}', "", None]
    rows = spark.createDataFrame([(venue, "spot", m, 0) for m in [raw, *bad]], RAW_MESSAGES)
    assert [tuple(r)[2:] for r in V.ingest_trades(rows).collect()] == [want]
    assert V.rejected_messages(rows).count() == len(bad)


def test_decoder_options(spark):
    raw = spark.createDataFrame([("binance", "spot", '{"e":"trade","s":"A","t":1,"p":"1","q":"1","T":1,"m":true}', 0), ("moon", "spot", "{}", 0), ("phemex", "spot", '{"symbol":"A","sequence":1,"trades_p":[["1","Buy","2"]]}', 0)], RAW_MESSAGES)
    taker = {"binance": lambda m, kind: V.decode_binance(m, kind, taker_side=True)}
    assert [r["side"] for r in V.ingest_trades(raw, decoders=taker).collect()] == ["sell"]
    assert {(r["exchange"], r["reject"]) for r in V.rejected_messages(raw).collect()} == {("moon", "unknown venue"), ("phemex", "short item")}


TITLES = {
    "셀레스티아(TIA)(KRW, BTC, USDT 마켓)": ("TIA", ["KRW", "BTC", "USDT"], True, ["TIA"]),
    "비체인(VET), 알고랜드(ALGO) (BTC, USDT 마켓)": ("ALGO", ["BTC", "USDT"], False, ["VET", "ALGO"]),
    "썬더코어(TT), 카바(KAVA) KRW 마켓": ("KAVA", ["KRW"], True, ["TT", "KAVA"]),
    "봉크(BONK) KRW 마켓": ("BONK", ["KRW"], True, ["BONK"]),
    "KRW 마켓 디지털 자산 추가 (WAXP, CARV)": ("WAXP", ["KRW"], True, ["WAXP", "CARV"]),
    "USDT 마켓 디지털 자산 추가 (AGLD, AHT, , ...)": ("AGLD", ["USDT"], False, ["AGLD", "AHT"]),
    "셀레스티아(TIA)(krw, Btc 마켓)": ("TIA", ["KRW", "BTC"], True, ["TIA"]),
}


@pytest.mark.parametrize("title", TITLES)
def test_titles(spark, title):
    rows = spark.createDataFrame([(1, title), (2, "no listing"), (3, None)], "id bigint, title string")
    symbol, markets, krw, every = TITLES[title]
    assert [(r["symbol"], r["markets"], r["is_krw"]) for r in P.parse_listings(rows).collect()] == [(symbol, markets, krw)]
    assert [r["symbol"] for r in P.parse_listings_multi(rows).collect()] == every


def trades(spark, rows):
    return spark.createDataFrame(rows, "event_id string, exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint, trigger_ms bigint")


def burst(prices, *, exchange="binance", market="spot", at=10_000, event="e", trigger=10_000):
    return [(event, exchange, market, "AUSDT", f"{exchange}{market}{at}{i}", p, "1", "buy", at + 10 * i, trigger) for i, p in enumerate(prices)]


def test_pump_rules(spark):
    good = burst(["100", "101", "103", "102", "100"])
    found = W.detect_pumps(trades(spark, good)).collect()
    assert [(r["start_ms"], r["price_change"], r["trade_count"]) for r in found] == [(10_000, 3.0, 5)]
    assert W.detect_pumps(trades(spark, good[:4])).count() == 0
    # A row whose price is no number counts, but sets no price; a price of 0 or less spoils its window.
    assert W.detect_pumps(trades(spark, burst(["100", "x", "103", "102", "100"]))).first()["trade_count"] == 5
    assert W.detect_pumps(trades(spark, burst(["100", "0", "103", "102", "100"]))).count() == 0
    # A fall of 3 % counts too, unless the direction is asked for.
    fall = burst(["103", "102", "101", "100", "100"])
    assert W.detect_pumps(trades(spark, fall)).count() == 1
    assert W.detect_pumps(trades(spark, fall), directional=True).count() == 0
    # The first of two markets that pump at once is the one that comes first in the fixed order.
    both = W.detect_pumps(trades(spark, good + burst(["100", "101", "104", "102", "100"], exchange="bybit", market="futures")), keys=W.EVENT_MARKET)
    summary = W.pump_summary(both).first()
    assert (summary["markets_with_pumps"], summary["first_market"], summary["max_change"], summary["duration_ms"]) == (2, "binance_spot", 4.0, 1000)


def test_actors_and_exchanges(spark):
    rows = trades(spark, burst(["100", "101", "103", "102", "100"]) + burst(["100"] * 5, exchange="okx") + burst(["1"], exchange="gate", at=25_000))
    pumps = W.detect_pumps(rows, keys=("event_id", "trigger_ms", *W.MARKET))
    window = A.actor_window_trades(rows, pumps)
    assert window.count() == 10  # both ends of ten seconds, the trade at 25 s is outside
    found = A.actors(window)
    first = A.rank_actors(found).where("rank = 1").first()
    assert (first["actor_id"], first["trade_count"], first["exchange_trades"], first["notional"], first["start_price"], first["relative_ms"]) == ("user_10000", 2, {"binance_spot": 1, "okx_spot": 1}, 200.0, 100.0, 0)
    insights = A.exchange_insights(pumps, found)
    by = {r["exchange"]: r for r in insights.collect()}
    # An actor's whole notional counts for every exchange it touched.
    assert by["binance"]["actor_volume"] == by["okx"]["actor_volume"] == 1006.0
    comparison = A.exchange_comparison(insights).first()
    assert (comparison["fastest"], comparison["ranking"], comparison["spread_ms"]) == ("binance", "binance", 0)
    assert A.top_actors(found, 2).count() == 2


def test_interval_join(spark):
    listing = spark.createDataFrame([("e1", "A", 50_000, 50_500), ("e2", "OMI", 50_000, 50_500)], "event_id string, symbol string, trigger_ms bigint, detected_ms bigint")
    rows = trades(spark, [(None, "okx", "spot", "AUSDT", str(i), "1", "1", "buy", 50_000 + 1000 * i, None) for i in range(-25, 26)] + [(None, "okx", "spot", "SOMIUSDT", "s", "1", "1", "buy", 50_000, None)]).drop("event_id", "trigger_ms")
    for broadcast in (True, False, None):
        found = J.listing_trades(listing, rows, broadcast=broadcast)
        assert {r["event_id"]: r["n"] for r in found.groupBy("event_id").agg(F.count("*").alias("n")).collect()} == {"e1": 41, "e2": 1}
    assert J.listing_trades(listing, rows, leading_s=False).where("event_id = 'e2'").count() == 0
    plan = J.listing_trades(listing, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("broadcast", [True, False])
def test_interval_join_deals_one_files_trades(spark, broadcast):
    """Trades that lie in one part, of one coin and within one interval, meet their listings in many tasks."""
    listing = spark.createDataFrame([(f"e{i}", "A", 50_000 + i, None) for i in range(50)], "event_id string, symbol string, trigger_ms bigint, detected_ms bigint")
    rows = trades(spark, [(None, "okx", "spot", "AUSDT", str(i), "1", "1", "buy", 41_000 + 30 * i, None) for i in range(600)]).drop("event_id", "trigger_ms").coalesce(1)
    found = J.listing_trades(listing, rows, broadcast=broadcast).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in found) == 600 * 50
    assert len(found) >= 6 and max(r["n"] for r in found) < 600 * 50 / 3


def test_catalogue(spark):
    rows = spark.createDataFrame([("kucoin", "futures", "BTCUSDTM"), ("binance", "spot", "BTCUSDT"), ("okx", "spot", "ETH-USDT")], "exchange string, market_type string, symbol string")
    home = spark.createDataFrame([("BTC",)], "base string")
    # A contract name with an M at its end keeps it, so it is never excluded.
    assert {r["symbol"] for r in C.subscription_list(rows, home).collect()} == {"BTCUSDTM", "ETH-USDT"}
    many = spark.createDataFrame([("a", "spot", f"S{i:02}") for i in range(10)], "exchange string, market_type string, symbol string")
    assert [r["count"] for r in C.split_even(many, 4).groupBy("chunk").count().orderBy("chunk").collect()] == [3, 3, 2, 2]
    assert [r["count"] for r in C.split_fixed(many, 3, 3).groupBy("chunk").count().orderBy("chunk").collect()] == [3, 3, 3]


def test_monitoring(spark):
    rows = [("n", i, 1000 * i, 100.0, 200, ok, 10.0, 100, False) for i, ok in enumerate([True, False, False, True, False])]
    calls = spark.createDataFrame(rows, "node string, call_id bigint, ts_ms bigint, response_ms double, status int, success boolean, cpu double, memory_mb bigint, new_listing boolean")
    assert [r["streak"] for r in M.failure_streak(calls).orderBy("call_id").collect()] == [0, 1, 2, 0, 1]
    assert [r["success_1m"] for r in M.rolling_success(calls).orderBy("call_id").collect()] == [100.0, 50.0, 33.3333, 50.0, 40.0]
    # Streaks and rates go on across hours, also over hours without a success or without a call.
    late = [(0, True), (1, False), (3_599_999, False), (3_600_000, False), (3_700_000, False), (7_300_000, False), (18_000_000, False), (18_000_001, True), (18_000_002, False)]
    hours = spark.createDataFrame([("n", k, at, 1.0, 200, ok, 1.0, 1, False) for k, (at, ok) in enumerate(late)], calls.schema)
    assert [r["streak"] for r in M.failure_streak(hours).orderBy("call_id").collect()] == [0, 1, 2, 3, 4, 5, 6, 0, 1]
    want = [round(100.0 * sum(o for a, o in late if at - 3_600_000 < a <= at) / sum(at - 3_600_000 < a <= at for a, _ in late), 4) for at, _ in late]
    assert [r["success_1h"] for r in M.rolling_success(hours).orderBy("call_id").collect()] == want
    assert M.rolling_success(calls, include_current=False).orderBy("call_id").first()["success_1m"] == 100.0
    assert M.performance_score(M.service_state(calls)).first()["score"] == 70
    assert M.recent_trades(trades(spark, burst(["1"] * 3)), 0).count() == 3


@pytest.mark.parametrize("current", [True, False])
def test_rolling_success_against_plain_counts(spark, current):
    """Bursts, ties, calls at the bounds of minutes and horizons, a busy node, null nodes and unknown success."""
    rng = random.Random(41)
    times = [rng.randrange(4) * 3_600_000 + rng.choice([0, 59_999, 60_000, 299_999, 300_000, 300_001, rng.randrange(3_600_000)]) for _ in range(400)]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), t, rng.choice([True, False, True, None])) for i, t in enumerate(times)]
    calls = spark.createDataFrame(rows, "call_id int, node string, ts_ms bigint, success boolean")
    got = {r["call_id"]: (r["success_1m"], r["success_5m"], r["success_1h"]) for r in M.rolling_success(calls, include_current=current).collect()}

    def rate(node, at, width):
        seen = [bool(s) for _, n, t, s in rows if n == node and at - width < t and (t <= at if current else t < at)]
        return round(100.0 * sum(seen) / len(seen), 4) if seen else 100.0

    want = {i: tuple(rate(n, t, w) for w in (60_000, 300_000, 3_600_000)) for i, n, t, _ in rows}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-3 for i in want for x, y in zip(got[i], want[i], strict=True))



def test_delays(spark):
    rows = [("n", i, 0, 1000 * ((7 * i) % 13), i) for i in range(300)] + [("m", 0, 0, 301_000, 0), ("m", 1, 0, 700_000, 1), ("m", 2, 0, 700_000, 2), ("m", 3, 0, 1, 3)]
    notices = spark.createDataFrame(rows, "node string, id bigint, announced_ms bigint, detected_ms bigint, processed_ms bigint")
    want = {}
    for node, _, _, x, _ in rows:
        want[node] = x if node not in want else (want[node] + x) / 2
    assert {r["node"]: (r["ewma_ms"], r["n"]) for r in P.ewma_delay(notices).collect()} == {"n": (round(want["n"], 4), 300), "m": (round(want["m"], 4), 4)}
    # Two of three slow notices are very slow: 0.67. Seven of ten are not over 0.7, eight are.
    assert {r["node"]: r["likely_cause"] for r in P.detection_delay_stats(notices).collect()} == {"n": "none", "m": "sporadic"}
    for very, cause in ((7, "sporadic"), (8, "systematic")):
        ten = spark.createDataFrame([("n", i, 0, 700_000 if i < very else 400_000, i) for i in range(10)], notices.schema)
        assert P.detection_delay_stats(ten).first()["likely_cause"] == cause


def test_symbol_lists(spark):
    rows = spark.createDataFrame([('{"okx":{"spot":["A-USDT","B-USDT"],"futures":[]}}',), ("{broken",), (None,)], "value string")
    assert {tuple(r) for r in R.parse_symbol_lists(rows).collect()} == {("okx", "spot", "A-USDT"), ("okx", "spot", "B-USDT")}


def test_stored(spark, tmp_path):
    rows = trades(spark, burst(["1", "x", "2"]) + burst(["5"], at=86_400_000 * 40)).drop("event_id")
    K.write_trades(rows, str(tmp_path / "t"))
    assert R.read_trades(spark, str(tmp_path / "t"), 0, 86_400_000).count() == 2  # the row that does not parse is left out
    assert K.apply_retention(spark, str(tmp_path / "t"), 86_400_000 * 41) == ["1970-01-01"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    days = spark.createDataFrame([(datetime.date(2024, 1, k),) for k in range(1, 31)], "dt date")
    now = 1706572800000  # 30 January
    assert K.expired_partitions(days, now).count() == 0 and K.expired_partitions(days, now, usage=90.0).count() == 4
    result = K.export_tables_csv(spark, {"good": rows.drop("trigger_ms"), "bad": rows.select(F.array("price"))}, str(tmp_path / "csv")).collect()
    assert {(r["table"], r["status"], r["run_status"]) for r in result} == {("good", "success", "partial"), ("bad", "failed", "partial")}
    event = tmp_path / "files" / "ABC_20240101_000000" / "raw" / "okx"
    event.mkdir(parents=True)
    (event / "spot.json").write_text('[{"price":"1","ts_ms":5},{"price":"2","ts_ms":6}]')
    assert [(r["event_key"], r["file_exchange"], r["price"]) for r in R.read_event_files(spark, str(tmp_path / "files")).orderBy("price").collect()] == [("ABC_20240101_000000", "okx", "1"), ("ABC_20240101_000000", "okx", "2")]


def test_registry(spark):
    registry.register_analyzer("count", lambda t, least=0: t.groupBy("exchange").count().where(F.col("count") >= least))
    assert registry.analyze(trades(spark, burst(["1", "2"])), "count", least=2).first()["count"] == 2
    registry.register_decoder("moon", V.decode_okx)
    assert "moon" in V.DECODERS
    del V.DECODERS["moon"]


def test_invariants(spark, data):
    t = X.trades(spark, data)
    windows = W.pump_windows(t)
    assert windows.agg(F.sum("trade_count")).first()[0] == t.count()
    assert W.detect_pumps(t, min_trades=2).count() <= windows.count()


def test_empty(spark):
    none = trades(spark, [])
    assert W.detect_pumps(none).count() == 0 and W.market_results(none).count() == 0
    assert A.actors(A.actor_window_trades(none, W.detect_pumps(none, keys=W.EVENT_MARKET))).count() == 0
    assert V.ingest_trades(spark.createDataFrame([], RAW_MESSAGES)).count() == 0
