"""Messages as VARIANT: the same trades as the typed decoders, fields that nobody declared, and why messages are rejected."""

from pyspark.sql import functions as F

from tapewright.plans import fixtures as X
from tapewright.schemas import RAW_MESSAGES
from tapewright.sources import open_messages as O
from tapewright.sources import venues as V


def test_same_trades_as_the_typed_decoders(spark, data):
    raw = X.raw_messages(spark, data).unionByName(X.phemex_messages(spark, data))
    rows = lambda df: sorted(map(repr, map(tuple, df.select("exchange", "market_type", "symbol", "trade_id", "price", "quantity", "side", "ts_ms").collect())))
    got = rows(O.ingest_open(raw))
    assert got == rows(V.ingest_trades(raw)) and len({r.split(",")[0] for r in got}) == 6
    assert O.decode_open(raw).where("reject is not null").count() == V.rejected_messages(raw).count()


def test_fields_that_were_never_declared_are_kept(spark):
    raw = [
        ("okx", "spot", '{"arg":{"channel":"trades","instId":"AB-USDT"},"data":[{"instId":"AB-USDT","tradeId":"1","px":"2","sz":"3","side":"buy","ts":"1700000000000","count":"4","source":{"kind":"rfq"}}],"seq":[1,2]}', 0),
        # A known part of another type than before, beside the fields that are read.
        ("bybit", "spot", '{"topic":"publicTrade.AB","type":"snapshot","ts":"soon","cs":{"x":1},"data":[{"i":7,"s":"ABUSDT","p":1.5,"v":"2","S":"Sell","T":1700000000000,"BT":"no"},{"i":"8","s":"ABUSDT","p":"1.6","v":"2","S":"Buy","T":1700000000001}]}', 0),
    ]
    rows = O.ingest_open(spark.createDataFrame(raw, RAW_MESSAGES), keep_item=True)
    assert sorted((r["exchange"], r["trade_id"], r["price"], r["side"], r["ts_ms"]) for r in rows.collect()) == [("bybit", "7", "1.5", "sell", 1700000000000), ("bybit", "8", "1.6", "buy", 1700000000001), ("okx", "1", "2", "buy", 1700000000000)]
    okx = rows.where("exchange = 'okx'").select(O.at(F.col("item"), "$.count", "int"), O.at(F.col("item"), "$.source.kind"), O.at(F.col("item"), "$.none")).first()
    assert tuple(okx) == (4, "rfq", None)
    seq = O.decode_open(spark.createDataFrame(raw, RAW_MESSAGES)).where("exchange = 'okx'").select(O.at(F.col("message"), "$.seq", "array<int>")).first()[0]
    assert seq == [1, 2]


def test_why_messages_are_rejected(spark):
    cases = [
        ("okx", "{broken", "not JSON"), ("okx", None, "not JSON"), ("okx", "[1,2]", "not a trade"), ("okx", '"text"', "not a trade"), ("okx", "null", "not a trade"), ("binance", '{"e":"kline"}', "not a trade"), ("nowhere", "{}", "unknown venue"), (None, "{}", "unknown venue"),
        ("okx", '{"arg":{"channel":"trades"}}', "no data"), ("okx", '{"arg":{"channel":"trades"},"data":{"px":"1"}}', "no data"), ("okx", '{"arg":{"channel":"trades"},"data":[]}', "no data"), ("okx", '{"arg":{"channel":"trades"},"data":[{"px":"1","sz":"1","ts":"1"}]}', "no symbol"),
        ("okx", '{"arg":{"channel":"trades"},"data":[{"instId":"A","px":"","sz":"1","ts":"1"}]}', "no price"), ("okx", '{"arg":{"channel":"trades"},"data":[{"instId":"A","px":"1","ts":"1"}]}', "no quantity"), ("okx", '{"arg":{"channel":"trades"},"data":[{"instId":"A","px":"1","sz":"1","ts":"x"}]}', "no time"),
        ("phemex", '{"symbol":"A","sequence":1,"trades_p":[["1","Buy","2"]]}', "no quantity"),
    ]
    rows = O.decode_open(spark.createDataFrame([(e, "spot", raw, 0) for e, raw, _ in cases], RAW_MESSAGES)).select("exchange", "raw", "reject").collect()
    assert sorted(map(repr, ((r["exchange"], r["raw"], r["reject"]) for r in rows))) == sorted(map(repr, cases))


def test_another_venue_is_a_few_paths(spark):
    venue = O.OPEN_VENUES["okx"]._replace(is_trade=lambda m, _: O.at(m, "$.kind") == "deal", items=lambda m: O.at(m, "$.deals", "array<variant>"), symbol=lambda i, m, _: O.at(m, "$.pair"))
    raw = [("mirror", "spot", '{"kind":"deal","pair":"AB_USDT","deals":[{"tradeId":5,"px":"1","sz":"2","side":"SELL","ts":"1700000000000"}]}', 0)]
    rows = O.ingest_open(spark.createDataFrame(raw, RAW_MESSAGES), venues={"mirror": venue}).collect()
    assert [(r["symbol"], r["trade_id"], r["side"], r["ts_ms"]) for r in rows] == [("ABUSDT", "5", "sell", 1700000000000)]
