"""The ledger: failed, repeated and concurrent writes, compaction, and views kept by merging."""

import os
import random

import pytest

from tapewright.streaming import ledger as L

SCHEMA = "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint"
START = 1_704_067_200_000


def trades(spark, ids, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice(["okx", "gate"]), rng.choice(["spot", "futures"]), f"C{k % 3}", f"{k:05d}", str(k), "1", "buy", START + rng.randrange(10**6)) for k in ids]
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, path):
    return sorted(r["trade_id"] for r in L.read_stored(spark, path).collect())


def ids(*numbers):
    return sorted(f"{k:05d}" for part in numbers for k in part)


def test_a_batch_that_fails_and_comes_again_is_seen_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    ledger = L.Ledger(spark, path)
    assert stored(spark, path) == []
    assert L.write_batch(ledger, trades(spark, range(50)), "a", 0)
    # The data are written, then the driver fails before the entry is in place.
    monkeypatch.setattr(L.Ledger, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        L.write_batch(ledger, trades(spark, range(50, 90)), "a", 1)
    monkeypatch.undo()
    assert stored(spark, path) == ids(range(50)) and len(os.listdir(f"{path}/data")) == 2
    assert L.write_batch(ledger, trades(spark, range(50, 90)), "a", 1)
    assert not L.write_batch(ledger, trades(spark, range(50, 90)), "a", 1)  # after its commit it writes nothing
    assert stored(spark, path) == ids(range(90)) and len(os.listdir(f"{path}/data")) == 3
    # Another stream's batches of the same numbers are others.
    assert L.write_batch(ledger, trades(spark, range(200, 210)), "b", 1)
    assert stored(spark, path) == ids(range(90), range(200, 210))
    assert len(ledger.vacuum(grace_ms=0)) == 1 and ledger.vacuum() == []
    assert stored(spark, path) == ids(range(90), range(200, 210))


def test_empty_batches_and_rows_that_do_not_parse(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    assert L.write_batch(ledger, trades(spark, []), "a", 0) and stored(spark, str(tmp_path)) == []
    bad = trades(spark, [1]).selectExpr(*(c if c != "price" else "'x' as price" for c in trades(spark, [1]).columns))
    assert L.write_batch(ledger, bad.unionByName(trades(spark, [2])), "a", 1) and stored(spark, str(tmp_path)) == ids([2])
    assert L.compact(ledger, L.STORED) and stored(spark, str(tmp_path)) == ids([2])


def test_files_of_a_batch_are_bounded(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    L.write_batch(ledger, trades(spark, range(2500)).coalesce(1), "a", 0)
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "data") for f in names if f.endswith(".parquet")]
    assert max(spark.read.parquet(f).count() for f in files) <= 1000 and stored(spark, str(tmp_path)) == ids(range(2500))


def test_compaction_keeps_rows_and_only_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    ledger = L.Ledger(spark, path)
    for k in range(5):
        L.write_batch(ledger, trades(spark, range(10 * k, 10 * k + 10)), "a", k)
    reader = L.read_stored(spark, path)  # planned before the compaction
    commit = L.Ledger.commit

    def late(self, name, *rest):
        # Another compaction of the same state is committed while this one writes.
        monkeypatch.undo()
        assert L.compact(ledger, L.STORED)
        return commit(self, name, *rest)

    monkeypatch.setattr(L.Ledger, "commit", late)
    assert not L.compact(ledger, L.STORED)
    assert [e.rows for e in ledger.live()] == [50] and stored(spark, path) == ids(range(50)) and reader.count() == 50
    L.write_batch(ledger, trades(spark, range(50, 60)), "a", 5)
    assert L.compact(ledger, L.STORED) and [e.rows for e in ledger.live()] == [60]
    assert len(ledger.vacuum(grace_ms=0)) == 8 and stored(spark, path) == ids(range(60))
    assert not L.compact(ledger, L.STORED)
    # Batches keep their entries, so that a late repetition is still known.
    assert not L.write_batch(ledger, trades(spark, range(10)), "a", 0)


def test_a_view_equals_the_whole_however_it_is_split(spark, tmp_path):
    rows = trades(spark, range(300), seed=5).collect()
    whole = sorted(map(tuple, L.market_view(spark.createDataFrame(rows, SCHEMA)).collect()))
    for seed in (1, 2):
        rng = random.Random(seed)
        shuffled = rng.sample(rows, len(rows))  # late trades in any batch
        cuts = sorted(rng.sample(range(1, 300), 3))
        parts = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
        path = f"{tmp_path}/{seed}"
        ledger = L.Ledger(spark, path)
        for k, part in enumerate(parts):
            assert L.update_view(ledger, spark.createDataFrame(part, SCHEMA), "v", k)
            if k == 2:
                assert not L.update_view(ledger, spark.createDataFrame(parts[1], SCHEMA), "v", 1)  # repeated
        assert L.update_view(ledger, spark.createDataFrame([], SCHEMA), "v", 9)
        assert sorted(map(tuple, L.read_market_view(spark, path).collect())) == whole and len(ledger.live()) == 1
    totals = {r["exchange"]: r for r in L.feed_totals(L.read_market_view(spark, path), START + 10**6).collect()}
    assert totals[None]["spot_trades"] + totals[None]["futures_trades"] == 300 and totals[None]["active"] == sum(totals[e]["active"] for e in ("okx", "gate"))
