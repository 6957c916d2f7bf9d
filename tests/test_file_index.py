"""Point and range reads by the file index: which files are planned, false hits, new and vanished files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tapewright.sources import file_index as FI
from tapewright.sources import writers as K

SCHEMA = "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint"
DAY = 86_400_000
START = 1_704_067_200_000


@pytest.fixture(scope="module")
def given():
    """Six hours of trades over two days, 40 symbols."""
    rng = random.Random(1)
    return [("okx", "spot", f"C{rng.randrange(40)}USDT", f"t{k}", "1.5", "2", "buy", START + DAY - 3 * 3_600_000 + k * 3_600) for k in range(6_000)]


@pytest.fixture(scope="module")
def stored(spark, given, tmp_path_factory):
    """Written in six parts, as a feed would, the index following each."""
    top = str(tmp_path_factory.mktemp("indexed"))
    added = []
    for k in range(6):
        part = spark.createDataFrame(given[k * 1000 : (k + 1) * 1000], SCHEMA)
        K.trade_rows(part).repartition(12, "symbol").write.mode("append").partitionBy("dt").parquet(f"{top}/trades")
        added.append(FI.update_index(spark, f"{top}/trades", f"{top}/index"))
    return f"{top}/trades", f"{top}/index", added


def parquet_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def scanned(df):
    """Files that the scan of an executed plan has read, by its metrics."""
    df._jdf.queryExecution().toRdd().count()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numFiles").value()


def test_a_range_reads_the_files_that_hold_it(spark, given, stored):
    path, index, added = stored
    files = parquet_files(path)
    assert sum(added) == len(files) > 50 and FI.update_index(spark, path, index) == 0
    at = given[2500][7]
    for symbol in ("C7USDT", "C31USDT"):
        rows = FI.read_indexed(spark, path, index, from_ms=at - 20_000, to_ms=at + 20_000, symbol=symbol)
        want = {g[3] for g in given if g[2] == symbol and abs(g[7] - at) <= 20_000}
        assert {r["trade_id"] for r in rows.collect()} == want
        named = {r["file"] for r in FI.candidate_files(spark, index, from_ms=at - 20_000, to_ms=at + 20_000, symbol=symbol).collect()}
        holding = {f"file://{f}" for f in files if spark.read.parquet(f).where((F.col("symbol") == symbol) & F.col("ts_ms").between(at - 20_000, at + 20_000)).count()}
        # A file of the symbol and the hour may hold no trade of the seconds asked for.
        assert holding <= named and len(named) <= 2
        assert scanned(rows) == len(rows.inputFiles()) == len(named)
    wide = FI.read_indexed(spark, path, index, from_ms=at - 600_000, to_ms=at + 600_000)
    assert {r["trade_id"] for r in wide.collect()} == {g[3] for g in given if abs(g[7] - at) <= 600_000}
    assert scanned(wide) <= len(files) / 4


def test_a_trade_is_found_by_its_id(spark, given, stored):
    path, index, _ = stored
    for k in (0, 17, 5999):
        rows = FI.read_indexed(spark, path, index, trade_id=given[k][3])
        assert [r["ts_ms"] for r in rows.collect()] == [given[k][7]]
        # One file holds it; a false hit or two among a hundred files may be opened beside it.
        assert scanned(rows) <= 5
    missing = [FI.candidate_files(spark, index, trade_id=f"none{k}").count() for k in range(6)]
    assert sum(missing) <= 0.04 * 6 * len(parquet_files(path))
    assert FI.read_indexed(spark, path, index, trade_id="none1", symbol="C1USDT").collect() == []
    assert FI.read_indexed(spark, path, index, from_ms=0, to_ms=1).columns == spark.read.parquet(path).columns


def test_more_files_than_names_are_read_by_partition(spark, given, stored):
    path, index, _ = stored
    rows = FI.read_indexed(spark, path, index, from_ms=START, to_ms=START + DAY - 1, most_files=3)
    assert {r["trade_id"] for r in rows.collect()} == {g[3] for g in given if g[7] < START + DAY}


def test_vanished_files_and_rows_without_values(spark, tmp_path):
    path, index = f"{tmp_path}/trades", f"{tmp_path}/index"
    rows = [("okx", "spot", s, i, "1", "1", "buy", START) for s, i in (("A", "1"), (None, "2"), ("B", None))]
    K.write_trades(spark.createDataFrame(rows[:2], SCHEMA), path)
    assert FI.update_index(spark, path, index) == len(parquet_files(path))
    for old in parquet_files(path):
        os.remove(old)
    K.write_trades(spark.createDataFrame(rows[1:], SCHEMA), path)
    assert FI.update_index(spark, path, index) == len(parquet_files(path))
    named = {r["file"] for r in FI.candidate_files(spark, index).collect()}
    assert named == {f"file://{f}" for f in parquet_files(path)}
    assert {r["symbol"] for r in FI.read_indexed(spark, path, index, from_ms=START, to_ms=START).collect()} == {None, "B"}
    assert [r["symbol"] for r in FI.read_indexed(spark, path, index, symbol="B").collect()] == ["B"] and FI.read_indexed(spark, path, index, symbol="A").collect() == []


def test_no_task_writes_a_large_symbol_whole(spark, tmp_path):
    at = F.lit(1704067200000) + F.col("id")
    trades = spark.range(0, 40_000, 1, 8).select(
        F.lit("okx").alias("exchange"), F.lit("spot").alias("market_type"), F.lit("SYM1USDT").alias("symbol"), F.col("id").cast("string").alias("trade_id"),
        F.lit("1.5").alias("price"), F.lit("2").alias("quantity"), F.lit("buy").alias("side"), at.alias("ts_ms"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        K.write_trades(trades, str(tmp_path / "t"))
    finally:
        spark.conf.set(size, before)
    rows = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) > 2 and sum(r["n"] for r in rows) == 40_000 and max(r["n"] for r in rows) <= 20_000
