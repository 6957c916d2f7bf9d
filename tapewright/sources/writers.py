"""Writers: day-partitioned tables, event archives, CSV exports and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.numbers import event_key, floor_window, strict_double
from tapewright.functions.symbols import match_bases
from tapewright.operators.pumps import MARKET

#: Milliseconds of the blocks in which an archive stores a coin's trades.
ARCHIVE_BLOCK_MS = 10_000


def _day(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def trade_rows(trades: DataFrame) -> DataFrame:
    """What ``write_trades`` stores: numbers as doubles, rows that do not parse left out, a day column."""
    px, qty = strict_double(F.col("price")), strict_double(F.col("quantity"))
    rows = trades.withColumns({"px": px, "qty": qty}).where("px is not null and qty is not null and ts_ms is not null")
    return rows.withColumns({"ts": F.timestamp_millis("ts_ms"), "dt": _day(F.col("ts_ms"))})


def write_trades(trades: DataFrame, path: str, *, mode: str = "append") -> None:
    """Day partitions, sorted by symbol and time within files so that row groups can be skipped.

    A day's symbols are dealt to 16 parts, of which adaptive execution splits large ones, so that no task sorts a day or a symbol whole.
    """
    rows = trade_rows(trades).withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(16)))
    rows.hint("rebalance", "dt", "part").drop("part").sortWithinPartitions("dt", "symbol", "ts_ms").write.mode(mode).partitionBy("dt").parquet(path)


def write_listings(listings: DataFrame, path: str, stored_ms: int, *, mode: str = "append") -> None:
    rows = listings.withColumns({"markets": F.to_json("markets"), "stored_at": F.timestamp_millis(F.lit(stored_ms)), "dt": _day(F.col("announced_ms"))})
    rows.write.mode(mode).partitionBy("dt").parquet(path)


def pump_analysis_rows(pumps: DataFrame, metrics: DataFrame, analyzed_ms: int, *, keys: Sequence[str] = MARKET) -> DataFrame:
    """What ``write_pump_analysis`` stores: pumps with the metrics of ``pump_metrics``, an id, times as timestamps and the day of analysis."""
    rows = pumps.join(metrics.drop("price_change"), [*keys, "start_ms"])
    listing = F.col("event_id") if "event_id" in keys else F.lit(None)
    return rows.select(
        F.xxhash64(*keys, "start_ms").alias("id"), listing.cast("bigint").alias("listing_id"), "symbol", "exchange", "market_type", F.timestamp_millis("start_ms").alias("pump_start_time"), F.timestamp_millis("end_ms").alias("pump_end_time"),
        F.col("duration_ms").cast("int").alias("duration_ms"), "start_price", "peak_price", "end_price", F.col("price_change").alias("price_change_percent"), F.col("volume").alias("total_volume"), F.col("volume_spike").alias("volume_spike_ratio"),
        F.col("trade_count").cast("int").alias("trade_count"), F.col("avg_size").alias("avg_trade_size"), F.col("max_size").alias("max_trade_size"), "buy_sell_ratio", F.timestamp_millis(F.lit(analyzed_ms)).alias("analyzed_at"), _day(F.lit(analyzed_ms)).alias("dt"),
    )


def write_pump_analysis(rows: DataFrame, path: str, *, mode: str = "append") -> None:
    """Rows of ``pump_analysis_rows``, in partitions by day of analysis."""
    rows.write.mode(mode).partitionBy("dt").parquet(path)


def write_metrics(metrics: DataFrame, path: str, *, mode: str = "append") -> None:
    """Rows (ts_ms, metric_name, metric_value, tags, node_id)."""
    metrics.withColumn("dt", _day(F.col("ts_ms"))).write.mode(mode).partitionBy("dt").parquet(path)


def write_event_archive(listings: DataFrame, trades: DataFrame, reports: dict[str, DataFrame], path: str, *, pre_ms: int = 20_000, post_ms: int = 20_000) -> None:
    """Events with their intervals under events/, the trades around them as JSON by coin and block of time under raw/, and each report as its own dataset.

    Events of one coin overlap: a trade is stored once a coin, not once an event, so the archive grows with trades and events and not
    with their pairs. Rows of one folder meet in few tasks, else every task would write a file to every folder.
    """
    at, second = F.col("trigger_ms"), F.col("ts_ms")
    events = listings.select("event_id", event_key(F.regexp_replace("symbol", "USDT$", ""), at).alias("event"), F.col("symbol").alias("base"), "trigger_ms", (at - pre_ms).alias("from_ms"), (at + post_ms).alias("to_ms"))
    block = lambda t: floor_window(t, ARCHIVE_BLOCK_MS)
    wanted = events.select("base", F.explode(F.sequence(block(F.col("from_ms")), block(F.col("to_ms")), F.lit(ARCHIVE_BLOCK_MS).cast("bigint"))).alias("block")).distinct()
    rows = trades.withColumns({"base": F.explode(match_bases(F.col("symbol"))), "block": block(second)}).join(wanted, ["base", "block"], "left_semi")
    rows.hint("rebalance", "base", "block").write.mode("overwrite").option("compression", "gzip").partitionBy("base", "block").json(f"{path}/raw")
    for name, report in {"events": events, **reports}.items():
        report.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def export_tables_csv(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as gzipped CSV; one row per table (table, rows, status, error), and the run's status in ``run_status``."""
    results = []
    for name, table in tables.items():
        try:
            # Rows are counted as they are written: lines of the file may be more, where values hold line breaks.
            seen = Observation()
            table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/{name}")
            results.append((name, seen.get["rows"], "success", None))
        except Exception as error:  # noqa: BLE001  one table's failure is a result row, not the run's end
            results.append((name, 0, "failed", str(error)[:500]))
    good = sum(r[2] == "success" for r in results)
    status = "success" if good == len(results) else "partial" if good else "failed"
    return spark.createDataFrame([(*r, status) for r in results], "table string, rows bigint, status string, error string, run_status string")


def expired_partitions(days: DataFrame, now_ms: int, *, keep_days: int = 30, short_days: int = 25, usage: float = 0.0, most_usage: float = 85.0) -> DataFrame:
    """Days (dt) before the cutoff; a fuller disk than ``most_usage`` per cent shortens what is kept."""
    kept = short_days if usage > most_usage else keep_days
    return days.where(F.col("dt") < F.date_sub(_day(F.lit(now_ms)), kept))


def apply_retention(spark: SparkSession, path: str, now_ms: int, **limits) -> list[str]:
    """Removes the expired day folders of a partitioned table and names them."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top) if s.getPath().getName().startswith("dt=")]
    if not names:
        return []
    days = spark.createDataFrame([(n[3:],) for n in names], "day string").select(F.to_date("day").alias("dt"))
    gone = sorted(str(r["dt"]) for r in expired_partitions(days, now_ms, **limits).collect())
    for day in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}"), True)
    return gone
