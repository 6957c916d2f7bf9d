"""A sink with a ledger: readers see committed batches only, each once, whatever failed or was repeated.

    data/entry=<name>-<unique>/dt=.../*.parquet     one folder for each attempt at a batch, for each compaction, each version of a view
    ledger/<name>.json                        what was committed: name, folder, rows, and the entries it replaces

A batch writes its folder first and its entry last. The entry is renamed into place, which fails if one of that name is there: a batch that
is repeated after its commit writes nothing, one that failed before leaves a folder that no entry names. Readers take the folders of the
entries that no other entry replaces. Compactions are numbered, so of two that began from the same state one fails and changes nothing.
The ledger is small: compaction bounds the entries that are alive, and ``vacuum`` removes folders that none of them names.

On stores where a rename is no single step, give ``Ledger`` a path in one where it is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapewright.sources.writers import trade_rows

_ENTRY = "name string, folder string, rows bigint, replaces array<string>, committed_ms bigint"
#: A batch's files hold so many rows at most.
BATCH_ROWS = 1000


@dataclass(frozen=True)
class Entry:
    name: str
    folder: str
    rows: int


class Ledger:
    """What a folder's readers see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_package = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs_package.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(f"ledger/{name}.json"))

    def commit(self, name: str, folder: str, rows: int, replaces: Sequence[str] = ()) -> bool:
        """Puts an entry in place; False if there is one of that name already."""
        staged = f"staged/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(staged), False)
        out.write(bytearray(json.dumps({"name": name, "folder": folder, "rows": rows, "replaces": list(replaces), "committed_ms": round(time.time() * 1000)}).encode()))
        out.close()
        self._fs.mkdirs(self._at("ledger"))
        context = self._fs_package.FileContext.getFileContext(self._at("").toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._fs_package.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(self._at(staged)), self._fs.makeQualified(self._at(f"ledger/{name}.json")), none)
        except Exception as error:
            self._fs.delete(self._at(staged), False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def entries(self) -> DataFrame:
        """All that was committed."""
        there = self._fs.exists(self._at("ledger"))
        return self.spark.read.schema(_ENTRY).json(f"{self.path}/ledger") if there else self.spark.createDataFrame([], _ENTRY)

    def live(self) -> list[Entry]:
        """Entries that none replaces, by name."""
        entries = self.entries()
        replaced = entries.select(F.explode("replaces").alias("name"))
        return [Entry(r["name"], r["folder"], r["rows"]) for r in entries.join(replaced, "name", "left_anti").orderBy("name").collect()]

    def new_folder(self, name: str) -> str:
        return f"data/entry={name}-{uuid.uuid4().hex}"

    def read(self, schema: str) -> DataFrame:
        """Rows of all live entries, as of now."""
        return self.rows_of(self.live(), schema)

    def rows_of(self, entries: Sequence[Entry], schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{e.folder}" for e in entries if e.rows]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders).select(empty.columns) if folders else empty

    def vacuum(self, *, grace_ms: int = 3_600_000) -> list[str]:
        """Removes data folders that no live entry names and that were not touched within the grace period; readers may still be in younger ones."""
        kept = {e.folder for e in self.live()}
        cut, gone = time.time() * 1000 - grace_ms, []
        for status in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            folder = f"data/{status.getPath().getName()}"
            if folder not in kept and status.getModificationTime() <= cut:
                self._fs.delete(status.getPath(), True)
                gone.append(folder)
        return gone


def write_counted(rows: DataFrame, path: str, *, most_rows: int = 0, by: Sequence[str] = ()) -> int:
    """Writes rows and gives their number, in one pass."""
    seen = Observation()
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("maxRecordsPerFile", most_rows)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return seen.get["rows"]


def write_batch(ledger: Ledger, rows: DataFrame, source: str, batch_id: int, *, most_rows: int = BATCH_ROWS) -> bool:
    """Stores one batch of trades; False if it was stored before."""
    name = f"{source}-{batch_id:012d}"
    if ledger.has(name):
        return False
    folder = ledger.new_folder(name)
    n = write_counted(trade_rows(rows), f"{ledger.path}/{folder}", most_rows=most_rows, by=["dt"])
    return ledger.commit(name, folder, n)


def compact(ledger: Ledger, schema: str, *, at_least: int = 2, small_rows: int = 1_000_000) -> bool:
    """Brings the small entries together as sorted files; False if there are too few, or if another compaction came first."""
    count = ledger.entries().where(F.col("name").startswith("compact-")).count()
    small = [e for e in ledger.live() if e.rows < small_rows]
    if len(small) < at_least:
        return False
    name = f"compact-{count + 1:09d}"
    folder, n = ledger.new_folder(name), 0
    if any(e.rows for e in small):
        rows = ledger.rows_of(small, schema)
        n = write_counted(rows.repartition("dt", F.pmod(F.xxhash64("symbol"), F.lit(16))).sortWithinPartitions("dt", "symbol", "ts_ms"), f"{ledger.path}/{folder}", by=["dt"])
    return ledger.commit(name, folder, n, [e.name for e in small])


#: What the sink stores of a trade.
STORED = "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint, px double, qty double, ts timestamp, dt date"


def stream_to_ledger(trades: DataFrame, path: str, checkpoint: str, *, source: str = "trades", interval: str | None = "1 second", most_rows: int = BATCH_ROWS, compact_every: int = 100, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Micro-batches into a ledger, every so many of them compacted. ``source`` names the stream: one name for each checkpoint."""
    columns = [c.split()[0] for c in STORED.split(", ")][:8]
    ledger = Ledger(trades.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(ledger, batch.select(*columns), source, batch_id, most_rows=most_rows)
        if (batch_id + 1) % compact_every == 0:
            compact(ledger, STORED)
        if on_batch is not None:
            on_batch(batch, batch_id)

    writer = trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return Ledger(spark, path).read(STORED)


# A view that is kept up to date


MARKET = ("exchange", "market_type", "symbol")
VIEW = "exchange string, market_type string, symbol string, trades bigint, first_ms bigint, last_ms bigint, last_trade_id string, last_price string, last_quantity string, last_side string"


def market_view(trades: DataFrame) -> DataFrame:
    """Per market: trades, first and last time, and the latest trade (of equal times the one with the largest id)."""
    last = F.struct("ts_ms", "trade_id", "price", "quantity", "side")
    return _merged(trades.groupBy(*MARKET).agg(F.count(F.lit(1)).alias("trades"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max(last).alias("last")))


def _merged(partial: DataFrame) -> DataFrame:
    return partial.select(*MARKET, "trades", "first_ms", "last_ms", F.col("last.trade_id").alias("last_trade_id"), F.col("last.price").alias("last_price"), F.col("last.quantity").alias("last_quantity"), F.col("last.side").alias("last_side"))


def merge_views(views: DataFrame) -> DataFrame:
    """Several states of the view over different trades as one: sums of counts, the newest version of each market's last trade."""
    last = F.struct(F.col("last_ms").alias("ts_ms"), F.col("last_trade_id").alias("trade_id"), F.col("last_price").alias("price"), F.col("last_quantity").alias("quantity"), F.col("last_side").alias("side"))
    return _merged(views.groupBy(*MARKET).agg(F.sum("trades").alias("trades"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.max(last).alias("last")))


def update_view(ledger: Ledger, trades: DataFrame, source: str, batch_id: int) -> bool:
    """Merges a batch into the view as a new version that replaces the one before; False if the batch is in it already.

    The work is the batch and the view's markets, not the trades before.
    """
    name = f"{source}-{batch_id:012d}"
    if ledger.has(name):
        return False
    before = ledger.live()
    folder = ledger.new_folder(name)
    n = write_counted(merge_views(ledger.read(VIEW).unionByName(market_view(trades))), f"{ledger.path}/{folder}")
    return ledger.commit(name, folder, n, [e.name for e in before])


def stream_market_view(trades: DataFrame, path: str, checkpoint: str, *, source: str = "view", interval: str | None = "1 second") -> DataStreamWriter:
    """Keeps the market view of a stream; ``read_market_view`` shows its last committed version."""
    ledger = Ledger(trades.sparkSession, path)
    writer = trades.writeStream.foreachBatch(lambda batch, batch_id: update_view(ledger, batch, source, batch_id)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def read_market_view(spark: SparkSession, path: str) -> DataFrame:
    return Ledger(spark, path).read(VIEW)


def feed_totals(view: DataFrame, now_ms: int, *, silence_ms: int = 30_000) -> DataFrame:
    """From the market view, per exchange and for all (exchange null): spot and futures trades, markets, and exchanges that have sent within ``silence_ms``."""
    per = view.groupBy("exchange").agg(
        F.sum(F.when(F.col("market_type") == "spot", F.col("trades")).otherwise(0)).alias("spot_trades"), F.sum(F.when(F.col("market_type") == "futures", F.col("trades")).otherwise(0)).alias("futures_trades"),
        F.count(F.lit(1)).alias("markets"), F.max("last_ms").alias("last_ms"),
    )
    per = per.withColumn("active", (F.col("last_ms") >= now_ms - silence_ms).cast("bigint"))
    return per.groupingSets([[F.col("exchange")], []], F.col("exchange")).agg(*(F.sum(c).alias(c) for c in ("spot_trades", "futures_trades", "markets", "active")), F.max("last_ms").alias("last_ms"))
