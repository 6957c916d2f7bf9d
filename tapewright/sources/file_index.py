"""An index of a table's files, so that point and range reads plan over the files that can hold their rows and no others.

For each file the index has rows, times and symbols from least to greatest, and Bloom filters of its symbols and trade
ids. Filters are built by Spark's bitmap aggregates: hashes of a value are bit positions, dealt to bitmaps of 32,768 bits; a file has as
many bitmaps as its rows need for about one false hit in a hundred. The index is partitioned by the table's days, so a lookup reads the
days of its range only, and what comes to the driver are the names of the files that are read.

``update_index`` adds files that are new and marks those that have gone, so it may follow every write. A file that is not indexed yet is not
found: readers that must see all rows update first. Files are added last, after their filters, so an update that fails is simply repeated. Rows without symbol or id are in their file's times, not in its filters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's aggregates, bits for each value, and hashes for each value.
BITMAP, BITS, HASHES = 32_768, 10, 4
_FILES = "file string, rows bigint, min_ms bigint, max_ms bigint, min_symbol string, max_symbol string, bitmaps bigint, dt date"
_BITS = "file string, kind string, bucket bigint, bits binary, dt date"
_GONE = "file string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A part of the index; empty before anything was written to it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _positions(value: Column, bitmaps: Column) -> Column:
    """Bits of a value, from 1, among all bits of a file's filter."""
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), bitmaps * BITMAP) + 1 for k in range(HASHES)])


def _plain(name: Column) -> Column:
    """File names as both listings write them."""
    return F.regexp_replace(name, "^file:/+", "file:///")


def _has(value: Column, candidates: DataFrame, bits: DataFrame, kind: str) -> DataFrame:
    """Candidates (file, bitmaps) whose filter may hold a value: all of its bits are set."""
    wanted = candidates.select("file", F.explode(_positions(value, F.lit(1) if kind == "symbol" else F.col("bitmaps"))).alias("at"))
    wanted = wanted.select("file", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit")).distinct()
    is_set = F.expr("(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bit % 8 as int))) != 0")
    met = wanted.join(bits.where(F.col("kind") == kind), ["file", "bucket"], "left").select("file", "bucket", "bit", F.coalesce(is_set, F.lit(False)).alias("hit"))
    met = met.groupBy("file", "bucket", "bit").agg(F.max("hit").alias("hit"))
    return met.groupBy("file").agg(F.min("hit").alias("hit")).where("hit").select("file")


def _files(spark: SparkSession, index: str) -> DataFrame:
    return _table(spark, f"{index}/files", _FILES).join(_table(spark, f"{index}/gone", _GONE).distinct(), "file", "left_anti")


def update_index(spark: SparkSession, path: str, index: str) -> int:
    """Brings the index of a trade table in line with its files; gives the number of files added."""
    known = _files(spark, index).select("file")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    listed = found.select(_plain(F.col("path")).alias("file"))
    known.join(listed, "file", "left_anti").write.mode("append").parquet(f"{index}/gone")
    new = [r["file"] for r in listed.join(known, "file", "left_anti").collect()]
    if not new:
        return 0
    table = spark.read.option("basePath", path).parquet(*new) if not known.isEmpty() else spark.read.parquet(path)
    rows = table.select(_plain(F.col("_metadata.file_path")).alias("file"), "symbol", "trade_id", "ts_ms", "dt")
    stats = rows.groupBy("file", "dt").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts_ms").alias("min_ms"), F.max("ts_ms").alias("max_ms"), F.min("symbol").alias("min_symbol"), F.max("symbol").alias("max_symbol")
    )
    stats = stats.withColumn("bitmaps", F.ceil(F.col("rows") * BITS / BITMAP)).select("file", "rows", "min_ms", "max_ms", "min_symbol", "max_symbol", "bitmaps", "dt")
    pending = f"{index}/pending/{uuid.uuid4().hex}"
    stats.write.parquet(pending)
    stats = spark.read.schema(_FILES).parquet(pending)

    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("symbol", "trade_id")])
    values = rows.select("file", "dt", F.explode(kinds).alias("v")).select("file", "dt", "v.kind", "v.value").where("value is not null")
    values = values.join(stats.select("file", "bitmaps"), "file")
    at = values.select("file", "dt", "kind", F.explode(_positions(F.col("value"), F.when(F.col("kind") == "symbol", F.lit(1)).otherwise(F.col("bitmaps")))).alias("at"))
    maps = at.groupBy("file", "dt", "kind", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    maps.select("file", "kind", "bucket", "bits", "dt").repartition("dt").write.mode("append").partitionBy("dt").parquet(f"{index}/bits")
    stats.repartition("dt").write.mode("append").partitionBy("dt").parquet(f"{index}/files")
    return len(new)


def candidate_files(spark: SparkSession, index: str, *, from_ms: int | None = None, to_ms: int | None = None, symbol: str | None = None, trade_id: str | None = None) -> DataFrame:
    """Files that may hold rows of a time range, a symbol and a trade id, each of which may be left open."""
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    within = F.lit(True)
    if from_ms is not None:
        within = within & (F.col("dt") >= day(from_ms))
    if to_ms is not None:
        within = within & (F.col("dt") <= day(to_ms))
    found = _files(spark, index).where(within)
    if from_ms is not None:
        found = found.where(F.col("max_ms") >= from_ms)
    if to_ms is not None:
        found = found.where(F.col("min_ms") <= to_ms)
    if symbol is not None:
        found = found.where((F.col("min_symbol") <= symbol) & (F.col("max_symbol") >= symbol))
    found = found.select("file", "bitmaps").distinct()
    bits = _table(spark, f"{index}/bits", _BITS).where(within)
    for kind, value in (("symbol", symbol), ("trade_id", trade_id)):
        if value is not None:
            found = found.join(_has(F.lit(value), found, bits, kind), "file", "left_semi")
    return found.select("file")


def read_indexed(spark: SparkSession, path: str, index: str, *, from_ms: int | None = None, to_ms: int | None = None, symbol: str | None = None, trade_id: str | None = None, most_files: int = 10_000) -> DataFrame:
    """The rows that match, read from the files that the index names.

    A range that meets more than ``most_files`` files is read by partition and row group instead, without naming files.
    """
    names = [r["file"] for r in candidate_files(spark, index, from_ms=from_ms, to_ms=to_ms, symbol=symbol, trade_id=trade_id).limit(most_files + 1).collect()]
    if not names:
        rows = spark.read.parquet(path).where(F.lit(False))
    elif len(names) > most_files:
        rows = spark.read.parquet(path)
    else:
        rows = spark.read.option("basePath", path).parquet(*sorted(names))
    for column, value in (("symbol", symbol), ("trade_id", trade_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if from_ms is not None:
        rows = rows.where((F.col("ts_ms") >= from_ms) & (F.col("dt") >= F.to_date(F.timestamp_millis(F.lit(from_ms)))))
    if to_ms is not None:
        rows = rows.where((F.col("ts_ms") <= to_ms) & (F.col("dt") <= F.to_date(F.timestamp_millis(F.lit(to_ms)))))
    return rows
