"""Retention of event folders and exports: folders listed as a table, marked by a first pass, removed by a second.

``list_entries`` names the entries of a folder in the driver and looks into each of them in tasks, which give number, bytes and newest modification
time of what lies below. ``mark`` writes a tombstone for what has expired, or only says what it would mark; ``sweep`` removes what
was marked at least a grace period ago and has still expired, in tasks, and gives a row for each. Removing is repeatable: what is gone
already counts as gone, so a lost task or a second sweep does no harm, and a folder that was written to again since is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.numbers import event_key_ms

_ENTRIES = "name string, path string, is_folder boolean, files bigint, bytes bigint, modified_ms bigint"
_TOMBSTONES = "path string, reason string, due_ms bigint, marked_ms bigint"
_DAY = 86_400_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _looked_into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            files, at = _open(path)
            top = files.get_file_info(at)
            if top.type == fs.FileType.NotFound:
                continue
            below = files.get_file_info(fs.FileSelector(at, recursive=True)) if top.type == fs.FileType.Directory else [top]
            held = [i for i in below if i.type == fs.FileType.File]
            newest = max((i.mtime_ns for i in (held or [top]) if i.mtime_ns is not None), default=0)
            rows.append((at.rstrip("/").rsplit("/", 1)[1], path, top.type == fs.FileType.Directory, len(held), sum(i.size for i in held), newest // 1_000_000))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "path", "is_folder", "files", "bytes", "modified_ms"])


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, is_folder, files, bytes, modified_ms) of what lies in a folder."""
    files, at = _open(path)
    names = [i.base_name for i in files.get_file_info(fs.FileSelector(at, allow_not_found=True))]
    tasks = max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))
    return spark.createDataFrame([(f"{path.rstrip('/')}/{n}",) for n in names], "path string").repartition(tasks).mapInArrow(_looked_into, _ENTRIES)


def expired_events(entries: DataFrame, now_ms: int, *, keep_days: int = 30) -> DataFrame:
    """Event folders (SYMBOL_yyyyMMdd_HHmmss) whose time is before the cutoff: (path, reason, due_ms). Other names are not events and stay."""
    at = event_key_ms(F.col("name"))
    due = at + keep_days * _DAY
    return entries.where(F.col("is_folder") & F.col("name").rlike(r".+_\d{8}_\d{6}$") & (due < now_ms)).select("path", F.lit("event").alias("reason"), due.alias("due_ms"))


def expired_exports(entries: DataFrame, now_ms: int, *, keep_days: int = 7, pattern: str = r".*\.(tar\.gz|csv|csv\.gz)$|.*export.*") -> DataFrame:
    """Exports and backups, by pattern of their name, whose newest file is older than the time to keep."""
    due = F.col("modified_ms") + keep_days * _DAY
    return entries.where(F.col("name").rlike(pattern) & (due < now_ms)).select("path", F.lit("export").alias("reason"), due.alias("due_ms"))


def _tombstones(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(_TOMBSTONES).parquet(path) if there else spark.createDataFrame([], _TOMBSTONES)


def mark(expired: DataFrame, tombstones: str, now_ms: int, *, dry_run: bool = False) -> DataFrame:
    """Marks what has expired and is not marked yet; gives (path, reason, due_ms, action), the action being "marked" or "would mark"."""
    spark = expired.sparkSession
    fresh = expired.join(_tombstones(spark, tombstones).select("path").distinct(), "path", "left_anti").withColumn("marked_ms", F.lit(now_ms).cast("bigint"))
    if dry_run:
        return fresh.drop("marked_ms").withColumn("action", F.lit("would mark"))
    fresh.write.mode("append").parquet(tombstones)
    return _tombstones(spark, tombstones).where(F.col("marked_ms") == now_ms).drop("marked_ms").withColumn("action", F.lit("marked"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        actions = []
        for path in batch.column(0).to_pylist():
            files, at = _open(path)
            try:
                kind = files.get_file_info(at).type
                if kind == fs.FileType.Directory:
                    files.delete_dir(at)
                elif kind == fs.FileType.File:
                    files.delete_file(at)
                actions.append("gone before" if kind == fs.FileType.NotFound else "removed")
            except OSError as error:
                # Another attempt of this task may be at the same folder; the next sweep sees what is left.
                actions.append(f"failed: {error}"[:300])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(actions, pa.string())], ["path", "reason", "action"])


def sweep(expired: DataFrame, tombstones: str, now_ms: int, *, grace_ms: int = _DAY) -> DataFrame:
    """Removes what was marked before the grace period and is expired still; (path, reason, action) of each, written by the caller or collected once."""
    spark = expired.sparkSession
    marked = _tombstones(spark, tombstones).where(F.col("marked_ms") <= now_ms - grace_ms).select("path").distinct()
    due = expired.select("path", "reason").join(marked, "path", "left_semi")
    return due.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_removed, "path string, reason string, action string")
