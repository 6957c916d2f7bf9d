"""What many overlapping time ranges hold of the same rows, in work that grows with rows and with ranges, not with their pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.numbers import floor_window
from tapewright.functions.symbols import match_bases

#: Rows of ranges, and bytes of their names, up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_RANGES, BROADCAST_BYTES = 100_000, 16 << 20
#: Buckets of a range, of which it touches one more: fewer where all copies of a range are broadcast.
BROADCAST_BUCKETS, BUCKETS = 8, 20
#: Ranges in one list, on average, at most.
LISTED = 4096


def range_pieces(ranges: DataFrame, ticks: DataFrame, *, on: str, keys: Sequence[str], totals: dict[str, Callable[[str], Column]], width_ms: int = 1000, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Totals of ticks for each range, block of ``width_ms`` and key: the range's columns, the keys, start_ms and the totals.

    ``ranges`` have ``on``, from_ms and to_ms (both included); ``ticks`` have ``keys`` (``on`` among them), ts_ms and
    the columns of ``totals``, of which ``n`` is a count that is added up. Whole blocks are added up once for all ranges;
    blocks that a range cuts are read off running totals at the cuts. A range that begins inside a block must go beyond it.
    ``shape`` makes other columns of the totals, or leaves rows out: of whole blocks once, not once a range.
    """
    block = [*keys, "start_ms"]
    t = ticks.withColumn("start_ms", floor_window(F.col("ts_ms"), width_ms))
    blocks = t.groupBy(*block).agg(*[f(c).alias(c) for c, f in totals.items()])
    shape = shape or (lambda rows: rows)
    shaped = shape(blocks)
    lo, hi = F.col("from_ms"), F.col("to_ms")
    first, last = floor_window(lo, width_ms), floor_window(hi, width_ms)
    cut_lo, cut_hi = lo != first, hi != last + width_ms - 1
    begin, end = F.when(cut_lo, first + width_ms).otherwise(first), F.when(cut_hi, last - width_ms).otherwise(last)
    starts = F.when((lo <= hi) & (begin <= end), F.sequence(begin, end, F.lit(width_ms).cast("bigint")))
    columns = [*ranges.columns, *[c for c in shaped.columns if c != on]]
    # Few ranges meet many blocks: they are dealt to all tasks, however small the tables are.
    spark = ticks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    whole = ranges.withColumn("start_ms", F.explode(starts)).repartition(tasks, on, "start_ms").join(shaped, [on, "start_ms"]).select(*columns)
    edge = lambda cut, at, start, lower: ranges.where((lo <= hi) & cut).select(*ranges.columns, at.alias("at_ms"), start.alias("start_ms"), F.lit(lower).alias("lower"))
    edges = edge(cut_lo, lo, first, True).unionByName(edge(cut_hi, hi, last, False))
    asked = edges.select(on, "start_ms", "at_ms", "lower").distinct()
    marks = asked.join(blocks.select(*block), [on, "start_ms"]).select(*block, F.col("at_ms").alias("ts_ms"), "lower")
    # A window holds the ticks and cuts of one block of one key.
    up, down = Window.partitionBy(*block).orderBy("ts_ms"), Window.partitionBy(*block).orderBy(F.desc("ts_ms"))
    rows = t.select(*block, "ts_ms", *totals).unionByName(marks, allowMissingColumns=True)
    at = rows.select(*block, F.col("ts_ms").alias("at_ms"), "lower", *[F.when(F.col("lower"), f(c).over(down)).otherwise(f(c).over(up)).alias(c) for c, f in totals.items()])
    cut = edges.join(at.where(F.col("lower").isNotNull() & (F.col("n") > 0)), [on, "start_ms", "at_ms", "lower"])
    return whole.unionByName(shape(cut).select(*columns))


def numbered(ticks: DataFrame, *, keys: Sequence[str], width_ms: int = 1000) -> DataFrame:
    """Ticks, one for each key and ts_ms, with their number ``nth`` within the key by time, from 1; no window sorts a key whole."""
    t = ticks.withColumn("start_ms", floor_window(F.col("ts_ms"), width_ms))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1))
    blocks = t.groupBy(*keys, "start_ms").agg(F.count(F.lit(1)).alias("n")).select(*keys, "start_ms", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "start_ms").orderBy("ts_ms"))
    return t.withColumn("own", own).join(blocks, [*keys, "start_ms"]).withColumn("nth", F.col("before") + F.col("own")).drop("own", "before", "start_ms")


def listed_ranges(ranges: DataFrame, *, on: str, width_ms: int, rows: int | None = None) -> DataFrame:
    """Ranges (``on``, from_ms, to_ms and other columns) as lists ``near`` by ``on`` and ``bucket`` of ``width_ms``, in each bucket that a range touches.

    Lists that would be long are split; how long is counted, unless ``rows``, the ranges' number where it is known, is small.
    """
    rest = [c for c in ranges.columns if c != on]
    touched = F.sequence(F.floor(F.col("from_ms") / width_ms), F.floor(F.col("to_ms") / width_ms))
    spread = ranges.where("from_ms <= to_ms").select(on, F.explode(touched).alias("bucket"), F.struct(*rest).alias("range"))
    most = rows if rows is not None and rows <= LISTED else spread.groupBy(on, "bucket").count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // LISTED)
    part = (F.pmod(F.xxhash64("range"), F.lit(parts)) if parts > 1 else F.lit(0)).alias("part")
    return spread.groupBy(on, "bucket", part).agg(F.collect_list("range").alias("near")).drop("part")


def trades_in_ranges(trades: DataFrame, ranges: DataFrame, *, span_ms: int, leading_s: bool = True, broadcast: bool | None = None) -> DataFrame:
    """Trades with each range of their coin that holds them. ``ranges`` have base, from_ms, to_ms, at most ``span_ms`` apart, and other columns, which are kept.

    A trade joins by base name and time bucket with lists of ranges, each in the buckets that it touches, so the join is an
    equi-join, no coin gathers all its ranges, and no row per pair is looked up. Buckets are short against the ranges: few pairs are
    looked at in vain, and a coin's trades fill many keys. Few ranges (rows and bytes are counted, unless
    ``broadcast`` says so) are broadcast; trades in a range's bucket are then dealt to all tasks, since each may
    meet many ranges, however few files held them. Else both sides are shuffled, trades only under names that have ranges, if these
    names are few enough to be broadcast, and without a sort.
    """
    counted = lambda table: table.limit(BROADCAST_RANGES + 1).agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in table.dtypes if kind == "string"]).first()
    few = lambda table: table[0] <= BROADCAST_RANGES and sum(table[1:]) <= BROADCAST_BYTES
    rows = None
    if broadcast is None:
        rows = counted(ranges)
        broadcast, rows = few(rows), rows[0]
    width = -(-max(span_ms, 1) // (BROADCAST_BUCKETS if broadcast else BUCKETS))
    named = trades.withColumn("base", F.explode(match_bases(F.col("symbol"), leading_s=leading_s)))
    lists = listed_ranges(ranges, on="base", width_ms=width, rows=rows if broadcast else None)
    spark, key = trades.sparkSession, ["base", "bucket"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    bucket = F.floor(F.col("ts_ms") / width)
    if broadcast:
        named = named.withColumn("bucket", bucket).join(F.broadcast(lists.select(*key).distinct()), key, "left_semi").repartition(tasks, "ts_ms", "trade_id")
        lists = F.broadcast(lists)
    else:
        bases = ranges.select("base").distinct()
        if few(counted(bases)):
            named = named.join(F.broadcast(bases), "base", "left_semi")
        named, lists = named.withColumn("bucket", bucket).repartition(tasks, *key), lists.repartition(tasks, *key).hint("shuffle_hash")
    pairs = named.join(lists, key).select(*trades.columns, F.inline("near"))
    return pairs.where(F.col("ts_ms").between(F.col("from_ms"), F.col("to_ms"))).drop("from_ms", "to_ms")
