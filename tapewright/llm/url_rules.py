"""URL filters by a sort-merge range join of urls with rules on hosts and paths.

A host's key is its labels from last to first, each ended by a dot: ``m.example.net`` becomes
``net.example.m.``. A rule's host then holds exactly the keys that start with its own, which is an
interval of the sorted keys, and intervals of two hosts are nested or apart. Urls and rules are dealt
by ranges of (key, path), sorted within each range and swept once: a stack holds the rule hosts
whose interval the sweep is in, each with its paths in order, and a url looks for the longest path
that it starts with in each host of the stack.

Ranges come from a bounded sample of the keys, which only decides how evenly rows are dealt. A key that fills several
ranges by itself, such as one url in a third of all rows, is dealt to all of them by row. A rule
goes to each range that its interval meets; where a range lies within one host, only rules whose
paths can occur in it go there. So urls are shuffled once, rules are never broadcast, and a task holds the
rules of one chain of hosts only.

Defined results:
* host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, ports and user names
  included; path: then up to ``?``, ``#`` or the end; a null url or one without ``://`` has both empty;
* a rule fits its host and all hosts that end with a dot and it, if the path starts with the rule's path;
  of several, the longest host and path together decides, then the longest host; of one host and path that
  is listed twice, block;
* without a rule that fits: rule null and the verdict ``default``;
* rules without host, path or a verdict of allow or block are left out; no rules, or no urls, are allowed;
* every row gives one row, repeated rows and rows without an id too; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.exact_dedup import ascii_lower

#: Rows sampled for each range, and the most code points of a key or path that decide about ranges.
PER_RANGE, COMPARED = 64, 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def host_key(host: Column) -> Column:
    """Labels from last to first, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Ranges:
    """Ranges of (key, path) between sorted bounds; a bound that is repeated stands for a key that fills whole ranges."""

    def __init__(self, bounds: list[tuple[str, str]]) -> None:
        self.bounds = bounds

    def of(self, key: str, path: str, deal: int) -> int:
        at = (key[:COMPARED], path[:COMPARED])
        first = bisect_left(self.bounds, at)
        return first + deal % (bisect_right(self.bounds, at, first) - first + 1)

    def met_by(self, key: str, path: str) -> Iterator[int]:
        """Ranges that can hold a key and path starting with these."""
        end = key[:-1] + "/" if len(key) <= COMPARED else key[:COMPARED] + "\0"
        key, path = key[:COMPARED], path[:COMPARED]
        first, last = bisect_left(self.bounds, (key, "")), bisect_left(self.bounds, (end, ""))
        for k in range(first, last + 1):
            if 0 < k < len(self.bounds) and self.bounds[k - 1][0] == self.bounds[k][0]:
                low, high = self.bounds[k - 1][1], self.bounds[k][1]
                if path > high or path < low and not low.startswith(path):
                    continue
            yield k


class _Host:
    """The rules of one host; their paths come in order."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.paths: list[str] = []
        self.rules: list[tuple[str, str]] = []
        self.around: list[int] = []  # for each path the nearest other that it starts with, or -1

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.rules[-1] = (rule, verdict)
            return
        k = len(self.paths) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        self.around.append(k)
        self.paths.append(path)
        self.rules.append((rule, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        """All paths between a prefix and the path itself start with that prefix, so it is around the last of them."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return self.rules[k] if k >= 0 else None


class Sweep:
    """Takes rules and urls in the order of their keys, rules first where keys are equal."""

    def __init__(self) -> None:
        self.open: list[_Host] = []

    def _to(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1].key):
            self.open.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        self._to(key)
        if not self.open or self.open[-1].key != key:
            self.open.append(_Host(key))
        self.open[-1].add(path, rule, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self._to(key)
        best = None
        for host in reversed(self.open):  # longer hosts first
            found = host.longest(path)
            if found and (best is None or len(found[0]) > len(best[0])):
                best = found
        return best


def _bounds(urls: DataFrame, ranges: int) -> list[tuple[str, str]]:
    share = min(1.0, PER_RANGE * ranges / max(1, urls.count()))
    sample = urls.sample(share, 7).select(F.substring("key", 1, COMPARED), F.substring("path", 1, COMPARED))
    keys = sorted((r[0], r[1]) for r in sample.collect())
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``; ``rules`` has host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.select("id", F.pmod(F.xxhash64("id", "url"), F.lit(1 << 30)).alias("deal"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    listed = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    listed = listed.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").withColumn("key", host_key(F.col("host")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = spark.sparkContext.broadcast(Ranges(_bounds(urls, n)))

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "deal")), strict=True)
            at = pa.array([ranges.value.of(*k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([at, *(batch.column(c) for c in ("key", "path", "host", "id"))], ["at", "key", "path", "host", "id"])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "host", "verdict")), strict=True)
            dealt = ((k, *row) for row in rows for k in ranges.value.met_by(row[0], row[1]))
            columns = list(zip(*dealt, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], ["at", "key", "path", "host", "verdict"])

    kind = urls.schema["id"].dataType.simpleString()
    met = urls.mapInArrow(deal_urls, f"at int, key string, path string, host string, id {kind}")
    laid = listed.mapInArrow(deal_rules, "at int, key string, path string, host string, verdict string")
    both = laid.withColumn("is_url", F.lit(False)).unionByName(met.withColumn("is_url", F.lit(True)), allowMissingColumns=True)
    order = both.repartitionById(n, F.col("at")).sortWithinPartitions("at", "key", "is_url", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swept, at = Sweep(), None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("at", "is_url", "key", "path", "host", "verdict")), strict=True)
            take, found = [], []
            for k, (here, is_url, key, path, host, verdict) in enumerate(rows):
                if here != at:
                    swept, at = Sweep(), here
                if is_url:
                    take.append(k)
                    found.append(swept.judge(key, path) or (None, default))
                else:
                    swept.rule(key, path, host + path, verdict)
            rest = batch.take(pa.array(take, pa.int64()))
            rule, verdict = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("id", "host", "path")), rule, verdict], ["id", "host", "path", "rule", "verdict"])

    return order.mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
