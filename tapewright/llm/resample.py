"""Quality by importance resampling: which documents look like a target, sampled in proportion.

Texts are bags of hashed word unigrams and bigrams. The number of buckets grows with the corpus, as its
vocabulary does (see ``buckets_for``). Two generative models, one of the target texts and one of all raw
texts, give each text a log importance weight: the log ratio of its probabilities in the two, which is the sum
over its n-grams of ``log p_target - log p_raw``. With ``unit`` it is their mean times ``unit`` instead, which makes
texts of all lengths compare, and is no longer the importance weight. Adding Gumbel noise and taking the ``k``
largest keys samples without replacement in proportion to the weights. The k-th largest key is found by
four counts over 16 bits each, so no sort or collection grows with the data.

Counts cover all documents. Tasks count the buckets that they meet, so time does not depend on how many there
are; counts are added up in partitions and written, and ratios come to the driver as blocks of ``BLOCK`` buckets. The
target is every labelled row with label 1 outside the held-out fold, at most ``fit_rows`` of them (by id hash);
their ids, a bounded table, are broadcast.

Defined results: null and empty texts have weight 0; without target rows every weight is 0; noise depends
on id, text length and seed, so repeated rows share it and rows tied at the threshold are all kept; null
ids are scored and may be kept; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import words as W
from tapewright.llm.scratch import Scratch
from tapewright.llm.toxicity import fold


#: Buckets whose ratios travel as one row; counts that a task holds before it adds them up; counts in one Arrow batch.
BLOCK, _SETTLE, _SENT = 4096, 1 << 18, 1 << 16


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every unigram and bigram of a slice."""
    starts, ends, before = W.spans(data, offsets, W.LETTERS)
    words = W.hashes(data, starts, ends)
    text = W.rows_of(np.diff(before))
    pairs = W.runs(words, 2)
    same = text[1:] == text[:-1] if len(text) else np.zeros(0, dtype=bool)
    kind = np.concatenate([W.mix(words), pairs[same]])
    return (kind % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[:-1][same] if len(text) else text])


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, raw, target) with each bucket once."""
    bucket, raw, target = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return (bucket[first], np.add.reduceat(raw[order], first), np.add.reduceat(target[order], first)) if len(first) else (bucket, raw, target)


def _counted(buckets: int):
    """Counts of the buckets that a task meets; memory grows with these and ends at the number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        parts, held, settled = [(none, none, none)], 0, 0
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, data, offsets in W.slices(batch.column(0)):
                bucket, text = _grams(data, offsets, buckets)
                # The flag of target texts is the lowest bit, so that one sort counts both.
                key, n = np.unique(bucket * 2 + wanted[lo + text], return_counts=True)
                parts.append((key >> 1, n, n * (key & 1)))
                held += len(key)
                if held > max(settled, _SETTLE):
                    parts = [_added(parts)]
                    settled, held = len(parts[0][0]), 0
        bucket, raw, target = _added(parts)
        for i in range(0, len(bucket), _SENT):
            yield pa.RecordBatch.from_pydict({"bucket": bucket[i : i + _SENT], "raw": raw[i : i + _SENT], "target": target[i : i + _SENT]})

    return run


def _ratios(raw_total: int, target_total: int, buckets: int, smoothing: float):
    """From counts sorted by bucket, with all of a block in one task: (block, ratios of its buckets as bytes)."""

    def packed(bucket: np.ndarray, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        ratio = np.log((target + smoothing) / (target_total + smoothing * buckets)) - np.log((raw + smoothing) / (raw_total + smoothing * buckets))
        blocks, place = np.unique(bucket // BLOCK, return_inverse=True)
        out = np.zeros((len(blocks), BLOCK), dtype=np.float32)
        out[place, bucket % BLOCK] = ratio
        return pa.RecordBatch.from_pydict({"block": blocks, "ratios": pa.array([r.tobytes() for r in out], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("bucket", "raw", "target")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last block may go on in the next batch.
            done = int(np.searchsorted(held[0], held[0][-1] // BLOCK * BLOCK)) if len(held[0]) else 0
            if done:
                yield packed(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield packed(*held)

    return run


def buckets_for(n_bytes: int) -> int:
    """Buckets of the models: a power of two of about 16 times the square root of the bytes of text.

    Vocabularies grow about as the square root of their corpus. Counts and ratios are arrays of that length in
    the driver and in each task, so it ends at 2**24 (64 MB of ratios), which a terabyte of text reaches.
    """
    return min(max(1 << math.ceil(math.log2(16 * math.sqrt(max(n_bytes, 1)))), 1 << 14), 1 << 24)


def _least_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the least hashes. What can't be among them is left out before any sort, so that one task merges little more than ``most`` rows."""
    n = rows.count()
    share = 1.1 * most / n + 1e-9 if n > 2 * most else 1.0
    some = rows.where(F.xxhash64(key) < F.lit(int(share * 2.0**64) - 2**63)) if share < 1 else rows
    return some.orderBy(F.xxhash64(key), key).limit(most)


def importance(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int | None = None, unit: float | None = None, smoothing: float = 1.0, fit_rows: int = 200_000, seed: int = 1) -> DataFrame:
    """(id, log_weight, gumbel_key) of every row; weights are log ratios, or with ``unit`` their means per n-gram times ``unit``."""
    spark = docs.sparkSession
    wanted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id")).distinct()
    scratch = Scratch(spark, "importance")
    wanted = scratch.save(_least_hashes(wanted.where(fold(F.col("label_id")) != 0), "label_id", fit_rows).withColumn("wanted", F.lit(True)), "target")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if buckets is None:
        buckets = buckets_for(rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0)
    flagged = rows.join(F.broadcast(wanted), F.col("id") == F.col("label_id"), "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    # A task sends each bucket once, so counts are not added up again before the shuffle.
    counts = flagged.mapInArrow(_counted(buckets), "bucket bigint, raw bigint, target bigint").withColumn("block", F.floor(F.col("bucket") / BLOCK)).repartition("block")
    counts = counts.groupBy("block", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = scratch.save(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    ratio = np.zeros(-(-buckets // BLOCK) * BLOCK, dtype=np.float32)
    if total["target"]:
        blocks = counts.repartition("block").sortWithinPartitions("bucket")
        # As many rows as there are blocks, 4,096 at most, of 16 KB.
        for r in blocks.mapInArrow(_ratios(total["raw"], total["target"], buckets, smoothing), "block bigint, ratios binary").collect():
            ratio[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["ratios"], dtype=np.float32)
    shared = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(len(batch))
            for lo, data, offsets in W.slices(batch.column(1)):
                bucket, text = _grams(data, offsets, buckets)
                n = len(offsets) - 1
                weight[lo : lo + n] = np.bincount(text, weights=shared.value[bucket], minlength=n)
                if unit is not None:
                    weight[lo : lo + n] *= unit / np.maximum(np.bincount(text, minlength=n), 1)
            chance = batch.column(2).to_numpy()
            uniform = ((chance.view(np.uint64) >> np.uint64(11)) + 0.5) / float(1 << 53)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))], ["id", "log_weight", "gumbel_key"])

    noisy = rows.select("id", "text", F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce(F.octet_length("text"), F.lit(0))).alias("chance"))
    return noisy.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, log_weight double, gumbel_key double").withColumnRenamed("id", id_col)


def _ordered_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles as integers of the same order: their bits, with those of negative numbers turned over."""
    for batch in batches:
        bits = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64)
        yield pa.RecordBatch.from_pydict({"bits": np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))})


def largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column without nulls or NaN (None if there are fewer than k rows): four counts of at most 65,536 groups."""
    rest, left, found = rows.select(key).mapInArrow(_ordered_bits, "bits bigint"), k, 0
    for shift in (48, 32, 16, 0):
        part = F.shiftright("bits", shift) if shift == 48 else F.shiftright("bits", shift).bitwiseAND(0xFFFF)
        groups = sorted(((r["part"], r["n"]) for r in rest.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for value, n in groups:
            if n >= left:
                break
            left -= n
        else:
            return None
        found = (found << 16) | (value & 0xFFFF if shift != 48 else value)
        rest = rest.where(part == value)
    signed = found if found < 1 << 63 else found - (1 << 64)
    signed = signed if signed >= 0 else signed ^ 0x7FFFFFFFFFFFFFFF
    return float(np.array(signed, dtype=np.int64).view(np.float64))


def resample(docs: DataFrame, labels: DataFrame, *, share: float = 0.5, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, log_weight, gumbel_key, kept) of every row; about ``share`` of all rows are kept, exactly that many but for ties."""
    scratch = Scratch(docs.sparkSession, "resample")
    scored = scratch.save(importance(docs, labels, id_col=id_col, **options), "scored")
    k = int(scored.count() * share)
    least = largest(scored, "gumbel_key", k) if k else float("inf")
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(least))
