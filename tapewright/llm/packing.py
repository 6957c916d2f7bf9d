"""Packing: documents become token sequences of bounded length with little padding.

Each text is tokenized once, in tasks; its ids and an end id are cut into pieces of the sequence length
and a rest. The histogram of piece lengths, as many rows as a sequence has tokens, goes to the driver,
where cutting-stock column generation makes patterns of it. Pieces get a rank within their length, and
ranks map to the slots of the patterns by a table whose size depends on the sequence length only. Ranks
are made in two levels (a hash bucket of at most about ``BUCKET`` pieces, then the order within), so no
length is gathered in one task, however many pieces share it.

A sequence is padded to the full length unless its length is a power of two.

Defined results: a null text counts as empty and gives the end id alone; rows that repeat an id are
packed each; null ids are kept; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.cutting_stock import cutting_stock
from tapewright.llm.scratch import Scratch

BUCKET = 2_000
#: How a byte-level BPE splits text (a fixed value of such models).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin letters, their signs, and common dashes, quotation marks and the euro sign.
_RARE = re.compile("[^\u0000-\u024f\u2010-\u2026\u20ac]")
_BLANKS = re.compile(r"\s\s")
#: A run of white space too long for the look-ahead of ``tiktoken``'s expressions.
_LONG = re.compile(r"\s{100000}")


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary is also given to ``tiktoken``, which merges by rank and gives the same ids several
    times faster where both libraries are known to agree about character classes; texts with a character of
    ``_RARE``, with the string of a token that was added to the vocabulary, or with very long white space, are
    left to ``tokenizers`` itself. Texts without two white space characters in a row, where the model's look-ahead decides nothing,
    take a split without it.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model, added = known["model"], [re.escape(t["content"]) for t in known.get("added_tokens", ())]
        self.own = re.compile("|".join([_RARE.pattern, *added]))
        vocabulary = model["vocab"]
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks = [vocabulary[m] for m in joined]
        if ranks != sorted(ranks):
            raise ValueError("ids do not follow the order of merges")
        as_byte = {c: b for b, c in _byte_letters().items()}
        tokens = {bytes(as_byte[c] for c in t): vocabulary[t] for t in [*as_byte, *joined]}
        self.full, self.plain = (tiktoken.Encoding(name, pat_str=split, mergeable_ranks=tokens, special_tokens={}) for name, split in (("full", _SPLIT), ("plain", _SPLIT.replace(r"\s+(?!\S)|", ""))))

    def encode(self, text: str) -> np.ndarray:
        if self.own.search(text) or _LONG.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return (self.full if _BLANKS.search(text) else self.plain).encode_to_numpy(text, disallowed_special=())


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level BPE file: printable ones for themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id))
                for at in range(0, len(found), capacity):
                    piece = found[at : at + capacity]
                    row.append(i), start.append(at), length.append(len(piece)), crc.append(zlib.crc32(piece.astype("<u4").tobytes())), total.append(len(found))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            out = {"id": batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs of slots, the sequence of each run's first slot, the offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for size in lengths:
            runs[size].append((used[size], sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) for size, found in runs.items()}


def pack(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """``pieces`` (id, start, length and what else they have) with sequence_id and offset. They are read several times: pass a written table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(cutting_stock(histogram, capacity)))
    # As many rows as a sequence has tokens: frequent lengths have many buckets, rare ones a single one.
    buckets = spark.createDataFrame([(s, -(-n // BUCKET)) for s, n in histogram.items()], "length bigint, buckets bigint")
    bucketed = pieces.join(F.broadcast(buckets), "length").select(*pieces.columns, F.pmod(F.xxhash64("id", "start"), "buckets").alias("bucket"))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = bucketed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = slots.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            for size, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
                start, base, at = runs[size]
                run = np.searchsorted(start, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[run] + rank[rows] - start[run], at[run]
            columns = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked for.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every executor.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    pieces = scratch.save(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), schema), "pieces")
    return pack(pieces, capacity=capacity).withColumnRenamed("id", id_col)
