"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every text.

Executors cut the benchmark into windows: rows of at most ``PIECE`` windows as flat arrays, so that no item
has to fit anywhere whole. The rows of a block, about ``block_bytes`` of text, are broadcast: hashes in order,
with the words behind them. Each task computes the hashes of all word windows of its texts as arrays, looks
them up, and compares the words of each hit, so a colliding hash marks nothing. A window takes 24 bytes and
its words once, which for the default block is about 90 MB in the driver and in each Python worker. A
benchmark larger than a block is taken block by block: each pass reads the written result of the one before
and adds to it, and no shuffle is needed for any size.

Defined results:
* a null or empty text has no words and no hits, an item without words has no windows;
* an item of fewer words than a window is one window of its own length;
* rows with the same id are scanned one by one; repeated items have one window and each counts as an item;
  items with a null id are looked for and marked but not listed;
* empty documents or an empty benchmark give no hits;
* only the named columns of either table are read, other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tapewright.llm import words as W
from tapewright.llm.scratch import Scratch

#: Windows of an item in one row.
PIECE = 1 << 15
_TABLE_BITS = 20


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case with a blank between them, and where each begins and ends in that."""
    length = ends - starts
    end = np.cumsum(length + 1) - 1
    begin = end - length
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    word = W.rows_of(length)
    inside = np.arange(len(word)) - (np.cumsum(length) - length)[word]
    out[begin[word] + inside] = W.LOWER[data[starts[word] + inside]]
    return out, begin, end


def _windowed(n: int):
    """From (item, text): rows of at most ``PIECE`` windows of an item: their words, and hash, first and end byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                for _, data, offsets in W.slices(batch.column(1).slice(i, 1)):
                    starts, ends, _ = W.spans(data, offsets, W.LETTERS)
                    size = min(n, len(starts))
                    keys = W.runs(W.hashes(data, starts, ends), size) if size else np.zeros(0, np.uint64)
                    for a in range(0, len(keys), PIECE):
                        z = min(a + PIECE, len(keys))
                        words, begin, end = _joined(data, starts[a : z + size - 1], ends[a : z + size - 1])
                        row = {"item": batch.column(0).slice(i, 1), "size": pa.array([size], pa.int32())}
                        arrays = (words, keys[a:z], begin[: z - a].astype(np.int32), end[size - 1 :].astype(np.int32))
                        row |= {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("words", "keys", "first", "end"), arrays, strict=True)}
                        yield pa.RecordBatch.from_pydict(row)

    return run


_PIECES = "item string, size int, words binary, keys binary, first binary, end binary"


class Windows:
    """Word windows of some benchmark items: by length the hashes in order, and the place of each window's words."""

    def __init__(self, rows: Iterable[Row]) -> None:
        by_size: dict[int, list[Row]] = {}
        for row in rows:
            by_size.setdefault(row["size"], []).append(row)
        self.of: dict[int, tuple] = {}
        for size, found in by_size.items():
            texts, keys = [bytes(r["words"]) for r in found], [np.frombuffer(bytes(r["keys"]), np.uint64) for r in found]
            base = np.cumsum([0, *map(len, texts)])
            owner = W.rows_of(np.array([len(k) for k in keys]))
            first, end = (np.concatenate([np.frombuffer(bytes(r[c]), np.int32) for r in found]) + base[owner] for c in ("first", "end"))
            all_keys = np.concatenate(keys)
            order = np.argsort(all_keys, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[all_keys >> np.uint64(64 - _TABLE_BITS)] = True
            self.of[size] = table, all_keys[order], first[order], end[order], owner[order].astype(np.int32), b"".join(texts), [r["item"] for r in found]
        self.met: dict[tuple[int, int], dict[bytes, frozenset[str]]] = {}

    def items(self, size: int, at: int, words: bytes) -> frozenset[str] | None:
        """The items with a window of these words; ``at`` is where its hash stands first. What has been met once is kept."""
        known = self.met.get((size, at))
        if known is None:
            _, keys, first, end, owner, text, names = self.of[size]
            found: dict[bytes, set] = {}
            for k in range(at, int(np.searchsorted(keys, keys[at], side="right"))):
                name = names[owner[k]]
                found.setdefault(text[first[k] : end[k]], set()).update([name] if name is not None else [])
            known = self.met[size, at] = {w: frozenset(x) for w, x in found.items()}
        return known.get(words)


def _scan(data: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int, int, int]], set[str]]]]:
    """Words per text, and for each text with hits its (first word, end word, first byte, end byte) and items."""
    starts, ends, before = W.spans(data, offsets, W.LETTERS)
    words = W.hashes(data, starts, ends)
    text_of = W.rows_of(np.diff(before))
    hits: dict[int, tuple[list, set]] = {}
    for size, (table, keys, *_) in windows.of.items():
        found = W.runs(words, size)
        maybe = np.flatnonzero(table[found >> np.uint64(64 - _TABLE_BITS)])
        maybe = maybe[text_of[maybe] == text_of[maybe + size - 1]]
        at = np.searchsorted(keys, found[maybe])
        at[at == len(keys)] = 0
        equal = keys[at] == found[maybe]
        for i, key in zip(maybe[equal].tolist(), at[equal].tolist(), strict=True):
            here = b" ".join(W.LOWER[data[starts[k] : ends[k]]].tobytes() for k in range(i, i + size))
            if (items := windows.items(size, key, here)) is not None:
                text = int(text_of[i])
                spans, ids = hits.setdefault(text, ([], set()))
                spans.append((i - int(before[text]), i - int(before[text]) + size, int(starts[i] - offsets[text]), int(ends[i + size - 1] - offsets[text])))
                ids.update(items)
    return np.diff(before), hits


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            p = out[-1]
            out[-1] = (p[0], max(p[1], b), p[2], max(p[3], d))
        else:
            out.append((a, b, c, d))
    return out


_SPAN = pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "first_byte", "end_byte")])
_SCHEMA = "n_words bigint, spans array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_bytes: int = 16 << 20, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, spans (merged runs of hit words, with bytes), items (sorted as strings), and the text if asked for.

    A window is ``n`` consecutive words of an item; all words of any occurrence in a text are hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, math.ceil((total or 0) / block_bytes))
    pieces = items.mapInArrow(_windowed(n), _PIECES)
    key = docs.select(F.col(id_col).alias("id")).schema["id"]
    empty = F.array().cast("array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>")
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"), empty.alias("spans"), F.array().cast("array<string>").alias("items"))
    scratch = Scratch(spark, "contamination")
    if blocks > 1:
        pieces = scratch.save(pieces, "pieces")
    for k in range(blocks):
        block = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item", "keys"), F.lit(blocks)) == k)
        # One block, of a documented size.
        shared = spark.sparkContext.broadcast(Windows(block.collect()))

        keep_text = with_text or k < blocks - 1

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, later: bool = k > 0, keep_text: bool = keep_text) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                n_words, spans, found = np.zeros(len(batch), dtype=np.int64), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
                if later:
                    spans, found = ([[tuple(s.values()) for s in row] for row in batch.column(3).to_pylist()], batch.column(4).to_pylist())
                for lo, data, offsets in W.slices(batch.column(1)):
                    n_words[lo : lo + len(offsets) - 1], hits = _scan(data, offsets, windows)
                    for text, (more, ids) in hits.items():
                        spans[lo + text] = _merged([*spans[lo + text], *more])
                        found[lo + text] = sorted({*found[lo + text], *ids})
                as_rows = [[dict(zip(_SPAN.names, s, strict=True)) for s in row] for row in spans]
                out = {"id": batch.column(0), "text": batch.column(1), "n_words": pa.array(n_words), "spans": pa.array(as_rows, pa.list_(_SPAN)), "items": pa.array(found, pa.list_(pa.string()))}
                if not keep_text:
                    del out["text"]
                yield pa.RecordBatch.from_pydict(out)

        state = state.mapInArrow(scan, f"id {key.dataType.simpleString()}, {'text string, ' * keep_text}{_SCHEMA}")
        if k < blocks - 1:
            state = scratch.save(state, f"block-{k}")
    return state.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """The documents without hits; or with ``remove="spans"`` all documents, their hit spans cut out of the text.

    All columns of the documents stay; the cut text replaces the text column.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(F.struct(*[F.col(c) for c in (id_col, *rest)]).alias("row"), F.col(text_col).alias("text"))
    found = find_contamination(packed, benchmark, id_col="row", text_col="text", with_text=True, **options)
    if remove == "documents":
        found = found.where(F.size("spans") == 0)
        text = F.col("text")
    elif remove == "spans":
        cut = F.aggregate(
            "spans",
            F.struct(F.lit(1).cast("int").alias("at"), F.lit("").alias("kept")),
            lambda a, s: F.struct((s["end_byte"] + 1).cast("int").alias("at"), F.concat(a["kept"], F.decode(F.substring(F.encode("text", "utf-8"), a["at"], (s["first_byte"] + 1 - a["at"]).cast("int")), "utf-8")).alias("kept")),
        )
        cut = F.when(F.size("spans") > 0, F.struct(cut["at"].alias("at"), cut["kept"].alias("kept")))
        tail = F.decode(F.substring(F.encode("text", "utf-8"), cut["at"], F.octet_length("text")), "utf-8")
        text = F.when(F.size("spans") > 0, F.concat(cut["kept"], tail)).otherwise(F.col("text"))
    else:
        raise ValueError('remove is "documents" or "spans"')
    return found.select(*[text.alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
