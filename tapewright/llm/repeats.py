"""Suffix-array dedup by prefix-free parsing: bytes covered by a long string that starts twice in the corpus.

*Triggers and parse.* A rolling hash over 8 bytes is taken at every byte. The trigger of a start ``i``
is the first smallest hash among the ``GAP`` starts from ``i`` on, so it depends only on the bytes of
the string that starts there, and every string of ``length`` bytes has one. The triggers cut each text
into phrases. Starts with the same trigger ``t`` are the suffixes of the phrase before ``t``; each is
followed by the same rest of the parse.

*Order of the parse.* A string of ``length`` bytes is a phrase suffix (``t - i`` bytes) and the parse
suffix that begins at ``t``. Rows of one trigger each are sorted by a fingerprint of the parse suffix
and then of everything that the trigger's starts cover. In that order

* a trigger whose parse suffix has no equal neighbour covers no repeat and is left out,
* one whose whole cover has an equal neighbour is repeated at all its starts,
* only those between, at the edges of repeats, go on.

*Dictionary suffixes and parse combined.* For these, each phrase suffix is joined with its parse suffix
and the combinations are sorted; equal neighbours are repeated strings.

Only equality over ``length`` bytes is asked for, so the sort keys are xxHash fingerprints of the
strings (128 bits wherever equality decides about bytes) in place of ranks; no part of the corpus is
held as a suffix array by one task, and equal strings within a batch meet before the shuffle.

*Passages.* A second, shorter length can be asked about at the same time. Texts without a repeat of the
shorter length hold none of the longer one, so the longer is only looked for in what is left.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; a row's identity is
its id and its text (by md5), rows that repeat both are repeats of each other; null ids are an id of their own;
an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm import words as W
from tapewright.llm.scratch import Scratch

#: Starts that share one search for a trigger.
GAP = 128
_ROLL = 8
_U = np.uint64
#: What a row says about a range of starts: all repeated; still open; repeated, and what open ones may equal.
REPEATED, OPEN, WITNESS = 0, 1, 2
#: Rows on their way to the sort: seen once, standing for several equal ones of its batch, known already.
_ONCE, _SEVERAL, _KNOWN = 0, 1, 2


def triggers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigger, first start, last start) of every trigger, over all starts of whole strings of ``length``."""
    none = (np.zeros(0, dtype=np.int64),) * 4
    if len(data) < length:
        return none
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << _U(8))
    x = x[:-2] | (x[2:] << _U(16))
    x = x[:-4] | (x[4:] << _U(32))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    low = (x & _U(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
    step = 1
    while step < GAP:
        np.minimum(low[:-step], low[step:], out=low[:-step])
        low = low[:-step]
        step *= 2
    low = (low & _U(0xFFFFFFFF)).astype(np.int64)
    many = np.maximum(np.diff(offsets) - length + 1, 0)
    text = W.rows_of(many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][text]
    if not len(start):
        return none
    at = low[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return text[first], at[first], start[first], start[last]


def _hashed(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    view, f = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((f(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), dtype=np.uint64, count=len(lo)).view(np.int64)


def _hashed_twice(data: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of fingerprint for the strings of ``length`` bytes at ``lo``."""
    view, f = memoryview(data), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([f(view[a : a + length]) for a in lo.tolist()]), dtype=np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _where(start: np.ndarray, width: np.ndarray | int, kind: np.ndarray | int) -> np.ndarray:
    """Start, width (below 2**16) and kind in one integer."""
    return (np.asarray(start, dtype=np.int64) << 20) | (np.asarray(width, dtype=np.int64) << 4) | kind


def _parsed(length: int):
    """From (id, mark, text): rows (parse, cover, id, mark, place), equal ones of a batch met already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = length - GAP + 1
        for batch in batches:
            parts = []
            for lo, data, offsets in W.slices(batch.column(2)):
                text, at, first, last = triggers(data, offsets, length)
                parse, cover = _hashed(data, at, at + rest), _hashed(data, first, last + length)
                parts.append((parse, cover, text + lo, first - offsets[text], last - first))
            if not parts:
                continue
            parse, cover, row, first, width = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((cover, parse))
            same = np.zeros(len(order) + 1, dtype=bool)
            same[1:-1] = (parse[order][1:] == parse[order][:-1]) & (cover[order][1:] == cover[order][:-1])
            several, lead = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
            several[order] = same[1:] | same[:-1]
            lead[order] = ~same[:-1]
            ids, marks = batch.column(0), batch.column(1)
            go = np.flatnonzero(lead)
            yield _rows(parse[go], cover[go], ids, marks, row[go], _where(first[go], width[go], np.where(several[go], _SEVERAL, _ONCE)))
            # What is known to be repeated goes along as ranges of starts; rows are in order of text and start.
            known = np.flatnonzero(several)
            if len(known):
                new = np.ones(len(known), dtype=bool)
                new[1:] = (row[known][1:] != row[known][:-1]) | (first[known][1:] != (first + width)[known][:-1] + 1)
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(known)) - 1
                a, z = known[begin], known[end]
                yield _rows(W.mix((row[a] * 1_000_003 + first[a]).astype(np.uint64)).view(np.int64), first[z] + width[z], ids, marks, row[a], _where(first[a], 0, _KNOWN))

    return run


def _rows(parse: np.ndarray, cover: np.ndarray, ids: pa.Array, marks: pa.Array, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(parse), pa.array(cover), ids.take(row), marks.take(row), pa.array(place)], ["parse", "cover", "id", "mark", "place"])


def _sorted_parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (parse, cover): ranges of starts with REPEATED, OPEN or WITNESS. One row is carried over."""
    held: pa.RecordBatch | None = None
    before = (None, None)  # parse and cover of the row before the held one
    earlier = False  # whether the held row's cover came after another cover of the same parse
    for batch in batches:
        if not len(batch):
            continue
        held, before, earlier, out = _settle(batch if held is None else pa.concat_batches([held, batch]), before, earlier, False)
        yield out
    if held is not None:
        yield _settle(held, before, earlier, True)[3]


def _settle(batch: pa.RecordBatch, before: tuple, earlier: bool, end: bool):
    parse, cover, place = (batch.column(c).to_numpy() for c in ("parse", "cover", "place"))
    kind = place & 15
    real = kind != _KNOWN
    # A known row sits at a random place of the order; it must not part two equal rows, so neighbours are among real rows.
    at = np.flatnonzero(real)
    p, c = parse[at], cover[at]
    m = len(at)
    same_parse, same_cover = np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=bool)
    if m:
        same_parse[1:-1] = p[1:] == p[:-1]
        same_cover[1:-1] = same_parse[1:-1] & (c[1:] == c[:-1])
        same_parse[0] = before[0] is not None and p[0] == before[0]
        same_cover[0] = bool(same_parse[0]) and c[0] == before[1]
    # Whether a row's cover has another cover before it within its parse, known from the cover's first row on.
    has_earlier = np.zeros(m, dtype=bool)
    if m:
        first = ~same_cover[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(m), -1))
        has_earlier = np.where(start >= 0, same_parse[:-1][np.maximum(start, 0)], earlier)
    many = (kind[at] == _SEVERAL) | same_cover[1:] | same_cover[:-1]
    last = ~same_cover[1:]
    other = same_parse[1:] & ~same_cover[1:] | has_earlier
    out_kind = np.where(many, np.where(last & other, WITNESS, REPEATED), OPEN)
    go = many | same_parse[1:] | same_parse[:-1]
    stop = m if end else max(m - 1, 0)
    go[stop:] = False
    keep = at[go]
    lo = place >> 20
    hi = np.where(real, lo + ((place >> 4) & 0xFFFF), cover)
    known = np.flatnonzero(~real)
    rows = np.concatenate([keep, known])
    kinds = np.concatenate([out_kind[go], np.full(len(known), REPEATED)])
    take = pa.array(rows)
    out = pa.RecordBatch.from_arrays(
        [batch.column("id").take(take), batch.column("mark").take(take), pa.array(lo[rows]), pa.array(hi[rows]), pa.array(kinds.astype(np.int32))], ["id", "mark", "lo", "hi", "kind"]
    )
    if end or not m:
        return None, before, earlier, out
    tail = int(at[-1])
    kept = pa.concat_batches([batch.slice(tail, 1)])
    if m >= 2:
        before = (p[-2], c[-2])
    return kept, before, bool(has_earlier[-1]), out


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Ranges (first, last) of starts, sorted and joined where they touch."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), dtype=bool)
    new[1:] = ranges[1:, 0] > end[:-1] + 1
    first = np.flatnonzero(new)
    return np.stack([ranges[first, 0], end[np.append(first[1:], len(ranges)) - 1]], axis=1)


def _combined(length: int):
    """From (row, text, ranges): rows (w, v, row, place) of the open and witness starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = np.asarray(lists.offsets)
            flat = lists.values
            lo_, hi_, kind_ = (flat.field(k).to_numpy() for k in ("lo", "hi", "kind"))
            w, v, row, place = [], [], [], []
            for base, data, offsets in W.slices(batch.column(1)):
                text = W.rows_of(np.diff(bounds[base : base + len(offsets)]))
                a, z = bounds[base], bounds[base + len(offsets) - 1]
                use = kind_[a:z] != REPEATED
                lo, width, kind, text = lo_[a:z][use], (hi_ - lo_)[a:z][use] + 1, kind_[a:z][use], text[use]
                each = W.rows_of(width)
                start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
                x, y = _hashed_twice(data, start + offsets[text[each]], length) if len(each) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                w.append(x), v.append(y), row.append(text[each] + base), place.append(_where(start, 0, kind[each]))
            if not w:
                continue
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(w)), pa.array(np.concatenate(v)), batch.column(0).take(take), pa.array(np.concatenate(place))],
                ["w", "v", "row", "place"],
            )

    return run


def _sorted_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (w, v, witnesses first): the open starts whose string has an equal one."""
    held = None
    before = None  # whether the held row equals the row before it, and if so that row repeats
    for batch in batches:
        if not len(batch):
            continue
        held, before, out = _equal(batch if held is None else pa.concat_batches([held, batch]), before, False)
        yield out
    if held is not None:
        yield _equal(held, before, True)[2]


def _equal(batch: pa.RecordBatch, before: bool | None, end: bool):
    w, v, place = (batch.column(c).to_numpy() for c in ("w", "v", "place"))
    n = len(w)
    same = np.zeros(n + 1, dtype=bool)
    same[1:-1] = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    same[0] = bool(before)
    go = (same[1:] | same[:-1]) & ((place & 15) == OPEN)
    if not end:
        go[-1] = False
    take = pa.array(np.flatnonzero(go))
    out = pa.RecordBatch.from_arrays([batch.column("row").take(take), pa.array(place[go] >> 20)], ["row", "start"])
    return (None if end else pa.concat_batches([batch.slice(n - 1, 1)])), bool(same[n - 1]), out


def _cut(length: int, with_kept: bool):
    """From (id, mark, text, ranges, starts): what is removed and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digest, kept_bytes = [], [], []
            ranges, starts = batch.column(3), batch.column(4)
            for i in range(len(batch)):
                text = (batch.column(2)[i].as_py() or "").encode()
                flat = ranges[i].values
                found = np.stack([flat.field("lo").to_numpy(), flat.field("hi").to_numpy()], axis=1)[flat.field("kind").to_numpy() != OPEN]
                if starts[i].is_valid:
                    one = starts[i].values.to_numpy()
                    found = np.concatenate([found, np.stack([one, one], axis=1)])
                # A range of starts covers length - 1 bytes beyond its last start, so touching covers join.
                covered = _merge(np.stack([found[:, 0], found[:, 1] + length - 1], axis=1)) if len(found) else np.zeros((0, 2), dtype=np.int64)
                sha, kept, at = hashlib.sha256(), [], 0
                for a, z in covered.tolist():
                    kept.append(text[at:a])
                    at = z + 1
                kept.append(text[at:])
                for piece in kept:
                    sha.update(piece)
                spans.append([{"first_byte": a, "end_byte": z + 1} for a, z in covered.tolist()])
                digest.append(sha.hexdigest())
                kept_bytes.append(b"".join(kept) if with_kept else None)
            out = {"id": batch.column(0), "mark": batch.column(1), "spans": pa.array(spans, pa.list_(_SPAN)), "kept_sha256": pa.array(digest, pa.string())}
            if with_kept:
                out["kept"] = pa.array(kept_bytes, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


_SPAN = pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())])


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"id": "its_id", "mark": "its_mark"})
    return left.join(right, (left["mark"] == right["its_mark"]) & left["id"].eqNullSafe(right["its_id"]), how).drop("its_id", "its_mark")


def _candidates(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Of (id, mark, text), the texts that may hold a repeat, with ranges of their starts and a number for each row."""
    kind = rows.schema["id"].dataType.simpleString()
    parsed = rows.mapInArrow(_parsed(length), f"parse bigint, cover bigint, id {kind}, mark binary, place bigint")
    ranges = parsed.repartition("parse").sortWithinPartitions("parse", "cover").mapInArrow(_sorted_parse, f"id {kind}, mark binary, lo bigint, hi bigint, kind int")
    marked = ranges.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("ranges"))
    found = _joined(rows, marked, "inner").select(F.monotonically_increasing_id().alias("row"), "id", "mark", "text", "ranges")
    return scratch.save(found, f"candidates-{length}")


def _removed(some: DataFrame, length: int, with_kept: bool) -> DataFrame:
    """(id, mark, spans, kept_sha256) of the candidates, and the bytes kept if asked for."""
    edges = some.where(F.exists("ranges", lambda r: r["kind"] != REPEATED)).select("row", "text", "ranges")
    opened = edges.mapInArrow(_combined(length), "w bigint, v bigint, row bigint, place bigint")
    starts = opened.repartition("w").sortWithinPartitions("w", "v").mapInArrow(_sorted_starts, "row bigint, start bigint")
    starts = starts.groupBy("row").agg(F.collect_set("start").alias("starts"))
    schema = f"id {some.schema['id'].dataType.simpleString()}, mark binary, spans array<struct<first_byte:bigint,end_byte:bigint>>, kept_sha256 string" + ", kept binary" * with_kept
    return some.join(starts, "row", "left").select("id", "mark", "text", "ranges", "starts").mapInArrow(_cut(length, with_kept), schema).dropDuplicates(["id", "mark"])


def covered_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end_byte"] - s["first_byte"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None, with_kept: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, spans removed, kept_sha256, and the bytes kept if asked for.

    A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else. Kept
    bytes may end within a code point, so they come as binary. With ``passage``, a length below ``length``,
    a column passage_bytes counts the bytes that strings of that length cover which start elsewhere too;
    these are reported, not removed.
    """
    if not GAP + _ROLL < (passage or length) <= length < 1 << 16:
        raise ValueError(f"lengths must be over {GAP + _ROLL}, and that of passages not above that of what is removed")
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))
    searched, passages = rows, None
    if passage:
        some = _candidates(rows, passage, scratch)
        # Written, so that it is done, and its shuffles can go, before the next length begins.
        passages = scratch.save(_removed(some, passage, False).select("id", "mark", covered_bytes(F.col("spans")).alias("passage_bytes")), "passages")
        searched = some.select("id", "mark", "text")
    cut = _removed(_candidates(searched, length, scratch), length, with_kept)
    whole = rows.select("id", "mark", F.octet_length("text").cast("bigint").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"), *[F.encode("text", "utf-8").alias("bytes")] * with_kept)
    if passages is not None:
        cut = _joined(passages, cut, "left")
    out = _joined(whole, cut, "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("spans", F.array().cast("array<struct<first_byte:bigint,end_byte:bigint>>")).alias("spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
        *[F.coalesce("kept", "bytes").alias("kept")] * with_kept,
        *([F.coalesce("passage_bytes", F.lit(0)).alias("passage_bytes")] if passage else []),
    )
