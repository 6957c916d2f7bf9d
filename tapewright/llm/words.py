"""Words of whole Arrow text columns as arrays: spans, 64-bit hashes, runs of words.

Texts are UTF-8 bytes. Which bytes make up words is a table of 256 flags; bytes of 0x80 and above
always belong to words here, so a word never cuts a code point. All functions take many texts at
once and work in slices of about a megabyte, so that memory stays a small multiple of one slice or
of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken per slice; a longer text forms a slice of its own.
SLICE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII digits and letters and every byte of a longer code point.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_U = np.uint64
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit (splitmix64's finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4096), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more than texts)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = kind[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cut = offsets[:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, letters A-Z lower-cased."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        base, size = int(starts[i]), int(ends[j - 1] - starts[i])
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_CODES[data[base : base + size]] * powers(_BASE, size), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * powers(_BASE_INVERSE, size)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n consecutive words; runs across texts are for the caller to leave out."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * _U(0xD1342543DE82EF95) + words[k : k + count]
    return mix(out)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """For counts [2, 0, 1]: [0, 0, 2]."""
    return np.repeat(np.arange(len(counts)), counts)
