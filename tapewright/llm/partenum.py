"""PartEnum signatures: sets of similar size and overlap share at least one signature, with certainty.

Sizes are cut into bands that grow by 1 / threshold. Two sets whose Jaccard similarity reaches the
threshold differ in at most ``k`` elements, where ``k`` follows from the upper end of the larger set's
band. The band partitions the feature domain by hash, in two levels: into ``k // 2 + 1 + slack``
partitions of three parts each. At most ``k // 2`` partitions hold two differing elements or more, so
``slack + 1`` of them hold one at most, and of such a partition two parts of three are equal. A signature is
one of the subsets of two parts of a partition, enumerated, with what the set holds of it. So two similar
sets share a signature in each of ``slack + 1`` partitions. A set with at most ``slack`` partitions in which a
subset is empty needs no signatures for empty subsets; a set with more of them adds these, so nothing is lost.

Where the threshold lets sets differ in so many elements that parts of parts would often be empty (``levels``),
the second level is left out: ``k + 1 + slack`` partitions, of which ``slack + 1`` are equal, and each is a signature.

Each set takes the signatures of its own band and of the next one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tapewright.llm import words as W

_U = np.uint64
#: By parts of a partition: the subsets that are signatures, and how many differing elements a partition may hold before none is equal.
_SUBSETS = {3: ([1, 2], [0, 2], [0, 1]), 1: ([0],)}
_SPOILS = {3: 2, 1: 1}


def largest_difference(sizes: int, p: int, q: int) -> int:
    """Most elements in which two sets of together ``sizes`` elements differ at similarity p / q or more."""
    return (q - p) * sizes // (q + p)


def _slack(k: int, smallest: float, parts: int, most: float) -> int | None:
    """Partitions to add so that a set of ``smallest`` elements rarely leaves subsets of more partitions empty; None if that takes more than ``most``."""
    slack = 1
    while slack <= most:
        many = k // _SPOILS[parts] + 1 + slack
        subset = _SUBSETS[parts][0]
        empty = len(_SUBSETS[parts]) * many * math.exp(-smallest * len(subset) / (parts * many))
        if slack >= empty + 4 * math.sqrt(empty):
            return slack
        slack += 1
    return None


@lru_cache
def levels(p: int, q: int) -> int:
    """Parts of a partition at a threshold: three, unless sets of a thousand elements would need a quarter more partitions for it."""
    size = 1000
    k = largest_difference(2 * (size * q // p), p, q)
    return 3 if _slack(k, size * p / q, 3, k / 8) else 1


@lru_cache
def bands(p: int, q: int, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands, their k, and their number of partitions; they reach beyond ``up_to`` by two bands."""
    low, k, many = [1], [], []
    parts = levels(p, q)
    while len(low) < 3 or low[-3] <= up_to:
        high = low[-1] * q // p
        k.append(largest_difference(2 * high, p, q))
        smallest = low[-1] * p / q
        slack = _slack(k[-1], smallest, parts, smallest) or math.ceil(smallest)
        many.append(k[-1] // _SPOILS[parts] + 1 + slack)
        low.append(high + 1)
    return np.array(low[:-1]), np.array(k), np.array(many)


def shingle_sets(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): each text's distinct n-word shingles as sorted hashes; fewer words form one shingle."""
    counts = np.diff(before)
    runs = W.runs(words, n) if len(words) else np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, (a, c) in enumerate(zip(before[:-1].tolist(), counts.tolist(), strict=True)):
        if c >= n:
            own = np.unique(runs[a : a + c - n + 1])
        elif c:
            own = W.mix(W.runs(words[a : a + c], c) + _U(c))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets


def signatures(elements: np.ndarray, offsets: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set index) of all sets."""
    sizes = np.diff(offsets)
    if not len(elements):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, k, partitions = bands(p, q, 1 << int(sizes.max()).bit_length())
    parts = levels(p, q)
    own = np.searchsorted(low, sizes, side="right") - 1
    spread, value = W.mix(elements ^ _U(0xA24BAED4963EE407)), W.mix(elements + _U(0x9FB21C651E98DF25))
    halves = (value & _U(0xFFFFFFFF)).astype(np.float64), (value >> _U(32)).astype(np.float64)
    row = W.rows_of(sizes)
    found, who = [], []
    for step in (0, 1):
        band = own + step
        many = np.where((sizes > 0) & (k[band] > 0), partitions[band], 0)
        slack = partitions[band] - k[band] // _SPOILS[parts] - 1
        at = np.concatenate([[0], np.cumsum(many)])
        use = many[row] > 0
        cells = (many[row[use]] * parts).astype(np.uint64)
        cell = at[row[use]] * parts + (((spread[use] >> _U(32)) * cells) >> _U(32)).astype(np.int64)
        total = int(at[-1]) * parts
        held = np.bincount(cell, minlength=total).reshape(-1, parts)
        lo, hi = (np.bincount(cell, weights=h[use], minlength=total).astype(np.uint64).reshape(-1, parts) for h in halves)
        set_of = W.rows_of(many)
        partition = np.arange(len(set_of)) - at[set_of]
        filled = np.stack([held[:, s].sum(axis=1) > 0 for s in _SUBSETS[parts]], axis=1)
        gaps = np.bincount(set_of[~filled.all(axis=1)], minlength=len(sizes))
        also_empty = (gaps > slack)[set_of]
        for out, subset in enumerate(_SUBSETS[parts]):
            keep = filled[:, out] | also_empty
            place = (band[set_of[keep]].astype(np.uint64) << _U(40)) | (partition[keep] * parts + out).astype(np.uint64)
            low_sum, high_sum = (x[keep][:, subset].sum(axis=1, dtype=np.uint64) for x in (lo, hi))
            found.append(W.mix(W.mix(low_sum + high_sum * _U(0x9E3779B97F4A7C15)) ^ W.mix(place)))
            who.append(set_of[keep])
    return np.concatenate(found), np.concatenate(who)
