"""Cutting stock over a histogram of lengths: which lengths share a sequence, and how often.

A linear program over patterns (multisets of lengths that fit a sequence) covers every length of the
histogram as often as it occurs. It is solved by column generation over all lengths: a knapsack dynamic
program over the dual prices, which may take a length as often as it fits, gives for every length the best
pattern that holds it; all of those that would lower the cost join a pool, and the program is solved over the
pool before prices are asked for again, until no pattern lowers the cost or the cost is within ``gap`` or one
sequence of the bound that the prices prove. There is no cap: demands are shifted by about 1e-8, so that each
exchange of patterns lowers the cost and none comes back.

The first basis is a greedy filling: every pattern of it uses up one length, so its columns are triangular
and their counts are a feasible solution. Pattern counts are rounded, down and to the nearest number that the
demand allows; what remains is filled sequence by sequence, the longest length first and then the subset of the
rest that fills it best, and the plan of fewer sequences stands. Work and memory depend on the sequence
length, never on how many pieces there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np

#: Share of the optimum within which the linear program may stop.
GAP = 1e-4
#: Smallest gain for which a pattern enters, and smallest pivot.
TOLERANCE = 1e-7
#: Patterns compared by what they would gain before one enters; exchanges after which the inverse is brought up to date.
_TRIED, _PENDING, _ANEW = 8, 64, 2048


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each room, the highest total price of lengths (ascending ``sizes``, each as often as it fits), and the length taken there (-1: none)."""
    place = np.flatnonzero(price > 0)
    items, gain = sizes[place], price[place]
    best, taken = np.zeros(capacity + 1), [-1] * (capacity + 1)
    fits = np.searchsorted(items, np.arange(capacity + 1), side="right").tolist()
    for room in range(int(items[0]) if len(items) else capacity + 1, capacity + 1):
        with_it = gain[: fits[room]] + best[room - items[: fits[room]]]
        k = int(with_it.argmax())
        best[room] = best[room - 1]
        if with_it[k] > best[room]:
            best[room], taken[room] = with_it[k], int(place[k])
    return best, taken


def _taken(taken: list[int], sizes: list[int], room: int) -> list[int]:
    """Places of the lengths that a knapsack of that room holds."""
    out = []
    while room > 0:
        k = taken[room]
        if k < 0:
            room -= 1
        else:
            out.append(k)
            room -= sizes[k]
    return out


def best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of lengths of the highest total price that fits, and that price."""
    best, taken = _knapsack(sizes, price, capacity)
    return np.bincount(np.array(_taken(taken, sizes.tolist(), capacity), dtype=np.int64), minlength=len(sizes)).astype(float), float(best[capacity])


def _priced(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[list[tuple[int, ...]], float]:
    """For every length, the best pattern that holds it, if it is worth more than one sequence; and the price of the best of all."""
    best, taken = _knapsack(sizes, price, capacity)
    each, plain = price + best[capacity - sizes], sizes.tolist()
    found = {tuple(sorted([k, *_taken(taken, plain, capacity - plain[k])])) for k in np.flatnonzero(each > 1 + TOLERANCE).tolist()}
    return sorted(found), float(best[capacity])


def _greedy(sizes: list[int], demand: list[float], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns, as many as lengths and linearly independent, the inverse of their matrix, and counts that meet the demand exactly."""
    place = {s: k for k, s in enumerate(sizes)}
    left = dict(zip(sizes, demand, strict=True))
    columns, counts, inverse = [], [], np.zeros((len(sizes), len(sizes)))
    while left:
        once = Counter({s: capacity // s for s in left})
        lengths = Counter(_fill(sorted(left, reverse=True), once, capacity))
        n = min(left[s] / k for s, k in lengths.items())
        used_up = min(lengths, key=lambda s: (left[s] / lengths[s], s))
        column = np.zeros(len(sizes))
        for s, k in lengths.items():
            column[place[s]] = k
            left[s] = max(left[s] - n * k, 0.0)
        del left[used_up]
        # A length that is used up stands in no later column, so the inverse follows row by row.
        row = np.zeros(len(sizes))
        row[place[used_up]] = 1
        for j, earlier in enumerate(columns):
            if earlier[place[used_up]]:
                row -= earlier[place[used_up]] * inverse[j]
        inverse[len(columns)] = row / column[place[used_up]]
        columns.append(column), counts.append(n)
    return np.array(columns).T, inverse, np.array(counts)


class _Basis:
    """The patterns in use, the transposed inverse of their matrix (exchanges since the last update aside), counts and dual prices."""

    def __init__(self, columns: np.ndarray, inverse: np.ndarray, demand: np.ndarray) -> None:
        self.columns, self.inverse, self.demand = columns, np.ascontiguousarray(inverse.T), demand
        # The inverse stands for inverse - right.T @ left, of as many rows as are pending.
        self.left, self.right = np.zeros((_PENDING, len(demand))), np.zeros((_PENDING, len(demand)))
        self.pending = self.changes = 0
        self.count, self.dual = inverse @ demand, inverse.sum(axis=0)

    def steps(self, patterns: list[np.ndarray]) -> np.ndarray:
        """What each count loses per unit of each pattern (one row each)."""
        flat = np.concatenate(patterns)
        first = np.cumsum([0, *(len(p) for p in patterns[:-1])])
        out = np.add.reduceat(self.inverse[flat], first, axis=0)
        if self.pending:
            out -= np.add.reduceat(self.right[: self.pending, flat], first, axis=1).T @ self.left[: self.pending]
        return out

    def enter(self, pattern: np.ndarray, step: np.ndarray, out: int, amount: float) -> None:
        n = self.pending
        row = (self.inverse[:, out] - self.left[:n, out] @ self.right[:n]) / step[out]
        self.dual = self.dual - (self.dual[pattern].sum() - 1) * row
        self.count = np.maximum(self.count - amount * step, 0)
        self.count[out] = amount
        self.columns[:, out] = np.bincount(pattern, minlength=len(step))
        self.left[n], self.right[n] = step, row
        self.left[n, out] -= 1
        self.pending, self.changes = n + 1, self.changes + 1
        if self.changes % _ANEW == 0:
            self.inverse, self.pending = np.ascontiguousarray(np.linalg.inv(self.columns).T), 0
            self.count, self.dual = np.maximum(self.demand @ self.inverse, 0), self.inverse.sum(axis=1)
        elif self.pending == _PENDING:
            self.inverse -= self.right.T @ self.left
            self.pending = 0

    def improve(self, pool: list[tuple[int, ...]], enough: float) -> None:
        """Exchanges until no pattern of the pool lowers the cost, or it is ``enough``; of the most valuable ones, that which gains most enters."""
        patterns = [np.array(p) for p in pool]
        flat = np.concatenate(patterns)
        first = np.cumsum([0, *(len(p) for p in patterns[:-1])])
        while self.count.sum() > enough:
            value = np.add.reduceat(self.dual[flat], first)
            top = np.argpartition(-value, min(_TRIED, len(value)) - 1)[:_TRIED]
            top = top[value[top] > 1 + TOLERANCE]
            if not len(top):
                return
            step = self.steps([patterns[j] for j in top.tolist()])
            ratio = np.divide(self.count, step, out=np.full(step.shape, np.inf), where=step > TOLERANCE)
            out = ratio.argmin(axis=1)
            amount = ratio[np.arange(len(top)), out]
            gain = np.where(np.isfinite(amount), amount * (value[top] - 1), -1.0)
            j = int(gain.argmax())
            if gain[j] < 0:
                return
            self.enter(patterns[int(top[j])], step[j], int(out[j]), float(amount[j]))


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, gap: float = GAP, start: Iterable[tuple[int, ...]] = ()) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (one column each) and their counts of the linear program, and a proven lower bound of its optimum.

    It stops within a share ``gap`` or one sequence of the bound (at the optimum if ``gap`` is 0). ``start`` are
    patterns, by places of their lengths, that the pool begins with.
    """
    # Shifted by different amounts, so that no two counts run out at once and every exchange gains.
    shifted = demand + 1e-8 * (1 + np.arange(len(sizes)) * 0.6180339887498949 % 1)
    columns, inverse, _ = _greedy(sizes.tolist(), shifted.tolist(), capacity)
    basis = _Basis(columns, inverse, shifted)
    least = float(sizes @ demand) / capacity
    pool = list(start)
    while True:
        enough = least + max(gap * least, 1.0) if gap else 0.0
        if pool:
            basis.improve(pool, enough)
        if basis.count.sum() <= enough:
            break
        price = np.maximum(basis.dual, 0)
        found, value = _priced(sizes, price, capacity)
        # Prices divided by the best value are feasible, which bounds the optimum from below.
        least = max(least, float(price @ demand) / max(value, 1.0))
        if not found or set(found) <= set(pool):
            break
        pool = sorted({*pool, *found})
        if len(pool) > 4 * len(sizes):
            # The pool is bounded by the sequence length; what leaves it can be priced again.
            worth = sorted(((float(basis.dual[list(p)].sum()), p) for p in pool), reverse=True)
            pool = [p for _, p in worth[: 3 * len(sizes)]]
    return basis.columns, basis.count, least


def _fill(sizes: list[int], left: Counter, capacity: int) -> tuple[int, ...]:
    """One sequence from what is left: its longest length, then the subset of others that fills it best."""
    first = sizes[0]
    room = capacity - first
    reach, steps, items = 1, [], []
    mask = (1 << (room + 1)) - 1
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(left[s] - (s == first), room // s)):
            items.append(s)
            steps.append(reach)
            reach |= (reach << s) & mask
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, [first]
    for s, before in zip(reversed(items), reversed(steps), strict=True):
        if not before >> total & 1:
            chosen.append(s)
            total -= s
    return tuple(chosen)


def _filled(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences one pattern after the other, until nothing is left."""
    plan = []
    while left:
        lengths = _fill(sorted(left, reverse=True), left, capacity)
        plan.append((lengths, _take(left, Counter(lengths))))
    return plan


def _take(left: Counter, need: Counter, most: int | None = None) -> int:
    """Takes a pattern out of what is left as often as it can be had (at most ``most`` times); how often."""
    times = min(left[s] // k for s, k in need.items())
    times = times if most is None else min(times, most)
    for s, k in need.items():
        left[s] -= k * times
        if not left[s]:
            del left[s]
    return times


def _rounded(left: Counter, patterns: list[tuple[Counter, float]], capacity: int, up: float) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as their counts say, rounded down; once more where a fraction of at least ``up`` is left and the demand allows it; then the rest."""
    left = Counter(left)
    plan = [(need, _take(left, need, int(n + 1e-6))) for need, n in patterns]
    by_rest = sorted(((n + 1e-6) % 1, k) for k, (_, n) in enumerate(patterns))
    plan += [(patterns[k][0], _take(left, patterns[k][0], 1)) for rest, k in reversed(by_rest) if rest >= up]
    return [(tuple(sorted(need.elements(), reverse=True)), n) for need, n in plan if n] + _filled(left, capacity)


def cutting_stock(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences); every length of the histogram is placed exactly as often as it occurs."""
    whole = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    left = Counter({s: n for s, n in histogram.items() if 0 < s < capacity and n > 0})
    if not left:
        return whole
    sizes = np.array(sorted(left))
    place = {s: k for k, s in enumerate(sizes.tolist())}
    greedy = _filled(Counter(left), capacity)
    start = [tuple(sorted(place[s] for s in lengths)) for lengths, _ in greedy]
    columns, count, _ = relaxed(sizes, np.array([left[s] for s in sizes.tolist()], dtype=float), capacity, start=start)
    patterns = [(Counter({int(sizes[k]): int(column[k]) for k in np.flatnonzero(column).tolist()}), n) for column, n in zip(columns.T, count.tolist(), strict=True)]
    plans = [_rounded(left, patterns, capacity, up) for up in (1.0, 0.75, 0.5, 0.25)] + [greedy]
    return whole + min(plans, key=lambda plan: sum(n for _, n in plan))
