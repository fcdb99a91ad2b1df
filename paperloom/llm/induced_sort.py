"""Suffixes of many segments in order, with common prefixes, by induced sorting in external memory.

Suffixes that are less than the next one, with a greater one before (S*), are sorted by their substrings up to the next
such suffix: tuples (symbol, position) wait in a priority queue and are refined one range of symbols at a time. Equal
substrings get one name, and the string of names is sorted in the same way, recursively. From the S* suffixes all others
are induced: taking a suffix from the queue in order, the one that starts a position earlier is put in with its own first symbol.
First those greater than their successors are induced upwards, then those less than theirs downwards.

Common prefixes travel with the tuples. Two suffixes that follow each other under one symbol share one symbol more than
the least of the prefixes between the suffixes that induced them. They are counted up to a limit.

Runs of the queue and long arrays lie in temporary files that have no name and are gone with the task; a range of the queue is in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Arrays of more bytes lie on disk; so many suffixes are one range of the queue, or those of one symbol if they are more.
IN_MEMORY, RANGE = 1 << 24, 1 << 17


def stored(a: np.ndarray) -> np.ndarray:
    """a, on disk if it is long."""
    if a.nbytes <= IN_MEMORY:
        return a
    with tempfile.TemporaryFile() as file:
        a.tofile(file)
        file.flush()
        return np.memmap(file, a.dtype, "r", shape=a.shape)


class Queue:
    """A priority queue of tuples (symbol, ...): least symbols first, in the order of their coming within one."""

    def __init__(self) -> None:
        self.runs: list[list] = []

    def push(self, symbol: np.ndarray, *more: np.ndarray) -> None:
        if len(symbol):
            order = np.argsort(symbol, kind="stable")
            self.runs.append([0, *[stored(x[order]) for x in (symbol, *more)]])

    def pop(self, bound: int, width: int) -> list[np.ndarray]:
        """All with a symbol under bound, without the symbols; width: the number of columns."""
        parts = []
        for run in self.runs:
            at, end = run[0], int(np.searchsorted(run[1], bound))
            if end > at:
                parts.append([c[at:end] for c in run[1:]])
                run[0] = end
        self.runs = [run for run in self.runs if run[0] < len(run[1])]
        if not parts:
            return [np.empty(0, np.int64)] * width
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns[1:]]


def types(x: np.ndarray) -> np.ndarray:
    """For each suffix whether it is less than the next one (S); the last symbol, the least of all, counts as such."""
    n = len(x)
    change = np.append(np.flatnonzero(x[1:] != x[:-1]), n - 1)
    s = np.empty(n, bool)
    up = np.append(x[change[:-1] + 1] > x[change[:-1]], True)
    s[:] = np.repeat(up, np.diff(change, prepend=-1))
    return s


def _ranges(counts: np.ndarray, most: int) -> list[int]:
    """Ends of ranges of symbols that hold about most occurrences, one symbol at least."""
    sums = np.cumsum(counts)
    ends = np.unique(np.searchsorted(sums, np.arange(most, int(sums[-1]) + most, most)) + 1)
    return np.minimum(ends, len(counts)).tolist()


def _split(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """active by key, and which of them share theirs with another; rank, where a group of equals begins, is brought up to date."""
    order = np.argsort(key, kind="stable")
    active, key = active[order], key[order]
    old, first = rank[active], np.arange(len(active))
    group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), first, 0))
    starts = np.append(True, key[1:] != key[:-1])
    part = np.maximum.accumulate(np.where(starts, first, 0))
    rank[active] = old + part - group
    return active, ~(starts & np.append(starts[1:], True))


def _refined(x: np.ndarray, s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each S* substring the number of those that are less; the same for equal ones."""
    rank, active, t = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(active):
        where = at[active] + t
        symbol = 2 * x[where].astype(np.int64) + s[where]
        active, several = _split(rank, active, rank[active] * (int(symbol.max()) + 1) + symbol)
        if t:
            where = at[active] + t
            several &= ~(s[where] & ~s[where - 1])  # the substring ends here
        active, t = active[several], t + 1
    return rank


def sorted_stars(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Positions of the S* suffixes in order."""
    stars = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(x) == 1:
        return np.zeros(1, np.int64)
    queue, names, known = Queue(), np.empty(len(stars), np.int64), 0
    for at in range(0, len(stars), RANGE):
        part = stars[at : at + RANGE]
        queue.push(x[part], np.arange(at, at + len(part)))
    for bound in _ranges(np.bincount(x[stars]), RANGE):
        (which,) = queue.pop(bound, 1)
        if len(which):
            less, number = np.unique(_refined(x, s, stars[which]), return_inverse=True)
            names[which] = known + number
            known += len(less)
    if known == len(stars):
        order = np.empty(known, np.int64)
        order[names] = np.arange(known)
    else:
        order = sorted_suffixes(stored(names.astype(np.int32)))
    return stars[order]


def _in_range(x: np.ndarray, s: np.ndarray, sign: int, bound: int, come: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a range in order, and which of them are seeds: those that have come, seeds, and what both induce within it."""
    found, after, front, base = [come], [], come, 0
    front = np.concatenate([come, seeds])
    number = np.concatenate([np.arange(len(come)), -1 - np.arange(len(seeds))])  # seeds count from the end
    total = len(come)
    while len(front):
        before = np.maximum(front - 1, 0)
        inside = (front > 0) & (s[before] == (sign < 0)) & (sign * x[before].astype(np.int64) < bound)
        front, number = before[inside], number[inside]
        found.append(front)
        after.append(number)
        number = np.arange(total, total + len(front))
        total += len(front)
    all_of = np.concatenate([*found, seeds])
    seed = np.arange(len(all_of)) >= total
    symbol = 2 * sign * x[all_of].astype(np.int64) + seed
    if total == len(come):
        order = np.argsort(symbol, kind="stable")
        return all_of[order], seed[order]
    follows = np.concatenate(after)
    follows = np.where(follows < 0, total - 1 - follows, follows)
    behind = np.concatenate([np.arange(len(come)), np.zeros(total - len(come), np.int64), np.arange(len(seeds))])
    rank = np.zeros(len(all_of), np.int64)
    active, key = np.arange(len(all_of)), symbol - symbol.min()
    while len(active):
        active, several = _split(rank, active, key)
        active = active[several]
        behind[len(come) : total] = len(come) + rank[follows]
        key = rank[active] * (2 * len(all_of)) + behind[active]
    order = np.empty_like(rank)
    order[rank] = np.arange(len(rank))
    return all_of[order], seed[order]


def _induced(x: np.ndarray, s: np.ndarray, seeds: np.ndarray, sign: int) -> np.ndarray:
    """sign 1: the suffixes greater than their successors, ascending, from S* seeds; -1: all, descending, from those."""
    counts = np.bincount(x)
    bounds = _ranges(counts, RANGE)
    bounds = bounds if sign > 0 else [1 - b for b in [0, *bounds[:-1]][::-1]]
    cuts = np.searchsorted(sign * x[seeds].astype(np.int64), bounds)
    queue, out, at = Queue(), [], 0
    for bound, cut in zip(bounds, cuts.tolist()):
        (come,) = queue.pop(bound, 1)
        order, seed = _in_range(x, s, sign, bound, come, seeds[at:cut])
        at = cut
        before = np.maximum(order - 1, 0)
        symbol = sign * x[before].astype(np.int64)
        on = (order > 0) & (s[before] == (sign < 0)) & (symbol >= bound)
        queue.push(symbol[on], before[on])
        out.append(order[~seed] if sign > 0 else order)
    return np.concatenate(out)


def sorted_suffixes(x: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of x in order; its last symbol is less than any other."""
    s = types(x)
    seeds = sorted_stars(x, s)
    if len(x) == 1:
        return seeds
    larger = _induced(x, s, seeds, 1)
    return np.append(_induced(x, s, larger[::-1], -1), len(x) - 1)[::-1]


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop], for each; start < stop."""
    level = np.frexp(stop - start)[1] - 1
    out, table = np.empty(len(start), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        here = level == k
        out[here] = np.minimum(table[start[here]], table[stop[here] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def _common(text: np.ndarray, ends: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix of at shares with the one before in at, within segments that stop at ends, up to limit."""
    padded = np.append(np.asarray(text), np.zeros(8, np.uint8))
    words = np.ndarray(len(text), "<u8", padded, strides=(1,))
    left = np.minimum(ends[np.searchsorted(ends, at, "left")] - at, limit)
    most, shared = np.minimum(left[1:], left[:-1]), np.zeros(len(at), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        done = shared[1 + active]
        differ = words[at[active] + done] ^ words[at[1 + active] + done]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        shared[1 + active] = np.minimum(done + same, most[active])
        active = active[(differ == 0) & (done + 8 < most[active])]
    return shared.astype(np.uint16)


def _run(x: np.ndarray, at: int) -> int:
    n = 1
    while x[at + n] == x[at]:
        n += 1
    return n


def _pass(x: np.ndarray, s: np.ndarray, seeds: list, sign: int, low: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each symbol: itself, its suffixes in order, what each shares with the one before, and how many are not seeds.

    seeds: (positions, shared) by symbol. Symbols under low end segments: none of their suffixes share anything.
    """
    queue = Queue()
    top = len(seeds)
    for symbol in [low - 1, *range(low, top)] if sign > 0 else range(top - 1, low - 1, -1):
        come, shared = queue.pop(sign * symbol + 1, 2)
        order, common, front, depth = [come], [shared.astype(np.uint16)], (come, shared), 0
        while len(front[0]):  # runs of one symbol: each suffix induces the next longer run
            at, least = front
            before = np.maximum(at - 1, 0)
            on = np.flatnonzero((at > 0) & (s[before] == (sign < 0)) & (x[before] == symbol))
            depth += 1
            if not len(on):
                break
            more = np.empty(len(on), np.int64)
            more[0] = depth
            more[1:] = 1 + _least(least, on[:-1] + 1, on[1:] + 1)
            front = before[on], np.minimum(more, limit).astype(np.uint16)
            order.append(front[0])
            common.append(front[1])
        others = sum(map(len, order))
        rest, between = seeds[symbol]
        if len(rest):
            between = between.copy()
            last = next((o for o in reversed(order) if len(o)), None)
            between[0] = 0 if last is None or symbol < low else min(_run(x, int(last[-1])), _run(x, int(rest[0])), limit)
        at, least = np.concatenate([*order, rest]), np.concatenate([*common, between])
        least[:1] = 0
        yield symbol, at, least, others
        before = np.maximum(at - 1, 0)
        first = x[before].astype(np.int64)
        on = np.flatnonzero((at > 0) & (s[before] == (sign < 0)) & (first >= low) & (sign * first > sign * symbol))
        if len(on):
            first = first[on]
            by = np.argsort(first.astype(np.uint16) if top < 1 << 16 else first, kind="stable")
            first, on = first[by], on[by]
            more = np.ones(len(on), np.int64)  # after a suffix induced by another symbol: only the symbol itself
            again = np.flatnonzero(first[1:] == first[:-1]) + 1
            more[again] = 1 + _least(least, on[again - 1] + 1, on[again] + 1)
            more[np.flatnonzero(np.append(True, first[1:] != first[:-1]))] = 1
            queue.push(sign * first, before[on], np.minimum(more, limit).astype(np.uint16))


def repeated(text: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Sorted positions of text, bytes, whose next limit bytes also start at another position, in one segment each.

    A segment ends before each of ends, where a byte that belongs to no segment stands; the last byte is one of them.
    """
    m, n = len(ends), len(text)
    x = text.astype(np.int32) + m
    x[ends] = np.arange(m - 1, -1, -1)
    x = stored(x)
    s = types(x)
    stars = sorted_stars(x, s)
    shared = _common(text, ends, stars, limit)
    cuts = np.searchsorted(x[stars], np.arange(m, m + 257)).tolist()
    none = (np.empty(0, np.int64), np.empty(0, np.uint16))
    pick = lambda a, b: (stars[a:b], shared[a:b])
    # ends that are no S* suffix do not occur: every segment has a byte, which is more than its end
    seeds = [none] * (m - 1) + [pick(0, cuts[0])] + [pick(a, b) for a, b in zip(cuts, cuts[1:])]
    larger = [none] * (m + 256)
    for symbol, at, least, others in _pass(x, s, seeds, 1, m, limit):
        if symbol >= m and others:
            at, least = at[:others][::-1], np.append(least[1:others][::-1], 0)
            larger[symbol] = stored(at), stored(np.append(np.uint16(0), least[:-1]).astype(np.uint16))
    found = []
    for _, at, least, _ in _pass(x, s, larger, -1, m, limit):
        hit = np.flatnonzero(least >= limit)
        found.append(np.unique(at[np.concatenate([hit, hit - 1])]))
    return np.sort(np.concatenate([*found, np.empty(0, np.int64)]))
