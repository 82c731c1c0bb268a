"""A run-length index of some strings: the runs of their Burrows-Wheeler transform, with the suffixes sampled at run ends.

Plain numpy over one shard's strings; ``suffixes`` takes the sharding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shared import chunks, ordered, runs, spread

_STEP = 7  # symbols of 9 bits that a 64-bit key holds


@dataclass
class RunIndex:
    """The runs of the transform, by the place of their samples. ``first`` and ``before``: the suffixes at a run's start and
    at the end of the run before it, in order. ``common``: how many symbols these two share. ``size``: places in all.

    Three numbers a run are all that is kept of the suffixes' order: in repetitive strings there are few runs."""

    first: np.ndarray
    before: np.ndarray
    common: np.ndarray
    size: int

    def statistics(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places ``lo`` to ``hi``: the place whose suffix comes before theirs in order, and their matching
        statistics, the symbols that the two share. Between samples both follow from the place to the left: the suffix
        before moves along, and one symbol less is shared. So the text is streamed from sample to sample."""
        place = np.arange(lo, hi)
        run = np.searchsorted(self.first, lo, "right") - 1
        last = np.searchsorted(self.first, hi, "left")
        some = slice(run, last)
        at = np.repeat(np.arange(run, last), np.diff(np.append(np.maximum(self.first[some], lo), hi)))
        moved = place - self.first[at]
        return self.before[at] + moved, self.common[at] - moved


def _symbols(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (1 to 256, and a 0 that ends each string) and, for each place, that of its string's end."""
    size = length + 1
    ends = np.cumsum(size) - 1
    sym = np.zeros(int(size.sum()), np.uint16)
    inner = np.ones(len(sym), bool)
    inner[ends] = False
    sym[inner] = data.astype(np.uint16) + 1
    return sym, np.repeat(ends, size)


def _keys(sym: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next symbols of each place in one number; zeros from the string's end on."""
    n, key, place = len(sym), np.zeros(len(sym), np.uint64), np.arange(len(sym))
    for j in range(_STEP):
        s = np.zeros(n, np.uint64)
        s[: n - j] = sym[j:]
        s[place + j >= end] = 0
        key = (key << np.uint64(9)) | s
    return key


def _suffix_order(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling over those that are still tied; ends of strings come first, in turn."""
    n = len(key)
    place, bits = np.arange(n), n.bit_length()
    h = min(_STEP, (64 - bits) // 9)
    key = key >> np.uint64(9 * (_STEP - h))
    order = ordered(key, 9 * h)
    first = runs(key[order])
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    stops = np.flatnonzero(end == place)
    rank[stops] = np.arange(len(stops))
    tied = np.repeat(size > 1, size)
    tied[: len(stops)] = False
    slots = np.flatnonzero(tied)
    while len(slots):
        sub = order[slots]
        both = (rank[sub] << bits) | rank[np.minimum(sub + h, end[sub])]
        by = ordered(both, 2 * bits)
        sub = sub[by]
        order[slots] = sub
        new = runs(both[by])
        size = np.diff(np.append(new, len(sub)))
        # Slots of a group are neighbours, so that a slot is its rank.
        rank[sub] = np.repeat(slots[new], size)
        slots, h = slots[np.repeat(size > 1, size)], 2 * h
    return order


def _common(key: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that pairs of suffixes share."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        # Beyond an end a key has zeros only: keys that differ do so before it, and equal ones share what is left.
        other = key[a] ^ key[b]
        same = np.zeros(len(live), np.int64)
        for j in range(_STEP):
            same += other < np.uint64(1 << 9 * j)
        same = np.minimum(same, end[a] - a)
        out[live] += same
        whole = same == _STEP
        live, a, b = live[whole], a[whole] + _STEP, b[whole] + _STEP
    return out


def build(data: np.ndarray, length: np.ndarray) -> RunIndex:
    """The index of strings that stand one after the other in ``data``. The order of all suffixes is needed to find the
    runs, and let go then."""
    sym, end = _symbols(data, length)
    key = _keys(sym, end)
    order = _suffix_order(key, end)
    left = np.where(order > 0, sym[order - 1], 0)
    # Every string's begin is a run of its own, as no two have the same end symbol before them.
    new = np.ones(len(order), bool)
    new[1:] = (left[1:] != left[:-1]) | (left[1:] == 0)
    at = np.flatnonzero(new)
    first, before = order[at], order[np.maximum(at - 1, 0)]
    common = _common(key, end, first, before)
    common[at == 0] = 0
    by = np.argsort(first)
    return RunIndex(first[by], before[by], common[by], len(order))


def _chained(data: np.ndarray, length: np.ndarray, doc: np.ndarray, least: int, step: int = 1 << 20) -> np.ndarray:
    """``earliest`` by one index of all the strings.

    A match of ``least`` or more ties a place to the one before it in order; places tied into one chain have the same
    bytes, and the chain's first place stands for all."""
    index = build(data, length)
    root = np.empty(index.size, np.int64)
    for lo in range(0, index.size, step):
        hi = min(lo + step, index.size)
        before, shared = index.statistics(lo, hi)
        root[lo:hi] = np.where(shared >= least, before, np.arange(lo, hi))
    tied = np.flatnonzero(root != np.arange(index.size))
    while len(tied):
        further = root[root[tied]]
        moved = further != root[tied]
        root[tied] = further
        tied = tied[moved]
    best = np.repeat(doc, length + 1)
    smallest = best.copy()
    np.minimum.at(smallest, root, best)
    return smallest[root]


def earliest(data: np.ndarray, length: np.ndarray, doc: np.ndarray, group: np.ndarray, least: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For each place of strings and their end symbols: the smallest of ``doc`` among all strings that hold the ``least``
    bytes from there; and the place at which each string begins. Places with fewer bytes left mean nothing.

    Strings of different ``group`` share no ``least`` bytes. So one that is all of its group needs no index, and the others
    are indexed some groups at a time, about ``most`` bytes, which bounds memory but for a larger group."""
    size = length + 1
    begin = np.cumsum(size) - size
    best = np.repeat(doc, size)
    by = np.argsort(group, kind="stable")
    first = runs(group[by])
    n = np.diff(np.append(first, len(by)))
    by, n = by[np.repeat(n > 1, n)], n[n > 1]
    edge = np.concatenate(([0], np.cumsum(n)))
    upto = np.concatenate(([0], np.cumsum(size[by])))
    from_ = np.cumsum(length) - length
    for lo, hi in chunks(upto[edge], most):
        some = by[edge[lo] : edge[hi]]
        at = spread(from_[some], length[some])
        best[spread(begin[some], size[some])] = _chained(data[at], length[some], doc[some], least)
    return best, begin
