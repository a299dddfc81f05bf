"""Sets with a Dice coefficient above a ratio, found exactly by their rarest elements."""

from __future__ import annotations

import functools

import numpy as np

#: An element that begins so many sets or fewer is a key by itself; more, and a second element joins it.
LIGHT = 32
#: Numbers held for the orders of second elements; elements left without an order are keys by themselves.
ORDERS = 1 << 21
#: The most frequent elements have a bit each.
BITS = 512
#: Candidates compared at once.
AT_ONCE = 1 << 19


class Sets:
    """Sets of whole numbers, the rarest elements the smallest: ascending, one after another."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, elements: int):
        self.flat, self.m, self.elements = flat.astype(np.int64), lengths.astype(np.int64), elements
        self.start = np.concatenate([[0], np.cumsum(self.m)])
        self.bits = np.zeros((len(self.m), BITS // 64), np.uint64)
        row, bit = np.repeat(np.arange(len(self.m)), self.m), elements - 1 - self.flat
        own = bit < BITS
        np.bitwise_or.at(self.bits, (row[own], bit[own] >> 6), np.uint64(1) << (bit[own] & 63).astype(np.uint64))
        self.rest = np.bincount(row[~own], minlength=len(self.m))  # elements without a bit

    @classmethod
    def of(cls, packed: list[bytes], elements: int) -> Sets:
        lengths = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
        return cls(np.frombuffer(b"".join(packed), np.int32), lengths, elements)

    def some(self, rows: np.ndarray) -> Sets:
        return Sets(self.flat[_ranges(self.start[rows], self.m[rows])], self.m[rows], self.elements)

    def by_length(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, their elements as a matrix) of each length."""
        order = np.argsort(self.m, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(self.m[order])) + 1) if len(order) else []
        return [(m := int(self.m[p[0]]), p, self.flat[self.start[p][:, None] + np.arange(m)]) for p in parts if self.m[p[0]]]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n numbers."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Index:
    """Finds the sets like a given one.

    Of two like sets the larger misses few of its elements in the other and the smaller fewer still.
    So both have their rarest common element among their first ones, and, as all before it are
    missed, a next common one among the first of what is left, in any order. Where many sets begin
    with an element, that order is by the number of those that hold the other: elements that always
    come together tell nothing apart.
    """

    def __init__(self, sets: Sets, ratio: float):
        self.sets, self.ratio = sets, ratio
        begin = np.zeros(sets.elements, np.int64)
        for m, _, toks in sets.by_length():
            begin += np.bincount(toks[:, : self._missed(m, False) + 1].ravel(), minlength=sets.elements)
        heavy = np.flatnonzero(begin > LIGHT)
        heavy = heavy[np.argsort(-begin[heavy], kind="stable")][: ORDERS // sets.elements]
        self.slot = np.full(sets.elements, -1)
        self.slot[heavy] = np.arange(len(heavy))
        held = np.zeros((len(heavy), sets.elements), np.int32)
        for m, _, toks in sets.by_length():
            for i in range(self._missed(m, False) + 1):
                s = self.slot[toks[:, i]]
                on = s >= 0
                flat = (s[on][:, None] * sets.elements + toks[on, i + 1 :]).ravel()
                if len(flat):
                    at, n = np.unique(flat, return_counts=True)
                    held.ravel()[at] += n.astype(np.int32)
        self.order = np.argsort(np.argsort(held, axis=1, kind="stable"), axis=1).astype(np.int32)
        self.found = {}
        for small in (False, True):
            rows, keys = self._keys(sets, small)
            at = np.argsort(keys, kind="stable")
            self.found[small] = keys[at], rows[at].astype(np.int32)

    def _missed(self, m: int, small: bool) -> int:
        """The most elements that a set may have alone if it is the smaller one of two, or the larger."""
        return max(0, m - int(m * (self.ratio if small else self.ratio / (2 - self.ratio)) - 1e-9) - 1)

    def _keys(self, sets: Sets, small: bool) -> tuple[np.ndarray, np.ndarray]:
        rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        base = sets.elements + 1
        for m, at, toks in sets.by_length():
            most = self._missed(m, small)
            for i in range(most + 1):
                g = toks[:, i]
                slot = self.slot[g]
                alone = slot < 0 if m - most > 1 else np.ones(len(g), bool)  # with one common element enough there may be no second
                rows.append(at[alone])
                keys.append(g[alone] * base + sets.elements)
                rest = toks[slot >= 0, i + 1 :]
                k = min(most - i + 1, rest.shape[1])
                if not k or not len(rest):
                    continue
                rank = self.order[slot[slot >= 0][:, None], rest]
                if k < rest.shape[1]:
                    rest = np.take_along_axis(rest, np.argpartition(rank, k - 1, axis=1)[:, :k], 1)
                rows.append(np.repeat(at[slot >= 0], k))
                keys.append((g[slot >= 0][:, None] * base + rest).ravel())
        return np.concatenate(rows), np.concatenate(keys)

    def like(self, sets: Sets, before: np.ndarray | None = None):
        """Arrays (row, its like in the index) of all pairs, some of them more than once; of ``before``, only
        those in the index before a row's number."""
        for small in (False, True):
            rows, keys = self._keys(sets, small)
            known, ids = self.found[not small]
            sort = np.argsort(keys)
            rows, keys = rows[sort], keys[sort]
            left = np.searchsorted(known, keys, "left")
            n = np.searchsorted(known, keys, "right") - left
            some = n > 0
            rows, left, n = rows[some], left[some], n[some]
            total, at = np.cumsum(n), 0
            while at < len(n):
                # at least one key, else as many as make a batch
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
                a, b = np.repeat(rows[at:end], n[at:end]), ids[_ranges(left[at:end], n[at:end])]
                ma, mb = sets.m[a], self.sets.m[b]
                near = ma < mb if small else ma >= mb
                if before is not None:
                    near &= b < before[a]
                yield self._alike(sets, a[near], b[near])
                at = end

    def _alike(self, sets: Sets, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = self.ratio * (sets.m[a] + self.sets.m[b])
        common = np.bitwise_count(sets.bits[a] & self.sets.bits[b]).sum(1, dtype=np.int64)
        unseen = np.minimum(sets.rest[a], self.sets.rest[b])
        may = 2 * (common + unseen) > total
        a, b, total, sure = a[may], b[may], total[may], unseen[may] == 0
        for some in np.split(np.flatnonzero(~sure), range(1 << 16, int((~sure).sum()), 1 << 16)):
            x, y = a[some], b[some]
            of = lambda s, k: np.repeat(np.arange(len(k)), s.m[k]) * sets.elements + s.flat[_ranges(s.start[k], s.m[k])]
            both = np.intersect1d(of(sets, x), of(self.sets, y), assume_unique=True)
            sure[some] = 2 * np.bincount(both // sets.elements, minlength=len(some)) > total[some]
        return a[sure], b[sure]

    def first(self, sets: Sets) -> np.ndarray:
        """The first in the index like each set; the size of the index where there is none."""
        out = np.full(len(sets.m), len(self.sets.m))
        for a, b in self.like(sets):
            np.minimum.at(out, a, b)
        return out

    def expected(self, sample: int) -> float:
        """The links among the index' own sets, by those of some sets, evenly spread."""
        n = len(self.sets.m)
        rows = np.arange(0, n, max(1, n // sample))
        met = [np.unique(a * n + b) for a, b in self.like(self.sets.some(rows), rows)]
        return len(functools.reduce(np.union1d, met, np.zeros(0, np.int64))) * n / max(1, len(rows))


def led(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Greedy leaders of 0 to n - 1 by links from ``a`` to a later ``b``: the first leader linked, else itself."""
    follows, x, y = np.zeros(n, bool), a, b
    while len(x):
        waits = np.zeros(n, bool)
        waits[y] = True
        heads = ~waits[x]
        now = np.zeros(n, bool)
        now[y[heads]] = True
        follows |= now
        left = ~heads & ~now[x] & ~now[y]
        x, y = x[left], y[left]
    out = np.arange(n)
    leads = ~follows[a]
    np.minimum.at(out, b[leads], a[leads])
    return out
