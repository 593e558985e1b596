"""Clusters of many places by Lloyd's steps, in time that grows about as the rows do.

Rows lie in a tree of boxes, each with the largest distance of its rows to their centres: a centre is held
only against boxes that it may be nearest in.  Starting rows of many seeds are drawn side by side.  Draws, distances
and ties are those of a plain search of all centres, up to the rounding of sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Rows of a smallest box, bits of the number of boxes in one, and rows times seeds that are drawn at once.
LEAF, BITS, AT_ONCE = 16, 3, 1 << 21


class Places:
    """Rows in boxes, and the starts of the seeds that are asked for one after the other."""

    def __init__(self, z: np.ndarray, k: int, seeds: Sequence[int] = ()) -> None:
        self.z = np.ascontiguousarray(z, float)
        n, dims = self.z.shape
        self.k = min(k, len(np.unique(self.z, axis=0)))
        self.seeds, self.held = list(seeds), {}
        self.block = max(8, math.isqrt(n))
        self.rows = (n // self.block + 1) * self.block  # one more than n at least: the place of what fills a box
        # Halves by the widest column, in place of rows their numbers; a number n fills up.
        depth = max(0, math.ceil(math.log2(n / LEAF))) if n > LEAF else 0
        each = -(-n // (1 << depth))
        order = np.concatenate((np.arange(n), np.zeros((each << depth) - n, int)))
        real = np.arange(len(order)) < n
        for level in range(depth):
            order, real = order.reshape(1 << level, -1), real.reshape(1 << level, -1)
            at = self.z[order]
            widest = np.ptp(at, axis=1).argmax(1)
            by = np.argsort(np.take_along_axis(at, widest[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
            order, real = np.take_along_axis(order, by, 1), np.take_along_axis(real, by, 1)
        order, real = order.reshape(1 << depth, each), real.reshape(1 << depth, each)
        self.at = [np.ascontiguousarray(self.z[order, c]) for c in range(dims)]
        self.number = np.where(real, order, n)
        low, high = self.z[order].min(1), self.z[order].max(1)
        self.ends = [[(np.ascontiguousarray(low[:, c]), np.ascontiguousarray(high[:, c])) for c in range(dims)]]
        while len(self.ends[0][0][0]) > 1 << BITS:  # wider boxes come before those they hold
            self.ends.insert(0, [(a.reshape(-1, 1 << BITS).min(1), b.reshape(-1, 1 << BITS).max(1)) for a, b in self.ends[0]])

    def _most(self, leaf_most: np.ndarray) -> list[np.ndarray]:
        """By level, the largest of each box."""
        out = [leaf_most]
        for ends in self.ends[-2::-1]:
            out.insert(0, out[0].reshape(len(leaf_most), len(ends[0][0]), -1).max(2))
        return out

    def _near(self, centre: np.ndarray, most: list[np.ndarray], owner: np.ndarray, ties: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """By level, numbers of centres and of boxes that lie nearer than a row of theirs to its own centre; ``owner`` is a centre's row of the tables."""
        q, box = np.repeat(np.arange(len(centre)), len(self.ends[0][0][0])), np.tile(np.arange(len(self.ends[0][0][0])), len(centre))
        out = []
        for level, (ends, top) in enumerate(zip(self.ends, most, strict=True)):
            if level:
                fan = top.shape[1] // most[level - 1].shape[1]
                q, box = np.repeat(q, fan), ((box * fan)[:, None] + np.arange(fan)).ravel()
            square = 0.0
            for c, (low, high) in enumerate(ends):
                x = centre[q, c]
                d = np.maximum(np.maximum(low[box] - x, x - high[box]), 0)
                square = square + d * d
            limit = top[owner[q], box]
            hit = np.flatnonzero(square <= limit if ties else square < limit)
            q, box = q[hit], box[hit]
            out.append((q, box))
        return out

    def _squares(self, leaf: np.ndarray, centre: np.ndarray) -> np.ndarray:
        total = 0.0
        for c, at in enumerate(self.at):
            d = at[leaf] - centre[:, c, None]
            total = total + d * d
        return total

    def _starts(self, seeds: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each seed its starting rows, each drawn by squared distances to those before it, and every row's nearest."""
        z, n, size, m, k = self.z, len(self.z), self.rows, len(seeds), self.k
        rngs = [np.random.default_rng(s) for s in seeds]
        picks = np.empty((m, k), np.int64)
        picks[:, 0] = [r.integers(n) for r in rngs]
        drawn = np.stack([r.random(k - 1) for r in rngs])
        d, label = np.zeros((m, size)), np.zeros((m, size), np.int32)
        for i in range(m):
            d[i, :n] = ((z - z[picks[i, 0]]) ** 2).sum(1)
        most = self._most(d[:, self.number].max(2))
        cells = d.reshape(m, -1, self.block)
        seed = np.arange(m)
        for j in range(1, k):
            if j % 64 == 1:  # sums anew, so that rounding does not gather
                sums = cells.sum(2)
            ends = sums.cumsum(1)
            goal = drawn[:, j - 1] * ends[:, -1]
            b = np.minimum((ends <= goal[:, None]).sum(1), sums.shape[1] - 1)
            inner = cells[seed, b].cumsum(1)
            inside = (inner <= (goal - ends[seed, b] + sums[seed, b])[:, None]).sum(1)
            row = b * self.block + np.minimum(inside, self.block - 1)
            for i in np.flatnonzero((inside == self.block) | (d[seed, row] <= 0)):  # rounding led past a block's end
                whole = d[i, :n].cumsum()
                row[i] = min(whole.searchsorted(drawn[i, j - 1] * whole[-1], side="right"), np.flatnonzero(d[i, :n])[-1])
            picks[:, j] = row
            centre = z[row]
            path = self._near(centre, most, seed, ties=False)
            own, leaf = path[-1]
            new = self._squares(leaf, centre[own])
            flat = self.number[leaf] + (own * size)[:, None]
            old = d.ravel()[flat]
            less = new < old
            where = flat[less]
            d.ravel()[where] = new[less]
            label.ravel()[where] = j
            sums -= np.bincount(where // self.block, weights=(old - new)[less], minlength=sums.size).reshape(sums.shape)
            most[-1][own, leaf] = np.minimum(old, new).max(1)
            for level in range(len(path) - 2, -1, -1):
                own, box = path[level]
                count = most[level].shape[1]
                most[level][own, box] = most[level + 1].reshape(m, count, -1)[own, box].max(1)
        return [(z[picks[i]], label[i, :n].astype(np.int64)) for i in range(m)]

    def start(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        if seed not in self.held:
            if seed not in self.seeds:
                return self._starts([seed])[0]
            at = self.seeds.index(seed)
            now = self.seeds[at : at + max(1, AT_ONCE // self.rows)]
            self.held = dict(zip(now, self._starts(now), strict=True))
        return self.held.pop(seed)

    def assigned(self, label: np.ndarray, centre: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """The nearest centre of each row, the first of equals, where ``label`` was nearest before some centres moved."""
        z, n = self.z, len(self.z)
        own = sum((z[:, c] - centre[label, c]) ** 2 for c in range(z.shape[1]))
        padded = np.append(own, -1.0)
        # Rows whose own centre moved are held against all centres, others against those that moved.
        loose = np.append(np.where(moved[label], own, -1.0), -1.0)
        most = self._most(np.stack((loose[self.number].max(1), padded[self.number].max(1))))
        rows, squares, names = [], [], []
        for a in range(0, len(centre), 1 << 14):
            c, leaf = self._near(centre[a : a + (1 << 14)], most, moved[a : a + (1 << 14)].astype(int), ties=True)[-1]
            c = c + a
            for b in range(0, len(c), 1 << 16):
                who, where = c[b : b + (1 << 16)], leaf[b : b + (1 << 16)]
                new, row = self._squares(where, centre[who]), self.number[where]
                i, e = np.nonzero(new <= padded[row])
                rows.append(row[i, e])
                squares.append(new[i, e])
                names.append(who[i])
        row, square, name = map(np.concatenate, (rows, squares, names))
        better = (square < own[row]) | (name < label[row])
        row, square, name = row[better], square[better], name[better]
        first = np.lexsort((name, square, row))
        row, name = row[first], name[first]
        head = np.ones(len(row), bool)
        head[1:] = row[1:] != row[:-1]
        out = label.copy()
        out[row[head]] = name[head]
        return out


def lloyd(places: Places, seed: int, steps: int = 100) -> np.ndarray:
    """Each row's cluster: steps of means and nearest centres until no row changes."""
    z, k = places.z, places.k
    centre, label = places.start(seed)
    for _ in range(steps - 1):
        count = np.bincount(label, minlength=k)
        held = count > 0
        new = centre.copy()
        for c in range(z.shape[1]):
            new[held, c] = np.bincount(label, weights=z[:, c], minlength=k)[held] / count[held]
        moved = (new != centre).any(1)
        centre = new
        if not moved.any():
            break
        last, label = label, places.assigned(label, centre, moved)
        if (last == label).all():
            break
    return label
