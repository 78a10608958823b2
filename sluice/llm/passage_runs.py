"""Stretches that two texts share, around seeds of equal words, for many pairs of texts at once: numpy instead of a loop over pairs."""

from __future__ import annotations

import numpy as np

from .word_hashes import numbers_of, ranges, split_words

SHINGLE = 5
#: Words of either text that an edit may take: replaced, inserted or left out.
EDITS = ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1))
#: Between texts, more than an edit and a shingle take; before the first and after the last, more than _equal() looks at once.
_GAP, _EDGE = 8, 520


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    n = max(len(h) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


class PairedTexts:
    """Pairs of texts: a[row] and b[row] are numbers of texts (lower-case bytes). Words are equal where their 64-bit hashes are."""

    def __init__(self, texts: list[bytes], a: np.ndarray, b: np.ndarray):
        data, start, end, bound = split_words(texts)
        size = np.diff(bound)
        base = bound[:-1] + _EDGE + _GAP * np.arange(1, len(texts) + 1)
        self.x = np.full(len(start) + 2 * _EDGE + _GAP * (len(texts) + 1), 1, np.uint64)
        self.x[ranges(base, base + size)[0]] = numbers_of(data, start, end)
        # What stands between texts is equal nowhere.
        self.y = np.where(self.x == 1, np.uint64(2), self.x)
        self.gx, self.gy = grams(self.x, SHINGLE), grams(self.y, SHINGLE)
        self.a, self.b = base[a], base[b]
        self.wide = size[b] + 2 * _GAP
        area = (size[a] + 2 * _GAP) * self.wide
        self.area = np.cumsum(area) - area

    def _equal(self, i: np.ndarray, j: np.ndarray, step: int, most: np.ndarray | None = None) -> np.ndarray:
        """How many equal words begin (step 1) at x[i] and y[j], or end (step -1) before them; most are enough."""
        n, live, look = np.zeros(len(i), np.int64), np.arange(len(i)), 8
        while len(live):
            by = step * np.arange(look) - (step < 0)
            same = self.x[(i[live] + step * n[live])[:, None] + by] == self.y[(j[live] + step * n[live])[:, None] + by]
            whole = same.all(1)
            n[live] += np.where(whole, look, same.argmin(1))
            live = live[whole]
            if most is not None:
                live = live[n[live] < most[live]]
            look = min(2 * look, 512)
        return n

    def _key(self, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A number for each place of each pair."""
        return self.area[row] + (i - self.a[row] + _GAP) * self.wide[row] + (j - self.b[row] + _GAP)

    def blocks(self, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal (row, i, j, n), n at least SHINGLE, with x[i : i + n] == y[j : j + n], that hold a seed (place in a, place in b)."""
        i, j = i + self.a[row], j + self.b[row]
        order = np.lexsort((i, i - j, row))
        order = order[self.x[i[order]] == self.y[j[order]]]
        row, i, j = row[order], i[order], j[order]
        if not len(row):
            return row, i, j, i
        # On one diagonal, equal words are followed from seed to seed.
        on = (row[1:] == row[:-1]) & (i[1:] - j[1:] == i[:-1] - j[:-1])
        gap = np.append(np.where(on, i[1:] - i[:-1], 1 << 60), 1 << 60)
        after = self._equal(i, j, 1, gap)
        met = np.append(False, after[:-1] >= gap[:-1])
        first, last = np.flatnonzero(~met), np.flatnonzero(np.append(~met[1:], True))
        before = self._equal(i[first], j[first], -1)
        n = i[last] + after[last] - i[first] + before
        keep = n >= SHINGLE
        return row[first][keep], (i[first] - before)[keep], (j[first] - before)[keep], n[keep]

    def _walked(self, row: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> list[tuple[np.ndarray, ...]]:
        """Blocks that edits part from these and from one another, after them (step 1) or before."""
        known, out = np.unique(self._key(row, i + n, j + n) if step > 0 else self._key(row, i, j)), []
        while len(row):
            s, t = (i + n, j + n) if step > 0 else (i, j)
            to, todo = np.full((len(row), 2), -1), np.arange(len(row))
            for x, y in EDITS:
                u, v = s[todo] + step * x, t[todo] + step * y
                back = SHINGLE * (step < 0)
                equal = self.gx[u - back] == self.gy[v - back]
                to[todo[equal]] = np.stack([u, v], 1)[equal]
                todo = todo[~equal]
            went = to[:, 0] >= 0
            row, (i, j) = row[went], to[went].T
            n = self._equal(i, j, step)
            if step < 0:
                i, j = i - n, j - n
            out.append((row, i, j, n))
            key, one = np.unique(self._key(row, i + n, j + n) if step > 0 else self._key(row, i, j), return_index=True)
            one = one[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key]
            row, i, j, n = row[one], i[one], j[one], n[one]
        return out

    def bridged(self, blocks: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """blocks and those that edits of a word or two part from them, after them and before, in turn; ordered."""
        row, i, j, n = (np.concatenate(x) for x in zip(blocks, *self._walked(*blocks, 1), *self._walked(*blocks, -1), strict=True))
        order = np.lexsort((n, j, i, row))
        row, i, j, n = row[order], i[order], j[order], n[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (n[1:] != n[:-1])
        return row[new], i[new], j[new], n[new]

    def alike(self, s: np.ndarray, e: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Jaccard similarity of the shingles of x[s:e] and y[t:f]."""
        at, of = ranges(s, e - SHINGLE + 1)
        bt, ob = ranges(t, f - SHINGLE + 1)
        shingle, of = np.concatenate([self.gx[at], self.gy[bt]]), np.concatenate([of, ob])
        order = np.lexsort((shingle, of))
        shingle, of, side = shingle[order], of[order], np.repeat(np.array([1, 2], np.uint8), (len(at), len(bt)))[order]
        if not len(of):
            return np.zeros(len(s))
        first = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])))
        both = np.bitwise_or.reduceat(side, first) == 3
        return np.bincount(of[first][both], minlength=len(s)) / np.maximum(np.bincount(of[first], minlength=len(s)), 1)

    def matched(self, blocks: tuple[np.ndarray, ...], similarity: float, least: int) -> tuple[np.ndarray, ...]:
        """(row, start, end, start in b, end in b, similarity) of the longest stretches from one block to the same or a later one (of blocks as bridged() orders them) that have least words or more in both
        texts and that similarity by the shingles of their blocks and by all their shingles (exact Jaccard). So a stretch which falls short is split where the texts differ; what lies inside another is left out."""
        row, i, j, n = blocks
        if not len(row):
            return (*(np.zeros(0, np.int64),) * 5, np.zeros(0))
        # Pairs whose blocks reach far enough in both texts; of these, the ones that are alike from the first block to the last are done.
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(first, len(row)))
        s, e, t, f = i[first], np.maximum.reduceat(i + n, first), np.minimum.reduceat(j, first), np.maximum.reduceat(j + n, first)
        shared = np.add.reduceat(n - SHINGLE + 1, first)
        far = np.minimum(e - s, f - t) >= least
        near = far & (shared / np.maximum(e - s + f - t - 2 * (SHINGLE - 1) - shared, 1) >= similarity)
        alike, more = np.where(near, 1.0, 0.0), near & (size > 1)
        alike[more] = self.alike(s[more], e[more], t[more], f[more])
        whole = near & (alike >= similarity)
        r = row[first]
        out = [tuple(x[whole] for x in (r, s - self.a[r], e - self.a[r], t - self.b[r], f - self.b[r], alike))]
        left = far & ~whole
        keep, size = np.repeat(left, size), size[left]
        row, i, j, n = row[keep], i[keep], j[keep], n[keep]
        if not len(row):
            return out[0]
        of = np.repeat(np.arange(len(size)), size)
        last = np.cumsum(size)[of]
        ends = np.maximum.accumulate(i + n + (of << 40)) - (of << 40)
        upto = np.append(0, np.cumsum(n - SHINGLE + 1))
        # Stretches from block k to block m that are long enough and alike by their blocks.
        k, low, high, some, d = np.arange(len(row)), j, j + n, [], 0
        while len(k):
            m = k + d
            low, high = np.minimum(low, j[m]), np.maximum(high, j[m] + n[m])
            x, y, shared = ends[m] - i[k], high - low, upto[m + 1] - upto[k]
            near = (np.minimum(x, y) >= least) & (shared / np.maximum(x + y - 2 * (SHINGLE - 1) - shared, 1) >= similarity)
            some.append((k[near], m[near], low[near], high[near]))
            d += 1
            on = k + d < last[k]
            k, low, high = k[on], low[on], high[on]
        k, m, low, high = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((-m, k))
        k, m, low, high = k[order], m[order], low[order], high[order]
        # Of each pair the next one in this order, of which the rest depends.
        start = np.searchsorted(k, np.arange(len(row) + 1))
        stop = start[np.cumsum(size)]
        at, done = start[np.cumsum(size) - size], np.cumsum(size) - size
        live = np.flatnonzero(at < stop)
        while len(live):
            c = at[live]
            late = m[c] >= done[live]
            # Those that end before done, and all that follow with their k, are inside what was found.
            at[live[~late]] = start[k[c[~late]] + 1]
            # The fewer pairs are left, the more of each are looked at ahead of need.
            look = max(1, min(16, 256 // len(live)))
            c, of = ranges(c[late], np.minimum(c[late] + look, stop[live[late]]))
            pair = live[late][of]
            c, pair = (x[m[c] >= done[pair]] for x in (c, pair))
            s, e, t, f = i[k[c]], ends[m[c]], low[c], high[c]
            alike, more = np.ones(len(c)), m[c] > k[c]
            alike[more] = self.alike(s[more], e[more], t[more], f[more])
            at[live[late]] = np.minimum(at[live[late]] + look, stop[live[late]])
            good = np.flatnonzero(alike >= similarity)
            good = good[np.unique(pair[good], return_index=True)[1]]
            r = row[k[c[good]]]
            out.append((r, s[good] - self.a[r], e[good] - self.a[r], t[good] - self.b[r], f[good] - self.b[r], alike[good]))
            done[pair[good]] = m[c[good]] + 1
            at[pair[good]] = start[k[c[good]] + 1]
            live = live[at[live] < stop[live]]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
