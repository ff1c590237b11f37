"""Order statistics and frame-dependent weights over trailing frames, one pass of Arrow batches an instrument.

A state is fed an instrument's values in time order, NaN for a missing one, and gives a value for each row.  It holds the
frame alone (``n`` slots), or for expanding frames (0) the values so far, sorted; rows cost about the logarithm of those.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np

#: Numbers of the frames laid out at once, the widest frame that is sorted row by row, and rows that join a sorted history at once.
LAID_OUT, SORTED, STEP = 1 << 21, 256, 512


def place_between(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Linear interpolation at a fractional place between two neighbours."""
    down, up = np.floor(at), np.ceil(at)
    return np.where(down == up, low, (up - at) * low + (at - down) * high)


class Frames:
    """Frames of the last ``n`` values; what was before the first one is missing."""

    def __init__(self, n: int):
        self.n = n
        self.reset()

    def reset(self) -> None:
        self.before = np.full(self.n - 1, np.nan)

    def frames(self, values: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        if not len(values):
            return
        whole = np.concatenate([self.before, values])
        if self.n > 1:
            self.before = whole[1 - self.n :]
        laid = np.lib.stride_tricks.sliding_window_view(whole, self.n)
        step = max(1, LAID_OUT // self.n)
        for s in range(0, len(values), step):
            yield slice(s, s + step), laid[s : s + step]


class Quantile(Frames):
    """Linearly interpolated quantile of the present values."""

    def __init__(self, n: int, q: float):
        self.q = q
        super().__init__(n)

    def reset(self) -> None:
        super().reset()
        self.sorted: list[float] = []

    def feed(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        if self.n > SORTED:
            whole = np.concatenate([self.before, values]).tolist()
            self.before = np.array(whole[1 - self.n :])
            for i, v in enumerate(values.tolist()):
                if v == v:
                    insort(self.sorted, v)
                if m := len(self.sorted):
                    at = (m - 1) * self.q
                    low = int(at)
                    a, b = self.sorted[low], self.sorted[min(low + 1, m - 1)]
                    out[i] = a if at == low else (low + 1 - at) * a + (at - low) * b
                if (gone := whole[i]) == gone:
                    del self.sorted[bisect_left(self.sorted, gone)]
            return out
        for rows, w in self.frames(values):
            w = np.sort(w, axis=1)  # missing ones last
            m = np.count_nonzero(~np.isnan(w), axis=1)
            at = np.maximum((m - 1) * self.q, 0.0)
            pick = lambda j, w=w: np.take_along_axis(w, j.astype(np.int64)[:, None], 1)[:, 0]
            out[rows] = place_between(at, pick(np.floor(at)), pick(np.ceil(at)))
        return out


class Rank(Frames):
    """Percent rank of the last value, ties averaged."""

    def feed(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        for rows, w in self.frames(values):
            last = w[:, -1:]
            place = 0.5 + (w < last).sum(1) + 0.5 * (w == last).sum(1)
            m = np.count_nonzero(~np.isnan(w), axis=1)
            out[rows] = np.where(np.isnan(last[:, 0]), np.nan, place / np.maximum(m, 1))
        return out


class Mad(Frames):
    """Mean absolute deviation about the mean of the present values."""

    def feed(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        for rows, w in self.frames(values):
            there = ~np.isnan(w)
            m = np.maximum(there.sum(1), 1)
            mean = np.where(there, w, 0.0).sum(1) / m
            out[rows] = np.where(there.any(1), np.where(there, np.abs(w - mean[:, None]), 0.0).sum(1) / m, np.nan)
        return out


class ExpandingQuantile:
    """Quantile of all values so far, between a heap of the lower and one of the upper ones."""

    def __init__(self, q: float):
        self.q = q
        self.reset()

    def reset(self) -> None:
        self.low: list[float] = []
        self.high: list[float] = []

    def feed(self, values: np.ndarray) -> np.ndarray:
        low, high, out = self.low, self.high, []
        for v in values.tolist():
            if v == v:
                if low and v < -low[0]:
                    heapq.heappush(low, -v)
                else:
                    heapq.heappush(high, v)
                at = (len(low) + len(high) - 1) * self.q
                while len(low) < int(at) + 1:
                    heapq.heappush(low, -heapq.heappop(high))
                while len(low) > int(at) + 1:
                    heapq.heappush(high, -heapq.heappop(low))
            if not low:
                out.append(np.nan)
                continue
            at = (len(low) + len(high) - 1) * self.q
            a, f = -low[0], int(at)
            out.append(a if at == f else (f + 1 - at) * a + (at - f) * high[0])
        return np.array(out, float)


class Expanding:
    """The present values so far, sorted, to which steps of rows are added; in a step rows meet pair by pair."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.past = np.zeros(0)
        self.total = 0.0

    def steps(self, values: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, their values, which earlier or same row each one sees)."""
        for s in range(0, len(values), STEP):
            v = values[s : s + STEP]
            yield slice(s, s + STEP), v, np.tril(np.broadcast_to(~np.isnan(v), (len(v), len(v))))
            new = np.sort(v[~np.isnan(v)])
            self.past = np.insert(self.past, np.searchsorted(self.past, new), new)
            self.total += float(new.sum())


class ExpandingRank(Expanding):
    def feed(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        for rows, v, seen in self.steps(values):
            less, to = np.searchsorted(self.past, v, "left"), np.searchsorted(self.past, v, "right")
            less = less + ((v[None] < v[:, None]) & seen).sum(1)
            same = to - np.searchsorted(self.past, v, "left") + ((v[None] == v[:, None]) & seen).sum(1)
            place = (0.5 + less + 0.5 * same) / np.maximum(len(self.past) + seen.sum(1), 1)
            out[rows] = np.where(np.isnan(v), np.nan, place)
        return out


class ExpandingMad(Expanding):
    def feed(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        for rows, v, seen in self.steps(values):
            there = np.where(np.isnan(v), 0.0, v)
            m = len(self.past) + seen.sum(1)
            mean = (self.total + (seen * there[None]).sum(1)) / np.maximum(m, 1)
            sums = np.concatenate([[0.0], np.cumsum(self.past)])
            below = np.searchsorted(self.past, mean)
            apart = mean * below - sums[below] + (sums[-1] - sums[below]) - mean * (len(self.past) - below)
            apart = apart + (np.abs(there[None] - mean[:, None]) * seen).sum(1)
            out[rows] = np.where(m > 0, apart / np.maximum(m, 1), np.nan)
        return out


class WholeEma:
    """Mean of all rows so far, weighted by powers of 1 - 2 / (1 + rows): other weights for each row.

    The history is covered by blocks of doubling length, one of each length at most, with the moments of their values.
    In a block the weights are an exponential of at most the first power, which ``TERMS`` of its series give to 1e-15.
    """

    LEAF, TERMS = 64, 20

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.values = np.zeros(0)
        self.moments: list[np.ndarray] = []

    def _moments(self) -> None:
        """Moments of the blocks of every length that are full now."""
        level, size = 0, self.LEAF
        while size <= len(self.values):
            if level == len(self.moments):
                self.moments.append(np.zeros((0, self.TERMS)))
            done, full = len(self.moments[level]), len(self.values) // size
            if full > done:
                from_centre = (np.arange(size) - (size - 1) / 2) / (size / 2)
                new = self.values[done * size : full * size].reshape(-1, size) @ from_centre[:, None] ** np.arange(self.TERMS)
                self.moments[level] = np.concatenate([self.moments[level], new])
            level, size = level + 1, size * 2

    def feed(self, values: np.ndarray) -> np.ndarray:
        start = len(self.values)
        self.values = np.concatenate([self.values, np.where(np.isnan(values), 0.0, values)])
        self._moments()
        t = np.arange(start, len(self.values))
        r = t + 1.0
        keep = 1 - 2 / (1 + r)
        total = np.zeros(len(t))
        leaves = t // self.LEAF
        # the rows since the last full leaf, one offset at a time
        for back in range(self.LEAF):
            at = t - back
            own = at >= leaves * self.LEAF
            total[own] += self.values[at[own]] * keep[own] ** back
        factorial = np.cumprod(np.concatenate([[1.0], np.arange(1.0, self.TERMS)]))
        for level, moments in enumerate(self.moments):
            rows = np.flatnonzero((leaves >> level) & 1)
            if not len(rows):
                continue
            size = self.LEAF << level
            block = (leaves[rows] >> (level + 1)) << 1
            rate = -np.log(keep[rows])
            series = (moments[block] * (rate * size / 2)[:, None] ** np.arange(self.TERMS) / factorial).sum(1)
            total[rows] += series * np.exp(-rate * (t[rows] - (block * size + (size - 1) / 2)))
        return total * (1 - keep) / (1 - keep**r)


def stream(batches: Iterator, key: str, inputs: list[str], names: list[str], make: list[Callable[[], object]]) -> Iterator:
    """Arrow batches, sorted by key and time, with a column for each state; other columns pass untouched."""
    import pyarrow as pa

    states, last = [m() for m in make], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        at = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        columns = [batch.column(batch.schema.get_field_index(i)).to_numpy(zero_copy_only=False).astype(float) for i in inputs]
        out = [np.empty(len(at)) for _ in states]
        for x, y in zip(edges, edges[1:], strict=False):
            now = (keys[x].as_py(),)
            for state, column, result in zip(states, columns, out, strict=True):
                if now != last:
                    state.reset()
                result[x:y] = state.feed(column[x:y])
            last = now
        made = [pa.array(o, mask=np.isnan(o)) for o in out]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])
