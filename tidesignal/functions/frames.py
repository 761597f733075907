"""Order statistics of arbitrary frames of one series, for all rows at once: a wavelet matrix over ranks.

The values are replaced by their ranks, and the ranks are stored bit by bit from the highest on: at each level a count of zeros up to
every place, and the ranks reordered so that those with a zero come first. A frame is a range of places; every level maps it to a range in
the next, so the k-th smallest value of a frame, or the number of its values below a bound, takes as many steps as ranks have bits,
whatever the length of the frame. Each step is done for all rows together. Missing values have a place in the series but none in the matrix.
"""

from __future__ import annotations

import numpy as np


class Frames:
    """Frames [start, stop) of the places of ``x``; NaN is missing."""

    def __init__(self, x: np.ndarray):
        known = ~np.isnan(x)
        self.at = np.concatenate(([0], np.cumsum(known)))
        self.values, ranks = np.unique(x[known], return_inverse=True)
        self.bits = max(1, int(len(self.values) - 1).bit_length()) if len(self.values) else 0
        self.zeros, self.turn = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (ranks >> b) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            self.turn.append(int(self.zeros[-1][-1]))
            ranks = np.concatenate((ranks[~one], ranks[one]))

    def count(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Values that are not missing."""
        return self.at[stop] - self.at[start]

    def kth(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0; every frame must have more than k values."""
        a, z, rank = self.at[start], self.at[stop], np.zeros(len(start), np.int64)
        for b, zeros, turn in zip(range(self.bits - 1, -1, -1), self.zeros, self.turn):
            low, high = zeros[a], zeros[z]
            one = k >= high - low
            k = np.where(one, k - (high - low), k)
            a, z = np.where(one, turn + a - low, low), np.where(one, turn + z - high, high)
            rank |= one.astype(np.int64) << b
        return self.values[rank]

    def up_to(self, start: np.ndarray, stop: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Number of values that are at most ``v``."""
        bound = np.searchsorted(self.values, v, "right")
        a, z, n = self.at[start], self.at[stop], np.zeros(len(start), np.int64)
        every = bound == len(self.values)
        for b, zeros, turn in zip(range(self.bits - 1, -1, -1), self.zeros, self.turn):
            low, high = zeros[a], zeros[z]
            one = (bound >> b) & 1 == 1
            n += np.where(one, high - low, 0)
            a, z = np.where(one, turn + a - low, low), np.where(one, turn + z - high, high)
        return np.where(every, self.count(start, stop), n)

    def quantile(self, start: np.ndarray, stop: np.ndarray, level: float | np.ndarray) -> np.ndarray:
        """Interpolated quantile; NaN for a frame without values or a missing level."""
        n, level, out = self.count(start, stop), np.broadcast_to(np.asarray(level, float), len(start)), np.full(len(start), np.nan)
        has = (n > 0) & ~np.isnan(level)
        if has.any():
            a, z, last = start[has], stop[has], n[has] - 1
            at = last * level[has]
            low = at.astype(np.int64)
            x, y = self.kth(a, z, low), self.kth(a, z, np.minimum(low + 1, last))
            out[has] = x + (y - x) * (at - low)
        return out

    def share(self, start: np.ndarray, stop: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Share of the values that are at most ``v``; NaN for a frame without values."""
        n = self.count(start, stop)
        return np.divide(self.up_to(start, stop, v), n, out=np.full(len(n), np.nan), where=n > 0)


def trailing(rows: int, window: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the last ``window`` rows up to each row, or up to ``skip`` rows before it."""
    stop = np.maximum(np.arange(1, rows + 1) - skip, 0)
    return np.maximum(stop - window, 0), stop
