"""Medians of many windows of one array at once."""

from __future__ import annotations

import numpy as np


def window_medians(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The median of x[start:stop] for each window (of any odd length; the upper of the middle two for even ones).

    A wavelet matrix over ranks: bit by bit from the highest, ranks are parted
    stably into zeros and ones, and every window steps to the part that holds
    its median. All windows step together, so the cost is log2(len(x)) passes
    over x and over the windows, whatever their lengths.
    """
    order = np.argsort(x, kind="stable")
    ranks = np.empty(len(x), np.int32)
    ranks[order] = np.arange(len(x), dtype=np.int32)
    lo, hi = start.astype(np.int32), stop.astype(np.int32)
    place, found = (hi - lo) // 2, np.zeros(len(lo), np.int32)
    for bit in range(max(1, int(len(x) - 1).bit_length()) - 1, -1, -1):
        ones = (ranks >> bit & 1).astype(bool)
        zeros_before = np.zeros(len(x) + 1, np.int32)
        np.cumsum(~ones, out=zeros_before[1:])
        a, b = zeros_before[lo], zeros_before[hi]
        up = place >= b - a
        place -= np.where(up, b - a, 0)
        lo, hi = np.where(up, zeros_before[-1] + lo - a, a), np.where(up, zeros_before[-1] + hi - b, b)
        found |= up.astype(np.int32) << bit
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return x[order[found]]
