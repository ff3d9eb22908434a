"""Hilbert keys of points, by Skilling's transpose form of the curve (AIP Conf. Proc. 707, 2004)."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of integer cells (rows of n coordinates in [0, 2**bits)); n * bits must stay below 64.

    Neighbouring positions are cells that differ by one step in one coordinate.
    """
    n, dims = cells.shape
    if dims * bits > 63:
        raise ValueError("dims * bits must be at most 63")
    x = [cells[:, d].astype(np.int64) for d in range(dims)]
    step = 1 << (bits - 1)
    while step > 1:  # undo the rotations and reflections of each level
        low = step - 1
        for d in range(dims):
            flip = (x[d] & step) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            if d:
                x[d] ^= swap
        step >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    fix = np.zeros(n, np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        fix ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | (((x[d] ^ fix) >> b) & 1)
    return key


def cells_of(points: np.ndarray, bits: int) -> np.ndarray:
    """Cells of points in [0, 1); points outside go to the outermost cells."""
    side = 1 << bits
    return np.clip((points * side).astype(np.int64), 0, side - 1)
