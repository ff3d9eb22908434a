"""Items of acoustic fingerprints from chroma frames, and the stretches over which two fingerprints agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .prints import GRAY

#: Signs of the parts of a filter's rectangle, by parts in time, then by parts of the bins.
SIGNS = {0: [[1]], 1: [[-1, 1]], 2: [[-1], [1]], 3: [[-1, 1], [1, -1]], 4: [[-1, 1, -1]], 5: [[-1], [1], [-1]]}
#: Kind of filter, first bin, bins, frames, and the three levels of each classifier.
CLASSIFIERS = (
    (0, 4, 3, 15, 1.98215, 2.35817, 2.63523),
    (4, 4, 6, 15, -1.03809, -0.651211, -0.282167),
    (1, 0, 4, 16, -0.298702, 0.119262, 0.558497),
    (3, 8, 2, 12, -0.105439, 0.0153946, 0.135898),
    (3, 4, 4, 8, -0.142891, 0.0258736, 0.200632),
    (4, 0, 3, 5, -0.826319, -0.590612, -0.368214),
    (1, 2, 2, 9, -0.557409, -0.233035, 0.0534525),
    (2, 7, 3, 4, -0.0646826, 0.00620476, 0.0784847),
    (2, 6, 2, 16, -0.192387, -0.029699, 0.215855),
    (2, 1, 3, 2, -0.0397818, -0.00568076, 0.0292026),
    (5, 10, 1, 15, -0.53823, -0.369934, -0.190235),
    (3, 6, 2, 10, -0.124877, 0.0296483, 0.139239),
    (2, 1, 1, 14, -0.101475, 0.0225617, 0.231971),
    (3, 5, 6, 4, -0.0799915, -0.00729616, 0.063262),
    (1, 9, 2, 12, -0.272556, 0.019424, 0.302559),
    (3, 4, 2, 14, -0.164292, -0.0321188, 0.0846339),
)
#: Frames that an item looks at.
WIDEST = max(c[3] for c in CLASSIFIERS)


def summed(image: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the first row and column; one more row and column than the image."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    return out


def items_of(chroma: np.ndarray) -> np.ndarray:
    """An unsigned 32-bit item for each run of WIDEST frames (rows): two Gray-coded bits a classifier, the first highest."""
    n = len(chroma) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total, items = summed(np.asarray(chroma, np.float64)), np.zeros(n, np.uint32)
    for kind, low, bins, frames, *levels in CLASSIFIERS:
        signs = np.array(SIGNS[kind])
        times = [k * (frames // signs.shape[0]) for k in range(signs.shape[0])] + [frames]
        rows = [low + k * (bins // signs.shape[1]) for k in range(signs.shape[1])] + [low + bins]
        sums = {1: np.ones(n), -1: np.ones(n)}
        for (t, b), sign in np.ndenumerate(signs):
            upper, lower = total[times[t + 1] : times[t + 1] + n], total[times[t] : times[t] + n]
            sums[int(sign)] += (upper[:, rows[b + 1]] - upper[:, rows[b]]) - (lower[:, rows[b + 1]] - lower[:, rows[b]])
        level = np.searchsorted(levels, np.log(sums[1] / sums[-1]), side="right")
        items = items << np.uint32(2) | np.array(GRAY, np.uint32)[level]
    return items


def fingerprint_items(frames: DataFrame) -> DataFrame:
    """track_id, items of (track_id, frame, chroma) rows; the frames of a track are one group.

    Tracks with fewer than WIDEST frames have no item. A null chroma counts as silence.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        chroma = np.array([np.zeros(12) if c is None else np.asarray(c, np.float64) for c in group["chroma"]])
        return pd.DataFrame({"track_id": [group["track_id"].iloc[0]], "items": [items_of(chroma).astype(np.int64)]})

    return frames.groupBy("track_id").applyInPandas(run, "track_id string, items array<long>")


def smoothed(values: np.ndarray, sigma: float = 8.0, passes: int = 3) -> np.ndarray:
    """Nearly a Gaussian: means over windows of two odd widths, as many of each as give its variance; ends are mirrored."""
    small = int(np.sqrt(12 * sigma * sigma / passes + 1))
    small -= small % 2 == 0
    narrow = int(np.floor((12 * sigma * sigma - passes * (small + 1) * (small + 3)) / (-4 * small - 4) + 0.5))
    for k in range(passes if len(values) else 0):
        width = small if k < narrow else small + 2
        padded = np.concatenate(([0.0], np.pad(values, width // 2, mode="symmetric").cumsum()))
        values = (padded[width:] - padded[:-width]) / width
    return values


def best_offset(left: np.ndarray, right: np.ndarray) -> int | None:
    """By how many items the right one must move for most items to agree in their top 12 bits; None if no two do.

    Of equally good offsets the largest counts.
    """
    top_l, top_r = left >> np.uint32(20), right >> np.uint32(20)
    places = {int(v): np.flatnonzero(top_r == v) for v in np.intersect1d(top_l, top_r)}
    count = np.zeros(len(left) + len(right), np.int64)
    for i, v in enumerate(top_l.tolist()):
        if v in places:
            count[i + len(right) - places[v]] += 1
    if not len(count) or count.max() < 2:
        return None
    return int(np.flatnonzero(count == count.max())[-1]) - len(right)


def segments_of(left: np.ndarray, right: np.ndarray, most: float = 10.0, peak: float = 0.15, merge: float = 0.7) -> list[tuple[int, int, int, float]]:
    """(left_start, right_start, length, score): stretches at the best offset with fewer than ``most`` differing bits an item.

    The smoothed number of differing bits is cut where it changes most; a stretch whose mean is
    within ``merge`` of the one kept before is joined with it.
    """
    left, right = np.asarray(left, np.uint32), np.asarray(right, np.uint32)
    offset = best_offset(left, right)
    if offset is None:
        return []
    a, b = max(offset, 0), max(-offset, 0)
    n = min(len(left) - a, len(right) - b)
    bits = np.bitwise_count(left[a : a + n] ^ right[b : b + n]).astype(np.float64)
    slope = np.abs(np.gradient(smoothed(bits))) if n > 1 else np.zeros(n)
    high = np.zeros(n, bool)
    high[1:-1] = (slope[1:-1] > peak) & (slope[1:-1] >= slope[:-2]) & (slope[1:-1] >= slope[2:])
    cuts = [0]
    for at in np.flatnonzero(high).tolist():
        if len(cuts) == 1 or cuts[-1] + 1 < at:
            cuts.append(at)
    out: list[tuple[int, int, int, float]] = []
    for start, end in zip(cuts, [*cuts[1:], n], strict=True):
        score = float(bits[start:end].mean())
        if score >= most:
            continue
        if out and abs(out[-1][3] - score) < merge:
            x, y, length, before = out[-1]
            size = end - start
            out[-1] = (x, y, length + size, (before * length + score * size) / (length + size))
        else:
            out.append((a + start, b + start, end - start, score))
    return out


def matching_segments(pairs: DataFrame) -> DataFrame:
    """pair_id, left_start, right_start, length, score of (pair_id, left, right) rows of item arrays.

    Null or empty arrays, and pairs without two agreeing items, give no row. Each pair is worked on
    alone, and a fingerprint has a few thousand items.
    """

    def run(batches):
        for b in batches:
            rows = [(p, *s) for p, x, y in zip(b["pair_id"], b["left"], b["right"], strict=True) if x is not None and y is not None for s in segments_of(x, y)]
            yield pd.DataFrame(rows, columns=["pair_id", "left_start", "right_start", "length", "score"])

    return pairs.select("pair_id", "left", "right").mapInPandas(run, "pair_id long, left_start int, right_start int, length int, score double")
