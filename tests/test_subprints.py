"""Fingerprint items and segments against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tonearm.operators import subprints


def plain_item(image: np.ndarray, at: int) -> int:
    def area(t0, t1, b0, b1):
        return sum(image[at + t][b] for t in range(t0, t1) for b in range(b0, b1))

    out = 0
    for kind, y, h, w, *levels in subprints.CLASSIFIERS:
        if kind == 0:
            a, b = area(0, w, y, y + h), 0.0
        elif kind == 1:
            a, b = area(0, w, y + h // 2, y + h), area(0, w, y, y + h // 2)
        elif kind == 2:
            a, b = area(w // 2, w, y, y + h), area(0, w // 2, y, y + h)
        elif kind == 3:
            a = area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)
            b = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 4:
            a, b = area(0, w, y + h // 3, y + 2 * (h // 3)), area(0, w, y, y + h // 3) + area(0, w, y + 2 * (h // 3), y + h)
        else:
            a, b = area(w // 3, 2 * (w // 3), y, y + h), area(0, w // 3, y, y + h) + area(2 * (w // 3), w, y, y + h)
        value = math.log((1 + a) / (1 + b))
        out = out << 2 | (0, 1, 3, 2)[sum(value >= t for t in levels)]
    return out


def chroma(seed: int, n: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64(seed)).random((n, 12)) ** 3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_items(spark):
    tracks = {"a": chroma(1, 40), "b": chroma(2, 16), "short": chroma(3, 15)}
    rows = [(t, i, c.tolist()) for t, x in tracks.items() for i, c in enumerate(x)]
    got = {r.track_id: r["items"] for r in subprints.fingerprint_items(spark.createDataFrame(rows, "track_id string, frame int, chroma array<double>").repartition(3)).collect()}
    assert got == {t: [plain_item(x, i) for i in range(len(x) - 15)] for t, x in tracks.items()}
    assert len(got["b"]) == 1 and got["short"] == []


@pytest.mark.parametrize("n", [1, 2, 9, 40, 200])
def test_smoothing_keeps_the_mean_of_mirrored_values(n):
    x = np.random.Generator(np.random.PCG64(n)).random(n)

    def box(v, w):
        mirrored = lambda i: v[i % (2 * n)] if i % (2 * n) < n else v[2 * n - 1 - i % (2 * n)]
        return [sum(mirrored(i + k) for k in range(-(w // 2), w // 2 + 1)) / w for i in range(n)]

    assert np.allclose(subprints.smoothed(x), box(box(box(x.tolist(), 15), 15), 17))


def test_segments(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    own, other = rng.integers(0, 1 << 32, 300, dtype=np.uint32), rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    moved = np.concatenate((other[:40], own[:150], other[190:]))
    rows = [(1, own.tolist(), own.tolist()), (2, own.tolist(), moved.tolist()), (3, own.tolist(), other.tolist()), (4, None, own.tolist()), (5, [], own.tolist()), (6, [7, 7], [7]), (7, [7, 7, 8], [7, 7])]
    got = subprints.matching_segments(spark.createDataFrame(rows, "pair_id long, left array<long>, right array<long>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.pair_id, []).append(r)
    assert [(r.left_start, r.right_start, r.length, r.score) for r in by[1]] == [(0, 0, 300, 0.0)]
    (r,) = by[2]
    assert (r.left_start, r.right_start) == (0, 40) and abs(r.length - 150) <= 4 and r.score < 1
    assert not {4, 5, 6} & set(by)
    assert [(r.left_start, r.right_start, r.length) for r in by[7]] == [(1, 0, 2)]  # two offsets agree twice: the larger
