"""Frames across chunks against whole tracks, and Bark bands against plain sums."""

from __future__ import annotations

import numpy as np
import pytest

from tonearm.operators import frames

SCHEMA = "track_id string, at long, samples array<double>"


def cut(track: str, x: np.ndarray, size: int) -> list[tuple]:
    return [(track, at, x[at : at + size].tolist()) for at in range(0, len(x), size)]


def test_any_chunks_give_the_frames_of_the_whole(spark):
    rng, bands = np.random.default_rng(3), frames.bark_bands(5, 300, 3600, 8000, 64)
    tracks = {"a": rng.normal(size=1000), "b": rng.normal(size=63), "c": rng.normal(size=64)}
    for size, block in ((1, 2), (17, 3), (400, 1), (5000, 50)):
        rows = [r for t, x in tracks.items() for r in cut(t, x, size)]
        edges = [("a", None, [1.0]), ("a", -5, [1.0, 2.0]), ("d", 0, None), ("d", 0, []), (None, 0, [None] * 64)]
        chunks = spark.createDataFrame(rows + rows[:3] + edges, SCHEMA)
        got = {(r.track_id, r.frame): r.feature for r in frames.frame_features(chunks, bands, 64, block=block).collect()}
        want = {(t, k): bands(x[None, k * 21 : k * 21 + 64])[0] for t, x in tracks.items() for k in range((len(x) - 64) // 21 + 1 if len(x) >= 64 else 0)}
        assert got.pop((None, 0)) == [0.0] * 5
        assert got.keys() == want.keys() and len(want) == 46
        for k, v in want.items():
            assert got[k] == pytest.approx(v)


def test_a_gap_has_no_frames(spark):
    x = np.ones(300)
    chunks = spark.createDataFrame([r for r in cut("a", x, 50) if r[1] != 100], SCHEMA)
    got = sorted(r.frame for r in frames.frame_features(chunks, frames.chroma(8000, 32), 32, 10, block=4).collect())
    assert got == [k for k in range(27) if k * 10 + 32 <= 100 or k * 10 >= 150]
    assert frames.frame_features(chunks.limit(0), frames.chroma(8000, 32), 32).count() == 0


def test_bark_scale_and_bands():
    assert [round(frames.bark(f), 4) for f in (0, 1000, 20000)] == [-0.1505, 8.5274, 24.7203]
    edges = frames.bark_edges(8, 100, 4000, 11025, 4096)
    assert len(edges) == 9 and edges[0] == 37 and edges == sorted(edges)
    width = (frames.bark(4000) - frames.bark(100)) / 8
    for a, b in zip(edges[1:-1], edges[2:], strict=True):
        since = frames.bark(a * 11025 / 4096)
        assert b == 2048 or (frames.bark(b * 11025 / 4096) - since > width >= frames.bark((b - 1) * 11025 / 4096) - since)
    x = np.random.default_rng(1).normal(size=(3, 256))
    power, e = frames.hamming_power(x), frames.bark_edges(4, 200, 3500, 8000, 256)
    got = frames.bark_bands(4, 200, 3500, 8000, 256)(x)
    for b in range(4):
        assert got[:, b] == pytest.approx(power[:, e[b] : e[b + 1]].mean(axis=1))
    assert frames.bark_edges(9, 0, 500, 8000, 8)[-1] == 4
