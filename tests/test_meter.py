"""The meter: any chunking, any order of chunks and a restart give the whole track's result; the calibration tone."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tonearm.operators import loudness
from tonearm.streaming.meter import measured_chunks


def by_sample(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    out, z1, z2 = [], 0.0, 0.0
    for v in x.tolist():
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


def test_block_filter_equals_the_filter_by_samples():
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=3000)
    for rate in (44_100, 96_000):
        for b, a in loudness._biquads(rate):
            want = by_sample(x, b, a)
            for cuts in ([3000], [1, 127, 128, 129, 2615], [1000, 2000]):
                got, z, at = [], None, 0
                for n in cuts:
                    y, z = loudness.filtered(x[at : at + n], b, a, z)
                    got.append(y)
                    at += n
                assert np.allclose(np.concatenate(got), want, rtol=0, atol=1e-9)


def tone(rate: int, seconds: float, channels: int, level: float = -23.0) -> np.ndarray:
    x = 10 ** (level / 20) * np.sin(2 * np.pi * 1000 * np.arange(int(rate * seconds)) / rate)
    return np.repeat(x[:, None], channels, axis=1).ravel()


@pytest.mark.parametrize("rate", [44_100, 48_000, 96_000])
def test_calibration_tone_in_chunks(rate):
    meter = loudness.Meter(rate, 2)
    samples, powers = tone(rate, 3, 2), []
    for at in range(0, len(samples), 2 * 5003):
        powers += [p for _, p in meter.feed(samples[at : at + 2 * 5003])]
    level = -0.691 + 10 * math.log10(np.mean(powers))
    assert abs(level + 23.0) < 0.1 and len(powers) == 27 and meter.state["frames"] == 3 * rate
    assert abs(loudness.decibels(meter.state["sample_peak"]) + 23.0) < 0.01


def test_peaks_between_samples_and_of_cut_tracks():
    """A sine at a quarter of the rate, sampled beside its tops: 3 dB more between the samples, also across chunks."""
    x = np.sin(np.pi / 2 * np.arange(4000) + np.pi / 4)
    whole = loudness.linear_peak(x, 44_100)
    assert abs(20 * math.log10(whole)) < 0.2 and abs(np.abs(x).max() - math.sqrt(0.5)) < 1e-9
    for size in (1, 7, 11, 500):
        meter = loudness.Meter(44_100, 1)
        for at in range(0, len(x), size):
            meter.feed(x[at : at + size])
        assert abs(meter.state["true_peak"] - whole) < 1e-12
    assert loudness.linear_peak(x, 192_000) == np.abs(x).max() and loudness.true_peak(np.zeros(100), 44_100) == -200.0


def whole_track(x: np.ndarray, rate: int, channels: int) -> dict:
    meter = loudness.Meter(rate, channels)
    out = {b: p for b, p in meter.feed(x)}
    return out | {None: (meter.state["frames"] / rate, loudness.decibels(meter.state["sample_peak"]), loudness.decibels(max(meter.state["sample_peak"], meter.state["true_peak"])))}


def test_stream_of_chunks_with_a_restart(spark, tmp_path):
    """Chunks in files of several micro-batches, out of order and repeated; the query is stopped midway and started again from its checkpoint."""
    rng = np.random.Generator(np.random.PCG64(4))
    tracks = {"a": (rng.normal(size=2 * 9000) * 0.1, 8000, 2), "b": (rng.normal(size=7000) * 0.2, 8000, 1), "c": (np.zeros(0), 8000, 2), "d": (rng.normal(size=6 * 5000) * 0.1, 8000, 6)}
    rows = []
    for t, (x, rate, channels) in tracks.items():
        frames, at, seq = len(x) // channels, 0, 0
        while True:
            n = int(min(rng.integers(1, 1500), frames - at))
            rows.append((t, seq, rate, channels, x[at * channels : (at + n) * channels].tolist(), at + n == frames))
            at, seq = at + n, seq + 1
            if at == frames:
                break
    rng.shuffle(rows)
    rows = [(t, int(s), int(r), int(c), [float(v) for v in x], bool(e)) for t, s, r, c, x, e in rows]
    rows += [(None, 0, 8000, 1, [1.0], True), ("e", None, 8000, 1, [1.0], True), ("f", 0, 8000, 1, None, True)]
    schema = "track_id string, seq long, sample_rate int, channels int, samples array<double>, last boolean"
    files, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    parts = [rows[i::4] for i in range(4)]
    parts.append(parts[0])  # repeated chunks of tracks that have ended
    parts[2] = parts[2] + parts[0][:4]  # and of some that go on

    def run():
        chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
        query = measured_chunks(chunks).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)

    for half in (parts[:2], parts[2:]):
        for part in half:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(files)
        run()
    got: dict[str, dict] = {}
    for r in spark.read.parquet(out).collect():
        key = None if r.block is None else r.block
        assert key not in got.setdefault(r.track_id, {})
        got[r.track_id][key] = r.power if r.block is not None else (r.seconds, r.sample_peak_db, r.true_peak_db)
    want = {t: whole_track(*v) for t, v in tracks.items()} | {"f": {None: (0.0, -200.0, -200.0)}}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t].keys() == want[t].keys() and all(np.allclose(got[t][k], want[t][k], rtol=1e-9, atol=1e-12) for k in want[t])
