"""Loudness: block powers, two-stage gates, gain values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Loudness of silence's gate, and how far below the mean the second gate lies.
ABSOLUTE_GATE, RELATIVE_GATE = -70.0, -10.0
REPLAY_GAIN_REFERENCE, R128_REFERENCE = -18.0, -23.0
#: Samples of a block of a recursive filter, and values of an interpolating filter.
BLOCK, TAPS = 128, 12


def loudness(power: Column) -> Column:
    return F.when(power > 0, -0.691 + 10 * F.log10(power))


def block_power(sub: DataFrame, key: str, pos: str, power: str) -> DataFrame:
    """Rows with ``block``: the mean of the last four sub-blocks, from the fourth on."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-3, 0)
    return sub.withColumns({"block": F.avg(power).over(w), "_n": F.count("*").over(w)}).where("_n = 4").drop("_n")


def gated_loudness(blocks: DataFrame, *key: str) -> DataFrame:
    """key, integrated, kept: loudness of the blocks' mean power after both gates; null if none is left."""
    w = Window.partitionBy(*key)
    audible = blocks.where(loudness(F.col("power")) > ABSOLUTE_GATE).withColumn("mean", F.avg("power").over(w))
    kept = audible.where(loudness(F.col("power")) > loudness(F.col("mean")) + RELATIVE_GATE)
    level = kept.groupBy(*key).agg(loudness(F.avg("power")).alias("integrated"), F.count("*").alias("kept"))
    return blocks.select(*key).distinct().join(level, list(key), "left").fillna({"kept": 0})


def channel_weight(channel: Column, channels: Column) -> Column:
    """1 in front, 1.41 around, 0 for the low-frequency channel (the fourth of six or more)."""
    return F.when((channels >= 6) & (channel == 3), 0.0).when((channels >= 5) & (channel >= 3), 1.41).when((channels == 4) & (channel >= 2), 1.41).otherwise(1.0)


def gain_strings(level: Column, peak_db: Column, is_dsd: Column) -> dict[str, Column]:
    """Tag values of a loudness and a peak; null for unknown loudness, and an R128 gain for DSD only."""
    return {
        "gain": F.when(level.isNotNull(), F.concat(F.format_string("%.2f", REPLAY_GAIN_REFERENCE - level), F.lit(" dB"))),
        "peak": F.format_string("%.6f", F.pow(F.lit(10.0), peak_db / 20)),
        "r128": F.when(is_dsd & level.isNotNull(), F.round((R128_REFERENCE - level) * 256).cast("int").cast("string")),
        "reference": F.when(level.isNotNull(), F.lit("-18.00 LUFS")),
    }


@lru_cache(maxsize=16)
def _biquads(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two stages of the K weighting of BS.1770 for a sample rate, from its analogue prototypes."""
    k = np.tan(np.pi * 1681.974450955533 / rate)
    q, vh = 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))]


@lru_cache(maxsize=32)
def _block_matrices(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(now, later, into, step) of a filter of order two over a block of samples: what samples and the state at its start give to the block's
    output, and to the state at its end."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    entry = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ step)
    later = np.array([m[0] for m in powers[:BLOCK]])
    response = np.concatenate(([b[0]], later[:-1] @ entry))
    at = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    now = np.where(at >= 0, response[np.abs(at)], 0.0)
    into = np.array([powers[BLOCK - 1 - i] @ entry for i in range(BLOCK)])
    return now, later, into, np.array(powers)


def filtered(samples: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(output, state): one channel through a recursive filter of order two, from the state that a run of samples before has left.

    Blocks go through matrix products; only the two values of the state pass from block to block.
    """
    now, later, into, powers = _block_matrices(tuple(b.tolist()), tuple(a.tolist()))
    z = np.zeros(2) if state is None else np.asarray(state, np.float64)
    whole, rest = divmod(len(samples), BLOCK)
    x = samples[: whole * BLOCK].reshape(whole, BLOCK)
    given, starts = x @ into, np.empty((whole, 2))
    full = powers[BLOCK]
    for i in range(whole):
        starts[i] = z
        z = full @ z + given[i]
    out = [(x @ now.T + starts @ later.T).ravel()]
    if rest:
        tail = samples[whole * BLOCK :]
        out.append(now[:rest, :rest] @ tail + later[:rest] @ z)
        z = powers[rest] @ z + tail @ into[BLOCK - rest :]
    return np.concatenate(out), z


def k_weighted(samples: np.ndarray, rate: int) -> np.ndarray:
    """One channel through both stages."""
    for b, a in _biquads(rate):
        samples, _ = filtered(samples, b, a)
    return samples


def interpolators(rate: int) -> np.ndarray:
    """Filters of TAPS values, a row a phase, that oversample 4 times below 96 kHz and twice below 192 kHz: a windowed sinc, each phase with the sum 1."""
    up = 4 if rate < 96_000 else 2 if rate < 192_000 else 1
    if up == 1:
        return np.zeros((0, TAPS))
    i = np.arange(TAPS * up)
    h = np.sinc((i - (len(i) - 1) / 2) / up) * (0.5 - 0.5 * np.cos(2 * np.pi * i / (len(i) - 1)))
    phases = h.reshape(TAPS, up).T
    return phases / phases.sum(axis=1, keepdims=True)


def linear_peak(samples: np.ndarray, rate: int, before: np.ndarray | None = None) -> float:
    """The largest magnitude of a channel's samples and between them; ``before`` are the TAPS - 1 samples in front, silence if not given."""
    peak = float(np.abs(samples).max(initial=0.0))
    if len(samples):
        padded = np.concatenate((np.zeros(TAPS - 1) if before is None else before, samples))
        for phase in interpolators(rate):
            peak = max(peak, float(np.abs(np.convolve(padded, phase, "valid")).max()))
    return peak


def decibels(peak: float) -> float:
    """A linear peak in dB; -200 for silence."""
    return 20 * math.log10(peak) if peak > 0 else -200.0


def true_peak(samples: np.ndarray, rate: int) -> float:
    return decibels(linear_peak(samples, rate))


class Meter:
    """Loudness of a track whose samples come in chunks: whatever the chunks, the same block powers and peaks.

    ``state`` is a dict of plain values, so a meter can be written down between any two chunks and go on elsewhere.
    """

    def __init__(self, rate: int, channels: int, state: dict | None = None):
        self.rate, self.channels, self.size = rate, channels, max(1, rate // 10)
        zeros = lambda n: [0.0] * n
        self.state = state or {"registers": zeros(4 * channels), "before": zeros((TAPS - 1) * channels), "sums": zeros(channels), "count": 0, "recent": [], "blocks": 0, "frames": 0, "sample_peak": 0.0, "true_peak": 0.0}
        self.weights = [0.0 if channels >= 6 and c == 3 else 1.41 if (channels >= 5 and c >= 3) or (channels == 4 and c >= 2) else 1.0 for c in range(channels)]

    def feed(self, samples: np.ndarray) -> list[tuple[int, float]]:
        """(number, power) of the blocks that interleaved samples complete."""
        s, wide = self.state, len(samples) // self.channels
        frames = np.asarray(samples, np.float64)[: wide * self.channels].reshape(wide, self.channels)
        registers, before = np.array(s["registers"]).reshape(self.channels, 2, 2), np.array(s["before"]).reshape(self.channels, TAPS - 1)
        squares = np.empty_like(frames)
        for c in range(self.channels):
            x = np.ascontiguousarray(frames[:, c])
            s["sample_peak"] = max(s["sample_peak"], float(np.abs(x).max(initial=0.0)))
            s["true_peak"] = max(s["true_peak"], linear_peak(x, self.rate, before[c]))
            before[c] = np.concatenate((before[c], x))[-(TAPS - 1) :]
            for i, (b, a) in enumerate(_biquads(self.rate)):
                x, registers[c, i] = filtered(x, b, a, registers[c, i])
            squares[:, c] = x * x
        s["registers"], s["before"], s["frames"] = registers.ravel().tolist(), before.ravel().tolist(), s["frames"] + wide
        out, at, sums = [], 0, np.array(s["sums"])
        while at < wide:
            take = min(self.size - s["count"], wide - at)
            sums += squares[at : at + take].sum(axis=0)
            s["count"], at = s["count"] + take, at + take
            if s["count"] == self.size:
                s["recent"] = [*s["recent"], float(np.dot(self.weights, sums) / self.size)][-4:]
                s["count"], sums = 0, np.zeros(self.channels)
                if len(s["recent"]) == 4:
                    out.append((s["blocks"], sum(s["recent"]) / 4))
                    s["blocks"] += 1
        s["sums"] = sums.tolist()
        return out


def measure_tracks(pcm: DataFrame) -> DataFrame:
    """track_id, block, power, peak_db of (track_id, sample_rate, channel, channels, samples) rows: K-weighted power of 400 ms
    blocks every 100 ms, summed over channels by weight, and the true peak over channels.

    A channel's samples are one array, filtered in a task; rows of a track meet only as block powers.
    """

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                x = np.asarray(r.samples, np.float64)
                size = r.sample_rate // 10
                y = k_weighted(x, r.sample_rate)[: len(x) // size * size].reshape(-1, size)
                power = (y * y).mean(axis=1)
                mean = np.convolve(power, np.full(4, 0.25), "valid") if len(power) >= 4 else np.zeros(0)
                peak = true_peak(x, r.sample_rate)
                yield pd.DataFrame({"track_id": r.track_id, "channel": r.channel, "channels": r.channels, "block": np.append(np.arange(len(mean)), -1), "power": np.append(mean, np.nan), "peak_db": peak})

    per = pcm.mapInPandas(run, "track_id string, channel int, channels int, block int, power double, peak_db double")
    power = F.when(F.col("block") >= 0, channel_weight(F.col("channel"), F.col("channels")) * F.col("power"))
    blocks = per.groupBy("track_id", "block").agg(F.sum(power).alias("power"), F.max("peak_db").alias("peak_db"))
    # every channel has a row without a block, with its peak: it stays where a track is too short for a block
    track = Window.partitionBy("track_id")
    blocks = blocks.withColumns({"peak_db": F.max("peak_db").over(track), "last": F.max(F.when(F.col("track_id").isNotNull(), F.col("block"))).over(track)})
    kept = blocks.where("block between 0 and last or (block < 0 and coalesce(last, -1) < 0)")
    return kept.select("track_id", F.when(F.col("block") >= 0, F.col("block")).alias("block"), "power", "peak_db")
