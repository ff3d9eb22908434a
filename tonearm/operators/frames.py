"""Overlapping frames of samples that come in chunks of any length, and what is measured of each frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Feature = Callable[[np.ndarray], np.ndarray]
#: Samples of frames that a task measures at a time, or so.
VALUES = 1 << 20


def hamming_power(frames: np.ndarray) -> np.ndarray:
    """Energies of the frequencies of frames (rows) under a Hamming window."""
    n = frames.shape[1]
    return np.abs(np.fft.rfft(frames * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))))) ** 2


def chroma(rate: int = 11025, frame: int = 4096) -> Feature:
    """12 energies by note, from 28 to 3520 Hz, of unit length or zero."""
    freq = np.arange(frame // 2 + 1) * rate / frame
    ok = (freq >= 28) & (freq < 3520)
    octave = np.log2(freq[ok] / 27.5)
    note = np.floor(12 * (octave - np.floor(octave))).astype(int)

    def of(frames: np.ndarray) -> np.ndarray:
        out = np.zeros((len(frames), 12))
        np.add.at(out.T, note, hamming_power(frames)[:, ok].T)
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.where(norm < 0.01, 0.0, out / np.maximum(norm, 1e-12))

    return of


def bark(frequency: float) -> float:
    """The critical band, with fractions, of a frequency in Hz; both ends of the scale are stretched."""
    z = 26.81 * frequency / (1960 + frequency) - 0.53
    return z + 0.15 * (2 - z) if z < 2 else z + 0.22 * (z - 20.1) if z > 20.1 else z


def bark_edges(bands: int, low: float, high: float, rate: int, frame: int) -> list[int]:
    """First index of each band and the end of the last: bands follow each other as soon as an index is more than an equal share of the scale further.

    Bands that the frame has no index for are empty, at its middle.
    """
    share, edges, since = (bark(high) - bark(low)) / bands, [int(frame * low / rate + 0.5)], bark(low)
    for i in range(edges[0], frame // 2):
        z = bark(i * rate / frame)
        if len(edges) <= bands and z - since > share:
            edges.append(i)
            since = z
    return edges + [frame // 2] * (bands + 1 - len(edges))


def bark_bands(bands: int, low: float, high: float, rate: int = 11025, frame: int = 4096) -> Feature:
    """Mean energy of each band of the Bark scale from ``low`` to ``high`` Hz; empty bands have 0."""
    edges = bark_edges(bands, low, high, rate, frame)

    def of(frames: np.ndarray) -> np.ndarray:
        upto = np.concatenate((np.zeros((len(frames), 1)), hamming_power(frames).cumsum(axis=1)), axis=1)
        sums = upto[:, edges[1:]] - upto[:, edges[:-1]]
        return sums / np.maximum(np.diff(edges), 1)

    return of


def frame_features(chunks: DataFrame, feature: Feature, frame: int = 4096, hop: int | None = None, block: int = 64) -> DataFrame:
    """track_id, frame, feature of (track_id, at, samples) chunks, ``at`` being the number of a chunk's first sample in its track.

    Frames of ``frame`` samples start each ``hop`` (by default a third). Every ``block`` frames of a track are one
    group, and a chunk sends each group the samples that it needs, those that two groups share to both; so a
    track of any length spans tasks, and results don't depend on how it was cut. A frame with a missing sample has no
    row, nor have the samples after a track's last whole frame. Null samples are silence; chunks without samples, or with a null or
    negative ``at``, are left out. Chunks that overlap are expected to agree, as repeated rows do. Other columns are ignored.
    """
    hop = hop or frame // 3
    if not 0 < hop <= frame:
        raise ValueError("a hop is between one sample and a frame")
    step, reach = hop * block, hop * (block - 1) + frame
    held = chunks.where("size(samples) > 0 AND at >= 0").select("track_id", F.col("at").cast("long").alias("at"), F.col("samples").cast("array<double>").alias("samples"))
    end = F.col("at") + F.size("samples")
    groups = F.sequence(F.greatest(F.floor((F.col("at") - reach) / step) + 1, F.lit(0)), F.floor((end - 1) / step))

    def piece(b):
        start = F.greatest(b * step, F.col("at"))
        length = F.least(b * step + reach, end) - start
        return F.struct(b.alias("block"), (start - b * step).alias("place"), F.slice("samples", (start - F.col("at") + 1).cast("int"), length.cast("int")).alias("part"))

    sent = held.select("track_id", F.explode(F.transform(groups, piece)).alias("p")).select("track_id", "p.*")

    parts = sent.groupBy("track_id", "block").agg(F.collect_list(F.struct("place", "part")).alias("p"))
    parts = parts.select("track_id", "block", F.col("p.place").alias("places"), F.transform("p.part", lambda x: F.size(x)).alias("sizes"), F.flatten("p.part").alias("samples"))
    most = max(1, VALUES // (block * frame))
    kind = chunks.schema["track_id"].dataType.simpleString()
    numbers = lambda c, t: c.flatten().to_numpy(zero_copy_only=False).astype(t)

    def run(batches):
        for every in batches:
            for low in range(0, every.num_rows, most):  # groups side by side, as rows of one matrix
                b = every.slice(low, most)
                places, sizes = numbers(b["places"], np.int64), numbers(b["sizes"], np.int64)
                group = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["places"]).to_numpy(zero_copy_only=False))
                at = np.repeat(group * reach + places - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                x, there = np.zeros((b.num_rows, reach)), np.zeros((b.num_rows, reach), bool)
                x.ravel()[at], there.ravel()[at] = np.nan_to_num(numbers(b["samples"], np.float64)), True
                row, place = np.nonzero(np.lib.stride_tricks.sliding_window_view(there, frame, axis=1)[:, ::hop].all(axis=2))
                if len(row):
                    found = np.asarray(feature(np.lib.stride_tricks.sliding_window_view(x, frame, axis=1)[:, ::hop][row, place]), np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                    number = b["block"].to_numpy(zero_copy_only=False)[row] * block + place
                    yield pa.RecordBatch.from_arrays([b["track_id"].take(pa.array(row)), pa.array(number, pa.int64()), lists], ["track_id", "frame", "feature"])

    return parts.mapInArrow(run, f"track_id {kind}, frame long, feature array<double>")
