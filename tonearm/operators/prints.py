"""Perceptual fingerprints: hashes by vote, alignments, peaks, filters over time."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import chroma, frame_features


def simhash(items: DataFrame, key: str) -> DataFrame:
    """key, hash: bit by bit the majority of 32-bit items; a tie or no item gives 0."""
    votes = [F.sum(F.when(F.col("item").bitwiseAND(1 << b) != 0, 1).otherwise(-1)).alias(f"v{b}") for b in range(32)]
    per = items.groupBy(key).agg(*votes)
    return per.select(key, sum((F.when(F.col(f"v{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(32)), F.lit(0).cast("long")).alias("hash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def hamming_bands(rows: int, most: int) -> int:
    """Bands of a 32-bit hash with the least work: probes of all rows, and pairs that meet in a band of random bits."""

    def cost(bands: int) -> float:
        width, probes = 32 // bands, sum(math.comb(32 // bands, r) for r in range(min(most // bands, 32 // bands) + 1))
        return rows * bands * probes * (20 + rows / 2**width)

    return min((2, 4, 8), key=cost)


def hamming_pairs(hashes: DataFrame, most: int, bands: int | None = None) -> DataFrame:
    """left_id, right_id, distance of 32-bit hashes at most ``most`` bits apart.

    Of so many bands of bits, one differs in most / bands bits at most, so each row looks in every band for all
    values so near its own: an equi-join that finds every pair. Few wide bands make more probes and far fewer
    pairs; by default the number of rows decides.
    """
    bands = bands or hamming_bands(hashes.count(), most)
    width = 32 // bands
    part = lambda i: F.shiftright("hash", i * width).bitwiseAND((1 << width) - 1)
    own = F.array(*[F.struct(F.lit(i).alias("band"), part(i).alias("bits")) for i in range(bands)])
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, most // bands)])
    held = hashes.select(F.col("id").alias("right_id"), F.col("hash").alias("y"), F.explode(own).alias("p")).select("right_id", "y", "p.band", "p.bits")
    asks = hashes.select(F.col("id").alias("left_id"), F.col("hash").alias("x"), F.explode(own).alias("p")).select("left_id", "x", "p.band", F.explode(F.transform(masks, lambda m: F.col("p.bits").bitwiseXOR(m))).alias("bits"))
    far = hamming(F.col("x"), F.col("y"))
    met = asks.join(held, ["band", "bits"]).where((F.col("left_id") < F.col("right_id")) & (far <= most))
    return met.select("left_id", "right_id", far.alias("distance")).distinct()


def alignment_histogram(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, offset, n: how often items of equal top 12 bits stand so far apart, if more than once; (pair_id, pos, item) rows."""
    top = lambda df, pos: df.select("pair_id", F.shiftright("item", 20).alias("top"), F.col("pos").alias(pos))
    met = top(left, "i").join(top(right, "j"), ["pair_id", "top"])
    return met.groupBy("pair_id", (F.col("i") - F.col("j")).alias("offset")).agg(F.count("*").alias("n")).where("n > 1")


def integral_image(cells: DataFrame) -> DataFrame:
    """(track_id, frame, bin, value) rows with ``total``, the sum over all earlier frames and lower bins, these included."""
    across = Window.partitionBy("track_id", "frame").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("track_id", "bin").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("line", F.sum("value").over(across)).withColumn("total", F.sum("line").over(down)).drop("line")


def areas(image: DataFrame, low: int, bins: int, frames: int) -> DataFrame:
    """track_id, frame, area: the sum over ``bins`` bins from ``low`` and ``frames`` frames from each frame on, by four corners of an integral image; where all these frames exist."""
    high = low + bins - 1
    corners = image.where(F.col("bin").isin(low - 1, high)).groupBy("track_id", "frame").agg(
        (F.max(F.when(F.col("bin") == high, F.col("total"))) - F.coalesce(F.max(F.when(F.col("bin") == low - 1, F.col("total"))), F.lit(0))).alias("upto")
    )
    w = Window.partitionBy("track_id").orderBy("frame")
    rows = corners.withColumn("end", F.lead("upto", frames - 1).over(w)).withColumn("before", F.coalesce(F.lag("upto").over(w), F.lit(0)))
    return rows.where("end is not null").select("track_id", "frame", (F.col("end") - F.col("before")).alias("area"))


def local_maxima(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Rows not below either neighbour; plateaus count, and the ends have one neighbour."""
    w = Window.partitionBy(key).orderBy(pos)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    marked = rows.withColumn("_top", (before.isNull() | (F.col(value) >= before)) & (after.isNull() | (F.col(value) >= after)))
    return marked.where("_top").drop("_top")


def time_filter(rows: DataFrame, key: str, pos: str, value: str, weights: tuple[float, ...]) -> DataFrame:
    """Rows with ``smooth``: the weighted sum of the last values, where so many are there."""
    w = Window.partitionBy(key).orderBy(pos)
    terms = [F.lag(value, len(weights) - 1 - i).over(w) * x for i, x in enumerate(weights)]
    return rows.withColumn("smooth", sum(terms[1:], terms[0])).where("smooth is not null")


def open_from(rows: DataFrame, key: str, pos: str, value: str, window: int, threshold: int) -> DataFrame:
    """Rows from the first on whose integer moving average is over a threshold: leading silence goes."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-(window - 1), 0)
    mean = F.floor(F.sum(F.abs(value)).over(w) / F.count("*").over(w))
    so_far = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_mean", mean)
    return rows.withColumn("_open", F.max((F.col("_mean") > threshold).cast("int")).over(so_far)).where("_open = 1").drop("_mean", "_open")


def note_of(frequency: Column, base: float = 27.5, bins: int = 12) -> Column:
    """The chroma bin of a frequency between 28 and 3520 Hz, else null."""
    octave = F.log2(frequency / base)
    return F.when((frequency >= 28) & (frequency < 3520), F.floor(bins * (octave - F.floor(octave))).cast("int"))


def distance_tiers(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the Euclidean distance of unit vectors and whether they are the same, close or different."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    d = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    return pairs.withColumn("distance", d)


#: Bits of a pair of classifier levels, so that neighbouring levels differ in one.
GRAY = (0, 1, 3, 2)


def chroma_features(pcm: DataFrame, rate: int = 11025, frame: int = 4096) -> DataFrame:
    """track_id, frame, chroma: 12 energies of each Hamming-windowed frame, a third of a frame apart, unit length or zero, of (track_id, samples) rows; see frames for tracks in chunks."""
    found = frame_features(pcm.select(F.col("track_id").cast("string").alias("track_id"), F.lit(0).alias("at"), "samples"), chroma(rate, frame), frame)
    return found.select("track_id", F.col("frame").cast("int").alias("frame"), F.col("feature").alias("chroma"))


def pack_items(items: np.ndarray) -> bytes:
    """Items as XOR differences, each as the gaps between its set bits in 3 bits, gaps of 7 and more in 5 bits more."""
    x = np.asarray(items, np.uint32)
    delta = x.copy()
    delta[1:] ^= x[:-1]
    normal, large = [], []
    for v in delta.tolist():
        last = 0
        for bit in range(1, 33):
            if v >> (bit - 1) & 1:
                gap = bit - last
                normal.append(min(gap, 7))
                if gap >= 7:
                    large.append(gap - 7)
                last = bit
        normal.append(0)
    bits = [v >> k & 1 for v in normal for k in range(3)]
    bits += [0] * (-len(bits) % 8)
    bits += [v >> k & 1 for v in large for k in range(5)]
    return len(x).to_bytes(3, "big") + np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def unpack_items(data: bytes) -> np.ndarray:
    n, bits = int.from_bytes(data[:3], "big"), np.unpackbits(np.frombuffer(data[3:], np.uint8), bitorder="little").tolist()
    normal, at, ends = [], 0, 0
    while ends < n:
        v = bits[at] | bits[at + 1] << 1 | bits[at + 2] << 2
        normal.append(v)
        at, ends = at + 3, ends + (v == 0)
    at += -at % 8
    out, v, bit = [], 0, 0
    for g in normal:
        if g == 0:
            out.append(v)
            v, bit = 0, 0
            continue
        if g == 7:
            g += sum(bits[at + k] << k for k in range(5))
            at += 5
        bit += g
        v |= 1 << (bit - 1)
    return np.bitwise_xor.accumulate(np.array(out, np.uint32)) if out else np.zeros(0, np.uint32)
