"""CRC-32 of ranges of discs whose bytes come in chunks: checksums of pieces, moved to their place and added.

A CRC is a remainder of a polynomial over two elements. The checksum of a whole is the exclusive or of those of its pieces, each
multiplied by x to the power of the bits behind it, so pieces can be summed in any order and grouping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.discs import SAMPLE_BYTES, TRIM_SAMPLES

#: Fixed value: the polynomial, lowest power first.
POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the polynomial of remainders, the highest bit being the constant term."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64).copy(), np.zeros(len(a), np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ np.uint64(POLYNOMIAL), b >> np.uint64(1))
    return out


def moved(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Checksums of pieces as parts of a whole with so many bytes behind each."""
    out, left = np.asarray(crc, np.uint64).copy(), np.asarray(behind, np.int64).copy()
    power = np.full(1, 1 << 23, np.uint64)  # x to the power of 8
    while left.any():
        odd = (left & 1) == 1
        out[odd] = _times(np.repeat(power, odd.sum()), out[odd])
        power, left = _times(power, power), left >> 1
    return out


def range_crcs(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """disc_id, range_id, crc, bytes of every range of which some byte is there.

    chunks: (disc_id, at, pcm), bytes from the place ``at`` of a disc on, without overlaps; ranges: (disc_id, range_id, low, high), the places from low up to high.
    Any cut into chunks gives the same; ``bytes`` tells whether all of a range were there, and a range with a gap has the checksum with zeros in it, started there anew. Rows with nulls
    and empty ranges take no part. Only the checksums of pieces are shuffled to their range.
    """

    @F.pandas_udf("long")
    def placed(crc: pd.Series, behind: pd.Series) -> pd.Series:
        return pd.Series(moved(crc.to_numpy(np.int64), behind.to_numpy(np.int64)).astype(np.int64))

    size = F.octet_length("pcm")
    met = chunks.where("pcm is not null").withColumn("until", F.col("at") + size).join(ranges.where("low < high"), "disc_id")
    met = met.where((F.col("at") < F.col("high")) & (F.col("until") > F.col("low")))
    start, end = F.greatest("at", "low"), F.least("until", "high")
    piece = F.substring(F.col("pcm"), (start - F.col("at") + 1).cast("int"), (end - start).cast("int"))
    each = met.select("disc_id", "range_id", F.crc32(piece).alias("crc"), (end - start).alias("n"), (F.col("high") - end).alias("behind"))
    return each.withColumn("crc", placed("crc", "behind")).groupBy("disc_id", "range_id").agg(F.bit_xor("crc").alias("crc"), F.sum("n").alias("bytes"))


def disc_range(first: Column, end: Column, trim: int = TRIM_SAMPLES) -> tuple[Column, Column]:
    """(low, high) in bytes of the checksum of a whole disc, between the samples where its first track begins and its last one ends: both trims are left out."""
    return (first + trim) * SAMPLE_BYTES, (end - trim) * SAMPLE_BYTES
