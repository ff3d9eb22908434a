"""Checksums of ranges from chunks, against zlib over the whole bytes."""

from __future__ import annotations

import random
import zlib

import numpy as np

from tonearm.operators import checksums


def test_moved_pieces_add_up():
    rng = random.Random(2)
    for _ in range(30):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 5000))
        assert int(checksums.moved(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_any_cut_gives_the_same(spark):
    rng = random.Random(3)
    discs = {1: rng.randbytes(200_000), 2: rng.randbytes(70_001), 3: b""}
    ranges = [(1, "track 1", 0, 90_000), (1, "track 2", 90_000, 200_000), (1, "disc", 23_520, 200_000 - 23_520), (2, "one byte", 70_000, 70_001), (2, "beyond", 60_000, 80_000), (2, "empty", 5, 5), (3, "none", 0, 10), (None, "null", 0, 9)]
    want = {(1, n, zlib.crc32(discs[1][a:b]), b - a) for d, n, a, b in ranges if d == 1} | {(2, "one byte", zlib.crc32(discs[2][70_000:]), 1)}
    for size in (997, 16_384, 1 << 20):
        rows = [(d, at, bytearray(data[at : at + size])) for d, data in discs.items() for at in range(0, len(data), size)] + [(None, 0, bytearray(b"x")), (1, 900_000, None)]
        chunks = spark.createDataFrame(rows, "disc_id long, at long, pcm binary").repartition(5)
        got = {tuple(r) for r in checksums.range_crcs(chunks, spark.createDataFrame(ranges, "disc_id long, range_id string, low long, high long")).collect()}
        assert {r for r in got if r[1] != "beyond"} == want and [r[3] for r in got if r[1] == "beyond"] == [10_001]
