"""Token shards as wavelet matrices: one compressed file a shard, with access, counting and occurrence lookup."""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, filesystem, materialize, new_folder, shuffle_parts
from .tokens import encoder

MAGIC = b"TAWM2\n"
#: Bits between two stored ranks of a plane.
RANK_STEP = 4096
#: Bytes of a plane that are compressed together: what a lookup inflates. A multiple of RANK_STEP bits.
BLOCK_BYTES = 1 << 15
#: Inflated blocks that an open shard keeps.
KEPT_BLOCKS = 256
#: Ids of a shard; a shard is closed with the document that reaches it.
SHARD_IDS = 1 << 21
#: Texts that are encoded at a time.
BATCH_TEXTS = 512


def build_planes(ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """Packed bit planes, highest bit first; each level's order is the one before, zeros first and stable."""
    planes, now = [], ids
    for level in range(levels - 1, -1, -1):
        bit = (now & now.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bit))
        now = np.concatenate((now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))))
    return planes


def rank_directory(plane: np.ndarray, n: int) -> np.ndarray:
    """Ones of a packed plane of n bits before every RANK_STEP-th place, and all of them."""
    blocks = -(-n // RANK_STEP)
    padded = np.zeros(blocks * RANK_STEP // 8, np.uint8)
    padded[: len(plane)] = plane
    ones = np.bitwise_count(padded.reshape(blocks, -1)).sum(axis=1, dtype=np.int64) if blocks else np.zeros(0, np.int64)
    return np.concatenate(([0], np.cumsum(ones)))


class WaveletMatrix:
    """A sequence of integers below 2**levels, kept as bit planes with ranks at every RANK_STEP-th bit.

    A plane is an array of packed bits or anything that gives such arrays for slices, as BlockedPlane does.
    """

    def __init__(self, planes: list, ranks: list[np.ndarray], n: int):
        self.n, self.planes, self.ranks, self.levels = n, planes, ranks, len(planes)
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids).astype(np.uint32)
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes = build_planes(ids, levels)
        return cls(planes, [rank_directory(p, len(ids)) for p in planes], len(ids))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3 : (i >> 3) + 1][0] >> (7 - (i & 7))) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        block, whole = i // RANK_STEP, i >> 3
        p = self.planes[level][block * RANK_STEP // 8 : whole + (1 if i & 7 else 0)]
        within = whole - block * RANK_STEP // 8
        n = int(self.ranks[level][block]) + int(np.bitwise_count(p[:within]).sum())
        return n + (int(p[within] >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        ranks = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * RANK_STEP - self.ranks[level]
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        a = block * RANK_STEP
        bits = np.unpackbits(self.planes[level][a // 8 : (a + RANK_STEP) // 8])
        return a + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _walk(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.levels):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            if token >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + ra, self.zeros[level] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._walk(token, start, self.n if end is None else min(end, self.n))
        return max(0, b - a)

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token; -1 if there are fewer."""
        if not 0 <= k < self.count(token):
            return -1
        at = self._walk(token, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, 1, at - self.zeros[level]) if bit else self._select(level, 0, at)
        return at

    def decode(self) -> np.ndarray:
        """All values, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level][:], count=self.n).view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            up[np.flatnonzero(bit)] = now[self.zeros[level] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = up
        return now


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file: magic, length of the header, JSON header, then zstd blocks.

    The first three blocks are the documents' null marks, ids and lengths. Then comes each level's rank
    directory, and each level's plane in blocks of BLOCK_BYTES; the header has every block's size, so
    a lookup reads the directories and inflates just the blocks that it passes.
    """
    codec = pa.Codec("zstd")
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes = build_planes(ids.astype(np.uint16) if levels <= 16 else ids, levels)
    raw = [np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<i8").tobytes()]
    raw += [rank_directory(p, len(ids)).astype("<u4").tobytes() for p in planes]
    raw += [p[a : a + BLOCK_BYTES].tobytes() for p in planes for a in range(0, len(p), BLOCK_BYTES)]
    blocks = [codec.compress(r, asbytes=True) for r in raw]
    head = {"documents": len(doc_ids), "ids": len(ids), "levels": levels, "rank_step": RANK_STEP, "block_bytes": BLOCK_BYTES, "blocks": [[len(r), len(b)] for r, b in zip(raw, blocks, strict=True)]}
    text = json.dumps(head).encode()
    return MAGIC + struct.pack("<I", len(text)) + text + b"".join(blocks)


class BlockedPlane:
    """A plane in compressed blocks of a file; slices inflate the blocks that they touch."""

    def __init__(self, load, size: int, block: int):
        """load: gives a block by its number; size: bytes of the plane; block: bytes of a block."""
        self.load, self.size, self.block = load, size, block

    def __getitem__(self, at: slice) -> np.ndarray:
        a, b, _ = at.indices(self.size)
        if a >= b:
            return np.zeros(0, np.uint8)
        first, last = a // self.block, (b - 1) // self.block
        parts = [self.load(k) for k in range(first, last + 1)]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[a - first * self.block : b - first * self.block]


class Shard:
    """An open shard file: ``doc_ids``, ``lengths`` and ``matrix``, whose planes are inflated block by block as lookups pass them."""

    def __init__(self, file, kept: int = KEPT_BLOCKS):
        """file: seekable, opened for reading; kept: inflated blocks that stay in memory."""
        self.file, self.codec, self.read_blocks = file, pa.Codec("zstd"), 0
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<I", self._at(len(MAGIC), 4))
        self.head = json.loads(self._at(len(MAGIC) + 4, n))
        if self.head["rank_step"] != RANK_STEP:
            raise ValueError("ranks of another step")
        self.sizes = self.head["blocks"]
        self.starts = (len(MAGIC) + 4 + n + np.cumsum([0, *(packed for _, packed in self.sizes)])).tolist()
        self.block = functools.lru_cache(kept)(self._block)
        null, docs = np.frombuffer(self._raw(0), np.uint8), np.frombuffer(self._raw(1), "<i8").tolist()
        self.doc_ids = [None if z else d for z, d in zip(null, docs, strict=True)]
        self.lengths = np.frombuffer(self._raw(2), "<i8")
        levels, ids, wide = self.head["levels"], self.head["ids"], self.head["block_bytes"]
        size = -(-ids // 8)
        each = -(-size // wide)
        ranks = [np.frombuffer(self._raw(3 + k), "<u4").astype(np.int64) for k in range(levels)]
        planes = [BlockedPlane(functools.partial(self._of, 3 + levels + k * each), size, wide) for k in range(levels)]
        self.matrix = WaveletMatrix(planes, ranks, ids)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def _raw(self, k: int) -> bytes:
        size, packed = self.sizes[k]
        return self.codec.decompress(self._at(self.starts[k], packed), size, asbytes=True) if size else b""

    def _block(self, k: int) -> np.ndarray:
        self.read_blocks += 1
        return np.frombuffer(self._raw(k), np.uint8)

    def _of(self, first: int, k: int) -> np.ndarray:
        return self.block(first + k)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, append ``end_id`` to each, and write shards in ascending order of the ids.

    The texts are dealt out by ranges of the id and each task writes the shards of its range; a shard
    is written under a temporary name and then renamed, and the manifest names only files of tasks
    that succeeded. The result is the manifest: path, part, shard, documents, ids. Null texts count
    as empty; null ids come first; rows that repeat an id stay, ordered by a hash of the text. Very long texts
    are documents like others. An empty table writes no shard.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # very many rows of one id are dealt over several tasks
    rows = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        run, shard, held, parts, size = uuid.uuid4().hex, 0, [], [], 0

        def close():
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            name = f"{path}/part-{part:06d}-{shard:05d}-{run}"
            data = shard_bytes(held, lengths, np.frombuffer(b"".join(parts), "<u4"))
            with fs.open_output_stream(f"{name}.tmp", compression=None) as f:
                f.write(data)
            fs.move(f"{name}.tmp", f"{name}.wm")
            return pd.DataFrame({"path": [f"{folder}/{name.rpartition('/')[2]}.wm"], "part": [part], "shard": [shard], "documents": [len(held)], "ids": [int(lengths.sum())]})

        for b in batches:
            texts, own = b["text"].tolist(), b["doc_id"]
            own = [None if pd.isna(d) else int(d) for d in own]
            for a in range(0, len(texts), BATCH_TEXTS):
                for d, ids in zip(own[a : a + BATCH_TEXTS], enc.encode(texts[a : a + BATCH_TEXTS]), strict=True):
                    held.append(d)
                    parts.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard_ids:
                        yield close()
                        shard, held, parts, size = shard + 1, [], [], 0
        if held:
            yield close()

    return materialize(rows.mapInPandas(write, "path string, part long, shard long, documents long, ids long"), "token-manifest", TEXT_ROWS)


def count_token(manifest: DataFrame, token: int) -> DataFrame:
    """path, occurrences of a token in each shard of a manifest, by rank alone: no shard is decoded."""

    def count(batches):
        for b in batches:
            found = []
            for path in b["path"]:
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    found.append(Shard(f).matrix.count(token))
            yield pd.DataFrame({"path": b["path"], "occurrences": found})

    return manifest.select("path").repartition(shuffle_parts(manifest.sparkSession)).mapInPandas(count, "path string, occurrences long")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards of a manifest."""
    spark = manifest.sparkSession
    parts = {r.part: r.n for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(parts):
        starts.append((p, total))
        total += parts[p]
    from pyspark.sql import Window

    before = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spark.createDataFrame(starts, "part long, base long")
    files = manifest.withColumn("before", before).join(F.broadcast(offsets), "part").select("path", (F.col("base") + F.col("before")).alias("start"))

    def read(batches):
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    shard = Shard(f, kept=0)  # every block is passed once
                    docs, lengths, ids = shard.doc_ids, shard.lengths, shard.matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[(e - n) * 4 : e * 4]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    return files.repartition(shuffle_parts(spark)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
