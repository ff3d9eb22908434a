"""Packing documents into training sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, materialize, shuffle_parts, small_batches
from .hilbert import cells_of, hilbert_keys
from .tokens import KEPT_WORDS, encoder

#: Texts that are encoded at a time.
BATCH_TEXTS = 512
#: Bits of a Hilbert key by whose cells ids are counted to cut the curve.
CELL_BITS = 16


@dataclass(frozen=True)
class Curve:
    """dims: that hashed document vectors are projected to; bits: of a coordinate of the curve's cells."""

    dims: int = 5
    bits: int = 10
    seed: int = 23


def project(ids: np.ndarray, lengths: np.ndarray, curve: Curve) -> np.ndarray:
    """Mean random direction of the hashed ids of each document: its hashed vector, projected (documents, dims)."""
    table = np.random.Generator(np.random.PCG64(curve.seed)).normal(size=(curve.dims, 1 << 16)).astype(np.float32)
    hashed = (ids * np.uint32(0x9E3779B1)) >> np.uint32(16)
    starts = np.cumsum(lengths) - lengths
    out = np.empty((len(lengths), curve.dims))
    for d in range(curve.dims):
        out[:, d] = np.add.reduceat(table[d][hashed], starts)
    return out / lengths[:, None]


def power_pieces(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, curve: Curve = Curve(), id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, ids (16- or 32-bit little-endian, with the end id), wide, n, place: written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path, kept_words)
        for b in batches:
            for at in range(0, len(b), BATCH_TEXTS):
                part = b.iloc[at : at + BATCH_TEXTS]
                held = [x + end for x in enc.encode(part["text"].tolist())]
                lengths = np.array([len(x) // 4 for x in held], np.int64)
                ids = np.frombuffer(b"".join(held), "<u4")
                wide = bool(ids.max() > 0xFFFF)
                kept = held if wide else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in held]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": kept, "wide": wide, "n": lengths, "place": list(project(ids, lengths, curve))})

    return materialize(rows.mapInPandas(run, "doc_id long, ids binary, wide boolean, n long, place array<double>"), "pack-ids", TEXT_ROWS)


def _with_part(keyed: DataFrame, curve: Curve, parts: int) -> DataFrame:
    """Rows of (key, n, h, doc_id) with the ``part`` of the curve that they are in, by the sums of ids in its cells.

    A row a cell, 2**CELL_BITS at most, is ordered in one task and broadcast.
    """
    cell = F.shiftrightunsigned("key", max(0, curve.dims * curve.bits - CELL_BITS)).cast("int")
    sums = keyed.groupBy(cell.alias("cell")).agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums.withColumns({"before": before, "total": F.sum("held").over(Window.partitionBy())}), "pack-cells")
    spot = (F.xxhash64("h", "doc_id").cast("double") + 2.0**63) / 2.0**64
    part = F.least(F.floor((F.col("before") + F.col("held") * spot) * parts / F.col("total")), F.lit(parts - 1))
    return keyed.withColumn("cell", cell).join(F.broadcast(sums), "cell").withColumn("part", part.cast("int"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, curve: Curve = Curve(), id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wished, ids; kept_words bounds the
    words whose ids a Python process keeps.

    Documents are placed by their hashed token vector, projected to few dimensions and scaled by the
    mean and deviation over all documents, and range-sorted by the Hilbert key of the place; ranges hold about
    equally many ids, not documents, and a cell of the curve with more than that is cut by a hash. Each
    range lays its documents one after another along the curve and cuts them every ``length`` ids; what is left at
    its end goes to sequences whose lengths are powers of two, which need no padding. So nothing is padded, each id is
    in one piece, and ids of documents next to each other in a sequence are alike. Null and empty
    texts are just the end id; null ids stay null; rows that repeat are documents of their own. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    ids = tokenize(docs, tokenizer_path, end_id, curve, id_col, text_col, kept_words)
    place = [F.element_at("place", d + 1) for d in range(curve.dims)]
    stats = ids.agg(*[F.avg(p).alias(f"m{d}") for d, p in enumerate(place)], *[F.stddev_pop(p).alias(f"s{d}") for d, p in enumerate(place)]).first()
    mean = np.array([stats[f"m{d}"] or 0.0 for d in range(curve.dims)])
    dev = np.array([max(stats[f"s{d}"] or 0.0, 1e-12) for d in range(curve.dims)])

    @F.pandas_udf("long")
    def key(place: pd.Series) -> pd.Series:
        if not len(place):
            return pd.Series([], dtype="int64")
        z = np.clip((np.stack(place.to_numpy()) - mean) / dev, -30, 30)
        return pd.Series(hilbert_keys(cells_of(1 / (1 + np.exp(-1.702 * z)), curve.bits), curve.bits))

    keyed = ids.select("doc_id", "ids", "wide", "n", key("place").alias("key"), F.xxhash64("ids").alias("h"))
    parts = shuffle_parts(spark)
    placed = _with_part(keyed, curve, parts).select("doc_id", "ids", "wide", "key", "h", "part")
    sorted_rows = placed.repartitionById(parts, "part").sortWithinPartitions("part", "key", "h", F.col("doc_id").asc_nulls_first())
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if keep_ids else "")

    def run(batches):
        base, sequence, held, filled = 0, 0, [], 0

        def close(lengths: list[int]):
            """Pieces of the held documents' parts, cut to sequences of these lengths."""
            nonlocal sequence
            out, todo = [], list(held)
            for size in lengths:
                at = 0
                while at < size:
                    doc, start, total, raw = todo[0]
                    n = min(len(raw), size - at)
                    out.append((doc, start, n, zlib.crc32(raw[:n].tobytes()), total, base + sequence, at, raw[:n].tolist() if keep_ids else None))
                    at += n
                    todo[0] = (doc, start + n, total, raw[n:])
                    if n == len(raw):
                        todo.pop(0)
                sequence += 1
            held[:] = todo
            return out

        rows = []
        for b in batches:
            base = int(b["part"].iloc[0]) << 40 if len(b) else base  # a task has one part
            for doc, data, wide in zip(b["doc_id"], b["ids"], b["wide"], strict=True):
                raw = np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4")
                held.append((None if pd.isna(doc) else int(doc), 0, len(raw), raw))
                filled += len(raw)
                if filled >= length:
                    rows += close([length] * (filled // length))
                    filled %= length
                if len(rows) >= 20_000:
                    yield _frame(rows, keep_ids)
                    rows = []
        rows += close(power_pieces(filled))
        if rows:
            yield _frame(rows, keep_ids)

    return sorted_rows.mapInPandas(run, columns)


def _frame(rows: list[tuple], keep_ids: bool) -> pd.DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    out = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    return out if keep_ids else out.drop(columns="ids")
