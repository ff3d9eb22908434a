"""Homomorphic multiset hashes of documents: sums of wide vectors hashed from paragraphs, modulo powers of two."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, materialize, shuffle_parts, small_batches
from .grams import runs_of, word_hashes

#: 64-bit lanes that tell paragraphs apart, modulo 2**64 each: together a 512-bit digest of the paragraph.
LANES = 8
#: 32-bit lanes that a paragraph's word runs are dealt over with a sign, modulo 2**32 each.
SKETCH = 192
#: Words of a run.
RUN = 3


def paragraph_vectors(paragraphs: list[str], owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the paragraphs of each of n owners: lanes (n, LANES) uint64 and sketch (n, SKETCH) int32.

    The lanes are the parts of the paragraph's 512-bit digest; a sketch is the
    signed counts of its word runs by bucket. Both are sums over paragraphs, so a paragraph is
    inserted by adding its vector and deleted by subtracting it, in any order.
    """
    raw = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * LANES).digest() for p in paragraphs)
    lanes = np.zeros((n, LANES), np.uint64)
    starts = np.flatnonzero(np.diff(np.concatenate(([-1], owner))))
    if len(starts):
        lanes[owner[starts]] = np.add.reduceat(np.frombuffer(raw, "<u8").reshape(-1, LANES), starts, axis=0)
    h, words = word_hashes(paragraphs)
    runs, many = runs_of(h, words, RUN)
    at = np.repeat(owner, many) * SKETCH + ((runs >> np.uint64(32)) % np.uint64(SKETCH)).astype(np.int64)
    sign = np.where(runs & np.uint64(1), 1.0, -1.0)
    sketch = np.bincount(at, sign, n * SKETCH).astype(np.int64).astype(np.uint32).view(np.int32)
    return lanes, sketch.reshape(n, SKETCH)


def vectors_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of whole texts; a paragraph is a line, and an empty text is one empty paragraph."""
    parts = [t.split("\n") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    return paragraph_vectors([p for own in parts for p in own], owner, len(texts))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 from two sketches: twice the estimated common word runs by those of both; 1 if equal."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    apart = (a - b).astype(np.float64)  # modulo 2**32, as the sums are
    return np.clip(1 - (apart * apart).sum(axis=1) / np.maximum(both, 1e-300), 0, 1)


def encode(lanes: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: the lanes' and the sketch's bytes, little-endian, in base64."""
    return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<i4").tobytes()).decode() for a, b in zip(lanes, sketch, strict=True)]


def decode(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [base64.b64decode(f) for f in fingerprints]
    return np.array([np.frombuffer(r[: 8 * LANES], "<u8") for r in raw]), np.array([np.frombuffer(r[8 * LANES :], "<i4") for r in raw])


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint with b's paragraphs inserted (sign 1) or deleted (-1)."""
    (la, lb), (sa, sb) = decode([a, b])
    return encode((la + lb if sign > 0 else la - lb)[None], (sa + sb if sign > 0 else sa - sb)[None])[0]


def _sketch_likeness(lanes: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((lanes == other).all(axis=1), 1.0, likeness(a, b))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the
    next document's, in ascending id, after the last the first. Rows are dealt out by ranges of the
    id, cut at quantiles; the first row of a range is also sent to the range before, so each task
    sees every successor and no order over all rows is gathered. Null texts are empty; null ids come
    first; rows that repeat an id are ordered by a hash of the text, and very many of them are dealt over several ranges. A table of one row follows itself; an
    empty table gives no rows. Equal texts have equal fingerprints, and near 1 to each other.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.lit(-(1 << 63)).cast("long")
    key = F.coalesce("doc_id", low)
    cuts = np.array(rows.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [] if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, h: pd.Series) -> pd.Series:
        """The range of a row; an id so frequent that it is several cuts (as null may be) is dealt over their ranges in order of the hash."""
        low, up = np.searchsorted(cuts, key.to_numpy()), np.searchsorted(cuts, key.to_numpy(), side="right")
        share = (h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series((low + np.minimum((share * (up - low + 1)).astype(np.int64), up - low)).astype(np.int32))

    h = F.xxhash64("text")
    rows = rows.select("doc_id", "text", range_of(key, h).alias("part"), h.alias("h"))
    order = F.struct(F.coalesce("doc_id", low).alias("key"), "h")
    heads = materialize(rows.groupBy("part").agg(F.min(order).alias("head")), "print-heads")  # a row a range
    line = Window.orderBy("part")
    to = F.coalesce(F.lag("part").over(line), F.max("part").over(Window.partitionBy()))
    heads = heads.select(F.col("part").alias("h_part"), F.col("head.key").alias("h_key"), F.col("head.h").alias("h_h"), to.alias("to"))
    # no row, or as many as ranges: as small as the number of partitions
    flagged = rows.join(F.broadcast(heads), (rows["part"] == heads["h_part"]) & (F.coalesce("doc_id", low) == heads["h_key"]) & (rows["h"] == heads["h_h"]), "left")
    sent = F.array(F.struct("part", F.lit(0).alias("extra")), F.struct(F.col("to").alias("part"), F.lit(1).alias("extra")))
    dealt = flagged.select(
        "doc_id", "text", "h", F.explode(F.when(F.col("to").isNull(), F.slice(sent, 1, 1)).otherwise(sent)).alias("s")
    ).select("doc_id", "text", "h", "s.part", "s.extra")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "h")

    def work(own: list, texts: list[str]) -> pd.DataFrame:
        """Rows of all texts but the last, which is the successor of the one before."""
        edited = [t[: len(t) - len(t) // 4] + s[: len(t) // 4] for t, s in zip(texts, texts[1:])]
        (lanes, sketch), (e_lanes, e_sketch) = vectors_of(texts), vectors_of(edited)
        return pd.DataFrame({
            "doc_id": pd.array(own, "Int64"), "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "fingerprint": encode(lanes[:-1], sketch[:-1]), "edited_fingerprint": encode(e_lanes, e_sketch),
            "near_edited": _sketch_likeness(lanes[:-1], e_lanes, sketch[:-1], e_sketch),
            "near_next": _sketch_likeness(lanes[:-1], lanes[1:], sketch[:-1], sketch[1:]),
        })

    def run(batches):
        own, texts, part, size, closed = [], [], None, 0, False
        for b in batches:
            for d, t, p, extra in zip(b["doc_id"], b["text"], b["part"], b["extra"], strict=True):
                if p != part:
                    own, texts, part, size, closed = [], [], p, 0, False
                if closed:
                    continue  # the successor is there already; equal rows may repeat it
                texts.append(t)
                size += len(t)
                if extra:
                    yield work(own, texts)
                    closed = True
                    continue
                own.append(None if pd.isna(d) else int(d))
                if size > CHUNK_CHARS and len(texts) > 1:
                    yield work(own[:-1], texts)
                    own, texts, size = own[-1:], texts[-1:], len(texts[-1])

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(run, out)
