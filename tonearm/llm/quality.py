"""A quality classifier: Naive Bayes support vectors on n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .grams import char_grams, mix, span_hashes, text_codes, word_spans

#: log2 of the number of feature buckets.
BITS = 16
#: Character n-grams of these lengths are features, besides 1- and 2-grams of word shapes.
CHAR_GRAMS = (1, 2, 3)

_CLASS = np.zeros(256, np.uint64)
for _name, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256)), 1):
    _CLASS[list(_bytes)] = _name


def _shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word shapes and pairs of them, and how many each text has.

    A shape is the kind of the first and second byte, the kind or sign of the last, and whether the
    word repeats the one before.
    """
    data, starts, ends, n = word_spans(texts)
    h = span_hashes(data, starts, ends)
    first, last, second = data[starts], data[ends - 1], data[np.minimum(starts + 1, ends - 1)]
    sign = np.where(_CLASS[last] > 0, _CLASS[last], last.astype(np.uint64) + np.uint64(8))
    heads = (np.cumsum(n) - n)[n > 0]  # a text's first word follows none
    twice = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
    twice[heads] = False
    shape = _CLASS[first] | _CLASS[second] << np.uint64(4) | sign << np.uint64(8) | twice.astype(np.uint64) << np.uint64(20)
    one = mix(shape + np.uint64(1 << 32))
    before = np.concatenate((shape[:1], shape[:-1]))
    before[heads] = shape[heads]
    two = mix(before * np.uint64(1 << 24) + shape + np.uint64(1 << 60)) if len(h) else one
    top = np.uint64(64 - BITS)
    return np.stack(((one >> top), (two >> top)), axis=1).astype(np.int64).ravel(), 2 * n


def indicators(texts: list[str]) -> list[np.ndarray]:
    """The buckets of the n-grams that each whole text holds, each once, ascending."""
    out, seen = [], np.zeros(1 << BITS, bool)
    for _, part in chunks(texts):
        codes, sizes = text_codes(part)
        grams = [char_grams(codes, n, BITS) for n in CHAR_GRAMS]
        shapes, many = _shapes(part)
        at = s_at = 0
        for size, m in zip(sizes.tolist(), many.tolist(), strict=True):
            for n, g in zip(CHAR_GRAMS, grams, strict=True):
                if size >= n:
                    seen[g[at : at + size - n + 1]] = True
            seen[shapes[s_at : s_at + m]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            out.append(found.astype(np.int32))
            at, s_at = at + size, s_at + m
    return out


@dataclass
class SupportVectors:
    """weights: of the scaled indicators, already times the log-count ratios; ratios: those; scale, shift: from a margin to log-odds."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, x in enumerate(rows):
            if len(x):
                norm = np.sqrt((self.ratios[x] ** 2).sum())
                out[i] += self.weights[x].sum() / norm if norm else 0.0
        return out

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(rows) + self.shift, -40, 40)))


@dataclass(frozen=True)
class Training:
    """per_class: most labelled rows of a class that the model is fitted on, chosen by a hash of the
    id; smoothing: added to counts; cost: upper bound of the dual variables; blend: of the weights with
    their mean size; epochs: passes of coordinate descent; held: share of the rows for calibration."""

    per_class: int = 2000
    smoothing: float = 1.0
    cost: float = 10.0
    blend: float = 0.9
    epochs: int = 20
    held: float = 0.25
    seed: int = 5


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model: one dual variable at a time, in [0, cost]."""
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of the logistic curve through labelled margins, by Newton steps with a small prior."""
    a, b = 2.0, 0.0
    target = np.where(y > 0, 0.98, 0.02)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - target)
        h = np.maximum(weight * p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * (a - 2), g.sum() + 1e-3 * b])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 0.1), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, t: Training = Training()) -> SupportVectors:
    """The model of indicator rows and 0/1 labels; prior: share of label 1 among all labelled rows.

    Without rows of both classes it gives every text that share (a half without any).
    """
    dims = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(labels.tolist())) < 2:
        return SupportVectors(np.zeros(1), np.zeros(1), constant=prior)
    held = np.random.Generator(np.random.PCG64(t.seed)).random(len(rows)) < t.held
    if min((y[~held] > 0).sum(), (y[~held] < 0).sum(), (y[held] > 0).sum(), (y[held] < 0).sum()) < 2:
        held[:] = False

    def train(at: np.ndarray) -> SupportVectors:
        count = {s: np.full(dims, t.smoothing) for s in (1.0, -1.0)}
        for i in at:
            count[y[i]][rows[i]] += 1
        ratios = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
        own = [rows[i] for i in at]
        values = [(v := ratios[x]) / max(np.sqrt((v * v).sum()), 1e-12) for x in own]
        share = (y[at] > 0).mean()
        cost = t.cost * np.where(y[at] > 0, 0.5 / share, 0.5 / (1 - share))
        w, bias = dual_descent(own, values, y[at], dims, cost, t.epochs, t.seed)
        w = t.blend * w + (1 - t.blend) * np.abs(w).mean()
        return SupportVectors((w * ratios).astype(np.float64), ratios, bias)

    model = train(np.flatnonzero(~held))
    at = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    share = (y[at] > 0).mean()
    weight = np.where(y[at] > 0, prior / share, (1 - prior) / (1 - share))
    model.scale, model.shift = platt(model.margins([rows[i] for i in at]), y[at], weight)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, t: Training) -> tuple[DataFrame, float]:
    """(doc_id, features, label, place) of at most about ``per_class`` rows of each class, and the share of label 1 of all; features: 32-bit little-endian buckets.

    Ids are chosen by a hash, and rows in its order where there are more than twice as many. Labels other than 0 and 1 and null
    ids are left out; an id with both labels counts as 1; each row of an id is an example of its label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for label, many in n.items():
        rate = F.when(F.col("label") == label, float(min(1.0, t.per_class / many))).otherwise(rate)
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    part = F.pmod(hashed, F.lit(1 << 30)) < rate * (1 << 30)
    chosen = known.where(part).orderBy(hashed, "doc_id").limit(4 * t.per_class)  # so many rows at most, so the broadcast is small

    @F.pandas_udf("binary")  # a list of numbers would be ten times as large in the driver
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([x.astype("<i4").tobytes() for x in indicators([t or "" for t in text])], dtype="object")

    rows = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "label", F.xxhash64("doc_id", "text").alias("place"), features(F.col("text")).alias("features"))
    return rows.orderBy("place", "doc_id", "label", "features").limit(4 * t.per_class), (n.get(1, 0) / sum(n.values()) if n else 0.5)


def train_classifier(docs: DataFrame, labels: DataFrame, learn: Column, t: Training = Training()) -> SupportVectors:
    """The model of docs (doc_id, text) and labels (doc_id, label); learn: condition on doc_id of the rows to learn from.

    Rows that repeat an id are examples each, whatever their texts; null texts are empty. Without labelled rows, as of
    an empty table, the model gives every text a half; with one label only, that label's share. The same rows give the same
    model in any layout.
    """
    small_batches(docs.sparkSession)
    sample, prior = labelled_sample(docs, labels, learn, t)
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.place))
    return fit([np.frombuffer(r.features, "<i4") for r in rows], np.array([r.label for r in rows]), prior, t)


def score_documents(docs: DataFrame, model: SupportVectors, text_col: str = "text", score: str = "score") -> DataFrame:
    """All rows and columns with ``score``, the probability of label 1 of each whole text; null texts count as empty."""

    small_batches(docs.sparkSession)
    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities(indicators([t or "" for t in text])), dtype="float64")

    return docs.withColumn(score, of(F.col(text_col)))
