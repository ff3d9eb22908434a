"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .grams import char_grams, text_codes

#: log2 of the number of n-gram buckets.
BITS = 16
GRAMS = (1, 2, 3)
#: The answer for texts without a letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Training:
    """per_language: most rows of a language that the weights are fitted on, chosen by a hash of the
    id (document frequencies are of all rows); alpha, beta, l1, l2: of the follow-the-regularised-
    leader steps; epochs: passes; held: share of the rows for the temperature."""

    per_language: int = 800
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002
    epochs: int = 3
    held: float = 0.25
    seed: int = 3


def gram_counts(texts: list[str]):
    """Of each whole text in lower case: its n-gram buckets, ascending, and how often each occurs."""
    for _, part in chunks(texts):
        low = [t.lower() for t in part]
        codes, sizes = text_codes(low)
        grams = [char_grams(codes, n, BITS) for n in GRAMS]
        at = 0
        for size in sizes.tolist():
            own = [g[at : at + size - n + 1] for n, g in zip(GRAMS, grams, strict=True) if size >= n]
            count = np.bincount(np.concatenate(own), minlength=1 << BITS) if own else np.zeros(1 << BITS, np.int64)
            found = np.flatnonzero(count)
            yield found, count[found]
            at += size


def tfidf(found: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of length one: one plus the log of the count, times the inverse document frequency."""
    v = (1 + np.log(count)) * idf[found]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


@dataclass
class LanguageModel:
    """weights: (buckets, languages); temperature: the logits are divided by it."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[found] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its calibrated probability; ties go to the first in order."""
        z = np.array([self.logits(f, tfidf(f, c, self.idf)) for f, c in gram_counts(texts)]).reshape(len(texts), -1) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        best = z.argmax(axis=1)
        return [self.languages[i] for i in best], p.max(axis=1) / p.sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], idf: np.ndarray, t: Training = Training()) -> LanguageModel:
    """Follow-the-regularised-leader with per-coordinate rates and an elastic-net penalty, then the temperature.

    rows: buckets and TF-IDF weights; labels: places in ``languages``.
    """
    k, dims = len(languages), len(idf)
    z, n = np.zeros((dims + 1, k)), np.zeros((dims + 1, k))

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= t.l1, 0.0, -(zi - np.sign(zi) * t.l1) / ((t.beta + np.sqrt(n[at])) / t.alpha + t.l2))

    rng = np.random.Generator(np.random.PCG64(t.seed))
    held = rng.random(len(rows)) < t.held if len(rows) >= 8 * k else np.zeros(len(rows), bool)
    for _ in range(t.epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, v = np.append(rows[i][0], dims), np.append(rows[i][1], 1.0)
            w = weights(at)
            logit = v @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = v[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / t.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    model = LanguageModel(languages, idf, w[:-1], w[-1])
    at = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    if len(at) and k > 1:
        logit = np.array([model.logits(*rows[i]) for i in at])
        model.temperature = temperature(logit, labels[at])
    return model


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in [0.05, 20] with the least log-loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and the number of texts: summed in each task, then by bucket."""

    def count(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for found, _ in gram_counts([t or "" for t in b["text"]]):
                df[found] += 1
                n += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(some, -1), "n": np.append(df[some], n)})

    out = np.zeros(1 << BITS, np.int64)
    found = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def train_languages(docs: DataFrame, learn: Column, t: Training = Training()) -> LanguageModel | None:
    """The model of (doc_id, text, lang) rows where ``learn`` holds and text and lang are not null; None if there are none, as of an empty table.

    Rows that repeat an id are examples each. The same rows give the same model in any layout.
    """
    small_batches(docs.sparkSession)
    known = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    languages = sorted(n)
    df, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + df)) + 1
    rate = F.element_at(F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, t.per_language / n[lang])))]), F.col("lang"))
    place = F.xxhash64("doc_id", "text", F.lit("sample"))
    part = F.pmod(place, F.lit(1 << 30)) < rate * (1 << 30)

    @F.pandas_udf("struct<found: binary, count: binary>")  # 32-bit little-endian: lists of numbers would be ten times as large in the driver
    def grams(text: pd.Series) -> pd.DataFrame:
        rows = [(f.astype("<i4").tobytes(), c.astype("<i4").tobytes()) for f, c in gram_counts(text.tolist())]
        return pd.DataFrame(rows, columns=["found", "count"], dtype="object")

    sample = known.where(part).select("doc_id", "lang", place.alias("place"), grams("text").alias("g")).orderBy("place", "doc_id", "lang", "g").limit(4 * t.per_language * len(languages))
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.lang, r.place))
    found = [np.frombuffer(r.g.found, "<i4") for r in rows]
    return fit([(f, tfidf(f, np.frombuffer(r.g["count"], "<i4"), idf)) for f, r in zip(found, rows, strict=True)], np.array([languages.index(r.lang) for r in rows]), languages, idf, t)


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``lang_score`` of each whole text.

    Texts that are null or have no letter, and all texts where nothing was learned, are ``und`` with
    score 0. Columns of these two names are replaced.
    """
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0)})

    @F.pandas_udf("struct<lang: string, score: double>")
    def of(text: pd.Series) -> pd.DataFrame:
        lang, score = model.predict([t or "" for t in text]) if len(text) else ([], [])
        return pd.DataFrame({"lang": pd.Series(lang, dtype="object"), "score": pd.Series(score, dtype="float64")})

    some = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    name = f"lang-{uuid.uuid4().hex}"  # no column of the table has this name
    got = docs.withColumn(name, of(F.col(text_col)))
    return got.withColumns({"lang_pred": F.when(some, F.col(f"`{name}`.lang")).otherwise(UNDETERMINED), "lang_score": F.when(some, F.col(f"`{name}`.score")).otherwise(0.0)}).drop(name)
