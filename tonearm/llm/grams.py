"""Vectorised hashing of words, word n-grams and character n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes that end a word: blank, tab to carriage return.
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SEED = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_held: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held["up"]) < n:
        size = max(n, 1 << 19)
        _held["up"], _held["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _held["up"][:n], _held["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _SEED
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, the start and end of each word (runs without ASCII white space), and the words of each text; bytes are texts in UTF-8."""
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BREAK[data])).astype(np.int8)))  # starts and ends by turns
    starts, ends = edge[0::2], edge[1::2]
    upto = np.searchsorted(starts, np.cumsum(sizes))
    return data, starts, ends, np.diff(np.concatenate(([0], upto)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: polynomial hashes, from differences of one running sum over all bytes."""
    up, down = _tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words of each text."""
    data, starts, ends, n = word_spans(texts)
    return span_hashes(data, starts, ends), n


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words, and their number in each text.

    A text with fewer words, but any, has one run: all its words.
    """
    h, n = word_hashes(texts)
    return runs_of(h, n, words)


def runs_of(h: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes, from word hashes and their number in each text."""
    ends = np.cumsum(n)
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    if not len(h):
        return np.zeros(0, np.uint64), many
    padded = np.concatenate((h, np.zeros(words, np.uint64)))
    left = np.repeat(ends, n) - np.arange(len(h))  # words from here to the end of the text
    total = np.zeros(len(h), np.uint64)
    for k in range(words):
        part = padded[k : k + len(h)]
        total = total * np.uint64(0xFF51AFD7ED558CCD) + np.where(left > k, part, np.uint64(k + 1))
    keep = (left >= words) | (left == np.repeat(n, n))
    return mix(total[keep]), many


def text_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts joined, and the length of each."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.fromiter(map(len, texts), np.int64, len(texts))


def char_grams(codes: np.ndarray, n: int, dims_bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point; the last n - 1 positions have none."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(m, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + m]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h = (h + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - dims_bits)).astype(np.int64)
