"""Token ids of whole texts by a file of the tokenizers library, with the ids of known words kept."""

from __future__ import annotations

import contextlib
import os
import re

import numpy as np

#: Words whose ids a process keeps; about 200 bytes each. Others are encoded in each batch.
KEPT_WORDS = 1_000_000
#: New words that are encoded in one text.
WORDS_AT_A_TIME = 4096



#: White space other than blanks and newlines, as the tokenizer or as Python sees it.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _places(values: list, wanted, start: int) -> list[int]:
    """Where a value stands in a list, from a place on."""
    out = []
    with contextlib.suppress(ValueError):
        while True:
            out.append(start := values.index(wanted, start))
            start += 1
    return out


class BatchEncoder:
    """Encodes texts to the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    The byte-level pre-tokenizer of the file never lets a token cross a place where a single blank or
    a single newline stands between two words: a blank goes with the word after it and a newline is a
    piece of its own. So a text whose only white space is such blanks and newlines is encoded word by
    word, and a word seen before is looked up. Any other text is encoded whole. Whether a file cuts
    texts in this way is tried out on a few probes when it is loaded; otherwise all texts are encoded
    whole. A text that holds the string of an added token is encoded whole, as the library does by default.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # an added token that a normalised text may hold, or that white space is part of, can't be looked for in words
        self.plain_added = not any(re.search(r"\s", t.content) or (t.normalized and self.tokenizer.normalizer is not None) for t in added)
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.newline = self._whole(["\n"])[0]
        self.by_word = self.plain_added and self._cuts_at_blanks()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts_at_blanks(self) -> bool:
        if len(self.newline) != 4:
            return False
        for probe in ("ab, 12 c'd\nEf 's. x", "The end.\nof 7 à-b\n( c ) !"):
            parts = [self._whole([f" {w}" if i else w for i, w in enumerate(line.split(" "))]) for line in probe.split("\n")]
            if self.newline.join(b"".join(p) for p in parts) != self._whole([probe])[0]:
                return False
        return True

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word after what parts it from the text before: a blank, or its own newline.

        Many words are encoded in one text, a line each; a newline's id parts their ids.
        """
        if not words:
            return {}
        if len(words) > WORDS_AT_A_TIME:
            return {w: x for a in range(0, len(words), WORDS_AT_A_TIME) for w, x in self._encode_words(words[a : a + WORDS_AT_A_TIME]).items()}
        lines = [w[1:] if w[0] == "\n" else f" {w}" for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(["", *lines])], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0])
        if len(cut) != len(words):
            found = self._whole(lines)
        else:
            raw, starts, ends = ids.tobytes(), ((cut + 1) * 4).tolist(), (np.append(cut[1:], len(ids)) * 4).tolist()
            found = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return {w: self.newline + ids if w[0] == "\n" else ids for w, ids in zip(words, found, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        split, odd, new = [], [], set()
        known = self.known.get
        for i, t in enumerate(texts):
            if self.by_word and t and not any(a in t for a in self.added) and not _OTHER_SPACE.search(t):
                own = f" {t}".replace("\n", " \n").split(" ")
                parts = list(map(known, own))
                parts[:2] = None, b""  # the first word follows no blank
                missed = _places(parts, None, 2)
                words = [own[k] for k in missed]
                if not (own[1] == "" or "" in words or "\n" in words or own[1][0] == "\n"):
                    split.append((i, own[1], parts, missed, words))
                    new.update(words)
                    continue
            odd.append(i)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        found = self._encode_words(list(new))
        for (i, _, parts, missed, words), first in zip(split, self._whole([x[1] for x in split]), strict=True):
            for k, w in zip(missed, words, strict=True):
                parts[k] = found[w]
            parts[0] = first
            out[i] = b"".join(parts)
        for w in found if len(self.known) < self.kept else ():  # the words met first stay: frequent ones are among them
            self.known[w] = found[w]
        return out


_loaded: dict[tuple[str, int], BatchEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> BatchEncoder:
    """The process's encoder for a tokenizer file; tasks of one Python worker share it."""
    if (path, kept) not in _loaded:
        _loaded[path, kept] = BatchEncoder(path, kept)
    return _loaded[path, kept]
