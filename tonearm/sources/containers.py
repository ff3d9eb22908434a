"""Tags of audio files as rows, from the bytes that hold them: FLAC and Vorbis comments, ID3v2, APEv2, MP4 boxes, and chunks of IFF and RIFF files.

Files come as ``binaryFile`` rows or any table with a column of bytes; only a file's tag bytes are looked at, and pictures
are stepped over. A reader yields what it finds before the first damaged place.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text encodings of ID3v2 frames.
ID3_TEXT = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
Pairs = Iterator[tuple[str, str]]


def _fits(data: bytes, at: int, n: int) -> bool:
    return 0 <= at and 0 <= n and at + n <= len(data)


def vorbis_comments(data: bytes, at: int = 0) -> Pairs:
    """Fields of a Vorbis comment: a vendor, then counted ``NAME=value`` entries; names in upper case."""
    if not _fits(data, at, 4):
        return
    at += 4 + struct.unpack_from("<I", data, at)[0]
    if not _fits(data, at, 4):
        return
    (count,), at = struct.unpack_from("<I", data, at), at + 4
    for _ in range(count):
        if not _fits(data, at, 4) or not _fits(data, at + 4, n := struct.unpack_from("<I", data, at)[0]):
            return
        name, eq, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        at += 4 + n
        if eq:
            yield name.upper(), value


def flac_blocks(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, start, length) of the metadata blocks of a FLAC file, one behind an ID3v2 tag too."""
    start = id3_size(data)
    if data[start : start + 4] != b"fLaC":
        return
    at, last = start + 4, False
    while not last and _fits(data, at, 4):
        head = struct.unpack_from(">I", data, at)[0]
        last, kind, n = bool(head >> 31), head >> 24 & 0x7F, head & 0xFFFFFF
        if not _fits(data, at + 4, n):
            return
        yield kind, at + 4, n
        at += 4 + n


def _syncsafe(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * (3 - i) for i, x in enumerate(b))


def id3_size(data: bytes, at: int = 0) -> int:
    """Bytes of the ID3v2 tag at a place; 0 without one."""
    return 10 + _syncsafe(data[at + 6 : at + 10]) if data[at : at + 3] == b"ID3" and _fits(data, at, 10) else 0


def id3_frames(data: bytes, at: int = 0) -> Pairs:
    """Text frames of an ID3v2.3 or 2.4 tag: the frame's name, or the description of a TXXX frame in upper case; several values are several fields.

    A person is a field ``IPLS:role``, a comment COMM, an identifier ``UFID:owner``.
    """
    end = at + id3_size(data, at)
    if end == at or end > len(data) or data[at + 3] not in (3, 4):
        return
    size_of = _syncsafe if data[at + 3] == 4 else lambda b: int.from_bytes(b, "big")
    extended = data[at + 5] & 0x40
    at += 10
    if extended and _fits(data, at, 4):
        at += size_of(data[at : at + 4])
    while at + 10 <= end and data[at]:
        name, n = data[at : at + 4].decode("latin-1"), size_of(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + n]
        if at + 10 + n > end:
            return
        at += 10 + n
        if name == "UFID":
            owner, zero, value = body.partition(b"\0")
            if zero:
                yield f"UFID:{owner.decode('latin-1')}", value.decode("utf-8", "replace")
            continue
        if name == "COMM" and len(body) > 4 and body[0] in ID3_TEXT:
            said = body[4:].decode(ID3_TEXT[body[0]], "replace").split("\x00")
            yield name, said[-1].lstrip("\ufeff")
            continue
        if name in ("IPLS", "TIPL", "TMCL") and body and body[0] in ID3_TEXT:
            said = [v.lstrip("\ufeff") for v in body[1:].decode(ID3_TEXT[body[0]], "replace").split("\x00")]
            yield from ((f"IPLS:{role}", person) for role, person in zip(said[0::2], said[1::2], strict=False))
            continue
        if name[0] != "T" or not body or body[0] not in ID3_TEXT:
            continue
        values = body[1:].decode(ID3_TEXT[body[0]], "replace").split("\x00")
        if name == "TXXX":
            name, *values = values[0].upper(), *values[1:]
        yield from ((name, v.lstrip("﻿")) for v in values if v)


def ape_items(data: bytes) -> Pairs:
    """Text items of an APEv2 tag at the end of a file, before an ID3v1 tag if there is one."""
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    if data[end - 32 : end - 24] != b"APETAGEX":
        return
    size, count = struct.unpack_from("<II", data, end - 20)
    at = end - size
    for _ in range(count if at >= 0 else 0):
        if at + 8 > end - 32:
            return
        n, flags = struct.unpack_from("<II", data, at)
        zero = data.find(b"\x00", at + 8, end)
        if zero < 0 or zero + 1 + n > end - 32:
            return
        if not flags >> 1 & 3:  # text, not binary
            for value in data[zero + 1 : zero + 1 + n].decode("utf-8", "replace").split("\x00"):
                yield data[at + 8 : zero].decode("latin-1").upper(), value
        at = zero + 1 + n


def chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(name, start, length) of the chunks of a RIFF/WAVE, AIFF or DSDIFF file."""
    kind = data[:4]
    little, wide = kind == b"RIFF", kind == b"FRM8"
    if kind not in (b"RIFF", b"FORM", b"FRM8"):
        return
    at, head = (16, 12) if wide else (12, 8)
    while _fits(data, at, head):
        n = int.from_bytes(data[at + 4 : at + head], "little" if little else "big")
        yield data[at : at + 4].decode("latin-1"), at + head, min(n, len(data) - at - head)
        at += head + n + (n & 1)


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, start of the content, end) of the boxes of an MP4 file between two places, up to the first damaged one."""
    while at + 8 <= end:
        n, head = int.from_bytes(data[at : at + 4], "big"), 8
        kind = data[at + 4 : at + 8].decode("latin-1")
        if n == 1:
            if at + 16 > end:
                return
            n, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            return
        yield kind, at + head, at + n
        at += n


def _mp4_text(body: bytes) -> str | None:
    kind, body = int.from_bytes(body[1:4], "big"), body[8:]
    if kind == 1:
        return body.decode("utf-8", "replace")
    if kind == 2:
        return body.decode("utf-16-be", "replace")
    return str(int.from_bytes(body, "big")) if kind in (0, 21, 22) and len(body) <= 8 else None


def mp4_items(data: bytes) -> Pairs:
    """Items of moov/udta/meta/ilst: an atom's name or a free item's name in upper case; pictures, and free items of other owners, are none.

    Track and disc numbers are "number/total", without what is 0; a compilation's mark is 1 or nothing.
    """
    at, end = 0, len(data)
    for kind, skip in (("moov", 0), ("udta", 0), ("meta", 0), ("ilst", 4)):  # the list lies behind four bytes of meta
        found = next(((s, e) for k, s, e in boxes(data, at + skip, end) if k == kind), None)
        if not found:
            return
        at, end = found
    for name, s, e in boxes(data, at, end):
        inside = [(k, data[x:y]) for k, x, y in boxes(data, s, e)]
        values = [b for k, b in inside if k == "data" and len(b) >= 8]
        if name in ("trkn", "disk"):
            if values and len(values[0]) >= 14:
                number, total = (int.from_bytes(values[0][i : i + 2], "big") for i in (10, 12))
                if number or total:
                    yield name, (str(number) if number else "") + (f"/{total}" if total else "")
        elif name == "cpil":
            if values and len(values[0]) >= 9 and values[0][8]:
                yield name, "1"
        elif name != "covr":
            own = {k: b[4:].decode("utf-8", "replace") for k, b in reversed(inside) if k in ("name", "mean")}
            if name == "----" and own.get("mean") != "com.apple.iTunes":
                continue
            called = own.get("name", "").upper() if name == "----" else name
            for text in map(_mp4_text, values):
                yield from ((called, v) for v in (text or "").split("\x00") if v)


def tags_of(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The container and the fields of a file's bytes, in their order; an unknown container has no field."""
    if any(True for _ in flac_blocks(data)):
        return "flac", [p for kind, at, n in flac_blocks(data) if kind == 4 for p in vorbis_comments(data[at : at + n])]
    if data[:4] == b"DSD " and _fits(data, 20, 8):
        return "dsf", list(id3_frames(data, int.from_bytes(data[20:28], "little")))
    if data[4:8] == b"ftyp":
        return "mp4", list(mp4_items(data))
    found = {b"RIFF": "wav", b"FORM": "aiff", b"FRM8": "dff"}.get(data[:4])
    if found:
        return found, [p for name, at, _ in chunks(data) if name.strip().upper() == "ID3" for p in id3_frames(data, at)]
    if b"APETAGEX" in data[-192:]:
        return "ape", list(ape_items(data))
    return ("id3", list(id3_frames(data))) if id3_size(data) else ("unknown", [])


def tag_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, container, ord, field, value: the tags of every file; a null or unknown one has a row without a field."""

    @F.pandas_udf("struct<container: string, tags: array<struct<field: string, value: string>>>")
    def read(data: pd.Series) -> pd.DataFrame:
        found = [tags_of(bytes(d)) if d is not None else ("unknown", []) for d in data]
        return pd.DataFrame({"container": [c for c, _ in found], "tags": [[{"field": f, "value": v} for f, v in t] for _, t in found]})

    rows = files.select(key, read(F.col(content)).alias("t"))
    return rows.select(key, "t.container", F.posexplode_outer("t.tags").alias("ord", "tag")).select(key, "container", "ord", "tag.field", "tag.value")


def probed_stream(json: Column) -> dict[str, Column]:
    """codec, rate, channels, bits, seconds of a probe's JSON on the first audio stream; null without a rate and channels.

    Bits are the raw sample's if it has any, else the coded sample's, else 16.
    """
    stream = F.try_element_at(F.from_json(json, "streams ARRAY<STRUCT<codec_name: STRING, sample_rate: STRING, channels: STRING, bits_per_sample: STRING, bits_per_raw_sample: STRING, duration: STRING>>")["streams"], F.lit(1))
    n = lambda f: stream[f].try_cast("int")
    ok = (n("sample_rate") > 0) & (n("channels") > 0)
    bits = F.coalesce(F.when(n("bits_per_raw_sample") > 0, n("bits_per_raw_sample")), F.when(n("bits_per_sample") > 0, n("bits_per_sample")), F.lit(16))
    values = {"codec": F.coalesce(stream["codec_name"], F.lit("")), "rate": n("sample_rate"), "channels": n("channels"), "bits": bits, "seconds": stream["duration"].try_cast("double")}
    return {k: F.when(ok, v) for k, v in values.items()}
