"""A data source for the headers of media files: tags and places of pictures by ranged reads, never whole files.

    spark.dataSource.register(headers.MediaHeaders)
    spark.read.format("media_headers").option("pictures", "false").load("file:///music")
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import containers

#: Bytes of a picture block that are read for its description.
PICTURE_HEAD = 512


class Ranged:
    """A file read in ranges; ``count`` is the number of bytes read so far."""

    def __init__(self, file, size: int):
        self.file, self.size, self.count = file, size, 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n <= 0 or at >= self.size:
            return b""
        self.file.seek(at)
        data = self.file.read(min(n, self.size - at))
        self.count += len(data)
        return data


def _flac(f: Ranged, at: int, pictures: bool) -> Iterator[tuple]:
    at, last = at + 4, False
    while not last and len(head := f.read(at, 4)) == 4:
        word = struct.unpack(">I", head)[0]
        last, kind, n = bool(word >> 31), word >> 24 & 0x7F, word & 0xFFFFFF
        if at + 4 + n > f.size:
            return
        if kind == 4:
            yield from (("tag", name, value, None, None, None) for name, value in containers.vorbis_comments(f.read(at + 4, n)))
        elif kind == 6:
            data = f.read(at + 4, min(n, PICTURE_HEAD))
            try:
                mime = struct.unpack_from(">I", data, 4)[0]
                said = struct.unpack_from(">I", data, 8 + mime)[0]
                length = struct.unpack(">I", f.read(at + 4 + 28 + mime + said, 4))[0]
            except struct.error:
                return
            start = at + 4 + 32 + mime + said
            if start + length > at + 4 + n:
                return
            yield "picture", str(int.from_bytes(data[:4], "big")), data[8 : 8 + mime].decode("latin-1"), start, length, f.read(start, length) if pictures else None
        at += 4 + n


def _boxes(f: Ranged, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """As containers.boxes, by reading the boxes' heads alone."""
    while at + 8 <= end:
        head = f.read(at, 16)
        found = next(containers.boxes(head[:16] + bytes(16 - len(head)), 0, end - at), None)
        if not found:
            return
        yield head[4:8], at + found[1], at + found[2]
        at += found[2]


def _mp4(f: Ranged, pictures: bool) -> Iterator[tuple]:
    at, end = 0, f.size
    for name, skip in ((b"moov", 0), (b"udta", 0), (b"meta", 0), (b"ilst", 4)):
        found = next(((s, e) for k, s, e in _boxes(f, at + skip, end) if k == name), None)
        if not found:
            return
        at, end = found
    box = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    items, held = b"", []
    for name, s, e in _boxes(f, at, end):
        if name == b"covr":
            held += [("picture", "3", None, x + 8, y - x - 8, f.read(x + 8, y - x - 8) if pictures else None) for k, x, y in _boxes(f, s, e) if k == b"data" and y - x >= 8]
        else:
            items += box(name, f.read(s, e - s))
    small = box(b"moov", box(b"udta", box(b"meta", bytes(4) + box(b"ilst", items))))
    yield from (("tag", name, value, None, None, None) for name, value in containers.mp4_items(small))
    yield from held


def header_rows(f: Ranged, pictures: bool = False) -> tuple[str, list[tuple]]:
    """The container, and (kind, field, value, offset, length, data) of a file's tags and pictures, up to the first damaged place.

    A FLAC or MP4 file costs its tag blocks and heads of the others; of a file with an ID3v2 or APEv2 tag, or an ID3 chunk, the tag is read.
    """
    head = f.read(0, 12)
    at = containers.id3_size(head)
    tags = lambda pairs: [("tag", name, value, None, None, None) for name, value in pairs]
    if (head[:4] if not at else f.read(at, 4)) == b"fLaC":
        return "flac", list(_flac(f, at, pictures))
    if at:
        return "id3", tags(containers.id3_frames(f.read(0, at)))
    if head[4:8] == b"ftyp":
        return "mp4", list(_mp4(f, pictures))
    if head[:4] == b"DSD ":
        place = int.from_bytes(f.read(20, 8), "little")
        return "dsf", tags(containers.id3_frames(f.read(place, containers.id3_size(f.read(place, 10)))))
    kind = {b"RIFF": "wav", b"FORM": "aiff", b"FRM8": "dff"}.get(head[:4])
    if kind:
        little, (at, wide) = kind == "wav", (16, 12) if kind == "dff" else (12, 8)
        out: list[tuple] = []
        while len(h := f.read(at, wide)) == wide:
            n = int.from_bytes(h[4:], "little" if little else "big")
            if h[:4].strip().upper() == b"ID3":
                out += tags(containers.id3_frames(f.read(at + wide, n)))
            at += wide + n + (n & 1)
        return kind, out
    tail = f.read(f.size - 160, 160) if f.size > 160 else f.read(0, f.size)
    if b"APETAGEX" in tail:
        end = f.size - (128 if tail[-128:-125] == b"TAG" else 0)
        foot = f.read(end - 32, 32)
        size = struct.unpack_from("<I", foot, 12)[0] if foot[:8] == b"APETAGEX" else 0
        return "ape", tags(containers.ape_items(f.read(end - size, size)))
    return "unknown", []


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.pictures = options.get("pictures", "false").lower() == "true"
        self.files = int(options.get("filesperpartition", "256"))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def partitions(self) -> list[Files]:
        fs, path = self._open()
        info = fs.get_file_info(path)
        found = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file]
        found = sorted((i.path, i.size) for i in found)
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = self._open()
        for path, size in partition.paths:
            with fs.open_input_file(path) as file:
                ranged = Ranged(file, size)
                container, rows = header_rows(ranged, self.pictures)
                for n, row in enumerate(rows or [(None,) * 6]):
                    yield (path, container, None if row[0] is None else n, *row, ranged.count)


class MediaHeaders(DataSource):
    """path, container, ord, kind (tag, picture), field, value, offset, length, data, bytes_read: a row a tag or picture of each file below a
    folder; a file without any has one row. A picture's field is its type, its value the media type; data is null unless ``pictures`` is true. bytes_read is what the file cost.

    Options: ``pictures`` (false), ``filesPerPartition`` (256). Files are listed once, on the driver, by name and size alone.
    """

    @classmethod
    def name(cls) -> str:
        return "media_headers"

    def schema(self) -> str:
        return "path string, container string, ord int, kind string, field string, value string, offset long, length long, data binary, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)
