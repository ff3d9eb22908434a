"""Tag bytes: composed files of each kind, damaged ones, and rows."""

from __future__ import annotations

import struct

from tonearm.sources import containers


def vorbis(*entries: str) -> bytes:
    raw = [e.encode() for e in entries]
    return struct.pack("<I", 3) + b"abc" + struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(e)) + e for e in raw)


def flac(*blocks: tuple[int, bytes]) -> bytes:
    out = b"fLaC"
    for i, (kind, body) in enumerate(blocks):
        out += bytes([kind | (0x80 if i == len(blocks) - 1 else 0)]) + len(body).to_bytes(3, "big") + body
    return out


def id3(version: int, *frames: tuple[bytes, bytes]) -> bytes:
    size = lambda n: bytes(n >> 7 * k & 127 for k in (3, 2, 1, 0)) if version == 4 else n.to_bytes(4, "big")
    body = b"".join(name + size(len(b)) + b"\0\0" + b for name, b in frames) + bytes(20)
    n = len(body)
    return b"ID3" + bytes([version, 0, 0]) + bytes(n >> 7 * k & 127 for k in (3, 2, 1, 0)) + body


def ape(*items: tuple[bytes, bytes, int]) -> bytes:
    body = b"".join(struct.pack("<II", len(v), flags) + k + b"\0" + v for k, v, flags in items)
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + bytes(8)


TAG = id3(3, (b"TIT2", b"\x03Song"), (b"APIC", b"\0\1\2"), (b"TXXX", b"\x01" + "Mood\0sad\0blue".encode("utf-16")), (b"TPE1", b"\0A\0B"))
FIELDS = [("TIT2", "Song"), ("MOOD", "sad"), ("MOOD", "blue"), ("TPE1", "A"), ("TPE1", "B")]


def test_containers(spark):
    files = {
        "flac": (flac((0, bytes(34)), (6, b"picture"), (4, vorbis("Title=é = x", "artist=A", "artist=B", "broken"))) + b"sound", ("flac", [("TITLE", "é = x"), ("ARTIST", "A"), ("ARTIST", "B")])),
        "flac behind a tag": (TAG + flac((4, vorbis("A=b"))), ("flac", [("A", "b")])),
        "id3": (TAG + b"\xff\xfb", ("id3", FIELDS)),
        "id3 2.4": (id3(4, (b"TALB", b"\x03" + b"x" * 200), (b"TCON", b"\x02" + "Pop".encode("utf-16-be"))), ("id3", [("TALB", "x" * 200), ("TCON", "Pop")])),
        "wav": (b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 3) + b"abc\0" + b"id3 " + struct.pack("<I", len(TAG)) + TAG, ("wav", FIELDS)),
        "aiff": (b"FORM\0\0\0\0AIFF" + b"ID3 " + struct.pack(">I", len(TAG)) + TAG, ("aiff", FIELDS)),
        "dff": (b"FRM8" + bytes(8) + b"DSD " + b"ID3 " + struct.pack(">Q", len(TAG)) + TAG, ("dff", FIELDS)),
        "dsf": (b"DSD " + struct.pack("<QQQ", 28, 0, 28) + TAG, ("dsf", FIELDS)),
        "ape": (b"MAC " + ape((b"Title", b"a\0b", 0), (b"Cover", b"\1", 2)), ("ape", [("TITLE", "a"), ("TITLE", "b")])),
        "ape before an old tag": (ape((b"Year", b"1984", 0)) + b"TAG" + bytes(125), ("ape", [("YEAR", "1984")])),
        "unknown": (b"plain bytes", ("unknown", [])), "empty": (b"", ("unknown", [])),
    }
    for name, (data, want) in files.items():
        assert containers.tags_of(data) == want, name
        for cut in range(0, len(data), 7):  # damaged files give what comes before the damage, and no error
            kind, found = containers.tags_of(data[:cut])
            assert kind == "unknown" or found == want[1][: len(found)] or kind != want[0], (name, cut)
    rows = spark.createDataFrame([(k, bytearray(d)) for k, (d, _) in files.items()] + [("null", None)], "path string, content binary")
    got = containers.tag_rows(rows).collect()
    for name, (_, (kind, fields)) in files.items():
        own = sorted((r for r in got if r.path == name), key=lambda r: (r.ord is not None, r.ord))
        assert {r.container for r in own} == {kind} and [(r.field, r.value) for r in own] == (fields or [(None, None)])
    assert [(r.container, r.field) for r in got if r.path == "null"] == [("unknown", None)]


def box(name: bytes, body: bytes, wide: bool = False) -> bytes:
    return (b"\0\0\0\1" + name + struct.pack(">Q", len(body) + 16) if wide else struct.pack(">I", len(body) + 8) + name) + body


def item(kind: int, body: bytes) -> bytes:
    return box(b"data", struct.pack(">II", kind, 0) + body)


def free(mean: bytes, name: bytes, body: bytes) -> bytes:
    return box(b"----", box(b"mean", bytes(4) + mean) + box(b"name", bytes(4) + name) + body)


def test_mp4_boxes():
    items = [
        box(b"\xa9nam", item(1, "Sóng\0two".encode())), box(b"\xa9gen", item(2, "Pöp".encode("utf-16-be"))), box(b"trkn", item(0, bytes([0, 0, 0, 3, 0, 12, 0, 0]))), box(b"disk", item(0, bytes([0, 0, 0, 0, 0, 2]))),
        box(b"cpil", item(21, b"\1")), box(b"covr", item(13, b"picture")), free(b"com.apple.iTunes", b"ISRC", item(1, b"X")), free(b"else", b"ISRC", item(1, b"Y")), box(b"tmpo", item(21, b"\0\x78")), box(b"bad ", item(99, b"?")), box(b"\xa9day", b""),
    ]
    want = [("©nam", "Sóng"), ("©nam", "two"), ("©gen", "Pöp"), ("trkn", "3/12"), ("disk", "/2"), ("cpil", "1"), ("ISRC", "X"), ("tmpo", "120")]
    for wide in (False, True):
        ilst = box(b"ilst", b"".join(items), wide)
        data = box(b"ftyp", b"M4A ") + box(b"mdat", bytes(50), wide) + box(b"moov", box(b"trak", bytes(9)) + box(b"udta", box(b"meta", bytes(4) + box(b"hdlr", b"x") + ilst), wide))
        assert containers.tags_of(data) == ("mp4", want)
        for cut in range(len(data)):  # a damaged box and what follows it are not read
            kind, found = containers.tags_of(data[:cut])
            assert found == want[: len(found)] and (kind == "mp4" or cut < 8)
        last = data[: data.rindex(b"\xa9nam") - 4] + bytes(4) + b"\xa9nam" + data[data.rindex(b"\xa9nam") + 4 :]
        assert containers.tags_of(last)[1][:1] == [("©nam", "Sóng")]  # size 0: up to the end of the list
    assert containers.tags_of(box(b"ftyp", b"M4A ")) == ("mp4", [])


def test_people_comments_and_identifiers():
    tag = id3(4, (b"TIPL", b"\x03mix\0Ann\0DJ-mix\0Bo\0odd"), (b"UFID", b"http://musicbrainz.org\0abc"), (b"COMM", b"\x01eng" + "﻿\0﻿said".encode("utf-16-le")), (b"UFID", b"no end"))
    assert containers.tags_of(tag)[1] == [("IPLS:mix", "Ann"), ("IPLS:DJ-mix", "Bo"), ("UFID:http://musicbrainz.org", "abc"), ("COMM", "said")]


def test_mapped_fields_of_dates_and_numbers(spark):
    from tonearm.operators import tags

    rows = [
        ("a", "id3", 0, "TDAT", "3105"), ("a", "id3", 1, "TYER", "1984"), ("b", "id3", 0, "TYER", "1984"), ("b", "id3", 1, "TDAT", "3105"), ("b", "id3", 2, "TDRC", "1990-02"), ("c", "id3", 0, "TRCK", "3"), ("c", "id3", 1, "TRCK", "4/9"),
        ("d", "ape", 0, "TRACK", "7/8"), ("d", "ape", 1, "DISC", "1"), ("e", "flac", 0, "TRACKNUMBER", "3/12"), ("e", "flac", 1, "GENRE", " x "), ("e", "flac", 2, "GENRE", "x"), ("e", "flac", 3, "GENRE", " "), ("f", "unknown", None, None, None),
    ]
    got = tags.mapped_fields(spark.createDataFrame(rows, "path string, container string, ord int, field string, value string")).collect()
    want = {("a", "DATE", "1984"), ("b", "DATE", "1990-02"), ("c", "TRACKNUMBER", "4"), ("c", "TRACKTOTAL", "9"), ("c", "TOTALTRACKS", "9"), ("d", "TRACKNUMBER", "7"), ("d", "TRACKTOTAL", "8"), ("d", "TOTALTRACKS", "8"), ("d", "DISCNUMBER", "1"), ("e", "TRACKNUMBER", "3/12"), ("e", "GENRE", "x")}
    assert {(r.path, r.field, r.value) for r in got} == want and len(got) == len(want)


def picture(kind: int, mime: bytes, data: bytes) -> bytes:
    return struct.pack(">II", kind, len(mime)) + mime + struct.pack(">I", 4) + b"desc" + bytes(16) + struct.pack(">I", len(data)) + data


def test_headers_are_read_in_ranges(spark, tmp_path):
    """Tags of large files for few bytes; pictures stay unread unless asked for; other containers as from whole files."""
    from tonearm.sources import headers

    art, sound = bytes(range(256)) * 2000, bytes(3_000_000)
    big = flac((0, bytes(34)), (1, bytes(40_000)), (6, picture(3, b"image/png", art)), (4, vorbis("title=x", "ARTIST=é"))) + sound
    ilst = box(b"ilst", box(b"covr", item(13, art)) + box(b"\xa9nam", item(1, b"Song")))
    movie = box(b"ftyp", b"M4A ") + box(b"mdat", sound, True) + box(b"moov", box(b"udta", box(b"meta", bytes(4) + ilst)))
    whole = {
        "id3.mp3": TAG + sound, "wav.wav": b"RIFF\0\0\0\0WAVEdata" + struct.pack("<I", len(sound)) + sound + b"id3 " + struct.pack("<I", len(TAG)) + TAG, "dff.dff": b"FRM8" + bytes(8) + b"DSD " + b"ID3 " + struct.pack(">Q", len(TAG)) + TAG,
        "dsf.dsf": b"DSD " + struct.pack("<QQQ", 28, 0, 28) + TAG, "ape.ape": sound + ape((b"Year", b"1984", 0)) + b"TAG" + bytes(125), "none.txt": b"plain", "empty": b"", "cut.flac": big[:60_000], "head.flac": TAG + flac((4, vorbis("A=b"))),
    }
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (whole | {"deep/big.flac": big, "movie.m4a": movie}).items():
        (tmp_path / "in" / name).write_bytes(data)
    spark.dataSource.register(headers.MediaHeaders)
    read = lambda **o: spark.read.format("media_headers").options(filesPerPartition="3", **o).load(f"file://{tmp_path}/in")
    rows = read().collect()
    by = lambda name: [r for r in rows if r.path.endswith(name)]
    for name, data in whole.items():
        kind, fields = containers.tags_of(data)
        own = by(f"/{name}")
        assert {r.container for r in own} == {kind if name != "cut.flac" else "flac"} and [(r.field, r.value) for r in own if r.kind == "tag"] == fields
    for name, tags in (("big.flac", [("TITLE", "x"), ("ARTIST", "é")]), ("movie.m4a", [("©nam", "Song")])):
        own = by(name)
        assert [(r.field, r.value) for r in own if r.kind == "tag"] == tags and max(r.bytes_read for r in own) < 16_384
        shown = next(r for r in own if r.kind == "picture")
        data = (tmp_path / "in" / ("deep/" + name if name == "big.flac" else name)).read_bytes()
        assert shown.data is None and data[shown.offset : shown.offset + shown.length] == art
    asked = [r for r in read(pictures="true").collect() if r.kind == "picture"]
    assert len(asked) == 2 and all(bytes(r.data) == art for r in asked)
    assert max(r.bytes_read for r in by(".wav")) < 4096
    (tmp_path / "nothing").mkdir()
    assert spark.read.format("media_headers").load(f"file://{tmp_path}/nothing").collect() == []
