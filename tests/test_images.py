"""Track tables of composed super audio discs: lists over several sectors, texts, genres and damage."""

from __future__ import annotations

import struct

from tonearm.sources import images


def put(size: int, **at: bytes) -> bytes:
    out = bytearray(size)
    for place, value in at.items():
        out[int(place[1:]) : int(place[1:]) + len(value)] = value
    return bytes(out)


def master(stereo: int, multi: int, charset: int = 2, genre: int = 0) -> bytes:
    return put(2048, _0=b"SACDMTOC", _16=struct.pack(">HH", 1, 1), _64=struct.pack(">I", stereo), _72=struct.pack(">I", multi), _108=bytes([2, 0, 0, 7, 1, 0, 0, genre]), _138=bytes([charset]))


def area(blocks: int, tracks: int, charset: int = 0, mark: bytes = b"TWOCHTOC") -> bytes:
    return put(2048, _0=mark, _10=struct.pack(">H", blocks), _21=b"\x02", _32=b"\x02", _64=bytes([70, 1, 2]), _69=bytes([tracks]), _72=struct.pack(">II", 600, 90000), _90=bytes([charset]))


def lists(tracks: int) -> tuple[bytes, bytes]:
    starts = put(2048, _0=b"SACDTRL1", _8=b"".join(struct.pack(">I", 600 + 10 * k) for k in range(tracks)), _1028=b"".join(struct.pack(">I", 9 + k) for k in range(tracks)))
    times = put(2048, _0=b"SACDTRL2", _8=b"".join(bytes([k // 60, k % 60, 5, 0]) for k in range(tracks)), _1028=b"".join(bytes([3, k % 60, 74, 0]) for k in range(tracks)))
    return starts, times


def texts(*tracks: list[tuple[int, bytes]] | int, size: int = 4096) -> bytes:
    """Lists of texts one after another from byte 1000; a number is a place that is written as it is."""
    at, body, places = 1000, b"", []
    for t in tracks:
        if isinstance(t, int):
            places.append(t)
            continue
        places.append(at + len(body))
        one = bytes([len(t), 0, 0, 0])
        for kind, text in t:
            one += bytes([kind, 0]) + text + b"\0"
            one += bytes(-len(one) % 4)
        body += one
    return put(size, _0=b"SACDTTxt", _8=b"".join(struct.pack(">H", p) for p in places), _1000=body)


def rows(spark, **discs: dict[int, bytes]):
    sectors = [(d, n, bytearray(b)) for d, held in discs.items() for n, b in held.items()]
    frame = spark.createDataFrame(sectors, "disc_id string, sector long, content binary")
    found = images.masters(frame)
    tracks = images.track_tables(frame, found, images.areas(frame, found))
    return {(r.disc_id, r.multichannel, r.number): r.asDict() for r in tracks.collect()}


def test_tracks_of_both_areas(spark):
    starts, times = lists(255)
    codes = put(4096, _0=b"SACD_IGL", _8=b"JPX000000001" + b"short\0\0\0\0\0\0\0", _3068=bytes([1, 0, 0, 14, 1, 0, 0, 1]), _4084=bytes([1, 0, 0, 29]))
    long = b"x" * 700
    words = texts([(1, "é".encode("latin-1")), (2, b"Who"), (9, b"none"), (1, b"Last")], 3, [(1, long), (4, b"After")], 5000, [(3, b""), (6, b" note ")], [(2, b"p" * 40)] * 17)
    japanese = texts([(1, "音楽".encode("shift_jis"))], size=2048)
    disc = {510: master(520, 540, genre=4), 520: area(7, 255), 521: starts, 522: codes[:2048], 523: codes[2048:], 524: times, 525: words[:2048], 526: words[2048:], 540: area(4, 1, charset=3, mark=b"MULCHTOC"), 541: lists(1)[0], 542: lists(1)[1], 543: japanese}
    got = rows(spark, d=disc)
    assert len(got) == 256
    first, second, third, fifth, sixth, last = (got["d", False, n] for n in (1, 2, 3, 5, 6, 255))
    assert (first["start_sector"], first["sectors"], first["start_frames"], first["frames"], first["isrc"], first["genre"]) == (600, 9, 5, 180 * 75 + 74, "JPX000000001", "Jazz")
    assert (first["title"], first["performer"], first["message"]) == ("Last", "Who", None)
    assert (second["isrc"], second["genre"], second["title"]) == (None, "Children's Music", None)  # code 1 is no genre: the disc's
    assert third["title"] == "x" * 512 and third["composer"] == "After"
    assert got["d", False, 4]["title"] is None  # beyond the block
    assert fifth["songwriter"] is None and fifth["message"] == "note"
    assert sixth["performer"] == "p" * 40
    assert (last["start_sector"], last["sectors"], last["genre"], last["frames"]) == (600 + 2540, 9 + 254, "Blues", (180 + 254 % 60) * 75 + 74)
    multi = got["d", True, 1]
    assert (multi["title"], multi["isrc"], multi["genre"]) == ("音楽", None, "Children's Music")


def test_damaged_discs(spark):
    starts, times = lists(2)
    whole = {510: master(520, 0), 520: area(3, 2), 521: starts, 522: times}
    no_times = {**whole, 522: bytes(2048)}
    short = {**whole, 520: area(2, 2)}  # the list of times lies outside
    no_sector = {k: v for k, v in whole.items() if k != 521}
    none = {**whole, 520: area(3, 0)}
    cut = {**whole, 522: times[:1040]}
    other = {**whole, 520: area(3, 2, mark=b"SOMETHIN")}
    got = rows(spark, whole=whole, no_times=no_times, short=short, no_sector=no_sector, none=none, cut=cut, other=other)
    assert sorted(k[0] + str(k[2]) for k in got) == ["cut1", "cut2", "whole1", "whole2"]
    assert got["whole", False, 2]["frames"] == 181 * 75 + 74 and got["whole", False, 2]["genre"] is None and got["whole", False, 2]["title"] is None
    assert (got["cut", False, 2]["start_sector"], got["cut", False, 2]["frames"]) == (610, 181 * 75 + 74)
    assert rows(spark, whole={**whole, 522: times[:1032]})["whole", False, 2]["frames"] is None
    assert rows(spark, none={1: b""}) == {}
