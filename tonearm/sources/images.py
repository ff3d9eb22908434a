"""Tables of contents of super audio disc images, from their 2048-byte sectors by column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.albums import disc_text

SECTOR = 2048
#: The sector of the master table of contents; its texts are in the next one.
MASTER = 510
#: Frames in a second.
FRAMES = 75
#: Texts of a track at most, and bytes of each.
TEXTS, TEXT_BYTES = 16, 512
#: Genres of category 1 by their codes from 2, and kinds of a track's texts by theirs from 1.
GENRES = (
    "Adult Contemporary", "Alternative Rock", "Children's Music", "Classical", "Contemporary Christian", "Country", "Dance", "Easy Listening", "Erotic", "Folk", "Gospel", "Hip Hop", "Jazz", "Latin",
    "Musical", "New Age", "Opera", "Operetta", "Pop Music", "RAP", "Reggae", "Rock Music", "Rhythm and Blues", "Sound Effects", "Sound Track", "Spoken Word", "World Music", "Blues",
)
TEXT_KINDS = ("title", "performer", "songwriter", "composer", "arranger", "message")


def _bytes(sector: Column, at: int, n: int) -> Column:
    return F.substring(sector, at + 1, n)


def _number(sector: Column, at: int, n: int) -> Column:
    """An unsigned big-endian number."""
    return F.conv(F.hex(_bytes(sector, at, n)), 16, 10).cast("long")


def _ascii(sector: Column, at: int, n: int) -> Column:
    """Text up to a zero byte, trimmed; null if there is none."""
    plain = F.decode(_bytes(sector, at, n), "ISO-8859-1")
    return F.nullif(F.trim(F.regexp_extract(plain, "(?s)^([^\\x00]*)", 1)), F.lit(""))


def _slice(block: Column, at: Column, n: int) -> Column:
    """Bytes at a computed place, as many as there are."""
    return block.substr((at + 1).cast("int"), F.lit(n))


def _read(block: Column, at: Column, n: int) -> Column:
    """An unsigned big-endian number at a computed place; null where the block ends before."""
    return F.when((at >= 0) & (at + n <= F.octet_length(block)), F.conv(F.hex(_slice(block, at, n)), 16, 10).cast("long"))


def _genre(block: Column, at: Column) -> Column:
    """The genre of a category, a free byte and a code of two bytes; null for other categories and codes."""
    code = _read(block, at + 2, 2).cast("int")
    return F.when((_read(block, at, 1) == 1) & (code > 1), F.try_element_at(F.array(*map(F.lit, GENRES)), code - 1))


def _frames(block: Column, at: Column) -> Column:
    """Frames of a time in minutes, seconds and frames."""
    return (_read(block, at, 1) * 60 + _read(block, at + 1, 1)) * FRAMES + _read(block, at + 2, 1)


def masters(sectors: DataFrame) -> DataFrame:
    """disc_id, set_size, set_place, album_catalogue, disc_catalogue, disc_date, language, charset, stereo_toc, multi_toc, genre,
    album_title, album_artist, disc_title, disc_artist of (disc_id, sector, content) rows; other images have no row."""
    m = sectors.where(F.col("sector") == MASTER).where((F.octet_length("content") == SECTOR) & (_bytes(F.col("content"), 0, 8) == F.lit(b"SACDMTOC")))
    c = F.col("content")
    day = lambda at: F.greatest(_number(c, at, 1), F.lit(1)).cast("int")
    date = F.when(_number(c, 120, 2) > 0, F.format_string("%04d-%02d-%02d", _number(c, 120, 2).cast("int"), day(122), day(123)))
    main = m.select(
        "disc_id", _number(c, 16, 2).alias("set_size"), _number(c, 18, 2).alias("set_place"), _ascii(c, 24, 16).alias("album_catalogue"), _ascii(c, 88, 16).alias("disc_catalogue"), date.alias("disc_date"),
        _ascii(c, 136, 2).alias("language"), _number(c, 138, 1).cast("int").alias("charset"), _number(c, 64, 4).alias("stereo_toc"), _number(c, 72, 4).alias("multi_toc"),
        F.coalesce(*[_genre(c, F.lit(at + 4 * i)) for at in (104, 40) for i in range(4)]).alias("genre"),
    )
    texts = sectors.where(F.col("sector") == MASTER + 1).where((F.octet_length("content") == SECTOR) & (_bytes(c, 0, 8) == F.lit(b"SACDText"))).select("disc_id", F.col("content").alias("t"))
    t = F.col("t")
    place = lambda at: _number(t, at, 2).cast("int")
    text = lambda at: F.when(place(at) > 0, disc_text(t.substr(place(at) + 1, F.lit(SECTOR)), F.col("charset")))
    named = {"album_title": 16, "album_artist": 18, "disc_title": 32, "disc_artist": 34}
    return main.join(texts, "disc_id", "left").withColumns({k: text(at) for k, at in named.items()}).drop("t")


def areas(sectors: DataFrame, discs: DataFrame) -> DataFrame:
    """disc_id, sector, multichannel, format, channels, track_offset, tracks, seconds, first_sector, last_sector, blocks, code, problem of the areas of masters' rows.

    blocks are the sectors of the area's tables with the first, code is that of its character set, the disc's where it names none;
    problem is set where the sector is no table of contents of an area.
    """
    starts = discs.select("disc_id", "charset", F.explode(F.array("stereo_toc", "multi_toc")).alias("sector")).where("sector <> 0")
    rows = starts.join(sectors, ["disc_id", "sector"], "left")
    c = F.col("content")
    kind = F.decode(_bytes(c, 0, 8), "ISO-8859-1")
    ok = F.coalesce((F.octet_length(c) == SECTOR) & kind.isin("TWOCHTOC", "MULCHTOC"), F.lit(False))
    code = _number(c, 21, 1)
    one = lambda at: _number(c, at, 1).cast("int")
    values = {
        "multichannel": kind == "MULCHTOC", "format": F.when(code == 0, "dst").when(code.isin(2, 3), "dsd").otherwise("unknown"), "channels": one(32), "track_offset": one(68), "tracks": one(69),
        "seconds": one(64) * 60 + one(65), "first_sector": _number(c, 72, 4), "last_sector": _number(c, 76, 4),
        "blocks": _number(c, 10, 2).cast("int"), "code": F.coalesce(F.nullif(one(90), F.lit(0)), F.col("charset")),
    }
    return rows.select("disc_id", "sector", *[F.when(ok, v).alias(k) for k, v in values.items()], F.when(~ok, "not an area").alias("problem"))


def area_tables(sectors: DataFrame, found: DataFrame) -> DataFrame:
    """disc_id, sector, starts, times, codes, texts: the tables of areas' rows, each null without its mark.

    They are looked for in the sectors after the area's own, by an equi-join of computed numbers. Of a mark that repeats the
    last sector counts. Codes run over two sectors; texts from their mark to the end of the area, so these are joined in order.
    An area is at most as long as its two-byte count of sectors says, whatever the number of discs.
    """
    inside = found.where("problem is null and blocks > 1").select("disc_id", F.col("sector").alias("area"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("i"))
    rows = inside.withColumn("sector", F.col("area") + F.col("i")).join(sectors, ["disc_id", "sector"])
    rows = rows.withColumn("mark", F.decode(_bytes(F.col("content"), 0, 8), "ISO-8859-1"))
    last = lambda m: F.max(F.when(F.col("mark") == m, F.col("i")))
    at = rows.groupBy("disc_id", "area").agg(last("SACDTRL1").alias("trl1"), last("SACDTRL2").alias("trl2"), last("SACD_IGL").alias("igl"), last("SACDTTxt").alias("ttxt"))
    i = F.col("i")
    of = {"starts": i == F.col("trl1"), "times": i == F.col("trl2"), "codes": i.between(F.col("igl"), F.col("igl") + 1), "texts": i >= F.col("ttxt")}
    needed = rows.join(at, ["disc_id", "area"]).where(reduce(or_, [F.coalesce(c, F.lit(False)) for c in of.values()]))
    # collect_list passes over nulls; the hexadecimal text of a run of sectors is put together and read back as bytes
    joined = lambda c: F.unhex(F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("i", F.hex("content").alias("h"))))), lambda x: x["h"]), ""), F.lit("")))
    return needed.groupBy("disc_id", F.col("area").alias("sector")).agg(*[joined(c).alias(name) for name, c in of.items()])


def _text_places(block: Column, plain: Column, at: Column) -> Column:
    """(i, kind, place) of the texts of a track whose list is at a place: a count, three free bytes, and for each text its kind,
    a free byte and the text up to a zero byte, filled up to four bytes. ``plain`` is the block with a character for each byte."""
    size = F.octet_length(block)
    none = F.array().cast("array<struct<i:int,kind:int,place:bigint>>")
    start = F.struct((at + 4).cast("long").alias("p"), none.alias("found"))

    def step(s, i):
        zero = F.position(F.lit("\0"), plain, (s["p"] + 3).cast("int")).cast("long")  # the number of the character after the text, from 1
        end = F.when(zero > 0, zero).otherwise(size.cast("long") + 1)
        one = F.struct(i.alias("i"), _read(block, s["p"], 1).cast("int").alias("kind"), (s["p"] + 2).alias("place"))
        after = F.struct((F.floor((end + 3) / 4) * 4).cast("long").alias("p"), F.concat(s["found"], F.array(one)).alias("found"))
        return F.when(s["p"] + 2 < size, after).otherwise(s)

    turns = F.slice(F.sequence(F.lit(1), F.lit(TEXTS)), F.lit(1), F.coalesce(_read(block, at, 1), F.lit(0)).cast("int"))
    return F.when((at >= 12) & (at + 4 <= size), F.aggregate(turns, start, step)["found"])


def track_tables(sectors: DataFrame, discs: DataFrame, found: DataFrame) -> DataFrame:
    """disc_id, multichannel, number, start_sector, sectors, start_frames, frames, isrc, genre and TEXT_KINDS of the tracks of areas' rows.

    discs are masters' rows; a track without a genre has its disc's. Areas that lack the list of sectors or that of times
    have no row (their ids are found by an anti-join). Of several texts of a kind the last counts, an empty one too.
    """
    tables = area_tables(sectors, found).where("starts is not null and times is not null")
    rows = found.join(tables, ["disc_id", "sector"]).join(discs.select("disc_id", F.col("genre").alias("disc_genre")), "disc_id").where("tracks > 0")
    k, c = F.col("k"), F.col
    rows = rows.withColumn("plain", F.decode(c("texts"), "ISO-8859-1")).withColumn("k", F.explode(F.sequence(F.lit(0), c("tracks") - 1)))
    values = {
        "start_sector": _read(c("starts"), 8 + 4 * k, 4), "sectors": _read(c("starts"), 1028 + 4 * k, 4), "start_frames": _frames(c("times"), 8 + 4 * k), "frames": _frames(c("times"), 1028 + 4 * k),
        "isrc": disc_text(_slice(c("codes"), 8 + 12 * k, 12), F.lit(1)), "genre": F.coalesce(_genre(c("codes"), 3068 + 4 * k), c("disc_genre")),
        "found": _text_places(c("texts"), c("plain"), _read(c("texts"), 8 + 2 * k, 2)),
    }
    cut = F.transform("found", lambda x: F.struct(x["i"].alias("i"), x["kind"].alias("kind"), _slice(c("texts"), x["place"], TEXT_BYTES).alias("bytes")))
    rows = rows.select("disc_id", "sector", "multichannel", "code", (k + 1).alias("number"), "texts", *[v.alias(n) for n, v in values.items()])
    rows = rows.withColumn("found", cut).drop("texts").withColumn("isrc", F.when(F.length("isrc") == 12, c("isrc")))
    key = ["disc_id", "sector", "number"]
    rest = [n for n in values if n != "found"]
    each = rows.withColumn("f", F.explode_outer("found")).withColumn("text", disc_text(c("f.bytes"), c("code")))
    kinds = [F.max_by("text", F.when(c("f.kind") == i, c("f.i"))).alias(n) for i, n in enumerate(TEXT_KINDS, 1)]
    return each.groupBy(*key).agg(F.first("multichannel").alias("multichannel"), *[F.first(n).alias(n) for n in rest], *kinds).select("disc_id", "multichannel", "number", *rest, *TEXT_KINDS)


def sectors_of(files: DataFrame, wanted: list[int]) -> DataFrame:
    """disc_id, sector, content: some sectors of (disc_id, content) rows, null where the image is shorter."""
    at = F.explode(F.array(*[F.lit(s).cast("long") for s in wanted])).alias("sector")
    return files.select("disc_id", at, "content").select("disc_id", "sector", F.col("content").substr((F.col("sector") * SECTOR + 1).cast("int"), F.lit(SECTOR)).alias("content"))
