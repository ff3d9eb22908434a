"""Disc lookups as tables: requests are parsed, matched with ranked media, and answered as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import form_value
from .batch import nearest_media, response_code

#: One category names each match of an answer.
CATEGORIES = ("rock", "misc", "jazz", "classical", "folk", "blues")
#: Bytes of a line, without its end.
LINE_BYTES = 250


def parse_requests(requests: DataFrame) -> DataFrame:
    """req_id, verb, disc, category, offsets, seconds, durations, valid of (req_id, query) rows.

    A query names a disc, as many start frames as it says, and the playing time in seconds; a read a category and a disc.
    """
    words = F.filter(F.split(F.coalesce(form_value(F.col("query"), "cmd"), F.lit("")), " "), lambda w: w != "")
    rows = requests.select("req_id", words.alias("w"))
    verb = F.when(F.lower(F.try_element_at("w", F.lit(1))) == "cddb", F.lower(F.try_element_at("w", F.lit(2)))).otherwise(F.lower(F.try_element_at("w", F.lit(1))))
    n = F.try_element_at("w", F.lit(4)).try_cast("int")
    offsets = F.transform(F.when(n > 0, F.slice("w", 5, n)), lambda x: x.try_cast("long"))
    seconds = F.element_at("w", -1).try_cast("long")
    rows = rows.withColumns({"verb": verb, "n": n})
    rows = rows.withColumns({"offsets": F.when(F.col("verb") == "query", offsets), "seconds": F.when((F.col("verb") == "query") & (F.size("w") > 0), seconds)})
    query_ok = F.coalesce((F.col("n") > 0) & (F.size("w") == F.col("n") + 5) & F.col("seconds").isNotNull() & F.forall("offsets", lambda o: o.isNotNull()), F.lit(False))
    valid = F.when(F.col("verb") == "query", query_ok).when(F.col("verb") == "read", F.size("w") >= 4).otherwise(F.coalesce(F.col("verb").isin("proto", "hello", "motd", "stat", "lscat"), F.lit(False)))
    last = F.concat(F.slice("offsets", 2, F.greatest(F.size("offsets") - 1, F.lit(0))), F.array(F.col("seconds") * 75))
    return rows.select(
        "req_id", "verb", F.lower(F.when(F.col("verb") == "query", F.try_element_at("w", F.lit(3))).when(F.col("verb") == "read", F.try_element_at("w", F.lit(4)))).alias("disc"),
        F.when(F.col("verb") == "read", F.lower(F.try_element_at("w", F.lit(3)))).alias("category"), "offsets", "seconds", F.when(valid & (F.col("verb") == "query"), F.zip_with(last, "offsets", lambda e, o: F.floor((e - o) / 75))).alias("durations"), valid.alias("valid"),
    )


def display_title(artist: Column, title: Column) -> Column:
    return F.replace(F.concat(artist, F.lit(" / "), title), F.lit("\n"), F.lit(" "))


def edition_note(*parts: Column) -> Column:
    """The known parts of an edition in brackets, after a blank; nothing without any."""
    known = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(known) == 0, "").otherwise(F.concat(F.lit(" ["), F.array_join(known, " · "), F.lit("]")))


def answers(requests: DataFrame, media: DataFrame) -> DataFrame:
    """req_id, code, answer of parsed queries; media: (medium_id, tracks, durations, artist, title, year, country, format, catalog_number).

    Media with equally many tracks are listed by how far their durations are off, six at most.
    """
    asks = requests.where("verb = 'query'")
    ranked = nearest_media(asks.where("valid").select("req_id", F.size("durations").alias("tracks"), "durations"), media.select("medium_id", "tracks", "durations"), len(CATEGORIES)).drop("matches")
    names = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("rank"))
    about = ranked.join(media.drop("tracks", "durations"), "medium_id").join(asks.select("req_id", "disc"), "req_id")
    title = F.concat_ws(" ", names, "disc", display_title(F.col("artist"), F.col("title")))
    about = about.withColumns({"line": title, "full": F.concat(title, edition_note(F.col("year"), F.col("country"), F.col("format"), F.col("catalog_number")))})
    lists = about.groupBy("req_id").agg(F.count("*").alias("n"), F.min_by("line", "rank").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "full"))), lambda x: x["full"]), "\n").alias("list"))
    rows = asks.join(lists, "req_id", "left").withColumn("code", response_code(F.coalesce("n", F.lit(0)), F.col("valid")))
    text = F.when(F.col("code") == 500, "500 Command syntax error.").when(F.col("code") == 202, "202 No match found.").when(F.col("code") == 200, F.concat(F.lit("200 "), "first")).otherwise(
        F.concat(F.lit("211 Found inexact matches, list follows (until terminating `.')\n"), "list", F.lit("\n."))
    )
    return rows.select("req_id", "code", text.alias("answer"))


def wrapped_field(key: Column, value: Column) -> Column:
    """Lines ``key=part`` of a value, as many characters in each as fit the bytes of a line."""
    clean = F.replace(value, F.lit("\n"), F.lit(" "))
    room = LINE_BYTES - 1 - F.octet_length(key)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, c):
        fits = F.octet_length(s["now"]) + F.octet_length(c) <= room
        return F.when(fits, F.struct(s["done"].alias("done"), F.concat(s["now"], c).alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), c.alias("now")))

    each = F.aggregate(F.filter(F.split(clean, ""), lambda c: c != ""), start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    # characters of one byte each are cut by their places
    cuts = F.sequence(F.lit(0), F.greatest(F.length(clean) - 1, F.lit(0)), F.greatest(room, F.lit(1)))
    plain = (F.octet_length(clean) == F.length(clean)) & (room > 0)
    parts = F.when(plain, F.transform(cuts, lambda i: F.substring(clean, i + 1, room))).otherwise(each)
    return F.array_join(F.transform(parts, lambda p: F.concat(key, F.lit("="), p)), "\n")


def provisional_tags(tracks: DataFrame) -> DataFrame:
    """album_id, number, field, value of split tracks before a release is known: (album_id, number, title, performer, isrc,
    album, album_artist, date, genre, disc) rows; track 0 is a hidden one."""
    total = F.count_if(F.col("number") > 0).over(Window.partitionBy("album_id"))
    rows = tracks.withColumn("total", total)
    fields = {
        "TITLE": F.when(F.col("number") == 0, "Hidden Track").otherwise(F.coalesce("title", F.concat(F.lit("Track "), F.col("number").cast("string")))), "ARTIST": F.coalesce("performer", "album_artist"), "ALBUM": F.col("album"),
        "ALBUMARTIST": F.col("album_artist"), "TRACKNUMBER": F.col("number").cast("string"), "TRACKTOTAL": F.col("total").cast("string"), "DISCNUMBER": F.col("disc").cast("string"), "DATE": F.col("date"), "GENRE": F.col("genre"), "ISRC": F.col("isrc"),
    }
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(v).alias("value")) for f, v in fields.items()])
    return rows.select("album_id", "number", F.explode(pairs).alias("p")).select("album_id", "number", "p.field", "p.value").where("value is not null and value <> ''")


def stream_info(block: Column) -> dict[str, Column]:
    """Fields of a 34-byte STREAMINFO block; null for a block of another length."""
    digits = F.when(F.octet_length(block) == 34, F.hex(block))
    bits = lambda a, n: reduce(lambda x, y: x.bitwiseAND(y), (F.shiftright(F.conv(F.substring(digits, a // 4 + 1, (a + n - 1) // 4 - a // 4 + 1), 16, 10).cast("long"), (-(a + n)) % 4), F.lit((1 << n) - 1).cast("long")))
    return {
        "min_block": bits(0, 16), "max_block": bits(16, 16), "min_frame": bits(32, 24), "max_frame": bits(56, 24), "sample_rate": bits(80, 20), "channels": bits(100, 3) + 1, "bits": bits(103, 5) + 1, "samples": bits(108, 36), "md5": F.lower(F.substring(digits, 37, 32)),
    }
