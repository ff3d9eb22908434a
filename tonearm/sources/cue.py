"""Cue sheets as DataFrames: lines become commands, and windows carry files and tracks forward."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.discs import parse_msf


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), '^"(.*?)"?$', "$1")


def _raw_lines(text: Column) -> Column:
    """Lines without a mark at the start of the text; what is left of an end of line is blank."""
    return F.split(F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text), "\n")


def _clean(raw: Column) -> Column:
    """A line with single blanks, none at its ends."""
    plain = F.trim(raw)
    return F.when(plain.rlike("[\\t\\x0B\\f\\r\\x00]|  "), F.trim(F.regexp_replace(raw, "[\\s\\x00]+", " "))).otherwise(plain)


def commands(sheets: DataFrame) -> DataFrame:
    """album_id, line, command, rest, file_ord, track_ord, own_track of (album_id, text) rows.

    file_ord counts FILE lines so far and track_ord TRACK lines; own_track is whether a TRACK came
    since the last FILE, so lines before it describe the album.
    """
    lines = sheets.select("album_id", F.posexplode(_raw_lines(F.col("text"))).alias("line", "raw")).withColumn("raw", _clean(F.col("raw"))).where("raw <> ''")
    word = F.substring_index("raw", " ", 1)  # blanks are single by now
    rows = lines.select("album_id", "line", F.upper(word).alias("command"), F.substring(F.col("raw"), F.length(word) + 2, F.length("raw")).alias("rest"))
    so_far = Window.partitionBy("album_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda c: F.last(F.when(F.col("command") == c, F.col("line")), ignorenulls=True).over(so_far)
    return rows.withColumns({
        "file_ord": F.sum((F.col("command") == "FILE").cast("int")).over(so_far), "track_ord": F.sum((F.col("command") == "TRACK").cast("int")).over(so_far),
        "own_track": F.coalesce(mark("TRACK") > mark("FILE"), F.lit(False)),
    })


def starts(sheets: DataFrame) -> DataFrame:
    """album_id, track_ord, number, title, isrc, frames: each INDEX 01 of each track, of (album_id, text) rows; broken sheets are left out.

    What tracks, indexes and albums say of the same lines. But a sheet is cut within its own row, so its lines are neither sorted nor grouped.
    """
    lines = F.filter(F.transform(_raw_lines(F.col("text")), _clean), lambda raw: raw != "")
    word = lambda raw: F.substring_index(raw, " ", 1)
    rows = sheets.select("album_id", lines.alias("lines")).select("album_id", F.transform("lines", lambda raw: F.struct(
        F.upper(word(raw)).alias("command"), F.substring(raw, F.length(word(raw)) + 2, F.length(raw)).alias("rest"))).alias("lines"))
    places = F.array_compact(F.transform("lines", lambda x, i: F.when(x["command"] == "TRACK", i + 1)))
    rows = rows.select("album_id", "lines", F.array_position("lines.command", "FILE").alias("file"), places.alias("places"))
    # filters on what was made of the lines would make it once more for each of them, so only what is exploded is filtered
    whole = (F.col("file") > 0) & (F.try_element_at("places", F.lit(1)) > F.col("file"))
    rows = rows.select("album_id", "lines", "places", F.posexplode_outer(F.when(whole, F.col("places"))).alias("k", "place")).where("place is not null")
    end = F.coalesce(F.get("places", F.col("k") + 1), F.size("lines") + 1)
    rows = rows.select("album_id", (F.col("k") + 1).cast("long").alias("track_ord"), F.element_at("lines", F.col("place"))["rest"].alias("track"), F.slice("lines", F.col("place") + 1, end - F.col("place") - 1).alias("lines"))
    # a later FILE ends what is said of the track, though not its INDEX lines
    file = F.array_position("lines.command", "FILE").cast("int")
    rows = rows.withColumn("own", F.when(file > 0, F.slice("lines", F.lit(1), file - 1)).otherwise(F.col("lines")))
    said = lambda c: F.try_element_at(F.filter("own", lambda x: x["command"] == c), F.lit(-1))["rest"]
    rows = rows.select("album_id", "track_ord", "track", said("TITLE").alias("title"), said("ISRC").alias("isrc"), F.explode_outer(F.filter("lines", lambda x: x["command"] == "INDEX")["rest"]).alias("rest"))
    first = F.regexp_extract("rest", "^(\\S+)", 1).try_cast("int") == 1
    return rows.where(first).select(
        "album_id", "track_ord", F.coalesce(F.regexp_extract("track", "^(\\S+)", 1).try_cast("int"), F.col("track_ord")).alias("number"), _unquoted(F.col("title")).alias("title"), _unquoted(F.col("isrc")).alias("isrc"),
        parse_msf(F.regexp_extract("rest", "^\\S+\\s+(\\S+)", 1)).alias("frames"),
    ).where("frames is not null")


def files(cmds: DataFrame) -> DataFrame:
    """album_id, file_ord, name, type: the type is the last word; a name may have blanks with or without quotes."""
    f = cmds.where("command = 'FILE' and rest <> ''")
    one = ~F.col("rest").rlike('(^".*"\\s+\\S+$)|(^[^"]*\\S\\s+\\S+$)')
    name = F.when(one, F.col("rest")).otherwise(F.regexp_replace("rest", "\\s+\\S+$", ""))
    return f.select("album_id", "file_ord", _unquoted(name).alias("name"), F.when(one, "WAVE").otherwise(F.upper(F.regexp_extract("rest", "(\\S+)$", 1))).alias("type"))


def tracks(cmds: DataFrame) -> DataFrame:
    """album_id, track_ord, file_ord, number, type, title, performer, isrc, pregap."""
    # a track's own lines begin with its TRACK line, so one grouping gives it and what it says
    last = lambda c, v: F.max_by(F.when(F.col("command") == c, v), F.when(F.col("command") == c, F.col("line")))
    words = lambda pattern: F.regexp_extract("rest", pattern, 1)
    per = cmds.where("own_track and file_ord > 0").groupBy("album_id", "track_ord").agg(
        last("TRACK", F.struct("file_ord", F.coalesce(words("^(\\S+)").try_cast("int"), F.col("track_ord")).alias("number"), F.upper(F.coalesce(F.nullif(words("^\\S+\\s+(\\S+)"), F.lit("")), F.lit("AUDIO"))).alias("type"))).alias("t"),
        last("TITLE", _unquoted(F.col("rest"))).alias("title"), last("PERFORMER", _unquoted(F.col("rest"))).alias("performer"), last("ISRC", _unquoted(F.col("rest"))).alias("isrc"), last("PREGAP", parse_msf(F.col("rest"))).alias("pregap"),
    )
    return per.select("album_id", "track_ord", "t.file_ord", "t.number", "t.type", "title", "performer", "isrc", "pregap")


def indexes(cmds: DataFrame) -> DataFrame:
    """album_id, track_ord, number, frames, file_offset: an INDEX between a FILE and its first TRACK belongs to the
    track before, measured in the later file."""
    so_far = Window.partitionBy("album_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    began = F.last(F.when(F.col("command") == "TRACK", F.col("file_ord")), ignorenulls=True).over(so_far)
    rows = cmds.withColumn("began", began).where("command = 'INDEX' and track_ord > 0").select(
        "album_id", "track_ord", F.regexp_extract("rest", "^(\\S+)", 1).try_cast("int").alias("number"), parse_msf(F.regexp_extract("rest", "^\\S+\\s+(\\S+)", 1)).alias("frames"), (F.col("file_ord") - F.col("began")).alias("file_offset")
    )
    return rows.where("number is not null and frames is not null")


def albums(cmds: DataFrame) -> DataFrame:
    """album_id, title, performer, catalog, barcode, catalogue_numbers, problem: what a sheet says of the album; problem is set for broken sheets."""
    about = lambda c: ~F.col("own_track") & (F.col("command") == c)
    last = lambda c: F.max_by(F.when(about(c), _unquoted(F.col("rest"))), F.when(about(c), F.col("line")))
    key = F.upper(F.regexp_extract("rest", "^(\\S+)", 1))
    value = _unquoted(F.regexp_replace("rest", "^\\S+\\s*", ""))
    rem = F.when(about("REM"), F.struct("line", key.alias("key"), value.alias("value")))
    rems = F.when(F.count_if(~F.col("own_track")) > 0, F.sort_array(F.collect_list(rem)))
    per = cmds.groupBy("album_id").agg(
        last("TITLE").alias("title"), last("PERFORMER").alias("performer"), last("CATALOG").alias("catalog"), rems.alias("rems"), F.max("file_ord").alias("files"), F.count_if((F.col("command") == "TRACK") & (F.col("file_ord") == 0)).alias("early")
    )
    named = F.filter("rems", lambda r: r["key"].isin("COMMENT", "BARCODE"))
    codes = F.transform(named, lambda r: F.coalesce(
        F.nullif(F.replace(F.regexp_extract(r["value"], "(?i)barcode\\s*[:=]?\\s*([0-9][0-9 ]{7,}[0-9])", 1), F.lit(" ")), F.lit("")),
        F.when((r["key"] == "BARCODE") & (F.length(F.regexp_replace(r["value"], "[^0-9]", "")) >= 8), F.regexp_replace(r["value"], "[^0-9]", "")),
    ))
    own = F.when(F.col("catalog").rlike("^[0-9]{8,}$") & ~F.col("catalog").rlike("^0+$"), F.col("catalog"))
    numbers = F.flatten(F.transform(F.filter("rems", lambda r: r["key"].isin("COMMENT", "CATALOGNUMBER", "CATNO")), lambda r: F.transform(
        F.arrays_zip(F.regexp_extract_all(r["value"], F.lit(_HINT), F.lit(1)).alias("a"), F.regexp_extract_all(r["value"], F.lit(_HINT), F.lit(2)).alias("b")), lambda x: F.concat_ws("-", x["a"], x["b"]))))
    problem = F.when(F.col("early") > 0, "track outside file").when(F.col("files") == 0, "no files")
    return per.select("album_id", "title", "performer", "catalog", F.coalesce(own, F.try_element_at(F.array_compact(codes), F.lit(1))).alias("barcode"), F.array_distinct(numbers).alias("catalogue_numbers"), problem.alias("problem"))


#: Fixed value: a catalogue number in a comment.
_HINT = r"\b([A-Z]{2,10})[- ]?(\d{3,7}(?:-\d{1,2})?)\b"


def decode_text(data: bytes) -> tuple[str, str]:
    """Text and the name of its encoding, by marks, validity and plausibility of the bytes."""
    for mark, codec, name in ((b"\xef\xbb\xbf", "utf-8-sig", "utf-8-bom"), (b"\xff\xfe", "utf-16", "utf-16"), (b"\xfe\xff", "utf-16", "utf-16")):
        if data.startswith(mark):
            try:
                return data.decode(codec), name
            except UnicodeDecodeError:
                break
    try:
        return data.decode(), "ascii" if data.isascii() else "utf-8"
    except UnicodeDecodeError:
        pass
    import re

    double = rb"(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])"  # a character of Shift-JIS beyond ASCII
    if re.fullmatch(rb"(?:[\x00-\x7f]|" + double + rb")*", data) and re.search(double + rb"{2}", re.sub(rb"[\x00-\x7f](?=[\x00-\x7f])", b"", data)):
        try:
            return data.decode("cp932"), "shift_jis"
        except UnicodeDecodeError:
            pass
    for codec, ok in (("cp1251", lambda s: re.search("[Ѐ-ӿ]{3}", s)), ("cp1252", lambda s: True)):
        try:
            if ok(s := data.decode(codec)):
                return s, codec
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "iso-8859-1"


def decoded(files: DataFrame, column: str = "content") -> DataFrame:
    """Rows of bytes with ``text`` and ``encoding``."""

    @F.pandas_udf("struct<text: string, encoding: string>")
    def of(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_text(bytes(b or b"")) for b in data], columns=["text", "encoding"])

    return files.withColumn("_d", of(F.col(column))).withColumns({"text": F.col("_d.text"), "encoding": F.col("_d.encoding")}).drop("_d")
