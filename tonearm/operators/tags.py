"""Tags: merging, differences, roll-ups, field maps, credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_diff(existing: DataFrame, proposed: DataFrame, identity: list[str], locked: DataFrame | None = None) -> DataFrame:
    """file, field, old, new, kind: of (file, field, value) rows, the tags before and after a merge.

    A proposed field replaces unless it is locked. Where a file has a proposal, identity fields that
    are not in it go; all else stays. kind is added, removed, changed or unchanged.
    """
    lock = (locked if locked is not None else existing.select("field").limit(0)).select("field", F.lit(True).alias("locked")).distinct()
    given = proposed.select("file").distinct().withColumn("given", F.lit(True))
    both = existing.withColumnRenamed("value", "old").join(proposed.withColumnRenamed("value", "wanted"), ["file", "field"], "full").join(given, "file", "left").join(lock, "field", "left")
    keep = F.coalesce("locked", F.lit(False))
    drop = F.col("wanted").isNull() & F.coalesce("given", F.lit(False)) & F.col("field").isin(*identity) & ~keep
    new = F.when(keep, F.col("old")).when(F.col("wanted").isNotNull(), F.col("wanted")).when(~drop, F.col("old"))
    return with_kind(both.withColumn("new", new)).select("file", "field", "old", "new", "kind").where("kind is not null")


def with_kind(rows: DataFrame) -> DataFrame:
    old, new = F.col("old"), F.col("new")
    kind = F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "removed").when(old == new, "unchanged").when(old.isNotNull() & new.isNotNull(), "changed")
    return rows.withColumn("kind", kind)


def album_level(changes: DataFrame, tracks: DataFrame) -> DataFrame:
    """album_id, field, old, new, kind, n, album_level: changes and whether every track has the very same; (album_id, file) and change rows."""
    per = tracks.groupBy("album_id").agg(F.count("*").alias("tracks"))
    found = changes.join(tracks, "file").groupBy("album_id", "field", "old", "new", "kind").agg(F.count("*").alias("n"))
    return found.join(per, "album_id").withColumn("album_level", F.col("n") == F.col("tracks")).drop("tracks")


def change_counts(changes: DataFrame, tracks: DataFrame) -> DataFrame:
    """album_id, changed_tracks, changed_fields, has_work."""
    real = F.col("kind") != "unchanged"
    return changes.join(tracks, "file").groupBy("album_id").agg(
        F.count_distinct(F.when(real, F.col("file"))).alias("changed_tracks"), F.count_distinct(F.when(real, F.col("field"))).alias("changed_fields"), F.coalesce(F.bool_or(real), F.lit(False)).alias("has_work")
    )


def release_state(files: DataFrame) -> DataFrame:
    """album_id, already_tagged, existing_key of (album_id, release_id, wanted_id) rows, a row a file.

    Tagged already: every file has the wanted id in any case; the key is the one id that all files have.
    """
    same = F.coalesce(F.lower("release_id") == F.lower("wanted_id"), F.lit(False))
    one = (F.count("release_id") == F.count("*")) & (F.min(F.lower("release_id")) == F.max(F.lower("release_id")))
    return files.groupBy("album_id").agg(F.bool_and(same).alias("already_tagged"), F.when(one, F.min(F.lower("release_id"))).alias("existing_key"))


#: Fields of the containers' own names. Track and disc numbers, dates, people, comments and ids have rules of their own below.
ID3_FRAMES = {
    "TIT2": "TITLE", "TPE1": "ARTIST", "TPE2": "ALBUMARTIST", "TALB": "ALBUM", "TSOP": "ARTISTSORT", "TSOA": "ALBUMSORT", "TSO2": "ALBUMARTISTSORT", "TSOC": "COMPOSERSORT",
    "TCOM": "COMPOSER", "TEXT": "LYRICIST", "TPE3": "CONDUCTOR", "TPE4": "REMIXER", "TPUB": "LABEL", "TMED": "MEDIA", "TSRC": "ISRC", "TCON": "GENRE", "TSST": "DISCSUBTITLE",
    "TCMP": "COMPILATION", "TIT1": "GROUPING", "TIT3": "SUBTITLE", "TBPM": "BPM", "TLAN": "LANGUAGE", "TCOP": "COPYRIGHT", "TENC": "ENCODEDBY", "TMOO": "MOOD",
    "TOPE": "ORIGINALARTIST", "TOAL": "ORIGINALALBUM", "TSSE": "ENCODERSETTINGS",
}
#: Descriptions of TXXX frames and names of free items of MP4 files, in any case; others are fields themselves.
DESCRIPTIONS = {
    "MusicBrainz Album Id": "MUSICBRAINZ_ALBUMID", "MusicBrainz Artist Id": "MUSICBRAINZ_ARTISTID", "MusicBrainz Album Artist Id": "MUSICBRAINZ_ALBUMARTISTID",
    "MusicBrainz Release Group Id": "MUSICBRAINZ_RELEASEGROUPID", "MusicBrainz Release Track Id": "MUSICBRAINZ_RELEASETRACKID", "MusicBrainz Work Id": "MUSICBRAINZ_WORKID",
    "MusicBrainz Disc Id": "MUSICBRAINZ_DISCID", "MusicBrainz Album Type": "RELEASETYPE", "MusicBrainz Album Status": "RELEASESTATUS",
    "MusicBrainz Album Release Country": "RELEASECOUNTRY", "Acoustid Id": "ACOUSTID_ID", "Acoustid Fingerprint": "ACOUSTID_FINGERPRINT",
}
#: A free item of MP4 files that TXXX frames have no description for.
MP4_NAMES = {"MusicBrainz Track Id": "MUSICBRAINZ_TRACKID"}
#: Items of APE tags whose field is not their name in upper case.
APE_ITEMS = {"ALBUM ARTIST": "ALBUMARTIST", "YEAR": "DATE", "ORIGINAL DATE": "ORIGINALDATE", "TRACK": "TRACKNUMBER", "DISC": "DISCNUMBER", "MIXARTIST": "REMIXER"}
#: Atoms of MP4 files.
MP4_ATOMS = {
    "©nam": "TITLE", "©ART": "ARTIST", "aART": "ALBUMARTIST", "©alb": "ALBUM", "©day": "DATE", "©gen": "GENRE", "©wrt": "COMPOSER", "©cmt": "COMMENT", "©grp": "GROUPING", "©lyr": "LYRICS",
    "soar": "ARTISTSORT", "soaa": "ALBUMARTISTSORT", "soal": "ALBUMSORT", "soco": "COMPOSERSORT", "sonm": "TITLESORT", "cpil": "COMPILATION", "trkn": "TRACKNUMBER", "disk": "DISCNUMBER",
}
#: Roles of people frames that have a field, as spelled there.
PEOPLE = {"producer": "PRODUCER", "engineer": "ENGINEER", "mixer": "MIXER", "mix": "MIXER", "arranger": "ARRANGER", "DJ-mix": "REMIXER"}
RECORDING_OWNER = "http://musicbrainz.org"
ID3_FIELDS = {field: frame for frame, field in ID3_FRAMES.items()} | {"DATE": "TDRC", "TRACKNUMBER": "TRCK", "DISCNUMBER": "TPOS"}
#: Containers whose names are frames; dates among these.
_FRAMED, _DATES = ("id3", "wav", "aiff", "dff", "dsf"), ("TYER", "TDRC", "TDAT")
#: Fields that the last of several values replaces.
_REPLACED = ("TRACKNUMBER", "TRACKTOTAL", "TOTALTRACKS", "DISCNUMBER", "DISCTOTAL", "TOTALDISCS", "ORIGINALDATE", "MUSICBRAINZ_TRACKID", "DATE")


def mapped_fields(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, field, ord, value of the rows of containers.tag_rows: the containers' own names as the fields that they mean.

    "3/12" is a number and totals. Of dates the recording time wins over the first year, and a day and month (DDMM) after a year alone complete
    it. Numbers, totals, dates and recording ids are what was said last; of other fields each value stands once, trimmed, in order; empty ones go.
    Names that are unknown are fields. ``ord`` counts from 0 in each file and field.
    """
    name, framed = F.col("field"), F.col("container").isin(*_FRAMED)
    known = lambda m, c=name: F.element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]), c)
    described = {k.upper(): v for k, v in DESCRIPTIONS.items()}
    free = described | {k.upper(): v for k, v in MP4_NAMES.items()}
    role = F.substring(name, 6, 1 << 20)
    person = F.coalesce(known(PEOPLE, role), F.lit("PERFORMER"))
    plain = F.when((known(PEOPLE, role).isNotNull()) | F.lower(role).isin("", "performer"), F.col("value")).otherwise(F.concat("value", F.lit(" ("), role, F.lit(")")))
    numbers = {"TRCK": "TRACKNUMBER", "TPOS": "DISCNUMBER"}
    field = (
        F.when(framed & name.startswith("IPLS:"), person)
        .when(framed & (name == f"UFID:{RECORDING_OWNER}"), "MUSICBRAINZ_TRACKID")
        .when(framed & name.isin("TORY", "TDOR"), "ORIGINALDATE")
        .when(framed & (name == "COMM"), "COMMENT")
        .when(framed, F.coalesce(known(ID3_FRAMES | numbers), known(described), name))
        .when(F.col("container") == "ape", F.coalesce(known(APE_ITEMS), name))
        .when(F.col("container") == "mp4", F.coalesce(known(MP4_ATOMS), known(free, F.upper(name)), F.upper(name)))
        .otherwise(name)
    )
    value = F.when(framed & name.startswith("IPLS:"), plain).otherwise(F.col("value"))
    some = rows.where("field is not null").where(~(framed & name.startswith("UFID:") & (name != f"UFID:{RECORDING_OWNER}")))
    dated = framed & name.isin(*_DATES)
    # dates keep their frame's name until a file's are put together
    at = some.select(key, "ord", F.when(dated, name).otherwise(field).alias("field"), F.when(dated, F.col("value")).otherwise(value).alias("value"), "container", dated.alias("dated"))

    paired = ~F.col("dated") & F.col("field").isin("TRACKNUMBER", "DISCNUMBER") & (F.col("container") != "flac")
    parts, disc = F.split("value", "/", 2), F.col("field") == "DISCNUMBER"
    total = F.try_element_at(parts, F.lit(2))
    one = lambda f, v: F.struct(f.alias("field"), v.alias("value"))
    each = F.when(
        paired,
        F.filter(F.array(one(F.col("field"), parts[0]), one(F.when(disc, "DISCTOTAL").otherwise("TRACKTOTAL"), total), one(F.when(disc, "TOTALDISCS").otherwise("TOTALTRACKS"), total)), lambda x: x["value"].isNotNull()),
    ).otherwise(F.array(one(F.col("field"), F.col("value"))))
    each = F.transform(each, lambda x: F.struct("ord", x["field"].alias("field"), x["value"].alias("value"), "dated"))
    # a file's fields meet once: all steps after work on what they become together
    every = at.groupBy(key).agg(F.flatten(F.collect_list(each)).alias("every"))
    said = F.sort_array(F.filter("every", lambda x: x["dated"]))

    def next_date(d: Column, x: Column) -> Column:
        year = (F.length(x["value"]) == 4) & (F.length(d) == 4)
        whole = F.concat(d, F.lit("-"), F.substring(x["value"], 3, 2), F.lit("-"), F.substring(x["value"], 1, 2))
        return F.when((x["field"] == "TDRC") | ((x["field"] == "TYER") & (d == "")), x["value"]).when((x["field"] == "TDAT") & year, whole).otherwise(d)

    date = F.struct(said[0]["ord"].alias("ord"), F.lit("DATE").alias("field"), F.aggregate(said, F.lit(""), next_date).alias("value"), F.lit(True).alias("dated"))
    fields = every.select(key, F.explode(F.concat(F.filter("every", lambda x: ~x["dated"]), F.when(F.size(said) > 0, F.array(date)).otherwise(F.array()))).alias("f"))
    fields = fields.select(key, "f.ord", "f.field", F.btrim("f.value", F.lit(" \t\r\n")).alias("value")).where("value <> ''")
    replaced = F.col("field").isin(*_REPLACED)
    fields = fields.withColumn("own", F.when(~replaced, F.col("value")))
    fields = fields.groupBy(key, "field", "own").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.max_by("value", "ord").alias("value"))
    fields = fields.select(key, "field", F.when(replaced, F.col("last")).otherwise(F.col("first")).alias("ord"), F.when(replaced, F.col("value")).otherwise(F.col("own")).alias("value"))
    order = F.row_number().over(Window.partitionBy(key, "field").orderBy("ord", "value")) - 1
    return fields.select(key, "field", order.alias("ord"), "value")


def renamed(field: Column, names: dict[str, str]) -> Column:
    """A field under another name; unknown ones keep theirs."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), field), field)


def ordered_fields(fields: DataFrame, known: list[str]) -> DataFrame:
    """file, field, ord: the known fields in their order, then the others by name."""
    at = F.array_position(F.array(*[F.lit(k) for k in known]), F.col("field"))
    return fields.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy(F.when(at > 0, at).otherwise(len(known) + 1), "field")))


def override_tags(stream: Column, container: Column) -> Column:
    """Two maps with upper-case keys joined; the container's values win."""
    up = lambda m: F.transform_keys(m, lambda k, _: F.upper(k))
    s, c = up(stream), up(container)
    return F.map_concat(F.map_filter(s, lambda k, _: ~F.map_contains_key(c, k)), c)


#: Spellings of roles, by the field that they fill; "performer" fills PERFORMER with the bare name.
ROLES = {
    "COMPOSER": ("composer", "composed by", "music by"),
    "LYRICIST": ("lyricist", "lyrics by", "words by", "librettist"),
    "WRITER": ("writer", "written-by", "written by", "songwriter"),
    "ARRANGER": ("arranger", "arranged by", "orchestrator", "orchestrated by"),
    "CONDUCTOR": ("conductor", "conducted by"),
    "PRODUCER": ("producer", "produced by", "co-producer", "executive producer", "executive-producer"),
    "ENGINEER": ("engineer", "recorded by", "recording engineer", "recording", "mastered by", "mastering", "mastering engineer"),
    "MIXER": ("mixer", "mixed by", "mix"),
    "REMIXER": ("remixer", "remix", "remixed by"),
    "PERFORMER": ("performer",),
}
ROLE_FIELDS = {role: field for field, roles in ROLES.items() for role in roles}


def role_name(role: Column) -> Column:
    """A role in lower case, "Guitar [Acoustic]" as "acoustic guitar"; what follows the bracket goes, and empty brackets too."""
    role = F.btrim(F.lower(role), F.lit(" \t"))
    bracket = "(?s)^([^\\[\\]]*)\\[([^\\]]*)\\].*$"
    base, inside = (F.btrim(F.regexp_extract(role, bracket, n), F.lit(" \t")) for n in (1, 2))
    return F.when(role.rlike(bracket), F.when(inside == "", base).otherwise(F.concat(inside, F.lit(" "), base))).otherwise(role)


def credit_fields(credits: DataFrame) -> DataFrame:
    """track_id, field, value of (track_id, role, name) rows: roles split at commas and named by role_name,
    unknown roles as PERFORMER with the role in brackets; each value once."""
    rows = credits.select("track_id", "name", F.explode(F.split("role", ",")).alias("role")).where(F.btrim("role", F.lit(" \t")) != "")
    rows = rows.withColumn("role", role_name(F.col("role")))
    field = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_FIELDS.items() for x in pair]), F.col("role"))
    value = F.when(field.isNotNull(), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "role", F.lit(")")))
    return rows.select("track_id", F.coalesce(field, F.lit("PERFORMER")).alias("field"), value.alias("value")).distinct()


def joined_artist(credits: Column) -> Column:
    """Names of an array of (name, join) with what joins them."""
    return F.array_join(F.transform(credits, lambda c: F.concat(c["name"], F.coalesce(c["join"], F.lit("")))), "")
