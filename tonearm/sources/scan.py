"""Library scans: a table of files becomes albums, discs, tracks and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folder_disc, natural_key

#: Formats by extension, and names that are never part of an album.
FORMATS = {"flac": "flac", "dsf": "dsf", "dff": "dff", "wav": "wav", "wave": "wav", "aiff": "aiff", "aif": "aiff", "aifc": "aiff", "ape": "ape", "wv": "wv", "m4a": "m4a", "mp3": "mp3"}
IMAGES = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp", "gif", "pdf")
ART_FOLDERS = ("artwork", "art", "scans", "scan", "covers", "cover", "booklet", "images")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))


def is_junk(name: Column) -> Column:
    low = F.lower(name)
    return name.startswith(".") | low.isin("thumbs.db", "desktop.ini", "@eadir") | low.endswith(".dr_done") | low.endswith(".part") | low.endswith(".tmp")


def audio_format(name: Column) -> Column:
    """The format that an extension names, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for p in FORMATS.items() for x in p]), extension(name))


def local_format(is_dsd: Column, rate: Column, bits: Column) -> Column:
    """sacd, cd, hiRes or unknown; unknown rates and sizes tell nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(is_dsd), "sacd").when(yes((rate == 44100) & (bits <= 16)), "cd").when(yes(rate > 44100) | yes(bits > 16), "hiRes").otherwise("unknown")


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext == "iso", "iso").when(ext == "cue", "cue").when(audio_format(name).isNotNull(), "audio").when(ext.isin(*IMAGES), "artwork").when(ext == "log", "log").otherwise("other")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, parent, name, size, modified, kind of all files below a root that are not junk; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return with_kinds(files)


def with_kinds(files: DataFrame) -> DataFrame:
    """(path, …) rows with folder, parent, name and kind, without junk."""
    parts = F.split("path", "/")
    rows = files.withColumns({"name": F.element_at(parts, -1), "folder": F.regexp_replace("path", "/[^/]*$", "")})
    rows = rows.withColumn("parent", F.regexp_replace("folder", "/[^/]*$", ""))
    return rows.where(~is_junk(F.col("name"))).withColumn("kind", file_kind(F.col("name")))


def folder_albums(files: DataFrame, cue_refs: DataFrame) -> DataFrame:
    """folder, parent, kind, cue, tracks: the albums that a folder holds by itself.

    files: from with_kinds; cue_refs: (path, ref) rows, the files that each cue sheet names. A cue
    whose one file is there is an image, one whose several files all are there a multi-file album,
    an ISO a disc image; audio that no such cue names is a folder of tracks.
    """
    there = files.where("kind = 'audio'").select("folder", F.lower("name").alias("ref"), F.lit(1).alias("there"))
    refs = cue_refs.select(F.col("path").alias("cue"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.lower("ref").alias("ref")).distinct()
    cues = refs.join(there.distinct(), ["folder", "ref"], "left").groupBy("folder", "cue").agg(F.count("*").alias("refs"), F.count("there").alias("found")).where("refs = found")
    cue_albums = cues.select("folder", F.when(F.col("refs") == 1, "image").otherwise("multiFile").alias("kind"), "cue", F.col("refs").alias("tracks"))
    used = refs.join(cues.select("cue"), "cue", "left_semi").select("folder", "ref").distinct()
    loose = there.join(used, ["folder", "ref"], "left_anti").groupBy("folder").agg(F.count("*").alias("tracks"))
    loose = loose.select("folder", F.lit("trackFolder").alias("kind"), F.lit(None).cast("string").alias("cue"), "tracks")
    iso = files.where("kind = 'iso'").select("folder", F.lit("iso").alias("kind"), F.col("path").alias("cue"), F.lit(1).cast("long").alias("tracks"))
    return cue_albums.unionByName(loose).unionByName(iso).withColumn("parent", F.regexp_replace("folder", "/[^/]*$", ""))


def multi_disc_albums(albums: DataFrame) -> DataFrame:
    """parent, discs, kind: parents without audio of their own whose numbered children hold one album each.

    Two numbered children, or one that is the only child; children of several kinds are a folder of tracks.
    """
    name = F.regexp_extract("folder", "([^/]*)$", 1)
    per = albums.withColumn("disc", folder_disc(name)).groupBy("parent", "folder").agg(F.count("*").alias("albums"), F.first("kind").alias("kind"), F.first("disc").alias("disc"))
    top = per.groupBy("parent").agg(F.count("*").alias("children"), F.count("disc").alias("numbered"), F.max("albums").alias("most"), F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"))
    own = albums.select(F.col("folder").alias("parent")).distinct()
    ok = top.where("most = 1 and (numbered >= 2 or (children = 1 and numbered = 1))").join(own, "parent", "left_anti")
    return ok.select("parent", F.col("numbered").alias("discs"), F.when(F.col("kinds") > 1, "trackFolder").otherwise(F.col("kind")).alias("kind"))


def collect_artwork(files: DataFrame) -> DataFrame:
    """album_folder, path: pictures of a folder, and those in an art folder one level below it."""
    art = files.where("kind = 'artwork'")
    below = art.where(F.lower(F.regexp_extract("folder", "([^/]*)$", 1)).isin(*ART_FOLDERS))
    return art.select(F.col("folder").alias("album_folder"), "path").unionByName(below.select(F.col("parent").alias("album_folder"), "path"))


def track_order(files: DataFrame) -> DataFrame:
    """Audio files with ``pos`` in natural order of the folder."""
    return files.where("kind = 'audio'").withColumn("pos", F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")))
