"""Catalogue extracts (JSON, XML) as candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import artist_title, duration_ms, trailing_number

#: Fixed schema of a release of a MusicBrainz extract.
RELEASE = """id STRING, title STRING, date STRING, country STRING, barcode STRING, status STRING, disambiguation STRING,
`release-group` STRUCT<id: STRING, `primary-type`: STRING>, `artist-credit` ARRAY<STRUCT<name: STRING, joinphrase: STRING>>,
`label-info` ARRAY<STRUCT<`catalog-number`: STRING, label: STRUCT<name: STRING>>>,
media ARRAY<STRUCT<position: INT, format: STRING, title: STRING, `track-count`: INT, discs: ARRAY<STRUCT<id: STRING>>,
tracks: ARRAY<STRUCT<position: INT, number: STRING, title: STRING, length: INT, recording: STRUCT<id: STRING, length: INT, isrcs: ARRAY<STRING>>, `artist-credit`: ARRAY<STRUCT<name: STRING, joinphrase: STRING>>>>>>"""


def _credit(credits: Column) -> Column:
    return F.array_join(F.transform(credits, lambda c: F.concat(c["name"], F.coalesce(c["joinphrase"], F.lit("")))), "")


def releases(extracts: DataFrame, column: str = "json") -> DataFrame:
    """One candidate a row of JSON: ids, names, year, distinct labels and catalogue numbers, the one media format or all, track count."""
    r = extracts.select(F.from_json(column, RELEASE).alias("r")).select("r.*")
    names = lambda f: F.array_join(F.array_distinct(F.array_compact(F.transform("label-info", f))), ", ")
    formats = F.array_distinct(F.array_compact(F.transform("media", lambda m: m["format"])))
    return r.select(
        F.lit("musicbrainz").alias("source"), F.col("id").alias("provider_id"), F.col("release-group.id").alias("release_group_id"), "title", _credit(F.col("artist-credit")).alias("artist"),
        F.nullif(F.left("date", F.lit(4)), F.lit("")).alias("year"), "country", F.nullif(F.col("barcode"), F.lit("")).alias("barcode"), "status", "disambiguation",
        names(lambda x: x["label"]["name"]).alias("label"), names(lambda x: x["catalog-number"]).alias("catalog_number"), F.array_join(formats, ", ").alias("media_format"),
        F.aggregate("media", F.lit(0), lambda s, m: s + F.coalesce(m["track-count"], F.lit(0))).alias("track_count"), F.flatten(F.transform("media", lambda m: F.transform(m["discs"], lambda d: d["id"]))).alias("disc_ids"),
    )


def release_tracks(extracts: DataFrame, column: str = "json") -> DataFrame:
    """provider_id, medium, position, title, duration_ms, recording_id, artist: the artist only where it differs from the release's;
    positions are filled from the order, durations from the recording."""
    r = extracts.select(F.from_json(column, RELEASE).alias("r")).select("r.id", "r.artist-credit", F.posexplode("r.media").alias("m_ord", "m"))
    t = r.select("id", "artist-credit", F.coalesce("m.position", F.col("m_ord") + 1).alias("medium"), F.posexplode("m.tracks").alias("t_ord", "t"))
    own, album = _credit(F.col("t.artist-credit")), _credit(F.col("artist-credit"))
    return t.select(
        F.col("id").alias("provider_id"), "medium", F.coalesce("t.position", F.col("t_ord") + 1).alias("position"), "t.title", F.coalesce("t.length", "t.recording.length").alias("duration_ms"),
        F.col("t.recording.id").alias("recording_id"), F.when((own != "") & (own != album), own).alias("artist"),
    )


def discogs_search(extracts: DataFrame, column: str = "json") -> DataFrame:
    """provider_id, artist, title, year, barcode, images of Discogs results: "Artist - Album" split, the first code of 8 to 14 digits, no spacer covers."""
    r = extracts.select(F.from_json(column, "id LONG, title STRING, year STRING, barcode ARRAY<STRING>, cover_image STRING").alias("r")).select("r.*")
    artist, title = artist_title(F.col("title"))
    codes = F.filter(F.transform("barcode", lambda b: F.regexp_replace(b, "[^0-9]", "")), lambda b: F.length(b).between(8, 14))
    image = F.when(~F.col("cover_image").endswith("spacer.gif"), F.col("cover_image"))
    return r.select(F.concat(F.lit("discogs:"), F.col("id").cast("string")).alias("provider_id"), artist.alias("artist"), title.alias("title"), "year", F.try_element_at(codes, F.lit(1)).alias("barcode"), image.alias("image"))


def discogs_tracks(extracts: DataFrame, column: str = "json") -> DataFrame:
    """provider_id, ord, position, title, duration_ms; headings and video tracks have no place in the list."""
    r = extracts.select(F.from_json(column, "id LONG, tracklist ARRAY<STRUCT<position: STRING, type_: STRING, title: STRING, duration: STRING>>").alias("r")).select("r.id", F.posexplode("r.tracklist").alias("ord", "t"))
    ok = (F.coalesce("t.type_", F.lit("track")) == "track") & ~F.upper(F.coalesce("t.position", F.lit(""))).rlike("^(DVD|VIDEO)")
    return r.where(ok).select(F.concat(F.lit("discogs:"), F.col("id").cast("string")).alias("provider_id"), "ord", trailing_number(F.col("t.position")).alias("position"), "t.title", duration_ms(F.col("t.duration")).alias("duration_ms"))


def acoustid_hits(extracts: DataFrame, column: str = "json") -> DataFrame:
    """track_id, acoust_id, recording_id, score, release_id of lookup results: recordings without an id go; ids from ``releaseids``, else from ``releases``."""
    schema = "results ARRAY<STRUCT<id: STRING, score: DOUBLE, recordings: ARRAY<STRUCT<id: STRING, releaseids: ARRAY<STRING>, releases: ARRAY<STRUCT<id: STRING>>>>>>"
    r = extracts.select("track_id", F.explode(F.from_json(column, schema)["results"]).alias("r")).select("track_id", "r.id", "r.score", F.explode("r.recordings").alias("c"))
    ids = F.coalesce(F.when(F.size("c.releaseids") > 0, F.col("c.releaseids")), F.transform("c.releases", lambda x: x["id"]))
    return r.where("c.id is not null").select("track_id", F.col("id").alias("acoust_id"), F.col("c.id").alias("recording_id"), "score", F.explode_outer(ids).alias("release_id"))


def ctdb_entries(extracts: DataFrame, column: str = "xml") -> DataFrame:
    """disc_id, entry_id, confidence, disc_crc, pos, track_crc of lookup answers; checksums are unsigned 32-bit."""
    schema = "entry ARRAY<STRUCT<_id: STRING, _confidence: INT, _crc32: STRING, _trackcrcs: STRING>>"
    e = extracts.select("disc_id", F.explode(F.from_xml(column, schema)["entry"]).alias("e"))
    crc = lambda c: F.conv(c, 16, 10).cast("long")
    rows = e.select("disc_id", F.col("e._id").alias("entry_id"), F.col("e._confidence").alias("confidence"), crc(F.col("e._crc32")).alias("disc_crc"), F.posexplode(F.split("e._trackcrcs", " ")).alias("pos", "track"))
    return rows.select("disc_id", "entry_id", "confidence", "disc_crc", (F.col("pos") + 1).alias("pos"), crc(F.col("track")).alias("track_crc"))


def image_listing(extracts: DataFrame, column: str = "json") -> DataFrame:
    """release_id, ord, url, front: cover archive listings, most liked first where likes are given; a missing listing gives none."""
    r = extracts.select("release_id", F.posexplode(F.from_json(column, "images ARRAY<STRUCT<image: STRING, url: STRING, front: BOOLEAN, likes: INT>>")["images"]).alias("ord", "i"))
    return r.select("release_id", "ord", F.coalesce("i.image", "i.url").alias("url"), F.coalesce("i.front", F.lit(False)).alias("front"), F.coalesce("i.likes", F.lit(0)).alias("likes"))
