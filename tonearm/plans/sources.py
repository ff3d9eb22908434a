"""Queries on what files and services hold: cue sheets, encodings, catalogue answers, folder names, tag bytes, disc images, fingerprints.

The inputs are composed from the driver's tables, so the SQL says what must come back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import checksums, library, lookups, loudness, prints, subprints, tags
from ..sources import catalogue, containers, cue, folders, images
from .registry import dealt, query, table

_MSF = "printf('%02d:%02d:%02d', {f} DIV 4500, {f} DIV 75 % 60, {f} % 75)"
_LINES = "SELECT DISTINCT l_orderkey AS album_id, CAST(l_linenumber AS INT) AS number, CAST(l_linenumber * 5000 + l_orderkey % 75 AS BIGINT) AS frames FROM {l}"


def _le(n: Column) -> Column:
    """Four bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def _be(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def _utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


#: Lines a task that makes sheets of them.
SHEET_LINES = 500_000


def sheets(spark, d) -> DataFrame:
    """A cue sheet an order: two files, a track a line."""
    # made distinct in their sheets, by the one grouping
    rows = dealt(spark.sql(_LINES.replace("DISTINCT ", ""), l=table(spark, d, "lineitem")), "album_id", task_rows=SHEET_LINES)

    def line(x: Column) -> Column:
        two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
        number, frames = x["number"], x["frames"]
        file = F.when(number == 1, F.concat(F.lit('FILE "disc '), "album_id", F.lit('.wav" WAVE\n'))).when(number == 4, "FILE second.wav WAVE\n").otherwise("")
        msf = F.concat(two(F.floor(frames / 4500)), F.lit(":"), two(F.floor(frames / 75) % 60), F.lit(":"), two(frames % 75))
        return F.concat(file, F.lit("  TRACK "), two(number), F.lit(' AUDIO\n    TITLE "Song '), number, F.lit('"\n    ISRC AB'), "album_id", F.lit("\n    INDEX 00 00:00:00\n    INDEX 01 "), msf, F.lit("\n"))

    text = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("number", "frames"))), line), "")
    head = F.concat(F.lit('REM COMMENT "Barcode: 4988 0061'), F.lpad((F.col("album_id") % 10000).cast("string"), 4, "0"), F.lit('"\nPERFORMER "Band '), (F.col("album_id") % 9).cast("string"), F.lit('"\nTITLE "Album '), "album_id", F.lit('"\n'))
    return rows.groupBy("album_id").agg(text.alias("body")).select("album_id", F.concat(head, "body").alias("text"))


@query(f"WITH l AS ({_LINES.format(l='lineitem')}), f AS (SELECT album_id, min(number) AS first FROM l GROUP BY 1) SELECT l.album_id, l.number::BIGINT AS number, 'Song ' || l.number AS title, 'AB' || l.album_id AS isrc, l.frames FROM l JOIN f USING (album_id) WHERE f.first = 1 OR f.first = 4")
def cue_tracks(spark, d):
    """Tracks of cue sheets with the start of each; sheets whose first line is no file are broken, and left out."""
    return cue.starts(sheets(spark, d)).select("album_id", "number", "title", "isrc", F.col("frames").cast("long").alias("frames"))


@query(f"WITH l AS ({_LINES.format(l='lineitem')}), f AS (SELECT album_id, min(number) AS first FROM l GROUP BY 1) SELECT album_id, CASE WHEN first IN (1, 4) THEN 'Album ' || album_id END AS title, 'Band ' || (album_id % 9) AS performer, '49880061' || lpad((album_id % 10000)::VARCHAR, 4, '0') AS barcode, CASE WHEN first <> 1 AND first <> 4 THEN 'track outside file' END AS problem FROM f")
def cue_albums(spark, d):
    a = cue.albums(cue.commands(sheets(spark, d)))
    return a.select("album_id", F.when(F.col("problem").isNull(), F.col("title")).alias("title"), "performer", "barcode", "problem")


_TEXTS = "CASE c_custkey % 5 WHEN 0 THEN 'plain ' WHEN 1 THEN 'é日 ' WHEN 2 THEN 'ü ' WHEN 3 THEN 'Ωж ' ELSE 'x ' END || c_name"


@query(f"SELECT c_custkey AS id, {_TEXTS} AS text, CASE c_custkey % 5 WHEN 0 THEN 'ascii' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'utf-8-bom' WHEN 3 THEN 'utf-16' ELSE 'utf-16' END AS encoding FROM customer")
def decoded_texts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_TEXTS).alias("t"))
    k = F.col("id") % 5
    little = F.concat(F.lit(b"\xff\xfe"), F.encode("t", "UTF-16LE"))
    content = F.when(k < 2, _utf8(F.col("t"))).when(k == 2, F.concat(F.lit(b"\xef\xbb\xbf"), _utf8(F.col("t")))).when(k == 3, F.encode("t", "UTF-16")).otherwise(little)
    return cue.decoded(c.select("id", content.alias("content"))).select("id", "text", "encoding")


def _release(spark, d) -> DataFrame:
    """A release a customer, as a catalogue's JSON."""
    return spark.sql("""SELECT c_custkey, to_json(named_struct('id', 'r' || c_custkey, 'title', c_name, 'date', (1970 + c_custkey % 50) || '-05-01', 'country', 'JP', 'barcode', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '4988' || c_custkey END, 'status', 'Official',
 'release-group', named_struct('id', 'g' || c_custkey % 100), 'artist-credit', array(named_struct('name', c_mktsegment, 'joinphrase', ' & '), named_struct('name', 'B', 'joinphrase', '')),
 'label-info', array(named_struct('catalog-number', 'CAT-' || c_custkey, 'label', named_struct('name', 'L')), named_struct('catalog-number', 'CAT-' || c_custkey, 'label', named_struct('name', 'M'))),
 'media', array(named_struct('position', 1, 'format', 'CD', 'track-count', 2, 'discs', array(named_struct('id', 'd1')), 'tracks', array(named_struct('position', 1, 'title', 'One', 'length', 1000 * c_custkey, 'recording', named_struct('id', 'x' || c_custkey, 'length', CAST(NULL AS INT))), named_struct('position', 2, 'title', 'Two', 'length', CAST(NULL AS BIGINT), 'recording', named_struct('id', 'y' || c_custkey, 'length', 5)))),
  named_struct('position', 2, 'format', CASE WHEN c_custkey % 2 = 0 THEN 'CD' ELSE 'DVD' END, 'track-count', 3, 'discs', array(named_struct('id', 'd2')), 'tracks', slice(array(named_struct('position', 1, 'title', 'One', 'length', 1000 * c_custkey, 'recording', named_struct('id', '', 'length', 1))), 1, 0))))) AS json FROM {c}""", c=table(spark, d, "customer"))


@query("SELECT 'r' || c_custkey AS provider_id, c_mktsegment || ' & B' AS artist, (1970 + c_custkey % 50)::VARCHAR AS year, CASE WHEN c_custkey % 3 <> 0 THEN '4988' || c_custkey END AS barcode, 'L, M' AS label, 'CAT-' || c_custkey AS catalog_number, CASE WHEN c_custkey % 2 = 0 THEN 'CD' ELSE 'CD, DVD' END AS media_format, 5 AS track_count FROM customer")
def catalogue_releases(spark, d):
    return catalogue.releases(_release(spark, d)).select("provider_id", "artist", "year", "barcode", "label", "catalog_number", "media_format", "track_count")


@query("SELECT 'r' || c_custkey AS provider_id, 1 AS medium, t AS position, CASE t WHEN 1 THEN 'One' ELSE 'Two' END AS title, CASE t WHEN 1 THEN 1000 * c_custkey ELSE 5 END::INT AS duration_ms, CASE t WHEN 1 THEN 'x' ELSE 'y' END || c_custkey AS recording_id FROM customer CROSS JOIN (SELECT unnest([1, 2])::INT AS t)")
def catalogue_tracks(spark, d):
    """Tracks of releases; a track without a length has its recording's."""
    return catalogue.release_tracks(_release(spark, d)).select("provider_id", "medium", "position", "title", "duration_ms", "recording_id")


@query("SELECT 'discogs:' || p_partkey AS provider_id, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS artist, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '12345678' || p_partkey % 10 END AS barcode, CASE WHEN p_partkey % 5 <> 0 THEN 'http://x/' || p_partkey || '.jpg' END AS image FROM part")
def discogs_results(spark, d):
    json = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(" - "), "p_name")).alias("title"), F.array(F.lit("n/a"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1234 5678 "), (F.col("p_partkey") % 10).cast("string"))).otherwise("12")).alias("barcode"),
        F.when(F.col("p_partkey") % 5 == 0, "http://x/spacer.gif").otherwise(F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("cover_image")))
    r = catalogue.discogs_search(table(spark, d, "part").select(json.alias("json")))
    return r.select("provider_id", "artist", "title", "barcode", F.col(r.columns[-1]).alias("image"))


@query("SELECT o_orderkey AS track_id, 'a' || o_orderkey AS acoust_id, 'rec' || o_custkey AS recording_id, o_orderkey % 100 / 100.0::DOUBLE AS score, 'rel' || r AS release_id FROM orders, (SELECT unnest([1, 2]) AS r)")
def acoustid_results(spark, d):
    """Results of fingerprint lookups by recording and release; a recording without an id is left out."""
    ids = F.array(F.lit("rel1"), F.lit("rel2"))
    rec = lambda i, a, b: F.struct(i.alias("id"), a.alias("releaseids"), b.alias("releases"))
    own, other = F.concat(F.lit("rec"), F.col("o_custkey").cast("string")), F.transform(ids, lambda x: F.struct(x.alias("id")))
    k = F.col("o_orderkey") % 2 == 0
    first = rec(own, F.when(k, ids), F.when(~k, other))
    none = rec(F.lit(None).cast("string"), ids, other)
    json = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_orderkey") % 100 / 100).alias("score"), F.array(none, first).alias("recordings"))).alias("results")))
    return catalogue.acoustid_hits(table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), json.alias("json")))


@query("SELECT o_orderkey AS disc_id, 'e' || (o_custkey % 7) AS entry_id, (o_orderkey % 50)::INT AS confidence, (o_orderkey * 7919 % 4294967296)::BIGINT AS disc_crc, p AS pos, (o_custkey * 104729 * p % 4294967296)::BIGINT AS track_crc FROM orders, (SELECT unnest([1, 2, 3])::INT AS p)")
def checksum_entries(spark, d):
    """Entries of a checksum database's XML answers, a row a track."""
    o = table(spark, d, "orders")
    word = lambda n: F.lpad(F.lower(F.hex((n % (1 << 32)).cast("long"))), 8, "0")
    tracks = F.concat_ws(" ", *[word(F.col("o_custkey") * 104729 * p) for p in (1, 2, 3)])
    xml = F.concat(F.lit('<ctdb><entry id="e'), (F.col("o_custkey") % 7).cast("string"), F.lit('" confidence="'), (F.col("o_orderkey") % 50).cast("string"), F.lit('" crc32="'), word(F.col("o_orderkey") * 7919), F.lit('" trackcrcs="'), tracks, F.lit('"/></ctdb>'))
    return catalogue.ctdb_entries(o.select(F.col("o_orderkey").alias("disc_id"), xml.alias("xml")))


@query("SELECT s_suppkey AS release_id, n AS ord, 'http://i/' || s_suppkey || '/' || n AS url, n = 1 AS front, CASE n WHEN 0 THEN s_suppkey ELSE 0 END::INT AS likes FROM supplier, (SELECT unnest([0, 1])::INT AS n) WHERE s_suppkey % 4 <> 0")
def image_listings(spark, d):
    """Images of cover archives; a missing listing has none."""
    url = lambda n: F.concat(F.lit("http://i/"), F.col("s_suppkey").cast("string"), F.lit(f"/{n}"))
    none = lambda t: F.lit(None).cast(t)
    item = lambda image, u, front, likes: F.struct(image.alias("image"), u.alias("url"), front.alias("front"), likes.alias("likes"))
    json = F.to_json(F.struct(F.array(item(none("string"), url(0), none("boolean"), F.col("s_suppkey").cast("int")), item(url(1), none("string"), F.lit(True), none("int"))).alias("images")))
    return catalogue.image_listing(table(spark, d, "supplier").select(F.col("s_suppkey").alias("release_id"), F.when(F.col("s_suppkey") % 4 != 0, json).alias("json")))


_FOLDER = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN (1950 + p_partkey % 60) || ' - ' ELSE '' END || 'Band' || (p_partkey % 9) || ' - ' || CASE p_partkey % 4 WHEN 1 THEN (1950 + p_partkey % 60) || ' - ' ELSE '' END || 'Song' || (p_partkey % 77) || CASE p_partkey % 4 WHEN 2 THEN ' ' || (1950 + p_partkey % 60) ELSE '' END
 || CASE p_partkey % 3 WHEN 0 THEN ' Deluxe_Edition' WHEN 1 THEN ' (2011 Remaster, Japan)' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN ' [24-96 Vinyl Rip]' WHEN 1 THEN ' ' || chr(123) || 'SACD, USA' || chr(125) WHEN 2 THEN ' [FLAC]' ELSE '' END AS name FROM {p}"""


@query("""SELECT p_partkey AS id, 'Band' || (p_partkey % 9) AS artist, 'Song' || (p_partkey % 77) || CASE WHEN p_partkey % 4 = 2 AND p_partkey % 3 = 0 THEN ' ' || (1950 + p_partkey % 60) ELSE '' END AS title,
 CASE WHEN p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_partkey % 3 <> 0) THEN (1950 + p_partkey % 60)::VARCHAR END AS year, CASE p_partkey % 3 WHEN 0 THEN 'Deluxe Edition' WHEN 1 THEN '2011 Remaster' END AS edition, CASE WHEN p_partkey % 3 = 1 THEN '2011' END AS edition_year,
 CASE p_partkey % 5 WHEN 0 THEN 'vinyl' WHEN 1 THEN 'sacd' END AS source, CASE WHEN p_partkey % 3 = 1 THEN 'JP' WHEN p_partkey % 5 = 1 THEN 'US' END AS country FROM part""")
def folder_names(spark, d):
    """Names with the year at several places, editions, media and countries; a year before an edition's words is the title's."""
    return folders.parse_folders(spark.sql(_FOLDER, p=dealt(table(spark, d, "part"), "p_partkey"))).select("id", "artist", "title", "year", "edition", "edition_year", "source", "country")


@query("SELECT p_partkey AS path, 'flac' AS container, n AS ord, CASE n WHEN 0 THEN 'TITLE' ELSE 'ARTIST' END AS field, CASE n WHEN 0 THEN p_name ELSE p_brand || ' é' END AS value FROM part, (SELECT unnest([0, 1])::INT AS n)")
def comment_tags(spark, d):
    """Tags of files composed of a stream header, a picture, a comment block and sound."""
    entry = lambda name, v: F.concat(_le(F.octet_length(_utf8(v)) + len(name) + 1), _utf8(F.concat(F.lit(name + "="), v)))
    comment = F.concat(_le(F.lit(3)), F.lit(b"abc"), _le(F.lit(2)), entry("title", F.col("p_name")), entry("Artist", F.concat("p_brand", F.lit(" é"))))
    block = lambda kind, body: F.concat(F.lit(bytes([kind])), _be(F.octet_length(body), 3), body)
    content = F.concat(F.lit(b"fLaC"), block(0, F.lit(bytes(34))), block(6, F.lit(b"\x00" * 50)), block(0x84, comment), F.lit(b"\xff\xf8sound"))
    return containers.tag_rows(table(spark, d, "part").select(F.col("p_partkey").alias("path"), content.alias("content")))


def _id3(fields: list[tuple[bytes, Column]]) -> Column:
    frames = [F.concat(F.lit(name), _be(F.octet_length(_utf8(v)) + 1, 4), F.lit(b"\x00\x00\x03"), _utf8(v)) for name, v in fields]
    body = F.concat(*frames, F.lit(bytes(16)))
    n = F.octet_length(body)
    return F.concat(F.lit(b"ID3\x03\x00\x00\x00\x00"), _be(F.shiftright(n, 7).bitwiseAND(127), 1), _be(n.bitwiseAND(127), 1), body)


@query("SELECT p_partkey AS path, CASE p_partkey % 3 WHEN 0 THEN 'id3' WHEN 1 THEN 'wav' ELSE 'aiff' END AS container, n AS ord, CASE n WHEN 0 THEN 'TIT2' ELSE 'TPE1' END AS field, CASE n WHEN 0 THEN p_name ELSE p_brand END AS value FROM part, (SELECT unnest([0, 1])::INT AS n)")
def frame_tags(spark, d):
    """Text frames of files that start with a tag, or hold it in a chunk of either byte order."""
    tag = _id3([(b"TIT2", F.col("p_name")), (b"TPE1", F.col("p_brand"))])
    n = F.octet_length(tag)
    pad = F.when(n % 2 == 1, F.lit(b"\x00")).otherwise(F.lit(b""))
    wav = F.concat(F.lit(b"RIFF\x00\x00\x00\x00WAVEfmt \x03\x00\x00\x00abc\x00id3 "), _le(n), tag, pad)
    aiff = F.concat(F.lit(b"FORM\x00\x00\x00\x00AIFFCOMM\x00\x00\x00\x02abID3 "), _be(n, 4), tag, pad)
    k = F.col("p_partkey") % 3
    return containers.tag_rows(table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(k == 0, tag).when(k == 1, wav).otherwise(aiff).alias("content")))


_LONG = lambda fields: " UNION ALL ".join(f"SELECT p_partkey AS path, '{f}' AS field, {o} AS ord, {v} AS value FROM part" for f, o, v in fields)


@query(_LONG([
    ("TITLE", 0, "p_name"), ("TRACKNUMBER", 0, "(p_partkey % 20)::VARCHAR"), ("TRACKTOTAL", 0, "'20'"), ("TOTALTRACKS", 0, "'20'"), ("DISCNUMBER", 0, "'2'"), ("DATE", 0, "CASE WHEN p_partkey % 2 = 0 THEN '1984-05-31' ELSE '1984' END"),
    ("MUSICBRAINZ_TRACKID", 0, "p_brand"), ("MUSICBRAINZ_ALBUMID", 0, "p_type"), ("PRODUCER", 0, "p_type"), ("PERFORMER", 0, "p_brand || ' (bass)'"), ("PERFORMER", 1, "p_type"), ("COMMENT", 0, "'said'"), ("STYLE", 0, "'x'"),
]))
def mapped_frames(spark, d):
    """Fields of tags with numbers, dates in two frames, people, comments and identifiers."""
    part, text = dealt(table(spark, d, "part"), "p_partkey"), lambda *v: F.concat_ws("\x00", *v)
    k, owner = F.col("p_partkey"), F.lit("http://musicbrainz.org")
    frames = [
        (b"TIT2", b"\x03", F.col("p_name")), (b"TRCK", b"\x03", F.concat((k % 20).cast("string"), F.lit("/20"))), (b"TPOS", b"\x03", F.lit("2")), (b"TYER", b"\x03", F.lit("1984")),
        (b"TDAT", b"\x03", F.when(k % 2 == 0, "3105").otherwise("odd")), (b"TYER", b"\x03", F.lit("1999")), (b"UFID", b"", text(owner, F.col("p_brand"))), (b"UFID", b"", text(F.lit("http://elsewhere"), F.col("p_name"))),
        (b"TXXX", b"\x03", text(F.lit("MusicBrainz Album Id"), F.col("p_type"))), (b"IPLS", b"\x03", text(F.lit("producer"), F.col("p_type"), F.lit("bass"), F.col("p_brand"), F.lit(""), F.col("p_type"))),
        (b"COMM", b"\x03eng", text(F.lit(""), F.lit("said"))), (b"TXXX", b"\x03", text(F.lit("Style"), F.lit("x"), F.lit("x"))),
    ]
    body = F.concat(*[F.concat(F.lit(name), _be(F.octet_length(_utf8(v)) + len(head), 4), F.lit(b"\x00\x00" + head), _utf8(v)) for name, head, v in frames], F.lit(bytes(16)))
    n = F.octet_length(body)
    content = F.concat(F.lit(b"ID3\x03\x00\x00\x00\x00"), _be(F.shiftright(n, 7).bitwiseAND(127), 1), _be(n.bitwiseAND(127), 1), body)
    return tags.mapped_fields(containers.tag_rows(part.select(k.alias("path"), content.alias("content"))))


@query(_LONG([
    ("TITLE", 0, "p_name"), ("ARTIST", 0, "p_brand"), ("ARTIST", 1, "p_type"), ("TRACKNUMBER", 0, "(p_partkey % 9 + 1)::VARCHAR"), ("TRACKTOTAL", 0, "'9'"), ("TOTALTRACKS", 0, "'9'"), ("DISCTOTAL", 0, "'3'"), ("TOTALDISCS", 0, "'3'"),
    ("COMPILATION", 0, "'1'"), ("MUSICBRAINZ_TRACKID", 0, "p_type"), ("BPM", 0, "p_size::VARCHAR"), ("GENRE", 0, "'é'"),
]))
def atom_tags(spark, d):
    """Items of MP4 files: texts of either encoding, numbers, pairs, free items of two owners, a picture, and boxes of both size forms."""
    box = lambda name, *body: F.concat(_be(F.octet_length(F.concat(*body)) + 8, 4), F.lit(name), *body)
    wide = lambda name, body: F.concat(_be(F.lit(1), 4), F.lit(name), _be(F.octet_length(body) + 16, 8), body)
    data = lambda kind, body: box(b"data", _be(F.lit(kind), 4), F.lit(bytes(4)), body)
    named = lambda mean, name, body: box(b"----", box(b"mean", F.lit(bytes(4) + mean)), box(b"name", F.lit(bytes(4) + name)), body)
    k, itunes = F.col("p_partkey"), b"com.apple.iTunes"
    items = [
        box(b"\xa9nam", data(1, _utf8(F.col("p_name")))), box(b"\xa9ART", data(1, _utf8(F.col("p_brand"))), data(1, _utf8(F.col("p_type")))), box(b"trkn", data(0, F.concat(F.lit(b"\0\0"), _be(k % 9 + 1, 2), F.lit(b"\0\x09\0\0")))),
        box(b"disk", data(0, F.lit(b"\0\0\0\0\0\3"))), box(b"cpil", data(21, F.lit(b"\1"))), box(b"covr", data(13, F.lit(bytes(300)))), named(itunes, b"MusicBrainz Track Id", data(1, _utf8(F.col("p_type")))),
        named(b"org.else", b"LABEL", data(1, F.lit(b"x"))), named(itunes, b"bpm", data(21, _be(F.col("p_size"), 4))), box(b"\xa9gen", data(2, F.encode(F.lit("é"), "UTF-16BE"))),
    ]
    meta = box(b"meta", F.lit(bytes(4)), box(b"hdlr", F.lit(bytes(25))), wide(b"ilst", F.concat(*items)))
    moov = box(b"moov", box(b"mvhd", F.lit(bytes(100))), box(b"udta", meta))
    content = F.concat(box(b"ftyp", F.lit(b"M4A \0\0\0\0")), F.when(k % 2 == 0, wide(b"mdat", F.lit(bytes(64)))).otherwise(box(b"free", F.lit(bytes(8)))), moov)
    return tags.mapped_fields(containers.tag_rows(dealt(table(spark, d, "part"), "p_partkey").select(k.alias("path"), content.alias("content"))))


@query("SELECT p_partkey AS path, 'ape' AS container, 0 AS ord, 'TITLE' AS field, p_name AS value FROM part")
def item_tags(spark, d):
    """Items of tags at the end of files, some with an older tag behind them; binary items are no tags."""
    item = lambda name, body, flags: F.concat(_le(F.octet_length(body)), _le(F.lit(flags)), F.lit(name + b"\x00"), body)
    items = F.concat(item(b"Title", _utf8(F.col("p_name")), 0), item(b"Cover", F.lit(b"\x01\x02"), 2))
    footer = F.concat(F.lit(b"APETAGEX"), _le(F.lit(2000)), _le(F.octet_length(items) + 32), _le(F.lit(2)), _le(F.lit(0)), F.lit(bytes(8)))
    old = F.when(F.col("p_partkey") % 2 == 0, F.lit(b"TAG" + bytes(125))).otherwise(F.lit(b""))
    return containers.tag_rows(table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit(b"MAC sound"), items, footer, old).alias("content")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN 'flac' END AS codec, CASE WHEN p_partkey % 6 <> 0 THEN 44100 END AS rate, CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 6)::INT END AS channels, CASE WHEN p_partkey % 6 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 24 WHEN p_partkey % 3 = 0 THEN 20 ELSE 16 END END AS bits FROM part")
def probed_streams(spark, d):
    k = F.col("p_partkey")
    s = F.struct(F.lit("flac").alias("codec_name"), F.lit("44100").alias("sample_rate"), (k % 6).cast("int").alias("channels"), F.when(k % 3 == 0, 20).otherwise(0).alias("bits_per_sample"), F.when(k % 2 == 0, "24").otherwise("N/A").alias("bits_per_raw_sample"), F.lit("3.5").alias("duration"))
    p = table(spark, d, "part").select(k.alias("id"), F.to_json(F.struct(F.array(s).alias("streams"))).alias("json"))
    f = containers.probed_stream(F.col("json"))
    return p.select("id", *[f[n].alias(n) for n in ("codec", "rate", "channels", "bits")])


@query("""SELECT s_suppkey AS disc_id, s_suppkey % 4 + 1 AS set_size, 1::BIGINT AS set_place, 'CAT-' || s_suppkey AS disc_catalogue, CASE WHEN s_suppkey % 3 <> 0 THEN '2004-01-09' END AS disc_date, CASE WHEN s_suppkey % 2 = 0 THEN '音楽' ELSE 'é x' END AS album_title, s_suppkey % 5 = 0 AS multichannel, (s_suppkey % 20)::INT AS tracks,
 CASE s_suppkey % 3 WHEN 0 THEN 'dst' WHEN 1 THEN 'dsd' ELSE 'dsd' END AS format, (s_suppkey % 70 * 60 + 5)::INT AS seconds, 544 + s_suppkey AS first_sector FROM supplier WHERE s_suppkey % 11 <> 0""")
def disc_images(spark, d):
    """Masters and areas of super audio discs, from sectors composed of their fields; images without the master's mark have no row."""
    k = F.col("s_suppkey")
    fill = lambda c, n: F.unhex(F.rpad(F.hex(c), 2 * n, "0"))
    multi = k % 5 == 0
    toc = lambda own: F.when(own, _be(F.lit(520), 4)).otherwise(_be(F.lit(0), 4))
    master = F.concat(
        F.when(k % 11 == 0, F.lit(b"NOTADISC")).otherwise(F.lit(b"SACDMTOC")), F.lit(bytes(8)), _be(k % 4 + 1, 2), _be(F.lit(1), 2), F.lit(bytes(4)), F.lit(b"ALBUM".ljust(16)), F.lit(bytes(24)), toc(~multi), F.lit(bytes(4)), toc(multi), F.lit(bytes(12)),
        fill(_utf8(F.concat(F.lit("CAT-"), k.cast("string"))), 16), F.lit(bytes(16)), _be(F.when(k % 3 == 0, 0).otherwise(2004), 2), F.lit(b"\x00\x09"), F.lit(bytes(12)), F.lit(b"en"), _be(F.when(k % 2 == 0, 3).otherwise(2), 1),
    )
    title = F.when(k % 2 == 0, F.lit("音楽".encode("shift_jis"))).otherwise(F.lit("é x".encode("latin-1")))
    texts = F.concat(F.lit(b"SACDText"), F.lit(bytes(8)), _be(F.lit(64), 2), F.lit(bytes(46)), title)
    code = F.when(k % 3 == 0, F.lit(b"\x00")).when(k % 3 == 1, F.lit(b"\x02")).otherwise(F.lit(b"\x03"))
    area = F.concat(F.when(multi, F.lit(b"MULCHTOC")).otherwise(F.lit(b"TWOCHTOC")), F.lit(bytes(13)), code, F.lit(bytes(10)), F.lit(b"\x02"), F.lit(bytes(31)), _be(k % 70, 1), F.lit(b"\x05\x00\x00"), F.lit(b"\x00"), _be(k % 20, 1), F.lit(bytes(2)), _be(k + 544, 4), _be(k + 999, 4))
    sector = lambda n, body: F.struct(F.lit(n).cast("long").alias("sector"), fill(body, images.SECTOR).alias("content"))
    rows = table(spark, d, "supplier").select(k.alias("disc_id"), F.explode(F.array(sector(510, master), sector(511, texts), sector(520, area))).alias("s")).select("disc_id", "s.sector", "s.content")
    found = images.masters(rows)
    return found.join(images.areas(rows, found), "disc_id").select("disc_id", "set_size", "set_place", "disc_catalogue", "disc_date", "album_title", "multichannel", "tracks", "format", "seconds", "first_sector")


_GENRE = "CASE WHEN {c} BETWEEN 2 AND 5 THEN ['Adult Contemporary', 'Alternative Rock', 'Children''s Music', 'Classical'][({c} - 1)::BIGINT] END"


@query(f"""WITH t AS (SELECT s_suppkey AS disc_id, unnest(range(0, s_suppkey % 20)) AS i, s_name, s_suppkey % 5 = 0 AS multichannel FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT disc_id, multichannel, (i + 1)::INT AS number, disc_id + 600 + i * 7 AS start_sector, 7::BIGINT AS sectors, (i * 60 + 9) * 75 + i AS start_frames, (60 + i) * 75 + 74 AS frames, CASE WHEN i % 3 <> 0 THEN 'JPX' || lpad((disc_id * 100 + i)::VARCHAR, 9, '0') END AS isrc,
 coalesce({_GENRE.format(c='(i % 6)')}, {_GENRE.format(c='(disc_id % 6)')}) AS genre, 'Track ' || (i + 1) AS title, CASE WHEN i % 2 = 0 THEN s_name END AS performer FROM t""")
def disc_tracks(spark, d):
    """Tracks of super audio discs from tables composed over several sectors: lists, codes over two, texts over as many as the tracks fill."""
    k, i = F.col("s_suppkey"), F.col("i")
    s = table(spark, d, "supplier")
    fill = lambda c, n: F.unhex(F.rpad(F.hex(c), 2 * n, "0"))
    each = s.withColumn("i", F.explode(F.sequence(F.lit(0), (k % 20).cast("int")))).where(i < k % 20)
    text = lambda kind, t, n: fill(F.concat(F.lit(bytes([kind, 0])), _utf8(t)), n)
    isrc = F.when(i % 3 == 0, F.lit(bytes(12))).otherwise(_utf8(F.concat(F.lit("JPX"), F.lpad((k * 100 + i).cast("string"), 9, "0"))))
    parts = {
        "starts": _be(k + 600 + i * 7, 4), "lengths": _be(F.lit(7), 4), "times": F.concat(_be(i, 1), F.lit(b"\x09"), _be(i, 1), F.lit(b"\x00")), "frames": F.concat(F.lit(b"\x01"), _be(i, 1), F.lit(bytes([74, 0]))), "isrcs": isrc,
        "genres": F.concat(F.lit(b"\x01\x00"), _be(i % 6, 2)), "places": _be(1900 + i * 84, 2), "texts": F.concat(_be(1 + (i + 1) % 2, 1), F.lit(bytes(3)), text(1, F.concat(F.lit("Track "), (i + 1).cast("string")), 12), text(2, F.col("s_name"), 68)),
    }
    run = lambda c: F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.hex(c).alias("h")))), lambda x: x["h"]), ""))
    per = s.join(each.groupBy("s_suppkey").agg(*[run(c).alias(n) for n, c in parts.items()]), "s_suppkey", "left")
    c = lambda n: F.coalesce(F.col(n), F.lit(b""))
    multi = k % 5 == 0
    toc = lambda own: F.when(own, _be(F.lit(520), 4)).otherwise(_be(F.lit(0), 4))
    mark = F.when(k % 11 == 0, F.lit(b"NOTADISC")).otherwise(F.lit(b"SACDMTOC"))
    master = F.concat(fill(mark, 64), toc(~multi), F.lit(bytes(4)), toc(multi), F.lit(bytes(28)), F.lit(b"\x01\x00"), _be(k % 6, 2), F.lit(bytes(30)), F.lit(b"\x02"))
    area = F.concat(F.when(multi, F.lit(b"MULCHTOC")).otherwise(F.lit(b"TWOCHTOC")), F.lit(bytes(2)), _be(F.lit(8), 2), F.lit(bytes(9)), F.lit(b"\x02"), F.lit(bytes(47)), _be(k % 20, 1))
    two = lambda mark, a, b: F.concat(F.lit(mark), fill(c(a), 1020), c(b))
    codes = fill(F.concat(F.lit(b"SACD_IGL"), fill(c("isrcs"), 3060), c("genres")), 4096)
    words = fill(F.concat(fill(F.concat(F.lit(b"SACDTTxt"), c("places")), 1900), c("texts")), 6144)
    piece = lambda block, n: block.substr(F.lit(n * images.SECTOR + 1), F.lit(images.SECTOR))
    held = {510: master, 520: area, 521: two(b"SACDTRL1", "starts", "lengths"), 522: two(b"SACDTRL2", "times", "frames"), 523: piece(codes, 0), 524: piece(codes, 1), 525: piece(words, 0), 526: piece(words, 1), 527: piece(words, 2)}
    sector = lambda n, body: F.struct(F.lit(n).cast("long").alias("sector"), fill(body, images.SECTOR).alias("content"))
    rows = per.select(k.alias("disc_id"), F.explode(F.array(*[sector(n, b) for n, b in held.items()])).alias("s")).select("disc_id", "s.sector", "s.content")
    found = images.masters(rows)
    tracks = images.track_tables(rows, found, images.areas(rows, found))
    return tracks.select("disc_id", "multichannel", "number", "start_sector", "sectors", "start_frames", "frames", "isrc", "genre", "title", "performer")


@query("SELECT o_orderkey AS id, 4096 AS max_block, o_custkey AS max_frame, CASE o_orderkey % 2 WHEN 0 THEN 44100 ELSE 96000 END AS sample_rate, (o_orderkey % 8 + 1)::INT AS channels, 24 AS bits, o_orderkey * 588 AS samples FROM orders")
def stream_headers(spark, d):
    """Bit fields of stream headers composed of their values."""
    k = F.col("o_orderkey")
    rate = F.when(k % 2 == 0, 44100).otherwise(96000).cast("long")
    packed = F.shiftleft(rate, 44).bitwiseOR(F.shiftleft((k % 8).cast("long"), 41)).bitwiseOR(F.lit(23 << 36).cast("long")).bitwiseOR((k * 588).cast("long"))
    block = F.concat(_be(F.lit(4096), 2), _be(F.lit(4096), 2), _be(F.lit(14), 3), _be(F.col("o_custkey"), 3), _be(packed, 8), F.lit(bytes(16)))
    f = lookups.stream_info(block)
    long = {"max_frame", "samples"}
    return table(spark, d, "orders").select(k.alias("id"), *[f[n].cast("long" if n in long else "int").alias(n) for n in ("max_block", "max_frame", "sample_rate", "channels", "bits", "samples")])


@query("SELECT p_partkey AS id, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM part")
def digests(spark, d):
    """Digests that tag writes and encoders are verified by."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha256"))


#: CRC-32 of a text of ASCII letters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({c}, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295)"""


@query(f"""WITH t AS (SELECT p_partkey // 5 AS disc_id, string_agg(p_name, '' ORDER BY p_partkey) AS t FROM part GROUP BY 1),
r AS (SELECT disc_id, 'disc' AS range_id, substr(t, 5, length(t) - 12) AS r FROM t UNION ALL SELECT disc_id, 'all', t FROM t UNION ALL SELECT disc_id, 'track', substr(t, 21, 20) FROM t)
SELECT disc_id, range_id, {_CRC.format(c='r')} AS crc, length(r)::BIGINT AS bytes FROM r WHERE length(r) > 0""")
def range_checksums(spark, d):
    """Discs whose bytes are the names of five parts, a chunk each: the whole, the disc without its trims, and a track from the middle."""
    part = table(spark, d, "part").select((F.expr("p_partkey DIV 5")).alias("disc_id"), "p_partkey", _utf8(F.col("p_name")).alias("pcm"))
    before = F.sum(F.octet_length("pcm")).over(Window.partitionBy("disc_id").orderBy("p_partkey"))
    chunks = part.select("disc_id", (before - F.octet_length("pcm")).alias("at"), "pcm")
    size = part.groupBy("disc_id").agg(F.sum(F.octet_length("pcm")).alias("size"))
    low, high = checksums.disc_range(F.lit(0), F.col("size") / checksums.SAMPLE_BYTES, 1)  # a trim of one sample, another from the end
    span = lambda name, low, high: F.struct(F.lit(name).alias("range_id"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    spans = F.array(span("all", F.lit(0), F.col("size")), span("disc", low, high - checksums.SAMPLE_BYTES), span("track", F.lit(20), F.least(F.lit(40), F.col("size"))))
    ranges = size.select("disc_id", F.explode(spans).alias("r")).select("disc_id", "r.*")
    return checksums.range_crcs(chunks, ranges)


_CELLS = "SELECT user_id % 20 AS track_id, CAST(event_id % 60 AS INT) AS frame, CAST(event_id % 12 AS INT) AS bin, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM {e} GROUP BY 1, 2, 3"
#: Every frame and bin of a track has a cell.
_GRID = "SELECT g.track_id, g.frame, g.bin, coalesce(c.value, 0) AS value FROM (SELECT t.track_id, f.frame, b.bin FROM (SELECT DISTINCT user_id % 20 AS track_id FROM {e}) t CROSS JOIN (SELECT DISTINCT CAST(event_id % 60 AS INT) AS frame FROM {e}) f CROSS JOIN (SELECT DISTINCT CAST(event_id % 12 AS INT) AS bin FROM {e}) b) g LEFT JOIN (" + _CELLS + ") c USING (track_id, frame, bin)"


@query(f"WITH g AS ({_GRID.format(e='events')}) SELECT a.track_id, a.frame, sum(b.value)::BIGINT AS area FROM (SELECT DISTINCT track_id, frame FROM g) a JOIN g b ON a.track_id = b.track_id AND b.frame BETWEEN a.frame AND a.frame + 14 AND b.bin BETWEEN 4 AND 6 WHERE a.frame + 14 <= 59 GROUP BY 1, 2")
def image_areas(spark, d):
    """Sums over rectangles of an image of 12 bins by frames, from the corners of its integral image."""
    image = prints.integral_image(spark.sql(_GRID, e=table(spark, d, "events")))
    return prints.areas(image, 4, 3, 15).select("track_id", "frame", F.col("area").cast("long").alias("area"))


def _chroma(spark, d) -> DataFrame:
    grid = spark.sql(_GRID, e=table(spark, d, "events")).groupBy("track_id", "frame").agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("c"))
    return grid.select(F.col("track_id").cast("string").alias("track_id"), "frame", F.transform("c", lambda x: x["value"].cast("double") / 1000).alias("chroma"))


@query()
def acoustic_items(spark, d):
    """Items of fingerprints, from frames of chroma."""
    return subprints.fingerprint_items(_chroma(spark, d))


@query("SELECT (user_id % 20)::VARCHAR AS track_id, 45::BIGINT AS items, 45::BIGINT AS back FROM events GROUP BY 1")
def packed_items(spark, d):
    """Fingerprints packed to bytes and unpacked again: as many items, and all the same ones."""

    @F.pandas_udf("long")
    def back(items: pd.Series) -> pd.Series:
        given = [np.array(x, np.uint32) for x in items]
        return pd.Series([int((np.asarray(prints.unpack_items(prints.pack_items(g))) == g).sum()) for g in given])

    return subprints.fingerprint_items(_chroma(spark, d)).select("track_id", F.size("items").cast("long").alias("items"), back("items").alias("back"))


@query()
def matching_segments(spark, d):
    """Stretches over which each track agrees with itself moved by ten items."""
    items = subprints.fingerprint_items(_chroma(spark, d))
    pairs = items.select(F.col("track_id").cast("long").alias("pair_id"), F.col("items").alias("left"), F.slice("items", 11, 1000).alias("right"))
    return subprints.matching_segments(pairs)


@query()
def measured_tracks(spark, d):
    """K-weighted block powers and true peaks of tones of a second, one a supplier."""
    seconds = F.sequence(F.lit(0), F.lit(47999))
    tone = F.transform(seconds, lambda i: F.sin(i * F.col("step") * 0.02) * 0.5)
    suppliers = dealt(table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40 + 1).alias("step")), "s_suppkey")
    pcm = suppliers.select(F.col("s_suppkey").cast("string").alias("track_id"), F.lit(48000).alias("sample_rate"), F.lit(0).alias("channel"), F.lit(1).alias("channels"), tone.alias("samples"))
    return loudness.measure_tracks(pcm)


@query("SELECT o_orderkey || '/f' AS path FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 7 <> 0")
def unclaimed_files(spark, d):
    """Files in no album's folder and below no excluded root."""
    o = table(spark, d, "orders").select((F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string"), F.lit("/a/"), F.col("o_orderkey").cast("string"))).alias("folder"), "o_orderkey")
    files = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("/f")).alias("path"), "folder")
    return library.unclaimed(files, o.where("o_orderkey % 3 = 0").select("folder"), spark.createDataFrame([("r0",), ("r1/b",)], "root string")).select("path")
