"""Queries on tags over the driver's tables: parts are files, their columns fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tags
from .registry import query, table

OLD = "SELECT p_partkey AS file, stack(4, 'TITLE', p_name, 'ARTIST', p_brand, 'DISCID', CASE WHEN p_partkey % 3 = 0 THEN p_type END, 'COMMENT', CASE WHEN p_partkey % 2 = 0 THEN 'x' END) AS (field, value) FROM {p}"
NEW = "SELECT p_partkey AS file, stack(4, 'TITLE', CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END, 'ARTIST', p_type, 'DATE', CASE WHEN p_partkey % 4 = 0 THEN '1984' END, 'GENRE', p_type) AS (field, value) FROM {p} WHERE p_partkey % 7 <> 0"
_OLD = " UNION ALL ".join(f"SELECT p_partkey AS file, '{f}' AS field, {v} AS value FROM part" for f, v in (("TITLE", "p_name"), ("ARTIST", "p_brand"), ("DISCID", "CASE WHEN p_partkey % 3 = 0 THEN p_type END"), ("COMMENT", "CASE WHEN p_partkey % 2 = 0 THEN 'x' END")))
_NEW = " UNION ALL ".join(f"SELECT p_partkey AS file, '{f}' AS field, {v} AS value FROM part WHERE p_partkey % 7 <> 0" for f, v in (("TITLE", "CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END"), ("ARTIST", "p_type"), ("DATE", "CASE WHEN p_partkey % 4 = 0 THEN '1984' END"), ("GENRE", "p_type")))
MERGED = f"""o AS (SELECT * FROM ({_OLD}) WHERE value IS NOT NULL), n AS (SELECT * FROM ({_NEW}) WHERE value IS NOT NULL), b AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.field, n.field) AS field, o.value AS old, n.value AS wanted FROM o FULL JOIN n ON o.file = n.file AND o.field = n.field),
m AS (SELECT file, field, old, CASE WHEN field = 'GENRE' THEN old WHEN wanted IS NOT NULL THEN wanted WHEN field = 'DISCID' AND file % 7 <> 0 THEN NULL ELSE old END AS new FROM b),
merged AS (SELECT *, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'unchanged' ELSE 'changed' END AS kind FROM m WHERE old IS NOT NULL OR new IS NOT NULL)"""


def merged(spark, d):
    part = table(spark, d, "part")
    old, new = (spark.sql(q, p=part).where("value is not null") for q in (OLD, NEW))
    return tags.merge_diff(old, new, ["DISCID"], spark.createDataFrame([("GENRE",)], "field string"))


@query(f"WITH {MERGED} SELECT file, field, old, new, kind FROM merged")
def tag_merge_diff(spark, d):
    """A merge with the genre locked and an identity field."""
    return merged(spark, d)


ALBUMS = "SELECT p_partkey AS file, p_partkey // 4 AS album_id FROM part"


def albums(spark, d):
    return spark.sql("SELECT p_partkey AS file, p_partkey DIV 4 AS album_id FROM {p}", p=table(spark, d, "part"))


@query(f"WITH {MERGED}, t AS ({ALBUMS}), c AS (SELECT album_id, count(*) AS tracks FROM t GROUP BY 1) SELECT album_id, field, old, new, kind, n, n = tracks AS album_level FROM (SELECT album_id, field, old, new, kind, count(*) AS n FROM merged JOIN t USING (file) GROUP BY ALL) JOIN c USING (album_id)")
def album_level_changes(spark, d):
    return tags.album_level(merged(spark, d), albums(spark, d))


@query(f"WITH {MERGED}, t AS ({ALBUMS}) SELECT album_id, count(DISTINCT file) FILTER (kind <> 'unchanged') AS changed_tracks, count(DISTINCT field) FILTER (kind <> 'unchanged') AS changed_fields, count(*) FILTER (kind <> 'unchanged') > 0 AS has_work FROM merged JOIN t USING (file) GROUP BY 1")
def change_counts(spark, d):
    return tags.change_counts(merged(spark, d), albums(spark, d))


_STATE = "SELECT o_custkey AS album_id, CASE WHEN o_orderkey % 9 = 0 AND o_custkey % 2 = 0 THEN NULL ELSE CASE o_orderkey % 2 WHEN 0 THEN 'AB' ELSE 'ab' END || (o_custkey % 5 + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END) END AS release_id, 'aB' || (o_custkey % 4) AS wanted_id FROM {o}"


@query(f"""WITH s AS ({_STATE.format(o='orders')}) SELECT album_id, bool_and(coalesce(lower(release_id) = lower(wanted_id), FALSE)) AS already_tagged, CASE WHEN count(release_id) = count(*) AND min(lower(release_id)) = max(lower(release_id)) THEN min(lower(release_id)) END AS existing_key FROM s GROUP BY 1""")
def release_state(spark, d):
    return tags.release_state(spark.sql(_STATE, o=table(spark, d, "orders")))


_CASES = "CASE field " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tags.ID3_FIELDS.items()) + " ELSE field END"


@query(f"WITH {MERGED} SELECT field, {_CASES} AS frame, field AS back, count(*) AS n FROM merged GROUP BY 1")
def field_map_roundtrip(spark, d):
    back = {v: k for k, v in tags.ID3_FIELDS.items()}
    f = merged(spark, d).select("field", tags.renamed(F.col("field"), tags.ID3_FIELDS).alias("frame"))
    return f.withColumn("back", tags.renamed(F.col("frame"), back)).groupBy("field", "frame", "back").agg(F.count("*").alias("n"))


@query(f"""WITH {MERGED} SELECT file, field, row_number() OVER (PARTITION BY file ORDER BY CASE field WHEN 'TITLE' THEN 1 WHEN 'ARTIST' THEN 2 WHEN 'DATE' THEN 3 ELSE 4 END, field)::INT AS ord FROM merged""")
def field_order(spark, d):
    return tags.ordered_fields(merged(spark, d), ["TITLE", "ARTIST", "DATE"]).select("file", "field", "ord")


_CREDITS = "SELECT o_orderkey AS track_id, CASE o_orderkey % 5 WHEN 0 THEN 'Guitar [Acoustic], Composer' WHEN 1 THEN 'Producer' WHEN 2 THEN 'Piano, , Mixer' WHEN 3 THEN 'Producer, producer' ELSE '' END AS role, o_orderpriority AS name FROM {o}"


@query(f"""WITH c AS ({_CREDITS.format(o='orders')}), r AS (SELECT track_id, name, lower(trim(unnest(string_split(role, ',')))) AS role FROM c),
s AS (SELECT track_id, name, trim(regexp_replace(role, '^(.*?)\\s*\\[([^\\]]*)\\]\\s*$', '\\2 \\1')) AS role FROM r WHERE role <> '')
SELECT DISTINCT track_id, CASE role WHEN 'composer' THEN 'COMPOSER' WHEN 'producer' THEN 'PRODUCER' WHEN 'mixer' THEN 'MIXER' ELSE 'PERFORMER' END AS field, CASE WHEN role IN ('composer', 'producer', 'mixer') THEN name ELSE name || ' (' || role || ')' END AS value FROM s""")
def credit_fields(spark, d):
    return tags.credit_fields(spark.sql(_CREDITS, o=table(spark, d, "orders")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS title, c_name || ' feat. ' || c_mktsegment AS artist FROM customer""")
def tag_overrides_and_artists(spark, d):
    """Container tags win over stream tags; artist credits are joined by their own phrases."""
    c = table(spark, d, "customer")
    stream, container = F.create_map(F.lit("title"), "c_name"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("Title"), "c_mktsegment")).otherwise(F.create_map(F.lit("Genre"), F.lit("x")))
    credits = F.array(F.struct(F.col("c_name").alias("name"), F.lit(" feat. ").alias("join")), F.struct(F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("join")))
    return c.select(F.col("c_custkey").alias("id"), F.element_at(tags.override_tags(stream, container), "TITLE").alias("title"), tags.joined_artist(credits).alias("artist"))


#: Roles as credits spell them, with the field and, for performers of a kind, what stands in brackets.
_SPELLED = """('composer', 'COMPOSER', NULL), ('Composed By', 'COMPOSER', NULL), ('Music By', 'COMPOSER', NULL), ('lyricist', 'LYRICIST', NULL), ('Lyrics By', 'LYRICIST', NULL), ('Words By', 'LYRICIST', NULL),
('librettist', 'LYRICIST', NULL), ('writer', 'WRITER', NULL), ('Written-By', 'WRITER', NULL), ('written by', 'WRITER', NULL), ('Songwriter', 'WRITER', NULL), ('arranger', 'ARRANGER', NULL), ('Arranged By', 'ARRANGER', NULL),
('Orchestrator', 'ARRANGER', NULL), ('orchestrated by', 'ARRANGER', NULL), ('Conductor', 'CONDUCTOR', NULL), ('conducted by', 'CONDUCTOR', NULL), ('Producer', 'PRODUCER', NULL), ('produced by', 'PRODUCER', NULL), ('Co-producer', 'PRODUCER', NULL),
('executive producer', 'PRODUCER', NULL), ('Executive-Producer', 'PRODUCER', NULL), ('engineer', 'ENGINEER', NULL), ('Recorded By', 'ENGINEER', NULL), ('recording engineer', 'ENGINEER', NULL), ('recording', 'ENGINEER', NULL),
('Mastered By', 'ENGINEER', NULL), ('mastering', 'ENGINEER', NULL), ('Mastering Engineer', 'ENGINEER', NULL), ('mixer', 'MIXER', NULL), ('Mixed By', 'MIXER', NULL), ('mix', 'MIXER', NULL), ('remixer', 'REMIXER', NULL), ('Remix', 'REMIXER', NULL),
('remixed by', 'REMIXER', NULL), ('Performer', 'PERFORMER', NULL), ('Vocals', 'PERFORMER', 'vocals'), ('Guitar [Acoustic]', 'PERFORMER', 'acoustic guitar'), ('Drums [ ]', 'PERFORMER', 'drums'), ('Bass ] [Fretless] solo', 'PERFORMER', 'bass ] [fretless] solo'),
('Engineer [Assistant]', 'PERFORMER', 'assistant engineer'), ('  Mix [] ', 'MIXER', NULL)"""
_ROLE_ROWS = "SELECT o_orderkey AS track_id, o_orderpriority AS name, o_orderkey % 41 AS a, o_custkey % 41 AS b FROM {o}"


@query(f"""WITH v AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_SPELLED}) t(role, field, kind)), o AS ({_ROLE_ROWS.format(o='orders')})
SELECT DISTINCT track_id, field, CASE WHEN kind IS NULL THEN name ELSE name || ' (' || kind || ')' END AS value FROM o JOIN v ON v.i = o.a OR v.i = o.b""")
def credit_roles(spark, d):
    """Two of all spellings of roles in each credit."""
    spelled = spark.sql(f"SELECT collect_list(role) AS roles FROM (VALUES {_SPELLED}) t(role, field, kind)")
    rows = spark.sql(_ROLE_ROWS, o=table(spark, d, "orders")).crossJoin(F.broadcast(spelled))  # one row of names
    role = F.concat(F.element_at("roles", (F.col("a") + 1).cast("int")), F.lit(", "), F.element_at("roles", (F.col("b") + 1).cast("int")))
    return tags.credit_fields(rows.select("track_id", role.alias("role"), "name"))


#: Names that containers have for fields.
_NAMES = """('id3', 'TIT2', 'TITLE'), ('id3', 'TPE1', 'ARTIST'), ('id3', 'TPE2', 'ALBUMARTIST'), ('id3', 'TALB', 'ALBUM'), ('id3', 'TSOP', 'ARTISTSORT'), ('id3', 'TSOA', 'ALBUMSORT'), ('id3', 'TSO2', 'ALBUMARTISTSORT'), ('id3', 'TSOC', 'COMPOSERSORT'),
('wav', 'TCOM', 'COMPOSER'), ('wav', 'TEXT', 'LYRICIST'), ('wav', 'TPE3', 'CONDUCTOR'), ('wav', 'TPE4', 'REMIXER'), ('wav', 'TPUB', 'LABEL'), ('wav', 'TMED', 'MEDIA'), ('aiff', 'TSRC', 'ISRC'), ('aiff', 'TCON', 'GENRE'), ('aiff', 'TSST', 'DISCSUBTITLE'),
('dff', 'TCMP', 'COMPILATION'), ('dff', 'TIT1', 'GROUPING'), ('dff', 'TIT3', 'SUBTITLE'), ('dff', 'TBPM', 'BPM'), ('dff', 'TLAN', 'LANGUAGE'), ('dsf', 'TCOP', 'COPYRIGHT'), ('dsf', 'TENC', 'ENCODEDBY'), ('dsf', 'TMOO', 'MOOD'), ('dsf', 'TOPE', 'ORIGINALARTIST'),
('dsf', 'TOAL', 'ORIGINALALBUM'), ('dsf', 'TSSE', 'ENCODERSETTINGS'), ('id3', 'MUSICBRAINZ ALBUM ID', 'MUSICBRAINZ_ALBUMID'), ('id3', 'MUSICBRAINZ ARTIST ID', 'MUSICBRAINZ_ARTISTID'), ('id3', 'MUSICBRAINZ ALBUM ARTIST ID', 'MUSICBRAINZ_ALBUMARTISTID'),
('id3', 'MUSICBRAINZ RELEASE GROUP ID', 'MUSICBRAINZ_RELEASEGROUPID'), ('id3', 'MUSICBRAINZ RELEASE TRACK ID', 'MUSICBRAINZ_RELEASETRACKID'), ('id3', 'MUSICBRAINZ WORK ID', 'MUSICBRAINZ_WORKID'), ('id3', 'MUSICBRAINZ DISC ID', 'MUSICBRAINZ_DISCID'),
('id3', 'MUSICBRAINZ ALBUM TYPE', 'RELEASETYPE'), ('id3', 'MUSICBRAINZ ALBUM STATUS', 'RELEASESTATUS'), ('id3', 'MUSICBRAINZ ALBUM RELEASE COUNTRY', 'RELEASECOUNTRY'), ('id3', 'ACOUSTID ID', 'ACOUSTID_ID'), ('id3', 'ACOUSTID FINGERPRINT', 'ACOUSTID_FINGERPRINT'),
('id3', 'CATALOGNUMBER', 'CATALOGNUMBER'), ('id3', 'BARCODE', 'BARCODE'), ('id3', 'SCRIPT', 'SCRIPT'), ('id3', 'ARTISTS', 'ARTISTS'), ('id3', 'WORK', 'WORK'), ('id3', 'WRITER', 'WRITER'), ('id3', 'ORIGINALYEAR', 'ORIGINALYEAR'), ('id3', 'DISCID', 'DISCID'),
('id3', 'STYLE', 'STYLE'), ('id3', 'OTHER NAME', 'OTHER NAME'), ('id3', 'UFID:http://elsewhere', NULL), ('id3', 'COMM', 'COMMENT'), ('id3', 'TDOR', 'ORIGINALDATE'), ('id3', 'TORY', 'ORIGINALDATE'), ('id3', 'TDRC', 'DATE'),
('ape', 'ALBUM ARTIST', 'ALBUMARTIST'), ('ape', 'YEAR', 'DATE'), ('ape', 'ORIGINAL DATE', 'ORIGINALDATE'), ('ape', 'MIXARTIST', 'REMIXER'), ('ape', 'TITLE', 'TITLE'), ('ape', 'CATALOGNUMBER', 'CATALOGNUMBER'), ('ape', 'DISCSUBTITLE', 'DISCSUBTITLE'), ('ape', 'ODD', 'ODD'),
('mp4', '©nam', 'TITLE'), ('mp4', '©ART', 'ARTIST'), ('mp4', 'aART', 'ALBUMARTIST'), ('mp4', '©alb', 'ALBUM'), ('mp4', '©day', 'DATE'), ('mp4', '©gen', 'GENRE'), ('mp4', '©wrt', 'COMPOSER'), ('mp4', '©cmt', 'COMMENT'), ('mp4', '©grp', 'GROUPING'), ('mp4', '©lyr', 'LYRICS'),
('mp4', 'soar', 'ARTISTSORT'), ('mp4', 'soaa', 'ALBUMARTISTSORT'), ('mp4', 'soal', 'ALBUMSORT'), ('mp4', 'soco', 'COMPOSERSORT'), ('mp4', 'sonm', 'TITLESORT'), ('mp4', 'MUSICBRAINZ TRACK ID', 'MUSICBRAINZ_TRACKID'), ('mp4', 'LABEL', 'LABEL'), ('flac', 'TIT2', 'TIT2')"""


@query(f"""WITH v AS (SELECT *, row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM (VALUES {_NAMES}) t(container, name, field))
SELECT p_partkey AS path, field, 0 AS ord, p_name AS value FROM part JOIN v ON v.i = p_partkey % v.n WHERE field IS NOT NULL""")
def field_names(spark, d):
    """Every name of a container in turn, as a file with that name alone."""
    names = spark.sql(f"SELECT collect_list(struct(container, name)) AS names FROM (VALUES {_NAMES}) t(container, name, field)")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("value")).crossJoin(F.broadcast(names))  # one row of names
    own = F.element_at("names", (F.col("path") % F.size("names") + 1).cast("int"))
    return tags.mapped_fields(rows.select("path", own["container"].alias("container"), F.lit(0).alias("ord"), own["name"].alias("field"), "value"))
