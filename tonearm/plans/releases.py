"""Queries on media, plans and covers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media
from .registry import query, table

_MEDIA = """SELECT o_custkey AS album_id, o_orderkey AS ord, CASE o_orderkey % 6 WHEN 0 THEN 'SACD Layer' WHEN 1 THEN 'CD Layer' WHEN 2 THEN 'CD' WHEN 3 THEN 'DVD-Video' WHEN 4 THEN NULL ELSE 'Blu-ray' END AS format, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS INT) END AS tracks FROM {o}"""
_LOCAL = "CASE album_id % 3 WHEN 0 THEN 'sacd' WHEN 1 THEN 'cd' ELSE 'hiRes' END"


def media_arrays(spark, d):
    m = spark.sql(_MEDIA, o=table(spark, d, "orders"))
    a = m.groupBy("album_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("position"), "format", "tracks"))).alias("media"))
    return a.withColumn("local", F.expr(_LOCAL))


M = f"""m AS (SELECT *, lower(coalesce(format, '')) LIKE '%dvd%' OR lower(coalesce(format, '')) LIKE '%blu-ray%' AS video, coalesce(format, '') LIKE '%Layer%' AS layer, {_LOCAL} AS local FROM ({_MEDIA.format(o='orders')})),
v AS (SELECT *, bool_and(video) OVER (PARTITION BY album_id) AS all_video FROM m), k AS (SELECT * FROM v WHERE NOT video OR all_video),
l AS (SELECT *, row_number() OVER (PARTITION BY album_id, layer ORDER BY CASE WHEN (local = 'sacd' AND format = 'SACD Layer') OR (local = 'cd' AND format = 'CD Layer') THEN 0 ELSE 1 END, ord) AS r FROM k)"""


@query(f"WITH {M} SELECT album_id, string_agg(ord, ',' ORDER BY layer, ord) AS media FROM l WHERE NOT layer OR r = 1 GROUP BY 1")
def relevant_media(spark, d):
    a = media_arrays(spark, d)
    return a.select("album_id", F.array_join(F.transform(media.relevant_media(F.col("media"), F.col("local")), lambda m: m["position"].cast("string")), ",").alias("media"))


@query(f"WITH m AS ({_MEDIA.format(o='orders')}), r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY ord) AS p FROM m) SELECT album_id, count(*) FILTER (album_id % 2 = 0 OR p = 1 OR p = 3) AS paired FROM r GROUP BY 1")
def paired_media(spark, d):
    """Sets (odd albums) have the first and third disc."""
    a = media_arrays(spark, d)
    p = media.paired_media(F.col("media"), F.col("album_id") % 2 == 1, F.array(F.lit(1), F.lit(3)))
    return a.select("album_id", F.size(p).cast("long").alias("paired"))


@query(f"""WITH {M}, t AS (SELECT album_id, sum(coalesce(tracks, 0)) AS total, sum(coalesce(tracks, 0)) FILTER (video) AS video, coalesce(sum(tracks) FILTER (NOT layer), 0) AS others FROM m GROUP BY 1),
n AS (SELECT album_id, total AS n FROM t UNION SELECT album_id, total - video FROM t WHERE video > 0 AND total > video UNION SELECT album_id, tracks FROM m WHERE layer AND tracks IS NOT NULL UNION SELECT album_id, tracks + others FROM m JOIN t USING (album_id) WHERE layer AND tracks IS NOT NULL)
SELECT album_id, string_agg(n, ',' ORDER BY n) AS counts FROM n GROUP BY 1""")
def plausible_track_counts(spark, d):
    a = media_arrays(spark, d)
    total = F.aggregate("media", F.lit(0), lambda s, m: s + F.coalesce(m["tracks"], F.lit(0)))
    return a.select("album_id", F.array_join(F.transform(media.plausible_counts(F.col("media"), total), lambda n: n.cast("string")), ",").alias("counts"))


_FILES = "SELECT l_orderkey AS album_id, l_linenumber AS disc, count(*) AS files FROM {l} WHERE l_linenumber <= 3 GROUP BY 1, 2"
_DISCS = "SELECT l_orderkey AS album_id, l_linenumber AS disc, count(*) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS tracks FROM {l} WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY 1, 2"


@query(f"""WITH f AS ({_FILES.format(l='lineitem')}), m AS ({_DISCS.format(l='lineitem').replace("GROUP BY 1, 2", "GROUP BY l_orderkey, l_linenumber")}), n AS (SELECT album_id, count(*) AS discs FROM m GROUP BY 1)
SELECT * FROM (SELECT coalesce(f.album_id, m.album_id) AS album_id, coalesce(f.disc, m.disc) AS disc, CASE WHEN tracks IS NULL THEN 'no such disc' WHEN files IS NULL THEN CASE WHEN discs > 1 THEN 'missing' END WHEN files <> tracks THEN 'count differs' END AS warning
 FROM f FULL JOIN m ON f.album_id = m.album_id AND f.disc = m.disc LEFT JOIN n ON n.album_id = coalesce(f.album_id, m.album_id)) WHERE warning IS NOT NULL""")
def plan_warnings(spark, d):
    l = table(spark, d, "lineitem")
    return media.plan_warnings(spark.sql(_FILES, l=l), spark.sql(_DISCS, l=l))


_SCORED = "SELECT o_custkey AS album_id, o_orderkey AS candidate_id, CAST(o_orderkey % 71 AS DOUBLE) AS score, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS DOUBLE) / 13 END AS distance, o_orderkey % 3 <> 0 AS proves_audio, o_orderkey % 4 AS twin_key, o_orderkey % 2 = 0 AS proven, o_custkey % 3 + o_orderkey % 7 // 6 AS group_id, o_orderkey % 37 = 0 AS is_sacd_edition, o_orderkey % 4 <> 2 AS numbered FROM {o}"


def scored(spark, d):
    return spark.sql(_SCORED.replace("o_orderkey % 7 // 6", "o_orderkey % 7 DIV 6"), o=table(spark, d, "orders"))


@query(f"""WITH s AS ({_SCORED.format(o='orders')}), a AS (SELECT *, max(score) OVER w - score < 30 AS close, row_number() OVER (PARTITION BY album_id ORDER BY score DESC, candidate_id) AS place FROM s WINDOW w AS (PARTITION BY album_id)),
b AS (SELECT *, count(*) FILTER (close) OVER w AS n, count(*) FILTER (close AND proves_audio) OVER w AS p, score + CASE WHEN close AND place <= 6 THEN CASE WHEN distance < 0.35 THEN 30 WHEN distance < 0.6 THEN 15 ELSE 0 END ELSE 0 END AS total FROM a WINDOW w AS (PARTITION BY album_id)),
c AS (SELECT * FROM b WHERE n > 1 AND p > 0), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY total DESC, candidate_id) AS r FROM c WHERE close AND place <= 6) WHERE r = 1),
v AS (SELECT t.album_id, max(c.total) AS rival FROM t JOIN c ON c.album_id = t.album_id AND c.candidate_id <> t.candidate_id AND c.twin_key <> t.twin_key GROUP BY 1)
SELECT t.album_id, t.candidate_id FROM t LEFT JOIN v USING (album_id) WHERE t.proves_audio AND t.total - coalesce(v.rival, 0) >= 30""")
def cover_tie_break(spark, d):
    return media.cover_tie_break(scored(spark, d))


@query(f"""WITH s AS ({_SCORED.format(o='orders')}), a AS (SELECT *, bool_or(is_sacd_edition) OVER (PARTITION BY album_id) AS sacd FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY score DESC, candidate_id) AS r FROM a WHERE proven AND NOT sacd),
f AS (SELECT album_id, score AS top, group_id AS grp FROM p WHERE r = 1), k AS (SELECT p.*, f.grp FROM p JOIN f USING (album_id) WHERE f.top - p.score < 30), g AS (SELECT album_id FROM k GROUP BY 1 HAVING bool_and(group_id = grp))
SELECT album_id, candidate_id FROM (SELECT k.album_id, k.candidate_id, row_number() OVER (PARTITION BY k.album_id ORDER BY numbered DESC, score DESC, candidate_id) AS n FROM k JOIN g USING (album_id)) WHERE n = 1""")
def album_only_pick(spark, d):
    return media.album_only_pick(scored(spark, d))


_RELEASES = "SELECT p_partkey AS release_id, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN 'Various Artists' ELSE p_brand END AS artist, CASE WHEN p_partkey % 3 = 0 THEN '1959-08-17' END AS first_release, CASE WHEN p_partkey % 2 = 0 THEN '1984-01-01' END AS released, '1983' AS year, p_type AS type, CAST(p_partkey % 3 AS INT) AS discs, p_brand AS label, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '123' END AS barcode, 'JP' AS country, 'Official' AS status FROM {p}"
_TAGS = {"ALBUM": "title", "ALBUMARTIST": "artist", "ORIGINALDATE": "first_release", "ORIGINALYEAR": "left(first_release, 4)", "RELEASETYPE": "lower(type)", "DISCTOTAL": "greatest(1, discs)::VARCHAR", "COMPILATION": "CASE WHEN artist = 'Various Artists' THEN '1' END", "DATE": "coalesce(released, year)", "LABEL": "label", "BARCODE": "barcode", "RELEASECOUNTRY": "country", "RELEASESTATUS": "lower(status)"}


@query(f"WITH r AS ({_RELEASES.format(p='part')}), t AS ({' UNION ALL '.join(f'''SELECT release_id, '{f}' AS field, {v} AS value FROM r''' for f, v in _TAGS.items())}) SELECT * FROM t WHERE value <> ''")
def album_tags(spark, d):
    return media.album_tags(spark.sql(_RELEASES, p=table(spark, d, "part")))


@query("""WITH f AS (SELECT c_nationkey AS folder, c_name AS name FROM customer), r AS (SELECT c_nationkey AS folder, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN 'sub/' || c_name ELSE 'none' || c_custkey END AS ref FROM customer)
SELECT r.folder, r.ref, coalesce(max(CASE WHEN f.name = r.ref THEN f.name END), min(f.name)) AS found FROM r LEFT JOIN f ON f.folder = r.folder AND lower(f.name) = lower(r.ref) AND NOT contains(r.ref, '/') GROUP BY 1, 2""")
def referenced_files(spark, d):
    c = table(spark, d, "customer")
    refs = spark.sql("SELECT c_nationkey AS folder, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN 'sub/' || c_name ELSE 'none' || c_custkey END AS ref FROM {c}", c=c)
    return media.referenced_files(refs, c.select(F.col("c_nationkey").alias("folder"), F.col("c_name").alias("name")))


_RELATIONS = "SELECT o_custkey AS recording_id, CASE o_orderkey % 7 WHEN 0 THEN 'instrument' WHEN 1 THEN 'vocal' WHEN 2 THEN 'Mix' WHEN 3 THEN 'recording' WHEN 4 THEN 'producer' WHEN 5 THEN 'composer' ELSE 'conductor' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'guest,piano,solo' WHEN 1 THEN 'additional' ELSE 'lead,high' END AS a, o_orderpriority AS name FROM {o}"


@query(f"""WITH r AS ({_RELATIONS.format(o='orders')}), x AS (SELECT *, array_to_string(list_filter(string_split(a, ','), lambda s: s NOT IN ('additional', 'guest', 'solo')), ', ') AS attrs FROM r)
SELECT DISTINCT recording_id, CASE lower(type) WHEN 'instrument' THEN coalesce(nullif(attrs, ''), 'performer') WHEN 'vocal' THEN coalesce(nullif(attrs, ''), 'vocals') WHEN 'mix' THEN 'mixer' WHEN 'recording' THEN 'recording engineer' ELSE type END AS role, name FROM x WHERE type <> 'composer'""")
def relationship_credits(spark, d):
    r = spark.sql(_RELATIONS, o=table(spark, d, "orders"))
    return media.relationship_credits(r.withColumn("attributes", F.split("a", ",")))


@query("""WITH i AS (SELECT o_custkey AS release_id, o_orderkey AS image_id, ['obi', 'front', 'back', 'medium', 'booklet', 'other', 'discogs'][o_orderkey % 7 + 1] AS kind FROM orders)
SELECT release_id, image_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY list_position(['obi', 'front', 'back', 'medium', 'booklet', 'other', 'discogs'], kind), image_id) AS r FROM i) WHERE r = 1""")
def preferred_picture(spark, d):
    kinds = F.array(*[F.lit(p) for p in media.PICTURES])
    return media.preferred_picture(table(spark, d, "orders").select(F.col("o_custkey").alias("release_id"), F.col("o_orderkey").alias("image_id"), F.element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("kind")))


@query("""WITH k AS (SELECT c_custkey AS path, ['scanned', 'error', 'done', 'review'][c_custkey % 4 + 1] AS state FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT c_custkey AS path FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(k.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'error' WHEN state IS NULL OR state IN ('scanned', 'error') THEN 'scanned' ELSE state END AS state FROM k FULL JOIN s ON k.path = s.path""")
def rescan(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.element_at(F.array(*[F.lit(s) for s in ("scanned", "error", "done", "review")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("state"))
    return media.rescan(c.where("path % 5 <> 0"), c.where("path % 3 <> 0").select("path"))


_HINTS = "SELECT o_orderkey AS album_id, CASE WHEN o_orderkey % 3 = 0 THEN 'T' END AS tag_artist, CASE WHEN o_orderkey % 2 = 0 THEN 'C' END AS cue_artist, 'F' AS folder_artist, CASE WHEN o_orderkey % 5 = 0 THEN 'TA' END AS tag_album, CASE WHEN o_orderkey % 7 = 0 THEN 'CA' END AS cue_album, CASE WHEN o_orderkey % 11 = 0 THEN 'Stereo' ELSE 'FA' END AS folder_album, 'PA' AS parent_album, CASE WHEN o_orderkey % 2 = 1 THEN CAST(1990 + o_orderkey % 3 AS STRING) || '-01' END AS tag_date, CASE WHEN o_orderkey % 3 = 1 THEN '1991' END AS tag_original, CASE WHEN o_orderkey % 4 = 0 THEN '1970' END AS cue_date, '1960' AS folder_year, CASE WHEN o_orderkey % 13 = 0 THEN '2000' END AS folder_edition_year FROM {o}"


@query(f"""WITH h AS ({_HINTS.format(o='orders')}) SELECT album_id, coalesce(tag_artist, cue_artist, folder_artist) AS artist, coalesce(tag_album, cue_album, CASE WHEN folder_album = 'Stereo' THEN parent_album ELSE folder_album END) AS album,
 coalesce(left(tag_original, 4), left(tag_date, 4), left(cue_date, 4), folder_year) AS year, CASE WHEN left(tag_date, 4) <> left(tag_original, 4) THEN left(tag_date, 4) ELSE folder_edition_year END AS edition_year FROM h""")
def signal_hints(spark, d):
    return media.signal_hints(spark.sql(_HINTS, o=table(spark, d, "orders")))


@query("""SELECT o_orderkey AS album_id, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 7 END, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END) AS chosen, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 7 END, CASE WHEN o_orderkey % 4 >= 2 THEN o_custkey END) AS selected FROM orders""")
def chosen_candidate(spark, d):
    a = spark.sql("SELECT o_orderkey AS album_id, CASE WHEN o_orderkey % 5 = 0 THEN CAST(7 AS BIGINT) END AS choice, o_orderkey % 2 = 0 AS is_confident, o_orderkey % 4 AS confidence_rank, o_custkey AS best_id FROM {o}", o=table(spark, d, "orders"))
    return media.chosen_candidate(a)


@query("""SELECT o_custkey AS album_id, count(DISTINCT 'x/' || (o_orderkey % (o_custkey % 2 + 1))) AS folders, count(DISTINCT o_orderkey % (o_custkey % 2 + 1)) = 1 AS follows FROM orders GROUP BY 1""")
def move_plan(spark, d):
    return media.move_plan(table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), F.expr("'x/' || (o_orderkey % (o_custkey % 2 + 1)) || '/f' || o_orderkey").alias("target")))
