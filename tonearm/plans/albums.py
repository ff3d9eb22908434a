"""Queries on albums of a library: files on releases, sets, states, order, and the identification plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import albums, evidence
from .registry import query, table
from .tagging import MERGED, NEW, OLD

_KEYS = "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'discogs' ELSE 'other' END AS source, 'Ab' || s_suppkey AS provider_id, 'own:' || s_suppkey AS own_id FROM {s}"


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'mb:ab' || s_suppkey WHEN 1 THEN 'discogs:Ab' || s_suppkey ELSE 'own:' || s_suppkey END AS release_key FROM supplier")
def release_keys(spark, d):
    return spark.sql(_KEYS, s=table(spark, d, "supplier")).select("id", albums.release_key(F.col("source"), F.col("provider_id"), F.col("own_id")).alias("release_key"))


_PAD = "regexp_replace(regexp_replace({x}, '[0-9]+', '000000000000\\0', 'g'), '0*([0-9]{{12}})', '\\1', 'g') COLLATE C"


@query(f"SELECT p_partkey AS album_id, row_number() OVER (ORDER BY p_partkey % 50 DESC, {_PAD.format(x='lower(p_brand || p_partkey % 100)')}, p_partkey)::INT AS place FROM part")
def queue_places(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("album_id"), (F.col("p_partkey") % 50).alias("added_at"), F.concat("p_brand", (F.col("p_partkey") % 100).cast("string")).alias("title"))
    return albums.queue_order(a).select("album_id", F.col("place").cast("int").alias("place"))


_FILES = "SELECT DISTINCT l_orderkey AS member, l_orderkey || '/' || l_linenumber AS path, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber % 2 + 1 AS INT) ELSE 1 END AS disc, CAST(l_linenumber AS INT) AS ord FROM {l}"
_MEMBERS = "SELECT o_orderkey AS member, o_custkey AS album_id, CAST(o_orderkey % 5 + 1 AS INT) AS position FROM {o}"
_TRACKS = "SELECT album_id, disc, track, 'T' || track AS title, album_id * 100 + disc * 10 + track AS recording_id FROM (SELECT DISTINCT o_custkey AS album_id, CAST(o_orderkey % 5 + 1 AS INT) AS disc FROM {o}) {cross}"
PLACED = f"""f AS ({_FILES.format(l='lineitem')}), m AS ({_MEMBERS.format(o='orders')}), n AS (SELECT member, count(DISTINCT disc) AS discs FROM f GROUP BY 1),
placed AS (SELECT m.album_id, f.path, CASE WHEN n.discs > 1 THEN f.disc ELSE m.position END AS disc, (row_number() OVER (PARTITION BY f.member, f.disc ORDER BY f.ord, f.path) - 1)::INT AS track, f.member AS owner FROM f JOIN m USING (member) JOIN n USING (member))"""
ON_RELEASE = f"""{PLACED}, t AS ({_TRACKS.format(o='orders', cross='CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS track)')}), ti AS (SELECT *, (row_number() OVER (PARTITION BY album_id ORDER BY disc, track) - 1)::INT AS album_index FROM t),
on_release AS (SELECT album_id, disc, track, path, owner, title, recording_id, album_index FROM placed JOIN ti USING (album_id, disc, track))"""


def placed(spark, d):
    return albums.place_files(spark.sql(_FILES, l=table(spark, d, "lineitem")), spark.sql(_MEMBERS, o=table(spark, d, "orders")))


def on_release(spark, d):
    tracks = spark.sql(_TRACKS.replace("{cross}", "LATERAL VIEW explode(array(0, 1, 2)) AS track"), o=table(spark, d, "orders"))
    return albums.release_tracks_of(placed(spark, d), tracks)


@query(f"WITH {PLACED} SELECT album_id, path, disc, track, owner FROM placed")
def file_places(spark, d):
    return placed(spark, d)


@query(f"WITH {ON_RELEASE} SELECT path, title, recording_id::BIGINT AS recording_id, album_index FROM on_release")
def release_track_files(spark, d):
    return on_release(spark, d).select("path", "title", "recording_id", "album_index")


_RELEASES = "SELECT c_custkey AS album_id, 'r' || c_custkey AS release_id, CAST(c_custkey % 4 * 3 AS INT) AS track_count, CASE WHEN c_custkey % 5 = 0 THEN 'r' || c_custkey ELSE 'd' || c_custkey END AS other_id, 6 AS other_count FROM {c}"
_OTHERS = "SELECT 'd' || c_custkey AS other_id, CAST(c_custkey % 3 AS INT) AS album_index, 'Producer' AS role, c_name AS name FROM {c}"


@query(f"WITH {ON_RELEASE}, r AS ({_RELEASES.format(c='customer')}), x AS ({_OTHERS.format(c='customer')}) SELECT p.path, x.role, x.name FROM on_release p JOIN r USING (album_id) JOIN x ON x.other_id = r.other_id AND x.album_index = p.album_index WHERE r.other_id <> r.release_id AND (track_count = 0 OR track_count = other_count)")
def secondary_credits(spark, d):
    """Credits of another catalogue where its release has as many tracks."""
    c = table(spark, d, "customer")
    return albums.secondary_credits(on_release(spark, d), spark.sql(_RELEASES, c=c), spark.sql(_OTHERS, c=c))


@query(f"WITH {PLACED}, r AS (SELECT o_custkey AS album_id, o_orderkey || '/' || (o_orderkey % 9) AS path, -o_custkey AS leader FROM orders) SELECT r.album_id, r.path, coalesce(o.owner, r.leader) AS owner FROM r LEFT JOIN (SELECT path, min(owner) AS owner FROM placed GROUP BY 1) o USING (path)")
def owned_reports(spark, d):
    """Reports on files with the member that owns each; unknown files fall to the leader."""
    r = spark.sql("SELECT o_custkey AS album_id, o_orderkey || '/' || (o_orderkey % 9) AS path, -o_custkey AS leader FROM {o}", o=table(spark, d, "orders"))
    return albums.owned(r, placed(spark, d)).select("album_id", "path", "owner")


_DISCS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 4 AS INT) END AS set_size, CAST(p_partkey % 3 + 1 AS INT) AS set_place, CAST(p_partkey % 2 + 1 AS INT) AS discs, CASE WHEN p_partkey % 7 < 4 THEN p_brand || ' (CD ' || (p_partkey % 7 + 1) || ' of 4)' ELSE p_brand END AS name, 'Own ' || p_brand AS title FROM {p}"


@query(f"""WITH d AS ({_DISCS.format(p='part')}), e AS (SELECT *, coalesce(set_size > 1, FALSE) AS own, id % 7 < 4 AS named FROM d) SELECT id, CASE WHEN own THEN set_place WHEN discs <= 1 AND named THEN (id % 7 + 1)::INT END AS number, CASE WHEN own THEN set_size WHEN discs <= 1 AND named THEN 4 END AS total,
CASE WHEN own THEN title ELSE regexp_replace(name, ' \\(CD.*', '') END AS base FROM e""")
def disc_positions(spark, d):
    rows = spark.sql(_DISCS, p=table(spark, d, "part"))
    number, total = albums.disc_position(F.col("set_size"), F.col("set_place"), F.col("discs"), F.col("name"))
    return rows.select("id", number.alias("number"), total.alias("total"), albums.set_base(F.col("set_size"), F.col("title"), F.col("name")).alias("base"))


@query(f"WITH {MERGED.replace(chr(39) + 'GENRE' + chr(39) + ' THEN old', chr(39) + 'ARTIST' + chr(39) + ' THEN old')} SELECT file, field, old, new, kind FROM merged")
def relocked_tags(spark, d):
    """The merge again after the lock was taken from one field and put on another."""
    part = table(spark, d, "part")
    old, new = (spark.sql(q, p=part).where("value is not null") for q in (OLD, NEW))
    fields = lambda *f: spark.createDataFrame([(x,) for x in f], "field string")
    return albums.relocked(old, new, ["DISCID"], fields("GENRE"), fields("GENRE", "ARTIST"))[0]


_SAMPLES = "SELECT DISTINCT l_orderkey AS album_id, CAST(l_linenumber AS INT) AS ord, l_linenumber * 588 * (l_orderkey % 50 + 1) + CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN 1 ELSE 0 END AS samples, CASE WHEN l_orderkey % 13 = 0 THEN 44101 ELSE 44100 END AS rate FROM {l}"


@query(f"""WITH s AS ({_SAMPLES.format(l='lineitem')}), g AS (SELECT album_id, bool_and(rate % 75 = 0 AND samples % 588 = 0) AS ok, string_agg((samples // 588)::BIGINT::VARCHAR, ',' ORDER BY ord) AS f FROM s GROUP BY 1)
SELECT album_id, CASE WHEN ok THEN f ELSE '' END AS frames, CASE WHEN NOT ok THEN 'not frame aligned' END AS problem FROM g""")
def whole_frames(spark, d):
    f = albums.whole_frames(spark.sql(_SAMPLES, l=table(spark, d, "lineitem")))
    return f.select("album_id", F.coalesce(F.array_join(F.transform("frames", lambda n: n.cast("string")), ","), F.lit("")).alias("frames"), "problem")


_PICTURES = "SELECT o_custkey AS release_id, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_primary FROM {o}"


@query(f"WITH i AS ({_PICTURES.format(o='orders')}) SELECT release_id, ord, row_number() OVER (PARTITION BY release_id ORDER BY coalesce(is_primary, FALSE) DESC, ord)::INT AS place FROM i")
def primary_images(spark, d):
    return albums.primary_first(spark.sql(_PICTURES, o=table(spark, d, "orders"))).select("release_id", "ord", "place")


_STEPS = "SELECT user_id AS album_id, event_id AS ord, CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'scanning' WHEN 2 THEN 'scanned' WHEN 3 THEN 'identifying' WHEN 4 THEN 'confident' WHEN 5 THEN 'needsReview' WHEN 6 THEN 'applying' WHEN 7 THEN 'done' ELSE 'error' END AS state FROM {e}"
_ALLOWED = ", ".join(f"'{a} {b}'" for a, to in albums.STATES.items() for b in to)


@query(f"""WITH s AS ({_STEPS.format(e='events')}), b AS (SELECT *, lag(state) OVER (PARTITION BY album_id ORDER BY ord) AS before FROM s)
SELECT album_id, ord, state, CASE WHEN before IS NULL THEN state = 'pending' WHEN state = 'error' THEN TRUE ELSE (before || ' ' || state) IN ({_ALLOWED}) END AS allowed FROM b""")
def lifecycle_steps(spark, d):
    return albums.lifecycle(spark.sql(_STEPS, e=table(spark, d, "events"))).select("album_id", "ord", "state", "allowed")


_SCANS = "SELECT o_orderkey AS root, o_orderkey % 100 AS started, CASE WHEN o_orderkey % 3 = 0 THEN 100 END AS finished, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 110 END AS last_seen FROM {o}"


@query(f"SELECT root, finished IS NULL AND 110 - greatest(started, coalesce(last_seen, started)) > 15 AS stalled FROM ({_SCANS.format(o='orders')})")
def stalled_scans(spark, d):
    return albums.stalled(spark.sql(_SCANS, o=table(spark, d, "orders")), F.lit(110)).select("root", "stalled")


@query("""WITH s AS (SELECT o_orderkey AS id, list_distinct([o_orderkey % 3, o_orderkey % 5, o_orderkey % 7]) AS a, list_distinct([o_custkey % 4, o_custkey % 6 + 2]) AS b FROM orders)
SELECT id, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, NOT list_has_any(a, b) AS disjoint, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_ours FROM s""")
def code_sets(spark, d):
    s = spark.sql("SELECT o_orderkey AS id, array(o_orderkey % 3, o_orderkey % 5, o_orderkey % 7) AS ours, array(o_custkey % 4, o_custkey % 6 + 2) AS theirs FROM {o}", o=table(spark, d, "orders"))
    flat = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), ",")
    r = albums.code_sets(s)
    return r.select("id", flat("common").alias("common"), "disjoint", flat("only_ours").alias("only_ours"))


_SET = """SELECT o_orderkey AS album_id, o_orderpriority || ' ' || (o_orderkey % 12) AS title, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 6 + 1 AS INT) END AS disc, CASE WHEN o_orderkey % 8 = 0 THEN 9 END AS declared, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 400 END AS set_id,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 4 + 1 AS INT) END AS position, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS total, CASE o_orderkey % 4 WHEN 0 THEN 'confident' WHEN 1 THEN 'needsReview' WHEN 2 THEN 'done' ELSE 'scanned' END AS state, o_orderkey % 4 <> 3 AS identified FROM {o}"""
_BACK = "CASE WHEN {c} AND identified AND state IN ('confident', 'needsReview') THEN 'scanned' ELSE state END AS state, identified AND NOT {c} AS identified"


@query(f"""WITH a AS ({_SET.format(o='orders')}), r AS (SELECT a.*, CASE WHEN album_id % 6 = 1 THEN 1000 + album_id % 700 END AS new_set FROM a), w AS (SELECT *, count(*) OVER p AS n, coalesce(disc, row_number() OVER (PARTITION BY new_set ORDER BY disc NULLS LAST, {_PAD.format(x='lower(title)')}, album_id))::INT AS np FROM r WHERE new_set IS NOT NULL WINDOW p AS (PARTITION BY new_set)),
t AS (SELECT *, n > 1 AS g, greatest(coalesce(max(declared) OVER p, 0), max(np) OVER p, n)::INT AS nt FROM w WINDOW p AS (PARTITION BY new_set))
SELECT album_id, CASE WHEN g THEN new_set ELSE set_id END AS set_id, CASE WHEN g THEN np ELSE position END AS position, CASE WHEN g THEN nt ELSE total END AS total, {_BACK.format(c='g')} FROM t
UNION ALL SELECT album_id, set_id, position, total, state, identified FROM r WHERE new_set IS NULL""")
def grouped_sets(spark, d):
    """Albums of which some are made sets."""
    a = spark.sql(_SET, o=table(spark, d, "orders"))
    chosen = a.where("album_id % 6 = 1").select("album_id", (F.col("album_id") % 700 + 1000).alias("new_set"))
    return albums.group_albums(a, chosen).select("album_id", "set_id", "position", "total", "state", "identified")


@query(f"""WITH a AS ({_SET.format(o='orders')}), g AS (SELECT *, coalesce(set_id % 3 = 0, FALSE) AS gone FROM a) SELECT album_id, CASE WHEN NOT gone THEN set_id END AS set_id, CASE WHEN NOT gone THEN position END AS position, CASE WHEN NOT gone THEN total END AS total, {_BACK.format(c='gone')} FROM g""")
def ungrouped_sets(spark, d):
    a = spark.sql(_SET, o=table(spark, d, "orders"))
    return albums.ungroup_albums(a, a.where("set_id % 3 = 0").select("set_id")).select("album_id", "set_id", "position", "total", "state", "identified")


@query(f"""WITH a AS ({_SET.format(o='orders')}), m AS (SELECT *, CASE WHEN album_id % 7 = 0 AND album_id % 9 >= 1 THEN (album_id % 9)::INT END AS dest FROM a), p AS (SELECT *, coalesce(dest, position) AS np FROM m)
SELECT album_id, np AS position, CASE WHEN set_id IS NOT NULL AND bool_or(dest IS NOT NULL) OVER (PARTITION BY set_id) THEN greatest(max(np) OVER (PARTITION BY set_id), coalesce(total, 0))::INT ELSE total END AS total FROM p""")
def repositioned(spark, d):
    a = spark.sql(_SET, o=table(spark, d, "orders"))
    moves = a.where("album_id % 7 = 0").select("album_id", (F.col("album_id") % 9).cast("int").alias("to"))
    return albums.reposition(a, moves).select("album_id", "position", "total")


@query(f"""WITH a AS ({_SET.format(o='orders')}), q AS (SELECT set_id, min(album_id) AS k FROM a WHERE set_id IS NOT NULL GROUP BY 1), l AS (SELECT min(album_id) AS album_id, album_id % 400 AS to_set FROM a WHERE set_id IS NULL AND album_id % 400 IN (SELECT set_id FROM q) GROUP BY album_id % 400),
j AS (SELECT a.*, l.to_set, coalesce(l.to_set, a.set_id) AS sid FROM a LEFT JOIN l USING (album_id)), p AS (SELECT *, CASE WHEN to_set IS NOT NULL THEN coalesce(disc, coalesce(max(CASE WHEN to_set IS NULL THEN position END) OVER (PARTITION BY sid), 0) + 1) ELSE position END AS np FROM j),
c AS (SELECT *, sid IS NOT NULL AND bool_or(to_set IS NOT NULL) OVER (PARTITION BY sid) AS ch, greatest(coalesce(max(declared) OVER (PARTITION BY sid), 0), max(np) OVER (PARTITION BY sid), count(*) OVER (PARTITION BY sid))::INT AS nt FROM p)
SELECT album_id, sid AS set_id, np::INT AS position, CASE WHEN ch THEN nt ELSE total END AS total, {_BACK.format(c='ch')} FROM c""")
def joined_sets(spark, d):
    """Late discs that join a set."""
    a = spark.sql(_SET, o=table(spark, d, "orders"))
    known = a.where("set_id is not null").select(F.col("set_id").alias("to_set")).distinct()
    late = a.where("set_id is null").groupBy((F.col("album_id") % 400).alias("to_set")).agg(F.min("album_id").alias("album_id")).join(known, "to_set", "left_semi")
    return albums.join_set(a, late.select("album_id", "to_set")).select("album_id", "set_id", "position", "total", "state", "identified")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE CASE c_custkey % 6 WHEN 0 THEN 'é' WHEN 1 THEN '音楽' WHEN 2 THEN 'é日本' WHEN 3 THEN 'é' ELSE 'plain' END || ' ' || c_mktsegment END AS text FROM customer")
def disc_texts(spark, d):
    """Texts in the encodings of a disc's character set codes, with what follows a zero byte."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.expr("CASE c_custkey % 6 WHEN 0 THEN 'é' WHEN 1 THEN '音楽' WHEN 2 THEN 'é日本' WHEN 3 THEN 'é' ELSE 'plain' END"), F.lit(" "), "c_mktsegment").alias("t"), "c_mktsegment")
    k = F.col("c_custkey") % 6
    music = F.lit("音楽 ".encode("shift_jis"))
    raw = F.when(k == 0, F.encode("t", "ISO-8859-1")).when(k == 1, F.concat(music, F.encode("c_mktsegment", "UTF-8"))).when(k == 3, F.encode("t", "ISO-8859-1")).when(k == 5, F.lit(b"")).otherwise(F.encode("t", "UTF-8"))
    code = F.when(k == 0, 2).when(k == 1, 3).when(k == 2, 9).when(k == 3, 1).otherwise(7)
    return c.select(F.col("c_custkey").alias("id"), albums.disc_text(F.concat(raw, F.lit(b"\x00 tail")), code).alias("text"))


@query("SELECT o_orderkey AS track_id, CASE WHEN p = 5 THEN CASE WHEN n >= 2048 THEN (n - 2048) // 512 + 1 ELSE 0 END ELSE CASE WHEN n >= 4096 THEN (n - 4096) // 1365 + 1 ELSE 0 END END::BIGINT AS frames FROM (SELECT o_orderkey, (o_orderkey % 5 + 1) AS p, o_custkey * 97 AS n FROM orders)")
def preset_frames(spark, d):
    t = spark.sql("SELECT o_orderkey AS track_id, CAST(o_orderkey % 5 + 1 AS INT) AS preset, o_custkey * 97 AS samples FROM {o}", o=table(spark, d, "orders"))
    return albums.preset_frames(t).select("track_id", "frames")


_FOUND = """SELECT o_custkey AS album_id, CASE o_orderkey % 8 WHEN 0 THEN 'tags' WHEN 1 THEN 'disc' WHEN 2 THEN 'barcode' WHEN 3 THEN 'catalogue' WHEN 4 THEN 'fingerprint' WHEN 5 THEN 'sibling' WHEN 6 THEN 'text' ELSE 'second' END AS stage, o_orderkey % 30 AS key, o_orderkey AS ord, CASE o_orderkey % 2 WHEN 0 THEN 'musicbrainz' ELSE 'discogs' END AS provider,
 CAST(o_orderkey % 3 AS INT) AS tracks FROM {o}"""
_KNOWN = "SELECT DISTINCT o_custkey AS album_id, o_orderkey % 30 AS key, (o_custkey + o_orderkey % 30) % 3 <> 0 AS count_matches, CASE WHEN o_orderkey % 30 % 4 = 0 THEN NULL ELSE CAST((o_custkey + o_orderkey % 30) % 10 AS DOUBLE) / 10 + 0.05 END AS fit, o_custkey % 7 = 0 AS contradicts, CASE WHEN o_orderkey % 30 % 9 = 0 THEN 'unlikely' ELSE 'fits' END AS format, CASE WHEN o_orderkey % 30 % 5 = 0 THEN NULL ELSE o_orderkey % 30 % 2 END AS twin_key FROM {o}"


@query(f"""WITH a AS ({_FOUND.format(o='orders')}), k AS ({_KNOWN.format(o='orders')}), s AS (SELECT DISTINCT album_id, key, stage FROM a WHERE stage IN ('tags', 'barcode')),
g AS (SELECT album_id, bool_or(stage = 'tags' AND count_matches AND coalesce(fit, 1) >= 0.8 AND NOT contradicts) AS tagged_fit, count(DISTINCT CASE WHEN stage = 'barcode' AND count_matches AND coalesce(fit, 0) >= 0.75 AND format <> 'unlikely' AND NOT contradicts THEN coalesce(twin_key::VARCHAR, 'own ' || key) END) = 1 AS one FROM s JOIN k USING (album_id, key) GROUP BY 1),
q AS (SELECT a.*, coalesce(tagged_fit, FALSE) AS tagged_fit, coalesce(NOT tagged_fit AND one, FALSE) AS coded_fit FROM a LEFT JOIN g USING (album_id)),
p AS (SELECT * FROM q WHERE NOT (tagged_fit AND stage <> 'tags') AND NOT (coded_fit AND stage IN ('fingerprint', 'sibling', 'text')))
SELECT album_id, key, arg_min(provider, (tracks = 0)::BIGINT * 1000000000 + ord) AS provider, arg_min(tracks, (tracks = 0)::BIGINT * 1000000000 + ord) AS tracks, array_to_string(list_sort(list(DISTINCT stage)), ',') AS origins, min(ord) AS arrived, bool_or(tagged_fit) AS tagged_fit, bool_or(coded_fit) AS coded_fit FROM p GROUP BY 1, 2""")
def identification_plan(spark, d):
    """The pool of each album when a tagged release that fits, or a barcode that names one edition, ends the search early."""
    o = table(spark, d, "orders")
    return evidence.planned_pool(spark.sql(_FOUND, o=o).withColumn("origin", F.col("stage")), spark.sql(_KNOWN, o=o))
