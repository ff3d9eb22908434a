"""Queries on libraries and batches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import batch, library
from .registry import dealt, query, table
from .strings import NORMALIZE

_WANT = "SELECT o_orderkey AS album_id, o_orderkey AS own_folder, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS release_key, o_custkey % 97 AS barcode, o_custkey % 89 AS code FROM {o}"
_HAVE = "SELECT o_orderkey AS folder, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS release_id, o_custkey % 97 AS barcode, o_custkey % 89 AS code FROM {o}"


@query(f"""WITH w AS ({_WANT.format(o='orders')}), i AS ({_HAVE.format(o='orders')}) SELECT w.album_id, i.folder FROM w JOIN i ON w.release_key = i.release_id AND i.folder <> w.own_folder
UNION SELECT w.album_id, i.folder FROM w JOIN i ON w.barcode = i.barcode AND w.code = i.code AND (i.release_id IS NULL OR w.release_key IS NULL) AND i.folder <> w.own_folder""")
def library_duplicates(spark, d):
    """Every album is looked up in the index of all folders."""
    o = table(spark, d, "orders")
    return library.owned_duplicates(spark.sql(_WANT, o=o), spark.sql(_HAVE, o=o))


@query("""WITH s AS (SELECT o_orderkey AS folder, o_custkey AS m FROM orders WHERE o_orderkey % 5 <> 0), p AS (SELECT o_orderkey AS folder, o_custkey - (o_orderkey % 3 = 0)::INT AS m FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(s.folder, p.folder) AS folder, coalesce(s.m, p.m) AS modified, CASE WHEN s.m IS NULL THEN 'dropped' WHEN s.m = p.m THEN 'kept' ELSE 'scanned' END AS action FROM s FULL JOIN p ON s.folder = p.folder""")
def incremental_reuse(spark, d):
    o = table(spark, d, "orders")
    seen = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("folder"), F.col("o_custkey").alias("modified"))
    before = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("folder"), (F.col("o_custkey") - F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("modified"))
    return library.incremental_scan(seen, before)


_PATHS = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END || '/' || (o_custkey % 300) || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE '/x.flac' END AS path FROM {o}"


@query(f"""WITH p AS ({_PATHS.format(o='orders')}), n AS (SELECT ord, path, row_number() OVER (PARTITION BY lower(path) ORDER BY ord) AS n FROM p)
SELECT ord, CASE WHEN n = 1 THEN path ELSE regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || list_aggregate(list_transform(range(2, n + 1), lambda i: '.' || i), 'string_agg', '') || coalesce(regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 2), '') END AS final FROM n""")
def path_collisions(spark, d):
    return library.collision_suffix(spark.sql(_PATHS, o=table(spark, d, "orders"))).select("ord", "final")


@query("""WITH m AS (SELECT DISTINCT '/v/' || (c_nationkey % 5) AS mount, CASE WHEN c_nationkey % 5 = 1 THEN 'autofs' ELSE 'nfs' END AS kind FROM customer UNION SELECT DISTINCT '/v/2/' || (c_custkey % 3), 'apfs' FROM customer), p AS (SELECT c_custkey AS id, '/v/' || (c_custkey % 7) || '/' || (c_custkey % 4) || '/f' || c_custkey AS path FROM customer)
SELECT id, arg_max(mount, length(mount)) AS mount FROM p LEFT JOIN m ON starts_with(path, mount || '/') GROUP BY 1""")
def longest_prefix(spark, d):
    m = spark.sql("SELECT DISTINCT '/v/' || (c_nationkey % 5) AS mount, CASE WHEN c_nationkey % 5 = 1 THEN 'autofs' ELSE 'nfs' END AS kind FROM {c} UNION SELECT DISTINCT '/v/2/' || (c_custkey % 3), 'apfs' FROM {c}", c=table(spark, d, "customer"))
    p = spark.sql("SELECT c_custkey AS id, '/v/' || (c_custkey % 7) || '/' || (c_custkey % 4) || '/f' || c_custkey AS path FROM {c}", c=table(spark, d, "customer"))
    return p.join(library.longest_prefix(p.select("path"), m), "path").select("id", "mount")


_SETS = "SELECT o_orderkey AS album_id, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey END AS key, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_orderkey % 41 + 1 END AS disc, CASE WHEN o_custkey % 3 = 0 THEN 3 ELSE NULL END AS declared FROM {o}"


@query(f"""WITH a AS ({_SETS.format(o='orders')}), s AS (SELECT key, count(*) AS n, count(DISTINCT disc) AS places, max(declared) AS declared, min(album_id) AS set_id, max(disc) AS top FROM a WHERE key IS NOT NULL AND disc IS NOT NULL GROUP BY 1)
SELECT album_id, set_id, disc AS position, greatest(coalesce(s.declared, 0), top) AS total FROM a JOIN s USING (key) WHERE n = places AND (n > 1 OR s.declared > 1) AND disc IS NOT NULL""")
def release_sets(spark, d):
    return library.release_sets(spark.sql(_SETS, o=table(spark, d, "orders")))


_TAGGED = """SELECT o_orderkey AS album_id, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'mb:' || o_custkey END AS key, CASE WHEN o_custkey % 4 = 0 OR o_orderkey % 37 <> 5 THEN o_orderkey % 29 END AS disc,
 CASE o_custkey % 5 WHEN 0 THEN 'Sonatas Vol.' || (o_orderkey % 31) WHEN 1 THEN 'Same name' WHEN 2 THEN (o_orderkey % 97) || ' - Box 3x' || (o_orderkey % 2) WHEN 3 THEN 'Box (' || (o_orderkey % 53) || ' of 60) ' || (o_orderkey % 59) || '.' ELSE 'Vol. ' || (o_orderkey % 61) || '_' END AS name FROM {o}"""
_OWN = """SELECT o_orderkey AS album_id, o_custkey AS key, CASE WHEN o_custkey % 7 < 2 THEN o_orderkey % 83 + 1 END AS disc, CAST(NULL AS BIGINT) AS declared FROM {o}"""


@query(f"""WITH own AS ({_OWN.format(o='orders')}), k AS (SELECT key, count(*) AS n, count(DISTINCT disc) AS places, max(disc) AS top, min(album_id) AS set_id FROM own WHERE disc IS NOT NULL GROUP BY 1),
folders AS (SELECT album_id, set_id, disc AS position, top AS total, NULL AS title FROM own JOIN k USING (key) WHERE disc IS NOT NULL AND n = places AND n > 1),
free AS (SELECT *, TRY_CAST(nullif(regexp_extract(name, '(\\d+)\\D*$', 1), '') AS BIGINT) AS number, CASE WHEN regexp_matches(name, '\\d') THEN trim(regexp_replace(name, '\\d+(\\D*)$', '\\1'), ' .-_') ELSE name END AS base
 FROM ({_TAGGED.format(o='orders')}) WHERE key IS NOT NULL AND album_id NOT IN (SELECT album_id FROM folders)),
g AS (SELECT key, count(*) AS n, count(disc) = count(*) AND count(DISTINCT disc) = count(*) AS by_disc, count(number) = count(*) AND count(DISTINCT number) = count(*) AND count(DISTINCT base) = 1 AS by_name,
 max(disc) AS top_disc, max(number) AS top_number, min(album_id) AS set_id, arg_min(base, album_id) AS title FROM free GROUP BY 1)
SELECT album_id, set_id, position, total, title, 'folder' AS found FROM folders
UNION ALL SELECT album_id, set_id, CASE WHEN by_disc THEN disc ELSE number END, greatest(n, CASE WHEN by_disc THEN top_disc ELSE top_number END), title, CASE WHEN by_disc THEN 'disc' ELSE 'name' END FROM free JOIN g USING (key) WHERE n > 1 AND (by_disc OR by_name)""")
def tagged_sets(spark, d):
    """Sets by folders first; of the albums left, those whose files name one release, by tagged discs or else by the numbers in their names."""
    orders = table(spark, d, "orders")
    folders = library.release_sets(spark.sql(_OWN, o=orders))
    found = library.tagged_sets(spark.sql(_TAGGED, o=orders), folders)
    first = folders.select("album_id", "set_id", "position", "total", F.lit(None).cast("string").alias("title"), F.lit("folder").alias("found"))
    return first.unionByName(found.select("album_id", "set_id", "position", "total", "title", "found"))


@query(f"""WITH a AS ({_SETS.format(o='orders')}), p AS (SELECT key, list(DISTINCT disc) AS present, max(disc) AS top FROM a WHERE key IS NOT NULL AND disc IS NOT NULL GROUP BY 1)
SELECT key, array_to_string(list_filter(range(1, top + 1), lambda i: NOT list_contains(present, i)), ',') AS missing FROM p""")
def missing_discs(spark, d):
    a = spark.sql(_SETS, o=table(spark, d, "orders")).where("key is not null and disc is not null")
    p = a.groupBy("key").agg(F.collect_set("disc").alias("present"), F.max("disc").alias("top"))
    return p.select("key", F.array_join(library.missing_discs(F.col("present"), F.col("top")), ",").alias("missing"))


@query("""WITH o AS (SELECT c_custkey AS path, c_name AS title, c_custkey % 5 AS runs, 1000 + c_custkey AS added_at FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE upper(c_name) END AS title FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.path, n.path) AS path, coalesce(n.title, o.title) AS title, o.runs, coalesce(o.added_at, 5000) AS added_at FROM o FULL JOIN n ON o.path = n.path""")
def upsert_albums(spark, d):
    c = table(spark, d, "customer")
    old = spark.sql("SELECT c_custkey AS path, c_name AS title, c_custkey % 5 AS runs, 1000 + c_custkey AS added_at FROM {c} WHERE c_custkey % 3 <> 0", c=c)
    new = spark.sql("SELECT c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE upper(c_name) END AS title FROM {c} WHERE c_custkey % 2 = 0", c=c)
    return library.upsert(old, new, "path", ["runs"], F.lit(5000))


@query("SELECT o_custkey AS path, arg_min(o_orderkey, o_orderkey % 1000 * 100000000 + o_orderkey) AS backup_id, min(o_orderkey % 1000) AS created FROM orders GROUP BY 1")
def first_backup(spark, d):
    return library.first_backup(table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("backup_id"), (F.col("o_orderkey") % 1000).alias("created")))


_EVIDENCE = "SELECT o_custkey AS set_id, CASE WHEN o_orderkey % 2 = 0 THEN 'barcode' ELSE 'catalogue' END AS kind, o_orderkey % 6 AS value, o_orderpriority AS origin, o_orderkey % 4 AS disc, o_orderkey AS ord FROM {o}"


@query(f"""WITH e AS ({_EVIDENCE.format(o='orders')}), f AS (SELECT *, row_number() OVER (PARTITION BY set_id, kind, value ORDER BY disc, ord, origin) AS r FROM e)
SELECT set_id, kind, value, origin, row_number() OVER (PARTITION BY set_id, kind ORDER BY disc, ord, value)::INT AS ord FROM f WHERE r = 1""")
def set_merge(spark, d):
    return library.set_merge(spark.sql(_EVIDENCE, o=table(spark, d, "orders")))


_CASCADE = """SELECT o_orderkey AS album_id, CASE WHEN o_orderkey % 29 = 0 THEN 'decode error' END AS error, o_orderkey % 5 = 0 AS is_confident, o_orderkey % 3 = 0 AS has_choice, o_orderkey % 11 = 0 AS tag_fits, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS DOUBLE) / 10 END AS fit,
 o_orderkey % 6 = 0 AS contradicts, o_orderkey % 13 = 0 AS clear_barcode, o_orderkey % 17 = 0 AS clear_prints, o_orderkey % 19 = 0 AS cover_pick, o_orderkey % 23 = 0 AS album_only, o_custkey % 4 = 0 AS is_dsd, o_custkey % 8 = 0 AS has_sacd_edition, o_custkey % 3 AS candidates FROM {o}"""
CASCADE = f"""c AS ({_CASCADE.format(o='orders')}), r AS (SELECT *, CASE WHEN error IS NOT NULL THEN 1 WHEN is_confident AND has_choice THEN 2 WHEN tag_fits AND coalesce(fit, 1) >= 0.8 AND NOT contradicts THEN 3 WHEN clear_barcode THEN 4 WHEN clear_prints THEN 5 WHEN cover_pick THEN 6 WHEN album_only THEN 7 WHEN is_dsd AND NOT has_sacd_edition THEN 8 WHEN candidates > 0 THEN 9 ELSE 10 END AS rule FROM c),
cascade AS (SELECT album_id, CASE WHEN rule = 1 THEN 'failed' WHEN rule <= 7 THEN 'chosen' ELSE 'review' END AS status, CASE rule WHEN 1 THEN error WHEN 2 THEN 'confident' WHEN 3 THEN 'tagged release fits' WHEN 4 THEN 'barcode' WHEN 5 THEN 'fingerprints' WHEN 6 THEN 'cover' WHEN 7 THEN 'album only' WHEN 8 THEN 'no SACD edition' WHEN 9 THEN 'several candidates' ELSE 'no candidate' END AS note FROM r)"""


@query(f"WITH {CASCADE} SELECT * FROM cascade")
def batch_cascade(spark, d):
    return batch.cascade(spark.sql(_CASCADE, o=table(spark, d, "orders"))).select("album_id", "status", "note")


_FINISH = "SELECT o_orderkey AS album_id, o_orderkey % 2 = 0 AS dry_run, o_orderkey % 7 = 0 AS needs_files, o_orderkey % 11 <> 0 AS has_plan, o_custkey % 5 % 4 % 2 AS warnings, o_orderkey % 13 = 0 AS other_release, o_orderkey % 17 = 0 AS owned, o_orderkey % 3 <> 0 AS has_work, o_orderkey % 23 <> 0 AS written FROM {o}"
FINISH = f"""f AS ({_FINISH.format(o='orders')}), g AS (SELECT album_id, CASE WHEN dry_run AND needs_files THEN 'done:would extract' WHEN needs_files THEN 'review:needs files' WHEN NOT has_plan THEN 'review:no plan' WHEN warnings > 0 THEN 'review:warnings' WHEN other_release THEN 'review:tagged as another release' WHEN owned THEN 'review:owned already' WHEN dry_run THEN 'done:would tag' WHEN NOT has_work THEN 'done:nothing to do' WHEN written THEN 'done:tagged' ELSE 'failed:not written' END AS s FROM f),
finish AS (SELECT album_id, split_part(s, ':', 1) AS status, split_part(s, ':', 2) AS note FROM g)"""


def finished(spark, d):
    return batch.finish(spark.sql(_FINISH, o=table(spark, d, "orders"))).select("album_id", "status", "note")


@query(f"WITH {FINISH} SELECT * FROM finish")
def batch_finish(spark, d):
    return finished(spark, d)


@query(f"""WITH {FINISH}, k AS (SELECT CASE WHEN album_id % 9 = 0 THEN 'working' ELSE status END AS status, album_id % 4 AS batch FROM finish)
SELECT batch, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'working') AS open, count(*) FILTER (status <> 'working') AS finished,
 round(count(*) FILTER (status = 'working') / ((count(*) FILTER (status <> 'working') - 5) / 600.0::DOUBLE), 4) AS eta FROM k GROUP BY 1""")
def batch_counts(spark, d):
    """Counts of four batches and the seconds left, ten minutes after the start with five finished."""
    k = finished(spark, d).select(F.when(F.col("album_id") % 9 == 0, "working").otherwise(F.col("status")).alias("status"), (F.col("album_id") % 4).alias("batch"))
    n = batch.counts(k, "batch")
    return n.withColumn("eta", F.round(batch.eta_seconds(F.col("open"), F.col("finished"), F.lit(5), F.lit(600.0)), 4))


@query(f"""WITH {FINISH} SELECT '"' || album_id || '","' || status || '","' || replace(note || CASE WHEN album_id % 5 = 0 THEN ' "x"' ELSE '' END, '"', '""') || '",""' AS line FROM finish""")
def batch_report_csv(spark, d):
    rows = finished(spark, d).withColumns({"note": F.concat("note", F.when(F.col("album_id") % 5 == 0, ' "x"').otherwise("")), "match": F.lit(None).cast("string")})
    return batch.report_lines(rows, ["album_id", "status", "note", "match"])


_LOCAL = "SELECT DISTINCT l_orderkey AS disc_id, l_linenumber AS pos, l_orderkey % 5 * 7 + l_linenumber AS crc FROM {l}"
_ENTRIES = "SELECT DISTINCT l_orderkey AS disc_id, e AS entry_id, (l_orderkey + e) % 40 AS confidence, l_linenumber AS pos, l_orderkey % 5 * 7 + l_linenumber + CASE WHEN (l_orderkey + e + l_linenumber) % 4 = 0 THEN 100 ELSE 0 END AS crc FROM {l} {join} WHERE l_orderkey % 3 <> 0"


@query(f"""WITH l AS ({_LOCAL.format(l='lineitem')}), e AS ({_ENTRIES.format(l='lineitem', join='CROSS JOIN (SELECT 1 AS e UNION ALL SELECT 2)')}), t AS (SELECT disc_id, sum(confidence) AS total, arg_max(entry_id, confidence * 10 - entry_id) AS best FROM (SELECT DISTINCT disc_id, entry_id, confidence FROM e) GROUP BY 1)
SELECT l.disc_id, l.pos, coalesce(sum(e.confidence), 0)::BIGINT AS confidence, coalesce(max(t.total), 0)::BIGINT AS total, coalesce(bool_or(e.entry_id = t.best), FALSE) AS in_best FROM l LEFT JOIN e ON e.disc_id = l.disc_id AND e.pos = l.pos AND e.crc = l.crc LEFT JOIN t ON t.disc_id = l.disc_id GROUP BY 1, 2""")
def ctdb_verify(spark, d):
    l = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", task_rows=1 << 18)
    entries = spark.sql(_ENTRIES.replace("{join}", "LATERAL VIEW explode(array(1, 2)) AS e"), l=l)
    return batch.verify_checksums(spark.sql(_LOCAL, l=l), entries)


_MEDIA = "SELECT o_orderkey AS id, o_custkey % 200 AS tracks, o_orderkey % 61 AS a, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 53 END AS b FROM {o}"


@query(f"""WITH m AS ({_MEDIA.format(o='orders')}), x AS (SELECT q.id AS req_id, m.id AS medium_id, abs(q.a - m.a) + coalesce(abs(q.b - m.b), 0) AS error FROM m q JOIN m USING (tracks)),
r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY error, medium_id)::INT AS rank, count(*) OVER (PARTITION BY req_id) AS n FROM x) SELECT req_id, medium_id, error, rank, CASE n WHEN 1 THEN 200 ELSE 211 END AS code FROM r WHERE rank <= 6""")
def cddb_rank(spark, d):
    """The six best media of each request, and the answer's code. Every medium is a request."""
    m = spark.sql(_MEDIA, o=table(spark, d, "orders")).select("id", "tracks", F.array(F.col("a").cast("long"), F.col("b").cast("long")).alias("durations"))
    r = batch.nearest_media(m.withColumnRenamed("id", "req_id"), m.withColumnRenamed("id", "medium_id"), 6)
    return r.select("req_id", "medium_id", "error", "rank", batch.response_code(F.col("matches"), F.lit(True)).alias("code"))


_QUEUE = "SELECT user_id AS path, ts, event_id AS ord, CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'readyToFinish' WHEN 2 THEN 'done' WHEN 3 THEN 'review' WHEN 4 THEN 'failed' ELSE 'working' END AS status FROM {e}"


@query(f"""WITH q AS ({_QUEUE.format(e='events')}), l AS (SELECT path, last(status ORDER BY ts, ord) AS status, bool_or(status = 'readyToFinish') AS ready FROM q GROUP BY 1)
SELECT path, CASE WHEN status = 'working' THEN CASE WHEN ready THEN 'readyToFinish' ELSE 'pending' END ELSE status END AS status FROM l""")
def queue_state(spark, d):
    return batch.latest_state(spark.sql(_QUEUE, e=table(spark, d, "events")), "path")


_IMAGES = "SELECT o_custkey AS album_id, o_orderkey AS image_id, CASE o_orderkey % 8 WHEN 0 THEN 'caa-release' WHEN 1 THEN 'caa-group' WHEN 2 THEN 'fanart' WHEN 3 THEN 'discogs' WHEN 4 THEN 'itunes' WHEN 5 THEN 'deezer' WHEN 6 THEN 'local' ELSE 'other' END AS source, o_orderkey % 500 AS width, o_custkey % 3000 + o_orderkey % 10 AS bytes FROM {o}"


@query(f"""WITH i AS ({_IMAGES.format(o='orders')}), t AS (SELECT *, list_position(['caa-release', 'caa-group', 'fanart', 'discogs', 'itunes', 'deezer', 'local'], source) AS place, row_number() OVER (PARTITION BY album_id, source ORDER BY image_id) AS turn FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY place, image_id) AS r FROM t WHERE place > 0 AND width >= 200 AND (source = 'local' OR bytes > 1024) AND (source <> 'fanart' OR turn <= 2)) SELECT album_id, image_id, source FROM r WHERE r = 1""")
def artwork_pick(spark, d):
    return batch.pick_artwork(spark.sql(_IMAGES, o=table(spark, d, "orders")))


@query(f"""SELECT p_partkey AS id FROM part WHERE contains({NORMALIZE.format(x='p_name')}, 'a') AND (contains(lower(p_name), 'bl') OR contains(lower(p_brand), 'bl') OR contains(lower(p_type), 'brass'))""")
def queue_search(spark, d):
    """A filter on normalised names, then a search for a text in any of three columns, in any case."""
    has = lambda c, s: F.lower(c).contains(s)
    return table(spark, d, "part").where(normalize(F.col("p_name")).contains("a") & (has("p_name", "bl") | has("p_brand", "bl") | has("p_type", "brass"))).select(F.col("p_partkey").alias("id"))


@query("""WITH a AS (SELECT o_orderkey AS album_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS selected, ['done', 'review'][o_orderkey % 2 + 1] AS state, o_orderkey % 5 AS backups FROM orders)
SELECT album_id, CASE WHEN album_id % 4 = 0 THEN CASE WHEN selected IS NOT NULL THEN 'needsReview' ELSE 'scanned' END ELSE state END AS state, CASE WHEN album_id % 4 = 0 THEN 0 ELSE backups END AS backups FROM a""")
def restore_outcome(spark, d):
    a = spark.sql("SELECT o_orderkey AS album_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS selected, CASE o_orderkey % 2 WHEN 0 THEN 'done' ELSE 'review' END AS state, o_orderkey % 5 AS backups FROM {o}", o=table(spark, d, "orders"))
    return batch.restore_outcome(a, a.where("album_id % 4 = 0"))


_EXTRACT = "SELECT l_orderkey AS album_id, CAST(l_quantity AS BIGINT) AS frames, CAST(l_quantity AS BIGINT) + CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS expected, l_suppkey % 30 <> 0 AS contiguous FROM {l}"


@query(f"WITH t AS ({_EXTRACT.format(l='lineitem')}) SELECT album_id, CASE WHEN bool_and(frames = expected AND contiguous) THEN 'scanned' ELSE 'error' END AS state, sum(frames)::BIGINT AS frames FROM t GROUP BY 1")
def extraction_state(spark, d):
    return batch.extraction_state(spark.sql(_EXTRACT, l=table(spark, d, "lineitem")))


@query("SELECT user_id AS album_id, coalesce(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value), 0) AS confidence FROM events GROUP BY 1")
def mean_confidence(spark, d):
    return batch.mean_confidence(table(spark, d, "events").select(F.col("user_id").alias("album_id"), F.col("value").alias("confidence")))


@query("SELECT o_orderkey AS album_id, CASE WHEN o_custkey % 5 = 0 THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'readyToFinish' ELSE 'pending' END AS status FROM orders")
def batch_start(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("album_id"), F.col("o_custkey").alias("folder"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("chosen"))
    return batch.start_batch(a, a.where("folder % 5 = 0").select("folder"))
