"""Queries on disc lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from .registry import query, table

_REQ = "SELECT o_orderkey AS req_id, CASE o_orderkey % 5 WHEN 0 THEN 'cmd=cddb+query+AB' || o_orderkey || '+2+150+' || (1000 + o_custkey) || '+' || (100 + o_custkey) || '&proto=6' WHEN 1 THEN 'cmd=cddb+read+Rock+ab' || o_orderkey WHEN 2 THEN 'cmd=cddb+query+ab+3+150' WHEN 3 THEN 'hello=x' ELSE 'cmd=proto+6' END AS query FROM {o}"


@query(f"""WITH r AS ({_REQ.format(o='orders')}) SELECT req_id, CASE req_id % 5 WHEN 0 THEN 'query' WHEN 1 THEN 'read' WHEN 2 THEN 'query' WHEN 3 THEN NULL ELSE 'proto' END AS verb, CASE WHEN req_id % 5 IN (0, 1) THEN 'ab' || req_id WHEN req_id % 5 = 2 THEN 'ab' END AS disc,
 CASE WHEN req_id % 5 = 1 THEN 'rock' END AS category, req_id % 5 IN (0, 1, 4) AS valid, CASE WHEN req_id % 5 = 0 THEN ((850 + o_custkey) // 75) || ',' || (((100 + o_custkey) * 75 - 1000 - o_custkey) // 75) END AS durations FROM r JOIN orders ON o_orderkey = req_id""")
def lookup_requests(spark, d):
    r = lookups.parse_requests(spark.sql(_REQ, o=table(spark, d, "orders")))
    return r.select("req_id", "verb", "disc", "category", "valid", F.array_join(F.transform("durations", lambda x: x.cast("string")), ",").alias("durations"))


_KEYS = "SELECT p_partkey AS id, 'TTITLE' || (p_partkey % 20) AS k, repeat(p_name || ' ', CAST(1 + p_partkey % 60 AS INT)) AS v FROM {p}"


@query(f"""WITH k AS ({_KEYS.format(p='part')}), r AS (SELECT *, 249 - strlen(k) AS room FROM k), c AS (SELECT *, unnest(range(0, greatest(1, (length(v) + room - 1) // room))) AS i FROM r)
SELECT id, string_agg(k || '=' || substr(v, (i * room + 1)::BIGINT, room::BIGINT), chr(10) ORDER BY i) AS lines FROM c GROUP BY 1""")
def wrapped_fields(spark, d):
    """Values of plain letters, so bytes and characters are the same."""
    k = spark.sql(_KEYS, p=table(spark, d, "part"))
    return k.select("id", lookups.wrapped_field(F.col("k"), F.col("v")).alias("lines"))


_TRACKS = "SELECT l_orderkey AS album_id, min(l_linenumber) - 1 AS number, CASE WHEN min(l_partkey) % 2 = 0 THEN 'T' || min(l_partkey) END AS title, CASE WHEN min(l_suppkey) % 3 = 0 THEN 'P' END AS performer, CAST(NULL AS STRING) AS isrc, 'A' || l_orderkey AS album, 'AA' AS album_artist, '1984' AS date, CASE WHEN l_orderkey % 2 = 0 THEN ' ' ELSE 'Jazz' END AS genre, 2 AS disc FROM {l} GROUP BY l_orderkey, l_linenumber"
_F = {"TITLE": "CASE WHEN number = 0 THEN 'Hidden Track' ELSE coalesce(title, 'Track ' || number) END", "ARTIST": "coalesce(performer, album_artist)", "ALBUM": "album", "ALBUMARTIST": "album_artist", "TRACKNUMBER": "number::VARCHAR", "TRACKTOTAL": "total::VARCHAR", "DISCNUMBER": "disc::VARCHAR", "DATE": "date", "GENRE": "trim(genre)", "ISRC": "isrc"}


@query(f"WITH t AS ({_TRACKS.format(l='lineitem')}), n AS (SELECT *, count(*) FILTER (number > 0) OVER (PARTITION BY album_id) AS total FROM t), f AS ({' UNION ALL '.join(f'''SELECT album_id, number, '{f}' AS field, {v} AS value FROM n''' for f, v in _F.items())}) SELECT * FROM f WHERE value <> ''")
def provisional_tags(spark, d):
    return lookups.provisional_tags(spark.sql(_TRACKS, l=table(spark, d, "lineitem")))
