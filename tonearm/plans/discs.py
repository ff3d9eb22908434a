"""Queries on disc timelines over the driver's tables: orders are discs, their lines tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import discs
from ..operators import timeline
from .registry import dealt, query, table

#: Lines that a task sorts at a time, or so.
TASK_ROWS = 1 << 18
LINES = """SELECT l_orderkey AS album_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount) AS INT) AS pos, CAST(l_quantity AS BIGINT) * 750 + l_partkey % 75 AS frames FROM {l}"""
TOC = f"""lines AS ({LINES.format(l='lineitem')}), starts AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY album_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(frames) OVER (PARTITION BY album_id))::BIGINT AS total FROM lines),
toc AS (SELECT album_id, count(*) AS n, list(start + 150 ORDER BY pos) AS offsets, max(total) + 150 AS lead FROM starts GROUP BY 1)"""


def lines(spark, d):
    return spark.sql(LINES, l=table(spark, d, "lineitem"))


def toc(spark, d):
    """album_id, n, offsets, lead: tables of contents of orders."""
    s = timeline.starts(lines(spark, d), "album_id", "pos", "frames")
    slots = F.sort_array(F.collect_list(F.struct("pos", (F.col("start") + discs.LEAD_IN).alias("o"))))
    return s.groupBy("album_id").agg(F.count("*").alias("n"), F.transform(slots, lambda x: x["o"]).alias("offsets"), discs.lead_out(F.sum("frames"), F.lit(None).cast("long")).alias("lead"))


@query(f"WITH {TOC} SELECT album_id, pos, start, (start + frames)::BIGINT AS \"end\" FROM starts")
def toc_layout(spark, d):
    s = timeline.starts(lines(spark, d), "album_id", "pos", "frames")
    total = F.sum("frames").over(Window.partitionBy("album_id"))
    return timeline.ends(s, "album_id", total).select("album_id", "pos", "start", F.col("end").cast("long").alias("end"))


@query(f"""WITH {TOC}, i AS (SELECT album_id, pos, start + album_id % 400 AS index01, total + album_id % 400 AS total FROM starts)
SELECT album_id, pos AS track, index01::BIGINT AS start, lead(index01, 1, total) OVER (PARTITION BY album_id ORDER BY index01, pos)::BIGINT AS "end" FROM i UNION ALL SELECT album_id, 0 AS track, 0 AS start, min(index01)::BIGINT AS "end" FROM i GROUP BY 1 HAVING min(index01) > 150""")
def split_plan(spark, d):
    """Track intervals with a lead-in of up to 399 frames; a long one is track 0."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_tax", "l_discount"]
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("album_id"), *order, (F.col("l_quantity").cast("long") * 750 + F.col("l_partkey") % 75).alias("frames"))
    s = timeline.laid_out(dealt(raw, "album_id", task_rows=TASK_ROWS), "album_id", order, "frames")
    rows = s.select("album_id", "pos", (F.col("start") + F.col("album_id") % 400).alias("index01"), (F.col("total") + F.col("album_id") % 400).alias("total"))
    return timeline.split_plan(rows).select("album_id", "track", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH {TOC}, i AS (SELECT album_id, pos, CASE WHEN album_id % 7 = 1 AND pos = 2 THEN NULL WHEN album_id % 7 = 2 AND pos = 3 THEN 0 WHEN album_id % 7 = 3 AND pos = 1 THEN total + 5 ELSE start END AS index01, total FROM starts),
g AS (SELECT *, index01 < lag(index01) OVER (PARTITION BY album_id ORDER BY pos) AS back FROM i), p AS (SELECT album_id, count(*) AS n, count(*) FILTER (index01 IS NULL) AS m, count(*) FILTER (index01 >= total) AS b, count(*) FILTER (back) AS k FROM g GROUP BY 1)
SELECT album_id, CASE WHEN n > 99 THEN 'too many tracks' WHEN m > 0 THEN 'missing index' WHEN b > 0 THEN 'index beyond file' ELSE 'not monotonic' END AS problem FROM p WHERE n > 99 OR m > 0 OR b > 0 OR k > 0""")
def toc_guards(spark, d):
    s = timeline.starts(lines(spark, d), "album_id", "pos", "frames").withColumn("total", F.sum("frames").over(Window.partitionBy("album_id")))
    kind = F.col("album_id") % 7
    broken = F.when((kind == 1) & (F.col("pos") == 2), F.lit(None)).when((kind == 2) & (F.col("pos") == 3), F.lit(0)).when((kind == 3) & (F.col("pos") == 1), F.col("total") + 5).otherwise(F.col("start"))
    return timeline.toc_guards(s.withColumn("index01", broken))


@query(f"""WITH {TOC} SELECT album_id, replace(replace(replace(to_base64(unhex(sha1(printf('%02X%02X%08X', 1, n, lead) || list_aggregate(list_transform(range(1, 100), lambda i: printf('%08X', coalesce(offsets[i], 0))), 'string_agg', '')))), '+', '.'), '/', '_'), '=', '-') AS disc_id FROM toc""")
def disc_id_sha1(spark, d):
    return toc(spark, d).select("album_id", discs.musicbrainz_id(F.lit(1), F.col("n"), F.col("lead"), F.col("offsets")).alias("disc_id"))


@query(f"""WITH {TOC}, s AS (SELECT album_id, n, lead, offsets, (list_sum(list_transform(offsets, lambda o: list_sum(list_transform(string_split((o // 75)::VARCHAR, ''), lambda c: c::BIGINT)))) % 255)::BIGINT AS checksum FROM toc)
SELECT album_id, printf('%08X', (checksum << 24) | (((lead // 75 - offsets[1] // 75) << 8)::BIGINT) | n) AS freedb, array_to_string(list_transform(offsets, lambda o: (o - 150)::VARCHAR), ':') || ':' || (lead - 150) AS ctdb, '1+' || n || '+' || lead || '+' || array_to_string(list_transform(offsets, lambda o: o::VARCHAR), '+') AS mb FROM s""")
def freedb_and_toc_strings(spark, d):
    t = toc(spark, d)
    return t.select(
        "album_id", discs.freedb_id(F.col("lead"), F.col("offsets")).alias("freedb"), discs.ctdb_toc(F.col("lead"), F.col("offsets")).alias("ctdb"), discs.musicbrainz_toc(F.lit(1), F.col("n"), F.col("lead"), F.col("offsets")).alias("mb")
    )


@query("""WITH e AS (SELECT event_id AS id, event_id % 400000 AS f FROM events), t AS (SELECT id, f, printf('%02d:%02d:%02d', f // 4500, f // 75 % 60, f % 75) AS msf FROM e)
SELECT id, msf, f AS parsed, f * 44100 // 75 AS samples, NULL::INT AS bad FROM t""")
def msf_roundtrip(spark, d):
    f = (F.col("event_id") % 400000).cast("long")
    msf = discs.format_msf(f)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), msf.alias("msf"), discs.parse_msf(msf).cast("long").alias("parsed"), discs.frames_to_samples(f, F.lit(44100)).alias("samples"), discs.parse_msf(F.lit("1:60:00")).cast("int").alias("bad"))


EVENTS = "SELECT user_id AS k, event_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS t FROM {e}"
_EV = "SELECT user_id AS k, event_id, floor(epoch(ts))::BIGINT AS t FROM events"
_WIN = "SELECT k, event_id AS window_id, t AS start, least(t + 1800, lead(t, 1, t + 1800) OVER (PARTITION BY k ORDER BY t, event_id)) AS \"end\" FROM ev WHERE event_id % 20 = 0"


@query(f"""WITH ev AS ({_EV}), w AS ({_WIN}), p AS (SELECT * FROM ev WHERE event_id % 20 <> 0) SELECT p.event_id, max(w.window_id) FILTER (p.t < w."end") AS window_id FROM p LEFT JOIN w ON w.k = p.k AND w.start <= p.t AND p.t < w."end" GROUP BY 1""")
def frame_windows(spark, d):
    """Events put to half-hour windows that every twentieth event of a user opens, cut at the next."""
    ev = spark.sql(EVENTS, e=table(spark, d, "events"))
    order = Window.partitionBy("k").orderBy("t", "event_id")
    w = ev.where("event_id % 20 = 0").select("k", F.col("event_id").alias("window_id"), F.col("t").alias("start"), F.least(F.col("t") + 1800, F.lead("t").over(order)).alias("end"))
    return timeline.assign_windows(ev.where("event_id % 20 <> 0"), w, "k").select("event_id", "window_id")


@query(f"""WITH ev AS ({_EV}), n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t, event_id) + event_id % 50 // 49 AS code, t, event_id FROM ev), s AS (SELECT k, code - lag(code) OVER (PARTITION BY k ORDER BY t, event_id) AS step FROM n)
SELECT k, count(*) AS n, count(*) FILTER (step <> 1) AS breaks, count(*) FILTER (step <> 1) = 0 AS contiguous FROM s GROUP BY 1""")
def contiguity_check(spark, d):
    """Time codes that jump at every fiftieth event."""
    ev = spark.sql(EVENTS, e=table(spark, d, "events"))
    code = F.row_number().over(Window.partitionBy("k").orderBy("t", "event_id")) + F.when(F.col("event_id") % 50 == 49, 1).otherwise(0)
    return timeline.contiguity(ev.withColumn("code", code), "k", ["t", "event_id"], "code")


@query(f"""WITH ev AS ({_EV}), f AS (SELECT k, event_id % 13 AS len, sum((event_id % 4 = 0)::INT) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS frame FROM ev)
SELECT k, frame::BIGINT AS frame, count(*) AS packets, sum(len)::BIGINT AS bytes FROM f WHERE frame > 0 GROUP BY 1, 2""")
def frame_assembly(spark, d):
    ev = spark.sql(EVENTS, e=table(spark, d, "events")).withColumn("len", F.col("event_id") % 13)
    return timeline.assemble(ev, "k", ["t", "event_id"], F.col("event_id") % 4 == 0)


@query(f"""WITH ev AS ({_EV}), r AS (SELECT k, event_id, (t % 86400) * 10 AS a, row_number() OVER (PARTITION BY k ORDER BY (t % 86400) * 10, event_id) AS n FROM ev)
SELECT event_id AS req_id, (max(a - n * 1050) OVER (PARTITION BY k ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) + n * 1050)::BIGINT AS slot FROM r""")
def rate_limit_slots(spark, d):
    ev = spark.sql(EVENTS, e=table(spark, d, "events")).select("k", F.col("event_id").alias("req_id"), ((F.col("t") % 86400) * 10).alias("arrive_ms"))
    return timeline.rate_slots(ev, "k", 1050).select("req_id", F.col("slot").cast("long").alias("slot"))


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS old, p_partkey + 7 AS new FROM part WHERE p_partkey % 3 = 0), c AS (SELECT p_partkey AS path, p_partkey AS final, 0 AS n FROM part UNION ALL SELECT c.path, m.new, n + 1 FROM c JOIN m ON m.old = c.final WHERE n < 8)
SELECT path, arg_max(final, n) AS final FROM c GROUP BY 1""")
def path_chain(spark, d):
    part = table(spark, d, "part")
    moves = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 7).alias("new"))
    return timeline.path_chain(part.select(F.col("p_partkey").alias("path")), moves)
