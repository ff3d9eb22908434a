"""Queries on loudness and fingerprints over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, loudness, prints
from .registry import query, table

_L = "CASE WHEN {p} > 0 THEN -0.691 + 10 * log10({p}) END"
SUB = """SELECT user_id AS track_id, event_type AS album_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos, CASE WHEN event_id % 9 = 0 THEN CAST(1e-9 AS DOUBLE) ELSE CAST(value AS DOUBLE) * value / 1000000.0 END AS power FROM {e}"""
BLOCKS = f"""sub AS ({SUB.format(e='events')}), w AS (SELECT track_id, album_id, pos, avg(power) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS power, count(*) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM sub),
blocks AS (SELECT track_id, album_id, pos, power FROM w WHERE n = 4)"""


def sub_blocks(spark, d):
    return spark.sql(SUB, e=table(spark, d, "events"))


def blocks(spark, d):
    b = loudness.block_power(sub_blocks(spark, d), "track_id", "pos", "power")
    return b.select("track_id", "album_id", "pos", F.col("block").alias("power"))


def _gated(key: str) -> str:
    return f"""WITH {BLOCKS}, a AS (SELECT {key}, power, avg(power) OVER (PARTITION BY {key}) AS mean FROM blocks WHERE {_L.format(p='power')} > -70),
k AS (SELECT {key}, avg(power) AS p, count(*) AS kept FROM a WHERE {_L.format(p='power')} > {_L.format(p='mean')} - 10 GROUP BY 1)
SELECT {key}, round({_L.format(p='k.p')}, 4) AS integrated, coalesce(kept, 0) AS kept FROM (SELECT DISTINCT {key} FROM blocks) LEFT JOIN k USING ({key})"""


@query(f"WITH {BLOCKS} SELECT track_id, pos, round(power, 6) AS power FROM blocks")
def momentary_blocks(spark, d):
    return blocks(spark, d).select("track_id", "pos", F.round("power", 6).alias("power"))


@query(_gated("track_id"))
def gated_mean_track(spark, d):
    return loudness.gated_loudness(blocks(spark, d), "track_id").withColumn("integrated", F.round("integrated", 4))


@query(_gated("album_id"))
def gated_mean_album(spark, d):
    """The gates over the union of all tracks' blocks."""
    return loudness.gated_loudness(blocks(spark, d), "album_id").withColumn("integrated", F.round("integrated", 4))


_LEVELS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(-(p_partkey % 4000) AS DOUBLE) / 128 END AS level, CAST(-(p_partkey % 100) AS DOUBLE) / 8 AS peak, p_partkey % 2 = 0 AS dsd FROM {p}"


@query(f"""WITH l AS ({_LEVELS.format(p='part')}) SELECT id, CASE WHEN level IS NOT NULL THEN printf('%.2f', round(-18 - level, 2)) || ' dB' END AS gain, printf('%.6f', 10 ** (peak / 20)) AS peak,
 CASE WHEN dsd AND level IS NOT NULL THEN round((-23 - level) * 256)::INT::VARCHAR END AS r128, CASE WHEN level IS NOT NULL THEN '-18.00 LUFS' END AS reference FROM l""")
def gain_strings(spark, d):
    l = spark.sql(_LEVELS, p=table(spark, d, "part"))
    return l.select("id", *[c.alias(n) for n, c in loudness.gain_strings(F.col("level"), F.col("peak"), F.col("dsd")).items()])


@query("""WITH s AS (SELECT l_orderkey AS block, (l_linenumber - 1) % 6 AS ch, CAST(l_quantity AS DOUBLE) / 50 AS x FROM lineitem), n AS (SELECT block, max(ch) + 1 AS channels FROM s GROUP BY 1)
SELECT block, round(sum(CASE WHEN channels >= 6 AND ch = 3 THEN 0 WHEN channels >= 5 AND ch >= 3 THEN 1.41 WHEN channels = 4 AND ch >= 2 THEN 1.41 ELSE 1 END * x * x), 6)::DOUBLE AS power FROM s JOIN n USING (block) GROUP BY 1""")
def channel_power(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), ((F.col("l_linenumber") - 1) % 6).alias("ch"), (F.col("l_quantity").cast("double") / 50).alias("x"))
    s = s.join(s.groupBy("block").agg((F.max("ch") + 1).alias("channels")), "block")
    return s.groupBy("block").agg(F.round(F.sum(loudness.channel_weight(F.col("ch"), F.col("channels")) * F.col("x") * F.col("x")), 6).alias("power"))


_ITEMS = "w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), items AS (SELECT doc_id, ('0x' || left(md5(w), 8))::BIGINT AS item FROM w WHERE w <> '')"
_BITS = ", ".join(f"sum(CASE WHEN item & {1 << b} <> 0 THEN 1 ELSE -1 END) AS v{b}" for b in range(32))
_SUM = " + ".join(f"CASE WHEN v{b} > 0 THEN {1 << b} ELSE 0 END" for b in range(32))


@query(f"WITH {_ITEMS}, v AS (SELECT doc_id, {_BITS} FROM items GROUP BY 1) SELECT doc_id, ({_SUM})::BIGINT AS hash FROM v")
def simhash_documents(spark, d):
    """The first 32 bits of the digests of all words of a text, by majority."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return prints.simhash(w.select("doc_id", F.conv(F.left(F.md5("w"), F.lit(8)), 16, 10).cast("long").alias("item")), "doc_id")


_SIGNS = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(32))


@query(f"WITH h AS (SELECT vec_id AS id, ({_SIGNS})::BIGINT AS hash FROM embeddings) SELECT a.id AS left_id, b.id AS right_id, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 7")
def hamming_pairs(spark, d):
    """Sign bits of vectors that differ in 7 places at most."""
    bits = sum((F.when(F.element_at("embedding", i + 1) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)), F.lit(0).cast("long"))
    return prints.hamming_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("hash")), 7)


_SIDE = "SELECT o_custkey AS pair_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pos, (o_orderkey {shift}) % 13 * 1048576 + 5 AS item FROM {o}"


@query(f"""WITH a AS ({_SIDE.format(shift='* 1', o='orders')}), b AS ({_SIDE.format(shift='* 1', o='orders')}) SELECT a.pair_id, a.pos - b.pos AS "offset", count(*) AS n FROM a JOIN b ON a.pair_id = b.pair_id AND (a.item >> 20) = (b.item >> 20) GROUP BY 1, 2 HAVING count(*) > 1""")
def alignment_histogram(spark, d):
    side = spark.sql(_SIDE.replace("{shift}", "* 1"), o=table(spark, d, "orders"))
    return prints.alignment_histogram(side, side)


@query("""WITH r AS (SELECT user_id AS k, event_id, value AS v, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT k, event_id FROM r WHERE (b IS NULL OR v >= b) AND (a IS NULL OR v >= a)""")
def local_maxima(spark, d):
    e = spark.sql("SELECT user_id AS k, event_id, value, struct(ts, event_id) AS pos FROM {e}", e=table(spark, d, "events"))
    return prints.local_maxima(e, "k", "pos", "value").select("k", "event_id")


@query("""WITH r AS (SELECT user_id AS k, event_id, lag(value, 4) OVER w AS a, lag(value, 3) OVER w AS b, lag(value, 2) OVER w AS c, lag(value, 1) OVER w AS d, value AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(0.25 * a + 0.75 * b + c + 0.75 * d + 0.25 * e, 4)::DOUBLE AS smooth FROM r WHERE a IS NOT NULL""")
def chroma_fir(spark, d):
    e = spark.sql("SELECT user_id AS k, event_id, CAST(value AS DOUBLE) AS value, struct(ts, event_id) AS pos FROM {e}", e=table(spark, d, "events"))
    return prints.time_filter(e, "k", "pos", "value", (0.25, 0.75, 1.0, 0.75, 0.25)).select("event_id", F.round("smooth", 4).alias("smooth"))


@query("""WITH r AS (SELECT user_id AS k, event_id, row_number() OVER w AS pos, floor(sum(abs(value)) OVER (w ROWS BETWEEN 54 PRECEDING AND CURRENT ROW) / count(*) OVER (w ROWS BETWEEN 54 PRECEDING AND CURRENT ROW)) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT k, min(pos) AS first FROM r WHERE m > 50 GROUP BY 1) SELECT r.k, count(*) AS open FROM r JOIN f ON f.k = r.k AND r.pos >= f.first GROUP BY 1""")
def silence_gate(spark, d):
    e = spark.sql("SELECT user_id AS k, event_id, value, struct(ts, event_id) AS pos FROM {e}", e=table(spark, d, "events"))
    return prints.open_from(e, "k", "pos", "value", 55, 50).groupBy("k").agg(F.count("*").alias("open"))


@query("""WITH f AS (SELECT event_id, 10.0::DOUBLE * 2 ** ((event_id % 110) / 10.0::DOUBLE) AS f, value FROM events), n AS (SELECT value, CASE WHEN f >= 28 AND f < 3520 THEN floor(12 * (log2(f / 27.5) - floor(log2(f / 27.5))))::INT END AS note FROM f) SELECT note, count(*) AS n, round(sum(value), 2)::DOUBLE AS energy FROM n WHERE note IS NOT NULL GROUP BY 1""")
def chroma_fold(spark, d):
    f = spark.sql("SELECT value, CAST(10.0 AS DOUBLE) * power(2, (event_id % 110) / CAST(10.0 AS DOUBLE)) AS f FROM {e}", e=table(spark, d, "events"))
    n = f.select("value", prints.note_of(F.col("f")).alias("note")).where("note is not null")
    return n.groupBy("note").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("energy"))


@query("""WITH r AS (SELECT user_id AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS slot, value FROM events) SELECT k, slot::BIGINT AS slot, round(avg(value), 4) AS chroma FROM r GROUP BY 1, 2 HAVING count(*) = 3""")
def chroma_decimate(spark, d):
    """Averages of every three rows in order; a partial last one is dropped."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    slot = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 3)
    return e.select(F.col("user_id").alias("k"), slot.alias("slot"), "value").groupBy("k", "slot").agg(F.round(F.avg("value"), 4).alias("chroma"), F.count("*").alias("n")).where("n = 3").drop("n")


@query("""WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS dot FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10)
SELECT left_id, right_id, round(sqrt(greatest(2 - 2 * dot, 0)), 5) AS distance, CASE WHEN round(sqrt(greatest(2 - 2 * dot, 0)), 5) < 0.35 THEN 30 WHEN round(sqrt(greatest(2 - 2 * dot, 0)), 5) < 0.6 THEN 15 ELSE 0 END AS points, round(sqrt(greatest(2 - 2 * dot, 0)), 5) >= 0.95 AS differs FROM p""")
def cover_distance_tiers(spark, d):
    from ..operators.evidence import cover_points

    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 10).alias("vec_id"), "label", F.col("vec_id").alias("right_id"), F.col("embedding").alias("other"))
    p = prints.distance_tiers(e.join(b, ["vec_id", "label"]), "embedding", "other").withColumn("distance", F.round("distance", 5))
    return p.select(F.col("vec_id").alias("left_id"), "right_id", "distance", cover_points(F.col("distance")).alias("points"), (F.col("distance") >= 0.95).alias("differs"))


def _bark(f: str) -> str:
    z = f"(26.81 * ({f}) / (1960 + ({f})) - 0.53)"
    return f"(CASE WHEN {z} < 2 THEN {z} + 0.15 * (2 - {z}) WHEN {z} > 20.1 THEN {z} + 0.22 * ({z} - 20.1) ELSE {z} END)::DOUBLE"


@query(f"""WITH RECURSIVE walk(i, since, b) AS (SELECT 0, {_bark('200')}, 0 UNION ALL
SELECT i + 1, CASE WHEN {_bark('(i + 1) * 250')} - since > ({_bark('3500')} - {_bark('200')}) / 4 THEN {_bark('(i + 1) * 250')} ELSE since END, CASE WHEN {_bark('(i + 1) * 250')} - since > ({_bark('3500')} - {_bark('200')}) / 4 THEN b + 1 ELSE b END FROM walk WHERE i < 15),
bins AS (SELECT i AS k, b AS band FROM walk WHERE i BETWEEN 1 AND 15 AND b < 4), s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events),
f AS (SELECT user_id, unnest(range(0, (max(pos) - 31) // 10 + 1)) AS frame FROM s GROUP BY 1 HAVING max(pos) >= 31),
x AS (SELECT f.user_id, frame, pos - 10 * frame AS n, v * (0.54 - 0.46 * cos(2 * pi() * (pos - 10 * frame) / 31)) AS v FROM f JOIN s ON s.user_id = f.user_id AND pos BETWEEN 10 * frame AND 10 * frame + 31),
p AS (SELECT user_id, frame, band, k, pow(sum(v * cos(2 * pi() * k * n / 32)), 2) + pow(sum(v * sin(2 * pi() * k * n / 32)), 2) AS power FROM x CROSS JOIN bins GROUP BY ALL)
SELECT user_id, frame, band, round(avg(power), 2) AS energy FROM p GROUP BY ALL""")
def bark_bands(spark, d):
    """Frames of 32 values of a user's events, which come in chunks of 10, by the energies of four Bark bands."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").select(F.col("user_id").alias("track_id"), pos.alias("pos"), "value")
    chunks = e.groupBy("track_id", F.floor(F.col("pos") / 10).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("samples"))
    found = frames.frame_features(chunks.withColumn("at", F.col("chunk") * 10), frames.bark_bands(4, 200, 3500, 8000, 32), 32, 10, block=3)
    return found.select(F.col("track_id").alias("user_id"), "frame", F.posexplode("feature").alias("band", "e")).select("user_id", "frame", "band", F.round("e", 2).alias("energy"))
