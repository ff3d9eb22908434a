"""Queries on scalar text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence
from ..operators.ordering import numbered
from .registry import query, table

_NORM = "trim(regexp_replace(regexp_replace(replace(strip_accents(lower({x})), '&', 'and'), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"
NORMALIZE = "regexp_replace(" + _NORM + ", '^the ', '')"


@query(f"SELECT doc_id, md5({NORMALIZE.format(x='text')}) AS digest, length({NORMALIZE.format(x='text')}) AS n FROM documents")
def normalize_text(spark, d):
    """Whole texts, normalised for comparison."""
    n = text.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


@query(f"""WITH n AS (SELECT p_partkey AS id, {NORMALIZE.format(x="p_name")} AS a, {NORMALIZE.format(x="split_part(p_name, ' ', 1) || ' ' || p_brand")} AS b FROM part)
SELECT id, a <> '' AND b <> '' AND (a = b OR (length(a) >= 6 AND (contains(a, b) OR contains(b, a)))) AS alike FROM n""")
def similar_names(spark, d):
    a, b = text.normalize(F.col("p_name")), text.normalize(F.concat_ws(" ", F.split("p_name", " ")[0], "p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.similar(a, b).alias("alike"))


_ALIKE = "(a.name = b.other OR (length(a.name) >= 6 AND (contains(a.name, b.other) OR contains(b.other, a.name))))"


@query(f"""WITH a AS (SELECT {NORMALIZE.format(x='p_name')} AS name, count(*) AS m FROM part GROUP BY 1), b AS (SELECT {NORMALIZE.format(x="string_split(p_name, ' ')[1]")} AS other, count(*) AS n FROM part GROUP BY 1)
SELECT a.name, b.other, a.m * b.n AS pairs FROM a JOIN b ON a.name <> '' AND b.other <> '' AND {_ALIKE}""")
def similar_name_pairs(spark, d):
    """All parts' names against all first words, each with how many pairs of parts it stands for; names are counted first."""
    part = table(spark, d, "part")
    a = part.groupBy(text.normalize(F.col("p_name")).alias("name")).agg(F.count("*").alias("m"))
    b = part.groupBy(text.normalize(F.split("p_name", " ")[0]).alias("other")).agg(F.count("*").alias("n"))
    met = evidence.similar_names(a.select(F.col("name").alias("left_id"), "name"), b.select(F.col("other").alias("right_id"), "other"))
    return met.join(a, F.col("left_id") == F.col("name")).join(b, F.col("right_id") == F.col("other")).select("name", "other", (F.col("m") * F.col("n")).alias("pairs"))


@query(f"""WITH e AS (SELECT p_partkey AS id, {NORMALIZE.format(x="p_type || ' Remastered Edition'")} AS e, {NORMALIZE.format(x="p_name || ' ' || p_type")} AS c FROM part),
k AS (SELECT id, c, list_transform(list_filter(string_split(e, ' '), lambda w: w <> '' AND w NOT IN ('edition','version','the','of','and','release','import','press','pressing')), lambda w: CASE WHEN ends_with(w, 'ed') AND length(w) > 5 THEN left(w, length(w) - 2) ELSE w END) AS k FROM e)
SELECT id, array_to_string(k, ' ') AS keywords, len(list_filter(k, lambda w: len(list_filter(string_split(c, ' '), lambda x: starts_with(x, w))) > 0)) = len(k) AS mentioned FROM k""")
def edition_keywords(spark, d):
    """Keywords of an edition and whether the candidate's words mention all of them."""
    k = text.edition_keywords(F.concat("p_type", F.lit(" Remastered Edition")))
    words = F.split(text.normalize(F.concat_ws(" ", "p_name", "p_type")), " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(k, " ").alias("keywords"), text.edition_matches(k, words).alias("mentioned"))


_LINES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN upper(substr(p_brand, 1, 2)) || 'XY-' || p_partkey WHEN 1 THEN 'made in japan ' || (1000 + p_partkey) || ' sicp ' || (100 + p_partkey) WHEN 2 THEN 'PD' || (10000 + p_partkey)
 WHEN 3 THEN 'Los Angeles, CA ' || (90000 + p_partkey % 1000) || ' ~ AB_' || p_partkey WHEN 4 THEN 'CD-' || p_partkey || ' & VDJ ~ ' || p_partkey ELSE p_name || ' TOCJ-' || p_partkey || '/TOCJ-' || p_partkey END AS line FROM {p}"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_STATES = ", ".join(f"'{w}'" for w in text.US_STATES)
_FOUND = " UNION ALL ".join(
    f"SELECT id, {i} AS p, unnest(regexp_extract_all(upper(line), '{pat}', 1)) AS a, unnest(regexp_extract_all(upper(line), '{pat}', 2)) AS b, unnest(range(1, 1 + len(regexp_extract_all(upper(line), '{pat}', 1)))) AS o FROM l" for i, pat in enumerate(text.CODE_PATTERNS)
)


@query(f"""WITH l AS ({_LINES.format(p='part')}), f AS ({_FOUND}), k AS (SELECT id, a || '-' || b AS code, min(p * 1000 + o) AS o FROM f WHERE a NOT IN ({_STOP}) AND NOT (a IN ({_STATES}) AND length(b) = 5) GROUP BY 1, 2)
SELECT l.id, coalesce(string_agg(code, ' ' ORDER BY o), '') AS codes FROM l LEFT JOIN k ON k.id = l.id GROUP BY 1""")
def catalog_codes(spark, d):
    lines = spark.sql(_LINES, p=table(spark, d, "part"))
    return lines.select("id", F.array_join(text.catalogue_codes(F.col("line")), " ").alias("codes"))


_RANGES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ABC-' || lpad(CAST(p_partkey AS STRING), 5, '0') || '/' || (p_partkey % 100) WHEN 1 THEN 'X-' || p_partkey || '~' || (p_partkey % 10) || ' & Y-9' WHEN 2 THEN 'Q-1/9999' ELSE 'S 12, T-3; ' END AS f FROM {p}"


@query(f"""WITH f AS ({_RANGES.format(p='part')}), s AS (SELECT id, f AS field, trim(unnest(string_split_regex(f, '[,&;]'))) AS s FROM f), x AS (SELECT *, trim(regexp_extract(s, '^(.*)[/~]([^/~]*)$', 1)) AS head, trim(regexp_extract(s, '^(.*)[/~]([^/~]*)$', 2)) AS tail FROM s WHERE s <> ''),
y AS (SELECT *, regexp_extract(head, '([0-9]+)$', 1) AS first FROM x), z AS (SELECT *, left(head, length(head) - length(first)) AS prefix, TRY_CAST(first AS BIGINT) AS a, TRY_CAST(left(first, greatest(0, length(first) - length(tail))) || tail AS BIGINT) AS b FROM y),
w AS (SELECT *, coalesce(length(first) > 0 AND regexp_matches(tail, '^[0-9]+$') AND length(tail) <= length(first) AND b > a AND b - a < 50, FALSE) AS ok FROM z),
c AS (SELECT id, CASE WHEN ok THEN prefix || lpad(CAST(n AS VARCHAR), greatest(length(first), length(CAST(n AS VARCHAR)))::INT, '0') ELSE s END AS code FROM (SELECT *, unnest(CASE WHEN ok THEN range(a, b + 1) ELSE [0] END) AS n FROM w))
SELECT id, code FROM c""")
def catalog_range_expand(spark, d):
    return spark.sql(_RANGES, p=table(spark, d, "part")).select("id", F.explode(text.matching_codes(F.col("f"))).alias("code"))


@query("""WITH v AS (SELECT p_partkey AS id, upper(p_brand) || (p_partkey % 1000) || ' SA' AS raw FROM part), g AS (SELECT id, raw, regexp_replace(raw, '[^A-Z0-9]', '', 'g') AS glued FROM v),
s AS (SELECT *, regexp_replace(regexp_replace(glued, '([A-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Z])', '\\1 \\2', 'g') AS spaced FROM g)
SELECT id, raw || '|' || spaced || '|' || replace(spaced, ' ', '-') || '|' || glued AS variants FROM s""")
def catalog_variants(spark, d):
    raw = F.concat(F.upper("p_brand"), (F.col("p_partkey") % 1000).cast("string"), F.lit(" SA"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.catalogue_variants(raw), "|").alias("variants"))


_DURATIONS = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN (event_id % 90) || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0') WHEN 1 THEN '1:' || (event_id % 60) || ':07' WHEN 2 THEN 'A' || (event_id % 30) WHEN 3 THEN '' ELSE '3:x' END AS s FROM {e}"


@query(f"""WITH s AS ({_DURATIONS.format(e='events')}), p AS (SELECT id, s, string_split(s, ':') AS p FROM s)
SELECT id, CASE len(p) WHEN 2 THEN (TRY_CAST(p[1] AS INT) * 60 + TRY_CAST(p[2] AS INT)) * 1000 WHEN 3 THEN (TRY_CAST(p[1] AS INT) * 3600 + TRY_CAST(p[2] AS INT) * 60 + TRY_CAST(p[3] AS INT)) * 1000 END::INT AS ms, TRY_CAST(regexp_extract(s, '([0-9]+)$', 1) AS INT) AS trailing FROM p""")
def durations_and_positions(spark, d):
    s = spark.sql(_DURATIONS, e=table(spark, d, "events"))
    return s.select("id", text.duration_ms(F.col("s")).alias("ms"), text.trailing_number(F.col("s")).alias("trailing"))


@query("""WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ' - Album - ' || s_suppkey END AS n FROM supplier)
SELECT id, CASE WHEN contains(n, ' - ') THEN trim(split_part(n, ' - ', 1)) END AS artist, CASE WHEN contains(n, ' - ') THEN trim(substr(n, strpos(n, ' - ') + 3)) ELSE n END AS title FROM n""")
def artist_title_split(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" - Album - "), F.col("s_suppkey").cast("string"))).alias("n"))
    artist, title = text.artist_title(F.col("n"))
    return n.select("id", artist.alias("artist"), title.alias("title"))


@query("""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Thumbs.db' WHEN 1 THEN '.hidden' WHEN 2 THEN c_name || '.FLAC' WHEN 3 THEN c_name || '.part' WHEN 4 THEN c_name || '.dsf' ELSE c_name || '.wave' END AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 44100 WHEN 2 THEN 96000 ELSE 44100 END AS rate, CASE c_custkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE NULL END AS bits FROM customer),
f AS (SELECT *, CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'flac' THEN 'flac' WHEN 'dsf' THEN 'dsf' WHEN 'wave' THEN 'wav' END AS format FROM n)
SELECT id, starts_with(name, '.') OR lower(name) IN ('thumbs.db', 'desktop.ini', '@eadir') OR regexp_matches(lower(name), '\\.(dr_done|part|tmp)$') AS junk, format,
 CASE WHEN format IN ('dsf', 'dff') THEN 'sacd' WHEN rate = 44100 AND bits <= 16 THEN 'cd' WHEN rate > 44100 OR bits > 16 THEN 'hiRes' ELSE 'unknown' END AS local_format FROM f""")
def file_classes(spark, d):
    from ..sources.scan import audio_format, is_junk, local_format

    n = spark.sql(
        "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Thumbs.db' WHEN 1 THEN '.hidden' WHEN 2 THEN c_name || '.FLAC' WHEN 3 THEN c_name || '.part' WHEN 4 THEN c_name || '.dsf' ELSE c_name || '.wave' END AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 44100 WHEN 2 THEN 96000 ELSE 44100 END AS rate, CASE c_custkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE NULL END AS bits FROM {c}",
        c=table(spark, d, "customer"),
    )
    f = audio_format(F.col("name"))
    return n.select("id", is_junk(F.col("name")).alias("junk"), f.alias("format"), local_format(f.isin("dsf", "dff"), F.col("rate"), F.col("bits")).alias("local_format"))


_DISCS = "SELECT o_orderkey AS id, 'Box ' || o_custkey || CASE o_orderkey % 5 WHEN 0 THEN ' (Disc ' || (1 + o_orderkey % 9) || ').cue' WHEN 1 THEN ' - CD' || (1 + o_orderkey % 9) || ' of 9' WHEN 2 THEN ' Vol. 40' WHEN 3 THEN ' 2024 CD FLAC' ELSE ' [disk 3-7].iso' END AS name FROM {o}"


@query(f"""WITH n AS ({_DISCS.format(o='orders')}) SELECT id, CASE id % 5 WHEN 0 THEN 1 + id % 9 WHEN 1 THEN 1 + id % 9 WHEN 4 THEN 3 END::INT AS disc, CASE id % 5 WHEN 1 THEN 9 WHEN 4 THEN 7 END::INT AS total,
 CASE WHEN id % 5 IN (2, 3) THEN name ELSE regexp_extract(name, '^Box [0-9]+') END AS base FROM n""")
def disc_tokens(spark, d):
    n = spark.sql(_DISCS, o=table(spark, d, "orders"))
    disc, total = text.disc_token(F.col("name"))
    return n.select("id", disc.alias("disc"), total.alias("total"), text.without_disc_token(F.col("name")).alias("base"))


@query("""WITH r AS (SELECT p_partkey AS id, p_name AS name FROM part) SELECT id, row_number() OVER (ORDER BY regexp_replace(regexp_replace(lower(name || ' ' || (id % 1000)), '[0-9]+', '000000000000\\0', 'g'), '0*([0-9]{12})', '\\1', 'g') COLLATE C, id)::INT AS place FROM r""")
def natural_sort(spark, d):
    """Places in natural order over the whole table."""
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 1000).cast("string")).alias("name"))
    return numbered(r, [text.natural_key(F.col("name")), F.col("id")]).select("id", F.col("place").cast("int").alias("place"))


@query("""SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS INT), -1) AS page, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS source, TRY_CAST(regexp_extract(url, '/([0-9]+)([/.?#]|$)', 1) AS BIGINT) AS number FROM pages""")
def url_fields(spark, d):
    q = F.regexp_extract("url", "\\?([^#]*)", 1)
    return table(spark, d, "pages").select(
        "page_id", F.coalesce(text.form_value(q, "page").try_cast("int"), F.lit(-1)).alias("page"), F.coalesce(text.form_value(q, "utm_source"), F.lit("")).alias("source"), F.regexp_extract("url", "/([0-9]+)([/.?#]|$)", 1).try_cast("long").alias("number")
    )


_NAMES = """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'AC/DC' ELSE s_name END AS artist, CASE s_suppkey % 6 WHEN 0 THEN 'Back: in Black' WHEN 1 THEN 'X  ()' WHEN 2 THEN 'A ' || chr(123) || ' ' || chr(125) || ' ' || chr(123) || chr(125) || ' b' WHEN 3 THEN '...Dots' WHEN 4 THEN repeat('long ', 50) ELSE repeat('é', 101) END AS album,
 CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1980 + s_suppkey % 20 END AS year, s_suppkey % 30 AS n, CASE WHEN s_suppkey % 5 = 0 THEN 'Hells Bells...' ELSE '..Song - ' END AS title FROM {s}"""
#: A component made safe: separators, blanks, empty brackets, dangling dashes, dots, and the length limit.
_SAFE = r"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({x}, '/:', '--'), '\s+', ' ', 'g'), '\( ?\)|\[ ?\]|\{{\}}', '', 'g'), '\s+', ' ', 'g'), '(\s-\s*)+$', ''), '^(\s*-\s)+', '')), '^\.+', ''), '[. ]+$', '')"
_CUT = "CASE WHEN strlen({x}) > 200 THEN trim(left({x}, 200)) ELSE {x} END"


@query(f"""WITH v AS ({_NAMES.format(s='supplier')}), a AS (SELECT id, {_SAFE.format(x="translate(artist, '/', '-')")} AS x, {_SAFE.format(x="album || ' (' || coalesce(year::VARCHAR, '') || ') {open'")} AS y, {_SAFE.format(x="lpad(n::VARCHAR, 2, '0') || ' ' || title")} AS z FROM v)
SELECT id, array_to_string(list_filter([{_CUT.format(x='x')}, {_CUT.format(x='y')}, {_CUT.format(x='z')}], lambda p: p <> ''), '/') AS path FROM a""")
def target_paths(spark, d):
    """Paths from a template with names in any case, an unknown one, and a brace that is never closed."""
    v = spark.sql(_NAMES, s=table(spark, d, "supplier"))
    values = {"artist": F.col("artist"), "album": F.col("album"), "year": F.col("year"), "track": F.lpad(F.col("n").cast("string"), 2, "0"), "title": F.col("title")}
    return v.select("id", text.render_template("{Artist}/{album} ({YEAR}){nothing} {open/{track} {title}", values).alias("path"))


_FOREIGN = {"Björk – Vespertine": "Bjork - Vespertine", "Ｆｕｌｌ＆ｗｉｄｅ": "Full&wide", "Кино – Дом": "Kino - Dom", "Σωκράτης": "Sokrates", "日本 x": "x", "Straße „a“ … Ærø": 'Strasse "a" ... AEro', "Žižek ×2": "Zizek x2", "Чайка": "Cajka"}
_ASCII = "CASE p_partkey % 8 " + " ".join("WHEN {i} THEN '{v}'".format(i=i, v=v) for i, v in enumerate(_FOREIGN)) + " END"


@query("SELECT p_partkey AS id, CASE p_partkey % 8 " + " ".join("WHEN {i} THEN '{v}'".format(i=i, v=v) for i, v in enumerate(_FOREIGN.values())) + " END || ' ' || p_brand AS name FROM part")
def ascii_names(spark, d):
    """Names of several scripts in printable ASCII."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.ascii_safe(F.concat(F.expr(_ASCII), F.lit(" "), F.col("p_brand"))).alias("name"))
