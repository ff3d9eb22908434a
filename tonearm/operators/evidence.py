"""Release identification: votes, candidate pools, evidence scores, rankings and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WILDCARD_LENGTHS, codes_match, glued, similar, wildcard_prefix

#: Match confidence from least to most.
CONFIDENCE = ("unlikely", "possible", "likely", "confident")
#: Seconds by which a track may be off.
TOLERANCE = 4.0
#: Points by which a pick must lead to be clear.
CLEAR = 30


def consensus_votes(hits: DataFrame) -> DataFrame:
    """album_id, release_id, hits, best_score, coverage, rank: of (album_id, track, release_id, score) rows.

    Releases stay that about half as many tracks name as the most named one, but two at least,
    unless one track or one hit is all there is. Hits are reduced to tracks and releases once, and counted from that.
    """
    named = hits.groupBy("album_id", "release_id", "track").agg(F.max("score").alias("score"))
    tracks = named.groupBy("album_id", "track").agg(F.lit(1)).groupBy("album_id").agg(F.count("*").alias("tracks"))
    votes = named.groupBy("album_id", "release_id").agg(F.count("*").alias("hits"), F.max("score").alias("best_score"))
    votes = votes.join(tracks, "album_id").withColumn("most", F.max("hits").over(Window.partitionBy("album_id")))
    need = F.greatest(F.lit(2), F.floor((F.col("most") + 1) / 2))
    votes = votes.where(~((F.col("tracks") > 1) & (F.col("most") >= 2)) | (F.col("hits") >= need))
    rank = F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("hits"), F.desc("best_score"), "release_id"))
    return votes.select("album_id", "release_id", "hits", "best_score", (F.col("hits") / F.col("tracks")).alias("coverage"), rank.alias("rank"))


def best_recording(hits: DataFrame) -> DataFrame:
    """album_id, track, recording_id, score: the recording with the best score of each track, ties to the smallest id."""
    best = F.max(F.struct("score", (-F.col("recording_id")).alias("minus")))
    return hits.groupBy("album_id", "track").agg(best.alias("b")).select("album_id", "track", (-F.col("b.minus")).alias("recording_id"), "b.score")


def top_k(rows: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each key in an order, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def candidate_pool(arrivals: DataFrame) -> DataFrame:
    """album_id, key, provider, tracks, origins, arrived: one row a candidate of (album_id, key, ord, provider, tracks, origin) rows.

    The first arrival stays unless it has no tracks and a later one has; origins are gathered in order of name.
    """
    first = F.min(F.struct((F.coalesce("tracks", F.lit(0)) == 0).alias("bare"), "ord", "provider", "tracks"))
    pool = arrivals.groupBy("album_id", "key").agg(first.alias("f"), F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("origins"), F.min("ord").alias("arrived"))
    return pool.select("album_id", "key", "f.provider", "f.tracks", "origins", "arrived")


#: Searches in order, and whether a tagged release that fits, or a barcode that names one edition, makes each of them needless.
STAGES = {"tags": (False, False), "disc": (True, False), "barcode": (True, False), "catalogue": (True, False), "fingerprint": (True, True), "sibling": (True, True), "text": (True, True), "second": (True, False)}


def identification_gates(arrivals: DataFrame, facts: DataFrame) -> DataFrame:
    """album_id, tagged_fit, coded_fit: whether a tagged release decides, or else the barcode.

    facts: (album_id, key, count_matches, fit, contradicts, format, twin_key), a row a candidate. A tagged release fits with the
    right number of tracks, a fit of 0.8 or more (or unknown) and no code against it. A barcode decides where the fitting
    releases that it finds, at least one, are all twins.
    """
    found = arrivals.where(F.col("stage").isin("tags", "barcode")).groupBy("album_id", "key").agg(F.bool_or(F.col("stage") == "tags").alias("tagged"), F.bool_or(F.col("stage") == "barcode").alias("coded"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = found.join(facts, ["album_id", "key"])
    plain = yes(F.col("count_matches")) & ~yes(F.col("contradicts"))
    tagged = F.col("tagged") & plain & (F.coalesce("fit", F.lit(1.0)) >= 0.8)
    coded = F.col("coded") & plain & yes(F.col("fit") >= 0.75) & (F.col("format") != "unlikely")
    twin = F.when(coded, F.coalesce(F.col("twin_key").cast("string"), F.concat(F.lit("own "), F.col("key").cast("string"))))
    per = rows.groupBy("album_id").agg(F.bool_or(tagged).alias("tagged_fit"), (F.min(twin) == F.max(twin)).alias("one"))
    return per.select("album_id", "tagged_fit", (~F.col("tagged_fit") & yes(F.col("one"))).alias("coded_fit"))


def planned_pool(arrivals: DataFrame, facts: DataFrame) -> DataFrame:
    """The candidate pool of the searches that an identification makes: (album_id, stage, key, ord, provider, tracks, origin) rows, with ``tagged_fit`` and ``coded_fit``.

    A search that an earlier finding makes needless brings nothing, though its rows are there.
    """
    gates = identification_gates(arrivals, facts)
    rows = arrivals.join(gates, "album_id", "left").fillna(False, ["tagged_fit", "coded_fit"])
    skipped = [(F.col("stage") == s) & ((F.col("tagged_fit") & F.lit(t)) | (F.col("coded_fit") & F.lit(c))) for s, (t, c) in STAGES.items() if t or c]
    pool = candidate_pool(rows.where(~reduce(Column.__or__, skipped)))
    return pool.join(gates, "album_id", "left").fillna(False, ["tagged_fit", "coded_fit"])


def duration_fit(pairs: DataFrame, local: DataFrame, candidate: DataFrame) -> DataFrame:
    """album_id, candidate_id, mean_error, fit of pairs whose track counts agree and whose durations are all known.

    local: (album_id, pos, seconds), candidate: (candidate_id, pos, seconds). Durations are compared in the order of pos, as one
    array an album: each table is grouped once, and pairs are joined with arrays, never with tracks.
    """
    met = pairs.join(_known_lists(local, "album_id", "ours"), "album_id").join(_known_lists(candidate, "candidate_id", "theirs"), "candidate_id")
    return _fits(met.where("ours_n = theirs_n"))


def group_duration_fit(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """duration_fit of every two different albums of a group, both ways round: (group, album_id) and (album_id, pos, seconds) rows.

    Members get their durations before they are paired, so no pair is shuffled, and albums meet only where their track counts agree.
    """
    held = members.join(_known_lists(tracks, "album_id", "each"), "album_id").select("group", "album_id", "each", "each_n")
    same = (F.col("a.group") == F.col("b.group")) & (F.col("a.each_n") == F.col("b.each_n")) & (F.col("a.album_id") != F.col("b.album_id"))
    met = held.alias("a").join(held.alias("b"), same)
    return _fits(met.select(F.col("a.album_id").alias("album_id"), F.col("b.album_id").alias("candidate_id"), F.col("a.each").alias("ours"), F.col("b.each").alias("theirs"), F.col("a.each_n").alias("ours_n")))


def group_facts(members: DataFrame, tracks: DataFrame, task_rows: int, alone: bool = False) -> DataFrame:
    """group, album_id, candidate_id, local_count, candidate_count, mean_error, fit of every two different albums of a group that have tracks, both ways round.

    members: (group, album_id), tracks: (album_id, pos, seconds). The last two are those of duration_fit, null for pairs that are not in it. Members get
    their tracks before they are paired, and pairs stay where their group is, so none is shuffled; tasks have some ``task_rows`` members. With
    ``alone``, an album without others is a row without a candidate.
    """
    held = members.join(_lists(tracks, "album_id", "each"), "album_id").select("group", "album_id", "each", "each_n")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-members.count() // task_rows))
    held = held.repartition(parts, "group")
    other = (F.col("a.group") == F.col("b.group")) & (F.col("a.album_id") != F.col("b.album_id"))
    met = held.alias("a").join(held.alias("b"), other, "left" if alone else "inner").select(
        F.col("a.group").alias("group"), F.col("a.album_id").alias("album_id"), F.col("b.album_id").alias("candidate_id"), F.col("a.each").alias("ours"), F.col("b.each").alias("theirs"), F.col("a.each_n").alias("ours_n"), F.col("b.each_n").alias("theirs_n")
    )
    off = F.when((F.col("ours_n") == F.col("theirs_n")) & F.col("ours").isNotNull() & F.col("theirs").isNotNull(), _off())
    rows = met.select("group", "album_id", "candidate_id", F.col("ours_n").alias("local_count"), F.col("theirs_n").alias("candidate_count"), off.alias("mean_error"))
    return rows.withColumn("fit", F.when(F.col("mean_error").isNotNull(), _fit()))


def _lists(tracks: DataFrame, key: str, name: str) -> DataFrame:
    """The durations of each album in the order of pos, null unless all are known, and the number of its tracks."""
    every = F.sort_array(F.collect_list(F.struct("pos", "seconds")))
    per = tracks.groupBy(key).agg(every.alias("t"), F.bool_and(F.col("seconds").isNotNull()).alias("known"))
    return per.select(key, F.when(F.col("known"), F.transform("t", lambda t: t["seconds"])).alias(name), F.size("t").alias(f"{name}_n"))


def _known_lists(tracks: DataFrame, key: str, name: str) -> DataFrame:
    """The durations of each album whose durations are all known, in the order of pos, and their number."""
    return _lists(tracks, key, name).where(F.col(name).isNotNull())


def _fits(met: DataFrame) -> DataFrame:
    return met.select("album_id", "candidate_id", _off().alias("mean_error")).withColumn("fit", _fit())


def _off() -> Column:
    return F.aggregate(F.zip_with("ours", "theirs", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda x, y: x + y) / F.col("ours_n")


def _fit() -> Column:
    return F.greatest(F.lit(0.0), 1 - F.col("mean_error") / (2 * TOLERANCE))


def format_flags(text: Column) -> dict[str, Column]:
    """What a medium's description says, of text in lower case."""
    has = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return {
        "sacd": has("sacd", "dsd"), "vinyl": has("vinyl", "cassette", "shellac", "reel"), "digital": has("digital"), "dvd": has("dvd", "blu-ray"),
        "cd": has("cd") & ~(has("sacd") & ~has("cd layer") & ~has("hybrid")),
    }


def format_compatibility(formats: Column, local: Column, hint: Column, is_image: Column) -> Column:
    """fits, unlikely or unknown: could media of these descriptions be the source of the files?

    formats: descriptions; a medium named by a person decides, else what the files allow.
    """
    known = F.filter(F.transform(formats, lambda f: F.lower(f)), lambda f: f.isNotNull() & (f != "") & ~f.isin("unknown", "(unknown)", "other"))
    text = F.array_join(known, " ")
    has = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    sacd, digital, dvd = has("sacd", "dsd"), has("digital", "file", "download"), has("dvd", "blu-ray", "bluray", "hd dvd")
    vinyl, tape = has("vinyl", "lp", "flexi", "acetate"), has("cassette", "reel", "8-track", "shellac")
    cd = F.exists(known, lambda f: (f.contains("cd") & ~f.contains("sacd")) | f.contains("cd layer") | f.contains("hybrid") | f.contains("hdcd") | f.contains("shm-cd"))
    fits = lambda c: F.when(c, "fits").otherwise("unlikely")
    by_hint = F.when(hint == "vinyl", fits(vinyl)).when(hint == "sacd", fits(sacd)).when(hint == "dvd", fits(dvd)).when(hint == "digital", fits(digital | (is_image & sacd))).when(hint == "cd", fits(cd))
    by_files = F.when(local == "sacd", fits(sacd | (~is_image & digital))).when(local == "cd", fits(cd | digital)).when(local == "hiRes", fits(digital | vinyl | sacd | dvd)).otherwise("unknown")
    return F.when((F.size(known) == 0) | ~(sacd | cd | digital | vinyl | dvd | tape), "unknown").otherwise(F.coalesce(by_hint, by_files))


def _points(*terms: tuple[Column, int]) -> Column:
    """Points of the first condition that holds, else 0; unknown conditions don't hold."""
    out = F
    for condition, points in terms:
        out = out.when(F.coalesce(condition, F.lit(False)), float(points))
    return out.otherwise(0.0)


def evidence_score(pairs: DataFrame) -> DataFrame:
    """Pairs with terms, ``score``, ``strong``, ``confidence`` and its ``confidence_rank``.

    Columns: local_format, source_hint, format_text, local_count, candidate_count, disc_count,
    media_count, is_set, declared_total, missing_discs, mean_error, fit, barcode_hit, catalogue_hit,
    own_catalogue_hit, disc_id_hits, toc_match, tag_mbid, ctdb_mbid, coverage, fingerprinted,
    artist_hit, title_hit, edition_hit, edition_year, year_hint, has_edition, year, country_hint,
    country, status. Null means unknown, which neither adds nor takes points.
    """
    c, yes = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    # flags are columns of their own: within the terms they would be worked out again and again
    found = format_flags(F.coalesce("format_text", F.lit("")))
    known = (c("local_count") > 0) & c("candidate_count").isNotNull()
    pairs = pairs.withColumns({f"_{k}": v for k, v in found.items()} | {"_text": F.coalesce("format_text", F.lit("")) != "", "count_matches": F.when(known, c("candidate_count") == c("local_count"))})
    f = {k: c(f"_{k}") for k in found}
    text, local, hint, matches = c("_text"), c("local_format"), c("source_hint"), c("count_matches")
    plain_cd = (local == "sacd") & ~f["sacd"] & f["cd"]
    year_hit = c("year_hint") == c("year")
    terms = {
        "p_format": F.when(local == "sacd", _points((f["sacd"], 15), (f["cd"] | f["vinyl"] | f["digital"] | f["dvd"], -20), (text, -5)))
        .when(local == "cd", _points((f["vinyl"], -20), (f["cd"], 8), (f["sacd"], -10))).otherwise(0.0),
        "p_hint": F.when(hint == "vinyl", _points((f["vinyl"], 12), ((local != "cd") & text, -6)))
        .when(hint == "sacd", _points((f["sacd"] & (local != "sacd"), 10))).when(hint == "cd", _points((f["cd"] & (local != "cd"), 6)))
        .when(hint == "digital", _points((f["digital"], 8), (f["vinyl"] | f["dvd"], -6))).when(hint == "dvd", _points((f["dvd"], 10))).otherwise(0.0),
        "p_count": _points((matches, 10), (~matches, -40)),
        "p_discs": F.when((c("disc_count") > 1) & (c("media_count") > 0) & (~yes("is_set") | c("declared_total").isNotNull()), _points((c("media_count") == c("disc_count"), 5), (F.lit(True), -15))).otherwise(0.0),
        "p_missing": _points((c("missing_discs") > 0, -30)),
        "p_durations": F.coalesce(30 * c("fit") + F.when(c("mean_error") > 3 * TOLERANCE, -30.0).otherwise(0.0), F.lit(0.0)),
        "p_barcode": _points((c("barcode_hit"), 40)), "p_catalogue": _points((c("catalogue_hit"), 30)), "p_own": _points((c("own_catalogue_hit"), 15)),
        "p_disc_id": F.when(c("disc_id_hits") > 0, 45.0 + 5 * (c("disc_id_hits") - 1)).otherwise(_points((c("toc_match"), 25))),
        "p_release_id": _points((c("tag_mbid"), 45), (c("ctdb_mbid"), 15)),
        "p_prints": _points((c("coverage") >= 0.8, 35), (c("coverage") >= 0.5, 20), (c("coverage").isNotNull(), 8)),
        "p_text": _points((c("artist_hit"), 10)) + _points((c("title_hit"), 10)),
        "p_edition": _points((c("edition_hit"), 10), (~c("edition_hit"), -5)),
        "p_year": _points((c("edition_year") == c("year"), 8), (year_hit & (yes("has_edition") | c("edition_year").isNotNull()), 2), (year_hit, 5)),
        "p_place": _points((c("country_hint") == c("country"), 6)) + _points((c("status") == "Bootleg", -10)),
    }
    strong = sum((F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0) for x in (c("barcode_hit"), c("catalogue_hit"), c("own_catalogue_hit"), (c("disc_id_hits") > 0) | c("toc_match"), c("tag_mbid"), c("coverage") >= 0.8)), F.lit(0))
    # summed as an array: one generated method with all terms is too long for the JVM to compile
    score = F.aggregate(F.array(*[c(t) for t in terms]), F.lit(0.0), lambda done, x: done + x)
    scored = pairs.withColumns(terms).withColumns({"score": score, "strong": strong})
    proven = F.coalesce((c("coverage") >= 0.999) & (c("fingerprinted") == c("local_count")) & matches, F.lit(False))
    fits = proven | F.when(c("fit").isNull(), F.coalesce(matches, F.lit(True))).otherwise(c("fit") >= 0.6)
    base = fits & F.coalesce(matches, F.lit(True)) & ~plain_cd
    rank = F.when((c("strong") >= 2) & base, 3).when((c("strong") >= 1) & base, 2).when(c("score") >= 20, 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in CONFIDENCE])
    return scored.withColumn("confidence_rank", rank).drop("_text", *[f"_{k}" for k in found]).withColumn("confidence", F.element_at(names, c("confidence_rank") + 1))


def runner_up(scored: DataFrame, keep: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """album_id, candidate_id, score, rival_id, rival_score, margin: the best candidate and its closest rival that is no twin.

    scored: (album_id, candidate_id, score, confidence_rank, twin_key); candidates with a key in common are twins. Columns to
    ``keep`` are the best candidate's. Columns ``within`` are the same for all rows of an album: rows that lie together by them
    are not shuffled. An album whose row has no candidate has no best one, and is left out.
    """
    keep, album = keep or [], [*(within or []), "album_id"]
    # twins are one row, so an album's second row is the closest rival; a candidate without a key is twin to none
    lone = F.when(F.col("twin_key").isNull(), F.col("candidate_id")).alias("lone")
    twins = scored.groupBy(*album, "twin_key", lone).agg(F.max(F.struct("score", "confidence_rank", (-F.col("candidate_id")).alias("minus"), *keep)).alias("b"))
    two = twins.withColumn("r", F.row_number().over(Window.partitionBy(*album).orderBy(F.desc("b")))).where(F.col("r") <= 2)
    both = two.groupBy(*album).agg(F.max(F.when(F.col("r") == 1, F.col("b"))).alias("b"), F.max(F.when(F.col("r") == 2, F.col("b"))).alias("r"))
    return both.where("b.minus is not null").select(
        "album_id", (-F.col("b.minus")).alias("candidate_id"), "b.score", (-F.col("r.minus")).alias("rival_id"), F.col("r.score").alias("rival_score"),
        (F.col("b.score") - F.coalesce("r.score", F.lit(0.0))).alias("margin"), F.col("b.confidence_rank").alias("confidence_rank"), F.col("r.confidence_rank").alias("rival_rank"), *[F.col(f"b.{k}").alias(k) for k in keep],
    )


def decisions(tops: DataFrame) -> DataFrame:
    """Rows of runner_up joined with the pick's facts, with ``is_confident``, ``clear_prints``, ``clear_barcode``, ``proves_audio``.

    Facts: coverage, all_fingerprinted, count_matches, fit, format, barcode_hit, contradicts.
    """
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    audio = yes(c("coverage") >= 0.999) & yes(c("count_matches")) & yes(c("fit") >= 0.75) & ~yes(c("contradicts"))
    rival = yes(c("rival_rank") == 3) & yes(c("rival_score") >= c("score") - 5)
    return tops.withColumns({
        "is_confident": (c("confidence_rank") == 3) & ~rival,
        "proves_audio": audio & (c("confidence_rank") >= 2),
        "clear_prints": audio & yes(c("all_fingerprinted")) & (c("margin") >= CLEAR),
        "clear_barcode": yes(c("count_matches")) & yes(c("fit") >= 0.75) & (c("format") != "unlikely") & yes(c("barcode_hit")) & ~yes(c("contradicts")) & (c("rival_score").isNull() | (c("score") - c("rival_score") >= CLEAR)),
    })


def cover_points(distance: Column) -> Column:
    """Points for a cover that looks like the album's own."""
    return F.when(distance < 0.35, 30).when(distance < 0.6, 15).otherwise(0)


def twin_pairs(candidates: DataFrame) -> DataFrame:
    """album_id, left_id, right_id of candidates of an album that are the same pressing: (album_id, candidate_id, is_sacd, barcode, code).

    Barcode or catalogue number is equal. An OR-join would compare all pairs, so it is two equi-joins.
    """
    a = candidates.select("album_id", "is_sacd", F.col("candidate_id").alias("left_id"), "barcode", "code")
    b = candidates.select("album_id", "is_sacd", F.col("candidate_id").alias("right_id"), "barcode", "code")
    one = a.drop("code").join(b.drop("code"), ["album_id", "is_sacd", "barcode"])
    two = a.drop("barcode").join(b.drop("barcode"), ["album_id", "is_sacd", "code"])
    both = one.select("album_id", "left_id", "right_id").unionByName(two.select("album_id", "left_id", "right_id"))
    return both.where("left_id < right_id").distinct()


def suffix_code_join(local: DataFrame, catalogue: DataFrame) -> DataFrame:
    """album_id, candidate_id, local_key, key: catalogue keys that are equal, or of which one ends the other where the local one is 6 or longer.

    local: (album_id, local_key); catalogue: (candidate_id, key). Blocked by the last six characters, short keys by
    themselves; shorter catalogue keys are looked up among the short ends of the local keys of 6 or more.
    """
    block = lambda k: F.when(F.length(k) >= 6, F.right(k, F.lit(6))).otherwise(k)
    ends = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda n: F.right(F.col("local_key"), n))
    c = catalogue.withColumn("block", block(F.col("key")))
    same = local.withColumn("block", block(F.col("local_key"))).join(c, "block")
    short = local.where(F.length("local_key") >= 6).withColumn("block", F.explode(ends)).join(c.where(F.length("key") < 6), "block")
    met = same.unionByName(short).where(codes_match(F.col("local_key"), F.col("key")))
    return met.select("album_id", "candidate_id", "local_key", "key").distinct()


def suffix_code_counts(local: DataFrame, catalogue: DataFrame) -> DataFrame:
    """local_key, key, pairs of suffix_code_join: how many of its rows have these keys. Only distinct keys are joined."""
    a = local.distinct().groupBy("local_key").agg(F.count("*").alias("albums"))
    b = catalogue.distinct().groupBy("key").agg(F.count("*").alias("candidates"))
    met = suffix_code_join(a.select(F.col("local_key").alias("album_id"), "local_key"), b.select(F.col("key").alias("candidate_id"), "key"))
    return met.select("local_key", "key").join(a, "local_key").join(b, "key").select("local_key", "key", (F.col("albums") * F.col("candidates")).alias("pairs"))


def similar_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of normalised names that are similar: (left_id, name) and (right_id, other) rows.

    Distinct names are joined: equal ones, and either way round the contained ones. A contained name of
    6 or more is looked up by that of its 6-grams which the fewest containers have, a shorter one by itself,
    among all grams of its length of the containers; so containment inside words is found too.
    """
    a, b = left.select("name").where("name <> ''").distinct(), right.select("other").where("other <> ''").distinct()
    long = a.where(F.length("name") >= 6)
    inside = _contained(b.withColumnRenamed("other", "part"), long.withColumnRenamed("name", "whole")).select(F.col("whole").alias("name"), F.col("part").alias("other"))
    around = _contained(long.withColumnRenamed("name", "part"), b.withColumnRenamed("other", "whole")).select(F.col("part").alias("name"), F.col("whole").alias("other"))
    same = a.join(b, F.col("name") == F.col("other"))
    pairs = same.unionByName(inside).unionByName(around).where(similar(F.col("name"), F.col("other"))).distinct()
    return left.join(pairs, "name").join(right, "other").select("left_id", "right_id").distinct()


def _contained(parts: DataFrame, wholes: DataFrame, size: int = 6) -> DataFrame:
    """part, whole of distinct strings, none empty, of which one holds the other."""
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    held = reduce(DataFrame.unionByName, [wholes.where(F.length("whole") >= n).select("whole", F.explode(grams(F.col("whole"), F.lit(n))).alias("gram")) for n in range(1, size + 1)])
    counts = held.where(F.length("gram") == size).groupBy("gram").agg(F.count("*").alias("n"))
    cut = parts.where(F.length("part") >= size).select("part", F.explode(grams(F.col("part"), F.lit(size))).alias("gram")).join(counts, "gram")
    rarest = cut.groupBy("part").agg(F.min(F.struct("n", "gram")).alias("g")).select("part", F.col("g.gram").alias("gram"))
    short = parts.where(F.length("part") < size).select("part", F.col("part").alias("gram"))
    return rarest.unionByName(short).join(held, "gram").where(F.col("whole").contains(F.col("part"))).select("part", "whole")


def toc_matches(discs: DataFrame, tolerance: int) -> DataFrame:
    """disc_id, other_id of tables of contents with equally many tracks and every offset within a tolerance.

    discs: (disc_id, tracks, offsets). Distinct tables are compared, blocked by the number of tracks and the band of the last
    offset; a pair of tables is found one way round, and then joined with the discs of both, whose rows are neither gathered nor compared.
    """
    band = F.floor(F.element_at("offsets", -1) / (tolerance + 1))
    tables = discs.select("tracks", "offsets").distinct().withColumn("band", band)
    others = tables.select("tracks", F.col("offsets").alias("others"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    close = F.forall(F.zip_with("offsets", "others", lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)
    met = tables.join(others, ["tracks", "band"]).where((F.col("offsets") <= F.col("others")) & close)
    met = met.select("tracks", "offsets", "others", (F.col("offsets") == F.col("others")).alias("same"))
    # the answers are many times the discs, so partitions are not to be few because the discs are small
    parts = int(discs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ours = met.join(discs.select("tracks", "offsets", "disc_id"), ["tracks", "offsets"]).select("tracks", F.col("others").alias("offsets"), "same", F.col("disc_id").alias("a"))
    theirs = discs.select("tracks", "offsets", F.col("disc_id").alias("b")).repartition(parts, "tracks", "offsets")
    pairs = ours.repartition(parts, "tracks", "offsets").join(theirs, ["tracks", "offsets"])
    pairs = pairs.where((F.col("a") < F.col("b")) | (~F.col("same") & (F.col("a") > F.col("b"))))
    return pairs.select(F.least("a", "b").alias("disc_id"), F.greatest("a", "b").alias("other_id"))


def wildcard_code_join(local: DataFrame, catalogue: DataFrame) -> DataFrame:
    """album_id, candidate_id, prefix: catalogue numbers that begin with the wildcard prefix of a local one; (album_id, code) and (candidate_id, key) rows.

    A prefix has 4 to 17 characters, so each key has at most 14 beginnings that can be one: an equi-join with
    them, of distinct keys and prefixes, and then with their rows. Rows with null codes, or codes without such a prefix, find nothing.
    """
    ours = local.select("album_id", wildcard_prefix(F.col("code")).alias("prefix")).where("prefix is not null")
    return _prefix_keys(ours, catalogue).join(ours, "prefix").select("album_id", "candidate_id", "prefix")


def wildcard_code_counts(local: DataFrame, catalogue: DataFrame) -> DataFrame:
    """prefix, candidate_id, albums of wildcard_code_join: how many of its rows have these. Albums are counted by prefix first, and never joined."""
    ours = local.select(wildcard_prefix(F.col("code")).alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"))
    found = _prefix_keys(ours, catalogue).groupBy("prefix", "candidate_id").agg(F.count("*").alias("keys"))
    return found.join(ours, "prefix").select("prefix", "candidate_id", (F.col("n") * F.col("keys")).alias("albums"))


def _prefix_keys(ours: DataFrame, catalogue: DataFrame) -> DataFrame:
    """prefix, candidate_id: a row for each catalogue row and each distinct prefix that its key begins with."""
    keys = catalogue.select("candidate_id", glued(F.col("key")).alias("key")).where("key <> ''")
    low, high = WILDCARD_LENGTHS[0], WILDCARD_LENGTHS[-1]
    begins = F.transform(F.sequence(F.lit(low), F.least(F.length("key"), F.lit(high))), lambda n: F.substring(F.col("key"), F.lit(1), n))
    met = keys.select("key").distinct().where(F.length("key") >= low).select("key", F.explode(begins).alias("prefix")).join(ours.select("prefix").distinct(), "prefix")
    return met.join(keys, "key").select("prefix", "candidate_id")
