"""Media of releases: layers, discs of sets, plausible counts, plans, tags, covers, rescans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import CLEAR, cover_points


def relevant_media(media: Column, local: Column) -> Column:
    """Media that audio files can come from, of an array of (position, format, tracks).

    Video goes unless all is video. Of a hybrid's layers one stays, after the other media: the first that fits the files, else the first.
    """
    low = lambda m: F.lower(F.coalesce(m["format"], F.lit("")))
    video = lambda m: low(m).contains("dvd") | low(m).contains("blu-ray") | low(m).contains("vhs")
    audio = F.filter(media, lambda m: ~video(m))
    kept = F.when(F.size(audio) > 0, audio).otherwise(media)
    layers, others = F.filter(kept, lambda m: low(m).contains("layer")), F.filter(kept, lambda m: ~low(m).contains("layer"))
    fits = F.filter(layers, lambda m: ((local == "sacd") & low(m).contains("sacd layer")) | ((local == "cd") & low(m).contains("cd layer") & ~low(m).contains("sacd layer")))
    return F.when(F.size(layers) == 0, kept).otherwise(F.concat(others, F.slice(F.concat(fits, layers), 1, 1)))


def paired_media(media: Column, is_set: Column, present: Column) -> Column:
    """All media, or of a set those at the positions present; positions beyond the media give none."""
    at = F.filter(present, lambda p: (p >= 1) & (p <= F.size(media)))
    return F.when(is_set, F.transform(at, lambda p: F.element_at(media, p))).otherwise(media)


def plausible_counts(media: Column, total: Column) -> Column:
    """Track counts that a rip can have: all, all but video, one layer, one layer and the other media."""
    low = lambda m: F.lower(F.coalesce(m["format"], F.lit("")))
    count = lambda keep: F.aggregate(F.filter(media, keep), F.lit(0), lambda s, m: s + F.coalesce(m["tracks"], F.lit(0)))
    layer = lambda m: low(m).contains("layer")
    video = count(lambda m: low(m).contains("dvd") | low(m).contains("blu-ray") | low(m).contains("vhs"))
    others = count(lambda m: ~layer(m))
    layers = F.filter(F.transform(F.filter(media, layer), lambda m: m["tracks"]), lambda n: n.isNotNull())
    found = F.concat(F.array(total), F.array(F.when((video > 0) & (total > video), total - video)), layers, F.transform(layers, lambda n: n + others))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def plan_warnings(locals_: DataFrame, media: DataFrame) -> DataFrame:
    """album_id, disc, warning: discs beyond the release, counts that differ, and discs of the release that are missing.

    locals_: (album_id, disc, files); media: (album_id, disc, tracks).
    """
    both = locals_.join(media, ["album_id", "disc"], "full")
    many = media.groupBy("album_id").agg(F.count("*").alias("discs"))
    known = both.join(many, "album_id", "left")
    warning = F.when(F.col("tracks").isNull(), "no such disc").when(F.col("files").isNull(), F.when(F.col("discs") > 1, "missing")).when(F.col("files") != F.col("tracks"), "count differs")
    return known.withColumn("warning", warning).where("warning is not null").select("album_id", "disc", "warning")


def unusable_tracklist(media_count: Column, local_discs: Column, release_tracks: Column, files: Column) -> Column:
    """The release has fewer discs than the files, or less than half as many tracks."""
    return (media_count < local_discs) | (release_tracks * 2 < files)


def cover_tie_break(scored: DataFrame) -> DataFrame:
    """album_id, candidate_id: the pick that a cover makes clear, of (album_id, candidate_id, score, distance, proves_audio, twin_key) rows.

    Of the six best within 30 points, one at least proven, the one with most points with its cover's
    must be proven and lead every other but twins by 30.
    """
    w = Window.partitionBy("album_id")
    rows = scored.withColumn("lead", F.max("score").over(w) - F.col("score")).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "candidate_id")))
    close = F.col("lead") < CLEAR
    rows = rows.withColumns({"contends": close & (F.col("place") <= 6), "n": F.count_if(close).over(w), "proven": F.count_if(close & F.col("proves_audio")).over(w)})
    rows = rows.withColumn("total", F.col("score") + F.when(F.col("contends"), cover_points(F.col("distance"))).otherwise(0)).where("n > 1 and proven > 0")
    best = rows.where("contends").groupBy("album_id").agg(F.max(F.struct("total", (-F.col("candidate_id")).alias("minus"), "proves_audio", "twin_key")).alias("b"))
    rivals = rows.join(best, "album_id").where((F.col("candidate_id") != -F.col("b.minus")) & ~F.coalesce(F.col("twin_key") == F.col("b.twin_key"), F.lit(False))).groupBy("album_id").agg(F.max("total").alias("rival"))
    clear = best.join(rivals, "album_id", "left").where(F.col("b.proves_audio") & (F.col("b.total") - F.coalesce("rival", F.lit(0.0)) >= CLEAR))
    return clear.select("album_id", (-F.col("b.minus")).alias("candidate_id"))


def album_only_pick(scored: DataFrame) -> DataFrame:
    """album_id, candidate_id: the edition that stands for a release group where no edition is sure.

    scored: (album_id, candidate_id, score, proven, group_id, is_sacd_edition, numbered). Where no
    candidate is an SACD edition, all proven ones within 30 points of the first must share its group;
    the first that numbers its tracks is taken, else the first.
    """
    w = Window.partitionBy("album_id")
    rows = scored.withColumn("sacd", F.bool_or("is_sacd_edition").over(w)).where("proven and not sacd")
    first = F.max(F.struct("score", (-F.col("candidate_id")).alias("minus"), "group_id")).over(w)
    rows = rows.withColumn("f", first).where((F.col("f.score") - F.col("score") < CLEAR) & F.col("f.group_id").isNotNull())
    per = rows.groupBy("album_id").agg(F.bool_and(F.coalesce(F.col("group_id") == F.col("f.group_id"), F.lit(False))).alias("same"), F.max(F.struct("numbered", "score", (-F.col("candidate_id")).alias("minus"))).alias("b"))
    return per.where("same").select("album_id", (-F.col("b.minus")).alias("candidate_id"))


def album_tags(releases: DataFrame, album_only: bool = False) -> DataFrame:
    """release_id, field, value: the album's fields, the edition's left out where only the album is sure."""
    c, date = F.col, F.coalesce("released", "year")
    fields = {
        "ALBUM": c("title"), "ALBUMARTIST": c("artist"), "ORIGINALDATE": c("first_release"), "ORIGINALYEAR": F.left("first_release", F.lit(4)), "RELEASETYPE": F.lower("type"),
        "DISCTOTAL": F.greatest(F.lit(1), c("discs")).cast("string"), "COMPILATION": F.when(F.lower("artist") == "various artists", "1"), "DATE": F.coalesce("first_release", "year") if album_only else date,
    }
    if not album_only:
        fields |= {"LABEL": c("label"), "BARCODE": c("barcode"), "RELEASECOUNTRY": c("country"), "RELEASESTATUS": F.lower("status")}
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()])
    return releases.select("release_id", F.explode(pairs).alias("p")).select("release_id", "p.field", "p.value").where("value is not null and value <> ''")


def referenced_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """folder, ref, found: the file of a folder that a sheet names: exactly, else the first without regard to case, but not in a subfolder."""
    exact = refs.join(files.select("folder", F.col("name").alias("ref"), F.col("name").alias("exact")), ["folder", "ref"], "left")
    loose = files.groupBy("folder", F.lower("name").alias("low")).agg(F.min("name").alias("near"))
    both = exact.withColumn("low", F.when(~F.col("ref").contains("/"), F.lower("ref"))).join(loose, ["folder", "low"], "left")
    return both.select("folder", "ref", F.coalesce("exact", "near").alias("found"))


def relationship_credits(relations: DataFrame) -> DataFrame:
    """recording_id, role, name of (recording_id, type, attributes, name) rows: attributes of instruments and voices are roles."""
    attrs = F.array_join(F.filter("attributes", lambda a: ~a.isin("additional", "guest", "solo")), ", ")
    t = F.lower("type")
    same = ("performer", "performing orchestra", "orchestra", "conductor", "arranger", "producer", "engineer", "mastering", "remixer", "programming", "chorus master", "concertmaster")
    role = F.when(t == "instrument", F.coalesce(F.nullif(attrs, F.lit("")), F.lit("performer"))).when(t == "vocal", F.coalesce(F.nullif(attrs, F.lit("")), F.lit("vocals"))).when(t == "mix", "mixer").when(t == "recording", "recording engineer").when(t.isin(*same), t)
    return relations.withColumn("role", role).where("role is not null and name <> ''").select("recording_id", "role", "name").distinct()


#: Pictures of a gallery, first to last.
PICTURES = ("obi", "front", "back", "medium", "booklet", "other", "discogs")


def preferred_picture(images: DataFrame) -> DataFrame:
    """release_id, image_id, kind: the first kind there is, in the order of the listing."""
    at = F.array_position(F.array(*[F.lit(p) for p in PICTURES]), F.col("kind"))
    return images.groupBy("release_id").agg(F.min(F.struct(at.alias("at"), "image_id", "kind")).alias("b")).select("release_id", "b.image_id", "b.kind")


def rescan(known: DataFrame, seen: DataFrame) -> DataFrame:
    """path, state: advanced states stay, scanned ones are renewed, vanished paths are errors, new ones scanned."""
    both = known.join(seen.withColumn("seen", F.lit(True)), "path", "full")
    state = F.when(F.col("seen").isNull(), "error").when(F.col("state").isNull() | F.col("state").isin("scanned", "error"), "scanned").otherwise(F.col("state"))
    return both.select("path", state.alias("state"))


def chosen_candidate(albums: DataFrame) -> DataFrame:
    """album_id, chosen, selected: a person's choice, else a confident best; a best that is likely at least is selected for review."""
    rank = F.col("confidence_rank")
    return albums.select("album_id", F.coalesce("choice", F.when(F.col("is_confident"), F.col("best_id"))).alias("chosen"), F.coalesce("choice", F.when(rank >= 2, F.col("best_id"))).alias("selected"))


def signal_hints(rows: DataFrame) -> DataFrame:
    """album_id, artist, album, year, edition_year: tags before the sheet before the folder's name; a tag's
    date is the edition's where the original date has another year. Area folders take their parent's name."""
    folder = F.when(F.lower("folder_album").isin("stereo", "multichannel", "5.1", "2.0"), F.col("parent_album")).otherwise(F.col("folder_album"))
    tag, first = F.left("tag_date", F.lit(4)), F.left("tag_original", F.lit(4))
    demoted = F.coalesce(tag != first, F.lit(False))
    return rows.select(
        "album_id", F.coalesce("tag_artist", "cue_artist", "folder_artist").alias("artist"), F.coalesce("tag_album", "cue_album", folder).alias("album"),
        F.coalesce(first, tag, F.left("cue_date", F.lit(4)), "folder_year").alias("year"), F.when(demoted, tag).otherwise(F.col("folder_edition_year")).alias("edition_year"),
    )


def move_plan(files: DataFrame) -> DataFrame:
    """album_id, folders, follows: whether an album's path follows its files: all of them go to one folder; (album_id, target) rows."""
    folder = F.regexp_replace("target", "/[^/]*$", "")
    return files.groupBy("album_id").agg(F.count_distinct(folder).alias("folders")).withColumn("follows", F.col("folders") == 1)
