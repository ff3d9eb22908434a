"""Albums in a library: their files on releases, owners, sets, states, order and small rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import disc_token, natural_key, without_disc_token
from .ordering import numbered
from .tags import merge_diff

#: States of an album and, of each, those that may follow.
STATES = {
    "pending": ("scanning",), "scanning": ("scanned",), "scanned": ("identifying",), "identifying": ("confident", "needsReview"), "confident": ("applying", "identifying"), "needsReview": ("applying", "identifying"),
    "applying": ("done",), "done": ("identifying",), "error": ("pending", "scanning", "identifying"),
}
#: Seconds without news after which a scan counts as stalled.
STALL_SECONDS = 15
#: CD frames in a second.
FRAMES = 75


def release_key(source: Column, provider_id: Column, own_id: Column) -> Column:
    """The name of a release across providers: ``mb:`` and the id in lower case, ``discogs:`` and the id, else its own id."""
    return F.when(source == "musicbrainz", F.concat(F.lit("mb:"), F.lower(provider_id))).when(source == "discogs", F.concat(F.lit("discogs:"), provider_id)).otherwise(own_id)


def queue_order(albums: DataFrame) -> DataFrame:
    """(album_id, added_at, title) rows with ``place``: the newest first, then by title in natural order."""
    keys = [-F.col("added_at").cast("long"), natural_key(F.coalesce("title", F.lit(""))), F.col("album_id")]
    return numbered(albums, keys)


def place_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """album_id, path, disc, track, owner: where each audio file stands on the release.

    files: (member, path, disc, ord); members: (member, album_id, position). A member of one disc stands at its position in the
    set, one of several keeps its own disc numbers; tracks count from 0 within a disc.
    """
    discs = files.groupBy("member").agg(F.count_distinct("disc").alias("discs"))
    rows = files.join(members, "member").join(discs, "member")
    track = F.row_number().over(Window.partitionBy("member", "disc").orderBy("ord", "path")) - 1
    return rows.select("album_id", "path", F.when(F.col("discs") > 1, F.col("disc")).otherwise(F.col("position")).alias("disc"), track.alias("track"), F.col("member").alias("owner"))


def release_tracks_of(placed: DataFrame, tracks: DataFrame) -> DataFrame:
    """Placed files with ``title``, ``recording_id`` and ``album_index`` of the release track; files without one are left out.

    tracks: (album_id, disc, track, title, recording_id), discs from 1 and tracks from 0; the index counts over all discs.
    """
    index = F.row_number().over(Window.partitionBy("album_id").orderBy("disc", "track")) - 1
    return placed.join(tracks.withColumn("album_index", index), ["album_id", "disc", "track"])


def secondary_credits(placed: DataFrame, releases: DataFrame, credits: DataFrame) -> DataFrame:
    """path, role, name: credits of another catalogue's release, by the index over the album.

    releases: (album_id, release_id, track_count, other_id, other_count); credits: (other_id, album_index, role, name). Only
    where the other release is not the same one and has as many tracks; a release without a list of tracks takes any.
    """
    fit = (F.col("other_id") != F.col("release_id")) & ((F.col("track_count") == 0) | (F.col("track_count") == F.col("other_count")))
    others = releases.where(fit).select("album_id", "other_id")
    return placed.join(others, "album_id").join(credits, ["other_id", "album_index"]).select("path", "role", "name")


def owned(reports: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of (album_id, path, leader) with ``owner``: the member that a file belongs to, else the album's leader."""
    own = placed.groupBy("path").agg(F.min("owner").alias("owner"))
    return reports.join(own, "path", "left").withColumn("owner", F.coalesce("owner", "leader"))


def disc_position(set_size: Column, set_place: Column, discs: Column, name: Column) -> tuple[Column, Column]:
    """Number and total of a disc in its set: as the disc itself says; none for an album of several discs; else as the name does."""
    number, total = disc_token(name)
    own = F.coalesce(set_size > 1, F.lit(False))
    return F.when(own, set_place).when(discs <= 1, number), F.when(own, set_size).when(discs <= 1, total)


def set_base(set_size: Column, title: Column, name: Column) -> Column:
    """What members of a set share: the disc's own title or the folder's name, without its disc token."""
    return without_disc_token(F.when(F.coalesce((set_size > 1) & (title != ""), F.lit(False)), title).otherwise(name))


def relocked(existing: DataFrame, proposed: DataFrame, identity: list[str], locks: DataFrame, toggled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merge of every file's tags after some locks were turned over, and the locks: ``toggled`` fields are locked if they were not, and free if they were."""
    both = locks.select("field", F.lit(1).alias("n")).distinct().unionByName(toggled.select("field", F.lit(1).alias("n")).distinct())
    now = both.groupBy("field").agg(F.sum("n").alias("n")).where("n = 1").select("field")
    return merge_diff(existing, proposed, identity, now), now


def whole_frames(files: DataFrame) -> DataFrame:
    """album_id, frames, problem of (album_id, ord, samples, rate) rows: the frames of each file in order, or why there is no table of contents.

    Every file must be whole CD frames long, and its rate a multiple of 75.
    """
    per = F.floor(F.col("rate") / FRAMES)
    ok = (F.col("rate") % FRAMES == 0) & (per > 0) & (F.col("samples") % F.greatest(per, F.lit(1)) == 0)
    rows = files.groupBy("album_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.array_sort(F.collect_list(F.struct("ord", F.floor(F.col("samples") / F.greatest(per, F.lit(1))).alias("n")))).alias("f"))
    return rows.select("album_id", F.when(F.col("ok"), F.transform("f", lambda x: x["n"])).alias("frames"), F.when(~F.col("ok"), "not frame aligned").alias("problem"))


def primary_first(images: DataFrame) -> DataFrame:
    """(release_id, ord, is_primary) rows with ``place``: primary images first, otherwise in their order."""
    return images.withColumn("place", F.row_number().over(Window.partitionBy("release_id").orderBy(F.desc(F.coalesce("is_primary", F.lit(False))), "ord")))


def lifecycle(events: DataFrame) -> DataFrame:
    """album_id, ord, state, before, allowed: of (album_id, ord, state) rows whether each state may follow the one before; any may end in an error, and the first is pending."""
    before = F.lag("state").over(Window.partitionBy("album_id").orderBy("ord"))
    steps = F.create_map(*[x for s, to in STATES.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]))])
    rows = events.withColumn("before", before)
    follows = F.array_contains(F.element_at(steps, F.col("before")), F.col("state"))
    return rows.withColumn("allowed", F.when(F.col("before").isNull(), F.col("state") == "pending").when(F.col("state") == "error", True).otherwise(F.coalesce(follows, F.lit(False))))


def stalled(scans: DataFrame, now: Column, seconds: int = STALL_SECONDS) -> DataFrame:
    """(root, started, finished, last_seen) rows with ``stalled``: not finished, and nothing heard for longer than some seconds."""
    heard = F.greatest(F.col("started"), F.coalesce("last_seen", "started"))
    return scans.withColumn("stalled", F.col("finished").isNull() & (now - heard > seconds))


def code_sets(rows: DataFrame) -> DataFrame:
    """Rows of arrays (ours, theirs) with ``common``, ``disjoint`` and ``only_ours``."""
    return rows.withColumns({"common": F.array_intersect("ours", "theirs"), "disjoint": ~F.arrays_overlap("ours", "theirs"), "only_ours": F.array_except("ours", "theirs")})


def _reset(rows: DataFrame, changed: Column) -> DataFrame:
    """A set that changed loses its members' identification, and reviewed ones are only scanned again."""
    back = changed & F.coalesce(F.col("identified"), F.lit(False))
    return rows.withColumns({"state": F.when(back & F.col("state").isin("confident", "needsReview"), "scanned").otherwise(F.col("state")), "identified": F.col("identified") & ~back})


def group_albums(albums: DataFrame, chosen: DataFrame) -> DataFrame:
    """Albums after some were made one set: (album_id, title, disc, declared, set_id, position, total, state, identified) rows and (album_id, new_set) ones.

    Members are ordered by the disc that they name, then by title; a position is that disc or the place. The total is the
    largest of what members declare, their positions and their number. A set of one album changes nothing.
    """
    rows = albums.join(chosen, "album_id", "left")
    w = Window.partitionBy("new_set")
    place = F.row_number().over(w.orderBy(F.col("disc").asc_nulls_last(), natural_key(F.coalesce("title", F.lit(""))), "album_id"))
    inside = rows.where("new_set is not null").withColumn("n", F.count("*").over(w)).withColumn("new_position", F.coalesce("disc", place))
    inside = inside.withColumn("new_total", F.greatest(F.coalesce(F.max("declared").over(w), F.lit(0)), F.max("new_position").over(w), F.col("n").cast("int")))
    grouped = F.col("n") > 1
    inside = _reset(inside.withColumns({"set_id": F.when(grouped, F.col("new_set")).otherwise(F.col("set_id")), "position": F.when(grouped, F.col("new_position")).otherwise(F.col("position")), "total": F.when(grouped, F.col("new_total")).otherwise(F.col("total"))}), grouped)
    return rows.where("new_set is null").select(albums.columns).unionByName(inside.select(albums.columns))


def ungroup_albums(albums: DataFrame, sets: DataFrame) -> DataFrame:
    """Albums after some sets were taken apart: (set_id) rows; their members have no place in a set any more."""
    gone = F.coalesce("gone", F.lit(False))
    rows = albums.join(sets.select("set_id", F.lit(True).alias("gone")).distinct(), "set_id", "left")
    rows = _reset(rows, gone).withColumns({c: F.when(~gone, F.col(c)) for c in ("position", "total")})
    return rows.withColumn("set_id", F.when(~gone, F.col("set_id"))).select(albums.columns)


def _members():
    """A window over the members of a set; an album without a set is alone, so that these don't meet in one task."""
    return Window.partitionBy("set_id", F.when(F.col("set_id").isNull(), F.col("album_id")))


def reposition(albums: DataFrame, moves: DataFrame) -> DataFrame:
    """Albums after some got another position, of 1 at least: (album_id, to) rows; a set's total is the largest position, and never falls."""
    rows = albums.join(moves.where("to >= 1"), "album_id", "left").withColumn("position", F.coalesce("to", "position"))
    w = _members()
    moved = F.max(F.col("to").isNotNull()).over(w) & F.col("set_id").isNotNull()
    return rows.withColumn("total", F.when(moved, F.greatest(F.max("position").over(w), F.coalesce("total", F.lit(0)))).otherwise(F.col("total"))).select(albums.columns)


def join_set(albums: DataFrame, late: DataFrame) -> DataFrame:
    """Albums after late ones joined a set: (album_id, to_set) rows, one for a set. A late disc has the position that it names, else the one after the last."""
    rows = albums.join(late, "album_id", "left").withColumn("set_id", F.coalesce("to_set", "set_id"))
    w = _members()
    came = F.col("to_set").isNotNull()
    top = F.coalesce(F.max(F.when(~came, F.col("position"))).over(w), F.lit(0))
    rows = rows.withColumn("position", F.when(came, F.coalesce("disc", top + 1)).otherwise(F.col("position")))
    changed = F.col("set_id").isNotNull() & F.coalesce(F.max(came).over(w), F.lit(False))
    total = F.greatest(F.coalesce(F.max("declared").over(w), F.lit(0)), F.max("position").over(w), F.count("*").over(w).cast("int"))
    return _reset(rows.withColumn("total", F.when(changed, total).otherwise(F.col("total"))), changed).select(albums.columns)


#: Encodings of a disc's character set codes; others are read as UTF-8.
CHARSETS = {2: "latin-1", 3: "shift_jis", 7: "latin-1"}


def _disc_text(content: bytes | None, code: int | None) -> str | None:
    data = bytes(content or b"").partition(b"\x00")[0]
    for charset in (CHARSETS.get(code, "utf-8"), "utf-8", "latin-1"):
        try:
            return data.decode(charset).strip() if data else None
        except UnicodeDecodeError:
            continue
    return None


def disc_text(content: Column, code: Column) -> Column:
    """Text of a disc up to its first zero byte, by the code of its character set; what is no such text is read as UTF-8, else byte by byte; nothing is null.

    Spark's own decode knows no Shift-JIS.
    """

    @F.pandas_udf("string")
    def of(content: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([_disc_text(b, None if pd.isna(c) else int(c)) for b, c in zip(content, code, strict=True)], dtype="object")

    return of(content, code)


#: Parameters of the fingerprint presets: samples of a frame and shared by neighbours, whether notes are interpolated, and the silence below which a start is dropped.
PRESETS = {
    1: dict(frame=4096, overlap=4096 - 4096 // 3, interpolate=False, silence=0), 2: dict(frame=4096, overlap=4096 - 4096 // 3, interpolate=False, silence=0), 3: dict(frame=4096, overlap=4096 - 4096 // 3, interpolate=True, silence=0),
    4: dict(frame=4096, overlap=4096 - 4096 // 3, interpolate=False, silence=50), 5: dict(frame=2048, overlap=2048 - 2048 // 4, interpolate=False, silence=0),
}


def preset_frames(tracks: DataFrame) -> DataFrame:
    """(preset, samples) rows with ``frames``: how many overlapping frames a preset makes of a track."""
    at = lambda k: F.element_at(F.create_map(*[x for p, v in PRESETS.items() for x in (F.lit(p), F.lit(v[k]))]), F.col("preset"))
    hop = at("frame") - at("overlap")
    return tracks.withColumn("frames", F.when(F.col("samples") >= at("frame"), F.floor((F.col("samples") - at("frame")) / hop) + 1).otherwise(0).cast("long"))
