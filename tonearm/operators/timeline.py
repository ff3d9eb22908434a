"""Disc timelines: prefix sums, starts and ends, windows, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(rows: DataFrame, key: str, pos: str, length: str) -> DataFrame:
    """Rows with ``start``: the lengths of all earlier rows of the key."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def laid_out(rows: DataFrame, key: str, order: list[str], length: str) -> DataFrame:
    """Rows with ``pos``, ``start`` and ``total``: their place, the lengths before them and of all of the key, by one ordering."""
    by = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    total = F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"pos": F.row_number().over(by), "start": before, "total": total})


def ends(rows: DataFrame, key: str, total: Column) -> DataFrame:
    """Rows of (key, start) with ``end``: the next start, or the total."""
    return rows.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start", "pos")), total))


def split_plan(tracks: DataFrame, threshold: int = 150) -> DataFrame:
    """album_id, track, start, end: half-open frame intervals of (album_id, pos, index01, total) rows.

    Audio before the first index becomes track 0 if it is longer than ``threshold`` frames, else it
    is dropped. Albums that break a guard have none: see ``toc_guards``.
    """
    plan = ends(tracks.withColumn("start", F.col("index01")), "album_id", F.col("total"))
    album = Window.partitionBy("album_id").orderBy("start", "pos")
    first = F.min("start").over(album.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    plan = plan.withColumns({"first": first, "place": F.row_number().over(album)})
    interval = lambda track, start, end: F.struct(track.alias("track"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    own = interval(F.col("pos"), F.col("start"), F.col("end"))
    hidden = interval(F.lit(0).cast("int"), F.lit(0), F.col("first"))
    # an album's first row brings its lead-in along
    rows = F.when((F.col("place") == 1) & (F.col("first") > threshold), F.array(hidden, own)).otherwise(F.array(own))
    return plan.select("album_id", F.inline(rows))


def toc_guards(tracks: DataFrame) -> DataFrame:
    """album_id, problem: why no table of contents can be made of (album_id, pos, index01, total) rows; one row a broken album.

    Guards in order: no audio, over 99 tracks, a missing index, an index beyond the end, starts out of order.
    """
    back = F.col("index01") < F.lag("index01").over(Window.partitionBy("album_id").orderBy("pos"))
    per = tracks.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("album_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("index01").isNull()).alias("missing"), F.count_if(F.col("index01") >= F.col("total")).alias("beyond"), F.count_if("back").alias("backs")
    )
    problem = F.when(F.col("n") == 0, "no audio").when(F.col("n") > 99, "too many tracks").when(F.col("missing") > 0, "missing index").when(F.col("beyond") > 0, "index beyond file").when(F.col("backs") > 0, "not monotonic")
    return per.withColumn("problem", problem).where("problem is not null").select("album_id", "problem")


def assign_windows(points: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Points with the ``window_id`` they lie in, null in a gap: points (key, t), windows (key, window_id, start, end).

    Windows of a key are disjoint. The last window that starts at or before a point is carried to it
    over one ordering of both, so no range join compares all pairs.
    """
    w = windows.select(key, F.col("start").alias("t"), F.lit(0).alias("kind"), F.struct("window_id", "end").alias("w"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (key, "t")])
    p = points.withColumns({"kind": F.lit(1), "w": F.lit(None).cast(w.schema["w"].dataType)})
    order = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last("w", ignorenulls=True).over(order)
    both = w.unionByName(p).withColumn("held", held).where("kind = 1")
    return both.withColumn("window_id", F.when(F.col("t") < F.col("held.end"), F.col("held.window_id"))).drop("kind", "w", "held")


def contiguity(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, n, breaks, contiguous: whether each value is the one before and one."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    per = rows.withColumn("step", step).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("step") != 1).alias("breaks"))
    return per.withColumn("contiguous", F.col("breaks") == 0)


def assemble(rows: DataFrame, key: str, order: list[str], starts_frame: Column) -> DataFrame:
    """key, frame, packets, bytes: packets joined to frames, each from a packet that starts one; those before the first start are dropped."""
    frame = F.sum(starts_frame.cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    framed = rows.withColumn("frame", frame).where("frame > 0")
    return framed.groupBy(key, "frame").agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"))


def path_chain(paths: DataFrame, moves: DataFrame, hops: int = 8) -> DataFrame:
    """path, final: where files are after so many moves at most; moves: (old, new) rows, one an old path."""
    out = paths.select("path", F.col("path").alias("final"))
    for i in range(hops):
        step = moves.select(F.col("old").alias(f"o{i}"), F.col("new").alias(f"n{i}"))
        out = out.join(step, out["final"] == step[f"o{i}"], "left").select("path", F.coalesce(f"n{i}", "final").alias("final"))
    return out


def rate_slots(requests: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Requests with ``slot``: each as early as it arrives, but ``gap_ms`` after the one before.

    slot_i = max(arrival_i, slot_{i-1} + gap) has the closed form max over j <= i of (arrival_j - j gap), plus i gap.
    """
    order = Window.partitionBy(key).orderBy("arrive_ms", "req_id")
    n = F.row_number().over(order)
    best = F.max(F.col("arrive_ms") - F.col("n") * gap_ms).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.withColumn("n", n).withColumn("slot", best + F.col("n") * gap_ms).drop("n")
