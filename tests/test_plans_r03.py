"""Steps that are to be done once: what plans must not hold again."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tonearm.functions import discs
from tonearm.sources import cue

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cue_tracks_and_indexes_need_no_join(spark):
    text = 'TITLE "A"\nFILE "a b.wav" WAVE\n  TRACK 01\n \t \n\tTITLE  "One \x00 two"\nINDEX 01 00:01:00\nFILE b.wav WAVE\nINDEX 02 00:00:01\nTRACK x AUDIO\nINDEX 01 00:00:00'
    cmds = cue.commands(spark.createDataFrame([(1, text)], "album_id long, text string"))
    assert "Join" not in plan(cue.tracks(cmds)) + plan(cue.indexes(cmds))
    assert sorted(map(tuple, cue.tracks(cmds).select("track_ord", "file_ord", "number", "type", "title").collect())) == [(1, 1, 1, "AUDIO", "One two"), (2, 2, 2, "AUDIO", None)]
    assert sorted(map(tuple, cue.indexes(cmds).select("track_ord", "number", "frames", "file_offset").collect())) == [(1, 1, 75, 0), (1, 2, 1, 1), (2, 1, 0, 0)]


def test_cue_albums_need_no_join(spark):
    sheets = [(1, "TRACK 01 AUDIO\nREM COMMENT x"), (2, 'REM COMMENT "ABC-1234"\nTITLE "T"\nFILE a WAVE'), (3, "TRACK 01 AUDIO")]
    found = cue.albums(cue.commands(spark.createDataFrame(sheets, "album_id long, text string")))
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.select("album_id", "title", "catalogue_numbers", "problem").collect())) == [(1, None, [], "track outside file"), (2, "T", ["ABC-1234"], None), (3, None, [], "track outside file")]


def test_disc_ids_visit_their_own_offsets(spark):
    rows = spark.createDataFrame([(1, [150]), (2, None), (3, [150, None]), (4, list(range(120)))], "n int, offsets array<long>")
    made = rows.select(discs.musicbrainz_id(F.lit(1), F.col("n"), F.lit(9000), F.col("offsets")).alias("id"))
    assert "sequence(1, 99" not in plan(made)
    assert [len(r.id) for r in made.collect()] == [28] * 4


def test_evidence_is_scored_once(spark):
    query = entry_module.queries()["decision_flags"](spark, SF)
    assert plan(query).count("LeftOuter") == 1


def test_evidence_terms_are_summed_as_an_array(spark):
    assert "aggregate(array(" in plan(entry_module.queries()["evidence_score"](spark, SF))
    assert "aggregate(array(" in plan(entry_module.queries()["runner_up_margin"](spark, SF))


def test_wrapped_fields_of_plain_and_other_letters(spark):
    """Plain values are cut by places, others by bytes; both as characters one by one."""
    from tonearm.operators import lookups

    def lines(key: str, value: str) -> str:
        done, now = [], ""
        for c in value.replace("\n", " "):
            if len((now + c).encode()) > 249 - len(key.encode()):
                done.append(now)
                now = ""
            now += c
        return "\n".join(f"{key}={x}" for x in [*done, now])

    rows = [(k, v) for k in ("T", "TTITLE10", "é" * 100, "x" * 248) for v in ("", "a", "a\nb" * 100, "ab" * 124, "x" * 248, "x" * 249, "é" + "y" * 600, "日本" * 90)]
    got = spark.createDataFrame(rows, "k string, v string").select("k", "v", lookups.wrapped_field(F.col("k"), F.col("v")).alias("lines"))
    assert "substring" in plan(got)
    assert [(r.k, r.v, r.lines) for r in got.collect()] == [(k, v, lines(k, v)) for k, v in rows]


def test_prefix_of_near_duplicates_is_no_matter_of_the_sample(spark, monkeypatch):
    """Whatever a sample would have, prefixes are as short as the least similarity asks."""
    from tonearm.llm import jaccard

    used, walk = [], jaccard._neighbours
    monkeypatch.setattr(jaccard, "_neighbours", lambda signed, length, forest: (used.append(length), walk(signed, length, forest))[1])
    monkeypatch.setattr(jaccard, "fit_prefix", lambda *_: (8, 1.0, 1000))
    docs = spark.createDataFrame([(i, "a b c d e f g h" if i < 3 else f"x{i} y z") for i in range(6)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert used == [jaccard.Forest().shortest()]


def test_tracks_are_measured_once(spark):
    from tonearm.operators import loudness

    rows = [("short", 480, 0, 1, [0.5] * 48), (None, 480, 0, 1, [0.25] * 240)] + [("t", 480, c, 2, [0.5 / (c + 1)] * 240) for c in (0, 1)]
    got = loudness.measure_tracks(spark.createDataFrame(rows, "track_id string, sample_rate int, channel int, channels int, samples array<double>"))
    assert plan(got).count("MapInPandas") == 1
    found = sorted((str(r.track_id), r.block) for r in got.collect())
    assert found == [("None", None), ("short", None), ("t", 0), ("t", 1)]
    assert entry_module.queries()["measured_tracks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_tag_bytes_are_read_once(spark):
    assert plan(entry_module.queries()["mapped_frames"](spark, SF)).count("ArrowEvalPython") == 1


def test_fields_of_null_and_dated_files(spark):
    from tonearm.operators import tags

    rows = [("a", "id3", 0, "TDAT", "3105"), ("a", "id3", 1, "TYER", " 1984"), ("b", "id3", 0, "TYER", "1984"), ("b", "id3", 1, "TDAT", "0102"), ("b", "id3", 2, "TRCK", "3/9"), ("c", "unknown", None, None, None), ("d", "flac", 0, "DATE", " ")]
    got = tags.mapped_fields(spark.createDataFrame(rows, "path string, container string, ord int, field string, value string"))
    assert sorted(map(tuple, got.collect())) == [("a", "DATE", 0, "1984"), ("b", "DATE", 0, "1984-02-01"), ("b", "TOTALTRACKS", 0, "9"), ("b", "TRACKNUMBER", 0, "3"), ("b", "TRACKTOTAL", 0, "9")]


def test_items_are_read_once_by_all_tasks(spark):
    made = plan(entry_module.queries()["atom_tags"](spark, SF))
    assert made.count("ArrowEvalPython") == 1 and "RepartitionByExpression [p_partkey" in made


def test_names_are_parsed_by_all_tasks(spark):
    assert entry_module.queries()["folder_names"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_split_plan_reads_lines_once(spark):
    from tonearm.plans.registry import dealt

    made = plan(entry_module.queries()["split_plan"](spark, SF))
    assert made.count("Relation") == 1 and "Union" not in made
    assert dealt(spark.range(1000), "id", task_rows=100).rdd.getNumPartitions() == 10
    assert dealt(spark.range(10), "id", task_rows=100).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def largest_part(spark, change) -> int:
    """Rows of the largest partition of 400 albums without a set after a change."""
    from tonearm.plans.albums import _SET

    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("x").alias("o_orderpriority"))
    rows = spark.sql(_SET, o=orders).withColumn("set_id", F.lit(None).cast("long"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = change(rows).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(got) == 400
    return max(sum(r.part == p for r in got) for p in range(4))


def test_albums_without_a_set_join_in_many_tasks(spark):
    from tonearm.operators import albums

    assert largest_part(spark, lambda a: albums.join_set(a, a.where("album_id < 0").select("album_id", F.lit(1).cast("long").alias("to_set")))) < 200


def test_durations_join_albums_before_pairs(spark):
    from tonearm.operators import evidence

    assert "each_n" in plan(entry_module.queries()["duration_fit"](spark, SF)).split("Join Inner")[1].splitlines()[0]  # the pairing join knows the track counts

    members = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (None, 10), (2, 13)], "group long, album_id long")
    tracks = spark.createDataFrame([(10, 1, 5), (10, 2, 7), (11, 1, 9), (11, 2, 7), (12, 1, 5), (12, 2, None), (13, 1, 1)], "album_id long, pos int, seconds long")
    got = evidence.group_duration_fit(members, tracks)
    assert sorted(map(tuple, got.collect())) == [(10, 11, 2.0, 0.75), (11, 10, 2.0, 0.75)]


def test_groups_of_frames_are_measured_together(spark):
    made = plan(entry_module.queries()["bark_bands"](spark, SF))
    assert "FlatMapGroupsInPandas" not in made and made.count("MapInArrow") == 1


def test_frames_keep_large_and_null_ids(spark):
    import numpy as np

    from tonearm.operators import frames

    chunks = spark.createDataFrame([(2**60 + 1, 0, [1.0] * 9), (None, 0, [2.0, None, float("nan"), 2.0])], "track_id long, at long, samples array<double>").coalesce(1)
    got = frames.frame_features(chunks, lambda x: np.asarray(x.sum(axis=1, keepdims=True)), 4, 2, block=2)
    assert sorted(((r.track_id or 0), r.frame, list(r.feature)) for r in got.collect()) == [(0, 0, [4.0]), (2**60 + 1, 0, [4.0]), (2**60 + 1, 1, [4.0]), (2**60 + 1, 2, [4.0])]


def test_checksums_need_no_join(spark):
    from tonearm.operators import batch

    assert "Join" not in plan(entry_module.queries()["ctdb_verify"](spark, SF))
    local = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (None, 1, 5), (2, None, 5)], "disc_id long, pos long, crc long")
    entries = spark.createDataFrame([(1, 1, 3, 1, 5), (1, 2, 3, 1, 9), (1, 2, 3, None, None), (None, 1, 9, 1, 5), (2, 4, 7, None, 5)], "disc_id long, entry_id long, confidence long, pos long, crc long")
    got = sorted(((r.disc_id or 0, r.pos or 0), r.confidence, r.total, r.in_best) for r in batch.verify_checksums(local, entries).collect())
    assert got == [((0, 1), 0, 0, False), ((1, 1), 3, 6, True), ((1, 2), 0, 6, False), ((2, 0), 0, 7, False)]


def test_albums_without_a_set_move_in_many_tasks(spark):
    from tonearm.operators import albums

    assert largest_part(spark, lambda a: albums.reposition(a, a.where("album_id % 7 = 0").select("album_id", F.lit(2).alias("to")))) < 200
