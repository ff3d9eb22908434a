"""Steps that must not move or parse rows again and again: what plans must not hold, and the results beside it."""

from __future__ import annotations

import random
import re

import pytest

import __spark_entry__ as entry_module
from tonearm.operators import evidence
from tonearm.sources import cue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unbroadcast(spark):
    """Small tables are planned as large ones."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def dealt_by(frame) -> list[str]:
    """The keys of each shuffle."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", frame._jdf.queryExecution().executedPlan().toString())


def test_scored_pairs_are_not_shuffled(unbroadcast):
    keys = dealt_by(entry_module.queries()["evidence_score"](unbroadcast, SF))
    assert keys and not [k for k in keys if "candidate_id" in k]


def test_facts_of_a_group(spark):
    """Pairs without comparable durations stay, with null; an album without tracks has no pair."""
    members = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("g", 4), ("h", 5), ("g", 6)], "group string, album_id long")
    tracks = spark.createDataFrame([(1, 2, 5), (1, 1, 3), (2, 1, 4), (2, 2, 9), (3, 1, 3), (4, 1, None), (4, 2, 1), (5, 1, 1)], "album_id long, pos int, seconds long")
    got = [tuple(r) for r in evidence.group_facts(members, tracks, 1000).collect()]
    assert len(got) == 12 and {r[:5] for r in got} == {("g", a, b, m, n) for a, m in ((1, 2), (2, 2), (3, 1), (4, 2)) for b, n in ((1, 2), (2, 2), (3, 1), (4, 2)) if a != b}
    assert sorted(r[1:3] + r[5:] for r in got if r[5] is not None) == [(1, 2, 2.5, 0.6875), (2, 1, 2.5, 0.6875)]
    assert all((r[5] is None) == (r[6] is None) for r in got)
    alone = [tuple(r) for r in evidence.group_facts(members, tracks, 1000, alone=True).where("candidate_id is null").collect()]
    assert alone == [("h", 5, None, 1, None, None, None)]


def test_rivals_are_found_where_pairs_are(unbroadcast):
    keys = dealt_by(entry_module.queries()["runner_up_margin"](unbroadcast, SF))
    assert keys and not [k for k in keys if "twin_key" in k or "candidate_id" in k]


def test_rivals_within_a_group(spark):
    rows = [("g", 1, 2, 9.0, 3, 0), ("g", 1, 3, 8.0, 3, 0), ("g", 1, 4, 7.0, 2, 1), ("g", 2, 1, 5.0, 1, None), ("g", 2, 3, 5.0, 1, None), ("h", 5, None, 1.0, 0, None)]
    scored = spark.createDataFrame(rows, "group string, album_id long, candidate_id long, score double, confidence_rank int, twin_key long")
    for within in (None, ["group"]):
        got = evidence.runner_up(scored, within=within).select("album_id", "candidate_id", "rival_id", "margin").collect()
        assert sorted(map(tuple, got)) == [(1, 2, 4, 2.0), (2, 1, 3, 0.0)]


def test_decisions_shuffle_no_pair(unbroadcast):
    keys = dealt_by(entry_module.queries()["decision_flags"](unbroadcast, SF))
    assert keys and not [k for k in keys if "twin_key" in k or "candidate_id" in k]


def test_cue_sheets_are_cut_once_within_their_rows(spark):
    frame = entry_module.queries()["cue_tracks"](spark, SF)
    made = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in made and "Join" not in made
    assert made.count("[\\s\\x00]+") == 1
    assert len(dealt_by(frame)) == 1


def test_starts_are_what_tracks_indexes_and_albums_say(spark):
    pieces = ['FILE "a b.wav" WAVE', "file c", "TRACK 01 AUDIO", "\ttrack 07  DATA", "TRACK x", 'TITLE "One"', "TITLE", "title  two \x00 words", "TITLE a\rb", 'ISRC "Q" ', "INDEX 00 00:00:00", "INDEX 01 00:01:02", "INDEX 1 00:02:00", "INDEX 01 00:99:00", "INDEX 01", " \x00 ", ""]
    deal = random.Random(4)
    texts = [("\ufeff" if i % 9 == 0 else "") + ("FILE f WAVE\n" if i % 4 else "") + ("\n", "\r\n")[i % 2].join(deal.choices(pieces, k=deal.randrange(16))) for i in range(500)]
    sheets = spark.createDataFrame([*enumerate(texts), (500, None)], "album_id long, text string")
    cmds = cue.commands(sheets)
    first = cue.indexes(cmds).where("number = 1").select("album_id", "track_ord", "frames")
    whole = cue.albums(cmds).where("problem is null").select("album_id")
    want = cue.tracks(cmds).join(first, ["album_id", "track_ord"]).join(whole, "album_id", "left_semi").select("album_id", "track_ord", "number", "title", "isrc", "frames")
    got = cue.starts(sheets)
    assert got.dtypes == want.dtypes and got.count() > 100
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_library_rows_are_dealt_by_album_and_folder_once(unbroadcast):
    """What a side is made distinct and counted by needs one shuffle of it, not two."""
    keys = dealt_by(entry_module.queries()["library_duplicates"](unbroadcast, SF))
    assert keys and not [k for k in keys if len(k.split(",")) > 2]
