"""Joins on names, keys and media against brute force, over all rows of both sides."""

from __future__ import annotations

import random
import re
from collections import Counter

import __spark_entry__ as entry_module
from tonearm.operators import batch, evidence

SF = "/root/testdata/sf0.001"


def ends(local: str, key: str) -> bool:
    return local != "" and (local == key or (len(local) >= 6 and (local.endswith(key) or key.endswith(local))))


def test_suffix_code_join_by_force(spark):
    rng = random.Random(2)
    keys = ["ABC12345", "12345", "BC12345", "345", "5", "", "XYZ", "12346", "C12345"] + ["".join(rng.choices("AB", k=rng.randint(1, 9))) for _ in range(60)]
    local, catalogue = list(enumerate(keys)), [(i + 500, k) for i, k in enumerate(keys + keys[:3])]
    got = evidence.suffix_code_join(spark.createDataFrame(local, "album_id long, local_key string"), spark.createDataFrame(catalogue, "candidate_id long, key string"))
    want = sorted((a, c, x, y) for a, x in local for c, y in catalogue if ends(x, y))
    assert sorted(map(tuple, got.collect())) == want
    assert (0, 501, "ABC12345", "12345") in want


def test_catalogue_suffix_join_takes_all_parts(spark):
    parts = [(r.p_partkey, re.sub("[^A-Z0-9]", "", r.p_brand.upper())) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    want = Counter((x, y) for x in [k[p % 2 :] for p, k in parts] for _, y in parts if ends(x, y))
    got = entry_module.queries()["catalogue_suffix_join"](spark, SF).collect()
    assert {(r.local_key, r.key): r.pairs for r in got} == want and len(got) == len(want)


def test_nearest_media_by_force(spark):
    rng = random.Random(4)
    media = [(i, rng.choice([2, 2, 2, 3, 9]), [rng.randint(0, 9), rng.choice([None, 3, 8])]) for i in range(90)] + [(90, 7, [1, 1])]
    frame = spark.createDataFrame(media, "id long, tracks int, durations array<long>")
    got = batch.nearest_media(frame.withColumnRenamed("id", "req_id"), frame.withColumnRenamed("id", "medium_id"), 6, block=8)
    off = lambda x, y: sum(0 if a is None or b is None else abs(a - b) for a, b in zip(x, y, strict=True))
    want = []
    for q, t, x in media:
        met = sorted((off(x, y), m) for m, u, y in media if t == u)
        want += [(q, m, e, k, len(met)) for k, (e, m) in enumerate(met[:6], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nearest_media_compares_few(spark):
    """Unknown durations on both sides, copies, crowded and empty cells: brute force's answers from a small share of all pairs."""
    rng = random.Random(9)
    album = [[rng.randint(100, 400) for _ in range(8)] for _ in range(500)]
    near = [[x + rng.randint(-2, 2) for x in rng.choice(album[:40])] for _ in range(1200)]
    media = [(i, 8, d) for i, d in enumerate(album + near + [album[3]] * 200)]
    media += [(5000 + i, 8, [None if rng.random() < 0.1 else x for x in rng.choice(album)]) for i in range(20)] + [(6000, 1, [None]), (6001, 1, [7]), (6002, 2, [])]
    asks = [(i, t, d) for i, t, d in media if i % 9 == 0 or i >= 5000] + [(9000, 8, [1] * 8), (9001, 8, [9999] * 8), (9002, 3, [1, 2, 3])]
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} long, tracks int, durations array<long>")
    got = batch.nearest_media(frame(asks, "req_id"), frame(media, "medium_id"), 6, block=16, counted=True).collect()
    off = lambda x, y: sum(0 if a is None or b is None else abs(a - b) for a, b in zip(x, y))  # noqa: B905, E731
    want = []
    for q, t, x in asks:
        met = sorted((off(x, y), m) for m, u, y in media if t == u)
        want += [(q, m, e, k, len(met)) for k, (e, m) in enumerate(met[:6], 1)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    compared = {r.req_id: r.compared for r in got if 500 <= r.req_id < 1700}  # those with close answers; others can't meet few
    assert len(compared) > 100 and sum(compared.values()) < 0.15 * len(compared) * len(media)
    assert batch.nearest_media(frame(asks, "req_id"), frame([], "medium_id"), 6).count() == 0


def test_places_by_ranges(spark):
    from tonearm.operators.ordering import numbered

    rng = random.Random(3)
    values = [(rng.choice([None, "a", "a", "b"]), i) for i in range(3000)]
    frame = spark.createDataFrame(values, "name string, id long").repartition(7)
    got = numbered(frame, [frame["name"], frame["id"]], parts=23)
    order = sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    assert {r.id: r.place for r in got.collect()} == {v[1]: n for n, v in enumerate(order, 1)}
    assert numbered(frame.limit(0), [frame["id"]]).count() == 0


def test_every_order_is_a_request_and_a_wanted_album(spark):
    orders = [(r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    ranked = entry_module.queries()["cddb_rank"](spark, SF)
    assert ranked.select("req_id").distinct().count() == len(orders)
    ids = {(o, p) for o, c in orders for p, b in orders if o != p and ((o % 4 and p % 3 and c == b) or ((o % 4 == 0 or p % 3 == 0) and (c % 97, c % 89) == (b % 97, b % 89)))}
    assert {tuple(r) for r in entry_module.queries()["library_duplicates"](spark, SF).collect()} == ids


def test_similar_names_by_force(spark):
    rng = random.Random(6)
    names = ["abbeyroad", "abbey", "abbey road", "a", "road", "", "beyro", "beyroad", "xabbeyroadx", "abbeyroad"] + ["".join(rng.choices("ab ", k=rng.randint(1, 12))).strip() for _ in range(60)]
    left, right = list(enumerate(names)), list(enumerate(reversed(names)))
    alike = lambda x, y: bool(x and y) and (x == y or (len(x) >= 6 and (x in y or y in x)))
    got = evidence.similar_names(spark.createDataFrame(left, "left_id long, name string"), spark.createDataFrame(right, "right_id long, other string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, x in left for j, y in right if alike(x, y))
    parts = [r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    want = Counter((x, y.split(" ")[0]) for x in parts for y in parts if alike(x, y.split(" ")[0]))
    assert {(r.name, r.other): r.pairs for r in entry_module.queries()["similar_name_pairs"](spark, SF).collect()} == want


def test_nearest_media_answers_equal_requests_once(spark):
    """Crowds of equal requests and media: brute force's answers, and no more entries met than there are different media."""
    media = [(i, 1, [i % 3, 5]) for i in range(400)]
    frame = spark.createDataFrame(media, "id long, tracks int, durations array<long>")
    got = batch.nearest_media(frame.withColumnRenamed("id", "req_id"), frame.withColumnRenamed("id", "medium_id"), 6, block=8, counted=True).collect()
    want = [(q, m, 0, k, 400) for q, _, (d, _) in media for k, m in enumerate(range(d, 18, 3), 1)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert max(r.compared for r in got) <= 3


def test_toc_matches_by_force(spark):
    """Copies are joined as discs, but compared once; each pair stands once."""
    rng = random.Random(12)
    discs = [(i, rng.choice([None, 2, 3]), [rng.randint(0, 5), 100 + rng.randint(0, 5)]) for i in range(150)] + [(0, 2, [0, 100])]
    met = evidence.toc_matches(spark.createDataFrame(discs, "disc_id long, tracks int, offsets array<long>"), 2)
    want = [(a, b) for a, t, x in discs for b, u, y in discs if t is not None and t == u and a < b and all(abs(p - q) <= 2 for p, q in zip(x, y, strict=True))]
    assert sorted(map(tuple, met.collect())) == sorted(want)
    joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "lambda" not in joins[0] and "lambda" not in joins[1]  # discs meet by equal keys; only tables are compared


def test_owned_duplicates_with_several_rows(spark):
    """Folders and albums of several ids and codes are found once; pairs of lone rows pass no exchange after their join."""
    from tonearm.operators import library

    rng = random.Random(13)
    some = lambda n: rng.choice([None, *range(n)])
    wanted = [(rng.randint(0, 60), rng.randint(0, 9), some(4), some(3), some(3)) for _ in range(70)]
    index = [(rng.randint(0, 60), some(4), some(3), some(3)) for _ in range(70)]
    got = library.owned_duplicates(spark.createDataFrame(wanted, "album_id long, own_folder long, release_key long, barcode long, code long"), spark.createDataFrame(index, "folder long, release_id long, barcode long, code long"))
    known = lambda x, y: x is not None and x == y
    want = {(a, f) for a, o, r, b, c in wanted for f, s, x, y in index if f != o and (known(r, s) or ((r is None or s is None) and known(b, x) and known(c, y)))}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_collision_suffix_of_many(spark):
    from tonearm.operators import library

    paths = [(i, "A/x.flac" if i % 2 else "a/x.flac") for i in range(1100)] + [(2000, "b")]
    got = {r.ord: r.final for r in library.collision_suffix(spark.createDataFrame(paths, "ord long, path string")).collect()}
    assert got == {i: p.removesuffix(".flac") + "".join(f".{k}" for k in range(2, i + 2)) + ".flac" for i, p in paths[:1100]} | {2000: "b"}
    assert library.collision_suffix(spark.createDataFrame([], "ord long, path string")).count() == 0


def test_wildcard_code_counts(spark):
    """Counts of the join's rows, from albums counted before it."""
    local = spark.createDataFrame([(i, c) for i, c in enumerate(["CAPP 10", "capp-10 SA", "CAPP 101", None, "A 1", "x"] * 3)], "album_id long, code string")
    keys = spark.createDataFrame([(1, "CAPP1012"), (1, "capp 10"), (2, "Capp 10"), (3, None), (4, "CAP")], "candidate_id long, key string")
    want = Counter((r.prefix, r.candidate_id) for r in evidence.wildcard_code_join(local, keys).collect())
    counts = evidence.wildcard_code_counts(local, keys)
    assert {(r.prefix, r.candidate_id): r.albums for r in counts.collect()} == want and want["CAPP10", 1] == 12
