"""Nearest neighbours, near duplicates and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import ann, fingerprints, jaccard
from tonearm.llm.components import components
from tonearm.llm.hilbert import hilbert_keys

SF = "/root/testdata/sf0.001"


def test_hilbert_steps_are_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def brute(vectors: dict[int, np.ndarray], k: int) -> dict[int, list[int]]:
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in ids:
        if i % 50 == 0:
            s = m @ m[ids.index(i)]
            out[i] = [j for _, j in sorted((-round(float(x), 12), j) for x, j in zip(s, ids, strict=True) if j != i)[:k]]
    return out


def exact_cosine(a: list[float], b: list[float]) -> float:
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def test_nearest_recall_outside_the_fit(spark):
    """Every fifth row asks; the fit sees 100 of the 400 queries, and recall is of the others."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors, asks = ann.valid_vectors(table, "vec_id", "embedding"), F.col("vec_id") % 5 == 0
    ix = ann.CurveIndex(sample=100)
    found, fitted = ann.search(vectors, asks, 5, ix)
    got = found.collect()
    rows = {r.vec_id: list(r.embedding) for r in table.collect()}
    m = np.array([rows[i] for i in sorted(rows)])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids, near = sorted(rows), (m @ m.T) - 3 * np.eye(len(m))
    want = {i: {ids[j] for j in np.argsort(-near[at])[:5]} for at, i in enumerate(ids) if i % 5 == 0}
    by = {q: sorted((r for r in got if r.query_id == q), key=lambda r: r.rank) for q in want}
    shares = [len(want[q] & {r.vec_id for r in by[q]}) / 5 for q in want]
    assert sum(shares) / len(shares) >= 0.9
    # the worst hundred queries can't all be those of the fit: without any hundred of the best the rest still reaches the goal
    assert (sum(shares) - 100) / (len(shares) - 100) >= 0.9
    assert fitted.rows == 2000 and fitted.curves * (2 * fitted.window + 1) < 1.3 * fitted.rows
    for q, line in by.items():
        assert [r.rank for r in line] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in line] == sorted((-r.score, r.vec_id) for r in line)
        assert all(abs(r.score - exact_cosine(rows[q], rows[r.vec_id])) < 1e-12 for r in line)


def test_nearest_prunes_where_vectors_have_structure(spark):
    """Vectors near a surface of three dimensions: the fitted windows hold a small part of the table."""
    rng = np.random.Generator(np.random.PCG64(1))
    m = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 32)) + rng.normal(size=(3000, 32)) * 0.01
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found, fitted = ann.search(ann.valid_vectors(frame, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)
    assert fitted.curves * (2 * fitted.window + 1) < 0.3 * fitted.rows
    want = brute(dict(enumerate(m)), 5)
    hits = {(r.query_id, r.vec_id) for r in found.collect()}
    assert len([1 for q, ids in want.items() for i in ids if (q, i) in hits]) >= 0.9 * sum(map(len, want.values()))


def test_nearest_copies_and_extreme_values(spark):
    """Many copies of one vector (the smallest ids win), squares beyond a double, and repeated ids."""
    rows = [(i, [3.0, 4.0, 0.0]) for i in range(40, 140)] + [(1, [3e200, 4e200, 1e199]), (2, [3e-200, 4e-200, -5e-200]), (3, [-1.0, 0.0, 0.0]), (3, [3.0, 4.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(ann.valid_vectors(frame, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 4).collect()}
    assert [got[50, r][0] for r in range(1, 5)] == [40, 41, 42, 43] and [got[100, r][0] for r in range(1, 5)] == [40, 41, 42, 43]
    one = ann.nearest(ann.valid_vectors(frame, "vec_id", "embedding"), F.col("vec_id") == 1, 103).collect()
    assert [r.vec_id for r in one][:100] == list(range(40, 140)) and {r.vec_id for r in one[100:]} == {2, 3}
    assert abs(next(r.score for r in one if r.vec_id == 3) - exact_cosine([3.0, 4.0, 0.1], [3.0, 4.0, 1.0])) < 1e-12


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>, v string"
    bad = [(None, [1.0, 0.0], "x"), (1, None, None), (2, [], None), (3, [0.0, 0.0], None), (4, [float("nan"), 1.0], None), (5, [float("inf"), 1.0], None), (6, [None, 1.0], None)]
    rows = [(0, [1.0, 0.0], "a"), (50, [1.0, 0.0], "b"), (7, [1.0, 0.0], None), (8, [0.0, 2.0], None), (9, [1.0, 0.0], None)]
    got = ann.nearest(ann.valid_vectors(spark.createDataFrame(rows + bad, schema), "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 7), (0, 2, 9), (0, 3, 50), (50, 1, 0), (50, 2, 7), (50, 3, 9)]
    assert ann.nearest(ann.valid_vectors(spark.createDataFrame([], schema), "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 3).count() == 0
    one = ann.valid_vectors(spark.createDataFrame(rows[:1], schema), "vec_id", "embedding")
    assert ann.nearest(one, F.col("vec_id") % 50 == 0, 3).count() == 0


def shingles(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes_by_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t or "") for d, t in docs}
    text = dict(docs)
    links: dict[int, set[int]] = {d: set() for d in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        same = text[a] is not None and text[b] is not None and text[a].lower() == text[b].lower()
        if same or (x and y and len(x & y) >= 0.8 * len(x | y)):
            links[a].add(b)
            links[b].add(a)
    out: dict[int, tuple[int, int]] = {}
    for d in sorted(sets):
        if d not in out:
            todo, seen = [d], {d}
            while todo:
                for n in links[todo.pop()] - seen:
                    seen.add(n)
                    todo.append(n)
            out |= {n: (d, len(links[n])) for n in seen}
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_by_force(spark, block):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    docs: list[tuple[int, str | None]] = []
    for g in range(12):
        base = rng.choices(words, k=rng.randint(3, 160))
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((len(docs), " ".join(t)))
    docs += [(1000, ""), (1001, ""), (1002, None), (1003, None), (1004, " \n"), (1005, "one"), (1006, "ONE"), (1007, docs[0][1]), (1008, docs[0][1].upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.near_duplicates(frame, jaccard.Forest(block=block)).collect()}
    assert got == classes_by_force(docs)


def test_near_duplicates_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (None, "a b c d e f")]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (1, 1, 1)]


def test_forest_prefixes(spark):
    f = jaccard.Forest()
    k = f.shortest()
    assert 1 - (1 - f.similarity**k) ** f.trees >= f.recall > 1 - (1 - f.similarity ** (k + 1)) ** f.trees
    a, b = np.array([0x0102030405060708, 0, 5], np.int64), np.array([0x0102030405FF0708, -1, 5], np.int64)
    assert jaccard.common_prefix(a, b, 8).tolist() == [5, 0, 8]


def test_forest_shortens_by_what_the_sample_shows(spark):
    """Links of 19 in 20 words meet at the whole depth; links at the threshold shorten the prefix."""
    rng, lengths = random.Random(8), []
    for changed in (1, 9):
        docs = []
        for g in range(150):
            base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            docs += [" ".join(base), " ".join(base[:-changed] + [f"x{rng.randrange(10**6)}" for _ in range(changed)] if changed < 5 else base[: 200 - 4 * changed])]
        rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        rows = rows.withColumn("key", jaccard.text_key(F.col("doc_id"), F.col("text")))
        texts = rows.select("key", F.col("doc_id").alias("rep"), F.col("doc_id").alias("tid"))
        signed, names = jaccard._signed(rows, texts, jaccard.Forest())
        assert len(names) == 300 and all(set(r.met) >= {names.index(bytes(r.key))} for r in signed.collect())
        lengths.append(jaccard.fit_prefix(signed, names, jaccard.Forest())[0])
    assert lengths[0] == 8 and lengths[1] < 8


def test_near_duplicate_recall_on_documents(spark):
    """All links of the documents of the smallest tables, against brute force."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = classes_by_force(docs)
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values()) > 0
    assert len([d for d in want if got[d] == want[d]]) >= 0.99 * len(want)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.comp for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_fingerprints_by_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choices("abcdefghij", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[0][1]), (63, "日本\U0001f600x" * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(9)).repartition(5)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame).collect()}
    text = {d: t or "" for d, t in rows}
    order = sorted(text)
    assert sorted(got) == order
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        k = len(text[d]) // 4
        edited = text[d][: len(text[d]) - k] + text[after][:k]
        assert got[d].n_chars == len(text[d])
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [got[d].edited_fingerprint] == fingerprints.encode(*fingerprints.vectors_of([edited]))
        assert got[d].near_next == 1.0 if text[d] == text[after] else 0 <= got[d].near_next <= 1
    assert got[0].fingerprint == got[62].fingerprint and got[60].fingerprint == got[61].fingerprint
    assert len({got[d].fingerprint for d in got}) == len(set(text.values()))


def test_fingerprint_likeness_by_force(spark):
    """The likeness is near twice the common word runs by those of both; very long repetitive texts too."""
    rng = random.Random(12)

    def runs(t: str) -> Counter:
        out: Counter = Counter()
        for line in t.split("\n"):
            w = line.split()
            out.update([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])
        return out

    texts = []
    for n in (50, 200, 1000):
        a = [f"w{rng.randrange(500)}" for _ in range(n)]
        texts += [(" ".join(a), " ".join(a[: n * k // 10] + [f"v{rng.randrange(500)}" for _ in range(n - n * k // 10)])) for k in (0, 3, 6, 9, 10)]
    a, b = (fingerprints.vectors_of([t[i] for t in texts])[1] for i in (0, 1))
    for (x, y), got in zip(texts, fingerprints.likeness(a, b), strict=True):
        p, q = runs(x), runs(y)
        apart = sum((p[k] - q[k]) ** 2 for k in p | q) / (sum(v * v for v in p.values()) + sum(v * v for v in q.values()))
        assert abs(got - (1 - apart)) < 0.25
    for n in (1000, 70_000, 200_000):
        lanes, sketch = fingerprints.vectors_of(["word " * n, "word " * (n * 3 // 4) + "other " * (n // 4)])
        assert fingerprints.likeness(sketch[:1], sketch[1:])[0] > 0.9
    one = fingerprints.vectors_of(["x"])[0]
    assert len(set(one[0].tolist())) == 8 and hashlib.blake2b(b"x", digest_size=64).digest() == one.astype("<u8").tobytes()


def test_fingerprints_of_a_frequent_id(spark):
    """Null ids and one id with most of the rows are dealt over several ranges in one order."""
    rows = [(None, f"null {i}") for i in range(150)] + [(7, f"seven {i}") for i in range(150)] + [(i, f"t {i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint_documents(frame).collect()
    h = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    edit = lambda t, s: t[: len(t) - len(t) // 4] + s[: len(t) // 4]
    want = Counter((d, hashlib.sha256(edit(t, s).encode()).hexdigest()) for (d, t), (_, s) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_fingerprints_add_and_subtract():
    a, b, both = (fingerprints.encode(*fingerprints.vectors_of([t]))[0] for t in ("one two\nthree", "four five six", "four five six\none two\nthree"))
    assert fingerprints.combine(a, b) == both and fingerprints.combine(both, b, -1) == a


def test_fingerprints_edges(spark):
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"abcdefab").hexdigest())]
    twice = spark.createDataFrame([(None, "n"), (1, "same"), (1, "same"), (1, "other text")], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(twice).count() == 4


def test_batches_without_a_word(spark):
    rows = [(1, ""), (2, None), (3, " \n"), (4, ""), (None, "a b")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in got) == [(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 1, 1)]


def test_prefix_is_shortened_as_far_as_the_sample_asks(spark):
    """Links that share one value only: no floor holds the length up, and what is reached is said."""
    forest = jaccard.Forest(sample=4, trees=2, least_links=3)
    names = [bytes([i]) for i in range(4)]
    nodes = lambda i: [(7 << 56) + (i << 48), i << 57]
    rows = [(names[i], nodes(i + 1), [0, 1, 2, 3]) for i in range(4)]
    signed = spark.createDataFrame(rows, "key binary, nodes array<long>, met array<int>")
    assert jaccard.fit_prefix(signed, names, forest) == (1, 1.0, 12)
    lone = spark.createDataFrame([*rows[:3], (names[3], [-(1 << 62), 9 << 57], [0, 1, 2, 3])], signed.schema)
    length, recall, links = jaccard.fit_prefix(lone, names, forest)
    assert (length, links) == (1, 12) and recall == 0.5
    assert jaccard.fit_prefix(signed.limit(0), names, forest)[0] == forest.shortest()
