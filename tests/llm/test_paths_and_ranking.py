"""Chosen-path joins and ranked search against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tonearm.llm import paths, queries, ranking

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_sets(rows: list[tuple]) -> list[frozenset]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    return [frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else []) for w in words]


def plain_components(rows: list[tuple]) -> Counter:
    sets, above = plain_sets(rows), list(range(len(rows)))

    def top(i: int) -> int:
        while above[i] != i:
            i = above[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            above[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append(d)
    return Counter((d, len(s), min(least[top(i)]), d == min(least[top(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found_components(spark, rows: list[tuple], parts: int = 3, join: paths.PathJoin = paths.PathJoin()) -> Counter:
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("tid", F.lit("x"))
    return Counter(map(tuple, paths.near_duplicate_components(frame.repartition(parts), join).collect()))


def test_components_equal_brute_force_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op13_chosen_paths(spark, SF).collect())) == plain_components(rows)


def test_components_of_edge_rows(spark):
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(40_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (3, "ONE"), (9, "one two"), (4, "É b"), (2, "é b"), (10, "a b c d e f"), (11, "A b c d e f g"), (1, "a b c d e f"), (1, "other words stand here"), (1, None)]
    rows += [(20, long), (21, long + " more"), (22, long[: len(long) // 2])]
    assert found_components(spark, rows) == plain_components(rows) == found_components(spark, rows, 1)
    assert found_components(spark, [*rows, (None, "a b c d e f")]) == plain_components(rows)
    assert not found_components(spark, []) and set(found_components(spark, [(3, None)])) == {(3, 0, 3, True)}


def test_components_of_families_and_chains(spark):
    """Families of near copies too large for exhaustive nodes, an outlier as their least id, and a chain whose ends are not alike."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(500 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 90))) for i in range(60)]
    rows += [(1, " ".join(base[:95] + [f"o{i}" for i in range(20)]))]
    small = paths.PathJoin(block=16, block_shingles=2000, partners=16)
    want = plain_components(rows)
    assert found_components(spark, rows) == want == found_components(spark, rows, 4, small)
    assert len({c for d, _, c, _ in want if 500 <= d < 560}) == 1


def test_recall_of_pairs_at_the_least_similarity():
    """Shares of pairs that meet in one tree and in all, for sets that are just similar enough."""
    join, rng = paths.PathJoin(), np.random.Generator(np.random.PCG64(3))
    n, depth = 1500, 4
    sets = []
    for _ in range(n):
        h = np.unique(rng.integers(0, 1 << 63, 220, dtype=np.uint64))[:200]
        sets += [h[:180], np.concatenate((h[20:180], h[180:200]))]  # 160 of 200: exactly 0.8
    values = paths.min_values(sets, join)
    met, share = np.zeros(n, bool), []
    for t in range(join.trees(depth)):
        row, path = paths.chosen_paths(values, t, depth, join)
        have = defaultdict(set)
        for r, p in zip(row.tolist(), path.tolist(), strict=True):
            have[r].add(p)
        now = np.array([bool(have[2 * i] & have[2 * i + 1]) for i in range(n)])
        share.append(now.mean())
        met |= now
    assert abs(np.mean(share) - (1 - join.missed(depth))) < 0.03 and met.mean() >= 0.997
    alike = (values[0::2] == values[1::2]).sum(1)
    assert alike.min() >= join.least_alike()


def plain_search(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := find(t))]
    n, words = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, length in held:
            m = 25 + (75 * length * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in find(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d, score))
        out += [(item, rank, d, score) for rank, (_, _, d, score) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def found_search(spark, docs, items, search=ranking.Search(), parts: int = 3) -> Counter:
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("score", F.lit(0))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    return Counter(map(tuple, ranking.search_documents(frame.repartition(parts), asked, search).collect()))


def test_search_equals_plain_ranking(spark):
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(700)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(40)]
    want = Counter(plain_search(docs, items))
    for search in (ranking.Search(), ranking.Search(postings=64, primed=1), ranking.Search(items=7, item_terms=50, postings=1000)):
        assert found_search(spark, docs, items, search) == want


def test_search_of_edge_rows(spark):
    docs = [(1, "Größe-GROSS_a1 größe"), (2, None), (3, ""), (4, "-- !!"), (None, "a1 b2"), (5, "a1 b2"), (5, "a1 b2"), (6, "B2 İ A1"), (7, "x " * 90_000 + "rare"), (-8, "a1 b2")]
    items = [(1, "größe a1 a1 a1"), (2, None), (3, "nothing here"), (4, "rare x"), (None, "b2"), (5, "GRÖSSE İ"), (6, "b2 a1")]
    assert found_search(spark, docs, items) == Counter(plain_search(docs, items)) == found_search(spark, docs, items, parts=1)
    assert not found_search(spark, [], items) and not found_search(spark, docs, []) and not found_search(spark, [(1, None)], items)


def test_pivots_skip_documents():
    """Of many documents with only frequent terms few are scored once the heap is full."""
    rng = np.random.Generator(np.random.PCG64(1))
    vocabulary, n = [f"w{i}" for i in range(50)], 4000
    docs = [[vocabulary[int(x)] for x in np.minimum(rng.geometric(0.15, 30) - 1, 49)] for _ in range(n)]
    for i in range(0, n, 200):
        docs[i] = docs[i][:10] + vocabulary[40:50]
    post = defaultdict(list)
    for d, words in enumerate(docs):
        for t, k in Counter(words).items():
            post[int(t[1:])].append((d, k))
    own = sorted(post)
    row = {"ids": list(range(n)), "lengths": [len(d) for d in docs], "terms": own, "ends": np.cumsum([len(post[t]) for t in own]), "at": [d for t in own for d, _ in post[t]], "times": [k for t in own for _, k in post[t]]}
    lists = ranking.Lists(row, {t: ranking.weight(n, len(post[t])) for t in own}, n, sum(map(len, docs)))
    heap: list[tuple[int, int]] = []
    scored = ranking.wand(lists, Counter(range(50)), heap, ranking.Search())
    want = plain_search([(i, " ".join(d)) for i, d in enumerate(docs)], [(0, " ".join(vocabulary))])
    assert sorted((-s, -d) for s, d in heap) == [(-s, d) for _, _, d, s in want] and scored < n / 4
