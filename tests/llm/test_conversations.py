"""The prefix trie against a plain one, and prefix sums over many partitions."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tonearm.llm.conversations import prefix_trie
from tonearm.llm.prefix import prefix_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = set()
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(n))
        children = len([m for m in below if len(m) == len(n) + 1])
        out.add((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows: list[tuple], parts: int = 3) -> list:
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit("other")).repartition(parts)
    got = prefix_trie(frame).collect()
    assert {tuple(r)[:8] for r in got} == plain_trie(rows) and len(got) == len({tuple(r)[:8] for r in got})
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(got)))
    for r in order:  # a subtree is an interval: its nodes are deeper than its top, and the next one after it is not
        inside = order[r.position + 1 : r.subtree_end + 1]
        assert all(x.depth > r.depth for x in inside) and (r.subtree_end + 1 == len(order) or order[r.subtree_end + 1].depth <= r.depth)
    return got


def test_trie_of_shared_and_edge_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in (100, 101, 102, 103, 104, 199) for t in range(c % 7 + 1)]
    rows += [(7, None, None, None), (7, 1, "", ""), (7, 1, "", ""), (7, 1, "b", "x"), (7, 1, "a", "y"), (-250, 3, "user", "below zero"), (-250, 3, "user", "below zero"), (None, 1, "user", "of no conversation")]
    rows += [(500, t, "user", "same") for t in range(9)] + [(501, t, "user", "same") for t in range(9)] + [(600, 0, "system", "é" * 5)]
    check(spark, rows)
    check(spark, rows, 1)


def test_trie_of_copies_and_a_long_conversation(spark):
    rows = [(c * 100, t, "user", f"t{t % 3}") for c in range(60) for t in range(3)]
    rows += [(10_000, t, "user", "x" * (t % 4)) for t in range(400)] + [(20_000, t, "user", "x" * (t % 4)) for t in range(390)] + [(20_001, t, "user", "own") for t in range(8)]
    got = check(spark, rows, 5)
    assert max(r.depth for r in got) == 400 and next(r for r in got if r.depth == 0).n_convs == 63


def test_trie_of_staircase_and_of_nothing(spark):
    """Each conversation is a beginning of the next one: as many chains on a path as there can be."""
    check(spark, [(c * 100, t, "user", str(t)) for c in range(25) for t in range(c + 1)])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_prefix_sums_carry_over_partitions(spark):
    rows = [(g, i, (g * 7 + i) % 5) for g, n in ((1, 1), (2, 500), (3, 2), (9, 40)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    for group in ("g", None):
        upto, want, at = 0, {}, None
        for g, i, v in sorted(rows):
            upto = v if group and g != at else upto + v
            at, want[g, i] = g, upto
        assert {(r.g, r.i): r.v_upto for r in prefix_sums(frame, ["g", "i"], ["v"], ["g", "i"], "test", group).collect()} == want
    assert prefix_sums(frame.where("false"), ["i"], ["v"], ["i"], "test", "g").collect() == []
