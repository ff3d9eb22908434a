"""Set similarity join by chosen paths: near duplicates as connected components of exact links.

Every set has a row of MinHash values. A node of a tree selects one position of that row, and with
the probability 1 / similarity - 1 a second one; the sets of the node go on to the child of their value
there, so a pair at just the least similarity stays together in about one child of each node. Nodes with
few sets are compared exhaustively. Nodes that are crowded at the full depth hold families of near copies:
their sets are compared with two of them, and where that leaves a family in more than one component, the sets outside
the largest are compared with all others of the family, in blocks. Independent trees are repeated until a pair at the
least similarity shares a compared node with the target probability. Sketches only rule pairs out;
links are confirmed on whole sets, read from the texts again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, chunks, join_counted, materialize, shuffle_parts
from .components import components
from .grams import mix, shingle_hashes
from .jaccard import common_counts, spanning_links

#: Of the values in a pair's short sketch (8 of 8 bits), so many agree; a pair at 0.8 has fewer with 0.00008.
SHORT_ALIKE = 2
_SELECT, _SECOND, _BRANCH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class PathJoin:
    """words: of a shingle; percent: least similarity of a link; values: MinHash values of a set; small: sets of a node that are compared exhaustively;
    split: by how much a level is taken to divide a table of unrelated texts; recall: least probability that a pair at the least similarity is compared;
    block, block_shingles: sets of a crowded node, and shingles of a family's sets, that are compared with as many at a time; partners: of one set that are confirmed in one task; errors: standard errors
    by which a sketch may be wrong."""

    words: int = 2
    percent: int = 80
    values: int = 128
    small: int = 8
    split: int = 30
    recall: float = 0.999
    block: int = 256
    block_shingles: int = 1 << 17
    partners: int = 256
    errors: float = 5.0
    seed: int = 23

    @property
    def second(self) -> float:
        return min(1.0, 100 / self.percent - 1)

    def depth(self, sets: int) -> int:
        """Levels after which unrelated texts are alone, by the number of sets."""
        return max(1, math.ceil(math.log(max(sets, 1) / self.small + 1) / math.log(self.split)))

    def missed(self, depth: int) -> float:
        """The probability that a pair at the least similarity is parted in every branch of a tree."""
        lost, s, p = 0.0, self.percent / 100, self.second
        for _ in range(depth):
            stays = 1 - s + s * lost
            lost = (1 - p) * stays + p * stays * stays
        return lost

    def trees(self, depth: int) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(self.missed(depth))))

    def least_alike(self) -> int:
        """So many values at least agree in the sketches of a pair that may be linked."""
        s = self.percent / 100
        return max(1, math.floor(self.values * (s - self.errors * math.sqrt(s * (1 - s) / self.values))))


def lowered(text: str | None) -> bytes:
    """The text in UTF-8 with A to Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingle_sets(texts: list[bytes], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each text and the sorted distinct hashes of its shingles."""
    for at, part in chunks(texts):
        h, n = shingle_hashes(part, words)
        ends = np.cumsum(n)
        for i in range(len(part)):
            yield at + i, np.unique(h[ends[i] - n[i] : ends[i]])


def set_key(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def min_values(sets: list[np.ndarray], join: PathJoin) -> np.ndarray:
    """MinHash values (16 bits each) of non-empty sets, a row a set."""
    rng = np.random.Generator(np.random.PCG64(join.seed))
    mult = rng.integers(0, 1 << 31, join.values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, join.values, dtype=np.uint32)
    out, at = np.zeros((len(sets), join.values), "<u2"), 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (upto == at or size + len(sets[upto]) <= 1 << 16):
            size += len(sets[upto])
            upto += 1
        short = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : upto - 1])])
        held = np.empty_like(short)
        for j in range(join.values):
            np.multiply(short, mult[j], out=held)
            np.add(held, plus[j], out=held)
            out[at:upto, j] = mix(np.minimum.reduceat(held, starts).astype(np.uint64) + np.uint64(j)) >> np.uint64(48)
        at = upto
    return out


def chosen_paths(values: np.ndarray, tree: int, depth: int, join: PathJoin) -> tuple[np.ndarray, np.ndarray]:
    """(row, path): the paths of one tree that each row of MinHash values goes, as longs of ``depth`` groups of bits."""
    bits, n = np.uint64(path_bits(depth)), len(values)
    row, path = np.arange(n), np.zeros(n, np.uint64)
    node = np.full(n, mix(np.array([tree + 1], np.uint64) * _BRANCH)[0], np.uint64)
    for _ in range(depth):
        at = (mix(node ^ _SELECT) % np.uint64(join.values)).astype(np.int64)
        twice = np.flatnonzero((mix(node ^ _SECOND) >> np.uint64(11)).astype(np.float64) < join.second * float(1 << 53))
        other = (at[twice] + 1 + (mix(node[twice] ^ _BRANCH) % np.uint64(join.values - 1)).astype(np.int64)) % join.values
        row, at, node, path = (np.concatenate(x) for x in ((row, row[twice]), (at, other), (node, node[twice]), (path, path[twice])))
        node = mix(node * _BRANCH + (at.astype(np.uint64) << np.uint64(16)) + values[row, at].astype(np.uint64) + np.uint64(1))
        path = (path << bits) | (node >> (np.uint64(64) - bits))
    return row, path.view(np.int64)


def path_bits(depth: int) -> int:
    return min(16, 63 // depth)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether enough bytes of two short sketches agree."""
    return (np.bitwise_xor(a, b)[..., None].view(np.uint8) == 0).sum(-1) >= SHORT_ALIKE


def signed_rows(docs: DataFrame, join: PathJoin, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (of the set), mins (its values) of every row with an id; key and mins are null for empty sets."""

    def sign(batches):
        for b in batches:
            ids, keys, sizes, mins = b["doc_id"].tolist(), [None] * len(b), np.zeros(len(b), np.int64), [None] * len(b)
            held = []
            for i, s in shingle_sets([lowered(t) for t in b["text"]], join.words):
                sizes[i] = len(s)
                if len(s):
                    keys[i] = set_key(s)
                    held.append((i, s))
            for (i, _), row in zip(held, min_values([s for _, s in held], join), strict=True):
                mins[i] = row.tobytes()
            yield pd.DataFrame({"doc_id": ids, "n_shingles": sizes, "key": pd.Series(keys, dtype=object), "mins": pd.Series(mins, dtype=object)})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInPandas(sign, "doc_id long, n_shingles long, key binary, mins binary"), "path-rows", TEXT_ROWS)


def _nodes(sets: DataFrame, join: PathJoin, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(small nodes of each level, crowded nodes of the last): tree, node, tid, short and the number of rows of the node, c, with its least and largest tid.

    Levels are counted one after another: a node with few rows is compared, and only the rows of the others go on to the next level.
    """
    trees, bits = join.trees(depth), path_bits(depth)

    def walk(batches):
        for b in batches:
            values = np.frombuffer(b"".join(b["mins"]), "<u2").reshape(-1, join.values)
            short, tid = np.ascontiguousarray(values[:, :8].astype(np.uint8)).view(np.int64)[:, 0], b["tid"].to_numpy()
            for t in range(trees):
                row, path = chosen_paths(values, t, depth, join)
                yield pd.DataFrame({"tree": np.full(len(row), t, np.int32), "path": path, "tid": tid[row], "short": short[row]})

    at = materialize(sets.select("tid", "mins").mapInPandas(walk, "tree int, path long, tid long, short long"), "path-nodes", 4096)
    small = []
    for level in range(max(1, depth - 2), depth + 1):
        down = bits * (depth - level)
        rows = at.select("tree", "path", "tid", "short", (F.shiftrightunsigned("path", down) if down else F.col("path")).alias("node"))
        counts = rows.groupBy("tree", "node").agg(F.count("*").alias("c"), F.min("tid").alias("least"), F.max("tid").alias("largest")).where("least < largest")
        met = materialize(rows.join(counts, ["tree", "node"]), f"path-level-{level}")
        small.append(met.where(F.col("c") <= join.small).select("tree", "node", "tid", "short"))
        at = met.where(F.col("c") > join.small)
    return small, at


def _small_pairs(nodes: DataFrame, join: PathJoin) -> DataFrame:
    """a < b: the pairs of small nodes whose short sketches don't rule them out."""
    rows = nodes.repartition(shuffle_parts(nodes.sparkSession), "tree", "node").sortWithinPartitions("tree", "node")

    def meet(batches):
        left: pd.DataFrame | None = None
        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            if not len(b):
                continue
            tree, node = b["tree"].to_numpy(), b["node"].to_numpy()
            open_from = len(b) - int(np.argmin(np.append((tree == tree[-1])[::-1] & (node == node[-1])[::-1], False)))
            left = b.iloc[open_from:]
            yield from pairs_of(b.iloc[:open_from])
        if left is not None:
            yield from pairs_of(left)

    def pairs_of(b: pd.DataFrame):
        tree, node, tid, short = (b[c].to_numpy() for c in ("tree", "node", "tid", "short"))
        found = []
        for d in range(1, join.small):
            same = np.flatnonzero((tree[d:] == tree[:-d]) & (node[d:] == node[:-d]))
            if not len(same):
                break
            same = same[_alike(short[same], short[same + d])]
            x, y = tid[same], tid[same + d]
            found.append(np.stack((np.minimum(x, y), np.maximum(x, y)), 1)[x != y])
        if found and len(found := np.unique(np.concatenate(found), axis=0)):
            yield pd.DataFrame(found, columns=["a", "b"])

    return rows.mapInPandas(meet, "a long, b long")


def _near(pairs: DataFrame, sets: DataFrame, join: PathJoin, name: str) -> DataFrame:
    """The distinct pairs (a, b) whose sketches don't rule them out, with alike, the number of values that agree."""
    least = join.least_alike()

    def estimate(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), "<u2").reshape(len(b), -1) for c in ("am", "bm"))
                b = b[["a", "b"]].assign(alike=(x == y).sum(1))
                yield b[b["alike"] >= least]

    mins = sets.select("tid", "mins")
    both = pairs.distinct().join(mins.select(F.col("tid").alias("a"), F.col("mins").alias("am")), "a").join(mins.select(F.col("tid").alias("b"), F.col("mins").alias("bm")), "b")
    return materialize(both.mapInPandas(estimate, "a long, b long, alike long"), name, 4096)


def _texts(docs: DataFrame, sets: DataFrame, tids: DataFrame, join: PathJoin, id_col: str, text_col: str) -> DataFrame:
    """tid, text of the sets asked for; of an id with several texts that of the set."""
    wanted = tids.select("tid").distinct().join(sets.select("tid", "rep", "key"), "tid").withColumnRenamed("rep", "doc_id")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(wanted, "doc_id")

    def own(batches):
        for b in batches:
            ok = np.zeros(len(b), bool)
            for i, s in shingle_sets([lowered(t) for t in b["text"]], join.words):
                ok[i] = len(s) > 0 and set_key(s) == bytes(b["key"].iloc[i])
            yield b.loc[ok, ["tid", "text"]]

    return materialize(found.select("tid", "text", "key").mapInPandas(own, "tid long, text string").dropDuplicates(["tid"]), "path-texts", TEXT_ROWS)


def confirmed(pairs: DataFrame, texts: DataFrame, join: PathJoin, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough.

    Pairs are dealt by b, whose set is made once for at most ``partners`` of them; a task holds that one set and a batch of texts.
    """
    spark, percent, words = pairs.sparkSession, join.percent, join.words
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / join.partners).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(groups, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    heads = dealt.select("b", "part", F.col("b").alias("tid")).distinct().withColumn("role", F.lit(0))
    rows = dealt.select("b", "part", F.col("a").alias("tid")).withColumn("role", F.lit(1)).unionByName(heads).join(texts, "tid")
    rows = rows.repartition(shuffle_parts(spark), "b", "part").sortWithinPartitions("b", "part", "role")

    def compare(batches):
        at, held = None, None
        for b in batches:
            out, keys = [], list(zip(b["b"].tolist(), b["part"].tolist(), b["tid"].tolist(), b["role"].tolist(), strict=True))
            for i, s in shingle_sets([lowered(t) for t in b["text"]], words):
                hub, part, tid, role = keys[i]
                if role == 0:
                    at, held = (hub, part), s
                elif at == (hub, part):
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(s) - both):
                        out.append((tid, hub))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return materialize(rows.select("b", "part", "role", "tid", "text").mapInPandas(compare, "a long, b long"), name, TEXT_ROWS)


def _dealt(rows: DataFrame, group: list[str], label: str, weight: str, limit: int, columns: list[str]) -> DataFrame:
    """The rows of groups with several labels, dealt to (group, probe, block): each row outside of its group's commonest label (role 1) meets
    each row of the group (role 0) in one of them; a block has about ``limit`` of ``weight``."""
    each = rows.groupBy(*group, label).agg(F.count("*").alias("n"), F.sum(weight).alias("size"))
    of = each.groupBy(*group).agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by(label, "n").alias("main"), F.sum("size").alias("size"), F.max_by("size", "n").alias("main_size")).where("top < all")
    of = of.select(*group, "main", F.ceil(F.col("size") / limit).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("main_size")) / limit).cast("int").alias("probes"))
    rows = materialize(rows.join(of, group), "path-crowds")
    own = lambda n: F.pmod(F.xxhash64("tid", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = rows.withColumn("block", own("blocks")).withColumn("probe", every("probes")).withColumn("role", F.lit(0))
    asking = rows.where(F.col(label) != F.col("main")).withColumn("probe", own("probes")).withColumn("block", every("blocks")).withColumn("role", F.lit(1))
    keys = [*group, "probe", "block", "role"]
    return there.select(*keys, *columns).unionByName(asking.select(*keys, *columns))


def _crossing(crowded: DataFrame, families: DataFrame, sets: DataFrame, join: PathJoin) -> DataFrame:
    """a, b: for each set of a crowded node outside of the node's largest family, and each other family there, the pair with the most
    values in common, if its sketches don't rule it out."""
    rows = crowded.select("tree", "node", "tid").distinct().join(families.select(F.col("id").alias("tid"), F.col("comp").alias("family")), "tid", "left")
    rows = rows.withColumn("family", F.coalesce("family", "tid")).withColumn("one", F.lit(1))
    dealt = _dealt(rows, ["tree", "node"], "family", "one", join.block, ["tid", "family"]).join(sets.select("tid", "mins"), "tid")
    least = join.least_alike()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["role"] == 1], group[group["role"] == 0].sort_values("family")
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        if len(x) and len(y):
            mine, there = (np.frombuffer(b"".join(g["mins"]), "<u2").reshape(len(g), -1) for g in (x, y))
            family, tid = y["family"].to_numpy(), y["tid"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1])))
            for values, own, me in zip(mine, x["family"], x["tid"], strict=True):
                alike = (there == values).sum(1)
                best = np.maximum.reduceat(alike, starts)
                spot = np.array([s + int(np.argmax(alike[s:e])) for s, e, n in zip(starts, [*starts[1:], len(alike)], best, strict=True) if n >= least], np.int64)
                spot = spot[family[spot] != own] if len(spot) else spot
                out.append(np.stack((np.minimum(tid[spot], me), np.maximum(tid[spot], me)), 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    keys = ["tree", "node", "probe", "block"]
    return dealt.repartition(shuffle_parts(sets.sparkSession), *keys).groupBy(*keys).applyInPandas(meet, "a long, b long").distinct()


def _family_links(members: DataFrame, texts: DataFrame, join: PathJoin) -> DataFrame:
    """a, b: links between the components of a family (tid, family, comp, n), by comparing whole sets block by block."""
    dealt = _dealt(members, ["family"], "comp", "n", join.block_shingles, ["tid", "comp"]).join(texts, "tid")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["role"] == 1], group[group["role"] == 0]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        common, a_n, b_n = common_counts([lowered(t) for t in x["text"]], [lowered(t) for t in y["text"]], join.words)
        common = common.astype(np.int64)
        alike = 100 * common >= join.percent * (a_n[:, None] + b_n[None, :] - common)
        alike &= x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]
        return pd.DataFrame(spanning_links(x["comp"].to_numpy(), y["comp"].to_numpy(), alike), columns=["a", "b"], dtype=np.int64)

    keys = ["family", "probe", "block"]
    dealt = dealt.repartition(shuffle_parts(members.sparkSession), *keys)
    return materialize(dealt.groupBy(*keys).applyInPandas(meet, "a long, b long"), "path-family-links", TEXT_ROWS)


def near_duplicate_components(docs: DataFrame, join: PathJoin = PathJoin(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row with an id.

    A text's set holds its distinct shingles of ``words`` words (runs without ASCII white space, A to Z in
    lower case); fewer words are one shingle; no word or a null text gives an empty set, which is linked with nothing. Sets are
    linked if 100 times their common shingles is at least ``percent`` times those of either. component_id is the smallest id that links reach. Rows with a
    null id are left out; rows that repeat an id are one document each. An empty table gives no rows.

    Equal sets stand for one; links inside families of near copies are followed as trees and never made as all pairs.
    """
    rows = signed_rows(docs, join, id_col, text_col)
    some = rows.where("key is not null")
    sets = some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("mins").alias("mins"), F.max("n_shingles").alias("n"))
    sets = materialize(sets.withColumn("tid", F.monotonically_increasing_id()), "path-sets")
    small, crowded = _nodes(sets, join, join.depth(sets.count()))
    pairs = crowded.select(F.col("least").alias("a"), F.col("tid").alias("b")).unionByName(crowded.select(F.col("tid").alias("a"), F.col("largest").alias("b"))).where("a < b")
    for level in small:
        pairs = pairs.unionByName(_small_pairs(level, join))
    near = _near(pairs, sets, join, "path-near")
    ends = near.select(F.col("a").alias("tid")).unionByName(near.select(F.col("b").alias("tid")))
    links = confirmed(near, _texts(docs, sets, ends, join, id_col, text_col), join, "path-links")
    comps = components(links, "path-components")

    # families: what sketches don't keep apart; in those with crowded nodes not all pairs have been confirmed or ruled out
    families = components(near, "path-families")
    across = materialize(_crossing(crowded, families, sets, join), "path-across")
    families = components(near.select("a", "b").unionByName(across), "path-families")
    families = families.select(F.col("id").alias("tid"), F.col("comp").alias("family"))
    open_ones = families.join(crowded.select("tid").distinct(), "tid", "left_semi").select("family").distinct()
    members = families.join(open_ones, "family").join(comps.withColumnRenamed("id", "tid"), "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
    members = materialize(members.join(sets.select("tid", "n"), "tid"), "path-members")
    mixed = members.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("family")
    members = materialize(members.join(mixed, "family"), "path-mixed")
    if members.limit(1).count():
        more = _family_links(members, _texts(docs, sets, members, join, id_col, text_col), join)
        comps = components(links.unionByName(more), "path-components")

    labelled = sets.join(comps.withColumnRenamed("id", "tid"), "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
    smallest = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_key = materialize(labelled.join(smallest, "comp").select("key", "component_id", "copies"), "path-classes")
    placed = join_counted(some.select("doc_id", "n_shingles", "key"), of_key, "key", "copies").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
