"""The prefix trie of conversations, its nodes ranked in preorder and summed by intervals.

A node is a sequence of first turns. Its key is a sum of hashes of (depth, turn), so keys come from prefix
sums along each conversation, however long it is. Distinct conversations are ranked lexicographically by
the chains of their path (runs of nodes that the same conversations go through); a subtree is then
an interval of ranks, its top first, and leaves and savings of a subtree are differences of prefix
sums over the nodes in this order, read where the node stands and where its subtree ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, shuffle_parts
from .prefix import prefix_sums

#: Most turns that a conversation takes from another one.
MOST_TAKEN = 5
#: Characters of joined ids that a row holds at most on their way to a digest.
ID_CHARS = 4096
#: The key of the root, and what stands after all depths.
_ROOT, _AFTER = (0, 0), (1 << 31) - 1
_HALF = (1 << 32) - 1


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (of role and text), chars of every turn, in the order of turn, null first.

    Rows of one turn are ordered by role and then by the MD5 of role and text; repeated rows are turns of their own. A null role or text is
    empty. Rows with a null conv_id are left out.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    digest = F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "utf-8"))
    rows = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("place"))
    return prefix_sums(rows, ["turn", "role", "digest"], ["place"], ["conv_id", "digest", "chars"], "trie-turns", "conv_id").select("conv_id", F.col("place_upto").alias("place"), "digest", "chars")


def rebuilt_turns(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv_id, total; and conv_id, depth, digest, chars, total after taking over first turns.

    Conversation c begins with the first h turns of conversation c - c % 100 (all if fewer, none if absent), h = crc32(decimal c) % 6, and goes
    on with its own turns after its first h.
    """
    own = materialize(places.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-lengths")
    convs = own.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % (MOST_TAKEN + 1)).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "trie-convs")
    forget(own)
    heads = places.where((F.col("conv_id") % 100 == 0) & (F.col("place") <= MOST_TAKEN)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("depth"), "digest", "chars", "total")
    tails = places.join(convs, "conv_id").where(F.col("place") > F.col("h"))
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars", "total")
    return convs.select("conv_id", "total"), heads.unionByName(tails)


def _key(s: list[Column]) -> list[Column]:
    """Two longs of the lower halves of four sums."""
    low = [c.bitwiseAND(F.lit(_HALF)) for c in s]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def keyed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, depth, chars, total, k1, k2 (the node's key), p1, p2 (its parent's) of every turn (conv_id, depth, digest, chars, total)."""
    wide = [F.xxhash64("depth", "digest", F.lit(i)) for i in (1, 2)]
    lanes = [c for w in wide for c in (F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(_HALF)))]
    rows = turns.select("conv_id", "depth", "chars", "total", *(c.alias(f"s{i}") for i, c in enumerate(lanes)))
    names = [f"s{i}" for i in range(4)]
    sums = prefix_sums(rows, ["depth"], names, ["conv_id", "depth", "chars", "total"], "trie-sums", "conv_id")
    k, p = _key([F.col(f"{s}_upto") for s in names]), _key([F.col(f"{s}_upto") - F.col(s) for s in names])
    return sums.select("conv_id", "depth", "chars", "total", k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"))


def ranked_sequences(ends: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, their turns): the distinct conversations with rep (smallest id), copies and their lexicographic rank, and the turns of the reps.

    The path of a sequence is the list of its chains' first nodes. Chains end where fewer sequences go
    on, each time with at least one more conversation of at least that length, so a path has at most the square root of twice the number
    of turns as entries.
    """
    seqs = materialize(ends.groupBy("k1", "k2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "trie-sequences")
    reps = materialize(turns.join(seqs.select(F.col("rep").alias("conv_id"), "copies"), "conv_id"), "trie-reps")
    through = reps.groupBy("k1", "k2").agg(F.count("*").alias("through"))
    chains = reps.select("conv_id", "depth", "k1", "k2").join(through, ["k1", "k2"]).groupBy("conv_id", "through").agg(F.min(F.struct("depth", "k1", "k2")).alias("top"))
    paths = chains.groupBy(F.col("conv_id").alias("rep")).agg(F.sort_array(F.collect_list("top")).alias("path"))
    sorted_by = seqs.select("rep", "copies", F.lit(1).cast("long").alias("rank")).join(paths, "rep", "left")
    ranked = prefix_sums(sorted_by, ["path", "rep"], ["rank"], ["rep", "copies"], "trie-ranks")  # a turnless sequence has no path and comes first
    return ranked.select("rep", "copies", F.col("rank_upto").alias("rank")), reps


def id_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: SHA-256 of the ids of each key in decimals, ascending and joined by commas.

    A digest needs its ids one after another; they are joined to longer strings where they are sorted first, so the
    task that digests a key with very many reads few rows and holds a batch of them.
    """
    parts = shuffle_parts(ends.sparkSession)
    ids = ends.repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, held, size = None, 0, [], 0
        for b in batches:
            out = []
            for k1, k2, i in zip(b["k1"].tolist(), b["k2"].tolist(), b["conv_id"].tolist(), strict=True):
                if held and (key != (k1, k2) or size > ID_CHARS):
                    out.append((*key, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    key, first = (k1, k2), i
                held.append(str(i))
                size += len(held[-1]) + 1
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "first", "ids"])
        if held:
            yield pd.DataFrame([(*key, first, ",".join(held))], columns=["k1", "k2", "first", "ids"])

    joined = ids.mapInPandas(join, "k1 long, k2 long, first long, ids string").repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for b in batches:
            out = []
            for k1, k2, s in zip(b["k1"].tolist(), b["k2"].tolist(), b["ids"].tolist(), strict=True):
                if key == (k1, k2):
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256()
                sha.update(s.encode())
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    return joined.mapInPandas(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and position and subtree_end: the node's place in preorder (from 0) and that of the last node below it.

    Turns are read as numbered_turns says and rebuilt as rebuilt_turns says. A conversation whose rebuilt turns
    are none ends at the root. A table without a conversation gives no rows; other columns are ignored.
    """
    convs, rebuilt = rebuilt_turns(numbered_turns(turns))
    keyed = materialize(keyed_turns(rebuilt), "trie-keys")
    root = [F.lit(x).cast("long").alias(f"k{i}") for i, x in enumerate(_ROOT, 1)]
    ends = keyed.where("depth = total").select("conv_id", "k1", "k2").unionByName(convs.where("total = 0").select("conv_id", *root))
    seqs, reps = ranked_sequences(ends, keyed)
    ranks = materialize(seqs, "trie-order")

    at_nodes = reps.join(ranks.select(F.col("rep").alias("conv_id"), "rank"), "conv_id").select("k1", "k2", "p1", "p2", "depth", "chars", "conv_id", "copies", "rank")
    none = F.lit(None).cast("long")
    at_root = ranks.select(*root, none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.col("rep").alias("conv_id"), "copies", "rank")
    nodes = at_nodes.unionByName(at_root).groupBy("k1", "k2").agg(
        *(F.min(c).alias(c) for c in ("p1", "p2", "depth", "chars", "conv_id")), F.sum("copies").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last")
    )
    nodes = materialize(nodes, "trie-nodes")
    forget(reps)
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = materialize(nodes, "trie-tree")

    # every node stands twice in the order: where it is, with its value, and after its subtree, with none
    leaf, save, one = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars"), F.lit(1).cast("long")
    here = tree.select("k1", "k2", F.col("first").alias("rank"), "depth", F.lit(0).alias("kind"), leaf.alias("leaf"), save.alias("save"), one.alias("one"))
    zero = F.lit(0).cast("long")
    after = tree.select("k1", "k2", F.col("last").alias("rank"), F.lit(_AFTER).cast("long").alias("depth"), F.lit(1).alias("kind"), zero.alias("leaf"), zero.alias("save"), zero.alias("one"))
    sums = prefix_sums(here.unionByName(after), ["rank", "depth", "kind", "k1", "k2"], ["leaf", "save", "one"], ["k1", "k2", "kind"], "trie-preorder")

    def below(c: str) -> Column:
        return F.sum(F.when(F.col("kind") == 1, F.col(f"{c}_upto")).otherwise(F.col(c) - F.col(f"{c}_upto")))

    upto = F.col("one_upto") - 1
    sums = sums.groupBy("k1", "k2").agg(
        below("leaf").alias("n_leaves"), below("save").alias("saved_tokens"), F.max(F.when(F.col("kind") == 0, upto)).alias("position"), F.max(F.when(F.col("kind") == 1, upto)).alias("subtree_end")
    )
    parents = tree.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = tree.join(sums, ["k1", "k2"]).join(id_digests(ends), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha, "position", "subtree_end")
