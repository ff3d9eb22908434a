"""Near duplicates by the Jaccard similarity of word n-grams: a MinHash LSH forest and an exact check.

Each of several trees sorts the texts by a sequence of MinHash values, so texts below one node of
its prefix trie stand next to each other and share the values on the path. The length at which
neighbours are linked is that by which a pair at just the least similarity meets in some tree with the target
probability; it follows from the number of trees, whatever the table. A bounded sample only tells how that went: all true links of its texts are
found exactly, in the pass that signs the texts, and where it would ask for shorter prefixes, that is said. Texts that
are connected by common prefixes are then compared exactly, in blocks.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, chunks, join_counted, materialize, shuffle_parts
from .components import components
from .grams import mix, shingle_hashes

#: Bits of a MinHash value in a tree's key; a key is a long of ``depth`` values, the first in its highest bits.
VALUE_BITS = 8


@dataclass(frozen=True)
class Forest:
    """words: of an n-gram; similarity: least Jaccard similarity of a link; trees, depth: MinHash
    values of a signature by tree; recall: share of the links that meet; sample, least_links, most_links: texts whose
    links are found exactly, how many links are needed to judge by them, and of how many links of a text; block, block_chars:
    texts that are compared at a time, and about how many characters."""

    words: int = 5
    similarity: float = 0.8
    trees: int = 24
    depth: int = 8
    recall: float = 0.999
    sample: int = 512
    least_links: int = 100
    most_links: int = 64
    block: int = 256
    block_chars: int = 1 << 22
    seed: int = 11

    def shortest(self) -> int:
        """The prefix by which even a pair at just the least similarity meets with the target recall; never longer than needed."""
        length = self.depth
        while length > 1 and 1 - (1 - self.similarity**length) ** self.trees < self.recall:
            length -= 1
        return length


def signatures(texts: list[str], forest: Forest, see: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Trie keys of each text by tree (n, trees), and the number of its n-grams; texts without a word have zeros.

    ``see`` is called with each chunk's first text, the hashes of its n-grams and their number in each text.
    """
    rng = np.random.Generator(np.random.PCG64(forest.seed))
    mult = rng.integers(0, 1 << 31, (forest.trees, forest.depth), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, (forest.trees, forest.depth), dtype=np.uint32)
    keys, sizes = np.zeros((len(texts), forest.trees), np.uint64), np.zeros(len(texts), np.int64)
    for at, part in chunks(texts, 1 << 18):
        h, n = shingle_hashes(part, forest.words)
        sizes[at : at + len(part)] = n
        if see:
            see(at, h, n)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        starts = (np.cumsum(n) - n)[some]
        short = (h >> np.uint64(32)).astype(np.uint32)
        held = np.empty_like(short)
        for t in range(forest.trees):
            key = np.zeros(len(some), np.uint64)
            for d in range(forest.depth):
                np.multiply(short, mult[t, d], out=held)
                np.add(held, plus[t, d], out=held)
                least = mix(np.minimum.reduceat(held, starts).astype(np.uint64) + np.uint64(d))
                key = (key << np.uint64(VALUE_BITS)) | (least >> np.uint64(64 - VALUE_BITS))
            keys[at + some, t] = key
    return keys, sizes


def common_prefix(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many leading values two arrays of keys share."""
    low = (a ^ b).view(np.uint64)
    return sum((low >> np.uint64(VALUE_BITS * (depth - n))) == 0 for n in range(1, depth + 1))


def _sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts: their hashes, whose they are, and how many each text has."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, part in chunks(texts, 1 << 18):
        h, n = shingle_hashes(part, words)
        owner = np.repeat(np.arange(at, at + len(part)), n)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
        hashes.append(h[new])
        owners.append(owner[new])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    return h, owner, np.bincount(owner, minlength=len(texts))


def common_counts(left: list[str], right: list[str] | None, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, a_n, b_n): n-grams that the texts of two lists (or of one, with itself) have in common, and how many each text has.

    Common n-grams are counted by products of indicator matrices, a slice of the n-grams at a time.
    """
    own = right is None
    a_h, a_o, a_n = _sets(left, words)
    b_h, b_o, b_n = (a_h, a_o, a_n) if own else _sets(right, words)
    every, count = np.unique(np.concatenate((np.unique(a_h), np.unique(b_h))) if not own else a_h, return_counts=True)
    shared = every[count > 1]
    common = np.zeros((len(left), len(a_n) if own else len(right)), np.float32)

    def place(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, h)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == h[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], o[ok][order]

    if len(shared):
        a_at, a_o = place(a_h, a_o)
        b_at, b_o = (a_at, a_o) if own else place(b_h, b_o)
        for low in range(0, len(shared), 4096):
            wide = min(4096, len(shared) - low)

            def slice_of(at, o, n, low=low, wide=wide):
                m = np.zeros((n, wide), np.float32)
                s, e = np.searchsorted(at, [low, low + wide])
                m[o[s:e], at[s:e] - low] = 1
                return m

            x = slice_of(a_at, a_o, len(left))
            common += x @ (x if own else slice_of(b_at, b_o, len(right))).T
    return common, a_n, b_n


def compare(left: list[str], right: list[str] | None, words: int, similarity: float) -> np.ndarray:
    """Which texts of two lists (or of one, against itself) are at least so similar: a boolean matrix."""
    common, a_n, b_n = common_counts(left, right, words)
    union = a_n[:, None] + b_n[None, :] - common
    return (common >= similarity * union - 1e-6 * union) & (union > 0)


def spanning_links(a_ids: np.ndarray, b_ids: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects: as many as there are texts at most."""
    ids = np.unique(np.concatenate((a_ids, b_ids)))
    x, y = np.nonzero(alike)
    u, v = np.searchsorted(ids, a_ids)[x], np.searchsorted(ids, b_ids)[y]
    label = np.arange(len(ids))
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return list(zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True))


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, links of every row.

    Two texts are linked if their sets of word n-grams are at least ``similarity`` alike, and copies
    of a text always are; words are runs without ASCII white space, in lower case; a text of fewer
    words has one n-gram. A class is what links connect, named by its smallest id; ``links`` is the
    number of other rows that a row is linked with. Empty texts are copies of each other; a null text is no copy of
    any. Rows with a null id are left out; rows that repeat an id are one document each, in the same
    class only if their texts are. An empty table gives no rows.

    Copies are counted first and stand for one text. Texts connected by common prefixes of the forest
    are compared in blocks of ``block`` texts, so the largest task is a pair of blocks however many
    texts are connected, and links inside are passed on as trees: never as all pairs.
    """
    return keyed_classes(docs, forest, id_col, text_col).select("doc_id", "class_id", "links")


def text_key(doc_id: Column, text: Column) -> Column:
    """The key of a text, equal for copies of it; a null text gets a key of its own id."""
    return F.coalesce(F.unhex(F.md5(F.encode(F.lower(text.cast("string")), "utf-8"))), F.concat(F.lit(b"null"), F.unhex(F.hex(doc_id.cast("long")))))


def keyed_classes(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates with the ``key`` of each row's text and ``class_key``, which tells classes apart whose smallest ids are the same."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    key = text_key(F.col("doc_id"), F.col("text"))
    keyed = materialize(rows.select("doc_id", key.alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "join-keys")
    texts = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("chars").alias("chars"))
    texts = materialize(texts.withColumn("tid", F.monotonically_increasing_id()), "join-copies")
    return _linked(rows.withColumn("key", key), keyed.select("doc_id", "key"), texts, forest)


def _sampled(rows: DataFrame, texts: DataFrame, forest: Forest) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sampled texts, hashes of their n-grams in order, whose they are, and how many each has."""
    chosen = F.broadcast(texts.orderBy(F.xxhash64("key"), "key").limit(forest.sample).select(F.col("key").alias("chosen"), F.col("rep").alias("doc_id")))
    # ids first: then only the texts of these few rows need their keys
    met = rows.drop("key").join(chosen, "doc_id").where(text_key(F.col("doc_id"), F.col("text")) == F.col("chosen"))
    found = {bytes(r.chosen): r.text for r in met.select("chosen", "text").dropDuplicates(["chosen"]).collect()}
    names = sorted(k for k in found if found[k] is not None)
    h, owner, n = _sets([found[k] for k in names], forest.words)
    order = np.argsort(h, kind="stable")
    return names, h[order], owner[order], n


def _signed(rows: DataFrame, texts: DataFrame, forest: Forest) -> tuple[DataFrame, list[bytes]]:
    """key, nodes (a trie key a tree), met (sampled texts that the text is linked with) of every distinct text with a word."""
    names, sample_h, sample_o, sample_n = _sampled(rows, texts, forest)

    high = np.uint64(64 - 22)
    seen_high = np.zeros(1 << 22, bool)  # most n-grams of a table are none of the sample's: their first bits tell
    seen_high[sample_h >> high] = True

    def meetings(h: np.ndarray, n: np.ndarray) -> dict[int, list[int]]:
        """The sampled texts that each of some texts is similar to, by the texts' places."""
        at = np.flatnonzero(seen_high[h >> high])
        low, up = np.searchsorted(sample_h, h[at]), np.searchsorted(sample_h, h[at], "right")
        at, low, wide = at[up > low], low[up > low], (up - low)[up > low]
        ends = np.cumsum(n)
        owner = np.searchsorted(ends, at, "right")
        order = np.lexsort((h[at], owner))
        new = np.concatenate(([True], np.diff(owner[order]) != 0)) | np.concatenate(([True], np.diff(h[at][order]) != 0)) if len(at) else np.zeros(0, bool)
        owner, low, wide = owner[order][new], low[order][new], wide[order][new]
        spot = np.repeat(low - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        both, shared = np.unique(np.repeat(owner, wide) * len(names) + sample_o[spot], return_counts=True)
        text, name = both // len(names), both % len(names)
        near = shared >= forest.similarity * sample_n[name] * (1 - 1e-6)  # else the union is too large in any case
        out: dict[int, list[int]] = {}
        for t, s, k in zip(text[near].tolist(), name[near].tolist(), shared[near].tolist(), strict=True):
            grams = len(np.unique(h[ends[t] - n[t] : ends[t]]))
            if k >= forest.similarity * (grams + sample_n[s] - k) * (1 - 1e-6):
                out.setdefault(t, []).append(s)
        return out

    def sign(batches):
        for b in batches:
            met: dict[int, list[int]] = {}

            def see(first: int, h: np.ndarray, n: np.ndarray, met=met):
                met.update({first + t: s for t, s in meetings(h, n).items()})

            keys, sizes = signatures([t or "" for t in b["text"]], forest, see if names else None)
            some = np.flatnonzero(sizes)
            if len(some):  # an empty column of lists would have no type
                yield pd.DataFrame({"key": b["key"].iloc[some], "nodes": list(keys[some].view(np.int64)), "met": [met.get(i, []) for i in some.tolist()]})

    # every row is signed where it is read: that costs less than moving the texts
    signed = rows.select("key", "text").mapInPandas(sign, "key binary, nodes array<long>, met array<int>")
    signed = signed.groupBy("key").agg(F.first("nodes").alias("nodes"), F.first("met").alias("met"))
    return materialize(signed.join(texts.select("key", "tid"), "key"), "join-nodes", TEXT_ROWS), names


def fit_prefix(signed: DataFrame, names: list[bytes], forest: Forest) -> tuple[int, float, int]:
    """(length, recall, links): the longest prefix at which the sampled texts, on average, meet the target share of their links in some tree,
    the share that they meet at that length, and by how many links it was measured.

    No length is too short; a length of one value, where the target can't be met, comes with the recall that is.
    With fewer than ``least_links`` links the length is ``shortest`` and the recall the probability for a pair at just the least similarity.
    """
    shortest = forest.shortest()
    pairs = signed.where(F.size("met") > 0).select("key", "nodes", F.explode("met").alias("sampled"))
    place = F.row_number().over(Window.partitionBy("sampled").orderBy(F.xxhash64("key"), "key"))
    own = signed.where(F.size("met") > 0).where(F.col("key").isin(names)).select("key", "nodes").collect() if names else []
    nodes = {bytes(r.key): np.array(r.nodes, np.int64) for r in own}
    some = pairs.withColumn("place", place).where(F.col("place") <= forest.most_links).collect()
    longest: dict[int, list[int]] = {}
    for r in some:
        name = names[r.sampled]
        if bytes(r.key) != name:
            longest.setdefault(r.sampled, []).append(int(common_prefix(np.array(r.nodes, np.int64), nodes[name], forest.depth).max()))
    links = sum(map(len, longest.values()))
    if links < forest.least_links:
        return shortest, 1 - (1 - forest.similarity**shortest) ** forest.trees, links
    reached = lambda length: float(np.mean([np.mean(np.array(n) >= length) for n in longest.values()]))
    length = forest.depth
    while length > 1 and reached(length) < forest.recall:
        length -= 1
    return length, reached(length), links


def _neighbours(signed: DataFrame, length: int, forest: Forest) -> DataFrame:
    """a, b: texts of one node of some tree's sorted trie, each with the smallest id of the node, so that trees often name the same pair.

    Trees are range-sorted by prefix and id, so a node with very many texts is spread over partitions; nodes that
    go on from one partition to the next are joined by the first and last rows of partitions.
    """
    shift = VALUE_BITS * (forest.depth - length)
    rows = signed.select("tid", F.posexplode("nodes").alias("tree", "trie"))
    node = F.shiftrightunsigned("trie", shift) if shift else F.col("trie")
    rows = rows.select("tree", node.alias("node"), "tid")
    rows = rows.repartitionByRange(shuffle_parts(signed.sparkSession), "tree", "node", "tid").sortWithinPartitions("tree", "node", "tid")

    def walk(batches):
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not len(b):
                continue
            tree, node, tid = b["tree"].to_numpy(), b["node"].to_numpy(), b["tid"].to_numpy()
            new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])))
            hub = tid[new][np.cumsum(new) - 1]
            if last is not None and last[:2] == (tree[0], node[0]):
                hub[: np.argmax(new[1:]) + 1 if new[1:].any() else len(hub)] = last[2]
            if first is None:
                first = (tree[0], node[0], hub[0])
            last = (tree[-1], node[-1], hub[-1])
            on = hub != tid
            if on.any():
                yield pd.DataFrame({"part": part, "end": 0, "tree": tree[on], "node": node[on], "a": tid[on], "b": hub[on]})
        if last is not None:
            yield pd.DataFrame([(part, 1, *first, first[2]), (part, 2, *last, last[2])], columns=["part", "end", "tree", "node", "a", "b"])

    walked = materialize(rows.mapInPandas(walk, "part int, end int, tree int, node long, a long, b long"), "join-walk")
    # two rows a partition: the last node before is gone on with if it is the first here
    ends = walked.where("end > 0")
    order = Window.orderBy("part", "end")
    seams = ends.withColumns({"was_tree": F.lag("tree").over(order), "was_node": F.lag("node").over(order), "was": F.lag("b").over(order)})
    seams = seams.where("end = 1 and tree = was_tree and node = was_node and a <> was").select("a", F.col("was").alias("b"))
    every = walked.where("end = 0").select("a", "b").unionByName(seams)
    every = every.repartition(shuffle_parts(signed.sparkSession), "a").sortWithinPartitions("a", "b")

    def thin(batches):
        """Each text with its smallest hub, and its other hubs with that one: as connected, with about one row a text."""
        at, least = None, None
        for b in batches:
            pairs: set[tuple[int, int]] = set()
            for text, hub in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
                if text != at:
                    at, least = text, hub
                    pairs.add((text, hub))
                elif hub != least:
                    pairs.add((hub, least))
            if pairs:
                yield pd.DataFrame(sorted(pairs), columns=["a", "b"])

    return every.mapInPandas(thin, "a long, b long").distinct()


def _linked(rows: DataFrame, keyed: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    signed, names = _signed(rows, texts, forest)
    length = forest.shortest()
    asked, recall, sampled = fit_prefix(signed, names, forest)  # a check: it decides nothing
    if asked < length or recall < forest.recall:
        warnings.warn(f"prefixes of {length} are used; by {sampled} sampled links {asked} would meet {recall:.4f}", stacklevel=2)
    stars = _neighbours(signed, length, forest)
    groups = components(stars, "join-groups")
    groups = materialize(groups.select("comp", F.col("id").alias("tid")).join(texts, "tid").select("comp", "tid", "key", F.col("rep").alias("doc_id"), "copies", "chars"), "join-members")
    sizes = groups.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / forest.block), F.ceil(F.sum("chars") / forest.block_chars)).cast("int").alias("blocks"))
    members = groups.join(materialize(sizes, "join-sizes"), "comp")
    # one plan at every size: texts are shuffled once, and members are never broadcast
    full = members.join(rows.hint("merge"), ["key", "doc_id"])
    block = F.pmod(F.xxhash64("tid", F.lit(1)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = full.select("comp", "tid", "copies", "text", block.alias("block"), other.alias("other"))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def check(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("tid")
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        a, b = group[group["block"] == low], group[group["block"] == high]
        own = low == high
        alike = compare(a["text"].tolist(), None if own else b["text"].tolist(), forest.words, forest.similarity)
        a_ids, b_ids = a["tid"].to_numpy(), b["tid"].to_numpy()
        if own:
            np.fill_diagonal(alike, False)
        linked = alike.astype(np.float64)
        out = [(int(i), None, int(d)) for i, d in zip(a_ids, linked @ b["copies"].to_numpy(np.float64), strict=True) if d]
        if not own:
            out += [(int(i), None, int(d)) for i, d in zip(b_ids, linked.T @ a["copies"].to_numpy(np.float64), strict=True) if d]
        out += [(i, j, 0) for i, j in spanning_links(a_ids, b_ids, alike)]
        return pd.DataFrame({"a": pd.array([r[0] for r in out], "Int64"), "b": pd.array([r[1] for r in out], "Int64"), "links": np.array([r[2] for r in out], np.int64)})

    # comparing costs more than its bytes tell, so small partitions are not joined
    dealt = dealt.repartition(shuffle_parts(rows.sparkSession), "comp", "low", "high")
    found = materialize(dealt.groupBy("comp", "low", "high").applyInPandas(check, "a long, b long, links long"), "join-links")
    classes = components(found.where("b is not null").select("a", "b"), "join-classes")
    degree = found.groupBy(F.col("a").alias("tid")).agg(F.sum("links").alias("links"))
    labelled = (
        texts.join(classes.select(F.col("id").alias("tid"), "comp"), "tid", "left")
        .join(degree, "tid", "left")
        .select("key", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("comp", "tid").alias("comp"))
    )
    labelled = materialize(labelled, "join-labels")
    smallest = labelled.groupBy("comp").agg(F.min("rep").alias("class_id"))
    of_key = labelled.join(smallest, "comp").select("key", "class_id", F.col("comp").alias("class_key"), "links", "copies")
    of_key = materialize(of_key, "join-classed")
    return join_counted(keyed, of_key, "key", "copies").select("doc_id", "key", "class_id", "class_key", "links")
