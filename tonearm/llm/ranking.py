"""Ranked lexical search: WAND over document shards with integer BM25-like scores.

Whole texts are read once. Each task writes its documents as shards: rows that hold the postings of the terms asked for. Document
frequencies and lengths are summed over all shards; then every shard is searched with WAND: the lists of an item's terms
are kept in the order of their next document, the pivot is the first at which the terms' largest impacts add up to what the item's heap
asks for, and everything before the pivot is skipped. A task's heaps go on from shard to shard, and
the heaps of all tasks are merged.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, materialize

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands for a null id among ids: after all others.
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Search:
    """top: documents of an item; items, item_terms: items, and different terms of theirs, that are asked for in one pass over the documents;
    postings: about how many a shard holds; primed: documents of an item's rarest terms that are scored before a shard's pivots."""

    top: int = 10
    items: int = 4096
    item_terms: int = 1 << 17
    postings: int = 1 << 19
    primed: int = 32


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and all characters beyond ASCII, A to Z in lower case; null has none."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def blocks(items: DataFrame, search: Search) -> Iterator[list[tuple[int | None, Counter[bytes]]]]:
    """The rows of a query table in blocks of bounded size; of a row its id and terms."""
    held, seen = [], set()
    for r in items.select("item_id", "text").toLocalIterator():
        own = Counter(terms(r["text"]))
        if held and (len(held) >= search.items or len(seen | own.keys()) > search.item_terms):
            yield held
            held, seen = [], set()
        held.append((r["item_id"], own))
        seen |= own.keys()
    if held:
        yield held


_SHARD = "ids array<long>, lengths array<int>, terms array<int>, ends array<int>, at array<int>, times array<int>, words long, documents long"


def write_shards(docs: DataFrame, vocabulary: dict[bytes, int], search: Search, name: str = "search-shards") -> DataFrame:
    """A row a shard: ids and lengths of its documents in ascending order of ids, its terms, the end of each term's postings, and of each posting the document's
    place and how often it holds the term; words and documents count what has a term at all. Documents without a term are not in it."""

    def shard(ids: list[int], lengths: list[int], found: list[tuple[list[int], list[int]]]) -> dict:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        term = np.array([t for f in found for t in f[0]], np.int64)
        times = np.array([n for f in found for n in f[1]], np.int64)
        at = np.repeat(place, [len(f[0]) for f in found])
        by = np.lexsort((at, term))
        own, count = np.unique(term, return_counts=True)
        return {
            "ids": np.array(ids, np.int64)[order], "lengths": np.array(lengths, np.int32)[order], "terms": own.astype(np.int32), "ends": np.cumsum(count).astype(np.int32),
            "at": at[by].astype(np.int32), "times": times[by].astype(np.int32), "words": sum(lengths), "documents": len(ids),
        }

    def index(batches):
        ids, lengths, found, held = [], [], [], 0
        for b in batches:
            for i, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                words = terms(text)
                if not words:
                    continue
                own = {t: n for w, n in Counter(words).items() if (t := vocabulary.get(w)) is not None}
                ids.append(i)
                lengths.append(len(words))
                found.append((list(own), list(own.values())))
                held += len(own) + 1
                if held >= search.postings:
                    yield pd.DataFrame([shard(ids, lengths, found)])
                    ids, lengths, found, held = [], [], [], 0
        if ids:
            yield pd.DataFrame([shard(ids, lengths, found)])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInPandas(index, _SHARD), name, TEXT_ROWS)


def term_counts(shards: DataFrame) -> tuple[int, int, dict[int, int]]:
    """(documents, words, documents by term) of all shards; there are as many terms as a block of items has at most."""
    total = shards.agg(F.sum("documents").alias("n"), F.sum("words").alias("l")).first()
    before = F.expr("transform(ends, (e, i) -> named_struct('term', terms[i], 'df', e - if(i = 0, 0, ends[i - 1])))")
    by_term = shards.select(F.explode(before).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df"))
    return int(total["n"] or 0), int(total["l"] or 0), {r["term"]: r["df"] for r in by_term.collect()}


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Lists:
    """The postings of a shard with their impacts, ready for items."""

    def __init__(self, row: Row | dict, weights: dict[int, int], documents: int, words: int):
        self.ids = np.asarray(row["ids"], np.int64)
        m = 25 + (75 * np.asarray(row["lengths"], np.int64) * documents) // words
        at, times, ends = np.asarray(row["at"], np.int64), np.asarray(row["times"], np.int64), np.asarray(row["ends"], np.int64)
        own = np.asarray(row["terms"], np.int64)
        w = np.array([weights[t] for t in own.tolist()], np.int64)
        impact = np.repeat(w, np.diff(ends, prepend=0)) * ((1_000_000_000 * times) // (1000 * times + 8 * m[at]))
        starts = ends - np.diff(ends, prepend=0)
        most = np.maximum.reduceat(impact, starts).tolist() if len(own) else []
        self.of = {t: (s, e, x) for t, s, e, x in zip(own.tolist(), starts.tolist(), ends.tolist(), most, strict=True)}
        self.at, self.impact = at, impact
        self._plain: dict[int, tuple[list[int], list[int]]] = {}

    def plain(self, term: int) -> tuple[list[int], list[int]]:
        """A term's documents and impacts as lists, made when first asked for."""
        if term not in self._plain:
            s, e, _ = self.of[term]
            self._plain[term] = self.at[s:e].tolist(), self.impact[s:e].tolist()
        return self._plain[term]


def _offer(heap: list[tuple[int, int]], score: int, doc: int, top: int) -> None:
    """Keep the best of (score, -id): larger scores, then smaller ids."""
    if score > 0:
        if len(heap) < top:
            heapq.heappush(heap, (score, -doc))
        elif (score, -doc) > heap[0]:
            heapq.heapreplace(heap, (score, -doc))


def wand(lists: Lists, item: Counter[int], heap: list[tuple[int, int]], search: Search) -> int:
    """Offer the shard's documents for one item to its heap; returns how many were scored.

    A document with a score below that of the heap's last can't enter, nor can one with the same score and a larger id. The heap is first offered the
    documents of the terms with the largest impacts, so that the threshold is high from the first pivot on.
    """
    own = sorted(((lists.of[t][2] * n, t, n) for t, n in item.items() if t in lists.of and lists.of[t][2] > 0), reverse=True)
    if not own:
        return 0
    top, ids, scored = search.top, lists.ids, set()
    first: list[int] = []
    for _, t, _ in own:
        s, e, _ = lists.of[t]
        first.extend(lists.at[s : min(e, s + search.primed)].tolist())
        if len(first) >= search.primed:
            break
    if len(heap) < top or sum(m for m, _, _ in own) >= heap[0][0]:
        docs = np.unique(np.array(first, np.int64))
        total = np.zeros(len(docs), np.int64)
        for _, t, n in own:
            s, e, _ = lists.of[t]
            spot = np.searchsorted(lists.at[s:e], docs)
            ok = spot < e - s
            ok[ok] = lists.at[s + spot[ok]] == docs[ok]
            total[ok] += n * lists.impact[s + spot[ok]]
        for d, x in zip(docs.tolist(), total.tolist(), strict=True):
            _offer(heap, x, int(ids[d]), top)
        scored.update(docs.tolist())
    end = len(ids)
    # a cursor: next document, largest impact, how often the item has the term, place in the list, documents, impacts
    cursors = [[lists.plain(t)[0][0], m, n, 0, *lists.plain(t)] for m, t, n in own]
    while cursors:
        cursors.sort(key=lambda c: c[0])
        least, sum_, pivot = heap[0][0] if len(heap) == top else 1, 0, -1
        for i, c in enumerate(cursors):
            sum_ += c[1]
            if sum_ >= least:
                pivot = i
                break
        if pivot < 0:
            break
        doc = cursors[pivot][0]
        if cursors[0][0] == doc:
            score, i = 0, 0
            while i < len(cursors) and cursors[i][0] == doc:
                c = cursors[i]
                score += c[2] * c[5][c[3]]
                c[3] += 1
                c[0] = c[4][c[3]] if c[3] < len(c[4]) else end
                i += 1
            if doc not in scored:
                scored.add(doc)
                _offer(heap, score, int(ids[doc]), top)
        else:
            for c in cursors[:pivot]:
                if c[0] < doc:
                    c[3] = bisect_left(c[4], doc, c[3])
                    c[0] = c[4][c[3]] if c[3] < len(c[4]) else end
        cursors = [c for c in cursors if c[0] < end]
    return len(scored)


def search_documents(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item by score, equal scores by ascending id.

    Only scores above 0 count. An item without a term or without such a document has no rows. Each row of ``items`` is an
    item of its own, with a null id too; rows that repeat an id and the terms are one. Each row of ``docs`` is a document of its own; a null
    text has no terms and counts nowhere, and a null id comes after all others of its score. Empty tables give no rows.
    Items are read in blocks of bounded size, each a pass over the documents; other columns are ignored.
    """
    spark, found = docs.sparkSession, []
    for block in blocks(items, search):
        found.append(_search_block(docs, block, search))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs: DataFrame, block: list[tuple[int | None, Counter[bytes]]], search: Search) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    distinct = {(i, tuple(sorted((vocabulary[t], n) for t, n in own.items()))) for i, own in block}
    asked = sorted(distinct, key=lambda x: (x[0] is None, x))
    shards = write_shards(docs, vocabulary, search)
    documents, words, df = term_counts(shards)
    weights = {t: weight(documents, n) for t, n in df.items()}
    wanted = [Counter(dict(own)) for _, own in asked]

    def run(batches):
        heaps: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for b in batches:
            for row in b.to_dict("records"):
                lists = Lists(row, weights, documents, words)
                for item, heap in zip(wanted, heaps, strict=True):
                    wand(lists, item, heap, search)
        out = [(i, -doc, score) for i, heap in enumerate(heaps) for score, doc in heap]
        if out:
            yield pd.DataFrame(out, columns=["item", "doc_id", "score"])

    best = materialize(shards.mapInPandas(run, "item int, doc_id long, score long"), "search-heaps", 1)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    merged = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.top)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked)], "item int, item_id long")
    doc_id = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id")
    return merged.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score")
