"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are projected several times to a few dimensions, along directions drawn from the
covariance of a sample, shifted, and given a Hilbert key a projection. Every curve is range-sorted
in Spark, so each vector gets its rank on each curve. A query meets the vectors at most ``window``
ranks away on any curve; their scores are estimated from 8-bit codes, what the curves find is
merged, and the best are ranked again by the exact measure. The window is not guessed: for a bounded
sample of queries the exact neighbours and their ranks are found in two passes, and the number of
curves and the window are the cheapest that hold ``recall`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts
from .hilbert import cells_of, hilbert_keys


#: What one more curve costs, in rows compared a query: wide windows on few curves or narrow ones on many.
CURVE_COST = 32


@dataclass(frozen=True)
class CurveIndex:
    """curves: orderings at most; dims, bits: of the cells of a curve; fit_rows: sampled vectors for the covariance.

    sample: queries that curves and window are fitted on; recall: what they must hold of their
    neighbours; segment: rows of a curve that a task looks at together, at least four windows;
    spare: candidates by estimated score for each neighbour wanted.
    """

    curves: int = 32
    dims: int = 8
    bits: int = 7
    fit_rows: int = 4096
    sample: int = 256
    recall: float = 0.94
    segment: int = 16384
    spare: int = 8
    seed: int = 7


@dataclass(frozen=True)
class Fitted:
    """What the sample says: curves used, rows of the window at each side, and distinct vectors."""

    curves: int
    window: int
    rows: int


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.zeros((0, 1))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes; cosines stay exactly the same."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b, in double precision; equal pairs get equal values."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors of doubles. Null ids, null, empty and zero vectors, and vectors with null or
    non-finite components are left out. Rows that repeat an id stay; they are found once, with their best score."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(~bad & F.exists("v", lambda x: x != 0.0))
    )


def _distinct(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(rid, v, ids, asks): distinct vectors with their k + 1 smallest ids; and (query_id, mark) of the queries.

    Copies of a vector are all equally near to anything, so no answer needs more of their ids, and a
    vector with very many copies is one row of the index.
    """
    marked = vectors.withColumn("mark", F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))))))
    marked = materialize(marked.withColumn("asks", is_query), "ann-marked")
    place = F.row_number().over(Window.partitionBy("mark").orderBy("vec_id"))
    few = marked.select("mark", "vec_id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    few = few.groupBy("mark").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = marked.groupBy("mark").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    reps = materialize(one.join(few, "mark").withColumn("rid", F.monotonically_increasing_id()), "ann-distinct")
    asked = marked.where("asks").select(F.col("vec_id").alias("query_id"), "mark").distinct()
    return reps, asked.join(reps.where("asks").select("mark", F.col("rid").alias("q")), "mark").select("query_id", "q")


def _directions(reps: DataFrame, dim: int, ix: CurveIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions (dim, curves * dims), orthogonal within a curve and drawn from the sample's covariance; means, deviations and shifts."""
    rows = reps.select("rid", "v").orderBy(F.xxhash64("rid"), "rid").limit(ix.fit_rows).collect()
    u = _unit(np.array([r.v for r in rows], np.float64))
    rng = np.random.Generator(np.random.PCG64(ix.seed))
    centred = u - u.mean(axis=0)
    root = np.linalg.cholesky(centred.T @ centred / len(u) + np.eye(dim) * 1e-6 / dim)
    p = np.concatenate([np.linalg.qr(root @ rng.normal(size=(dim, min(ix.dims, dim))))[0] for _ in range(ix.curves)], axis=1)
    y = u @ p
    return p, y.mean(axis=0), np.maximum(y.std(axis=0), 1e-9), rng.random(p.shape[1])


def _indexed(reps: DataFrame, dim: int, ix: CurveIndex) -> DataFrame:
    """rid, asks, v, keys (one a curve), code (the unit vector in 8-bit steps after its step, a float)."""
    p, mean, dev, shift = _directions(reps, dim, ix)
    wide = min(ix.dims, dim)

    def index(batches):
        for b in batches:
            if not len(b):
                continue
            u = _unit(_matrix(b["v"]))
            x = (1 / (1 + np.exp(-1.702 * np.clip((u @ p - mean) / dev, -30, 30))) + shift) / 2  # near uniform, then shifted in a cube of twice the side
            cells = cells_of(x, ix.bits)
            b["keys"] = list(np.stack([hilbert_keys(cells[:, c * wide : (c + 1) * wide], ix.bits) for c in range(ix.curves)], axis=1))
            step = (np.abs(u).max(axis=1) / 127).astype("<f4")
            codes = np.rint(u / step[:, None]).astype(np.int8)
            b["code"] = [s.tobytes() + c.tobytes() for s, c in zip(step, codes, strict=True)]
            yield b

    return materialize(reps.select("rid", "asks", "v").mapInPandas(index, "rid long, asks boolean, v array<double>, keys array<long>, code binary"), "ann-keys")


def _fit(keyed: DataFrame, k: int, ix: CurveIndex) -> Fitted:
    """The cheapest number of curves and window in rows that hold ``recall`` of the sampled queries' exact neighbours."""
    rows = keyed.count()
    sample = keyed.where("asks").orderBy(F.xxhash64("rid"), "rid").limit(ix.sample).select("rid", "v", "keys").collect()
    if not sample:
        return Fitted(1, 1, rows)
    own, queries = np.array([r.rid for r in sample]), _unit(np.array([r.v for r in sample], np.float64))

    def exact(batches):
        for b in batches:
            if not len(b):
                continue
            rids = b["rid"].to_numpy()
            near = queries @ _unit(_matrix(b["v"])).T
            near[own[:, None] == rids[None, :]] = -np.inf
            at = np.argpartition(-near, min(k, len(b)) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(own)), at.shape[1])
            yield pd.DataFrame({"q": q, "rid": rids[at.ravel()], "score": near[q, at.ravel()], "keys": list(b["keys"].iloc[at.ravel()])})

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rid"))
    found = keyed.select("rid", "v", "keys").mapInPandas(exact, "q int, rid long, score double, keys array<long>").where(F.col("score") >= -1.5).withColumn("r", rank).where(F.col("r") <= k).select("q", "keys").collect()
    if not found:
        return Fitted(1, 1, rows)
    asked = np.array([sample[r.q]["keys"] for r in found], np.int64)
    near = np.array([r["keys"] for r in found], np.int64)
    low, high = np.minimum(asked, near), np.maximum(asked, near)
    marks = [np.unique(np.concatenate((low[:, c], high[:, c]))) for c in range(ix.curves)]
    # rows below each mark, and up to it: the ranks that two keys of the sample have on a curve, at any size of the table

    def count(batches):
        total = [np.zeros((2, len(m) + 1), np.int64) for m in marks]
        for b in batches:
            if len(b):
                keys = np.stack(b["keys"].to_numpy())
                for c, m in enumerate(marks):
                    for side, name in enumerate(("left", "right")):
                        total[c][side] += np.bincount(np.searchsorted(m, keys[:, c], name), minlength=len(m) + 1)
        for c, t in enumerate(total):
            yield pd.DataFrame({"curve": c, "mark": np.arange(t.shape[1]), "upto": t[0], "below": t[1]})

    counted = keyed.select("keys").mapInPandas(count, "curve int, mark int, upto long, below long").groupBy("curve", "mark").agg(F.sum("upto").alias("upto"), F.sum("below").alias("below")).collect()
    counts = [np.zeros((2, len(m) + 1), np.int64) for m in marks]
    for r in counted:
        counts[r.curve][:, r.mark] = r.upto, r.below
    gaps = []
    for c, m in enumerate(marks):
        upto, below = np.cumsum(counts[c], axis=1)
        gaps.append(upto[np.searchsorted(m, high[:, c])] - below[np.searchsorted(m, low[:, c])])
    best = np.minimum.accumulate(np.array(gaps), axis=0)  # by the number of curves
    place = int(np.ceil(ix.recall * best.shape[1])) - 1
    windows = np.sort(best, axis=1)[:, place].clip(1)
    cost = np.arange(1, ix.curves + 1) * (2 * windows + 1 + CURVE_COST)
    curves = int(cost.argmin()) + 1
    return Fitted(curves, int(windows[curves - 1]), rows)


def _ranked(keyed: DataFrame, fitted: Fitted) -> DataFrame:
    """curve, rid, rank: every curve in the order of its keys, by one range sort and the sizes of its partitions."""
    keys = F.slice("keys", 1, fitted.curves)
    spots = keyed.select("rid", F.posexplode(keys).alias("curve", "key"))
    spots = spots.repartitionByRange(shuffle_parts(keyed.sparkSession), "curve", "key", "rid").sortWithinPartitions("curve", "key", "rid")

    def number(batches):
        from pyspark import TaskContext

        part, upto = TaskContext.get().partitionId(), np.zeros(fitted.curves, np.int64)
        for b in batches:
            curve = b["curve"].to_numpy()
            n = np.bincount(curve, minlength=fitted.curves)
            first = np.cumsum(n) - n  # rows of a batch are in order of their curves
            place = np.arange(len(b)) - first[curve] + upto[curve]
            upto += n
            yield pd.DataFrame({"part": part, "curve": curve, "rid": b["rid"], "place": place})

    placed = materialize(spots.select("curve", "rid").mapInPandas(number, "part int, curve int, rid long, place long"), "ann-places")
    # a row a partition and curve
    sizes = placed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.withColumn("before", before), ["curve", "part"]).select("curve", "rid", (F.col("place") + F.col("before")).alias("rank"))


def nearest(vectors: DataFrame, is_query: Column, k: int, ix: CurveIndex = CurveIndex()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query found, by cosine, ties to the smaller id.

    ``vectors`` comes from valid_vectors; ``is_query`` is a condition on vec_id. A row is never its
    own neighbour. Vectors of another length than the commonest (the smaller, if two are) are left out. Without a
    vector the result is empty. Rows that repeat an id are one query, and as a candidate stand with their best score.
    Copies of a vector are one entry of the index, so a hot group of copies costs no more than one.
    """
    return search(vectors, is_query, k, ix)[0]


def search(vectors: DataFrame, is_query: Column, k: int, ix: CurveIndex = CurveIndex()) -> tuple[DataFrame, Fitted]:
    """As nearest, with what was fitted: a query is compared with curves * (2 * window + 1) rows at most."""
    spark = vectors.sparkSession
    first = vectors.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), Fitted(0, 0, 0)
    reps, asked = _distinct(vectors.where(F.size("v") == first.n), is_query, k)
    keyed = _indexed(reps, first.n, ix)
    fitted = _fit(keyed, k, ix)
    window, segment, keep = fitted.window, max(ix.segment, 4 * fitted.window), ix.spare * k
    spots = _ranked(keyed, fitted).join(keyed.select("rid", "asks", "code"), "rid")
    # a query also goes to the segments beside its own that its window reaches into
    at = lambda r: F.floor(r / segment)
    own, reach = at(F.col("rank")), F.sequence(at(F.greatest(F.col("rank") - window, F.lit(0))), at(F.col("rank") + window))
    dealt = spots.withColumn("segment", F.explode(F.when(F.col("asks"), reach).otherwise(F.array(own)))).withColumn("here", F.col("segment") == own)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        rows = group[group["here"]]
        ranks, rids = rows["rank"].to_numpy(), rows["rid"].to_numpy()
        both = {}
        for name, part in (("q", group[group["asks"]]), ("c", rows)):
            raw = np.frombuffer(b"".join(part["code"]), np.int8).reshape(len(part), -1)
            both[name] = raw[:, 4:].astype(np.float32) * np.frombuffer(raw[:, :4].tobytes(), "<f4")[:, None]
        asks = group[group["asks"]]
        starts, ends = np.searchsorted(ranks, asks["rank"].to_numpy() - window), np.searchsorted(ranks, asks["rank"].to_numpy() + window, "right")
        out_q, out_c, out_s = [], [], []
        for q, line, a, b in zip(asks["rid"].to_numpy(), both["q"], starts, ends, strict=True):
            score = both["c"][a:b] @ line
            top = np.argpartition(-score, keep)[:keep] if len(score) > keep else np.arange(len(score))
            out_q.append(np.full(len(top), q))
            out_c.append(rids[a:b][top])
            out_s.append(score[top])
        flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pd.DataFrame({"q": flat(out_q, np.int64), "c": flat(out_c, np.int64), "near": flat(out_s, np.float32)})

    met = dealt.select("curve", "segment", "rid", "rank", "asks", "here", "code").groupBy("curve", "segment").applyInPandas(compare, "q long, c long, near float")
    # the query's own vector is a candidate too: its copies are neighbours
    met = met.where("q <> c").groupBy("q", "c").agg(F.max("near").alias("near"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "c"))
    pairs = met.withColumn("place", place).where(F.col("place") <= keep).select("q", "c")
    pairs = pairs.unionByName(reps.where("asks").select(F.col("rid").alias("q"), F.col("rid").alias("c")))

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_cosines(_matrix(a), _matrix(b))) if len(a) else pd.Series([], dtype="float64")

    whole = reps.select(F.col("rid").alias("c"), F.col("v").alias("cv"), "ids")
    exact = pairs.join(whole, "c").join(reps.where("asks").select(F.col("rid").alias("q"), F.col("v").alias("qv")), "q")
    exact = exact.select("q", "ids", cosine("qv", "cv").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    best = exact.withColumn("r", rank).where(F.col("r") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    named = asked.join(best, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), fitted
