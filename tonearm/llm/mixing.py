"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Weights that sources get in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST_COPIES = 3
#: Ranges of the Pareto order by which a source's cut is located, and ranges of each of these.
BUCKETS = 256
#: Inclusion in proportion to size to this power: longer documents are less likely, so a sample has more documents for its words.
TILT = -0.5


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: of (source, size) rows, one row a source.

    Sources in code-point order, null last, weigh ``weights`` by turns and share the total size by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight. That is a water level: in order of size a unit of weight, the sources up to a place are
    capped and the rest share what is left. One row a source, so the windows here are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    total = Window.partitionBy()
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    per = (
        per.withColumn("all", F.sum("source_size").over(total))
        .withColumn("heavy", F.sum("weight").over(total))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(order), F.lit(0)))
        .withColumn("light", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("level", (F.col("all") - F.col("capped")) / (F.col("heavy") - F.col("light")))
    )
    # the first in order that isn't capped; among equal ratios that is the one of the highest level
    level = -F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("minus")))).over(total)["minus"]
    target = F.least(F.col("weight") * level, (F.col("source_size") * most).cast("double"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def size_class(size: Column) -> Column:
    """Documents of about the same size: four classes an octave."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 4).cast("int")


def inclusion(sizes: DataFrame, targets: DataFrame, tilt: float) -> DataFrame:
    """source, class, odds: the probability with which a document is taken once more, by its source and size class.

    It is in proportion to the class's typical size to the power ``tilt``, one at most, and such that a
    source's expected words are its ``rest``. Classes that reach one are certain; what they leave is shared by the others,
    which is a water level over a source's classes: a hundred rows or so at any size of the table.
    """
    per = sizes.groupBy("source", "class").agg(F.sum("size").alias("words"))
    per = per.join(targets, per["source"].eqNullSafe(targets["t_source"])).select(per["source"], "class", "words", "rest")
    per = per.withColumn("heft", F.pow(F.lit(2.0), F.col("class") * (tilt / 4)))
    before = Window.partitionBy("source").orderBy(F.desc("heft"), "class").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    per = per.withColumn("load", F.col("heft") * F.col("words"))
    per = per.withColumn("sure", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("open", F.sum("load").over(every) - F.coalesce(F.sum("load").over(before), F.lit(0.0)))
    # the level if all classes heavier than this one are certain; the largest that keeps the others at one or less holds
    per = per.withColumn("level", F.when(F.col("open") > 0, (F.col("rest") - F.col("sure")) / F.col("open")))
    fits = F.min(F.when((F.col("level") * F.col("heft") <= 1) & (F.col("level") >= 0), F.struct(F.lit(-1.0) * F.col("heft"), "level"))).over(every)["level"]
    return per.select(F.col("source").alias("i_source"), F.col("class").alias("i_class"), F.least(F.coalesce(fits, F.lit(1.0)) * F.col("heft"), F.lit(1.0)).alias("odds"))


def pareto_order(odds: Column, seed: int, *keys: Column) -> Column:
    """In [0, 1], the order of random odds divided by the odds of inclusion: below a half where a document is likelier in than out.

    The random odds are fixed by the keys. With q = (u / (1 - u)) / (p / (1 - p)) it is q / (1 + q); certain documents have 0.
    """
    u = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    out = u * (1 - odds)
    return F.when(odds >= 1, 0.0).when(odds <= 0, 1.0).otherwise(out / (out + (1 - u) * odds))


def _cut(rows: DataFrame, bucket: str) -> DataFrame:
    """c_source, at, before: the bucket in which a source's running words reach its rest, and its words before that; of (source, rest, so_far, size, bucket) rows."""
    per = rows.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("so_far").alias("so_far"))
    upto = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("upto", F.col("so_far") + F.sum("words").over(upto)).where(F.col("upto") >= F.col("rest"))
    first = per.groupBy(F.col("source").alias("c_source")).agg(F.min(F.struct(bucket, (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    return first.select("c_source", F.col(f"cut.{bucket}").alias("at"), F.col("cut.before").alias("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = BUCKETS, tilt: float = TILT, seed: int = 5) -> DataFrame:
    """doc_id, size, source, source_size, target, odds, copies, taken, text_key: of every document how often the mix takes it.

    A source's target is so many whole passes over it, which every document gets, and a remainder. For
    that, each document has its odds of inclusion by size (see inclusion), and documents are taken in
    Pareto order, certain ones first, until the source's words come
    nearest its target; so the sample's size is fixed and rows agree between runs. The place of the
    cut is found from sums over ``buckets`` ranges of the order, then over as many within that range, and
    exactly in the one narrow range that holds it, so
    that no source is ever gathered in a task. Null texts have size 0; null sources are one source;
    rows that repeat an id are ranked by a hash of id, size and text too, equal rows in any order, so ids shared by very many
    rows (null may be) lie all over the order. ``text_key`` tells rows of one id apart by their texts. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_key"))
    sizes = materialize(sizes.withColumn("class", size_class(F.col("size"))), "mix-sizes")
    passes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sizes).withColumn("whole", F.floor(passes).cast("int"))
    targets = targets.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).withColumnRenamed("source", "t_source")
    targets = materialize(targets, "mix-targets")
    odds = materialize(inclusion(sizes, targets, tilt).join(targets, F.col("i_source").eqNullSafe(F.col("t_source"))).drop("t_source"), "mix-odds")
    rows = sizes.join(odds, sizes["source"].eqNullSafe(odds["i_source"]) & (sizes["class"] == odds["i_class"])).drop("i_source", "i_class")
    order = pareto_order(F.col("odds"), seed, F.col("doc_id"), F.col("size"), F.col("text_key"))
    rows = rows.withColumn("order", order).withColumn("wide", F.least(F.floor(F.col("order") * buckets), F.lit(buckets - 1)).cast("int"))
    rows = rows.withColumn("narrow", F.floor((F.col("order") * buckets - F.col("wide")) * buckets).cast("int"))
    cut = materialize(_cut(rows.withColumn("so_far", F.lit(0)), "wide"), "mix-cut")
    rows = rows.join(cut, rows["source"].eqNullSafe(cut["c_source"]), "left").drop("c_source")
    keep = ("doc_id", "source", "size", "text_key", "source_size", "target", "odds", "whole")
    inside = F.coalesce(F.col("wide") == F.col("at"), F.lit(False))
    # without a cut the source's words never reach its rest, so all are taken
    clear = rows.where(~inside).select(*keep, (F.coalesce(F.col("wide") < F.col("at"), F.lit(True)) & (F.col("rest") > 0)).alias("more"))
    near = rows.where(inside).withColumnRenamed("before", "so_far").drop("at")
    fine = materialize(_cut(near, "narrow").withColumnRenamed("before", "f_before"), "mix-fine")
    near = near.join(fine, near["source"].eqNullSafe(fine["c_source"])).drop("c_source")
    beside = near.where(F.col("narrow") != F.col("at")).select(*keep, ((F.col("narrow") < F.col("at")) & (F.col("rest") > 0)).alias("more"))
    line = Window.partitionBy("source").orderBy("order", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = near.where(F.col("narrow") == F.col("at")).withColumn("upto", F.col("f_before") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    edge = edge.select(*keep, ((F.col("rest") - F.col("upto")) * 2 > F.col("size")).alias("more"))
    copies = F.col("whole") + F.when(F.col("more") & (F.col("whole") < MOST_COPIES), 1).otherwise(0)
    return clear.unionByName(beside).unionByName(edge).select(
        "doc_id", "size", "source", "source_size", "target", "odds", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "text_key"
    )
