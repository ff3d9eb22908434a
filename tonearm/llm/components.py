"""Connected components of a table of links, by passing on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp): the smallest id that each id of (a, b) links is connected with.

    In each round every id takes the smallest label among its neighbours and then its label's label,
    so paths halve; rounds are written to the shared folder, each is removed when the next is there, and they end when nothing changes. Ids without a link are not
    in the result. Links may repeat, go either way, or lead from an id to itself.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null")
    both = materialize(both.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), f"{name}-links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        of = labels.select(F.col("id").alias("of"), F.col("comp").alias("jump"))
        step = materialize(step.join(of, step["comp"] == of["of"]).select("id", "old", F.least("comp", "jump").alias("comp")), name)
        changed = step.where("old <> comp").limit(1).count()
        forget(labels)
        labels = step.select("id", "comp")
        if not changed:
            forget(both)
            return labels
