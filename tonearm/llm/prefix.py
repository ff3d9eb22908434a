"""Distributed prefix sums: running sums over a range-sorted table, carried over partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shuffle_parts


def prefix_sums(df: DataFrame, order: list[str], sums: list[str], keep: list[str], name: str, group: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row and, for each column of ``sums``, ``<column>_upto``: its sum over the
    rows up to this one (itself included) in the order of ``order``, within the rows of the same ``group``.

    sums and group are long columns without nulls; a sum must fit a long. Rows are range-sorted by group and order, so a group
    may span any number of tasks; each task adds up its own rows, and what it carries on to the next is
    one row a partition, added up on the driver. Rows that tie in the whole order come in any order.
    """
    spark, keys = df.sparkSession, ([group] if group else []) + [c for c in order if c != group]
    rows = df.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    rows = rows.select(*dict.fromkeys([*keep, *sums, *([group] if group else [])]))
    columns, upto = rows.columns, [f"{c}_upto" for c in sums]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in upto), T.StructField("_part", T.LongType()), T.StructField("_at", T.LongType())])

    def add(batches):
        from pyspark import TaskContext

        part, seen, last, carried = TaskContext.get().partitionId(), 0, None, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = not seen
            if group:
                g = b.column(columns.index(group)).to_numpy(zero_copy_only=False)
                new[0] = not seen or g[0] != last
                new[1:] = g[1:] != g[:-1]
                last = g[-1]
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for i, c in enumerate(sums):
                v = b.column(columns.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                total = total - np.where(start >= 0, (total - v)[start], -carried[i])
                carried[i] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
            more = [pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(seen, seen + n), pa.int64())]
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, *out, *more], names=[*columns, *upto, "_part", "_at"])

    walked = materialize(rows.mapInArrow(add, schema), name)
    first, ends = F.col(group) if group else F.lit(0), F.struct(*upto)
    edges = walked.groupBy("_part").agg(F.min_by(first, "_at").alias("first"), F.max_by(first, "_at").alias("last"), F.max_by(ends, "_at").alias("ends"))
    offsets, at, total = [], None, [0] * len(sums)
    for e in sorted(edges.collect(), key=lambda r: r["_part"]):  # a row a partition
        goes_on = at is not None and e["first"] == at[0]
        if goes_on:
            offsets.append((e["_part"], e["first"], *total))
        total = [t * (goes_on and e["first"] == e["last"]) + x for t, x in zip(total, e["ends"], strict=True)]
        at = (e["last"],)
    more = ", ".join(f"_o{i} long" for i in range(len(sums)))
    carried = spark.createDataFrame(offsets, f"_p long, _g long, {more}")
    same = (walked["_part"] == carried["_p"]) & ((walked[group] == carried["_g"]) if group else F.lit(True))
    return walked.join(F.broadcast(carried), same, "left").select(*keep, *(c for c in sums if c not in keep), *((F.col(u) + F.coalesce(f"_o{i}", F.lit(0))).alias(u) for i, u in enumerate(upto)))


