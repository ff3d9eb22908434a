"""Places in an order over a whole table, without bringing the table to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A row's number within its partition is in the low bits of its increasing id, the partition's above them.
ROW_BITS = 33


def ensure_checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints: the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process, one of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tonearm-"))


def numbered(rows: DataFrame, keys: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Rows with their place, from 1, in the order of some keys that no two rows share.

    Spark sorts the rows by ranges of the keys and each gets its number within its range, which a checkpoint holds fast; a range
    starts after the rows of the ranges before it, of which there is one count each. Nothing is brought to the driver.
    """
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at = [f"_k{i}" for i in range(len(keys))]
    ordered = rows.withColumns(dict(zip(at, keys, strict=True))).repartitionByRange(parts, *at).sortWithinPartitions(*at).drop(*at)
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    ordered = ordered.withColumns({"_part": F.shiftright("_id", ROW_BITS), "_row": F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)})
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))  # a row a range
    return ordered.join(F.broadcast(counts), "_part").withColumn(name, F.col("_row") + F.col("_before") + 1).drop("_id", "_part", "_row", "_before")
