"""Structured Streaming forms of the work queue and of incremental sub-block powers.

They extend the batch operators to streams of events: the batch results are the same for whole inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_states(events: DataFrame) -> DataFrame:
    """path, status, ts: the last state of each path, for the update or complete output mode; (path, ts, ord, status) rows."""
    last = F.max(F.struct("ts", "ord", "status"))
    return events.groupBy("path").agg(last.alias("l")).select("path", F.col("l.status").alias("status"), F.col("l.ts").alias("ts"))


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """start, status, n: states by time, final once the watermark has passed."""
    per = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("start"), "status", "n")


def sub_block_powers(samples: DataFrame, size: int) -> DataFrame:
    """track_id, sub, n, power: mean square of each run of ``size`` samples of (track_id, i, x) rows; any chunking of a track gives the same."""
    per = samples.groupBy("track_id", F.floor(F.col("i") / size).alias("sub")).agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("power"))
    return per
