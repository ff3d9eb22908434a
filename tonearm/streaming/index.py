"""The library's index kept up by a stream of written albums, a folder of the index for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last row of each folder in a batch, by ``modified``, replaces what the batch of that number wrote before, so a repeated batch changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        last = rows.groupBy("folder").agg(F.max_by(F.struct(*rows.columns), F.struct("modified", *[c for c in rows.columns if c != "modified"])).alias("r"))
        last.select("r.*").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def index_updates(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of (folder, modified, ...) rows, to be started; it goes on from its checkpoint after a stop."""
    return changes.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The index: of each folder the row of its latest batch, with ``added_at``, the first time that it was written with."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy("folder").agg(F.max_by(F.struct(*values), "batch").alias("r"), F.min_by("modified", "batch").alias("added_at"))
    return last.select("r.*", "added_at")
