"""Shared folders, materialised tables and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step handles at a time in a task.
CHUNK_CHARS = 1 << 18
#: Whole texts that a Python function gets at a time where their plan is written by this library.
TEXT_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs in one process (as in tests) a folder of this machine is
    made and set; on a cluster its executors could not see it, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tonearm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a fresh folder below the shared one."""
    return f"{shared_dir(spark)}/tonearm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The rows survive lost executors, and what made them runs once. batch_rows: rows that Python
    functions of the plan get at a time, where a batch of the session's size would hold too much text.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, min(batch_rows, int(before)) if int(before) > 0 else batch_rows)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Python functions of the session get TEXT_ROWS rows at a time, unless the session sets a number of its own.

    A batch of Spark's default number of whole texts takes some hundred megabytes in both processes of a task.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, TEXT_ROWS)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, for files that tasks write and read."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def discard(uri: str) -> None:
    """Remove a folder that this library has made below the shared one, if it is there."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that materialize has written and that nothing needs any more."""
    files = df.inputFiles()
    if files:
        discard(files[0].rpartition("/")[0])


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, count: str, most: int = 1 << 20, how: str = "inner") -> DataFrame:
    """The join (inner or left) of rows with a table of one row a key that says how many rows the key has.

    Keys of more than ``most`` rows are at most a ``most``-th of the rows: so few that they are broadcast, and no
    task meets all rows of such a key. The rest is joined as Spark sees fit.
    """
    hot, cool = F.broadcast(per_key.where(F.col(count) > most)), per_key.where(F.col(count) <= most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cool, key, how))


def crc_of(col: Column) -> Column:
    """crc32 of a value written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters with the index of their first; a longer text is a run of its own."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
