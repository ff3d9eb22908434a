"""The index from a stream: later batches win, a stop and a repeated batch change nothing."""

from __future__ import annotations

from tonearm.streaming import index

SCHEMA = "folder string, modified long, release_id string"


def test_index_stream(spark, tmp_path):
    source, store, check = (f"{tmp_path}/{n}" for n in ("in", "index", "check"))
    batches = [[("a", 1, "r1"), ("b", 1, "r2"), ("a", 3, "r3"), ("a", 2, "r4")], [("b", 5, None), ("c", 4, "r5")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = index.index_updates(spark.readStream.schema(SCHEMA).parquet(source), store, check).trigger(availableNow=True).start()  # stopped and started again for each
        query.awaitTermination(60)
        assert query.exception() is None and n >= 0
    want = {("a", 3, "r3", 3), ("b", 5, None, 1), ("c", 4, "r5", 4)}
    assert {tuple(r) for r in index.current_index(spark, store).collect()} == want
    index.batch_writer(store)(spark.createDataFrame(batches[0], SCHEMA), 0)  # repeated after a later one
    assert {tuple(r) for r in index.current_index(spark, store).collect()} == want
