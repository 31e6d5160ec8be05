"""What a task of the text index holds."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from brindle.operators import text_index as X


def test_an_indexing_task_holds_a_bounded_shard(monkeypatch):
    monkeypatch.setattr(X, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    names, rng = pa.array([f"w{i}" for i in range(5_000)]), np.random.default_rng(1)

    def batches():
        for lo in range(0, 10_000, 1_000):
            words = names.take(pa.array(rng.integers(0, 5_000, 300_000)))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, 300_001, 300), pa.int32()), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 1_000)), listed], names=["id", "t"])

    tracemalloc.start()
    docs = words = 0
    for part in X._shards(batches()):
        for r in part.filter(pa.compute.is_null(part.column(1))).to_pylist():
            docs, words = docs + r["n"], words + r["total"]
            assert r["total"] <= 1_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (docs, words) == (10_000, 3_000_000)
    assert peak < 100e6, peak  # bytes of numpy's arrays


def test_index_rows_are_written_by_the_task_that_made_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common w{i % 7} x{i}") for i in range(400)], "id long, text string")
    index = X.build(docs, f"file://{tmp_path}/index")
    tasks = index.rows.selectExpr("input_file_name() AS f", "shard >> 24 AS task").distinct().groupBy("f").count().collect()
    assert len(tasks) > 4 and {r["count"] for r in tasks} == {1}
