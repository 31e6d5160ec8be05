"""The stream of runs: gaps, repeats, ends, stretches, and going on after a stop."""

import datetime as dt

import pytest

from brindle.sources import readers as S
from brindle.sources.run_log import RunLog
from brindle.streaming import runs

AT = dt.datetime(2024, 1, 2, 3)


def _append(spark, path, rows, by_type=False):
    events = spark.createDataFrame([(r, n, t, f"{r}{n}", AT) for r, n, t in rows], S.EVENTS)
    S.append_events(events, path) if by_type else events.write.mode("append").parquet(path)


def _follow(spark, path, **options):
    spark.dataSource.register(RunLog)
    return spark.readStream.format("run_log").options(path=path, **options).load()


def _rows(spark, stream, out):
    return sorted((r.run_id, r.seq, r.payload, r.created_at) for r in spark.read.schema(stream.schema).parquet(out).collect())


@pytest.mark.parametrize("by_type", [False, True])
def test_goes_on_after_a_stop_and_waits_for_gaps(spark, tmp_path, by_type):
    log, out, check = (f"{tmp_path}/{x}" for x in ("log", "out", "check"))
    stream = _follow(spark, log, runs="a,b,none", after="1", until="done,failed", rows="2")
    _append(spark, log, [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "x"), ("a", 5, "x"), ("b", 2, "x"), ("b", 4, "done"), ("c", 2, "x"), (None, 2, "x"), ("a", None, "x")], by_type)
    runs.drain(stream, out, check)
    assert [r[:2] for r in _rows(spark, stream, out)] == [("a", 2), ("a", 3), ("b", 2)]
    runs.drain(stream, out, check)
    _append(spark, log, [("a", 4, "x"), ("a", 4, "x"), ("a", 6, "failed"), ("a", 7, "x"), ("b", 3, "x"), ("b", 5, "x")], by_type)
    runs.drain(_follow(spark, log, runs="a,b,none", after="1", until="done,failed", rows="2"), out, check)
    assert _rows(spark, stream, out) == [(r, n, f"{r}{n}", AT) for r, n in [("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 6), ("b", 2), ("b", 3), ("b", 4)]]
    runs.drain(stream, out, check)
    assert len(_rows(spark, stream, out)) == 8


def test_a_trigger_that_fails_is_replayed_once(spark, tmp_path):
    log, out, check = (f"{tmp_path}/{x}" for x in ("log", "out", "check"))
    _append(spark, log, [("a", n, "x") for n in range(1, 8)])
    stream = _follow(spark, log, runs="a")

    def fails(batch, n):
        batch.collect()
        raise RuntimeError("killed")

    query = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(fails).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    _append(spark, log, [("a", n, "x") for n in range(8, 11)])
    runs.drain(stream, out, check, mode="update")
    runs.drain(stream, out, check, mode="update")
    batches = [sorted(r.seq for r in spark.read.parquet(str(p)).collect()) for p in sorted((tmp_path / "out").glob("trigger=*"))]
    assert batches[0] == list(range(1, 8)) and sorted(sum(batches, [])) == list(range(1, 11))


def test_stretches_and_lost_rows(spark, tmp_path):
    assert RunLog({"path": f"{tmp_path}/no", "runs": "a"}).streamReader(None).latestOffset() == {"a": 0}
    _append(spark, f"{tmp_path}/log", [("a", n, "x") for n in range(1, 8)])
    reader = RunLog({"path": f"{tmp_path}/log", "runs": "a", "rows": "3"}).streamReader(None)
    assert reader.latestOffset() == {"a": 7}
    parts = reader.partitions({"a": 0}, {"a": 7})
    assert [(p.after, p.last) for p in parts] == [(0, 3), (3, 6), (6, 7)]
    assert [x for p in parts for b in reader.read(p) for x in b.column("seq").to_pylist()] == list(range(1, 8))
    with pytest.raises(ValueError, match="gone"):
        list(reader.read(reader.partitions({"a": 6}, {"a": 9})[0]))
