"""Stateful streams: three triggers with a restart between them, late, repeated and out-of-order rows; state that goes away."""

import json
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from brindle.streaming import runs, settled

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double"
KINDS = ["click", "view", "error", "purchase"]


def log_rows():
    """Rows in time order, and three deliveries of them: rows up to some minutes late, and some delivered twice."""
    rng = random.Random(8)
    at, rows = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(900):
        at += timedelta(seconds=rng.choice([1, 30, 120, 120, 400]))
        rows.append((i, rng.randrange(6) if i % 300 < 280 else 0, at, rng.choice(KINDS), round(rng.uniform(0, 9), 2)))
    parts = [[], [], []]
    for r in rows:
        part = min(2, r[0] // 300)
        if part < 2 and r[2] > rows[300 * part + 299][2] - timedelta(minutes=5) and rng.random() < 0.5:
            part += 1  # delivered late, but within the watermark
        parts[part].append(r)
        if rng.random() < 0.05:
            parts[part].append(r)
    for p in parts:
        rng.shuffle(p)
    return rows, parts


@pytest.fixture
def drained(spark, tmp_path):
    def run(build, rocksdb=True, last=None):
        rows, parts = log_rows()
        if last:
            parts.append([last])
        progress = None
        for k, part in enumerate(parts):
            frame = spark.createDataFrame(part, SCHEMA)
            frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            # A new stream on the same checkpoint: it goes on where the one before stopped.
            stream = build(runs.log_stream(spark, f"{tmp_path}/log", frame.schema))
            progress = runs.drain(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", rocksdb=rocksdb)
        return rows, spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"), progress

    return run


FAR = (9999, 77, datetime(2024, 6, 1, tzinfo=timezone.utc), "view", 0.0)


def test_numbers_over_three_triggers_equal_the_batch(spark, drained):
    rows, out, _ = drained(lambda log: settled.processed(log, settled.Sequence()))
    want, last = {}, {}
    for i, user, *_ in rows:
        last[user] = last.get(user, 0) + 1
        want[i] = (user, last[user])
    got = out.collect()
    assert len(got) == len({r.event_id for r in got}) > 600
    assert all(want[r.event_id] == (r.user_id, r.seq) for r in got)
    whole = settled.with_tail(out, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.event_id: (r.user_id, r.seq) for r in whole} == want and len(whole) == len(rows)


def test_an_ended_run_takes_no_more_rows_and_leaves_the_state(drained):
    rows, out, progress = drained(lambda log: settled.processed(log, settled.Sequence(("purchase",), keep_ms=10**10)), last=FAR)
    want, last, over = {}, {}, set()
    for i, user, _, kind, _ in rows:
        if user not in over:
            last[user] = last.get(user, 0) + 1
            want[i] = (user, last[user])
            if kind == "purchase":
                over.add(user)
    assert {r.event_id: (r.user_id, r.seq) for r in out.collect()} == want


def test_runs_over_three_triggers_and_no_state_left(drained):
    gap = 20 * 60 * 1000
    rows, out, progress = drained(lambda log: settled.processed(log, settled.Runs(gap)), last=FAR)
    want, held = [], {}

    def close(user):
        started, _, n, kind, reserved = held.pop(user)
        want.append((user, started, n, "completed" if kind == "purchase" else "failed", 0 if kind == "purchase" else reserved))

    for _, user, at, kind, value in rows:
        us = int(at.timestamp() * 10**6)
        if user in held and us - held[user][1] >= gap * 1000:
            close(user)
        started, _, n, _, reserved = held.get(user, (us, us, 0, kind, 0))
        held[user] = (started, us, n + 1, kind, reserved + (round(value * 100) if kind == "click" else 0))
    for user in list(held):
        close(user)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 30
    # Only the last row, which no watermark has passed, is still held.
    assert progress[0]["operatorName"].startswith("transformWithState") and progress[0]["numRowsTotal"] <= 2, progress


def test_windows_and_pairs_as_streams_equal_the_batch(spark, drained, tmp_path):
    rows, out, progress = drained(lambda log: settled.coalesced(log), rocksdb=False, last=FAR)
    batch = settled.coalesced(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_pairs_of_two_streams_equal_the_batch(spark, drained):
    rows, out, progress = drained(lambda log: settled.followed(log, "click", "purchase"), rocksdb=False, last=FAR)
    batch = settled.followed(spark.createDataFrame(rows, SCHEMA), "click", "purchase")
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 50
    joined = [p for p in progress if "Join" in p["operatorName"]]
    assert joined and all(p["numRowsTotal"] <= 2 for p in joined), progress


def test_settle_rules_by_hand():
    s = settled.Sequence(("end",), keep_ms=10)
    state, out, wake = s.settle((5,), None, [(1, 1, "a", 0), (2, 2, "end", 0), (3, 3, "a", 0)], 100)
    assert out == [(1, 5, 1), (2, 5, 2)] and state == (2, True, 110) and wake == 110
    assert s.settle((5,), state, [(4, 9, "a", 0)], 105)[1] == [] and s.settle((5,), state, [], 110)[0] is None


def test_rows_wait_in_packs_and_not_one_by_one(spark, tmp_path):
    rows, _ = log_rows()
    frame = spark.createDataFrame([*rows, FAR], SCHEMA)
    frame.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = settled.processed(runs.log_stream(spark, f"{tmp_path}/log", frame.schema), settled.Runs(20 * 60 * 1000))
    progress = runs.drain(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", rocksdb=True)
    # The trigger that settles all 900 rows takes six keys' packs from the state; before, each row was an entry of its own.
    assert 6 <= progress[0]["numRowsRemoved"] <= 30, progress
    assert spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").selectExpr("sum(n)").first()[0] == len(rows)


class Held:
    """A key's state, timers and list of packs, as far as the processors ask for them."""

    def __init__(self):
        self.entries, self.value, self.timers = [], None, []

    def getListState(self, name, schema):
        return type("L", (), {"get": lambda s: iter(self.entries), "appendList": lambda s, v: self.entries.extend(v), "put": lambda s, v: self.entries.__setitem__(slice(None), v), "clear": lambda s: self.entries.clear()})()

    def getValueState(self, name, schema):
        return type("V", (), {"get": lambda s: self.value, "update": lambda s, v: setattr(self, "value", v), "clear": lambda s: setattr(self, "value", None)})()

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_packs_keep_rows_order_and_one_timer_for_each_key(monkeypatch):
    monkeypatch.setattr(settled, "PACK", 3)
    rng, held, p = random.Random(3), Held(), settled.Sequence()
    rows = [(1000 * i, 2**60 + i, rng.choice(["é \"a\",\n", "b", None]), i) for i in range(1, 41)]
    assert [len(json.loads(t)) for (t,) in settled.packs(rows[:7])] == [3, 3, 1] and list(settled.unpacked(settled.packs(rows))) == rows and settled.packs([]) == []
    p.init(held)
    got, mixed = [], rng.sample(rows, len(rows))
    for part, now in ((mixed[:25], 0), (mixed[25:], 30), ([], 10**6)):
        frames = [pd.DataFrame(part[i : i + 10], columns=["at", "id", "kind", "cents"]).astype({"kind": object}) for i in range(0, len(part), 10)]
        if frames:
            assert list(p.handleInputRows((5,), iter(frames), None)) == [] and len(held.timers) == 1
        while held.timers and held.timers[0] <= now:
            at = held.timers[0]
            for f in p.handleExpiredTimer((5,), type("T", (), {"getCurrentWatermarkInMs": lambda s, now=now: now})(), None):
                for text in f["rows"]:
                    assert len(json.loads(text)) <= 3
                    got += [(r["event_id"], r["user_id"], r["seq"]) for r in json.loads(text)]
            held.timers.remove(at)  # as Spark does
            assert len(held.timers) <= 1 and all(t > now for t in held.timers)
    assert got == [(2**60 + i, 5, i) for i in range(1, 41)] and held.entries == [] and held.timers == []
