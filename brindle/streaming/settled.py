"""Stateful streams over the run log that act on rows only when the watermark has passed them.

Rows of a run wait in list state until no earlier row can come any more, and are then handed on in order. They wait in
packs, as an entry of a list state costs as much to read as a whole pack. What a run has come to is one value; an
event-time timer wakes it when its next row settles or its time is over, and a run that is over leaves no state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructType

#: A pack of rows that came together, as JSON.
HELD = "rows string"
#: Rows in a pack at most.
PACK = 10_000
#: (microseconds, id, kind, cents) of a row.
Row = tuple[int, int, str, int]


def packs(rows: list) -> list[tuple[str]]:
    """Rows as entries of a list state."""
    return [(json.dumps(rows[i : i + PACK]),) for i in range(0, len(rows), PACK)]


def unpacked(entries: Iterator[tuple[str]]) -> Iterator[Row]:
    for (pack,) in entries:
        yield from map(tuple, json.loads(pack))


class Settled(StatefulProcessor):
    """Hands the rows of a key to ``settle`` in the order of (time, id), once the watermark is past them."""

    value = ""  # schema of what a key has come to
    output: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.state = handle.getValueState("state", self.value)

    def settle(self, key: tuple, state: tuple | None, rows: list[Row], now_ms: int) -> tuple[tuple | None, list[tuple], int | None]:
        """(state, rows to give, when to be woken though no row comes) after some rows; no state: the key is over."""
        raise NotImplementedError

    def _wake(self, at_ms: int | None) -> None:
        """One timer for each key, the earliest that it needs."""
        for t in list(self.handle.listTimers()):
            if at_ms is not None and t <= at_ms:
                return
            self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = list(zip(frame["at"].tolist(), frame["id"].tolist(), frame["kind"].tolist(), frame["cents"].tolist(), strict=True))
            self.held.appendList(packs(new))
            least = min(r[0] for r in new) // 1000 + 1
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(unpacked(self.held.get()))
        ready = [r for r in rows if r[0] // 1000 + 1 <= now]
        later = rows[len(ready) :]
        if ready:
            self.held.clear()
            if later:
                self.held.put(packs(later))
        before = self.state.get()
        state, out, wake = self.settle(key, before, ready, now)
        if state is not None:
            self.state.update(state)
        elif before is not None:
            self.state.clear()
        waits = [w for w in (wake, later[0][0] // 1000 + 1 if later else None) if w is not None]
        # The key's only timer is the one that has just expired, and Spark deletes that.
        if waits:
            self.handle.registerTimer(max(min(waits), now + 1))
        if out:
            # A frame costs by its columns more than by its rows, and each key gives one.
            yield pd.DataFrame({"rows": [p for (p,) in packs([dict(zip(self.output, r, strict=True)) for r in out])]})

    def close(self) -> None:
        pass


class Sequence(Settled):
    """The next number of its run for each row. A row of a kind in ``ends`` is a run's last; later ones are not numbered."""

    value = "last long, over boolean, until long"
    output = ["event_id", "user_id", "seq"]
    schema = "event_id long, user_id long, seq long"

    def __init__(self, ends: tuple[str, ...] = (), keep_ms: int = 3_600_000):
        self.ends, self.keep = ends, keep_ms

    def settle(self, key, state, rows, now_ms):
        last, over, until = state or (0, False, 0)
        out = []
        for _, row_id, kind, _ in rows:
            if over:
                continue
            last += 1
            out.append((row_id, int(key[0]), last))
            over = kind in self.ends
            until = now_ms + self.keep if over else 0
        if over and now_ms >= until:
            return None, out, None
        # An ended run is remembered for ``keep_ms``, so that a straggler does not begin it anew.
        return (last, over, until), out, until if over else None


class Runs(Settled):
    """A row for each run when it is over: a key's rows with less than ``gap_ms`` between neighbours.

    A run whose last row is of a kind in ``ends`` has completed, another one fell silent and failed; what it had reserved
    and not settled is released.
    """

    value = "started long, last long, n long, kind string, reserved long"
    output = ["user_id", "started", "n", "status", "released"]
    schema = "user_id long, started long, n long, status string, released long"

    def __init__(self, gap_ms: int, ends: tuple[str, ...] = ("purchase",), reserve: str = "click"):
        self.gap, self.ends, self.reserve = gap_ms, ends, reserve

    def _row(self, key: tuple, state: tuple) -> tuple:
        started, _, n, kind, reserved = state
        done = kind in self.ends
        return int(key[0]), started, n, "completed" if done else "failed", 0 if done else reserved

    def settle(self, key, state, rows, now_ms):
        out = []
        for at, _, kind, cents in rows:
            if state is not None and at - state[1] >= self.gap * 1000:
                out.append(self._row(key, state))
                state = None
            started, _, n, _, reserved = state or (at, at, 0, kind, 0)
            state = (started, at, n + 1, kind, reserved + (cents if kind == self.reserve else 0))
        if state is None:
            return None, out, None
        over = state[1] // 1000 + self.gap + 1
        if over <= now_ms:
            return None, [*out, self._row(key, state)], None
        return state, out, over


def once(log: DataFrame, watermark: str) -> DataFrame:
    """The log's rows once each: a row that is delivered again is dropped by its id, in a stream within the watermark."""
    return log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if log.isStreaming else log.dropDuplicates(["event_id"])


def prepared(log: DataFrame, watermark: str) -> DataFrame:
    """The log's rows as the processors read them; late ones are dropped by now, so that ``ts`` itself is not needed."""
    cents = F.coalesce(F.round(F.col("value").cast("decimal(20,2)") * 100).cast("long"), F.lit(0))
    return once(log, watermark).select("user_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), cents.alias("cents"))


def processed(log: DataFrame, processor: Settled, watermark: str = "10 minutes") -> DataFrame:
    """A stream of what a processor gives, in append mode. It needs the RocksDB state store (``runs.drain`` sets it)."""
    rows = prepared(log, watermark)
    given = rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=HELD, outputMode="Append", timeMode="EventTime")
    return given.select(F.inline(F.from_json("rows", ArrayType(StructType.fromDDL(processor.schema)), {"mode": "FAILFAST"})))


def with_tail(numbered: DataFrame, log: DataFrame) -> DataFrame:
    """Numbers of all rows: those that the stream has given, and those of rows still before the watermark, counted on."""
    rest = log.select("event_id", "user_id", "ts").join(numbered.select("event_id"), "event_id", "left_anti")
    last = numbered.groupBy("user_id").agg(F.max("seq").alias("last"))
    more = rest.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).join(last, "user_id", "left")
    return numbered.select("event_id", "user_id", "seq").unionByName(more.select("event_id", "user_id", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("seq")))


def coalesced(log: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(user_id, start, deltas): the kinds of a key's rows in a window, in order; as a stream each window once, when it is over."""
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    out = once(log, watermark).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.array_join(F.transform(parts, lambda x: x["event_type"]), "").alias("deltas"))
    return out.select("user_id", F.col("w.start").alias("start"), "deltas")


def followed(log: DataFrame, first: str, then: str, within: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(first_id, then_id): rows of kind ``then`` with the rows of kind ``first`` of the same key up to ``within`` before.

    Both sides have a watermark and the times of a pair are bounded, so a row leaves the state when its hour is over.
    """
    side = lambda kind, name: once(log, watermark).where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    a, b = side(first, "first"), side(then, "then")
    on = (F.col("first_user") == F.col("then_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("first_id", "then_id")
