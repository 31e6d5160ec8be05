"""Windows over event logs and ledgers: rolling and calendar sums, sequences, sessions, limits."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.operators.chains import STRETCH, positions
from brindle.operators.tables import discard, written


def rolling(agg: str, key: str, at: str, interval: str) -> Column:
    """``agg`` over the rows of a key from ``interval`` before a row up to it, both ends included."""
    return F.expr(f"{agg} OVER (PARTITION BY {key} ORDER BY {at} RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")


def month_to_date(agg: str, key: str, at: str) -> Column:
    return F.expr(f"{agg} OVER (PARTITION BY {key}, date_trunc('month', {at}) ORDER BY {at} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def next_month(at: Column) -> Column:
    return F.date_trunc("month", at) + F.expr("INTERVAL 1 MONTH")


def sequence(df: DataFrame, key: str, order: list[str], name: str = "seq") -> DataFrame:
    """A gapless number from 1 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of rows of a key with less than ``gap`` between neighbours."""
    out = df.groupBy(F.session_window(at, gap).alias("_w"), key).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.drop("_w")


def fifo_pairs(df: DataFrame, key: str, order: list[str], start: Column, end: Column, at: str) -> DataFrame:
    """The k-th start of a key with its k-th end: (key, n, started, ended)."""
    number = Window.partitionBy(key).orderBy(*order)
    a = df.where(start).select(key, F.row_number().over(number).alias("n"), F.col(at).alias("started"))
    b = df.where(end).select(key, F.row_number().over(number).alias("n"), F.col(at).alias("ended"))
    return a.join(b, [key, "n"])


#: How often the blocks of a key hand on what they end with before the rest of the key is gone through in order.
ROUNDS = 8


def _turned(t: list[int], lo: int, hi: int, taken: deque[int], limit: int, width: int, out: list[tuple[int, int, int]]) -> None:
    """Goes through the times ``t[lo:hi]`` of a key (in order) with the accepted times in ``taken``, and adds to ``out`` the runs
    of rows turned away: (begin, end, the time from which the next row is let in). A run is one step, however long."""
    i = lo
    while i < hi:
        while taken and t[i] - taken[0] >= width:
            taken.popleft()
        if len(taken) < limit:
            taken.append(t[i])
            i += 1
        else:
            free = taken[0] + width
            end = bisect_left(t, free, i + 1, hi)
            out.append((i, end, free))
            i = end


def _verdicts(us: np.ndarray, turned: list[tuple[int, int, int]]) -> tuple[np.ndarray, pa.Array]:
    """For each time whether it is let in, and the seconds that it waits else."""
    ok, wait = np.ones(len(us), dtype=bool), np.zeros(len(us), dtype=np.int64)
    if turned:
        begin, end, free = np.array(turned, dtype=np.int64).T
        n = end - begin
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        ok[at] = False
        wait[at] = np.maximum(1, np.rint((np.repeat(free, n) - us[at]) / 1_000_000))
    return ok, pa.array(wait, mask=ok)


def _let_in(batches: Iterator[pa.RecordBatch], limit: int, width: int) -> Iterator[tuple[pa.RecordBatch | None, np.ndarray, np.ndarray, pa.Array, list[list[int]]]]:
    """Each batch with the places of its rows, verdicts for all its places, and what the units that end before it or in it
    end with. Rows (_us, _state) are in order; a row with a state is a mark that begins a unit."""
    taken: deque[int] = deque()
    begun = False
    for batch in batches:
        mark = pc.is_valid(batch.column("_state"))
        us, n = batch.column("_us").fill_null(0).to_numpy(), batch.num_rows
        t, at, turned, ended = us.tolist(), np.flatnonzero(mark).tolist(), [], []
        _turned(t, 0, at[0] if at else n, taken, limit, width, turned)
        for place, end in zip(at, [*at[1:], n]):
            if begun:
                ended.append(list(taken))
            taken, begun = deque(batch.column("_state")[place].as_py()), True
            _turned(t, place + 1, end, taken, limit, width, turned)
        yield batch, np.flatnonzero(pc.invert(mark)), *_verdicts(us, turned), ended
    if begun:
        yield None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), pa.array([], pa.int64()), [list(taken)]


def _in_units(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, _unit, pos, _us, ...) and ``marks`` (key, _unit, _state), a unit's mark before its rows, a unit in one part."""
    both = rows.unionByName(marks.withColumn("pos", F.lit(0).cast("long")), allowMissingColumns=True)
    return both.repartition(key, "_unit").sortWithinPartitions(key, "_unit", "pos")


def _block_ends(rows: DataFrame, marks: DataFrame, key: str, limit: int, width: int) -> DataFrame:
    """(key, _block, _state): the accepted times that each unit hands to the block after it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: list[tuple[object, int]] = []
        for batch, _, _, _, ended in _let_in(batches, limit, width):
            if batch is not None:
                mark = pc.is_valid(batch.column("_state"))
                units += zip(batch.column(key).filter(mark).to_pylist(), batch.column("_unit").filter(mark).to_pylist(), strict=True)
            done, units = units[: len(ended)], units[len(ended) :]
            if done:
                yield pa.RecordBatch.from_pydict({key: [k for k, _ in done], "_block": [b + 1 for _, b in done], "_state": ended}, schema=ends)

    out = marks.select(key, F.col("_unit").alias("_block"), "_state").schema
    ends = to_arrow_schema(out)
    return _in_units(rows.select(key, "_unit", "pos", "_us"), marks, key).mapInArrow(scan, out)


def rate_limited(df: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float, stretch: int = STRETCH, rounds: int = ROUNDS) -> DataFrame:
    """``df`` (key, at, tie) with ``accepted`` and ``wait``: a row is turned away if ``limit`` accepted rows lie in the window
    of ``seconds`` before it, and then waits until the first of them leaves it (whole seconds, at least 1).

    Rows turned away are not recorded, so each decision needs those before it: what a row lets in depends on up to
    ``limit`` rows, so no pointer from one row to the next tells it. Keys of at most ``stretch`` rows are dealt once and
    gone through in order. The rows of longer keys are cut into blocks of ``stretch`` rows that
    tasks go through side by side, each from what the block before it handed on (at most ``limit`` times), at first nothing.
    Blocks that are handed something else than they began with are gone through once more, until none is: after a silence
    of a window, or once the same rows are let in from either beginning, nothing changes any more. Keys where more than half
    of a later round's blocks still do (even traffic, always over the limit), or some after ``rounds`` rounds, stream in
    order through one task from the first such block on, where only the window's accepted times are held and a run of rows
    turned away is one step. The result is the same either way.

    A row without a key is under no limit; without a time it gets null. Of rows of one time and tie either may come first.
    """
    width = round(seconds * 1_000_000)
    at_us = F.unix_micros(F.col(at).cast("timestamp")).alias("_us")
    timed = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, tie, at_us)
    named = df.select(key, at, tie, F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("wait"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in named.schema])
    untimed = named.where(F.col(key).isNull() | F.col(at).isNull()).withColumn("accepted", F.when(F.col(key).isNull(), True))
    long = timed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stretch)
    long = written(long.select(key), "long-keys")
    if long.isEmpty():
        return _limited_in_order(timed, key, at, tie, limit, width, out).unionByName(untimed)
    short = _limited_in_order(timed.join(long, key, "left_anti"), key, at, tie, limit, width, out)
    blocks = _limited_in_blocks(timed.join(long, key, "left_semi"), key, at, tie, limit, width, out, stretch, rounds)
    return short.unionByName(blocks).unionByName(untimed)


def _limited_in_order(timed: DataFrame, key: str, at: str, tie: str, limit: int, width: int, out: T.StructType) -> DataFrame:
    """``rate_limited``, each key in one task: its rows stream by."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        taken: deque[int] = deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode("encode")
            begins = np.flatnonzero(np.diff(keys.indices.to_numpy(), prepend=-1)).tolist()
            if last != (keys[0].as_py(),):
                taken.clear()
            last = (keys[len(keys) - 1].as_py(),)
            us, turned = batch.column("_us").to_numpy(), []
            t = us.tolist()
            for lo, hi in zip(begins, [*begins[1:], len(t)]):
                if lo:
                    taken.clear()
                _turned(t, lo, hi, taken, limit, width, turned)
            ok, wait = _verdicts(us, turned)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ok), wait], [*batch.schema.names[:3], "accepted", "wait"])

    return timed.repartition(key).sortWithinPartitions(key, at, tie).mapInArrow(decide, out)


def _limited_in_blocks(timed: DataFrame, key: str, at: str, tie: str, limit: int, width: int, out: T.StructType, stretch: int, rounds: int) -> DataFrame:
    """``rate_limited`` for keys of many rows."""
    block = F.floor((F.col("pos") - 1) / stretch)
    rows = positions(timed, key, [at, tie]).withColumn("_unit", block)
    blocks = written(rows.groupBy(key, F.col("_unit").alias("_block")).agg(F.min("_us").alias("_first")), "blocks")
    before_another = blocks.select(key, (F.col("_block") - 1).alias("_block")).where("_block >= 0")

    def units(states: DataFrame) -> DataFrame:
        return states.select(key, F.col("_block").alias("_unit"), "_state")

    held = blocks.select(key, "_block", F.array().cast("array<bigint>").alias("_state"))
    todo = written(held.join(before_another, [key, "_block"], "left_semi"), "todo")
    open_blocks = None  # of keys that are streamed
    for done in range(rounds):
        if todo.isEmpty():
            break
        own = rows.join(units(todo), [key, "_unit"], "left_semi")
        ends = _block_ends(own, units(todo), key, limit, width).join(blocks, [key, "_block"])
        live = F.filter("_state", lambda t: t > F.col("_first") - width).alias("_state")
        begun = held.withColumnRenamed("_state", "_begun")
        changed = ends.select(key, "_block", live).join(begun, [key, "_block"]).where("_state != _begun").drop("_begun")
        changed = written(changed, "handed")
        held = written(held.join(changed, [key, "_block"], "left_anti").unionByName(changed), "held")
        left = changed.join(before_another, [key, "_block"], "left_semi")
        if done:
            # A row for each key: how many of the blocks gone through are to be gone through again.
            many = todo.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(left.groupBy(key).agg(F.count(F.lit(1)).alias("_left")), key)
            stuck = many.where("2 * _left > _n").select(key)
            kept = written(left.join(stuck, key, "left_semi"), "stuck")
            open_blocks = kept if open_blocks is None else open_blocks.unionByName(kept)
            left = left.join(stuck, key, "left_anti")
        more = written(left, "todo")
        discard(todo, changed)
        todo = more
    todo = todo if open_blocks is None else open_blocks.unionByName(todo)
    if not todo.isEmpty():
        first = todo.groupBy(key).agg(F.min("_block").alias("_from"))
        joined = blocks.join(first, key, "left").select(key, F.col("_block"), F.coalesce(F.least("_block", "_from"), "_block").alias("_to"))
        rows = rows.withColumnRenamed("_unit", "_block").join(joined, [key, "_block"]).drop("_block").withColumnRenamed("_to", "_unit")
        held = held.join(joined.where("_block = _to").select(key, "_block"), [key, "_block"], "left_semi")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, ok, wait, _ in _let_in(batches, limit, width):
            if len(places):
                kept = batch.select([key, at, tie]).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ok[places]), wait.take(pa.array(places))], [*kept.schema.names, "accepted", "wait"])

    return _in_units(rows, units(held), key).mapInArrow(decide, out)


def longest_wait(one: DataFrame, other: DataFrame, row: str) -> DataFrame:
    """(row, wait): the longer wait of two limits (``rate_limited``) that both count a row, so it is let in later, when
    neither bucket is full; null if both let it in. Each limit records what itself lets in."""
    return one.select(row, F.col("wait").alias("_one")).join(other.select(row, F.col("wait").alias("_other")), row).select(row, F.greatest("_one", "_other").alias("wait"))


def longest_gaps(rows: DataFrame, key: str, at: str, tie: str, kind: str, first: str, opens: str) -> DataFrame:
    """(key, before, after): the longest silence in microseconds up to and from a key's first row of kind ``first``.

    A silence that a row of kind ``opens`` begins does not count.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    token = F.min(F.when(F.col(kind) == first, F.col(at))).over(Window.partitionBy(key))
    gap = F.expr(f"timestampdiff(MICROSECOND, _at, {at})")
    out = rows.withColumns({"_at": F.lag(at).over(w), "_kind": F.lag(kind).over(w), "_token": token}).withColumn("_gap", F.when(F.col("_kind") != opens, gap))
    early = F.col("_token").isNull() | (F.col(at) <= F.col("_token"))
    return out.groupBy(key).agg(F.max(F.when(early, F.col("_gap"))).alias("before"), F.max(F.when(~early, F.col("_gap"))).alias("after"))


def span_residuals(spans: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, total, attributed, residual) in microseconds: a key's whole time, what its spans (started, ended) cover, the rest."""
    whole = rows.groupBy(key).agg(F.expr(f"timestampdiff(MICROSECOND, min({at}), max({at}))").alias("total"))
    own = spans.where("ended >= started").groupBy(key).agg(F.sum(F.expr("timestampdiff(MICROSECOND, started, ended)")).alias("attributed"))
    out = whole.join(own, key, "left").withColumn("attributed", F.coalesce("attributed", F.lit(0)))
    return out.withColumn("residual", F.greatest(F.col("total") - F.col("attributed"), F.lit(0)))
