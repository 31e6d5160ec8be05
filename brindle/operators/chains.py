"""Chains along a key's rows, with no key in one task: positions, running values, reach, and pointer doubling.

Greedy filling and circuit breakers go from one row to the next that matters: where a batch began says where the next
begins, where a circuit opened says when it is tried again. Such a next row follows from the row alone, so it is found
for every row at once; which rows a chain from the first row visits is then told by following pointers of doubled length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.tables import discard, written

#: Rows of a key that one window or one task holds.
STRETCH = 20_000


def positions(df: DataFrame, key: str, order: list[str | Column], name: str = "pos") -> DataFrame:
    """``df`` with a gapless number from 1 within each key, and written once. Rows are dealt by ranges of (key, order), so a
    large key lies in many parts; a part's rows are numbered for themselves and go on from those of the parts before."""
    dealt = written(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part", key).orderBy(*order)
    starts = dealt.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.col(key).alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = dealt.withColumn("_own", F.row_number().over(own))
    out = numbered.join(starts.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    out = written(out.select(*df.columns, (F.col("_start") + F.col("_own")).alias(name)), "positions")
    discard(dealt)
    return out


def running(rows: DataFrame, key: str, value: Column, how: str, name: str, pos: str = "pos", stretch: int = STRETCH) -> DataFrame:
    """``rows`` with the sum or maximum of ``value`` over the rows of a key up to each, or the minimum from each on.

    Worked out within stretches of positions; the stretches' own values are then run over, a row for each stretch.
    """
    agg, back = {"sum": (F.sum, False), "max": (F.max, False), "min_from": (F.min, True)}[how]
    rows = rows.withColumn("_value", value).withColumn("_stretch", F.floor(F.col(pos) / stretch))
    whole = rows.groupBy(key, "_stretch").agg(agg("_value").alias("_whole"))
    side = Window.partitionBy(key).orderBy("_stretch")
    side = side.rowsBetween(1, Window.unboundedFollowing) if back else side.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), agg("_whole").over(side).alias("_beyond"))
    own = Window.partitionBy(key, "_stretch").orderBy(pos)
    own = own.rowsBetween(0, Window.unboundedFollowing) if back else own.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inner", agg("_value").over(own)).join(whole, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")))
    both = F.coalesce("_inner", F.lit(0)) + F.coalesce("_beyond", F.lit(0)) if how == "sum" else (F.greatest if how == "max" else F.least)("_inner", "_beyond")
    return out.withColumn(name, both).drop("_value", "_stretch", "_inner", "_key", "_at", "_beyond")


def last_within(rows: DataFrame, key: str, at: str, width: int, name: str, pos: str = "pos") -> DataFrame:
    """``rows`` with the last position of the key whose ``at`` (a long that rises with the position) is at most ``width`` above.

    Rows stand in the stretch of ``width`` that holds them and in the one before, so a window has two stretches at most.
    """
    step = F.floor(F.col(at) / max(1, width))
    twice = rows.withColumn("_own", step).withColumn("_slot", F.explode(F.array(step, step - 1)))
    reach = Window.partitionBy(key, "_slot").orderBy(at).rangeBetween(0, width)
    return twice.withColumn(name, F.max(pos).over(reach)).where(F.col("_slot") == F.col("_own")).drop("_own", "_slot")


def visited(pointers: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """(key, pos) of the rows that chains of ``pointers`` (key, pos, next) visit from ``firsts`` (key, pos) on.

    In each round the rows found so far find those as far behind them again, and the pointers double; both joins are on a
    row's own place, so no key is gathered. The number of rounds is the logarithm of the longest chain.
    """
    ends = written(pointers.where("next is not null").select(key, "pos", "next"), "pointers")
    found = written(firsts.where("pos is not null").select(key, "pos"), "visited")
    while not ends.isEmpty():
        # Pointers that are longer than the chain so far lead to rows that no shorter one has found.
        more = found.join(ends, [key, "pos"]).select(key, F.col("next").alias("pos"))
        grown = written(found.unionByName(more), "visited")
        behind = ends.select(key, F.col("pos").alias("next"), F.col("next").alias("_far"))
        longer = written(ends.join(behind, [key, "next"]).select(key, "pos", F.col("_far").alias("next")), "pointers")
        discard(found, ends)
        found, ends = grown, longer
    return found


def packed_batches(rows: DataFrame, key: str, order: str, size: str, budget: int, most: int = STRETCH) -> DataFrame:
    """``rows`` (key, order, size) with ``batch`` from 0: rows go into a batch in order as long as they fit the budget.

    A first row beyond the budget is a batch with the empty rows before it; a null size counts as none. Of rows of one
    place in the order either may come first. An empty table gives no rows.

    Keys of at most ``most`` rows are dealt once and gone through in order, with no table between; only the rows of
    longer keys go by pointer doubling. Rows without a key are filled in order like those of one key.
    """
    rows = rows.select(key, order, size)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long = written(counts.where(F.col("_n") > most).select(key), "long-keys")
    if long.isEmpty():
        return _filled_in_order(rows, key, order, size, budget)
    short = _filled_in_order(rows.join(long, key, "left_anti"), key, order, size, budget)
    return short.unionByName(_filled_by_pointers(rows.join(long, key, "left_semi"), key, order, size, budget))


def _filled_in_order(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``packed_batches``, each key in one task: its rows stream by, and only what the open batch holds is kept."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, used = None, 0, 0
        for part in batches:
            if not part.num_rows:
                continue
            keys = part.column(0).dictionary_encode("encode")
            codes = keys.indices.to_numpy()
            begins = np.diff(codes, prepend=codes[0]) != 0
            begins[0] = last is None or last[0] != keys[0].as_py()
            last, out = (keys[len(keys) - 1].as_py(),), []
            for n, begin in zip(part.column("_size").to_pylist(), begins.tolist(), strict=True):
                if begin:
                    batch, used = 0, n
                elif used and used + n > budget:
                    batch, used = batch + 1, n
                else:
                    used += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.int32())], [*part.schema.names[:3], "batch"])

    sized = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField("batch", T.IntegerType())])
    return sized.repartition(key).sortWithinPartitions(key, order).mapInArrow(fill, out)


def _filled_by_pointers(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``packed_batches``, no key in one task: where a batch would end is told for each row, and the chain is followed."""
    at = positions(rows.select(key, order, size).withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))), key, [order])
    summed = running(at, key, F.col("_size"), "sum", "_sum").withColumn("_before", F.col("_sum") - F.col("_size"))
    # The first row whose sum is over the budget is the last one that begins within it.
    summed = last_within(summed, key, "_before", budget, "_last")
    summed = running(summed, key, F.when(F.col("_size") > 0, F.col("pos")), "min_from", "_full")
    summed = written(summed, "sums")
    over = F.greatest("_last", F.col("_full") + 1)
    n = summed.groupBy(key).agg(F.max("pos").alias("_n"), F.max("_sum").alias("_total"))
    pointers = summed.join(n, key).where((F.col("_total") - F.col("_before") > budget) & (over <= F.col("_n"))).select(key, "pos", over.alias("next"))
    starts = visited(pointers, n.select(key, F.lit(1).cast("long").alias("pos")), key).withColumn("_first", F.lit(1))
    out = running(at.join(starts, [key, "pos"], "left"), key, F.coalesce("_first", F.lit(0)), "sum", "_count")
    return out.select(key, order, size, (F.col("_count") - 1).cast("int").alias("batch"))


def circuit_states(df: DataFrame, key: str, at: str, tie: str, failed: Column, threshold: int, cooldown: float) -> DataFrame:
    """``df`` (key, at, tie) with ``state`` before each row: closed, open or half_open.

    ``threshold`` failures in a row open the circuit; after ``cooldown`` seconds one trial decides: a failure opens it
    again, else it closes. Rows that meet an open circuit are not tried. Null keys take no part.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, at, tie, F.coalesce(failed, F.lit(False)).alias("_bad"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    rows = positions(rows, key, [at, tie])
    good = running(rows, key, F.when(~F.col("_bad"), F.col("pos")), "max", "_good")
    full = F.col("pos") - F.coalesce("_good", F.lit(0)) >= threshold  # as many failures since the last success
    ready = running(good, key, F.when(full, F.col("pos")), "min_from", "_opens")
    # The trial after an opening at a row is the first row at least the cooldown later.
    ready = last_within(ready, key, "_us", int(cooldown * 1_000_000) - 1, "_last").withColumn("_trial", F.col("_last") + 1)
    ready = written(ready.select(key, "pos", at, tie, "_bad", "_opens", "_trial"), "circuits")
    # A failed trial opens the circuit again; after a good one it opens where the next failures are enough.
    trial = ready.select(key, F.col("pos").alias("_trial"), F.when(F.col("_bad"), F.col("pos")).otherwise(F.col("_opens")).alias("next"))
    pointers = ready.select(key, "pos", "_trial").join(trial, [key, "_trial"]).select(key, "pos", "next")
    opened = visited(pointers, ready.groupBy(key).agg(F.min("_opens").alias("pos")), key).withColumn("_opened", F.lit(True))
    marked = ready.join(opened, [key, "pos"], "left")
    # Of an opening before a row its place tells the trial too, so both are run along as one.
    now = F.when(F.col("_opened"), F.struct(F.col("pos").alias("p"), F.col("_trial").alias("t")))
    out = running(marked, key, now, "max", "_until")
    since = out.select(key, (F.col("pos") + 1).alias("pos"), F.col("_until.t").alias("_t"))  # what holds before the next row
    out = ready.join(since, [key, "pos"], "left")
    state = F.when(F.col("pos") < F.col("_t"), "open").when(F.col("pos") == F.col("_t"), "half_open").otherwise("closed")
    return out.select(key, at, tie, state.alias("state"))
