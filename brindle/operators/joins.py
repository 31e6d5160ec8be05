"""Joins beyond a plain equi-join, and table rewrites that stand in for mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: Column, take: list[str]) -> DataFrame:
    """For each key the values of its last row, without a correlated subquery and without sorting a key's rows."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*take), order).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in take])


def fallback_lookup(rows: DataFrame, prices: DataFrame, key: str, other: str, id_col: str, value: str) -> DataFrame:
    """``rows`` with ``value`` looked up by ``key``, else by ``other``, else 0."""
    p = prices.select(F.col(id_col).alias("_k"), F.col(value).alias("_v"))
    q = prices.select(F.col(id_col).alias("_k2"), F.col(value).alias("_v2"))
    out = rows.join(p, F.col(key) == F.col("_k"), "left").join(q, F.col(other) == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v", "_v2", F.lit(0.0))).drop("_k", "_v", "_k2", "_v2")


def pairs_within(rows: DataFrame, key: str, item: str, order: str, most: int = 5) -> DataFrame:
    """(key, a, b): pairs of the first ``most`` rows of each key, the smaller rank first."""
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, item))).where(F.col("_r") <= most)
    a = top.select(key, F.col(item).alias("a"), F.col("_r").alias("_ra"))
    b = top.select(key, F.col(item).alias("b"), F.col("_r").alias("_rb"))
    return a.join(b, key).where("_ra < _rb").select(key, "a", "b")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` (unique by keys) put in or over its own."""
    rest = [c for c in target.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_new"))
    out = target.join(new, keys, "full")
    return out.select(*keys, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def claim_once(attempts: DataFrame, code: str, order: list[str]) -> DataFrame:
    """``attempts`` with ``claimed``: the first attempt of each code wins."""
    first = attempts.groupBy(code).agg(F.min(F.struct(*order)).alias("_first"))
    return attempts.join(first, code).withColumn("claimed", F.struct(*order) == F.col("_first")).drop("_first")


def ready_batch(tasks: DataFrame) -> DataFrame:
    """Tasks (plan, id, depends_on, answered) whose dependencies are all answered while they are not."""
    done = tasks.where("answered").select("plan", F.col("id").alias("_dep"))
    needs = tasks.where(~F.col("answered")).select("plan", "id", F.explode("depends_on").alias("_dep"))
    open_ = needs.join(done, ["plan", "_dep"], "left_anti").select("plan", "id").distinct()
    return tasks.where(~F.col("answered")).select("plan", "id").join(open_, ["plan", "id"], "left_anti")


def chosen(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of hand-picked ids; an id that is not there is an error, raised when the rows are read."""
    wanted = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{key} {rows.schema[key].dataType.simpleString()}")
    out = F.broadcast(wanted).join(rows.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no row of id "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return out.select(*[checked.alias(key) if c == key else F.col(c) for c in rows.columns])


def entity_grid(rows: DataFrame, key: str, item: str, entities: str, most: int) -> DataFrame:
    """(key, question, item, entity): a question for each of a key's first ``most`` items and each of its entities."""
    top = rows.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(item)) - 1).where(F.col("_p") < most)
    out = top.select(key, item, "_p", F.posexplode(entities).alias("_e", "entity"))
    return out.select(key, F.concat_ws("_", F.lit("entity"), "_p", "_e").alias("question"), item, "entity")


def cited_contexts(answers: DataFrame, markers: str, contexts: str) -> DataFrame:
    """``answers`` with ``n`` and ``context``: a row for each marker that names one of the answer's contexts, counted from 1."""
    out = answers.withColumn("n", F.explode(markers)).where((F.col("n") >= 1) & (F.col("n") <= F.size(contexts)))
    return out.withColumn("context", F.element_at(contexts, F.col("n").cast("int")))


def versioned(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Versions of each key with what was there ``before`` and ``after``, and whether they are the ``active`` one, the last."""
    w = Window.partitionBy(key)
    last = F.max(F.struct(*order)).over(w)
    return rows.withColumns({"before": F.lag(value).over(w.orderBy(*order)), "after": F.col(value), "active": F.struct(*order) == last})


def parsed_plan(reply: Column, most: int = 5) -> Column:
    """Tasks (id, depends_on) of a JSON list: at most ``most``, ids unique, dependencies on other tasks of the plan only."""
    raw = F.coalesce(F.from_json(reply, "array<struct<id:string,depends_on:array<string>>>"), F.array().cast("array<struct<id:string,depends_on:array<string>>>"))

    def cut(tasks: Column) -> Column:
        ids = F.transform(tasks, lambda t: t["id"])
        first = F.slice(F.filter(tasks, lambda t, i: t["id"].isNotNull() & (F.array_position(ids, t["id"]) == i + 1)), 1, most)
        kept = F.transform(first, lambda t: t["id"])
        return F.transform(first, lambda t: F.struct(t["id"], F.array_remove(F.array_intersect(F.coalesce(t["depends_on"], F.array().cast("array<string>")), kept), t["id"]).alias("depends_on")))

    return F.element_at(F.transform(F.array(raw), cut), 1)
