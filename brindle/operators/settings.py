"""Settings of many owners: JSON patches merged into each other, and the values that break a rule.

A document is held as its leaves (path, value), so merging any number of patches is a grouping by path: no order within a
task, no document rebuilt patch by patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.tables import written


#: Levels of a document that one pass opens; only what lies deeper takes another.
LEVELS = 3


def leaves(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` but for ``column``, JSON texts, with a row for each leaf of it: ``path`` (the keys down to it) and ``value`` (its JSON).

    Lists are leaves. Empty objects have none; a text that is no JSON object has none either. Texts are parsed once, and
    the leaves are written: a pass opens ``LEVELS`` levels, in which leaves go along with the objects still to be opened.
    """
    spark, kept = docs.sparkSession, [c for c in docs.columns if c != column]
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    level = docs.select(*kept, F.array().cast("array<string>").alias("path"), F.try_parse_json(column).alias("_v")).where(is_object)
    out = None
    while out is None or not level.isEmpty():
        level = level.withColumn("_open", F.lit(True))
        for _ in range(LEVELS):
            level = level.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("_open"), F.col("_v")).outer()))
            level = level.where(~F.col("_open") | F.col("key").isNotNull())  # an empty object has no leaf
            deeper = F.when(F.col("_open"), F.array_append("path", F.col("key"))).otherwise(F.col("path"))
            level = level.select(*kept, deeper.alias("path"), F.when(F.col("_open"), F.col("value")).otherwise(F.col("_v")).alias("_v"), F.col("_open").alias("_was"))
            level = level.select(*kept, "path", "_v", (F.col("_was") & is_object).alias("_open"))
        value, rest = F.when(~F.col("_open"), F.to_json("_v")), F.when(F.col("_open"), F.to_json("_v"))
        level = written(level.select(*kept, "path", value.alias("value"), rest.alias("_rest")), "leaves")
        found = level.where("value is not null").drop("_rest")
        out = found if out is None else out.unionByName(found)
        level = level.where("_rest is not null").select(*kept, "path", F.parse_json("_rest").alias("_v"))
    return out


def _prefixes(path: Column, last: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), last), lambda n: F.slice(path, F.lit(1), n))


def deep_merged(writes: DataFrame, key: str, version: str) -> DataFrame:
    """(key, path, value): what stands of ``writes`` (key, version, path, value) when patches go into each other by version.

    Objects go into objects; any other value takes the place of what stood there, and an object takes that of a value. So a
    leaf stands unless a later patch wrote at its path, above it or below it. ``version`` may be of any type with an order
    and tells the patches of a key apart. Rows without a key or version are left out.
    """
    writes = writes.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(key, F.col(version).alias("_at"), "path", "value")
    # Only the latest write at a path can stand, so all that follows works on a row for each path of a key.
    latest = written(writes.groupBy(key, "path").agg(F.max("_at").alias("_at")), "latest")
    steps = latest.select(key, "_at", "path", F.explode(_prefixes(F.col("path"), F.size("path"))).alias("step"))
    last = steps.groupBy(key, "step").agg(F.max("_at").alias("_under"), F.max(F.when(F.size("step") == F.size("path"), F.col("_at"))).alias("_own"))
    own = latest.join(last.select(key, F.col("step").alias("path"), "_under"), [key, "path"]).where("_at = _under").drop("_under")
    above = own.where(F.size("path") > 1).select(key, "path", "_at", F.explode(_prefixes(F.col("path"), F.size("path") - 1)).alias("step"))
    gone = above.join(last.where("_own is not null").select(key, "step", "_own"), [key, "step"]).where("_own > _at")
    stands = own.join(gone.select(key, "path").distinct(), [key, "path"], "left_anti")
    return writes.join(stands, [key, "path", "_at"], "left_semi").select(key, "path", "value")


def checked(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """``settings`` (..., path, value) with ``name`` and ``problem``: null, unknown, type or range.

    ``rules`` (name, kind, low, high, choices, optional): kind is number, integer, text or flag; a null bound or choice sets
    none; ``optional`` lets a JSON null pass. A name that ends in ``.*`` is for all settings right below a section that
    have no rule of their own.
    """
    named = settings.withColumn("name", F.array_join("path", "."))
    section = F.concat(F.regexp_replace(F.array_join("path", "."), r"[^.]*$", ""), F.lit("*"))
    fields = F.struct("kind", "low", "high", "choices", "optional")
    own, general = (rules.select(F.col("name").alias(f"_{n}"), fields.alias(n)) for n in ("own", "general"))
    out = named.join(own, F.col("name") == F.col("_own"), "left").join(general, section == F.col("_general"), "left")
    out = out.withColumn("_r", F.coalesce("own", "general"))
    value, kind = F.col("value"), F.col("_r.kind")
    number = value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    text = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), 0)
    right = F.when(kind == "number", number).when(kind == "integer", value.rlike("^-?[0-9]+$")).when(kind == "text", value.startswith('"')).otherwise(value.isin("true", "false"))
    size = F.when(number, value.try_cast("double"))
    within = (F.col("_r.low").isNull() | (size >= F.col("_r.low"))) & (F.col("_r.high").isNull() | (size <= F.col("_r.high")))
    chosen = F.col("_r.choices").isNull() | F.array_contains("_r.choices", text)
    problem = (
        F.when(F.col("_r").isNull(), "unknown")
        .when((value == "null") & F.col("_r.optional"), None)
        .when(~right, "type")
        .when(~F.when(kind.isin("number", "integer"), within).otherwise(chosen), "range")
    )
    return out.withColumn("problem", problem).select(*named.columns, "problem")
