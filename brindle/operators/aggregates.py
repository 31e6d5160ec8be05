"""Aggregates of evaluations, reviews and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stats import ratio

#: Weight of a partly supported claim, and severities of verdicts from best to worst.
PARTIAL = 0.5
SEVERITY = {"supported": 0, "partial": 1, "unsupported": 2, "contradicted": 3}


def share(condition: Column) -> Column:
    """Part of a group's rows for which a condition holds; null conditions do not count."""
    return ratio(F.count_if(condition).cast("double"), F.count(condition))


def mean_of_top(rows: DataFrame, keys: list[str], value: str, n: int = 3) -> DataFrame:
    """The mean of the best ``n`` values of each key, of those there are; null values do not count."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    best = rows.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= n) & F.col(value).isNotNull())
    return best.groupBy(*keys).agg(F.avg(value).alias("mean_top"))


def review_scores(claims: DataFrame, key: str) -> DataFrame:
    """(key, faithfulness, min_support, citation_precision) from (key, verdict, p, factual, citations).

    Faithfulness is (supported + half of partial) / factual claims, the least p over these, precision the part of
    (claim, citation) pairs whose claim is supported. Without claims or pairs a score is 1.
    """
    factual = F.col("factual")
    pairs = F.when(factual, F.size("citations")).otherwise(0)
    agg = claims.groupBy(key).agg(
        F.count_if(factual).alias("n"),
        F.sum(F.when(factual & (F.col("verdict") == "supported"), 1.0).when(factual & (F.col("verdict") == "partial"), PARTIAL).otherwise(0.0)).alias("good"),
        F.min(F.when(factual, F.col("p"))).alias("least"),
        F.sum(pairs).alias("pairs"),
        F.sum(F.when(F.col("verdict") == "supported", pairs).otherwise(0)).alias("good_pairs"),
    )
    return agg.select(
        key,
        F.when(F.col("n") > 0, F.col("good") / F.col("n")).otherwise(1.0).alias("faithfulness"),
        F.coalesce("least", F.lit(1.0)).alias("min_support"),
        F.when(F.col("pairs") > 0, F.col("good_pairs") / F.col("pairs")).otherwise(1.0).alias("citation_precision"),
    )


def severity(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == v, F.lit(s)) for v, s in SEVERITY.items()])


def citation_verdicts(claims: DataFrame, key: str) -> DataFrame:
    """(key, citation, severity, p): of the claims that cite a source, the worst verdict and the least p."""
    flat = claims.select(key, "verdict", "p", F.explode("citations").alias("citation"))
    return flat.groupBy(key, "citation").agg(F.max(severity(F.col("verdict"))).alias("severity"), F.min("p").alias("p"))


def entity_coverage(grades: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, covered, best) from (key, entity, grade): every entity has a passage at or over the threshold."""
    per = grades.groupBy(key, "entity").agg(F.max("grade").alias("g"))
    return per.groupBy(key).agg(F.bool_and(F.col("g") >= threshold).alias("covered"), F.max("g").alias("best"))


def family(name: Column) -> Column:
    """A numbered name as its family; the first prefix that fits counts."""
    out = F.when(name.startswith("chunk_injection_"), "chunk_injection")
    for prefix in ("claim_", "entity_", "rerank_", "conflict_"):
        out = out.when(name.startswith(prefix), prefix[:-1])
    return out.otherwise(name)


def paired_outcomes(scores: DataFrame, item: str, a: str, b: str, tie: int = 2) -> DataFrame:
    """One row: items that only a or only b has right, and whether that is a tie."""
    out = scores.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("wins"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("losses"))
    return out.withColumn("tie", F.abs(F.col("wins") - F.col("losses")) < tie)


def baseline_of(runs: DataFrame) -> DataFrame:
    """(metric, mean, spread, n) over (run, metric, value), by the runs that have the metric."""
    own = runs.where(F.col("value").isNotNull())
    return own.groupBy("metric").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("spread"), F.count(F.lit(1)).alias("n"))


def bars(n: Column) -> tuple[Column, Column]:
    """Whole-number bars of an acceptance gate: at least nine tenths right (rounded up), at most a twentieth wrong."""
    return F.ceil(n * 90 / 100).cast("long"), F.floor(n * 5 / 100).cast("long")


def top_overlap(pairs: DataFrame, query: str, item: str, a: str, b: str, k: int) -> DataFrame:
    """(query, n): how many of the first ``k`` items by score ``a`` are also among the first ``k`` by score ``b``."""
    rank = lambda c: F.row_number().over(Window.partitionBy(query).orderBy(F.col(c).desc(), item))
    out = pairs.withColumn("_a", rank(a)).withColumn("_b", rank(b))
    return out.groupBy(query).agg(F.count_if((F.col("_a") <= k) & (F.col("_b") <= k)).alias("n"))


def calibration(rows: DataFrame, key: str, grade: str, tie: str, entity: Column, kind: str) -> DataFrame:
    """(key, top, mean_top, entity_max, kinds): the best grade, the mean of the best three, the best entity grade, the kinds seen."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(grade).desc_nulls_last(), tie))
    return rows.withColumn("_n", n).groupBy(key).agg(
        F.max(grade).alias("top"), F.avg(F.when(F.col("_n") <= 3, F.col(grade))).alias("mean_top"), F.max(F.when(entity, F.col(grade))).alias("entity_max"), F.array_sort(F.collect_set(kind)).alias("kinds")
    )


def call_key(call: Column, run: Column, seq: Column) -> Column:
    """The id of a call, or one made of its run and place where it has none or an empty one."""
    return F.coalesce(F.nullif(call, F.lit("")), F.concat_ws(":", run.cast("string"), seq.cast("string")))


def family(kind: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first prefix that a kind begins with, in the given order; else the kind itself."""
    out = F.when(F.lit(False), F.lit(""))
    for prefix, name in names:
        out = out.when(kind.startswith(prefix), name)
    return out.otherwise(kind)
