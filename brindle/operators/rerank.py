"""Reranking: scores from graded levels, the fallback when the grader is out, and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The levels of the rubric and what each contributes; passages kept.
LEVELS = {
    "off-topic": 0.0,
    "related but does not answer the question": 1 / 3,
    "partly answers the question": 2 / 3,
    "fully answers the question": 1.0,
}
KEPT = 8


def _level(name: Column) -> Column:
    out = F.lit(0.0)
    for level, value in LEVELS.items():
        out = F.when(name == level, F.lit(value)).otherwise(out)
    return out


def expected_level(probabilities: Column, value: Column) -> Column:
    """The expected level of a distribution (map of level to probability), between 0 and 1.

    Without a distribution that sums to more than 0 it is the chosen level's own value, and 0 without either.
    """
    entries = F.map_entries(F.coalesce(probabilities, F.create_map().cast("map<string,double>")))
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"])
    expected = F.aggregate(entries, F.lit(0.0), lambda a, e: a + _level(e["key"]) * e["value"])
    return F.when(total > 0, F.least(F.greatest(expected / total, F.lit(0.0)), F.lit(1.0))).otherwise(F.coalesce(_level(value), F.lit(0.0)))


def fused_order_score(position: Column) -> Column:
    """The score that keeps the order in which candidates came; positions count from 0."""
    return 1.0 / (1 + position)


def apply_rerank(pool: DataFrame, scores: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best ``kept`` candidates of each query with ``rerank_score`` and ``rank``.

    ``pool``: (query_id, id, position from 0); ``scores``: (query_id, id, score). A query that has no score at all, as
    when the grader is out, keeps its order by ``fused_order_score``; a candidate without a score has 0. Ties keep
    the order of the pool.
    """
    any_score = scores.select("query_id").distinct().withColumn("_graded", F.lit(True))
    out = pool.join(scores, ["query_id", "id"], "left").join(any_score, "query_id", "left")
    score = F.when(F.col("_graded"), F.coalesce("score", F.lit(0.0))).otherwise(fused_order_score(F.col("position")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "position")
    out = out.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= kept).drop("score", "_graded")


def merged_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """One pool of chunks and summaries (query_id, id, fused), in the order of ``fused``; ids of summaries get a prefix."""
    both = chunks.select("query_id", F.col("id").cast("string").alias("id"), "fused", F.lit("chunk").alias("kind"))
    both = both.unionByName(summaries.select("query_id", summary_id(F.col("id")).alias("id"), "fused", F.lit("summary").alias("kind")))
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "kind", "id")
    return both.withColumn("position", F.row_number().over(order) - 1)


def summary_id(id_: Column) -> Column:
    """A stable id of a summary as a candidate."""
    return F.concat(F.lit("summary:"), id_.cast("string"))


def summaries_allowed(intent: Column, corrective: Column) -> Column:
    return (intent == "summarize") | F.coalesce(corrective, F.lit(False))
