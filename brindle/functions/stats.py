"""Statistics over groups, pre-aggregated so that a group that holds most rows is not sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percentile_cont(column: str, p: float, where: str | None = None) -> Column:
    """The interpolated percentile; null without rows."""
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {column})" + (f" FILTER (WHERE {where})" if where else ""))


def percentile_disc(column: str, p: float) -> Column:
    """The nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def _mean_ranks(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks of distinct values from their counts; ties share the mean of their ranks."""
    own = counts.groupBy(*keys, value).agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("upto", upto).select(*keys, value, (F.col("upto") - (F.col("m") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho) over pairs without nulls; null under three pairs or when one side does not vary.

    Pairs are counted first: windows run over distinct values, not over rows.
    """
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.join(_mean_ranks(counts, keys, x, "rx"), [*keys, x]).join(_mean_ranks(counts, keys, y, "ry"), [*keys, y])
    w = F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(w * e).alias(k) for k, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") ** 2), ("syy", F.col("ry") ** 2), ("sxy", F.col("rx") * F.col("ry")))],
    )
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    rho = F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return sums.select(*keys, "n", rho.alias("rho"))


def dcg_weight(rank: Column) -> Column:
    """The discount of a 1-based rank."""
    return F.lit(1.0) / F.log2(rank + 1)


def ideal_dcg(n: Column, k: int) -> Column:
    """The best sum of discounts with n relevant rows in the first k."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
