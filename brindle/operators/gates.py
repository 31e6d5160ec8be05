"""Gates over evaluation runs: regression against a baseline, retries, and acceptance by classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.aggregates import bars

#: The least mean faithfulness and the drop that is allowed; item flips that fail; factors of latency, which
#: only warn; counts whose bar is zero and of which the worst draw counts.
FLOOR, DROP, FLIPS = 0.90, 0.06, 2
OVERHEAD_FACTOR, LATENCY_FACTOR = 1.35, 1.20
ZERO = ("forbidden_hits", "content_misses", "wrong_document", "answers_unscored")
TOTALS = ("should_abstain_total", "answerable_total")
COUNTS = ("should_abstain_correct", "answerable_answered")
#: The class mix of each acceptance set that matters here, by (items, answer, abstain).
LATENCY_BAR_MS, MOST_MISSES = 45_000, 1


def wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(run, one column a metric) from (run, metric, value)."""
    return metrics.groupBy("run").pivot("metric", names).agg(F.max("value"))


def regression_findings(run: Mapping[str, Column], base: Mapping[str, Column]) -> tuple[Column, Column]:
    """(failures, warnings): arrays of rule names that fire for a run against its baseline.

    Both map metric names to columns; a null is a metric that was not measured, never a zero.
    """
    null = F.lit(None).cast("double")
    r = lambda k: run.get(k, null)
    b = lambda k: base.get(k, null)
    fail, warn = [], []
    fire = lambda out, when, name: out.append(F.when(when, F.lit(name)))
    fire(fail, r("failed") > 0, "errored")
    fire(fail, r("faithfulness") < FLOOR, "faithfulness_floor")
    fire(fail, r("faithfulness") < b("faithfulness") - DROP, "faithfulness_drop")
    for key in TOTALS:
        fire(fail, r(key) != b(key), f"{key}_differs")
        fire(warn, r(key).isNull() | b(key).isNull(), f"{key}_unverified")
    for key in COUNTS:
        lost = b(key) - r(key)
        fire(fail, lost >= FLIPS, f"{key}_flips")
        fire(warn, (lost > 0) & (lost < FLIPS), f"{key}_flip")
        fire(warn, lost.isNull(), f"{key}_unverified")
    own, old = r("p50_our_overhead_ms"), b("p50_our_overhead_ms")
    measured = own.isNotNull() & old.isNotNull()
    slow = F.when(measured, (old > 0) & (own > old * OVERHEAD_FACTOR)).otherwise((b("p50_latency_ms") > 0) & (r("p50_latency_ms") > b("p50_latency_ms") * LATENCY_FACTOR))
    fire(warn, slow, "latency_rise")
    for key in ZERO:
        fire(fail, r(key) > 0, key)
    return F.array_compact(F.array(*fail)), F.array_compact(F.array(*warn))


def mean_of_runs(metrics: DataFrame, worst: tuple[str, ...] = ZERO) -> DataFrame:
    """(metric, value) over (run, metric, value): the mean over the runs that recorded it, of some the worst draw."""
    return metrics.where(F.col("value").isNotNull()).groupBy("metric").agg(F.when(F.col("metric").isin(*worst), F.max("value")).otherwise(F.avg("value")).alias("value"))


def comparable_baseline(runs: DataFrame) -> DataFrame:
    """(metric, mean, spread, n, refused) over (run, models, metric, value).

    A baseline is refused if there are under two runs, if they used different models, or if only some have the metric.
    """
    whole = runs.agg(F.count_distinct("run").alias("n_runs"), F.count_distinct("models").alias("n_models"))  # one row
    own = runs.where(F.col("value").isNotNull()).groupBy("metric").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("spread"), F.count_distinct("run").alias("n"))
    why = F.when(F.col("n_runs") < 2, "too few runs").when(F.col("n_models") > 1, "different models").when(F.col("n") < F.col("n_runs"), "missing in some runs")
    return own.join(F.broadcast(whole)).select("metric", "mean", "spread", "n", why.alias("refused"))


def gate_loop(first: Column, mean: Column, blocked: Column) -> tuple[Column, Column]:
    """(verdict, draws): a first run without failures passes; blockers are not drawn again; else the mean of three decides."""
    none = F.size(first) == 0
    return (
        F.when(none, "pass").when(blocked, "blocked").when(F.size(mean) == 0, "pass on the mean").otherwise("fail"),
        F.when(none | blocked, 1).otherwise(3),
    )


def map_differences(a: Column, b: Column) -> Column:
    """Sorted keys of two maps whose values differ, over the union of their keys."""
    both = F.map_zip_with(a, b, lambda k, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, differs: differs)))


def behaviour(expect: Column, status: Column, abstained: Column, declined: Column, n_citations: Column, passed: Column) -> Column:
    """The one class of an evaluated item that an acceptance summary counts."""
    cited = n_citations > 0
    gone = abstained | declined
    return (
        F.when(~F.coalesce(status.startswith("completed"), F.lit(False)), "errored")
        .when((expect == "not_in_sources") & ~gone, "confident_wrong")
        .when((expect == "not_in_sources") & cited, "unclean_decline")
        .when(expect == "not_in_sources", "clean_decline")
        .when((expect == "answer") & gone, "false_abstention")
        .when((expect == "answer") & ~cited, "uncited_answer")
        .when((expect == "answer") & ~passed, "content_miss")
        .otherwise(F.concat(F.lit("plain_"), expect))
    )


def acceptance_failures(c: Mapping[str, Column], expected: Mapping[str, int], deep: bool, declines_gated: bool) -> Column:
    """Names of the clauses that a summary's counts break; a wrong mix of classes hides the rates and stands alone."""
    first = F.array_compact(F.array(F.when(c["errored"] > 0, "errored"), *[F.when(c[k] != n, F.lit(f"mix_{k}")) for k, n in expected.items()]))
    low = bars(c["abstain_items"])[0]
    high = bars(c["answer_items"])[1]
    rates = [F.when(c["confident_wrong"] > 0, "confident_wrong"), F.when(c["content_misses"] > MOST_MISSES, "content_misses")]
    if declines_gated:
        rates.append(F.when(c["clean_declines"] < low, "clean_declines"))
    if deep:
        rates.append(F.when(F.coalesce(c["p50_total_ms"], F.lit(-1)) < 0, "no_latency").when(c["p50_total_ms"] > LATENCY_BAR_MS, "latency"))
    else:
        rates += [F.when(c["false_abstentions"] > high, "false_abstentions"), F.when(c["uncited_answers"] > 0, "uncited_answers")]
    return F.when(F.size(first) > 0, first).otherwise(F.array_compact(F.array(*rates)))


def item_passes(expect: Column, completed: Column, declined: Column, n_citations: Column, cite_hit: Column, mention_hit: Column, language_ok: Column, forbidden: Column) -> tuple[Column, Column]:
    """(passes, reason) of an item; language and forbidden values come before the class."""
    by_class = (
        F.when(expect == "smalltalk", completed & (n_citations == 0))
        .when(expect == "library", completed & mention_hit)
        .when(expect == "answer", completed & (n_citations > 0) & cite_hit & mention_hit)
        .when(expect == "not_in_sources", declined)
        .otherwise(F.lit(False))
    )
    passes = language_ok & forbidden.isNull() & by_class
    reason = (
        F.when(passes, F.lit(None))
        .when(~language_ok, "language_mismatch")
        .when(forbidden.isNotNull(), F.concat(F.lit("forbidden_value:"), forbidden))
        .when((expect == "answer") & (n_citations == 0), "no_citations")
        .otherwise("wrong_class_or_content")
    )
    return passes, reason


def language_differs(expected: Column, got: Column) -> Column:
    """Whether two languages are known and differ; what cannot be told is no mismatch."""
    return F.coalesce(expected != got, F.lit(False))


def clearly_absent(gate_mean: Column, entity_max: Column, entity_measured: Column, entity_ok: Column, gate_most: float = 0.10, entity_most: float = 0.50) -> Column:
    """Whether evidence is so clearly absent that another retrieval cannot help; no reading at all is clearly absent."""
    return ~(entity_measured & entity_ok) & ~F.coalesce(entity_max > entity_most, F.lit(False)) & (gate_mean.isNull() | (gate_mean <= gate_most))


def threshold_proposal(runs: DataFrame, misses: int = 1) -> DataFrame:
    """(floor, line): from (answerable, grade), grades not null.

    The floor is halfway between the lowest answerable grade that is left when ``misses`` are given up and the highest
    decline below it; the line is the lowest tenth over the highest decline. Without a separation both are null.
    """
    low = runs.where("answerable").orderBy("grade").limit(misses + 1)  # misses + 1 rows
    low = low.agg(F.max("grade").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == misses + 1)
    declines = runs.where("not answerable")
    below = declines.join(F.broadcast(low.select("low"))).where("grade < low").agg(F.max("grade").alias("below"))
    top = declines.agg(F.max("grade").alias("top"))
    one = low.select("low").join(F.broadcast(below)).join(F.broadcast(top))  # one row at most
    return one.where("below is not null").select(F.bround((F.col("low") + F.col("below")) / 2, 3).alias("floor"), ((F.floor(F.col("top") * 10 + 1e-9) + 1) / 10).alias("line"))
