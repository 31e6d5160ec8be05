"""Decisions of guards and controllers: verdicts, choices, agreement with a shadow engine, sampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far two numbers may be apart and still agree; the part of calls that are shadowed; tokens of a state.
LOOSE, SHADOW_RATE, STATE_CHARS_PER_TOKEN = 0.20, 0.02, 4


def guard_verdict(score: Column, warn: Column, block: Column, enabled: Column) -> Column:
    """block, warn or pass; a guard that is off, or has no score, passes."""
    return F.when(~enabled | score.isNull(), "pass").when(score >= block, "block").when(score >= warn, "warn").otherwise("pass")


def picked(value: Column, probability: Column, floor: Column, floors: Mapping[str, float], default: str) -> Column:
    """The chosen option if its probability reaches the floor and the option's own floor, else the default."""
    own = F.lit(0.0)
    for option, least in floors.items():
        own = F.when(value == option, F.lit(least)).otherwise(own)
    return F.when(value.isNotNull() & (probability >= floor) & (probability >= own), value).otherwise(F.lit(default))


def normalised(weights: Column) -> Column:
    """A map of option to weight (none below 0) that sums to 1; without any weight all options are alike."""
    values = F.transform(F.map_values(weights), lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(weights, lambda k, x: F.when(total > 0, F.greatest(x, F.lit(0.0)) / total).otherwise(F.lit(1.0) / F.size(F.map_keys(weights))))


def argmax(options: Column, probabilities: Column) -> Column:
    """The first option of the highest probability (arrays side by side); options without one count 0."""
    scored = F.transform(options, lambda o, i: F.struct(F.coalesce(F.try_element_at(probabilities, o), F.lit(0.0)).alias("p"), (-i).alias("at"), o.alias("option")))
    return F.array_max(scored)["option"]


def loosely_agree(a: Column, b: Column) -> Column:
    """Numbers agree within ``LOOSE``, anything else if it is equal; null where a side is missing."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= LOOSE + 1e-12).otherwise(a == b)


def threshold_of(decisions: DataFrame, thresholds: DataFrame, overrides: DataFrame) -> DataFrame:
    """``decisions`` (engine, name, ...) with ``threshold``: the name's override, else the engine's own, else the name's for any engine.

    ``thresholds``: (engine, name, threshold), engine ``*`` for any; ``overrides``: (name, threshold). Both are small tables.
    """
    own = thresholds.where("engine <> '*'").select("engine", "name", F.col("threshold").alias("_own"))
    any_ = thresholds.where("engine = '*'").select("name", F.col("threshold").alias("_any"))
    set_ = overrides.select("name", F.col("threshold").alias("_set"))
    out = decisions.join(own, ["engine", "name"], "left").join(any_, "name", "left").join(set_, "name", "left")
    return out.withColumn("threshold", F.coalesce("_set", "_own", "_any")).drop("_own", "_any", "_set")


def delivery(stakes: Column, review: Column, citations: Column) -> Column:
    """Whether an answer is held until it is reviewed or streamed."""
    return F.when(review & ((stakes == "high") | (citations == 0)), "hold").otherwise("stream")


def rescaled(fraction: Column, low: Column, high: Column) -> Column:
    return low + F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * (high - low)


def controller(value: Column, probability: Column, threshold: float) -> Column:
    """The controller's verdict; without a sure one more is needed."""
    known = value.isin("enough", "need_more", "give_up")
    return F.when(known & (probability >= threshold), value).otherwise("need_more")


def truncated_state(text: Column, tokens: int) -> Column:
    return F.substring(text, 1, tokens * STATE_CHARS_PER_TOKEN)


def sampled(key: Column, rate: float, salt: str) -> Column:
    """Whether a key falls into a sample of about ``rate``: by its hash, so that a task that runs again decides alike."""
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(salt)), 256), 1, 8), 16, 10).cast("long") < int(rate * 2**32)


def decision_pairs(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """(pair, key, primary, shadow): answers of a shadow call beside those of the call that it shadows.

    ``calls``: (call, pair, shadow), a shadow's ``pair`` naming the other call; ``answers``: (call, key, value).
    """
    shadows = calls.where("shadow").select(F.col("call").alias("_shadow"), "pair")
    a = shadows.join(answers.withColumnRenamed("value", "primary"), F.col("call") == F.col("pair")).select("pair", "_shadow", "key", "primary")
    b = answers.select(F.col("call").alias("_shadow"), "key", F.col("value").alias("shadow"))
    return a.join(b, ["_shadow", "key"]).select("pair", "key", "primary", "shadow")


def credits(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, reference: Column) -> Column:
    """Credits of a call: its price over that of the reference model, which must be over 0."""
    checked = F.when(reference > 0, reference).otherwise(F.raise_error(F.lit("the reference price must be over 0")).cast("double"))
    return (price_in * tokens_in + price_out * tokens_out) / checked


def reference_price(prices: DataFrame, wanted: str, fallback: str = "%haiku%") -> DataFrame:
    """One row, ``price``: that of the wanted id, else of the first id like the fallback, else 1; never 0 or less."""
    exact = F.max(F.when(F.col("id") == wanted, F.col("price")))
    like = F.min_by("price", F.when(F.col("id").ilike(fallback), F.col("id")))
    out = prices.agg(F.coalesce(exact, like, F.lit(1.0)).alias("price"))
    return out.select(F.when(F.col("price") > 0, F.col("price")).otherwise(1.0).alias("price"))
