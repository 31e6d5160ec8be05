"""Guards and reviews: sanitised chunks, guarded output, verified claims, label audits, samples of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import REDACTIONS, injection_kept, redact, redact_injections


def sanitised(chunks: DataFrame, first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """``chunks`` (id, text, rank) that may be used, with ``text`` redacted where it had to be and ``redacted``; ranks stay.

    ``first`` and ``second``: (id, p), how sure a guard is of an injection in a chunk and, after redaction, in what is
    left of it. A chunk under the threshold, or never judged, is used as it is; one at or over it is used redacted if
    enough of it is left and the second reading is under the threshold.
    """
    out = chunks.join(first.withColumnRenamed("p", "_p1"), "id", "left").join(second.withColumnRenamed("p", "_p2"), "id", "left")
    text = F.coalesce("text", F.lit(""))
    cut, _ = redact_injections(text)
    hit = F.coalesce(F.col("_p1") >= threshold, F.lit(False))
    out = out.withColumns({"redacted": hit, "_cut": F.when(hit, cut).otherwise(text)})
    fine = ~F.col("redacted") | (injection_kept(text, F.col("_cut")) & (F.col("_cut") != text) & F.coalesce(F.col("_p2") < threshold, F.lit(False)))
    return out.where(fine).withColumn("text", F.col("_cut")).drop("_p1", "_p2", "_cut")


def guarded_output(replies: DataFrame, text: str, toxicity: str, block: float) -> DataFrame:
    """``replies`` with ``output`` and ``findings``: a toxic reply is blocked whole, any other is redacted, a finding for each kind."""
    out = redact(replies, text, "_redacted")
    toxic = F.coalesce(F.col(toxicity) >= block, F.lit(False))
    kinds = F.array_compact(F.array(*[F.when(F.col(f"n_{k.lower()}") > 0, F.lit(k.lower())) for k, _ in REDACTIONS]))
    out = out.withColumns({"output": F.when(~toxic, F.col("_redacted")), "findings": F.when(toxic, F.array(F.lit("toxicity"))).otherwise(kinds)})
    return out.drop("_redacted", *[f"n_{k.lower()}" for k, _ in REDACTIONS])


def verified(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """``claims`` (claim_id, ord, factual, n_citations) with ``verdict`` and ``p``, in the order of ``ord``.

    What is not factual has no verdict; a factual claim without a citation is unsupported; else the decision counts
    (claim_id, verdict, p), and a claim that none was made for stays unscored.
    """
    out = claims.join(decisions.withColumnsRenamed({"verdict": "_v", "p": "_p"}), "claim_id", "left")
    alone = F.col("factual") & (F.col("n_citations") == 0)
    verdict = F.when(~F.col("factual"), F.lit(None)).when(alone, "unsupported").otherwise(F.coalesce("_v", F.lit("unscored")))
    return out.withColumns({"verdict": verdict, "p": F.when(alone, 0.0).when(F.col("factual"), F.col("_p"))}).drop("_v", "_p")


def needs_revision(verdicts: Column, p: Column) -> Column:
    """Any contradicted claim, or one of less than even odds (an aggregate)."""
    return F.coalesce(F.bool_or(verdicts == "contradicted"), F.lit(False)) | F.coalesce(F.min(p) < 0.5, F.lit(False))


def reviewed(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, verdict_of, state): which draft's review counts after at most one revision.

    Both: (key, verdict, p) of claims. A first draft that needs no revision stands; else the second one counts, and if no
    claims could be read from that, the answer is unscored.
    """
    need = first.groupBy(key).agg(needs_revision(F.col("verdict"), F.col("p")).alias("_need"))
    again = second.select(key).distinct().withColumn("_again", F.lit(True))
    out = need.join(again, key, "left")
    return out.select(key, F.when(~F.col("_need"), "first").otherwise("second").alias("verdict_of"), F.when(F.col("_need") & F.col("_again").isNull(), "unscored").otherwise("scored").alias("state"))


def stratified_claims(claims: DataFrame, total: int, seed: str) -> DataFrame:
    """A sample of cited ``claims`` (claim_id, source, verdict, n_citations) for human review, half of each of two sources.

    All claims that are not supported are taken first, then supported ones by a hash of their id, up to the source's share.
    """
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("verdict") == "supported", F.sha2(F.concat(F.col("claim_id").cast("string"), F.lit(seed)), 256)))
    return claims.where("n_citations > 0").withColumn("_n", rank).where((F.col("_n") <= total // 2) | (F.col("verdict") != "supported")).drop("_n")


def label_findings(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, code): what is wrong with the labels of ``items`` (item_id, should_abstain, scope, home), given ``hits``
    (item_id, corpus, n): in how many passages of a corpus an item's answer stands.

    An item to abstain on must have none in its scope (and some in its home corpus, or nothing tells the two apart); one
    to answer must have some in its scope.
    """
    own = items.join(hits.select("item_id", F.col("corpus").alias("scope"), F.col("n").alias("_in")), ["item_id", "scope"], "left")
    own = own.join(hits.select("item_id", F.col("corpus").alias("home"), F.col("n").alias("_home")), ["item_id", "home"], "left")
    inside, there = F.coalesce("_in", F.lit(0)), F.coalesce("_home", F.lit(0))
    code = F.when(F.col("should_abstain") & (inside > 0), "answer_in_scope").when(F.col("should_abstain") & (there == 0), "answer_nowhere").when(~F.col("should_abstain") & (inside == 0), "answer_not_in_corpus")
    return own.select("item_id", code.alias("code")).where("code is not null")


def evidence_attempts(attempts: DataFrame, key: str, floor: float) -> DataFrame:
    """(key, attempt, verdict) from (key, attempt from 1, grade, absent): the attempt that ends the loop.

    A grade at or over the floor ends it as enough; evidence that is clearly absent ends it without another try; the last
    attempt ends it in any case.
    """
    enough = F.coalesce(F.col("grade") >= floor, F.lit(False))
    last = F.max("attempt").over(Window.partitionBy(key))
    ends = attempts.withColumn("_last", last).where(enough | F.col("absent") | (F.col("attempt") == F.col("_last")))
    verdict = F.when(enough, "enough").when(F.col("absent"), "absent").otherwise("exhausted")
    first = ends.withColumn("verdict", verdict).groupBy(key).agg(F.min(F.struct("attempt", "verdict")).alias("_e"))
    return first.select(key, "_e.attempt", "_e.verdict")
