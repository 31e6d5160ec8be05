"""Guard and review queries: line items are claims and readings, documents are chunks and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import guards as U
from brindle.plans.registry import query, table
from brindle.plans.texts import _injection_sql, _redact_sql


@query("G11_sanitised_chunks", f"""WITH x AS ({_injection_sql()}), d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 7) / 7 END AS p1, CASE WHEN doc_id % 3 <> 0 THEN 0.1 ELSE 0.9 END AS p2 FROM documents)
SELECT doc_id, coalesce(p1 >= 0.5, false) AS redacted, CASE WHEN coalesce(p1 >= 0.5, false) THEN text_md5 ELSE md5(t) END AS text_md5 FROM d JOIN x USING (doc_id) WHERE NOT coalesce(p1 >= 0.5, false) OR (kept AND text_md5 <> md5(t) AND p2 < 0.5)""")
def g11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("rank"))
    first = docs.where("id % 10 <> 0").select("id", ((F.col("id") % 7) / 7).alias("p"))
    second = docs.select("id", F.when(F.col("id") % 3 != 0, 0.1).otherwise(0.9).alias("p"))
    return U.sanitised(docs, first, second, 0.5).select(F.col("id").alias("doc_id"), "redacted", F.md5("text").alias("text_md5"))


_FOUND = ", ".join(f"CASE WHEN n_{k.lower()} > 0 THEN '{k.lower()}' END" for k, _ in T.REDACTIONS)


@query("G12_guarded_output", f"WITH x AS ({_redact_sql()}) SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text_md5 END AS output_md5, CASE WHEN doc_id % 11 = 0 THEN 'toxicity' ELSE concat_ws(',', {_FOUND}) END AS findings FROM x")
def g12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 11 == 0, 0.9).alias("p"))
    return U.guarded_output(docs, "text", "p", 0.8).select("doc_id", F.md5("output").alias("output_md5"), F.array_join("findings", ",").alias("findings"))


_VERIFIED = """v AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS claim_id, CASE WHEN l_quantity < 5 THEN NULL WHEN l_partkey % 4 = 0 THEN 'unsupported' WHEN l_suppkey % 5 = 0 THEN 'unscored' WHEN l_returnflag = 'R' THEN 'contradicted' ELSE 'supported' END AS verdict,
CASE WHEN l_quantity < 5 THEN NULL WHEN l_partkey % 4 = 0 THEN 0 WHEN l_suppkey % 5 = 0 THEN NULL ELSE 0.45 + l_discount END::DOUBLE AS p FROM lineitem)"""


def _verified(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("claim_id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    claims = lines.select("claim_id", "l_orderkey", F.col("l_linenumber").alias("ord"), (F.col("l_quantity") >= 5).alias("factual"), (F.col("l_partkey") % 4).alias("n_citations"))
    decisions = lines.where("l_suppkey % 5 <> 0").select("claim_id", F.when(F.col("l_returnflag") == "R", "contradicted").otherwise("supported").alias("verdict"), (0.45 + F.col("l_discount")).alias("p"))
    return U.verified(claims, decisions)


@query("G13_verified_claims", f"WITH {_VERIFIED} SELECT l_orderkey, claim_id, verdict, round(p, 9) AS p FROM v")
def g13(spark, sf_dir):
    return _verified(spark, sf_dir).select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("ord")).alias("claim_id"), "verdict", F.round("p", 9).alias("p"))


@query("G14_reviewed_answers", f"""WITH {_VERIFIED}, n AS (SELECT l_orderkey, coalesce(bool_or(verdict = 'contradicted'), false) OR coalesce(min(p) < 0.5, false) AS need FROM v GROUP BY 1)
SELECT l_orderkey, CASE WHEN need THEN 'second' ELSE 'first' END AS verdict_of, CASE WHEN need AND l_orderkey % 6 = 0 THEN 'unscored' ELSE 'scored' END AS state FROM n""")
def g14(spark, sf_dir):
    first = _verified(spark, sf_dir)
    return U.reviewed(first, first.where("l_orderkey % 6 <> 0"), "l_orderkey")


@query("G8_stratified_claims", """WITH c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 0 THEN 'partial' ELSE 'supported' END AS verdict FROM labels WHERE doc_id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY verdict = 'supported', sha256(claim_id || 'review')) AS n FROM c) SELECT claim_id, source, verdict FROM r WHERE n <= 60 OR verdict <> 'supported'""")
def g8(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 0, "partial").otherwise("supported")
    claims = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("source"), verdict.alias("verdict"), (F.col("doc_id") % 5).alias("n_citations"))
    return U.stratified_claims(claims, 120, "review").select("claim_id", "source", "verdict")


_HITS = """h AS (SELECT p_partkey AS item_id, 'c' || l_suppkey % 4 AS corpus, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 30 GROUP BY 1, 2),
i AS (SELECT p_partkey AS item_id, p_size % 3 = 0 AS should_abstain, 'c' || p_size % 4 AS scope, 'c' || (p_size + 1) % 4 AS home FROM part),
s AS (SELECT i.*, coalesce(a.n, 0) AS inside, coalesce(b.n, 0) AS there FROM i LEFT JOIN h a ON a.item_id = i.item_id AND a.corpus = scope LEFT JOIN h b ON b.item_id = i.item_id AND b.corpus = home),
f AS (SELECT item_id, CASE WHEN should_abstain AND inside > 0 THEN 'answer_in_scope' WHEN should_abstain AND there = 0 THEN 'answer_nowhere' WHEN NOT should_abstain AND inside = 0 THEN 'answer_not_in_corpus' END AS code FROM s)"""


def _findings(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 30")
    name = lambda c: F.concat(F.lit("c"), (c % 4).cast("string"))
    hits = lines.groupBy(F.col("l_partkey").alias("item_id"), name(F.col("l_suppkey")).alias("corpus")).agg(F.count(F.lit(1)).alias("n"))
    items = part.select(F.col("p_partkey").alias("item_id"), (F.col("p_size") % 3 == 0).alias("should_abstain"), name(F.col("p_size")).alias("scope"), name(F.col("p_size") + 1).alias("home"))
    return U.label_findings(items, hits)


@query("G6_label_audit", f"WITH {_HITS} SELECT item_id, code FROM f WHERE code IS NOT NULL")
def g6(spark, sf_dir):
    return _findings(spark, sf_dir)


@query("G7_entity_mismatch_audit", f"WITH {_HITS} SELECT item_id, code FROM f WHERE code IN ('answer_in_scope', 'answer_nowhere')")
def g7(spark, sf_dir):
    return _findings(spark, sf_dir).where(F.col("code").isin("answer_in_scope", "answer_nowhere"))


@query("G10_evidence_attempts", """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS attempt, l_discount AS grade, l_tax = 0 AS absent FROM lineitem), l AS (SELECT *, max(attempt) OVER (PARTITION BY l_orderkey) AS last FROM a)
SELECT l_orderkey, min(attempt) AS attempt, arg_min(CASE WHEN grade >= 0.08 THEN 'enough' WHEN absent THEN 'absent' ELSE 'exhausted' END, attempt) AS verdict FROM l WHERE grade >= 0.08 OR absent OR attempt = last GROUP BY 1""")
def g10(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    attempts = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("attempt"), F.col("l_discount").alias("grade"), (F.col("l_tax") == 0).alias("absent"))
    return U.evidence_attempts(attempts, "l_orderkey", 0.08)
