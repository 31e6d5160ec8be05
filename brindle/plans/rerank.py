"""Rerank queries: a question's lexical pool is reranked by grades made from labels and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import rerank as K
from brindle.operators import retrieval as R
from brindle.operators import text_index as X
from brindle.plans.registry import query, table
from brindle.plans.retrieval import PLAIN_IDF, PROB_IDF, _bm25_sql, _docs, _questions, documents_index

_LEVELS = list(K.LEVELS)
_P = "map {" + ", ".join(f"'{name}': {p}" for name, p in zip(_LEVELS, ("l_discount", "l_tax", "l_quantity / 100", "CASE WHEN l_linenumber = 2 THEN 0 ELSE l_discount * 2 END"), strict=True)) + "}"


def _grades(spark, sf_dir):
    p = ("l_discount", "l_tax", "l_quantity / 100", "CASE WHEN l_linenumber = 2 THEN 0 ELSE l_discount * 2 END")
    probs = F.create_map(*[x for name, e in zip(_LEVELS, p, strict=True) for x in (F.lit(name), F.expr(e).cast("double"))])
    none = F.col("l_linenumber") == 5
    value = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(~none, probs).alias("p"), F.when(F.col("l_linenumber") != 4, value).alias("v"))


@query("R7_expected_level", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber <> 5 AND a + b + c + d > 0 THEN least(greatest((b / 3 + c * 2 / 3 + d) / (a + b + c + d), 0), 1)
  WHEN l_linenumber = 4 THEN 0 ELSE (l_linenumber % 4) / 3 END, 9) AS score
FROM (SELECT *, l_discount AS a, l_tax AS b, l_quantity / 100 AS c, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_discount * 2 END AS d FROM lineitem)""")
def r7(spark, sf_dir):
    return _grades(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(K.expected_level(F.col("p"), F.col("v")), 9).alias("score"))


@query("R8_fused_order_score", "SELECT conv_id, turn, role, round(1.0::DOUBLE / (1 + turn), 9) AS score FROM conversations")
def r8(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.round(K.fused_order_score(F.col("turn")), 9).alias("score"))


_POOL = f"""{_bm25_sql('documents', 20, 1.5, PLAIN_IDF)},
p AS (SELECT query_id, id, rank - 1 AS position FROM lex),
gr AS (SELECT query_id, id, CASE WHEN id % 3 = 0 THEN 1.0 WHEN id % 3 = 1 THEN 0.5 END::DOUBLE AS score FROM p WHERE query_id % 4 <> 0 AND id % 3 <> 2),
pr AS (SELECT query_id, id, position, CASE WHEN query_id IN (SELECT query_id FROM gr) THEN coalesce(score, 0) ELSE 1.0::DOUBLE / (1 + position) END AS rerank_score FROM p LEFT JOIN gr USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS rank FROM pr)"""


def _reranked(spark, sf_dir, kept):
    pool = X.search(documents_index(spark, sf_dir), _questions(spark, sf_dir), 20).select("query_id", "id", (F.col("rank") - 1).alias("position"))
    grade = F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5)
    scores = pool.where("query_id % 4 <> 0 AND id % 3 <> 2").select("query_id", "id", grade.alias("score"))
    return K.apply_rerank(pool, scores, kept)


@query("R9_rerank_with_outage", f"WITH {_POOL} SELECT query_id, id, round(rerank_score, 9) AS rerank_score, rank FROM r")
def r9(spark, sf_dir):
    return _reranked(spark, sf_dir, 20).select("query_id", "id", F.round("rerank_score", 9).alias("rerank_score"), "rank")


@query("T7_rerank_top8", f"WITH {_POOL} SELECT query_id, id, rank FROM r WHERE rank <= 8")
def t7(spark, sf_dir):
    return _reranked(spark, sf_dir, K.KEPT).select("query_id", "id", "rank")


_SUM = f"""{_bm25_sql("(SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0)", 50, 1.2, PROB_IDF)},
su AS (SELECT query_id, id, round(0.5::DOUBLE / (60 + rank), 12) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5::DOUBLE / (60 + rank), 12) DESC, id) AS n FROM lex)"""


def _summaries(spark, sf_dir):
    """Documents of even ids stand for summaries; there is no vector leg for them here."""
    own = _docs(spark, sf_dir).where("id % 2 = 0")
    lexical = X.search(X.kept(own, "documents of even doc_id"), _questions(spark, sf_dir), R.LEG, k1=1.2, probabilistic=True)
    fused = R.fuse(lexical.where("false"), lexical, 0.5, limit=6, reserve=0)
    return fused.select("query_id", "id", "fused")


@query("R17_T6_summary_search", f"WITH {_SUM} SELECT query_id, id, fused FROM su WHERE n <= 6")
def r17(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query("U2_T5_merged_pool", f"""WITH {_SUM}, m AS (SELECT query_id, 'summary:' || id AS id, fused, 'summary' AS kind FROM su WHERE n <= 6 UNION ALL
SELECT item_id, '' || (item_id * 7 + k), round(1.0::DOUBLE / (100 + k * 3), 12), 'chunk' FROM (SELECT DISTINCT item_id FROM benchmark), range(5) t(k))
SELECT query_id, id, kind, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, kind, id) - 1 AS position FROM m""")
def u2(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id").distinct().select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    chunks = items.select("query_id", (F.col("query_id") * 7 + F.col("k")).alias("id"), F.round(1.0 / (100 + F.col("k") * 3), 12).alias("fused"))
    return K.merged_summaries(chunks, _summaries(spark, sf_dir)).select("query_id", "id", "kind", "position")


@query("R13_summary_ids", "SELECT item_id, 'summary:' || item_id AS id FROM benchmark")
def r13(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", K.summary_id(F.col("item_id")).alias("id"))


@query("R14_summaries_allowed", "SELECT event_id, event_type = 'view' OR user_id % 5 = 0 AS allowed FROM events")
def r14(spark, sf_dir):
    intent = F.when(F.col("event_type") == "view", "summarize").otherwise("question")
    return table(spark, sf_dir, "events").select("event_id", K.summaries_allowed(intent, F.col("user_id") % 5 == 0).alias("allowed"))


@query("J25_scores_onto_events", "SELECT event_id, user_id, score FROM events LEFT JOIN (SELECT vec_id, label::DOUBLE / 10 AS score FROM embeddings WHERE vec_id % 3 = 0) ON vec_id = event_id")
def j25(spark, sf_dir):
    scores = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("event_id"), (F.col("label").cast("double") / 10).alias("score"))
    return table(spark, sf_dir, "events").join(scores, "event_id", "left").select("event_id", "user_id", "score")
