"""Retrieval queries: documents are chunks, benchmark items are questions, sources are collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import excerpt, token_count
from brindle.operators import retrieval as R
from brindle.operators import text_index as X
from brindle.plans.registry import query, table

OWNER = "u1"


def documents_index(spark: SparkSession, sf_dir: str) -> X.TextIndex:
    """The lasting index of all documents."""
    return X.kept(_docs(spark, sf_dir), "documents by doc_id")


def scoped_index(spark: SparkSession, sf_dir: str) -> X.TextIndex:
    """The lasting index of what ``OWNER`` may see."""
    return X.kept(_scoped(spark, sf_dir), f"documents in the scope of {OWNER}")


def _collections(docs: DataFrame) -> DataFrame:
    """Sources as collections: four owners in turn, every fifth source shared."""
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return docs.select("source").distinct().select("source", F.concat(F.lit("u"), (n % 4).cast("string")).alias("owner"), F.when(n % 5 == 0, "shared").otherwise("private").alias("visibility"))


_SCOPE = """(SELECT * FROM documents WHERE regexp_extract(source, '[0-9]+')::INT % 4 = 1 OR regexp_extract(source, '[0-9]+')::INT % 5 = 0)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return R.scoped(docs, _collections(docs), OWNER)


_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_FOLDED = "strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss'))"
TOKENS_SQL = rf"""(list_filter(regexp_extract_all(regexp_replace({_FOLDED}, '[{_CJK}]', ' ', 'g'), '\p{{L}}+|\p{{Nd}}+'), lambda t: length(t) > 1 OR regexp_matches(t, '^\p{{Nd}}$'))
 || flatten(list_transform(regexp_extract_all({_FOLDED}, '[{_CJK}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"""


def _bm25_sql(docs: str, k: int, k1: float, idf: str) -> str:
    return f"""
d AS (SELECT doc_id AS id, {TOKENS_SQL} AS t FROM {docs}),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
f AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d),
g AS (SELECT term, id, dl, count(*) AS tf FROM f GROUP BY ALL),
h AS (SELECT term, count(*) AS df FROM g GROUP BY term),
sc AS (SELECT query_id, id, round(sum({idf} * tf * {k1 + 1} / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN g USING (term) JOIN h USING (term), s GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {k})"""


PLAIN_IDF, PROB_IDF = "ln(1 + n_docs / df)", "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"


@query("A41_document_frequency", f"""
WITH d AS (SELECT doc_id, unnest(list_distinct({TOKENS_SQL})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + any_value(n.n) / count(*)), 6) AS idf FROM d, n GROUP BY term""")
def a41(spark, sf_dir):
    return R.document_frequency(documents_index(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("R3_audit_bm25", f"WITH {_bm25_sql('documents', 3, 1.5, PLAIN_IDF)} SELECT query_id, id, score, rank FROM lex")
def r3(spark, sf_dir):
    return X.search(documents_index(spark, sf_dir), _questions(spark, sf_dir), 3)


@query("R2_scoped_bm25_top50", f"WITH {_bm25_sql(_SCOPE, 50, 1.2, PROB_IDF)} SELECT query_id, id, score, rank FROM lex")
def r2(spark, sf_dir):
    return X.search(scoped_index(spark, sf_dir), _questions(spark, sf_dir), R.LEG, k1=1.2, probabilistic=True)


@query("F1_ownership_scope", f"SELECT doc_id AS id, source FROM {_SCOPE}")
def f1(spark, sf_dir):
    return _scoped(spark, sf_dir).select("id", "source")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query("T1_vector_top50", f"""
SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 50""")
def t1(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return R.vector_topk(vectors, asked, R.LEG).withColumn("score", F.round("score", 6))


WEIGHT = 0.35
_HYBRID = f"""WITH {_bm25_sql(_SCOPE, 50, 1.2, PROB_IDF)},
vs AS (SELECT item_id AS query_id, b.vec_id AS id, {_COSINE} AS score FROM (SELECT DISTINCT item_id FROM benchmark) JOIN embeddings a ON a.vec_id = item_id, embeddings b
  WHERE b.vec_id IN (SELECT doc_id FROM {_SCOPE})),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= 50),
fu AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, v.score AS vector_score, v.rank AS vector_rank, l.score AS lexical_score, l.rank AS lexical_rank,
    round(coalesce({1 - WEIGHT}::DOUBLE / (60 + v.rank), 0) + coalesce({WEIGHT}::DOUBLE / (60 + l.rank), 0), 12) AS fused
  FROM vec v FULL JOIN lex l ON v.query_id = l.query_id AND v.id = l.id),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS place FROM fu),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place > 40 AND vector_rank IS NULL THEN lexical_rank END NULLS LAST, id) AS spare FROM pl),
kept AS (SELECT * FROM sp WHERE place <= 40 OR (vector_rank IS NULL AND spare <= 8))"""


def _hybrid(spark, sf_dir):
    docs = _scoped(spark, sf_dir)
    questions = _questions(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    asked = questions.select("query_id").distinct().join(vectors.withColumnRenamed("id", "query_id"), "query_id")
    lexical = X.search(scoped_index(spark, sf_dir), questions, R.LEG, k1=1.2, probabilistic=True)
    nearest = R.vector_topk(vectors.join(docs.select("id"), "id", "left_semi"), asked, R.LEG)
    return docs, R.fuse(nearest, lexical, WEIGHT)


@query("J1_J3_hybrid_retrieval", _HYBRID + """
SELECT query_id, id, source, substr(text, 1, 240) AS excerpt, round(vector_score, 6) AS vector_score, lexical_score, fused, place > 40 AS rescued
FROM kept JOIN documents ON doc_id = id""")
def g2(spark, sf_dir):
    docs, pool = _hybrid(spark, sf_dir)
    wide = docs.select("id", "source", excerpt(F.col("text"), 240).alias("excerpt"))
    return pool.join(wide, "id").select("query_id", "id", "source", "excerpt", F.round("vector_score", 6).alias("vector_score"), "lexical_score", "fused", "rescued")


@query("R4_weighted_rrf", _HYBRID + " SELECT query_id, id, vector_rank, lexical_rank, fused FROM kept WHERE place <= 40")
def r4(spark, sf_dir):
    return _hybrid(spark, sf_dir)[1].where(~F.col("rescued")).select("query_id", "id", "vector_rank", "lexical_rank", "fused")


@query("R5_lexical_reserve", _HYBRID + " SELECT query_id, id, lexical_rank FROM kept WHERE place > 40")
def r5(spark, sf_dir):
    return _hybrid(spark, sf_dir)[1].where("rescued").select("query_id", "id", "lexical_rank")


@query("W16_group_share", f"""WITH {_bm25_sql('documents', 50, 1.5, PLAIN_IDF)},
j AS (SELECT query_id, id, score, lang FROM lex JOIN documents ON doc_id = id),
n AS (SELECT query_id, count(DISTINCT lang) AS g FROM j GROUP BY query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, id) AS n FROM j)
SELECT query_id, id, lang, score FROM r JOIN n USING (query_id) WHERE r.n <= ceil(8 / g)""")
def w16(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    pool = X.search(documents_index(spark, sf_dir), _questions(spark, sf_dir), R.LEG).join(docs, "id")
    return R.group_share(pool, 8, "lang").select("query_id", "id", "lang", "score")


@query("W15_guaranteed_first", f"""WITH {_bm25_sql('documents', 50, 1.5, PLAIN_IDF)},
j AS (SELECT query_id, id, score, lang FROM lex JOIN documents ON doc_id = id),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, id) <= 2 AS lead FROM j)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, score DESC, id) AS position FROM l""")
def w15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    pool = X.search(documents_index(spark, sf_dir), _questions(spark, sf_dir), R.LEG).join(docs, "id")
    return R.guaranteed_first(pool, "lang").select("query_id", "id", "position")


@query("W19_token_budget", f"""WITH {_bm25_sql('documents', 50, 1.5, PLAIN_IDF)},
j AS (SELECT query_id, id, rank, CASE WHEN rank = 1 THEN least(6000, n) ELSE n END AS tokens FROM lex JOIN (SELECT doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS n FROM documents) ON doc_id = id)
SELECT query_id, id, rank, tokens FROM j QUALIFY sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) <= 6000""")
def w19(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("id", token_count(F.col("text")).alias("tokens"))
    pool = X.search(documents_index(spark, sf_dir), _questions(spark, sf_dir), R.LEG).join(docs, "id")
    return R.within_budget(pool, 6000, ["query_id"]).select("query_id", "id", "rank", "tokens")


@query("W21_middle_out", f"""WITH {_bm25_sql('documents', 8, 1.5, PLAIN_IDF)},
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM lex)
SELECT query_id, id, rank, CASE WHEN n < 4 THEN rank WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n - rank // 2 + 1 END::INT AS position FROM n""")
def w21(spark, sf_dir):
    top = X.search(documents_index(spark, sf_dir), _questions(spark, sf_dir), 8)
    n = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return top.join(n, "query_id").select("query_id", "id", "rank", R.middle_out(F.col("rank"), F.col("n")).alias("position"))


_CLEAN = r"lower(trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"
_GOLD = f"gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains({_CLEAN.format('d.text')}, {_CLEAN.format('b.text')}))"


@query("J29_gold_passages", f"WITH {_GOLD} SELECT query_id, id FROM gold")
def j29(spark, sf_dir):
    return R.gold_passages(_docs(spark, sf_dir), _questions(spark, sf_dir))


@query("A24_A25_ranking_metrics", f"""WITH {_bm25_sql('documents', 10, 1.5, PLAIN_IDF)}, {_GOLD},
n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
hh AS (SELECT query_id, max((rank <= 8)::INT) AS hit, sum(1 / log2(rank + 1)) AS dcg FROM lex JOIN gold USING (query_id, id) GROUP BY 1)
SELECT query_id, coalesce(n_gold, 0) AS n_gold, coalesce(hit, 0) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg
FROM (SELECT DISTINCT query_id FROM lex) LEFT JOIN n USING (query_id) LEFT JOIN hh USING (query_id)""")
def a24(spark, sf_dir):
    docs, questions = _docs(spark, sf_dir), _questions(spark, sf_dir)
    out = R.ranking_metrics(X.search(documents_index(spark, sf_dir), questions, 10), R.gold_passages(docs, questions))
    return out.withColumn("ndcg", F.round("ndcg", 6))


@query("R6_multi_query_rrf", f"""WITH {_bm25_sql('documents', 50, 1.5, PLAIN_IDF)},
v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS score FROM embeddings a JOIN (SELECT DISTINCT item_id FROM benchmark) ON item_id = a.vec_id, embeddings b),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 50),
a AS (SELECT query_id, id, 0 AS variant, rank, score FROM lex UNION ALL SELECT query_id, id, 1, rank, score FROM w),
n AS (SELECT query_id, count(DISTINCT variant) AS n FROM a GROUP BY 1)
SELECT query_id, id, round(CASE WHEN any_value(n) = 1 THEN min_by(score, variant) ELSE sum(1.0::DOUBLE / (60 + rank)) END, 9) AS fused FROM a JOIN n USING (query_id) GROUP BY query_id, id""")
def r6(spark, sf_dir):
    questions, vectors = _questions(spark, sf_dir), _vectors(spark, sf_dir)
    asked = questions.select("query_id").distinct().join(vectors.withColumnRenamed("id", "query_id"), "query_id")
    one = X.search(documents_index(spark, sf_dir), questions, R.LEG).withColumn("variant", F.lit(0))
    two = R.vector_topk(vectors, asked, R.LEG).withColumn("variant", F.lit(1))
    return R.multi_query_rrf(one.unionByName(two)).withColumn("fused", F.round("fused", 9))


_TURNS = "(SELECT conv_id, turn::INT AS ord, text, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM conversations)"


@query("R10_small_to_big", f"""
WITH c AS {_TURNS}, s AS (SELECT conv_id, sum(tokens) AS size, string_agg(text, chr(10) || chr(10) ORDER BY ord, text) AS whole FROM c GROUP BY 1),
n AS (SELECT a.conv_id, a.ord, string_agg(b.text, chr(10) || chr(10) ORDER BY b.ord, b.text) AS nearby FROM (SELECT DISTINCT conv_id, ord FROM c) a JOIN c b ON a.conv_id = b.conv_id AND b.ord BETWEEN a.ord - 1 AND a.ord + 1 GROUP BY 1, 2)
SELECT c.conv_id, c.ord, md5(CASE WHEN size <= 1200 THEN whole ELSE nearby END) AS context_md5 FROM c JOIN s USING (conv_id) JOIN n ON n.conv_id = c.conv_id AND n.ord = c.ord""")
def r10(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("ord"), "text", token_count(F.col("text")).alias("tokens"))
    return R.expand(turns, "conv_id").select("conv_id", "ord", F.md5("context").alias("context_md5"))


@query("W13_adjacent_dedupe", """WITH r AS (SELECT conv_id, turn::INT AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC NULLS LAST, turn) AS rank FROM conversations),
o AS (SELECT conv_id, ord, min(rank) AS rank FROM r GROUP BY ALL),
f AS (SELECT *, coalesce(lag(ord) OVER a = ord - 1 AND lag(rank) OVER a < rank, false) AS up, coalesce(lead(ord) OVER a = ord + 1 AND lead(rank) OVER a < rank, false) AS down FROM o WINDOW a AS (PARTITION BY conv_id ORDER BY ord)),
s AS (SELECT *, max(CASE WHEN NOT up THEN ord END) OVER (PARTITION BY conv_id ORDER BY ord) AS l, min(CASE WHEN NOT down THEN ord END) OVER (PARTITION BY conv_id ORDER BY ord DESC) AS r FROM f)
SELECT conv_id, ord FROM s WHERE (ord - l) % 2 = 0 AND (r - ord) % 2 = 0""")
def w13(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("ord"), F.length("text").alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("n").desc_nulls_last(), "ord")
    return R.dedupe_adjacent(turns.withColumn("rank", F.row_number().over(order)), ["conv_id"])
