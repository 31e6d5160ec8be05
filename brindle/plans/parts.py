"""Queries for the steps that larger queries are made of, each by itself over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions.stats import dcg_weight, ideal_dcg, spearman
from brindle.operators import aggregates as A
from brindle.operators import retrieval as R
from brindle.operators import text_index as X
from brindle.operators import units as U
from brindle.operators import windows as W
from brindle.plans import retrieval as P
from brindle.plans.language import _SENT
from brindle.plans.registry import query, table
from brindle.plans.texts import _STRIP


@query("F10_call_keys", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k'), '0'), user_id || ':' || seq) AS call FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)")
def f10(spark, sf_dir):
    rows = W.sequence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return rows.select("event_id", A.call_key(F.nullif(F.get_json_object("props", "$.k"), F.lit("0")), F.col("user_id"), F.col("seq")).alias("call"))


_FAMILIES = (("PROMO BRUSHED", "brushed"), ("PROMO", "promo"), ("STANDARD", "standard"))


@query("F11_family_names", "SELECT p_partkey, CASE " + " ".join(f"WHEN p_type LIKE '{p}%' THEN '{n}'" for p, n in _FAMILIES) + " ELSE p_type END AS family FROM part")
def f11(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.family(F.col("p_type"), _FAMILIES).alias("family"))


@query("F15_neighbours", "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT a.conv_id, a.turn, b.turn AS near FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1")
def f15(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return R.neighbours(turns, "conv_id", "turn").select("conv_id", "turn", "near")


@query("J2_pool_chunks", P._HYBRID + " SELECT query_id, id, source, lang, n_chars FROM kept JOIN documents ON doc_id = id")
def j2(spark, sf_dir):
    pool = P._hybrid(spark, sf_dir)[1]
    return pool.select("query_id", "id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars"), "id").select("query_id", "id", "source", "lang", "n_chars")


@query("J6_not_in_pool", P._HYBRID + " SELECT query_id, id, rank FROM lex WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM kept)")
def j6(spark, sf_dir):
    _, pool = P._hybrid(spark, sf_dir)
    lexical = X.search(P.scoped_index(spark, sf_dir), P._questions(spark, sf_dir), R.LEG, k1=1.2, probabilistic=True)
    return lexical.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "rank")


@query("J15_document_collections", "SELECT doc_id, 'u' || (regexp_extract(source, '[0-9]+')::INT % 4) AS owner, CASE WHEN regexp_extract(source, '[0-9]+')::INT % 5 = 0 THEN 'shared' ELSE 'private' END AS visibility FROM documents")
def j15(spark, sf_dir):
    docs = P._docs(spark, sf_dir)
    return docs.select("id", "source").join(P._collections(docs), "source").select(F.col("id").alias("doc_id"), "owner", "visibility")


@query("R1_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r1(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


def _lexical(spark, sf_dir):
    return X.search(P.scoped_index(spark, sf_dir), P._questions(spark, sf_dir), R.LEG, k1=1.2, probabilistic=True)


@query("T2_lexical_top50", f"WITH {P._bm25_sql(P._SCOPE, 50, 1.2, P.PROB_IDF)} SELECT query_id, id, score FROM lex")
def t2(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "id", "score")


@query("W2_lexical_rank", f"WITH {P._bm25_sql(P._SCOPE, 50, 1.2, P.PROB_IDF)} SELECT query_id, id, rank FROM lex")
def w2(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "id", "rank")


@query("T3_fused_top40", P._HYBRID + " SELECT query_id, id, place FROM kept WHERE place <= 40")
def t3(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "id")
    pool = P._hybrid(spark, sf_dir)[1].where(~F.col("rescued"))
    return pool.select("query_id", "id", F.row_number().over(order).alias("place"))


@query("T4_reserve_top8", P._HYBRID + " SELECT query_id, id, spare FROM kept WHERE place > 40")
def t4(spark, sf_dir):
    order = Window.partitionBy("query_id").orderBy("lexical_rank", "id")
    return P._hybrid(spark, sf_dir)[1].where("rescued").select("query_id", "id", F.row_number().over(order).alias("spare"))


@query("T10_audit_top3", f"WITH {P._bm25_sql('documents', 3, 1.5, P.PLAIN_IDF)} SELECT query_id, id, rank FROM lex")
def t10(spark, sf_dir):
    return X.search(P.documents_index(spark, sf_dir), P._questions(spark, sf_dir), 3).select("query_id", "id", "rank")


@query("W1_vector_rank", f"SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {P._COSINE} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 20")
def w1(spark, sf_dir):
    vectors = P._vectors(spark, sf_dir)
    return R.vector_topk(vectors, vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 20).select("query_id", "id", "rank")


@query("W3_list_rank", f"""WITH {P._bm25_sql('documents', 50, 1.5, P.PLAIN_IDF)} SELECT query_id, id, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, score FROM lex) JOIN documents ON doc_id = id""")
def w3(spark, sf_dir):
    lists = X.search(P.documents_index(spark, sf_dir), P._questions(spark, sf_dir), R.LEG).drop("rank").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    order = Window.partitionBy("query_id", "lang").orderBy(F.col("score").desc(), "id")
    return lists.select("query_id", "id", "lang", F.row_number().over(order).alias("rank"))


@query("U6_distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u6(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("X32_month_bounds", "SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS next FROM events")
def x32(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", stamp(F.date_trunc("month", "ts")).alias("start"), stamp(W.next_month(F.col("ts"))).alias("next"))


@query("X42_integer_bars", "SELECT l_partkey, count(*) AS n, ceil(count(*) * 90 / 100.0)::BIGINT AS least, count(*) * 5 // 100 AS most FROM lineitem GROUP BY l_partkey")
def x42(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    least, most = A.bars(F.col("n"))
    return out.select("l_partkey", "n", least.cast("long").alias("least"), most.cast("long").alias("most"))


@query("E9_custom_aggregates", """WITH r AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS ry, l_returnflag = 'R' AS gold FROM lineitem),
g AS (SELECT k, count(*) AS n, round(corr(rx::DOUBLE, ry::DOUBLE), 6) AS rho, round(avg(y) FILTER (WHERE n <= 3), 4) AS mean_top3, count(*) FILTER (WHERE gold) AS n_gold, coalesce(sum(1 / log2(n + 1)) FILTER (WHERE gold AND n <= 10), 0) AS dcg FROM r GROUP BY k)
SELECT k AS l_suppkey, n, rho, mean_top3, round(CASE WHEN n_gold > 0 THEN dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM g""")
def e9(spark, sf_dir):
    """Rank correlation, mean of the three best and nDCG of each group, from functions that pre-aggregate."""
    rows = table(spark, sf_dir, "lineitem")
    rho = spearman(rows, ["l_suppkey"], "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    top = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10")  # limited in each task before the shuffle
    top = top.groupBy("l_suppkey").agg(F.avg(F.when(F.col("rank") <= 3, F.col("l_extendedprice"))).alias("mean_top3"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", dcg_weight(F.col("rank")))), F.lit(0.0)).alias("dcg"))
    gold = rows.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_gold"))
    ndcg = F.when(F.col("n_gold") > 0, F.col("dcg") / ideal_dcg(F.col("n_gold"), 10)).otherwise(F.lit(0.0))
    return rho.join(top, "l_suppkey").join(gold, "l_suppkey").select("l_suppkey", "n", F.round("rho", 6).alias("rho"), F.round("mean_top3", 4).alias("mean_top3"), F.round(ndcg, 6).alias("ndcg"))


_UNIT, _WINDOW, _TAIL = 20, 300, 45
_PARAGRAPHS = rf"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[ \t]*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '')"
_UNITS = rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS par FROM (SELECT doc_id, {_PARAGRAPHS} AS l FROM documents)),
s AS (SELECT doc_id, par, unnest(l) AS s, generate_subscripts(l, 1) AS sent FROM (SELECT doc_id, par, CASE WHEN length(text) <= {4 * _UNIT} THEN [text] ELSE {_SENT} END AS l FROM p)),
w AS (SELECT doc_id, par, sent, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, par, sent, list_filter(string_split_regex(s, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS l FROM s WHERE length(s) > {4 * _UNIT})),
c AS (SELECT doc_id, par, sent, i, w, unnest(range(0, length(w), {4 * _UNIT})) AS o FROM w),
q AS (SELECT doc_id, par, sent, substr(w, o + 1, {4 * _UNIT}) AS t, length(substr(w, o + 1, {4 * _UNIT})) + 1 AS size, row_number() OVER (PARTITION BY doc_id, par, sent ORDER BY i, o) AS k FROM c),
r AS (SELECT doc_id, par, sent, t, k, 0 AS run, size AS used FROM q WHERE k = 1 UNION ALL
SELECT q.doc_id, q.par, q.sent, q.t, q.k, CASE WHEN used + size > {4 * _UNIT + 1} THEN run + 1 ELSE run END, CASE WHEN used + size > {4 * _UNIT + 1} THEN size ELSE used + size END
FROM r JOIN q ON q.doc_id = r.doc_id AND q.par = r.par AND q.sent = r.sent AND q.k = r.k + 1),
a AS (SELECT doc_id, par, sent, 0 AS run, s AS text FROM s WHERE length(s) <= {4 * _UNIT} UNION ALL SELECT doc_id, par, sent, run, string_agg(t, ' ' ORDER BY k) FROM r GROUP BY ALL),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY par, sent, run) AS n, text, ceil(length(text) / 4)::BIGINT AS tokens FROM a),
v AS (SELECT doc_id, n, tokens, 0 AS wdw, tokens AS used FROM u WHERE n = 1 UNION ALL
SELECT u.doc_id, u.n, u.tokens, CASE WHEN used + u.tokens > {_WINDOW} THEN wdw + 1 ELSE wdw END, CASE WHEN used + u.tokens > {_WINDOW} THEN u.tokens ELSE used + u.tokens END FROM v JOIN u ON u.doc_id = v.doc_id AND u.n = v.n + 1)"""


def _units(spark, sf_dir):
    return U.text_units(table(spark, sf_dir, "documents").select("doc_id", "text"), _UNIT)


@query("X5_text_units", f"{_UNITS} SELECT doc_id, n, tokens, md5(text) AS text_md5 FROM u")
def x5(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", "n", "tokens", F.md5("text").alias("text_md5"))


@query("W17_token_windows", f'{_UNITS} SELECT doc_id, n, wdw AS "window" FROM v')
def w17(spark, sf_dir):
    return U.token_windows(_units(spark, sf_dir), _WINDOW).select("doc_id", "n", "window")


@query("W18_tail_overlaps", f"""{_UNITS}, b AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id, wdw ORDER BY n DESC) AS upto, n = min(n) OVER (PARTITION BY doc_id, wdw) AS head FROM v)
SELECT doc_id, wdw AS "window", count(*) FILTER (WHERE upto <= {_TAIL} AND NOT head) AS repeated, coalesce(max(upto) FILTER (WHERE upto <= {_TAIL} AND NOT head), 0)::BIGINT AS tokens FROM b GROUP BY 1, 2""")
def w18(spark, sf_dir):
    return U.tail_overlaps(U.token_windows(_units(spark, sf_dir), _WINDOW), _TAIL).select("doc_id", "window", "repeated", "tokens")
