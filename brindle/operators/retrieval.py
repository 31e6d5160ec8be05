"""Retrieval: scopes, lexical and vector legs, fusion, reserve, and what is done with a ranking.

Every frame carries a query id, so all queries run in one job. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stats import dcg_weight, ideal_dcg
from brindle.operators.tables import shared_dir, written
from brindle.operators.text_index import MOST_WORDS, TextIndex, build, search

#: Constant of the reciprocal ranks, leg size, fused size, reserve.
RRF, LEG, FUSED, RESERVE = 60, 50, 40, 8


def scoped(docs: DataFrame, collections: DataFrame, owner: str, key: str = "source") -> DataFrame:
    """Rows of collections that belong to ``owner`` or are shared."""
    mine = collections.where((F.col("owner") == owner) | (F.col("visibility") == "shared")).select(key)
    return docs.join(mine, key, "left_semi")


def ranked(scores: DataFrame, k: int, by: str = "score", query: str = "query_id", item: str = "id") -> DataFrame:
    """The first ``k`` rows of each query, with ``rank`` from 1."""
    order = Window.partitionBy(query).orderBy(F.col(by).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_frequency(index: TextIndex) -> DataFrame:
    """(term, df, idf): documents with a term, and ln(1 + N / df), as the index holds them."""
    n = index.size[0]
    return index.terms.select("term", "df", F.log(1 + F.lit(n) / F.col("df")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, probabilistic: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` of ``docs`` (id, text) for each query, by an index made for this search."""
    return search(build(docs, shared_dir(docs.sparkSession, "text-index")), queries, k, k1, b, probabilistic, most_words)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the nearest ``k`` vectors of each query by cosine, exactly.

    ``vectors``: (id, vector); ``queries``: (query_id, vector). Queries go to the tasks in blocks of ``block`` rows, the
    bound of what is sent; each task keeps its best ``k`` of each query. A vector of length 0, a null, and one of another
    width than the block's widest query have score 0.
    """
    spark = vectors.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // block))
    out = None
    for n in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        rows = part.select(F.col("query_id").cast("long"), "vector").orderBy("query_id").toArrow()
        ids = rows.column(0).to_pylist()
        width = max((len(v) for v in rows.column(1).to_pylist() if v is not None), default=1)
        score = _cosines(_unit(rows.column(1).to_pylist(), width), width)
        found = vectors.select(F.col("id").cast("long"), "vector").mapInArrow(_best(ids, score, k), "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out if out is not None else spark.createDataFrame([], "query_id long, id long, score double"), k)


def _unit(vectors: list, width: int) -> np.ndarray:
    m = np.array([v if v is not None and len(v) == width and None not in v else [0.0] * width for v in vectors], dtype=np.float64).reshape(len(vectors), width)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _cosines(queries: np.ndarray, width: int, step: int = 512):
    def scores(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, batch.num_rows, step):
            yield ids[lo : lo + step], np.round(queries @ _unit(batch.column(1).slice(lo, step).to_pylist(), width).T, 9)

    return scores


def _best(query_ids: list[int], scores, k: int, positive: bool = False):
    """A task's best ``k`` rows of each query, ties by id; ``scores`` gives (ids, queries x ids) in slices of a batch.

    Of a slice only rows that can still enter some query's best are merged. With ``positive``, a score of 0 is no hit.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not query_ids:
            return
        low = 0.0 if positive else -np.inf
        ids, best = np.full((len(query_ids), k), np.iinfo(np.int64).max), np.full((len(query_ids), k), -np.inf)
        for batch in batches:
            for own, near in scores(batch):
                entering = (near >= best[:, -1:]) & ((near > 0) | (not positive))
                most = int(entering.sum(axis=1).max(initial=0))
                if not most:
                    continue
                near = np.where(entering, near, -np.inf)
                at = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
                more, new = np.take_along_axis(near, at, 1), own[at]
                new = np.where(more > -np.inf, new, np.iinfo(np.int64).max)
                ids, best = np.concatenate([ids, new], axis=1), np.concatenate([best, more], axis=1)
                order = np.lexsort((ids, -best), axis=1)[:, :k]
                ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        kept = best > low if positive else best > -np.inf
        flat = np.repeat(np.array(query_ids, dtype=np.int64), kept.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids[kept]), pa.array(best[kept])], names=["query_id", "id", "score"])

    return search


def fuse(vector_leg: DataFrame, lexical_leg: DataFrame, weight: float, limit: int = FUSED, reserve: int = RESERVE) -> DataFrame:
    """Weighted reciprocal rank fusion of two legs (query_id, id, score, rank), with a lexical reserve.

    (1 - weight) / (60 + vector rank) + weight / (60 + lexical rank), a missing side counting 0. The first ``limit`` of
    a query are kept; to these come up to ``reserve`` rows that only the lexical leg has, by their rank there.
    """
    v = vector_leg.select("query_id", "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    x = lexical_leg.select("query_id", "id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF + F.col(r)), F.lit(0.0))
    both = v.join(x, ["query_id", "id"], "full").withColumn("fused", F.round(part(1 - weight, "vector_rank") + part(weight, "lexical_rank"), 12))
    at = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "id")
    rest = F.when((F.col("place") > limit) & F.col("vector_rank").isNull(), F.col("lexical_rank"))
    both = both.withColumn("place", F.row_number().over(at)).withColumn("_rest", rest)
    spare = Window.partitionBy("query_id").orderBy(F.col("_rest").asc_nulls_last(), "id")
    both = both.withColumn("_spare", F.row_number().over(spare))
    kept = (F.col("place") <= limit) | (F.col("_rest").isNotNull() & (F.col("_spare") <= reserve))
    return both.where(kept).withColumn("rescued", F.col("place") > limit).drop("_rest", "_spare", "place")


def multi_query_rrf(lists: DataFrame) -> DataFrame:
    """(query_id, id, fused) from (query_id, variant, id, rank, score): sum of 1 / (60 + rank) over the variants.

    A query with a single list keeps that list's scores. The lists are dealt anew by query and row: a union of
    frames that are each dealt by query passes for dealt, while adaptive execution may have merged their parts in different
    ways, and groups would come apart.
    """
    lists = lists.repartition("query_id", "id")
    n = lists.groupBy("query_id").agg(F.count_distinct("variant").alias("n"))
    summed = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.min_by("score", "variant").alias("first_score"))
    return summed.join(n, "query_id").select("query_id", "id", F.when(F.col("n") == 1, F.col("first_score")).otherwise(F.col("rrf")).alias("fused"))


def group_share(rows: DataFrame, limit: int, group: str, query: str = "query_id", by: str = "score", item: str = "id") -> DataFrame:
    """At most ceil(limit / number of groups) rows of each group of a query, by score."""
    groups = rows.groupBy(query).agg(F.count_distinct(group).alias("_groups"))
    order = Window.partitionBy(query, group).orderBy(F.col(by).desc(), F.col(item))
    return rows.withColumn("_n", F.row_number().over(order)).join(groups, query).where(F.col("_n") <= F.ceil(F.lit(limit) / F.col("_groups"))).drop("_n", "_groups")


def guaranteed_first(rows: DataFrame, group: str, first: int = 2, query: str = "query_id", by: str = "score", item: str = "id") -> DataFrame:
    """Rows with ``position``: the best ``first`` of each group lead, then the rest, each part by score."""
    own = Window.partitionBy(query, group).orderBy(F.col(by).desc(), F.col(item))
    lead = rows.withColumn("_lead", F.row_number().over(own) <= first)
    order = Window.partitionBy(query).orderBy(F.col("_lead").desc(), F.col(by).desc(), F.col(item))
    return lead.withColumn("position", F.row_number().over(order)).drop("_lead")


def dedupe_adjacent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ord) without those next to a better one that is itself kept.

    Going from a chunk to better and better neighbours, the last one is kept and the ones before it go and stay in turn.
    So a chunk stays if the rising runs of ranks that end at it from the left and from the right both have an even number
    of steps. Of equal places of a section the best counts; ranks are unique in it.
    """
    one = rows.groupBy(*keys, "ord").agg(F.min("rank").alias("rank"))
    out = one
    for name, order, step in (("_left", F.col("ord").asc(), 1), ("_right", F.col("ord").desc(), -1)):
        w = Window.partitionBy(*keys).orderBy(order)
        rises = (F.lag("ord").over(w) == F.col("ord") - step) & (F.lag("rank").over(w) < F.col("rank"))
        out = out.withColumn("_start", F.when(~F.coalesce(rises, F.lit(False)), F.col("ord")))
        steps = F.abs(F.col("ord") - F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn(name, steps)
    return out.where((F.col("_left") % 2 == 0) & (F.col("_right") % 2 == 0)).select(*keys, "ord")


def expand(chunks: DataFrame, section: str, limit: int = 1200) -> DataFrame:
    """(section, ord, context) for (section, ord, text, tokens): small sections whole, else the chunk with its neighbours.

    Only sections of at most ``limit`` tokens are gathered; neighbours are found by an equi-join on the place.
    """
    size = chunks.groupBy(section).agg(F.sum("tokens").alias("_size"))
    small = chunks.join(size.where(F.col("_size") <= limit), section).where("tokens > 0 or text is not null")
    whole = small.groupBy(section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("whole"))
    near = chunks.select(section, F.explode(F.array(*[F.col("ord") + d for d in (-1, 0, 1)])).alias("_at"), F.col("ord").alias("_from"), "text")
    joined = near.groupBy(section, F.col("_at").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_from", "text"))), lambda x: x["text"]), "\n\n").alias("nearby"))
    out = chunks.select(section, "ord").join(whole, section, "left").join(joined, [section, "ord"], "left")
    return out.select(section, "ord", F.coalesce("whole", "nearby").alias("context"))


def neighbours(rows: DataFrame, section: str, ord: str, reach: int = 1) -> DataFrame:
    """(section, ord, near): the places of a section within ``reach`` of each place, itself included, by an equi-join."""
    asked = rows.select(section, ord, F.explode(F.sequence(F.col(ord) - reach, F.col(ord) + reach)).alias("near"))
    return asked.join(rows.select(section, F.col(ord).alias("near")), [section, "near"])


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one width; null where one has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def within_budget(rows: DataFrame, budget: int, keys: list[str], rank: str = "rank", tokens_col: str = "tokens") -> DataFrame:
    """The leading rows of each ranking whose tokens fit the budget together; the first that does not fit ends it.

    A first row over the budget is kept and cut to it: ``tokens_col`` then says how much of it may be used.
    """
    w = Window.partitionBy(*keys).orderBy(rank)
    own = F.when(F.row_number().over(w) == 1, F.least(F.col(tokens_col), F.lit(budget))).otherwise(F.col(tokens_col))
    cut = rows.withColumn(tokens_col, own)
    return cut.withColumn("_sum", F.sum(tokens_col).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_sum")


def middle_out(rank: Column, n: Column) -> Column:
    """Place of a rank (from 1) of n: odd ranks from the front, even ones from the back, so the weakest stand inside. Under four the order stays."""
    odd = rank % 2 == 1
    return F.when(n < 4, rank).when(odd, ((rank + 1) / 2).cast("int")).otherwise((n - rank / 2 + 1).cast("int")).cast("int")


def ranking_metrics(ranking: DataFrame, gold: DataFrame, recall_at: int = 8, ndcg_at: int = 10) -> DataFrame:
    """(query_id, n_gold, recall, ndcg): any gold row in the first ``recall_at``, and binary nDCG; 0 without gold."""
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranking.join(gold, ["query_id", "id"]).groupBy("query_id").agg(
        F.max((F.col("rank") <= recall_at).cast("int")).alias("hit"),
        F.sum(F.when(F.col("rank") <= ndcg_at, dcg_weight(F.col("rank")))).alias("dcg"),
    )
    out = ranking.select("query_id").distinct().join(n, "query_id", "left").join(hits, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
        F.coalesce("hit", F.lit(0)).alias("recall"),
        F.coalesce(F.when(F.col("n_gold") > 0, F.col("dcg") / ideal_dcg(F.col("n_gold"), ndcg_at)), F.lit(0.0)).alias("ndcg"),
    )


#: Quotes too short to be joined by their words that one pass over the documents takes.
MOST_SHORT = 2000


def gold_passages(docs: DataFrame, quotes: DataFrame, most_short: int = MOST_SHORT) -> DataFrame:
    """(query_id, id) where a document contains a quote, blanks collapsed and case ignored.

    The first and last word of a quote may be parts of longer words in a document, those between cannot: of a quote's
    runs of three inner words the rarest is what the two are joined by, and only then are texts compared. Quotes of
    fewer than five words are looked for in every text, in blocks of ``most_short``.
    """
    clean = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")))
    runs = lambda words, n: F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(3)]))
    quote = quotes.select("query_id", clean(F.col("text")).alias("quote")).where(F.length("quote") > 0).distinct().withColumn("w", F.split("quote", " "))
    body = docs.select("id", clean(F.coalesce("text", F.lit(""))).alias("body"))
    inner = quote.where(F.size("w") >= 5).withColumn("w", F.slice("w", 2, F.size("w") - 2))
    keyed = inner.select("query_id", "quote", F.explode(F.array_distinct(runs(F.col("w"), F.size("w") - 3))).alias("key"))
    found = body.withColumn("w", F.split("body", " ")).where(F.size("w") >= 3)
    found = found.select("id", F.explode(F.array_distinct(runs(F.col("w"), F.size("w") - 3))).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
    found = written(found, "quote-keys")
    df = found.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rarest = keyed.join(df, "key").groupBy("query_id", "quote").agg(F.min_by("key", F.struct("df", "key")).alias("key"))
    # A quote none of whose runs occurs has no place; one that lacks some run is ruled out when the texts are compared.
    # Written, so that their size is known: where they are few, the texts are not shuffled, and only theirs are cleaned.
    pairs = written(found.join(rarest, "key").select("query_id", "quote", "id"), "quote-pairs")
    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    out = pairs.join(texts, "id").where(F.contains(clean(F.col("text")), F.col("quote"))).select("query_id", "id")
    short = quote.where(F.size("w") < 5).select("query_id", "quote")
    blocks = -(-short.count() // most_short)
    for n in range(blocks):
        part = short.where(F.pmod(F.xxhash64("query_id", "quote"), F.lit(blocks)) == n).select("query_id", "quote").collect()
        listed = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), F.lit(r.quote).alias("quote")) for r in part])
        hits = body.select("id", F.explode(F.filter(listed, lambda q: F.contains(F.col("body"), q["quote"]))).alias("q"))
        out = out.unionByName(hits.select("q.query_id", "id"))
    return out.distinct()
