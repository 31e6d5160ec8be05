"""Operator 11: exact top-k inner products through a pivot-distance index.

Vectors become points of one sphere by a further coordinate, sqrt(M^2 - |x|^2) for rows and 0 for queries, where M is
the largest length: the larger an inner product, the smaller the distance. Each row is keyed by its nearest pivot and
the distance to it; rows in the order of these keys are cut into annuli, which are the index. A query first meets the
annulus that holds its own row, which bounds its k-th best score from below; of the other annuli it meets those whose
triangle-inequality bound, |distance to the pivot - radius|, leaves room for a better score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, written

#: Production parameters. Pivots are picked from a sample of ``SAMPLE`` rows; queries meet the index in blocks of
#: ``QUERY_BLOCK``, the bound of what the driver holds and sends.
TOP, PIVOTS, SAMPLE, ANNULUS, QUERY_BLOCK, SCALE = 10, 48, 1024, 2048, 32_768, 1024
#: Below this sum of products a double holds every integer, so that BLAS gives exact scores.
EXACT = 2.0**53


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null where the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def prepared(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(id, vec, asked): one row for each id; of equal vectors the k + 1 smallest ids and all queries.

    The others of a group of equal vectors stand behind k + 1 smaller ids at the same score, so no query needs them;
    Spark limits each group before it shuffles, so a vector that a third of all rows share is no large group.
    """
    rows = vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = rows.withColumn("asked", is_query)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec", "asked").orderBy("id"))).where(F.col("asked") | (F.col("n") <= k + 1))
    return first.select("id", "vec", "asked")


@dataclass
class Pivots:
    """Pivot points (with the further coordinate), the largest length M, and the width of all vectors."""

    points: np.ndarray
    longest: float
    width: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        own = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", self.points, self.points) - 2 * points @ self.points.T
        return np.sqrt(np.maximum(0.0, own))


def matrix(vectors: list, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled up with zeros."""
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pick_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Pivots | None:
    """Far-apart vectors of a fixed sample (smallest hashes of the id); None without rows."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    width, longest = rows.agg(F.max(F.size("vec")), F.max(length)).first()
    if width is None:
        return None
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()
    # A little longer than the longest, so that rounding leaves no negative rest.
    out = Pivots(np.zeros((0, width + 1)), float(longest) * (1 + 1e-9), width)
    points = out.lifted(matrix(taken["vec"].tolist(), width).astype(np.float64))
    chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(pivots, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    out.points = points[chosen]
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; those beyond a long are cut to its range."""
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * max(1, rows.shape[1])
    if most < EXACT:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    whole = queries.astype(object) @ rows.T.astype(object)
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each of n queries so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)  # a query's floor: its k-th best is known to be no lower
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """``scores``: a row for each of the queries ``who``; ``own``: their ids, which are no partners of theirs."""
        fair = ids[None, :] != own[:, None]
        least = self.floor[who]
        if scores.shape[1] > self.k + 1:  # no more than one partner is the query's own
            least = np.maximum(least, np.partition(scores, -(self.k + 1), axis=1)[:, -(self.k + 1)].astype(np.float64))
        at, col = np.nonzero((scores.astype(np.float64) >= least[:, None]) & fair)
        order = np.lexsort((ids[col], -scores[at, col], at))
        at, col = at[order], col[order]
        starts = np.searchsorted(at, np.arange(len(who) + 1))
        for i, q in enumerate(who.tolist()):
            mine = col[starts[i] : starts[i + 1]][: self.k]
            if len(mine):
                both = self.found[q] + list(zip((-scores[i, mine]).tolist(), ids[mine].tolist(), strict=True))
                self.found[q] = sorted(both)[: self.k]
                if len(self.found[q]) == self.k:
                    self.floor[q] = max(self.floor[q], -float(self.found[q][-1][0]))


ANNULI = "pivot int, lo double, hi double, ids binary, rows binary, q_ids binary, q_floors binary, q_rows binary"


def annuli(rows: DataFrame, pivots: Pivots, k: int = TOP, size: int = ANNULUS) -> DataFrame:
    """The index: rows in the order of (pivot, distance), cut into annuli of at most ``size`` rows of one pivot.

    An annulus holds its inner and outer radius, its ids and vectors, and the queries among its rows with the floor that
    the annulus gives them.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = pivots.distances(pivots.lifted(matrix(batch["vec"].tolist(), pivots.width).astype(np.float64)))
                near = d.argmin(axis=1)
                yield batch.assign(pivot=near.astype(np.int32), radius=d[np.arange(len(d)), near])[["pivot", "radius", "id", "vec", "asked"]]

    def row(part: pd.DataFrame) -> dict:
        part = part.sort_values("id")
        ids, x = part["id"].to_numpy(np.int64), matrix(part["vec"].tolist(), pivots.width)
        asked = np.nonzero(part["asked"].to_numpy(bool))[0]
        best = Best(len(asked), k, np.full(len(asked), -np.inf))
        if len(asked):
            best.add(np.arange(len(asked)), products(x[asked], x), ids, ids[asked])
        return {
            "pivot": part["pivot"].iloc[0], "lo": part["radius"].min(), "hi": part["radius"].max(), "ids": ids.tobytes(), "rows": x.tobytes(),
            "q_ids": ids[asked].tobytes(), "q_floors": best.floor.tobytes(), "q_rows": x[asked].tobytes(),
        }

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # less than an annulus, and one batch
        for batch in batches:
            whole = pd.concat([*held, batch], ignore_index=True)
            held, out = [], []
            for _, part in whole.groupby("pivot", sort=False):
                last = part.index[-1] == len(whole) - 1
                for lo in range(0, len(part), size):
                    piece = part.iloc[lo : lo + size]
                    if last and lo + size >= len(part):
                        held = [piece]
                    else:
                        out.append(row(piece))
            if out:
                yield pd.DataFrame(out)
        if held and len(held[0]):
            yield pd.DataFrame([row(held[0])])

    keys = rows.mapInPandas(keyed, "pivot int, radius double, id long, vec array<long>, asked boolean")
    # The id is part of the order, so rows at one distance (or a pivot with most of them) fall to several tasks.
    return keys.repartitionByRange("pivot", "radius", "id").sortWithinPartitions("pivot", "radius", "id").mapInPandas(cut, ANNULI)


def wanted(distance: np.ndarray, lo: float, hi: float, length2: np.ndarray, longest: float, floor: np.ndarray) -> np.ndarray:
    """Which queries an annulus may still serve: those whose bound on its scores is not below their floor."""
    gap = np.maximum(0.0, np.maximum(lo - distance, distance - hi))
    reach = length2 + longest**2
    # The slack covers rounding of distances, which is relative to the squares they come from.
    return (reach - gap**2) / 2 + 1e-7 * reach + 1e-6 >= floor


def met(index: DataFrame, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, pivots: Pivots, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of a block of queries in each task of the index."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = vectors.astype(np.float64)
        length2 = np.einsum("ij,ij->i", x, x)
        distance = pivots.distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
        best = Best(len(ids), k, floors.copy())
        for batch in batches:
            for pivot, lo, hi, own, rows in zip(batch["pivot"], batch["lo"], batch["hi"], batch["ids"], batch["rows"], strict=True):
                who = np.nonzero(wanted(distance[:, pivot], lo, hi, length2, pivots.longest, best.floor))[0]
                there, ring = np.frombuffer(own, dtype=np.int64), np.frombuffer(rows, dtype=np.int64).reshape(-1, pivots.width)
                for at in range(0, len(who), 1024):  # bounds the table of scores
                    some = who[at : at + 1024]
                    best.add(some, products(vectors[some], ring), there, ids[some])
        out = [(int(ids[q]), i, -s) for q, mine in enumerate(best.found) for s, i in mine]
        if out:
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return index.select("pivot", "lo", "hi", "ids", "rows").mapInPandas(search, "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = TOP, pivots: int = PIVOTS, annulus: int = ANNULUS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the largest integer inner product with each query.

    ``vectors``: (id, vec) with vec an array of longs; the queries are its rows for which ``is_query`` (over ``id``)
    holds. All other rows are partners, a query's own is not. Ties go to the smaller id; fewer than k partners are all
    given. Rows with a null id or vector take no part; of rows with one id that with the smallest vector counts.
    Shorter vectors count as filled up with zeros, and scores beyond a long as its end. Other columns are not read. An
    empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(prepared(vectors.select(F.col("id").cast("long").alias("id"), "vec"), is_query, k), "vectors")
    spheres = pick_pivots(rows, pivots)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if spheres is None:
        return none
    if spheres.width == 0:  # empty vectors alone: every score is 0
        spheres = Pivots(np.zeros((1, 2)), 0.0, 1)
    index = written(annuli(rows, spheres, k, annulus), "annuli")
    discard(rows)
    found: DataFrame | None = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        nonlocal found
        ids, floors, x = (np.concatenate(p) for p in zip(*held, strict=True))
        held.clear()
        part = met(index, ids, x, floors, spheres, k)
        found = part if found is None else found.unionByName(part)

    for r in index.where(F.octet_length("q_ids") > 0).select("q_ids", "q_floors", "q_rows").toLocalIterator():
        held.append((np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_floors, np.float64), np.frombuffer(r.q_rows, np.int64).reshape(-1, spheres.width)))
        if sum(len(h[0]) for h in held) >= block:
            flush()
    if held:
        flush()
    if found is None:
        return none
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vec"))
    return exact_topk(vectors, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
