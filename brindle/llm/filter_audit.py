"""Operator 13: how five document filters interact, over all orders of applying them.

Texts are routed by their xxhash: rows of one hash meet in one place, where a chain of the different texts with this
hash holds each whole text and its smallest id; rows with another id are repeats. Every document is then a mask of the
filters that it fails, and vectors that count masks, one for each part of the corpus, tell what any order removes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The filters by letter; filter i is bit i of a mask.
FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Production parameter: bytes of texts that a task holds to fold repeats before it sends texts on.
HELD_BYTES = 32 << 20
#: Production parameter: bytes of texts that a task on the other side of the routing gets, about.
ROUTED_BYTES = 64 << 20
UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def own_mask(text: str, raw: bytes) -> int:
    """Bits of A to D: what a text fails by itself. ``bytes.split`` cuts at the contract's white space."""
    words = raw.split()
    n = len(words)
    upper = len(raw) - len(raw.translate(None, UPPER))
    signs = len(raw) != len(raw.translate(None, SIGNS))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * upper > 10 * len(text)) << 2 | signs << 3


#: What is known of one text: its bytes (None: its rows are settled), its smallest id, and [id, part, mask, rows].
Entry = tuple[bytes | None, int | None, list[tuple[int | None, str, int, int]]]


def merged(entries: Iterable[Entry]) -> tuple[int | None, dict, dict]:
    """Of entries of one text: the smallest id, the rows that have it, and the rows that repeat it."""
    least, first, repeats = None, {}, {}
    rows = [r for e in entries for r in e[2]]
    for own, _, _, _ in rows:
        least = own if least is None else least if own is None else min(least, own)
    for own, part, mask, n in rows:
        # A row without an id has no smaller one that could be compared, so it repeats nothing.
        to = repeats if own is not None and own > least else first
        to[own, part, mask] = to.get((own, part, mask), 0) + n
    return least, first, repeats


def routed(rows: Iterable[Row]) -> Iterator[tuple[int, Entry]]:
    """(hash, entry) of a task's rows: rows that repeat a text of the same task are settled, the rest is sent on.

    So a text that a third of all rows hold is sent once a task (or once for each ``HELD_BYTES`` of texts), whole.
    """
    held: dict[bytes, list[tuple[int | None, str, int, int]]] = {}
    size = 0

    def flush() -> Iterator[tuple[int, Entry]]:
        for raw, own in held.items():
            least, first, repeats = merged([(raw, None, own)])
            yield xxhash.xxh64_intdigest(raw) - (1 << 63), (raw, least, [(*k, n) for k, n in first.items()])
            for (doc, part, mask), n in repeats.items():
                yield xxhash.xxh64_intdigest(str(doc)) - (1 << 63), (None, None, [(doc, part, mask | REPEAT, n)])
        held.clear()

    for doc, text, part in rows:
        raw = text.encode()
        if raw in held:
            own = held[raw]
            own.append((doc, part, own[0][2], 1))
        else:
            held[raw] = [(doc, part, own_mask(text, raw), 1)]
            size += len(raw)
        size += 64
        if size > HELD_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def settled(entries: Iterable[tuple[int, Entry]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(doc_id, part, mask, rows) from entries in the order of their hashes: one hash's chain is held at a time."""
    chain: dict[bytes, list[Entry]] = {}
    now = None

    def end() -> Iterator[tuple[int | None, str, int, int]]:
        for same in chain.values():
            _, first, repeats = merged(same)
            for (doc, part, mask), n in first.items():
                yield doc, part, mask, n
            for (doc, part, mask), n in repeats.items():
                yield doc, part, mask | REPEAT, n

    for key, entry in entries:
        if key != now:
            yield from end()
            chain, now = {}, key
        if entry[0] is None:
            yield from entry[2]
        else:
            chain.setdefault(entry[0], []).append(entry)  # equal hashes are told apart by the whole text
    yield from end()


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, rows): the filters that each document fails; equal rows may be put together."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED_BYTES))
    found = texts.rdd.mapPartitions(routed).repartitionAndSortWithinPartitions(n, lambda key: key).mapPartitions(settled)
    return spark.createDataFrame(found, "doc_id long, part string, mask int, rows long", verifySchema=False)


def counted(found: DataFrame, labels: DataFrame):
    """RDD of (part, vector): rows, good rows and toxic rows for each mask; vectors merge within tasks first."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = found.join(marks, "doc_id", "left").select("part", "mask", "rows", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        vector[mask] += (n, n * good, n * toxic)
        return vector

    def first(row: tuple[int, int, int, int]) -> np.ndarray:
        return add(np.zeros((1 << len(FILTERS), 3), dtype=np.int64), row)

    return rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(first, add, np.add)


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of one part: every step of every order."""
    codes = np.arange(len(vector))
    orders = list(permutations(range(len(FILTERS))))
    shapley = np.zeros(len(FILTERS), dtype=np.int64)
    rows = []
    for order in orders:
        gone = np.zeros(len(vector), dtype=bool)
        for step, f in enumerate(order, 1):
            fails = (codes >> f & 1).astype(bool)
            here, before = fails & ~gone, fails & gone
            gone |= fails
            n, good, toxic = vector[here].sum(axis=0).tolist()
            shapley[f] += n
            rows.append((order, step, f, int(vector[~gone, 0].sum()), n, int(vector[before, 0].sum()), int(vector[1 << f, 0]), good, toxic))
    for order, step, f, *counts in rows:
        yield (part, "".join(FILTERS[i] for i in order), step, *counts, int(shapley[f]))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter keeps, removes and shares with others.

    A null text is empty and a null ``part`` the empty string. A text is a repeat (filter E) if a smaller doc_id has the
    same text, whatever its part; rows with one doc_id repeat each other in nothing, a null doc_id never is a repeat and
    makes none, and carries no label. Each row counts, also repeated ones. A document is good (toxic) if any of its
    label rows says so; labels without a document count nothing. Other columns are not read. An empty table has no part
    and gives no rows.
    """
    rows = counted(masks(docs, part), labels).flatMap(lambda kv: audited(*kv))
    return docs.sparkSession.createDataFrame(rows, AUDIT, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS f FROM w),
c AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
o(ord) AS (SELECT ''::VARCHAR UNION ALL SELECT ord || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(ord) < 5 AND NOT contains(ord, x)),
s AS (SELECT ord AS filter_order, step::INT AS step, instr('ABCDE', substr(ord, step::INT, 1)) AS own,
    list_transform(range(1, step), lambda i: instr('ABCDE', substr(ord, i::INT, 1))) AS earlier FROM o, range(1, 6) r(step) WHERE length(ord) = 5),
x AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(earlier, lambda e: f[e])) > 0 AS gone, len(list_filter(f, lambda b: b)) = 1 AS alone FROM c, s),
a AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a
"""
