"""A lasting inverted index over texts, and block-max pruned BM25 on it.

Documents are numbered within shards of bounded size, in the tasks that read them, so texts are never shuffled. A row of
the index holds one term's postings in one shard, and for each block of 32 documents the largest frequency and the smallest
length in it, which bound the score that the term can give there for any parameters; documents of a shard lie in the
order of their lengths, which keeps these bounds close. Rows lie in folders by a
hash of the term: a search reads the folders of its words only. Each shard is searched by itself: blocks are scored in
the order of the sum of their bounds until no block can beat the k-th best score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokens
from brindle.operators.tables import shared_dir

#: A shard ends at so many documents (whose numbers fit 16 bits) or words; documents of a block; folders of terms. A task
#: holds one shard at a time, so the words bound its memory, whatever the table's size.
SHARD_DOCS, SHARD_WORDS, BLOCK, BUCKETS = 65_536, 1_000_000, 32, 16
#: Stored rows that a search unpacks at once.
UNPACKED = 256
#: Words of queries that one pass over the index takes: the bound of what is sent to the executors.
MOST_WORDS = 20_000
#: Layout of the stored rows; a change makes older indexes unknown.
VERSION = 2

ROWS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), *[(c, pa.binary()) for c in ("docs", "freqs", "blocks", "most", "least", "starts")]])

STORED = "shard long, term string, n long, total long, docs binary, freqs binary, blocks binary, most binary, least binary, starts binary"


def _slices(data: np.ndarray, starts: np.ndarray, kind: str) -> pa.Array:
    """Parts of an array, from each start to the next, as binary values."""
    data = np.ascontiguousarray(data, dtype=kind)
    offsets = np.append(starts, len(data)).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _inverted(shard: int, ids: np.ndarray, sizes: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: that of its documents (without a term: ids and lengths), then one for each term."""
    order = np.argsort(sizes, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(place, sizes)
    ids, sizes = ids[order], sizes[order]
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([int(sizes.sum())]), pa.array([ids.astype("<i8").tobytes()]), pa.array([sizes.astype("<u4").tobytes()]), *[pa.array([b""]) for _ in range(4)]], schema=ROWS
    )
    if not len(words):
        return
    coded = words.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * SHARD_DOCS + owner
    key, freq = np.unique(key, return_counts=True)
    term, doc = key // SHARD_DOCS, key % SHARD_DOCS
    first = np.nonzero(np.diff(term, prepend=-1))[0]
    block = np.nonzero(np.diff(term * SHARD_DOCS + doc // BLOCK, prepend=-1))[0]  # where a term enters a block
    most, least = np.maximum.reduceat(freq, block), np.minimum.reduceat(sizes[doc], block)
    first_block = np.searchsorted(block, first)
    own = block - np.repeat(first, np.diff(np.append(first_block, len(block))))
    n = np.diff(np.append(first, len(key)))
    columns = [
        pa.array(np.full(len(first), shard)), coded.dictionary, pa.array(n), pa.array(np.add.reduceat(freq, first)),
        _slices(doc, first, "<u2"), _slices(freq, first, "<u4"), _slices(doc[block] // BLOCK, first_block, "<u2"), _slices(most, first_block, "<u4"), _slices(least, first_block, "<u4"), _slices(own, first_block, "<u4"),
    ]
    whole = pa.RecordBatch.from_arrays(columns, schema=ROWS)
    for lo in range(0, whole.num_rows, 20_000):
        yield whole.slice(lo, 20_000)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index from (id, words): a task's documents go into shards as they come."""
    number = TaskContext.get().partitionId() << 24
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    words: list[pa.Array] = []
    docs = held = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal number, docs, held
        yield from _inverted(number, np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(words))
        number, docs, held = number + 1, 0, 0
        ids.clear(), sizes.clear(), words.clear()

    for batch in batches:
        own, listed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = np.diff(listed.offsets.to_numpy()).astype(np.int64)
        flat, ends = listed.flatten(), np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(own):
            # As many documents as fit the shard, one at least.
            fit = int(np.searchsorted(ends, ends[lo] + SHARD_WORDS - held, "right")) - 1
            hi = min(len(own), lo + SHARD_DOCS - docs, max(fit, lo + (docs == 0)))
            if hi > lo:
                ids.append(own[lo:hi])
                sizes.append(size[lo:hi])
                words.append(flat.slice(int(ends[lo]), int(ends[hi] - ends[lo])))
                docs, held, lo = docs + hi - lo, held + int(ends[hi] - ends[lo]), hi
            if lo < len(own):
                yield from out()
    if docs:
        yield from out()


@dataclass
class TextIndex:
    """An index in ``path``: ``rows`` by folders of terms, and ``terms`` with their frequencies over all shards."""

    spark: SparkSession
    path: str

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{STORED}, bucket int").parquet(f"{self.path}/rows")

    @cached_property
    def terms(self) -> DataFrame:
        """(term, df, total): documents that have a term, and how often it occurs."""
        return self.spark.read.parquet(f"{self.path}/terms")

    @cached_property
    def size(self) -> tuple[int, float]:
        """The number of documents and their mean length in words."""
        n, total = self.rows.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        return n, total / n if n else 0.0


def _bucket(term: str):
    return F.when(F.col(term).isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def _files(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """Places, sizes and times of files as they are now."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in sorted(files):
        at = jvm.org.apache.hadoop.fs.Path(f)
        s = at.getFileSystem(conf).getFileStatus(at)
        out.append((f, s.getLen(), s.getModificationTime()))
    return out


def _spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt to all cores where its files are too small to be read by all of them."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = sum(n for _, n, _ in _files(spark, docs.inputFiles()))
    few = size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return docs.repartition(cores) if few else docs


def build(docs: DataFrame, path: str) -> TextIndex:
    """Writes an index of ``docs`` (id, text). Rows without an id take no part; each other row is a document.

    Each task writes the rows of its own shards into the folders, so none are shuffled, and no task writes all rows of a
    common word.
    """
    own = _spread(docs.where("id is not null")).select(F.col("id").cast("long").alias("id"), tokens(F.col("text")).alias("t"))
    rows = own.mapInArrow(_shards, STORED).withColumn("bucket", _bucket("term"))
    # Sorted, so that the statistics of a file's parts tell which words they have.
    rows.sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{path}/rows")
    index = TextIndex(docs.sparkSession, path)
    index.rows.where("bucket >= 0").groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total")).write.parquet(f"{path}/terms")
    return index


def kept(docs: DataFrame, name: str) -> TextIndex:
    """The index of ``docs`` (id, text) that is kept under ``spark.checkpoint.dir``; it is written where there is none.

    ``name`` says how ``docs`` is made from its files. An index belongs to the files as they are: another size or time of
    one of them makes another index. A new one is written aside and then renamed, so that an index is whole or absent.
    """
    spark = docs.sparkSession
    key = hashlib.sha256(f"{VERSION} {name} {_files(spark, docs.inputFiles())}".encode()).hexdigest()[:24]
    aside = shared_dir(spark, "index-parts")
    path = f"{aside.rsplit('/', 1)[0]}/text-index-{key}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        build(docs, aside)
        made = jvm.org.apache.hadoop.fs.Path(aside)
        if not fs.exists(at):
            fs.rename(made, at)
        else:  # another job was faster
            fs.delete(made, True)
    return TextIndex(spark, path)


class Shard:
    """A shard's documents and the postings of the words that are asked for, and searches in them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, mean: float, k1: float, b: float):
        self.ids, self.k1 = ids, k1
        self.damp = lambda size: k1 * (1 - b + b * size / mean)
        self.norm = self.damp(sizes.astype(np.float64))
        self.n_blocks = -(-len(ids) // BLOCK)
        self.words: dict[int, tuple] = {}
        self.scores = np.zeros(self.n_blocks * BLOCK)

    def add(self, word: int, idf: float, docs: bytes, freqs: bytes, blocks: bytes, most: bytes, least: bytes, starts: bytes) -> None:
        most = np.frombuffer(most, "<u4").astype(np.float64)
        bound = idf * most * (self.k1 + 1) / (most + self.damp(np.frombuffer(least, "<u4").astype(np.float64)))
        docs = np.frombuffer(docs, "<u2").astype(np.int64)
        self.words[word] = (idf, docs, np.frombuffer(freqs, "<u4"), np.frombuffer(blocks, "<u2").astype(np.int64), bound, np.append(np.frombuffer(starts, "<u4"), len(docs)).astype(np.int64))

    def _score(self, words: list[int], at: np.ndarray) -> np.ndarray:
        """Scores of the documents of some blocks (sorted), a row for each block."""
        table = self.scores.reshape(-1, BLOCK)
        table[at] = 0
        for w in words:
            idf, docs, freqs, blocks, _, starts = self.words[w]
            place = np.searchsorted(blocks, at)
            place = place[(place < len(blocks)) & (blocks[np.minimum(place, len(blocks) - 1)] == at)]
            n = starts[place + 1] - starts[place]
            if n.sum():
                i = np.arange(n.sum()) + np.repeat(starts[place] - np.cumsum(n) + n, n)
                tf = freqs[i].astype(np.float64)
                self.scores[docs[i]] += idf * tf * (self.k1 + 1) / (tf + self.norm[docs[i]])
        return np.round(table[at], 6)

    def search(self, words: list[int], k: int, step: int = 8) -> tuple[list[tuple[float, int]], int, int]:
        """The best ``k`` (-score, id) of a query, ties by id; the blocks scored, and those that hold a word of it."""
        words = [w for w in words if w in self.words]
        bound = np.zeros(self.n_blocks)
        for w in words:
            bound[self.words[w][3]] += self.words[w][4]
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        best: list[tuple[float, int]] = []
        done = 0
        while done < len(order):
            # Scores are rounded to six places, so a bound a little lower may still tie.
            if len(best) == k and bound[order[done]] + 2e-6 < -best[-1][0]:
                break
            at = np.sort(order[done : done + step])
            done += len(at)
            near = self._score(words, at)
            least = -best[-1][0] if len(best) == k else 0.0
            if near.size > k:
                least = max(least, float(np.partition(near, -k, axis=None)[-k]))
            row, col = np.nonzero((near >= least) & (near > 0))
            found = zip((-near[row, col]).tolist(), self.ids[at[row] * BLOCK + col].tolist(), strict=True)
            best = sorted([*best, *found])[:k]
            step = min(step * 2, 256)
        return best, done, len(order)


def _searched(rows: DataFrame, queries: list[tuple[int, list[int]]], words: dict[str, int], idf: list[float], mean: float, k: int, k1: float, b: float, report: bool) -> DataFrame:
    """Runs the queries in every shard; ``report`` gives the blocks scored and held instead of the rows found."""

    def answers(shard: Shard | None) -> pa.RecordBatch:
        out = []
        for q, own in queries if shard else ():
            best, scored, held = shard.search(own, k)
            out += [(q, scored, held)] if report else [(q, i, -s) for s, i in best]
        kinds = [pa.int64(), pa.int64(), pa.int64() if report else pa.float64()]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["query_id", "scored", "held"] if report else ["query_id", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for r in (r for lo in range(0, batch.num_rows, UNPACKED) for r in batch.slice(lo, UNPACKED).to_pylist()):
                if r["shard"] != now:
                    yield answers(shard)
                    now, shard = r["shard"], None
                if r["term"] is None:
                    shard = Shard(np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["freqs"], "<u4"), mean, k1, b)
                else:
                    w = words[r["term"]]
                    shard.add(w, idf[w], *(r[c] for c in ("docs", "freqs", "blocks", "most", "least", "starts")))
        yield answers(shard)

    own = rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return own.mapInArrow(run, "query_id long, scored long, held long" if report else "query_id long, id long, score double")


def search(index: TextIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, probabilistic: bool = False, most_words: int = MOST_WORDS, report: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` documents of each of ``queries`` (query_id, text).

    idf is ln(1 + N / df), or ln(1 + (N - df + 0.5) / (df + 0.5)) if ``probabilistic``. Queries go to the shards in blocks of
    about ``most_words`` words; only rows of these words leave the index. With ``report``: (query_id, scored, held), the
    blocks of documents that were scored and those that hold a word of the query.
    """
    spark = index.spark
    n, mean = index.size
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), tokens(F.col("text")).alias("t"))
    asked = asked.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")).withColumn("n", F.size("t"))
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // most_words))
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        listed = sorted((r.query_id, r.t) for r in part.select("query_id", "t").collect() if r.query_id is not None)
        names = sorted({w for _, t in listed for w in t})
        frame = spark.createDataFrame([(w,) for w in names], "term string").withColumn("bucket", _bucket("term"))
        folders = [r.bucket for r in frame.select("bucket").distinct().collect()]
        df = {r.term: r.df for r in index.terms.join(F.broadcast(frame), "term").select("term", "df").collect()}  # at most a row for each word
        words = {w: i for i, w in enumerate(w for w in names if w in df)}
        idf = [float(np.log(1 + ((n - df[w] + 0.5) / (df[w] + 0.5) if probabilistic else n / df[w]))) for w in words]
        held = index.rows.where(F.col("bucket").isin(folders)).join(F.broadcast(frame.select("term")), "term", "left_semi")
        rows = index.rows.where("bucket = -1").unionByName(held)
        found = _searched(rows, [(q, [words[w] for w in t if w in words]) for q, t in listed], words, idf, mean or 1.0, k, k1, b, report)
        out = found if out is None else out.unionByName(found)
    if report:
        return out.groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("held").alias("held"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
