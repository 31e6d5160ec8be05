"""Operator 2: toxicity from averaged subword-bag embeddings and a linear softmax.

A word is the bag of itself and its character n-grams, each an embedding row found by hashing, so unseen spellings
share rows with known ones. A window of words is the mean of its words, and a linear softmax over that mean gives
the window's odds; a document counts as its most toxic window, so that a few words in a long text are not diluted (the
mean over the whole document, ``window`` beyond its length, marks far more clean documents; README has the figures).
Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_text, read

#: Production parameters. The documented bound of what is fitted: of each class the labelled rows whose hashed id is
#: smallest, at most ``TRAIN_ROWS`` of them and as many as have ``TRAIN_BYTES`` of text together. Each is fitted whole.
TRAIN_ROWS = 3000
TRAIN_BYTES = 6 << 20
BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5)
WINDOW = 3
STEPS = 100
RATE = 1.0
DECAY = 0.02
LEAST_DOCS = 3
CACHE_WORDS = 500_000

#: Bytes that separate words: all ASCII but letters and digits; capitals become small.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def subwords(vocab: list[bytes], buckets: int = BUCKETS, step: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words' bags, one after the other, and where each word's bag begins; worked out for ``step`` words at a time."""
    parts = [_subwords(vocab[lo : lo + step], buckets) for lo in range(0, max(1, len(vocab)), step)]
    shift = np.cumsum([0, *[len(row) for row, _ in parts]])
    return np.concatenate([row for row, _ in parts]), np.concatenate([start + at for (_, start), at in zip(parts, shift, strict=False)])


def _subwords(vocab: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in vocab), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in vocab], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(vocab)), sizes)
    left = ends[owner] - np.arange(len(data))  # bytes from here to the word's end
    rows, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            fits = np.flatnonzero(left >= n)
            h = np.full(len(fits), n, dtype=np.uint64)
            for k in range(n):
                h = (h * np.uint64(1_000_003)) ^ data[fits + k]
            rows.append(((h * _MIX) >> np.uint64(40)) % np.uint64(buckets))
            owners.append(owner[fits])
        whole = np.zeros(len(vocab), dtype=np.uint64)
        for k in range(int(sizes.max(initial=0))):
            live = sizes > k
            whole[live] = (whole[live] * np.uint64(1_000_003)) ^ data[starts[live] + k]
        rows.append(((whole * _MIX) >> np.uint64(40)) % np.uint64(buckets))
        owners.append(np.arange(len(vocab)))
    row, own = np.concatenate(rows).astype(np.int32), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(vocab))
    return row[order], np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(vocab) else np.zeros(0, np.int64)


@dataclass
class Model:
    """Each bucket's part of the logit difference between toxic and not (its embedding times the softmax weights)."""

    part: np.ndarray
    bias: float
    window: int

    def word_logits(self, vocab: list[bytes]) -> np.ndarray:
        if not vocab:
            return np.zeros(0)
        row, start = subwords(vocab, len(self.part))
        size = np.diff(np.concatenate([start, [len(row)]]))
        return np.add.reduceat(self.part[row], start) / size

    def top(self, logits: np.ndarray) -> float:
        """The highest mean over windows of words; a shorter text is one window."""
        if len(logits) <= self.window:
            return float(logits.mean()) if len(logits) else 0.0
        sums = np.concatenate([[0.0], np.cumsum(logits)])
        return float((sums[self.window :] - sums[: -self.window]).max()) / self.window


def fit(texts: list[bytes], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, window: int = WINDOW, steps: int = STEPS, seed: int = 7) -> Model:
    """Full-batch descent on the log loss of each document's most toxic window, both classes weighing alike.

    Steps have momentum, and embeddings and weights each move by their gradient over its largest part. With one class only, or no rows, the model is the prior: all scores equal.
    """
    y = np.array(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(buckets), -2.0 if len(y) == 0 or y.max() == 0 else 2.0, window)
    index: dict[bytes, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words(t)] or [index.setdefault(b"", len(index))], dtype=np.int32) for t in texts]
    seen = np.zeros(len(index))
    for d in docs:
        seen[np.unique(d)] += 1
    flat = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    del docs
    begin = np.cumsum(sizes) - sizes
    # Window starts at each half window; a window never leaves its document.
    step = max(1, window // 2)
    lo = np.concatenate([(b + np.minimum(np.arange(0, max(1, n - window + step), step), max(0, n - window))).astype(np.int32) for b, n in zip(begin, sizes, strict=True)])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(range(0, max(1, n - window + step), step)) for n in sizes])
    hi = np.minimum(lo + window, (begin + sizes)[owner]).astype(np.int32)
    width = (hi - lo).astype(np.float32)
    first = np.searchsorted(owner, np.arange(len(sizes), dtype=np.int32))
    alike = (1.0 / np.bincount(owner))[owner].astype(np.float32)
    row, start = subwords(list(index), buckets)
    bag = np.diff(np.concatenate([start, [len(row)]]))
    # Words in stretches, so that no array of all rows of all bags is made besides ``row`` itself.
    stretches = [(lo, min(lo + 50_000, len(index))) for lo in range(0, len(index), 50_000)]
    rows_of = lambda lo, hi: slice(int(start[lo]), int(start[hi]) if hi < len(index) else len(row))

    def by_bucket(of_word: np.ndarray) -> np.ndarray:
        """The sum over all bags of what each word gives to each of its rows."""
        out = np.zeros(buckets)
        for a, b in stretches:
            out += np.bincount(row[rows_of(a, b)], weights=np.repeat(of_word[a:b], bag[a:b]), minlength=buckets)
        return out

    # Rows that fewer than LEAST_DOCS documents can have reached say nothing about other documents and stay zero.
    live = by_bucket(seen) >= LEAST_DOCS
    rng = np.random.default_rng(seed)
    emb = np.zeros((buckets, dim))
    out = rng.normal(0, 0.3, dim)
    bias = 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    y = y.astype(np.float32)
    pace_emb, pace_out, pace_bias = np.zeros_like(emb), np.zeros(dim), 0.0
    for t in range(1, steps + 1):
        part = emb @ out
        logit = np.concatenate([np.add.reduceat(part[row[rows_of(a, b)]], start[a:b] - start[a]) for a, b in stretches]) / bag
        sums = np.zeros(len(flat) + 1)
        np.cumsum(logit[flat], out=sums[1:])
        score = (sums[hi] - sums[lo]).astype(np.float32)
        del sums
        score /= width
        if t <= steps // 6:  # at first all windows of a document count alike
            picked, share = slice(None), alike
        else:
            best = np.maximum.reduceat(score, first)
            at = np.flatnonzero(score == best[owner])
            picked = at[np.unique(owner[at], return_index=True)[1]]
            share = np.ones(len(picked), dtype=np.float32)
        own = owner[picked]
        per = 1 / (1 + np.exp(-np.clip(score[picked] + np.float32(bias), -40, 40)))
        per -= y[own]
        per *= weight[own]
        per *= share
        pull = float(per.sum())
        per /= width[picked]
        edge = np.bincount(lo[picked], weights=per, minlength=len(flat) + 1)
        edge -= np.bincount(hi[picked], weights=per, minlength=len(flat) + 1)
        del score, per
        g_word = np.bincount(flat, weights=np.cumsum(edge)[:-1], minlength=len(index))
        g_part = np.where(live, by_bucket(g_word / bag), 0.0)
        # Momentum; each tensor's step has the scale of its largest gradient, so rare rows move little.
        g_out = emb.T @ g_part
        pace_emb = 0.9 * pace_emb + 0.1 * np.outer(g_part, out)
        pace_out = 0.9 * pace_out + 0.1 * g_out
        pace_bias = 0.9 * pace_bias + 0.1 * pull
        emb -= RATE * pace_emb / (np.abs(pace_emb).max() + 1e-12) + DECAY * emb
        out -= 0.02 * pace_out / (np.abs(pace_out).max() + 1e-12)
        bias -= 2.0 * pace_bias
    return Model(emb @ out, float(bias), window)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample, whole texts. Ids whose CRC-32 is 0 modulo 5 are held out and never read.

    An id labelled more than once counts as toxic if any label says so, and of several texts of one id the least one
    is taken. Labelled ids without a document take no place of the sample. A text of more than an eighth of ``most_bytes``
    is left out, so that no single text fills a class; in the order of hashed ids a class then ends before the first
    text that does not fit ``most_bytes`` any more.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(crc32_text(F.col("doc_id").cast("string")) % 5 != 0)
    fits = F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 8
    known = known.join(docs.where(fits).select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("toxic = 1").orderBy(*order).limit(rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(rows))
    # At most 2 * rows ids, so the sample may be broadcast, and the window below has that many rows.
    own = docs.where(fits).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    own = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("toxic").orderBy(*order))
    return own.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """The model of the sample, which is read by the driver: at most ``most_bytes`` of text of each class."""
    got = training_rows(docs, labels, rows, most_bytes).select("text", F.col("toxic").cast("int")).toArrow()
    pairs = sorted(zip([t or b"" for t in got.column("text").to_pylist()], got.column("toxic").to_pylist(), strict=True))
    return fit([t for t, _ in pairs], [y for _, y in pairs])


def toxicity_scores(docs: DataFrame, model: Model, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, score) of every whole text. A null or empty text has the score of no words at all.

    Repeated rows are each scored alike; only ``text`` decides a score, and no other column but ``doc_id`` is read. An
    empty table gives no rows.
    """
    cache: dict[bytes, float] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 200):
                split = [words(t) for t in texts[lo : lo + 200]]
                new = set().union(*split) - cache.keys()
                if new:
                    if len(cache) + len(new) > cache_words:
                        cache.clear()
                        new = set().union(*split)
                    fresh = list(new)
                    cache.update(zip(fresh, model.word_logits(fresh).tolist(), strict=True))
                found += [model.top(np.array([cache[w] for w in ws])) for ws in split]
            scores = 1 / (1 + np.exp(-np.clip(np.array(found, dtype=np.float64) + model.bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity_scores(docs, train(docs, read(spark, sf_dir, "labels")))
    held_out = crc32_text(F.col("doc_id").cast("string")) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
