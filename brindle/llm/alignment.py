"""Operator 12: alignment of the tokens of two tokenizers.

Token ends are byte offsets into one text, so two pointers over the ends of both sides give the groups (cuts where both
sides end) and the links (pairs that overlap). Spark counts the linked id pairs of the whole corpus, finds each side's
best count, and joins both back to the documents.

Neither tokenizer has a token that reaches over the place between a sign and a blank after it, so a text is aligned as
the sequence of its stretches between such places, and a stretch that comes again is aligned once. Documents go through
in bundles of bounded size. A bundle's different pairs are what is counted and joined, not the links of each document;
a document names its pairs by their places among those of its bundle. What goes between the tasks is a row for each
document: rows of whole bundles, of 12 MB each, are held by the dozen where they are written, read and shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, written
from .packing import encoder

#: Production parameters: the files of both sides; bytes of texts in a bundle; stretches
#: that a worker remembers, and signs of stretches that are encoded together.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BUNDLE_BYTES = 8 << 20
REMEMBERED, TOGETHER = 400_000, 1 << 17

#: A stretch: white space from a blank on, then anything up to the next blank that follows a sign.
STRETCH = re.compile(r"\s++(?:\S++(?:[^\S ]\s*+\S++)*+(?:[^\S ]\s*+)?)?")
#: Sides of a pair in one long: the id of A above the id of B.
SIDE = 32


@dataclass
class Links:
    """Some stretches, aligned: a row of ``counts`` (tokens of A and B, groups, links) and a groups' text for each, and
    the packed pairs of all links, in order; ``fine`` is false where a side does not give the bytes back."""

    fine: np.ndarray
    counts: np.ndarray
    groups: list[str]
    pairs: np.ndarray


NONE = Links(np.zeros(0, bool), np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64))


def joined(parts: list[Links]) -> Links:
    return Links(np.concatenate([p.fine for p in parts]), np.concatenate([p.counts for p in parts]), [g for p in parts for g in p.groups], np.concatenate([p.pairs for p in parts]))


def merge(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, ends: np.ndarray, a_names: list[str], b_names: list[str]) -> Links:
    """Aligns the tokens of consecutive stretches, given the ends of tokens of both sides and of the stretches.

    The two sorted lists of ends are merged. At each end of the merged list a pointer on either side stands at the
    token that covers what lies before it: these two are linked, and where both end a group does.
    """
    steps = np.union1d(a_ends, b_ends)
    i, j = np.searchsorted(a_ends, steps), np.searchsorted(b_ends, steps)
    both = (a_ends[i] == steps) & (b_ends[j] == steps)
    shut = steps[both]
    before = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, shut, steps)]
    counts = np.stack([np.diff(x, prepend=0) for x in before], axis=1)
    left, right = [a_names[t] for t in a.tolist()], [b_names[t] for t in b.tolist()]
    texts: list[str] = []
    i0 = j0 = 0
    for i1, j1 in zip((i[both] + 1).tolist(), (j[both] + 1).tolist(), strict=True):
        texts.append((left[i0] if i1 - i0 == 1 else ",".join(left[i0:i1])) + "|" + (right[j0] if j1 - j0 == 1 else ",".join(right[j0:j1])))
        i0, j0 = i1, j1
    at = [0, *before[2].tolist()]
    return Links(np.ones(len(ends), bool), counts, [";".join(texts[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], a[i] << SIDE | b[j])


class Places(dict):
    """Numbers of stretches, in the order in which they are first asked for."""

    def __missing__(self, stretch: str) -> int:
        self[stretch] = n = len(self)
        return n


class Aligner:
    """Both tokenizers, and the stretches aligned since the last time that they were more than ``REMEMBERED``."""

    def __init__(self, byte_level: str, pieces: str):
        self.a = encoder(byte_level, plain=True)
        named = self.a.token_bytes()
        self.a_bytes = [named.get(i, b"") for i in range(max(named) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))
        # The cuts hold only if no piece has its blank after another sign.
        self.cut = not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in self.b_bytes)
        self.forget()

    def forget(self) -> None:
        """Lets go of all stretches."""
        self.places, self.links, self.starts = Places(), NONE, np.zeros(1, np.int64)

    def stretches(self, text: str) -> list[str]:
        """The stretches of blank + text, each with a blank in front."""
        return STRETCH.findall(" " + text) if self.cut else [" " + text]

    def _together(self, stretches: list[str]) -> Links:
        """Aligns stretches as one text; where that does not give the bytes back, in halves."""
        text = "".join(stretches)
        raw = text.encode()
        a = self.a.ids([text])[0]
        # It puts the blank in front itself, but of nothing.
        b = self.b.encode(text[1:], num_threads=1) if text != " " else [self.b.piece_to_id("▁")]
        if b"".join([self.a_bytes[t] for t in a]) == raw and b"".join([self.b_bytes[t] for t in b]) == raw:
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            ends = np.cumsum([len(raw)] if len(stretches) == 1 else [len(s.encode()) for s in stretches])
            return merge(a, a_ends, b, b_ends, ends, self.a_names, self.b_names)
        if len(stretches) == 1:
            return Links(np.zeros(1, bool), np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64))
        half = len(stretches) // 2
        return joined([self._together(stretches[:half]), self._together(stretches[half:])])

    def align(self, stretches: list[str]) -> Links:
        """Aligns stretches, in texts of some length. One that ends in white space may only be the last of its text."""
        parts, some, size = [NONE], [], 0
        for n, s in enumerate(stretches, 1):
            some.append(s)
            size += len(s)
            if n == len(stretches) or size > TOGETHER or s[-1].isspace() or len(stretches[n]) > TOGETHER:
                parts.append(self._together(some))
                some, size = [], 0
        return joined(parts)

    def numbered(self, texts: list[str]) -> list[list[int]]:
        """The stretches of each text by their numbers; ``links`` and ``starts`` (of their pairs) hold all numbers."""
        if len(self.places) > REMEMBERED:
            self.forget()
        old = len(self.places)
        out = [list(map(self.places.__getitem__, self.stretches(t))) if t else [] for t in texts]
        if len(self.places) > old:
            self.links = joined([self.links, self.align(list(islice(self.places, old, None)))])
            self.starts = np.concatenate([[0], np.cumsum(self.links.counts[:, 3])])
        return out

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of some stretches, in order, and how many links hold each."""
        used, often = np.unique(numbers, return_counts=True)
        sizes = self.links.counts[used, 3]
        # The places of these stretches' pairs: runs from each start.
        run = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[used], sizes)
        pairs, at = np.unique(self.links.pairs[run], return_inverse=True)
        return pairs, np.bincount(at, weights=np.repeat(often, sizes), minlength=len(pairs)).astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str | None, pieces: str | None) -> Aligner:
    """The aligner of two files, one for each Python worker."""
    if byte_level is None or pieces is None:
        import public_tokenizers

        byte_level, pieces = byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES)
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


def forget_stretches() -> None:
    """For Python workers that aligned before and now do something else."""
    for align in _aligners.values():
        align.forget()


#: A document: places (32 bits each) of its different pairs among those of its bundle, and how many of its links hold
#: each. The first one of a bundle has the bundle's pairs and their totals too.
BUNDLES = "bundle long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, totals array<long>"


def bundle(align: Aligner, number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    """One bundle: a row for each document."""
    cut = align.numbered(texts)
    links = align.links
    counts: list[np.ndarray] = []
    shas: list[str] = []
    found: list[np.ndarray] = []
    times: list[np.ndarray] = []
    for own in cut:
        at = np.array(own, dtype=np.int64)
        if not links.fine[at].all():
            own, at = [], at[:0]
        counts.append(links.counts[at].sum(axis=0))
        shas.append(hashlib.sha256(";".join(map(links.groups.__getitem__, own)).encode()).hexdigest() if own else "")
        pairs, n = align.pairs(at)
        found.append(pairs)
        times.append(n)
    pairs, places = np.unique(np.concatenate(found), return_inverse=True)
    totals = np.bincount(places, weights=np.concatenate(times), minlength=len(pairs)).astype(np.int64)
    ends = np.cumsum([len(f) for f in found])[:-1]
    table = np.array(counts, dtype=np.int64).reshape(-1, 4)
    others = [None] * (len(ids) - 1)
    longs = pa.list_(pa.int64())
    return pa.record_batch({
        "bundle": pa.array([number] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "n_a": table[:, 0], "n_b": table[:, 1], "n_groups": table[:, 2], "n_links": table[:, 3], "groups_sha256": shas,
        "places": [p.tobytes() for p in np.split(places.astype(np.uint32), ends)], "times": [n.astype(np.uint32).tobytes() for n in times], "pairs": pa.array([pairs, *others], longs), "totals": pa.array([totals, *others], longs),
    })


def bundles(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, size: int = BUNDLE_BYTES) -> DataFrame:
    """Documents, aligned in bundles of about ``size`` bytes of text (a longer text is one of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held, number
            rows = bundle(align, number, ids, texts)
            ids.clear(), texts.clear()
            held, number = 0, number + 1
            return rows

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), (t.as_py() for t in batch["text"]), strict=True):
                if texts and held + len(text) > size:
                    yield out()
                ids.append(doc)
                texts.append(text)
                held += len(text) + 64
        if texts:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BUNDLES)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, a_best, b_best): the links of each id pair in the corpus, and the best count of either id."""
    listed = made.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select("x.pairs", "x.totals")
    n = listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("n"))
    n = n.select("pair", F.shiftright("pair", SIDE).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << SIDE) - 1).cast("int").alias("b_id"), "n")
    n = written(n, "pair-counts")
    # A row for each id of a vocabulary at most.
    a = n.groupBy("a_id").agg(F.max("n").alias("a_best"))
    b = n.groupBy("b_id").agg(F.max("n").alias("b_best"))
    return n.join(F.broadcast(a), "a_id").join(F.broadcast(b), "b_id").select("pair", "a_id", "b_id", "n", "a_best", "b_best")


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string"


def scored(made: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with the counts of their links: pairs get theirs by a join, once a bundle, and documents sum them up."""
    asked = made.select(F.col("bundle").alias("of"), F.explode("pairs").alias("pair"))
    told = asked.join(counts.select("pair", "n", (F.col("n") == F.col("b_best")).cast("long").alias("n_best"), (F.col("n") == F.col("a_best")).cast("long").alias("n_best_a")), "pair")

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        forget_stretches()
        order = np.argsort(told["pair"].to_numpy())
        sizes = pc.binary_length(docs["places"]).to_numpy().astype(np.int64) // 4
        ends = np.cumsum(sizes)
        places, times = (np.frombuffer(b"".join(docs[c].to_pylist()), np.uint32) for c in ("places", "times"))
        sums = {}
        for name in ("n_best", "n_best_a", "n"):
            so_far = np.concatenate([[0], np.cumsum(told[name].to_numpy()[order][places] * times)])
            sums[name] = so_far[ends] - so_far[ends - sizes]
        return pa.table({c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums["n_best"], "n_best_a": sums["n_best_a"], "count_sum": sums["n"], "groups_sha256": docs["groups_sha256"]})

    # A group holds what one bundle does, which its size bounds.
    return made.drop("pairs", "totals").groupBy("bundle").cogroup(told.groupBy("of")).applyInArrow(run, SCORED)


def tokenizer_alignment(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, size: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the linked id pairs of the corpus (see ``pair_counts``).

    ``byte_level`` and ``pieces``: the files of sides A and B. A text that is null or empty, or whose tokens on either
    side do not give back blank + text (one that holds U+2581, which stands for the blank), has no tokens: all counts 0
    and ''. Repeated rows are each aligned and counted. A null ``doc_id`` stays null. Other columns are not read. Empty
    tables give empty results.
    """
    made = written(bundles(docs, byte_level, pieces, size), "aligned")
    counts = written(pair_counts(made), "pairs")
    return scored(made, counts), counts


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(read(spark, sf_dir, "documents"))[0]
