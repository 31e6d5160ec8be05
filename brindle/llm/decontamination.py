"""Operator 6: benchmark decontamination by CGK embedding and bit-sampling LSH.

A random walk reads a string and steps on or stays by a random bit for each (step, sign); what it reads is the CGK
embedding, in which strings at a small edit distance differ at few places. Texts are read in windows beside anchors
(word pairs whose hash is the least of a run, so that text and item have the same anchors): a walk goes from an
anchor to the right or to the left over a fixed stretch of about 40 bytes, whatever the item's size. Several samples
of places of several walks are the hash keys; a window that meets an item's window in any of them is verified by the
exact edit distance. As edits that hit the anchors leave no key, runs of bytes that an item and a text share are
counted as well: where they cover enough of the item on nearly one diagonal, the place is verified too. The documents
are read once and nothing is shuffled; each Python worker builds the index of the items once, for all its tasks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .ngram_join import SLICE_BYTES, mix, word_hashes

#: Production parameters: edits allowed as a part of the item's length; steps of a walk; walks in each direction; samples
#: of a walk and their places; word pairs of a run; items that one pass over the documents takes (the proven bound of
#: what is sent to the executors; more items take more passes).
MAX_RATE = 0.2
STEPS = 80
WALKS = 3
SAMPLES = 12
PLACES = 12
RUN = 12
BLOCK_ITEMS = 20_000
SEED = 11
#: Bytes of a shared run that counts; diagonals that count together at least (an item's allowed edits, where these are
#: more); the part of an item (and the bytes at least) that
#: runs must cover.
GRAM = 8
DRIFT = 24
COVER = 0.3
COVER_LEAST = 26
#: Items of fewer bytes have no room for a walk and are found by any run that the allowed edits must leave.
SHORT = 80

#: ASCII letters become small, other ASCII but digits a blank; further bytes stay.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_U = np.uint64
_NONE = _U(2**64 - 1)


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_NORMAL).split())


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take over each run of ``width`` elements; the result is shorter by width - 1."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = take(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, run: int) -> np.ndarray:
    """Byte positions of the words that begin a pair whose hash is the least of some run of ``run`` pairs of its text."""
    hashes, at = word_hashes(data, offsets)
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    word = data != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = word[edge]
    start = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        pair = mix(hashes * _U(3) + np.concatenate([hashes[1:], hashes[:1]]) * _U(0x9E3779B97F4A7C15))
    last = at[1:][at[1:] > at[:-1]] - 1
    pair[last] = hashes[last]  # the last word of a text has no partner
    # `run` empty places between texts, so that no run of pairs touches two texts.
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(pair)) + run * (owner + 1)
    wide = np.full(len(pair) + run * (len(at) + 1), _NONE, dtype=_U)
    wide[place] = pair
    least = _sliding(wide, run, np.minimum)
    best = _sliding(least, run, np.maximum)  # at i: the largest minimum of the runs that hold i + run - 1
    return start[best[place - run + 1] == pair]


@dataclass
class Keys:
    """Walks and samples, alike for documents and items."""

    bits: np.ndarray  # walk, step, sign
    places: np.ndarray  # walk, sample, place

    @staticmethod
    def drawn(seed: int = SEED) -> Keys:
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (2 * WALKS, STEPS, 256)).astype(np.int32)
        places = np.stack([[np.sort(rng.choice(STEPS, PLACES, replace=False)) for _ in range(SAMPLES)] for _ in range(2 * WALKS)])
        return Keys(bits, places)

    def of(self, data: np.ndarray, at: np.ndarray, walk: int) -> np.ndarray:
        """Sample keys (samples x positions). Even walks go right from the position, odd ones left from the sign before it."""
        left = walk % 2
        step_by = -1 if left else 1
        used = defaultdict(list)
        for s, places in enumerate(self.places[walk]):
            for p in places:
                used[int(p)].append(s)
        out = np.full((len(self.places[walk]), len(at)), walk + 1, dtype=_U)
        pointer = at.astype(np.int64) - left
        with np.errstate(over="ignore"):
            for j in range(max(used) + 1):
                sign = data[pointer]
                wide = sign.astype(_U) if j in used else None
                for s in used.get(j, ()):
                    out[s] *= _U(0x9E3779B97F4A7C15)
                    out[s] += wide
                pointer += (self.bits[walk, j] * step_by).astype(np.int64)[sign]
            return mix(out)


def reach(walk: int, keys: Keys) -> int:
    """About the number of signs that a walk reads up to its last sampled place."""
    return int(keys.places[walk].max() // 2)


PAD = STEPS + 1


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, bytes, offsets): the texts one after the other; in the first, with room for the walks at the ends."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = np.zeros(int(offsets[-1]) + 2 * PAD, dtype=np.uint8)
    whole[PAD : PAD + int(offsets[-1])] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return whole, whole[PAD : PAD + int(offsets[-1])], offsets


@dataclass
class Grams:
    """The places of all runs of ``size`` bytes of some items, and how many bytes runs must cover of each item."""

    size: int
    hashes: np.ndarray  # sorted, each once
    begin: np.ndarray  # where the places of a hash begin, and the end
    item: np.ndarray
    inside: np.ndarray
    cover: np.ndarray
    drift: np.ndarray
    mask: np.ndarray

    @staticmethod
    def of(items: list[tuple[int | None, bytes]], own: list[int], size: int, cover: list[int], max_rate: float) -> Grams:
        whole, data, offsets = padded([items[i][1] for i in own])
        at = np.concatenate([np.arange(lo, hi - size + 1) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)])
        found = _gram_hashes(whole, size)[at + PAD]
        order = np.argsort(found, kind="stable")
        hashes, begin = np.unique(found[order], return_index=True)
        owner = np.searchsorted(offsets, at[order], side="right") - 1
        mask = np.zeros(1 << 22, dtype=bool)
        mask[hashes >> _U(42)] = True
        wanted = np.zeros(len(items), dtype=np.int64)
        wanted[own] = cover
        # Edits of one kind move the diagonal by as many bytes as there are edits.
        drift = np.array([max(DRIFT, int(len(t) * max_rate)) for _, t in items], dtype=np.int64)
        return Grams(size, hashes, np.append(begin, len(at)), np.array(own)[owner], at[order] - offsets[owner], wanted, drift, mask)

    def places(self, whole: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, start) where runs cover enough of the item on diagonals near each other."""
        total = int(offsets[-1])
        hashes = _gram_hashes(whole, self.size)[PAD : PAD + total]
        at = np.flatnonzero(self.mask[hashes >> _U(42)])
        found = np.searchsorted(self.hashes, hashes[at])
        found[found == len(self.hashes)] = 0
        doc = np.searchsorted(offsets, at, side="right") - 1
        true = (self.hashes[found] == hashes[at]) & (at + self.size <= offsets[doc + 1])
        at, found = at[true], found[true]
        # In parts, as a place can stand for many places of items; a part ends where a text does.
        n = self.begin[found + 1] - self.begin[found]
        ends = np.cumsum(n)
        bounds, lo = np.searchsorted(at, offsets[1:]), 0
        for hi in bounds.tolist():
            if hi > lo and (hi == len(at) or ends[hi - 1] - (ends[lo - 1] if lo else 0) >= 500_000):
                yield from self._covered(at[lo:hi], found[lo:hi], n[lo:hi], offsets)
                lo = hi

    def _covered(self, at: np.ndarray, found: np.ndarray, n: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        places = np.arange(int(n.sum())) + np.repeat(self.begin[found] - (np.cumsum(n) - n), n)
        item, pos = self.item[places].astype(np.int64), np.repeat(at, n)
        doc = np.searchsorted(offsets, pos, side="right") - 1
        # Rows of a text and item side by side, by diagonal and (as the sort is stable) place.
        diagonal = pos - self.inside[places]
        low, first = int(diagonal.min()), int(doc[0])
        lane = (item * (int(doc[-1]) - first + 1) + doc - first) * (int(diagonal.max()) - low + int(self.drift.max()) + 1) + diagonal - low
        order = np.argsort(lane, kind="stable")
        item, doc, diagonal, pos, lane = item[order], doc[order], diagonal[order], pos[order], lane[order]
        gap = np.full(len(pos), self.size)
        more = np.flatnonzero(lane[1:] == lane[:-1])
        gap[more + 1] = np.minimum(self.size, pos[more + 1] - pos[more])
        covered = np.concatenate([[0], np.cumsum(gap)])
        end = np.searchsorted(lane, lane + self.drift[item], side="right")
        # The first row of a diagonal counts all that later ones do. As a text may repeat a part of the item on several
        # diagonals, the item's bytes are then counted once each.
        first_of = np.append(True, lane[1:] != lane[:-1])
        k = np.flatnonzero(first_of & (covered[end] - covered[:-1] >= self.cover[item]))
        k = k[self._distinct(pos - diagonal, k, end[k]) >= self.cover[item[k]]]
        yield from zip(doc[k].tolist(), item[k].tolist(), (diagonal[k] - offsets[doc[k]]).tolist(), strict=True)

    def _distinct(self, inside: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 500_000) -> np.ndarray:
        """Bytes of an item that its runs at the places ``inside[begin:end]`` cover, each counted once, for each such stretch."""
        out = np.zeros(len(begin), dtype=np.int64)
        n = end - begin
        total = np.cumsum(n)
        span, lo = int(inside.max(initial=0)) + 1, 0
        while lo < len(begin):
            # In parts of about ``most`` places, one stretch at least.
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
            size = n[lo:hi]
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(begin[lo:hi] - first, size)
            place = np.sort(np.repeat(np.arange(hi - lo), size) * span + inside[at])
            gap = np.minimum(self.size, np.diff(place, prepend=0))
            gap[first] = self.size
            out[lo:hi] = np.add.reduceat(gap, first)
            lo = hi
        return out


@dataclass
class Table:
    """The keys of one sample in order, with the item and the place in it of each, and a mask of their first bits."""

    keys: np.ndarray
    item: np.ndarray
    inside: np.ndarray
    mask: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, item: np.ndarray, inside: np.ndarray) -> Table:
        order = np.argsort(keys, kind="stable")
        mask = np.zeros(1 << 20, dtype=bool)
        mask[keys >> _U(44)] = True
        return Table(keys[order], item[order].astype(np.int32), inside[order].astype(np.int32), mask)

    def matches(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``row``, entry) of all equal keys."""
        at = np.flatnonzero(self.mask[row >> _U(44)])
        lo = np.searchsorted(self.keys, row[at])
        n = np.searchsorted(self.keys, row[at], side="right") - lo
        return np.repeat(at, n), np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """Items, and for each walk and sample the keys of their windows."""

    items: list[tuple[int | None, bytes]]
    run: int
    keys: Keys
    tables: list[list[Table]] = field(default_factory=list)
    grams: list[Grams] = field(default_factory=list)


def _gram_hashes(whole: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` (8 at most) bytes from each place on; the last 7 places have none."""
    raw = np.ndarray((len(whole) - 7,), dtype="<u8", buffer=whole, strides=(1,))
    with np.errstate(over="ignore"):
        return mix((raw & _U((1 << (8 * size)) - 1)) * _U(0x9E3779B97F4A7C15) + _U(size))


def build_index(items: list[tuple[int | None, bytes]], run: int = RUN, max_rate: float = MAX_RATE) -> Index:
    """An item of fewer than ``run`` word pairs may have no anchor in common with a text; its runs of bytes find it."""
    items = [(i, t) for i, t in items if t]
    keys = Keys.drawn()
    index = Index(items, run, keys)
    whole, data, offsets = padded([t for _, t in items])
    at = anchors(data, offsets, run)
    owner = np.searchsorted(offsets, at, side="right") - 1
    inside, size = at - offsets[owner], np.diff(offsets)[owner]
    long = [i for i, (_, t) in enumerate(items) if len(t) >= SHORT]
    if long:
        index.grams.append(Grams.of(items, long, GRAM, [max(COVER_LEAST, int(len(items[i][1]) * COVER)) for i in long], max_rate))
    # Of the e + 1 equal parts of an item, e edits leave one whole: any run of its length is enough.
    short: dict[int, list[int]] = defaultdict(list)
    for i, (_, t) in enumerate(items):
        if len(t) < SHORT:
            short[min(GRAM, len(t) // (int(len(t) * max_rate) + 1))].append(i)
    for width, own in short.items():
        index.grams.append(Grams.of(items, own, width, [width] * len(own), max_rate))
    for walk in range(len(keys.bits)):
        # A window must lie in the item; where neither side has the room, both are kept.
        need = reach(walk, keys)
        room = inside if walk % 2 else size - inside
        other = size - room
        fits = (room >= need) | ((other < need) & (room >= other))
        found = keys.of(whole, at[fits] + PAD, walk)
        index.tables.append([Table.of(row, owner[fits], inside[fits]) for row in found])
    return index


def edit_distance_within(item: bytes, region: bytes) -> tuple[int, int]:
    """(least edit distance of the item to any part of the region, end of that part): bit-parallel, one step a sign."""
    at = region.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(region, 1):
        eq = where.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        hp = down | (full & ~(d | up))
        hn = up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up = hn | (full & ~(d | hp))
        down = hp & d
        if score < best[0]:
            best = (score, j)
    return best


def search(texts: list[bytes], index: Index, max_rate: float = MAX_RATE) -> Iterator[tuple[int, int, int]]:
    """(text, item, distance) of each text (normalised) and item that meet in a key and prove within the allowed edits."""
    if not index.items:
        return
    whole, data, offsets = padded(texts)
    at = anchors(data, offsets, index.run)
    asked: dict[tuple[int, int], set[int]] = defaultdict(set)
    for walk, tables in enumerate(index.tables):
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            for row, table in zip(index.keys.of(whole, part + PAD, walk), tables, strict=True):
                place, entry = table.matches(row)
                doc = np.searchsorted(offsets, part[place], side="right") - 1
                start = part[place] - offsets[doc] - table.inside[entry]
                for d, i, p in zip(doc.tolist(), table.item[entry].tolist(), start.tolist(), strict=True):
                    asked[d, i].add(p)
    for grams in index.grams:
        for doc, item, start in grams.places(whole, offsets):
            asked[doc, item].add(start)
    for (doc, item), starts in asked.items():
        body = index.items[item][1]
        spare = int(len(body) * max_rate)
        best, near = spare + 1, sorted(starts)
        # Starts near each other are one region, which reaches as far as the last of them needs: a match begins within
        # ``spare`` of its start and is longer than the item by ``spare`` at most.
        edges = [k for k in range(1, len(near)) if near[k] > near[k - 1] + spare]
        for lo, hi in zip([0, *edges], [*edges, len(near)], strict=True):
            if best:
                best = min(best, edit_distance_within(body, texts[doc][max(0, near[lo] - spare) : max(0, near[hi - 1] + len(body) + 2 * spare)])[0])
        if best <= spare:
            yield doc, item, best


_built: dict[str, Index] = {}


def _index_of(items: list[tuple[int | None, bytes | None]], max_rate: float) -> Index:
    """The index of some items, kept by the Python worker for its next tasks."""
    digest = hashlib.sha256(repr((items, max_rate, RUN, SEED)).encode()).hexdigest()
    if digest not in _built:
        _built.clear()
        _built[digest] = build_index([(i, normal(t)) for i, t in items], max_rate=max_rate)
    return _built[digest]


def _search_block(docs: DataFrame, items: list[tuple[int | None, bytes]], max_rate: float) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(items, max_rate)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple[int | None, int | None, int, int]] = []
            texts: list[bytes] = []
            held, first = 0, 0
            for k, raw in enumerate([*batch.column(1).to_pylist(), None]):
                end = k == len(ids)
                if not end:
                    texts.append(normal(raw))
                    held += len(texts[-1])
                if texts and (end or held >= SLICE_BYTES):
                    rows += [(ids[first + d], index.items[i][0], dist, len(index.items[i][1])) for d, i, dist in search(texts, index, max_rate)]
                    texts, held, first = [], 0, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "item_bytes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(found, "doc_id long, item_id long, distance long, item_bytes long")


def contaminated(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes) of each document and item that it holds within the allowed edits.

    Distance is in UTF-8 bytes of normalised text: small letters, one blank for all that is no letter or digit. Null
    and empty texts and items hold nothing; texts are searched whole, whatever their length. Repeated rows of either
    table each give rows, also those without an id, and equal items each give a row. Of an item's places in a document
    the nearest counts. Items are taken in blocks of ``block_items``; each is a pass over the documents. An empty table
    gives no rows. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    blocks = max(1, -(-items.count() // block_items))
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        got = own.toArrow()
        rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        part = _search_block(docs, rows, max_rate)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item. Rows of one id stay or go together; rows without an id stay."""
    gone = contaminated(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
