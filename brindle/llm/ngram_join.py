"""Operator 10: Jaccard self-join of word n-gram sets by vertical partitioning.

The n-grams stand in one global order, that of their hashes, which is cut into fragments. Each fragment counts for
itself, and counts are summed over fragments:

1. ``witnesses``: a document of n n-grams can only be linked if all but n / 4 of them occur in another set. Each
   fragment counts a set's n-grams that no other set has; sets with too many in all are done. Equal sets are one.
2. Of the sets left, those that share an n-gram of their prefix (rarest first) are grouped; each group is compared
   to its hub, the member with the fewest n-grams of its own. Overlaps of a pair are counted per fragment and summed.
3. Pairs of a group that neither touch the hub nor are joined through it are compared in blocks of bounded size:
   within families of groups that hang together while these are small, else within each group for itself.
4. Links give components.

No step gathers a group in one task, and no link between different sets is lost. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, written

#: Production parameters: words of an n-gram; links need PERCENT of the union in common.
N = 5
PERCENT = 75
#: Fragments in which overlaps of a pair are counted; sets of a block; sets of a family from which its groups are
#: compared one by one; bytes of text whose n-grams one fragment of the first step counts.
FRAGMENTS = 8
BLOCK = 256
FAMILY = 64 * BLOCK
FRAGMENT_BYTES = 64 << 20
#: Bytes of text that are hashed at once, and what a task gathers before it sends to the fragments.
SLICE_BYTES = 1 << 21
FLUSH_ELEMENTS = 3_000_000
FLUSH_SETS = 30_000

_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=_U) * _ROOT)
    _BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
    _POWER = _ROOT | _U(1)
    _INVERSE = _U(pow(int(_POWER), -1, 1 << 64))
    _PLACE = mix(np.arange(101, 101 + 16, dtype=_U) * _ROOT) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept for the next call."""
    name = str(base)
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=_U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers[name][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other, and where each text's words begin (and the end)."""
    if not len(data):
        return np.zeros(0, dtype=_U), np.zeros(len(offsets), dtype=np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = word[edge]
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * _power(_INVERSE, len(data)), dtype=_U)])
    hashes = mix((total[end] - total[start]) * _power(_POWER, len(data))[start] + (end - start).astype(_U))
    return hashes, np.searchsorted(start, offsets)


def gram_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text; a text of fewer words has its whole sequence as one."""
    texts = texts.cast(pa.large_binary())
    sizes = np.asarray(texts.fill_null(b"").to_numpy(zero_copy_only=False), dtype=object)
    lo = 0
    while lo < len(sizes):
        hi, taken = lo, 0
        while hi < len(sizes) and (hi == lo or taken + len(sizes[hi]) <= SLICE_BYTES):
            taken += len(sizes[hi])
            hi += 1
        part = sizes[lo:hi]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
        yield from _sets_of(np.frombuffer(b"".join(part), dtype=np.uint8), offsets, n)
        lo = hi


def _sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        words, at = word_hashes(data, offsets)
        m = max(0, len(words) - n + 1)
        grams = np.zeros(m, dtype=_U)
        for k in range(n):
            grams += words[k : k + m] * _PLACE[k]
        grams = mix(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACE[n : n + b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))
            else:
                yield np.zeros(0, dtype=_U)


def share(n: np.ndarray | int) -> np.ndarray:
    """The part of the hash space in which a set of n is looked at: enough to see more than n / 4 unshared n-grams."""
    return np.minimum(1.0, 0.33 + 2.0 / np.sqrt(np.maximum(n, 1)))


def _limit(n: int) -> np.uint64:
    return _U(min(int(share(n) * 2.0**64), 2**64 - 1))


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else b""


WITNESS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("blob", pa.binary())])
COUNTED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("key", pa.int64()), ("blob", pa.binary())])


def witnesses(docs: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """Rows of two kinds: (doc_id, n, node, key) of each document, and packed counts (part, blob) of n-grams that one set
    alone has, to be summed by ``totals``.

    ``node`` names a set, ``key`` is its first 8 bytes. A task sends an n-gram at most twice, which is enough to tell
    that it is shared, so one that very many documents have does not fill its fragment.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        grams: list[np.ndarray] = []
        counts: list[tuple[int, np.uint64]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if grams:
                h = np.concatenate(grams)
                keys = np.array([int.from_bytes(k[:8], "little") for k in seen], dtype=_U)
                index = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.uint16)
                own = h < np.repeat(np.array([c[1] for c in counts], dtype=_U), [c[0] for c in counts])
                order = np.argsort(h, kind="stable")
                h, index, own = h[order], index[order], own[order]
                third = np.zeros(len(h), dtype=bool)
                third[2:] = (h[2:] == h[:-2])
                h, index, own = h[~third], index[~third], own[~third]
                part = ((h & _U(0xFFFFFFFF)) * _U(parts)) >> _U(32)
                order = np.argsort(part, kind="stable")
                h, index, own, part = h[order], index[order], own[order], part[order]
                edges = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
                rows = []
                for p in range(parts):
                    a, b = edges[p], edges[p + 1]
                    if a < b:
                        used, place = np.unique(index[a:b], return_inverse=True)
                        code = (place.astype(np.uint16) << np.uint16(1)) | own[a:b].astype(np.uint16)
                        head = np.array([len(used), b - a], dtype="<u4").tobytes()
                        rows.append((p, head + keys[used].tobytes() + h[a:b].tobytes() + code.tobytes()))
                none = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[r[0] for r in rows], none, none, none, [r[1] for r in rows]], WITNESS.types, strict=True)], schema=WITNESS)
            seen.clear()
            grams.clear()
            counts.clear()
            held = 0

        for batch in batches:
            rows: list[tuple[int | None, int, bytes]] = []
            for doc, g in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1)), strict=True):
                node = set_key(g)
                rows.append((doc, len(g), node))
                if len(g) and node not in seen:
                    seen[node] = 1
                    sent = g[: np.searchsorted(g, _limit(-(-len(g) * percent // 100)))]
                    grams.append(sent)
                    counts.append((len(sent), _limit(len(g))))
                    held += len(sent)
                    if held >= FLUSH_ELEMENTS or len(grams) >= FLUSH_SETS:
                        yield from flush()
            if rows:
                to = [i % parts for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([to, *zip(*rows, strict=True), [None] * len(rows)], WITNESS.types, strict=True)], schema=WITNESS)
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, owns = [], [], []
        for batch in batches:
            blobs = batch.column("blob")
            rows = batch.filter(blobs.is_null())
            if rows.num_rows:
                key = pa.array([int.from_bytes(x[:8], "little", signed=True) for x in rows.column("node").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.int32()), rows.column("doc_id"), rows.column("n"), rows.column("node"), key, pa.nulls(rows.num_rows, pa.binary())], schema=COUNTED)
            for blob in blobs.drop_null().to_pylist():
                n_keys, n = np.frombuffer(blob, dtype="<u4", count=2).tolist()
                used = np.frombuffer(blob, dtype=_U, count=n_keys, offset=8)
                hashes.append(np.frombuffer(blob, dtype=_U, count=n, offset=8 + 8 * n_keys))
                code = np.frombuffer(blob, dtype=np.uint16, count=n, offset=8 + 8 * n_keys + 8 * n)
                keys.append(used[code >> np.uint16(1)])
                owns.append((code & np.uint16(1)).astype(bool))
        if hashes:
            h, key, own = np.concatenate(hashes), np.concatenate(keys), np.concatenate(owns)
            del hashes, keys, owns
            order = np.argsort(h, kind="stable")
            h, key, own = h[order], key[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            alone = np.minimum.reduceat(key, first) == np.maximum.reduceat(key, first)
            found, n_alone = np.unique(key[first][alone & own[first]], return_counts=True)
            part = found % _U(parts)
            order = np.argsort(part, kind="stable")
            found, n_alone, part = found[order], n_alone[order].astype("<u4"), part[order]
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
            to = [p for p in range(parts) if edges[p] < edges[p + 1]]
            blobs = [found[edges[p] : edges[p + 1]].tobytes() + n_alone[edges[p] : edges[p + 1]].tobytes() for p in to]
            none = [None] * len(to)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([to, none, none, none, none, blobs], COUNTED.types, strict=True)], schema=COUNTED)

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, "part int, doc_id long, n long, node binary, blob binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(count, "part int, doc_id long, n long, node binary, key long, blob binary")


def totals(counted: DataFrame, parts: int) -> DataFrame:
    """(key, alone): the packed counts of all fragments, summed per set. A set has one count from each fragment at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                n = len(blob) // 12
                keys.append(np.frombuffer(blob, dtype=_U, count=n))
                counts.append(np.frombuffer(blob, dtype="<u4", count=n, offset=8 * n))
        if keys:
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            alone = np.add.reduceat(count.astype(np.int64), first)
            for lo in range(0, len(first), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[first[lo : lo + 50_000]].astype(np.int64)), pa.array(alone[lo : lo + 50_000])], names=["key", "alone"])

    packed = counted.where("blob is not null").repartitionById(parts, F.col("part"))
    return packed.select("blob").mapInArrow(add, "key long, alone long")


def elements(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, gram): the n-grams of one document of each wanted set (node, first id)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists = [], []
            for node, g in zip(batch.column("node").to_pylist(), gram_sets(batch.column("text")), strict=True):
                if set_key(g) == node:
                    nodes.append(node)
                    lists.append(g.astype(np.int64))
            n = [len(g) for g in lists]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["node", "n", "grams"])

    mine = wanted.select(F.col("first").alias("_first"), "node").hint("shuffle_hash")
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(mine, F.col("doc_id").eqNullSafe(F.col("_first")))
    return joined.select("node", "text").mapInArrow(grams, "node binary, n long, grams array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable along the edges, by hooking and pointer jumping until nothing changes."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v")
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = written(hooked.join(up, "label").select("node", "was", F.least("label", "above").alias("label")), "labels")
        if after.where("was <> label").isEmpty():
            discard(both, labels)
            return after.select("node", "label")
        discard(labels)
        labels = after.select("node", "label")
        labels.written_to = after.written_to


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, common) for pairs (a, b): partial overlaps of each fragment, summed per pair."""
    by_b = pairs.join(segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b")), "b")
    by_a = by_b.join(segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a")), ["a", "fragment"])
    partial = by_a.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("common"))
    return partial.groupBy("a", "b").agg(F.sum("common").alias("common"))


def _block_links(percent: int):
    """Links of a block: edges that join different labels, a forest of them at most."""

    def links(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        n = table.column("n").to_numpy()
        label = {x: x for x in table.column("label").to_pylist()}
        group = table.column("label").to_pylist()

        def root(x: bytes) -> bytes:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        grams = table.column("grams").combine_chunks()
        flat = grams.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(nodes)), np.diff(grams.offsets.to_numpy()))
        found, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
        rank = np.cumsum(times > 1) - 1
        live = times[code] > 1
        owner, code = owner[live], rank[code[live]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        width = 4096
        for lo in range(0, int((times > 1).sum()), width):
            a, b = np.searchsorted(code, [lo, lo + width])
            m = np.zeros((len(nodes), width), dtype=np.float32)
            m[owner[a:b], code[a:b] - lo] = 1
            common += m @ m.T
        common = common.astype(np.int64)
        union = n[:, None] + n[None, :] - common
        out = []
        for i, j in zip(*np.nonzero(np.triu(100 * common >= percent * union, 1)), strict=True):
            x, y = root(group[i]), root(group[j])
            if x != y:
                label[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return links


def compare_in_blocks(nodes: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) within families: ``nodes`` has (node, n, family, label), ``sets`` has (node, grams).

    A family is cut by classes of size, between which only neighbours can be linked, and a class into parts of about
    ``block`` sets by hash; any two parts of the same or of neighbouring classes meet in one group. Of the links found,
    only those are returned that join different labels.
    """
    sized = nodes.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))
    counts = sized.groupBy("family", "class").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    counts = written(counts, "classes")
    at = lambda d, name: counts.select("family", (F.col("class") + d).alias("class"), F.col("parts").alias(name))
    placed = (
        sized.join(counts, ["family", "class"])
        .join(at(-1, "above"), ["family", "class"], "left")
        .join(at(1, "below"), ["family", "class"], "left")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    )
    meet = lambda c1, p1, c2, p2: F.struct(c1.alias("c1"), p1.alias("p1"), c2.alias("c2"), p2.alias("p2"))
    cls, part = F.col("class"), F.col("part")
    upto = lambda k: F.when(F.coalesce(k, F.lit(0)) > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    keys = F.concat(
        F.transform(upto(F.col("parts")), lambda q: meet(cls, F.least(part, q), cls, F.greatest(part, q))),
        F.transform(upto(F.col("above")), lambda q: meet(cls, part, cls + 1, q)),
        F.transform(upto(F.col("below")), lambda q: meet(cls - 1, q, cls, part)),
    )
    # A part meets itself once; where it meets others, pairs within it are found again, which adds no edge.
    rows = placed.select("node", "n", "label", "family", F.explode(keys).alias("k")).join(sets, "node")
    return rows.groupBy("family", "k").applyInArrow(_block_links(percent), "a binary, b binary")


def unsettled_members(unsettled: DataFrame, family: int) -> DataFrame:
    """(node, n, label, family): the sets to compare, from (gram, node, n, label, least) of groups with several labels.

    Groups that hang together are a family. One of more than ``family`` sets, as may come from long chains of groups, is
    taken group by group; of groups with the same sets one is enough.
    """
    whole = components(unsettled.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()).withColumnRenamed("label", "family")
    sets = unsettled.select("node", "n", "label").distinct().join(whole, "node")
    large = written(sets.groupBy("family").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > family).select("family"), "large-families")
    members = sets.join(large, "family", "left_anti").select("node", "n", "label", "family")
    if large.isEmpty():
        return members
    rows = unsettled.join(whole.join(large, "family", "left_semi").select("node"), "node", "left_semi")
    same = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    groups = same.groupBy("m", "x", "y").agg(F.min("gram").alias("gram")).select("gram")
    name = F.concat(F.lit("group "), F.col("gram").cast("string")).cast("binary")
    return written(members.unionByName(rows.join(groups, "gram").select("node", "n", "label", name.alias("family"))), "members")


def ngram_components(docs: DataFrame, percent: int = PERCENT, parts: int | None = None, family: int = FAMILY) -> DataFrame:
    """One row for each document: doc_id, node (names its set; empty for none), n_shingles, component_id.

    A text of fewer than five words has its whole sequence as its one n-gram; a text without words, or a null, has none
    and is linked with nothing: its component is its own id. Rows of equal sets are in one component. A null id counts
    for no component's smallest id, so a component of nulls alone has a null. Repeated rows each get a row. Columns of
    ``docs`` but doc_id and text are not read. An empty table gives no rows.
    """
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))
    counted = written(witnesses(docs, parts, percent), "witnesses")
    rows = counted.where("node is not null").select("doc_id", "n", "node", "key")
    classes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.first("key").alias("key"))
    alone = totals(counted, parts)
    spare = F.floor(F.col("n") - F.ceil(F.col("n") * percent / 100))
    wanted = classes.join(alone, "key", "left").where(F.coalesce("alone", F.lit(0)) <= spare)
    wanted = written(wanted.select("node", "first"), "wanted")
    sets = written(elements(docs, wanted).dropDuplicates(["node"]), "sets")

    flat = sets.select("node", "n", F.explode("grams").alias("gram"))
    often = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = F.sort_array(F.collect_list(F.struct("df", "gram")))
    shared = flat.join(often, "gram").groupBy("node", "n").agg(order.alias("shared"))
    shared = shared.withColumn("own", F.col("n") - F.size("shared")).where(F.col("own") <= spare)
    shared = written(shared, "shared")  # n-grams that another set has, rarest first
    discard(wanted, sets)
    prefix = F.slice("shared", F.lit(1), (spare + 1 - F.col("own")).cast("int"))
    signs = shared.select("node", "n", "own", F.explode(prefix).alias("s")).select("node", "n", "own", F.col("s.gram").alias("gram"))
    signs = written(signs, "signatures")

    hubs = signs.groupBy("gram").agg(F.min(F.struct("own", F.negative("n").alias("less"), "node")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    hubs = hubs.select("gram", F.col("hub.node").alias("hub"), (-F.col("hub.less")).alias("hub_n"))
    star = signs.join(hubs, "gram")
    star = written(star, "stars")
    discard(signs)
    pairs = star.where((F.col("node") != F.col("hub")) & _near_size(F.col("n"), F.col("hub_n"), percent))
    pairs = pairs.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.first("hub_n").alias("n_a"), F.first("n").alias("n_b"))
    cut = (
        shared.select("node", F.explode("shared.gram").alias("gram"))
        .groupBy("node", F.pmod(F.shiftrightunsigned("gram", 32), F.lit(FRAGMENTS)).cast("int").alias("fragment"))
        .agg(F.collect_list("gram").alias("grams"))
    )
    pairs = written(pairs, "pairs")
    cut = written(cut, "fragments")
    common = overlaps(pairs.select("a", "b"), cut)
    links = common.join(pairs, ["a", "b"]).where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")
    links = written(links, "links")
    discard(pairs, cut)

    # A set's label: the smallest hub that it is linked with, or itself. Sets of one label are of one component.
    label = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    label = written(label, "hub-labels")
    rest = star.where(F.col("node") != F.col("hub")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_groups = rest.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("least")).where("low <> high").select("gram", "least")
    unsettled = written(rest.join(open_groups, "gram").select("gram", "node", "n", "label", "least"), "unsettled")
    discard(star, label)
    if not unsettled.isEmpty():
        members = unsettled_members(unsettled, family)
        more = compare_in_blocks(members, shared.select("node", F.col("shared.gram").alias("grams")), percent)
        links, few = written(links.unionByName(more), "links"), links
        discard(few)
    discard(shared, unsettled)

    if links.isEmpty():
        merged = classes.select("node", F.col("first").alias("component_id"))
    else:
        joined = classes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
        merged = joined.select("node", "label").join(smallest, "label").select("node", "component_id")
    linked = rows.where("n > 0").join(merged, "node").select("doc_id", "node", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", "node", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are linked, over any number of links, with one of a smaller id.

    Ids are expected to be unique: rows of one id stay or go together. Rows without an id stay.
    """
    gone = written(ngram_components(docs, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "linked")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
