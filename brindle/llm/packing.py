"""Operator 8: sum-of-squares online packing of token sequences.

Documents are cut into full sequences and a remainder. Each remainder goes to the open sequence whose fill level,
of all levels with room, makes the sum of squares of the numbers of open sequences at each level smallest; the
levels are counted in an array. Every Spark partition packs its own stream of remainders.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written

#: Production parameters. A stream of ``STREAM_ROWS`` remainders leaves at most about ``LENGTH`` open sequences.
LENGTH = 1024
STREAM_ROWS = 200_000
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: The cut of byte-level vocabularies of this kind into words, which the vocabulary's file names but does not spell out.
WORD = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space that the faster library may meet.
LONGEST_RUN = 20_000
LONG_RUN = re.compile(r"\s{%d}" % LONGEST_RUN)


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in such a file: itself if it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """Ids of whole texts from a tokenizers file, as its own library gives them.

    A byte-level vocabulary whose merges stand in the order of their ids is encoded by the faster of two equal
    libraries; any other file by its own. A string of a special token in a text is that token: it parts the text, and
    both sides are encoded for themselves. With ``plain`` such strings are ordinary text.

    The faster library looks ahead from each sign of a run of white space and ends the process on very long runs
    (700,000 blanks), so a text with a run beyond ``LONGEST_RUN`` goes to the file's own library.
    """

    def __init__(self, path: str, plain: bool = False):
        self.path, self.plain = path, plain
        self.own = None
        self.ranked = self._ranked(path)

    @property
    def tokenizer(self):
        """The file's own library, read when it is first needed."""
        if self.own is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
            self.own.encode_special_tokens = self.plain
        return self.own

    def _ranked(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
            return None
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            return None
        self.special = {t["content"]: int(t["id"]) for t in added}
        self.parts = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if added and not self.plain else None
        vocab = self.vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [vocab.get(a + b) for a, b in pairs]
        if len(vocab) != 256 + len(merged) or any(m is None for m in merged) or merged != sorted(merged) or max(vocab[s] for s in _byte_signs()) >= merged[0]:
            return None
        import tiktoken

        signs = _byte_signs()
        ranks = {bytes(signs[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if len(text) >= LONGEST_RUN and LONG_RUN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.parts is None or not self.parts.search(text):
            return self.ranked.encode_ordinary(text)
        ids: list[int] = []
        for part in self.parts.split(text):
            ids += [self.special[part]] if part in self.special else self.ranked.encode_ordinary(part)
        return ids

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self._ids(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [np.array(i, dtype="<u4").tobytes() for i in self.ids(texts)]

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of each id of a byte-level file."""
        signs = _byte_signs()
        vocab = json.loads(self.tokenizer.to_str())["model"]["vocab"] if self.ranked is None else self.vocab
        return {v: bytes(signs[c] for c in k) for k, v in vocab.items() if all(c in signs for c in k)}


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, plain: bool = False) -> TextEncoder:
    """The encoder of a file, one for each Python worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = TextEncoder(path, plain)
    return _encoders[path, plain]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut at multiples of ``length``, each with its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        encode, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                for doc, data in zip(ids[lo : lo + 256], encode([t or "" for t in texts[lo : lo + 256]]), strict=True):
                    view = memoryview(data + end)
                    n = len(view) // 4
                    rows += [(doc, s, min(length, n - s), zlib.crc32(view[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECES, strict=True)] if rows else [pa.array([], t.type) for t in PIECES], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def place_all(sizes: Iterable[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (all below ``length``), in order, by the sum-of-squares rule; ties: the fullest level."""
    counts = np.zeros(length + 1, dtype=np.int64)  # open bins by level; a full bin is closed, level 0 is a new bin
    stacks: dict[int, list[int]] = defaultdict(list)
    bins, offsets, made = [], [], 0
    for size in sizes:
        room = length - size
        # Moving a bin from level h to h + size changes the sum of squares by 2 * (N[h + size] - N[h] + 1); leaving
        # level 0 or reaching the full level costs nothing at that end.
        gain = counts[size:length].copy()  # h = 0 .. room - 1 -> N[h + size]
        change = np.empty(room + 1)
        change[:room] = 2 * (gain - counts[:room]) + 2
        change[0] = 2 * gain[0] + 1 if room else 0
        if room:
            change[room] = 1 - 2 * counts[room]
        open_levels = counts[: room + 1] > 0
        open_levels[0] = True
        change[~open_levels] = np.inf
        level = room - int(np.argmin(change[::-1]))
        if level:
            which = stacks[level].pop()
            counts[level] -= 1
        else:
            which, made = made, made + 1
        bins.append(which)
        offsets.append(level)
        if level + size < length:
            counts[level + size] += 1
            stacks[level + size].append(which)
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(cut: DataFrame, rows: int, length: int = LENGTH, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``rows``: about the number of pieces, which sets the number of streams.

    Pieces are dealt to streams by a hash of (doc_id, start, ids_crc32) and placed in the order of that hash, so that a
    task that runs again gives the same rows.
    """
    streams = max(1, -(-rows // stream_rows))
    dealt = F.xxhash64("doc_id", "start", "ids_crc32")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # one stream: about `stream_rows` narrow rows
        if not parts:
            return
        whole = pd.concat(parts, ignore_index=True)
        for stream, part in whole.groupby("_stream", sort=True):
            full = (part["length"] == length).to_numpy()
            bins, offsets = place_all(part["length"][~full].tolist(), length)
            used = int(bins.max()) + 1 if len(bins) else 0
            part = part.assign(sequence_id=np.int64(0), offset=np.int64(0))
            part.loc[~full, "sequence_id"] = bins
            part.loc[~full, "offset"] = offsets
            part.loc[full, "sequence_id"] = used + np.arange(int(full.sum()))
            part["sequence_id"] += np.int64(stream) << 40
            yield part[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return (
        cut.withColumn("_order", dealt)
        .withColumn("_stream", F.pmod("_order", F.lit(streams)).cast("int"))
        .repartition(streams, "_stream")
        .sortWithinPartitions("_stream", "_order", "doc_id", "start", "doc_tokens")
        .mapInPandas(place, PACKED)
    )


def sequence_packing(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``length`` ids.

    A null or empty text is its end id alone. Repeated rows are each packed. Of sequences that fit a piece equally well
    the fullest is taken, and of these the one filled last; pieces alike in every column are placed in either order,
    which cannot be told apart. Other columns of ``docs`` are not read. An empty table gives no rows. A null
    ``doc_id`` stays null.
    """
    cut = written(pieces(docs, tokenizer_path, length), "pieces")
    return pack(cut, cut.count(), length, stream_rows)


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing(read(spark, sf_dir, "documents"))
