"""Sequence packing: ids, pieces and places against the tokenizers library and a brute-force placement."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm.packing import TextEncoder, place_all, sequence_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizers_library(tokenizer):
    rng = random.Random(4)
    signs = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​.,!?'\"-_#0123٣ⅷabcXYZßéÖÜñ中文字かな한글😀👩‍👩‍👧́\x00\x7f"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(60)) if not 0xD800 <= c <= 0xDFFF) for _ in range(500)]
    end = "<|endoftext|>"
    texts += [f"{end} and more", f"inside {end} of it", f"at the end {end}", end, end * 3, f"a{end}b {end}", f"  {end}  x\n{end}\n", "<|endoftext", "|endoftext|>", f"<|{end}"]
    texts += ["".join(rng.choice([end, " ", "word", "\n", "é", "<|", "  "]) for _ in range(9)) for _ in range(300)]
    texts += [ "it's we'll I'VE don't", "a" * 5000, " " * 3000, "\n" * 100 + "x", "word " * 500, ""]
    encode = TextEncoder(PATH)
    assert encode.ranked is not None
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want
    encode.ranked, encode.own = None, tokenizer
    assert encode(texts) == want


@pytest.mark.parametrize("sign", [" ", "\n", "a", "!", "7", "\u3000", "漢"])
def test_very_long_runs(tokenizer, sign):
    texts = [sign * 1_000_000, "x" + sign * 999_999 + "y", sign * 19_999 + "a", sign * 20_001]
    assert TextEncoder(PATH)(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_text_of_ten_million_blanks_is_packed(spark):
    text = " " * 10_000_000
    out = sequence_packing(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).where("doc_id = 1").agg({"length": "sum", "doc_tokens": "max"}).first()
    assert tuple(out) == (10_000_001, 10_000_001)


def rule(sizes, length):
    """The sum-of-squares rule, written down plainly."""
    levels, places = [], []
    for size in sizes:
        best = None
        for level in sorted({0, *levels}, reverse=True):
            if level + size > length:
                continue
            after = [x for x in levels]
            if level:
                after.remove(level)
            if level + size < length:
                after.append(level + size)
            cost = sum(after.count(x) ** 2 for x in set(after))
            if best is None or cost < best[0]:
                best = (cost, level, after)
        places.append(best[1])
        levels = best[2]
    return places


def test_places_follow_the_rule():
    rng = random.Random(6)
    for _ in range(30):
        length = rng.choice([5, 8, 16])
        sizes = [rng.randint(1, length - 1) for _ in range(60)]
        bins, offsets = place_all(sizes, length)
        assert offsets.tolist() == rule(sizes, length)
        fill = {}
        for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes, strict=True):
            assert fill.get(b, 0) == o and o + s <= length
            fill[b] = o + s


def check(rows, texts, tokenizer, length):
    seen = {}
    all_ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    for r in rows:
        ids = all_ids[r.doc_id]
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(all_ids[d])
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= length
    return seen, fill


def test_round_trip_and_little_padding(spark, tokenizer):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta,"]) for _ in range(rng.randint(0, 300))) for i in range(300)} | {900: None, 901: "", 902: "é " * 3000, 903: "before <|endoftext|> after <|endoftext|>", 904: "very long text " * 20_000}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, length string")
    rows = sequence_packing(docs, length=128, stream_rows=200).collect()
    seen, fill = check(rows, texts, tokenizer, 128)
    assert set(seen) == set(texts)
    assert sum(fill.values()) / (128 * len(fill)) > 0.9


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    rows = sequence_packing(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)] and len({r.sequence_id for r in rows}) == 1
    assert sequence_packing(docs.limit(0)).count() == 0
