"""Alignment of two tokenizers against a plain version that looks at every pair of tokens."""

import hashlib
import json
import pickle
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm.alignment import Aligner, bundles, op12_tokenizer_alignment, tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        with open(A, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.a_bytes = {i: bytes(sign[c] for c in t) for t, i in vocab.items() if all(c in sign for c in t)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        """[(id, begin, end)] of both sides; none if the bytes differ."""
        if not text:
            return [], []
        out = []
        for ids, what in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.__getitem__), (self.b.encode(text), self.piece)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(what(i))))
                at = own[-1][2]
            if b"".join(map(what, ids)) != (" " + text).encode():
                return [], []
            out.append(own)
        return tuple(out)

    def rows(self, texts):
        found = []
        for text in texts:
            a, b = self.tokens(text)
            ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups, lo = [], 0
            for end in ends:
                side = [",".join(str(i) for i, s, e in t if lo <= s and e <= end) for t in (a, b)]
                groups.append("|".join(side))
                lo = end
            links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
            found.append((len(a), len(b), groups, links))
        n = Counter(x for f in found for x in f[3])
        best = Counter()
        for (_, j), c in n.items():
            best[j] = max(best[j], c)
        return [(na, nb, len(g), len(x), sum(n[p] == best[p[1]] for p in x), sum(n[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, x in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts_of_all_kinds():
    rng = random.Random(12)
    signs = [" ", "  ", "\t", "\n", "\r\n", "\r", "a", "word", "Zürich", "é", "字", "かな", "😀", "👩‍👩‍👧", ".", ",", "';", ");\r", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "1234", "'s", "\x00", "\x1c", " ", "　", "́", " ", "#"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    out += ["the same words again and again " * 20, "a" * 300, " " * 200, "\n" * 50, " lead and trail ", "▁", "with ▁ inside", "x", " ", "\n", None, ""]
    return out


def test_every_column_equals_the_plain_version(spark):
    texts = texts_of_all_kinds()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(3)
    out, pairs = tokenizer_alignment(docs, size=700)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    want = dict(enumerate(Plain().rows(texts)))
    assert got == want
    assert got[texts.index("▁")] == EMPTY and got[texts.index(None)] == EMPTY and got[texts.index("")] == EMPTY
    assert pairs.agg({"n": "sum"}).first()[0] == sum(w[3] for w in want.values())


def test_query_over_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").toPandas()
    rows = docs.head(60)
    out = tokenizer_alignment(spark.createDataFrame(rows[["doc_id", "text"]], "doc_id long, text string"))[0].toPandas().set_index("doc_id")
    want = Plain().rows(rows["text"].tolist())
    assert [tuple(out.loc[i, COLUMNS]) for i in rows["doc_id"]] == want
    whole = op12_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert whole.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert set(COLUMNS) < set(whole.columns)


def test_repeats_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three"), (2, None)], "doc_id long, text string")
    out = tokenizer_alignment(docs)[0].collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_a) for r in out) == [(False, 1, 2), (False, 1, 2), (False, 2, 0), (True, 0, 1)]
    assert {r.count_sum for r in out if r.doc_id == 1} == {4}
    out, pairs = tokenizer_alignment(docs.where("false"))
    assert out.collect() == [] and pairs.collect() == []


@pytest.mark.parametrize("text", [" " * 300_000 + "x", "a" * 300_000, "x\n" * 100_000])
def test_very_long_texts(spark, text):
    row = tokenizer_alignment(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    p = Plain()
    assert (row.n_a, row.n_b) == (len(p.a.encode(" " + text, add_special_tokens=False).ids), len(p.b.encode(text)))
    assert row.n_links >= max(row.n_a, row.n_b) and row.n_best <= row.n_links


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr("brindle.llm.alignment.REMEMBERED", 5)
    align = Aligner(A, B)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(3):
        rows.append([[align.links.groups[i] for i in own] for own in align.numbered(words)])
        assert len(align.places) == len(align.links.groups) <= 40
    assert rows[0] == rows[1] == rows[2]


def test_stretches_that_do_not_give_their_bytes_back():
    align = Aligner(A, B)
    stretches = [" one", " ▁two", " three", " f▁ur ", " five"]
    out = align.align(stretches)
    assert out.fine.tolist() == [True, False, True, False, True]
    assert [c[0] > 0 for c in out.counts.tolist()] == out.fine.tolist()


def test_rows_that_are_written_hold_one_document(spark):
    # Rows of whole bundles grew with a task's share of the input, in the heap of what writes, reads and shuffles them.
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = bundles(docs).collect()
    assert len({r.bundle for r in made}) == 1
    own = sorted((r.doc_id, len(pickle.dumps(list((r.asDict() | {"pairs": None, "totals": None}).values())))) for r in made)
    assert [i for i, _ in own] == list(range(3000)) and max(n for _, n in own) < 5000
    assert sum(r.pairs is not None for r in made) == 1


def test_large_ids_beside_null_ids_and_texts_without_tokens(spark):
    big = (1 << 62) + 1
    docs = spark.createDataFrame([(big, "one two one"), (None, "one"), (big + 1, "▁"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in tokenizer_alignment(docs)[0].collect()}
    want = Plain().rows(["one two one", "one", "▁", None])
    assert out == dict(zip([big, None, big + 1, big + 2], want, strict=True))
