"""The corpus pipeline against a plain version of each stage, from documents to packed pieces."""

import math
import random
import re

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from brindle.llm.decontamination import MAX_RATE, edit_distance_within, normal
from brindle.llm.quality import BUCKETS, MAX_REPEAT_PERCENT, MIN_WORDS, TAIL, THRESHOLD, WINDOW

from .test_decontamination import edited
from .test_ngram_join import brute
from .test_packing import check
from .test_rules_and_scans import plain_line_dedup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(word):
    whole = xxhash.xxh64_intdigest(word.encode(), 42)
    tail = xxhash.xxh64_intdigest(b"\0" * 4, xxhash.xxh64_intdigest(word[-TAIL:].encode(), 42))
    return [(x - (1 << 64) * (x >> 63)) % BUCKETS for x in (whole, tail)]


def plain_quality(rows, good):
    raw, top = [0] * BUCKETS, [0] * BUCKETS
    for d, t in rows:
        for w in words_of(t):
            for g in grams(w):
                raw[g] += 1
                top[g] += d in good
    weight = [math.log((a + 1) / (sum(top) + BUCKETS)) - math.log((b + 1) / (sum(raw) + BUCKETS)) for a, b in zip(top, raw, strict=True)]
    kept = []
    for d, t in rows:
        w = words_of(t)
        windows = [tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1)]
        twice = {x for i, x in enumerate(windows) if x in windows[:i]}
        repeat = len({i + k for i, x in enumerate(windows) if x in twice for k in range(WINDOW)})
        if len(w) >= MIN_WORDS and 100 * repeat <= MAX_REPEAT_PERCENT * len(w) and sum(weight[g] for x in w for g in grams(x)) / (2 * len(w)) >= THRESHOLD:
            kept.append((d, t))
    return kept


def plain_one_of_each(rows):
    own = {d for d, _, component in brute(rows) if d == component}
    return [(d, t) for d, t in rows if d in own]


def plain_decontamination(rows, items):
    held = lambda t, i: edit_distance_within(normal(i.encode()), normal(t.encode()))[0] <= int(len(normal(i.encode())) * MAX_RATE)
    return [(d, t) for d, t in rows if not any(held(t, i) for i in items)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_stage_equals_its_plain_version(spark, tmp_path, seed):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(seed)
    make = lambda n, signs: ["".join(rng.choice(signs) for _ in range(rng.randint(2, 9))) for _ in range(n)]
    vocab, noise = make(900, "abcdefghilmnoprstu"), make(60, "jkqvwxyz")
    line = lambda words=vocab: " ".join(rng.choice(words) for _ in range(rng.randint(4, 12)))
    body = lambda n, words=vocab: [line(words) for _ in range(n)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 40))) for _ in range(6)]
    passages = [body(rng.randint(2, 14)) for _ in range(5)]
    texts = [body(rng.randint(2, 12)) for _ in range(60)]
    texts += [body(3) + passages[i % 5] + body(rng.randint(0, 4)) for i in range(25)]
    texts += [body(2) + [edited(rng, items[i % 6], i % 3 * 3)] + body(2) for i in range(12)]
    texts += [body(rng.randint(2, 6), noise) for _ in range(12)] + [["few words"], [line()] * 8]
    long_lines = [" ".join(body(9)) for _ in range(4)]  # copies with another word survive the line stage
    texts += [[t.replace(t.split()[k], rng.choice(vocab), 1)] for t in long_lines for k in (3, 40, 44)] + [[t] for t in long_lines]
    rng.shuffle(texts)
    rows = [(10 * i, "\n".join(t)) for i, t in enumerate(texts)] + [(5, None), (7, "")]
    good = {d for d, t in rows if t and not set(t.split()) & set(noise)}
    good = set(rng.sample(sorted(good), len(good) * 9 // 10))

    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in good] + [(d, 0, 0) for d, _ in rows if d not in good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    plain = [
        lambda r: plain_quality(r, good),
        lambda r: sorted(plain_line_dedup(r).items()),
        plain_one_of_each,
        lambda r: plain_decontamination(r, items),
    ]
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for k, ((name, stage), rule) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=False)):
        before, want = want, rule(want)
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        assert sorted(want) != sorted(before, key=lambda r: r[0]), f"{name} has nothing to do"
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen, _ = check(corpus_pipeline.run(spark, str(tmp_path)).collect(), dict(want), tokenizer, 1024)
    assert set(seen) == {d for d, _ in want}
