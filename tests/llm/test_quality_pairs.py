"""Pairs of words in operator 1's likelihood ratio, against plain counts."""

import inspect
import math

from pyspark.sql import functions as F

from brindle.llm import quality as Q

BUCKETS = 97


def test_pairs_of_words_count_as_n_grams(spark):
    rows = [(i, " ".join("abcdefghij"[(i * 7 + k * (3 if i % 2 else 7)) % 10] * (1 + k % 4) for k in range(12 + i))) for i in range(20)] + [(50, "one"), (51, ""), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    words = {d: (t or "").split() for d, t in rows}
    pairs = sorted({(a, b) for w in words.values() for a, b in zip(w, w[1:] + [None], strict=False)}, key=str)
    hashed = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[g.alias(f"g{i}") for i, g in enumerate([*Q.word_grams(F.col("a"), BUCKETS), Q.pair_gram(F.col("a"), F.col("b"), BUCKETS)])]).collect()
    grams = {(r.a, r.b): [g for g in (r.g0, r.g1, r.g2) if g is not None] for r in hashed}
    own = {d: [g for p in zip(w, w[1:] + [None], strict=False) for g in grams[p]] for d, w in words.items()}
    assert len(own[0]) == 3 * len(words[0]) - 1
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for d, gs in own.items():
        for g in gs:
            raw[g] += 1
            good[g] += d < 12 and d % 2
    ratio = [math.log((good[b] + 1) / (sum(good) + BUCKETS)) - math.log((raw[b] + 1) / (sum(raw) + BUCKETS)) for b in range(BUCKETS)]
    got = {r.doc_id: r.llr for r in Q.quality_rules(docs, labels, buckets=BUCKETS, pairs=True).collect()}
    assert got.keys() == own.keys()
    for d, gs in own.items():
        assert abs(got[d] - (sum(ratio[g] for g in gs) / len(gs) if gs else 0.0)) < 1e-9
    alone = {r.doc_id: r.llr for r in Q.quality_rules(docs, labels, buckets=BUCKETS).collect()}
    assert any(abs(alone[d] - got[d]) > 1e-6 for d in got)
    assert "pairs=True" in inspect.getsource(Q.op1_quality_rules)
