"""The text index: whole results whatever the blocks, shards and folders, and blocks that are not looked at."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.functions.text import tokens
from brindle.operators import text_index as X


def plain(docs, queries, k, k1=1.5, b=0.75, probabilistic=False):
    cut = lambda t: [w for w in re.findall(r"[a-z]+|[0-9]+", (t or "").lower()) if len(w) > 1 or w.isdigit()]
    bags = [(i, Counter(cut(t))) for i, t in docs if i is not None]
    n, mean = len(bags), sum(sum(c.values()) for _, c in bags) / max(1, len(bags))
    df = Counter(w for _, c in bags for w in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in bags:
            s = 0.0
            for w in dict.fromkeys(cut(text)):
                if c[w]:
                    idf = math.log(1 + ((n - df[w] + 0.5) / (df[w] + 0.5) if probabilistic else n / df[w]))
                    s += idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean))
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(41)
    docs = [(i, zipf(rng, rng.choice([3, 20, 60, 200]))) for i in range(900)]
    docs += [(900 + i, docs[i][1]) for i in range(40)] + [(990, None), (991, ""), (None, "w1 w2"), (3, "w1 twice the id")]
    queries = [(q, " ".join(rng.sample(docs[rng.randrange(900)][1].split(), 3)) + " w1") for q in range(25)] + [(77, "nowhere"), (78, ""), (79, None)]
    return docs, queries


@pytest.mark.parametrize(("shard_docs", "words", "most"), [(65_536, 4_000_000, 20_000), (50, 700, 6)])
def test_search_is_whole(spark, corpus, tmp_path, monkeypatch, shard_docs, words, most):
    for m in ("SHARD_DOCS", "SHARD_WORDS"):
        monkeypatch.setattr(X, m, {"SHARD_DOCS": shard_docs, "SHARD_WORDS": words}[m])
    docs, queries = corpus
    index = X.build(spark.createDataFrame(docs, "id long, text string").repartition(3), f"file://{tmp_path}/index")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for k, options in ((3, {}), (40, {"k1": 1.2, "probabilistic": True})):
        got = X.search(index, asked, k, most_words=most, **options).select("query_id", "id", "score", "rank").collect()
        want = plain(docs, queries, k, **options)
        assert [(r[0], r[1], r[3]) for r in sorted(map(tuple, got), key=lambda r: (r[0], r[3]))] == [(r[0], r[1], r[3]) for r in sorted(want, key=lambda r: (r[0], r[3]))]
        assert max(abs(a[2] - b[2]) for a, b in zip(sorted(map(tuple, got)), want, strict=True)) < 2e-6
    counts = Counter(w for i, t in docs if i is not None for w in set(re.findall(r"[a-z]+|[0-9]+", (t or "").lower())) if len(w) > 1 or w.isdigit())
    assert {r.term: r.df for r in index.terms.collect()} == counts


def test_blocks_are_skipped(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, zipf(rng, 30)) for i in range(20_000)], "id long, text string").coalesce(1)
    index = X.build(docs, f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(q, f"w{200 + 17 * q} w{2 + q} w1") for q in range(30)], "query_id long, text string")
    row = X.search(index, queries, 5, report=True).agg(F.sum("scored"), F.sum("held")).first()
    assert row[0] < 0.5 * row[1], tuple(row)
    assert X.search(index, queries, 5).groupBy("query_id").count().where("count != 5").count() == 0


def test_an_index_is_written_once_for_the_files_as_they_are(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "one word"), (2, "two words")], "id long, text string").write.parquet(path)
    first = X.kept(spark.read.parquet(path), "docs")
    assert X.kept(spark.read.parquet(path), "docs").path == first.path and first.size == (2, 2.0)
    assert X.kept(spark.read.parquet(path), "other").path != first.path
    spark.createDataFrame([(3, "three")], "id long, text string").write.mode("append").parquet(path)
    second = X.kept(spark.read.parquet(path), "docs")
    assert second.path != first.path and second.size[0] == 3
    q = spark.createDataFrame([(1, "three")], "query_id long, text string")
    assert [r.id for r in X.search(second, q, 3).collect()] == [3] and X.search(first, q, 3).count() == 0


def test_words_are_those_of_the_folded_text(spark):
    cases = ["Straße ÉTÉ naïve", "ß", "x² ½ ①", "ﬁne Ǆ", "ＡＢ１２", "がガ ゟ 漢字", "한글 a 1", "été", "İstanbul ıx", "don't", "ªº ok", None, "😀 ab"]
    want = [["strasse", "ete", "naive"], ["ss"], ["2", "1", "2"], ["fine", "dz"], ["ab", "12"], None, ["한글", "1"], ["ete"], None, ["don"], ["ao", "ok"], [], ["ab"]]
    got = [r.t for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(tokens(F.col("c")).alias("t")).collect()]
    for case, g, w in zip(cases, got, want, strict=True):
        assert w is None or g == w, (case, g)
