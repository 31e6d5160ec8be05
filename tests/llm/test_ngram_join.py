"""N-gram Jaccard join against a brute-force version."""

import random
import re

import pyarrow as pa

from brindle.llm.ngram_join import gram_sets, ngram_components, one_of_each

DOCS = "doc_id long, text string"


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for g in s:
            for j in index[g]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, c in counts.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                label[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += family(rng, [word() for _ in range(100)], 90, 8) + family(rng, [word() for _ in range(33)], 40, 3)
    passage = [word() for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 60))]) for _ in range(50)]
    texts += [None, "", " \t\n", "one two", "ONE\x0btwo", "a b c d e", "A b  c d E", "é à ü ö ß", "one two three"] + texts[:10]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        got = ngram_components(spark.createDataFrame(rows, DOCS).repartition(5))
        assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    from brindle.llm import ngram_join

    monkeypatch.setattr(ngram_join.compare_in_blocks, "__defaults__", (75, 4))
    rows = rows_of(3)
    got = ngram_components(spark.createDataFrame(rows, DOCS), parts=7)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_large_families_and_few_fragments_lose_no_link(spark):
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(9000)}"
    rows = rows_of(5)
    chain = [word() for _ in range(80)]
    for i in range(60):  # each is linked with its neighbours only
        chain = chain[6:] + [word() for _ in range(6)]
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, t) for i, t in enumerate(family(rng, [word() for _ in range(120)], 60, 16))]
    rows.append((3000, " ".join(word() for _ in range(40_000))))
    rows.append((3001, rows[-1][1] + " end"))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute(rows)
    for most in (6, 10**6):
        got = ngram_components(docs, parts=2, family=most)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want


def test_nulls_repeats_and_other_columns(spark):
    text = "the same seven words are here twice"
    rows = [(None, text, "k"), (7, text, None), (7, text, None), (9, None, "x"), (None, None, None), (3, "", "y")]
    docs = spark.createDataFrame(rows, DOCS + ", node string")
    got = sorted((tuple(r) for r in ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (9, 0, 9), (None, 0, None), (3, 0, 3)], key=str)
    assert ngram_components(docs.limit(0)).count() == 0
    kept = one_of_each(spark.createDataFrame([(1, text, "a"), (2, text, "b"), (None, None, "c")], DOCS + ", source string"))
    assert sorted(r.source for r in kept.collect()) == ["a", "c"] and kept.columns == ["doc_id", "text", "source"]


def test_hashes_follow_words():
    a = [len(x) for x in gram_sets(pa.array(["a b c d e f", "A  b\nc d e f", None, "f e d c b a"]))]
    assert a == [2, 2, 0, 2]
    x, y, z = gram_sets(pa.array(["a b c d e", "\tA b c\rd e ", "ab c d e f"]))
    assert x.tolist() == y.tolist() != z.tolist()
