"""Exact top-k search and the filter audit against plain versions."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F


from brindle.llm.filter_audit import AUDIT, filter_audit, settled
from brindle.llm.topk import annuli, exact_topk, pick_pivots, prepared, quantised, wanted

VECTORS = "id long, vec array<long>"


def brute(rows, k=10, every=100):
    own = {}
    for i, v in rows:
        if i is not None and v is not None:
            own[i] = min(own.get(i, v), v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for q in own:
        if q % every == 0:
            best = sorted((-dot(own[q], v), i) for i, v in own.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, every=100, **options):
    return sorted(tuple(r) for r in exact_topk(df, F.col("id") % every == 0, **options).collect())


@pytest.mark.parametrize(("pivots", "annulus", "block"), [(1, 7, 5), (8, 16, 3), (40, 500, 1000)])
def test_topk_of_all_kinds_of_vectors(spark, pivots, annulus, block):
    rng = random.Random(pivots)
    rows = [(i, [rng.randint(-50, 50) for _ in range(6)]) for i in range(300)]
    rows += [(i, [rng.randint(-2, 2) * 10 for _ in range(2)] + [0] * 4) for i in range(300, 500)]  # many ties
    rows += [(i, [7, 7, 7, 0, 0, 1]) for i in range(500, 900)]  # a group of equal vectors, with queries in it
    rows += [(900, [0] * 6), (901, None), (None, [1] * 6), (902, [3, 4]), (1000, []), (903, [900, 0, 0, 0, 0, 0])]
    rows += [(5, [99, 0, 0, 0, 0, 0]), (7, rows[7][1]), (100, rows[100][1])]  # ids that come again
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", score string").repartition(3)
    assert found(df, pivots=pivots, annulus=annulus, block=block) == brute(rows)


def test_few_rows_empty_tables_and_no_queries(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5, -6])], VECTORS)
    assert found(df) == [(0, 1, 1, 11), (0, 2, 2, -7)]
    assert found(df.where("id > 0")) == [] and found(df.where("false")) == []
    assert found(df.where("id = 0")) == []
    assert found(spark.createDataFrame([(0, []), (1, [])], VECTORS)) == [(0, 1, 1, 0)]


def test_scores_beyond_doubles_are_exact(spark):
    big = 3_000_000_019
    rows = [(0, [big, 1]), (1, [big - 1, 3]), (2, [big - 1, 2]), (3, [-big, 0])]
    assert found(spark.createDataFrame(rows, VECTORS)) == [(0, 1, 1, big * (big - 1) + 3), (0, 2, 2, big * (big - 1) + 2), (0, 3, 3, -(2**63) if big * big > 2**63 else -big * big)]


def test_quantised_components(spark):
    df = spark.createDataFrame([(1, [0.5, -0.0005]), (2, [float("nan"), 1.0]), (3, [float("inf")]), (4, None), (5, [None, 1.0]), (6, [])], "i int, v array<float>")
    got = {r.i: r.q for r in df.select("i", quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_annuli_are_skipped_by_their_bounds_and_nothing_is_lost(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(20, size=4000)] + 0.05 * rng.normal(size=(4000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None]).astype(int))]
    df = spark.createDataFrame(rows, VECTORS)
    assert found(df, annulus=50) == brute(rows)
    own = prepared(df, F.col("id") % 100 == 0)
    spheres = pick_pivots(own, 20)
    index = annuli(own, spheres, 10, 50).toPandas()
    assert index["ids"].map(len).sum() // 8 == 4000 and (index["ids"].map(len) <= 400).all() and (index["lo"] <= index["hi"]).all()
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in index["q_ids"]])
    x = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 16) for x in index["q_rows"]]).astype(float)
    floors = np.concatenate([np.frombuffer(x) for x in index["q_floors"]])
    distance = spheres.distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
    need = np.array([wanted(distance[:, r.pivot], r.lo, r.hi, (x * x).sum(axis=1), spheres.longest, floors) for r in index.itertuples()])
    assert len(ids) == 40 and need.mean() < 0.5, need.mean()  # most annuli are skipped


# The audit


def plain_audit(docs, labels):
    letters = "ABCDE"
    marks = {}
    for doc, quality, toxic in labels:
        old = marks.get(doc, (False, False))
        marks[doc] = (old[0] or quality == 1, old[1] or toxic == 1)
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": doc is not None and first[text] < doc,
        }
        rows.append((lang or "", {f for f in letters if fails[f]}, *(marks.get(doc, (False, False)) if doc is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shares = dict.fromkeys(letters, 0)
        steps = []
        for order in permutations(letters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], shares[s[-1]]) for s in steps]
    return sorted(out)


def audit_documents():
    rng = random.Random(13)
    words = ["alpha", "Beta", "GAMMA", "dé", "x|y", "#1", "word", "\x85", "\xa0", "\x1c", "ok"]
    out = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "\x0b", " "]) for _ in range(rng.choice([0, 5, 99, 100, 140])))
        if rng.random() < 0.5:
            text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([99, 100, 101, 130])))
        out.append((i, text, rng.choice(["en", "de", None, ""])))
    out += [(1000 + i, out[i][1], rng.choice(["en", "fr"])) for i in range(0, 200, 3)]  # copies in other parts
    out += [(2000 + i, "the copy " * 60, "en") for i in range(150)]  # a large group
    out += [(3000, None, "en"), (3001, "", "de"), (3002, None, None), (None, "the copy " * 60, "en"), (None, "alone", "en"), (5, out[5][1], "en"), (5, out[5][1], "en"), (6, "another text of id 6", "de")]
    out += [(4000, "long " * 200_000, "es"), (4001, "long " * 200_000, "es")]
    return out


@pytest.mark.parametrize("held", [2000, 32 << 20])
def test_audit_equals_the_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr("brindle.llm.filter_audit.HELD_BYTES", held)
    docs = audit_documents()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 1100, 2)] + [(0, 1, 1), (1, None, 1), (77777, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, part int, mask string").repartition(5)
    out = filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == [c.split()[0] for c in AUDIT.split(", ")]
    assert sorted(tuple(r) for r in out.collect()) == plain_audit(docs, labels)


def test_equal_hashes_are_told_apart_by_the_text():
    rows = [(b"one", 3, [(3, "en", 0, 1)]), (b"two", 1, [(1, "en", 0, 1)]), (b"one", 2, [(2, "en", 0, 1)]), (None, None, [(9, "en", 16, 2)])]
    assert sorted(settled((7, r) for r in rows)) == [(1, "en", 0, 1), (2, "en", 0, 1), (3, "en", 16, 1), (9, "en", 16, 2)]


def test_empty_tables_have_no_part(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert filter_audit(one, labels).count() == 600
