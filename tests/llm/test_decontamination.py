"""Benchmark decontamination against planted and brute-force searched items."""

import random

import numpy as np
import pytest

from brindle.llm.decontamination import build_index, contaminated, edit_distance_within, normal, search, without_contaminated

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def edited(rng, text, edits, kinds=(0, 1, 2)):
    out = list(text)
    for _ in range(edits):
        p = rng.randrange(len(out))
        kind = rng.choice(kinds)
        if kind == 0:
            out[p] = rng.choice("xyz")
        elif kind == 1:
            out.insert(p, rng.choice("xyz"))
        elif len(out) > 1:
            del out[p]
    return "".join(out)


def table(rng, item, region):
    best = list(range(len(item) + 1))
    low = best[-1]
    for c in region:
        row = [0]
        for i, x in enumerate(item, 1):
            row.append(min(row[-1] + 1, best[i] + 1, best[i - 1] + (x != c)))
        best = row
        low = min(low, best[-1])
    return low


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        region = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
        assert edit_distance_within(item, region)[0] == table(rng, item, region)


def test_recall_of_edited_copies_against_brute_force():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.randint(14, 60)))) for i in range(60)]
    docs = []
    for d in range(400):
        body = words(rng, rng.randint(5, 300))
        if d % 2:
            text = items[d % 60][1]
            body[len(body) // 2 : len(body) // 2] = [edited(rng, text, int(len(text) * rng.choice([0, 0.01, 0.03, 0.06])))]
        docs.append(normal(" ".join(body).encode()))
    index = build_index([(i, normal(t.encode())) for i, t in items])
    got = {(d, index.items[i][0]): dist for d, i, dist in search(docs, index)}
    truth = {}
    for d, text in enumerate(docs):
        for i, t in items if d % 2 == 0 and d < 40 else [items[d % 60]]:
            low, _ = edit_distance_within(normal(t.encode()), text)
            if low <= int(len(t) * 0.2):
                truth[d, i] = low
    assert set(got) <= set(truth) | {k for k in got if k not in truth and k[0] % 2}
    assert all(got[k] == truth[k] for k in got if k in truth and truth[k] == 0)
    assert len(set(got) & set(truth)) >= 0.97 * len(truth)
    exact = {k for k, v in truth.items() if v == 0}
    assert exact <= set(got)


def test_recall_up_to_the_allowed_edits():
    rng = random.Random(21)
    items = [(i, normal(" ".join(words(rng, rng.randint(14, 60))).encode())) for i in range(100)]
    index = build_index(items)
    for rate in (0.05, 0.1, 0.15, 0.2):
        docs = []
        for _, t in items:
            parts = [*words(rng, 40), edited(rng, t.decode(), int(len(t) * rate)), *words(rng, 40)]
            docs.append(normal(" ".join(parts).encode()))
        found = {(d, i) for d, i, _ in search(docs, index)}
        assert sum((d, d) in found for d in range(100)) >= 95
        assert all(edit_distance_within(items[i][1], docs[d])[0] <= int(len(items[i][1]) * 0.2) for d, i in found)


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,)], ids=["substitutions", "insertions", "deletions"])
@pytest.mark.parametrize("size", [100, 200, 400, 1000, 2000])
def test_recall_for_edits_of_one_kind(kinds, size):
    rng = random.Random(size)
    items = [(i, normal(" ".join(words(rng, size // 5))[:size].encode())) for i in range(40)]
    index = build_index(items)
    for rate in (0.05, 0.1, 0.15, 0.19):
        docs = [normal(" ".join([*words(rng, 40), edited(rng, t.decode(), int(len(t) * rate), kinds), *words(rng, 40)]).encode()) for _, t in items]
        within = {d for d, (_, t) in enumerate(items) if edit_distance_within(t, docs[d])[0] <= int(len(t) * 0.2)}
        found = {(d, i) for d, i, _ in search(docs, index)}
        assert len(within) > 30 and sum((d, d) in found for d in within) >= 0.9 * len(within), (rate, sum((d, d) in found for d in within), len(within))


def test_short_items_are_all_found():
    rng = random.Random(4)
    sizes = [1, 3, 5, 9, 12, 16, 20, 25, 30, 40, 50, 60, 70, 79] * 4
    items = [(k, normal("".join(rng.choice("abcdefgh ") if 0 < j < n - 1 else "q" for j in range(n)).encode())) for k, n in enumerate(sizes)]
    texts = []
    for k, (_, t) in enumerate(items):
        copy = edited(rng, t.decode(), int(len(t) * 0.2)) if k % 2 else t.decode()
        texts.append(normal(" ".join([*words(rng, 9), copy, *words(rng, 9)]).encode()))
    got = {(d, i): x for d, i, x in search(texts, build_index(items))}
    for d, text in enumerate(texts):
        for i, t in items:
            low = table(rng, t, text)
            assert got.get((d, i)) == (low if low <= int(len(t) * 0.2) else None)


def test_result_does_not_depend_on_neighbours():
    rng = random.Random(8)
    items = [(i, normal(" ".join(words(rng, 30)).encode())) for i in range(10)]
    docs = [normal(" ".join([*words(rng, 7), edited(rng, items[i % 10][1].decode(), 12), *words(rng, 9)]).encode()) for i in range(40)]
    index = build_index(items)
    alone = [(d, i, x) for d, t in enumerate(docs) for _, i, x in search([t], index)]
    assert sorted(alone) == sorted(search(docs, index))


def test_tables(spark):
    rng = random.Random(9)
    item = " ".join(words(rng, 20))
    rows = [(1, f"Before it. {item.upper()}! After."), (2, " ".join(words(rng, 50))), (3, None), (4, ""), (None, item), (5, "x " * 20000 + item), (6, item.replace(" ", ",\n"))]
    docs = spark.createDataFrame([(*r, "a") for r in rows], DOCS + ", item_id string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "...")], ITEMS)
    got = sorted((tuple(r)[:3] for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(d, 7, 0) for d in (1, 5, 6, None) for _ in range(2)], key=str)
    many = contaminated(docs, bench, block_items=1)
    assert sorted((tuple(r)[:3] for r in many.collect()), key=str) == got
    assert sorted(r.doc_id or 0 for r in without_contaminated(docs, bench).collect()) == [0, 2, 3, 4]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_covered_bytes_of_all_places_are_counted_at_once(monkeypatch):
    rng = random.Random(6)
    items = [(i, normal(" ".join(words(rng, 30)).encode())) for i in range(5)]
    grams = build_index(items).grams[0]
    inside = np.array([rng.randrange(60) for _ in range(400)])
    begin = np.array([rng.randrange(390) for _ in range(150)])
    end = np.array([rng.randint(b + 1, 400) for b in begin])
    plain = []
    for lo, hi in zip(begin, end):
        at = np.sort(inside[lo:hi])
        plain.append(grams.size + int(np.minimum(grams.size, np.diff(at)).sum()))
    for most in (1, 700, 500_000):
        assert grams._distinct(inside, begin, end, most).tolist() == plain
    assert grams._distinct(inside, begin[:0], end[:0]).tolist() == []
    # A text that repeats halves of items gives many places to count; the number of sorts does not follow them.
    halves = [t[: len(t) // 4] for _, t in items]
    text = b" ".join(rng.choice(halves) for _ in range(2000))
    calls, real = [], np.sort
    monkeypatch.setattr(np, "sort", lambda *a, **k: calls.append(1) or real(*a, **k))
    list(search([text], build_index(items)))
    assert len(calls) < 100
