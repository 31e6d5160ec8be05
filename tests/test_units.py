"""Units of texts against a row-by-row version, and what the steps write on the way."""

import math
import random
import re

import pytest

from brindle.operators import chains as C
from brindle.operators import units as U

LIMIT = 5


def plain_units(text):
    """Units of a text of paragraphs without full stops: each paragraph is one sentence."""
    out, signs = [], LIMIT * 4
    for p in re.split(r"\n[ \t]*\n", text or ""):
        p = p.strip(" \t\n\x0b\f\r")
        if not p:
            continue
        if len(p) <= signs:
            out.append(p)
            continue
        run = ""
        for word in re.split(r"[ \t\n\x0b\f\r]+", p):
            for piece in [word[i : i + signs] for i in range(0, len(word), signs)]:
                if run and len(run) + 1 + len(piece) > signs:
                    out.append(run)
                    run = piece
                else:
                    run = f"{run} {piece}" if run else piece
        out.append(run)
    return out


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abé漢𝔸") * rng.choice([1, 2, 3, 7, 18, 19, 20, 21, 39, 40, 41, 65])
    made = ["".join(word() + rng.choice([" ", "  ", "\n", "\t", "\n\n", " ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return [*made, "", None, " \n\n ", "x" * 20, "x" * 21, "x" * 400]


@pytest.fixture
def tables(monkeypatch):
    """The columns of each table that the steps write, by its name."""
    seen = []
    for module in (U, C):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: seen.append((name, df.columns)) or write(df, name))
    return seen


def test_units_equal_the_plain_version_and_no_text_is_written(spark, tables):
    rows = list(enumerate(texts()))
    out = U.text_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), LIMIT).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.n)):
        got.setdefault(r.doc_id, []).append((r.n, r.text, r.tokens))
    for i, text in rows:
        assert got.get(i, []) == [(n, u, math.ceil(len(u) / 4)) for n, u in enumerate(plain_units(text), 1)], text
    assert all("text" not in columns and "t" not in columns and "s" not in columns for _, columns in tables)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a one\n\na two"), (2, "alone"), (1, "b one"), (None, "none")]
    out = U.text_units(spark.createDataFrame(rows, "doc_id long, text string"), LIMIT).collect()
    assert sorted((r.doc_id, r.n) for r in out) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert [r.text for r in out if (r.doc_id, r.n) == (1, 3)] == ["a two"]


def test_windows_of_short_texts_need_one_table_of_sizes(spark, tables):
    units = spark.createDataFrame([(d, n, "x", 3) for d in range(9) for n in range(1, 8)], "doc_id int, n int, text string, tokens int")
    out = U.token_windows(units, 10).collect()
    assert len(out) == 63 and all(r.window == (r.n - 1) // 3 for r in out)
    assert [name for name, _ in tables] == ["unit-sizes", "long-keys"]


def test_long_keys_go_by_pointers_and_short_ones_do_not(spark, tables):
    sizes = {k: [random.Random(k).choice([0, 1, 20, 59, 60, 61, 300, None]) for _ in range(3 + 5 * k)] for k in range(8)}
    rows = [(k, i, s) for k, own in sizes.items() for i, s in enumerate(own)] + [(None, i, 25) for i in range(5)]
    out = C.packed_batches(spark.createDataFrame(rows, "k int, i int, s int").repartition(3), "k", "i", "s", 60, most=20).collect()
    got = {(r.k, r.i): r.batch for r in out}
    assert len(out) == len(rows)
    for k, own in sizes.items():
        batch = used = 0
        for i, n in enumerate(own):
            if used and used + (n or 0) > 60:
                batch, used = batch + 1, 0
            used += n or 0
            assert got[k, i] == batch, (k, i)
    assert [got[None, i] for i in range(5)] == [0, 0, 1, 1, 2]
    assert "pointers" in [name for name, _ in tables]
