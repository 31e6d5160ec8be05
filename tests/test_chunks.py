"""Chunks of texts with headings, long sentences and long words: Spark, its SQL, and what they say by hand."""

import random

import duckdb

from brindle.plans.registry import oracle_sql, queries

WORDS = "alpha Beta gamma, delta. Eps zeta! Theta iota <source x </Source kappa？ 東京 λόγος".split()


def texts(rng):
    for n in range(60):
        lines = []
        for _ in range(rng.randint(0, 25)):
            kind = rng.random()
            if kind < 0.2:
                lines.append("#" * rng.randint(1, 7) + " " + " ".join(rng.choices(WORDS, k=3)) + rng.choice(["", " ##", "  "]))
            elif kind < 0.35:
                lines += ["", rng.choice(["CHAPTER IV", "IV.", "=A Title=", "A short Title", "Title: none", "第3回 話", "no title"]), ""]
            elif kind < 0.5:
                lines.append(rng.choice(["", " ", "\t"]))
            else:
                words = rng.choices(WORDS, k=rng.choice([3, 40, 400]))
                words += ["x" * rng.choice([5, 1199, 1200, 1201, 5000])] * (rng.random() < 0.2)
                rng.shuffle(words)
                lines.append(rng.choice([" ", "　", " "]).join(words))
        yield n, "\n".join(lines)
    yield 100, None
    yield 101, ""
    yield 102, "# Only a heading"
    yield 103, "y" * 20_000
    yield 104, "# One\n\n" + "\n\n".join("Sentence number %d of many here." % i for i in range(900)) + "\n\n## Two\n\nend"


def chunks(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["X6_E8_chunked_documents"](spark, str(tmp_path))
    cols = ", ".join(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {cols} FROM ({oracle_sql()['X6_E8_chunked_documents']})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_chunks_equal_their_sql(spark, tmp_path):
    got, want = chunks(spark, tmp_path, list(texts(random.Random(4))))
    assert got == want
    assert len({r[0] for r in got}) > 50 and any(" > " in r[2] for r in got) and max(r[3] for r in got) > 3
    assert {r[0] for r in got}.isdisjoint({100, 101, 102})


def test_chunks_stay_in_bounds_and_overlap(spark, tmp_path):
    got, _ = chunks(spark, tmp_path, [(1, "# One\n\n" + "\n\n".join(f"Sentence number {i} of many." for i in range(600)))])
    assert [r[1] for r in got] == sorted(r[1] for r in got) and {r[1] for r in got} == set(range(max(r[1] for r in got) + 1))
    assert {r[2] for r in got} == {"One"} and all(r[4] <= 300 + 45 + 60 for r in got)
