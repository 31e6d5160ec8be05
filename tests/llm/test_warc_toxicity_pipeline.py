"""WARC round trip, toxicity on held-out rows, and the pipeline as a whole."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brindle.llm.toxicity import fit, toxicity_scores, train, training_rows
from brindle.llm.warc import EPOCH, ORDER, LoserTree, archive_round_trip, merge_histories, read_index, warc_date, write_archives

PAGES = "page_id long, url string, html string"


def test_loser_tree_merges():
    rng = random.Random(3)
    for k in range(0, 9):
        runs = [sorted((rng.randint(0, 20), i, j) for j in range(rng.randint(0, 7))) for i in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_give_back_what_was_written(spark):
    big = "é" * 80
    rows = [(5, "http://www.B.example.org:80/x?q=1#top", big), (2, "https://a.example.org/", big), (9, None, big), (1, "http://a.example.org", "small"), (3, "http://a.example.org", "small"), (4, "http://c.org/\r\nX: y", None), (6, "http://c.org", "a\r\n\r\nWARC/1.0\r\n\r\n" * 20), (7, "http://c.org", "\x00\n" * 200_000)]
    out = {r.page_id: r for r in archive_round_trip(spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", offset string")).collect()}
    assert set(out) == {r[0] for r in rows}
    for p, _, html in rows:
        data = (html or "").encode()
        r = out[p]
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 2) if html == big and p != 2 else ("response", None))
    order = sorted(out.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(rows)))
    assert [(r.url_key, r.page_id) for r in order] == sorted((r.url_key, r.page_id) for r in order)
    assert out[5].url_key == "org,example,b)/x?q=1" and out[9].url_key == ""
    assert archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_any_page_id_in_any_time_zone(spark):
    pages = [-(2**63), -1, 0, 26_431_199 - 1, 26_431_200 + 3600, 300_000_000_000, 2**63 - 1, None]  # about the hour that New York has twice
    rows = [(p, f"http://a.org/{i}", f"page {p}") for i, p in enumerate(pages)] + [(5, "http://same.org", "x" * 200)] * 7
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out = archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()
            assert sorted((str(r.page_id), r.payload_bytes) for r in out) == sorted((str(p), len(h)) for p, _, h in rows)
            order = sorted(out, key=lambda r: r.position)
            assert [r.position for r in order] == list(range(len(rows)))
            assert [r.url_key for r in order] == sorted(r.url_key for r in order)
            assert {r.ts - EPOCH for r in out if r.page_id in (0, 26_431_200 + 3600, 300_000_000_000)} == {0, 26_431_200 + 3600, 300_000_000_000}
            assert all(r.record_type == "response" and r.refers_to is None for r in out)
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    got = spark.createDataFrame([(s,) for s in (0, -1, EPOCH, 10**18, -(10**18))], "s long").select(warc_date(F.col("s"))).collect()
    assert [r[0] for r in got] == ["1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "2020-01-01T00:00:00Z", "9999-12-31T01:46:40Z", "0001-01-01T22:13:20Z"]


def test_histories_of_many_runs_and_ranges(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i if i % 50 else 7, f"http://{rng.choice('abc')}.org/{rng.randrange(4)}", f"text {i}") for i in range(400)]
    write_archives(spark.createDataFrame(rows, PAGES).repartition(5), f"{tmp_path}/archives", archive_bytes=200)
    index = read_index(spark, f"{tmp_path}/archives").repartition(9, "archive").drop("run", "at").sortWithinPartitions(*ORDER)
    index = index.withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    out = merge_histories(index, range_rows=30).collect()
    order = sorted(out, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(400))
    keys = [(r.url_key, r.ts, r.page_id, r.archive, r.offset) for r in order]
    assert keys == sorted(keys)


def test_toxicity_of_unseen_misspellings(spark):
    rng = random.Random(4)
    good = ["".join(rng.choice("abcdehilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zorkgruff", "vexblarg", "quzzknob", "jixwomp"]
    spell = lambda w: w[: (k := rng.randrange(1, len(w)))] + rng.choice("xyz*") + w[k:]
    rows = []
    for i in range(600):
        w = [rng.choice(good) for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [spell(b) if rng.random() < 0.5 else b for b in rng.sample(bad, 3)]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert (model.part == train(docs, labels).part).all()
    scores = {r.doc_id: r.score for r in toxicity_scores(docs, model).collect()}
    held = [(scores[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.9 * len(held)
    odd = toxicity_scores(spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None)], "doc_id long, text string"), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity_scores(docs.limit(0), model).count() == 0


def test_scores_against_a_plain_version(spark):
    import math

    import numpy as np

    from brindle.llm.toxicity import GRAMS, Model, words

    rng = random.Random(12)
    buckets = 257
    model = Model(np.array([rng.uniform(-3, 3) for _ in range(buckets)]), -0.3, 3)

    def row(piece, start):
        h = start
        for c in piece:
            h = ((h * 1_000_003) & (2**64 - 1)) ^ c
        return (((h * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 40) % buckets

    def plain(text):
        logits = []
        for w in words(text.encode()) if text else []:
            b = b"<" + w + b">"
            bag = [row(b[i : i + n], n) for n in GRAMS for i in range(len(b) - n + 1)] + [row(b, 0)]
            logits.append(sum(model.part[k] for k in bag) / len(bag))
        tops = [sum(logits[i : i + 3]) / 3 for i in range(len(logits) - 2)] if len(logits) > 3 else [sum(logits) / len(logits) if logits else 0.0]
        return 1 / (1 + math.exp(-(max(tops) + model.bias)))

    rows = [(i, " ".join("".join(rng.choice("aBc\u00e9-!") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(100, None), (101, ""), (101, ""), (None, "a b"), (102, "very long " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    for cache in (500_000, 40):
        got = sorted(((r.doc_id, r.score) for r in toxicity_scores(docs, model, cache_words=cache).collect()), key=str)
        assert [g[0] for g in got] == [w[0] for w in sorted(((d, plain(t)) for d, t in rows), key=str)]
        want = {(d, round(plain(t), 9)) for d, t in rows}
        assert {(d, round(x, 9)) for d, x in got} == want


def test_training_rows_are_bounded_and_told_by_rule(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(60)] + [(3, "a second text of 3"), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(4, 1), (4, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    own = {r.doc_id: (bytes(r.text or b"").decode(), r.toxic) for r in training_rows(docs, labels).collect()}
    assert not any(zlib.crc32(str(d).encode()) % 5 == 0 for d in own) and own[4][1] == 1 and own[3][0] == "a second text of 3"
    assert set(own) == {d for d in [*range(60), 61] if zlib.crc32(str(d).encode()) % 5}
    some = training_rows(docs, labels, most_bytes=200).collect()
    assert all(0 < sum(len(r.text or b"") for r in some if r.toxic == y) <= 200 for y in (0, 1)) and {r.doc_id for r in some} < set(own)
    assert all(len(r.text or b"") <= 25 for r in some)
    long = docs.unionByName(spark.createDataFrame([(100 + i, "long " * 200) for i in range(40)], docs.schema))
    more = training_rows(long, labels.unionByName(spark.createDataFrame([(100 + i, i % 2) for i in range(40)], labels.schema)), most_bytes=200).collect()
    assert sorted(more) == sorted(some)  # texts that cannot fit take no place and end no class
    assert training_rows(docs.limit(0), labels).count() == 0 and training_rows(docs, labels.limit(0)).count() == 0


def test_one_class_gives_the_prior():
    m = fit([b"a b", b"c"], [0, 0])
    assert m.bias < 0 and not m.part.any() and fit([], []).bias < 0


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(9)) for _ in range(n))
    item = " ".join(rng.choice(vocab) for _ in range(30))
    base = text(12).replace("\n", " ")  # one long line, of which a copy with another word survives the line stage
    passage = "\n".join(" ".join(rng.choice(vocab) for _ in range(9)) for _ in range(12))
    rows = [(i, text(8)) for i in range(40)]
    rows += [(100, base), (102, base.replace(f" {base.split()[5]} ", f" {vocab[0]} ", 1))]
    rows += [(200, text(3) + "\n" + item + "\n" + text(3)), (300, "too short"), (301, None), (302, "same words here now again " * 30)]
    rows += [(400 + i, text(5) + "\n" + passage + "\n" + text(5)) for i in range(4)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    trusted = [*range(40), 100, 101, 102, 102, 200, 400, 401, 402, 403]  # in a corpus this small the target must hold every word
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r.doc_id for r in kept.select("doc_id").distinct().collect()}
        if k < 4:
            assert kept.columns == corpus_pipeline.COLUMNS
    clean = set(range(40)) | {400, 401, 402, 403}
    assert seen["quality rules"] >= clean | {100, 102, 200} and not seen["quality rules"] & {300, 301, 302}
    assert seen["line dedup"] == seen["quality rules"]
    assert clean | {100} <= seen["n-gram Jaccard join"] and 102 not in seen["n-gram Jaccard join"]
    assert clean <= seen["benchmark decontamination"] and 200 not in seen["benchmark decontamination"]
    assert seen["packing"] == seen["benchmark decontamination"]
    rows_out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, rows_out.collect())) == sorted(map(tuple, kept.collect()))


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, own(1)), (1, own(1)), (2, None), (3, ""), (None, own(2)), (None, None), (4, "x" * 300_000), (5, "long text " * 50_000), (6, own(6))]
    docs = [(d, t, None if d == 6 else "en", None, None, "more") for d, t in rows]
    labels = [(1, 1, 0), (6, 1, 1), (6, 1, None), (None, 1, 1), (99, 1, 0)]
    items = [(1, "a benchmark item of words that no text of this corpus holds anywhere"), (2, None), (None, "another item of words that nobody has written down so far")]
    for name, parts in (("odd", (docs, labels, items)), ("empty", ([], [], []))):
        schemas = ("doc_id long, text string, lang string, source string, n_chars long, kept string", "doc_id long, quality int, toxic int", "item_id long, text string")
        for table, part, schema in zip(("documents", "labels", "benchmark"), parts, schemas, strict=True):
            spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} == ({1, None, 6} if name == "odd" else set())
        assert len({(r.doc_id, r.start, r.sequence_id, r.offset) for r in out}) == len(out)
