"""Readers and writers on small files."""

import datetime as dt
import json

from brindle.sources import readers as S


def test_uploads_and_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "big.txt").write_text("x" * 100)
    got = S.uploads(spark, str(tmp_path), "c", most_bytes=50).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("a.md", b"# A\n\ntext")]
    assert {r.name: r.text for r in S.markdown_corpus(spark, str(tmp_path)).collect()}["a.md"] == "# A\n\ntext"


def test_evaluation_items_of_both_shapes(spark, tmp_path):
    items = [{"id": "2", "question": "Who?", "should_abstain": True}, {"id": "1", "turns": ["Hi", "Who?"], "expect": "x"}, {"id": "3", "turns": []}, {"id": "4", "turns": ["What?"]}]
    (tmp_path / "items.json").write_text(json.dumps(items))
    got = sorted((r.id, r.question) for r in S.evaluation_items(spark, f"{tmp_path}/items.json").collect())
    assert got == [("1", "Who?"), ("4", "What?")]


def test_event_log_prunes_by_type(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3)
    events = spark.createDataFrame([("r", 1, "plan", "{}", at), ("r", 2, "metrics", "{}", at)], S.EVENTS)
    S.append_events(events, f"{tmp_path}/log")
    log = S.event_log(spark, f"{tmp_path}/log").where("type = 'plan'")
    assert [r.seq for r in log.collect()] == [1] and len(log.inputFiles()) <= 2
    assert S.sse_lines(events).orderBy("value").first().value == "id: 1\nevent: plan\ndata: {}\n"


def test_replacing_touches_only_its_buckets(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_bucket int, text string")
    S.replace_documents(old, f"{tmp_path}/chunks")
    S.replace_documents(old.where("doc_bucket = 2").selectExpr("doc_bucket", "'new' AS text"), f"{tmp_path}/chunks")
    assert sorted((r.doc_bucket, r.text) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()) == [(1, "a"), (2, "new")]


def test_web_search_without_a_provider_is_empty(spark):
    spark.dataSource.register(S.WebSearch)
    assert spark.read.format("web_search").option("queries", "a\nb").load().count() == 0
    reader = S.WebSearch({"queries": "a", "limit": "1", "provider": "p"}).reader(None)
    S.PROVIDERS["p"] = lambda q: [("u0", "t0", ""), ("u1", "t1", f"about {q}"), ("u2", "t2", "more")]
    assert list(reader.read(reader.partitions()[0])) == [("a", 1, "u1", "t1", "about a")]
