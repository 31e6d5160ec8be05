"""Gold passages: texts are cleaned and compared only where a quote may be."""

from brindle.operators import retrieval as R


def test_texts_are_joined_with_the_few_pairs_without_a_shuffle(spark):
    quote = "the Quick  brown fox jumps over it"
    docs = spark.createDataFrame([(1, "So the quick brown\nFOX jumps  over its dog"), (2, "quick brown fox jumps"), (3, None), (4, "The quick brown fox jumps over it")], "id long, text string")
    out = R.gold_passages(docs, spark.createDataFrame([(7, quote), (8, "no such words are in here at all"), (9, "")], "query_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(7, 1), (7, 4)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
