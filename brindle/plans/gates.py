"""Gate queries: years of orders are runs, priorities are metrics; labelled documents and turns are evaluated items."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import gates as G
from brindle.plans.aggregates import _RUNS, _runs
from brindle.plans.registry import query, table

_METRICS = {
    "faithfulness": ("avg(1 - l_discount)", "avg(CASE WHEN l_returnflag = 'A' THEN 1 - l_discount ELSE 0.99 END)"), "failed": ("count(*) FILTER (WHERE l_quantity > 50)", "0"),
    "should_abstain_total": ("count(*) FILTER (WHERE l_linenumber = 1)", "count(*) FILTER (WHERE l_linenumber = 1) + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END"),
    "answerable_total": ("CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 10 END", "10"), "should_abstain_correct": ("count(*) FILTER (WHERE l_linestatus = 'O') % 9", "count(*) FILTER (WHERE l_linestatus = 'O') % 10"),
    "answerable_answered": ("count(*) FILTER (WHERE l_tax > 0.04) % 5", "count(*) FILTER (WHERE l_tax > 0.04) % 6"), "p50_our_overhead_ms": ("CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey * 14 END", "l_suppkey * 10"),
    "p50_latency_ms": ("l_suppkey * 13", "l_suppkey * 11"), "forbidden_hits": ("CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END", "0"),
}
_CELLS = ", ".join(f"({a})::DOUBLE AS r_{k}, ({b})::DOUBLE AS b_{k}" for k, (a, b) in _METRICS.items())
_WIDE = f"w AS (SELECT l_suppkey, {_CELLS} FROM lineitem GROUP BY l_suppkey)"


def _pairs(spark, sf_dir):
    cells = [F.expr(f"cast({e} AS double) AS {s}_{k}".replace("count(*) FILTER", "count(1) FILTER")) for k, ab in _METRICS.items() for s, e in zip("rb", ab, strict=True)]
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*cells)


def _findings():
    return G.regression_findings({k: F.col(f"r_{k}") for k in _METRICS}, {k: F.col(f"b_{k}") for k in _METRICS})


_FAILS = """concat_ws(',', CASE WHEN r_failed > 0 THEN 'errored' END, CASE WHEN r_faithfulness < 0.9 THEN 'faithfulness_floor' END, CASE WHEN r_faithfulness < b_faithfulness - 0.06 THEN 'faithfulness_drop' END,
  CASE WHEN r_should_abstain_total <> b_should_abstain_total THEN 'should_abstain_total_differs' END, CASE WHEN r_answerable_total <> b_answerable_total THEN 'answerable_total_differs' END,
  CASE WHEN b_should_abstain_correct - r_should_abstain_correct >= 2 THEN 'should_abstain_correct_flips' END, CASE WHEN b_answerable_answered - r_answerable_answered >= 2 THEN 'answerable_answered_flips' END,
  CASE WHEN r_forbidden_hits > 0 THEN 'forbidden_hits' END)"""
_WARNS = """concat_ws(',', CASE WHEN r_should_abstain_total IS NULL THEN 'should_abstain_total_unverified' END, CASE WHEN r_answerable_total IS NULL THEN 'answerable_total_unverified' END,
  CASE WHEN b_should_abstain_correct - r_should_abstain_correct = 1 THEN 'should_abstain_correct_flip' END, CASE WHEN b_answerable_answered - r_answerable_answered = 1 THEN 'answerable_answered_flip' END,
  CASE WHEN (r_p50_our_overhead_ms IS NOT NULL AND r_p50_our_overhead_ms > b_p50_our_overhead_ms * 1.35 AND b_p50_our_overhead_ms > 0) OR (r_p50_our_overhead_ms IS NULL AND r_p50_latency_ms > b_p50_latency_ms * 1.2 AND b_p50_latency_ms > 0) THEN 'latency_rise' END)"""


@query("G1_regression_gate", f"WITH {_WIDE} SELECT l_suppkey, {_FAILS} AS failures, {_WARNS} AS warnings FROM w")
def g1(spark, sf_dir):
    fails, warns = _findings()
    return _pairs(spark, sf_dir).select("l_suppkey", F.array_join(fails, ",").alias("failures"), F.array_join(warns, ",").alias("warnings"))


@query("G2_gate_loop", f"""WITH {_WIDE}, x AS (SELECT l_suppkey, {_FAILS} AS f, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE {_FAILS} END AS m, r_failed > 0 OR r_forbidden_hits > 0 AS blocked FROM w)
SELECT l_suppkey, CASE WHEN f = '' THEN 'pass' WHEN blocked THEN 'blocked' WHEN m = '' THEN 'pass on the mean' ELSE 'fail' END AS verdict, CASE WHEN f = '' OR blocked THEN 1 ELSE 3 END AS draws FROM x""")
def g2(spark, sf_dir):
    fails, _ = _findings()
    mean = F.when(F.col("l_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(fails)
    verdict, draws = G.gate_loop(fails, mean, (F.col("r_failed") > 0) | (F.col("r_forbidden_hits") > 0))
    return _pairs(spark, sf_dir).select("l_suppkey", verdict.alias("verdict"), draws.alias("draws"))


@query("A12_mean_of_runs", f"""WITH {_RUNS}, r AS (SELECT run, CASE WHEN metric = '1-URGENT' THEN 'content_misses' ELSE metric END AS metric, CASE WHEN run = '1995' AND metric = '2-HIGH' THEN NULL ELSE value END AS value FROM runs)
SELECT metric, round(CASE WHEN metric = 'content_misses' THEN max(value) ELSE avg(value) END, 4) AS value FROM r WHERE value IS NOT NULL GROUP BY metric""")
def a12(spark, sf_dir):
    name = F.when(F.col("metric") == "1-URGENT", "content_misses").otherwise(F.col("metric"))
    value = F.when(~((F.col("run") == "1995") & (F.col("metric") == "2-HIGH")), F.col("value"))
    return G.mean_of_runs(_runs(spark, sf_dir).select("run", name.alias("metric"), value.alias("value"))).withColumn("value", F.round("value", 4))


@query("A13_comparable_baseline", f"""WITH {_RUNS}, r AS (SELECT run, metric, value FROM runs WHERE NOT (run = '1996' AND metric = '3-MEDIUM'))
SELECT metric, round(avg(value), 4) AS mean, round(max(value) - min(value), 4) AS spread, count(*) AS n, CASE WHEN count(*) < (SELECT count(DISTINCT run) FROM r) THEN 'missing in some runs' END AS refused FROM r GROUP BY metric""")
def a13(spark, sf_dir):
    runs = _runs(spark, sf_dir).where("NOT (run = '1996' AND metric = '3-MEDIUM')").withColumn("models", F.lit("m1"))
    return G.comparable_baseline(runs).select("metric", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"), "n", "refused")


@query("U9_model_differences", """WITH m AS (SELECT c_custkey, 'm' || c_nationkey % 3 AS a, 'm' || c_custkey % 3 AS b, c_mktsegment AS s FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN s = 'BUILDING' THEN 'extra' END, CASE WHEN a <> b THEN 'generate' END) AS roles FROM m""")
def u9(spark, sf_dir):
    model = lambda c: F.concat(F.lit("m"), (F.col(c) % 3).cast("string"))
    a = F.create_map(F.lit("generate"), model("c_nationkey"), F.lit("judge"), F.lit("j"))
    b = F.create_map(F.lit("generate"), model("c_custkey"), F.lit("judge"), F.lit("j"))
    b = F.when(F.col("c_mktsegment") == "BUILDING", F.map_concat(b, F.create_map(F.lit("extra"), F.lit("x")))).otherwise(b)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(G.map_differences(a, b), ",").alias("roles"))


_ITEMS = """i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS run, l_shipdate, CASE WHEN l_partkey % 9 = 0 THEN 'smalltalk' WHEN l_partkey % 9 = 1 THEN 'library' WHEN l_partkey % 9 < 4 THEN 'not_in_sources' ELSE 'answer' END AS expect,
  CASE WHEN l_quantity = 1 THEN 'failed' WHEN l_quantity = 2 THEN NULL ELSE 'completed' END AS status, l_discount > 0.08 AS abstained, l_tax > 0.07 AS declined, l_linenumber % 3 AS n_citations, l_returnflag <> 'R' AS passed, l_extendedprice AS ms FROM lineitem),
c AS (SELECT *, CASE WHEN status IS DISTINCT FROM 'completed' THEN 'errored' WHEN expect = 'not_in_sources' THEN CASE WHEN NOT (abstained OR declined) THEN 'confident_wrong' WHEN n_citations > 0 THEN 'unclean_decline' ELSE 'clean_decline' END
  WHEN expect = 'answer' AND (abstained OR declined) THEN 'false_abstention' WHEN expect = 'answer' AND n_citations = 0 THEN 'uncited_answer' WHEN expect = 'answer' AND NOT passed THEN 'content_miss' ELSE 'plain_' || expect END AS class FROM i)"""


def _items(spark, sf_dir):
    p = F.col("l_partkey") % 9
    expect = F.when(p == 0, "smalltalk").when(p == 1, "library").when(p < 4, "not_in_sources").otherwise("answer")
    status = F.when(F.col("l_quantity") == 1, "failed").when(F.col("l_quantity") != 2, "completed")
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("run"), expect.alias("expect"), status.alias("status"), (F.col("l_discount") > 0.08).alias("abstained"),
        (F.col("l_tax") > 0.07).alias("declined"), (F.col("l_linenumber") % 3).alias("n_citations"), (F.col("l_returnflag") != "R").alias("passed"), F.col("l_extendedprice").alias("ms"),
    )
    return items.withColumn("class", G.behaviour(*[F.col(c) for c in ("expect", "status", "abstained", "declined", "n_citations", "passed")]))


_NAMES = ("confident_wrong", "clean_decline", "unclean_decline", "false_abstention", "uncited_answer", "content_miss", "errored")
_COUNTED = f"""s AS (SELECT run, count(*) AS items, {', '.join(f"count(*) FILTER (WHERE class = '{n}') AS {n}" for n in _NAMES)}, count(*) FILTER (WHERE class <> 'errored' AND expect = 'answer') AS answer_items,
  count(*) FILTER (WHERE class <> 'errored' AND expect = 'not_in_sources') AS abstain_items, trunc(median(ms))::BIGINT AS p50_total_ms, min(id) FILTER (WHERE class = 'confident_wrong') AS first_wrong FROM c GROUP BY run)"""


def _counted(spark, sf_dir):
    graded = F.col("class") != "errored"
    return _items(spark, sf_dir).groupBy("run").agg(
        F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("class") == n).alias(n) for n in _NAMES], F.count_if(graded & (F.col("expect") == "answer")).alias("answer_items"),
        F.count_if(graded & (F.col("expect") == "not_in_sources")).alias("abstain_items"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY ms)").cast("long").alias("p50_total_ms"),
        F.min(F.when(F.col("class") == "confident_wrong", F.col("id"))).alias("first_wrong"),
    )


@query("A14_acceptance_summary", f"WITH {_ITEMS}, {_COUNTED} SELECT * FROM s")
def a14(spark, sf_dir):
    return _counted(spark, sf_dir)


@query("A14_behaviour_classes", f"WITH {_ITEMS} SELECT id, class FROM c")
def a14_classes(spark, sf_dir):
    return _items(spark, sf_dir).select("id", "class")


@query("G3_acceptance_gate", f"""WITH {_ITEMS}, {_COUNTED}, e AS (SELECT *, CASE WHEN items % 2 = 0 THEN 0 ELSE errored END AS er FROM s)
SELECT run, concat_ws(',', CASE WHEN confident_wrong > 0 THEN 'confident_wrong' END, CASE WHEN content_miss > 1 THEN 'content_misses' END, CASE WHEN clean_decline < (abstain_items * 90 + 99) // 100 THEN 'clean_declines' END,
  CASE WHEN false_abstention > answer_items * 5 // 100 THEN 'false_abstentions' END, CASE WHEN uncited_answer > 0 THEN 'uncited_answers' END) AS failures FROM e WHERE er = 0
UNION ALL SELECT run, 'errored' FROM e WHERE er > 0""")
def g3(spark, sf_dir):
    c = _counted(spark, sf_dir).withColumn("errored", F.when(F.col("items") % 2 == 0, 0).otherwise(F.col("errored")))
    names = {"errored": "errored", "confident_wrong": "confident_wrong", "content_misses": "content_miss", "clean_declines": "clean_decline", "false_abstentions": "false_abstention", "uncited_answers": "uncited_answer"}
    cols = {k: F.col(v) for k, v in names.items()} | {k: F.col(k) for k in ("abstain_items", "answer_items", "p50_total_ms")}
    return c.select("run", F.array_join(G.acceptance_failures(cols, {}, deep=False, declines_gated=True), ",").alias("failures"))


@query("G4_entity_mismatch_gate", f"WITH {_ITEMS} SELECT run, count(*) FILTER (WHERE expect = 'not_in_sources' AND class NOT IN ('clean_decline', 'unclean_decline')) = 0 AND count(*) FILTER (WHERE expect = 'not_in_sources') = 12 AS passed FROM c GROUP BY run")
def g4(spark, sf_dir):
    asked = F.col("expect") == "not_in_sources"
    bad = F.count_if(asked & ~F.col("class").isin("clean_decline", "unclean_decline"))
    return _items(spark, sf_dir).groupBy("run").agg(((bad == 0) & (F.count_if(asked) == 12)).alias("passed"))


@query("G5_item_rule", f"""WITH {_ITEMS}, x AS (SELECT id, expect, status IS NOT DISTINCT FROM 'completed' AND NOT abstained AS completed, abstained OR declined AS gone, n_citations, passed AS cite, id % 7 <> 0 AS mention, id % 11 <> 0 AS lang,
  CASE WHEN id % 13 = 0 THEN 'x1' END AS forbidden FROM c), p AS (SELECT *, lang AND forbidden IS NULL AND CASE expect WHEN 'smalltalk' THEN completed AND n_citations = 0 WHEN 'library' THEN completed AND mention
  WHEN 'answer' THEN completed AND n_citations > 0 AND cite AND mention ELSE gone END AS passes FROM x)
SELECT id, passes, CASE WHEN passes THEN NULL WHEN NOT lang THEN 'language_mismatch' WHEN forbidden IS NOT NULL THEN 'forbidden_value:' || forbidden WHEN expect = 'answer' AND n_citations = 0 THEN 'no_citations' ELSE 'wrong_class_or_content' END AS reason FROM p""")
def g5(spark, sf_dir):
    i = F.col("id")
    completed = F.col("status").eqNullSafe("completed") & ~F.col("abstained")
    passes, reason = G.item_passes(F.col("expect"), completed, F.col("abstained") | F.col("declined"), F.col("n_citations"), F.col("passed"), i % 7 != 0, i % 11 != 0, F.when(i % 13 == 0, F.lit("x1")))
    return _items(spark, sf_dir).select("id", passes.alias("passes"), reason.alias("reason"))


@query("X57_language_mismatch", "SELECT d.doc_id, coalesce(d.lang <> CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 2 = 0 THEN 'en' ELSE 'de' END, false) AS differs FROM documents d")
def x57(spark, sf_dir):
    got = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 2 == 0, "en").otherwise("de")
    return table(spark, sf_dir, "documents").select("doc_id", G.language_differs(F.col("lang"), got).alias("differs"))


@query("F25_clearly_absent", "SELECT l_orderkey, l_linenumber, NOT (l_linestatus = 'O' AND l_returnflag = 'N') AND NOT coalesce(e > 0.5, false) AND (g IS NULL OR g <= 0.1) AS absent FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_discount * 2 END AS g, CASE WHEN l_linenumber <> 2 THEN l_tax * 10 END AS e FROM lineitem)")
def f25(spark, sf_dir):
    g, e = F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 2), F.when(F.col("l_linenumber") != 2, F.col("l_tax") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.clearly_absent(g, e, F.col("l_linestatus") == "O", F.col("l_returnflag") == "N").alias("absent"))


@query("A46_threshold_proposal", """WITH r AS (SELECT c_nationkey < 12 AS answerable, round(CASE WHEN c_nationkey < 12 THEN 0.4 + c_acctbal / 20000 ELSE c_acctbal / 15000 END, 4) AS grade FROM customer),
l AS (SELECT grade AS low FROM r WHERE answerable ORDER BY grade LIMIT 1 OFFSET 9), b AS (SELECT max(grade) AS below FROM r, l WHERE NOT answerable AND grade < low)
SELECT round_even((low + below) / 2, 3) AS floor, (floor((SELECT max(grade) FROM r WHERE NOT answerable) * 10 + 1e-9) + 1) / 10 AS line FROM l, b WHERE below IS NOT NULL""")
def a46(spark, sf_dir):
    yes = F.col("c_nationkey") < 12
    runs = table(spark, sf_dir, "customer").select(yes.alias("answerable"), F.round(F.when(yes, 0.4 + F.col("c_acctbal") / 20000).otherwise(F.col("c_acctbal") / 15000), 4).alias("grade"))
    return G.threshold_proposal(runs, misses=9)


@query("G9_latency_targets", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, CASE WHEN quantile_cont(value, 0.5) <= 50 AND quantile_cont(value, 0.95) <= 95 THEN 'MET' ELSE 'NOT MET' END AS target FROM events GROUP BY 1")
def g9(spark, sf_dir):
    from brindle.functions.stats import percentile_cont

    out = table(spark, sf_dir, "events").groupBy("event_type").agg(percentile_cont("value", 0.5).alias("a"), percentile_cont("value", 0.95).alias("b"))
    return out.select("event_type", F.round("a", 6).alias("p50"), F.round("b", 6).alias("p95"), F.when((F.col("a") <= 50) & (F.col("b") <= 95), "MET").otherwise("NOT MET").alias("target"))
