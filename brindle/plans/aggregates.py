"""Aggregations over events, labels and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.stats import percentile_cont, percentile_disc, ratio, spearman
from brindle.operators import aggregates as A
from brindle.plans.registry import query, table


@query("A1_decision_totals", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 100) AS high, count(*) FILTER (WHERE value < 10) AS low FROM events GROUP BY event_type")
def a1(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(v >= 100).alias("high"), F.count_if(v < 10).alias("low"))


@query("A2_two_level_latency", """WITH c AS (SELECT event_type, user_id, coalesce(nullif(json_extract_string(props, '$.k'), '0'), 'id:' || event_id) AS call, max(value) AS v, bool_or(value > 100) AS slow FROM events GROUP BY ALL)
SELECT event_type, count(*) AS calls, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.5) FILTER (WHERE slow), 6) AS p50_slow FROM c GROUP BY event_type""")
def a2(spark, sf_dir):
    key = A.call_key(F.nullif(F.get_json_object("props", "$.k"), F.lit("0")), F.lit("id"), F.col("event_id"))
    calls = table(spark, sf_dir, "events").groupBy("event_type", "user_id", key.alias("call")).agg(F.max("value").alias("v"), F.bool_or(F.col("value") > 100).alias("slow"))
    return calls.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.round(percentile_cont("v", 0.5), 6).alias("p50"), F.round(percentile_cont("v", 0.95), 6).alias("p95"), F.round(percentile_cont("v", 0.5, "slow"), 6).alias("p50_slow")
    )


@query("A4_family_counts", """SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE 'STANDARD%' THEN 'standard' ELSE p_type END AS family, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY 1""")
def a4(spark, sf_dir):
    fam = A.family(F.col("p_type"), (("PROMO", "promo"), ("STANDARD", "standard")))
    return table(spark, sf_dir, "part").groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("A5_A6_agreement_rate", "SELECT source, round(coalesce(avg(CASE WHEN quality <> toxic THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS rate, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a5(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    agree = F.when(F.col("quality").isNotNull(), (F.col("quality") != F.col("toxic")))
    # A row without a label is no agreement.
    return rows.groupBy("source").agg(F.round(ratio(F.count_if(agree).cast("double"), F.count(F.lit(1))), 6).alias("rate"), F.count("quality").alias("n"))


_EVAL = """count(*) AS n, round(avg(quality), 6) AS mean_quality, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (WHERE toxic = 1) AS toxic, round(median(n_chars), 4) AS median_chars,
round(median(n_chars) FILTER (WHERE quality = 1), 4) AS median_good FROM documents LEFT JOIN labels USING (doc_id)"""


def _eval():
    return [
        F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.round(percentile_cont("n_chars", 0.5), 4).alias("median_chars"), F.round(percentile_cont("n_chars", 0.5, "quality = 1"), 4).alias("median_good"),
    ]


@query("A10_run_aggregate", f"SELECT {_EVAL}")
def a10(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").agg(*_eval())


@query("A11_corpus_aggregate", f"SELECT coalesce(source, 'unassigned') AS corpus, {_EVAL} GROUP BY 1")
def a11(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy(F.coalesce("source", F.lit("unassigned")).alias("corpus")).agg(*_eval())


_RUNS = """runs AS (SELECT strftime(o_orderdate, '%Y') AS run, o_orderpriority AS metric, avg(o_totalprice::DECIMAL(20, 2))::DOUBLE AS value FROM orders GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("run"), F.col("o_orderpriority").alias("metric")).agg((F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))).alias("value"))


@query("A13_baseline_mean", f"WITH {_RUNS} SELECT metric, round(avg(value), 4) AS mean, round(max(value) - min(value), 4) AS spread, count(*) AS n FROM runs GROUP BY metric")
def a13(spark, sf_dir):
    return A.baseline_of(_runs(spark, sf_dir)).select("metric", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"), "n")


@query("A15_category_passes", "SELECT lang AS category, sum((quality = 1)::INT)::BIGINT AS passed, count(*) AS total, ceil(count(*) * 90 / 100.0)::BIGINT AS bar FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a15(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("lang").alias("category")).agg(F.sum((F.col("quality") == 1).cast("int")).cast("long").alias("passed"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("bar", A.bars(F.col("total"))[0])


@query("A17_nearest_rank_percentiles", "SELECT l_shipmode, n, p50, p95 FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1)")
def a17(spark, sf_dir):
    key = F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")
    return table(spark, sf_dir, "lineitem").groupBy(key).agg(F.count(F.lit(1)).alias("n"), percentile_disc("l_extendedprice", 0.5).alias("p50"), percentile_disc("l_extendedprice", 0.95).alias("p95"))


@query("A18_agreement_table", """SELECT a.l_returnflag AS area, count(*) AS n, round(avg((a.l_tax = b.l_tax)::INT), 6) AS agree, round(avg(abs(a.l_tax - b.l_tax)), 6) AS mean_diff, count(*) FILTER (WHERE a.l_tax >= 0.04 AND b.l_tax < 0.04) AS crossings
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1""")
def a18(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a = rows.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_tax").alias("x"))
    b = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_tax").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_returnflag").alias("area")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((x == y).cast("int")), 6).alias("agree"), F.round(F.avg(F.abs(x - y)), 6).alias("mean_diff"), F.count_if((x >= 0.04) & (y < 0.04)).alias("crossings")
    )


@query("A19_crosstab", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a19(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("A20_cost_buckets", """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS bucket, sum(l_extendedprice::DECIMAL(20, 2))::DOUBLE AS cost,
round(sum(l_extendedprice::DECIMAL(20, 2))::DOUBLE / count(DISTINCT l_orderkey), 4) AS per_order FROM lineitem GROUP BY 1""")
def a20(spark, sf_dir):
    bucket = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "middle").otherwise("large")
    # Orders are counted once a bucket before the sums meet, so the distinct count needs no second copy of the rows.
    per = table(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket"), "l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("c"))
    out = per.groupBy("bucket").agg(F.sum("c").cast("double").alias("cost"), F.count(F.lit(1)).alias("orders"))
    return out.select("bucket", "cost", F.round(F.col("cost") / F.col("orders"), 4).alias("per_order"))


@query("A22_error_tally", "SELECT lang, source, substr(text, 1, 110) AS head, count(*) AS n FROM documents GROUP BY ALL")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source", F.substring("text", 1, 110).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("A23_guard_fires", "SELECT l_orderkey, bool_and(l_discount < 0.05) AS fires, count(*) FILTER (WHERE l_discount < 0.05) AS low FROM lineitem GROUP BY 1")
def a23(spark, sf_dir):
    low = F.col("l_discount") < 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(low).alias("fires"), F.count_if(low).alias("low"))


@query("A26_paired_outcomes", "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS wins, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS losses, abs(count(*) FILTER (WHERE quality = 1 AND toxic = 0) - count(*) FILTER (WHERE quality = 0 AND toxic = 1)) < 2 AS tie FROM labels")
def a26(spark, sf_dir):
    return A.paired_outcomes(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


@query("A28_spearman", """WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS ry FROM lineitem)
SELECT g, count(*) AS n, round(corr(rx::DOUBLE, ry::DOUBLE), 6) AS rho FROM r GROUP BY g""")
def a28(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_discount")
    return spearman(rows, ["g"], "l_quantity", "l_discount").withColumn("rho", F.round("rho", 6))


@query("A30_mean_top3", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST) AS n FROM events) SELECT user_id, round(avg(value), 6) AS mean_top FROM r WHERE n <= 3 GROUP BY user_id")
def a30(spark, sf_dir):
    return A.mean_of_top(table(spark, sf_dir, "events"), ["user_id"], "value").withColumn("mean_top", F.round("mean_top", 6))


@query("A31_entity_coverage", "WITH e AS (SELECT user_id, event_type, max(value) AS g FROM events GROUP BY ALL) SELECT user_id, bool_and(g >= 50) AS covered, max(g) AS best FROM e GROUP BY user_id")
def a31(spark, sf_dir):
    return A.entity_coverage(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("entity"), F.col("value").alias("grade")), "user_id", 50.0)


@query("A32_strongest_pair", "SELECT l_orderkey, arg_max(l_linenumber, (l_discount, -l_linenumber)) AS line, max(l_discount) AS p, max(l_discount) >= 0.05 AS disclosed FROM lineitem GROUP BY 1")
def a32(spark, sf_dir):
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_discount", -F.col("l_linenumber"))).alias("line"), F.max("l_discount").alias("p"))
    return best.withColumn("disclosed", F.col("p") >= 0.05)


_CLAIMS = """c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'supported' WHEN 'R' THEN 'partial' ELSE 'unsupported' END AS verdict, 1 - l_discount AS p, l_linestatus = 'O' OR l_quantity > 10 AS factual, l_suppkey, l_partkey FROM lineitem)"""


def _claims(spark, sf_dir):
    verdict = F.when(F.col("l_returnflag") == "N", "supported").when(F.col("l_returnflag") == "R", "partial").otherwise("unsupported")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", verdict.alias("verdict"), (1 - F.col("l_discount")).alias("p"), ((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 10)).alias("factual"), F.array("l_suppkey", "l_partkey").alias("citations"))


@query("A33_review_scores", f"""WITH {_CLAIMS} SELECT l_orderkey, round(coalesce(sum(CASE WHEN verdict = 'supported' THEN 1.0 WHEN verdict = 'partial' THEN 0.5 ELSE 0 END) FILTER (WHERE factual) / nullif(count(*) FILTER (WHERE factual), 0), 1)::DOUBLE, 6) AS faithfulness,
round(coalesce(min(p) FILTER (WHERE factual), 1), 6) AS min_support, round(coalesce(count(*) FILTER (WHERE factual AND verdict = 'supported') / nullif(count(*) FILTER (WHERE factual), 0), 1), 6) AS citation_precision FROM c GROUP BY 1""")
def a33(spark, sf_dir):
    out = A.review_scores(_claims(spark, sf_dir), "l_orderkey")
    return out.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("faithfulness", "min_support", "citation_precision")])


@query("A34_citation_verdicts", f"""WITH {_CLAIMS}, f AS (SELECT l_orderkey, verdict, p, l_suppkey AS citation FROM c UNION ALL SELECT l_orderkey, verdict, p, l_partkey FROM c)
SELECT l_orderkey, citation, max(CASE verdict WHEN 'supported' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END)::INT AS severity, round(min(p), 6) AS p FROM f GROUP BY 1, 2""")
def a34(spark, sf_dir):
    return A.citation_verdicts(_claims(spark, sf_dir), "l_orderkey").withColumn("p", F.round("p", 6))


@query("A35_gate_fold", "SELECT user_id, arg_max(value, (value, -event_id)) FILTER (WHERE event_type IN ('click', 'view')) AS best, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY user_id")
def a35(spark, sf_dir):
    kind, v = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(kind.isin("click", "view"), v)).alias("best"), F.max_by("value", F.when(kind == "purchase", F.col("event_id"))).alias("last"))


@query("A38_stage_percentiles", "SELECT json_extract_string(props, '$.k')::INT AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, max(value) AS worst FROM events GROUP BY 1")
def a38(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(percentile_cont("value", 0.5), 6).alias("p50"), F.max("value").alias("worst"))


@query("A40_probe_summary", "SELECT event_type, round(median(value), 6) AS median, min(value) AS low, max(value) AS high, round(coalesce(stddev_samp(value), 0), 4) AS spread FROM events GROUP BY 1")
def a40(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(percentile_cont("value", 0.5), 6).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("spread"))


@query("A43_calibration", """WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events)
SELECT user_id, max(value) AS top, round(avg(value) FILTER (WHERE n <= 3), 9) AS mean_top, max(value) FILTER (WHERE event_type = 'view') AS entity_max, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM r GROUP BY user_id""")
def a43(spark, sf_dir):
    out = A.calibration(table(spark, sf_dir, "events"), "user_id", "value", "event_id", F.col("event_type") == "view", "event_type")
    return out.select("user_id", "top", F.round("mean_top", 9).alias("mean_top"), "entity_max", F.array_join("kinds", ",").alias("kinds"))


@query("A44_attribution", """SELECT o_orderkey, count(l_linenumber) AS found, count(*) FILTER (WHERE l_returnflag = 'R') AS unresolved, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN coalesce(sum(l_quantity), 0) END AS overhead
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def a44(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("f"), F.count_if(F.col("l_returnflag") == "R").alias("u"), F.sum("l_quantity").alias("q"))
    out = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    unresolved = F.coalesce("u", F.lit(0))
    return out.select("o_orderkey", F.coalesce("f", F.lit(0)).alias("found"), unresolved.alias("unresolved"), F.when(unresolved == 0, F.coalesce("q", F.lit(0.0))).alias("overhead"))
