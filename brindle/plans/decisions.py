"""Decision queries: line items are decisions and calls, discounts and taxes their probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.stats import percentile_cont, ratio
from brindle.operators import decisions as D
from brindle.plans.registry import query, table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_KEY = ("l_orderkey", "l_linenumber")


@query("X36_guard_verdicts", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 OR l_returnflag = 'R' THEN 'pass' WHEN l_discount >= 0.08 THEN 'block' WHEN l_discount >= 0.04 THEN 'warn' ELSE 'pass' END AS verdict FROM lineitem""")
def x36(spark, sf_dir):
    score = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    return _lines(spark, sf_dir).select(*_KEY, D.guard_verdict(score, F.lit(0.04), F.lit(0.08), F.col("l_linenumber") != 1).alias("verdict"))


@query("X37_choices_with_floors", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 AND l_discount * 10 >= 0.3 AND l_discount * 10 >= CASE l_returnflag WHEN 'A' THEN 0.6 WHEN 'R' THEN 0.8 ELSE 0 END THEN l_returnflag ELSE 'none' END AS choice FROM lineitem""")
def x37(spark, sf_dir):
    value = F.when(F.col("l_linenumber") != 2, F.col("l_returnflag"))
    return _lines(spark, sf_dir).select(*_KEY, D.picked(value, F.col("l_discount") * 10, F.lit(0.3), {"A": 0.6, "R": 0.8}, "none").alias("choice"))


@query("X38_normalised_argmax", """WITH w AS (SELECT *, greatest(l_discount - 0.05, 0) AS a, l_tax AS b, (l_linenumber % 3) / 50 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 1 / 3 END, 9) AS p_yes, CASE WHEN a >= b AND a >= c THEN 'yes' WHEN b >= c THEN 'no' ELSE 'unsure' END AS choice FROM w""")
def x38(spark, sf_dir):
    names = ("yes", "no", "unsure")
    weights = (F.col("l_discount") - 0.05, F.col("l_tax"), (F.col("l_linenumber") % 3) / 50)
    m = F.create_map(*[x for n, w in zip(names, weights, strict=True) for x in (F.lit(n), w)])
    out = _lines(spark, sf_dir).select(*_KEY, D.normalised(m).alias("p"))
    return out.select(*_KEY, F.round(F.element_at("p", "yes"), 9).alias("p_yes"), D.argmax(F.array(*[F.lit(n) for n in names]), F.col("p")).alias("choice"))


@query("X39_loose_agreement", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_returnflag = l_linestatus ELSE abs(l_discount * 5 - l_tax * 5) <= 0.2 + 1e-12 END AS agree FROM lineitem""")
def x39(spark, sf_dir):
    label = F.col("l_returnflag") == "R"
    a = F.when(label, F.col("l_returnflag")).otherwise((F.col("l_discount") * 5).cast("string"))
    b = F.when(label, F.col("l_linestatus")).otherwise((F.col("l_tax") * 5).cast("string"))
    return _lines(spark, sf_dir).select(*_KEY, D.loosely_agree(a, b).alias("agree"))


_THRESHOLDS = "(VALUES ('A', 'F', 0.5), ('*', 'F', 0.4), ('*', 'O', 0.3), ('N', 'O', 0.2)) t(engine, name, threshold)"


@query("X40_thresholds", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_linenumber > 0 AND 1 = 0 THEN 0.9 ELSE coalesce(a.threshold, b.threshold) END::DOUBLE AS threshold FROM lineitem
LEFT JOIN (SELECT * FROM {_THRESHOLDS} WHERE engine <> '*') a ON a.engine = l_returnflag AND a.name = l_linestatus LEFT JOIN (SELECT * FROM {_THRESHOLDS} WHERE engine = '*') b ON b.name = l_linestatus""")
def x40(spark, sf_dir):
    known = spark.createDataFrame([("A", "F", 0.5), ("*", "F", 0.4), ("*", "O", 0.3), ("N", "O", 0.2)], "engine string, name string, threshold double")
    rows = _lines(spark, sf_dir).select(*_KEY, F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("name"))
    return D.threshold_of(rows, F.broadcast(known), spark.createDataFrame([("other", 0.9)], "name string, threshold double")).select(*_KEY, "threshold")


@query("X41_delivery_plan", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' AND (l_quantity > 40 OR l_linenumber % 4 = 0) THEN 'hold' ELSE 'stream' END AS plan FROM lineitem")
def x41(spark, sf_dir):
    stakes = F.when(F.col("l_quantity") > 40, "high").otherwise("low")
    return _lines(spark, sf_dir).select(*_KEY, D.delivery(stakes, F.col("l_returnflag") != "A", F.col("l_linenumber") % 4).alias("plan"))


@query("X51_rescaled_scores", "SELECT l_orderkey, l_linenumber, round(1 + least(greatest(l_discount * 12 - 0.1, 0), 1) * 4, 9) AS score FROM lineitem")
def x51(spark, sf_dir):
    return _lines(spark, sf_dir).select(*_KEY, F.round(D.rescaled(F.col("l_discount") * 12 - 0.1, F.lit(1.0), F.lit(5.0)), 9).alias("score"))


@query("X52_truncated_states", "SELECT doc_id, md5(substr(coalesce(text, ''), 1, 400)) AS state_md5 FROM documents")
def x52(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(D.truncated_state(F.coalesce("text", F.lit("")), 100)).alias("state_md5"))


@query("X53_provider_times", "SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE json_extract_string(props, '$.k')::DOUBLE END AS ms FROM events")
def x53(spark, sf_dir):
    other = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("value")).otherwise(other).alias("ms"))


@query("X54_controller_verdicts", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.5 AND l_returnflag <> 'R' THEN CASE l_returnflag WHEN 'A' THEN 'enough' ELSE 'give_up' END ELSE 'need_more' END AS verdict FROM lineitem")
def x54(spark, sf_dir):
    value = F.when(F.col("l_returnflag") == "A", "enough").when(F.col("l_returnflag") == "N", "give_up").otherwise("odd")
    return _lines(spark, sf_dir).select(*_KEY, D.controller(value, F.col("l_discount") * 10, 0.5).alias("verdict"))


@query("X55_ingress", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.09 THEN 'block' WHEN l_discount >= 0.07 THEN 'warn' ELSE 'pass' END AS toxicity, CASE WHEN l_tax >= 0.08 THEN 'block' WHEN l_tax >= 0.06 THEN 'warn' ELSE 'pass' END AS injection,
CASE WHEN l_discount * 10 >= 0.4 THEN l_returnflag ELSE 'N' END AS intent, round(least(greatest(l_tax * 10, 0), 1), 9) AS weight FROM lineitem""")
def x55(spark, sf_dir):
    on = F.lit(True)
    return _lines(spark, sf_dir).select(
        *_KEY, D.guard_verdict(F.col("l_discount"), F.lit(0.07), F.lit(0.09), on).alias("toxicity"), D.guard_verdict(F.col("l_tax"), F.lit(0.06), F.lit(0.08), on).alias("injection"),
        D.picked(F.col("l_returnflag"), F.col("l_discount") * 10, F.lit(0.4), {}, "N").alias("intent"), F.round(D.rescaled(F.col("l_tax") * 10, F.lit(0.0), F.lit(1.0)), 9).alias("weight"),
    )


@query("X59_output_caps", "SELECT l_orderkey, sum(CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 60 ELSE 30 END) + 100 AS cap FROM lineitem GROUP BY 1")
def x59(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", 40).when(F.col("l_returnflag") == "N", 60).otherwise(30)
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg((F.sum(kind) + 100).alias("cap"))


@query("X33_credits", "SELECT l_orderkey, l_linenumber, round((l_quantity * 1000 * 0.25 + l_linenumber * 100 * 1.25) / 0.5, 6) AS credits FROM lineitem")
def x33(spark, sf_dir):
    out = D.credits(F.col("l_quantity") * 1000, F.col("l_linenumber") * 100, F.lit(0.25), F.lit(1.25), F.lit(0.5))
    return _lines(spark, sf_dir).select(*_KEY, F.round(out, 6).alias("credits"))


@query("J38_reference_price", "SELECT price FROM (SELECT p_retailprice AS price FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_brand || p_partkey LIMIT 1)")
def j38(spark, sf_dir):
    id_ = F.concat(F.when(F.col("p_name").ilike("%ring%"), F.lit("")).otherwise(F.lit("~")), "p_brand", F.col("p_partkey").cast("string"))
    prices = table(spark, sf_dir, "part").select(id_.alias("id"), F.col("p_retailprice").alias("price"))
    return D.reference_price(prices, "not there", "brand%")


_PAIRS = """p AS (SELECT a.l_orderkey AS pair, a.l_linenumber AS key, a.l_discount AS primary_value, b.l_tax AS shadow_value FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber WHERE a.l_orderkey % 2 = 0)"""


def _decision_pairs(spark, sf_dir):
    """An order is a call; its shadow has the order's number negated and answers by the taxes."""
    lines = _lines(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    calls = orders.select(F.col("o_orderkey").alias("call"), F.lit(None).cast("long").alias("pair"), F.lit(False).alias("shadow"))
    calls = calls.unionByName(orders.where("o_orderkey % 2 = 0").select((-F.col("o_orderkey") - 1).alias("call"), F.col("o_orderkey").alias("pair"), F.lit(True).alias("shadow")))
    answers = lines.select(F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("key"), F.col("l_discount").alias("value"))
    answers = answers.unionByName(lines.select((-F.col("l_orderkey") - 1).alias("call"), F.col("l_linenumber").alias("key"), F.col("l_tax").alias("value")))
    return D.decision_pairs(calls, answers)


@query("J22_decision_pairs", f"WITH {_PAIRS} SELECT pair, key, primary_value, shadow_value FROM p")
def j22(spark, sf_dir):
    return _decision_pairs(spark, sf_dir).select("pair", "key", F.col("primary").alias("primary_value"), F.col("shadow").alias("shadow_value"))


@query("T9_latest_disagreements", f"WITH {_PAIRS} SELECT pair, key FROM p WHERE abs(primary_value - shadow_value) > 0.05 ORDER BY pair DESC, key LIMIT 20")
def t9(spark, sf_dir):
    return _decision_pairs(spark, sf_dir).where(F.abs(F.col("primary") - F.col("shadow")) > 0.05).orderBy(F.col("pair").desc(), "key").limit(20).select("pair", "key")


@query("K17_routed_calls", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'primary' END AS engine, ('0x' || substr(sha256(event_id || 'shadow'), 1, 8))::BIGINT < 85899345 AS shadowed FROM events""")
def k17(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "fallback").otherwise("primary").alias("engine"), D.sampled(F.col("event_id"), D.SHADOW_RATE, "shadow").alias("shadowed"))


@query("K18_trace_sample", "SELECT event_id FROM events WHERE ('0x' || substr(sha256(event_id || 'trace'), 1, 8))::BIGINT < 429496729")
def k18(spark, sf_dir):
    return table(spark, sf_dir, "events").where(D.sampled(F.col("event_id"), 0.1, "trace")).select("event_id")


@query("A3_step_percentiles", "SELECT round(quantile_cont(value, 0.5) FILTER (WHERE event_type = 'view'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE event_type = 'view'), 6) AS p95, quantile_cont(value, 0.5) FILTER (WHERE event_type = 'none') AS p50_none FROM events")
def a3(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(percentile_cont("value", 0.5, "event_type = 'view'"), 6).alias("p50"), F.round(percentile_cont("value", 0.95, "event_type = 'view'"), 6).alias("p95"), percentile_cont("value", 0.5, "event_type = 'none'").alias("p50_none"))


@query("A8_latest_version", "SELECT event_type, max(event_id) AS version, max(ts) AS heartbeat FROM events GROUP BY 1")
def a8(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("version"), F.max("ts").alias("heartbeat"))


@query("A9_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS running, count(DISTINCT o_custkey) AS users, count(*) FILTER (WHERE o_orderdate >= DATE '2001-01-01') AS recent FROM orders")
def a9(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("running"), F.count_distinct("o_custkey").alias("users"), F.count_if(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("recent"))


@query("A16_content_counts", "SELECT lang, sum(contains(lower(coalesce(text, '')), 'password')::INT)::BIGINT AS forbidden, sum((NOT contains(lower(coalesce(text, '')), 'the'))::INT)::BIGINT AS missed, count(*) FILTER (WHERE source = 'src3') AS wrong FROM documents GROUP BY lang")
def a16(spark, sf_dir):
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.contains(low, F.lit("password"))).alias("forbidden"), F.count_if(~F.contains(low, F.lit("the"))).alias("missed"), F.count_if(F.col("source") == "src3").alias("wrong"))


@query("A21_in_flight_share", """WITH c AS (SELECT l_orderkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1) SELECT o_orderpriority, round(median(1 - x / (o_totalprice / 100 + 50)), 9) AS share FROM orders JOIN c ON l_orderkey = o_orderkey GROUP BY 1""")
def a21(spark, sf_dir):
    calls = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"))
    out = table(spark, sf_dir, "orders").join(calls, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("s", 1 - F.col("x") / (F.col("o_totalprice") / 100 + 50))
    return out.groupBy("o_orderpriority").agg(F.round(percentile_cont("s", 0.5), 9).alias("share"))


@query("A27_reach_rates", """SELECT lang, round(count(*) FILTER (WHERE quality IS NOT NULL) / count(*), 9) AS pool_rate, round(count(*) FILTER (WHERE quality = 1) / count(*), 9) AS kept_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a27(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.count(F.lit(1))
    return rows.groupBy("lang").agg(F.round(ratio(F.count("quality").cast("double"), n), 9).alias("pool_rate"), F.round(ratio(F.count_if(F.col("quality") == 1).cast("double"), n), 9).alias("kept_rate"))


@query("A29_top8_overlap", """WITH a AS (SELECT l_suppkey AS q, l_partkey AS i, max(l_discount) AS x, max(l_tax) AS y FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY x DESC, i) AS rx, row_number() OVER (PARTITION BY q ORDER BY y DESC, i) AS ry FROM a), o AS (SELECT q, count(*) FILTER (WHERE rx <= 8 AND ry <= 8) AS n FROM r GROUP BY q)
SELECT min(n) AS least, round(avg(n), 9) AS mean, count(*) AS queries FROM o""")
def a29(spark, sf_dir):
    from brindle.operators.aggregates import top_overlap

    pairs = _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("i")).agg(F.max("l_discount").alias("x"), F.max("l_tax").alias("y"))
    return top_overlap(pairs, "q", "i", "x", "y", 8).agg(F.min("n").alias("least"), F.round(F.avg("n"), 9).alias("mean"), F.count(F.lit(1)).alias("queries"))


@query("A36_latency_waterfall", """SELECT user_id, round(sum(value::DECIMAL(20, 2)) FILTER (WHERE event_type IN ('signup', 'view')), 2)::DOUBLE AS before, round(sum(value::DECIMAL(20, 2)) FILTER (WHERE event_type = 'click'), 2)::DOUBLE AS generate,
round(sum(value::DECIMAL(20, 2)) FILTER (WHERE event_type IN ('purchase', 'error')), 2)::DOUBLE AS after FROM events GROUP BY user_id""")
def a36(spark, sf_dir):
    v = F.col("value").cast("decimal(20,2)")
    at = F.when(F.col("event_type").isin("signup", "view"), "before").when(F.col("event_type") == "click", "generate").otherwise("after")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.sum(F.when(at == n, v)).cast("double").alias(n) for n in ("before", "generate", "after")])


@query("A37_metered_usage", """SELECT user_id, event_type = 'error' AS judge, sum(greatest(value::DECIMAL(20, 2) - 20, 0))::DOUBLE AS tokens, count(*) AS calls FROM events GROUP BY 1, 2""")
def a37(spark, sf_dir):
    used = F.greatest(F.col("value").cast("decimal(20,2)") - F.lit(20), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_type") == "error").alias("judge")).agg(F.sum(used).cast("double").alias("tokens"), F.count(F.lit(1)).alias("calls"))


@query("A39_stage_shares", """WITH t AS (SELECT median(value) AS whole FROM events) SELECT event_type, round(median(value), 6) AS p50, max(value) AS worst, round(avg(value) / any_value(whole), 6) AS share, round(avg(value) - median(value), 6) AS residual FROM events, t GROUP BY 1""")
def a39(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    whole = events.agg(percentile_cont("value", 0.5).alias("whole"))  # one row
    own = events.groupBy("event_type").agg(percentile_cont("value", 0.5).alias("p"), F.max("value").alias("worst"), F.avg("value").alias("m")).join(F.broadcast(whole))
    return own.select("event_type", F.round("p", 6).alias("p50"), "worst", F.round(F.col("m") / F.col("whole"), 6).alias("share"), F.round(F.col("m") - F.col("p"), 6).alias("residual"))


@query("A42_counts_by_owner", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def a42(spark, sf_dir):
    out = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("A45_quota_summary", """WITH u AS (SELECT user_id, sum(value::DECIMAL(20, 2)) AS used FROM events GROUP BY 1) SELECT user_id, used::DOUBLE AS used, greatest(0, 3500 - used)::DOUBLE AS remaining, used >= 3500 AS blocked FROM u""")
def a45(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(20,2)")).alias("u"))
    return used.select("user_id", F.col("u").cast("double").alias("used"), F.greatest(F.lit(0), F.lit(3500) - F.col("u")).cast("double").alias("remaining"), (F.col("u") >= 3500).alias("blocked"))


@query("A47_usefulness", """SELECT lang, count(*) AS n, round(count(quality) / count(*), 9) AS coverage, round(coalesce(count(*) FILTER (WHERE quality = 1 AND n_chars > 1000) / nullif(count(*) FILTER (WHERE quality = 1), 0), 0), 9) AS good_pass,
round(coalesce(count(*) FILTER (WHERE quality = 0 AND n_chars > 1000) / nullif(count(*) FILTER (WHERE quality = 0), 0), 0), 9) AS bad_pass FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def a47(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rate = lambda q: F.round(ratio(F.count_if((F.col("quality") == q) & (F.col("n_chars") > 1000)).cast("double"), F.count_if(F.col("quality") == q)), 9)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(ratio(F.count("quality").cast("double"), F.count(F.lit(1))), 9).alias("coverage"), rate(1).alias("good_pass"), rate(0).alias("bad_pass"))


@query("A48_generator_latency", """WITH t AS (SELECT user_id, min(ts) AS a, min(ts) FILTER (WHERE event_type = 'click') AS g, min(ts) FILTER (WHERE event_type = 'purchase') AS f, max(ts) AS z FROM events GROUP BY 1)
SELECT count(*) AS runs, round(median(date_diff('microsecond', a, g)), 3) AS before, round(median(date_diff('microsecond', g, f)) FILTER (WHERE f >= g), 3) AS first, round(median(date_diff('microsecond', f, z)), 3) AS rest FROM t""")
def a48(spark, sf_dir):
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), at("click").alias("g"), at("purchase").alias("f"), F.max("ts").alias("z"))
    spans = runs.select("g", "f", *[F.expr(f"timestampdiff(MICROSECOND, {x}, {y})").alias(n) for n, x, y in (("b", "a", "g"), ("m", "g", "f"), ("r", "f", "z"))])
    return spans.agg(F.count(F.lit(1)).alias("runs"), F.round(percentile_cont("b", 0.5), 3).alias("before"), F.round(percentile_cont("m", 0.5, "f >= g"), 3).alias("first"), F.round(percentile_cont("r", 0.5), 3).alias("rest"))


@query("A49_audit_summary", "SELECT p_brand AS code, count(*) AS findings, count(DISTINCT p_type) AS kinds FROM part WHERE p_size < 20 GROUP BY 1")
def a49(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size < 20").groupBy(F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("p_type").alias("kinds"))


@query("F24_error_exclusion", "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean FROM events WHERE NOT coalesce(json_extract_string(props, '$.error'), '') <> '' AND value > 1 GROUP BY 1")
def f24(spark, sf_dir):
    error = F.get_json_object("props", "$.error")
    return table(spark, sf_dir, "events").where((error.isNull() | (error == "")) & (F.col("value") > 1)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("F28_flagged_claims", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R' OR l_discount < 0.03) AS flagged, bool_or(l_returnflag = 'R') OR min(l_discount) < 0.01 AS needs_revision FROM lineitem GROUP BY 1")
def f28(spark, sf_dir):
    bad = F.col("l_returnflag") == "R"
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(bad | (F.col("l_discount") < 0.03)).alias("flagged"), (F.bool_or(bad) | (F.min("l_discount") < 0.01)).alias("needs_revision"))


@query("F30_gate_compare", "SELECT vec_id, coalesce(CASE WHEN label <> 3 THEN label / 10 END >= 0.5, false) AS passed FROM embeddings")
def f30(spark, sf_dir):
    grade = F.when(F.col("label") != 3, F.col("label") / 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(grade >= 0.5, F.lit(False)).alias("passed"))


@query("F27_chosen_subset", "SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 2, 3, 50, 99)")
def f27(spark, sf_dir):
    from brindle.operators.joins import chosen

    return chosen(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", [1, 2, 3, 50, 99])


@query("J40_proxy_agreement", "SELECT quality, count(*) AS n, round(avg(CASE WHEN label IS NULL THEN NULL ELSE ((label > 4) = (quality = 1))::INT END), 9) AS agree FROM labels LEFT JOIN embeddings ON vec_id = doc_id GROUP BY quality")
def j40(spark, sf_dir):
    out = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    agree = F.when(F.col("label").isNotNull(), ((F.col("label") > 4) == (F.col("quality") == 1)).cast("int"))
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(agree), 9).alias("agree"))
