"""Queries over the event log: users are runs or ledger accounts, values are credits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import chains as C
from brindle.operators import windows as W
from brindle.plans.registry import query, table

_CENTS = "value::DECIMAL(20, 2)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("cents", F.col("value").cast("decimal(20,2)"))


@query("W4_rolling_5h", f"""SELECT event_id, user_id, (sum({_CENTS}) OVER w)::DOUBLE AS credits_5h, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW)""")
def w4(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "user_id", W.rolling("sum(cents)", "user_id", "ts", "5 HOURS").cast("double").alias("credits_5h"), W.rolling("count(1)", "user_id", "ts", "5 HOURS").alias("n"))


@query("W5_month_to_date", f"""SELECT event_id, user_id, (sum({_CENTS}) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts RANGE UNBOUNDED PRECEDING))::DOUBLE AS credits_month FROM events""")
def w5(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "user_id", W.month_to_date("sum(cents)", "user_id", "ts").cast("double").alias("credits_month"))


_NOW = "(SELECT max(ts) AS now FROM events)"


@query("W6_A7_quota_status", f"""SELECT user_id, coalesce(sum({_CENTS}) FILTER (WHERE ts >= now - INTERVAL 5 HOURS), 0)::DOUBLE AS used_5h,
  coalesce(sum({_CENTS}) FILTER (WHERE ts >= date_trunc('month', now)), 0)::DOUBLE AS used_month,
  strftime(min(ts) FILTER (WHERE ts >= now - INTERVAL 5 HOURS) + INTERVAL 5 HOURS, '%Y-%m-%d %H:%M:%S') AS resets_5h,
  strftime(date_trunc('month', any_value(now)) + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS resets_month
FROM events, {_NOW} GROUP BY user_id""")
def w6(spark, sf_dir):
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts").alias("now"))  # one row
    recent, month = F.col("ts") >= F.col("now") - F.expr("INTERVAL 5 HOURS"), F.col("ts") >= F.date_trunc("month", "now")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return events.join(F.broadcast(now)).groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(recent, F.col("cents"))), F.lit(0)).cast("double").alias("used_5h"),
        F.coalesce(F.sum(F.when(month, F.col("cents"))), F.lit(0)).cast("double").alias("used_month"),
        stamp(F.min(F.when(recent, F.col("ts"))) + F.expr("INTERVAL 5 HOURS")).alias("resets_5h"),
        stamp(W.next_month(F.first("now"))).alias("resets_month"),
    )


@query("W8_rolling_cap", """SELECT event_id, user_id, count(*) OVER w AS used, count(*) OVER w >= 4 AS capped,
  greatest(1, 86400 - floor(date_diff('microsecond', min(ts) OVER w, ts) / 1000000))::BIGINT AS retry_after FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)""")
def w8(spark, sf_dir):
    used, oldest = W.rolling("count(1)", "user_id", "ts", "24 HOURS"), W.rolling("min(ts)", "user_id", "ts", "24 HOURS")
    out = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", used.alias("used"), oldest.alias("oldest"))
    age = F.floor(F.expr("timestampdiff(MICROSECOND, oldest, ts)") / 1000000)
    return out.select("event_id", "user_id", "used", (F.col("used") >= 4).alias("capped"), F.greatest(F.lit(1), 86400 - age).cast("long").alias("retry_after"))


@query("W11_time_to_first", """SELECT user_id, date_diff('microsecond', min(ts), min(ts) FILTER (WHERE event_type = 'purchase')) AS micros FROM events GROUP BY user_id""")
def w11(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("b"))
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, a, b)").alias("micros"))


@query("W22_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 4")
def w22(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("neg", -F.col("turn"))
    return W.sequence(turns, "conv_id", ["neg", "role", "text"], "n").where("n <= 4").select("conv_id", "turn", "role")


@query("W23_history", "SELECT conv_id, turn, role FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system'")
def w23(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("trim(coalesce(text, '')) <> '' and role <> 'system'").select("conv_id", "turn", "role")


@query("W14_one_per_source", """WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
SELECT doc_id, source, n_chars FROM r WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 5""")
def w14(spark, sf_dir):
    best = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.struct("n_chars", F.negative("doc_id").alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("doc_id"), "source", "b.n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(5)


@query("K1_gapless_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def k1(spark, sf_dir):
    return W.sequence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("S24_replay", """WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
SELECT * FROM s WHERE user_id = 7 AND seq > 5 ORDER BY seq LIMIT 500""")
def s24(spark, sf_dir):
    mine = table(spark, sf_dir, "events").where("user_id = 7")
    return W.sequence(mine, "user_id", ["ts", "event_id"]).where("seq > 5").select("event_id", "user_id", "seq").orderBy("seq").limit(500)


@query("J35_fifo_steps", """WITH a AS (SELECT user_id, ts AS started, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, ts AS ended, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase')
SELECT user_id, n, date_diff('microsecond', started, ended) AS micros FROM a JOIN b USING (user_id, n)""")
def j35(spark, sf_dir):
    kind = F.col("event_type")
    out = W.fifo_pairs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind == "click", kind == "purchase", "ts")
    return out.select("user_id", "n", F.expr("timestampdiff(MICROSECOND, started, ended)").alias("micros"))


@query("K6_stale_runs", f"""SELECT user_id, count(*) AS n FROM events, {_NOW} GROUP BY user_id, now HAVING max(ts) < now - INTERVAL 6 HOURS AND arg_max(event_type, (ts, event_id)) <> 'purchase'""")
def k6(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    last = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.join(F.broadcast(now)).where((F.col("last") < F.col("now") - F.expr("INTERVAL 6 HOURS")) & (F.col("state") != "purchase")).select("user_id", "n")


@query("K7_fold_runs", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS last_view,
  max(event_id) AS last_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def k7(spark, sf_dir):
    at = F.struct("ts", "event_id")
    view = F.when(F.col("event_type") == "view", at)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", at).alias("state"), F.max_by("value", view).alias("last_view"), F.max("event_id").alias("last_id"), F.count_distinct("event_type").alias("kinds")
    )


@query("K8_resume_offset", "SELECT user_id, count(*) AS last_seq FROM events GROUP BY user_id")
def k8(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("last_seq"))  # numbers are gapless


@query("K4_coalesced_windows", """SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, string_agg(event_type, '' ORDER BY ts, event_id) AS deltas FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)""")
def k4(spark, sf_dir):
    w = F.window("ts", "1 hour")
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    out = table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.array_join(F.transform(parts, lambda x: x["event_type"]), "").alias("deltas"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "deltas")


@query("K14_signal_counts", """SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTES, ts)""")
def k14(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("K5_sessions", """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS micros, count(*) AS n FROM s GROUP BY user_id, session""")
def k5(spark, sf_dir):
    out = W.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "12 hours")
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, start, last)").alias("micros"), "n")


@query("K9_ledger_states", f"""WITH s AS (SELECT user_id, event_id, {_CENTS} AS v, CASE event_type WHEN 'click' THEN 'reserved' WHEN 'purchase' THEN 'settled' ELSE 'metered' END AS status FROM events)
SELECT user_id, coalesce(sum(v) FILTER (WHERE status = 'reserved'), 0)::DOUBLE AS reserved, coalesce(sum(v) FILTER (WHERE status = 'settled'), 0)::DOUBLE AS settled,
  coalesce(sum(greatest(v, 0)) FILTER (WHERE status = 'metered'), 0)::DOUBLE AS metered FROM s GROUP BY user_id""")
def k9(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "reserved").when(F.col("event_type") == "purchase", "settled").otherwise("metered")
    part = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.greatest(F.col("cents"), F.lit(0)) if s == "metered" else F.col("cents"))), F.lit(0)).cast("double").alias(s)
    return _events(spark, sf_dir).withColumn("status", status).groupBy("user_id").agg(part("reserved"), part("settled"), part("metered"))


@query("W10_longest_gaps", """WITH l AS (SELECT *, lag(ts) OVER w AS a, lag(event_type) OVER w AS k, min(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CASE WHEN k <> 'click' THEN date_diff('microsecond', a, ts) END AS gap FROM l) SELECT user_id, max(gap) FILTER (WHERE t IS NULL OR ts <= t) AS before, max(gap) FILTER (WHERE ts > t) AS after FROM g GROUP BY 1""")
def w10(spark, sf_dir):
    return W.longest_gaps(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", "purchase", "click")


@query("W12_span_residuals", """WITH a AS (SELECT user_id, ts AS started, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, ts AS ended, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, sum(date_diff('microsecond', started, ended))::BIGINT AS x FROM a JOIN b USING (user_id, n) WHERE ended >= started GROUP BY 1), w AS (SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS total FROM events GROUP BY 1)
SELECT user_id, total, coalesce(x, 0) AS attributed, greatest(total - coalesce(x, 0), 0) AS residual FROM w LEFT JOIN s USING (user_id)""")
def w12(spark, sf_dir):
    kind, events = F.col("event_type"), table(spark, sf_dir, "events")
    spans = W.fifo_pairs(events, "user_id", ["ts", "event_id"], kind == "click", kind == "purchase", "ts")
    return W.span_residuals(spans, events, "user_id", "ts")


@query("W20_packed_batches", """WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, q, n, 0 AS batch, q AS used FROM r WHERE n = 1 UNION ALL
SELECT r.l_orderkey, r.l_linenumber, r.q, r.n, CASE WHEN used + r.q > 60 THEN batch + 1 ELSE batch END, CASE WHEN used + r.q > 60 THEN r.q ELSE used + r.q END FROM p JOIN r ON r.l_orderkey = p.l_orderkey AND r.n = p.n + 1)
SELECT l_orderkey, n, batch FROM p""")
def w20(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), F.col("l_quantity").cast("int").alias("q"))
    return C.packed_batches(rows, "l_orderkey", "n", "q", 60).select("l_orderkey", "n", "batch")


def _limited(key: str, interval: str, limit: int) -> str:
    """A CTE p (event_id, key, ts, n, accepted, live): ``live`` are the accepted times in the window before a row."""
    live = f"list_filter(p.taken, lambda t: r.ts - t < INTERVAL {interval})"
    step = f"SELECT r.event_id, r.{key}, r.ts, r.n, {live} AS live FROM p JOIN r ON r.{key} = p.{key} AND r.n = p.n + 1"
    return f"""r AS (SELECT event_id, {key}, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT event_id, {key}, ts, n, true AS accepted, []::TIMESTAMP[] AS live, [ts] AS taken FROM r WHERE n = 1 UNION ALL
SELECT event_id, {key}, ts, n, len(live) < {limit}, live, CASE WHEN len(live) < {limit} THEN list_append(live, ts) ELSE live END FROM ({step}))"""


_LIMITED = f"WITH RECURSIVE {_limited('user_id', '12 HOURS', 3)}"


@query("W7_rate_limit", f"{_LIMITED} SELECT event_id, user_id, accepted FROM p")
def w7(spark, sf_dir):
    out = W.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 3600 * 12)
    return out.select("event_id", "user_id", "accepted")


_BREAKER = """WITH RECURSIVE r AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_id, user_id, ts, n, 'closed' AS state, bad::INT AS failures, NULL::TIMESTAMP AS opened FROM r WHERE n = 1 UNION ALL
SELECT event_id, user_id, ts, n, state, CASE WHEN state = 'open' THEN failures WHEN bad THEN failures + 1 ELSE 0 END,
  CASE WHEN state = 'open' THEN opened WHEN bad AND (failures + 1 >= 2 OR state = 'half_open') THEN ts WHEN bad THEN opened ELSE NULL END
FROM (SELECT r.event_id, r.user_id, r.ts, r.n, r.bad, s.failures, s.opened, CASE WHEN s.opened IS NULL THEN 'closed' WHEN r.ts - s.opened >= INTERVAL 24 HOURS THEN 'half_open' ELSE 'open' END AS state FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))"""


@query("W9_circuit_breaker", f"{_BREAKER} SELECT event_id, user_id, state FROM s")
def w9(spark, sf_dir):
    out = C.circuit_states(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 2, 3600 * 24)
    return out.select("event_id", "user_id", "state")


@query("K13_limited_by_state", f"{_LIMITED} SELECT user_id, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected FROM p GROUP BY 1")
def k13(spark, sf_dir):
    return w7(spark, sf_dir).groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


_WAIT = "greatest(1, round_even(43200 - date_diff('microsecond', list_min(live), ts) / 1000000.0, 0))::BIGINT"


def _bucket(key: str, limit: int) -> str:
    return f"(WITH RECURSIVE {_limited(key, '12 HOURS', limit)} SELECT event_id, CASE WHEN NOT accepted THEN {_WAIT} END AS wait FROM p)"


@query("W24_two_buckets", f"SELECT event_id, greatest(u.wait, t.wait) AS wait FROM {_bucket('user_id', 3)} u JOIN {_bucket('event_type', 25)} t USING (event_id)")
def w24(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    by_user, by_type = (W.rate_limited(events, key, "ts", "event_id", limit, 3600 * 12) for key, limit in (("user_id", 3), ("event_type", 25)))
    return W.longest_wait(by_user, by_type, "event_id")


@query("K2_followed_run", "SELECT event_id, seq FROM (SELECT event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE user_id = 3) WHERE seq > 2 AND seq <= coalesce((SELECT min(s) FROM (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS s FROM events WHERE user_id = 3) WHERE event_type = 'purchase' AND s > 2), 1000000)")
def k2(spark, sf_dir):
    mine = W.sequence(table(spark, sf_dir, "events").where("user_id = 3"), "user_id", ["ts", "event_id"]).where("seq > 2")
    done = F.max((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return mine.withColumn("_done", done).where("coalesce(_done, 0) = 0").select("event_id", "seq")


@query("K10_orphan_settlement", f"SELECT user_id, sum({_CENTS}) FILTER (WHERE event_type = 'click')::DOUBLE AS released FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'click') > 0 AND max(ts) < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTES")
def k10(spark, sf_dir):
    events = _events(spark, sf_dir)
    now = events.agg(F.max("ts").alias("now"))  # one row
    runs = events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", F.col("cents"))).cast("double").alias("released"), F.max("ts").alias("last"))
    return runs.where("released is not null").join(F.broadcast(now)).where(F.col("last") < F.col("now") - F.expr("INTERVAL 5 MINUTES")).select("user_id", "released")


@query("K16_document_states", """SELECT o_custkey, arg_max(o_orderstatus, (CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey)) AS state, count(*) AS changes FROM orders GROUP BY 1""")
def k16(spark, sf_dir):
    step = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct(step, "o_orderkey")).alias("state"), F.count(F.lit(1)).alias("changes"))


@query("K19_finalised_runs", """SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
'{"n":' || count(*) || ',"kinds":' || count(DISTINCT event_type) || '}' AS metrics FROM events GROUP BY 1""")
def k19(spark, sf_dir):
    at = F.struct("ts", "event_id")
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("k"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))
    status = F.when(F.col("k") == "purchase", "completed").when(F.col("k") == "error", "failed").otherwise("running")
    return out.select("user_id", status.alias("status"), F.to_json(F.struct("n", "kinds")).alias("metrics"))
