"""Streaming queries: they read the event log as a stream, drain it and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import windows as W
from brindle.operators.tables import shared_dir
from brindle.plans.registry import query, table
from brindle.sources.run_log import RunLog
from brindle.streaming import runs, settled


def _drained(spark, sf_dir, build, mode, rocksdb=False):
    events = table(spark, sf_dir, "events")
    log = runs.log_stream(spark, f"{sf_dir}/events.parquet*", events.schema)
    result = build(log)
    out = shared_dir(spark, "sink")
    runs.drain(result, out, shared_dir(spark, "stream"), mode, rocksdb)
    return out, result.schema


@query("K14_stream_signal_counts", """SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTES, ts)""")
def k14_stream(spark, sf_dir):
    out = runs.latest(spark, *_drained(spark, sf_dir, runs.signal_counts, "update"), ["event_type", "start"], "n")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_SEQ = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"
#: Runs with gaps, and the time that the stream's watermark ends at. What is not over by then is no row of a stream.
_RUNS = """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l),
r AS (SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n, max(ts) AS last, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  coalesce(sum(round(value::DECIMAL(20, 2) * 100)) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS cents FROM s GROUP BY user_id, run),
f AS (SELECT * FROM r WHERE last + INTERVAL 6 HOURS < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES)"""


@query("K1_stream_sequence", _SEQ)
def k1_stream(spark, sf_dir):
    """Numbers come from the stream for what its watermark has passed, and are counted on for the last minutes."""
    out, schema = _drained(spark, sf_dir, lambda log: settled.processed(log, settled.Sequence()), "append", rocksdb=True)
    return settled.with_tail(spark.read.schema(schema).parquet(out), table(spark, sf_dir, "events"))


def _runs(spark, sf_dir):
    out, schema = _drained(spark, sf_dir, lambda log: settled.processed(log, settled.Runs(6 * 3600 * 1000)), "append", rocksdb=True)
    return spark.read.schema(schema).parquet(out)


@query("K6_stream_stale_runs", f"{_RUNS} SELECT user_id, started, n FROM f WHERE status = 'failed'")
def k6_stream(spark, sf_dir):
    return _runs(spark, sf_dir).where("status = 'failed'").select("user_id", "started", "n")


@query("K10_stream_orphan_settlement", f"{_RUNS} SELECT user_id, started, cents AS released FROM f WHERE status = 'failed' AND cents > 0")
def k10_stream(spark, sf_dir):
    return _runs(spark, sf_dir).where("released > 0").select("user_id", "started", "released")


@query("K4_stream_coalesced", """SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, string_agg(event_type, '' ORDER BY ts, event_id) AS deltas FROM events
GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def k4_stream(spark, sf_dir):
    out, schema = _drained(spark, sf_dir, settled.coalesced, "append")
    return spark.read.schema(schema).parquet(out).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "deltas")


@query("J8_stream_clicks_to_purchases", "SELECT a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR")
def j8_stream(spark, sf_dir):
    out, schema = _drained(spark, sf_dir, lambda log: settled.followed(log, "click", "purchase"), "append")
    return spark.read.schema(schema).parquet(out)


@query("K2_K8_stream_followed", """WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20),
e AS (SELECT user_id, min(seq) AS last FROM s WHERE event_type = 'purchase' AND seq > 2 GROUP BY user_id)
SELECT user_id, event_id, seq FROM s JOIN top USING (user_id) LEFT JOIN e USING (user_id) WHERE seq > 2 AND seq <= coalesce(last, seq)""")
def k2_stream(spark, sf_dir):
    """The twenty longest runs behind their second row until a purchase: the log arrives in two parts, with gaps between
    them, and the stream is stopped after the first and goes on from its checkpoint."""
    events = table(spark, sf_dir, "events")
    numbered = W.sequence(events, "user_id", ["ts", "event_id"])
    rows = numbered.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("seq").cast("int").alias("seq"), F.col("event_type").alias("type"),
        F.col("event_id").cast("string").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))
    longest = events.groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").limit(20)
    spark.dataSource.register(RunLog)
    log, out, checkpoint = (shared_dir(spark, n) for n in ("log", "sink", "stream"))
    followed = spark.readStream.format("run_log").option("path", log).option("runs", ",".join(str(r.user_id) for r in longest.collect()))
    followed = followed.option("after", 2).option("until", "purchase").option("rows", 1000).load()
    for later in (False, True):
        part = rows.where((F.col("seq") % 3 == 0) == F.lit(later))
        part.repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq").write.mode("append").parquet(log)
        runs.drain(followed, out, checkpoint)
    return spark.read.schema(followed.schema).parquet(out).select(F.col("run_id").cast("long").alias("user_id"), F.col("payload").cast("long").alias("event_id"), "seq")
