"""Queries on scopes, filters and caches: documents are chunks, sources and nations are collections, orders are invites."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from brindle.operators import scopes as S
from brindle.plans.registry import query, table

_DAY = "DATE '2024-01-01' + (doc_id % 300)::INT"


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("tags"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("doc_id") % 300).cast("int")).alias("created_at"),
        F.concat(F.lit("text/"), F.col("lang")).alias("mime"), F.when(F.col("doc_id") % 4 == 0, "web").otherwise("document").alias("source_type"), (F.col("doc_id") % 9).cast("int").alias("page"), "source",
    )


@query("F2_summary_scope", "SELECT 'none' AS asked, doc_id FROM documents UNION ALL SELECT 'document', doc_id FROM documents")
def f2(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id")
    asked = {"none": (None, None), "document": ("document", None), "web": ("web", None), "page": (None, 3)}
    out = None
    for name, (kind, page) in asked.items():
        part = S.summary_scope(own, kind, page).select(F.lit(name).alias("asked"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("F3_narrowing_filters", f"""SELECT 'tags' AS asked, doc_id FROM documents WHERE lang = 'de' OR n_chars > 2000 UNION ALL SELECT 'dates', doc_id FROM documents WHERE {_DAY} BETWEEN DATE '2024-02-01' AND DATE '2024-03-01'
UNION ALL SELECT 'all', doc_id FROM documents WHERE doc_id IN (1, 2, 3, 5, 8, 13) AND doc_id % 4 <> 0 AND doc_id % 9 = 5 UNION ALL SELECT 'mime', doc_id FROM documents WHERE lang = 'fr'""")
def f3(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    parts = {
        "tags": S.narrowed(rows, tags=["de", "long"]), "dates": S.narrowed(rows, since=dt.date(2024, 2, 1), until=dt.date(2024, 3, 1)),
        "all": S.narrowed(rows, ids=[1, 2, 3, 5, 8, 13], source_type="document", page=5), "mime": S.narrowed(rows, mime="text/fr"),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("asked"), F.col("id").alias("doc_id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("F4_visible_collections", "SELECT n_nationkey, n_regionkey = 1 OR n_nationkey % 4 = 2 AS visible FROM nation")
def f4(spark, sf_dir):
    owner, kind = F.concat(F.lit("u"), (F.col("n_nationkey") % 4).cast("string")), F.when(F.col("n_regionkey") == 1, "shared").otherwise("private")
    return table(spark, sf_dir, "nation").select("n_nationkey", S.visible(owner, kind, "u2").alias("visible"))


def _collections(spark, sf_dir):
    chat = F.when(F.col("n_regionkey") == 0, "chat").otherwise("library")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), chat.alias("kind"), (F.col("n_nationkey") % 5).alias("chat_id"), F.when(F.col("n_regionkey") == 1, "shared").otherwise("private").alias("visibility"))


_SCOPE = """(SELECT id, min(ord) AS ord FROM (SELECT n_nationkey::BIGINT AS id, -1 AS ord FROM nation WHERE (n_regionkey = 0 AND n_nationkey % 5 = 0) OR n_regionkey = 1
UNION ALL SELECT * FROM (VALUES (3, 0), (1, 1), (24, 2), (3, 3)) t(id, ord)) GROUP BY id)"""


@query("F5_resolved_scope", f"SELECT id, ord FROM {_SCOPE}")
def f5(spark, sf_dir):
    return S.resolved_scope(_collections(spark, sf_dir), 0, [3, 1, 24, 3])


@query("F6_searchable_documents", f"SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT id FROM {_SCOPE})")
def f6(spark, sf_dir):
    scope = S.resolved_scope(_collections(spark, sf_dir), 0, [3, 1, 24, 3])
    return S.searchable(table(spark, sf_dir, "customer"), scope, "c_nationkey", "c_mktsegment", ("BUILDING",)).select("c_custkey", "c_name").orderBy("c_name")


@query("F7_empty_scope", "SELECT c_custkey FROM customer WHERE false")
def f7(spark, sf_dir):
    return S.searchable(table(spark, sf_dir, "customer"), spark.createDataFrame([], "id long"), "c_nationkey", "c_mktsegment", ("BUILDING",)).select("c_custkey")


@query("U7_scope_branches", "SELECT event_id FROM events WHERE (event_type <> 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) OR (event_type = 'view' AND event_id % 7 = 2)")
def u7(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "web").otherwise("document")
    chunks = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), kind.alias("source_type"), (F.col("event_id") % 7).alias("chat_id"))
    mine = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("document_id"))
    return S.web_branch(chunks, mine, 2).select("event_id")


@query("F12_hours_cutoff", """SELECT h AS hours, count(*) AS n FROM events, (SELECT unnest([0, 24, 5000]) AS h), (SELECT max(ts) AS now FROM events) WHERE ts >= now - to_hours(greatest(1, least(168, h))::INT) GROUP BY h""")
def f12(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    asked = now.select("now", F.explode(F.array(*[F.lit(h) for h in (0, 24, 5000)])).alias("hours"))  # three rows
    since = F.col("now") - F.make_dt_interval(hours=S.clamped_hours(F.col("hours")))
    return events.join(F.broadcast(asked.select("hours", since.alias("since")))).where("ts >= since").groupBy("hours").agg(F.count(F.lit(1)).alias("n"))


@query("F13_listed_rows", "SELECT p_partkey, p_brand IN ('Brand#2', 'Brand#17') AS listed FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def f13(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey", F.col("p_brand").isin("Brand#2", "Brand#17").alias("listed"))


@query("F16_null_defaults", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic IS NOT NULL AS graded FROM documents d LEFT JOIN labels l USING (doc_id)")
def f16(spark, sf_dir):
    out = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNotNull().alias("graded"))


@query("F18_display_names", "SELECT doc_id, coalesce(c_name, url) AS name FROM documents LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = doc_id LEFT JOIN pages ON page_id = doc_id")
def f18(spark, sf_dir):
    docs, names, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), table(spark, sf_dir, "pages")
    out = docs.join(names, F.col("c_custkey") == F.col("doc_id"), "left").join(pages, F.col("page_id") == F.col("doc_id"), "left")
    return out.select("doc_id", F.coalesce("c_name", "url").alias("name"))


_NOW = "(SELECT max(o_orderdate) - INTERVAL 20 DAYS AS now FROM orders)"
_STATUS = "CASE WHEN o_orderstatus = 'P' THEN 'revoked' WHEN o_orderpriority = '1-URGENT' THEN 'used' WHEN o_orderdate + INTERVAL 30 DAYS <= now THEN 'expired' ELSE 'live' END"


def _invites(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    now = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 20 DAYS")).alias("now"))  # one row
    status = S.invite_status(F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.col("now"))
    return orders.join(F.broadcast(now)).withColumn("status", status)


@query("F20_invite_status", f"SELECT o_orderkey, {_STATUS} AS status FROM orders, {_NOW}")
def f20(spark, sf_dir):
    return _invites(spark, sf_dir).select("o_orderkey", "status")


@query("F21_live_invites", f"SELECT o_orderkey, o_custkey FROM orders, {_NOW} WHERE {_STATUS} = 'live'")
def f21(spark, sf_dir):
    return _invites(spark, sf_dir).where("status = 'live'").select("o_orderkey", "o_custkey")


@query("F22_expiry", f"SELECT o_orderkey, o_orderdate > now - INTERVAL 90 DAYS AS fresh, o_orderdate + INTERVAL 30 DAYS <= now AS gone FROM orders, {_NOW}")
def f22(spark, sf_dir):
    orders = _invites(spark, sf_dir).withColumn("expires_at", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return orders.select("o_orderkey", S.fresh(F.col("o_orderdate"), F.col("now"), "90 DAYS").alias("fresh"), (F.col("expires_at") <= F.col("now")).alias("gone"))


@query("K11_expired_sweep", f"SELECT o_orderkey FROM orders, {_NOW} WHERE o_orderdate + INTERVAL 30 DAYS > now")
def k11(spark, sf_dir):
    orders = _invites(spark, sf_dir).withColumn("expires_at", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return orders.join(S.expired(orders, F.col("now")).select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


@query("F23_enabled_models", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % 10 WHERE p_size > 10 AND s_acctbal > 0")
def f23(spark, sf_dir):
    models, providers = table(spark, sf_dir, "part").where("p_size > 10"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return models.join(providers, F.col("s_suppkey") == F.col("p_partkey") % 10).select("p_partkey", "s_suppkey")


@query("T14_first_enabled_model", "SELECT min(p_partkey) AS p_partkey FROM part JOIN supplier ON s_suppkey = p_partkey % 10 WHERE p_size > 10 AND s_acctbal > 0")
def t14(spark, sf_dir):
    return f23(spark, sf_dir).agg(F.min("p_partkey").alias("p_partkey"))


@query("J19_model_providers", "SELECT p_partkey, s_name AS provider, p_size > 10 AND s_acctbal > 0 AS available FROM part JOIN supplier ON s_suppkey = p_partkey % 10")
def j19(spark, sf_dir):
    out = table(spark, sf_dir, "part").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("p_partkey") % 10)
    return out.select("p_partkey", F.col("s_name").alias("provider"), ((F.col("p_size") > 10) & (F.col("s_acctbal") > 0)).alias("available"))


@query("F26_free_models", "SELECT p_partkey, p_brand || '/' || p_name || CASE WHEN p_size % 5 = 0 THEN ':free' WHEN p_size % 5 = 1 THEN '/free' ELSE '' END AS model, p_size % 5 < 2 AS free FROM part")
def f26(spark, sf_dir):
    tail = F.when(F.col("p_size") % 5 == 0, ":free").when(F.col("p_size") % 5 == 1, "/free").otherwise("")
    out = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name", tail).alias("model"))
    return out.withColumn("free", S.free_model(F.col("model")))


_CACHE = """c AS (SELECT sha256('model-a:' || trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS hash, item_id AS value, TIMESTAMP '2024-01-01' + to_hours((item_id % 30)::INT) AS created_at FROM benchmark WHERE item_id % 2 = 0),
q AS (SELECT item_id, sha256('model-a:' || trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS hash FROM benchmark)"""


def _cache(spark, sf_dir):
    from brindle.functions.text import query_hash

    items = table(spark, sf_dir, "benchmark").select("item_id", query_hash(F.col("text"), "model-a:").alias("hash"))
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("item_id") % 30).cast("int"))
    return items, items.where("item_id % 2 = 0").select("hash", F.col("item_id").alias("value"), at.alias("created_at"))


@query("J34_cached_and_missing", f"WITH {_CACHE}, l AS (SELECT hash, arg_max(value, created_at) AS value FROM c WHERE created_at > TIMESTAMP '2024-01-02' - INTERVAL 12 HOURS GROUP BY hash) SELECT item_id, value, value IS NULL AS missing FROM q LEFT JOIN l USING (hash)")
def j34(spark, sf_dir):
    items, cache = _cache(spark, sf_dir)
    out = S.cached(items, cache, F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz"), "12 HOURS")
    return out.select("item_id", "value", F.col("value").isNull().alias("missing"))


@query("R18_cache_put", f"WITH {_CACHE} SELECT hash, value FROM c WHERE hash NOT IN (SELECT hash FROM q WHERE item_id < 10) UNION ALL SELECT hash, item_id + 1000 FROM q WHERE item_id < 10")
def r18(spark, sf_dir):
    items, cache = _cache(spark, sf_dir)
    new = items.where("item_id < 10").select("hash", (F.col("item_id") + 1000).alias("value"), F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz").alias("created_at"))
    return S.put(cache, new).select("hash", "value")


@query("S17_unexpired_pages", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) ")
def s17(spark, sf_dir):
    from brindle.operators.ingest import web_ingest

    pages = table(spark, sf_dir, "pages")
    now = F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")
    ends = F.when(F.col("page_id") % 3 == 0, F.lit(dt.datetime(2024, 1, 3))).otherwise(F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz")
    held = pages.select(F.lit(1).alias("chat_id"), "url", ends.alias("expires_at"))
    return web_ingest(pages.select(F.lit(1).alias("chat_id"), "url", "page_id"), held, now).select("page_id", "url")


@query("M10_get_or_create", "SELECT c_nationkey AS id, 'old' AS made FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)")
def m10(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_nationkey").alias("id"), F.lit("old").alias("made")).distinct()
    return S.get_or_create(old, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("new").alias("made")), ["id"])
