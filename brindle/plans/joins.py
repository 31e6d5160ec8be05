"""Join, set and rewrite queries over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import chains as C
from brindle.operators import joins as J
from brindle.plans.registry import query, table


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("J5_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)")
def j5(spark, sf_dir):
    orders, customer, nation = _t(spark, sf_dir, "orders", "customer", "nation")
    mine = customer.join(nation.where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("J9_unlabelled_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j9(spark, sf_dir):
    documents, labels = _t(spark, sf_dir, "documents", "labels")
    return documents.join(labels, "doc_id", "left_anti").select("doc_id")


@query("J10_first_wins_self_join", """WITH c AS (SELECT user_id, value AS weight FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT event_id, user_id, weight FROM events JOIN c USING (user_id) WHERE event_type = 'view'""")
def j10(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.where("event_type = 'click'").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("weight"))
    return events.where("event_type = 'view'").join(first, "user_id").select("event_id", "user_id", "weight")


@query("J11_left_outer", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j11(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    n = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("J12_coalesced_keys", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, e.label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = coalesce(l.doc_id, d.doc_id // 2)""")
def j12(spark, sf_dir):
    documents, labels, embeddings = _t(spark, sf_dir, "documents", "labels", "embeddings")
    l = labels.select(F.col("doc_id").alias("l_id"), "quality")
    out = documents.join(l, F.col("doc_id") == F.col("l_id"), "left").withColumn("key", F.coalesce("l_id", F.expr("doc_id div 2")))
    return out.join(embeddings, F.col("vec_id") == F.col("key"), "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "label")


@query("J13_latest_per_group", """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey""")
def j13(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    last = J.latest(orders, "o_custkey", F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_orderstatus"])
    return customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("J18_inner_chain", """SELECT l_orderkey, l_linenumber, s_name, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def j18(spark, sf_dir):
    lineitem, supplier, nation, region = _t(spark, sf_dir, "lineitem", "supplier", "nation", "region")
    where = nation.join(region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    return lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name", "n_name", "r_name")


@query("J20_orphans", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 300 DAYS AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')""")
def j20(spark, sf_dir):
    orders, lineitem = _t(spark, sf_dir, "orders", "lineitem")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    old = orders.where("o_orderstatus = 'O'").join(F.broadcast(now)).where("o_orderdate < now - INTERVAL 300 DAYS")
    return old.join(lineitem.where("l_linestatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("J23_costs_onto_calls", """SELECT o_orderkey, count(l_orderkey) AS n_found, sum((l_orderkey IS NULL)::INT) AS n_missing, round(coalesce(sum(l_extendedprice::DECIMAL(20, 2)), 0)::DOUBLE, 2) AS cost
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def j23(spark, sf_dir):
    orders, lineitem = _t(spark, sf_dir, "orders", "lineitem")
    costs = lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("c"))
    out = orders.join(costs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_found"), F.col("n").isNull().cast("long").alias("n_missing"), F.round(F.coalesce(F.col("c").cast("double"), F.lit(0.0)), 2).alias("cost"))


@query("J26_flag_onto_rows", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS flagged FROM documents")
def j26(spark, sf_dir):
    documents, labels = _t(spark, sf_dir, "documents", "labels")
    bad = labels.where("toxic = 1").select("doc_id").distinct().withColumn("_f", F.lit(True))
    return documents.join(bad, "doc_id", "left").select("doc_id", F.col("_f").isNotNull().alias("flagged"))


@query("J27_conflict_pairs", """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem QUALIFY r <= 5)
SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.r < b.r""")
def j27(spark, sf_dir):
    return J.pairs_within(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_linenumber")


@query("J33_price_fallback", """SELECT l_orderkey, l_linenumber, coalesce(p.p_retailprice, q.p_retailprice, 0) AS p_retailprice FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON p.p_partkey = l_partkey
LEFT JOIN (SELECT * FROM part WHERE p_size > 25) q ON q.p_partkey = l_suppkey""")
def j33(spark, sf_dir):
    lineitem, part = _t(spark, sf_dir, "lineitem", "part")
    return J.fallback_lookup(lineitem, part.where("p_size > 25"), "l_partkey", "l_suppkey", "p_partkey", "p_retailprice").select("l_orderkey", "l_linenumber", "p_retailprice")


@query("J37_assembled_messages", """SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || turn, ',' ORDER BY turn, role)) AS roles FROM conversations GROUP BY conv_id""")
def j37(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role")))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), parts.alias("p"))
    return out.select("conv_id", "n", F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), ",")).alias("roles"))


@query("U1_union_all", "SELECT doc_id AS id, 'quality' AS kind FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def u1(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("quality").alias("kind")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("kind")))


@query("U4_common_items", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def u4(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'O'").select("o_custkey").intersect(orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("U5_set_difference", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def u5(spark, sf_dir):
    part, lineitem = _t(spark, sf_dir, "part", "lineitem")
    return part.join(lineitem.where("l_returnflag = 'R' and l_quantity >= 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("U8_distinct_filters", "SELECT DISTINCT lang, source FROM documents")
def u8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("T8_newest_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def t8(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(100).select("o_orderkey", "o_totalprice")


@query("M2_upsert", """SELECT coalesce(c.c_custkey, s.s_suppkey) AS c_custkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE c.c_name END AS c_name, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_acctbal ELSE c.c_acctbal END AS c_acctbal
FROM customer c FULL JOIN (SELECT s_suppkey + 5 AS s_suppkey, s_name, s_acctbal FROM supplier) s ON c.c_custkey = s.s_suppkey""")
def m2(spark, sf_dir):
    customer, supplier = _t(spark, sf_dir, "customer", "supplier")
    updates = supplier.select((F.col("s_suppkey") + 5).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return J.upsert(customer.select("c_custkey", "c_name", "c_acctbal"), updates, ["c_custkey"])


@query("M3_claim_once", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS claimed FROM events WHERE event_type = 'signup'""")
def m3(spark, sf_dir):
    return J.claim_once(table(spark, sf_dir, "events").where("event_type = 'signup'"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "claimed")


@query("M5_ttl_cascade", """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAYS)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def m5(spark, sf_dir):
    orders, lineitem = _t(spark, sf_dir, "orders", "lineitem")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    gone = orders.join(F.broadcast(now)).where("o_orderdate < now - INTERVAL 365 DAYS")
    return lineitem.join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("J4_web_pages", "SELECT event_id, user_id, url FROM events LEFT JOIN pages ON event_type = 'view' AND user_id % 2 = page_id % 2 AND page_id = (props::JSON ->> '$.k')::BIGINT")
def j4(spark, sf_dir):
    events, pages = _t(spark, sf_dir, "events", "pages")
    # The constant condition on the left side becomes a null key, so that the join stays an equi-join.
    key = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").try_cast("long"))
    own = events.select("event_id", "user_id", key.alias("page_id"), (F.col("user_id") % 2).alias("chat"))
    return own.join(pages.select("page_id", (F.col("page_id") % 2).alias("chat"), "url"), ["page_id", "chat"], "left").select("event_id", "user_id", "url")


@query("J7_summaries_in_scope", "SELECT doc_id, source FROM labels JOIN documents USING (doc_id) JOIN (SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2', 'src3')) USING (source) WHERE quality = 1")
def j7(spark, sf_dir):
    documents, labels = _t(spark, sf_dir, "documents", "labels")
    scope = documents.where(F.col("source").isin("src1", "src2", "src3")).select("source").distinct()
    return labels.where("quality = 1").join(documents, "doc_id").join(scope, "source").select("doc_id", "source")


@query("J8_events_of_runs", "SELECT event_id, event_type FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j8(spark, sf_dir):
    events, orders = _t(spark, sf_dir, "events", "orders")
    return events.join(orders.where("o_orderstatus = 'F'"), F.col("user_id") == F.col("o_custkey"), "left_semi").select("event_id", "event_type")


@query("J14_owned_runs", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5")
def j14(spark, sf_dir):
    lineitem, orders, customer = _t(spark, sf_dir, "lineitem", "orders", "customer")
    mine = orders.join(customer.where("c_nationkey = 5"), F.col("o_custkey") == F.col("c_custkey"))
    return lineitem.join(mine, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber")


@query("J16_ordered_chunks", "SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber) AS position FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j16(spark, sf_dir):
    lineitem, orders = _t(spark, sf_dir, "lineitem", "orders")
    out = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber")
    return out.select("o_custkey", "l_orderkey", "l_linenumber", F.row_number().over(order).alias("position"))


@query("J17_newest_excerpts", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber LIMIT 12")
def j17(spark, sf_dir):
    lineitem, orders, customer = _t(spark, sf_dir, "lineitem", "orders", "customer")
    out = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return out.orderBy(F.col("o_orderdate").desc(), F.col("l_orderkey").desc(), "l_linenumber").limit(12).select("l_orderkey", "l_linenumber", "c_name")


@query("J21_results_to_items", "SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)")
def j21(spark, sf_dir):
    documents, labels = _t(spark, sf_dir, "documents", "labels")
    return labels.join(documents, "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("J24_runs_to_items", "SELECT o_orderkey, item_id FROM orders JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') ON conv_id = o_custkey JOIN (SELECT DISTINCT item_id FROM benchmark) ON item_id = turn + conv_id % 10")
def j24(spark, sf_dir):
    orders, turns, items = _t(spark, sf_dir, "orders", "conversations", "benchmark")
    asked = turns.where("role = 'user'").select("conv_id", "turn").distinct()
    out = orders.join(asked, F.col("o_custkey") == F.col("conv_id")).withColumn("item_id", F.col("turn") + F.col("conv_id") % 10)
    return out.join(items.select("item_id").distinct(), "item_id").select("o_orderkey", "item_id")


@query("J28_entity_grid", """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS p FROM lineitem QUALIFY p < 5), e AS (SELECT l_orderkey, l_shipdate, unnest(['A', 'N']) AS entity, unnest([0, 1]) AS e FROM (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1))
SELECT l_orderkey, 'entity_' || p || '_' || e AS question, l_linenumber, entity FROM p JOIN e USING (l_orderkey)""")
def j28(spark, sf_dir):
    return J.entity_grid(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.lit("A"), F.lit("N")).alias("entities")), "l_orderkey", "l_linenumber", "entities", 5)


@query("J31_marker_contexts", "SELECT a.conv_id, a.turn, 1 + a.turn % 3 AS n, b.turn AS context_turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)) b ON a.conv_id = b.conv_id AND b.n = 1 + a.turn % 3")
def j31(spark, sf_dir):
    from brindle.functions.text import citation_markers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    answer = F.concat(F.lit("as said in ["), (1 + F.col("turn") % 3).cast("string"), F.lit("]"))
    contexts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("contexts"))
    return J.cited_contexts(turns.withColumn("markers", citation_markers(answer)).join(contexts, "conv_id"), "markers", "contexts").select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.col("context").alias("context_turn"))


_DIGEST = "substr(sha1(substr(coalesce(text, ''), 1, 2000)), 1, 12)"


@query("J32_digest_to_chunks", f"SELECT q.doc_id AS asked, d.doc_id FROM documents q JOIN documents d ON {_DIGEST.replace('text', 'q.text')} = {_DIGEST.replace('text', 'd.text')} WHERE q.doc_id % 50 = 0")
def j32(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    digest = F.substring(F.sha1(F.substring(F.coalesce("text", F.lit("")), 1, 2000)), 1, 12).alias("digest")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("asked"), digest)
    return asked.join(docs.select("doc_id", digest), "digest").select("asked", "doc_id")


@query("J36_delete_candidates", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (1, 2, 3) AND o_orderstatus = 'F'")
def j36(spark, sf_dir):
    lineitem, orders, customer = _t(spark, sf_dir, "lineitem", "orders", "customer")
    gone = customer.where((F.col("c_mktsegment") == "BUILDING") & ~F.col("c_custkey").isin(1, 2, 3))
    own = orders.where("o_orderstatus = 'F'").join(gone, F.col("o_custkey") == F.col("c_custkey"))
    return lineitem.join(own, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber")


@query("J39_digest_index", "SELECT q.doc_id, q.k, d.doc_id AS found, d.doc_id IS NULL AS missing FROM (SELECT doc_id, substr(sha256(CASE WHEN doc_id % 3 = 0 THEN 'gone' ELSE coalesce(text, '') END), 1, 16) AS k FROM documents) q LEFT JOIN (SELECT min(doc_id) AS doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS k FROM documents GROUP BY 2) d USING (k)")
def j39(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 16).alias("k")
    index = docs.select("doc_id", digest(text)).groupBy("k").agg(F.min("doc_id").alias("found"))
    asked = docs.select("doc_id", digest(F.when(F.col("doc_id") % 3 == 0, "gone").otherwise(text)))
    return asked.join(index, "k", "left").select("doc_id", "k", "found", F.col("found").isNull().alias("missing"))


@query("U3_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def u3(spark, sf_dir):
    # A kind's first place is found before kinds are gathered, so a user's rows are never in one array.
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    out = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("k"))
    return out.select("user_id", F.array_join(F.transform("k", lambda x: x["event_type"]), ",").alias("kinds"))


@query("T11_longest_first", "SELECT p_brand, string_agg(n, ',' ORDER BY -length(n), n) AS names FROM (SELECT DISTINCT p_brand, p_name AS n FROM part) GROUP BY 1")
def t11(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct((-F.length("p_name")).alias("k"), "p_name"))).alias("n"))
    return names.select("p_brand", F.array_join(F.transform("n", lambda x: x["p_name"]), ",").alias("names"))


@query("T12_slowest_first", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position FROM events")
def t12(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return C.positions(events, "event_type", [F.col("value").desc(), "event_id"], "position").select("event_id", "position")


@query("T13_first_failing_gate", "SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) FILTER (WHERE l_discount < 0.03) AS gate FROM lineitem GROUP BY 1")
def t13(spark, sf_dir):
    failing = F.when(F.col("l_discount") < 0.03, F.struct("l_linenumber", "l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", failing).alias("gate"))


@query("M6_settings_versions", """WITH v AS (SELECT o_custkey, o_orderkey AS version, o_orderstatus AS settings, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, version, before, settings AS after, version = arg_max(version, (o_orderdate, version)) OVER (PARTITION BY o_custkey) AS active FROM v JOIN (SELECT o_orderkey, o_orderdate FROM orders) ON o_orderkey = version""")
def m6(spark, sf_dir):
    return J.versioned(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("settings"), "o_orderdate"), "o_custkey", ["o_orderdate", "version"], "settings").select("o_custkey", "version", "before", "after", "active")


@query("M1_upsert_counter", "SELECT user_id, count(*) + coalesce(any_value(l), 0) AS counter FROM events LEFT JOIN (SELECT c_custkey, c_nationkey AS l FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id GROUP BY user_id")
def m1(spark, sf_dir):
    events, customer = _t(spark, sf_dir, "events", "customer")
    held = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("held"))
    n = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(held, "user_id", "left").select("user_id", (F.col("n") + F.coalesce("held", F.lit(0))).alias("counter"))


@query("R15_ready_batch", "SELECT o_custkey AS plan, o_orderkey AS id FROM (SELECT *, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE o_orderstatus <> 'F' AND coalesce(before, 'F') = 'F'")
def r15(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    tasks = orders.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("id"), F.array_compact(F.array(before)).alias("depends_on"), (F.col("o_orderstatus") == "F").alias("answered"))
    return J.ready_batch(tasks)


@query("R16_parsed_plans", """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'whole' ELSE 'a:|b:a' || CASE WHEN c_nationkey % 4 > 1 THEN '|c:a,b' ELSE '' END END AS tasks FROM customer""")
def r16(spark, sf_dir):
    n = F.col("c_nationkey") % 4
    third = F.when(n > 1, F.lit(', {"id": "c", "depends_on": ["a", "c", "b", "zz"]}, {"id": "a", "depends_on": []}')).otherwise("")
    plan = F.when(n == 0, F.lit('[{"id": "a"}]')).otherwise(F.concat(F.lit('[{"id": "a", "depends_on": ["x"]}, {"id": "b", "depends_on": ["a"]}'), third, F.lit("]")))
    out = table(spark, sf_dir, "customer").select("c_custkey", J.parsed_plan(plan).alias("p"))
    text = F.array_join(F.transform("p", lambda t: F.concat(t["id"], F.lit(":"), F.array_join(t["depends_on"], ","))), "|")
    return out.select("c_custkey", F.when(F.size("p") < 2, "whole").otherwise(text).alias("tasks"))
