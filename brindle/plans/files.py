"""Queries over sources and sinks: what is written to a shared folder is read back; and parsers of model replies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import language as L
from brindle.functions import settings as Q
from brindle.operators import ingest as I
from brindle.operators import settings as Y
from brindle.operators import text_index as X
from brindle.operators.tables import shared_dir
from brindle.plans.ingest import _files
from brindle.plans.registry import query, table
from brindle.plans.retrieval import PLAIN_IDF, TOKENS_SQL, _bm25_sql
from brindle.sources import readers as S

_EXT = [*I.FORMATS, "exe", "zip", ""]


@query("S3_accepted_formats", f"SELECT p_partkey, ext, list_contains([{', '.join(repr(e) for e in I.FORMATS)}], ext) AS accepted FROM (SELECT p_partkey, ([{', '.join(repr(e) for e in _EXT)}])[p_partkey % {len(_EXT)} + 1] AS ext FROM part)")
def s3(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("p_partkey") % len(_EXT) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", ext.alias("ext"), ext.isin(*I.FORMATS).alias("accepted"))


@query("S4_size_limit", "SELECT page_id FROM pages WHERE octet_length(encode(coalesce(html, ''))) <= 3000")
def s4(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("page_id", F.regexp_extract("name", "^[0-9]+", 0).cast("long"))
    return I.within_size(files, 3000).select("page_id")


@query("S2_strict_uploads", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'unsupported type' WHEN octet_length(encode(coalesce(html, ''))) > 3000 THEN 'too large' END AS error FROM pages")
def s2(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("page_id", F.regexp_extract("name", "^[0-9]+", 0).cast("long"))
    return I.checked_uploads(files, 3000).select("page_id", "error")


@query("S9_merged_ocr", "SELECT a.doc_id, md5(CASE WHEN length(trim(coalesce(b.text, ''))) > length(trim(coalesce(a.text, ''))) THEN b.text ELSE coalesce(a.text, '') END) AS text_md5 FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1")
def s9(spark, sf_dir):
    """Whole texts: each document's own is the layer, that of the next id what was recognised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ocr")), "doc_id", "left")
    return both.select("doc_id", F.md5(I.merged_ocr(F.coalesce("text", F.lit("")), F.coalesce("ocr", F.lit("")))).alias("text_md5"))


@query("S10_ocr_lines", """WITH w AS (SELECT l_suppkey AS id, l_linenumber AS block, 1 AS par, l_orderkey AS line, l_partkey * 100 + l_quantity AS word, l_discount * 1000 AS conf, 'w' || l_partkey AS t FROM lineitem),
l AS (SELECT id, block, line, string_agg(t, ' ' ORDER BY word, t) AS t FROM w WHERE conf >= 50 GROUP BY ALL), p AS (SELECT id, md5(string_agg(t, chr(10) ORDER BY block, line, t)) AS text_md5 FROM l GROUP BY id)
SELECT id, text_md5, round(c, 6) AS confidence, n FROM (SELECT id, avg(conf) AS c, count(*) AS n FROM w GROUP BY id) LEFT JOIN p USING (id)""")
def s10(spark, sf_dir):
    tsv = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("block"), F.lit(1).alias("par"), F.col("l_orderkey").alias("line"), (F.col("l_partkey") * 100 + F.col("l_quantity")).alias("word"),
        (F.col("l_discount") * 1000).alias("conf"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
    )
    return I.tsv_lines(tsv, 50.0).select("id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "n")


@query("S32_image_documents", """WITH w AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey * 100 + l_quantity AS word, l_discount * 1000 AS conf, 'w' || l_partkey AS t FROM lineitem),
l AS (SELECT id, line, string_agg(t, ' ' ORDER BY word, t) AS t FROM w WHERE conf >= 40 GROUP BY ALL), p AS (SELECT id, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY id)
SELECT id, md5(text) AS text_md5, CASE WHEN text IS NULL THEN NULL WHEN c < 60 THEN 'ocr,ocr_low_confidence' ELSE 'ocr' END AS flags, text IS NULL AS failed, CASE WHEN text IS NULL THEN 0 ELSE 1 END::BIGINT AS chunks FROM (SELECT id, round(avg(conf), 6) AS c FROM w GROUP BY id) LEFT JOIN p USING (id)""")
def s32(spark, sf_dir):
    """Each order's lines are an image's recognised words; the documents that come of it are cut into chunks."""
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 100 + F.col("l_quantity")).alias("word"),
        (F.col("l_discount") * 1000).alias("conf"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
    )
    images = I.image_documents(I.tsv_lines(words, 40.0).withColumn("confidence", F.round("confidence", 6)))
    chunks = I.chunked(images.where("error is null").select(F.col("id").alias("doc_id"), F.col("markdown").alias("text"))).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    return images.join(chunks, "id", "left").select("id", F.md5("markdown").alias("text_md5"), F.array_join("flags", ",").alias("flags"), F.col("error").isNotNull().alias("failed"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


_PAGES = "(SELECT page_id AS doc_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS text FROM pages)"


@query("S13_E3_web_hits", f"WITH {_bm25_sql(_PAGES, 5, 1.5, PLAIN_IDF)} SELECT query_id, id, rank FROM lex")
def s13(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ").alias("text"))
    return X.search(X.kept(pages, "pages without tags"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5).select("query_id", "id", "rank")


@query("S15_failover", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'b' ELSE 'a' END AS provider, k AS rank FROM customer, range(2) t(k) WHERE c_nationkey % 9 <> 0")
def s15(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("rank"))
    a = asked.where("c_nationkey % 3 <> 0").select("c_custkey", "rank")
    b = asked.where("c_nationkey % 9 <> 0").select("c_custkey", "rank")
    return S.failover([("a", a), ("b", b)], "c_custkey").select("c_custkey", "provider", "rank")


@query("S18_pinned_pages", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5, sum(length(text) // 4)::BIGINT AS tokens FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def s18(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    return I.pinned(chunks, "conv_id").select("conv_id", F.md5("text").alias("text_md5"), "tokens")


@query("S19_evaluation_items", "SELECT min(lpad(item_id::VARCHAR, 6, '0')) AS id, text AS question, bool_or(item_id % 4 = 0) AS should_abstain FROM (SELECT * FROM benchmark QUALIFY row_number() OVER (PARTITION BY text ORDER BY item_id) = 1) GROUP BY text")
def s19(spark, sf_dir):
    path = shared_dir(spark, "items")
    items = table(spark, sf_dir, "benchmark").select(
        F.lpad(F.col("item_id").cast("string"), 6, "0").alias("id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("question"), F.when(F.col("item_id") % 2 == 1, F.array(F.lit("Hello"), F.col("text"))).alias("turns"),
        (F.col("item_id") % 4 == 0).alias("should_abstain"),
    )
    items.write.json(path)
    return S.evaluation_items(spark, path, multi_line=False).select("id", "question", "should_abstain")


@query("S22_specs_by_last_turn", "SELECT text AS question, item_id % 3 AS cite FROM benchmark")
def s22(spark, sf_dir):
    path = shared_dir(spark, "specs")
    table(spark, sf_dir, "benchmark").select(F.array(F.lit("Hi"), F.col("text")).alias("turns"), (F.col("item_id") % 3).alias("cite")).write.json(path)
    return S.specs(spark, path, "cite long").select("question", "cite")


@query("S20_markdown_corpus", "SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark")
def s20(spark, sf_dir):
    path = shared_dir(spark, "corpus")
    table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    return spark.read.text(path, wholetext=True).select(F.col("item_id").cast("long").alias("item_id"), F.md5("value").alias("text_md5"))


@query("S21_call_log", "SELECT event_type AS engine, count(*) AS calls, round(sum(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END::DECIMAL(20, 2))::DOUBLE, 2) AS cost, count(*) FILTER (WHERE event_id % 3 = 0) AS missing FROM events GROUP BY 1")
def s21(spark, sf_dir):
    calls, costs = shared_dir(spark, "calls"), shared_dir(spark, "costs")
    events = table(spark, sf_dir, "events")
    events.select(F.lit("call").alias("type"), F.col("event_id").cast("string").alias("call"), F.col("event_type").alias("engine"), F.col("value").alias("wall_ms")).write.json(calls)
    events.where("event_id % 3 <> 0").select(F.col("event_id").cast("string").alias("call"), F.col("value").alias("total_cost")).write.json(costs)
    out = S.call_log(spark, calls).join(spark.read.schema("call string, total_cost double").json(costs), "call", "left")
    cost = F.sum(F.col("total_cost").cast("decimal(20,2)")).cast("double")
    return out.groupBy("engine").agg(F.count(F.lit(1)).alias("calls"), F.round(cost, 2).alias("cost"), F.count_if(F.col("total_cost").isNull()).alias("missing"))


def _log(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), seq.alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))
    path = shared_dir(spark, "log")
    S.append_events(events, path)
    return S.event_log(spark, path)


_SEQ = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@query("S23_event_sink", f"SELECT user_id::VARCHAR AS run_id, seq, props AS payload FROM {_SEQ} WHERE event_type = 'purchase'")
def s23(spark, sf_dir):
    return _log(spark, sf_dir).where("type = 'purchase'").select("run_id", "seq", "payload")


@query("S25_sse_lines", f"SELECT md5('id: ' || seq || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10)) AS line_md5 FROM {_SEQ}")
def s25(spark, sf_dir):
    return S.sse_lines(_log(spark, sf_dir)).select(F.md5("value").alias("line_md5"))


@query("S26_json_export", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def s26(spark, sf_dir):
    path = shared_dir(spark, "summary")
    table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")).write.json(path)
    return spark.read.schema("lang string, n long, mean double").json(path)


@query("S27_csv_sheet", "SELECT item_id, text, item_id % 2 = 0 AS even FROM benchmark")
def s27(spark, sf_dir):
    path = shared_dir(spark, "sheet")
    table(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 2 == 0).alias("even")).write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema("item_id long, text string, even boolean").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query("S28_json_dump", "SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS rows FROM nation GROUP BY 1")
def s28(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))  # a dimension's rows
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(rows).alias("rows"))


@query("S29_signal_lines", "SELECT '{\"event\":\"' || event_type || '\",\"run_id\":\"' || user_id || '\",\"value\":' || event_id || '}' AS line FROM events WHERE event_type IN ('error', 'purchase')")
def s29(spark, sf_dir):
    path = shared_dir(spark, "signals")
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    events.select(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("value")).write.json(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("S31_documents_to_summarise", "SELECT doc_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s31(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("n_chars > 500").join(done, "doc_id", "left_anti").select("doc_id")


@query("S33_citation_rows", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_suppkey % 3 = 0 THEN 'summary' ELSE 'chunk' END AS kind, substr(repeat('part ' || l_partkey || ' ', 40), 1, 240) AS snapshot FROM lineitem")
def s33(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    text = F.repeat(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" ")), 40)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), F.when(F.col("l_suppkey") % 3 == 0, "summary").otherwise("chunk").alias("kind"), F.substring(text, 1, 240).alias("snapshot"))


@query("S34_audit_corpus", "SELECT 'db' AS origin, doc_id AS id FROM documents WHERE source IN ('src1', 'src5') UNION ALL SELECT 'files', item_id FROM benchmark")
def s34(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src5")).select(F.lit("db").alias("origin"), F.col("doc_id").alias("id"))
    return stored.unionByName(s20(spark, sf_dir).select(F.lit("files").alias("origin"), F.col("item_id").alias("id")))


@query("S35_unframed_books", r"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(coalesce(text, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') ELSE coalesce(text, '') END) AS body_md5 FROM documents")
def s35(spark, sf_dir):
    """Whole texts, of which every second stands in a frame."""
    body = F.coalesce("text", F.lit(""))
    book = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("By someone\n*** START OF THE BOOK ***\n\n"), body, F.lit("\n\n*** END OF THE BOOK ***\nlicense"))).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.without_frame(book)).alias("body_md5"))


@query("M4_replaced_index", "SELECT doc_id % 8 AS doc_bucket, doc_id, CASE WHEN doc_id % 8 < 3 THEN 'new' ELSE lang END AS text FROM documents WHERE doc_id % 8 >= 3 OR doc_id % 16 < 8")
def m4(spark, sf_dir):
    path = shared_dir(spark, "index")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("doc_bucket"), "doc_id", F.col("lang").alias("text"))
    S.replace_documents(docs, path)
    S.replace_documents(docs.where("doc_bucket < 3 AND doc_id % 16 < 8").withColumn("text", F.lit("new")), path)
    return spark.read.schema("doc_id long, text string, doc_bucket long").parquet(path)


@query("R12_E6_embedded_texts", f"""WITH h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS w FROM documents)),
v AS (SELECT doc_id, h % 64 AS dim, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY ALL)
SELECT doc_id, dim::INT AS dim, coalesce(CASE WHEN n > 0 THEN v / n END, 0)::FLOAT::DOUBLE AS value FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents) LEFT JOIN v USING (doc_id, dim) LEFT JOIN n USING (doc_id)""")
def r12(spark, sf_dir):
    out = I.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), I.hashing_embedder())
    # The outer form, as a filter that Spark infers from the other would work the vectors out once more, in a place where it cannot.
    return out.select("doc_id", F.posexplode_outer("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query("X10_page_flags_merged", "SELECT conv_id, turn, array_to_string(list_sort(list(DISTINCT f)), ',') AS flags FROM (SELECT conv_id, turn, role AS f FROM conversations UNION ALL SELECT conv_id, turn, 'low_text' FROM conversations WHERE length(text) < 200) GROUP BY 1, 2")
def x10(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    flags = turns.select("conv_id", "turn", F.array_compact(F.array("role", F.when(F.length("text") < 200, "low_text"))).alias("flags"))
    return I.merged_flags(flags, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("flags", ",").alias("flags"))


@query("X30_unified_diffs", "SELECT c_custkey, '@@ -1,2 +1,2 @@' || chr(10) || ' ' || c_name || chr(10) || '-' || c_mktsegment || chr(10) || '+' || lower(c_mktsegment) AS diff FROM customer")
def x30(spark, sf_dir):
    before, after = F.concat("c_name", F.lit("\n"), "c_mktsegment"), F.concat("c_name", F.lit("\n"), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", Q.unified_diff(before, after).alias("diff"))


_WRITES = """w AS (SELECT user_id, ts, event_id, unnest(CASE WHEN event_id % 50 = 0 THEN [{'path': ['retrieval'], 'value': k}] WHEN event_id % 3 = 0 THEN [{'path': ['name'], 'value': '"' || event_type || '"'}]
  ELSE [{'path': ['retrieval', 'limit'], 'value': k}, {'path': ['retrieval', 'share', event_type], 'value': k || '.5'}] END, recursive := true) FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)),
s AS (SELECT * FROM w a WHERE NOT EXISTS (FROM w b WHERE b.user_id = a.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND (b.path = a.path[1:len(b.path)] OR a.path = b.path[1:len(a.path)])))"""


def _settings(spark, sf_dir):
    """Each event patches its user's settings: a section, a name, or a value in the place of the whole section."""
    events = table(spark, sf_dir, "events")
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    name = F.format_string('{"name": "%s"}', kind)
    section = F.format_string('{"retrieval": {"limit": %s, "share": {"%s": %s.5}}}', k, kind, k)
    patch = F.when(F.col("event_id") % 50 == 0, F.format_string('{"retrieval": %s}', k)).when(F.col("event_id") % 3 == 0, name).otherwise(section)
    patches = events.select("user_id", F.struct("ts", "event_id").alias("version"), patch.alias("patch"))
    return Y.deep_merged(Y.leaves(patches, "patch"), "user_id", "version")


@query("X34_merged_settings", f"WITH {_WRITES} SELECT user_id, array_to_string(path, '.') AS name, value FROM s")
def x34_merged(spark, sf_dir):
    return _settings(spark, sf_dir).select("user_id", F.array_join("path", ".").alias("name"), "value")


_RULES = [("retrieval.limit", "integer", 10.0, 80.0, None, False), ("retrieval.share.*", "number", 0.0, 60.0, None, True), ("retrieval.share.click", "integer", None, None, None, False), ("name", "text", None, None, ["click", "purchase"], False)]


@query("X34_X35_settings", f"""WITH {_WRITES} SELECT user_id, array_to_string(path, '.') AS name, value, CASE WHEN path = ['retrieval'] THEN 'unknown' WHEN path = ['name'] THEN CASE WHEN value NOT IN ('"click"', '"purchase"') THEN 'range' END
WHEN path[2] = 'limit' THEN CASE WHEN value::DOUBLE NOT BETWEEN 10 AND 80 THEN 'range' END WHEN path[3] = 'click' THEN 'type' WHEN value::DOUBLE NOT BETWEEN 0 AND 60 THEN 'range' END AS problem FROM s""")
def x34(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "name string, kind string, low double, high double, choices array<string>, optional boolean")
    return Y.checked(_settings(spark, sf_dir), rules).select("user_id", "name", "value", "problem")


@query("X45_abstain_summaries", "WITH o AS (SELECT l_orderkey, list_distinct(list('p' || l_partkey % 7 ORDER BY l_linenumber, l_partkey)) AS n FROM lineitem GROUP BY 1), d AS (SELECT l_orderkey, 'p' || l_partkey % 7 AS n, min((l_linenumber, l_partkey)) AS k FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS i FROM d) SELECT l_orderkey, string_agg(n, ', ' ORDER BY i) FILTER (WHERE i <= 4) || '; page 1' AS summary FROM r GROUP BY 1")
def x45(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))  # the few lines of an order
    names = F.transform(rows, lambda x: F.concat(F.lit("p"), (x["l_partkey"] % 7).cast("string")))
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(names.alias("n"))
    return out.select("l_orderkey", L.abstain_summary(F.col("n"), F.array(F.lit("page 1"), F.lit("page 1"))).alias("summary"))


@query("X46_notes", "SELECT conv_id, md5(string_agg(substr(text, 1, 500), chr(10) || chr(10) ORDER BY turn, text) FILTER (WHERE i <= 5)) AS notes_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations WHERE text IS NOT NULL) GROUP BY 1")
def x46(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    top = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("i", first).where("i <= 5")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    return top.groupBy("conv_id").agg(texts.alias("t")).select("conv_id", F.md5(L.notes(F.col("t"))).alias("notes_md5"))


@query("X47_longest_prefixes", "SELECT doc_id, md5(substr(coalesce(text, ''), 1, 1200)) AS prefix_md5 FROM documents")
def x47(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.longest_prefix(F.coalesce("text", F.lit("")), 300)).alias("prefix_md5"))


@query("X48_summary_replies", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS s1 FROM part")
def x48(spark, sf_dir):
    second = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.lit("of all"))
    reply = F.to_json(F.create_map(F.lit("s1"), F.col("p_name"), F.lit("document"), second))
    out = L.summary_reply(reply, F.array(F.lit("s1"), F.lit("document")))
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(out, F.lit("s1")).alias("s1"))


@query("X49_starter_questions", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'What is ' || p_name || '?|Why?|How?' END AS questions FROM part")
def x49(spark, sf_dir):
    third = F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.lit(" How? "))
    reply = F.to_json(F.array(F.concat(F.lit("What is "), "p_name", F.lit("?")), F.lit("Why?"), third))
    out = L.starter_questions(reply)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(out.isNotNull(), F.array_join(out, "|")).alias("questions"))
