"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.language import STOP_WORDS, content_terms
from brindle.plans.registry import query, table
from brindle.plans.retrieval import TOKENS_SQL


def _redact_sql() -> str:
    steps = ["r0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    quote = lambda s: s.replace("'", "''")
    for i, (kind, pattern) in enumerate(T.REDACTIONS, 1):
        old = "".join(f", n{j}" for j in range(1, i))
        steps.append(f"r{i} AS (SELECT doc_id, regexp_replace(t, '{quote(pattern)}', '[REDACTED:{kind}]', 'g') AS t{old}, len(regexp_extract_all(t, '{quote(pattern)}')) AS n{i} FROM r{i - 1})")
    counts = ", ".join(f"n{i} AS n_{kind.lower()}" for i, (kind, _) in enumerate(T.REDACTIONS, 1))
    return f"WITH {', '.join(steps)} SELECT doc_id, md5(t) AS text_md5, {counts} FROM r{len(T.REDACTIONS)}"


@query("X23_redaction", _redact_sql())
def x23(spark, sf_dir):
    out = T.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    counts = [f"n_{kind.lower()}" for kind, _ in T.REDACTIONS]
    return out.select("doc_id", F.md5("redacted").alias("text_md5"), *[F.col(n).cast("long").alias(n) for n in counts])


_STRIP = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@query("X3_paragraphs", rf"SELECT doc_id, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[ \t]*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '')) AS n FROM documents")
def x3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("X9_page_flags", rf"""WITH s AS (SELECT doc_id, length({_STRIP.format("coalesce(text, '')")}) AS n, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) AS pipes FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN n < 200 THEN 'low_text' END, CASE WHEN pipes / greatest(n, 1) * 1000 > 25 THEN 'table_heavy' END) AS flags FROM s""")
def x9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.page_flags(F.coalesce("text", F.lit(""))), ",").alias("flags"))


@query("X14_tokens", f"SELECT doc_id, len({TOKENS_SQL}) AS n, md5(array_to_string({TOKENS_SQL}, ' ')) AS tokens_md5 FROM documents")
def x14(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("t", T.tokens(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_STOP_WORDS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query("X15_content_terms", f"""WITH t AS (SELECT item_id, list_distinct(list_filter({TOKENS_SQL}, lambda t: NOT list_contains({_STOP_WORDS}, t))) AS t FROM benchmark),
u AS (SELECT item_id, unnest(t) AS w FROM t) SELECT item_id, string_agg(w, ' ' ORDER BY -length(w), w) AS terms FROM u GROUP BY item_id""")
def x15(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(content_terms(F.col("text")), " ").alias("terms")).where("terms <> ''")


@query("X19_forbidden_values", r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(^|[^0-9A-Za-z_])(secret|password|AKIA[0-9A-Z]+)($|[^0-9A-Za-z_])') AS hit FROM documents")
def x19(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).rlike(r"(?<!\w)(secret|password|AKIA[0-9A-Z]+)(?!\w)").alias("hit"))


@query("X20_citation_markers", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\[(\d{1,2})\]', 1), lambda x: x::INT))), ',') AS markers FROM documents")
def x20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(T.citation_markers(F.coalesce("text", F.lit(""))), lambda x: x.cast("string")), ",").alias("markers"))


def _declines_sql(text: str) -> str:
    """Whether ``text`` declines. Every contrast in what follows a wording is marked and looked at by itself, as these patterns
    cannot look ahead: what stands before it, and what comes after."""
    plain = lambda p: p.replace("'", "''").replace(r"\w", r"[\p{L}\p{N}_]")
    tails = ", ".join(f"regexp_extract(x, '(?i)((?:{plain(p)})[\\s\\S]*)', 1)" for p in T.DECLINES)
    marked = f"string_split(regexp_replace(t, '(?i)({plain(T.CONTRAST)})', chr(30) || '\\1' || chr(31), 'g'), chr(30))"
    before = "regexp_replace(array_to_string(p[1:k], ''), chr(31), '', 'g')"
    after = "regexp_replace(array_to_string(p[k + 1:], ''), '^[^' || chr(31) || ']*' || chr(31), '')"
    goes_on = rf"""(NOT regexp_matches({before}, '[.!?。]\s|\n') OR regexp_matches({before}, '[.!?。\n][ \t"“]*$')) AND NOT regexp_matches({after}, '(?i)^{plain(T.DENIAL)}') AND regexp_matches({after}, '{T.ASSERTION}')"""
    turned = f"len(list_filter(tails, lambda t: len(list_filter(range(1, len({marked})), lambda k: {goes_on.replace('p[', marked + '[')})) > 0)) > 0"
    return f"(SELECT len(tails) > 0 AND NOT {turned} FROM (SELECT list_filter([{tails}], lambda t: t <> '') AS tails FROM (SELECT {text} AS x)))"


_DECLINES = _declines_sql("coalesce(text, '')")


@query("X21_declines", f"SELECT conv_id, turn, role, {_DECLINES} AS declines FROM conversations")
def x21(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.says_not_in_sources(F.coalesce("text", F.lit(""))).alias("declines"))


def _injection_sql() -> str:
    cue = "(?is)(?:" + "|".join(T.INJECTION_CUES).replace("'", "''") + ")"
    parts = r"string_split(regexp_replace(regexp_replace(regexp_replace(t, '\n#', chr(1) || chr(10) || '#', 'g'), '(\n[ \t]*\x01?\n)', chr(1) || '\1', 'g'), '(\n[ \t]*\x01?\n)', chr(1) || '\1', 'g'), chr(1))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, {parts} AS p FROM d),
r AS (SELECT doc_id, t, len(list_filter(p, lambda x: regexp_matches(x, '{cue}'))) AS n, array_to_string(list_transform(p, lambda x: regexp_replace(x, '{cue}.*$', '{T.INJECTION_MARK}')), '') AS r FROM p)
SELECT doc_id, n AS spans, length({_STRIP.format(f"replace(r, '{T.INJECTION_MARK}', '')")}) >= length({_STRIP.format('t')}) * {T.LEAST_KEPT} AS kept, md5(CASE WHEN n > 0 THEN r ELSE t END) AS text_md5 FROM r"""


@query("X24_injection_spans", _injection_sql())
def x24(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    redacted, spans = T.redact_injections(text)
    return table(spark, sf_dir, "documents").select("doc_id", spans.alias("spans"), T.injection_kept(text, redacted).alias("kept"), F.md5(redacted).alias("text_md5"))


@query("X44_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, substr(sha1(substr(coalesce(text, ''), 1, 2000)), 1, 12) AS digest FROM documents")
def x44(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), F.substring(F.sha1(T.excerpt(text, 2000)), 1, 12).alias("digest"))


@query("X43_key_areas", "SELECT regexp_replace(c_name, '[0-9_]+$', '') AS area, count(*) AS n FROM customer GROUP BY 1")
def x43(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(T.area_of(F.col("c_name")).alias("area")).agg(F.count(F.lit(1)).alias("n"))


@query("R11_query_hash", r"SELECT item_id, sha256('model-a:' || trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS hash FROM benchmark")
def r11(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.query_hash(F.col("text"), "model-a:").alias("hash"))


@query("F17_excerpts", "SELECT doc_id, substr(text, 1, 240) AS excerpt FROM documents")
def f17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 240).alias("excerpt"))


@query("F19_query_shape", "SELECT conv_id, turn, role, contains(coalesce(text, ''), '?') OR len(regexp_extract_all(coalesce(text, ''), '[.!?…]')) < 2 AS is_query FROM conversations")
def f19(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.contains(text, F.lit("?")) | (F.regexp_count(text, F.lit("[.!?…]")) < 2)).alias("is_query"))


@query("F14_collapsed_containment", r"SELECT doc_id FROM documents WHERE regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') ILIKE '%licensed under%'")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.regexp_replace("text", f"{T.BLANKS}+", " ").ilike("%licensed under%")).select("doc_id")


@query("F8_F9_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events")
def f8(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.try_to_number(k, F.lit("999999")).cast("double").alias("v"))
