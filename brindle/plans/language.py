"""Queries over sentences, names and small parsers: turns are replies, benchmark items are questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import language as L
from brindle.functions import text as T
from brindle.plans.registry import query, table
from brindle.plans.retrieval import TOKENS_SQL
from brindle.plans.texts import _DECLINES, _declines_sql


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_T = "coalesce(text, '')"
_SHORT = "|".join(a.replace(".", r"\.") for a in L.ABBREVIATIONS)
_SENT = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({_T}, '([.!?]["''”’»›）)】〕\]」』]*)(\s)', '\1' || chr(30) || '\2', 'g'), '([。！？]["''”’»›）)】〕\]」』]*)', '\1' || chr(30), 'g'), '(^|[ \n\x1e])({_SHORT})\x1e', '\1\2', 'g'), chr(30)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


@query("X4_sentences", f"SELECT doc_id, len({_SENT}) AS n, md5(array_to_string({_SENT}, chr(31))) AS sentences_md5 FROM documents")
def x4(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", L.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\x1f")).alias("sentences_md5"))


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _marks_sql(words):
    return " + ".join(f"contains(l, '{m}')::INT" if len(m) == 1 else f"contains(x, ' {m} ')::INT" if len(m) < 4 else f"contains(x, ' {m}')::INT" for m in words)


_SCORES = ", ".join(f"{{'lang': '{k}', 'score': len(list_filter(w, lambda y: list_contains({_sql_list(L.STOPS[k])}, y))) + 3 * ({_marks_sql(L.MARKS[k])})}}" for k in sorted(L.STOPS))
_SCRIPT = " ".join(f"WHEN len(regexp_extract_all({_T}, '[{signs.replace('Is', '')}]')) * 2 > len(regexp_extract_all({_T}, '\\p{{L}}')) THEN '{k}'" for k, signs in L.SCRIPTS.items())
_DETECTED = rf"""t AS (SELECT *, CASE WHEN regexp_matches({_T}, '[{L.KANA}]') THEN 'ja' {_SCRIPT} END AS script, lower({_T}) AS l, regexp_extract_all(lower({_T}), '\p{{L}}+') AS w FROM d),
s AS (SELECT *, [{_SCORES}] AS s FROM (SELECT *, ' ' || array_to_string(list_distinct(w), ' ') || ' ' AS x FROM t)),
b AS (SELECT *, list_filter(s, lambda y: y.score > 0 AND y.score = list_max(list_transform(s, lambda z: z.score))) AS f FROM s),
r AS (SELECT *, CASE WHEN script IS NOT NULL THEN script WHEN len(list_filter(f, lambda y: y.lang = 'en')) > 0 THEN 'en' WHEN len(f) = 1 THEN f[1].lang END AS found FROM b)"""


@query("X11_languages", f"WITH d AS (SELECT doc_id, text FROM documents), {_DETECTED} SELECT doc_id, found AS lang FROM r")
def x11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.detected_language(F.col("text")).alias("lang"))


@query("X11_turn_languages", f"WITH d AS (SELECT conv_id, turn, text FROM conversations), {_DETECTED} SELECT conv_id, turn, found AS lang FROM r")
def x11_turns(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", L.detected_language(F.col("text")).alias("lang"))


@query("X12_marker_hits", rf"""WITH t AS (SELECT doc_id, lower({_T}) AS l, regexp_extract_all(lower({_T}), '\p{{L}}+') AS w FROM documents)
SELECT doc_id, contains(l, 'ß') AS sign, list_contains(w, 'und') AS word, len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AS stem FROM t""")
def x12(spark, sf_dir):
    low = F.lower(F.coalesce("text", F.lit("")))
    out = table(spark, sf_dir, "documents").select("doc_id", low.alias("l"), F.regexp_extract_all(low, F.lit(r"\p{L}+"), 0).alias("w"))
    return out.select("doc_id", *[L.marker_hit(F.col("l"), F.col("w"), m).alias(n) for n, m in (("sign", "ß"), ("word", "und"), ("stem", "ther"))])


@query("X13_folded_text", f"SELECT doc_id, md5(strip_accents(replace(lower({_T}), 'ß', 'ss'))) AS folded_md5 FROM documents")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.coalesce("text", F.lit("")))).alias("folded_md5"))


@query("X16_token_sequences", f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({TOKENS_SQL}, ' ') || ' ' AS t FROM documents)
SELECT doc_id, contains(t, ' licensed under ') AS one, contains(t, ' released under the mit ') AS two FROM d""")
def x16(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return out.select("doc_id", *[L.contains_sequence(F.col("t"), F.array(*[F.lit(w) for w in q.split()])).alias(n) for n, q in (("one", "licensed under"), ("two", "released under the mit"))])


@query("X17_quote_windows", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')) AS l FROM documents),
p AS (SELECT *, list_min(list_filter([strpos(l, 'license'), strpos(l, 'password')], lambda x: x > 0)) AS pos FROM d) SELECT doc_id, trim(replace(substr(t, greatest(1, coalesce(pos, 1) - 133)::BIGINT, 400), chr(10), ' ')) AS quote FROM p""")
def x17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.quote_around(F.coalesce("text", F.lit("")), F.array(F.lit("license"), F.lit("password"))).alias("quote"))


@query("X18_mentions", f"SELECT doc_id, contains(lower({_T}), 'the') AND (contains(lower({_T}), 'license') OR contains(lower({_T}), 'token')) AS hit FROM documents")
def x18(spark, sf_dir):
    hit = L.mentions(F.coalesce("text", F.lit("")), F.array(F.lit("LICENSE"), F.lit("token")), F.array(F.lit("The")))
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("hit"))


@query("X22_confident_wrong", f"SELECT conv_id, turn, role, role = 'assistant' AND {_T} <> '' AND NOT {_DECLINES} AS wrong FROM conversations")
def x22(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    wrong = (F.col("role") == "assistant") & (text != "") & ~T.says_not_in_sources(text)
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", wrong.alias("wrong"))


@query("X25_absence_claims", rf"SELECT doc_id, regexp_matches({_T}, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(no|not any|none|never|nothing|without any|lacks?|does not (mention|state|contain|include)|do not (mention|state|contain|include)|is not (mentioned|stated|given))($|[^\p{{L}}\p{{N}}\p{{M}}_])') AS absent FROM documents")
def x25(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.absence_claim(F.coalesce("text", F.lit(""))).alias("absent"))


@query("X26_first_json", "SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN (props::JSON ->> '$.k')::BIGINT END AS k FROM events")
def x26(spark, sf_dir):
    """Replies with braces in the prose before an object, an object behind it, and every seventh without any."""
    broken = F.col("event_id") % 7 == 3
    reply = F.concat(F.lit('As {asked}, see {"k": } or {k}:\n```json\n'), F.when(broken, F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props")), F.lit('\n```\nDone'), F.when(broken, F.lit(".")).otherwise(F.lit(' {"k": -1}.')))
    return table(spark, sf_dir, "events").select("event_id", L.first_json(reply, "k long")["k"].alias("k"))


@query("X27_named_entities", """SELECT c_custkey, 'Customer of NATION_' || c_nationkey AS subject, 'X' || c_nationkey || '-9,Paris the Great' AS entities FROM customer""")
def x27(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    question = F.concat(F.lit("Does Customer X"), n, F.lit("-9 know What is in Paris the Great? "))
    out = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Customer of NATION_"), n).alias("subject"), L.named_entities(question).alias("e"))
    return out.select("c_custkey", "subject", F.array_join("e", ",").alias("entities"))


@query("X28_compare_queries", "SELECT c_custkey, 'Is AB-1 better than Kestrel, ' || c_mktsegment || '?|AB-1 Is AB-1 better than Kestrel, ' || c_mktsegment || '?|Kestrel Is AB-1 better than Kestrel, ' || c_mktsegment || '?' AS queries FROM customer")
def x28(spark, sf_dir):
    question = F.concat(F.lit("Is AB-1 better than Kestrel, "), "c_mktsegment", F.lit("?"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(L.compare_queries(question), "|").alias("queries"))


@query("F29_named_subjects", "SELECT c_custkey, c_nationkey % 3 <> 0 AS named FROM customer")
def f29(spark, sf_dir):
    message = F.when(F.col("c_nationkey") % 3 == 0, "tell me about that").when(F.col("c_nationkey") % 3 == 1, "and what of Kestrel?").otherwise("more on batteries")
    return table(spark, sf_dir, "customer").select("c_custkey", L.names_subject(message).alias("named"))


_GREETINGS = "[" + ", ".join(f"'{g}'" for g in L.GREETINGS) + "]"


@query("X29_greetings", f"""WITH m AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '  ' || upper({_GREETINGS}[conv_id % {len(L.GREETINGS)} + 1]) || '!! ' ELSE {_GREETINGS}[conv_id % {len(L.GREETINGS)} + 1] || ' ' || split_part(text, ' ', 1) END AS t FROM conversations),
b AS (SELECT *, trim(regexp_replace(lower(t), '[^\\p{{L}}]+', ' ', 'g')) AS bare FROM m)
SELECT conv_id, turn, role, CASE WHEN length(t) <= 40 AND list_contains({_GREETINGS}, bare) THEN bare END AS greeting FROM b""")
def x29(spark, sf_dir):
    """Turns, greetings in capitals with marks around them, and greetings with the first word of a turn."""
    known = F.get(F.array(*[F.lit(g) for g in L.GREETINGS]), F.col("conv_id") % len(L.GREETINGS))
    message = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("  "), F.upper(known), F.lit("!! "))).otherwise(F.concat(known, F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", L.greeting(message).alias("greeting"))


@query("X31_query_variants", "SELECT p_partkey, p_name || ' price|cost of ' || p_name AS variants FROM part")
def x31(spark, sf_dir):
    reply = F.concat(F.lit("1. "), "p_name", F.lit(" price\n- cost of "), "p_name", F.lit("\n3) "), "p_name", F.lit(" price\nno\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(L.variants(reply), "|").alias("variants"))


@query("X50_instant_titles", r"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, role, CASE WHEN length(t) <= 60 THEN t WHEN regexp_extract(substr(t, 1, 61), '^(.*)\s', 1) <> '' THEN trim(regexp_extract(substr(t, 1, 61), '^(.*)\s', 1)) || '…' ELSE trim(substr(t, 1, 60)) || '…' END AS title FROM c""")
def x50(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", L.instant_title(F.coalesce("text", F.lit(""))).alias("title"))


_REPLY = f"({_T} || '. The sources do not say more.')"


@query("X56_caveats", f"""WITH s AS (SELECT conv_id, turn, role, {_SENT.replace(_T, _REPLY)} AS s FROM conversations), h AS (SELECT *, array_to_string(s[1:len(s) - 1], ' ') AS head FROM s)
SELECT conv_id, turn, role, len(s) > 1 AND {_declines_sql('s[len(s)]')} AND NOT {_declines_sql('head')} AND length(head) >= 120 AND turn % 2 = 1 AS caveat FROM h""")
def x56(spark, sf_dir):
    reply = F.concat(F.coalesce("text", F.lit("")), F.lit(". The sources do not say more."))
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", L.caveat_only(reply, T.says_not_in_sources, F.col("turn") % 2 == 1).alias("caveat"))


@query("X58_step_rows", "SELECT event_id, CASE WHEN starts_with(event_type, 'pu') THEN 'pay' WHEN starts_with(event_type, 'p') THEN 'other p' WHEN starts_with(event_type, 'c') THEN 'act' ELSE 'rest' END AS step FROM events")
def x58(spark, sf_dir):
    out = F.lit("rest")
    for prefix, step in reversed((("pu", "pay"), ("p", "other p"), ("c", "act"))):
        out = F.when(F.col("event_type").startswith(prefix), step).otherwise(out)
    return table(spark, sf_dir, "events").select("event_id", out.alias("step"))


@query("X60_language_names", "SELECT doc_id, CASE lang WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'English' END AS name FROM documents")
def x60(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.language_name(F.col("lang")).alias("name"))


@query("X8_escaped_sources", r"SELECT page_id, md5(regexp_replace('<Source id=' || page_id || '>' || replace(coalesce(html, ''), '<p', '<source') || '</source> <sources>', '(?i)<(/?source\b)', '&lt;\1', 'g')) AS escaped_md5 FROM pages")
def x8(spark, sf_dir):
    """Whole pages whose paragraphs pass for sources."""
    text = F.concat(F.lit("<Source id="), F.col("page_id").cast("string"), F.lit(">"), F.replace(F.coalesce("html", F.lit("")), F.lit("<p"), F.lit("<source")), F.lit("</source> <sources>"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_source_tags(text)).alias("escaped_md5"))


@query("X7_token_counts", "SELECT doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM documents")
def x7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("X2_promoted_headings", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
b AS (SELECT *, coalesce(trim(lag(line) OVER w) = '', true) AS pb, coalesce(trim(lead(line) OVER w) = '', true) AS nb, count(*) FILTER (WHERE trim(line) <> '') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS first FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, n - 1 AS line_no, trim(line) AS heading FROM b WHERE pb AND nb AND NOT first AND trim(line) <> '' AND length(trim(line)) <= 60 AND len(string_split_regex(trim(line), '\s+')) <= 12 AND NOT regexp_matches(line, '^\s')
AND NOT regexp_matches(trim(line), '^[-*>|~`\["''“”「『(〔]|["''”’」』)】〔.!?…:;,。！？；：]$|\||^\d+[.)]\s') AND trim(line) <> lower(trim(line)) AND regexp_matches(line, '[\p{L}\p{N}_]')""")
def x2(spark, sf_dir):
    from brindle.operators.ingest import headings

    return headings(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "heading")
