"""Ingestion queries: pages are uploads, hosts are collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import ingest as I
from brindle.plans.language import _SENT
from brindle.plans.registry import query, table
from brindle.plans.texts import _STRIP


def _files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "//([^/:?#]*)", 1)
    return pages.select(host.alias("collection"), F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 7 == 0, ".exe").otherwise(".html")).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))


@query("S1_sniffed_types", "SELECT page_id || CASE WHEN page_id % 7 = 0 THEN '.exe' ELSE '.html' END AS name, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'text/html' END AS mime FROM pages")
def s1(spark, sf_dir):
    return _files(spark, sf_dir).select("name", I.sniff(F.col("name"), F.col("content")).alias("mime"))


@query("S5_content_dedupe", """WITH f AS (SELECT regexp_extract(url, '//([^/:?#]*)', 1) AS collection, page_id || '.html' AS name, sha256(coalesce(html, '')) AS sha256 FROM pages WHERE page_id % 7 <> 0)
SELECT collection, min(name) AS name, sha256 FROM f GROUP BY collection, sha256""")
def s5(spark, sf_dir):
    return I.acceptable(_files(spark, sf_dir)).select("collection", "name", "sha256")


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]
_MARKDOWN = r"regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g')"
_MARKDOWN = rf"regexp_replace(regexp_replace({_MARKDOWN}, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _old, _new in _ENTITIES:
    _MARKDOWN = f"replace({_MARKDOWN}, '{_old}', '{_new}')"
_MARKDOWN = rf"trim(regexp_replace(regexp_replace({_MARKDOWN}, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
_FLAGS = rf"""concat_ws(',', CASE WHEN length({_STRIP.format('m')}) < 200 THEN 'low_text' END,
  CASE WHEN cells >= 12 OR (length(m) - length(replace(m, '|', ''))) / greatest(length({_STRIP.format('m')}), 1) * 1000 > 25 THEN 'table_heavy' END)"""


@query("S6_parsed_pages", rf"WITH p AS (SELECT page_id, {_MARKDOWN} AS m, len(regexp_extract_all(coalesce(html, ''), '(?i)<t[dh]\b')) AS cells FROM pages) SELECT page_id, length(m) AS chars, md5(m) AS text_md5, {_FLAGS} AS flags FROM p")
def s6(spark, sf_dir):
    out = I.parse_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("markdown").alias("chars"), F.md5("markdown").alias("text_md5"), F.array_join("flags", ",").alias("flags"))


@query("S8_ocr_candidates", rf"""SELECT doc_id, source FROM documents WHERE length(trim(coalesce(text, ''))) < 200 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 50""")
def s8(spark, sf_dir):
    from brindle.operators.windows import sequence

    short = table(spark, sf_dir, "documents").where(I.needs_ocr(F.coalesce("text", F.lit("")), F.lit(0.0)))
    return sequence(short, "source", ["doc_id"], "n").where("n <= 50").select("doc_id", "source")


_MARKED = """m AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN '#' WHEN 'assistant' THEN '##' ELSE '####' END || ' Turn ' || turn || chr(10) || CASE WHEN turn % 3 = 0 THEN '' ELSE 'Text of ' || turn || '. More.' END AS part FROM (SELECT DISTINCT conv_id, turn, role FROM conversations))"""


@query("X1_heading_paths", f"""WITH RECURSIVE {_MARKED}, h AS (SELECT conv_id, turn, part, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 4 END AS level FROM m),
p AS (SELECT conv_id, turn, part, n, ['Turn ' || turn] AS path FROM h WHERE n = 1 UNION ALL SELECT h.conv_id, h.turn, h.part, h.n, path[1:h.level - 1] || ['Turn ' || h.turn] FROM p JOIN h ON h.conv_id = p.conv_id AND h.n = p.n + 1)
SELECT conv_id, turn, array_to_string(path, ' > ') AS path FROM p WHERE turn % 3 <> 0""")
def x1(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    mark = F.when(F.col("role") == "user", "#").when(F.col("role") == "assistant", "##").otherwise("####")
    body = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Text of "), F.col("turn").cast("string"), F.lit(". More.")))
    part = F.concat(mark, F.lit(" Turn "), F.col("turn").cast("string"), F.lit("\n"), body)
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("part"))))
    docs = turns.groupBy("conv_id").agg(parts.alias("p")).select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("text"))
    out = I.sections(docs).select("doc_id", F.explode("sections").alias("s"))
    turn = F.regexp_extract(F.col("s.path"), "Turn ([0-9]+)$", 1).cast("long")
    return out.select(F.col("doc_id").alias("conv_id"), turn.alias("turn"), F.col("s.path").alias("path"))


_CHAPTER = (
    r"^(?:CHAPTER|Chapter|CAPÍTULO|Capítulo|CHAPITRE|Chapitre|Kapitel|KAPANATA|Kabanata)\s+(?:[0-9]+|[IVXLCDM]+|[ivxlcdm]+|primero|Primero)\b.{0,70}$"
    r"|^第[0-9０-９一二三四五六七八九十百千萬零〇两兩]+[回章].{0,60}$|^(?:[IVXLCDM]+|[ivxlcdm]+)[.:=]?$"
)
_META = r"^(?:Author|Title|Language|Credits|Translator|Posting [Dd]ate|Release [Dd]ate|Last [Uu]pdated|Other information|ISBN|Editor)\s*:"
_NO_TITLE = r"""^[-*>|~`\["''“”「『(〔]|["''”’」』)】〕.!?…:;,。！？；：]$|\||^\d+[.)]\s"""
_MARK = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
_BLANKS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"
_PARTS = rf"list_filter(list_transform(string_split_regex(body, '\n[ \t]*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '')"
_TAKE, _MOST, _TAIL = 4 * I.CHILD_TOKENS, I.SECTION_TOKENS, I.OVERLAP_TOKENS
_CUT = f"(length(rest) * {I.CHILD_TOKENS} // ceil(length(rest) / 4)::BIGINT)"
#: Headings and the paths behind them (h, path), bodies (body), pieces that fit a chunk (cut, piece), their filling (fill),
#: what chunks and sections repeat (again, carry).
_CHUNKS = rf"""WITH RECURSIVE x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM x),
b AS (SELECT *, coalesce(trim(lag(line) OVER w) = '', true) AND coalesce(trim(lead(line) OVER w) = '', true) AS apart, coalesce(count(*) FILTER (WHERE trim(line) <> '') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first,
  CASE WHEN regexp_matches(trim(line), '^=.+=$') THEN trim(regexp_replace(trim(line), '^=|=$', '', 'g')) ELSE trim(line) END AS t FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
m AS (SELECT doc_id, n, line, length(regexp_extract(line, '{_MARK}', 1)) AS level, CASE WHEN regexp_matches(line, '{_MARK}') THEN trim(regexp_extract(line, '{_MARK}', 2))
  WHEN apart AND t <> '' AND length(t) <= 80 AND NOT regexp_matches(t, '{_META}') AND (regexp_matches(t, '{_CHAPTER}') OR (NOT first AND length(t) <= 60 AND len(string_split_regex(t, '\s+')) <= 12 AND NOT regexp_matches(line, '^\s')
  AND NOT regexp_matches(t, '{_NO_TITLE}') AND t <> lower(t) AND regexp_matches(t, '[\p{{L}}\p{{N}}_]'))) THEN t END AS title FROM b),
d AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM m),
path AS (SELECT DISTINCT doc_id, 0::BIGINT AS sec, []::VARCHAR[] AS path FROM documents UNION ALL
SELECT d.doc_id, d.sec, path[1:greatest(d.level - 1, 0)] || [d.title] FROM path JOIN d ON d.doc_id = path.doc_id AND d.sec = path.sec + 1 AND d.title IS NOT NULL),
body AS (SELECT doc_id, sec, regexp_replace(string_agg(line, chr(10) ORDER BY n), '(?i)<(/?source\b)', '&lt;\1', 'g') AS body FROM d WHERE title IS NULL GROUP BY ALL),
p AS (SELECT doc_id, sec, unnest(l) AS text, generate_subscripts(l, 1) AS par FROM (SELECT doc_id, sec, {_PARTS} AS l FROM body)),
s AS (SELECT doc_id, sec, par, unnest(l) AS s, generate_subscripts(l, 1) AS sent FROM (SELECT doc_id, sec, par, CASE WHEN length(text) <= {_TAKE} THEN [text] ELSE {_SENT} END AS l FROM p)),
w AS (SELECT doc_id, sec, par, sent, list_filter(string_split_regex(s, '{_BLANKS}'), lambda x: x <> '') AS w FROM s WHERE length(s) > {_TAKE}),
cut AS (SELECT doc_id, sec, par, sent, w, 0 AS step, 1 AS k, w[1] AS rest, '' AS run, []::VARCHAR[] AS out FROM w UNION ALL
SELECT doc_id, sec, par, sent, w, step + 1, CASE WHEN length(rest) > {_TAKE} THEN k ELSE k + 1 END, CASE WHEN length(rest) > {_TAKE} THEN substr(rest, {_CUT} + 1) ELSE w[k + 1] END,
  CASE WHEN length(rest) > {_TAKE} THEN '' WHEN run = '' OR length(run) + 1 + length(rest) > {_TAKE} THEN coalesce(rest, '') ELSE run || ' ' || rest END,
  CASE WHEN rest IS NULL THEN [run] WHEN length(rest) > {_TAKE} THEN [run, substr(rest, 1, {_CUT})] WHEN run <> '' AND length(run) + 1 + length(rest) > {_TAKE} THEN [run] ELSE [] END FROM cut WHERE k <= len(w) + 1),
piece AS (SELECT doc_id, sec, text, ceil(length(text) / 4)::BIGINT AS size, row_number() OVER (PARTITION BY doc_id, sec ORDER BY par, sent, step, o) AS i FROM (SELECT doc_id, sec, par, sent, 0 AS step, 0 AS o, s AS text FROM s WHERE length(s) <= {_TAKE}
  UNION ALL SELECT doc_id, sec, par, sent, step, generate_subscripts(out, 1), unnest(out) FROM cut) WHERE text <> ''),
fill AS (SELECT doc_id, sec, i, 0 AS whole, 0 AS ord, size AS used, size AS own FROM piece WHERE i = 1 UNION ALL
SELECT p.doc_id, p.sec, p.i, CASE WHEN used + size > {_MOST} THEN whole + 1 ELSE whole END, CASE WHEN used + size > {_MOST} THEN 0 WHEN own + size > {I.CHILD_TOKENS} THEN ord + 1 ELSE ord END,
  CASE WHEN used + size > {_MOST} THEN size ELSE used + size END, CASE WHEN used + size > {_MOST} OR own + size > {I.CHILD_TOKENS} THEN size ELSE own + size END
FROM fill JOIN piece p ON p.doc_id = fill.doc_id AND p.sec = fill.sec AND p.i = fill.i + 1),
f AS (SELECT doc_id, sec, i, whole, ord, text, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY sec, whole) - 1 AS section FROM fill JOIN piece USING (doc_id, sec, i)),
g AS (SELECT *, sum(size) OVER run <= {_TAIL} AND i > min(i) OVER (PARTITION BY doc_id, section, ord) AS last_run, sum(size) OVER sect <= {_TAIL} AND i > min(i) OVER (PARTITION BY doc_id, section) AS last_sect
  FROM f WINDOW run AS (PARTITION BY doc_id, section, ord ORDER BY i DESC), sect AS (PARTITION BY doc_id, section ORDER BY i DESC)),
chunk AS (SELECT doc_id, section, any_value(sec) AS sec, ord, string_agg(text, chr(10) ORDER BY i) AS text, string_agg(text, chr(10) ORDER BY i) FILTER (WHERE last_run) AS again FROM g GROUP BY doc_id, section, ord),
carry AS (SELECT doc_id, section + 1 AS section, string_agg(text, chr(10) ORDER BY i) FILTER (WHERE last_sect) AS before FROM g GROUP BY ALL),
c AS (SELECT chunk.doc_id, section, sec, ord, concat_ws(chr(10), CASE WHEN ord = 0 THEN before ELSE lag(again) OVER (PARTITION BY chunk.doc_id, section ORDER BY ord) END, chunk.text) AS text FROM chunk LEFT JOIN carry USING (doc_id, section))"""


@query("X6_E8_chunked_documents", f"{_CHUNKS} SELECT doc_id, section::INT AS section, array_to_string(path, ' > ') AS heading_path, ord::INT AS ord, ceil(length(text) / 4)::BIGINT AS tokens, md5(text) AS text_md5 FROM c JOIN path USING (doc_id, sec)")
def g1(spark, sf_dir):
    return I.chunked(table(spark, sf_dir, "documents")).select("doc_id", "section", "heading_path", "ord", "tokens", F.md5("text").alias("text_md5"))


@query("J30_offset_pages", """WITH p AS (SELECT conv_id AS doc_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
o AS (SELECT DISTINCT conv_id AS doc_id, unnest([10, 500, 1500]) AS o FROM conversations) SELECT doc_id, o AS "offset", min(turn)::BIGINT AS page FROM o JOIN p USING (doc_id) WHERE e >= o GROUP BY 1, 2""")
def j30(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    offsets = turns.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.lit(10), F.lit(500), F.lit(1500))).alias("offset"))
    return I.offset_pages(pages, offsets).select("doc_id", "offset", F.col("page").cast("long").alias("page"))
