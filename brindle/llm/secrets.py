"""Operator 5: secret scans behind a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams that every match must contain is derived from
it; the index lists the documents of each trigram that some query names; posting lists are intersected within an
alternative and united over alternatives; only the documents left are searched with the expression itself. Rules
without a mandatory trigram are searched in every text. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, prefix_sums, read


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if its ``group`` has at least ``least`` characters.

    ``test``, if given, is a shorter expression that each text with such a match also matches.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    test: str = ""


#: The three base rules, whose patterns are fixed, then those that the method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE + MORE

#: A query: alternatives, each a set of trigrams that must all occur. None: no trigram is mandatory.
Query = tuple[frozenset[str], ...] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return tuple(dict.fromkeys(x | y for x, y in product(a, b)))


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return tuple(dict.fromkeys(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)))


def _look(nodes) -> tuple[set[str] | None, Query]:
    """All strings that a part of an expression can match, if they are few, and the query of its matches."""
    exact: set[str] = {""}
    whole, query = True, None
    for op, arg in nodes:
        part: set[str] | None = None
        own: Query = None
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            part, own = _look(arg[-1])
        elif op is C.BRANCH:
            looks = [_look(x) for x in arg[1]]
            if all(p is not None for p, _ in looks):
                part = set().union(*(p for p, _ in looks))
            if all(q is not None for _, q in looks):
                own = tuple(dict.fromkeys(x for _, q in looks for x in q))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            inner_exact, inner_query = _look(inner)
            if inner_exact is not None and most == 1:
                part = inner_exact | ({""} if least == 0 else set())
            own = inner_query if least else None
        if part is not None and len(exact) * len(part) <= 64:
            exact = {a + b for a in exact for b in part}
        else:
            query, exact, whole = _both(_both(query, _of_strings(exact)), own), {""}, False
    return (exact if whole else None), _both(query, _of_strings(exact))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, over lower-cased text."""
    query = _look(_parser.parse(pattern))[1]
    return query and tuple(x for x in query if not any(y < x for y in query))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id), a row for each of the trigrams in a document's lower-cased text."""
    if not trigrams:
        return docs.select(F.lit("").alias("trigram"), "doc_id").limit(0)
    low = F.lower(F.coalesce("text", F.lit("")))
    return (
        docs.select("doc_id", low.alias("_low"))
        .select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))).alias("trigram"))
        .select("trigram", "doc_id")
    )


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(doc_id, mask): bit n of the mask tells that the document satisfies the query of rule n."""
    spark = index.sparkSession
    rows = [
        (n, k, t, 1 << i, (1 << len(alt)) - 1)
        for n, q in queries.items()
        if q is not None
        for k, alt in enumerate(q)
        for i, t in enumerate(sorted(alt))
    ]
    clauses = spark.createDataFrame(rows, "rule int, alt int, trigram string, bit long, whole long")  # as long as the rules, so it may be broadcast
    met = (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("doc_id", "rule", "alt", "whole")
        .agg(F.bit_or("bit").alias("have"))
        .where(F.col("have") == F.col("whole"))
    )
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, n, end) of a rule's matches in code points, leftmost and not overlapping, end exclusive.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths are offsets.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern), lambda x: F.length(x).cast("long"))
    lengths = F.transform(F.regexp_extract_all(text, pattern, 0), lambda x: F.length(x).cast("long"))
    sizes = F.transform(F.regexp_extract_all(text, pattern, rule.group), lambda x: F.length(x)) if rule.group else lengths

    def spans(gap: Column, length: Column, own: Column) -> Column:
        before = prefix_sums(F.zip_with(F.slice(gap, 1, F.size(length)), length, lambda a, b: a + b))
        return let(
            before,
            lambda p: F.filter(
                F.transform(
                    length,
                    lambda n, i: F.struct(
                        (F.get(p, i) + F.get(gap, i)).alias("start"),
                        F.lit(number).alias("n"),
                        (F.get(p, i) + F.get(gap, i) + n).alias("end"),
                        F.get(own, i).cast("long").alias("size"),
                    ),
                ),
                lambda s: s["size"] >= rule.least,
            ),
        )

    return let(gaps, lambda g: let(lengths, lambda n: let(sizes, lambda own: spans(g, n, own))))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["n"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: an array of spans (start, n, end, size), n the rule's place in ``rules``.

    Null and empty texts hold nothing. Repeated rows are each searched; documents that share an id share index
    entries, which only widens what is searched. A null id is looked up like any other value. A column of ``docs``
    named ``found`` is replaced, all others stay as they are. An empty table gives no rows. Candidates are joined by id: Spark broadcasts them if they prove small at run time.
    """
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    trigrams = sorted({t for q in queries.values() if q is not None for alt in q for t in alt})
    hits = candidates(postings(docs, trigrams), queries).select(F.col("doc_id").alias("id"), "mask")
    empty = F.array().cast("array<struct<start:bigint,n:int,end:bigint,size:bigint>>")
    text = F.coalesce("row.text", F.lit(""))
    own = []
    for n, r in enumerate(rules):
        asked = text.rlike(r.test or r.pattern)
        if queries[n] is not None:
            asked = (F.coalesce("mask", F.lit(0)).bitwiseAND(1 << n) != 0) & asked
        own.append(F.when(asked, rule_spans(text, r, n)).otherwise(empty))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "found"]).alias("row"))
    joined = rows.join(hits, F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("row", F.concat(*own).alias("found")).select("row.*", "found")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["n"] < len(BASE))
    count = lambda n: F.size(F.filter("found", lambda s: s["n"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)],
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"),
        _joined(F.col("found"), RULES).alias("spans"),
    )


def _sql() -> str:
    """The same rows in DuckDB: pieces between matches and matches give offsets."""
    parts = []
    for n, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"""r{n} AS (SELECT row, list_filter(list_transform(range(1, len(l) + 1), lambda i: {{'s': (coalesce(list_sum(list_slice(g, 1, i)), 0) + coalesce(list_sum(list_slice(l, 1, i - 1)), 0))::BIGINT, 'n': {n},
  'e': (coalesce(list_sum(list_slice(g, 1, i)), 0) + coalesce(list_sum(list_slice(l, 1, i)), 0))::BIGINT, 'z': length(k[i])}}), lambda x: x.z >= {r.least}) AS f{n}
  FROM (SELECT row, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS l, regexp_extract_all(t, '{pattern}', {r.group}) AS k FROM d))"""
        )
    joined = lambda n: "array_to_string(list_transform(list_sort(" + " || ".join(f"f{i}" for i in range(n)) + f"), lambda x: {[r.kind for r in RULES]}[x.n + 1] || ':' || x.s || ':' || x.e), ',')"
    tables = " ".join(f"JOIN r{i} USING (row)" for i in range(len(RULES)))
    counts = ", ".join(f"len(f{n}) AS n_{r.kind}" for n, r in enumerate(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), {", ".join(parts)}
SELECT doc_id, {counts}, sha256({joined(len(BASE))}) AS base_sha256, {joined(len(RULES))} AS spans FROM d {tables}"""


OP5_SQL = _sql()
