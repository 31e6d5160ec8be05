"""Settings merged and checked in Spark against a patch-by-patch version."""

import json
import random

from brindle.functions import settings as Q
from brindle.operators import settings as S

VALUES = [1, 0, -2.5, "x", "", None, True, [1, {"a": 2}], "{not json", 'quote "', "é"]


def document(rng, depth=0):
    own = {}
    for name in rng.sample(["a", "b", "c.d", "é"], rng.randint(1, 3)):
        own[name] = document(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else rng.choice(VALUES)
    return own


def flat(doc, path=()):
    for name, value in doc.items():
        if isinstance(value, dict):
            yield from flat(value, (*path, name))
        else:
            yield (*path, name), value


def test_merged_patches_equal_the_plain_version(spark):
    rng = random.Random(3)
    patches = [(k, v, json.dumps(document(rng))) for k in range(30) for v in range(rng.randint(1, 9))]
    odd = [(90, 1, None), (90, 2, "not json"), (90, 3, "[1]"), (90, 4, "7"), (90, 5, "{}"), (None, 1, '{"a": 1}'), (91, None, '{"a": 1}')]
    df = spark.createDataFrame([*patches, *odd], "k long, v long, patch string").repartition(5)
    got = {}
    for r in S.deep_merged(S.leaves(df, "patch"), "k", "v").collect():
        got.setdefault(r.k, {})[tuple(r.path)] = json.loads(r.value)
    want = {}
    for k, _, patch in patches:
        want[k] = Q.merged(want.get(k, {}), json.loads(patch))
    assert got == {k: dict(flat(doc)) for k, doc in want.items()}
    assert S.deep_merged(S.leaves(df.limit(0), "patch"), "k", "v").count() == 0


def test_values_are_checked_by_their_rules(spark):
    rules = [("n", "number", 0.0, 1.0, None, False), ("i", "integer", 1.0, None, None, True), ("t", "text", None, None, ["on", "off"], False), ("f", "flag", None, None, None, False), ("s.*", "number", 0.0, None, None, False), ("s.own", "text", None, None, None, False)]
    rules = spark.createDataFrame(rules, "name string, kind string, low double, high double, choices array<string>, optional boolean")
    cases = [
        (["n"], "0.5", None), (["n"], "1e-1", None), (["n"], "2", "range"), (["n"], '"0.5"', "type"), (["n"], "null", "type"), (["n"], "true", "type"),
        (["i"], "3", None), (["i"], "0", "range"), (["i"], "1.5", "type"), (["i"], "null", None), (["t"], '"on"', None), (["t"], '"odd"', "range"), (["t"], "1", "type"),
        (["f"], "true", None), (["f"], "1", "type"), (["s", "x"], "4", None), (["s", "x"], "-4", "range"), (["s", "own"], '"4"', None), (["s", "x", "y"], "4", "unknown"), (["q"], "1", "unknown"), (["s"], "1", "unknown"),
    ]
    out = S.checked(spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(cases)], "id int, path array<string>, value string"), rules)
    assert out.columns == ["id", "path", "value", "name", "problem"]
    assert {r.id: r.problem for r in out.collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_documents_are_parsed_once_at_any_depth(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1, "none": {}}}}, "l": [{"x": 1}]}}}, "n": None}
    rows = [(1, 1, json.dumps(deep)), (1, 1, json.dumps(deep)), (1, 2, json.dumps({"a": {"b": {"c": {"l": "{}"}}}})), (2, 1, '{"a": {}}')]
    leaves = S.leaves(spark.createDataFrame(rows, "k long, v long, patch string"), "patch")
    # What reads the leaves reads a table: no text is parsed again by the passes of a merge.
    plan = leaves._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "variant_explode" not in plan
    got = sorted((r.k, ".".join(r.path), r.value) for r in S.deep_merged(leaves, "k", "v").collect())
    # Rows of one version both stand, as in SQL.
    assert got == [(1, "a.b.c.d.e.f.g", "1")] * 2 + [(1, "a.b.c.l", '"{}"')] + [(1, "n", "null")] * 2
