"""The driver's contract, with and without the optional parts."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from brindle.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.queries()) > 80


def test_flagship_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[:2] == ["query_id", "id"] and out.count() > 0


NAMES = [
    "W4_rolling_5h", "A2_two_level_latency", "J13_latest_per_group", "X23_redaction", "R3_audit_bm25", "K1_stream_sequence", "R6_multi_query_rrf", "W13_adjacent_dedupe", "X24_injection_spans", "X4_sentences",
    "X11_languages", "W7_rate_limit", "W9_circuit_breaker", "W20_packed_batches", "G1_regression_gate", "G3_acceptance_gate", "G11_sanitised_chunks", "J22_decision_pairs", "K14_stream_signal_counts", "R18_cache_put",
    "X11_turn_languages", "K2_K8_stream_followed", "S23_event_sink", "M4_replaced_index", "R16_parsed_plans", "A46_threshold_proposal", "J29_gold_passages",
]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events", "orders", "customer", "lineitem", "labels", "conversations", "embeddings", "pages", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    key = lambda r: tuple(str(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r)
    assert sorted(key(r) for r in got.select(*cols).collect()) == sorted(key(r) for r in want.select(", ".join(cols)).fetchall())


def test_only_a_missing_subpackage_is_left_out(tmp_path):
    import subprocess
    import sys

    root = Path(__spark_entry__.__file__).parent
    (tmp_path / "brindle").mkdir()
    for f in root.glob("brindle/**/*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(registry.queries())), "False"]
    (tmp_path / "brindle" / "llm").mkdir()
    (tmp_path / "brindle" / "llm" / "__init__.py").write_text("")
    (tmp_path / "brindle" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in run().stderr
