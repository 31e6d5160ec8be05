"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_tokenizer_alignment
from .decontamination import op6_benchmark_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .licenses import OP7_SQL, op7_license_scan
from .line_dedup import op9_line_dedup
from .ngram_join import op10_ngram_jaccard
from .packing import op8_sequence_packing
from .quality import op1_quality_rules
from .secrets import OP5_SQL, op5_secret_scan
from .sharding import OP3_SQL, op3_jump_sharding
from .topk import OP11_SQL, op11_pivot_topk
from .toxicity import op2_toxicity
from .warc import OP4_SQL, op4_warc_histories


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_jump_sharding, op4_warc_histories, op5_secret_scan, op6_benchmark_decontamination, op7_license_scan, op8_sequence_packing, op9_line_dedup, op10_ngram_jaccard, op11_pivot_topk, op12_tokenizer_alignment, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jump_sharding": OP3_SQL, "op4_warc_histories": OP4_SQL, "op5_secret_scan": OP5_SQL, "op7_license_scan": OP7_SQL, "op11_pivot_topk": OP11_SQL, "op13_filter_audit": OP13_SQL}
