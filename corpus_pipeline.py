"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes each as Parquet and
reads it again as the next one's documents.

A null text counts as empty, which the quality rules reject, as they do any text of fewer than ten words. A null ``doc_id``
is an id of its own; other columns may be null and go along. Rows of one id stay or go together where a stage decides by
id (near duplicates, decontamination), and by their own text in the quality rules. Empty tables give empty results, also
without labels or benchmark items. Very long texts are read whole. Columns beyond those of ``documents`` are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontamination, line_dedup, ngram_join, packing, quality
from brindle.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    The verdicts are written before they filter: a filter pushed below them would work the rules out again and again.
    """
    judged = quality.quality_rules(docs, read(spark, sf_dir, "labels")).select(*COLUMNS, "kept")
    return written(judged, "judged").where("kept").select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line chunks; ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked documents."""
    return ngram_join.one_of_each(docs).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: the pieces of each document and their places."""
    return packing.sequence_packing(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the hashed weights nor the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
