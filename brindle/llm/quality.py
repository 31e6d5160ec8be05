"""Operator 1: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (words, pairs of neighbouring words, and the last three signs of words) are counted: one over a trusted target (documents
labelled good) and one over the whole raw corpus. A document's score is the mean over its n-grams of
log p(target) - log p(raw); documents under a fixed threshold are rejected. Rules on length and repetition
come first. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, read, words_of

#: Production parameters.
BUCKETS = 1 << 14
TARGET_ROWS = 20_000
THRESHOLD = -0.5
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Length of the n-gram of signs at each word's end, which sees suffixes and stray symbols.
TAIL = 3


def _repeated(windows: Column) -> Column:
    """Number of words that lie in a window whose key occurs twice or more."""

    def positions(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            key = x["key"]
            return F.coalesce(F.get(s, k - 1)["key"] == key, F.lit(False)) | F.coalesce(F.get(s, k + 1)["key"] == key, F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["at"]))

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("key"), i.alias("at"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        let(ordered, positions),
        start,
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + (p + WINDOW) - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"],
    )


def _windows(words: Column) -> Column:
    """A 64-bit key for each window of ``WINDOW`` words."""
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - WINDOW)),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def with_base_columns(rows: DataFrame) -> DataFrame:
    """``rows`` (among others ``text``) with the words of each text in ``words`` and the fixed columns of the rules.

    Each step names the column of the step before it more than once, so that Spark works it out once a row.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = rows.withColumns({"words": words_of(F.col("text")), "lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": _windows(F.col("words")),
        }
    )
    out = out.withColumn("twins", F.size("windows") - F.size(F.array_distinct("windows")))
    repeated = F.when(F.col("twins") > 0, _repeated(F.col("windows"))).otherwise(F.lit(0).cast("long"))
    return out.withColumn("n_repeat_words", repeated).drop("lines", "windows", "twins")


def word_grams(word: Column, buckets: int) -> list[Column]:
    """The hashed n-grams that a word stands for: itself, and its last ``TAIL`` signs."""
    m = F.lit(buckets)
    return [F.pmod(F.xxhash64(word), m).cast("int"), F.pmod(F.xxhash64(F.substring(word, -TAIL, TAIL), F.lit(0)), m).cast("int")]


def pair_gram(word: Column, after: Column, buckets: int) -> Column:
    """The hashed n-gram of a word and the one after it; null where none follows."""
    return F.when(after.isNotNull(), F.pmod(F.xxhash64(word, after, F.lit(2)), F.lit(buckets)).cast("int"))


def _with_next(words: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` (a word, the word after it or null) for each of ``words``."""
    return let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), of))


def target_ids(labels: DataFrame, limit: int = TARGET_ROWS) -> DataFrame:
    """At most ``limit`` ids labelled good, those of the smallest hash: the bounded trusted sample."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, limit: int = TARGET_ROWS, pairs: bool = False) -> DataFrame:
    """One row, ``w``: for each bucket log p(target) - log p(raw), add-one smoothed, over all documents."""
    spark = docs.sparkSession
    words, both = words_of(F.col("text")), word_grams(F.col("word"), buckets)
    listed = _with_next(words, lambda w, after: F.struct(w.alias("word"), after.alias("after"))) if pairs else words
    if pairs:
        both = [*word_grams(F.col("word.word"), buckets), pair_gram(F.col("word.word"), F.col("word.after"), buckets)]
    target = target_ids(labels, limit).withColumn("target", F.lit(1))  # at most `limit` rows, so it may be broadcast
    grams = (
        docs.select("doc_id", "text")
        .join(F.broadcast(target), "doc_id", "left")
        .select(F.coalesce("target", F.lit(0)).alias("target"), F.explode(listed).alias("word"))
        .select("target", F.explode(F.array(*both)).alias("bucket"))
        .where("bucket is not null")
    )
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("good"))
    full = (
        spark.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left")
        .na.fill(0, ["raw", "good"])
    )
    rows = F.sort_array(F.collect_list(F.struct("bucket", "raw", "good")))
    whole = full.agg(rows.alias("rows"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    return whole.select(
        F.transform(
            "rows",
            lambda r: F.log((r["good"] + 1) / (F.col("n_good") + buckets)) - F.log((r["raw"] + 1) / (F.col("n_raw") + buckets)),
        ).alias("w")
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS,
    pairs: bool = False,
) -> DataFrame:
    """``docs`` with the base columns, ``base_failed``, ``llr`` and ``kept``.

    Nulls and empty texts have no words and fail the base rules; a text without n-grams scores 0. Windows count as
    equal if their 64-bit hashes are. Repeated rows are each scored. Columns of ``docs`` named like a result are
    replaced, all others stay as they are. An empty table gives no rows. Without labelled rows the target is empty,
    smoothing makes it uniform, and the threshold still decides each document alike. With ``pairs``, each two words that
    stand side by side are an n-gram too.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("row"), "text", bucket_weights(docs, labels, buckets, target_rows, pairs).scalar().alias("w"))

    def add(total: Column, word: Column) -> Column:
        return total + sum((F.get(F.col("w"), g) for g in word_grams(word, buckets)), F.lit(0.0))

    out = with_base_columns(rows).withColumn("total", F.aggregate("words", F.lit(0.0), add))
    grams = F.col("n_words") * 2
    if pairs:
        of_pairs = _with_next(F.col("words"), lambda w, after: F.get(F.col("w"), pair_gram(w, after, buckets)))
        out = out.withColumn("total", F.col("total") + F.aggregate(of_pairs, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))))
        grams = F.col("n_words") * 3 - 1
    out = out.withColumn("llr", F.when(F.col("n_words") > 0, F.col("total") / grams).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select("row.*", *new)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), pairs=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
