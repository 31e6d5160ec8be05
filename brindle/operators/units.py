"""Units of texts, windows of units that fit a limit, and what a window repeats of the one before.

Paragraphs fall into sentences, these into runs of words, and words into pieces, each only where the larger unit is over
the limit. A text is cut in its own row; windows of very many units are filled by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.language import sentences
from brindle.functions.text import paragraphs, token_count
from brindle.operators.chains import packed_batches
from brindle.operators.tables import written

#: Characters that count as one token.
SIGNS = 4


def _runs(sentence: Column, signs: int) -> Column:
    """Runs of words, filled to ``signs``; a longer word is cut into pieces of that size, of which the last goes on as a word.

    A greedy pattern takes the longest run that fits and ends with a word, so all is cut in the row that holds the text.
    """
    words = F.btrim(F.regexp_replace(sentence, r"\s+", " "))
    words = F.regexp_replace(words, rf"(\S{{{signs}}})(?=\S)", "$1 ")
    return F.regexp_extract_all(words, F.lit(rf"(?s)\S(?:.{{0,{signs - 2}}}\S)?(?=\s|$)" if signs > 1 else r"\S"), 0)


def text_units(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n, text, tokens) of (doc_id, text): units of at most ``limit`` tokens, numbered from 1 in their order.

    Runs of words are filled to the limit; a word beyond it is cut into pieces of the limit, of which the last goes on as a
    word. A null or blank text has no units. Ids are taken as the keys of documents: rows of one id are one document.

    A text is cut within its row, where its units have their numbers, so no text is shuffled or written; only texts of
    an id that stands in several rows are dealt by it to be numbered as one.
    """
    signs = limit * SIGNS

    def cut(p: Column, i: Column) -> Column:
        parts = F.when(F.length(p) <= signs, F.array(p)).otherwise(sentences(p))
        return F.flatten(F.transform(parts, lambda s, j: F.transform(F.when(F.length(s) <= signs, F.array(s)).otherwise(_runs(s, signs)), lambda t, r: F.struct(i.alias("par"), j.alias("sent"), r.alias("run"), t.alias("text")))))

    named = docs.where("doc_id is not null").select("doc_id", "text")
    several = written(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "several-rows")
    units = lambda rows: rows.select("doc_id", F.posexplode(F.flatten(F.transform(paragraphs(F.col("text")), cut))).alias("at", "u"))
    shared = not several.isEmpty()
    out = units(named.join(several, "doc_id", "left_anti") if shared else named).select("doc_id", F.col("at") + 1, "u.text")
    if shared:
        order = Window.partitionBy("doc_id").orderBy("u.par", "u.sent", "u.run")
        out = out.union(units(named.join(several, "doc_id", "left_semi")).select("doc_id", F.row_number().over(order), "u.text"))
    return out.toDF("doc_id", "n", "text").select("doc_id", "n", "text", token_count(F.col("text")).alias("tokens"))


def token_windows(units: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n, tokens, window): units go into windows in order as long as these hold at most ``limit`` tokens."""
    sizes = written(units.select("doc_id", "n", "tokens"), "unit-sizes")  # texts are cut once
    out = packed_batches(sizes, "doc_id", "n", "tokens", limit)
    return out.withColumnRenamed("batch", "window")


def tail_overlaps(windows: DataFrame, budget: int) -> DataFrame:
    """(doc_id, window, repeated, tokens): how many of its last units a window gives to the next, and their tokens.

    As many as fit ``budget`` together, never all of them. A window has a bounded number of tokens, so it is small.
    """
    back = Window.partitionBy("doc_id", "window").orderBy(F.col("n").desc())
    own = windows.withColumn("_sum", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.lead("n").over(back).isNull())
    fits = (F.col("_sum") <= budget) & ~F.col("_first")
    return own.groupBy("doc_id", "window").agg(F.count_if(fits).alias("repeated"), F.coalesce(F.max(F.when(fits, F.col("_sum"))), F.lit(0)).alias("tokens"))
