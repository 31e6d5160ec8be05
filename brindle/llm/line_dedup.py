"""Operator 9: removal of repeated runs of lines.

A text is cut into chunks of lines where a rolling hash over the hashes of two lines fits a mask, so the cuts
follow the content and not the position. A line that would wrap counts as several lines and is a chunk of its own.
As cuts leave single lines and the ends of a passage depend on its context, what is looked for are units: the
shortest runs of at least two lines of text (blank ones between them do not count) and ``LEAST`` characters that
begin or end at each line, long lines, and chunks of one line with blank ones. Every run of lines that occurs
elsewhere in the same order is covered by its units, whatever stands around it. Units that occur more than once in
the whole corpus stay at their first place and go elsewhere, after their bytes have been compared.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let, read, written

#: Production parameters: a cut after one line pair in ``CUT_EVERY``; a line of ``WRAP`` characters or more counts
#: as several; a run of less than ``LEAST`` characters always stays.
CUT_EVERY = 2
WRAP = 160
LEAST = 40


def chunks(text: Column) -> Column:
    """Chunks (n_lines, body) of a text (not null), in order; joined by newlines they are the text again."""
    lines = F.split(text, "\n")

    def cut(all_lines: Column, hashes: Column) -> Column:
        """For each line, 1 if a chunk starts there: both sides of a long line, or where the rolling hash says so."""

        def starts(x: Column, i: Column) -> Column:
            before = F.get(all_lines, i - 1)
            rolled = F.pmod(F.xxhash64(F.get(hashes, i - 2), F.get(hashes, i - 1)), F.lit(CUT_EVERY)) == 0
            return (i == 0) | (F.length(x) >= WRAP) | (F.length(before) >= WRAP) | rolled

        return F.filter(F.transform(all_lines, lambda x, i: F.when(starts(x, i), i)), lambda i: i.isNotNull())

    def bodies(all_lines: Column, starts: Column) -> Column:
        def body(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(all_lines)) - at
            return F.struct(n.alias("n_lines"), F.array_join(F.slice(all_lines, at + 1, n), "\n").alias("body"))

        return F.transform(starts, body)

    return let(lines, lambda x: let(F.transform(x, lambda y: F.xxhash64(y)), lambda h: let(cut(x, h), lambda s: bodies(x, s))))


def _parts(text: Column) -> Column:
    """Of a text (not null): its ``lines`` that are not blank; ``pieces``, these with the blank lines after each (the
    first also with those before it), which joined by newlines are the text again; ``chunk``, the place of each line's
    chunk; ``alone``, whether the chunk has blank lines besides and ``LEAST`` characters; ``n_chunks``.
    """

    def of(x: Column, at: Column, cs: Column) -> Column:
        places = F.flatten(F.transform(cs, lambda c, j: F.array_repeat(j, c["n_lines"])))

        def piece(p: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(p)
            return F.array_join(F.slice(x, start + 1, F.coalesce(F.get(at, k + 1), F.size(x)) - start), "\n")

        def with_chunk(chunk: Column) -> Column:
            def alone(j: Column, k: Column) -> Column:
                near = F.coalesce(F.get(chunk, k - 1) == j, F.lit(False)) | F.coalesce(F.get(chunk, k + 1) == j, F.lit(False))
                own = F.get(cs, j)
                return ~near & (own["n_lines"] > 1) & (F.length(own["body"]) >= LEAST)

            return F.struct(
                F.transform(at, lambda p: F.get(x, p)).alias("lines"),
                F.transform(at, piece).alias("pieces"),
                chunk.alias("chunk"),
                F.transform(chunk, alone).alias("alone"),
                F.size(cs).alias("n_chunks"),
            )

        return let(places, lambda all_places: let(F.transform(at, lambda p: F.get(all_places, p)), with_chunk))

    def positions(x: Column) -> Column:
        return F.filter(F.transform(x, lambda y, i: F.when(y.rlike(r"\S"), i)), lambda i: i.isNotNull())

    return let(F.split(text, "\n"), lambda x: let(positions(x), lambda at: let(chunks(text), lambda cs: of(x, at, cs))))


def _needs(sizes: Column) -> Column:
    """For each line, how many lines from it on make a unit; null where the text ends before."""

    def need(size: Column, i: Column) -> Column:
        none = F.struct(F.lit(-1).alias("total"), F.lit(0).alias("n"))

        def more(a: Column, s: Column) -> Column:
            full = (a["n"] > 1) & (a["total"] >= LEAST)
            return F.when(full, a).otherwise(F.struct((a["total"] + s).alias("total"), (a["n"] + 1).alias("n")))

        found = F.aggregate(F.slice(sizes, i + 1, LEAST + 1), none, more, lambda a: F.when((a["n"] > 1) & (a["total"] >= LEAST), a["n"]))
        return F.when(size + F.get(sizes, i + 1) > LEAST, 2).otherwise(found)

    return F.transform(sizes, need)


def _units(parts: Column) -> Column:
    """Units (at, n, body) of a text: the first line of text, how many of them, their bytes without blank lines."""
    lines = parts["lines"]

    def over(forward: Column, backward: Column) -> Column:
        begin = F.transform(forward, lambda n, i: F.struct(i.alias("at"), n.alias("n")))
        end = F.transform(backward, lambda n, i: F.struct((i - n + 1).alias("at"), n.alias("n")))
        end = F.filter(end, lambda u: F.get(forward, u["at"]) < u["n"])
        single = F.transform(lines, lambda y, i: F.struct(i.alias("at"), F.when((F.length(y) >= WRAP) | F.get(parts["alone"], i), 1).alias("n")))
        return F.filter(F.concat(begin, end, single), lambda u: u["n"].isNotNull())

    sizes = F.transform(lines, lambda y: F.length(y) + 1)
    spans = let(sizes, lambda z: let(_needs(z), lambda f: let(F.reverse(_needs(F.reverse(z))), lambda b: over(f, b))))
    return F.transform(spans, lambda u: F.struct(u["at"], u["n"], _body(lines, u).alias("body")))


def _body(lines: Column, unit: Column) -> Column:
    return F.array_join(F.slice(lines, unit["at"] + 1, unit["n"]), "\n")


def _keys(body: Column) -> tuple[Column, Column]:
    """Two hashes of a unit's bytes, which together name it."""
    return F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body, F.length(body)).alias("k2")


def repeated_units(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, row_key, marks) of the documents with repeated units, and the tables it is read from; marks: (at, n, k1, k2, kept, gone) of each of
    these, where ``gone`` is the first of its lines that goes: the first place stays whole, so where the unit overlaps
    with that only the lines behind it go.

    Only hashes and places are shuffled, the bytes stay where they are. A unit that very many documents share is
    one row for each task before the shuffle when counted, and its rows are split by Spark when joined.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "row_key", F.explode(let(_parts(text), _units)).alias("u")).select("doc_id", "row_key", "u.at", "u.n", *_keys(F.col("u.body")))
    keyed = written(keyed, "unit-keys")
    place = F.struct("doc_id", "row_key", "at")
    first = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1")
    first = written(first.drop("times"), "unit-firsts")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    gone = F.when(same, F.greatest(F.col("at"), F.col("first.at") + F.col("n"))).otherwise(F.col("at"))
    mark = F.struct("at", "n", "k1", "k2", (F.col("first") == place).alias("kept"), gone.alias("gone"))
    marks = keyed.join(first, ["k1", "k2"]).groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(mark)).alias("marks"))
    return marks, [keyed, first]


def _cleaned(df: DataFrame) -> DataFrame:
    """``df`` (row, marks) with ``clean`` (null where nothing goes), ``n_chunks``, ``removed`` and ``bodies`` of the marks."""
    none = F.array().cast("array<int>")

    def of(parts: Column) -> Column:
        outs = F.filter("marks", lambda m: ~m["kept"] & (m["gone"] < m["at"] + m["n"]))
        out = F.array_distinct(F.flatten(F.transform(outs, lambda m: F.sequence(m["gone"], m["at"] + m["n"] - 1))))

        def rest(gone: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(parts["lines"]) - 1), gone)
            clean = F.array_join(F.transform(stay, lambda i: F.get(parts["pieces"], i)), "\n")
            return F.struct(
                F.when(F.size(gone) > 0, clean).alias("clean"),
                parts["n_chunks"].alias("n_chunks"),
                F.array_sort(F.array_distinct(F.transform(gone, lambda i: F.get(parts["chunk"], i)))).alias("removed"),
                F.transform("marks", lambda m: F.struct(m["k1"], m["k2"], _body(parts["lines"], m).alias("body"))).alias("bodies"),
            )

        return let(F.coalesce(out, none), rest)

    return df.withColumn("got", let(_parts(F.coalesce("row.text", F.lit(""))), of)).select("row", "marks", "got.*")


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_chunks`` and ``removed`` (places, from 0, of the chunks that lines are taken from).

    Of equal units the first by (doc_id, hash of the text, place) stays; a null id comes first. A line goes if it is
    in a repeated unit, with the blank lines after it; some place keeps each line. Rows of the same id and text count
    as one place and keep the same lines. Null texts stay null and empty ones empty; a text whose lines all go
    becomes empty. Bytes of all repeated units are compared within each pair of hashes; where they differ nothing is
    removed under these hashes. Columns of ``docs`` named like results are replaced, all others stay as they are. An
    empty table gives no rows.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("clean_text", "n_chunks", "removed")]).alias("row"))
    key = F.xxhash64("row.text")
    marks, used = repeated_units(rows.select("row.doc_id", key.alias("row_key"), "row.text"))
    marks = marks.withColumnsRenamed({"doc_id": "id", "row_key": "key"})
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (key == F.col("key"))
    done = written(_cleaned(rows.join(marks, same, "left")), "line-dedup")
    discard(*used)
    differ = (
        done.select(F.explode("bodies").alias("b"))
        .groupBy("b.k1", "b.k2")
        .agg(F.min("b.body").alias("low"), F.max("b.body").alias("high"))
        .where("low <> high")
        .select("k1", "k2")
    )
    differ = written(differ, "unit-differ")
    if not differ.isEmpty():
        done = _without(done, differ)
    done = done.select("row", F.coalesce("clean", "row.text").alias("clean_text"), "n_chunks", "removed")
    return done.select("row.*", "clean_text", "n_chunks", "removed")


def _without(done: DataFrame, differ: DataFrame) -> DataFrame:
    """The result with units put back whose hashes stand for different bytes."""
    key = F.xxhash64("row.text")
    back = (
        done.select("row.doc_id", key.alias("row_key"), F.explode("marks").alias("m"))
        .select("doc_id", "row_key", "m.k1", "m.k2")
        .join(differ, ["k1", "k2"], "left_semi")
        .groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
        .agg(F.collect_set(F.struct("k1", "k2")).alias("back"))
    )
    out = done.select("row", "marks").join(back, F.col("row.doc_id").eqNullSafe(F.col("id")) & (key == F.col("key")), "left")
    good = F.filter("marks", lambda m: ~F.coalesce(F.array_contains("back", F.struct(m["k1"].alias("k1"), m["k2"].alias("k2"))), F.lit(False)))
    return _cleaned(out.withColumn("marks", good))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_chunks").cast("long"), F.size("removed").cast("long").alias("n_removed"), F.col("clean_text").alias("text"))
