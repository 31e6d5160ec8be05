"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words (runs of anything but white space) of a text, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def prefix_sums(values: Column) -> Column:
    """For each element of an array of longs, the sum of those before it.

    Worked out in blocks of about sqrt(n) elements, so a long array costs n^1.5 steps and not n^2.
    """

    def over(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return let(
            width,
            lambda w: let(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - 1), w),
                    lambda s: F.aggregate(F.slice(v, s + 1, w), F.lit(0).cast("long"), lambda a, x: a + x),
                ),
                lambda sums: let(
                    F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, 1, j), F.lit(0).cast("long"), lambda a, x: a + x)),
                    lambda before: F.transform(
                        v,
                        lambda _, i: F.get(before, F.floor(i / w).cast("int"))
                        + F.aggregate(F.slice(v, (i - i % w) + 1, i % w), F.lit(0).cast("long"), lambda a, x: a + x),
                    ),
                ),
            ),
        )

    return let(values, over)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing and Spark runs in this process (tests) a local folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"brindle-{os.getpid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame, written once to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


