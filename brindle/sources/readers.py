"""Readers and writers: uploads, evaluation sets, call logs, the event log, and a web search source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EVENTS = "run_id string, seq int, type string, payload string, created_at timestamp"
CALLS = "type string, call string, pair string, engine string, stage string, shadow boolean, areas array<string>, batch int, wall_ms double, run_id string, error string"


def uploads(spark: SparkSession, path: str, collection: str, most_bytes: int | None = None) -> DataFrame:
    """(collection, name, content) of the files below a path; the size limit is put to the listing, before any is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select(F.lit(collection).alias("collection"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): each file of a folder as one row."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def evaluation_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, question, expect, should_abstain, corpus) of either shape of item: a question, or turns whose last one asks.

    Items of one question count once, the smallest id.
    """
    schema = "id string, question string, turns array<string>, expect string, should_abstain boolean, corpus string"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    items = raw.withColumn("question", F.coalesce("question", F.try_element_at("turns", F.lit(-1)))).where("question is not null").drop("turns")
    first = items.groupBy("question").agg(F.min("id").alias("id"))
    return items.join(first, ["question", "id"], "left_semi").select("id", "question", "expect", "should_abstain", "corpus")


def specs(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(question, fields): specifications of items, by the last of their turns."""
    raw = spark.read.schema(f"turns array<string>, {fields}").json(path)
    return raw.withColumn("question", F.element_at("turns", -1)).drop("turns")


def failover(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The rows of the first source, in the order given, that has any for a key, with ``provider``."""
    out = None
    for n, (name, rows) in enumerate(sources):
        part = rows.withColumns({"provider": F.lit(name), "_n": F.lit(n)})
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(key).agg(F.min("_n").alias("_n"))
    return out.join(first, [key, "_n"], "left_semi").drop("_n")


def call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALLS).json(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, laid out by type and day, so that a query of one type reads only its folders."""
    return spark.read.schema(EVENTS + ", day date").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("type", "day").parquet(path)


def replace_documents(chunks: DataFrame, path: str, key: str = "doc_bucket") -> None:
    """Puts the chunks of the touched buckets in place of what these held; other buckets stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def sse_lines(events: DataFrame) -> DataFrame:
    """(value): each event as the three lines of a server-sent event."""
    return events.select(F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), F.col("type"), F.lit("\ndata: "), F.col("payload"), F.lit("\n")).alias("value"))


class _Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.limit = int(options.get("limit", "5"))
        self.name = options.get("provider", "none")

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        provider = PROVIDERS.get(self.name)
        if provider is None:
            return
        hits = [h for h in provider(partition.text) if h[2]]
        for n, (url, title, content) in enumerate(hits[: self.limit]):
            yield partition.text, n + 1, url, title, content


#: The seam: a provider is a function from a query to (url, title, content) rows. None is built in, as none needs no network.
PROVIDERS: dict = {}


class WebSearch(DataSource):
    """``spark.read.format("web_search")``: one task a query, hits without content left out, at most ``limit`` each."""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return "query string, rank int, url string, title string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)
