"""Structured Streaming over the run log, each job with a batch twin that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event time is the row's own time; rows later than this are left to the batch twin.
WATERMARK = "10 minutes"


def log_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """The log as a stream of files; ``ts`` becomes a TIMESTAMP, which a watermark needs."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def signal_counts(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(event_type, start, n) per tumbling window; the same expression serves stream and batch.

    As a stream it runs in update mode: the watermark ends a window's state, and ``latest`` reads the last count of each.
    """
    source = log.withWatermark("ts", WATERMARK) if log.isStreaming else log
    return source.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", rocksdb: bool = False) -> list[dict]:
    """Runs a stream over what is there and stops; gives the state operators' last progress.

    In update mode each trigger adds its rows with its number, ``trigger``. Processors with timers need ``rocksdb``.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    if rocksdb:
        spark.conf.set(STORE, ROCKSDB)
    try:
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
        if mode == "update":
            # A trigger that runs again replaces what it wrote before.
            query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/trigger={n}")).start()
        else:
            query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
    finally:
        if rocksdb:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return [dict(o) for o in (query.lastProgress or {}).get("stateOperators", [])]


def latest(spark: SparkSession, out: str, schema, keys: list[str], value: str) -> DataFrame:
    """What a stream in update mode has come to: of each key the value of its last trigger."""
    rows = spark.read.schema(schema).parquet(out + "/*").withColumn("_at", F.regexp_extract(F.input_file_name(), r"trigger=(\d+)", 1).cast("long"))
    return rows.groupBy(*keys).agg(F.max_by(value, "_at").alias(value))
