"""Operator 3: shards by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: no ring table is kept, and a further
shard takes rows from the others but moves none between them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_text, let, prefix_sums, read

#: Production parameters. Slots are dealt in blocks of keys, so no shard is gathered in one task.
SHARDS = 16
SLOT_BLOCKS = 4096

#: Fixed values of the published jump hash: the multiplier of its linear congruential generator, in limbs of
#: 16 bits from the lowest (the number is 2862933555777941757), and 2^31.
MULTIPLIER = (0xB0FD, 0x87B0, 0x2EE6, 0x27BB)
HALF = 2147483648.0


def _next(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2^64, in limbs of 16 bits, so that no product overflows a long."""
    mask = F.lit(0xFFFF).cast("long")
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(mask) for i in range(4)]
    m = [F.lit(x).cast("long") for x in MULTIPLIER]
    parts: list[Column] = []
    carry = F.lit(1).cast("long")
    for i in range(4):
        whole = carry
        for j in range(i + 1):
            whole = whole + k[j] * m[i - j]
        parts.append(whole.bitwiseAND(mask))
        carry = F.shiftrightunsigned(whole, 16)
    out = parts[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(parts[i], 16 * i))
    return out


def jump_shards(key: Column, sizes: list[int]) -> Column:
    """A struct ``s<n>`` for each number of shards n: the jump hash of a long key.

    All come from one walk, as the walk for n shards is the part of the longest that stays below n.
    """
    state = F.struct(
        key.alias("key"),
        F.lit(0).cast("long").alias("j"),
        *[F.lit(0).cast("long").alias(f"s{n}") for n in sizes],
    )
    top = max(sizes)

    def step(a: Column, _: Column) -> Column:
        going = a["j"] < top
        after = _next(a["key"])
        width = (F.shiftrightunsigned(after, 33) + 1).cast("double")
        jumped = F.floor((a["j"] + 1).cast("double") * (F.lit(HALF) / width)).cast("long")
        return F.struct(
            F.when(going, after).otherwise(a["key"]).alias("key"),
            F.when(going, jumped).otherwise(a["j"]).alias("j"),
            *[F.when(a["j"] < n, a["j"]).otherwise(a[f"s{n}"]).alias(f"s{n}") for n in sizes],
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), state, step)


def jump_sharding(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, blocks: int = SLOT_BLOCKS) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (gapless from 0 within the shard) and ``grown_shard`` (one shard more).

    A null key counts as 0. Rows of one key share a shard; rows alike in every way get slots in any order, which
    cannot be told apart. Slots follow (key modulo ``blocks``, key, remaining columns): numbers within a block come
    from a window over shard and block, and the block's start from the counts of the blocks before it. Columns
    of ``docs`` named like a result are replaced, all others stay as they are. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    own = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct(*kept).alias("row"), jump_shards(own, [shards, shards + 1]).alias("walk"), F.pmod(own, F.lit(blocks)).cast("int").alias("block"))
    rows = rows.select("row", "block", F.col(f"walk.s{shards}").cast("int").alias("shard"), F.col(f"walk.s{shards + 1}").cast("int").alias("grown_shard"))
    starts = (
        rows.groupBy("shard", "block")
        .count()
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("block", "count"))).alias("b"))  # at most `blocks` entries
        .select("shard", F.explode(_running(F.col("b"))).alias("x"))
        .select("shard", "x.block", "x.start")
    )
    order = Window.partitionBy("shard", "block").orderBy(*[F.col("row")[c].asc_nulls_first() for c in [key, *[c for c in kept if c != key]]])
    numbered = rows.withColumn("n", F.row_number().over(order) - 1)
    # `starts` has at most shards * blocks rows, so it may be broadcast.
    return numbered.join(F.broadcast(starts), ["shard", "block"]).select("row.*", "shard", (F.col("start") + F.col("n")).alias("slot"), "grown_shard")


def _running(entries: Column) -> Column:
    """Entries (block, count) in order -> (block, start), with the sum of the counts before each."""
    return let(
        prefix_sums(F.transform(entries, lambda e: e["count"])),
        lambda before: F.zip_with(entries, before, lambda e, s: F.struct(e["block"].alias("block"), s.alias("start"))),
    )


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
    )
    out = jump_sharding(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: Table of the CRC-32 of single bytes, and a text's CRC-32, as DuckDB expressions.
CRC_TABLE = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i)))"""

OP3_SQL = f"""
WITH RECURSIVE tab AS (SELECT {CRC_TABLE} AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::INT])), 4294967295)::BIGINT AS text_crc32 FROM d, tab),
walk(k, key, j, s16, s17, n) AS (
  SELECT DISTINCT coalesce(doc_id, 0), coalesce(doc_id, 0)::UHUGEINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM documents
  UNION ALL
  SELECT k, after, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((after // 8589934592) + 1)::DOUBLE))::BIGINT,
    CASE WHEN j < 16 THEN j ELSE s16 END, CASE WHEN j < 17 THEN j ELSE s17 END, n + 1
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS after FROM walk) WHERE j < 17),
shards AS (SELECT k, arg_max(s16, n) AS shard, arg_max(s17, n) AS grown_shard FROM walk GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY coalesce(doc_id, 0) % 4096, doc_id, size, text_crc32) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM c JOIN shards ON k = coalesce(doc_id, 0)
"""
