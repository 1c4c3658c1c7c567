"""Sharding by weighted rendezvous hashing: every record key draws a number for each shard, the highest one wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropledger.llm.common import text_of
from cropledger.session import materialize

SHARDS = 24
#: Records that one task numbers at a time, about.
NUMBERED_ROWS = 2_000
#: Equal records that one task writes at a time.
EQUAL_ROWS = 10_000


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The key's draw for a shard: -weight / ln(u), with u in (0, 1) hashed from key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.lit(float(-weight)) / F.log((bits + F.lit(0.5)) / F.lit(float(2**53)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard of 0..len(weights)-1. A shard more, or a larger weight, only takes keys over to that shard."""
    return F.array_max(F.array(*[F.struct(draw(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0])).getField("shard")


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """All rows and columns, and `shard` (a column of that name is replaced). A null key counts as ''. No shuffle."""
    return df.withColumn("shard", rendezvous(F.coalesce(F.col(key).cast("string"), F.lit("")), list(weights)))


def op9_sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and gapless slot of every record, by the law `key`: record key and shard count alone decide.

    Records alike in all returned columns are numbered as one counted record and written out again in bounded blocks, so a
    record repeated without end lands in no single task. Null text: size 8 and CRC 0. A null doc_id is a key of its own.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # Best draw among the shards, and whether one more shard would beat it.
    best = F.array_max(F.array(*[F.struct(draw(key, s).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]))
    rows = docs.select("doc_id", F.octet_length(text_of()).cast("bigint").alias("octets"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
                       best.alias("best"), draw(key, shards).alias("more"))
    rows = rows.select("doc_id", (F.col("octets") + 8).alias("size"), "text_crc32", F.col("best.shard").alias("shard"),
                       F.when(F.col("more") > F.col("best.draw"), F.lit(shards)).otherwise(F.col("best.shard")).alias("grown_shard"))
    alike = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "shards")
    parts = max(1, -(-alike.count() // (shards * NUMBERED_ROWS)))
    alike = alike.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    sums = alike.groupBy("shard", "part").agg(F.sum("n").alias("n_part"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("shard", "part", F.coalesce(F.sum("n_part").over(w), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(first, ["shard", "part"])
    blocks = numbered.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("bigint"))))
    blocks = blocks.repartition("shard", "part", "doc_id", "block")
    out = blocks.withColumn("k", F.explode(F.sequence("block", F.least(F.col("block") + EQUAL_ROWS, F.col("n")) - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      (F.col("first") + F.col("before") + F.col("k")).alias("slot"), "grown_shard")
