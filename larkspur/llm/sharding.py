"""Sharding by jump consistent hashing (Lamping and Veach 2014): no ring table, least movement when shards are appended."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, ship, small_side, table

ship(__name__)

SHARDS = 8
#: Sub-buckets of a shard, at least, within which rows are numbered, and rows of one on average at most; their sizes are then summed up.
BUCKETS, BUCKET_ROWS = 256, 500_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each unsigned 64-bit key."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a non-null bigint column."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def stable_key(docs: DataFrame) -> Column:
    """doc_id; a row without one is keyed by its text, so that such rows do not all share a shard."""
    return F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))


def assign_shards(docs: DataFrame, shards: int = SHARDS, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (law ``key``).

    Slots number the rows of a shard from 0 without gaps. Null text has size 1 and the crc of the empty text; a null
    doc_id is keyed by the text; repeated rows get the same shard and a slot each; an empty table gives no rows.
    Equal rows are counted first and numbered together, so a row repeated any number of times is one row to the sort.
    """
    buckets = buckets or max(BUCKETS, -(-docs.count() // (shards * BUCKET_ROWS)))
    rows = docs.select(
        "doc_id", stable_key(docs).alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ).groupBy("doc_id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))  # shards * buckets rows at most, one for BUCKET_ROWS
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(small_side(materialize(starts)), ["shard", "bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int | None = None) -> None:
    """Write ``docs`` under ``path`` as one folder ``shard=K`` for each shard: without ``files`` each by all tasks, so that no
    text is shuffled; with it by ``files`` tasks for each shard, after one shuffle."""
    rows = docs.withColumn("shard", shard_of(stable_key(docs), shards))
    if files:
        rows = rows.repartition(shards * files, "shard", F.pmod(F.xxhash64(F.lit(19), "doc_id", "text"), F.lit(files)))
    rows.write.partitionBy("shard").parquet(path)


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
