"""Sharding: jump consistent hashing of stable keys.

A key's shard follows from the key and the number of shards alone, without a ring table; with one more shard, about one
row in (shards + 1) moves, and only into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import saved, without

#: The multiplier of the 64-bit linear congruential generator that Lamping and Veach (2014) published with the method.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key; all keys still jumping advance together."""
    state, at, to = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    while len(left):
        at[left] = to[left]
        with np.errstate(over="ignore"):
            state[left] = state[left] * STEP + np.uint64(1)
        span = (state[left] >> np.uint64(33)).astype(np.float64) + 1.0
        to[left] = ((at[left] + 1) * (float(1 << 31) / span)).astype(np.int64)
        left = left[to[left] < shards]
    return at.astype(np.int32)


def _shards(shards: int):
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards))

    return of


def shard(docs: DataFrame, keys: list[str], shards: int = 40, order: list[str] | None = None, chunks: int = 1024) -> DataFrame:
    """All rows of docs with shard, slot (0, 1, 2, ... within the shard) and grown_shard (the shard if there were one more).

    Rows with equal keys share a shard, null keys too. Slots follow a hash of `keys` and `order`, then these columns; rows
    equal in all of them are interchangeable. Input columns named like a result are replaced; an empty table gives an empty result.

    No shard is numbered in one task: each is cut by that hash into `chunks` windows, and the windows' offsets come from a
    count table of shards x chunks rows at most, which is what is broadcast. A key with a third of all rows (the null key, say)
    is dealt over the windows too, by its rows' `order`.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    plain = without(docs, ["shard", "slot", "grown_shard"])
    told = list(dict.fromkeys([*keys, *(order or [])]))

    def placed(frame: DataFrame) -> DataFrame:
        hashed = frame.withColumn("_cq_key", F.xxhash64(*keys)).withColumn("_cq_row", F.xxhash64(*told))
        return hashed.withColumn("shard", _shards(shards)("_cq_key")).withColumn("_cq_chunk", F.pmod(F.shiftright("_cq_row", 7), F.lit(chunks)).cast("int"))

    counts = placed(plain.select(*told)).groupBy("shard", "_cq_chunk").agg(F.count(F.lit(1)).alias("_cq_rows"))
    running = W.partitionBy("shard").orderBy("_cq_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_cq_chunk", F.coalesce(F.sum("_cq_rows").over(running), F.lit(0)).alias("_cq_start"))
    within = F.row_number().over(W.partitionBy("shard", "_cq_chunk").orderBy("_cq_row", *told))
    numbered = placed(plain).withColumn("grown_shard", _shards(shards + 1)("_cq_key")).withColumn("_cq_at", within).join(F.broadcast(starts), ["shard", "_cq_chunk"])
    return numbered.withColumn("slot", F.col("_cq_start") + F.col("_cq_at") - 1).select(*plain.columns, "shard", "slot", "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Three numbers a row are kept, so the texts are read once for counting and numbering.
    return shard(saved(docs), ["doc_id"], 40, ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
