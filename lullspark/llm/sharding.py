"""Sharding by jump consistent hashing.

A stable 64-bit key jumps from shard to shard (Lamping and Veach, 2014); the last
jump below the number of shards names its shard. There is no ring table, and a
shard more takes just its share of rows, all of them into itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import numbered, row_text

# The multiplier of the published generator; a fixed value.
STEP = np.uint64(2862933555777941757)
CHUNKS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key; all keys jump together, about ln(shards) times."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(active):
            state[active] = state[active] * STEP + np.uint64(1)
            spread = (1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1)
            landed = ((shard[active] + 1) * spread).astype(np.int64)
            active = active[landed < shards]
            shard[active] = landed[landed < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard from 0 to ``shards - 1`` of a stable key of any type; null is a key like any other."""
    if shards < 1:
        raise ValueError(f"no shards: {shards}")

    @F.pandas_udf("int")
    def jump(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = 8, chunks: int = CHUNKS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is `key`: only ``doc_id`` and the number of shards decide, so equal ids
    share a shard. ``slot`` numbers the rows of a shard from 0 without a gap, ranked
    in chunks so that no shard passes through one task. A null text is empty (size
    1, checksum 0); a null id is a key of its own; equal rows get a slot each. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        "doc_id",
        (F.octet_length(row_text()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(row_text(), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    ).withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(chunks)))
    order = ["doc_id", "text_crc32", "size"]
    placed = numbered(rows, ["shard"], "_chunk", order, "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The rows with a column ``shard`` (replacing one of that name), without a shuffle."""
    return docs.withColumn("shard", shard_of(F.col("doc_id"), shards))
