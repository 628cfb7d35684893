"""Sharding by jump consistent hashing.

A row's shard follows from its stable key and the number of shards alone, without a table of a ring. When a
shard is appended, rows move only into it, about one in (n + 1). Laws: `key`; sizes and counts of shards are
near equal only as far as the hash deals keys evenly.

Defined results: a null text has no bytes and the CRC-32 of an empty string; a null key is a key like any
other; rows that repeat a key share its shard and have slots of their own; rows that tie in everything may stand in
either one's slot. Of a very long text only its size and checksum are taken. An empty table gives an empty result.
Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.numbering import gapless
from lodestone.session import cut_lineage, table

SHARDS = 40
ROW_BYTES = 16

_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, for a whole column at once.

    Each key walks through the ever rarer shard counts at which it would move; the last one below `shards`
    is its shard. The walks end after about ln(shards) steps.
    """
    state = keys.astype(np.uint64, copy=True)
    shard, ahead = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = ahead[moving]
            state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
            ahead[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return shard


def _shard_of(shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def jump_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", *, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only ids, sizes and checksums are shuffled; texts stay where they are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(key_col).alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.xxhash64("doc_id")
    rows = cut_lineage(rows.withColumn("shard", _shard_of(shards)(key)).withColumn("grown_shard", _shard_of(shards + 1)(key)))
    return gapless(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", rows.count()).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jump_shards": op7_jump_shards}
ORACLE: dict[str, str] = {}
