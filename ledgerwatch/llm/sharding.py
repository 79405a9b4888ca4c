"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone; no ring table exists, and with one more shard a key either stays or moves into the new
shard (a share of 1/(n+1) moves). Slots number a shard's rows without a gap: rows are dealt by a hash into buckets of bounded size, only bucket
counts are summed up, and rows are numbered within their bucket, so no shard, however large, is sorted in one task.

Rows that equal one another in key, size and checksum are counted before they are numbered, so however often one repeats it takes one place in its bucket; they get slots that follow one another. The key alone decides
the shard: equal texts of different keys may lie in different shards.

A null key is a key of its own. A null text has size 1 (no bytes, plus 1) and the checksum of no bytes. Texts of any length are measured where they lie. Ties don't matter: rows that equal one another
are the same. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_of, fits_broadcast

#: Rows in a bucket of slots, about.
BUCKET_ROWS = 20_000
#: Fixed values of the published algorithm.
JUMP_MULTIPLIER = np.uint64(2862933555777941757)
NULL_KEY = -(1 << 63)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys, all at once; one turn for each jump that some key still makes."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    while len(going):
        at[going] = ahead[going]
        key[going] = key[going] * JUMP_MULTIPLIER + np.uint64(1)
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def shard_of(key, shards: int):
    """Column of shards for a column of long keys."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return run(F.coalesce(key, F.lit(NULL_KEY)))


def shards(df: DataFrame, count: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (with one more shard) of every row."""
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    rows = df.select(key, (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    buckets = max(1, df.select(key).count() // (count * BUCKET_ROWS) + 1)
    same = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("n"))
    same = same.withColumns({"shard": shard_of(F.col(key), count), "grown_shard": shard_of(F.col(key), count + 1)})
    # one key may repeat without bound, so what tells rows apart deals them
    same = same.withColumn("bucket", F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(buckets)))
    return numbered(same, key, buckets).select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def numbered(same: DataFrame, key: str, buckets: int) -> DataFrame:
    """Each of the ``n`` rows that a row stands for, with its ``slot``."""
    counted = same.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(key, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(fits_broadcast(starts, 32 * buckets), ["shard", "bucket"])
    return each_of(placed, "n", "i").withColumn("slot", F.col("start") + F.col("ahead") + F.col("i"))
