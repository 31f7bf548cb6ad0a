"""Shards by jump consistent hashing (operator 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_name, ship

# The multiplier of the published algorithm's 64-bit generator.
STEP = np.uint64(2862933555777941757)
BIN_DIGITS = 3  # of a hash, in base 16, that tell the bins of a shard apart


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; needs no table, and one more shard takes keys only into itself."""
    key = keys.astype(np.uint64, copy=True)
    out = np.zeros(len(key), np.int64)
    at = np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(left):
            out[left] = at[left]
            key[left] = key[left] * STEP + np.uint64(1)
            ahead = (out[left] + 1) * (float(1 << 31) / ((key[left] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
            at[left] = ahead.astype(np.int64)
            left = left[at[left] < shards]
    return out


def with_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """df with the shard, from 0, of a key column; a column of that name gives way.

    Whole numbers are keys as they are; other types are hashed to 64 bits
    first. Null keys are one key, 0. Equal keys get equal shards.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    ship(df.sparkSession)

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    own = F.col(f"`{key}`").cast("long") if whole else F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.col(f"`{key}`")))
    return df.withColumn(out, shard(F.coalesce(own, F.lit(0).cast("long"))))


def with_slot(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """df with each row's place in its shard: 0, 1, 2, ... without gaps; a column of that name gives way.

    No shard is sorted as a whole: its rows are dealt over 16**BIN_DIGITS bins
    by a hash of the order columns, the bins' sizes are summed up to each bin's
    first place, and rows are numbered inside their bins, nulls first. Equal
    rows are interchangeable.
    """
    b, first, n = (own_name(df, x) for x in ("_bin", "_first", "_n"))
    columns = [F.col(f"`{c}`") for c in order]
    dealt = df.withColumn(b, F.left(F.md5(F.concat_ws("|", *columns)), F.lit(BIN_DIGITS)))
    sizes = dealt.groupBy(shard, b).agg(F.count("*").alias(n))
    up_to = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(shard, b, F.coalesce(F.sum(n).over(up_to), F.lit(0)).alias(first))
    inside = F.row_number().over(Window.partitionBy(shard, b).orderBy(*columns))
    return dealt.withColumn(out, inside.cast("long") - 1).join(sizes, [shard, b]).withColumn(out, F.col(out) + F.col(first)).drop(b, first)


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    size is the text's UTF-8 bytes plus 16, 16 for a null text, whose crc is
    that of an empty one. Rows with equal ids share a shard; null ids share the
    shard of the key 0. grown_shard is the shard with one shard more. Repeated
    rows each have a slot; an empty table gives no rows. Further columns, of
    whatever name, are not used.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_slot(with_shard(rows, "doc_id", shards), "shard", ["doc_id", "size", "text_crc32"])
    return with_shard(placed, "doc_id", shards + 1, "grown_shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
