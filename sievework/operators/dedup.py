"""Exact and near duplicates by hashes, and what they say about labels, splits and sources."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.scores import bands, hamming, probes
from sievework.operators.manifest import numbered

# The largest distances of strong pairs and of pairs to be reviewed.
STRONG, REVIEW = 6, 10
SIGNED_AT_ONCE = 256  # rows whose words' bits are unpacked together


def exact_groups(df: DataFrame, hash_col: str, order: str) -> DataFrame:
    """Rows whose hash occurs more than once, with group numbers in the order of each group's first row."""
    rows = df.where(F.col(hash_col).isNotNull())
    groups = rows.groupBy(hash_col).agg(F.count("*").alias("group_size"), F.min(order).alias("first")).where("group_size > 1")
    # Numbers need one order over all groups: their first rows are ranked, not the rows of the corpus.
    ranked = numbered(groups, ["first", hash_col], "duplicate_group")
    return rows.join(ranked.select(hash_col, "group_size", "duplicate_group"), hash_col)


# Words of lower-cased texts: ASCII letters, digits and underscores.
WORD = re.compile("[0-9a-z_]+")
# Of each byte its eight bits, the highest first, as eight bytes.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def bit_counts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each group of rows of 8 bytes; no group is empty."""
    parts = -(-sizes // 255)  # what eight counters of a byte each can hold
    before = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(before, parts))
    few = np.add.reduceat(_BITS[data], starts, axis=0).view(np.uint8)
    return np.add.reduceat(few.astype(np.int64), before, axis=0)


def simhash(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, signature), and more columns if asked for: 64-bit SimHash over distinct words, each with the first 64 bits of its md5; texts without words have none.

    Each row has its own signature, also where rows share a key. Words are
    found, hashed and counted in the scan's own task, some rows at a time, and
    only texts go there: nothing is shuffled.
    """
    kept = [key, *more]
    rows = df.select(*kept, F.lower(text).alias("_text"))

    def sign(batches):
        known: dict[str, bytes] = {}
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a in range(0, len(texts), SIGNED_AT_ONCE):
                sets = [set(WORD.findall(t)) if t else () for t in texts[a : a + SIGNED_AT_ONCE]]
                if len(known) > 500_000:
                    known.clear()
                for w in set().union(*sets).difference(known):
                    known[w] = hashlib.md5(w.encode()).digest()[:8]
                there = np.flatnonzero([len(x) > 0 for x in sets])
                if not len(there):
                    continue
                n = np.array([len(sets[k]) for k in there])
                data = np.frombuffer(b"".join([known[w] for k in there for w in sets[k]]), np.uint8).reshape(-1, 8)
                signatures = np.packbits(2 * bit_counts(data, n) > n[:, None], axis=1).view(">i8").ravel().astype(np.int64)
                own = batch.slice(a, len(sets)).take(pa.array(there))
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in kept], pa.array(signatures)], names=[*kept, "signature"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(sign, f"{kinds}signature long")


def near_pairs(signed: DataFrame, key: str, most: int = REVIEW, *more: str) -> DataFrame:
    """(a, b, distance, n_a, n_b), and signature_a, signature_b if asked for, of pairs of different signatures that share one of four 16-bit bands.

    Rows with one signature are collapsed to the one with the smallest key;
    n_a and n_b say how many they are, so the join never pairs copies.
    """
    reps = signed.where("signature is not null").groupBy("signature").agg(F.min(key).alias("rep"), F.count("*").alias("n"))
    blocked = reps.select("rep", "n", "signature", F.posexplode(bands(F.col("signature"))).alias("band", "value"))
    a, b = blocked.alias("a"), blocked.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.rep") < F.col("b.rep"))
    distance = hamming(F.col("a.signature"), F.col("b.signature"))
    pairs = a.join(b, same).where(distance <= most)
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), distance.alias("distance"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.col("a.signature").alias("signature_a"), F.col("b.signature").alias("signature_b")).distinct().select("a", "b", "distance", "n_a", "n_b", *more)


def near_pairs_exact(signed: DataFrame, key: str, most: int = REVIEW) -> DataFrame:
    """(a, b, distance, n_a, n_b) of all pairs of different signatures at most `most` bits apart.

    If no band of 16 bits were within its own radius, the signatures would be
    further apart than `most`: the radii, plus one each, add up to most + 1.
    So one side of a pair asks for every value within the radius of its
    bands, the other is found by its bands as they are, and the first band
    that is within its radius reports the pair: nothing is made distinct. A
    bucket is one value of one band of different signatures, whose mean size
    is their number over 65,536; a hot one is split by Spark's skew join.

    The asking side has some 428 rows for each signature at 10 bits, of which
    Spark's estimate of its size knows nothing. Left to itself, it sends that
    side to the driver as a small table; so the found side, of four rows for
    each signature, is what the tasks hold, and both are dealt out. Signatures
    are few bytes, which Spark would leave to one task; so those that ask are
    dealt to four tasks a core before they become many rows.
    """
    least = (most + 1) // 4
    radii = [least + (k < (most + 1) % 4) - 1 for k in range(4)]
    reps = signed.where("signature is not null").groupBy("signature").agg(F.min(key).alias("rep"), F.count("*").alias("n"))
    own = F.posexplode(F.transform(bands(F.col("signature")), lambda x, k: x + k * 65536))
    b = reps.select("rep", "n", "signature", own.alias("band", "value"))
    a = reps.repartition(4 * signed.sparkSession.sparkContext.defaultParallelism).select("rep", "n", "signature", own.alias("band", "value"))
    masks = F.array(*[F.array(*map(F.lit, probes(r) if r >= 0 else [])).cast("array<bigint>") for r in radii])
    a = a.select("rep", "n", "signature", "band", "value", F.explode(masks[F.col("band")]).alias("mask"))
    a = a.select("rep", "n", "signature", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value")).alias("a")
    b = b.drop("band").hint("shuffle_hash").alias("b")
    differ = F.col("a.signature").bitwiseXOR(F.col("b.signature"))
    by_band = bands(differ)
    earlier = [(F.col("a.band") > k) & (F.bit_count(by_band[k]) <= r) for k, r in enumerate(radii[:-1])]
    same = (F.col("a.value") == F.col("b.value")) & (F.col("a.rep") < F.col("b.rep")) & (F.bit_count(differ) <= most)
    for x in earlier:
        same &= ~x
    return a.join(b, same).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.bit_count(differ).alias("distance"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def pairs_across(pairs: DataFrame, signed: DataFrame, source: str) -> DataFrame:
    """pairs with n_across: how many of the n_a * n_b pairs of rows are of two sources; `signed` has each row's signature and source.

    Rows of one source are counted by signature, so copies are never paired.
    """
    by_source = signed.where("signature is not null").groupBy("signature", source).agg(F.count("*").alias("k"))
    a = by_source.select(F.col("signature").alias("signature_a"), F.col(source).alias("s"), F.col("k").alias("k_a"))
    b = by_source.select(F.col("signature").alias("signature_b"), F.col(source).alias("t"), F.col("k").alias("k_b"))
    same = pairs.join(a, "signature_a").join(b, "signature_b").where(F.col("s").eqNullSafe(F.col("t")))
    within = same.groupBy("a", "b").agg(F.sum(F.col("k_a") * F.col("k_b")).alias("within"))
    return pairs.join(within, ["a", "b"], "left").withColumn("n_across", F.col("n_a") * F.col("n_b") - F.coalesce("within", F.lit(0))).drop("within")


def group_audit(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """For each group of more than one row: size and the sorted distinct non-blank values of each column."""
    sets = [F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}s") for c in columns]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *sets).where("n > 1")


def leaks(splits: Column) -> Column:
    """Does a set of splits hold train and an evaluation split?"""
    return F.array_contains(splits, "train") & (F.array_contains(splits, "test") | F.array_contains(splits, "validation") | F.array_contains(splits, "val"))


def star_edges(df: DataFrame, group: str, key: str) -> DataFrame:
    """(src, dst) from the first member of each group to the others."""
    first = F.min(key).over(Window.partitionBy(group))
    return df.select(first.alias("src"), F.col(key).alias("dst")).where("src != dst")
