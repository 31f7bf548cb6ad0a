"""Profiles of a corpus of several sources: counts, shares, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.select import medians


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def shares(df: DataFrame, keys: list[str], parent: list[str]) -> DataFrame:
    """Counts by keys with their percentage of the parent's rows; an empty parent is the whole."""
    by = counts(df, *keys)
    # The window runs over counted rows, not over the corpus.
    total = F.sum("n").over(Window.partitionBy(*(parent or [F.lit(1)])))
    return by.withColumn("percentage", F.round(100 * F.col("n") / total, 2))


def grouping_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key alone, in one pass."""
    level = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in keys])
    return df.groupingSets([[k] for k in keys], *keys).agg(level.alias("key"), value.alias("value"), F.count("*").alias("n")).select("key", "value", "n")


def numeric_profile(df: DataFrame, key: str, columns: list[str], valid: Column | None = None) -> DataFrame:
    """min, max, mean (2 digits) and exact median of each column; groups without valid rows are left out. Medians are found by selection, so groups may be of any size."""
    aggs, rows = [], df.where(valid) if valid is not None else df
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.round(F.avg(c), 2).alias(f"mean_{c}")]
    own = medians(rows, key, columns).select(F.col(key).alias("_k"), "column_name", "median")
    wide = own.groupBy("_k").agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(f"median_{c}") for c in columns])
    found = rows.groupBy(key).agg(*aggs).join(wide, F.col(key).eqNullSafe(F.col("_k")), "left")
    return found.select(key, *[f"{x}_{c}" for c in columns for x in ("min", "max", "mean", "median")])


def dataset_summary(df: DataFrame, key: str, label: str, valid: Column, small: Column) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("corrupt"), F.count_if(valid & small).alias("small"), F.countDistinct(label).alias("classes")
    )


def top(df: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k most frequent keys, ties in the order of the keys."""
    return counts(df, *keys).orderBy(F.desc("n"), *keys).limit(k)
