"""Mapping source classes to one taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["dataset", "original_class", "unified_parent", "unified_class", "training_role", "safety_level", "disposal_group", "mapping_confidence", "mapping_reason"]


def mapping_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows with values for all COLUMNS, or for the first ones."""
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS[: len(rows[0])]))


def _keys(df: DataFrame, taxonomy: DataFrame):
    # The mapping is a short fixed list, so Catalyst broadcasts it by its size.
    numbered = taxonomy.withColumn("n", F.monotonically_increasing_id())
    last = numbered.groupBy(F.lower(F.trim("dataset")).alias("k1"), F.lower(F.trim("original_class")).alias("k2")).agg(F.max_by(F.struct(*[c for c in taxonomy.columns if c in COLUMNS[2:]]), "n").alias("m"))
    return df.withColumns({"k1": F.lower(F.trim("dataset")), "k2": F.lower(F.trim("original_class"))}), last


def map_classes(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Inner lookup on (dataset, class), trimmed and in any case; of mappings with one key the last counts."""
    rows, last = _keys(df, taxonomy)
    return rows.join(last, ["k1", "k2"]).select(*df.columns, "m.*")


def unmapped(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    rows, last = _keys(df, taxonomy)
    return rows.join(last, ["k1", "k2"], "left_anti").select(*df.columns)


def map_all(df: DataFrame, taxonomy: DataFrame, named: int = 20) -> DataFrame:
    """map_classes, or a ValueError that names the first classes without a mapping."""
    left = unmapped(df, taxonomy).select("dataset", "original_class").distinct().orderBy("dataset", "original_class").limit(named).collect()
    if left:
        raise ValueError("unmapped classes: " + ", ".join(f"{d}/{c}" for d, c in left))
    return map_classes(df, taxonomy)


def rollup(mapped: DataFrame, n: str = "source_count") -> DataFrame:
    return mapped.groupBy("unified_parent", "unified_class").agg(F.sum(n).cast("long").alias("n")).orderBy(F.desc("n"), "unified_parent", "unified_class")
