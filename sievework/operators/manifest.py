"""Rows of a manifest: filters, lookups of groups and records, orders, the group report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.storage import written


def with_status(df: DataFrame, status: str, keep: bool = True, column: str = "status") -> DataFrame:
    """Rows of a status, or all others."""
    return df.where(F.col(column) == status if keep else F.col(column) != status)


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows without a null in the required columns."""
    return df.dropna(subset=required)


def of_split(df: DataFrame, split: str, folded: bool = False, column: str = "split") -> DataFrame:
    """Rows of a split, by its exact name or in any case."""
    return df.where((F.lower(F.trim(column)) if folded else F.col(column)) == (split.lower() if folded else split))


def size_gate(width: Column, height: Column, least: int = 64) -> Column:
    """(status, message): small images get a warning, and go on."""
    small = (width < least) | (height < least)
    return F.struct(F.when(small, "WARNING").otherwise("OK").alias("status"), F.when(small, "Image resolution is very small.").otherwise("Image is readable.").alias("message"))


def normal_pairs(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns by their usual names: each the first non-null of those of its other names that df has, null if it has none."""
    there = {c.lower(): c for c in df.columns}
    picked = []
    for name, others in names.items():
        own = [F.col(f"`{there[o.lower()]}`") for o in [name, *others] if o.lower() in there]
        picked.append((F.coalesce(*own) if own else F.lit(None).cast("string")).alias(name))
    return df.select(*picked)


def with_groups(df: DataFrame, key: str, groups: dict[str, DataFrame]) -> DataFrame:
    """df with a column for each relation (key, group): the row's group as text, "" where it has none."""
    for name, g in groups.items():
        g = g.select(F.col(g.columns[0]).alias(key), F.col(g.columns[1]).cast("string").alias(name))
        df = df.join(g, key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return df


def edges_among(edges: DataFrame, df: DataFrame, key: str, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Edges both of whose ends are keys of df."""
    for end in ends:
        edges = edges.join(df.select(F.col(key).alias(end)), end, "left_semi")
    return edges


def pair_records(pairs: DataFrame, df: DataFrame, key: str, columns: list[str], ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """pairs with the columns of both ends' records, as {column}_{end}."""
    for end in ends:
        pairs = pairs.join(df.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def group_report(df: DataFrame, group: str, split: str, dataset: str, label: str, exact: Column, near: Column) -> DataFrame:
    """Of each group: its size, its first split, its datasets and classes in order, and whether it has exact or near duplicates."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return df.groupBy(group).agg(
        F.count("*").alias("image_count"), F.min(split).alias("split"), joined(dataset).alias("datasets"), joined(label).alias("unified_classes"), F.bool_or(exact).alias("has_exact_duplicate"), F.bool_or(near).alias("has_near_duplicate")
    )


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with each row's number, from 1, in one order over all rows.

    Rows are dealt out by ranges of the order and written; the ranges' sizes
    give each its first number, and rows are numbered inside their range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(first, "_range").withColumn(out, F.col("_first") + F.col("_inside")).drop("_range", "_first", "_inside")


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in an order that has no ties."""
    return df.orderBy(*order).limit(n)


def rows_between(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """The rows from place `first` to place `last`, from 1, of an order over all rows, with their `place`."""
    return numbered(df, order, "place").where(F.col("place").between(first, last))


def first_of_groups(df: DataFrame, group: str, values: list[str], order: str) -> DataFrame:
    """(group, values): what the first row of each group has, null or not; rows are never gathered."""
    first = F.min_by(F.struct(*values), F.col(order)).alias("v")
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(first).select(group, "v.*")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys are those of another row, too; nulls are equal. Keys are counted, so a frequent one stays spread."""
    often = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(often, same, "left_semi")
