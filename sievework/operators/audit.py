"""Integrity of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls) of the required columns."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])))


def surplus_copies(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat the key of another row; nulls are equal."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def group_stats(df: DataFrame, group: str) -> DataFrame:
    """Number of groups, of those with several rows, their rows, and the largest."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("total_groups"), F.count_if(F.col("n") > 1).alias("multi_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_multi"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def cross_split_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows are in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0, values)


def absent_classes(df: DataFrame, label: str, split: str, splits: list[str]) -> DataFrame:
    """(class, split) pairs without rows: each class is looked for in each of the few splits."""
    every = df.select(label).distinct().select(label, F.explode(F.array(*map(F.lit, splits))).alias(split))
    return every.join(df.select(label, F.lower(split).alias(split)).distinct(), [label, split], "left_anti")


def missing_references(df: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Rows whose file isn't among the scanned files."""
    return df.join(files.select(path), path, "left_anti")


def retention(original: DataFrame, curated: DataFrame) -> DataFrame:
    a, b = original.agg(F.count("*").alias("original")), curated.agg(F.count("*").alias("curated"))
    both = a.join(b, F.lit(True))  # one row each
    return both.select("original", "curated", F.greatest(F.lit(0), F.col("original") - F.col("curated")).alias("removed"), F.round(100 * F.try_divide("curated", "original"), 2).alias("retention_percent"))


def integrity_checks(df: DataFrame, key: str, group: str, split: str, label: str, splits: list[str]) -> DataFrame:
    """(check_name, passed, violations), and the row `all` for their conjunction."""

    def one(name: str, violations: DataFrame) -> DataFrame:
        return violations.select(F.lit(name).alias("check_name"), F.coalesce(violations.columns[0], F.lit(0)).cast("long").alias("violations"))

    rows = [
        one("required_columns_not_null", null_counts(df, [key, group, split, label]).agg(F.sum("nulls").alias("n"))),
        one("keys_unique", surplus_copies(df, key)),
        one("groups_in_one_split", cross_split_groups(df, group, split).agg(F.count("*").alias("n"))),
        one("known_splits", df.agg(F.count_if(~F.lower(split).isin(splits)).alias("n"))),
        one("classes_in_all_splits", absent_classes(df, label, split, splits).agg(F.count("*").alias("n"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    total = out.agg(F.lit("all").alias("check_name"), F.sum("violations").alias("violations"))
    return out.unionByName(total).select("check_name", (F.col("violations") == 0).alias("passed"), "violations")


def _figures(manifest: DataFrame, original: DataFrame, files: DataFrame, near_pairs: DataFrame, key: str, group: str, split: str, label: str, near: str, splits: dict[str, str]) -> tuple[DataFrame, dict]:
    """One row with all counts, and {category: {metric: column on it}}."""
    required = {key, group, split, label} <= set(manifest.columns)
    by_split = F.lower(split)
    rows = manifest.agg(
        F.count("*").alias("images"), F.countDistinct(label).alias("classes"), F.countDistinct(key).alias("expected"), F.count_if(F.col(near)).alias("near_images"), F.count_if(F.greatest(*[F.col(x).isNull() for x in (key, group, split, label)])).alias("missing"),
        *[F.count_if(by_split == name).alias(f"n_{s}") for s, name in splits.items()], *[F.countDistinct(F.when(by_split == name, F.col(label))).alias(f"classes_{s}") for s, name in splits.items()],
    )
    sizes = group_sizes(manifest, group, split, label)
    groups = sizes.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("grouped"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(F.col("s") > 1).alias("crossing"), F.count_if(F.col("l") > 1).alias("conflicts"))
    found = manifest.select(key).distinct().join(files.select(key), key, "left_semi").agg(F.count("*").alias("found"))
    one = rows
    for other in (groups, found, original.agg(F.count("*").alias("original")), near_pairs.agg(F.count("*").alias("near_pairs")), surplus_copies(manifest, key)):
        one = one.join(other, F.lit(True))  # one row each
    n = F.col
    checks = {
        "required_columns": F.lit(required), "missing_required_values": n("missing") == 0, "duplicate_paths": n("surplus") == 0, "cross_split_leakage": n("crossing") == 0, "missing_images": n("expected") == n("found"),
        **{f"all_classes_{s}": n(f"classes_{s}") == n("classes") for s in splits},
    }
    overall = F.lit(True)
    for passed in checks.values():
        overall = overall & passed
    return one, {
        "dataset": {"total_images": n("images"), "number_of_classes": n("classes")},
        "split": {s: n(f"n_{s}") for s in splits},
        "leakage": {"total_groups": n("groups"), "groups_multiple_images": n("multi"), "grouped_images": n("grouped"), "cross_split_groups": n("crossing")},
        "duplicates": {"exact_duplicate_images": n("grouped"), "exact_duplicate_groups": n("multi"), "near_duplicate_images": n("near_images"), "near_duplicate_pairs_or_groups": n("near_pairs")},
        "label_conflicts": {"conflicting_groups": n("conflicts")},
        "files": {"images_expected": n("expected"), "images_found": n("found"), "images_missing": n("expected") - n("found")},
        "retention": {"original_manifest_images": n("original"), "curated_images": n("images"), "images_excluded": F.greatest(F.lit(0), n("original") - n("images")), "retention_rate_percent": F.round(100 * F.try_divide(n("images"), n("original")), 2)},
        "validation": {**checks, "overall_integrity": overall, "label_conflicts_warning": n("conflicts") > 0},
    }


def group_sizes(manifest: DataFrame, group: str, split: str, label: str) -> DataFrame:
    """(group, n, s, l): the rows, splits and labels of each group."""
    return manifest.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(split).alias("s"), F.countDistinct(label).alias("l"))


def report(manifest: DataFrame, original: DataFrame, files: DataFrame, near_pairs: DataFrame, key: str, group: str, split: str, label: str, near: str, splits: dict[str, str]) -> DataFrame:
    """(category, metric, value) of the 31 figures and checks of a finished manifest; values are text.

    splits: the report's name of each split -> its name in the manifest. A
    group with several images holds exact duplicates. Label conflicts are a
    warning and no part of the overall check.
    """
    one, figures = _figures(manifest, original, files, near_pairs, key, group, split, label, near, splits)
    cells = [F.struct(F.lit(category).alias("category"), F.lit(metric).alias("metric"), value.cast("string").alias("value")) for category, by in figures.items() for metric, value in by.items()]
    return one.select(F.inline(F.array(*cells)))


def typed_document(manifest: DataFrame, original: DataFrame, files: DataFrame, near_pairs: DataFrame, name: str, key: str, group: str, split: str, label: str, near: str, splits: dict[str, str]) -> DataFrame:
    """One row with the whole audit as typed, nested columns: dataset, splits, class_distribution, leakage, duplicates, label_conflicts, files, retention, validation.

    Counts are whole numbers, checks booleans; class_distribution and
    conflict_distribution are maps in the order of their keys. The names of
    the classes and of the groups in conflict are lists in one row, as the
    document asks for; all else is of a fixed size.
    """
    one, figures = _figures(manifest, original, files, near_pairs, key, group, split, label, near, splits)
    in_order = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).cast("string"), F.col(v)))))
    by_class = manifest.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    classes = by_class.agg(in_order(label, "n").alias("class_distribution"), F.array_sort(F.collect_list(F.col(label))).alias("class_names"))
    conflicts = group_sizes(manifest, group, split, label).where("l > 1")
    names = conflicts.agg(F.array_sort(F.collect_list(F.col(group).cast("string"))).alias("conflict_names"))
    kinds = conflicts.groupBy("l").agg(F.count("*").alias("k")).agg(in_order("l", "k").alias("conflict_kinds"))
    for other in (classes, names, kinds):
        one = one.join(other, F.lit(True))  # one row each
    n, part = F.col, lambda by: F.struct(*[v.alias(k) for k, v in by.items()])
    total = sum((n(f"n_{s}") for s in splits), F.lit(0).cast("long"))
    leakage = {"total_groups": n("groups"), "groups_containing_multiple_images": n("multi"), "images_in_grouped_samples": n("grouped"), "maximum_group_size": n("largest"), "groups_crossing_splits": n("crossing")}
    return one.select(
        part({"name": F.lit(name), **figures["dataset"], "classes": n("class_names")}).alias("dataset"),
        part({**figures["split"], "total": total}).alias("splits"),
        n("class_distribution"),
        part(leakage).alias("leakage"),
        part(figures["duplicates"]).alias("duplicates"),
        part({**figures["label_conflicts"], "conflict_distribution": n("conflict_kinds"), "conflicting_group_names": n("conflict_names")}).alias("label_conflicts"),
        *[part(figures[c]).alias(c) for c in ("files", "retention", "validation")],
    )


def document(rows: DataFrame) -> DataFrame:
    """(document): the report as one nested JSON document, {category: {metric: value}}, in the order of the names."""
    inner = rows.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("body"))
    parts = F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("category"), F.lit('":'), F.to_json("body"))))
    return inner.agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("document"))
