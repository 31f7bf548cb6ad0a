"""Label conflicts, and the decisions that resolve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.storage import written

# The decisions that a reviewer may take.
DECISIONS = ["LEGITIMATE_DIFFERENCE", "ANNOTATION_ERROR", "AMBIGUOUS", "NEEDS_REVIEW"]


#: Members of a group that stand in one row.
TOGETHER = 10_000


def conflicts(df: DataFrame, group: str, label: str, member: str) -> DataFrame:
    """(group, image_count, class_count, classes) of the groups with more than one label."""
    rows = df.where(F.col(group).isNotNull())
    return rows.groupBy(group).agg(F.count(member).alias("image_count"), F.countDistinct(label).alias("class_count"), F.array_join(F.array_sort(F.collect_set(label)), " | ").alias("classes")).where("class_count > 1")


def conflict_groups(df: DataFrame, group: str, label: str, member: str, together: int = TOGETHER) -> DataFrame:
    """Groups with more than one label: size, number of labels, the labels and members joined in order.

    `images` is null for groups of more than `together` members: conflict_members() lists theirs in chunks.
    """
    found = conflicts(df, group, label, member)
    small = df.join(found.where(F.col("image_count") <= together).select(group), group, "left_semi")
    joined = small.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(member)), " | ").alias("images"))
    return found.join(joined, group, "left").select(group, "image_count", "class_count", "classes", "images")


def conflict_members(df: DataFrame, group: str, label: str, member: str, size: int = TOGETHER) -> DataFrame:
    """(group, chunk, n, images): the members of every conflict group in order, `size` in a chunk, chunks from 0.

    Members are dealt out by ranges of (group, member), so a group may fill
    many ranges; a range's first place in a group comes from the counts of the
    ranges before it. No row and no task holds more than a range or a chunk.
    """
    rows = df.where(F.col(member).isNotNull()).join(conflicts(df, group, label, member).select(group), group, "left_semi").select(group, member)
    ranged = written(rows.repartitionByRange(group, member).withColumn("_range", F.spark_partition_id()), "members")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(member)) - 1
    placed = ranged.withColumn("_place", place).join(first, [group, "_range"]).withColumn("_place", F.col("_place") + F.col("_first"))
    chunk = F.floor(F.col("_place") / size).alias("chunk")
    listed = F.array_sort(F.collect_list(F.struct("_place", F.col(member).cast("string").alias("m"))))
    return placed.groupBy(group, chunk).agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["m"]), " | ").alias("images"))


def conflict_histogram(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("class_count").agg(F.count("*").alias("n_groups"))


def check_decisions(manifest: DataFrame, decisions: DataFrame, group: str = "leakage_group", label: str = "unified_class") -> DataFrame:
    """(group, problem) of decisions that can't be applied."""
    d = decisions.withColumns({c: F.coalesce(F.trim(c), F.lit("")) for c in ("decision", "keep_class", "exclude_class")})
    domain = d.where(~F.col("decision").isin(DECISIONS)).select(group, F.lit("unknown decision").alias("problem"))
    twice = d.groupBy(group).count().where("count > 1").select(group, F.lit("decided twice").alias("problem"))
    errors = d.where("decision = 'ANNOTATION_ERROR'")
    blank = errors.where("keep_class = '' or exclude_class = ''").select(group, F.lit("keep or exclude class is blank").alias("problem"))
    there = manifest.select(group, F.col(label).alias("exclude_class")).distinct()
    known = manifest.select(group).distinct()
    absent = errors.where("exclude_class != ''").join(known, group, "left_semi").join(there, [group, "exclude_class"], "left_anti").select(group, F.lit("excluded class is not in the group").alias("problem"))
    return domain.union(twice).union(blank).union(absent)


def curate(manifest: DataFrame, decisions: DataFrame, group: str = "leakage_group", label: str = "unified_class") -> DataFrame:
    """manifest with curation_status, curation_reason and curation_action.

    Decisions of groups that the manifest hasn't got have no effect. Of an
    annotation error only the kept and the excluded class are touched; where
    both are one class, it is kept.
    """
    d = decisions.select(group, F.col("decision").alias("_d"), F.col("reason").alias("_r"), F.col("action").alias("_a"), F.coalesce("keep_class", F.lit("")).alias("_k"), F.coalesce("exclude_class", F.lit("")).alias("_x"))
    rows = manifest.join(d, group, "left")
    kind, own = F.col("_d"), F.col(label)
    kept = (kind == "ANNOTATION_ERROR") & (own == F.col("_k"))
    excluded = (kind == "ANNOTATION_ERROR") & (own == F.col("_x")) & ~kept
    status = F.when(excluded, "EXCLUDE").when(kind == "AMBIGUOUS", "KEEP_HARD_CASE").when(kind == "NEEDS_REVIEW", "HOLD").otherwise("KEEP")
    touched = kept | excluded | kind.isin("LEGITIMATE_DIFFERENCE", "AMBIGUOUS", "NEEDS_REVIEW")
    reason = F.when(touched, F.coalesce("_r", F.lit(""))).otherwise("")
    action = F.when(excluded, F.coalesce("_a", F.lit(""))).when(kept, "KEEP_CORRECT_LABEL").when(kind == "LEGITIMATE_DIFFERENCE", "KEEP").when(touched, F.coalesce("_a", F.lit(""))).otherwise("")
    return rows.select(*manifest.columns, status.alias("curation_status"), reason.alias("curation_reason"), action.alias("curation_action"))


def curation_audit(manifest: DataFrame, decisions: DataFrame, group: str = "leakage_group") -> DataFrame:
    sizes = manifest.groupBy(group).agg(F.count("*").alias("images_in_group"))
    return decisions.join(sizes, group)


def curation_result(curated: DataFrame) -> DataFrame:
    """Excluded and kept rows; what is on hold counts as kept."""
    return curated.agg(F.count_if(F.col("curation_status") == "EXCLUDE").alias("excluded"), F.count_if(F.col("curation_status") != "EXCLUDE").alias("kept"))
