"""Columns derived from paths of the form .../dataset/[split/]class/.../file.ext."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names that say a split.
SPLIT_NAMES = ["train", "training", "val", "valid", "validation", "test", "testing"]


def normal_path(path: Column, prefix: str = "") -> Column:
    """Forward slashes, no surrounding blanks, without a leading prefix."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit(prefix)), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p) if prefix else p


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.[^.]+$", 0)


def deepest_class(path: Column) -> Column:
    """The last folder that names no split; UNKNOWN if there is none."""
    folders = F.slice(parts(path), 1, F.size(parts(path)) - 1)
    return F.coalesce(F.try_element_at(F.filter(folders, lambda f: ~F.lower(f).isin(SPLIT_NAMES)), F.lit(-1)), F.lit("UNKNOWN"))


def class_after(path: Column, dataset: str, skip_split: bool = True) -> Column:
    """The folder after the dataset's, or the one after a split folder there; UNKNOWN if there is none."""
    p = parts(path)
    at = F.array_position(F.transform(p, F.lower), dataset.lower()).cast("int")
    first, second = F.try_element_at(p, at + 1), F.try_element_at(p, at + 2)
    picked = F.when(F.lower(first).isin(SPLIT_NAMES), second).otherwise(first) if skip_split else first
    inside = F.when(F.lower(first).isin(SPLIT_NAMES) & F.lit(skip_split), F.size(p) > at + 2).otherwise(F.size(p) > at + 1)
    return F.when((at > 0) & inside, picked).otherwise("UNKNOWN")


def dataset_of(path: Column, names: list[str], default: str = "unknown") -> Column:
    """The first of the names that is a folder of the path, in the order of names."""
    p = F.transform(parts(path), F.lower)
    out = F.lit(default)
    for n in reversed(names):
        out = F.when(F.array_contains(p, n.lower()), n).otherwise(out)
    return out


# The splits that a path names by their plain words, the first of the list that it has.
PLAIN_SPLITS = [(w, [w]) for w in ("train", "test", "validation", "val")]


def split_of(path: Column, order: list[tuple[str, list[str]]] | None = None, default: str = "unspecified") -> Column:
    """The split that a path names: by `order`, (name, folder names) pairs with the first match winning."""
    p = F.transform(parts(path), F.lower)
    out = F.lit(default)
    for name, words in reversed(order or [("train", ["train", "training"]), ("validation", ["validation", "val", "valid"]), ("test", ["test", "testing"])]):
        out = F.when(F.arrays_overlap(p, F.array(*map(F.lit, words))), name).otherwise(out)
    return out


def short_name(name: Column) -> Column:
    """Names of over 32 characters end in an ellipsis after 29."""
    return F.when(F.length(name) > 32, F.concat(F.left(name, F.lit(29)), F.lit("..."))).otherwise(name)


def padded_id(prefix: str, number: Column) -> Column:
    """The number with five digits, or as many as it has."""
    return F.format_string(prefix + "_%05d", number.cast("long"))


def singleton_id(path: Column) -> Column:
    return F.concat(F.lit("UNIQUE_"), F.left(F.md5(path), F.lit(12)))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))
