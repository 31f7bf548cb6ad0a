"""Reading and writing: typed CSV and JSON, optional and preferred inputs, tables in shared storage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The extensions that count as images, in any case.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]
# Files that the driver lists at once: it holds about 1 KB for each.
FILES_AT_ONCE = 1 << 15
# How many bytes of lists of files the driver keeps for readers to come.
LISTS_KEPT = "spark.sql.hive.filesourcePartitionFileCacheSize"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local folder serves a local session; a session on a
    cluster has to name one, since executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="sievework-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clear() deletes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete what this process has put into the shared folder so far; frames that read it can't be used any more. How many paths there were."""
    found = [p for p in _MADE if exists(spark, p)]
    for path in found:
        remove(spark, path)
    _MADE.clear()
    return len(found)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors.

    The folder is a session's scratch space; what is done with goes by
    remove(), all of it by clear().
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of scratch()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a path, in whatever store Spark can read?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rename(spark: SparkSession, path: str, new: str) -> None:
    """Move a folder to a path that isn't there, in one step of the store."""
    p, q = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, new))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(q):
        raise FileExistsError(new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{path} could not become {new}")


def require_columns(df: DataFrame, needed: set[str] | list[str]) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, such as a model, in whatever store Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def changed(reader, since: str | None):
    """A reader of files that leaves out those last changed before `since`, a timestamp of whole seconds."""
    return reader.option("modifiedAfter", since) if since else reader


def slices(spark: SparkSession, root: str, most: int | None = None) -> list[tuple[list[str], int]]:
    """(paths, number of files) of parts of a folder of at most `most` files (FILES_AT_ONCE), which together are all that Spark reads below it.

    Parts are whole folders as far as they are that small, and several where
    they are smaller; the driver counts, and lists only what it has to cut. A
    folder of more files and no folders inside is a part as it is.
    """
    most = most or FILES_AT_ONCE
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[tuple[str, int]] = []

    def cut(path, n: int | None = None) -> int:
        summary = fs.getContentSummary(path) if n is None else None
        n = summary.getFileCount() if summary else n
        if n <= most or summary and summary.getDirectoryCount() == 1:
            found.append((path.toString(), n))
            return n
        entries = [x for x in fs.listStatus(path) if not re.match(r"[.]|_(?!.*=)", x.getPath().getName())]
        folders = [x.getPath() for x in entries if x.isDirectory()]
        if len(folders) == len(entries) == 1:
            return cut(folders[0], n)
        found.extend((x.getPath().toString(), 1) for x in entries if not x.isDirectory())
        for x in folders:
            cut(x)
        return n

    whole = cut(hadoop.Path(root))
    if whole <= most or len(found) == 1:
        return [([root], whole)]
    out: list[tuple[list[str], int]] = []
    for path, n in found:
        path = re.sub(r"([][{}*?\\])", r"\\\1", path)
        if out and out[-1][1] + n <= most:
            out[-1] = (out[-1][0] + [path], out[-1][1] + n)
        else:
            out.append(([path], n))
    return out


@contextmanager
def lists_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark's cache of lists of files, of up to 250 MB of the driver, is off meanwhile."""
    kept = spark.conf.get(LISTS_KEPT)
    spark.conf.set(LISTS_KEPT, "0")
    try:
        yield
    finally:
        spark.conf.set(LISTS_KEPT, kept)


def by_slices(spark: SparkSession, root: str, of: Callable[[str | list[str]], DataFrame], name: str, parts: list[tuple[list[str], int]] | None = None) -> DataFrame:
    """of(root) for a folder of any number of files: of each of its slices() in turn, as a table in the shared folder.

    A reader's list of files stands in the driver as long as its frame, so
    large folders aren't read by one, and a slice's frames and lists go before
    the next is listed. A folder that is a single slice is left as it is, and
    nothing is written.
    """
    parts = parts or slices(spark, root)
    if len(parts) == 1:
        return of(root)
    path, schema = scratch(spark, name), None
    with lists_dropped(spark):
        for paths, _ in parts:
            part = of(paths)
            part.write.mode("append").parquet(path)
            schema = part.schema
            del part
            gc.collect()  # frames are in cycles, and the lists of their files go with them
    return spark.read.schema(schema).parquet(path)


def named(reader, extensions: list[str]):
    """A reader of files that lists those with the extensions only, in any case; others aren't opened."""
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions]
    return reader.option("pathGlobFilter", "{" + ",".join(f"*.{x}" for x in any_case) + "}")


def in_few_tasks(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows of files in some tasks for each core: Spark makes one of every few files, however small they are."""
    return rows.coalesce(4 * spark.sparkContext.defaultParallelism)


def scan_files(spark: SparkSession, roots: dict[str, str | list[str]], extensions: list[str] = IMAGE_EXTENSIONS, since: str | None = None) -> DataFrame:
    """(dataset, path, length, content) of the files below each root that exists, or below each of several; extensions in any case."""
    out = None
    for dataset, root in roots.items():
        if isinstance(root, str) and not exists(spark, root):
            continue
        reader = named(spark.read.format("binaryFile").option("recursiveFileLookup", True), extensions)
        files = in_few_tasks(spark, changed(reader, since).load(root))
        part = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(extensions)).select(F.lit(dataset).alias("dataset"), "path", "length", "content")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "dataset string, path string, length long, content binary") if out is None else out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """A CSV file with a header: typed by a schema, or all strings with a byte-order mark stripped.

    Empty values are null; strict fails on bad rows, which else have nulls.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", True).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", False).csv(path)
    return df.toDF(*[c.removeprefix(chr(0xFEFF)) for c in df.columns])


def read_guarded(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The good rows of CSV files with a header, typed by the schema, and (file, line, record, reason) of the bad ones.

    A line with too few or too many columns, or with a value that is none of
    its column's type, is bad as a whole; the first such reason is told. Lines
    are counted from 1 and files are split between tasks as usual: each block's
    first line comes from the counts of the blocks before it. A record is a
    line, so values hold no line breaks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")), "blocks")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(by_file), F.lit(0))).drop("n")
    numbered = lines.join(blocks, ["file", "block"])
    head = (F.col("block") == 0) & (F.col("at") == F.col("first"))
    names = schema.fieldNames()
    wide = ", ".join(f"`{i}` string" for i in range(len(names) + 1))
    tokens = F.from_csv("value", wide, {"escape": '"'})
    rows = numbered.where(~head).withColumn("t", tokens).where(F.length("value") > 0)
    cells = [F.col("t")[str(i)] for i in range(len(names))]
    typed = [x.try_cast(f.dataType) for x, f in zip(cells, schema.fields, strict=True)]
    width = F.size(F.split(F.regexp_replace("value", '"(?:[^"]|"")*"', ""), ","))
    reason = F.when(width < len(names), "too few columns").when(width > len(names), "too many columns")
    for name, x, y in zip(names, cells, typed, strict=True):
        reason = reason.when(x.isNotNull() & y.isNull(), f"no {schema[name].dataType.simpleString()} in {name}")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(*[y.alias(n) for n, y in zip(names, typed, strict=True)])
    bad = rows.where("reason is not null").select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("record"), "reason")
    return good, bad


def read_preferred(spark: SparkSession, paths: list[str], read=read_csv, **how) -> DataFrame:
    """The first path that exists."""
    for p in paths:
        if exists(spark, p):
            return read(spark, p, **how)
    raise FileNotFoundError(", ".join(paths))


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, read=read_csv) -> DataFrame:
    """The file, or an empty relation of its schema."""
    return read(spark, path, schema=schema) if exists(spark, path) else spark.createDataFrame([], schema)


def class_mapping(spark: SparkSession, text: str) -> DataFrame:
    """(class_index, class_name) from a JSON mapping: a list, {"classes": [...]}, {"idx_to_class": {...}}, {"class_to_idx": {...}} or digit keys."""
    one = spark.range(1).select(F.lit(text).alias("j"))
    names = F.coalesce(F.from_json("j", "array<string>"), F.from_json(F.get_json_object("j", "$.classes"), "array<string>"))
    by_index = F.coalesce(F.from_json(F.get_json_object("j", "$.idx_to_class"), "map<string,string>"), F.from_json("j", "map<string,string>"))
    to_index = F.from_json(F.get_json_object("j", "$.class_to_idx"), "map<string,int>")
    listed = F.transform(names, lambda x, i: F.struct(i.alias("class_index"), x.alias("class_name")))
    keyed = F.transform(F.filter(F.map_entries(by_index), lambda e: e.key.rlike("^[0-9]+$")), lambda e: F.struct(e.key.cast("int").alias("class_index"), e.value.alias("class_name")))
    inverted = F.transform(F.map_entries(to_index), lambda e: F.struct(e.value.alias("class_index"), e.key.alias("class_name")))
    entries = F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).when(F.size(F.coalesce(inverted, F.array())) > 0, inverted).otherwise(keyed)
    return one.select(F.inline(entries)).orderBy("class_index")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = True) -> None:
    """CSV with a header and all spaces kept: one file, for a report, or one for each partition."""
    df = df.select(*columns) if columns else df
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**kept).csv(path)


def finite(x: Column, kind: T.DataType) -> Column:
    """x with null for NaN and infinities, at any depth of structs, arrays and maps."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[finite(x[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda y: finite(y, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, y: finite(y, kind.valueType))
    return x


def write_json_report(df: DataFrame, path: str) -> None:
    """Each row as one JSON document, nested as the row is; NaN and infinities become null, and nulls are written."""
    safe = [finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_split_cache(df: DataFrame, path: str, split: str = "split") -> None:
    """A Parquet cache with one folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split_cache(spark: SparkSession, path: str, wanted: str, split: str = "split") -> DataFrame:
    """One split of write_split_cache; other splits' folders are not opened."""
    return spark.read.parquet(path).where(F.col(split) == wanted)


def write_results(df: DataFrame, path: str, stem: str = "stem", document: str = "document") -> None:
    """JSON lines (file, document), one for each row: the file name is `<stem>_result.json`.

    Lines of large files take the place of one tiny file for each image.
    """
    df.select(F.concat(F.col(stem), F.lit("_result.json")).alias("file"), F.col(document).alias("document")).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_results wrote, with the document's fields as columns."""
    rows = spark.read.schema("file string, document string").json(path)
    return rows.select("file", F.from_json("document", schema).alias("d")).select("file", "d.*")
