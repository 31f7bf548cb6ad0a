"""Many small files as rows: a sink that writes one file a row, and a source of the members of ZIP archives.

Both are data sources of Spark's Python interface; their tasks reach files by
pyarrow's file systems, so paths are local ones or addresses of a store that
pyarrow knows.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of compressed members that one task reads.
MEMBERS_AT_ONCE = 32 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, iterator) -> Written:
        fs, root = located(self.root)
        n, made = 0, set()
        for path, content in iterator:
            if ".." in path.split("/"):
                raise ValueError(f"{path} is not below {self.root}")
            target = f"{root}/{path}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            # A task that is run again writes the same file again; none is seen half written.
            part = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(bytes(content if content is not None else b""))
            fs.move(part, target)
            n += 1
        return Written(n)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sievework_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(df: DataFrame, root: str, path: str | Column = "path", content: str | Column = "content") -> None:
    """Each row's content as the file `path` below root; a null content is an empty file. Of rows with one path any one stays."""
    df.sparkSession.dataSource.register(FileSink)
    path, content = (F.col(x) if isinstance(x, str) else x for x in (path, content))
    df.select(path.cast("string").alias("path"), content.cast("binary").alias("content")).write.format("sievework_files").mode("append").save(root)


def pack_archives(df: DataFrame, path: str = "path", content: str = "content", limit: int = 64 << 20) -> DataFrame:
    """(path, content): rows of files as ZIP archives of about `limit` bytes of members, in the order of the rows of each task."""
    rows = df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))

    def run(frames):
        import pandas as pd

        held, archive, size = None, None, 0

        def closed():
            archive.close()
            return pd.DataFrame({"path": [f"{uuid.uuid4().hex}.zip"], "content": [held.getvalue()]})

        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                if archive is None:
                    held = io.BytesIO()
                    archive, size = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED), 0
                archive.writestr(name, data or b"")
                size += len(data or b"")
                if size >= limit:
                    yield closed()
                    archive = None
        if archive is not None:
            yield closed()

    return rows.mapInPandas(run, "path string, content binary")


@dataclass
class Members(InputPartition):
    archive: str
    first: int
    last: int


class ZipReader(DataSourceReader):
    """Partitions are stretches of an archive's central directory, which each task reads for itself."""

    def __init__(self, options: dict):
        self.root, self.prefix = options["path"].rstrip("/"), options.get("prefix", "")
        self.limit = int(options.get("limit", MEMBERS_AT_ONCE))

    def partitions(self) -> list[Members]:
        fs, root = located(self.root)
        found = fs.get_file_info(root)
        archives = [root] if found.is_file else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.path.lower().endswith(".zip"))
        out = []
        for archive in archives:
            with fs.open_input_file(archive) as f:
                sizes = [x.compress_size for x in zipfile.ZipFile(f).infolist()]
            first, held = 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > self.limit:
                    out.append(Members(archive, first, i))
                    first, held = i, 0
                held += n
            out.append(Members(archive, first, len(sizes)))
        return out or [Members("", 0, 0)]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.archive:
            return
        fs, _ = located(self.root)
        with fs.open_input_file(partition.archive) as f:
            z = zipfile.ZipFile(f)
            for x in z.infolist()[partition.first : partition.last]:
                if not x.is_dir() and x.filename.startswith(self.prefix):
                    yield partition.archive, x.filename.removeprefix(self.prefix), x.file_size, z.read(x)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sievework_zip"

    def schema(self) -> str:
        return "archive string, path string, length long, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_archives(spark: SparkSession, path: str, prefix: str = "", limit: int = MEMBERS_AT_ONCE) -> DataFrame:
    """(archive, path, length, content) of the members of a ZIP archive, or of all below a folder.

    Only members below `prefix` are read, and it is stripped from their paths.
    Members of one archive are read by as many tasks as they have `limit`
    compressed bytes.
    """
    spark.dataSource.register(ZipSource)
    return spark.read.format("sievework_zip").option("prefix", prefix).option("limit", limit).load(path)
