"""Token ids in ORC files, in document order (operator 10).

Documents are dealt out by ranges of their id and sorted, so the files follow
each other in ascending order and hold one contiguous range each. ORC keeps
the ids of an array column as run-length encoded integers in stripes; row
indexes with minima and maxima, and Bloom filters on the document id, let a
reader skip stripes and row groups. Stripes are read in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import scratch, ship, written

END_ID = 0
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
FILE_BYTES = 256 << 20  # of documents that a file has at most, about
MOST_FILES = 1_000_000


def encode_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, at, ids array<int>): the ids of each whole text, then end_id, and how many ids the partition has before them.

    A null text counts as empty.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        coder, done = bpe.encoder(tokenizer), 0
        for batch in batches:
            buf, ends = bpe.utf8(batch.column("text"))
            for a, b in bpe.slices(ends):
                ids, bounds = coder.encode(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                if end_id is not None:
                    ids, own = np.empty(len(ids) + b - a, np.int32), ids
                    bounds = bounds + np.arange(b - a + 1)
                    is_end = np.zeros(len(ids), bool)
                    is_end[bounds[1:] - 1] = True
                    ids[is_end], ids[~is_end] = end_id, own
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(bounds[:-1] + done), lists], names=["doc_id", "at", "ids"])
                done += len(ids)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, at long, ids array<int>")


def write_ids(docs: DataFrame, path: str, tokenizer: str, files: int | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> None:
    """Write the ids of all documents as ORC files whose names ascend with the document ids.

    Null ids of documents come first; rows with equal ids are in the order of a
    hash of their texts, rows that are equal in both in any order. So a range
    of a file can start or end between rows of one id, and no id, however
    frequent, is one task's. There are as many files as shuffle partitions, or
    more, so that a file has about FILE_BYTES of documents. An empty table
    gives files without rows. Further columns are not used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), MOST_FILES))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(files, *keys, F.spark_partition_id()).sortWithinPartitions(*keys)
    (
        encode_ids(ordered, tokenizer, end_id=end_id)
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.stripe.size", STRIPE_BYTES)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """(doc_id, at, ids, part): `where` on doc_id goes down to the stripes; part is the file's number in the order, at counts the ids before in the file."""
    rows = spark.read.orc(path)
    rows = rows.where(where) if where else rows
    return rows.withColumn("part", F.regexp_extract(F.input_file_name(), r"part-(\d+)-[^/]*$", 1).cast("int"))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids_crc32) of what read_ids gives; the crc is over little-endian 32-bit ids."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "at")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "part", "at", "ids").mapInArrow(run, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")


def positions(found: DataFrame) -> DataFrame:
    """Adds start: the number of ids in all documents before it, by the files' order.

    Only the files' totals, one row each, are put in one order; within a file
    the place was written beside the ids.
    """
    totals = found.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def ids_file(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all ids to the shared folder, and give each document's place, length and crc as read back.

    One row for each row of docs: repeated rows and ids each have their own
    place, null ids come first, a null or empty text has the end id alone, an
    empty table gives no rows.
    """
    path = scratch(docs.sparkSession, "orc-ids")
    write_ids(docs, path, tokenizer)
    return positions(written(digests(read_ids(docs.sparkSession, path)), "orc-digests"))
