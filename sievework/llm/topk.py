"""Exact top-k search by inner product (operator 3): exhaustive, term at a time.

Queries are sparse rows of weighted terms (dimension, weight). A block of the
table is turned into postings, for each term the values of all its rows; every
query row scatters its weights times these postings into a dense array of
scores, one for each row of the block. A partition then selects each query's
best rows, and the selections of all partitions are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, ship, written

QUERY_BYTES = 16 << 20  # of one block of queries, as sent to the workers
ROWS_A_BLOCK = 8192
QUERIES_AT_ONCE = 32


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: float = 64.0, *more) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component, exact at any size; further columns may be asked for.

    Rows whose vector is null or holds null, NaN or infinite components (also
    after scaling) go, and so do rows without an id, which a result can't name.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.lit(scale) * x.cast("double"))
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # From 2**53 on a double is whole; floor() gives a long, which would clip it.
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return df.where(good & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("v"), *more)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers, as doubles; shorter ones end with zeros."""
    ends = lists.offsets.to_numpy()
    n = np.diff(ends)
    wide = int(n.max(initial=0))
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if len(n) else np.empty(0)
    if len(n) and (n == wide).all():
        return flat.reshape(len(n), wide)
    out = np.zeros((len(n), wide))
    out[np.arange(wide) < n[:, None]] = flat
    return out


def _kind(bound: float):
    """The narrowest type of whole numbers that holds all partial sums; Python's own beyond 64 bits."""
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object


def _whole(x: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape) if kind is object else x.astype(kind)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, (queries, rows): each query's weights scatter the postings of its terms into its score array."""
    terms = min(queries.shape[1], rows.shape[1])
    kind = _kind(float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, terms))
    postings = _whole(np.ascontiguousarray(rows.T[:terms]), kind)
    weights = _whole(queries[:, :terms], kind)
    out = np.zeros((len(queries), rows.shape[0]), kind)
    for q, acc in zip(weights, out, strict=True):
        for t in np.flatnonzero(q):
            acc += postings[t] * q[t]
    return out


def best(row_scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend."""
    if len(ids) <= k:
        return np.arange(len(ids))
    least = np.partition(row_scores, len(ids) - k)[len(ids) - k]
    above = np.flatnonzero(row_scores > least)
    return np.concatenate([above, np.flatnonzero(row_scores == least)[: k - len(above)]])


def _longs(x: np.ndarray) -> np.ndarray:
    if x.dtype == object and any(not -(2**63) <= y < 2**63 for y in x):
        raise OverflowError("a score among the highest is beyond 64 bits")
    return x.astype(np.int64)


def _search(ids: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int):
    """(query's place, score, id) of the k best of these rows for each query."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    for a in range(0, len(q), QUERIES_AT_ONCE):
        own = scores(q[a : a + QUERIES_AT_ONCE], rows)
        at = [best(s, ids, k) for s in own]
        yield np.repeat(np.arange(a, a + len(own)), [len(x) for x in at]), np.concatenate([_longs(s[x]) for s, x in zip(own, at, strict=True)]), np.concatenate([ids[x] for x in at])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products for each query row; both inputs as of whole_vectors.

    Each row of `queries` must be one of `vectors`, too: all rows but that one
    are its candidates, also others with its id. Fewer than k are all returned;
    ties go to the smaller id, and rows with one id and score can't be told
    apart. A query that is there several times has its rows each time. Scores
    are exact at any size of the components; one among the highest that is
    beyond 64 bits raises. Empty inputs give no rows.

    Queries are searched in blocks of QUERY_BYTES, one after the other: driver
    and workers hold one block, and what a block finds is written to the shared
    folder before the next one is fetched.
    """
    spark = vectors.sparkSession
    ship(spark)
    queries = queries.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    n, wide = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * (wide or 1) // QUERY_BYTES))
    path, kind = scratch(spark, "topk"), vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score long"
    queries = written(queries, "queries") if blocks > 1 else queries
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block) if blocks > 1 else queries
        own = own.orderBy("vec_id", "v").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        lists = own.column("v").combine_chunks()
        q = _matrix(lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks))
        sent = spark.sparkContext.broadcast(q)

        def run(batches, sent=sent):
            for batch in _blocks(batches):
                # One more than k: the query's own row may be among them.
                for got in _search(batch.column("vec_id").to_numpy(), _matrix(batch.column("v")), sent.value, k + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["q", "score", "vec_id"])

        found = vectors.mapInArrow(run, f"q long, score long, vec_id {kind}")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("place", place).where(F.col("place") <= k + 1)
        # The block's queries, and what their own rows score, are a table of the block's size.
        norms = _longs(np.array([sum(int(x) * int(x) for x in row) for row in q.tolist()], object)) if len(q) else np.empty(0, np.int64)
        asked = spark.createDataFrame(pa.table({"q": np.arange(len(q)), "query_id": own.column("vec_id"), "times": own.column("times"), "norm": norms}))
        rows = found.join(F.broadcast(asked), "q")
        mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("norm"))
        by_query = Window.partitionBy("q").orderBy("place")
        first = F.min(F.when(mine, F.col("place"))).over(Window.partitionBy("q"))
        rows = rows.withColumn("own", first).where(F.col("own").isNull() | (F.col("place") != F.col("own")))
        rows = rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        rows = rows.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")
        if blocks == 1:
            return rows
        rows.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema)


def _blocks(batches):
    """Arrow batches put together to about ROWS_A_BLOCK rows, so that each selection is worth its result."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS_A_BLOCK:
            yield _one(held)
            held, n = [], 0
    if n:
        yield _one(held)


def _one(batches) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c) for b in batches]) for c in ("vec_id", "v")], names=["vec_id", "v"])
