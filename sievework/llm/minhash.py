"""MinHash near-duplicates (operator 8).

Texts become weighted sets of shingles of five words. A shingle weighs its
count times the mean IDF of its words. Improved consistent weighted sampling
draws samples that agree with the probability of the weighted Jaccard
similarity; bands of samples make buckets. Texts that share a bucket are
compared by their exact weighted Jaccard similarity, and links of 0.8 or more
make classes.

Only different texts are signed into buckets, compared and put together:
exact copies, however many, are one node from the start, and get the class of
their text at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievework.operators.graph import components

from .common import grams, mix64, pieces, ship, tidy, word_hashes, written

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 12, 4
DF_BITS = 18
RAREST = 256  # a word in one of so many documents, or fewer, has the highest IDF
BLOCK = 512  # different texts of a bucket that one task compares with each other or with another block
BLOCK_WORDS = 1 << 20  # and their words
_T = 1 << 16
_TABLES: list[tuple] = []


def _tables() -> tuple:
    """Random numbers for the samples: (r, ln c, beta) by 16 bits of a hash each, and a multiplier for each sample."""
    if not _TABLES:
        rng = np.random.default_rng(20)
        r = rng.gamma(2, 1, _T).astype(np.float32)
        c = np.log(rng.gamma(2, 1, _T)).astype(np.float32)
        beta = rng.random(_T).astype(np.float32)
        mult = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        _TABLES.append((r, c, beta, mult))
    return _TABLES[0]


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_words(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """In how many of the texts each word bucket is."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    pair = np.unique((text << DF_BITS) | buckets(h))
    return np.bincount(pair & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)


def idf_of(df: np.ndarray, n: float) -> np.ndarray:
    """From 2 for words in one of RAREST documents or fewer down to 1 for words in all.

    Many rare words share a bucket when there are very many words; what a
    bucket has from them is about the median of all buckets, and is taken off.
    So the IDF of a word depends on the share of documents that have it, and
    not on how many documents or rare words there are.
    """
    own = np.maximum(df - np.median(df), 0)
    return (1 + np.clip(np.log((n + 1) / (own + 1)) / math.log(RAREST), 0, 1)).astype(np.float32)


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf_of each word bucket; document frequencies are counted over all documents with a text."""
    ship(docs.sparkSession)

    def run(batches):
        df, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += sum(t is not None for t in texts)
            for a, b in pieces(texts):
                df += document_words(*word_hashes(texts[a:b]))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["word", "n"])

    # At most a row for each bucket comes to the driver.
    got = docs.select(F.col(f"`{text}`")).mapInArrow(tidy(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(1 << DF_BITS)
    real = got[got.word >= 0]
    df[real.word] = real.n
    return idf_of(df, float(got.n[got.word < 0].sum()))


def shingles(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted shingle hashes of each text and their weights. A text of fewer words has one shingle, a wordless one none."""
    h, ends = word_hashes(texts)
    w = idf[buckets(h)]
    g = grams(h, SHINGLE)
    total = np.concatenate([[0], np.cumsum(w, dtype=np.float64)])
    mean = ((total[SHINGLE:] - total[:-SHINGLE]) / SHINGLE).astype(np.float32) if len(w) >= SHINGLE else np.empty(0, np.float32)
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= SHINGLE:
            own = g[a : b - SHINGLE + 1]
            ids, first, n = np.unique(own, return_index=True, return_counts=True)
            # The weight of a shingle must not depend on where the words stand: rounding hides the sums' last bits.
            out.append((ids, (n * np.round(mean[a : b - SHINGLE + 1][first], 3)).astype(np.float32)))
        elif b > a:
            out.append((grams(h[a:b], b - a), np.round(w[a:b].mean(keepdims=True), 3)))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.float32)))
        a = b
    return out


def sample(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The band keys of a weighted set (none of an empty one)."""
    if not len(ids):
        return np.empty(0, np.int64)
    r, c, beta, mult = _tables()
    logs = np.log(weights)
    keys = np.empty(len(mult), np.uint64)
    step = max(1, (1 << 17) // len(ids))
    for a in range(0, len(mult), step):
        x = ids * mult[a : a + step, None]
        rate = r[x >> np.uint64(48)]
        shift = beta[(x >> np.uint64(16)) & np.uint64(0xFFFF)]
        t = np.floor(logs / rate + shift)
        cost = c[(x >> np.uint64(32)) & np.uint64(0xFFFF)] - rate * (t - shift + 1)
        at = cost.argmin(axis=1)
        keys[a : a + step] = mix64(ids[at] ^ t[np.arange(len(at)), at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = keys.reshape(BANDS, ROWS)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        band = mix64(band * np.uint64(0xD6E8FEB86659FD93) ^ rows[:, k])
    return band.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of minima over the sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    high = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / high if high else 0.0


def links(nodes: list, sets: list[tuple[np.ndarray, np.ndarray]], least: float = LEAST) -> list[tuple]:
    """A spanning forest (from, to, similarity) of the graph of all pairs with at least that similarity.

    Each text is compared with all that no text before it has reached, so pairs
    whose ends are linked already are not looked at again.
    """
    if len(nodes) == 2:
        s = similarity(*sets)
        return [(nodes[0], nodes[1], s)] if s >= least else []
    every, ids = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    weights = np.concatenate([s[1] for s in sets])
    size = np.array([len(s[0]) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    total = np.array([s[1].sum(dtype=np.float64) for s in sets])
    dense = np.zeros(len(every), np.float32)
    left = np.arange(len(nodes))
    out, queue = [], []
    flat_ids, flat_w, flat_size = ids, weights, size
    stale = False
    while len(left):
        if queue:
            p = queue.pop()
        else:
            p, left = left[0], left[1:]
            stale = True
        if not len(left):
            break
        if stale:
            at = np.concatenate([np.arange(start[k], start[k + 1]) for k in left])
            flat_ids, flat_w, flat_size, stale = ids[at], weights[at], size[left], False
        own = slice(start[p], start[p + 1])
        dense[ids[own]] = weights[own]
        low = np.add.reduceat(np.minimum(dense[flat_ids], flat_w), np.concatenate([[0], np.cumsum(flat_size)[:-1]]), dtype=np.float64)
        dense[ids[own]] = 0
        s = low / (total[p] + total[left] - low)
        near = s >= least
        if near.any():
            out += [(nodes[p], nodes[k], float(x)) for k, x in zip(left[near], s[near], strict=True)]
            queue += left[near].tolist()
            left, stale = left[~near], True
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, digest, words, bands) of each row of (id, text): the text's md5, its number of words and its band keys."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                sets = shingles(texts[a:b], sent.value)
                keys, sizes = [sample(*x) for x in sets], [len(x[0]) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("digest")[a:b], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "words", "bands"])

    return docs.select("id", digest().alias("digest"), "text").mapInArrow(tidy(run), f"id {_type(docs, 'id')}, digest binary, words long, bands array<long>")


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(f"`{text}`")))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def node(copy_id: str = "copy_id", own: str = "digest") -> Column:
    """A text as a node: nodes are in the order of their smallest ids, those without any last.

    no_id has the type that it has when it is read from a file, where any
    column may be null, so that nodes are dealt out alike before and after.
    """
    no_id = F.when(F.col(copy_id).isNull(), True).when(F.col(copy_id).isNotNull(), False)
    return F.struct(no_id.alias("no_id"), F.col(copy_id).alias("copy_id"), F.col(own).alias("digest"))


def bucket_members(texts: DataFrame) -> DataFrame:
    """(bucket, node, words) of the buckets with several different texts; buckets with the same members are one."""
    members = texts.where(F.size("bands") > 0).select("node", "words", F.posexplode("bands").alias("band", "key")).select("node", "words", F.xxhash64("band", "key").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("words").alias("all_words"), F.bit_xor(F.xxhash64("node.digest")).alias("x"), F.bit_xor(F.xxhash64("node.digest", F.lit(1))).alias("y"), F.min("node").alias("leader")).where("n > 1")
    sizes = sizes.groupBy("n", "all_words", "x", "y", "leader").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all_words") / BLOCK_WORDS)).cast("int")
    return members.join(sizes.select("bucket", "leader", blocks.alias("blocks")), "bucket")


def _share(blocks, seed: int) -> Column:
    return F.pmod(F.xxhash64("node.digest", F.lit(seed)), blocks).cast("int")


def first_tasks(members: DataFrame) -> DataFrame:
    """(task, node): each bucket is a task; one of several blocks is a task for each, with the bucket's leader in all of them."""
    own = members.select("node", F.xxhash64("bucket", _share(F.col("blocks"), 2)).alias("task"))
    led = members.where("blocks > 1").select(F.col("leader").alias("node"), F.xxhash64("bucket", _share(F.col("blocks"), 2)).alias("task")).distinct()
    return own.unionAll(led)


def later_tasks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(task, node) of what the first tasks have left open in buckets of several blocks.

    Where all texts of a bucket are in one class already, nothing is. Else the
    texts are dealt into units: parts of one large class, or of several small
    ones together. Each pair of units is a task, but for two parts of one class.
    """
    large = members.where("blocks > 1").select("bucket", "node", "words", "blocks")
    large = large.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = large.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.max("blocks").alias("blocks"))
    several = classes.groupBy("bucket").agg(F.count("*").alias("k"), F.max("blocks").alias("most")).where("k > 1").select("bucket", "most")
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_WORDS)).cast("int")
    classes = classes.join(several, "bucket").select("bucket", "root", "most", parts.alias("parts"))
    # A class that fits a block shares a unit with other small ones.
    unit = F.when(F.col("parts") > 1, F.xxhash64("root", _share(F.col("parts"), 3))).otherwise(F.xxhash64(F.pmod(F.xxhash64("root"), F.col("most"))))
    whole = F.when(F.col("parts") > 1, F.xxhash64("root"))
    dealt = written(large.drop("blocks").join(classes, ["bucket", "root"]).select("bucket", "node", unit.alias("unit"), whole.alias("whole")), "units")
    units = dealt.select("bucket", "unit", "whole").distinct()
    a, b = units.alias("a"), units.alias("b")
    open_ = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.unit") <= F.col("b.unit")) & F.coalesce(F.col("a.whole") != F.col("b.whole"), F.lit(True))
    pairs = a.join(b, open_).select(F.col("a.bucket").alias("bucket"), F.xxhash64("a.bucket", "a.unit", "b.unit").alias("task"), F.array_distinct(F.array("a.unit", "b.unit")).alias("units"))
    pairs = pairs.select("bucket", "task", F.explode("units").alias("unit"))
    return dealt.join(pairs, ["bucket", "unit"]).select("task", "node")


def compare(tasks: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = LEAST) -> DataFrame:
    """(src, dst, similarity) links between the nodes of (task, node): in each task a spanning forest of its links.

    texts: (digest, text), one row for each different text.
    """
    sent = tasks.sparkSession.sparkContext.broadcast(idf)
    flat = tasks.select("task", F.col("node.copy_id").alias("copy_id"), F.col("node.digest").alias("digest"))
    # Texts are the large side at any size, and the tasks grow with them: neither is for a broadcast.
    rows = flat.join(texts.hint("merge"), "digest").select("task", "copy_id", "digest", "text").repartition("task").sortWithinPartitions("task", "digest")
    kind = rows.schema["copy_id"].dataType
    id_type = to_arrow_type(kind)

    def groups(batches):
        now, nodes, sets = None, [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys, own = batch.column("task").to_pylist(), list(zip(batch.column("copy_id").to_pylist(), batch.column("digest").to_pylist(), strict=True))
            for a, b in pieces(texts):
                for task, n, s in zip(keys[a:b], own[a:b], shingles(texts[a:b], sent.value), strict=True):
                    if task != now:
                        if len(nodes) > 1:
                            yield nodes, sets
                        now, nodes, sets = task, [], []
                    if not nodes or nodes[-1] != n:
                        nodes.append(n)
                        sets.append(s)
        if len(nodes) > 1:
            yield nodes, sets

    def edges(found):
        ends = [pa.array([x[side][k] for x in found], t) for side in (0, 1) for k, t in enumerate((id_type, pa.binary()))]
        return pa.RecordBatch.from_arrays([*ends, pa.array([x[2] for x in found], pa.float64())], names=["src_id", "src_digest", "dst_id", "dst_digest", "similarity"])

    def run(batches):
        found = []
        for nodes, sets in groups(batches):
            found += links(nodes, sets, least)
            if len(found) > 10_000:
                yield edges(found)
                found = []
        yield edges(found)

    t = kind.simpleString()
    out = rows.mapInArrow(tidy(run), f"src_id {t}, src_digest binary, dst_id {t}, dst_digest binary, similarity double")
    return out.select(node("src_id", "src_digest").alias("src"), node("dst_id", "dst_digest").alias("dst"), "similarity")


def _classes(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of each row of (id, text) with a text, and (digest, node, root) of each different text."""
    real = rows.where("text is not null")
    idf = idf_table(real)
    signed = written(signatures(real, idf), "signatures")
    texts = signed.groupBy("digest").agg(F.min("id").alias("copy_id"), F.any_value("words").alias("words"), F.any_value("bands").alias("bands"))
    texts = written(texts.select("digest", node().alias("node"), "words", "bands"), "texts")
    members = written(bucket_members(texts), "buckets")
    # Copies of a text are put together before they are sent anywhere; only texts that share a bucket are kept at hand.
    bodies = real.groupBy(digest().alias("digest")).agg(F.any_value("text").alias("text"))
    bodies = written(bodies.join(members.select("node.digest").distinct().hint("merge"), "digest", "left_semi"), "bodies")
    found = written(compare(first_tasks(members), bodies, idf, least), "links").select("src", "dst")
    roots = components(found)
    if members.where("blocks > 1").limit(1).count():
        more = written(compare(later_tasks(members, roots), bodies, idf, least), "links").select("src", "dst")
        roots = components(more.unionAll(roots.select(F.col("root").alias("src"), F.col("id").alias("dst")).where("src != dst")))
    classes = texts.select("digest", "node").join(roots.select(F.col("id").alias("node"), "root"), "node", "left")
    return signed.select("id", "digest"), classes.select("digest", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, copy_id, class_id) of each row of docs: the smallest ids of its exact copies and of its class.

    Classes are the components of links between different texts with a weighted
    Jaccard similarity of `least` or more; exact copies share a class. A null
    text is like no other, in a class of its own id; empty and wordless texts
    are alike only if they are equal. Ids can be of any type that has an order.
    Rows with one id and different texts are in the classes of their texts. A
    null id counts only where a class has no other: then copy_id or class_id
    are null. An empty table gives no rows; further columns are not used.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    signed, classes = _classes(rows, least)
    found = signed.join(classes.select("digest", F.col("node.copy_id").alias("copy_id"), F.col("root.copy_id").alias("class_id")), "digest")
    alone = rows.where("text is null").select("id", F.col("id").alias("copy_id"), F.col("id").alias("class_id"))
    return found.select("id", "copy_id", "class_id").unionAll(alone).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row of docs, with all its columns, for each class: one with the smallest id and the text that has it.

    Of rows with that id and text the smallest stays, by their other columns.
    Rows with one id and different texts are separate documents; rows with
    a null text all stay. An empty table stays empty.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    first = _classes(rows, least)[1].where("node = root").select(F.col("node").alias("key"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("copy_id"), digest(text).alias("digest"), whole.alias("row"))
    sortable = not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema)
    # Equal rows are put together where they are read; what is left is dealt out by its node once, for this and for the join.
    one = keyed.groupBy(node().alias("key")).agg((F.min("row") if sortable else F.any_value("row")).alias("row"))
    kept = one.join(first.hint("merge"), "key", "left_semi")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return kept.select(*columns).unionAll(docs.where(F.col(f"`{text}`").isNull()))
