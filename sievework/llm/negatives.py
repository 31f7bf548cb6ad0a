"""Hard negatives by dual-tree search (operator 11).

Anchors and candidates each have a tree: cells of a routing tree, which is
fitted on a bounded sample and routes every row; blocks of a cell; halves of
halves of a block, down to leaves of LEAF rows. A node is a ball. Of two nodes
the inner products lie between dot(a, c) - s and dot(a, c) + s, where
s = |a| r_c + |c| r_a + r_a r_c; a pair whose interval can't give any of the
anchors a better row goes with all that is below it. Pairs of blocks are
pruned by joins on the blocks' balls, pairs of halves in the tasks, and pairs
of leaves that stay are scored exactly, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, tidy, written
from .topk import _kind, _longs, _matrix, _whole, whole_vectors

LEAF = 64
BLOCK = 4096  # rows of a block, expected
SAMPLE = 16_384  # rows that a routing tree is fitted on at most
CELLS = 1024  # of a routing tree at most
SEEDS = 4  # blocks with the highest bounds, searched first for each block of anchors
CHUNK = 4  # blocks that one group of a search goes through
LEAVES_AT_ONCE = 8
POWER_STEPS = 3
LEAST, MOST = -(2**63) + 1, 2**63 - 1


# ---------------------------------------------------------------- trees


def spread(v: np.ndarray) -> np.ndarray:
    """A direction along which rows lie far apart: near the first principal one, by a few power steps."""
    own = v - v.mean(axis=0)
    x = np.random.default_rng(0).normal(size=v.shape[1])
    for _ in range(POWER_STEPS):
        x = own.T @ (own @ x)
        if not (n := np.abs(x).max(initial=0)):
            return np.zeros(v.shape[1])
        x /= n
    return x


def halves(v: np.ndarray) -> np.ndarray:
    """The rows' order by a tree that halves each node along its direction of spread, down to LEAF rows."""
    order = np.arange(len(v))

    def split(a: int, b: int, depth: int) -> None:
        if depth == 0 or b - a < 2:
            return
        own = v[order[a:b]]
        order[a:b] = order[a:b][np.argsort(own @ spread(own), kind="stable")]
        mid = (a + b) // 2
        split(a, mid, depth - 1)
        split(mid, b, depth - 1)

    split(0, len(v), depth_of(len(v)))
    return order


def depth_of(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))


def _bounds(n: int, depth: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: halves, as split() makes them."""
    at = np.array([0, n])
    for _ in range(depth):
        at = np.sort(np.concatenate([at, (at[:-1] + at[1:]) // 2]))
    return at


class Tree:
    """The levels of a block whose rows are in the order of halves(): each node's rows, centre, radius and labels."""

    def __init__(self, v: np.ndarray, labels: np.ndarray):
        self.v, self.depth = v, depth_of(len(v))
        self.at = [_bounds(len(v), d) for d in range(self.depth + 1)]
        self.centre, self.radius, self.norm, self.low, self.high = [], [], [], [], []
        for at in self.at:
            n = np.diff(at)
            c = np.add.reduceat(v, at[:-1], axis=0) / n[:, None]
            self.centre.append(c)
            self.radius.append(np.maximum.reduceat(np.linalg.norm(v - np.repeat(c, n, axis=0), axis=1), at[:-1]))
            self.norm.append(np.linalg.norm(c, axis=1))
            self.low.append(np.minimum.reduceat(labels, at[:-1]))
            self.high.append(np.maximum.reduceat(labels, at[:-1]))


def _matching(q: Tree, c: Tree, need: np.ndarray, allow: np.ndarray, same: bool):
    """(leaf of q, leaf of c, highest product) of the leaf pairs that no level prunes; need and allow are by row of q."""
    a = b = np.zeros(1, np.int64)
    for level in range(max(q.depth, c.depth) + 1):
        i, j = min(level, q.depth), min(level, c.depth)
        if level:
            if i == level:
                a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
            if j == level:
                a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
        dot = np.einsum("ij,ij->i", q.centre[i][a], c.centre[j][b])
        nq, nc, rq, rc = q.norm[i][a], c.norm[j][b], q.radius[i][a], c.radius[j][b]
        # The last term covers the rounding of the bounds themselves.
        slack = nq * rc + nc * rq + rq * rc + 1e-9 * (nq + rq) * (nc + rc) + 1e-6
        keep = (dot + slack >= np.minimum.reduceat(need, q.at[i][:-1])[a]) & (dot - slack <= np.maximum.reduceat(allow, q.at[i][:-1])[a])
        if same:
            keep &= (q.low[i][a] <= c.high[j][b]) & (c.low[j][b] <= q.high[i][a])
        else:
            keep &= ~((q.low[i][a] == q.high[i][a]) & (c.low[j][b] == c.high[j][b]) & (q.low[i][a] == c.low[j][b]))
        a, b, up = a[keep], b[keep], (dot + slack)[keep]
    return a, b, up


# ---------------------------------------------------------------- search in a task


class Search:
    """The best k rows of each window of each anchor of a block, over the candidate blocks that it is shown."""

    def __init__(self, rows: pa.RecordBatch, same: bool, k: int):
        self.same, self.k = same, k
        self.row, self.label = rows.column("row").to_numpy(), rows.column("label").to_numpy()
        v = _matrix(rows.column("v"))
        n = len(v)
        lows, highs = rows.column("lo").to_pylist(), rows.column("hi").to_pylist()
        wide = max(map(len, lows))
        # Anchors with fewer windows end with empty ones.
        self.low, self.high = (np.array([x + [e] * (wide - len(x)) for x in xs], np.int64).reshape(n, wide) for xs, e in ((lows, 1), (highs, 0)))
        self.tree = Tree(v, self.label)
        self.best = [np.empty((0, 5), object)] * (len(self.tree.at[-1]) - 1)  # by leaf: window of a row, score, id, row

    def _open(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest product that a row's windows take; an empty window takes none."""
        some = self.low[at] <= self.high[at]
        return np.where(some, self.low[at].astype(float), np.inf).min(axis=1, initial=np.inf), np.where(some, np.where(self.high[at] == MOST, np.inf, self.high[at]), -np.inf).max(axis=1, initial=-np.inf)

    def show(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        wide = max(v.shape[1], self.tree.v.shape[1])
        if v.shape[1] < wide:
            v = np.pad(v, ((0, 0), (0, wide - v.shape[1])))
        if self.tree.v.shape[1] < wide:
            self.tree = Tree(np.pad(self.tree.v, ((0, 0), (0, wide - self.tree.v.shape[1]))), self.label)
        c, q = Tree(v, labels), self.tree
        kind = _kind(float(np.abs(q.v).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, wide))
        kind = np.float64 if kind is np.int32 or kind is np.int64 and float(np.abs(q.v).max()) * float(np.abs(v).max()) * wide < 2**53 else kind
        mine, theirs = (q.v, v) if kind is np.float64 else (_whole(q.v, kind), _whole(v, kind))
        a, b, up = _matching(q, c, *self._open(slice(None)), self.same)
        order = np.lexsort((-up, a))
        a, b, up = a[order], b[order], up[order]
        for leaf in np.unique(a).tolist():
            at = slice(int(q.at[-1][leaf]), int(q.at[-1][leaf + 1]))
            own = np.flatnonzero(a == leaf)
            for first in range(0, len(own), LEAVES_AT_ONCE):
                some = own[first : first + LEAVES_AT_ONCE]
                some = some[up[some] >= self._open(at)[0].min()]  # what earlier leaves gave may have closed these
                if not len(some):
                    break
                places = np.concatenate([np.arange(c.at[-1][x], c.at[-1][x + 1]) for x in b[some]])
                self._score(leaf, at, mine[at] @ theirs[places].T, ids[places], rows[places], labels[places])

    def _score(self, leaf: int, at: slice, s: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        fits = self.row[at][:, None] != rows
        fits &= (self.label[at][:, None] == labels) == self.same
        if s.dtype == object and (fits & (s > MOST) & (self.high[at] == MOST).any(axis=1)[:, None]).any():
            raise OverflowError("a score among the highest is beyond 64 bits")
        got = [self.best[leaf]]
        n = min(self.k, s.shape[1])
        for w in range(self.low.shape[1]):
            ok = fits & (s >= self.low[at, w][:, None]) & (s <= self.high[at, w][:, None])
            if not ok.any():
                continue
            masked = np.where(ok, s, -(2**62) if s.dtype == np.int64 else -np.inf)
            least = np.partition(masked, s.shape[1] - n, axis=1)[:, s.shape[1] - n] if s.dtype != object else np.sort(masked, axis=1)[:, s.shape[1] - n]
            i, j = np.nonzero(ok & (masked >= least[:, None]))
            score = s[i, j]
            score = _longs(score) if s.dtype == object else score.astype(np.int64)
            found = np.empty((len(i), 5), object)
            for col, x in enumerate((i + at.start, np.full(len(i), w), score, ids[j], rows[j])):
                found[:, col] = x
            got.append(found)
        if len(got) == 1:
            return
        every = np.concatenate(got)
        q, w, score, vec_id, row = (every[:, col].astype(np.int64) for col in range(5))
        order = np.lexsort((row, vec_id, -score, w, q))
        q, w, score = q[order], w[order], score[order]
        new = np.r_[True, (np.diff(q) != 0) | (np.diff(w) != 0)]
        rank = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.best[leaf] = every[order[rank < self.k]]
        full = rank == self.k - 1
        # Equal scores may still come with a smaller id, so the last score itself stays open.
        self.low[q[full], w[full]] = np.maximum(self.low[q[full], w[full]], score[full])

    def found(self) -> pa.RecordBatch:
        every = np.concatenate([np.empty((0, 5), object), *self.best])
        q, w, score, vec_id, row = (every[:, col].astype(np.int64) for col in range(5))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.row[q], w.astype(np.int32), score, vec_id, row)], names=["q", "w", "score", "vec_id", "row"])


FOUND = "q long, w int, score long, vec_id long, row long"


def _searched(batches, same: bool, k: int):
    """Rows come by group: first the anchors of a block, then candidate blocks, the best first."""
    search, key, held, block = None, None, [], None

    def put() -> None:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            search.show(rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v")))

    for batch in batches:
        marks = [batch.column(c).to_numpy() for c in ("q_block", "chunk", "place")]
        cuts = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            now = tuple(int(m[a]) for m in marks)
            if now != block:
                if block is not None and block[2] < 0:
                    search = Search(pa.Table.from_batches(held).combine_chunks().to_batches()[0], same, k)
                elif block is not None:
                    put()
                if now[:2] != key:
                    if search is not None:
                        yield search.found()
                    search, key = None, now[:2]
                held, block = [], now
            held.append(batch.slice(a, b - a))
    if block is not None and block[2] >= 0:
        put()
        yield search.found()


# ---------------------------------------------------------------- trees over tables


def _route(v: np.ndarray, along: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    at = np.zeros(len(v), np.int64)
    while len(cuts) and (inner := at < len(cuts)).any():
        own = at[inner]
        at[inner] = 2 * own + 1 + (np.einsum("ij,ij->i", v[inner], along[own]) >= cuts[own])
    return at


def _router(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Direction and cut of each inner node, in heap order."""
    depth = int(np.ceil(np.log2(cells))) if cells > 1 and sample.size else 0
    along, cuts, held = [], [], [sample]
    for _ in range(depth):
        below = []
        for own in held:
            x = spread(own) if len(own) else np.zeros(sample.shape[1])
            place = own @ x
            cut = float(np.median(place)) if len(own) else 0.0
            along.append(x)
            cuts.append(cut)
            below += [own[place < cut], own[place >= cut]]
        held = below
    return np.array(along).reshape(len(along), sample.shape[1]), np.array(cuts)


def blocks(rows: DataFrame, n: int, wide: int) -> DataFrame:
    """rows (row, vec_id, label, v) with their block, their place in its tree, and at place 0 the block's ball and labels.

    A cell of the routing tree is dealt by a hash into as many blocks as its
    rows ask for, so one with a third of all rows is spread like any other,
    and the number of blocks follows from the rows and not from the tasks.
    """
    spark = rows.sparkSession
    ship(spark)
    size = min(BLOCK, max(256, n // 64))

    def padded(batch) -> np.ndarray:
        v = _matrix(pa.concat_arrays(batch.column("v").chunks) if isinstance(batch, pa.Table) else batch.column("v"))
        return np.pad(v, ((0, 0), (0, wide - v.shape[1])))

    sample = rows.orderBy(F.xxhash64("v", "row"), "row").limit(SAMPLE).select("v").toArrow()
    router = _router(padded(sample) if len(sample) else np.empty((0, wide)), min(CELLS, max(1, n // size)))
    sent = spark.sparkContext.broadcast(router)

    def route(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_route(padded(b), *sent.value))], names=[*b.schema.names, "cell"])

    def one(held: list) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        v = padded(b)
        order = halves(v)
        t = Tree(v[order], b.column("label").to_numpy()[order])
        b, n = b.take(pa.array(order)), len(order)
        first = lambda x, kind: pa.array([x] + [None] * (n - 1), kind)
        ball = [first(t.centre[0][0].tolist(), pa.list_(pa.float64())), first(float(t.radius[0][0]), pa.float64()), first(int(t.low[0][0]), pa.int64()), first(int(t.high[0][0]), pa.int64())]
        block = int(b.column("row").to_numpy().min())
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "vec_id", "label", "v")], pa.array(np.full(n, block)), pa.array(np.arange(n)), *ball], names=["row", "vec_id", "label", "v", "block", "pos", "centre", "radius", "low", "high"])

    def cut(batches):
        held, key = [], None
        for b in batches:
            cells, parts = b.column("cell").to_numpy(), b.column("part").to_numpy()
            ends = [*(np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0)) + 1).tolist(), b.num_rows]
            for a, e in zip([0, *ends], ends, strict=False):
                if a == e:
                    continue
                if held and key != (cells[a], parts[a]):
                    yield one(held)
                    held = []
                key = (cells[a], parts[a])
                held.append(b.slice(a, e - a))
        if held:
            yield one(held)

    routed = rows.select("row", "vec_id", "label", "v").mapInArrow(tidy(route), "row long, vec_id long, label long, v array<double>, cell long")
    first = len(router[1])
    counts = dict(routed.groupBy("cell").count().collect())  # of CELLS cells at most
    parts = F.element_at(F.array(*[F.lit(-(-counts.get(first + k, 1) // size)) for k in range(first + 1)]), (F.col("cell") - first + 1).cast("int"))
    dealt = routed.withColumn("part", F.pmod(F.xxhash64("row"), parts)).repartition("cell", "part").sortWithinPartitions("cell", "part", "row")
    schema = "row long, vec_id long, label long, v array<double>, block long, pos long, centre array<double>, radius double, low long, high long"
    return written(dealt.mapInArrow(tidy(cut), schema), "tree")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best_rows(anchors: DataFrame, windows: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """(q, w, rank, score, vec_id, row): for each window w of an anchor's row q the k best candidates of its label, or of others.

    anchors and candidates are blocks(); windows has (q, lo, hi), arrays of
    the least and the greatest score that each window takes. Higher scores come
    first, ties by smaller vec_id; an anchor's own row is no candidate.
    """
    ball = lambda df, p: df.where("pos = 0").select(F.col("block").alias(f"{p}_block"), *[F.col(c).alias(f"{p}_{c}") for c in ("centre", "radius", "low", "high")])
    asked = anchors.join(windows, anchors["row"] == windows["q"]).select("row", "vec_id", "label", "v", "block", "pos", "lo", "hi")
    open_ = F.exists(F.arrays_zip("lo", "hi"), lambda x: x["lo"] <= x["hi"])
    best = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id", "row")
    # The blocks of anchors are few; numbered, they stand against every candidate block.
    numbered = ball(anchors, "q").withColumn("i", F.row_number().over(Window.orderBy("q_block")).cast("long"))
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(numbered.count()).cast("long"))).alias("i")
    pairs = ball(candidates, "c").select("*", every).join(numbered, "i")
    norm = lambda p: F.sqrt(_dot(F.col(f"{p}_centre"), F.col(f"{p}_centre")))
    pairs = pairs.withColumns({"dot": _dot(F.col("q_centre"), F.col("c_centre")), "nq": norm("q"), "nc": norm("c")})
    slack = F.expr("nq * c_radius + nc * q_radius + q_radius * c_radius + 1e-9 * (nq + q_radius) * (nc + c_radius) + 1e-6")
    labels = F.expr("q_low <= c_high AND c_low <= q_high" if same else "NOT (q_low = q_high AND c_low = c_high AND q_low = c_low)")
    pairs = pairs.where(labels).select("q_block", "c_block", (F.col("dot") + slack).alias("upper"), (F.col("dot") - slack).alias("lower"))
    place = F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("upper"), "c_block"))
    pairs = written(pairs.withColumn("place", place.cast("long")), "pairs")

    def search(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        can = asked.where(open_).groupBy(F.col("block").alias("q_block")).agg(F.min(F.array_min("lo")).alias("need"), F.max(F.array_max("hi")).alias("allow"))
        pairs = pairs.join(can, "q_block").where((F.col("upper") >= F.col("need")) & ((F.col("lower") <= F.col("allow")) | (F.col("allow") == MOST))).withColumn("chunk", F.floor(F.col("place") / CHUNK))
        wanted = asked.join(pairs.select(F.col("q_block").alias("block"), "chunk").distinct(), "block")
        mine = wanted.select(F.col("block").alias("q_block"), "chunk", F.lit(-1).cast("long").alias("place"), "pos", "row", "vec_id", "label", "v", "lo", "hi")
        none = F.lit(None).cast("array<long>")
        theirs = candidates.join(pairs.select("q_block", F.col("c_block").alias("block"), "chunk", "place"), "block").select("q_block", "chunk", "place", "pos", "row", "vec_id", "label", "v", none.alias("lo"), none.alias("hi"))
        dealt = mine.unionAll(theirs).repartition("q_block", "chunk").sortWithinPartitions("q_block", "chunk", "place", "pos")
        return dealt.mapInArrow(tidy(lambda batches: _searched(batches, same, k)), FOUND)

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = written(top(search(pairs.where(F.col("place") <= SEEDS), asked)), "seeds")
    # What the first blocks gave is what the others have to reach.
    reached = first.where(F.col("rank") == k).groupBy(F.col("q").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    raised = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("reached", w), x)))
    asked = asked.join(reached, "row", "left").withColumn("lo", F.when(F.col("reached").isNull(), F.col("lo")).otherwise(raised)).drop("reached")
    return top(first.drop("rank").unionAll(search(pairs.where(F.col("place") > SEEDS), asked)))


# ---------------------------------------------------------------- mining


def hard_negatives(df: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), scores are whole inner products, exact;
    a positive's that is beyond 64 bits raises. Anchors are the rows where `anchor` holds. An anchor's
    positives are the best `positives` other rows of its label; a positive's
    negatives are the best `negatives` rows of other labels whose score is from
    `least` to `most` hundredths of the positive's. Higher scores come first,
    ties by smaller vec_id; what is fewer is returned whole.

    Rows with a null id, a null label, or a vector that is null or has a null,
    NaN or infinite component take no part. Shorter vectors end with zeros, an
    empty vector scores 0. Rows that repeat, or share an id, are rows of their
    own, and each is the others' candidate; repeated anchors have their rows
    each. Labels and ids are whole numbers. An empty table, or one without
    anchors, gives no rows; other columns, of whatever name, are not read.
    """
    for c in (vec_id, label):
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise TypeError(f"{c} must be a whole number")
    chosen = F.coalesce(anchor, F.lit(False)).alias("anchor")
    rows = whole_vectors(df, vec_id, vector, scale, F.col(f"`{label}`").cast("long").alias("label"), chosen).where("label is not null")
    rows = written(rows.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, m, wide = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    candidates, anchors = blocks(rows, n, wide or 0), blocks(rows.where("anchor"), m, wide or 0)
    everything = anchors.select(F.col("row").alias("q"), F.array(F.lit(LEAST)).alias("lo"), F.array(F.lit(MOST)).alias("hi"))
    near = written(best_rows(anchors, everything, candidates, True, positives).select("q", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    hundredths = lambda x: F.col("positive_score").cast("decimal(20,0)") * x / 100
    window = F.struct("p", F.ceil(hundredths(least)).cast("long").alias("lo"), F.floor(hundredths(most)).cast("long").alias("hi"))
    windows = near.groupBy("q").agg(F.array_sort(F.collect_list(window)).alias("w")).select("q", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    found = best_rows(anchors, windows, candidates, False, negatives)
    found = found.select("q", (F.col("w") + 1).alias("p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("q"), F.col("vec_id").alias("anchor_id"))
    return found.join(near, ["q", "p"]).join(ids, "q").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
