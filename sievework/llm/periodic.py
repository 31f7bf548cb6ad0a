"""Periodic runs of words (operator 13): a harmonic grid, prefix hashes and binary-searched common extensions.

A run of period q and length 3q or more has a grid point kq, such that the q
words from kq equal the q words from kq + q. All pairs (q, kq) of a slice of
texts are tried at once, n ln n for n words; of those that hold, the longest
common extensions to both sides are searched on prefix hashes, again all at
once. What is found is held against the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, pieces, ship, tidy

LEAST_WORDS, LEAST_PERIODS = 24, 3
PAIRS_AT_ONCE = 1 << 19
#: The words that the contract's texts are made of, as a regular expression of Java and of Spark.
SPACE = "[\\x20\\x09-\\x0D]+"
SCHEMA = "doc_id {0}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same for equal words in one process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _grid(starts: np.ndarray, sizes: np.ndarray):
    """Slices of all (period, place of kq, first place, end of its text) with room for two periods from kq."""
    most = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = sizes[text] // period - 1
    ends = np.cumsum(points)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, PAIRS_AT_ONCE):
        b = min(total, a + PAIRS_AT_ONCE)
        i, j = np.searchsorted(ends, [a, b - 1], side="right")
        first = ends[i : j + 1] - points[i : j + 1]
        n = np.minimum(ends[i : j + 1], b) - np.maximum(first, a)
        own = np.repeat(np.arange(i, j + 1), n)
        k = np.arange(a, b) - np.repeat(first, n)
        q, t = period[own], text[own]
        yield q, starts[t] + k * q, starts[t], starts[t] + sizes[t]


def _longest(same, most: np.ndarray) -> np.ndarray:
    """For each pair the largest length up to `most` of which same(pairs, lengths) holds; 0 always does."""
    low, high = np.zeros(len(most), np.int64), most + 1
    while len(open_ := np.flatnonzero(high - low > 1)):
        mid = (low[open_] + high[open_]) // 2
        holds = same(open_, mid)
        low[open_[holds]] = mid[holds]
        high[open_[~holds]] = mid[~holds]
    return low


def _candidates(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of what the hashes take for runs, in places of the slice."""
    up, _ = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    found = [np.empty((0, 3), np.int64)]
    for q, i, lo, hi in _grid(starts, sizes):
        x = total[i + q]
        good = np.flatnonzero((x - total[i]) * up[q] == total[i + 2 * q] - x)
        if not len(good):
            continue
        # Grid points that follow one another with one period are of one run: the first is enough.
        good = good[np.r_[True, (np.diff(good) > 1) | (np.diff(q[good]) != 0) | (np.diff(lo[good]) != 0)]]
        q, i, lo, hi = q[good], i[good], lo[good], hi[good]
        shift, j = up[q], i + q
        ahead = _longest(lambda p, n: (total[i[p] + n] - total[i[p]]) * shift[p] == total[j[p] + n] - total[j[p]], hi - j)
        back = _longest(lambda p, n: (total[i[p]] - total[i[p] - n]) * shift[p] == total[j[p]] - total[j[p] - n], i - lo)
        run = np.stack([i - back, j + ahead, q], axis=1)
        length = run[:, 1] - run[:, 0]
        found.append(np.unique(run[length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)], axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _extended(words: list[bytes], at: int, q: int, first: int, end: int) -> tuple[int, int]:
    """The stretch around `at` whose words q apart are identical, word by word."""
    a = b = at
    while b + q < end and words[b] == words[b + q]:
        b += 1
    while a > first and words[a - 1] == words[a - 1 + q]:
        a -= 1
    return a, b + q


def runs_of(texts: list[list[bytes]], hash_words=hashed) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), in order."""
    words = [w for t in texts for w in t]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    out: list[dict] = [{} for _ in texts]
    for s, e, q in _candidates(hash_words(words), starts, sizes).tolist():
        t = int(np.searchsorted(starts, s, side="right")) - 1
        first, end = int(starts[t]), int(starts[t] + sizes[t])
        least = out[t].get((s - first, e - s))
        if least and q % least == 0:  # candidates come by place and period
            continue
        stretches = [(s, e)]
        if words[s : e - q] != words[s + q : e]:  # the hashes were wrong: what is there is between the words that differ
            stretches, at = [], s
            while at + q < e:
                a, b = _extended(words, at, q, first, end)
                stretches.append((a, b))
                at = max(b - q, at) + 1
        for a, b in stretches:
            if b - a >= max(LEAST_WORDS, LEAST_PERIODS * q):
                # Of one stretch the smallest period counts; the others that are found are its multiples.
                own = out[t]
                own[a - first, b - a] = min(q, own.get((a - first, b - a), q))
    return [sorted((s, n, q) for (s, n), q in own.items()) for own in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        inside[s + q] += 1
        inside[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs.

    Words are runs of anything but the six ASCII white-space characters; runs
    are (start, length, period) in order of start and period, and `collapsed`
    has the words that no run contains after its first period, joined by one
    space. A null, empty or blank text has no words, no runs and collapses to
    the empty text. Whole texts count, however long: n words take n ln n
    trials, PAIRS_AT_ONCE at a time. Repeated rows and ids are rows of their
    own, null ids stay null; an empty table gives no rows, and other columns,
    of whatever name, are not read.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                words = [(t or "").encode().split() for t in texts[a:b]]
                runs = runs_of(words)
                kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs, strict=True)]
                ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return own.mapInArrow(tidy(run), SCHEMA.format(own.schema["doc_id"].dataType.simpleString()))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of one id in ten, by crc32, repeat a stretch of their words from some word on; null ids keep theirs."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    w = F.filter(F.split("text", SPACE), lambda x: x != "")
    chosen = rows.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10).cast("long")})
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[int(a + (i - a) % p)] END), ' ')")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The rows of periodic_runs as counts, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    first = "CASE WHEN l.length * r.period > r.length * l.period THEN -1 WHEN l.length * r.period < r.length * l.period THEN 1 WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 ELSE l.period - r.period END"
    best = F.expr(f"array_sort(runs, (l, r) -> int({first}))[0]")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.withColumn("b", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
