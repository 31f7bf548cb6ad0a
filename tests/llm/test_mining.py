"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import mixing, negatives, periodic, registry

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- periodic runs


def runs_by_comparing(words):
    """All runs (start, length, period): each period's stretches of equal words, the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def repeating(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 30]))).encode() for _ in range(rng.randrange(120))]
    if rng.random() < 0.7:
        p = [str(rng.randrange(3)).encode() for _ in range(rng.randint(1, 30))]
        w = w[: rng.randrange(len(w) + 1)] + p * rng.randint(1, 9) + p[: rng.randrange(len(p))] + w
    return w


@pytest.mark.parametrize("hash_words", [periodic.hashed, lambda words: np.array([hash(w) % 2 for w in words], np.uint64)], ids=["hashes", "hashes that collide"])
def test_runs_are_those_found_by_comparing_words(hash_words, monkeypatch):
    rng = random.Random(13)
    for pairs in (1 << 19, 97):
        monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", pairs)
        for _ in range(150):
            texts = [repeating(rng) for _ in range(rng.randint(1, 5))]
            assert periodic.runs_of(texts, hash_words) == [runs_by_comparing(w) for w in texts]


@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=90))
@settings(max_examples=150, deadline=None)
def test_runs_of_any_two_words(words):
    assert periodic.runs_of([words]) == [runs_by_comparing(words)]


def test_long_runs_take_no_quadratic_time():
    words = [b"a"] * 200_000
    assert periodic.runs_of([words]) == [[(0, 200_000, 1)]]
    assert periodic.collapse(words, [(0, 200_000, 1)]) == [b"a"]


def op13_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_comparing(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if runs else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, exponent, *sha)


def test_op13_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    want = [op13_row(*r) for r in docs]
    assert sum(r[1] > 0 for r in want) > 10
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_op13_on_odd_rows(spark):
    again = " ".join(["x y z"] * 20)
    texts = [None, "", " \t\r\n\x0b\x0c", again, again, again + " " + again, "a\x00b " * 30, "漢 字 " * 40, "w" * 300_000, " ".join(map(str, range(5000))) + " " + "p q " * 5000]
    rows = [(i, t, "odd") for i, t in enumerate(texts)] + [(None, again, "odd"), (None, None, None), (3, again, "odd"), (35, "one", "x"), (40, " ".join(map(str, range(60))), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.digest(periodic.periodic_runs(periodic.planted(docs.select("doc_id", "text", F.col("runs").alias("collapsed"), F.lit(1).alias("h")))))
    assert Counter(map(tuple, got.collect())) == Counter(op13_row(r[0], r[1]) for r in rows)
    whole = {r.doc_id: r for r in periodic.periodic_runs(docs.where("doc_id in (4, 9)")).collect()}
    assert whole[4].runs == [(0, 60, 3)] and whole[4].collapsed == "x y z"
    assert whole[9].runs == [(5000, 10_000, 2)] and whole[9].n_words == 15_000
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- hard negatives


def negatives_by_all_pairs(rows, is_anchor, positives=5, negatives=10):
    """rows of (vec_id, label, list): every pair is scored, in Python's whole numbers."""
    whole = [(i, label, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, own, v) in enumerate(whole):
        if not is_anchor(anchor):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, label) for b, (i, label, w) in enumerate(whole) if b != a), key=lambda s: s[:2])
        for s, i, _ in [x for x in scored if x[2] == own][:positives]:
            fit = [(j, -t) for t, j, label in scored if label != own and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(anchor, i, rank, j, -s, t) for rank, (j, t) in enumerate(fit, 1)]
    return Counter(out)


def test_negatives_by_all_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "SEEDS", 1)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in (centres[i % 6] + rng.normal(size=5) * 0.2)]) for i in range(700)]
    hot = [(1000 + i, i % 3, rows[0][2]) for i in range(200)]  # one vector again and again: ties everywhere
    df = spark.createDataFrame(rows + hot, "vec_id long, label int, embedding array<float>")
    got = negatives.hard_negatives(df, F.col("vec_id") % 25 == 0)
    assert Counter(map(tuple, got.collect())) == negatives_by_all_pairs(rows + hot, lambda i: i % 25 == 0)


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(512, 8)) * 0.01 + c for c in np.eye(8) * 10]).round(3)
    v = v[negatives.halves(v)]
    q = v[:128]
    q = q[negatives.halves(q)]
    trees = [negatives.Tree(x, np.zeros(len(x), np.int64)) for x in (q, v)]
    need = np.sort(q @ v.T, axis=1)[:, -5]
    a, b, _ = negatives._matching(*trees, need, np.full(len(q), np.inf), True)
    kept = np.zeros((len(q), len(v)), bool)
    for x, y in zip(a.tolist(), b.tolist()):
        kept[trees[0].at[-1][x] : trees[0].at[-1][x + 1], trees[1].at[-1][y] : trees[1].at[-1][y + 1]] = True
    assert kept[(q @ v.T) >= need[:, None]].all()
    assert kept.mean() < 0.3


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9]), (2, 2, [0.5, 0.1, 0.2]), (3, 2, []), (4, None, [1.0]), (5, 1, None), (6, 2, [None]), (7, 2, [nan]), (8, 2, [inf]), (9, 2, [-1.0, -1.0]), (None, 2, [0.6]), (10, 3, [0.5, 0.3]), (10, 3, [0.5, 0.3]), (20, 9, [-0.3, 0.2])]
    schema = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("row", "block", "q", "v", "anchor", "score")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == negatives_by_all_pairs(rows, lambda i: i % 10 == 0)
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("label is null")):
        assert negatives.hard_negatives(few, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(TypeError):
        negatives.hard_negatives(df.withColumn("label", F.lit("a")), F.lit(True))


def test_negatives_of_large_components(spark):
    rng = random.Random(3)
    for size in (1e5, 6e6, 4e7):
        rows = [(i, i % 2, [float(np.float32(rng.uniform(-size, size))) for _ in range(3)]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        if size > 1e7:
            with pytest.raises(Exception, match="beyond 64 bits"):
                negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()
            break
        assert Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect())) == negatives_by_all_pairs(rows, lambda i: i % 20 == 0)


# ---------------------------------------------------------------- mixing


def targets_by_sharing(sizes):
    """{source: target}: share by weight, cut, share the excess again, until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    full, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return full | share
        full |= {s: Fraction(3 * sizes[s]) for s in above}
        free -= above
        left -= sum(full[s] for s in above)
    return full


def mixed(spark, docs, **how):
    rows = mixing.mix(docs, **how).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    targets = targets_by_sharing(sizes)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(targets[r.source]), rel=1e-12, abs=1e-9)
        share = targets[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(share) <= r.copies <= math.floor(share) + 1
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(r.size for r in rows if r.source == s) / 2 + 1e-6
    return rows, {s: (taken[s], float(targets[s])) for s in sizes}


def words(n):
    return " ".join(["w"] * n)


def test_mix_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    rows, _ = mixed(spark, docs)
    assert {r.doc_id: r.size for r in rows} == size and len(rows) == len(size)
    again = mixing.mix(docs.orderBy(F.rand(1)).repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    got = registry.QUERIES["op12_mixing"](spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == 200


def test_mix_goes_through_levels_and_comes_near(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 16)
    rng = random.Random(12)
    rows = [(i, words(rng.choice([1, 2, 3, 5, 8, 60])), "abcdefg"[0 if i % 3 == 0 else rng.randrange(7)]) for i in range(3000)]
    _, ends = mixed(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sum(abs(taken - target) for taken, target in ends.values()) <= 7 * 60 / 4, ends


def test_mix_expects_the_fraction_at_every_size(spark):
    docs = spark.createDataFrame([(i, words(1 + i % 7), "ab"[i % 2]) for i in range(5600)], "doc_id long, text string, source string")
    found = mixing.mix(docs).groupBy("source", "size").agg(F.avg("copies").alias("mean"), F.count("*").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    assert len(found) == 14
    for r in found:
        share = r.t / r.s
        assert abs(r["mean"] - share) < 5 * math.sqrt((share % 1) * (1 - share % 1) / r.n)


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, target string, _mix_own string, item string"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, words(9), None), (4, words(9), None), (4, words(9), None), (None, "x y", None), (None, "x y z", "😀"), (5, words(50_000), "b"), *[(7, "same words here", "b")] * 500, (8, "a b\x00c", "￿"), (9, "漢 字", "")]
    docs = spark.createDataFrame([(*r, "t", "h", "i") for r in rows], schema)
    got, _ = mixed(spark, docs)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, len((t or "").encode().split()), s) for i, t, s in rows)
    assert len({r.copies for r in got if r.doc_id == 7}) <= 2
    made = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    texts = {(i, len((t or "").encode().split()), s): t for i, t, s in rows}
    for r in got:
        want[r.doc_id, texts[r.doc_id, r.size, r.source], r.source] += r.copies
    assert made == +want and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    empty, _ = mixed(spark, docs.where("doc_id <= 2"))
    assert {(r.target, r.taken) for r in empty} == {(0.0, 0)}
    one, ends = mixed(spark, docs.where("doc_id = 5"))
    assert [(r.copies, r.taken) for r in one] == [(1, 50_000)]


def test_mix_is_native(spark):
    got = registry.QUERIES["op12_mixing"](spark, SF)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|PythonUDF", plan)
