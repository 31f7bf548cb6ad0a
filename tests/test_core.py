"""Goldens, boundaries and properties of the operators outside llm."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import paths, scores
from sievework.operators import audit, curate, dedup, evaluate, graph, pixels, quality, serve, split, taxonomy, waste
from sievework.sources import storage
from sievework.streaming import serve as stream
from tests.conftest import SF


def test_paths(spark):
    rows = [
        ("data/raw/ds1/train/Paper/a.JPG", "Paper", "train"), ("data/raw/ds1/Paper/test/b.png", "Paper", "test"), ("ds1\\valid\\Metal\\c.bmp", "Metal", "validation"), ("x.jpg", "UNKNOWN", "unspecified"),
        ("train/x.jpg", "UNKNOWN", "train"), ("raw/glass/x.tar.gz", "glass", "unspecified"),
    ]
    df = spark.createDataFrame(rows, "path string, cls string, split string")
    p = paths.normal_path(F.col("path"))
    for r in df.select("*", paths.deepest_class(p).alias("c"), paths.split_of(p).alias("s"), paths.class_after(p, "DS1").alias("a"), paths.dataset_of(p, ["ds1", "glass"]).alias("d"), paths.stem(p).alias("stem")).collect():
        assert (r.c, r.s) == (r.cls, r.split)
        assert r.a == (r.cls if "ds1" in r.path else "UNKNOWN")
        assert r.d == ("ds1" if "ds1" in r.path else "glass" if "glass" in r.path else "unknown")
    one = spark.range(1).select(paths.short_name(F.lit("x" * 33)).alias("n"), paths.padded_id("NEAR", F.lit(7)).alias("i"), paths.human_size(F.lit(1536)).alias("h")).first()
    assert tuple(one) == ("x" * 29 + "...", "NEAR_00007", "1.5 KB")


def test_quality_boundaries(spark):
    rows = [
        (64, 64, 1.0, 25.0, 50.0, "RGB", False, []), (63, 64, 1.0, 100.0, 60.0, "RGB", False, ["very_small"]), (64, 400, 5.0, 235.0, 60.0, "RGB", False, []), (64, 400, 5.1, 236.0, 60.0, "RGB", False, ["extreme_aspect_ratio", "very_bright"]),
        (64, 400, 0.2, 24.9, 49.9, "RGB", False, ["very_dark", "blurry"]), (64, 64, 0.19, 100.0, None, "P", False, ["extreme_aspect_ratio", "non_rgb_mode"]), (64, 64, 1.0, 100.0, 60.0, "RGBA", True, ["transparency"]),
    ]
    df = spark.createDataFrame(rows, "width int, height int, aspect_ratio double, mean_brightness double, blur_score double, mode string, has_transparency boolean, want array<string>")
    got = df.select("want", quality.flags(quality.image_rules()).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    h = quality.issue_histogram(spark.createDataFrame([(["read_error:A"],), (["read_error:B", "blurry"],)], "issues array<string>"))
    assert {tuple(r) for r in h.collect()} == {("read_error", 2), ("blurry", 1)}


def test_banding_finds_what_shares_a_band(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 3, 4, 6, 7, 10, 11)]
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)] + [(999, None)]
    df = spark.createDataFrame(signed, "id long, signature long")
    got = {(r.a, r.b): (r.distance, r.n_a, r.n_b) for r in dedup.near_pairs(df, "id").collect()}
    reps = {}
    for i, v in enumerate(values):
        reps.setdefault(v, []).append(i)
    want = {}
    for x, y in itertools.combinations(reps, 2):
        d = (x ^ y).bit_count()
        if d <= 10 and any((x >> s) & 65535 == (y >> s) & 65535 for s in (0, 16, 32, 48)):
            (a, n), (b, m) = sorted([(reps[x][0], len(reps[x])), (reps[y][0], len(reps[y]))])
            want[a, b] = (d, n, m)
        if d <= 3:
            assert d <= 10 and any((x >> s) & 65535 == (y >> s) & 65535 for s in (0, 16, 32, 48))
    assert got == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, 5), (5, 9), (9, 0), (20, 21), (30, 3), (31, 30)], [(99, i) for i in range(30)]])
def test_components(spark, edges):
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def plain_split(sizes):
    total = sum(sizes)
    room = {n: s * total for n, s in split.SHARES}
    out = []
    for s in sizes:
        best = max(room, key=lambda n: (room[n], -list(room).index(n)))
        room[best] -= s
        out.append(best)
    return out


def test_split_plan_is_the_greedy_walk():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted((rng.choice([1, 1, 1, 1, 2, 3, 7, 20]) for _ in range(rng.randint(1, 120))), reverse=True)
        runs = split.plan_runs([(s, sizes.count(s)) for s in set(sizes)])
        got = [picks[(i - low) % len(picks)] for _, low, high, picks in runs for i in range(low, high)]
        assert got == plain_split(sizes)


def test_split_of_the_published_shape(spark):
    # 461 groups of several rows with 971 rows in all, 12,225 single ones.
    sizes = [7, *[3] * 44, *[2] * 416]
    sizes += [1] * (13_196 - sum(sizes))
    groups = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "g string, n long")
    got = split.greedy_split(groups, "g", "n").join(groups, "g").groupBy("split").agg(F.sum("n").alias("n")).collect()
    assert {r.split: r.n for r in got} == {"train": 9237, "validation": 1980, "test": 1979}
    assert len(split.plan_runs([(1, 10**10), (2, 10**6)])) < 50


def test_curation(spark):
    m = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 4), ("c", "x", 5), ("d", "x", 6), ("e", "x", 7), ("f", "x", 8)], "leakage_group string, unified_class string, id long")
    d = spark.createDataFrame(
        [("a", "ANNOTATION_ERROR", "r", "FIX", "x", "y"), ("b", "LEGITIMATE_DIFFERENCE", "r", "n", None, None), ("c", "AMBIGUOUS", "r", "HARD", "", ""), ("d", "NEEDS_REVIEW", "r", "WAIT", "", ""), ("f", "ANNOTATION_ERROR", "r", "FIX", "x", "x"), ("zz", "NEEDS_REVIEW", "", "", "", "")],
        "leakage_group string, decision string, reason string, action string, keep_class string, exclude_class string",
    )
    got = {r.id: (r.curation_status, r.curation_action) for r in curate.curate(m, d).collect()}
    assert got == {1: ("KEEP", "KEEP_CORRECT_LABEL"), 2: ("EXCLUDE", "FIX"), 3: ("KEEP", ""), 4: ("KEEP", "KEEP"), 5: ("KEEP_HARD_CASE", "HARD"), 6: ("HOLD", "WAIT"), 7: ("KEEP", ""), 8: ("KEEP", "KEEP_CORRECT_LABEL")}
    bad = spark.createDataFrame([("a", "ANNOTATION_ERROR", "x", "w"), ("b", "ANNOTATION_ERROR", " ", "x"), ("c", "MAYBE", "", ""), ("d", "AMBIGUOUS", "", ""), ("d", "AMBIGUOUS", "", "")], "leakage_group string, decision string, keep_class string, exclude_class string")
    assert {tuple(r) for r in curate.check_decisions(m, bad).collect()} == {("a", "excluded class is not in the group"), ("b", "keep or exclude class is blank"), ("c", "unknown decision"), ("d", "decided twice")}


def test_taxonomy_last_rule_wins(spark):
    rules = [("D", "A", "p", "c1", "", "", "", ""), ("d", " a ", "p", "c2", "", "", "", "")]
    df = spark.createDataFrame([("d", "A", 1), ("d", "b", 2)], "dataset string, original_class string, source_count long")
    tax = taxonomy.mapping_table(spark, rules).coalesce(1)
    assert [r.unified_class for r in taxonomy.map_classes(df, tax).collect()] == ["c2"]
    with pytest.raises(ValueError, match="d/b"):
        taxonomy.map_all(df, tax)


def test_audit(spark):
    m = spark.createDataFrame([("g", "train", "x", "p1"), ("g", "test", "x", "p1"), (None, "train", "y", "p2"), ("h", "validation", "x", "p3")], "g string, split string, label string, path string")
    got = {r.check_name: r.violations for r in audit.integrity_checks(m, "path", "g", "split", "label", ["train", "validation", "test"]).collect()}
    assert got == {"required_columns_not_null": 1, "keys_unique": 1, "groups_in_one_split": 1, "known_splits": 0, "classes_in_all_splits": 2, "all": 5}
    assert tuple(audit.group_stats(m, "g").first()) == (2, 1, 2, 2)


def test_report_of_a_small_matrix(spark):
    df = spark.createDataFrame([(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 1)] * 3 + [(1, 0)] * 1, "a int, p int")
    r = {x.label: x for x in evaluate.classification_report(evaluate.confusion(df, "a", "p", [0, 1, 2])).collect()}
    assert (r["0"].precision, r["0"].recall, r["2"].f1) == (pytest.approx(5 / 6), pytest.approx(5 / 6), 0.0)
    assert r["accuracy"].f1 == pytest.approx(0.8) and r["macro avg"].support == 10


def test_histories(spark):
    losses = [0.9, 0.8, 0.8, 0.85, 0.7, 0.71, 0.7, 0.72, 0.9, 0.1]
    h = spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")
    got = evaluate.early_stopping(h, "loss", 4).orderBy("epoch").collect()
    assert [r.epoch for r in got] == list(range(9))
    assert [r.epoch for r in got if r.improved] == [0, 1, 4]
    rates = [r.learning_rate for r in evaluate.plateau_lr(h, "loss", 1.0).orderBy("epoch").collect()]
    assert rates == [1, 1, 1, 1, 1, 1, 1, 1, 0.5, 0.5]


def test_scores(spark):
    one = spark.createDataFrame([([1.0, 3.0, 3.0, -1000.0],)], "v array<double>")
    got = one.select(scores.softmax(F.col("v")).alias("p"), scores.argmax(F.col("v")).alias("a"), scores.top_k(F.col("v"), 2).alias("t"), scores.top_k(F.col("v"), 9).alias("all")).first()
    assert sum(got.p) == pytest.approx(1) and got.a == 1
    assert [tuple(x) for x in got.t] == [(1, 3.0), (2, 3.0)] and len(got.all) == 4
    assert [r.x for r in spark.createDataFrame([(90.0,), (89.9,), (50.0,), (1.0,), (None,)], "c double").select(scores.ladder(F.col("c")).alias("x")).collect()] == [*[text for _, text in scores.LADDERS["long"]], None]


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b, \"c\"", None)], "k string, n long")
    storage.write_csv(df, f"{tmp_path}/r")
    assert sorted(map(str, storage.read_csv(spark, f"{tmp_path}/r", df.schema).collect())) == sorted(map(str, df.collect()))
    assert storage.read_optional(spark, f"{tmp_path}/none", df.schema).count() == 0
    assert storage.read_preferred(spark, [f"{tmp_path}/none", f"{tmp_path}/r"]).columns == ["k", "n"]
    (tmp_path / "bom.csv").write_text("﻿k,n\nx,1\n", encoding="utf-8")
    assert storage.read_csv(spark, f"{tmp_path}/bom.csv").columns == ["k", "n"]
    for text in ('["a","b"]', '{"classes":["a","b"]}', '{"class_to_idx":{"a":0,"b":1}}', '{"idx_to_class":{"0":"a","1":"b"}}', '{"0":"a","1":"b"}'):
        assert [tuple(r) for r in storage.class_mapping(spark, text).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError, match="zz"):
        storage.require_columns(df, ["k", "zz"])


def test_images(spark, tmp_path):
    (tmp_path / "in" / "A").mkdir(parents=True)
    rng = np.random.default_rng(3)
    px = rng.integers(0, 256, (70, 100, 3), dtype=np.uint8)
    head = b"P6 100 70 255\n"
    (tmp_path / "in" / "A" / "x.BMP").write_bytes(head + px.tobytes())
    (tmp_path / "in" / "A" / "y.png").write_bytes(b"broken")
    (tmp_path / "in" / "A" / "z.txt").write_bytes(b"no image")
    files = storage.scan_files(spark, {"one": str(tmp_path / "in"), "none": str(tmp_path / "missing")})
    got = {r.path.rsplit("/", 1)[1]: r for r in pixels.inspect_images(files).collect()}
    assert set(got) == {"x.BMP", "y.png"}
    x = got["x.BMP"]
    assert (x.width, x.height, x.mode, x.error) == (100, 70, "RGB", None)
    assert x.mean_brightness == pytest.approx(pixels.luma(px).mean()) and x.blur_score > 50
    assert got["y.png"].error == "read_error:ValueError"
    brighter = pixels.phash(pixels.luma(np.clip(px.astype(int) + 3, 0, 255)))
    assert ((x.phash ^ brighter) & ((1 << 64) - 1)).bit_count() <= 6
    assert len(pixels.model_input(head + px.tobytes())) == 3 * 224 * 224


def test_serving_stream(spark, tmp_path):
    df = spark.createDataFrame([([3.0, 1.0],), ([0.0, 1.0],)], "logits array<double>")
    df.write.parquet(f"{tmp_path}/in")
    guidance = spark.createDataFrame([("b", "Rinse.")], "class string, guidance string")
    q = stream.start(stream.serve_stream(spark, f"{tmp_path}/in", df.schema, "logits", ["a", "b"], guidance), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").where("value like '%Rinse.%'").count() == 1
    assert spark.read.text(f"{tmp_path}/out").count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["serving_json"](spark, SF).count() == 500


def png(px):
    """An RGB or gray PNG, written by hand."""
    import struct
    import zlib

    h, w = px.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + px[y].astype(np.uint8).tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if px.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_of_spark_s_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"c{k % 3}/i{k}.png": rng.integers(0, 256, (40 + k, 50, 3)) for k in range(6)} | {"c0/gray.png": rng.integers(0, 256, (33, 47))}
    for name, px in images.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(png(px))
    (tmp_path / "c1/broken.png").write_bytes(b"\x89PNG but no more")
    read = pixels.read_images(spark, str(tmp_path))
    got = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1]: r for r in pixels.inspect_decoded(read).collect()}
    assert set(got) == {*images, "c1/broken.png"} and got["c1/broken.png"].error.startswith("read_error") and got["c1/broken.png"].width is None
    for name, px in images.items():
        three = px if px.ndim == 3 else np.repeat(px[:, :, None], 3, axis=2)
        gray = np.round(three @ np.array([0.299, 0.587, 0.114]))
        r = got[name]
        assert (r.height, r.width, r.mode, r.format, r.error) == (*px.shape[:2], "RGB" if px.ndim == 3 else "L", "PNG", None)
        assert r.mean_brightness == pytest.approx(gray.mean()) and r.phash == pixels.phash(gray)
    x = pixels.model_inputs(read)
    weight, bias = rng.normal(size=(4, 3 * 224 * 224)).astype(np.float32), np.arange(4, dtype=np.float32)
    np.savez(tmp_path / "model.npz", weight=weight, bias=bias)
    rows = pixels.classify(x, str(tmp_path / "model.npz")).collect()
    assert len(rows) == 8
    for r in rows:
        if r.path.endswith("broken.png"):
            assert r.x is None and r.logits is None
        else:
            assert r.logits == pytest.approx((weight @ np.array(r.x, np.float32) + bias).tolist(), rel=1e-3, abs=1e-2)


def test_audit_report_of_a_clean_manifest(spark):
    rows = [(i, f"g{i // 2}", "train" if i < 16 else "val" if i < 24 else "TEST", f"c{i // 2 % 2}", i == 3) for i in range(32)]
    m = spark.createDataFrame(rows, "path long, grp string, split string, label string, near boolean")
    how = {"key": "path", "group": "grp", "split": "split", "label": "label", "near": "near", "splits": {"train": "train", "val": "val", "test": "test"}}
    got = {(r.category, r.metric): r.value for r in audit.report(m, m.union(m.limit(8)), m, m.limit(1), **how).collect()}
    assert len(got) == 31
    want = {("dataset", "total_images"): "32", ("split", "test"): "8", ("leakage", "groups_multiple_images"): "16", ("duplicates", "exact_duplicate_images"): "32", ("retention", "retention_rate_percent"): "80.0", ("files", "images_missing"): "0"}
    assert want.items() <= got.items()
    assert all(v == "true" for (c, k), v in got.items() if c == "validation" and k != "label_conflicts_warning") and got["validation", "label_conflicts_warning"] == "false"
    bad = {(r.category, r.metric): r.value for r in audit.report(m.withColumn("split", F.when(F.col("path") == 0, "val").otherwise(F.col("split"))), m, m.where("path > 5"), m.limit(0), **how).collect()}
    assert (bad["validation", "cross_split_leakage"], bad["validation", "missing_images"], bad["validation", "overall_integrity"], bad["files", "images_found"]) == ("false", "false", "false", "26")


def test_long_numbers_keep_their_digits(spark):
    got = spark.range(1).select(paths.padded_id("NEAR", F.lit(123456)).alias("a"), paths.padded_id("NEAR", F.lit(12345)).alias("b")).first()
    assert tuple(got) == ("NEAR_123456", "NEAR_12345")


def test_numbers_follow_one_order(spark):
    from sievework.operators.manifest import numbered

    df = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "a long, b long").repartition(7)
    got = numbered(df, ["a", "b"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [r.a for r in got] == sorted(r.a for r in got)
    assert numbered(df.where("false"), ["a"], "n").count() == 0


def test_a_cluster_must_name_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


@pytest.mark.parametrize("name", sorted(__import__("sievework.plans.catalog", fromlist=["x"]).ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    from sievework.plans.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "events", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({ORACLES[name].strip()})").fetchall()
    assert len(want[0] if want else names) == len(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


def test_csv_keeps_texts_and_strict_reads_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, " a, \"b\"\nc "), (2, ""), (3, None), (4, "\t\\")], "n long, t string")
    storage.write_csv(df, f"{tmp_path}/r", single=False)
    assert {tuple(r) for r in storage.read_csv(spark, f"{tmp_path}/r", df.schema, strict=True).collect()} == {(r.n, r.t or None) for r in df.collect()}
    (tmp_path / "bad.csv").write_text("n,t\nx,y\n")
    assert storage.read_csv(spark, f"{tmp_path}/bad.csv", df.schema).first().n is None
    with pytest.raises(Exception, match="(?i)malformed"):
        storage.read_csv(spark, f"{tmp_path}/bad.csv", df.schema, strict=True).collect()


def test_best_match_prefers_the_score_then_the_newest(spark):
    rows = [
        ("k", "S_cam.png", "s", 1), ("k", "s_grad.png", "s", 2), ("k", "s_why.png", "s", 9), ("m", "other.png", "s2", 1),
        ("n", "gradcam.png", "zz", 1), ("n", "zz.png", "zz", 0), ("n", "zz2.png", "zz", 0),
    ]
    files = spark.createDataFrame(rows, "image string, name string, stem string, mtime int")
    got = {r.image: r.best for r in serve.best_match(files, "image", "name", "stem", ["mtime", "name"]).collect()}
    assert got == {"k": "s_grad.png", "n": "gradcam.png"}


def test_waste_texts(spark):
    names = [("Food Organics",), ("Plastic cardboard",), ("Hazardous Waste",), ("Residual",)]
    advice = serve.guidance_rules(F.col("n"), waste.WEB_GUIDANCE, waste.WEB_DEFAULT)
    got = [r.a.split(".")[0] for r in spark.createDataFrame(names, "n string").select(advice.alias("a")).collect()]
    assert got == [
        "Place organic material in the designated organic or composting stream where available", "Empty and rinse the plastic item when appropriate, then place it in the designated plastic recycling stream",
        "Do not place this with ordinary household recycling", "Follow your local waste segregation rules for this category",
    ]
    rows = {(r.dataset, r.original_class): r for r in waste.taxonomy(spark).collect()}
    assert len(rows) == 29
    trash, stream = rows["trashnet", "trash"], rows["phenomsg", "non-recyclable"]
    assert (trash.unified_class, trash.training_role, trash.mapping_confidence) == ("Residual", "residual", "MEDIUM")
    assert (stream.unified_class, stream.training_role, stream.mapping_confidence) == ("Residual", "stream", "HIGH")
    assert rows["ewaste", "pcb"].mapping_reason == "Printed circuit board/electronic component."
