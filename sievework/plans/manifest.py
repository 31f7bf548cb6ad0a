"""Queries on the rows of a manifest and its audit report; more names of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import paths, scores
from sievework.operators import audit, curate, dedup, evaluate, manifest, profile, quality
from sievework.plans import catalog as c
from sievework.plans.catalog import query
from sievework.sources.storage import written

# ---------------------------------------------------------------- filters and orders


@query(f"WITH {c._FLAGS} SELECT doc_id, array_to_string(issues, ' | ') AS issues FROM flags WHERE len(issues) > 0")
def rows_not_ok(spark, d):
    return manifest.with_status(c.flagged(spark, d), "OK", keep=False).select("doc_id", F.array_join("issues", " | ").alias("issues"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.text IS NOT NULL")
def complete_rows(spark, d):
    rows = c.documents(spark, d).join(c.table(spark, d, "labels"), "doc_id", "left")
    return manifest.complete(rows, ["quality", "toxic", "text"]).select("doc_id", "quality", "toxic")


_ODD_SPLITS = "odd AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Train' WHEN 1 THEN 'train' WHEN 2 THEN ' TEST' ELSE 'val' END AS split FROM documents)"


def _odd_splits(spark, d):
    k = F.col("doc_id") % 4
    return c.table(spark, d, "documents").select("doc_id", F.when(k == 0, "Train").when(k == 1, "train").when(k == 2, " TEST").otherwise("val").alias("split"))


@query(f"WITH {_ODD_SPLITS} SELECT 'exact' AS how, doc_id FROM odd WHERE split = 'train' UNION ALL SELECT 'folded', doc_id FROM odd WHERE lower(trim(split)) = 'train' UNION ALL SELECT 'folded', doc_id FROM odd WHERE lower(trim(split)) = 'test'")
def split_subsets(spark, d):
    rows = _odd_splits(spark, d)
    parts = [("exact", manifest.of_split(rows, "train")), ("folded", manifest.of_split(rows, "train", folded=True)), ("folded", manifest.of_split(rows, "TEST", folded=True))]
    out = [p.select(F.lit(how).alias("how"), "doc_id") for how, p in parts]
    return out[0].union(out[1]).union(out[2])


@query("SELECT doc_id, CASE WHEN n_chars // 10 < 64 OR n_chars // 8 < 64 THEN 'WARNING' ELSE 'OK' END AS status, CASE WHEN n_chars // 10 < 64 OR n_chars // 8 < 64 THEN 'Image resolution is very small.' ELSE 'Image is readable.' END AS message FROM documents")
def size_gate(spark, d):
    gate = manifest.size_gate(F.expr("n_chars div 10"), F.expr("n_chars div 8"))
    return c.documents(spark, d).select("doc_id", gate["status"].alias("status"), gate["message"].alias("message"))


@query("SELECT page_id, row_number() OVER (ORDER BY lower(url), url, page_id) AS position FROM pages")
def pages_in_order(spark, d):
    rows = c.table(spark, d, "pages").select("page_id", "url", F.lower("url").alias("folded"))
    return manifest.numbered(rows, ["folded", "url", "page_id"], "position").select("page_id", "position")


@query(f"WITH {c._CONFLICTS} SELECT leakage_group, image_count, class_count FROM conflicts ORDER BY image_count DESC, class_count DESC, leakage_group LIMIT 20")
def largest_conflicts(spark, d):
    return manifest.first_rows(c.conflict_groups(spark, d), [F.desc("image_count"), F.desc("class_count"), "leakage_group"], 20).select("leakage_group", "image_count", "class_count")


@query(f"WITH {c._HASHED} SELECT sha256, count(*) AS n FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 ORDER BY n DESC, sha256 LIMIT 10")
def largest_groups(spark, d):
    return profile.top(c.hashed(spark, d).where("sha256 is not null"), ["sha256"], 10)


# ---------------------------------------------------------------- lookups

_NEAR_IDS = "near_ids AS (SELECT a AS doc_id, min(b) AS near FROM (SELECT a, b FROM pairs WHERE distance <= 6 UNION SELECT b, a FROM pairs WHERE distance <= 6) GROUP BY 1)"


def _near_ids(spark, d, pairs=None):
    p = (dedup.near_pairs(c.signed(spark, d), "doc_id", dedup.STRONG) if pairs is None else pairs).select("a", "b")
    return p.union(p.select("b", "a")).groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("near"))


@query(f"""
WITH {c._NEAR}, {_NEAR_IDS}, {c._HASHED}, g AS (SELECT sha256, count(*) AS k, min(doc_id) AS first FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT hashed.doc_id, coalesce(g.first::VARCHAR, '') AS exact_group, coalesce(near_ids.near::VARCHAR, '') AS near_group FROM hashed LEFT JOIN g USING (sha256) LEFT JOIN near_ids USING (doc_id)
""")
def group_lookup(spark, d):
    docs = c.hashed(spark, d)
    first = docs.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("k"), F.min("doc_id").alias("first")).where("k > 1")
    exact = docs.join(first, "sha256").select("doc_id", "first")
    return manifest.with_groups(docs.select("doc_id"), "doc_id", {"exact_group": exact, "near_group": _near_ids(spark, d)})


@query(f"WITH {c._NEAR} SELECT a, b, distance FROM pairs WHERE distance <= 10 AND a IN (SELECT doc_id FROM documents WHERE lang = 'en') AND b IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def near_pairs_in_set(spark, d):
    pairs = dedup.near_pairs(c.signed(spark, d), "doc_id").select("a", "b", "distance")
    return manifest.edges_among(pairs, c.documents(spark, d).where("lang = 'en'"), "doc_id", ("a", "b"))


@query(f"WITH {c._NEAR}, p AS (SELECT a, b, distance FROM pairs WHERE distance <= 10) SELECT a, b, distance, x.source AS source_a, y.source AS source_b, x.lang AS lang_a, y.lang AS lang_b FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b")
def near_pair_records(spark, d):
    return manifest.pair_records(dedup.near_pairs(c.signed(spark, d), "doc_id").select("a", "b", "distance"), c.documents(spark, d), "doc_id", ["source", "lang"])


@query(f"WITH {c._NEAR} SELECT a AS first_id, b AS second_id, distance AS hamming_distance, NULL::VARCHAR AS label FROM pairs WHERE distance <= 10")
def pair_columns(spark, d):
    rows = dedup.near_pairs(c.signed(spark, d), "doc_id").select(F.col("a").alias("image_1"), F.col("b").alias("Image_2"), "distance")
    return manifest.normal_pairs(rows, {"first_id": ["image_1", "path_1"], "second_id": ["image_2"], "hamming_distance": ["distance"], "label": ["class"]})


@query(f"""
WITH {c._NEAR}, {_NEAR_IDS}, {c._HASHED}, s AS (SELECT sha256, count(*) AS k FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1)
SELECT sha256 AS leakage_group, count(*) AS image_count, min(split) AS split, array_to_string(list_sort(list_distinct(list(source))), '|') AS datasets, array_to_string(list_sort(list_distinct(list(lang))), '|') AS unified_classes,
       bool_or(k > 1) AS has_exact_duplicate, bool_or(near IS NOT NULL) AS has_near_duplicate
FROM hashed JOIN s USING (sha256) LEFT JOIN near_ids USING (doc_id) GROUP BY 1
""")
def exact_group_report(spark, d):
    docs = c.hashed(spark, d).where("sha256 is not null")
    sizes = docs.groupBy("sha256").agg(F.count("*").alias("k"))
    rows = docs.join(sizes, "sha256").join(_near_ids(spark, d), "doc_id", "left").withColumnRenamed("sha256", "leakage_group")
    return manifest.group_report(rows, "leakage_group", "split", "source", "lang", F.col("k") > 1, F.col("near").isNotNull())


# ---------------------------------------------------------------- profiles and columns


@query("SELECT CASE WHEN grouping(ext) = 0 THEN 'extension' ELSE 'scheme' END AS key, coalesce(ext, scheme) AS value, count(*) AS n FROM (SELECT lower(regexp_extract(string_split(url, '/')[-1], '\\.[^.]+$')) AS ext, string_split(url, ':')[1] AS scheme FROM pages) GROUP BY GROUPING SETS ((ext), (scheme))")
def extension_profile(spark, d):
    rows = c.table(spark, d, "pages").select(F.lower(paths.suffix(F.col("url"))).alias("extension"), F.element_at(F.split("url", ":"), 1).alias("scheme"))
    return profile.grouping_profile(rows, ["extension", "scheme"])


@query("SELECT source, round(min(r), 4) AS min_ratio, round(max(r), 4) AS max_ratio, round(avg(r), 4) AS mean_ratio FROM (SELECT source, CASE WHEN n_chars % 97 > 0 THEN (n_chars % 89) / (n_chars % 97) ELSE 0 END AS r FROM documents WHERE n_chars > 0) GROUP BY 1")
def ratio_profile(spark, d):
    ratio = quality.aspect_ratio(F.col("n_chars") % 89, F.col("n_chars") % 97)
    return c.documents(spark, d).where("n_chars > 0").select("source", ratio.alias("r")).groupBy("source").agg(*[F.round(f("r"), 4).alias(f"{n}_ratio") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


_SIDES = "sides AS (SELECT doc_id, n_chars % 300 AS width, n_chars % 211 AS height, (n_chars % 256)::DOUBLE AS luma, (n_chars % 131)::DOUBLE AS blur, ['RGB', 'RGBA', 'P'][doc_id % 3 + 1] AS mode, doc_id % 2 = 0 AS clear FROM documents WHERE n_chars IS NOT NULL)"


@query(f"""
WITH {_SIDES}, r AS (SELECT *, CASE WHEN height > 0 THEN width / height ELSE 0 END AS ratio FROM sides)
SELECT doc_id, array_to_string(list_filter([CASE WHEN width < 64 OR height < 64 THEN 'very_small' END, CASE WHEN ratio > 5 OR ratio < 0.2 THEN 'extreme_aspect_ratio' END, CASE WHEN luma < 25 THEN 'very_dark' END, CASE WHEN luma > 235 THEN 'very_bright' END,
       CASE WHEN blur < 50 THEN 'blurry' END, CASE WHEN clear THEN 'transparency' END, CASE WHEN mode IN ('RGBA', 'P') AND NOT clear THEN 'non_rgb_mode' END], lambda x: x IS NOT NULL), ' | ') AS issues FROM r
""")
def image_rules(spark, d):
    n = F.col("n_chars")
    mode = F.element_at(F.array(*map(F.lit, ["RGB", "RGBA", "P"])), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = c.documents(spark, d).where(n.isNotNull()).select("doc_id", (n % 300).alias("width"), (n % 211).alias("height"), (n % 256).cast("double").alias("mean_brightness"), (n % 131).cast("double").alias("blur_score"), mode.alias("mode"), (F.col("doc_id") % 2 == 0).alias("has_transparency"))
    rows = rows.withColumn("aspect_ratio", quality.aspect_ratio(F.col("width"), F.col("height")))
    return rows.select("doc_id", F.array_join(quality.flags(quality.image_rules()), " | ").alias("issues"))


@query("""
WITH p AS (SELECT page_id, url, string_split(lower(url), '/') AS l, string_split(url, '/') AS o FROM pages)
SELECT page_id, CASE WHEN list_contains(l, 'a') THEN 'a' WHEN list_contains(l, 'www.example.com') THEN 'www.example.com' ELSE 'unknown' END AS dataset, CASE WHEN length(url) > 32 THEN left(url, 29) || '...' ELSE url END AS short,
       CASE WHEN length(url) * 41 < 1024 THEN (length(url) * 41)::VARCHAR || ' B' ELSE printf('%.1f KB', length(url) * 41 / 1024) END AS size
FROM p
""")
def path_extras(spark, d):
    u = F.col("url")
    return c.table(spark, d, "pages").select("page_id", paths.dataset_of(u, ["a", "www.example.com"]).alias("dataset"), paths.short_name(u).alias("short"), paths.human_size(F.length(u) * 41).alias("size"))


@query(f"""
WITH {c._DECIDED}, d AS (SELECT leakage_group, CASE WHEN decision = 'AMBIGUOUS' THEN 'MAYBE' ELSE decision END AS decision, keep_class, CASE WHEN decision = 'ANNOTATION_ERROR' AND image_count % 2 = 0 THEN '' ELSE 'elsewhere' END AS exclude_class FROM decisions JOIN (SELECT leakage_group, image_count FROM conflicts) USING (leakage_group))
SELECT leakage_group, 'unknown decision' AS problem FROM d WHERE decision = 'MAYBE' UNION ALL SELECT leakage_group, 'keep or exclude class is blank' FROM d WHERE decision = 'ANNOTATION_ERROR' AND exclude_class = ''
UNION ALL SELECT leakage_group, 'excluded class is not in the group' FROM d WHERE decision = 'ANNOTATION_ERROR' AND exclude_class = 'elsewhere'
""")
def decision_problems(spark, d):
    sizes = c.conflict_groups(spark, d).select("leakage_group", "image_count")
    kind = F.col("decision")
    rows = c.decisions(spark, d).join(sizes, "leakage_group").withColumn("exclude_class", F.when((kind == "ANNOTATION_ERROR") & (F.col("image_count") % 2 == 0), "").otherwise("elsewhere"))
    rows = rows.withColumn("decision", F.when(kind == "AMBIGUOUS", "MAYBE").otherwise(kind))
    return curate.check_decisions(c.conflict_rows(spark, d), rows.drop("image_count"))


@query(f"""
WITH {c._HISTORY}, a AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i, max(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, max(val_loss) OVER (ORDER BY epoch) AS best FROM history),
b AS (SELECT *, prior IS NULL OR val_loss > prior AS improved FROM a), k AS (SELECT *, i - max(CASE WHEN improved THEN i END) OVER (ORDER BY epoch) AS since FROM b),
e AS (SELECT *, coalesce(sum(CASE WHEN since >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM k)
SELECT epoch, val_loss, improved, best, since FROM e WHERE stops = 0
""")
def early_stopping_max(spark, d):
    return evaluate.early_stopping(c.history(spark, d), "val_loss", 3, lower_is_better=False).select("epoch", "val_loss", "improved", "best", F.col("since").cast("long").alias("since"))


@query("SELECT vec_id, list_transform(range(1, 4), lambda i: round((embedding[i]::DOUBLE - [0.485, 0.456, 0.406][i]) / [0.229, 0.224, 0.225][i], 6)) AS v FROM (SELECT vec_id, embedding FROM embeddings)")
def affine_values(spark, d):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return c.table(spark, d, "embeddings").select("vec_id", F.transform(scores.affine(v, [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]), lambda x: F.round(x, 6)).alias("v"))


@query(f"WITH {c._SCORED} SELECT round(avg(list_max(p)), 6) AS mean_confidence FROM scored")
def mean_confidence(spark, d):
    return c.scored(spark, d).agg(F.round(F.avg(F.array_max("p")), 6).alias("mean_confidence"))


@query(f"WITH {c._REPORT} SELECT 'first model' AS model, * FROM rounded WHERE NOT regexp_matches(label, 'a')")
def class_rows_of_report(spark, d):
    return c.report(spark, d).where(~F.col("label").isin("accuracy", "macro avg", "weighted avg")).select(F.lit("first model").alias("model"), "*")


# ---------------------------------------------------------------- the audit report

_AUDITED = f"""
{c._NEAR}, {_NEAR_IDS}, {c._HASHED},
m AS (SELECT hashed.*, near IS NOT NULL AS has_near FROM hashed LEFT JOIN near_ids USING (doc_id) WHERE doc_id % 50 <> 7),
g AS (SELECT sha256, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT lang) AS l FROM m WHERE sha256 IS NOT NULL GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM m) AS images, (SELECT count(DISTINCT lang) FROM m) AS classes, (SELECT count(*) FROM m WHERE split = 'train') AS train, (SELECT count(*) FROM m WHERE split = 'validation') AS val, (SELECT count(*) FROM m WHERE split = 'test') AS test,
  (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n > 1) AS multi, (SELECT coalesce(sum(n), 0)::BIGINT FROM g WHERE n > 1) AS grouped, (SELECT count(*) FROM g WHERE s > 1) AS crossing, (SELECT count(*) FROM g WHERE l > 1) AS conflicts,
  (SELECT count(*) FROM m WHERE has_near) AS near_images, (SELECT count(*) FROM pairs WHERE distance <= 6) AS near_pairs, (SELECT count(DISTINCT doc_id) FROM m) AS expected, (SELECT count(DISTINCT doc_id) FROM m WHERE doc_id IN (SELECT doc_id FROM labels)) AS found,
  (SELECT count(*) FROM documents) AS original, (SELECT count(*) FROM m WHERE doc_id IS NULL OR sha256 IS NULL OR lang IS NULL OR split IS NULL) AS missing, (SELECT count(*) - count(DISTINCT doc_id) FROM m) AS repeated,
  (SELECT count(DISTINCT lang) FROM m WHERE split = 'train') AS in_train, (SELECT count(DISTINCT lang) FROM m WHERE split = 'validation') AS in_val, (SELECT count(DISTINCT lang) FROM m WHERE split = 'test') AS in_test),
v AS (SELECT *, true AS required, missing = 0 AS ok_values, repeated = 0 AS ok_paths, crossing = 0 AS ok_split, expected = found AS ok_files, in_train = classes AS ok_train, in_val = classes AS ok_val, in_test = classes AS ok_test FROM a),
report AS (SELECT unnest([
  {{'category': 'dataset', 'metric': 'total_images', 'value': images::VARCHAR}}, {{'category': 'dataset', 'metric': 'number_of_classes', 'value': classes::VARCHAR}},
  {{'category': 'split', 'metric': 'train', 'value': train::VARCHAR}}, {{'category': 'split', 'metric': 'val', 'value': val::VARCHAR}}, {{'category': 'split', 'metric': 'test', 'value': test::VARCHAR}},
  {{'category': 'leakage', 'metric': 'total_groups', 'value': groups::VARCHAR}}, {{'category': 'leakage', 'metric': 'groups_multiple_images', 'value': multi::VARCHAR}}, {{'category': 'leakage', 'metric': 'grouped_images', 'value': grouped::VARCHAR}}, {{'category': 'leakage', 'metric': 'cross_split_groups', 'value': crossing::VARCHAR}},
  {{'category': 'duplicates', 'metric': 'exact_duplicate_images', 'value': grouped::VARCHAR}}, {{'category': 'duplicates', 'metric': 'exact_duplicate_groups', 'value': multi::VARCHAR}}, {{'category': 'duplicates', 'metric': 'near_duplicate_images', 'value': near_images::VARCHAR}}, {{'category': 'duplicates', 'metric': 'near_duplicate_pairs_or_groups', 'value': near_pairs::VARCHAR}},
  {{'category': 'label_conflicts', 'metric': 'conflicting_groups', 'value': conflicts::VARCHAR}},
  {{'category': 'files', 'metric': 'images_expected', 'value': expected::VARCHAR}}, {{'category': 'files', 'metric': 'images_found', 'value': found::VARCHAR}}, {{'category': 'files', 'metric': 'images_missing', 'value': (expected - found)::VARCHAR}},
  {{'category': 'retention', 'metric': 'original_manifest_images', 'value': original::VARCHAR}}, {{'category': 'retention', 'metric': 'curated_images', 'value': images::VARCHAR}}, {{'category': 'retention', 'metric': 'images_excluded', 'value': greatest(0, original - images)::VARCHAR}}, {{'category': 'retention', 'metric': 'retention_rate_percent', 'value': round(100.0 * images / original, 2)::DOUBLE::VARCHAR}},
  {{'category': 'validation', 'metric': 'required_columns', 'value': required::VARCHAR}}, {{'category': 'validation', 'metric': 'missing_required_values', 'value': ok_values::VARCHAR}}, {{'category': 'validation', 'metric': 'duplicate_paths', 'value': ok_paths::VARCHAR}}, {{'category': 'validation', 'metric': 'cross_split_leakage', 'value': ok_split::VARCHAR}}, {{'category': 'validation', 'metric': 'missing_images', 'value': ok_files::VARCHAR}},
  {{'category': 'validation', 'metric': 'all_classes_train', 'value': ok_train::VARCHAR}}, {{'category': 'validation', 'metric': 'all_classes_val', 'value': ok_val::VARCHAR}}, {{'category': 'validation', 'metric': 'all_classes_test', 'value': ok_test::VARCHAR}},
  {{'category': 'validation', 'metric': 'overall_integrity', 'value': (required AND ok_values AND ok_paths AND ok_split AND ok_files AND ok_train AND ok_val AND ok_test)::VARCHAR}}, {{'category': 'validation', 'metric': 'label_conflicts_warning', 'value': (conflicts > 0)::VARCHAR}}
]) AS r FROM v)
"""


def _manifest(spark, d, label="lang"):
    """What an audit is about, each table written once: it is read for many counts."""
    pairs = written(dedup.near_pairs(c.signed(spark, d), "doc_id", dedup.STRONG), "pairs")
    rows = c.hashed(spark, d).where("doc_id % 50 != 7").join(_near_ids(spark, d, pairs), "doc_id", "left")
    rows = written(rows.select("doc_id", "sha256", "split", label, F.col("near").isNotNull().alias("has_near")), "manifest")
    return (rows, c.documents(spark, d), c.table(spark, d, "labels"), pairs), {"key": "doc_id", "group": "sha256", "split": "split", "label": label, "near": "has_near", "splits": {"train": "train", "val": "validation", "test": "test"}}


def _audited(spark, d):
    tables, columns = _manifest(spark, d)
    return audit.report(*tables, **columns)


@query(f"WITH {_AUDITED} SELECT r.category AS category, r.metric AS metric, r.value AS value FROM report")
def audit_report(spark, d):
    return _audited(spark, d)


@query(f"""
WITH {_AUDITED}, inner_ AS (SELECT r.category AS category, string_agg('"' || r.metric || '":"' || r.value || '"', ',' ORDER BY r.metric) AS body FROM report GROUP BY 1)
SELECT '{{' || string_agg('"' || category || '":{{' || body || '}}', ',' ORDER BY category) || '}}' AS document FROM inner_
""")
def audit_document(spark, d):
    return audit.document(_audited(spark, d))


_TYPED = f"""
{c._NEAR}, {_NEAR_IDS}, {c._HASHED},
m AS (SELECT hashed.*, near IS NOT NULL AS has_near FROM hashed LEFT JOIN near_ids USING (doc_id) WHERE doc_id % 50 <> 7),
g AS (SELECT sha256, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT source) AS l FROM m WHERE sha256 IS NOT NULL GROUP BY 1),
k AS (SELECT source, count(*) AS n FROM m WHERE source IS NOT NULL GROUP BY 1), f AS (SELECT l::VARCHAR AS l, count(*) AS n FROM g WHERE l > 1 GROUP BY 1),
q AS (SELECT count(*) AS images, count(DISTINCT source) AS classes, count(DISTINCT doc_id) AS expected, count(*) FILTER (has_near) AS near_images, count(*) - count(DISTINCT doc_id) AS surplus,
  count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS val, count(*) FILTER (split = 'test') AS test, count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS found,
  count(DISTINCT source) FILTER (split = 'train') = count(DISTINCT source) AS in_train, count(DISTINCT source) FILTER (split = 'validation') = count(DISTINCT source) AS in_val, count(DISTINCT source) FILTER (split = 'test') = count(DISTINCT source) AS in_test,
  count(*) FILTER (doc_id IS NULL OR sha256 IS NULL OR source IS NULL OR split IS NULL) = 0 AS complete FROM m),
h AS (SELECT count(*) AS groups, count(*) FILTER (n > 1) AS multi, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS grouped, coalesce(max(n), 0) AS largest, count(*) FILTER (s > 1) AS crossing, count(*) FILTER (l > 1) AS conflicts FROM g)
"""


@query(f"""
WITH {_TYPED} SELECT
  to_json({{'name': 'documents', 'total_images': images, 'number_of_classes': classes, 'classes': (SELECT list(source ORDER BY source) FROM k)}})::VARCHAR AS dataset,
  to_json({{'train': train, 'val': val, 'test': test, 'total': train + val + test}})::VARCHAR AS splits,
  '{{' || (SELECT string_agg('"' || source || '":' || n, ',' ORDER BY source) FROM k) || '}}' AS class_distribution,
  to_json({{'total_groups': groups, 'groups_containing_multiple_images': multi, 'images_in_grouped_samples': grouped, 'maximum_group_size': largest, 'groups_crossing_splits': crossing}})::VARCHAR AS leakage,
  to_json({{'exact_duplicate_images': grouped, 'exact_duplicate_groups': multi, 'near_duplicate_images': near_images, 'near_duplicate_pairs_or_groups': (SELECT count(*) FROM pairs WHERE distance <= 6)}})::VARCHAR AS duplicates,
  '{{"conflicting_groups":' || conflicts || ',"conflict_distribution":{{' || (SELECT string_agg('"' || l || '":' || n, ',' ORDER BY l) FROM f) || '}},"conflicting_group_names":' || (SELECT to_json(list(sha256 ORDER BY sha256)) FROM g WHERE l > 1) || '}}' AS label_conflicts,
  to_json({{'images_expected': expected, 'images_found': found, 'images_missing': expected - found}})::VARCHAR AS files,
  to_json({{'original_manifest_images': (SELECT count(*) FROM documents), 'curated_images': images, 'images_excluded': (SELECT count(*) FROM documents) - images, 'retention_rate_percent': round(100.0 * images / (SELECT count(*) FROM documents), 2)::DOUBLE}})::VARCHAR AS retention,
  to_json({{'required_columns': true, 'missing_required_values': complete, 'duplicate_paths': surplus = 0, 'cross_split_leakage': crossing = 0, 'missing_images': expected = found, 'all_classes_train': in_train, 'all_classes_val': in_val, 'all_classes_test': in_test,
    'overall_integrity': complete AND surplus = 0 AND crossing = 0 AND expected = found AND in_train AND in_val AND in_test, 'label_conflicts_warning': conflicts > 0}})::VARCHAR AS validation
FROM q CROSS JOIN h
""")
def audit_typed(spark, d):
    """The typed audit, its parts as JSON: sources are the classes here, so that groups of copies are in conflict."""
    tables, columns = _manifest(spark, d, label="source")
    found = audit.typed_document(*tables, name="documents", **columns)
    return found.select(*[F.to_json(x).alias(x) for x in found.columns])
