"""Named queries over the driver's tables, each with the SQL that must give the same rows.

An image corpus has stand-ins here: a document is an image, its source
the dataset, its language the class, its number of characters the size, a
64-bit SimHash the perceptual hash, the components of an embedding the
class scores, and days of events the epochs of a training history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import paths, scores
from sievework.operators import audit, curate, dedup, evaluate, graph, manifest, profile, quality, serve, split, taxonomy, waste
from sievework.sources.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END"
DOCS = f"docs AS (SELECT doc_id, text, lang, source, n_chars, {SPLIT} AS split FROM documents)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("split", F.expr(SPLIT))


# ---------------------------------------------------------------- profiles


@query("SELECT source AS dataset, lang AS class_name, count(*) AS image_count FROM documents GROUP BY 1, 2")
def class_distribution(spark, d):
    return profile.counts(documents(spark, d), "source", "lang").toDF("dataset", "class_name", "image_count")


@query(f"WITH {DOCS} SELECT source AS dataset, split, count(*) AS image_count FROM docs GROUP BY 1, 2")
def split_distribution(spark, d):
    return profile.counts(documents(spark, d), "source", "split").toDF("dataset", "split", "image_count")


@query(f"WITH {DOCS} SELECT source AS dataset, lang AS original_class, split, count(*) AS image_count FROM docs GROUP BY 1, 2, 3")
def taxonomy_split_counts(spark, d):
    return profile.counts(documents(spark, d), "source", "lang", "split").toDF("dataset", "original_class", "split", "image_count")


@query("""
SELECT source, count(*) AS total, count(*) FILTER (text IS NOT NULL AND n_chars > 0) AS valid, count(*) FILTER (NOT (text IS NOT NULL AND n_chars > 0)) AS corrupt,
       count(*) FILTER (text IS NOT NULL AND n_chars > 0 AND n_chars < 100) AS small, count(DISTINCT lang) AS classes
FROM documents GROUP BY 1
""")
def dataset_summary(spark, d):
    return profile.dataset_summary(documents(spark, d), "source", "lang", F.expr("text is not null and n_chars > 0"), F.col("n_chars") < 100)


@query("SELECT source, min(n_chars) AS min_n_chars, max(n_chars) AS max_n_chars, round(avg(n_chars), 2) AS mean_n_chars, median(n_chars) AS median_n_chars FROM documents WHERE n_chars > 0 GROUP BY 1")
def numeric_profile(spark, d):
    return profile.numeric_profile(documents(spark, d), "source", ["n_chars"], F.col("n_chars") > 0)


@query("SELECT concat(n_chars // 500, 'x', lang) AS dimension, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, dimension LIMIT 10")
def dimension_topk(spark, d):
    return profile.top(documents(spark, d).select(F.concat_ws("x", F.expr("n_chars div 500"), "lang").alias("dimension")), ["dimension"], 10)


@query("SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM documents GROUP BY 1")
def source_shares(spark, d):
    return profile.shares(documents(spark, d), ["source"], [])


@query("SELECT source, lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 2) AS percentage FROM documents GROUP BY 1, 2")
def class_shares(spark, d):
    return profile.shares(documents(spark, d), ["source", "lang"], ["source"])


@query("""
SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'split' END AS key, coalesce(source, lang, split) AS value, count(*) AS n
FROM (SELECT source, lang, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM documents) GROUP BY GROUPING SETS ((source), (lang), (split))
""")
def grouping_profile(spark, d):
    return profile.grouping_profile(documents(spark, d), ["source", "lang", "split"])


_SPLITS = "['train', 'training', 'val', 'valid', 'validation', 'test', 'testing']"


@query(f"""
WITH p AS (SELECT page_id, url, string_split(url, '/') AS parts FROM pages)
SELECT page_id, coalesce(list_filter(parts[1:len(parts) - 1], lambda f: NOT list_contains({_SPLITS}, lower(f)))[-1], 'UNKNOWN') AS class_name,
       parts[-1] AS file_name, regexp_extract(parts[-1], '\\.[^.]+$') AS suffix,
       CASE WHEN list_has_any(list_transform(parts, lambda f: lower(f)), ['train', 'training']) THEN 'train'
            WHEN list_has_any(list_transform(parts, lambda f: lower(f)), ['validation', 'val', 'valid']) THEN 'validation'
            WHEN list_has_any(list_transform(parts, lambda f: lower(f)), ['test', 'testing']) THEN 'test' ELSE 'unspecified' END AS split,
       concat('UNIQUE_', left(md5(url), 12)) AS singleton
FROM p
""")
def path_columns(spark, d):
    u = paths.normal_path(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", paths.deepest_class(u).alias("class_name"), paths.file_name(u).alias("file_name"), paths.suffix(u).alias("suffix"), paths.split_of(u).alias("split"), paths.singleton_id(u).alias("singleton")
    )


# ---------------------------------------------------------------- quality

_FLAGS = r"""
flags AS (
  SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'very_short' END, CASE WHEN n_chars > 20000 THEN 'very_long' END,
      CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.6 * length(text) THEN 'few_letters' END,
      CASE WHEN len(list_distinct(string_split(text, chr(10)))) < 0.8 * len(string_split(text, chr(10))) THEN 'repeated_lines' END], lambda x: x IS NOT NULL) AS issues
  FROM documents)
"""


def flagged(spark, d):
    lines = F.split("text", "\n")
    rules = [
        ("very_short", F.col("n_chars") < 200),
        ("very_long", F.col("n_chars") > 20000),
        ("few_letters", F.length(F.regexp_replace("text", "[^A-Za-z]", "")) < 0.6 * F.length("text")),
        ("repeated_lines", F.size(F.array_distinct(lines)) < 0.8 * F.size(lines)),
    ]
    return documents(spark, d).select("doc_id", quality.flags(rules).alias("issues")).withColumn("status", quality.status(F.col("issues")))


@query(f"WITH {_FLAGS} SELECT doc_id, CASE WHEN len(issues) > 0 THEN 'WARNING' ELSE 'OK' END AS status, array_to_string(issues, ' | ') AS issues FROM flags")
def quality_flags(spark, d):
    return flagged(spark, d).select("doc_id", "status", F.array_join("issues", " | ").alias("issues"))


@query(f"WITH {_FLAGS} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM flags) GROUP BY 1")
def quality_issue_histogram(spark, d):
    return quality.issue_histogram(flagged(spark, d))


@query(f"WITH {_FLAGS} SELECT count(*) AS total, count(*) FILTER (len(issues) = 0) AS ok, count(*) FILTER (len(issues) > 0) AS warning, count(*) FILTER (false) AS error FROM flags")
def quality_summary(spark, d):
    return quality.status_summary(flagged(spark, d))


@query("""
SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'file too large' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported type' WHEN n_chars // 10 < 64 OR n_chars // 8 < 64 OR (n_chars // 10) * (n_chars // 8) < 10000 THEN 'image too small' ELSE 'ok' END AS message
FROM documents
""")
def upload_gate(spark, d):
    gate = quality.upload_gate(F.col("n_chars"), F.col("lang"), F.expr("n_chars div 10"), F.expr("n_chars div 8"), ["en", "de", "fr"], 20000)
    return documents(spark, d).select("doc_id", gate["message"].alias("message"))


@query("SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS nulls FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents")
def null_audit(spark, d):
    return audit.null_counts(documents(spark, d), ["doc_id", "text", "lang"])


@query("SELECT CAST(count(*) - count(DISTINCT text) - CASE WHEN count(*) > count(text) THEN 1 ELSE 0 END AS BIGINT) AS surplus FROM documents")
def duplicate_key_audit(spark, d):
    return audit.surplus_copies(documents(spark, d), "text")


# ---------------------------------------------------------------- duplicates


@query("""
SELECT sha256(text) AS sha256, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT source) > 1 AS cross_source, min(doc_id) AS first_doc
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def exact_duplicate_groups(spark, d):
    docs = documents(spark, d).where("text is not null")
    g = docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.min("doc_id").alias("first_doc"))
    return g.where("n > 1").withColumn("cross_source", F.col("n_sources") > 1)


_HASHED = f"{DOCS}, hashed AS (SELECT *, sha256(text) AS sha256 FROM docs)"


def hashed(spark, d):
    return documents(spark, d).withColumn("sha256", F.sha2("text", 256)).drop("text")


@query(f"""
WITH {_HASHED}, g AS (SELECT sha256, count(*) AS group_size, row_number() OVER (ORDER BY min(doc_id)) AS duplicate_group FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, duplicate_group, group_size FROM hashed JOIN g USING (sha256)
""")
def exact_duplicates(spark, d):
    return dedup.exact_groups(hashed(spark, d), "sha256", "doc_id").select("doc_id", F.col("duplicate_group").cast("long"), "group_size")


def _simhash_sql() -> str:
    sections = []
    for s in range(4):
        bits = []
        for i in range(4):
            for k in range(4):
                digit = f"instr('0123456789abcdef', substr(h, {4 * s + i + 1}, 1)) - 1"
                bits.append(f"CASE WHEN 2 * sum((({digit}) >> {k}) & 1) > count(*) THEN {1 << (4 * (3 - i) + k)} ELSE 0 END")
        sections.append(" + ".join(bits) + f" AS s{s}")
    return rf"""
tok AS (SELECT doc_id, md5(unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\w]+'), lambda x: x <> '')))) AS h FROM documents),
sig AS (SELECT doc_id, {", ".join(sections)} FROM tok GROUP BY 1),
reps AS (SELECT s0, s1, s2, s3, min(doc_id) AS rep, count(*) AS n FROM sig GROUP BY ALL),
pairs AS (SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.s0, b.s0)) + bit_count(xor(a.s1, b.s1)) + bit_count(xor(a.s2, b.s2)) + bit_count(xor(a.s3, b.s3)) AS INT) AS distance, a.n AS n_a, b.n AS n_b
          FROM reps a JOIN reps b ON a.rep < b.rep AND (a.s0 = b.s0 OR a.s1 = b.s1 OR a.s2 = b.s2 OR a.s3 = b.s3))
"""


_NEAR = _simhash_sql()


def signed(spark, d, *more):
    return dedup.simhash(documents(spark, d), "doc_id", "text", *more)


@query(f"WITH {_NEAR} SELECT * FROM pairs WHERE distance <= 6")
def near_duplicates_strong(spark, d):
    return dedup.near_pairs(signed(spark, d), "doc_id", dedup.STRONG)


@query(f"WITH {_NEAR} SELECT * FROM pairs WHERE distance BETWEEN 7 AND 10")
def near_duplicates_review(spark, d):
    return dedup.near_pairs(signed(spark, d), "doc_id").where(F.col("distance") > dedup.STRONG)


@query(f"""
WITH {_NEAR} SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.s0, b.s0)) + bit_count(xor(a.s1, b.s1)) + bit_count(xor(a.s2, b.s2)) + bit_count(xor(a.s3, b.s3)) AS INT) AS distance, a.n AS n_a, b.n AS n_b
FROM reps a JOIN reps b ON a.rep < b.rep AND bit_count(xor(a.s0, b.s0)) + bit_count(xor(a.s1, b.s1)) + bit_count(xor(a.s2, b.s2)) + bit_count(xor(a.s3, b.s3)) <= 10
""")
def near_duplicates_exact(spark, d):
    """All pairs up to the review distance; the SQL compares every two signatures."""
    return dedup.near_pairs_exact(written(signed(spark, d), "simhash"), "doc_id")


@query(f"""
WITH {_NEAR}, {_HASHED}, g AS (SELECT count(*) AS n, count(DISTINCT source) AS k FROM hashed WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1),
owned AS (SELECT r.rep, d.source FROM sig s JOIN reps r USING (s0, s1, s2, s3) JOIN documents d USING (doc_id)),
across AS (SELECT p.distance FROM pairs p JOIN owned x ON x.rep = p.a JOIN owned y ON y.rep = p.b WHERE x.source IS DISTINCT FROM y.source)
SELECT 'records' AS metric, count(*) AS value FROM documents
UNION ALL SELECT 'exact_groups', count(*) FROM g UNION ALL SELECT 'exact_records', coalesce(sum(n), 0)::BIGINT FROM g UNION ALL SELECT 'exact_cross_source_groups', count(*) FILTER (k > 1) FROM g
UNION ALL SELECT 'equal_signature_pairs', coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM reps
UNION ALL SELECT 'strong_pairs', coalesce(sum(n_a * n_b) FILTER (distance <= 6), 0)::BIGINT FROM pairs UNION ALL SELECT 'review_pairs', coalesce(sum(n_a * n_b) FILTER (distance BETWEEN 7 AND 10), 0)::BIGINT FROM pairs
UNION ALL SELECT 'strong_cross_source_pairs', count(*) FILTER (distance <= 6) FROM across UNION ALL SELECT 'review_cross_source_pairs', count(*) FILTER (distance BETWEEN 7 AND 10) FROM across
""")
def duplicate_summary(spark, d):
    docs = hashed(spark, d)
    g = docs.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("source").alias("k")).where("n > 1")
    sig = written(signed(spark, d, "source"), "simhash")
    near = dedup.pairs_across(written(dedup.near_pairs(sig, "doc_id", dedup.REVIEW, "signature_a", "signature_b"), "pairs"), sig, "source")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = [
        docs.agg(F.count("*").alias("records")),
        g.agg(F.count("*").alias("exact_groups"), zero(F.sum("n")).alias("exact_records"), F.count_if(F.col("k") > 1).alias("exact_cross_source_groups")),
        sig.groupBy("signature").agg(F.count("*").alias("n")).agg(zero(F.sum(F.expr("n * (n - 1) div 2"))).alias("equal_signature_pairs")),
        near.agg(*[zero(F.sum(F.when(within, F.expr(n)))).alias(f"{kind}_{name}") for n, name in (("n_a * n_b", "pairs"), ("n_across", "cross_source_pairs")) for kind, within in (("strong", F.col("distance") <= dedup.STRONG), ("review", F.col("distance") > dedup.STRONG))]),
    ]
    out = None
    for s in sums:
        part = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in s.columns])))
        out = part if out is None else out.union(part)
    return out


def grouped(spark, d):
    return dedup.group_audit(hashed(spark, d), "sha256", ["lang", "source", "split"])


_AUDIT = f"{_HASHED}, g AS (SELECT sha256, count(*) AS n, list_sort(list_distinct(list(lang))) AS langs, list_sort(list_distinct(list(source))) AS sources, list_sort(list_distinct(list(split))) AS splits FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {_AUDIT} SELECT sha256, n, array_to_string(langs, '|') AS all_labels FROM g WHERE len(langs) > 1")
def duplicate_label_conflicts(spark, d):
    return grouped(spark, d).where(F.size("langs") > 1).select("sha256", "n", F.array_join("langs", "|").alias("all_labels"))


@query(f"WITH {_AUDIT} SELECT sha256, n, array_to_string(splits, '|') AS splits FROM g WHERE list_contains(splits, 'train') AND (list_contains(splits, 'test') OR list_contains(splits, 'validation'))")
def split_leakage(spark, d):
    return grouped(spark, d).where(dedup.leaks(F.col("splits"))).select("sha256", "n", F.array_join("splits", "|").alias("splits"))


@query(f"WITH {_AUDIT} SELECT sha256, n, array_to_string(sources, '|') AS datasets_in_group FROM g WHERE len(sources) > 1")
def cross_source_duplicates(spark, d):
    return grouped(spark, d).where(F.size("sources") > 1).select("sha256", "n", F.array_join("sources", "|").alias("datasets_in_group"))


@query(f"WITH {_AUDIT} SELECT count(*) AS groups, count(*) FILTER (len(langs) > 1) AS label_conflicts, count(*) FILTER (list_contains(splits, 'train') AND (list_contains(splits, 'test') OR list_contains(splits, 'validation'))) AS split_leaks, count(*) FILTER (len(sources) > 1) AS cross_source FROM g")
def duplicate_audit_summary(spark, d):
    return grouped(spark, d).agg(F.count("*").alias("groups"), F.count_if(F.size("langs") > 1).alias("label_conflicts"), F.count_if(dedup.leaks(F.col("splits"))).alias("split_leaks"), F.count_if(F.size("sources") > 1).alias("cross_source"))


@query(f"WITH {_NEAR} SELECT count(*) AS near_images FROM (SELECT a FROM pairs WHERE distance <= 10 UNION SELECT b FROM pairs WHERE distance <= 10)")
def near_duplicate_images(spark, d):
    p = dedup.near_pairs(signed(spark, d), "doc_id")
    return p.select("a").union(p.select("b")).distinct().agg(F.count("*").alias("near_images"))


# ---------------------------------------------------------------- taxonomy

EVENT_CLASSES = [
    ("events", "view", "Browse", "Page view", "train", "S0", "keep", "HIGH"),
    ("events", "click", "Browse", "Click", "train", "S0", "keep", "HIGH"),
    ("events", "signup", "Convert", "Sign-up", "train", "S1", "keep", "HIGH"),
    ("events", "purchase", "Convert", "Purchase", "train", "S1", "keep", "MEDIUM"),
]
_MAP = "tax AS (SELECT * FROM (VALUES " + ", ".join(map(str, EVENT_CLASSES)) + ") t(dataset, original_class, unified_parent, unified_class, training_role, safety_level, disposal_group, mapping_confidence)), src AS (SELECT 'events' AS dataset, event_type AS original_class, count(*) AS source_count FROM events GROUP BY ALL)"


def event_counts(spark, d):
    return table(spark, d, "events").groupBy(F.lit("events").alias("dataset"), F.col("event_type").alias("original_class")).agg(F.count("*").alias("source_count"))


@query(f"WITH {_MAP} SELECT src.*, unified_parent, unified_class, training_role, safety_level, disposal_group, mapping_confidence FROM src JOIN tax USING (dataset, original_class)")
def taxonomy_map(spark, d):
    return taxonomy.map_classes(event_counts(spark, d), taxonomy.mapping_table(spark, EVENT_CLASSES))


@query(f"WITH {_MAP} SELECT * FROM src ANTI JOIN tax USING (dataset, original_class)")
def taxonomy_unmapped(spark, d):
    return taxonomy.unmapped(event_counts(spark, d), taxonomy.mapping_table(spark, EVENT_CLASSES))


@query(f"WITH {_MAP} SELECT unified_parent, unified_class, sum(source_count)::BIGINT AS n FROM src JOIN tax USING (dataset, original_class) GROUP BY 1, 2")
def taxonomy_rollup(spark, d):
    return taxonomy.rollup(taxonomy_map(spark, d))


_WASTE = "waste AS (SELECT * FROM (VALUES " + ", ".join(str((i, *r)) for i, r in enumerate((t[0], t[1], t[3]) for t in waste.TAXONOMY)) + f") t(i, dataset, original_class, unified_class)), src AS (SELECT dataset, original_class, count(*) AS source_count FROM documents JOIN waste ON i = doc_id % {len(waste.TAXONOMY)} GROUP BY 1, 2)"


@query(f"WITH {_WASTE} SELECT unified_class, sum(source_count)::BIGINT AS n FROM src JOIN waste USING (dataset, original_class) GROUP BY 1")
def waste_taxonomy_rollup(spark, d):
    """Each document is an image of one of the source classes; all are counted and mapped."""
    rules = F.array(*[F.struct(F.lit(a).alias("dataset"), F.lit(b).alias("original_class")) for a, b, *_ in waste.TAXONOMY])
    own = documents(spark, d).select(F.element_at(rules, (F.col("doc_id") % len(waste.TAXONOMY) + 1).cast("int")).alias("r"))
    src = own.groupBy(F.upper("r.dataset").alias("dataset"), F.col("r.original_class").alias("original_class")).agg(F.count("*").alias("source_count"))
    return taxonomy.rollup(taxonomy.map_classes(src, waste.taxonomy(spark))).select("unified_class", "n")


@query("SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS class_index FROM (SELECT DISTINCT lang FROM documents)")
def class_index(spark, d):
    from pyspark.sql import Window

    return documents(spark, d).select("lang").distinct().withColumn("class_index", (F.dense_rank().over(Window.orderBy("lang")) - 1).cast("long"))


# ---------------------------------------------------------------- groups and splits

_COMPONENTS = f"""
{_NEAR}, {_HASHED},
star AS (SELECT min(doc_id) OVER (PARTITION BY sha256) AS a, doc_id AS b FROM hashed),
samesig AS (SELECT r.rep AS a, s.doc_id AS b FROM sig s JOIN reps r USING (s0, s1, s2, s3)),
near AS (SELECT a, b FROM pairs WHERE distance <= 6 UNION SELECT a, b FROM samesig WHERE a <> b),
edges AS (SELECT a, b FROM near UNION SELECT a, b FROM star WHERE a <> b),
ties AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nties AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS id, a AS other FROM ties UNION SELECT reach.id, ties.b FROM reach JOIN ties ON reach.other = ties.a),
nreach AS (SELECT a AS id, a AS other FROM nties UNION SELECT nreach.id, nties.b FROM nreach JOIN nties ON nreach.other = nties.a),
leak AS (SELECT id, min(other) AS root FROM reach GROUP BY 1),
nleak AS (SELECT id, min(other) AS root FROM nreach GROUP BY 1),
members AS (SELECT d.doc_id, d.lang, d.source, d.split, d.sha256, coalesce('GROUP_' || root, concat('UNIQUE_', left(md5(d.doc_id::VARCHAR), 12))) AS leakage_group FROM hashed d LEFT JOIN leak ON leak.id = d.doc_id)
"""


def near_edges(spark, d):
    sig = written(signed(spark, d), "simhash")
    pairs = dedup.near_pairs(sig, "doc_id", dedup.STRONG).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return pairs.union(dedup.star_edges(sig, "signature", "doc_id"))


def members(spark, d):
    """documents with their leakage group: exact and strong near duplicates together, others alone."""
    docs = hashed(spark, d)
    edges = near_edges(spark, d).union(dedup.star_edges(docs.where("sha256 is not null"), "sha256", "doc_id"))
    roots = graph.components(edges)
    rows = docs.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return rows.withColumn("leakage_group", F.coalesce(F.concat(F.lit("GROUP_"), F.col("root").cast("string")), paths.singleton_id(F.col("doc_id").cast("string")))).select("doc_id", "lang", "source", "split", "sha256", "leakage_group")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, leakage_group FROM members")
def leakage_groups(spark, d):
    return members(spark, d).select("doc_id", "leakage_group")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT id AS doc_id, printf('NEAR_%05d', dense_rank() OVER (ORDER BY root)) AS near_group FROM nleak")
def near_components(spark, d):
    roots = graph.components(near_edges(spark, d))
    # One order over the groups, not over their members.
    named = manifest.numbered(roots.select("root").distinct(), ["root"], "n").select("root", paths.padded_id("NEAR", F.col("n")).alias("near_group"))
    return roots.join(named, "root").select(F.col("id").alias("doc_id"), "near_group")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT leakage_group, count(*) AS image_count, array_to_string(list_sort(list_distinct(list(source))), '|') AS datasets, array_to_string(list_sort(list_distinct(list(lang))), '|') AS unified_classes, count(*) > count(DISTINCT sha256) AS has_exact_duplicate FROM members GROUP BY 1")
def group_report(spark, d):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return members(spark, d).groupBy("leakage_group").agg(
        F.count("*").alias("image_count"), joined("source").alias("datasets"), joined("lang").alias("unified_classes"), (F.count("*") > F.countDistinct("sha256")).alias("has_exact_duplicate")
    )


_GREEDY = f"""
{_HASHED}, sizes AS (SELECT sha256, count(*) AS n FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('42' || sha256), sha256) AS i, sum(n) OVER () AS total FROM sizes),
walk AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS sha256, NULL::VARCHAR AS split, 0.70 * (SELECT max(total) FROM ranked)::DOUBLE AS tr, 0.15 * (SELECT max(total) FROM ranked)::DOUBLE AS va, 0.15 * (SELECT max(total) FROM ranked)::DOUBLE AS te
  UNION ALL
  SELECT r.i, r.sha256, CASE WHEN tr >= va AND tr >= te THEN 'train' WHEN va >= te THEN 'validation' ELSE 'test' END,
         CASE WHEN tr >= va AND tr >= te THEN tr - r.n ELSE tr END, CASE WHEN NOT (tr >= va AND tr >= te) AND va >= te THEN va - r.n ELSE va END, CASE WHEN NOT (tr >= va AND tr >= te) AND NOT va >= te THEN te - r.n ELSE te END
  FROM walk JOIN ranked r ON r.i = walk.i + 1)
"""


def exact_split(spark, d):
    groups = hashed(spark, d).where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"))
    return split.greedy_split(groups, "sha256", "n")


@query(f"WITH RECURSIVE {_GREEDY} SELECT sha256, split FROM walk WHERE i > 0")
def group_split(spark, d):
    return exact_split(spark, d)


@query(f"WITH RECURSIVE {_GREEDY} SELECT walk.split, hashed.source, hashed.lang, count(*) AS image_count FROM walk JOIN hashed USING (sha256) GROUP BY 1, 2, 3")
def manifest_summary(spark, d):
    docs = hashed(spark, d).drop("split").join(exact_split(spark, d), "sha256")
    return docs.groupBy("split", "source", "lang").agg(F.count("*").alias("image_count"))


# ---------------------------------------------------------------- curation and audit

_CONFLICTS = f"{_HASHED}, conflicts AS (SELECT sha256 AS leakage_group, count(doc_id) AS image_count, count(DISTINCT source) AS class_count, array_to_string(list_sort(list_distinct(list(source))), ' | ') AS classes, array_to_string(list_sort(list(doc_id)), ' | ') AS images, min(doc_id) AS first_id, min(source) AS low, max(source) AS high FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1)"


def conflict_rows(spark, d):
    return hashed(spark, d).select(F.col("sha256").alias("leakage_group"), "doc_id", F.col("source").alias("unified_class"))


@query(f"WITH {_CONFLICTS} SELECT leakage_group, image_count, class_count, classes, images FROM conflicts")
def conflict_groups(spark, d):
    return curate.conflict_groups(conflict_rows(spark, d), "leakage_group", "unified_class", "doc_id")


@query(f"WITH {_CONFLICTS} SELECT class_count, count(*) AS n_groups FROM conflicts GROUP BY 1")
def conflict_histogram(spark, d):
    return curate.conflict_histogram(conflict_groups(spark, d))


_DECIDED = f"{_CONFLICTS}, decisions AS (SELECT leakage_group, CASE first_id % 4 WHEN 0 THEN 'LEGITIMATE_DIFFERENCE' WHEN 1 THEN 'ANNOTATION_ERROR' WHEN 2 THEN 'AMBIGUOUS' ELSE 'NEEDS_REVIEW' END AS decision, concat('reason ', first_id) AS reason, 'REVIEWED' AS action, low AS keep_class, high AS exclude_class FROM conflicts)"


def decisions(spark, d):
    g = conflict_rows(spark, d).where("leakage_group is not null").groupBy("leakage_group").agg(F.min("doc_id").alias("i"), F.min("unified_class").alias("keep_class"), F.max("unified_class").alias("exclude_class")).where("keep_class != exclude_class")
    kind = F.element_at(F.array(*map(F.lit, curate.DECISIONS)), (F.col("i") % 4 + 1).cast("int"))
    return g.select("leakage_group", kind.alias("decision"), F.concat(F.lit("reason "), F.col("i").cast("string")).alias("reason"), F.lit("REVIEWED").alias("action"), "keep_class", "exclude_class")


_CURATED = f"""
{_DECIDED}, curated AS (
  SELECT doc_id, source AS unified_class,
    CASE WHEN decision = 'ANNOTATION_ERROR' AND source = exclude_class THEN 'EXCLUDE' WHEN decision = 'AMBIGUOUS' THEN 'KEEP_HARD_CASE' WHEN decision = 'NEEDS_REVIEW' THEN 'HOLD' ELSE 'KEEP' END AS curation_status,
    CASE WHEN decision IS NULL OR (decision = 'ANNOTATION_ERROR' AND source NOT IN (keep_class, exclude_class)) THEN '' ELSE reason END AS curation_reason,
    CASE WHEN decision = 'ANNOTATION_ERROR' AND source = exclude_class THEN action WHEN decision = 'ANNOTATION_ERROR' AND source = keep_class THEN 'KEEP_CORRECT_LABEL' WHEN decision = 'LEGITIMATE_DIFFERENCE' THEN 'KEEP' WHEN decision IN ('AMBIGUOUS', 'NEEDS_REVIEW') THEN action ELSE '' END AS curation_action
  FROM hashed LEFT JOIN decisions ON hashed.sha256 = decisions.leakage_group)
"""


def curated(spark, d):
    return curate.curate(conflict_rows(spark, d), decisions(spark, d))


@query(f"WITH {_CURATED} SELECT * FROM curated")
def curation(spark, d):
    return curated(spark, d).drop("leakage_group")


@query(f"WITH {_DECIDED} SELECT decisions.*, images_in_group FROM decisions JOIN (SELECT sha256 AS leakage_group, count(*) AS images_in_group FROM hashed GROUP BY 1) USING (leakage_group)")
def curation_audit(spark, d):
    return curate.curation_audit(conflict_rows(spark, d), decisions(spark, d))


@query(f"WITH {_CURATED} SELECT count(*) FILTER (curation_status = 'EXCLUDE') AS excluded, count(*) FILTER (curation_status <> 'EXCLUDE') AS kept FROM curated")
def curation_result(spark, d):
    return curate.curation_result(curated(spark, d))


@query(f"WITH {_CURATED} SELECT count(*) AS original, count(*) FILTER (curation_status <> 'EXCLUDE') AS curated, count(*) FILTER (curation_status = 'EXCLUDE') AS removed, round(100.0 * count(*) FILTER (curation_status <> 'EXCLUDE') / count(*), 2) AS retention_percent FROM curated")
def retention(spark, d):
    return audit.retention(documents(spark, d), curated(spark, d).where("curation_status != 'EXCLUDE'"))


@query(f"WITH {DOCS} SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM docs GROUP BY 1")
def class_split_crosstab(spark, d):
    return audit.crosstab(documents(spark, d), "lang", "split", ["train", "validation", "test"])


@query(f"WITH {DOCS} SELECT l.source, s.split FROM (SELECT DISTINCT source FROM docs) l, (VALUES ('train'), ('validation'), ('test'), ('holdout')) s(split) WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.source = l.source AND docs.split = s.split)")
def class_presence(spark, d):
    return audit.absent_classes(documents(spark, d), "source", "split", ["train", "validation", "test", "holdout"])


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_references(spark, d):
    return audit.missing_references(documents(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(f"WITH {_HASHED}, g AS (SELECT count(*) AS n FROM hashed WHERE sha256 IS NOT NULL GROUP BY sha256) SELECT count(*) AS total_groups, count(*) FILTER (n > 1) AS multi_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_multi, max(n) AS largest FROM g")
def group_stats(spark, d):
    return audit.group_stats(hashed(spark, d), "sha256")


@query(f"WITH {_HASHED} SELECT sha256, count(DISTINCT split) AS n_splits FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def cross_split_groups(spark, d):
    return audit.cross_split_groups(hashed(spark, d), "sha256", "split")


@query(f"""
WITH {_HASHED}, c AS (
  SELECT 'required_columns_not_null' AS check_name, count(*) FILTER (doc_id IS NULL) + count(*) FILTER (sha256 IS NULL) + count(*) FILTER (split IS NULL) + count(*) FILTER (lang IS NULL) AS violations FROM hashed
  UNION ALL SELECT 'keys_unique', count(*) - count(DISTINCT doc_id) FROM hashed
  UNION ALL SELECT 'groups_in_one_split', count(*) FROM (SELECT sha256 FROM hashed WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'known_splits', count(*) FILTER (split NOT IN ('train', 'validation', 'test')) FROM hashed
  UNION ALL SELECT 'classes_in_all_splits', count(*) FROM (SELECT DISTINCT lang FROM hashed) l, (VALUES ('train'), ('validation'), ('test')) s(split) WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.lang = l.lang AND h.split = s.split))
SELECT check_name, violations = 0 AS passed, violations FROM c UNION ALL SELECT 'all', sum(violations) = 0, sum(violations)::BIGINT FROM c
""")
def integrity_audit(spark, d):
    return audit.integrity_checks(hashed(spark, d), "doc_id", "sha256", "split", "lang", ["train", "validation", "test"])


# ---------------------------------------------------------------- evaluation and serving

_SCORED = """
raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ex AS (SELECT vec_id, label, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM raw),
probs AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex),
scored AS (SELECT vec_id, label, p, list_position(p, list_max(p)) - 1 AS predicted FROM probs)
"""
NAMES = [f"class {i}" for i in range(60)]
GUIDANCE = [("class 0", "Keep dry."), ("class 1", "Rinse first."), ("class 3", "Take to a collection point.")]


def scored(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", "label", v.alias("logits"), scores.softmax(v).alias("p"), scores.argmax(v).alias("predicted"))


@query(f"WITH {_SCORED}, ranked AS (SELECT vec_id, i - 1 AS class_index, p[i] AS x, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS rank FROM scored, generate_series(1, 64) t(i)) SELECT vec_id, rank, class_index::INT AS class_index, round(x, 6) AS confidence FROM ranked WHERE rank <= 3")
def softmax_topk(spark, d):
    return scored(spark, d).select("vec_id", F.posexplode(scores.top_k(F.col("p"), 3)).alias("i", "s")).select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("s")["index"].cast("int").alias("class_index"), F.round(F.col("s")["value"], 6).alias("confidence"))


_CELLS = f"{_SCORED}, cells AS (SELECT a.i::INT AS actual, b.i::INT AS predicted, count(s.vec_id) AS n FROM generate_series(0, 63) a(i) CROSS JOIN generate_series(0, 63) b(i) LEFT JOIN scored s ON s.label = a.i AND s.predicted = b.i GROUP BY 1, 2)"


def cells(spark, d):
    return evaluate.confusion(scored(spark, d), "label", "predicted", list(range(64)))


@query(f"WITH {_CELLS} SELECT * FROM cells")
def confusion_matrix(spark, d):
    return cells(spark, d)


_REPORT = f"""
{_CELLS}, t AS (SELECT actual AS c, sum(n)::DOUBLE AS support, sum(n) FILTER (actual = predicted)::DOUBLE AS tp FROM cells GROUP BY 1),
k AS (SELECT predicted AS c, sum(n)::DOUBLE AS called FROM cells GROUP BY 1),
pr AS (SELECT c, support, tp, CASE WHEN called = 0 THEN 0 ELSE tp / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM t JOIN k USING (c)),
m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
report AS (
  SELECT c::VARCHAR AS label, precision, recall, f1, support FROM m
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m),
rounded AS (SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report)
"""


def report(spark, d):
    r = evaluate.classification_report(cells(spark, d))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_REPORT} SELECT * FROM rounded")
def classification_report(spark, d):
    return report(spark, d)


@query(f"WITH {_REPORT} SELECT * FROM rounded WHERE NOT regexp_matches(label, '(?i)accuracy|macro avg|weighted avg') ORDER BY f1, label LIMIT 3")
def weakest_classes(spark, d):
    return evaluate.weakest(report(spark, d), 3)


_HISTORY = "history AS (SELECT epoch, round(avg(value), 6) AS val_loss FROM (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS epoch, value FROM events) GROUP BY 1)"


def history(spark, d):
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000L")
    return table(spark, d, "events").groupBy(hour.cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("val_loss"))


@query(f"""
WITH {_HISTORY}, a AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, min(val_loss) OVER (ORDER BY epoch) AS best FROM history),
b AS (SELECT *, prior IS NULL OR val_loss < prior AS improved FROM a), c AS (SELECT *, i - max(CASE WHEN improved THEN i END) OVER (ORDER BY epoch) AS since FROM b),
e AS (SELECT *, coalesce(sum(CASE WHEN since >= 4 THEN 1 ELSE 0 END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM c)
SELECT epoch, val_loss, improved, best, since FROM e WHERE stops = 0
""")
def early_stopping(spark, d):
    return evaluate.early_stopping(history(spark, d), "val_loss", 4).select("epoch", "val_loss", "improved", "best", F.col("since").cast("long").alias("since"))


@query(f"""
WITH RECURSIVE {_HISTORY}, h AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i FROM history),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS epoch, NULL::DOUBLE AS val_loss, 'infinity'::DOUBLE AS best, 0 AS bad, 0.1::DOUBLE AS used, 0.1::DOUBLE AS lr
  UNION ALL
  SELECT h.i, h.epoch, h.val_loss, least(best, h.val_loss), CASE WHEN h.val_loss < best THEN 0 WHEN bad + 1 > 2 THEN 0 ELSE bad + 1 END, lr, CASE WHEN h.val_loss < best THEN lr WHEN bad + 1 > 2 THEN lr * 0.5 ELSE lr END
  FROM walk JOIN h ON h.i = walk.i + 1)
SELECT epoch, val_loss, used AS learning_rate FROM walk WHERE i > 0
""")
def plateau_lr(spark, d):
    return evaluate.plateau_lr(history(spark, d), "val_loss", 0.1)


@query(f"""
WITH {_SCORED}, q AS (SELECT p, list_transform(p, lambda x: round(x, 2)) AS q FROM scored)
SELECT round(max(list_max(list_transform(generate_series(1, 64), lambda i: abs(p[i] - q[i])))), 6) AS max_abs_difference, count(*) FILTER (list_position(p, list_max(p)) = list_position(q, list_max(q))) AS same_argmax, count(*) AS n FROM q
""")
def scorer_parity(spark, d):
    rows = scored(spark, d).select("p", F.transform("p", lambda x: F.round(x, 2)).alias("q"))
    return evaluate.parity(rows, "p", "q").withColumn("max_abs_difference", F.round("max_abs_difference", 6))


_NAMED = f"{_SCORED}, named AS (SELECT vec_id, predicted, CASE WHEN predicted < 60 THEN concat('class ', predicted) ELSE concat('Unknown Class ', predicted) END AS prediction, round(list_max(p), 6) AS confidence, round(100 * list_max(p), 2) AS confidence_percent FROM scored)"


def served(spark, d):
    guidance = spark.createDataFrame(GUIDANCE, "class string, guidance string")
    return serve.serving_row(scored(spark, d), "logits", NAMES, guidance)


@query(f"WITH {_NAMED} SELECT vec_id, prediction, confidence, confidence_percent, coalesce(guidance, '{serve.DEFAULT_GUIDANCE}') AS guidance FROM named LEFT JOIN (VALUES {', '.join(map(str, GUIDANCE))}) g(prediction, guidance) USING (prediction)")
def guidance_lookup(spark, d):
    return served(spark, d).select("vec_id", "prediction", "confidence", "confidence_percent", "guidance")


def _ladder_sql(name: str) -> str:
    *steps, (_, last) = scores.LADDERS[name]
    return "CASE " + " ".join(f"WHEN x >= {least} THEN '{text}'" for least, text in steps) + f" ELSE '{last}' END AS {name}_text"


@query(f"WITH {_NAMED} SELECT vec_id, {', '.join(map(_ladder_sql, scores.LADDERS))} FROM (SELECT vec_id, confidence_percent * 20 AS x FROM named)")
def confidence_ladder(spark, d):
    x = F.col("confidence_percent") * 20
    return served(spark, d).select("vec_id", *[scores.ladder(x, name).alias(f"{name}_text") for name in scores.LADDERS])


@query(f"WITH {_NAMED} SELECT vec_id, CASE WHEN contains(prediction, 'unknown') THEN 'x' WHEN contains(lower(prediction), 'unknown') THEN 'Ask first.' WHEN contains(lower(prediction), 'class') THEN 'See the list.' ELSE 'none' END AS advice FROM named")
def guidance_rules(spark, d):
    return served(spark, d).select("vec_id", serve.guidance_rules(F.col("prediction"), [("unknown", "Ask first."), ("class", "See the list.")], "none").alias("advice"))


_TOP = "list_transform(list_slice(list_sort(list_transform(p, lambda x, i: {'v': -x, 'i': i - 1})), 1, 3), lambda s: {'class': CASE WHEN s.i < 60 THEN concat('class ', s.i) ELSE concat('Unknown Class ', s.i) END, 'confidence': round(-s.v, 6), 'confidence_percent': round(-100 * s.v, 2), 'class_index': s.i})"


@query(f"""
WITH {_NAMED}, worded AS (SELECT *, {_ladder_sql("long")} FROM (SELECT *, confidence_percent AS x FROM named))
SELECT vec_id, to_json({{'prediction': prediction, 'confidence': confidence, 'confidence_percent': confidence_percent, 'top_predictions': {_TOP}, 'confidence_text': long_text, 'guidance': coalesce(guidance, '{serve.DEFAULT_GUIDANCE}')}})::VARCHAR AS document
FROM worded JOIN (SELECT vec_id, p FROM scored) USING (vec_id) LEFT JOIN (VALUES {', '.join(map(str, GUIDANCE))}) g(prediction, guidance) USING (prediction)
""")
def serving_json(spark, d):
    return served(spark, d).select("vec_id", "document")


@query("SELECT round(sum(value * user_id) / sum(user_id), 6) AS mean_loss FROM events")
def weighted_loss(spark, d):
    return evaluate.weighted_loss(table(spark, d, "events"), "value", "user_id").select(F.round("mean_loss", 6).alias("mean_loss"))


@query(f"WITH {_NAMED} SELECT vec_id, u.c AS prediction, u.g AS guidance FROM named JOIN (VALUES {', '.join(str((i, c, g)) for i, (c, g) in enumerate(sorted(waste.GUIDANCE.items())))}) u(i, c, g) ON u.i = named.predicted % 16")
def waste_guidance(spark, d):
    rows = scored(spark, d).select("vec_id", F.element_at(F.array(*map(F.lit, sorted(waste.GUIDANCE))), F.col("predicted") % 16 + 1).alias("prediction"))
    return serve.with_guidance(rows, waste.guidance(spark)).select("vec_id", "prediction", "guidance")


@query(f"WITH {_REPORT} SELECT metric, label, value FROM (UNPIVOT rounded ON precision, recall, f1, support INTO NAME metric VALUE value)")
def report_long(spark, d):
    return report(spark, d).unpivot("label", ["precision", "recall", "f1", "support"], "metric", "value")


@query("""
WITH s AS (SELECT page_id, url, string_split(url, '/')[3] AS host, 10 * (contains(url, 'a'))::INT + 5 * (contains(url, 'grad'))::INT + 3 * (contains(url, 'e'))::INT AS score FROM pages)
SELECT host, arg_max(url, (score, page_id)) AS best FROM s GROUP BY 1
""")
def best_match(spark, d):
    u = F.col("url")
    weight = lambda part, w: F.when(F.contains(u, F.lit(part)), w).otherwise(0)
    rows = table(spark, d, "pages").select("page_id", u, F.try_element_at(F.split(u, "/"), F.lit(3)).alias("host"), (weight("a", 10) + weight("grad", 5) + weight("e", 3)).alias("score"))
    return rows.groupBy("host").agg(F.max_by("url", F.struct("score", "page_id")).alias("best"))


_LINK, _TITLE = r'(?i)href\s*=\s*"([^"]*)"', "(?i)<title>([^<]*)</title>"


@query(f"SELECT page_id, len(regexp_extract_all(html, '{_LINK}', 1)) AS n_links, regexp_extract(html, '{_TITLE}', 1) AS title FROM pages")
def text_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(_LINK), 1)).cast("long").alias("n_links"), F.regexp_extract("html", _TITLE, 1).alias("title"))


from sievework.plans import cases as _cases, histories as _histories, images as _images, manifest as _more, stored as _stored  # noqa: E402, F401  register their queries
