"""Queries that meet the odd cases: paths of every layout, broken files, decisions that can't be applied, classes without a mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import paths
from sievework.operators import audit, curate, manifest, quality, serve, taxonomy
from sievework.plans import catalog as c
from sievework.plans.catalog import query
from sievework.sources import storage

# ---------------------------------------------------------------- paths

#: Folders above a page's file, by page_id modulo their number: with and without splits, the dataset in any case, backslashes, a prefix.
LAYOUTS = ["data/raw/ds1/train/Paper/", "ds1/Paper/", "DS1/valid/Metal/", "ds1/test/", "other/val/Glass/", "ds1\\Training\\Plastic\\", "", "ds1/test/train/Tin/", " ds1/validation/val/Can/"]
_LAYOUTS = "[" + ", ".join(f"'{x}'" for x in LAYOUTS) + "]"
_RAW = f"r AS (SELECT page_id, {_LAYOUTS}[page_id % {len(LAYOUTS)} + 1] || page_id || '.JPG' AS path FROM pages)"


def laid_out(spark, d):
    folder = F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("page_id") % len(LAYOUTS) + 1).cast("int"))
    return c.table(spark, d, "pages").select("page_id", F.concat(folder, F.col("page_id").cast("string"), F.lit(".JPG")).alias("path"))


_FOLDERS = f"{_RAW}, n AS (SELECT page_id, replace(trim(path), chr(92), '/') AS p FROM r), s AS (SELECT page_id, p, string_split(p, '/') AS parts, list_transform(string_split(p, '/'), lambda x: lower(x)) AS low FROM n)"
_SPLITS = "['train', 'training', 'val', 'valid', 'validation', 'test', 'testing']"


@query(f"""
WITH {_FOLDERS}, a AS (SELECT *, list_position(low, 'ds1') AS pos FROM s),
k AS (SELECT *, pos + CASE WHEN list_contains({_SPLITS}, low[pos + 1]) THEN 2 ELSE 1 END AS skipped FROM a)
SELECT page_id, CASE WHEN pos > 0 AND skipped < len(parts) THEN parts[skipped] ELSE 'UNKNOWN' END AS class_name, CASE WHEN pos > 0 AND pos + 1 < len(parts) THEN parts[pos + 1] ELSE 'UNKNOWN' END AS plain_class,
       CASE WHEN list_contains(low, 'train') THEN 'train' WHEN list_contains(low, 'test') THEN 'test' WHEN list_contains(low, 'validation') THEN 'validation' WHEN list_contains(low, 'val') THEN 'val' ELSE '' END AS plain_split, parts[len(parts)] AS file_name
FROM k
""")
def path_layouts(spark, d):
    p = paths.normal_path(F.col("path"))
    rows = laid_out(spark, d)
    return rows.select(
        "page_id", paths.class_after(p, "ds1").alias("class_name"), paths.class_after(p, "ds1", skip_split=False).alias("plain_class"), paths.split_of(p, paths.PLAIN_SPLITS, "").alias("plain_split"), paths.file_name(p).alias("file_name")
    )


# ---------------------------------------------------------------- records that fail

_BROKEN = """
q AS (SELECT doc_id, n_chars, lang, CASE doc_id % 11 WHEN 4 THEN 'read_error:OSError' WHEN 7 THEN 'read_error:ValueError' END AS error, n_chars < 300 AS short FROM documents),
f AS (SELECT *, list_filter([CASE WHEN short THEN 'very_small' END, error], lambda x: x IS NOT NULL) AS issues, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN short THEN 'WARNING' ELSE 'OK' END AS status FROM q)
"""


def inspected(spark, d):
    error = F.when(F.col("doc_id") % 11 == 4, "read_error:OSError").when(F.col("doc_id") % 11 == 7, "read_error:ValueError")
    rows = c.table(spark, d, "documents").select("doc_id", "n_chars", "lang", error.alias("error"))
    issues = F.concat(quality.flags([("very_small", F.col("n_chars") < 300)]), F.array_compact(F.array("error")))
    return rows.withColumn("issues", issues).withColumn("status", quality.status(F.col("issues"), F.col("error")))


@query(f"WITH {_BROKEN} SELECT count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'WARNING') AS warning, count(*) FILTER (status = 'ERROR') AS error FROM f")
def broken_summary(spark, d):
    return quality.status_summary(inspected(spark, d))


@query(f"WITH {_BROKEN} SELECT CASE WHEN issue LIKE 'read_error%' THEN 'read_error' ELSE issue END AS issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM f) GROUP BY 1")
def broken_issues(spark, d):
    return quality.issue_histogram(inspected(spark, d))


@query(f"WITH {_BROKEN} SELECT doc_id, error FROM f WHERE status = 'ERROR'")
def broken_rows(spark, d):
    return manifest.with_status(inspected(spark, d), "ERROR").select("doc_id", "error")


@query("""
WITH u AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 1 THEN n_chars END AS size, CASE WHEN doc_id % 13 <> 2 THEN n_chars // 10 END AS w, CASE WHEN doc_id % 13 <> 3 THEN n_chars // 8 END AS h, CASE doc_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' ELSE 'webp' END AS ext,
             CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' WHEN 2 THEN 'image/webp' END AS mime FROM documents)
SELECT doc_id, CASE WHEN size IS NULL THEN 'file not found' WHEN size > 9000 THEN 'file too large' WHEN lower(ext) NOT IN ('png', 'jpg', 'webp') THEN 'unsupported type' WHEN w IS NULL OR h IS NULL THEN 'not decodable' WHEN w < 64 OR h < 64 OR w * h < 10000 THEN 'image too small' ELSE 'ok' END AS message,
       coalesce(mime LIKE 'image/%' AND size <= 9000, false) AS sent
FROM u
""")
def upload_checks(spark, d):
    """Files that are missing, too large, of another type, broken or too small, and what a page would send at all."""
    i, n = F.col("doc_id"), F.col("n_chars")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (i % k + 1).cast("int"))
    size = F.when(i % 13 != 1, n)
    gate = quality.upload_gate(size, pick(["PNG", "jpg", "gif", "webp", "webp"], 5), F.when(i % 13 != 2, F.expr("n_chars div 10")), F.when(i % 13 != 3, F.expr("n_chars div 8")), ["png", "jpg", "webp"], 9000)
    sent = quality.client_gate(pick(["image/png", "text/html", "image/webp", None], 4), size, 9000)
    return c.table(spark, d, "documents").select("doc_id", gate["message"].alias("message"), sent.alias("sent"))


# ---------------------------------------------------------------- decisions

_ODD_DECISIONS = f"""
{c._DECIDED}, known AS (SELECT leakage_group, first_id, low, high FROM conflicts),
odd AS (
  SELECT leakage_group, CASE first_id % 3 WHEN 0 THEN 'MAYBE' ELSE 'ANNOTATION_ERROR' END AS decision, CASE first_id % 3 WHEN 1 THEN ' ' ELSE low END AS keep_class, CASE WHEN first_id % 3 = 2 THEN 'elsewhere' ELSE high END AS exclude_class FROM known
  UNION ALL SELECT leakage_group, 'AMBIGUOUS', NULL, NULL FROM known WHERE first_id % 2 = 0
  UNION ALL SELECT 'absent ' || leakage_group, 'ANNOTATION_ERROR', low, 'elsewhere' FROM known)
"""


def odd_decisions(spark, d):
    known, i = c.decisions(spark, d), F.regexp_extract("reason", "([0-9]+)$", 1).cast("long")
    kind = F.when(i % 3 == 0, "MAYBE").otherwise("ANNOTATION_ERROR")
    one = known.select("leakage_group", kind.alias("decision"), F.when(i % 3 == 1, " ").otherwise(F.col("keep_class")).alias("keep_class"), F.when(i % 3 == 2, "elsewhere").otherwise(F.col("exclude_class")).alias("exclude_class"))
    none = F.lit(None).cast("string")
    two = known.where(i % 2 == 0).select("leakage_group", F.lit("AMBIGUOUS").alias("decision"), none.alias("keep_class"), none.alias("exclude_class"))
    absent = known.select(F.concat(F.lit("absent "), "leakage_group").alias("leakage_group"), F.lit("ANNOTATION_ERROR").alias("decision"), "keep_class", F.lit("elsewhere").alias("exclude_class"))
    return one.unionAll(two).unionAll(absent)


@query(f"""
WITH {_ODD_DECISIONS}
SELECT leakage_group, 'unknown decision' AS problem FROM odd WHERE decision = 'MAYBE'
UNION ALL SELECT leakage_group, 'decided twice' FROM odd GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT leakage_group, 'keep or exclude class is blank' FROM odd WHERE decision = 'ANNOTATION_ERROR' AND trim(keep_class) = ''
UNION ALL SELECT leakage_group, 'excluded class is not in the group' FROM odd WHERE decision = 'ANNOTATION_ERROR' AND exclude_class = 'elsewhere' AND leakage_group IN (SELECT leakage_group FROM known)
""")
def odd_decision_problems(spark, d):
    return curate.check_decisions(c.conflict_rows(spark, d), odd_decisions(spark, d))


@query(f"WITH {_ODD_DECISIONS} SELECT leakage_group, decision FROM odd WHERE leakage_group IN (SELECT leakage_group FROM odd GROUP BY 1 HAVING count(*) > 1)")
def decided_twice(spark, d):
    return manifest.repeated(odd_decisions(spark, d), ["leakage_group"]).select("leakage_group", "decision")


@query(f"WITH {_ODD_DECISIONS}, n AS (SELECT sha256 AS leakage_group, count(*) AS images_in_group FROM hashed GROUP BY 1) SELECT leakage_group, decision, images_in_group FROM odd JOIN n USING (leakage_group)")
def odd_decision_audit(spark, d):
    """Decisions of groups that aren't there are left out."""
    return curate.curation_audit(c.conflict_rows(spark, d), odd_decisions(spark, d)).select("leakage_group", "decision", "images_in_group")


# ---------------------------------------------------------------- checks that raise


def raised(spark, name: str, run, kind: type[Exception]):
    """(name, message): what a check raises, or null."""
    try:
        run()
        message = None
    except kind as e:
        message = str(e)
    return spark.range(1).select(F.lit(name).alias("name"), F.lit(message).cast("string").alias("message"))


@query("""
WITH k AS (SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT 'unmapped classes' AS name, 'unmapped classes: ' || string_agg('events/' || event_type, ', ' ORDER BY event_type) AS message FROM k
UNION ALL SELECT 'all mapped', NULL UNION ALL SELECT 'missing columns', 'missing columns: colour, size' UNION ALL SELECT 'all there', NULL
""")
def raised_checks(spark, d):
    counted, docs = c.event_counts(spark, d), c.documents(spark, d)
    some, every = (taxonomy.mapping_table(spark, rows) for rows in (c.EVENT_CLASSES[:2], [("events", r[0], *["x"] * 7) for r in counted.select("original_class").distinct().collect()]))
    checks = [
        ("unmapped classes", lambda: taxonomy.map_all(counted, some)), ("all mapped", lambda: taxonomy.map_all(counted, every)),
        ("missing columns", lambda: storage.require_columns(docs, ["doc_id", "size", "colour"])), ("all there", lambda: storage.require_columns(docs, ["doc_id", "split"])),
    ]
    out = [raised(spark, name, run, ValueError) for name, run in checks]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


# ---------------------------------------------------------------- places


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents QUALIFY place BETWEEN 17 AND 64")
def rows_of_a_slice(spark, d):
    return manifest.rows_between(c.table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 17, 64).select("doc_id", "place")


@query("SELECT source, arg_min({'v': CASE WHEN doc_id % 3 <> 0 THEN lang END}, doc_id).v AS lang, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY 1")
def first_of_each_source(spark, d):
    """The first row's values, null ones too."""
    rows = c.table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return manifest.first_of_groups(rows, "source", ["lang", "doc_id"], "doc_id").select("source", "lang", "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 50")
def first_missing(spark, d):
    missing = audit.missing_references(c.table(spark, d, "documents").select("doc_id"), c.table(spark, d, "labels"), "doc_id")
    return manifest.first_rows(missing, ["doc_id"], 50)


# ---------------------------------------------------------------- what is printed and reported

_LINE = "' || chr(10) || '"
_QUOTE = "' || chr(39) || '"
_PRINTED = f"""CASE page_id % 6 WHEN 0 THEN 'Grad-CAM explanation: "out/' || page_id || '.png"{_LINE}Explanation: other.png' WHEN 1 THEN 'Done.{_LINE}SAVED to:{_LINE}   out/' || page_id || '.png  '
  WHEN 2 THEN 'explanation : {_QUOTE}none.png{_QUOTE}{_LINE}GRAD-cam :out/' || page_id || '.png' WHEN 3 THEN 'generated  at: {_QUOTE}out/' || page_id || '.png{_QUOTE}{_LINE}saved at: out/0.png' WHEN 4 THEN 'nothing' END"""
_FOUND = ["regexp_extract_all(printed, '(?i)" + p + "', 1)" for p in serve.NAMED_PATHS]


@query(f"""
WITH o AS (SELECT page_id, {_PRINTED} AS printed FROM pages), m AS (SELECT page_id, flatten([{", ".join(_FOUND)}]) AS found FROM o),
p AS (SELECT page_id, unnest(list_transform(found, lambda x: trim(trim(trim(x), '"'), chr(39)))) AS path, generate_subscripts(found, 1) AS place FROM m)
SELECT page_id, arg_min(path, place) AS path FROM p WHERE path IN (SELECT 'out/' || page_id || '.png' FROM pages WHERE page_id % 5 <> 2) GROUP BY 1
""")
def explained_paths(spark, d):
    """The first path that a printed text names, by four patterns, and that exists."""
    pages = c.table(spark, d, "pages")
    rows = pages.select("page_id", serve.named_paths(F.expr(_PRINTED)).alias("paths"))
    there = pages.where("page_id % 5 <> 2").select(F.concat(F.lit("out/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return serve.first_existing(rows, "page_id", "paths", there)


@query("""
SELECT source, round(avg(n_chars), 4) AS mean_chars, NULL::DOUBLE AS worst, list_sort(list_distinct(list(lang))) AS langs, [min(n_chars)::DOUBLE, NULL] AS ends, count(*) FILTER (lang = 'en') AS english
FROM documents GROUP BY source
""")
def nested_report(spark, d):
    """A report of structs, arrays and maps as JSON documents, read back by its schema; what is no number is null at any depth."""
    bad = F.lit(float("nan"))
    rows = c.table(spark, d, "documents").groupBy("source").agg(
        F.struct(F.count("*").alias("n"), F.struct(F.round(F.avg("n_chars"), 4).alias("mean"), bad.alias("worst")).alias("chars")).alias("numbers"), F.array_sort(F.collect_set("lang")).alias("langs"),
        F.array(F.min("n_chars").cast("double"), F.lit(float("-inf"))).alias("ends"), F.create_map(F.lit("en"), F.count_if(F.col("lang") == "en").cast("double"), F.lit("none"), bad).alias("by_lang"),
    )
    path = storage.scratch(spark, "nested")
    storage.write_json_report(rows, path)
    read = spark.read.schema(rows.schema).json(path)
    return read.select("source", F.col("numbers.chars.mean").alias("mean_chars"), F.coalesce("numbers.chars.worst", F.col("by_lang")["none"]).alias("worst"), "langs", "ends", F.col("by_lang")["en"].cast("long").alias("english"))
