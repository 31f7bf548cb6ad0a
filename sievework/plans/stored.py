"""Queries that go through files: CSV, JSON, caches, images, models and served documents, written to the shared folder and read back."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import scores
from sievework.operators import pixels, serve, taxonomy, waste
from sievework.plans import catalog as c
from sievework.plans.catalog import query
from sievework.sources import storage
from sievework.streaming import serve as stream_serve

# ---------------------------------------------------------------- CSV


def _documents_csv(spark, d):
    path = storage.scratch(spark, "documents-csv")
    rows = c.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    storage.write_csv(rows, path, single=False)
    return path, rows.schema


@query("SELECT doc_id, nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars, md5(nullif(text, '')) AS text_md5 FROM documents")
def csv_typed(spark, d):
    path, schema = _documents_csv(spark, d)
    return storage.read_csv(spark, path, schema, strict=True).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("SELECT doc_id::VARCHAR AS doc_id, nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars::VARCHAR AS n_chars FROM documents")
def csv_strings(spark, d):
    path, _ = _documents_csv(spark, d)
    return storage.read_csv(spark, path).select("doc_id", "lang", "source", "n_chars")


@query("""
WITH l AS (SELECT doc_id, nullif(lang, '') AS lang FROM documents)
SELECT 'preferred' AS source, lang, count(*) AS n FROM l WHERE doc_id % 2 = 0 GROUP BY lang UNION ALL SELECT 'fallback', lang, count(*) FROM l GROUP BY lang
""")
def chosen_inputs(spark, d):
    """A curated file is read in place of the base one where it exists; an optional one that doesn't adds no rows."""
    base, curated, none = (storage.scratch(spark, x) for x in ("base", "curated", "none"))
    docs = c.table(spark, d, "documents").select("doc_id", "lang")
    storage.write_csv(docs, base, single=False)
    storage.write_csv(docs.where("doc_id % 2 = 0"), curated, single=False)
    read = {"preferred": [curated, base], "fallback": [none, base]}
    counted = [storage.read_preferred(spark, paths, schema=docs.schema).groupBy(F.lit(k).alias("source"), "lang").agg(F.count("*").alias("n")) for k, paths in read.items()]
    missing = storage.read_optional(spark, none, docs.schema).groupBy(F.lit("optional").alias("source"), "lang").agg(F.count("*").alias("n"))
    return counted[0].unionAll(counted[1]).unionAll(missing)


_ODD_LINES = "CASE doc_id % 7 WHEN 2 THEN doc_id || ',en' WHEN 3 THEN doc_id || ',\"a,b\",src,5,6' WHEN 4 THEN doc_id || ',en,src,many' WHEN 5 THEN 'x' || doc_id || ',en,src,5' ELSE doc_id || ',\"l,' || lang || '\",' || source || ',' || n_chars END"


@query("""
SELECT doc_id % 7 AS kind, CASE doc_id % 7 WHEN 2 THEN 'too few columns' WHEN 3 THEN 'too many columns' WHEN 4 THEN 'no bigint in n_chars' WHEN 5 THEN 'no bigint in doc_id' ELSE 'good' END AS reason, count(*) AS n, sum(doc_id)::BIGINT AS ids,
       CASE WHEN doc_id % 7 IN (2, 3, 4, 5) THEN count(*) END AS lines
FROM documents GROUP BY 1, 2
""")
def csv_quarantine(spark, d):
    """Four of seven lines are bad, each in its way; good rows and quarantined ones, whose lines are found again by file and number."""
    path = storage.scratch(spark, "odd-csv")
    lines = c.table(spark, d, "documents").select("doc_id", F.expr(_ODD_LINES).alias("value"))
    head = spark.range(1).select(F.lit("doc_id,lang,source,n_chars").alias("value"))
    for k in range(3):
        head.unionAll(lines.where(F.col("doc_id") % 3 == k).select("value")).coalesce(1).write.mode("append").text(path)
    good, bad = storage.read_guarded(spark, path, T.StructType.fromDDL("doc_id long, lang string, source string, n_chars long"))
    i = F.regexp_extract("record", "^x?([0-9]+)", 1).cast("long")
    seen = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("all"))
    # The line of that number in that file is the record.
    found = bad.join(seen, "file").withColumn("same", F.element_at("all", F.col("line").cast("int")) == F.col("record"))
    bad = found.groupBy((i % 7).alias("kind"), "reason").agg(F.count("*").alias("n"), F.sum(i).alias("ids"), F.count_if("same").alias("lines"))
    none = F.lit(None).cast("long").alias("lines")
    return bad.unionAll(good.groupBy((F.col("doc_id") % 7).alias("kind"), F.lit("good").alias("reason")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).withColumn("lines", none))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def stream_unique(spark, d):
    """Events that come again in later files, and after a restart of the stream: the sink has each once."""
    source, sink, state = (storage.scratch(spark, x) for x in ("arrivals", "unique", "state"))
    rows = c.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def arrive(some):
        some.coalesce(2).write.mode("append").parquet(source)

    def follow():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
        stream_serve.start_once(stream_serve.unique_uploads(stream, "event_id", "ts", "400 days"), sink, state).awaitTermination()

    arrive(rows.where("event_id % 2 = 0"))
    arrive(rows.where("event_id % 3 = 0"))
    follow()
    arrive(rows)
    follow()
    return stream_serve.read_sink(spark, sink, rows.schema).select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- JSON


@query("SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, NULL::DOUBLE AS no_number FROM documents GROUP BY source")
def json_report(spark, d):
    path = storage.scratch(spark, "report")
    rows = c.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.lit(float("nan")).alias("no_number"))
    storage.write_json_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


# ---------------------------------------------------------------- served documents

_DOCUMENT = "prediction string, confidence double, confidence_percent double, top_predictions array<struct<class: string, confidence: double, confidence_percent: double, class_index: int>>, confidence_text string, guidance string"


@query(f"""
WITH {c._NAMED}, ranked AS (SELECT vec_id, i - 1 AS class_index, p[i] AS x, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS rank FROM scored, generate_series(1, 64) t(i)),
tops AS (SELECT vec_id, list(class_index::INT ORDER BY rank) AS top_classes, list(round(x, 6) ORDER BY rank) AS top_confidences FROM ranked WHERE rank <= 3 GROUP BY 1),
said AS (SELECT *, {c._ladder_sql("long")} FROM (SELECT *, confidence_percent AS x FROM named))
SELECT 'vector_' || vec_id || '_result.json' AS file, prediction, confidence, confidence_percent, long_text AS confidence_text, coalesce(guidance, '{serve.DEFAULT_GUIDANCE}') AS guidance, top_classes, top_confidences
FROM said JOIN tops USING (vec_id) LEFT JOIN (VALUES {", ".join(map(str, c.GUIDANCE))}) g(prediction, guidance) USING (prediction)
""")
def prediction_files(spark, d):
    path = storage.scratch(spark, "results")
    storage.write_results(c.served(spark, d).withColumn("stem", F.concat(F.lit("vector_"), F.col("vec_id").cast("string"))), path)
    rows = storage.read_results(spark, path, _DOCUMENT)
    return rows.select("file", "prediction", "confidence", "confidence_percent", "confidence_text", "guidance", F.col("top_predictions.class_index").alias("top_classes"), F.col("top_predictions.confidence").alias("top_confidences"))


_NAME = "lower(split_part(url, '/', 3)) || CASE page_id % 5 WHEN 0 THEN '_grad_cam.png' WHEN 1 THEN '_WHY.png' WHEN 2 THEN '_cam.png' ELSE '.png' END"
_STEM = "CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', 3) ELSE 'another stem' END"


@query(f"""
WITH f AS (SELECT page_id % 40 AS image, page_id % 7 AS mtime, page_id, {_NAME} AS name, {_STEM} AS stem FROM pages),
s AS (SELECT *, 10 * contains(lower(name), lower(stem))::INT + 5 * contains(lower(name), 'grad')::INT + 5 * contains(lower(name), 'cam')::INT + 3 * contains(lower(name), 'why')::INT AS score FROM f)
SELECT image, arg_max(name, (score, mtime, page_id)) AS best FROM s WHERE score > 0 GROUP BY image
""")
def newest_match(spark, d):
    files = c.table(spark, d, "pages").select((F.col("page_id") % 40).alias("image"), (F.col("page_id") % 7).alias("mtime"), "page_id", F.expr(_NAME).alias("name"), F.expr(_STEM).alias("stem"))
    return serve.best_match(files, "image", "name", "stem", ["mtime", "page_id"])


_SOURCES = f"(VALUES {', '.join(str((i, *t)) for i, t in enumerate(waste.TAXONOMY))}) w(i, {', '.join(taxonomy.COLUMNS)})"


@query(f"""
SELECT doc_id, unified_class, training_role, mapping_confidence, mapping_reason, CASE {" ".join(f"WHEN contains(lower(unified_class), '{part}') THEN '{text}'" for part, text in waste.WEB_GUIDANCE)} ELSE '{waste.WEB_DEFAULT}' END AS advice
FROM documents JOIN {_SOURCES} ON i = doc_id % {len(waste.TAXONOMY)}
""")
def waste_advice(spark, d):
    """Each document is an image of one of the source classes: its mapping, with the reason, and what the web page says."""
    rules = F.array(*[F.struct(F.lit(a).alias("dataset"), F.lit(b).alias("original_class")) for a, b, *_ in waste.TAXONOMY])
    rows = c.table(spark, d, "documents").select("doc_id", F.element_at(rules, (F.col("doc_id") % len(waste.TAXONOMY) + 1).cast("int")).alias("r")).select("doc_id", "r.*")
    mapped = taxonomy.map_classes(rows, waste.taxonomy(spark))
    return mapped.select("doc_id", "unified_class", "training_role", "mapping_confidence", "mapping_reason", serve.guidance_rules(F.col("unified_class"), waste.WEB_GUIDANCE, waste.WEB_DEFAULT).alias("advice"))


# ---------------------------------------------------------------- images and models


@query("""
WITH h AS (SELECT doc_id, text IS NULL AS none, doc_id % 10 = 3 AS broken, sha256(text) || sha256(text || '.') AS h FROM documents),
b AS (SELECT *, list_transform(range(64), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT) AS b FROM h WHERE NOT none AND NOT broken),
l AS (SELECT doc_id, b, list_transform(list_transform(range(36), lambda k: (k // 6 + 1) * 8 + k % 6 + 2), lambda i: b[i - 8] + b[i + 8] + b[i - 1] + b[i + 1] - 4 * b[i]) AS l FROM b)
SELECT doc_id::VARCHAR AS path, 8 AS width, 8 AS height, 1.0::DOUBLE AS aspect_ratio, 'PPM' AS format, 'L' AS mode, round(list_avg(b), 6) AS mean_brightness, round(list_var_pop(l), 4) AS blur_score, NULL::VARCHAR AS error FROM l
UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN broken THEN 'read_error:ValueError' ELSE 'read_error:TypeError' END FROM h WHERE none OR broken
""")
def image_metrics(spark, d):
    """The digests of a text are the pixels of a gray image; every tenth file is broken."""
    planes = F.concat(F.encode(F.lit("P5 8 8 255\n"), "US-ASCII"), F.unhex(F.sha2("text", 256)), F.unhex(F.sha2(F.concat("text", F.lit(".")), 256)))
    content = F.when(F.col("doc_id") % 10 == 3, F.encode(F.lit("no image"), "US-ASCII")).otherwise(planes)
    files = c.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return pixels.inspect_images(files).drop("phash").withColumns({"mean_brightness": F.round("mean_brightness", 6), "blur_score": F.round("blur_score", 4)})


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
y AS (SELECT vec_id, list_transform(range(10), lambda k: k + list_sum(list_transform(range(64), lambda j: v[j + 1] * ((31 * k + 17 * j) % 7 - 3)))) AS y FROM v)
SELECT vec_id, (list_position(y, list_max(y)) - 1)::INT AS predicted, list_max(y)::DOUBLE AS logit FROM y
""")
def forward_pass(spark, d):
    """A linear classifier, written as a model file, loaded by each task and applied in batches."""
    k, j = np.ogrid[:10, :64]
    file = io.BytesIO()
    np.savez(file, weight=((31 * k + 17 * j) % 7 - 3).astype(np.float32), bias=np.arange(10, dtype=np.float32))
    path = f"{storage.scratch(spark, 'model')}/linear.npz"
    storage.put_file(spark, path, file.getvalue())
    x = F.transform("embedding", lambda x: F.floor(64 * x).cast("float"))
    rows = pixels.classify(c.table(spark, d, "embeddings").select("vec_id", x.alias("x")), path)
    return rows.select("vec_id", scores.argmax(F.col("logits")).alias("predicted"), F.array_max("logits").cast("double").alias("logit"))


@query(f"SELECT vec_id, label, {c.SPLIT.replace('doc_id', 'vec_id')} AS split, round(embedding[1]::DOUBLE, 5) AS x FROM embeddings WHERE vec_id % 20 < 14 OR vec_id % 20 >= 17")
def split_cache(spark, d):
    """A cache with a folder for each split; two of the three are read."""
    path = storage.scratch(spark, "cache")
    rows = c.table(spark, d, "embeddings").withColumn("split", F.expr(c.SPLIT.replace("doc_id", "vec_id")))
    storage.write_split_cache(rows, path)
    read = [storage.read_split_cache(spark, path, s) for s in ("train", "test")]
    return read[0].unionByName(read[1]).select("vec_id", "label", "split", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("x"))
