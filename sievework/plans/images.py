"""Queries on files of images that are made of a table's rows: metrics, hashes, model inputs, caches, archives, served documents."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sievework.functions import rasters
from sievework.operators import dedup, pixels, profile, serve
from sievework.plans import catalog as c
from sievework.plans.catalog import query
from sievework.sources import files, storage

SIDE = 8
KINDS = ["bmp", "png", "tiff", "TIF"]
IN_A_FOLDER = 4096


def drawn(df, seed: str = "html", spoiled: bool = False):
    """df with `path` and `content`: a file of SIDE x SIDE pixels whose bytes are digests of a text; every tenth is broken.

    Bytes are multiples of 8, of which no luma lies half-way between two whole numbers.
    A spoiled picture has a first byte of its own. Folders have IN_A_FOLDER files each, so that they can be read a few at a time.
    """

    @F.pandas_udf("binary")
    def image(kind: pd.Series, hexes: pd.Series) -> pd.Series:
        out = []
        for k, digits in zip(kind, hexes, strict=True):
            px = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(SIDE, SIDE, 3) & 0xF8
            out.append({"bmp": rasters.bmp, "png": rasters.png, "tiff": lambda a: rasters.tiff(a, rasters.LZW, predictor=True), "TIF": lambda a: rasters.tiff(a, rasters.PACKBITS, order=">")}[k](px))
        return pd.Series(out)

    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % 4 + 1).cast("int"))
    hexes = F.concat(*[F.sha2(F.concat(seed, F.lit(f".{k}")), 256) for k in range(6)])
    if spoiled:
        hexes = F.concat(F.lpad(F.hex(F.col("page_id") % 8 * 32), 2, "0"), F.substr(hexes, F.lit(3)))
    content = F.when(F.col("page_id") % 10 == 3, F.encode(F.lit("no image"), "US-ASCII")).otherwise(image(kind, hexes))
    return df.withColumn("content", content).withColumn("path", F.concat(F.lit("page/"), F.expr(f"cast(page_id div {IN_A_FOLDER} as string)"), F.lit("/"), F.col("page_id").cast("string"), F.lit("."), kind))


def image_folder(spark, d) -> str:
    root = storage.scratch(spark, "images")
    files.write_files(drawn(c.table(spark, d, "pages")), root)
    return root


_DIGESTS = " || ".join(f"sha256({{t}} || '.{k}')" for k in range(6))
_FILES = f"""
f AS (SELECT page_id, page_id % 10 = 3 AS broken, ['bmp', 'png', 'tiff', 'TIF'][page_id % 4 + 1] AS kind, {_DIGESTS.format(t="html")} AS h FROM pages),
b AS (SELECT *, page_id || '.' || kind AS name, list_transform(range(192), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT // 8 * 8) AS b FROM f),
g AS (SELECT *, list_transform(range(64), lambda i: round(0.299::DOUBLE * b[3 * i + 1] + 0.587::DOUBLE * b[3 * i + 2] + 0.114::DOUBLE * b[3 * i + 3])) AS g FROM b)
"""


@query(f"""
WITH {_FILES},
l AS (SELECT *, list_transform(list_transform(range(36), lambda k: (k // 6 + 1) * 8 + k % 6 + 2), lambda i: g[i - 8] + g[i + 8] + g[i - 1] + g[i + 1] - 4 * g[i]) AS l FROM g),
w AS (SELECT list_transform(range(64), lambda p: list_sum(list_transform(range(4), lambda t: cos(pi() * (p // 8) * (8 * (p % 8) + 2 * t + 1) / 64)))) AS w),
dct AS (SELECT page_id, list_transform(range(64), lambda o: list_sum(list_transform(range(64), lambda p: w[o // 8 * 8 + p // 8 + 1] * w[o % 8 * 8 + p % 8 + 1] * g[p + 1]))) AS low FROM g CROSS JOIN w),
hash AS (SELECT page_id, array_to_string(list_transform(low, lambda x: CASE WHEN x > list_median(low) THEN '1' ELSE '0' END), '') AS phash FROM dct)
SELECT name, CASE WHEN NOT broken THEN 8 END AS width, CASE WHEN NOT broken THEN 8 END AS height, CASE WHEN NOT broken THEN 1.0::DOUBLE END AS aspect_ratio, CASE WHEN NOT broken THEN CASE WHEN kind = 'TIF' THEN 'TIFF' ELSE upper(kind) END END AS format, CASE WHEN NOT broken THEN 'RGB' END AS mode,
       CASE WHEN NOT broken THEN round(list_avg(g), 6) END AS mean_brightness, CASE WHEN NOT broken THEN round(list_var_pop(l), 4) END AS blur_score, CASE WHEN NOT broken THEN phash END AS phash, broken AS failed
FROM l JOIN hash USING (page_id)
""")
def image_files(spark, d):
    """BMP and PNG files through the image source, TIFF files by numpy: size, brightness, sharpness and the DCT hash."""
    found = pixels.inspect_folder(spark, image_folder(spark, d))
    return found.select(
        F.substring_index("path", "/", -1).alias("name"), "width", "height", "aspect_ratio", "format", "mode", F.round("mean_brightness", 6).alias("mean_brightness"), F.round("blur_score", 4).alias("blur_score"),
        F.when(F.col("phash").isNotNull(), F.lpad(F.bin("phash"), 64, "0")).alias("phash"), F.col("error").isNotNull().alias("failed"),
    )


_DCT = """
w AS (SELECT list_transform(range(64), lambda p: list_sum(list_transform(range(4), lambda t: cos(pi() * (p // 8) * (8 * (p % 8) + 2 * t + 1) / 64)))) AS w),
dct AS (SELECT page_id, kind, list_transform(range(64), lambda o: list_sum(list_transform(range(64), lambda p: w[o // 8 * 8 + p // 8 + 1] * w[o % 8 * 8 + p % 8 + 1] * g[p + 1]))) AS low FROM g CROSS JOIN w WHERE NOT broken),
hash AS (SELECT page_id, kind, array_to_string(list_transform(low, lambda x: CASE WHEN x > list_median(low) THEN '1' ELSE '0' END), '') AS phash FROM dct)
"""


def _files_of(seed: str, spoiled: bool = False) -> str:
    out = _FILES.replace("sha256(html ||", f"sha256({seed} ||")
    return out.replace(" AS h FROM pages)", " AS h FROM pages), o AS (SELECT * REPLACE (printf('%02x', page_id % 8 * 32) || substr(h, 3) AS h) FROM f)").replace("AS b FROM f)", "AS b FROM o)") if spoiled else out


def twin_folder(spark, d, spoiled: bool = False) -> str:
    """Eight files in a row show one picture, in all four formats; spoiled ones each a little differently."""
    root = storage.scratch(spark, "twins")
    files.write_files(drawn(c.table(spark, d, "pages").withColumn("twin", F.expr("cast(page_id div 8 as string)")), "twin", spoiled), root)
    return root


@query(f"WITH {_files_of('(page_id // 8)::VARCHAR')}, {_DCT} SELECT phash, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE WHEN kind = 'TIF' THEN 'TIFF' ELSE upper(kind) END))), '|') AS formats FROM hash GROUP BY 1 HAVING count(*) > 1")
def image_hash_groups(spark, d):
    """Files that look alike, whatever their format."""
    found = pixels.inspect_folder(spark, twin_folder(spark, d)).where("phash is not null")
    groups = found.groupBy("phash").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("format")), "|").alias("formats")).where("n > 1")
    return groups.withColumn("phash", F.lpad(F.bin("phash"), 64, "0"))


@query(f"""
WITH {_files_of('(page_id // 8)::VARCHAR', True)}, {_DCT}, r AS (SELECT phash, min(page_id) AS id, count(*) AS n FROM hash GROUP BY 1),
p AS (SELECT x.id AS a, y.id AS b, list_sum(list_transform(range(64), lambda i: CASE WHEN x.phash[i + 1] <> y.phash[i + 1] THEN 1 ELSE 0 END))::INT AS distance, x.n AS n_a, y.n AS n_b FROM r x JOIN r y ON x.id < y.id)
SELECT * FROM p WHERE distance <= 10
""")
def image_near_pairs(spark, d):
    """Pictures whose hashes are near: files to pixels to hashes to pairs, none of them left out."""
    found = pixels.inspect_folder(spark, twin_folder(spark, d, True)).where("phash is not null")
    signed = found.select(F.regexp_extract("path", "([0-9]+)[.][A-Za-z]+$", 1).cast("long").alias("page_id"), F.col("phash").alias("signature"))
    return dedup.near_pairs_exact(storage.written(signed, "hashes"), "page_id")


@query(f"""
WITH {_FILES}, k AS (SELECT CASE WHEN NOT broken THEN CASE WHEN kind = 'TIF' THEN 'TIFF' ELSE upper(kind) END END AS format, CASE WHEN NOT broken THEN 'RGB' END AS mode FROM f)
SELECT 'format' AS key, format AS value, count(*) AS n FROM k GROUP BY format UNION ALL SELECT 'mode', mode, count(*) FROM k GROUP BY mode
""")
def image_formats(spark, d):
    return profile.grouping_profile(pixels.inspect_folder(spark, image_folder(spark, d)), ["format", "mode"])


_CHANNELS = ", ".join(f"CASE WHEN NOT broken THEN list_sum(list_transform(range(64), lambda i: b[3 * i + {k + 1}]))::BIGINT END AS {name}" for k, name in enumerate(("red", "green", "blue")))


@query(f"WITH {_FILES} SELECT name, CASE WHEN NOT broken THEN 150528 END AS n, {_CHANNELS}, CASE WHEN NOT broken THEN b[192]::BIGINT END AS last FROM b")
def image_inputs(spark, d):
    """The 224 x 224, normalised, channel-first copy of each file: its size, and the sums of the pixels that each channel has, as bytes of the file again."""
    wide = pixels.SIDE // SIDE  # each pixel of the file is a square of so many
    kinds = {"n": "int", "red": "long", "green": "long", "blue": "long", "last": "long"}

    def shown(x: np.ndarray) -> list[np.ndarray]:
        planes = x.reshape(-1, 3, pixels.SIDE, pixels.SIDE).transpose(0, 2, 3, 1)
        as_bytes = lambda px: np.rint((px.astype(float) * pixels.STD + pixels.MEAN) * 255).astype(np.int64)
        return [np.full(len(x), x.shape[1], np.int32), *as_bytes(planes[:, ::wide, ::wide]).sum(axis=(1, 2)).T, as_bytes(planes[:, -1, -1])[:, 2]]

    sums = lambda at: pixels.folder_inputs(spark, at, of=(kinds, shown)).select(F.substring_index("path", "/", -1).alias("name"), *kinds)
    return storage.by_slices(spark, image_folder(spark, d), sums, "inputs")


_TWINS = "t AS (SELECT page_id, page_id // 8 AS twin, page_id % 10 = 3 AS broken, ['bmp', 'png', 'tiff', 'TIF'][page_id % 4 + 1] AS kind FROM pages), k AS (SELECT *, CASE WHEN broken THEN 'broken' ELSE kind || twin END AS key FROM t)"


@query(f"""
WITH {_TWINS}, first AS (SELECT key, min(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END) AS batch FROM k GROUP BY 1)
SELECT page_id, batch, CASE WHEN broken THEN NULL ELSE 'class ' || page_id % 5 END AS label, CASE WHEN broken THEN 'read_error' END AS error FROM k JOIN first USING (key)
""")
def image_cache(spark, d):
    """Every third file is cached first, then all: only contents that are new are decoded, files with one content share a row."""
    rows = drawn(c.table(spark, d, "pages").withColumn("twin", F.expr("cast(page_id div 8 as string)")), "twin")
    root, cache = storage.scratch(spark, "images"), storage.scratch(spark, "image-cache")
    files.write_files(rows.where("page_id % 3 = 0"), root)
    pixels.cache_images(spark, root, cache, 1)
    files.write_files(rows.where("page_id % 3 != 0"), root)
    pixels.cache_images(spark, root, cache, 2)
    labelled = rows.select("page_id", "path", F.concat(F.lit("class "), (F.col("page_id") % 5).cast("string")).alias("label"))
    return pixels.cached_rows(labelled, root, cache).select("page_id", "batch", "label", "error")


@query("SELECT doc_id::VARCHAR || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS length, md5(coalesce(text, '')) AS text_md5 FROM documents")
def archive_members(spark, d):
    """All documents as members of ZIP archives, which are read back by stretches of members."""
    root = storage.scratch(spark, "archives")
    docs = c.table(spark, d, "documents").select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    files.write_files(files.pack_archives(docs, limit=1 << 20), root)
    found = files.read_archives(spark, root, prefix="raw/", limit=1 << 16)
    return found.select("path", "length", F.md5("content").alias("text_md5"))


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'first' ELSE 'second' END AS dataset, page_id || ['.JPG', '.png', '.tiff', '.webp', '.txt', '.jpg.zip'][page_id % 6 + 1] AS name, octet_length(encode(url)) AS length FROM pages WHERE page_id % 6 < 4")
def scanned_images(spark, d):
    """Each page's address is a file below one of two roots, a third does not exist; other extensions are left out."""
    root = storage.scratch(spark, "scanned")
    suffix = F.element_at(F.array(*map(F.lit, [".JPG", ".png", ".tiff", ".webp", ".txt", ".jpg.zip"])), (F.col("page_id") % 6 + 1).cast("int"))
    folder = F.concat(F.when(F.col("page_id") % 2 == 0, "one/").otherwise("two/"), (F.col("page_id") % 7).cast("string"), F.lit("/x/"))
    pages = c.table(spark, d, "pages")
    files.write_files(pages, root, F.concat(folder, F.col("page_id").cast("string"), suffix), F.encode("url", "UTF-8"))
    found = storage.scan_files(spark, {"first": f"{root}/one", "second": f"{root}/two", "third": f"{root}/three"})
    return found.select("dataset", F.substring_index("path", "/", -1).alias("name"), "length")


@query("""
WITH s AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT form, i::INT AS class_index, source AS class_name FROM s CROSS JOIN (VALUES ('list'), ('classes'), ('idx_to_class'), ('class_to_idx'), ('digits')) f(form)
""")
def class_mapping_forms(spark, d):
    """The sources of documents as a class mapping, written in five forms of JSON and read again."""
    names = [r[0] for r in c.table(spark, d, "documents").select("source").where("source is not null").distinct().orderBy("source").collect()]
    keyed = {str(i): n for i, n in enumerate(names)}
    forms = {"list": names, "classes": {"classes": names}, "idx_to_class": {"idx_to_class": keyed}, "class_to_idx": {"class_to_idx": {n: i for i, n in enumerate(names)}}, "digits": keyed}
    out = [storage.class_mapping(spark, json.dumps(x)).select(F.lit(k).alias("form"), "class_index", "class_name") for k, x in forms.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3]).unionAll(out[4])


_WHY = serve.WHY.replace("'", "''")


@query(f"""
WITH {c._NAMED}, said AS (SELECT *, vec_id % 100 + 40 AS side, {c._ladder_sql("long")} FROM (SELECT *, confidence_percent AS x FROM named))
SELECT 'vector_' || vec_id || '_result.json' AS file, to_json({{
  'image': 'images/vector_' || vec_id || '.png', 'model': 'linear', 'device': 'cpu',
  'quality': CASE WHEN side < 64 THEN {{'status': 'WARNING', 'message': 'Image resolution is very small.', 'width': side, 'height': 640}} ELSE {{'status': 'OK', 'message': 'Image is readable.', 'width': side, 'height': 640}} END,
  'prediction': prediction, 'confidence': confidence, 'confidence_percent': confidence_percent, 'top_predictions': {c._TOP},
  'why_this_result': printf('{_WHY}', prediction, confidence_percent, long_text),
  'grad_cam': CASE WHEN vec_id % 3 = 0 THEN {{'status': 'UNAVAILABLE', 'message': 'No explanation was generated.', 'path': NULL::VARCHAR}} ELSE {{'status': 'SUCCESS', 'message': 'Grad-CAM explanation generated.', 'path': 'explained/' || vec_id || '.png'}} END,
  'recycling_guidance': coalesce(guidance, '{serve.DEFAULT_GUIDANCE}')}})::VARCHAR AS document
FROM said JOIN (SELECT vec_id, p FROM scored) USING (vec_id) LEFT JOIN (VALUES {', '.join(map(str, c.GUIDANCE))}) g(prediction, guidance) USING (prediction)
""")
def result_files(spark, d):
    """The whole document of each vector, a file each, read back as it was written."""
    rows, i = c.scored(spark, d), F.col("vec_id")
    name = F.concat(F.lit("vector_"), i.cast("string"))
    explained = F.when(i % 3 != 0, F.concat(F.lit("explained/"), i.cast("string"), F.lit(".png")))
    guidance = spark.createDataFrame(c.GUIDANCE, "class string, guidance string")
    served = serve.result_document(rows, "logits", c.NAMES, guidance, F.concat(F.lit("images/"), name, F.lit(".png")), i % 100 + 40, F.lit(640), explained, "linear")
    root = storage.scratch(spark, "results")
    document = F.to_json("result", {"ignoreNullFields": "false"})
    files.write_files(served, root, F.concat(name, F.lit("_result.json")), F.encode(document, "UTF-8"))
    found = spark.read.format("binaryFile").load(root)
    return found.select(F.substring_index("path", "/", -1).alias("file"), F.decode("content", "UTF-8").alias("document"))
