"""Rows as they are served: prediction, confidence in words, guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scores import class_name, ladder, softmax, top_k

DEFAULT_GUIDANCE = "No guidance for this class."


def with_guidance(df: DataFrame, guidance: DataFrame, key: str = "prediction", default: str = DEFAULT_GUIDANCE) -> DataFrame:
    """Left lookup of (class, guidance), with a default. The list is as short as there are classes."""
    g = guidance.select(F.col("class").alias(key), "guidance")
    return df.join(g, key, "left").withColumn("guidance", F.coalesce("guidance", F.lit(default)))


def guidance_rules(name: Column, rules: list[tuple[str, str]], default: str = DEFAULT_GUIDANCE) -> Column:
    """The first rule whose text is part of the name, in any case."""
    out = F.lit(default)
    for part, text in reversed(rules):
        out = F.when(F.contains(F.lower(name), F.lit(part)), text).otherwise(out)
    return out


def predictions(df: DataFrame, logits: str, names: list[str], k: int = 3) -> DataFrame:
    """df with prediction, confidence (6 digits), confidence_percent (2 digits) and top_predictions."""
    p = softmax(F.col(logits))
    every = F.array(*map(F.lit, names))
    rows = df.withColumn("_p", p).withColumn("_top", top_k(F.col("_p"), k))
    best = F.element_at("_top", 1)
    made = F.transform("_top", lambda s: F.struct(class_name(s["index"], every).alias("class"), F.round(s["value"], 6).alias("confidence"), F.round(100 * s["value"], 2).alias("confidence_percent"), s["index"].cast("int").alias("class_index")))
    return rows.withColumns({"prediction": class_name(best["index"], every), "confidence": F.round(best["value"], 6), "confidence_percent": F.round(100 * best["value"], 2), "top_predictions": made}).drop("_p", "_top")


def serving_row(df: DataFrame, logits: str, names: list[str], guidance: DataFrame, k: int = 3) -> DataFrame:
    """df with the JSON document of each prediction; no state, so it runs on streams too."""
    rows = with_guidance(predictions(df, logits, names, k), guidance)
    document = F.struct("prediction", "confidence", "confidence_percent", "top_predictions", ladder(F.col("confidence_percent")).alias("confidence_text"), "guidance")
    return rows.withColumn("document", F.to_json(document))


# What a served document says of the image's quality, of the prediction and of its explanation.
LEAST_SIDE = 64
SMALL, READABLE = ("WARNING", "Image resolution is very small."), ("OK", "Image is readable.")
EXPLAINED = ("SUCCESS", "Grad-CAM explanation generated.")
NOT_EXPLAINED = ("UNAVAILABLE", "No explanation was generated.")
WHY = "The model classified the image as '%s' with %.2f%% confidence. %s The Grad-CAM heatmap highlights regions of the image that contributed most strongly to the prediction."


def _said(texts: tuple[str, str]) -> list[Column]:
    return [F.lit(texts[0]).alias("status"), F.lit(texts[1]).alias("message")]


def result_document(df: DataFrame, logits: str, names: list[str], guidance: DataFrame, image: Column, width: Column, height: Column, explanation: Column, model: str, device: str = "cpu", k: int = 3) -> DataFrame:
    """df with `result`, the whole document of each image as a struct.

    image, model, device, quality, prediction, confidence, confidence_percent,
    top_predictions, why_this_result, grad_cam, recycling_guidance. The quality
    is a warning where a side is under LEAST_SIDE pixels; an image without a
    width, which could not be read, has no document. `explanation` is the path
    of the image's explanation, or null.
    """
    given = {"_image": image, "_width": width.cast("int"), "_height": height.cast("int"), "_explanation": explanation.cast("string")}
    rows = with_guidance(predictions(df.withColumns(given), logits, names, k), guidance)
    w, h, path = F.col("_width"), F.col("_height"), F.col("_explanation")
    size = [w.alias("width"), h.alias("height")]
    quality = F.when(F.least(w, h) < LEAST_SIDE, F.struct(*_said(SMALL), *size)).otherwise(F.struct(*_said(READABLE), *size))
    shown = F.when(path.isNull(), F.struct(*_said(NOT_EXPLAINED), path.alias("path"))).otherwise(F.struct(*_said(EXPLAINED), path.alias("path")))
    why = F.format_string(WHY, F.col("prediction"), F.col("confidence_percent"), ladder(F.col("confidence_percent")))
    result = F.struct(
        F.col("_image").alias("image"), F.lit(model).alias("model"), F.lit(device).alias("device"), quality.alias("quality"), "prediction", "confidence", "confidence_percent", "top_predictions",
        why.alias("why_this_result"), shown.alias("grad_cam"), F.col("guidance").alias("recycling_guidance"),
    )
    return rows.withColumn("result", F.when(w.isNotNull() & h.isNotNull(), result)).drop(*given)


# How a path is named in what an explanation prints, the first pattern first.
NAMED_PATHS = [r"Grad-CAM explanation\s*:\s*(.+)", r"Grad-CAM\s*:\s*(.+)", r"explanation\s*:\s*(.+)", r"(?:generated|saved)\s+(?:to|at)\s*:\s*(.+)"]


def named_paths(output: Column) -> Column:
    """The paths that a text names, in any case, by the patterns in their order; blanks and then quotes around them go."""
    found = F.concat(*[F.regexp_extract_all(output, F.lit("(?i)" + p), 1) for p in NAMED_PATHS])
    bare = lambda x, ends: F.regexp_replace(x, f"^[{ends}]+|[{ends}]+$", "")
    return F.transform(found, lambda x: bare(bare(bare(x, r"\s"), '"'), "'"))


def first_existing(df: DataFrame, key: str, paths: str, files: DataFrame, path: str = "path") -> DataFrame:
    """(key, path): of each row's list of paths the first that is among the files; keys without one have no row."""
    named = df.select(key, F.posexplode(paths).alias("place", path)).join(files.select(path), path, "left_semi")
    return named.groupBy(key).agg(F.min_by(path, "place").alias(path))


def best_match(files: DataFrame, key: str, name: str, stem: str, newest: list[str]) -> DataFrame:
    """(key, best): the name that goes best with the stem of its key, of equal ones the newest; keys without any score have no row."""
    low = F.lower(name)
    # What parts of a file name count.
    parts = [(F.lower(stem), 10), (F.lit("grad"), 5), (F.lit("cam"), 5), (F.lit("why"), 3)]
    score = sum((F.when(F.contains(low, part), n).otherwise(0) for part, n in parts), F.lit(0))
    rows = files.select(key, F.col(name).alias("best"), F.struct(score.alias("score"), *newest).alias("rank")).where("rank.score > 0")
    return rows.groupBy(key).agg(F.max_by("best", "rank").alias("best"))
