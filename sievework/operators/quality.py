"""Quality flags of records, their status and their histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds of the image rules.
SMALL_SIDE, WIDE, DARK, BRIGHT, BLURRED = 64, 5.0, 25.0, 235.0, 50.0


def flags(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(F.lit(0.0))


def image_rules() -> list[tuple[str, Column]]:
    """On width, height, aspect_ratio, mean_brightness, blur_score, mode and has_transparency."""
    c = F.col
    return [
        ("very_small", (c("width") < SMALL_SIDE) | (c("height") < SMALL_SIDE)),
        ("extreme_aspect_ratio", (c("aspect_ratio") > WIDE) | (c("aspect_ratio") < 1 / WIDE)),
        ("very_dark", c("mean_brightness") < DARK),
        ("very_bright", (c("mean_brightness") >= DARK) & (c("mean_brightness") > BRIGHT)),
        ("blurry", c("blur_score") < BLURRED),
        ("transparency", c("has_transparency")),
        ("non_rgb_mode", c("mode").isin("RGBA", "LA", "P") & ~c("has_transparency")),
    ]


def status(issues: Column, error: Column | None = None) -> Column:
    out = F.when(F.size(issues) > 0, "WARNING").otherwise("OK")
    return F.when(error.isNotNull(), "ERROR").otherwise(out) if error is not None else out


def issue_histogram(df: DataFrame, issues: str = "issues") -> DataFrame:
    """Counts of each issue; `read_error:...` of any kind is one."""
    one = df.select(F.explode(issues).alias("issue")).select(F.when(F.startswith("issue", F.lit("read_error")), "read_error").otherwise(F.col("issue")).alias("issue"))
    return one.groupBy("issue").agg(F.count("*").alias("n"))


def status_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "WARNING", "ERROR")])


def upload_gate(size: Column, extension: Column, width: Column, height: Column, extensions: list[str], most_bytes: int = 10 << 20) -> Column:
    """(valid, message) of an upload: the first rule that fails gives the message."""
    message = (
        F.when(size.isNull(), "file not found")
        .when(size > most_bytes, "file too large")
        .when(~F.lower(extension).isin(extensions), "unsupported type")
        .when(width.isNull() | height.isNull(), "not decodable")
        .when((width < SMALL_SIDE) | (height < SMALL_SIDE) | (width * height < 10_000), "image too small")
    )
    return F.struct(message.isNull().alias("valid"), F.coalesce(message, F.lit("ok")).alias("message"))


def client_gate(mime: Column, size: Column, most_bytes: int = 10 << 20) -> Column:
    """What a page checks before it sends a file: is it said to be an image, and of at most so many bytes?"""
    return F.coalesce(F.startswith(mime, F.lit("image/")) & (size <= most_bytes), F.lit(False))
