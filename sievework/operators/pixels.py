"""Metrics of image files: size, brightness, sharpness, perceptual hash, model input, class scores.

JPEG, PNG, GIF and BMP files are decoded by Spark's own image decoder on the
JVM; TIFF, PPM and PGM files, and BMP and PNG files where only bytes are at
hand, with numpy. Files that can't be decoded, WebP among them, give an error in the row.
"""

from __future__ import annotations

import io
import math
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.rasters import read_png, read_tiff
from sievework.sources import storage

# Channel means and deviations of the usual photo normalisation, and luma weights.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LUMA = (0.299, 0.587, 0.114)
SIDE = 224
MODEL_BYTES = 512 << 20
INPUTS_AT_ONCE = 64

SCHEMA = "path string, width int, height int, aspect_ratio double, format string, mode string, mean_brightness double, blur_score double, phash long, error string"


def decode(content: bytes) -> tuple[np.ndarray, str, str]:
    """(height, width, 3) bytes, format and mode."""
    if m := re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", content):
        channels = 3 if m[1] == b"6" else 1
        w, h = int(m[2]), int(m[3])
        px = np.frombuffer(content, np.uint8, w * h * channels, m.end()).reshape(h, w, channels)
        return np.repeat(px, 3, axis=2) if channels == 1 else px, "PPM", "RGB" if channels == 3 else "L"
    if content[:2] == b"BM":
        at, w, h, bits, packed = *struct.unpack_from("<I", content, 10), *struct.unpack_from("<ii", content, 18), *struct.unpack_from("<HI", content, 28)
        if bits != 24 or packed:
            raise ValueError("unsupported BMP")
        line = (w * 3 + 3) // 4 * 4
        px = np.frombuffer(content, np.uint8, line * abs(h), at).reshape(abs(h), line)[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1]
        return px[::-1] if h > 0 else px, "BMP", "RGB"
    if content[:4] in (b"II*\0", b"MM\0*"):
        px, mode = read_tiff(content)
        return px, "TIFF", mode
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        px, mode = read_png(content)
        return px, "PNG", mode
    raise ValueError("unknown format")


def luma(px: np.ndarray) -> np.ndarray:
    return np.round(px @ np.array(LUMA))


def blur(gray: np.ndarray) -> float | None:
    """The variance of the Laplacian; none for images under 3 pixels."""
    if min(gray.shape) < 3:
        return None
    g = gray.astype(float)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def areas(px: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows and columns of resize(), and which of them stands in each row and in each column."""
    rows = np.unique(np.linspace(0, px.shape[0], height, endpoint=False).astype(int), return_inverse=True)
    cols = np.unique(np.linspace(0, px.shape[1], width, endpoint=False).astype(int), return_inverse=True)
    sums = np.add.reduceat(np.add.reduceat(px.astype(float), rows[0], axis=0), cols[0], axis=1)
    n = np.outer(np.diff(np.append(rows[0], px.shape[0])), np.diff(np.append(cols[0], px.shape[1])))
    small = sums / (n[:, :, None] if px.ndim == 3 else n)
    return small, rows[1], cols[1]


def resize(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target pixel covers, or the nearest pixel where it covers less than one."""
    small, rows, cols = areas(px, height, width)
    return small[rows][:, cols]


@lru_cache(64)
def _cosines(h: int, w: int) -> np.ndarray:
    """(h * w, 64): what each different pixel of a 32 x 32 copy, which has h rows and w columns of them, weighs in each coefficient."""
    sums = []
    for n in (h, w):
        weight = np.zeros((8, n))
        for k, row in enumerate(np.linspace(0, n, 32, endpoint=False).astype(int)):
            weight[:, row] += [math.cos(math.pi * o * (2 * k + 1) / 64) for o in range(8)]
        sums.append(weight)
    return np.einsum("ar,bc->rcab", *sums).reshape(h * w, 64)


def phash(gray: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest DCT coefficients of a 32 x 32 copy are above their median.

    Coefficients can be equal but for rounding, so the order of the sums is a
    part of the hash: the cosines of equal rows and columns first, one after
    the other, then the pixels, row by row.
    """
    small = areas(gray, 32, 32)[0]
    low = np.add.reduce(_cosines(*small.shape) * small.reshape(-1, 1), axis=0)
    a, b = np.sort(low)[31:33]
    return int(np.packbits(low > a + (b - a) * 0.5).view(">i8")[0])


def normalised(px: np.ndarray) -> np.ndarray:
    """Channel-first, normalised values of a SIDE x SIDE copy, as floats; what the copy repeats is computed once."""
    small, rows, cols = areas(px, SIDE, SIDE)
    small = ((small / 255 - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)
    return small.take(cols, axis=2).take(rows, axis=1).ravel()


def model_input(content: bytes) -> list[float]:
    """Channel-first, normalised values of a SIDE x SIDE copy."""
    return normalised(decode(content)[0]).tolist()


def inspect_image(path: str, content: bytes) -> tuple:
    try:
        px, kind, mode = decode(bytes(content))
        return measured(path, px, kind, mode)
    except Exception as e:  # a broken file is a row, not a failed job
        return path, None, None, None, None, None, None, None, None, f"read_error:{type(e).__name__}"


def from_planes(height: int, width: int, channels: int, data: bytes) -> tuple[np.ndarray, str]:
    """(height, width, 3) bytes and mode of what Spark's image source gives: rows of gray, BGR or BGRA bytes."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(px, 3, axis=2), "L"
    return px[:, :, 2::-1], "RGBA" if channels == 4 else "RGB"


def measured(path: str, px: np.ndarray, kind: str, mode: str) -> tuple:
    h, w = px.shape[:2]
    gray = luma(px)
    return path, w, h, w / h if h else 0.0, kind, mode, float(gray.mean()), blur(gray), phash(gray), None


def read_images(spark: SparkSession, folder: str | list[str], since: str | None = None) -> DataFrame:
    """(path, height, width, channels, data) of the JPEG, PNG, GIF and BMP files below a folder, or several; -1 and no data for broken ones."""
    reader = storage.named(spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True), BY_SPARK)
    rows = storage.in_few_tasks(spark, storage.changed(reader, since).load(folder))
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))  # other sources have paths as they are
    return rows.select(origin.alias("path"), *[F.col(f"image.{c}").alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def inspect_decoded(images: DataFrame) -> DataFrame:
    """Metrics of rows of read_images; one row for each file."""

    def run(frames):
        for f in frames:
            rows = []
            for path, h, w, n, data in zip(*(f[c] for c in ("path", "height", "width", "channels", "data")), strict=True):
                kind = path.rsplit(".", 1)[-1].upper().replace("JPG", "JPEG")
                try:
                    px, mode = from_planes(h, w, n, bytes(data))
                    rows.append(measured(path, px, kind, mode))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, *[None] * 8, f"read_error:{type(e).__name__}"))
            yield _frame(rows)

    return images.mapInPandas(run, SCHEMA)


#: What Spark's image source doesn't read and decode() does.
BY_BYTES = ["tif", "tiff", "ppm", "pgm"]
BY_SPARK = ["jpg", "jpeg", "png", "gif", "bmp"]
#: What counts as an image and nothing here decodes.
UNREAD = sorted(set(storage.IMAGE_EXTENSIONS) - set(BY_BYTES) - set(BY_SPARK))


def inspect_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of all image files below a folder, one row for each; files that nothing here decodes are error rows."""
    others = sorted((set(storage.IMAGE_EXTENSIONS) | set(BY_BYTES)) - set(BY_SPARK))

    def inspected(at: str | list[str]) -> DataFrame:
        return inspect_decoded(read_images(spark, at)).unionByName(inspect_images(storage.scan_files(spark, {"": at}, others)))

    return storage.by_slices(spark, folder, inspected, "inspected")


def folder_inputs(spark: SparkSession, folder: str | list[str], since: str | None = None, only: DataFrame | None = None, of: Kept | None = None) -> DataFrame:
    """(path, x array<float>) of all image files below a folder, or several: model inputs, null for broken ones.

    `since` leaves out files that were last changed before (a timestamp of
    whole seconds), `only` all but those of its paths; its other columns go
    along. `of` has other columns in x's place, null for broken files, too.
    A folder of very many files is to be read by storage.by_slices().
    """
    by_spark = read_images(spark, folder, since).withColumn("path", _plain("path"))
    by_bytes = storage.scan_files(spark, {"": folder}, BY_BYTES, since).drop("dataset", "length").withColumn("path", _plain("path"))
    more = []
    if only is not None:
        wanted, more = only.withColumn("path", _plain("path")), [c for c in only.columns if c != "path"]
        by_spark, by_bytes = (x.join(wanted, "path") for x in (by_spark, by_bytes))
    return model_inputs(by_spark, *more, of=of).unionByName(byte_inputs(by_bytes, *more, of=of))


def _plain(path: str) -> Column:
    """Sources name one file with one or three slashes after `file:`."""
    return F.regexp_replace(path, "^file:/+", "file:/")


#: Columns by name and type, and the function that makes an array for each of them of the inputs of some files, one a row.
Kept = tuple[dict[str, str], Callable[[np.ndarray], list[np.ndarray]]]


def _with_inputs(rows: DataFrame, more: tuple[str, ...], columns: list[str], pixels, of: Kept | None) -> DataFrame:
    """(path, more, x) of rows: the input of pixels(columns), null where that fails. By INPUTS_AT_ONCE rows: an input has 600 KB, whatever the file has.

    With `of` the inputs stay in the task that makes them: Spark takes some
    3 ms to make a row of one, and only what is kept of them becomes rows.
    """
    kept = ["path", *more]
    names, shown = of or ({"x": "array<float>"}, None)

    def inputs(some: pa.RecordBatch) -> list[np.ndarray | None]:
        out = []
        for cells in zip(*(some.column(c).to_pylist() for c in columns), strict=True):
            try:
                out.append(normalised(pixels(*cells)))
            except Exception:  # no input for a broken file
                out.append(None)
        return out

    def lists(out: list[np.ndarray | None]) -> list[pa.Array]:
        sizes = [0 if x is None else x.size for x in out]
        values = np.concatenate([np.empty(0, np.float32), *(x for x in out if x is not None)])
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values), mask=pa.array([x is None for x in out]))]

    def parts(out: list[np.ndarray | None]) -> list[pa.Array]:
        there = np.array([x is not None for x in out], bool)
        at = pa.array(np.cumsum(there) - 1, mask=~there)
        whole = np.concatenate([np.empty(0, np.float32), *(x for x in out if x is not None)]).reshape(-1, 3 * SIDE**2)
        return [pa.array(v).take(at) for v in shown(whole)]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, INPUTS_AT_ONCE):
                some = batch.slice(a, INPUTS_AT_ONCE)
                made = (parts if shown else lists)(inputs(some))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *made], names=[*kept, *names])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`{c}` {kind}" for c, kind in names.items()]
    return rows.select(*kept, *columns).mapInArrow(run, ", ".join(kinds))


def byte_inputs(files: DataFrame, *more: str, of: Kept | None = None) -> DataFrame:
    """(path, x array<float>), and more columns if asked for, of (path, content) rows that decode() reads; null for others. `of` as in folder_inputs."""
    return _with_inputs(files, more, ["content"], lambda content: decode(content)[0], of)


def cache_images(spark: SparkSession, folder: str, cache: str, batch: int, since: str | None = None) -> int:
    """Add the model inputs of the image files below a folder to a cache, with their content's hash as the key; how many were new.

    Only contents that the cache hasn't got are made inputs of, each once
    however many files have it; with `since`, files that were last changed
    before aren't opened. What can't be decoded is kept with its error, so it
    isn't tried again. A batch is written beside the cache and renamed into it
    when all of it is there: readers see whole batches, and a run that breaks
    off leaves none. Inputs are written where they are made: they are in no
    shuffle, join or broadcast.
    """
    parts = storage.slices(spark, folder)
    rows = hashed_files(spark, folder, since, parts)
    if storage.exists(spark, cache):
        rows = rows.join(read_cache(spark, cache).select("key"), "key", "left_anti")
    new = storage.written(rows.groupBy("key").agg(F.min(F.struct("path", "slice")).alias("f")).select("key", "f.*"), "new-files")
    staged = f"{cache}-staged-{batch}"
    for k, (paths, n) in enumerate(parts):
        only = new.where(F.col("slice") == k).select("path", "key")
        # Paths and hashes of a slice have a bound; those of one huge folder, which can't be cut, are dealt out.
        only = F.broadcast(only) if n <= storage.FILES_AT_ONCE else only.hint("merge")
        found = folder_inputs(spark, paths, since, only)
        found = found.select("key", "x", F.when(F.col("x").isNull(), "read_error").alias("error"), F.lit(batch).cast("int").alias("batch"))
        others = storage.scan_files(spark, {"": paths}, UNREAD, since).select(_plain("path").alias("path")).join(only, "path")
        found = found.unionByName(others.select("key", F.lit(None).cast("array<float>").alias("x"), F.lit("read_error").alias("error"), F.lit(batch).cast("int").alias("batch")))
        found.write.mode("append" if k else "overwrite").parquet(staged)
    storage.rename(spark, staged, f"{cache}/batch-{batch}")
    return new.count()


def hashed_files(spark: SparkSession, folder: str, since: str | None = None, parts: list[tuple[list[str], int]] | None = None) -> DataFrame:
    """(path, key, slice) of the image files below a folder: their content's sha256, and which of its slices, as `parts` has them, they are in."""
    parts = parts or storage.slices(spark, folder)
    place = {paths[0]: k for k, (paths, _) in enumerate(parts)}

    def hashed(at: str | list[str]) -> DataFrame:
        found = storage.scan_files(spark, {"": at}, [*storage.IMAGE_EXTENSIONS, *BY_BYTES], since)
        return found.select(_plain("path").alias("path"), F.sha2("content", 256).alias("key"), F.lit(0 if isinstance(at, str) else place[at[0]]).alias("slice"))

    return storage.by_slices(spark, folder, hashed, "hashed", parts)


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """(key, x, error, batch) of all batches of cache_images."""
    return spark.read.schema("key string, x array<float>, error string, batch int").parquet(f"{cache}/batch-*")


def cached_rows(labelled: DataFrame, folder: str, cache: str, label: str = "label") -> DataFrame:
    """labelled (path below the folder, label) with x, error and batch from the cache; rows with an error have no label."""
    spark = labelled.sparkSession
    files = hashed_files(spark, folder).select(F.col("path").alias("_path"), "key")
    top = folder.rstrip("/").rsplit("/", 1)[-1] + "/"
    files = files.withColumn("path", F.substring_index("_path", top, -1)).drop("_path")
    # Compressed inputs look small to Spark, so without the hint it may send them to the driver.
    rows = labelled.join(files, "path", "left").join(read_cache(spark, cache).hint("merge"), "key", "left")
    rows = rows.withColumn("error", F.when(F.col("batch").isNull(), "not cached").otherwise(F.col("error")))
    return rows.withColumn(label, F.when(F.col("error").isNull(), F.col(label)))


def model_inputs(images: DataFrame, *more: str, of: Kept | None = None) -> DataFrame:
    """(path, x array<float>), and more columns if asked for: the normalised, channel-first copy of each decodable image; null for others. `of` as in folder_inputs."""
    return _with_inputs(images, more, ["height", "width", "channels", "data"], lambda h, w, n, data: from_planes(h, w, n, data)[0], of)


def classify(inputs: DataFrame, model: str, x: str = "x") -> DataFrame:
    """inputs with logits: a forward pass of an ONNX file, or of an .npz file with `weight` (classes, inputs) and `bias`.

    Names in an .npz file may begin with `module.`, as parallel training writes
    them. The file is read through Spark, sent to the workers once, and loaded
    once in each task; rows go through it in batches. Null inputs have no
    logits. A file of more than MODEL_BYTES raises: it would have to stand in
    the memory of the driver and of each worker.
    """
    spark = inputs.sparkSession
    file = spark.read.format("binaryFile").load(model)
    size = file.select("length").first()[0]
    if size > MODEL_BYTES:
        raise ValueError(f"{model} has {size} bytes, more than {MODEL_BYTES}")
    sent = spark.sparkContext.broadcast(bytes(file.select("content").first()[0]))
    onnx = model.endswith(".onnx")

    def loaded():
        if onnx:
            import onnxruntime

            session = onnxruntime.InferenceSession(sent.value, providers=["CPUExecutionProvider"])
            name, shape = session.get_inputs()[0].name, session.get_inputs()[0].shape
            return lambda a: session.run(None, {name: a.reshape(len(a), *shape[1:])})[0]
        with np.load(io.BytesIO(sent.value)) as file:
            parts = {name.removeprefix("module."): file[name] for name in file.files}
        return lambda a: a @ parts["weight"].T + parts["bias"]

    @F.pandas_udf("array<float>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded()
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            there = np.flatnonzero(batch.notna())
            for a in range(0, len(there), 32):
                some = there[a : a + 32]
                for k, row in zip(some.tolist(), model(np.stack(batch.iloc[some].to_list()).astype(np.float32)), strict=True):
                    out[k] = row.astype(np.float32)
            yield out

    return inputs.withColumn("logits", forward(F.col(x)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    # As objects first: whole numbers beside None would pass through doubles, which 64-bit hashes don't survive.
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")], dtype=object)
    return frame.astype({"width": "Int32", "height": "Int32", "phash": "Int64", "aspect_ratio": "Float64", "mean_brightness": "Float64", "blur_score": "Float64"})


def inspect_images(files: DataFrame) -> DataFrame:
    """Metrics of (path, content) rows, as the binaryFile source gives; one row for each file."""

    def run(frames):
        for f in frames:
            yield _frame([inspect_image(p, c) for p, c in zip(f["path"], f["content"], strict=True)])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
