"""What the operators share: tables, shared storage, code on the workers, numpy text helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sievework.sources.storage import scratch, written  # noqa: F401  for the operators

PACKAGE = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sievework_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sievework-code-"), "sievework.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._sievework_shipped = True


def tidy(run):
    """run, for mapInArrow: what a task has freed goes back to the system when it ends, since workers live on."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that df hasn't got."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def pieces(texts: list[str | None], limit: int = 1 << 19):
    """Slices (from, to) of a list so that each has at most `limit` characters or is one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_POW.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, p in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0], done, step = 1, 1, p
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * np.uint64(step)
                done, step = done + take, step * step % (1 << 64)
            _POW[name] = out
    return _POW["up"][:n], _POW["down"][:n]


def word_hashes(texts: list[str | None], ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and for each text where its words end.

    Words are runs of digits, a-z and characters beyond ASCII; ascii_only
    lower-cases A-Z alone. Equal words have equal hashes, whatever text or call
    they come from.
    """
    data = [(t or "").encode().lower() if ascii_only else (t or "").lower().encode() for t in texts]
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    is_word = _WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum(np.fromiter((len(x) + 1 for x in data), np.int64, len(data)))
    return h, np.searchsorted(starts, text_ends)


# Odd multipliers, so that a shingle's hash depends on the order of its words.
_ORDER = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words (len(words) - n + 1 of them)."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += words[k : k + size] * _ORDER[k]
    return mix64(out)
