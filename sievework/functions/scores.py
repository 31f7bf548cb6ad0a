"""Columns on probability vectors, signatures and labels."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ladders that put a confidence in words, as (least percent, text).
LADDERS = {
    "short": [(90, "The model is quite confident in this prediction."), (70, "The model has fairly strong confidence in this prediction."), (None, "The model is less certain, so this result should be treated with caution.")],
    "long": [
        (90, "The model is highly confident in this prediction."),
        (70, "The model has relatively high confidence in this prediction."),
        (50, "The model has moderate confidence, so the prediction should be interpreted with some caution."),
        (None, "The model has low confidence, so the result should be verified before disposal."),
    ],
    "review": [
        (90, "The model is highly confident in this prediction."),
        (70, "The model has reasonably strong confidence in this prediction."),
        (50, "The model has moderate confidence, so this result should be treated with some caution."),
        (None, "The model has low confidence, so the image may need manual review."),
    ],
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once for a row: Spark shares nothing between the lambdas of a column."""
    return F.transform(F.array(value), then)[0]


def softmax(v: Column, digits: int | None = None) -> Column:
    """Stable softmax of an array, in doubles; in as many steps as it has elements."""

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(e, lambda x: F.round(x / t, digits) if digits is not None else x / t))

    def of(x: Column) -> Column:
        return let(F.array_max(x).cast("double"), lambda m: let(F.transform(x, lambda y: F.exp(y.cast("double") - m)), shares))

    return let(v, of)


def argmax(v: Column) -> Column:
    """The first place, from 0, of the largest element; that of softmax(v) is that of v."""
    return let(v, lambda x: F.array_position(x, F.array_max(x))).cast("int") - 1


def top_k(v: Column, k: int) -> Column:
    """(index, value) of the k largest elements, ties to the smaller index; k is held between 1 and the length."""
    ranked = F.transform(v, lambda x, i: F.struct((-x).alias("v"), i.alias("index")))
    kept = F.slice(F.array_sort(ranked), 1, max(1, k))
    return F.transform(kept, lambda s: F.struct(s["index"].alias("index"), (-s["v"]).alias("value")))


def ladder(percent: Column, name: str = "long") -> Column:
    out = F.lit(LADDERS[name][-1][1])
    for least, text in reversed(LADDERS[name][:-1]):
        out = F.when(percent >= least, text).otherwise(out)
    return F.when(percent.isNotNull(), out)


def class_name(index: Column, names: Column) -> Column:
    """The name of a class index, or `Unknown Class {i}`."""
    return F.coalesce(F.try_element_at(names, index + 1), F.concat(F.lit("Unknown Class "), index.cast("string")))


def affine(v: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std by channel."""
    m, s = (F.array(*map(F.lit, x)) for x in (mean, std))
    return F.zip_with(F.zip_with(v, m, lambda x, y: x - y), s, lambda x, y: x / y)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit signatures; null if one is."""
    return F.bit_count(a.bitwiseXOR(b))


def probes(radius: int, bits: int = 16) -> list[int]:
    """The masks that flip at most `radius` of `bits` bits."""
    return [sum(1 << b for b in flipped) for r in range(radius + 1) for flipped in combinations(range(bits), r)]


def bands(signature: Column) -> Column:
    """The four 16-bit sections of a 64-bit signature, the highest first."""
    return F.array(*[F.shiftrightunsigned(signature, 48 - 16 * k).bitwiseAND(F.lit(65535)) for k in range(4)])
