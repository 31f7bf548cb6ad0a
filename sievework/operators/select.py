"""Exact order statistics of groups of any size: selection by histograms that narrow the range of a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.storage import remove, scratch, written

BINS = 1024
#: Values that are left in a rank's range when they are sorted in one row.
AT_ONCE = 4096


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of x between lo and hi: it never falls as x grows, and lo and hi are in the first and the last."""
    share = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)  # halves, as hi - lo may be beyond a double
    inner = F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins))
    return F.when(x >= hi, bins - 1).otherwise(inner).cast("int")


def medians(df: DataFrame, key: str, columns: list[str], bins: int = BINS, at_once: int = AT_ONCE) -> DataFrame:
    """(key, column_name, median) of numeric columns by group; nulls and NaN are no values, a group without values has no row.

    A rank's range starts as all of its group. A pass counts the values in
    `bins` parts of each range, which Spark sums up before it shuffles, and
    keeps the part with the rank, from its least to its greatest value; a
    range shrinks each time, however its values lie. Ranges of at most
    `at_once` values are sorted in a row. So no row, buffer or task grows with
    a group; the driver sees one number a pass.
    """
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    values = df.select(F.col(key).alias("g"), F.inline(cells)).where("x is not null and not isnan(x)")
    whole = values.groupBy("g", "column_name").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    path = scratch(spark, "ranks")
    state = written(whole.select("g", "column_name", F.posexplode(ranks).alias("part", "rank"), "n", "lo", "hi"), "ranks", path)

    def inside(state: DataFrame) -> DataFrame:
        s = state.where("lo < hi").select(F.col("g").alias("h"), F.col("column_name").alias("c"), "part", "rank", "lo", "hi", "n")
        return values.join(s, F.col("g").eqNullSafe(F.col("h")) & (F.col("column_name") == F.col("c")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("h", "c")

    while (state.where("lo < hi").agg(F.max("n")).first()[0] or 0) > at_once:
        of = ["g", "column_name", "part", "rank"]
        counted = inside(state).withColumn("bin", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins)).groupBy(*of, "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*of).orderBy("bin")) - F.col("n")
        held = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        found = held.select("g", "column_name", "part", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi")
        done, path = path, scratch(spark, "ranks")
        state = written(found.unionAll(state.where("lo = hi")), "ranks", path)
        remove(spark, done)

    sorted_ = inside(state).groupBy("g", "column_name", "part", "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    ends = sorted_.select("g", "column_name", F.element_at("xs", (F.col("rank") + 1).cast("int")).alias("x")).unionAll(state.where("lo = hi").select("g", "column_name", F.col("lo").alias("x")))
    # Of an even number the mean of both middle values, as halves for the same reason as above.
    middle = ends.groupBy("g", "column_name").agg(F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.min("x") / 2 + F.max("x") / 2).alias("median"))
    return middle.select(F.col("g").alias(key), "column_name", "median")
