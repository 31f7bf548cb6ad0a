"""Group-aware splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Split names and shares, in the order that breaks ties.
SHARES = [("train", 0.70), ("validation", 0.15), ("test", 0.15)]
SEED = "42"


def plan_runs(sizes: list[tuple[int, int]], shares: list[tuple[str, float]] = SHARES) -> list[tuple[int, int, int, list[str]]]:
    """What the greedy walk does to k groups of each size, as (size, low, high, picks): group i of low..high goes to picks[(i - low) % len(picks)].

    While the splits with the most room take turns, their order repeats until
    another split has as much room; such a stretch is one run, so there are
    few runs however many groups there are.
    """
    total = sum(s * k for s, k in sizes)
    order = [n for n, _ in shares]
    room = {n: share * total for n, share in shares}
    best = lambda r: max(order, key=lambda n: (r[n], -order.index(n)))
    runs = []
    for s, k in sorted(sizes, reverse=True):
        at = 0
        while at < k:
            sim, picks = dict(room), []
            while len(picks) < len(order) and (n := best(sim)) not in picks:
                picks.append(n)
                sim[n] -= s
            others = [room[n] for n in order if n not in picks]
            cycles = (k - at) // len(picks)
            if others and s:
                cycles = min(cycles, max(1, math.ceil((min(room[n] for n in picks) - max(others)) / s)))
            n = max(cycles * len(picks), 1) if cycles else k - at
            for i, name in enumerate(picks):
                room[name] -= s * len(range(i, n, len(picks)))
            runs.append((s, at, at + n, picks))
            at += n
    return runs


def greedy_split(groups: DataFrame, group: str, size: str, shares: list[tuple[str, float]] = SHARES) -> DataFrame:
    """(group, split): the largest groups first, each to the split with the most room left, ties to the first split.

    Groups of one size are in the order of md5(seed || group). The walk needs
    only how many groups there are of each size; its runs are planned on the
    driver, and the groups, numbered within their size, look up their split.
    """
    sizes = [(r[0], r[1]) for r in groups.groupBy(size).agg(F.count("*")).collect()]  # a row for each different size
    runs = plan_runs(sizes, shares)
    kind = groups.schema[size].dataType.simpleString()
    table = groups.sparkSession.createDataFrame(runs, f"run_size {kind}, low long, high long, picks array<string>")
    rows = _numbered(groups, group, size).join(table, (F.col("s") == F.col("run_size")) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high")))
    return rows.select(group, F.element_at("picks", ((F.col("k") - F.col("low")) % F.size("picks") + 1).cast("int")).alias("split"))


def _numbered(groups: DataFrame, group: str, size: str) -> DataFrame:
    """(group, s, k): each group's place, from 0, among those of its size in the order of their md5.

    Sizes can be very unlike in number, so places are counted in bins of the
    md5's first byte, and the bins before are added.
    """
    m = F.md5(F.concat(F.lit(SEED), F.col(group).cast("string")))
    rows = groups.select(F.col(group), F.col(size).alias("s"), m.alias("m"), F.left(m, F.lit(2)).alias("bin"))
    per = rows.groupBy("s", "bin").agg(F.count("*").alias("n"))
    before = per.select("s", "bin", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s", "bin").orderBy("m", group))
    return rows.withColumn("i", inside).join(before, ["s", "bin"]).select(group, "s", (F.col("before") + F.col("i") - 1).alias("k"))
