"""Relations of classifier evaluation and training histories."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """(actual, predicted, n) of every pair of labels, zeros too."""
    every = F.array(*map(F.lit, labels))
    grid = df.sparkSession.range(1).select(F.explode(every).alias("actual")).select("actual", F.explode(every).alias("predicted"))
    n = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").fillna(0, ["n"])


def class_metrics(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) from a confusion relation; 0 where a denominator is 0."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_class = cells.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    called = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = by_class.join(called, "class").withColumns({"precision": ratio(F.col("tp"), F.col("called")), "recall": ratio(F.col("tp"), F.col("support"))})
    return rows.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support", "tp")


def classification_report(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): each class, accuracy, macro avg and weighted avg."""
    m = class_metrics(cells)
    own = m.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    s = F.sum("support")
    accuracy = F.coalesce(F.try_divide(F.sum("tp"), s), F.lit(0.0))
    lines = m.agg(
        F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), s.cast("double").alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), s.cast("double").alias("support")).alias("b"),
        F.struct(F.lit("weighted avg").alias("label"), *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), s), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], s.cast("double").alias("support")).alias("c"),
    )
    return own.unionByName(lines.select(F.inline(F.array("a", "b", "c"))))


def weakest(report: DataFrame, k: int = 10) -> DataFrame:
    """The k classes of least F1; summary rows, in any case, are left out."""
    return report.where(~F.coalesce(F.col("label").rlike("(?i)accuracy|macro avg|weighted avg"), F.lit(False))).orderBy("f1", "label").limit(k)


def follow(history: DataFrame, metric: str, start: float = 1.0, factor: float = 0.5, lr_patience: int = 2, stop_patience: int | None = None, lower_is_better: bool = True, order: str = "epoch", run: str | None = None, threshold: float = 0.0) -> DataFrame:
    """history with improved, best, since and stopped of early stopping, and the learning_rate used in each row.

    `improved` is better than all rows before, `best` the best so far, `since`
    the rows since an improvement; `stopped` is true after a row whose `since`
    has reached stop_patience. The rate falls by `factor` after more than
    lr_patience rows in which the metric isn't better, by `threshold`, than
    the best that the rate has seen. A null or NaN metric is no improvement.

    Runs of any number are followed at once: rows are dealt by run, sorted in
    their tasks, and streamed through one small state, so a run takes time in
    proportion to its rows and no memory for them. Without `run` there is one.
    Columns of the results' names give way.
    """
    made = {"improved": "boolean", "best": "double", "since": "long", "stopped": "boolean", "learning_rate": "double"}
    kept = [c for c in history.columns if c not in made]
    rows = history.select(*kept)
    dealt = rows.repartition(F.col(run)) if run else rows.coalesce(1)
    keys = [run, order] if run else [order]
    sign = 1.0 if lower_is_better else -1.0

    def steps(batches):
        now, state = object(), None
        for batch in batches:
            runs = batch.column(run).to_pylist() if run else [None] * batch.num_rows
            out: list[tuple] = []
            for r, m in zip(runs, batch.column("_metric").to_pylist(), strict=True):
                if state is None or r != now:
                    now, state = r, {"best": None, "since": 0, "stopped": False, "seen": math.inf, "bad": 0, "lr": start}
                s, x = state, sign * m if m is not None and m == m else None
                better = x is not None and (s["best"] is None or x < s["best"])
                s["best"] = x if better else s["best"]
                s["since"] = 0 if better else s["since"] + 1
                out.append((better, sign * s["best"] if s["best"] is not None else None, s["since"], s["stopped"], s["lr"]))
                s["stopped"] |= stop_patience is not None and s["since"] >= stop_patience
                if x is not None and x < s["seen"] - threshold:
                    s["seen"], s["bad"] = x, 0
                else:
                    s["bad"] += 1
                    if s["bad"] > lr_patience:
                        s["bad"], s["lr"] = 0, s["lr"] * factor
            new = [pa.array(x, t) for x, t in zip(zip(*out), (pa.bool_(), pa.float64(), pa.int64(), pa.bool_(), pa.float64()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, *made])

    fields = ", ".join([*[f"`{c}` {history.schema[c].dataType.simpleString()}" for c in kept], *[f"{c} {t}" for c, t in made.items()]])
    return dealt.withColumn("_metric", F.col(metric).cast("double")).sortWithinPartitions(*keys).mapInArrow(steps, fields)


def early_stopping(history: DataFrame, metric: str, patience: int, lower_is_better: bool = True, order: str = "epoch", run: str | None = None) -> DataFrame:
    """history up to the stop, with improved, best so far and rounds since the last improvement; many runs at once by `run`."""
    return follow(history, metric, stop_patience=patience, lower_is_better=lower_is_better, order=order, run=run).where("not stopped").drop("stopped", "learning_rate")


def plateau_lr(history: DataFrame, metric: str, start: float, factor: float = 0.5, patience: int = 2, lower_is_better: bool = True, order: str = "epoch", threshold: float = 0.0, run: str | None = None) -> DataFrame:
    """history with the learning rate used in each row: it falls after more than `patience` rows without an improvement; many runs at once by `run`."""
    return follow(history, metric, start, factor, patience, None, lower_is_better, order, run, threshold).drop("improved", "best", "since", "stopped")


def parity(df: DataFrame, p: str, q: str) -> DataFrame:
    """How far two scorers' vectors are apart, and how often their largest places agree."""
    from sievework.functions.scores import argmax

    gap = F.array_max(F.zip_with(p, q, lambda x, y: F.abs(x - y)))
    return df.agg(F.max(gap).alias("max_abs_difference"), F.count_if(argmax(F.col(p)) == argmax(F.col(q))).alias("same_argmax"), F.count("*").alias("n"))


def weighted_loss(df: DataFrame, loss: str, n: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias("mean_loss"))
