"""Queries on groups and histories of any size: medians by selection, members in chunks, many runs at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import curate, evaluate, select
from sievework.plans import catalog as c
from sievework.plans.catalog import query


@query("""
WITH v AS (SELECT l_returnflag, unnest([{'column_name': 'l_quantity', 'x': l_quantity}, {'column_name': 'l_extendedprice', 'x': l_extendedprice}, {'column_name': 'l_tax', 'x': l_tax}]) AS r FROM lineitem)
SELECT l_returnflag, r.column_name AS column_name, median(r.x) AS median FROM v GROUP BY 1, 2
""")
def large_medians(spark, d):
    """Groups of a third of all rows: their ranks' ranges are narrowed by histograms until few values are left."""
    return select.medians(c.table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"])


@query(f"""
WITH {c._CONFLICTS}, o AS (SELECT sha256 AS leakage_group, doc_id, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) - 1 AS i FROM hashed WHERE sha256 IN (SELECT leakage_group FROM conflicts))
SELECT leakage_group, i // 2 AS chunk, count(*) AS n, string_agg(doc_id, ' | ' ORDER BY i) AS images FROM o GROUP BY 1, 2
""")
def conflict_members(spark, d):
    return curate.conflict_members(c.conflict_rows(spark, d), "leakage_group", "unified_class", "doc_id", 2)


_RUNS = "runs AS (SELECT event_type AS run, epoch, round(avg(value), 6) AS score FROM (SELECT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS epoch, value FROM events) GROUP BY 1, 2)"


def runs(spark, d):
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000L")
    return c.table(spark, d, "events").groupBy(F.col("event_type").alias("run"), hour.cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("score"))


def _walk_sql(sign: int) -> str:
    better = f"{sign} * h.score < best"
    return f"""
WITH RECURSIVE {_RUNS}, h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM runs),
walk AS (
  SELECT DISTINCT run, 0::BIGINT AS i, NULL::BIGINT AS epoch, NULL::DOUBLE AS score, 'infinity'::DOUBLE AS best, 0 AS bad, 0.1::DOUBLE AS used, 0.1::DOUBLE AS lr FROM runs
  UNION ALL
  SELECT h.run, h.i, h.epoch, h.score, least(best, {sign} * h.score), CASE WHEN {better} THEN 0 WHEN bad + 1 > 2 THEN 0 ELSE bad + 1 END, lr, CASE WHEN {better} THEN lr WHEN bad + 1 > 2 THEN lr * 0.5 ELSE lr END
  FROM walk JOIN h ON h.run = walk.run AND h.i = walk.i + 1)
SELECT run, epoch, score, used AS learning_rate FROM walk WHERE i > 0
"""


@query(_walk_sql(1))
def plateau_lr_runs(spark, d):
    """Each type of event is a run, all followed at once; lower is better."""
    return evaluate.plateau_lr(runs(spark, d), "score", 0.1, run="run")


@query(_walk_sql(-1))
def plateau_lr_max(spark, d):
    """As plateau_lr_runs, higher is better."""
    return evaluate.plateau_lr(runs(spark, d), "score", 0.1, lower_is_better=False, run="run")


@query(f"""
WITH {_RUNS}, a AS (SELECT *, row_number() OVER w AS i, max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, max(score) OVER w AS best FROM runs WINDOW w AS (PARTITION BY run ORDER BY epoch)),
b AS (SELECT *, prior IS NULL OR score > prior AS improved FROM a), s AS (SELECT *, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY run ORDER BY epoch) AS since FROM b),
e AS (SELECT *, coalesce(sum(CASE WHEN since >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM s)
SELECT run, epoch, score, improved, best, since FROM e WHERE stops = 0
""")
def early_stopping_runs(spark, d):
    return evaluate.early_stopping(runs(spark, d), "score", 5, lower_is_better=False, run="run")
