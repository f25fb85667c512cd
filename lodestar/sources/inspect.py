"""Plans as rows, and column statistics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the equal-depth histogram, and how many common values are kept.
BUCKETS, COMMON = 32, 50
_TIMES = {"scanTime": 1000, "sortTime": 1000, "aggTime": 1000, "buildTime": 1000, "pipelineTime": 1000}


def _nodes(plan, depth: int = 0):
    """The physical plan's operators from the root down; adaptive wrappers and stages are looked through."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan(), depth)
        return
    if kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan(), depth)
        return
    inside = kind in ("WholeStageCodegenExec", "InputAdapter")
    if not inside:
        yield depth, plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i), depth + (not inside))


def _metric(plan, name: str) -> int | None:
    found = plan.metrics().get(name)
    return found.get().value() if found.isDefined() else None


def _estimate(plan) -> int | None:
    link = plan.logicalLink()
    rows = link.get().stats().rowCount() if link.isDefined() else link
    return int(str(rows.get())) if link.isDefined() and rows.isDefined() else None


def explain(spark: SparkSession, df: DataFrame, run: bool) -> DataFrame:
    """One row per operator; with run, the plan is executed and its metrics give rows and times. Step 0 has the whole time."""
    query = df._jdf.queryExecution()
    whole = None
    if run:
        start = time.perf_counter()
        query.toRdd().count()
        whole = int((time.perf_counter() - start) * 1e6)
    rows = []
    for step, (depth, plan) in enumerate(_nodes(query.executedPlan())):
        took = [m * scale for name, scale in _TIMES.items() if (m := _metric(plan, name)) is not None] if run else []
        rows.append((step, "  " * depth + plan.nodeName(), plan.simpleString(25), _estimate(plan), _metric(plan, "numOutputRows") if run else None, whole if step == 0 else sum(took) if took else None))
    return spark.createDataFrame(rows, "step int, operation string, detail string, rows_estimated bigint, rows_actual bigint, duration_us bigint")


def statistics(df: DataFrame) -> list[dict]:
    """Counts, distinct values, range, histogram and common values of every column in one pass over the rows."""
    measures = [F.count(F.lit(1)).alias("n")]
    for i, (c, kind) in enumerate(df.dtypes):
        col = F.col(f"`{c}`")
        text = col.cast("string")
        number = kind in ("int", "bigint", "float", "double")
        measures += [F.count(col).alias(f"k{i}"), F.approx_count_distinct(text).alias(f"d{i}")]
        measures += [(F.min(col) if not kind.startswith("array") else F.lit(None)).cast("string").alias(f"l{i}"), (F.max(col) if not kind.startswith("array") else F.lit(None)).cast("string").alias(f"h{i}")]
        measures += [(F.percentile_approx(col.cast("double"), [b / BUCKETS for b in range(BUCKETS + 1)]) if number else F.lit(None).cast("array<double>")).alias(f"p{i}")]
        measures += [F.expr(f"transform(approx_top_k(CAST(`{c}` AS STRING), {COMMON}), x -> x.item)").alias(f"t{i}")]
    r = df.agg(*measures).first()
    return [
        {"column": c, "rows": r.n, "nulls": r.n - r[f"k{i}"], "distinct": r[f"d{i}"], "low": r[f"l{i}"], "high": r[f"h{i}"], "histogram": r[f"p{i}"], "common": r[f"t{i}"]}
        for i, c in enumerate(df.columns)
    ]
