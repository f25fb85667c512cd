"""Relational helpers over DataFrames: joins that mean what they say, unions from left to right, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """NOT IN as an anti-join: nulls on the right are ignored, null keys on the left stay."""
    return left.join(right, on, "left_anti")


def union(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """A chain of ("all" | "distinct", branch), folded from the left: a distinct step removes duplicates of all rows so far."""
    return reduce(lambda a, step: a.union(step[1]) if step[0] == "all" else a.union(step[1]).distinct(), rest, first)


def top_k(df: DataFrame, order: list[Column | str], k: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET, which Spark runs as a bounded heap per task."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(k)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint where a bounded count proves the side small; otherwise Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16, hot: float = 0.01) -> DataFrame:
    """Equi-join whose hot keys, those with more than a share `hot` of the left rows, are spread over `salts` partitions.

    Only inner, left, left_semi and left_anti joins: a left row meets all its
    matches in its own salt, as the right rows of hot keys are repeated.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    counts = left.groupBy(key).count()
    total = left.count()
    heavy = counts.filter(F.col("count") > max(1, int(hot * total))).select(F.col(key).alias("_h"))
    # at most 1 / hot keys are that heavy, so the list is small by construction
    flag = F.broadcast(heavy)
    spread = left.join(flag, F.col(key) == F.col("_h"), "left").withColumn("_salt", F.when(F.col("_h").isNotNull(), F.floor(F.rand(7) * salts).cast("int")).otherwise(0)).drop("_h")
    copies = right.join(flag, F.col(key) == F.col("_h"), "left").withColumn("_salt", F.explode(F.when(F.col("_h").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_h")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")
