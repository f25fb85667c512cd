"""Writes as functions from a table's rows to its next rows.

Each function takes DataFrames and returns a Change: the rows after it and the
rows it touched, which are what RETURNING shows. Nothing is written here; the
catalog commits a Change as a snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A write that a constraint forbids."""


@dataclass
class Change:
    rows: DataFrame
    touched: DataFrame


def _holds(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[k] for k in keys])


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with their place in the batch, which decides between proposals for one key."""
    return df.withColumn("_at", F.monotonically_increasing_id())


def insert(table: DataFrame, proposed: DataFrame) -> Change:
    proposed = proposed.select(*table.columns)
    return Change(table.unionByName(proposed), proposed)


def _known(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])


def _without(rows: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key, where it has no null, is not among the taken ones."""
    other = taken.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)]), "left_anti")


def insert_or_ignore(table: DataFrame, proposed: DataFrame, keys: list[list[str]], at: str | None = None, keep=None) -> Change:
    """ON CONFLICT DO NOTHING: a row goes if any key, without nulls, is taken by the table or by an earlier row that stays.

    at names a column with the order of the batch. With several keys a row
    that one key rejects frees its other keys, so rows are settled in rounds:
    those first under all their keys stay, those that meet one that stays go.
    keep(df) writes the rows of a round once; as many rounds run as rows wait
    for one another in a chain.
    """
    left = _numbered(proposed) if at is None else proposed.withColumnRenamed(at, "_at")
    for key in keys:
        left = _without(left, table, key)
    ranks = {f"_n{i}": F.row_number().over(Window.partitionBy(*key).orderBy("_at")) for i, key in enumerate(keys)}
    first = reduce(lambda a, b: a & b, [~_known(key) | (F.col(f"_n{i}") == 1) for i, key in enumerate(keys)], F.lit(True))
    if len(keys) < 2:
        return insert(table, left.withColumns(ranks).filter(first) if ranks else left)
    keep = keep or (lambda df: df)
    left, stay = keep(left), None
    while left.head(1):
        won = keep(left.withColumns(ranks).filter(first).select(*left.columns))
        stay = won if stay is None else stay.union(won)
        left = left.join(won.select(F.col("_at").alias("_w")), F.col("_at") == F.col("_w"), "left_anti")
        for key in keys:
            left = _without(left, won, key)
        left = keep(left)
    return insert(table, proposed.limit(0) if stay is None else stay)


def upsert(table: DataFrame, proposed: DataFrame, key: list[str], assign: dict[str, str], at: str | None = None) -> Change:
    """ON CONFLICT DO UPDATE SET on one key: assign, in SQL, may name old columns as o.<name> and proposed ones as excluded.<name>.

    Proposals for one key are applied in turn, each to what the one before
    left; of a key that the table lacks the first inserts. Assignments need
    not be associative, so the proposals of one key meet in one row.
    """
    cols = table.columns
    batch = _numbered(proposed) if at is None else proposed.withColumnRenamed(at, "_at")
    kinds = dict(table.dtypes)
    free = batch.filter(~_known(key)).select(*cols)
    groups = batch.filter(_known(key)).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.sort_array(F.collect_list(F.struct("_at", *cols))).alias("_all"))
    old = table.select(F.struct(*cols).alias("_old"))
    met = old.join(groups, reduce(lambda a, b: a & b, [F.col(f"_old.{k}") == F.col(f"_k{i}") for i, k in enumerate(key)]), "full")
    whole = f"struct<{', '.join(f'`{c}`:{kinds[c]}' for c in cols)}>"
    start = F.when(F.col("_old").isNull(), F.struct(*[F.col("_all")[0][c].alias(c) for c in cols])).otherwise(F.col("_old"))
    rest = F.when(F.col("_old").isNull(), F.slice("_all", F.lit(2), F.size("_all"))).otherwise(F.coalesce(F.col("_all"), F.array()))
    turned = met.select(F.col("_all").isNotNull().alias("_hit"), start.cast(whole).alias("_o"), rest.alias("_rest"))
    values = [f"'{c}', CAST({assign[c]} AS {kinds[c]})" if c in assign else f"'{c}', o.`{c}`" for c in cols]
    step = f"CAST(named_struct({', '.join(values)}) AS {whole})"
    out = turned.select("_hit", F.expr(f"aggregate(_rest, _o, (o, excluded) -> {step})").alias("_o")).select("_hit", "_o.*")
    return Change(out.drop("_hit").unionByName(free), out.filter("_hit").drop("_hit").unionByName(free))


def update(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> Change:
    """SET: all expressions see the old row; a condition that is null leaves it."""
    hit = _holds(where)
    marked = table.withColumn("_hit", hit)
    kinds = dict(table.dtypes)
    out = marked.select(*[F.when(F.col("_hit"), assign[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns], "_hit")
    return Change(out.drop("_hit"), out.filter("_hit").drop("_hit"))


def update_from(table: DataFrame, name: str, source: DataFrame, source_name: str, on: Column, assign: dict[str, Column]) -> Change:
    """UPDATE ... FROM: a row that several source rows match is an error, raised when the rows are read."""
    cols = table.columns
    t, s = _numbered(table).alias(name), source.alias(source_name)
    pairs = t.join(s, on).select(F.col(f"{name}._at").alias("_row"), *[v.alias(f"_new_{c}") for c, v in assign.items()])
    agg = pairs.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), *[F.first(f"_new_{c}").alias(f"_new_{c}") for c in assign])
    base = _numbered(table)
    met = base.join(agg, base["_at"] == agg["_row"], "left")
    many = F.assert_true(F.col("_n").isNull() | (F.col("_n") == 1), "UPDATE FROM: more than one source row matches")
    kinds = dict(table.dtypes)
    checked = met.withColumn("_ok", many)
    hit = F.col("_n").isNotNull() & F.col("_ok").isNull()
    out = checked.select(*[F.when(hit, F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in cols], hit.alias("_hit"))
    return Change(out.drop("_hit"), out.filter("_hit").drop("_hit"))


def delete(table: DataFrame, where: Column | None = None) -> Change:
    hit = _holds(where)
    return Change(table.filter(~hit), table.filter(hit))


def truncate(table: DataFrame) -> Change:
    return Change(table.limit(0), table)


def with_numbers(table: DataFrame, proposed: DataFrame, column: str, at: str | None = None) -> DataFrame:
    """Autoincrement: nulls get the numbers after the largest one, in batch order; row counts of the parts give the offsets.

    at names a stored monotonically_increasing_id, so that all evaluations see the same order and parts.
    """
    top = table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    given = proposed.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    order = F.monotonically_increasing_id() if at is None else F.col(at)
    batch = proposed.withColumns({"_part": F.spark_partition_id() if at is None else F.shiftright(at, 33).cast("int"), "_at": order, "_free": F.col(column).isNull()})
    sizes = {r[0]: r[1] for r in batch.filter("_free").groupBy("_part").count().collect()}
    offset, starts = max(top, given), {}
    for part in sorted(sizes):
        starts[part] = offset
        offset += sizes[part]
    start = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    number = start[F.col("_part").cast("long")] + F.row_number().over(Window.partitionBy("_part", "_free").orderBy("_at"))
    kind = dict(table.dtypes)[column]
    return batch.withColumn(column, F.when(F.col("_free"), number).otherwise(F.col(column)).cast(kind)).select(*proposed.columns)


def check_not_null(rows: DataFrame, columns: list[str]) -> None:
    for c in columns:
        if rows.filter(F.col(c).isNull()).head(1):
            raise ConstraintError(f"{c} must not be null")


def check_unique(rows: DataFrame, keys: list[list[str]]) -> None:
    """A key with a null part is exempt."""
    for key in keys:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        if rows.filter(known).groupBy(*key).count().filter("count > 1").head(1):
            raise ConstraintError(f"duplicate key ({', '.join(key)})")


def check_expressions(rows: DataFrame, checks: list[str]) -> None:
    """A check that is null fails, as one that is false."""
    for c in checks:
        if rows.filter(~F.coalesce(F.expr(c), F.lit(False))).head(1):
            raise ConstraintError(f"check failed: {c}")


def check_parents(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> None:
    known = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_c"))
    if known.join(parent.select(F.col(parent_column).alias("_p")), F.col("_c") == F.col("_p"), "left_anti").head(1):
        raise ConstraintError(f"{column} has no parent in {parent_column}")


def parent_deleted(child: DataFrame, column: str, gone: DataFrame, parent_column: str, action: str) -> Change:
    """ON DELETE for one child: restrict (also no action), cascade or set null."""
    keys = gone.select(F.col(parent_column).alias("_p")).distinct()
    hit = child.join(keys, F.col(column) == F.col("_p"), "left_semi")
    if action in ("restrict", "no action"):
        if hit.head(1):
            raise ConstraintError(f"rows still refer to the deleted {parent_column}")
        return Change(child, hit)
    rest = child.join(keys, F.col(column) == F.col("_p"), "left_anti")
    if action == "cascade":
        return Change(rest, hit)
    kind = dict(child.dtypes)[column]
    nulled = hit.withColumn(column, F.lit(None).cast(kind)).select(*child.columns)
    return Change(rest.unionByName(nulled), nulled)


def parent_updated(child: DataFrame, column: str, moved: DataFrame, action: str) -> Change:
    """ON UPDATE for one child; moved has the columns old and new of every changed parent key."""
    pairs = moved.filter("not (old <=> new)").select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    met = child.join(pairs, F.col(column) == F.col("_old"), "left")
    hit = F.col("_old").isNotNull()
    if action in ("restrict", "no action"):
        if met.filter(hit).head(1):
            raise ConstraintError(f"rows still refer to the changed key through {column}")
        return Change(child, child.limit(0))
    kind = dict(child.dtypes)[column]
    new = (F.col("_new") if action == "cascade" else F.lit(None)).cast(kind)
    out = met.withColumn("_hit", hit).withColumn(column, F.when(F.col("_hit"), new).otherwise(F.col(column)))
    return Change(out.select(*child.columns), out.filter("_hit").select(*child.columns))
