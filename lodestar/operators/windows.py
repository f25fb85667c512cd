"""Window helpers with explicit frames.

The dialect's default frame counts rows, not peers, and its NTILE spreads the
larger buckets differently from the standard; both are spelled out here, so a
reader sees which one a query uses.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def over(partition: list[str] | None = None, order: list[Column | str] | None = None) -> WindowSpec:
    """A window; without an order all rows are peers, which Spark's ranking functions need to be told."""
    w = Window.partitionBy(*(partition or []))
    return w.orderBy(*(order or [F.lit(1)]))


def running(w: WindowSpec) -> WindowSpec:
    """The dialect's default frame: the rows up to this one."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def moving(w: WindowSpec, before: int, after: int = 0) -> WindowSpec:
    return w.rowsBetween(-before, after)


def ntile(n: int, w: WindowSpec, partition: list[str]) -> Column:
    """floor((row_number - 1) * n / rows) + 1: ten rows in four buckets are 3, 2, 3, 2."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return (F.floor((F.row_number().over(w) - 1) * F.lit(n) / rows) + 1).cast("long")


def first_value(c: Column, w: WindowSpec) -> Column:
    return F.first(c).over(running(w))


def last_value(c: Column, w: WindowSpec) -> Column:
    """Under the default frame: this row's own value."""
    return F.last(c).over(running(w))


def nth_value(c: Column, n: int, w: WindowSpec) -> Column:
    """The n-th row of the partition, whatever the frame."""
    return F.nth_value(c, n).over(whole(w))
