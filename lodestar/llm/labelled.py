"""The labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Staged


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)), F.lit(0).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, limit: int | None, staged: Staged) -> DataFrame:
    """Text and label (0 or 1) of the labelled documents outside the held-out remainder, at most `limit` if that is given.

    Under a limit the rows with the smallest hash of doc_id are taken, so the
    choice depends on neither the order nor the layout of the table. An id with
    two different labels is left out. The ids are written first, so that Spark knows their
    size when it picks the join with the texts.
    """
    known = labels.filter(f"doc_id is not null and {label} in (0, 1)").filter(remainder(mod) != held)
    one = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).filter("label = _most").drop("_most")
    chosen = staged.put(one if limit is None else one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.select("doc_id", "text")
    kinds = {t.schema["doc_id"].dataType.simpleString() for t in (docs, labels)}
    if limit is None and len(kinds) == 1 and kinds <= {"int", "bigint", "string"}:
        rows = rows.filter(remainder(mod) != held)  # the join may shuffle texts: not those of held-out rows
    return rows.join(chosen, "doc_id")
