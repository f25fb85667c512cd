"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.leaks import find_leaks
from lodestar.llm.mixing import mix
from lodestar.llm.neardup import drop_near_duplicates
from lodestar.llm.quality import classify_quality
from lodestar.llm.repeats import remove_repeats
from lodestar.llm.store import Staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify_quality(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (null ids last); rows without words stay."""
    return drop_near_duplicates(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes leave the texts; a text of which only white space is left goes."""
    left = remove_repeats(docs, as_text=True)
    some = left.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = F.col("n_removed") > 0
    return some.withColumns({"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens by the target weights; adds domain, n_tokens and epoch."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_neardup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontaminate),
    ("mixing_weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents after all stages."""
    docs, staged = table(spark, sf_dir, "documents"), Staged(spark, "pipeline")
    for _, stage in STAGES:
        docs = staged.put(stage(spark, docs, sf_dir))
    return docs


#: Training and shingle hashing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None
