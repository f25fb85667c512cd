"""Mixing sources to target weights by budgets on a domain-language-source tree.

The token budget is dealt out from the root: among siblings by weight, none
getting more than its documents hold over `max_epochs` epochs, and what one
cannot use going to its siblings first. A node's own limit is the sum of its
leaves', so a shortage leaves a subtree, towards the parent's siblings, only
when the whole subtree is used up. Each leaf then takes whole seeded epochs,
and of the last one the prefix of its shuffled documents that fits.

The prefix is a threshold on a document's hash, found from sums over hash
slices; only the slice that holds the threshold is sorted. One row per leaf is
joined to the documents, so their texts are not shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Staged, table

#: Weights of the contract query's tree; children that are not named weigh 1.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0, ("*", "en"): 2.0, ("*", "de"): 1.5}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The default domain: one of four by the md5 of the source's name."""
    return F.concat(F.lit("domain"), F.pmod(F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int"), F.lit(4)).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(weights: dict, depth: int) -> Column:
    """The weight of a node of that depth; '*' stands for any ancestor, exact names win."""
    out = F.lit(1.0)
    for path, w in sorted(weights.items(), key=lambda p: -sum(x == "*" for x in p[0]), reverse=False):
        if len(path) == depth:
            hit = F.lit(True)
            for name, x in zip(LEVELS, path):
                if x != "*":
                    hit = hit & (F.col(name) == x)
            out = F.when(hit, F.lit(float(w))).otherwise(out)
    return out


def _deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds budget to siblings that have weight and limit, from their parent's `share`: water-filling in closed form.

    In the order of limit / weight the full ones come first; one is full if an
    even deal of what the earlier ones leave would exceed its limit.
    """
    ratio = F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parent).orderBy("_ratio", *[c for c in LEVELS if c in nodes.columns])
    before, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    rows = nodes.withColumn("_ratio", ratio).withColumns(
        {"_c": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "_w": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))}
    )
    rows = rows.withColumn("_full", (F.col("_w") > 1e-9) & (F.col("_ratio") * F.col("_w") <= F.col("share") - F.col("_c")))
    rows = rows.withColumns({"_fc": F.sum(F.when(F.col("_full"), F.col("limit")).otherwise(0.0)).over(every), "_fw": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(every)})
    even = F.when(F.col("_fw") > 1e-9, F.greatest(F.col("share") - F.col("_fc"), F.lit(0.0)) * F.col("weight") / F.col("_fw")).otherwise(0.0)
    return rows.withColumn("budget", F.when(F.col("_full"), F.col("limit")).otherwise(even)).drop("_ratio", "_c", "_w", "_full", "_fc", "_fw")


def budgets(leaves: DataFrame, total: float, weights: dict, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> the same rows with limit and budget."""
    own = leaves.withColumn("limit", F.col("tokens").cast("double") * max_epochs)
    share, parent = None, []
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        nodes = own.groupBy(*keys).agg(F.sum("limit").alias("limit")).withColumn("weight", _weight(weights, depth))
        nodes = nodes.withColumn("share", F.lit(float(total))) if share is None else nodes.join(share, parent)
        # at the root all nodes are siblings: a constant key
        dealt = _deal(nodes.withColumn("_root", F.lit(0)), parent or ["_root"]).drop("_root")
        share, parent = dealt.select(*keys, F.col("budget").alias("share")), keys
    return own.join(share.withColumnRenamed("share", "budget"), list(LEVELS))


def mix(docs: DataFrame, fraction: float = 0.5, weights: dict | None = None, max_epochs: int = 4, seed: int = 17, domain: Column | None = None, slices: int = 3) -> DataFrame:
    """The selected copies: every column of docs, and domain, n_tokens and epoch.

    The budget is `fraction` of all tokens (runs of characters other than
    ASCII white space). A leaf with less than one token left takes no prefix; a
    document of no tokens costs nothing and comes with every other one. A leaf
    without any token gives none. Null lang and source count as '' in the tree. Rows that
    repeat a doc_id have equal hashes and are taken or left together. An empty
    table gives none. Columns of docs named domain, n_tokens or epoch are
    replaced; `slices` is the number of hex digits that tell hash slices.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "mixing")
    weights = WEIGHTS if weights is None else weights
    own = docs.drop("domain", "n_tokens", "epoch")
    lang_, source_, dom_, lan_, sou_, whole_, last_ = tk.fresh([*own.columns, "domain", "n_tokens", "epoch"], "_lang", "_source", "_d", "_l", "_s", "_whole", "_last")
    made = {"domain": domain_of(F.col("source")) if domain is None else domain, lang_: F.coalesce("lang", F.lit("")), source_: F.coalesce("source", F.lit("")), "n_tokens": tokens_of(F.col("text"))}
    rows = own.withColumns(made)
    light = staged.put(rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "domain", F.col(lang_).alias("lang"), F.col(source_).alias("source"), "n_tokens"))
    leaves = staged.put(light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = float(leaves.agg(F.sum("tokens")).first()[0] or 0) * fraction
    plan = staged.put(budgets(leaves, total, weights, max_epochs).select(*LEVELS, "tokens", "budget"))
    # a budget is a whole number of epochs and a rest; rounding noise of a full budget is no rest
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.lit(max_epochs))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    key = lambda id_, whole: F.md5(F.concat_ws("|", F.lit(str(seed)), whole.cast("string"), id_).cast("binary"))
    keyed = light.join(plan.select(*LEVELS, "whole", "rest"), list(LEVELS)).withColumn("key", key(F.col("id"), F.col("whole"))).withColumn("slice", F.substring("key", 1, slices))
    sums = keyed.groupBy(*LEVELS, "rest", "slice").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = staged.put(sums.withColumn("upto", F.sum("n").over(upto)))
    # the first slice that does not fit holds the threshold; all slices below it fit
    edge = run.filter("upto > rest").groupBy(*LEVELS).agg(F.min("slice").alias("slice"), F.min_by(F.col("upto") - F.col("n"), "slice").alias("base"))
    inner = Window.partitionBy(*LEVELS).orderBy("key")
    fits = keyed.join(edge, [*LEVELS, "slice"]).withColumn("upto", F.col("base") + F.sum("n_tokens").over(inner)).filter("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cut = staged.put(
        plan.join(edge.select(*LEVELS, "slice"), list(LEVELS), "left").join(fits, list(LEVELS), "left")
        # keys below the edge's slice compare below its digits; no edge: all fit
        .select(*[F.col(c).alias(x) for c, x in zip(LEVELS, (dom_, lan_, sou_))], F.col("whole").alias(whole_), F.when(F.col("rest") >= 1, F.coalesce("last", "slice", F.lit("g"))).otherwise("").alias(last_))
    )
    met = rows.join(cut, (F.col("domain") == F.col(dom_)) & (F.col(lang_) == F.col(lan_)) & (F.col(source_) == F.col(sou_)))
    part = key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(whole_)) <= F.col(last_)
    copies = F.col(whole_) + part.cast("int")
    out = met.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    return out.select(*own.columns, "domain", "n_tokens", "epoch")


def op4_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: half of all tokens of documents, by WEIGHTS."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


QUERIES = {"op4_mixing_weights": op4_mixing_weights}


def _sql_level(name: str, keys: str, parent: str, weight: str, share: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}0 AS (SELECT {keys}, sum(lim) AS lim, {weight} AS w, any_value({share}) AS share FROM {'leaf' if not parent else f'leaf JOIN {chr(ord(name) - 1)} USING ({parent})'} GROUP BY {keys}),
{name}1 AS (SELECT *, coalesce(sum(lim) OVER ({by} ORDER BY lim / w, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY lim / w, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ww FROM {name}0),
{name}2 AS (SELECT *, ww > 1e-9 AND lim / w * ww <= share - c AS f FROM {name}1),
{name}3 AS (SELECT *, sum(CASE WHEN f THEN lim ELSE 0.0 END) OVER ({by}) AS fc, sum(CASE WHEN f THEN 0.0 ELSE w END) OVER ({by}) AS fw FROM {name}2),
{name} AS (SELECT {keys}, CASE WHEN f THEN lim WHEN fw > 1e-9 THEN greatest(share - fc, 0.0) * w / fw ELSE 0.0 END AS budget FROM {name}3)"""


def mixing_sql(docs: str = "documents") -> str:
    """The contract query for DuckDB over any relation with the columns of documents."""
    return f"""
WITH t AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'domain' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {docs}),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * 4 AS lim FROM t GROUP BY ALL),{
    _sql_level('a', 'domain', '', "CASE domain WHEN 'domain0' THEN 4.0::DOUBLE WHEN 'domain1' THEN 3.0::DOUBLE WHEN 'domain2' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END", "(SELECT sum(tokens) * 0.5::DOUBLE FROM leaf)")},{
    _sql_level('b', 'domain, lang', 'domain', "CASE lang WHEN 'en' THEN 2.0::DOUBLE WHEN 'de' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END", 'budget')},{
    _sql_level('c', 'domain, lang, source', 'domain, lang', '1.0::DOUBLE', 'budget')},
p AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(least(floor(budget / tokens + 1e-9), 4) AS INTEGER) ELSE 0 END AS whole FROM leaf JOIN c USING (domain, lang, source)),
k AS (SELECT t.*, whole, budget - whole * tokens AS rest, md5('17|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM t JOIN p USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest AND rest >= 1 AS part FROM k)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, CAST(unnest(range(0, whole + CAST(part AS INTEGER))) AS INTEGER) AS epoch FROM s
"""


SQL = {"op4_mixing_weights": mixing_sql()}
