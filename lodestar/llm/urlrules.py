"""URL rules whose decisions also hold for a page's redirect and canonical aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Staged, table

#: (verdict, rule): a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 256


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(url: Column) -> Column:
    """Host, path and query: what stays when the scheme and the fragment go. Null where there is no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


def _without_dots(address: Column) -> Column:
    """An address whose path's '.' and '..' parts are resolved; its query stays as it is."""
    host, path, query = (F.regexp_extract(address, r"(?s)^([^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    kept = F.reduce(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    # a path that ends in a dot part names a directory
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(host, F.lit("/"), F.array_join(kept, "/"), end, query)).otherwise(address)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute url, seen from the page's url; null where it is no web address or the url has no host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_rest(url), r"^[^/?#]*[^?#]*(\?[^#]*)?", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1))
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    address = (
        F.when(target.rlike(scheme + "//"), _rest(target))
        .when(F.startswith(target, F.lit("//")), F.substring(target, F.lit(3), F.length(target)))
        .when(target.rlike(scheme) | (host == ""), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("/")), F.concat(host, target))
        .when(F.startswith(target, F.lit("?")), F.concat(host, path, target))
        .when(F.startswith(target, F.lit("#")), F.concat(host, path, query, target))
        .otherwise(F.concat(host, folder, target))
    )
    return F.concat(F.lit("http://"), _without_dots(address))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def with_rule(rows: DataFrame, rules) -> DataFrame:
    """Adds rule and ruled (its verdict) to rows with host and path: the longest rule that fits, ties by verdict allow, then by text."""
    split = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], r, v) for v, r in dict.fromkeys(rules)]
    if not split:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    if len(split) <= INLINE_RULES:
        out = None
        for host, path, rule, verdict in sorted(split, key=lambda s: (-len(s[2]), s[3] != "allow", s[2])):
            hit, value = _fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("ruled"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return rows.withColumn("_r", out).withColumns({"rule": F.col("_r.rule"), "ruled": F.col("_r.ruled")}).drop("_r")
    spark = rows.sparkSession
    listed = spark.createDataFrame(split, "rule_host string, rule_path string, rule string, ruled string").groupBy("rule_host").agg(F.collect_list(F.struct("rule_path", "rule", "ruled")).alias("own"))
    # each different host meets its suffixes' rules once, whatever the number of pages
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per_host = rows.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").groupBy("host").agg(F.flatten(F.collect_list("own")).alias("_all"))
    fit = F.filter("_all", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.reduce(
        fit,
        F.lit(None).cast("struct<rule_path:string,rule:string,ruled:string>"),
        lambda a, r: F.when(
            a.isNull() | (F.length(r["rule"]) > F.length(a["rule"])) | ((F.length(r["rule"]) == F.length(a["rule"])) & ((r["ruled"] < a["ruled"]) | ((r["ruled"] == a["ruled"]) & (r["rule"] < a["rule"])))), r
        ).otherwise(a),
    )
    return rows.join(per_host, "host", "left").withColumn("_r", best).withColumns({"rule": F.col("_r.rule"), "ruled": F.col("_r.ruled")}).drop("_all", "_r")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) addresses joined by a canonical link or a meta refresh in the page's html."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    kinds = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b"))
    target = F.transform(kinds, lambda t: F.when(F.startswith(F.lower(t), F.lit("<link")), F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).otherwise(F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    found = pages.select(F.col("url"), F.explode(target).alias("t")).filter("t != ''")
    return found.select(_address(F.col("url")).alias("a"), _address(resolved(F.col("t"), F.col("url"))).alias("b")).filter("a is not null and b is not null and a != b")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Every page's host, path, rule and verdict.

    A page with a rule of its own gets that rule's verdict. The others take
    it from their aliases, the addresses connected over canonical links, meta
    refreshes and `redirects` (columns from_url, to_url): allow if any alias
    is explicitly allowed, else block if any is blocked, else `default`.

    Null urls and urls without '://' have an empty host and path, no rule and
    no aliases. Repeated pages get a row each. Needs page_id and url; html is
    optional and null html has no links; other columns are ignored.
    """
    spark = pages.sparkSession
    staged = Staged(spark, "urls")
    judged = with_rule(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    edges = []
    if "html" in pages.columns:
        edges.append(alias_edges(pages))
    if redirects is not None:
        edges.append(redirects.select(_address(F.col("from_url")).alias("a"), _address(F.col("to_url")).alias("b")))
    out = judged.withColumn("via", F.lit(None).cast("string"))
    if edges:
        found = staged.put(reduce(DataFrame.union, edges).filter("a is not null and b is not null and a != b").distinct())
        nodes = components(found, staged)
        where = F.concat(F.lit("x://"), F.col("node"))
        known = with_rule(nodes.select("node", "component", host_of(where).alias("host"), path_of(where).alias("path")), rules)
        # 'allow' < 'block': the minimum over a component is its precedence
        decided = known.groupBy("component").agg(F.min("ruled").alias("via")).filter("via is not null")
        aliases = nodes.join(decided, "component").select("node", "via")
        out = judged.withColumn("_node", _address(F.col("url"))).join(aliases, F.col("_node") == F.col("node"), "left").drop("_node", "node")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "via", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the four rules over the whole of pages."""
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op6_url_filters": op6_url_filters}
SQL: dict[str, str] = {}
