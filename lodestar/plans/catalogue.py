"""Queries by name over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import library
from lodestar.operators import dml, relational, windows
from lodestar.plans.dialect import rewrite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    """Registers a DataFrame query and, where there is one, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def dialect(name: str, text: str, oracle: str | None, args=None) -> None:
    """Registers a query that is written in the dialect itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = rewrite(text, args)
        if "ls_json_contains(" in sql:
            library.register_python(spark)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                _read(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name] = run
    if oracle is not None:
        SQL[name] = oracle


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate
HAVING sum(l_extendedprice * (1 - l_discount)) > 1000 ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def flagship_top_orders(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = _read(spark, sf_dir, "lineitem").filter("l_shipdate > TIMESTAMP_NTZ'1995-03-15 00:00:00'")
    joined = c.join(o, c.c_custkey == o.o_custkey).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    total = joined.groupBy("l_orderkey", "o_orderdate").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("t")).filter("t > 1000")
    return relational.top_k(total.select("l_orderkey", F.round("t", 2).alias("revenue"), "o_orderdate"), [F.desc("revenue"), "l_orderkey"], 10)


# scans, projections, filters
@query("SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def scan_project(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


dialect("filter_bool_nested", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.03) OR (l_returnflag = 'R' AND (l_tax >= 0.07 OR l_linenumber = 1)) AND 1 = 1",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.03) OR (l_returnflag = 'R' AND (l_tax >= 0.07 OR l_linenumber = 1))")
dialect("filter_columns", "SELECT o.o_orderkey FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > c.c_acctbal * 20",
        "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 20")
dialect("filter_in_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority NOT IN ('1-URGENT') AND o_custkey NOT BETWEEN 5 AND 9",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority NOT IN ('1-URGENT') AND o_custkey NOT BETWEEN 5 AND 9")
dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand#__'",
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand#__'")
dialect("filter_null", "SELECT c.c_custkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
        "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
dialect("filter_not_null", "SELECT count(*) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL",
        "SELECT count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
dialect("bind_params", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'", [100000, "O"])

# joins
dialect("join_inner", "SELECT n.n_name, r.r_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
dialect("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
dialect("join_right", "SELECT o.o_orderkey, c.c_name FROM orders AS o RIGHT JOIN customer AS c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
dialect("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier AS s FULL OUTER JOIN customer AS c ON s.s_suppkey = c.c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
dialect("join_chain_star",
        "SELECT r.r_name, count(*) AS n, SUM(o.o_totalprice) AS total FROM region AS r INNER JOIN nation AS n ON r.r_regionkey = n.n_regionkey INNER JOIN customer AS c ON n.n_nationkey = c.c_nationkey INNER JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY r.r_name",
        "SELECT r_name, count(*) AS n, sum(o_totalprice) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
dialect("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
dialect("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders )", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti_frame(spark, sf_dir):
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return relational.anti(c, o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT e1.event_id AS a, e2.event_id AS b FROM events e1 ASOF JOIN events e2 ON e1.user_id = e2.user_id AND e1.event_type = e2.event_type AND e1.event_id < e2.event_id")
def join_self(spark, sf_dir):
    """Every event with the user's next one of the same type."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(windows.over(["user_id", "event_type"], ["event_id"])).alias("n"))
    after = e.select(F.col("event_id").alias("b"), "user_id", "event_type", (F.col("n") - 1).alias("n"))
    return e.join(after, ["user_id", "event_type", "n"]).select(F.col("event_id").alias("a"), "b")


@query("SELECT user_id, event_id, u.n FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u USING (user_id)")
def join_salted(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_id")
    return relational.salted_join(e, e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id").select("user_id", "event_id", "n")


dialect("join_agg", "SELECT o.o_orderpriority, SUM(l.l_quantity) AS qty, AVG(l.l_discount) AS disc FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority",
        "SELECT o_orderpriority, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
dialect("join_topk", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 25",
        "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")

# aggregation
dialect("agg_global", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS lines, AVG(l_quantity) AS q, MIN(l_shipdate) AS first_day, MAX(l_returnflag) AS flag FROM lineitem ",
        "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, avg(l_quantity) AS q, min(l_shipdate) AS first_day, max(l_returnflag) AS flag FROM lineitem")
dialect("agg_empty", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem WHERE l_orderkey < 0", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_orderkey < 0")
dialect("agg_group", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS qty, AVG(l_extendedprice) AS price, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, avg(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY ALL")
dialect("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 2",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 2")
dialect("agg_minmax_types", "SELECT MIN(p_name) AS a, MAX(p_size) AS b, MIN(p_retailprice) AS c, MAX(p_brand) AS d FROM part ", "SELECT min(p_name) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_brand) AS d FROM part")
dialect("agg_null_group", "SELECT o.o_orderstatus, COUNT(*) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY o.o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY o_orderstatus")
dialect("agg_expr_group", "SELECT DATE_TRUNC('day', ts) AS day, COUNT(*) AS n, SUM(value) AS v FROM events GROUP BY DATE_TRUNC('day', ts)",
        "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL")
dialect("distinct_single", "SELECT DISTINCT l_shipdate FROM lineitem ", "SELECT DISTINCT l_shipdate FROM lineitem")
dialect("distinct_multi_order", "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem ORDER BY l_returnflag DESC, l_linenumber LIMIT 7", "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem ORDER BY l_returnflag DESC, l_linenumber LIMIT 7")
dialect("ext_count_distinct", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(l_suppkey) AS n FROM lineitem ", "SELECT count(DISTINCT l_partkey) AS parts, count(l_suppkey) AS n FROM lineitem")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def ext_approx_distinct(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey + 100 FROM customer EXCEPT ALL SELECT s_nationkey + 100 FROM supplier)")
def ext_intersect_except(spark, sf_dir):
    c, s = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).union(c.exceptAll(s).select((F.col("k") + 100).alias("k")))


# sorts
dialect("sort_multi", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey")
dialect("sort_nulls", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey, c.c_custkey",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey")
dialect("sort_function", "SELECT p_partkey FROM part ORDER BY LENGTH(p_name), p_partkey", "SELECT p_partkey FROM part ORDER BY strlen(p_name), p_partkey")
dialect("sort_natural", "SELECT s_name, NATURAL_SORT(s_name) AS k FROM supplier ORDER BY NATURAL_SORT(s_name)",
        "SELECT s_name, list_aggregate(list_transform(regexp_extract_all(s_name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, CAST(greatest(20, length(x)) AS INTEGER), '0') ELSE x END), 'string_agg', '') AS k FROM supplier ORDER BY k")
dialect("topk", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
dialect("limit_offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 15 OFFSET 40", "SELECT event_id FROM events ORDER BY event_id LIMIT 15 OFFSET 40")

# sets, derived tables, CTEs, subqueries
dialect("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region ", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
dialect("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region ", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")


@query("(SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) UNION ALL SELECT s_nationkey FROM supplier")
def union_mixed_chain(spark, sf_dir):
    n, r, s = (_read(spark, sf_dir, t).select(c) for t, c in (("nation", "n_regionkey"), ("region", "r_regionkey"), ("supplier", "s_nationkey")))
    return relational.union(n.toDF("k"), ("distinct", r), ("all", s))


dialect("derived_table", "SELECT t.k, t.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 12", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE n > 12")
dialect("cte_multi", "WITH a AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT k, t FROM a WHERE t > 1000000) SELECT COUNT(*) AS n, MAX(t) AS m FROM b",
        "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1), b AS (SELECT k, t FROM a WHERE t > 1000000) SELECT count(*) AS n, max(t) AS m FROM b")
dialect("cte_join_agg", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT c.c_mktsegment, COUNT(*) AS n FROM big JOIN customer AS c ON big.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
        "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000 GROUP BY 1")
dialect("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders )", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
dialect("subq_in_agg", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 20)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 20)")
dialect("subq_correlated", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer ", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")

# windows
dialect("win_rank_family", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders ",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders")


@query("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders")
def win_ntile_std(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(windows.over(["o_custkey"], ["o_orderkey"])).cast("long").alias("q"))


dialect("win_ntile_parity", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders ",
        "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 4 / count(*) OVER (PARTITION BY o_custkey)) + 1 AS BIGINT) AS q FROM orders")
dialect("win_lag_lead", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, LEAD(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events ",
        "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events")
dialect("win_first_last_nth", "SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, NTH_VALUE(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events ",
        "SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, value AS l, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events")
dialect("win_running", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, MIN(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lo, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM events ",
        "SELECT event_id, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
dialect("win_partition_totals", "SELECT l_orderkey, l_linenumber, SUM(l_linenumber) OVER (PARTITION BY l_orderkey) AS s, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem ",
        "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey) AS BIGINT) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
dialect("win_moving_frame", "SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM events ORDER BY event_id",
        "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM events ORDER BY event_id")
dialect("win_rank_unordered", "SELECT n_nationkey, RANK() OVER (PARTITION BY n_regionkey) AS r FROM nation ", "SELECT n_nationkey, 1::BIGINT AS r FROM nation")

# scalar functions
dialect("fn_string", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS n, SUBSTR(p_name, 2, 4) AS s, SUBSTR(p_name, 0, 3) AS z, REPLACE(p_type, 'A', '__') AS r, CONCAT(p_brand, NULL, '-', p_size) AS c, TRIM('  x ') AS t, LTRIM(p_name, 'abc') AS lt FROM part ",
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, strlen(p_name) AS n, substr(p_name, 2, 4) AS s, substr(p_name, 1, 3) AS z, replace(p_type, 'A', '__') AS r, concat(p_brand, NULL, '-', p_size) AS c, 'x' AS t, ltrim(p_name, 'abc') AS lt FROM part")
dialect("fn_numeric", "SELECT c_custkey, ABS(c_acctbal) AS a, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, ROUND(c_acctbal, 1) AS r, MOD(c_custkey, 7) AS m, -c_custkey AS neg, c_custkey / 4 AS q FROM customer ",
        "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal, 1) AS r, c_custkey % 7 AS m, -c_custkey AS neg, c_custkey / 4 AS q FROM customer")
dialect("fn_conditional", "SELECT o.o_orderkey, COALESCE(o.o_orderstatus, c.c_name) AS x, NULLIF(o.o_orderstatus, 'F') AS y FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey",
        "SELECT o_orderkey, coalesce(o_orderstatus, c_name) AS x, nullif(o_orderstatus, 'F') AS y FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
dialect("fn_case", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS code FROM lineitem ",
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS code FROM lineitem")
dialect("fn_cast", "SELECT p_partkey, CAST(p_retailprice AS INT8) AS i, CAST(p_size AS TEXT) AS t, p_size::DOUBLE AS d, CAST(p_size AS BOOLEAN) AS b FROM part ",
        "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, p_size::DOUBLE AS d, p_size <> 0 AS b FROM part")
dialect("fn_cast_lenient", "SELECT o_orderkey, CAST(o_orderpriority AS INT8) AS p, CAST(CONCAT(o_orderkey, '.5kg') AS DOUBLE) AS w, CAST(o_orderstatus AS INT4) AS z FROM orders ",
        "SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT) AS p, o_orderkey + 0.5::DOUBLE AS w, 0::INTEGER AS z FROM orders")
dialect("fn_datetime_trunc", "SELECT event_id, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('month', ts) AS m, DATE_TRUNC('year', ts) AS y FROM events ",
        "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('year', ts)::TIMESTAMP AS y FROM events")
dialect("fn_datetime_extract", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT('month', ts) AS m, DATE_PART('day', ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s, EXTRACT(MICROSECOND FROM ts) AS us, EXTRACT(EPOCH FROM ts) AS e FROM events ",
        "SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS m, extract(day FROM ts) AS d, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi, extract(second FROM ts) AS s, extract(microsecond FROM ts) % 1000000 AS us, CAST(floor(extract(epoch FROM ts)) AS BIGINT) AS e FROM events")
dialect("fn_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS a, o_orderdate - INTERVAL '3 days 4 hours' AS b, o_orderdate + INTERVAL '1 year 2 weeks' AS c FROM orders ",
        "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS a, o_orderdate - INTERVAL '3 days 4 hours' AS b, o_orderdate + INTERVAL '1 year 14 days' AS c FROM orders")
dialect("fn_timestamp_text", "SELECT event_id, TO_TIMESTAMP('2024-01-31 10:00:00') + INTERVAL '1 month' AS t FROM events WHERE ts > TO_TIMESTAMP('2000-01-01 00:00:00')",
        "SELECT event_id, TIMESTAMP '2024-02-29 10:00:00' AS t FROM events WHERE ts > TIMESTAMP '2000-01-01'")

# JSON, vectors, full text
dialect("json_extract", "SELECT event_id, props ->> 'k' AS k, JSON_EXTRACT(props, '$.k') AS e, props -> 'k' AS j, props ->> 'nope' AS n FROM events ",
        "SELECT event_id, props ->> '$.k' AS k, props ->> '$.k' AS e, props ->> '$.k' AS j, NULL::VARCHAR AS n FROM events")
dialect("json_type_len_valid", "SELECT event_id, JSON_TYPE(props) AS t, JSON_TYPE(props, '$.k') AS kt, JSON_VALID(props) AS v, JSON_VALID(event_type) AS w, JSON_ARRAY_LENGTH(props) AS n, JSON_ARRAY_LENGTH('[1,2,3]') AS m FROM events ",
        "SELECT event_id, 'object' AS t, 'integer' AS kt, 1::BIGINT AS v, 0::BIGINT AS w, NULL::BIGINT AS n, 3::BIGINT AS m FROM events")
dialect("json_contains_kv", "SELECT event_id FROM events WHERE JSON_CONTAINS(props, '{\"k\": 7}')", "SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS INTEGER) = 7")
dialect("json_group", "SELECT props ->> 'k' AS k, COUNT(*) AS n FROM events GROUP BY props ->> 'k'", "SELECT props ->> '$.k' AS k, count(*) AS n FROM events GROUP BY 1")
_V = "[" + ", ".join(f"{(i % 7) / 10 - 0.25:.2f}" for i in range(64)) + "]"
dialect("vec_l2_topk", f"SELECT vec_id, ROUND(VEC_L2(embedding, '{_V}'), 5) AS d FROM embeddings ORDER BY VEC_L2(embedding, '{_V}'), vec_id LIMIT 10",
        f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_V}::FLOAT[]::DOUBLE[]), 5) AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}::FLOAT[]::DOUBLE[]), vec_id LIMIT 10")
dialect("vec_cosine_topk", f"SELECT vec_id, ROUND(VEC_COSINE(embedding, '{_V}'), 5) AS d FROM embeddings ORDER BY VEC_COSINE(embedding, '{_V}'), vec_id LIMIT 10",
        f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_V}::FLOAT[]::DOUBLE[]), 5) AS d FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_V}::FLOAT[]::DOUBLE[]), vec_id LIMIT 10")
_TOK = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in library.STOP_WORDS) + "], w))"
dialect("fts_match_terms", "SELECT doc_id FROM documents WHERE MATCH(text, 'er of th')", f"SELECT doc_id FROM (SELECT doc_id, {_TOK} AS d FROM documents) WHERE list_has_all(d, ['er', 'th'])")
dialect("fts_match_phrase", "SELECT doc_id FROM documents WHERE MATCH(text, '\"this en\"')", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS d FROM documents) WHERE contains(d, ' this en ')")
# TS_RANK by list functions: counts, coverage, length, phrase, and the smallest stretch that ends at a token and holds every term
_RANK = f"""WITH t AS (SELECT doc_id, {_TOK} AS d FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, d, {{q}} AS q FROM t),
c AS (SELECT doc_id, d, len(q) AS n, list_transform(q, lambda x: len(list_filter(d, lambda y: y = x))) AS c,
  list_filter(list_transform(d, lambda y, i: CASE WHEN y = q[1] THEN i END), lambda i: i IS NOT NULL) AS at1, list_filter(list_transform(d, lambda y, i: CASE WHEN y = q[2] THEN i END), lambda i: i IS NOT NULL) AS at2 FROM q),
s AS (SELECT *, len(list_filter(c, lambda x: x > 0)) AS hit,
  list_min(list_transform(list_concat(at1, at2), lambda e: e - least(list_max(list_filter(at1, lambda i: i <= e)), list_max(list_filter(at2, lambda i: i <= e)),
    CASE WHEN len(list_filter(at1, lambda i: i <= e)) * len(list_filter(at2, lambda i: i <= e)) = 0 THEN -1000000000 END) + 1)) AS span FROM c)"""
_RANKED = "list_sum(list_transform(c, lambda x: ln(1 + x) / (1 + ln(1 + x)))) / n * (0.5 + 0.5 * hit / n) / sqrt(1 + greatest(len(d) - n, 0) / 20.0)"
_NEAR = "CASE WHEN hit = n THEN 0.2 * (n / span::DOUBLE) * hit / n ELSE 0 END"
dialect("fts_rank", "SELECT doc_id, ROUND(TS_RANK(text, 'er th'), 6) AS r FROM documents ORDER BY r DESC, doc_id LIMIT 20",
        _RANK.replace("{q}", "['er', 'th']") + f" SELECT doc_id, round(coalesce(CASE WHEN hit = 0 THEN 0 ELSE {_RANKED} + {_NEAR} END, 0), 6)::DOUBLE AS r FROM documents LEFT JOIN s USING (doc_id) ORDER BY r DESC, doc_id LIMIT 20")
dialect("fts_rank_phrase", "SELECT doc_id, ROUND(TS_RANK(text, '\"this en\"'), 6) AS r FROM documents ",
        _RANK.replace("{q}", "['this', 'en']") + f" SELECT doc_id, round(coalesce(CASE WHEN hit = 0 THEN 0 ELSE {_RANKED} + CASE WHEN contains(' ' || array_to_string(d, ' ') || ' ', ' this en ') THEN 0.25 ELSE 0 END + {_NEAR} END, 0), 6)::DOUBLE AS r FROM documents LEFT JOIN s USING (doc_id)")
dialect("json_contains_array", "SELECT event_id, JSON_CONTAINS(CONCAT('{\"a\": [', event_id, ', 1, {\"k\": ', user_id, '}, 1]}'), '{\"a\": [1, 1, {\"k\": 3}]}') AS c FROM events ",
        "SELECT event_id, user_id = 3 AS c FROM events")
dialect("fn_floor_whole", "SELECT o_orderkey, FLOOR(o_orderkey + 9007199254740993) AS f, CEIL(o_custkey) AS c, FLOOR(-o_totalprice) AS n, CEIL(o_totalprice) AS u FROM orders ",
        "SELECT o_orderkey, o_orderkey + 9007199254740993 AS f, o_custkey AS c, floor(-o_totalprice) AS n, ceil(o_totalprice) AS u FROM orders")
dialect("agg_count_json", "SELECT COUNT(*) AS n FROM events WHERE JSON_CONTAINS(props, '{\"k\": 7}')", "SELECT count(*) AS n FROM events WHERE CAST(props ->> '$.k' AS INTEGER) = 7")
dialect("agg_count_match", "SELECT COUNT(*) AS n FROM documents WHERE MATCH(text, 'er of th')", f"SELECT count(*) AS n FROM (SELECT {_TOK} AS d FROM documents) WHERE list_has_all(d, ['er', 'th'])")
dialect("win_avg", "SELECT l_orderkey, l_linenumber, AVG(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS m FROM lineitem ",
        "SELECT l_orderkey, l_linenumber, avg(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM lineitem")
dialect("win_range_frame", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events ",
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events")
dialect("union_order_limit", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region ORDER BY name DESC LIMIT 12", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region ORDER BY name DESC LIMIT 12")
dialect("select_star", "SELECT * FROM supplier ", "SELECT * FROM supplier")
dialect("fn_now_uuid", "SELECT n_nationkey, LENGTH(GEN_RANDOM_UUID()) AS len, GEN_RANDOM_UUID() = GEN_RANDOM_UUID() AS same, NOW() > TO_TIMESTAMP('2024-01-01 00:00:00') AS late FROM nation ",
        "SELECT n_nationkey, 36::BIGINT AS len, false AS same, true AS late FROM nation")
dialect("join_anti_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_custkey, 5) NOT IN (SELECT NULLIF(o_custkey, 4) FROM orders )",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE nullif(o_custkey, 4) = nullif(c_custkey, 5))")


# writes as transforms: the rows after the statement
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 0 FROM region")
def dml_insert_select(spark, sf_dir):
    new = _read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(0).alias("n_regionkey"))
    return dml.insert(_read(spark, sf_dir, "nation"), new).rows


@query("SELECT row_number() OVER (ORDER BY n_nationkey) + 24 AS n_nationkey, 'new' AS n_name, 1::INTEGER AS n_regionkey FROM nation WHERE n_nationkey < 3")
def dml_insert_defaults(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    new = nation.filter("n_nationkey < 3").select(F.lit(None).cast("int").alias("n_nationkey"), F.lit("new").alias("n_name"), F.lit(1).alias("n_regionkey"))
    return dml.with_numbers(nation, new, "n_nationkey").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey <= 10 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 100000, s_acctbal FROM supplier WHERE s_suppkey <= 5")
def dml_upsert_update(spark, sf_dir):
    old = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = old.filter("s_suppkey <= 10").withColumn("s_acctbal", F.lit(1.0)).union(old.filter("s_suppkey <= 5").select(F.col("s_suppkey") + 100000, "s_acctbal"))
    return dml.upsert(old, new, ["s_suppkey"], {"s_acctbal": "o.s_acctbal + excluded.s_acctbal"}).rows


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 900, 'fresh'")
def dml_upsert_nothing(spark, sf_dir):
    old = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = old.filter("n_nationkey < 4").withColumn("n_name", F.lit("clash")).union(spark.sql("SELECT 900, 'fresh' UNION ALL SELECT 900, 'fresh'"))
    return dml.insert_or_ignore(old, new, [["n_nationkey"]]).rows


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update_expr(spark, sf_dir):
    return dml.update(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": F.col("c_acctbal") * 2}, F.col("c_mktsegment") == "BUILDING").rows.drop("c_mktsegment")


@query("SELECT s_suppkey, n_name AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dml_update_from(spark, sf_dir):
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    return dml.update_from(s, "s", n, "n", F.col("s.s_nationkey") == F.col("n.n_nationkey"), {"s_name": F.col("n.n_name")}).rows.select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def dml_delete(spark, sf_dir):
    return dml.delete(_read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F").rows.select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey <= 50 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def dml_fk_set_null(spark, sf_dir):
    gone = _read(spark, sf_dir, "customer").filter("c_custkey <= 50")
    return dml.parent_deleted(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey", "set null").rows


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 50")
def dml_fk_cascade(spark, sf_dir):
    gone = _read(spark, sf_dir, "customer").filter("c_custkey <= 50")
    return dml.parent_deleted(_read(spark, sf_dir, "orders"), "o_custkey", gone, "c_custkey", "cascade").rows.select("o_orderkey")
