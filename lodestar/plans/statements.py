"""Queries that write: each fills a catalog of its own from the driver's tables, runs statements, and returns what they leave."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from lodestar.plans.catalogue import query
from lodestar.sources.session import Session

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new catalog's folder under spark.checkpoint.dir; a local one only where that is unset and all runs in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestar-catalog-"))
        shared = f"file://{_own[0]}"
    return f"{shared.rstrip('/')}/catalog-{uuid.uuid4().hex}"


@atexit.register
def _clean() -> None:
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)


def _session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    s = Session(spark, scratch(spark))
    for t in tables:
        s.attach(t, f"{sf_dir}/{t}.parquet")
    return s


_ACCOUNTS = "CREATE TABLE accounts (id INT8 PRIMARY KEY, name VARCHAR(40) NOT NULL, nation INT4, balance DOUBLE DEFAULT 0 CHECK (balance > -100000))"


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 1000001, 'one', NULL, 0 UNION ALL SELECT 1000002, 'two', 3, 5.5")
def ddl_create_insert(spark, sf_dir):
    s = _session(spark, sf_dir, "customer")
    s.sql(_ACCOUNTS)
    s.sql("INSERT INTO accounts SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
    s.sql("INSERT INTO accounts (id, name) VALUES (1000001, 'one')")
    s.sql("INSERT INTO accounts VALUES (?, ?, 3, 5.5)", [1000002, "two"])
    return s.sql("SELECT * FROM accounts")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_name AS name FROM customer")
def dml_autoincrement_returning(spark, sf_dir):
    s = _session(spark, sf_dir, "customer")
    s.sql("CREATE TABLE numbered (id INT8 PRIMARY KEY AUTOINCREMENT, name TEXT)")
    return s.sql("INSERT INTO numbered (name) SELECT c_name FROM customer ORDER BY c_custkey RETURNING *")


@query("""SELECT c_custkey AS id, coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal) AS balance FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0""")
def dml_update_correlated(spark, sf_dir):
    s = _session(spark, sf_dir, "customer", "orders")
    s.sql(_ACCOUNTS)
    s.sql("INSERT INTO accounts SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
    s.sql("UPDATE accounts SET balance = COALESCE((SELECT SUM(o_totalprice) FROM orders WHERE o_custkey = accounts.id), balance) WHERE MOD(id, 3) = 0")
    return s.sql("SELECT id, balance FROM accounts")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey <= 500 THEN (c_custkey * 2 + 1) * 2 + 3 ELSE c_custkey END AS n FROM customer UNION ALL SELECT c_custkey + 10000000, 1 * 2 + 3 FROM customer WHERE c_custkey <= 500")
def dml_upsert_in_turn(spark, sf_dir):
    s = _session(spark, sf_dir, "customer")
    s.sql("CREATE TABLE t (id INT8 PRIMARY KEY, n INT8)")
    s.sql("INSERT INTO t SELECT c_custkey, c_custkey FROM customer")
    s.sql("""INSERT INTO t SELECT id, n FROM (SELECT c_custkey AS id, 1 AS n FROM customer WHERE c_custkey <= 500 UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_custkey <= 500
        UNION ALL SELECT c_custkey + 10000000, 1 FROM customer WHERE c_custkey <= 500 UNION ALL SELECT c_custkey + 10000000, 3 FROM customer WHERE c_custkey <= 500)
        ORDER BY n ON CONFLICT DO UPDATE SET n = t.n * 2 + EXCLUDED.n""")
    return s.sql("SELECT id, n FROM t")


@query("SELECT s_suppkey AS a, s_suppkey AS b FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_suppkey + 1000000 FROM supplier")
def dml_nothing_two_keys(spark, sf_dir):
    s = _session(spark, sf_dir, "supplier")
    s.sql("CREATE TABLE t (a INT8 UNIQUE, b INT8 UNIQUE)")
    s.sql("INSERT INTO t SELECT s_suppkey, s_suppkey FROM supplier")
    s.sql("""INSERT INTO t SELECT a, b FROM (SELECT s_suppkey + 1000000 AS a, s_suppkey AS b, 1 AS r FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_suppkey + 1000000, 2 FROM supplier
        UNION ALL SELECT s_suppkey + 2000000, s_suppkey + 1000000, 3 FROM supplier) ORDER BY r ON CONFLICT DO NOTHING""")
    return s.sql("SELECT a, b FROM t")


@query("SELECT s_suppkey AS id, s_name AS title, 'none' AS note FROM supplier WHERE s_suppkey > 10 UNION ALL SELECT 5000000, 'last', 'new'")
def ddl_alter_table(spark, sf_dir):
    s = _session(spark, sf_dir, "supplier")
    s.sql("CREATE TABLE t (id INT8 PRIMARY KEY, name TEXT, extra INT4)")
    s.sql("INSERT INTO t SELECT s_suppkey, s_name, s_nationkey FROM supplier")
    s.sql("ALTER TABLE t ADD COLUMN note TEXT DEFAULT 'none'")
    s.sql("ALTER TABLE t DROP COLUMN extra")
    s.sql("ALTER TABLE t RENAME COLUMN name TO title")
    s.sql("ALTER TABLE t RENAME TO u")
    s.sql("INSERT INTO u VALUES (5000000, 'last', 'new')")
    s.sql("DELETE FROM u WHERE id <= 10")
    s.sql("VACUUM")
    return s.sql("SELECT * FROM u")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey <> 1")
def dml_transaction(spark, sf_dir):
    s = _session(spark, sf_dir, "nation")
    s.sql("CREATE TABLE t (k INT4 PRIMARY KEY, name TEXT, r INT4)")
    s.sql("BEGIN")
    s.sql("INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    s.sql("DELETE FROM t WHERE r = 1")
    s.sql("COMMIT")
    s.sql("BEGIN")
    s.sql("TRUNCATE TABLE t")
    s.sql("ROLLBACK")
    return s.sql("SELECT k, name FROM t")


@query("SELECT o_orderkey AS id, o_custkey + 1000000 AS cust FROM orders WHERE o_custkey > 100")
def dml_fk_update_cascade(spark, sf_dir):
    s = _session(spark, sf_dir, "customer", "orders")
    s.sql("CREATE TABLE parent (id INT8 PRIMARY KEY)")
    s.sql("CREATE TABLE child (id INT8 PRIMARY KEY, cust INT8 REFERENCES parent (id) ON UPDATE CASCADE ON DELETE CASCADE)")
    s.sql("INSERT INTO parent SELECT c_custkey FROM customer")
    s.sql("INSERT INTO child SELECT o_orderkey, o_custkey FROM orders")
    s.sql("UPDATE parent SET id = id + 1000000")
    s.sql("DELETE FROM parent WHERE id <= 1000100")
    return s.sql("SELECT id, cust FROM child")


@query("SELECT 'l_linenumber' AS column, count(*) AS rows, 0::BIGINT AS nulls, min(l_linenumber)::VARCHAR AS low, max(l_linenumber)::VARCHAR AS high FROM lineitem")
def ddl_analyze(spark, sf_dir):
    s = _session(spark, sf_dir, "lineitem")
    s.sql("CREATE TABLE t (l_linenumber INT4)")
    s.sql("INSERT INTO t SELECT l_linenumber FROM lineitem")
    return s.sql("ANALYZE t").select("column", "rows", "nulls", "low", "high")
