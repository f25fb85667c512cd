"""Statements over a catalog: schema, writes, transactions, upkeep."""

import pytest

from lodestar.operators.dml import ConstraintError
from lodestar.sources.session import Session
from lodestar.sources.snapshots import ConflictError


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/catalog")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def people(s):
    s.sql("CREATE TABLE users (id INT8 PRIMARY KEY AUTOINCREMENT, email VARCHAR(20) UNIQUE, n INT4 DEFAULT 7 CHECK (n > 0))")
    return s.sql("INSERT INTO users (email, n) VALUES ('a', 1), ('b', DEFAULT), (?, ?) RETURNING id, email", ["c", 3])


def test_insert_numbers_defaults_returning(s):
    assert rows(people(s)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(s.sql("SELECT * FROM users")) == [(1, "a", 1), (2, "b", 7), (3, "c", 3)]
    assert rows(s.sql("INSERT INTO users SELECT id + 10, email || '2', n FROM users WHERE n = 7")) == [(1,)]
    assert rows(s.sql("INSERT INTO users (email) VALUES ('z') RETURNING *")) == [(13, "z", 7)]


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO users (email, n) VALUES ('x', 0)",
        "INSERT INTO users (id, email) VALUES (1, 'x')",
        "INSERT INTO users (email) VALUES ('a')",
        "INSERT INTO users (email) VALUES ('y'), ('y')",
        "INSERT INTO users (email) VALUES ('123456789012345678901')",
        "UPDATE users SET email = 'a'",
        "UPDATE users SET n = n - 1",
    ],
)
def test_constraints_leave_the_table(s, sql):
    people(s)
    with pytest.raises(ConstraintError):
        s.sql(sql)
    assert rows(s.sql("SELECT * FROM users")) == [(1, "a", 1), (2, "b", 7), (3, "c", 3)]


def test_do_nothing_with_two_keys(s):
    s.sql("CREATE TABLE t (a INT4 UNIQUE, b INT4 UNIQUE)")
    s.sql("INSERT INTO t VALUES (7, 70)")
    s.sql("INSERT INTO t VALUES (1, 70), (1, 71), (2, 71), (2, 72), (NULL, 72), (NULL, NULL), (NULL, NULL) ON CONFLICT DO NOTHING")
    assert rows(s.sql("SELECT * FROM t")) == rows(s.spark.createDataFrame([(7, 70), (1, 71), (2, 72), (None, None), (None, None)], "a int, b int"))


def test_upsert_in_turn(s):
    people(s)
    out = s.sql("INSERT INTO users (id, email, n) VALUES (1, 'a', 5), (1, 'q', 2), (9, 'i', 1), (9, 'j', 4) ON CONFLICT DO UPDATE SET n = users.n * 10 + excluded.n, email = EXCLUDED.email RETURNING *")
    assert rows(out) == [(1, "q", 152), (9, "j", 14)]
    assert rows(s.sql("SELECT * FROM users")) == [(1, "q", 152), (2, "b", 7), (3, "c", 3), (9, "j", 14)]
    s.sql("INSERT INTO users (email, n) VALUES ('b', 1) ON CONFLICT DO UPDATE SET n = n + excluded.n")
    assert (2, "b", 8) in rows(s.sql("SELECT * FROM users"))


def test_update_delete(s):
    people(s)
    s.sql("CREATE TABLE pay (uid INT8, amount INT4)")
    s.sql("INSERT INTO pay VALUES (1, 10), (1, 5), (2, 3)")
    assert rows(s.sql("UPDATE users SET n = n + (SELECT SUM(amount) FROM pay WHERE pay.uid = users.id) WHERE id IN (SELECT uid FROM pay) RETURNING id, n")) == [(1, 16), (2, 10)]
    with pytest.raises(ConstraintError):
        s.sql("UPDATE users SET n = pay.amount FROM pay WHERE pay.uid = users.id")
    s.sql("UPDATE users SET n = p.amount FROM (SELECT * FROM pay WHERE amount < 10) AS p WHERE p.uid = users.id")
    assert rows(s.sql("SELECT id, n FROM users")) == [(1, 5), (2, 3), (3, 3)]
    assert rows(s.sql("DELETE FROM users WHERE id NOT IN (SELECT uid FROM pay) RETURNING email")) == [("c",)]
    assert rows(s.sql("TRUNCATE TABLE pay")) == [(3,)]
    assert rows(s.sql("SELECT COUNT(*) FROM pay")) == [(0,)]


def test_foreign_keys(s):
    people(s)
    s.sql("CREATE TABLE a (id INT4 PRIMARY KEY, u INT8 REFERENCES users (id) ON DELETE CASCADE ON UPDATE CASCADE)")
    s.sql("CREATE TABLE b (x INT4, a INT4, FOREIGN KEY (a) REFERENCES a (id) ON DELETE SET NULL)")
    s.sql("CREATE TABLE c (u INT8 REFERENCES users (id))")
    s.sql("INSERT INTO a VALUES (10, 1), (20, 2), (30, NULL)")
    s.sql("INSERT INTO b VALUES (1, 10), (2, 20)")
    s.sql("INSERT INTO c VALUES (3)")
    for bad in ("INSERT INTO a VALUES (40, 99)", "DELETE FROM users WHERE id = 3", "UPDATE users SET id = 33 WHERE id = 3", "DROP TABLE users"):
        with pytest.raises(ConstraintError):
            s.sql(bad)
    s.sql("UPDATE users SET id = 22 WHERE id = 2")
    s.sql("DELETE FROM users WHERE id = 1")
    assert rows(s.sql("SELECT * FROM a")) == [(20, 22), (30, None)]
    assert rows(s.sql("SELECT * FROM b")) == [(1, None), (2, 20)]
    s.sql("PRAGMA foreign_keys = off")
    s.sql("DELETE FROM users WHERE id = 3")
    assert rows(s.sql("PRAGMA quick_check")) == [("ok",)]
    s.sql("PRAGMA foreign_keys = on")
    assert rows(s.sql("PRAGMA integrity_check"))[0][0].startswith("c: ")


def test_alter(s):
    people(s)
    s.sql("ALTER TABLE users ADD COLUMN tag TEXT DEFAULT 'old'")
    s.sql("INSERT INTO users (email, tag) VALUES ('d', 'new')")
    s.sql("ALTER TABLE users RENAME COLUMN email TO mail")
    s.sql("ALTER TABLE users RENAME TO folk")
    assert rows(s.sql("SELECT mail, tag FROM folk")) == [("a", "old"), ("b", "old"), ("c", "old"), ("d", "new")]
    with pytest.raises(ConstraintError):
        s.sql("ALTER TABLE folk DROP COLUMN mail")
    s.sql("ALTER TABLE folk DROP COLUMN tag")
    assert s.sql("SELECT * FROM folk").columns == ["id", "mail", "n"]
    with pytest.raises(Exception):
        s.sql("SELECT * FROM users").collect()
    s.sql("DROP TABLE folk")
    s.sql("DROP TABLE IF EXISTS folk")


def test_transactions(spark, s):
    people(s)
    other = Session(spark, s.store.root)
    s.sql("BEGIN")
    s.sql("DELETE FROM users WHERE id = 1")
    assert rows(s.sql("SELECT COUNT(*) FROM users")) == [(2,)]
    assert rows(other.sql("SELECT COUNT(*) FROM users")) == [(3,)]
    s.sql("ROLLBACK")
    assert rows(s.sql("SELECT COUNT(*) FROM users")) == [(3,)]
    s.sql("BEGIN")
    s.sql("UPDATE users SET n = 100")
    other.sql("CREATE TABLE aside (x INT4)")
    s.sql("COMMIT")
    assert rows(other.sql("SELECT DISTINCT n FROM users")) == [(100,)]
    s.sql("BEGIN")
    s.sql("UPDATE users SET n = 1")
    other.sql("UPDATE users SET n = 2")
    with pytest.raises(ConflictError):
        s.sql("COMMIT")
    assert rows(s.sql("SELECT DISTINCT n FROM users")) == [(2,)]


def test_indexes(s):
    s.sql("CREATE TABLE d (id INT8 PRIMARY KEY, body TEXT, j JSON, v VECTOR(2), k INT4)")
    s.sql("INSERT INTO d VALUES (1, 'some text', '{\"a\": 1}', '[1, 2]', 5)")
    s.sql("CREATE INDEX k1 ON d (k, id) WHERE k > 0")
    s.sql("CREATE UNIQUE INDEX k2 ON d (k)")
    s.sql("CREATE FULLTEXT INDEX f ON d (body)")
    s.sql("CREATE INVERTED INDEX i ON d (j)")
    s.sql("CREATE HNSW INDEX h ON d (v) WITH (m = 16, ef_construction = 200)")
    for bad in ("CREATE INDEX x ON d (body)", "CREATE FULLTEXT INDEX x ON d (k)", "CREATE INDEX k1 ON d (k)", "CREATE INDEX x ON d (none)"):
        with pytest.raises(Exception):
            s.sql(bad)
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO d (id, k) VALUES (2, 5)")
    s.sql("DROP INDEX k2")
    s.sql("INSERT INTO d (id, k) VALUES (2, 5)")
    assert rows(s.sql("SELECT id FROM d WHERE MATCH(body, 'text')")) == [(1,)]
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO d (id, v) VALUES (3, '[1, 2, 3]')")


def test_upkeep(spark, s, tmp_path):
    people(s)
    s.sql("UPDATE users SET n = 9 WHERE id = 1")
    stats = {r.column: r for r in s.sql("ANALYZE users").collect()}
    assert stats["n"].rows == 3 and stats["n"].distinct == 3 and stats["email"].low == "a" and len(stats["n"].histogram) == 33 and set(stats["email"].common) == {"a", "b", "c"}
    s.sql("VACUUM")
    assert len(list((tmp_path / "catalog" / "data").iterdir())) == 1
    s.backup(f"file://{tmp_path}/copy")
    s.sql("DELETE FROM users")
    assert rows(Session(spark, f"file://{tmp_path}/copy").sql("SELECT * FROM users")) == [(1, "a", 9), (2, "b", 7), (3, "c", 3)]
    plan = s.sql("EXPLAIN SELECT n, COUNT(*) FROM users GROUP BY n")
    assert plan.columns == ["step", "operation", "detail", "rows_estimated", "rows_actual", "duration_us"] and "HashAggregate" in plan.first().operation
    ran = Session(spark, f"file://{tmp_path}/copy").sql("EXPLAIN ANALYZE SELECT n, COUNT(*) FROM users GROUP BY n").collect()
    assert ran[0].rows_actual == 3 and ran[0].duration_us > 0
