"""Sorts, frames and joins over every row of their tables."""

import json

import pytest

from lodestar.functions import library
from lodestar.plans import catalogue
from tests.oracle import connect, plain


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ["sort_multi", "sort_nulls", "sort_function", "sort_natural", "win_moving_frame"])
def test_every_row_in_order(spark, sf_dir, con, name):
    assert "LIMIT" not in catalogue.SQL[name]
    whole = con.execute(catalogue.SQL[name]).fetchall()
    assert [plain(tuple(r)) for r in catalogue.QUERIES[name](spark, sf_dir).collect()] == [plain(r) for r in whole]


def test_not_in_is_an_anti_join(spark, sf_dir):
    for name in ("join_anti", "join_anti_null"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "NestedLoop" not in plan


def test_containment_is_one_to_one(spark):
    """A literal query, a query by row, and plain Python agree, also on texts that are no JSON."""
    documents = ['[1,1,2]', '[1,2]', '{"a":[{"b":1},{"b":1,"c":2}]}', '"x"', "not json", None, "[]", "[[1],[1,2]]", "null", "[true,1]"]
    queries = ["[1,1]", '{"a":[{"b":1,"c":2},{"b":1}]}', '{"a":[{"b":1},{"b":1,"c":2}]}', "[]", '"x"', "[[1,2],[1]]", "null", "[true]", "[1.0]"]
    df = spark.createDataFrame([(d,) for d in documents], "d string")
    library.register_python(spark)
    for q in queries:
        want = []
        for d in documents:
            try:
                want.append(d is not None and library.contains(json.loads(d), json.loads(q)))
            except ValueError:
                want.append(False)
        native = [r[0] for r in df.selectExpr(library.contains_sql("d", q)).collect()]
        by_row = [r[0] for r in df.selectExpr(f"ls_json_contains(d, {library.literal(q)})").collect()]
        assert native == want and by_row == want, q


def test_self_join_pairs_every_event(spark, sf_dir, con):
    """All events but the last of their user and type have a partner."""
    rows = catalogue.QUERIES["join_self"](spark, sf_dir).collect()
    events, groups = con.execute("SELECT count(*), count(DISTINCT (user_id, event_type)) FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL").fetchone()
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == len(rows) == events - groups
