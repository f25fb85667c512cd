"""Statements of the dialect over a catalog of snapshots.

    s = Session(spark, "hdfs:///catalog")
    s.sql("CREATE TABLE t (id INT8 PRIMARY KEY AUTOINCREMENT, n INT4 CHECK (n > 0))")
    s.sql("INSERT INTO t (n) VALUES (?), (?) RETURNING id", [1, 2]).show()

A SELECT is lazy and reads the snapshot of its moment. Every other statement
runs at once and commits, or waits for COMMIT after BEGIN; a statement that
fails leaves everything as it was. UPDATE and DELETE rewrite their table.
"""

from __future__ import annotations

import copy
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import library
from lodestar.operators import dml
from lodestar.plans.dialect import TYPES, _split, bind, rewrite_tokens, tokenize, unquote
from lodestar.sources import inspect
from lodestar.sources.snapshots import Snapshots

Token = tuple[str, str]


def _name(token: Token) -> str:
    kind, text = token
    if kind == "name":
        return unquote(text)
    if kind != "word":
        raise ValueError(f"expected a name, not {text!r}")
    return text.lower()


def _at(tokens: list[Token], *words: str) -> int | None:
    """Where these words stand outside of all parentheses."""
    depth = 0
    for i, (_, text) in enumerate(tokens):
        depth += (text == "(") - (text == ")")
        if not depth and [t[1].upper() for t in tokens[i : i + len(words)]] == list(words):
            return i
    return None


def _cut(tokens: list[Token], *words: str) -> tuple[list[Token], list[Token] | None]:
    """What stands before these words, and after them."""
    i = _at(tokens, *words)
    return (tokens, None) if i is None else (tokens[:i], tokens[i + len(words) :])


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0

    def accept(self, *words: str) -> bool:
        if [t[1].upper() for t in self.t[self.i : self.i + len(words)]] != list(words):
            return False
        self.i += len(words)
        return True

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            found = self.t[self.i][1] if self.i < len(self.t) else "the end"
            raise ValueError(f"expected {' '.join(words)} before {found!r}")

    def name(self) -> str:
        if self.i >= len(self.t):
            raise ValueError("expected a name at the end")
        self.i += 1
        return _name(self.t[self.i - 1])

    def group(self) -> list[Token]:
        self.expect("(")
        start, depth = self.i, 1
        while depth:
            if self.i >= len(self.t):
                raise ValueError("unbalanced parentheses")
            depth += (self.t[self.i][1] == "(") - (self.t[self.i][1] == ")")
            self.i += 1
        return self.t[start : self.i - 1]

    def names(self) -> list[str]:
        return [_name(p[0]) for p in _split(self.group())]

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to one of these words outside of parentheses, or the end."""
        start, depth = self.i, 0
        while self.i < len(self.t) and (depth or self.t[self.i][1].upper() not in stops):
            depth += (self.t[self.i][1] == "(") - (self.t[self.i][1] == ")")
            self.i += 1
        return self.t[start : self.i]

    def rest(self) -> list[Token]:
        out, self.i = self.t[self.i :], len(self.t)
        return out


_COLUMN_WORDS = ("PRIMARY", "AUTOINCREMENT", "NOT", "NULL", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES")
_ACTIONS = {("CASCADE",): "cascade", ("SET", "NULL"): "set null", ("RESTRICT",): "restrict", ("NO", "ACTION"): "no action"}


class Session:
    def __init__(self, spark: SparkSession, root: str, foreign_keys: bool = True):
        self.spark = spark.newSession()
        self.store = Snapshots(self.spark, root)
        self.options: dict[str, object] = {"foreign_keys": foreign_keys}
        self._open: dict | None = None
        library.register_python(self.spark)

    # state
    def _state(self) -> dict:
        if self._open is not None:
            return self._open
        version = self.store.head()
        return {"base": version, "now": self.store.load(version), "changed": set(), "relied": set()}

    def table(self, name: str) -> DataFrame:
        return self.store.read(self._table(self._state()["now"], name))

    def attach(self, name: str, path: str) -> None:
        """A Parquet path as a table that statements can read and not write."""
        self.spark.read.parquet(path).createOrReplaceTempView(name)

    @staticmethod
    def _table(now: dict, name: str) -> dict:
        if name not in now["tables"]:
            raise ValueError(f"no table {name}")
        return now["tables"][name]

    def _frame(self, sql: str, now: dict) -> DataFrame:
        for name in now["tables"]:
            if re.search(rf"\b{re.escape(name)}\b", sql, re.I):
                self.store.read(now["tables"][name]).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def _note(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], list(values))

    def sql(self, text: str, args=None) -> DataFrame:
        tokens = bind(tokenize(text), args)
        while tokens and tokens[-1][1] == ";":
            tokens.pop()
        if not tokens:
            raise ValueError("empty statement")
        word = tokens[0][1].upper()
        if word in ("SELECT", "WITH", "VALUES", "("):
            return self._frame(rewrite_tokens(tokens), self._state()["now"])
        if word == "EXPLAIN":
            ran = tokens[1:2] and tokens[1][1].upper() == "ANALYZE"
            return inspect.explain(self.spark, self._frame(rewrite_tokens(tokens[1 + bool(ran) :]), self._state()["now"]), bool(ran))
        if word in ("BEGIN", "COMMIT", "ROLLBACK"):
            return self._transaction(word)
        if word == "PRAGMA":
            return self._pragma(tokens[1:])
        if word == "VACUUM":
            return self._vacuum()
        run = {"CREATE": self._create, "DROP": self._drop, "ALTER": self._alter, "INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete, "TRUNCATE": self._delete, "ANALYZE": self._analyze}.get(word)
        if run is None:
            raise ValueError(f"unknown statement {word}")
        state = self._state()
        work = {**state, "now": copy.deepcopy(state["now"]), "changed": set(state["changed"]), "relied": set(state["relied"])}
        out = run(_Reader(tokens[1:]), work)
        if self._open is not None:
            self._open = work
        else:
            self.store.commit(work["base"], work["now"], work["changed"], work["relied"])
        return out

    def _transaction(self, word: str) -> DataFrame:
        if word == "BEGIN":
            if self._open is not None:
                raise ValueError("a transaction is open already")
            self._open = self._state()
            return self._note(version=self._open["base"])
        if self._open is None:
            raise ValueError("no transaction is open")
        work, self._open = self._open, None
        if word == "ROLLBACK" or not (work["changed"] or work["now"] != self.store.load(work["base"])):
            return self._note(version=work["base"])
        return self._note(version=self.store.commit(work["base"], work["now"], work["changed"], work["relied"]))

    def backup(self, root: str) -> None:
        """The newest snapshot as a catalog of its own."""
        now, there = self.store.load(self.store.head()), Snapshots(self.spark, root)
        for t in now["tables"].values():
            t["files"] = [there.write(self.store.read(t), t)]
        there.commit(0, now, set(now["tables"]), set())

    # schema
    def _create(self, r: _Reader, work: dict) -> DataFrame:
        now = work["now"]
        unique = r.accept("UNIQUE")
        kind = next((k for k in ("FULLTEXT", "INVERTED", "HNSW") if r.accept(k)), "BTREE")
        if r.accept("INDEX"):
            return self._create_index(r, work, kind, unique)
        r.expect("TABLE")
        lenient = r.accept("IF", "NOT", "EXISTS")
        name = r.name()
        if name in now["tables"]:
            if lenient:
                return self._note(rows=0)
            raise ValueError(f"table {name} is there already")
        t = {"columns": [], "keys": [], "checks": [], "foreign": [], "files": [], "auto": None, "next": 0}
        for part in _split(r.group()):
            self._part(_Reader(part), t)
        for key in t["keys"]:
            for c in key:
                self._column(t, c)
        for f in t["foreign"]:
            parent = t if f["parent"] == name else self._table(now, f["parent"])
            if [f["key"]] not in parent["keys"]:
                raise ValueError(f"{f['parent']}({f['key']}) is not a key")
            work["relied"].add(f["parent"])
        now["tables"][name] = t
        work["changed"].add(name)
        return self._note(rows=0)

    @staticmethod
    def _column(t: dict, name: str) -> dict:
        for c in t["columns"]:
            if c["name"] == name:
                return c
        raise ValueError(f"no column {name}")

    def _part(self, r: _Reader, t: dict) -> None:
        """One column or constraint of CREATE TABLE and ADD COLUMN."""
        if r.accept("CONSTRAINT"):
            r.name()
        if r.accept("PRIMARY", "KEY"):
            t["keys"].insert(0, r.names())
            for c in t["keys"][0]:
                self._column(t, c)["required"] = True
        elif r.accept("UNIQUE"):
            t["keys"].append(r.names())
        elif r.accept("CHECK"):
            t["checks"].append(rewrite_tokens(r.group()))
        elif r.accept("FOREIGN", "KEY"):
            column = r.names()[0]
            r.expect("REFERENCES")
            t["foreign"].append(self._reference(r, column))
        else:
            name, kind = r.name(), r.name().upper()
            if kind not in TYPES:
                raise ValueError(f"unknown type {kind}")
            if any(c["name"] == name for c in t["columns"]):
                raise ValueError(f"column {name} is there already")
            size = int(r.group()[0][1]) if r.i < len(r.t) and r.t[r.i][1] == "(" else None
            t["next"] += 1
            c = {"id": f"c{t['next']}", "name": name, "kind": kind, "type": TYPES[kind], "size": size, "required": False, "default": None}
            t["columns"].append(c)
            while r.i < len(r.t):
                if r.accept("PRIMARY", "KEY"):
                    t["keys"].insert(0, [name])
                    c["required"] = True
                elif r.accept("AUTOINCREMENT"):
                    t["auto"] = name
                elif r.accept("NOT", "NULL"):
                    c["required"] = True
                elif r.accept("NULL"):
                    pass
                elif r.accept("UNIQUE"):
                    t["keys"].append([name])
                elif r.accept("DEFAULT"):
                    c["default"] = rewrite_tokens(r.until(*_COLUMN_WORDS) or r.rest()[:1])
                elif r.accept("CHECK"):
                    t["checks"].append(rewrite_tokens(r.group()))
                elif r.accept("REFERENCES"):
                    t["foreign"].append(self._reference(r, name))
                else:
                    raise ValueError(f"unknown words in column {name}: {r.t[r.i][1]}")

    @staticmethod
    def _reference(r: _Reader, column: str) -> dict:
        f = {"column": column, "parent": r.name(), "key": r.names()[0], "delete": "restrict", "update": "restrict"}
        while r.accept("ON"):
            event = next(e for e in ("delete", "update") if r.accept(e.upper()))
            f[event] = next(a for words, a in _ACTIONS.items() if r.accept(*words))
        return f

    def _create_index(self, r: _Reader, work: dict, kind: str, unique: bool) -> DataFrame:
        """Indexes are notes for the reader: scans prune by Parquet statistics. A unique one is a key of its table."""
        now = work["now"]
        lenient, name = r.accept("IF", "NOT", "EXISTS"), r.name()
        if name in now["indexes"]:
            if lenient:
                return self._note(rows=0)
            raise ValueError(f"index {name} is there already")
        r.expect("ON")
        table = r.name()
        t = self._table(now, table)
        parts = _split(r.group())
        where = rewrite_tokens(r.rest()) if r.accept("WHERE") else None
        options = rewrite_tokens(r.rest()) or None
        columns = [_name(p[0]) for p in parts if len(p) == 1]
        wanted = {"FULLTEXT": ("TEXT", "VARCHAR"), "INVERTED": ("JSON",), "HNSW": ("VECTOR",)}.get(kind)
        for c in columns:
            has = self._column(t, c)["kind"]
            if (wanted and has not in wanted) or (not wanted and has in ("TEXT", "JSON", "VECTOR")):
                raise ValueError(f"a {kind} index does not take {c} {has}")
        rows = self.store.read(t)
        rows.select(*[F.expr(rewrite_tokens(p)) for p in parts]).schema  # unknown names fail here
        if unique:
            if where or len(columns) < len(parts):
                raise ValueError("a unique index takes whole columns of all rows")
            dml.check_unique(rows, [columns])
            t["keys"].append(columns)
            work["changed"].add(table)
        now["indexes"][name] = {"table": table, "kind": kind, "parts": [rewrite_tokens(p) for p in parts], "columns": columns, "unique": unique, "where": where, "options": options}
        work["relied"].add(table)
        return self._note(rows=0)

    def _drop(self, r: _Reader, work: dict) -> DataFrame:
        now = work["now"]
        if r.accept("INDEX"):
            lenient, name = r.accept("IF", "EXISTS"), r.name()
            i = now["indexes"].pop(name, None)
            if i is None and not lenient:
                raise ValueError(f"no index {name}")
            if i and i["unique"]:
                now["tables"][i["table"]]["keys"].remove(i["columns"])
                work["changed"].add(i["table"])
            return self._note(rows=0)
        r.expect("TABLE")
        lenient, name = r.accept("IF", "EXISTS"), r.name()
        if lenient and name not in now["tables"]:
            return self._note(rows=0)
        self._table(now, name)
        for other, t in now["tables"].items():
            if other != name and any(f["parent"] == name for f in t["foreign"]):
                raise dml.ConstraintError(f"{other} refers to {name}")
        del now["tables"][name]
        now["indexes"] = {k: i for k, i in now["indexes"].items() if i["table"] != name}
        self.spark.catalog.dropTempView(name)
        work["changed"].add(name)
        return self._note(rows=0)

    def _alter(self, r: _Reader, work: dict) -> DataFrame:
        r.expect("TABLE")
        now, name = work["now"], r.name()
        t = self._table(now, name)
        work["changed"].add(name)
        used = lambda c: any(c in k for k in t["keys"]) or any(f["column"] == c for f in t["foreign"]) or any(re.search(rf"\b{re.escape(c)}\b", x) for x in t["checks"]) or any(i["table"] == name and c in i["columns"] for i in now["indexes"].values())
        if r.accept("ADD"):
            r.accept("COLUMN")
            self._part(_Reader(r.rest()), t)
            c = t["columns"][-1]
            if c["default"] is not None:
                c["old"] = self.spark.sql(f"SELECT CAST({c['default']} AS STRING)").first()[0]
            self._whole(now, name, t)
        elif r.accept("DROP"):
            r.accept("COLUMN")
            c = self._column(t, r.name())
            if used(c["name"]) or len(t["columns"]) == 1:
                raise dml.ConstraintError(f"{c['name']} is in use")
            t["columns"].remove(c)
        elif r.accept("RENAME", "TO"):
            new = r.name()
            if new in now["tables"]:
                raise ValueError(f"table {new} is there already")
            now["tables"][new] = now["tables"].pop(name)
            for other, o in now["tables"].items():
                for f in o["foreign"]:
                    if f["parent"] == name:
                        f["parent"] = new
                        work["changed"].add(other)
            for i in now["indexes"].values():
                i["table"] = new if i["table"] == name else i["table"]
            self.spark.catalog.dropTempView(name)
            work["changed"].add(new)
        else:
            r.expect("RENAME")
            r.accept("COLUMN")
            old = r.name()
            r.expect("TO")
            new, c = r.name(), self._column(t, old)
            if any(x["name"] == new for x in t["columns"]):
                raise ValueError(f"column {new} is there already")
            if any(re.search(rf"\b{re.escape(old)}\b", x) for x in t["checks"]):
                raise dml.ConstraintError(f"a check names {old}")
            c["name"] = new
            t["keys"] = [[new if k == old else k for k in key] for key in t["keys"]]
            t["auto"] = new if t["auto"] == old else t["auto"]
            for f in t["foreign"]:
                f["column"] = new if f["column"] == old else f["column"]
            for other, o in now["tables"].items():
                for f in o["foreign"]:
                    if f["parent"] == name and f["key"] == old:
                        f["key"] = new
                        work["changed"].add(other)
            for i in now["indexes"].values():
                if i["table"] == name:
                    i["columns"] = [new if k == old else k for k in i["columns"]]
        return self._note(rows=0)

    # rows
    def _whole(self, now: dict, name: str, t: dict, rows: DataFrame | None = None) -> None:
        """Every constraint of one table over all its rows."""
        rows = self.store.read(t) if rows is None else rows
        self._check(t, rows)
        dml.check_unique(rows, t["keys"])
        self._check_parents(now, t, rows)

    def _check(self, t: dict, rows: DataFrame) -> None:
        dml.check_not_null(rows, [c["name"] for c in t["columns"] if c["required"]])
        sized = [(f"`{c['name']}`", c["kind"], c["size"]) for c in t["columns"] if c["size"] and c["kind"] in ("VARCHAR", "VECTOR")]
        dml.check_expressions(rows, t["checks"] + [f"{c} IS NULL OR {'octet_length' if kind == 'VARCHAR' else 'size'}({c}) {'<=' if kind == 'VARCHAR' else '='} {size}" for c, kind, size in sized])

    def _check_parents(self, now: dict, t: dict, rows: DataFrame, work: dict | None = None) -> None:
        for f in t["foreign"] if self.options["foreign_keys"] else []:
            dml.check_parents(rows, f["column"], self.store.read(now["tables"][f["parent"]]), f["key"])
            if work is not None:
                work["relied"].add(f["parent"])

    def _returning(self, touched: DataFrame, names: list[Token] | None) -> DataFrame:
        if names is None:
            return self._note(rows=touched.count())
        return touched if names[0][1] == "*" else touched.select(*[f"`{_name(p[0])}`" for p in _split(names)])

    def _insert(self, r: _Reader, work: dict) -> DataFrame:
        r.expect("INTO")
        now, name = work["now"], r.name()
        t = self._table(now, name)
        body, returned = _cut(r.rest(), "RETURNING")
        body, conflict = _cut(body, "ON", "CONFLICT")
        b = _Reader(body)
        listed = b.names() if body and body[0][1] == "(" and body[1][1].upper() != "SELECT" else [c["name"] for c in t["columns"]]
        for c in listed:
            self._column(t, c)
        default = {c["name"]: c["default"] or "NULL" for c in t["columns"]}
        names = [f"_x{i}" for i in range(len(listed))]
        if b.accept("VALUES"):
            rows = []
            for group in _split(b.rest()):
                parts = _split(_Reader(group).group())
                if len(parts) != len(listed):
                    raise ValueError(f"{len(listed)} columns, {len(parts)} values")
                rows.append(", ".join(default[c] if p[0][1].upper() == "DEFAULT" else rewrite_tokens(p) for c, p in zip(listed, parts)))
            given = self._frame(f"SELECT * FROM VALUES {', '.join(f'({x})' for x in rows)} AS _v({', '.join(names)})", now)
        else:
            given = self._frame(rewrite_tokens(b.rest()), now)
            if len(given.columns) != len(listed):
                raise ValueError(f"{len(listed)} columns, {len(given.columns)} values")
            given = given.toDF(*names)
        source = dict(zip(listed, names))
        rows = given.select(*[F.expr(self._fit(c, source.get(c["name"]), given)).alias(c["name"]) for c in t["columns"]])
        at = "_seq"
        batch = self.store.aside(rows.withColumn(at, F.monotonically_increasing_id()))
        old = self.store.read(t)
        if t["auto"]:
            batch = dml.with_numbers(old, batch, t["auto"], at)
        work["changed"].add(name)
        if conflict is None:
            touched = batch.drop(at)
            for key in t["keys"]:
                dml.check_unique(touched, [key])
                if touched.select(*key).join(old.select(*key), key, "left_semi").head(1):
                    raise dml.ConstraintError(f"duplicate key ({', '.join(key)})")
            return self._append(work, name, touched, returned)
        c = _Reader(conflict)
        if c.i < len(conflict) and conflict[0][1] == "(":
            c.names()
        c.expect("DO")
        if c.accept("NOTHING"):
            stays = dml.insert_or_ignore(old, batch, t["keys"], at, self.store.aside).touched
            return self._append(work, name, stays, returned)
        c.expect("UPDATE", "SET")
        columns = {x["name"] for x in t["columns"]}
        assign = {}
        for part in _split(c.rest()):
            assign[_name(part[0])] = rewrite_tokens(_old_row(part[2:], name, columns))
        key, others = self._target(t, old, batch)
        change = dml.upsert(old, batch, key, assign, at)
        out = self.store.aside(change.touched)
        self._check(t, out)
        self._check_parents(now, t, out, work)
        new = self.store.write(change.rows, t)
        rows = self.store.read({**t, "files": [new]})
        dml.check_unique(rows, others + ([key] if set(key) & set(assign) else []))
        t["files"] = [new]
        return self._returning(out, returned)

    def _target(self, t: dict, old: DataFrame, batch: DataFrame) -> tuple[list[str], list[list[str]]]:
        """The key whose conflicts an upsert settles: the first that the batch meets in the table, else the first of all."""
        if not t["keys"]:
            raise ValueError("the table has no key")
        key = next((k for k in t["keys"] if batch.select(*k).join(old.select(*k), k, "left_semi").head(1)), t["keys"][0])
        return key, [k for k in t["keys"] if k != key]

    def _fit(self, c: dict, x: str | None, given: DataFrame) -> str:
        if x is None:
            return f"CAST({c['default'] or 'NULL'} AS {c['type']})"
        if c["kind"] == "VECTOR" and dict(given.dtypes)[x] == "string":
            return library.inline(f"ls_vector({x})")
        return f"lower(CAST({x} AS STRING))" if c["kind"] == "UUID" else f"CAST({x} AS {c['type']})"

    def _append(self, work: dict, name: str, rows: DataFrame, returned) -> DataFrame:
        t = work["now"]["tables"][name]
        new = self.store.write(rows, t)
        there = self.store.read({**t, "files": [new]})
        self._check(t, there)
        t["files"].append(new)
        self._check_parents(work["now"], t, there, work)
        return self._returning(there, returned)

    def _update(self, r: _Reader, work: dict) -> DataFrame:
        now, name = work["now"], r.name()
        t = self._table(now, name)
        r.expect("SET")
        body, returned = _cut(r.rest(), "RETURNING")
        body, where = _cut(body, "WHERE")
        body, source = _cut(body, "FROM")
        assign = {}
        for part in _split(body):
            assign[self._column(t, _name(part[0]))["name"]] = rewrite_tokens(part[2:])
        cond = rewrite_tokens(where) if where else "true"
        kinds = {c["name"]: c["type"] for c in t["columns"]}
        cols = list(kinds)
        if source is None:
            sets = "".join(f", CASE WHEN {cond} THEN CAST({e} AS {kinds[c]}) END AS `_new_{c}`" for c, e in assign.items())
            marked = self._frame(f"SELECT `{name}`.*, coalesce({cond}, false) AS _hit{sets} FROM `{name}`", now)
        else:
            # every row gets a number in a table of its own, so that both sides of the match see the same ones
            base = self.store.aside(self.store.read(t).withColumn("_row", F.monotonically_increasing_id()))
            self._frame(f"SELECT 1 FROM {rewrite_tokens(source)}", now)
            base.createOrReplaceTempView(name)
            sets = "".join(f", CAST({e} AS {kinds[c]}) AS `_new_{c}`" for c, e in assign.items())
            pairs = self.store.aside(self.spark.sql(f"SELECT `{name}`._row{sets} FROM `{name}`, {rewrite_tokens(source)} WHERE {cond}"))
            if pairs.groupBy("_row").count().filter("count > 1").head(1):
                raise dml.ConstraintError("UPDATE FROM: more than one source row matches")
            marked = base.join(pairs.withColumn("_hit", F.lit(True)), "_row", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        out = self.store.aside(marked.select(*[F.col(f"`{c}`").alias(f"_old_{c}") for c in cols], *[F.when(F.col("_hit"), F.col(f"`_new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in assign else F.col(f"`{c}`") for c in cols], "_hit"))
        rows, touched = out.select(*cols), out.filter("_hit").select(*cols)
        self._check(t, touched)
        dml.check_unique(rows, [k for k in t["keys"] if set(k) & set(assign)])
        t["files"] = [self.store.write(rows, t)]
        work["changed"].add(name)
        if any(f["column"] in assign for f in t["foreign"]):
            self._check_parents(now, t, touched, work)
        for child, o in list(now["tables"].items()) if self.options["foreign_keys"] else []:
            for f in o["foreign"]:
                if f["parent"] == name and f["key"] in assign:
                    moved = out.filter("_hit").select(F.col(f"_old_{f['key']}").alias("old"), F.col(f["key"]).alias("new"))
                    change = dml.parent_updated(self.store.read(o), f["column"], moved, f["update"])
                    work["relied"].add(child)
                    if f["update"] in ("cascade", "set null"):
                        self._replace(work, child, change.rows)
        return self._returning(touched, returned)

    def _replace(self, work: dict, name: str, rows: DataFrame) -> None:
        t = work["now"]["tables"][name]
        new = self.store.write(rows, t)
        self._check(t, self.store.read({**t, "files": [new]}))
        t["files"] = [new]
        work["changed"].add(name)

    def _delete(self, r: _Reader, work: dict) -> DataFrame:
        r.accept("FROM") or r.accept("TABLE")
        now, name = work["now"], r.name()
        t = self._table(now, name)
        body, returned = _cut(r.rest(), "RETURNING")
        cond = rewrite_tokens(body[1:]) if body and body[0][1].upper() == "WHERE" else "true"
        marked = self._frame(f"SELECT `{name}`.*, coalesce({cond}, false) AS _hit FROM `{name}`", now)
        touched = self.store.aside(marked.filter("_hit").drop("_hit"))
        keep = [] if cond == "true" else [self.store.write(marked.filter("NOT _hit").drop("_hit"), t)]
        self._gone(work, name, touched, keep)
        return self._returning(touched, returned)

    def _gone(self, work: dict, name: str, gone: DataFrame, keep: list[dict]) -> None:
        """The table keeps these folders; what refers to the rows that went follows by its action."""
        now = work["now"]
        now["tables"][name]["files"] = keep
        work["changed"].add(name)
        for child, o in list(now["tables"].items()) if self.options["foreign_keys"] else []:
            for f in o["foreign"]:
                if f["parent"] == name:
                    work["relied"].add(child)
                    change = dml.parent_deleted(self.store.read(o), f["column"], gone, f["key"], f["delete"])
                    if f["delete"] == "set null":
                        self._replace(work, child, change.rows)
                    elif f["delete"] == "cascade" and change.touched.head(1):
                        went = self.store.aside(change.touched)
                        self._gone(work, child, went, [self.store.write(change.rows, o)])

    # upkeep
    def _analyze(self, r: _Reader, work: dict) -> DataFrame:
        r.accept("TABLE")
        names = [r.name()] if r.i < len(r.t) else sorted(work["now"]["tables"])
        out = []
        for name in names:
            t = self._table(work["now"], name)
            t["stats"] = inspect.statistics(self.store.read(t))
            work["changed"].add(name)
            out += [(name, s["column"], s["rows"], s["nulls"], s["distinct"], s["low"], s["high"], s["histogram"], s["common"]) for s in t["stats"]]
        return self.spark.createDataFrame(out, "table string, column string, rows bigint, nulls bigint, distinct bigint, low string, high string, histogram array<double>, common array<string>")

    def _vacuum(self) -> DataFrame:
        """Every table becomes one folder, and all that the new version does not name goes; no other reader or writer may run."""
        if self._open is not None:
            raise ValueError("VACUUM inside a transaction")
        base = self.store.head()
        now = self.store.load(base)
        for t in now["tables"].values():
            if t["files"]:
                t["files"] = [self.store.write(self.store.read(t), t)]
        version = self.store.commit(base, now, set(now["tables"]), set())
        self.store.sweep(version)
        return self._note(version=version)

    def _pragma(self, tokens: list[Token]) -> DataFrame:
        name, given = tokens[0][1].lower(), [t[1] for t in tokens[1:] if t[1] not in ("=", "(", ")")]
        if name in ("quick_check", "integrity_check"):
            now, found = self._state()["now"], []
            for table, t in sorted(now["tables"].items()):
                try:
                    if name == "integrity_check":
                        self._whole(now, table, t)
                    else:
                        self._check(t, self.store.read(t))
                except dml.ConstraintError as e:
                    found.append((f"{table}: {e}",))
            return self.spark.createDataFrame(found or [("ok",)], f"{name} string")
        if name not in ("foreign_keys", "synchronous", "parallel_scan", "sort_mem_limit", "wal_checkpoint"):
            raise ValueError(f"unknown pragma {name}")
        if given:
            self.options[name] = given[0].lower() in ("on", "true", "1") if name == "foreign_keys" else given[0]
        return self.spark.createDataFrame([(str(self.options.get(name, "")).lower(),)], f"{name} string")


def _old_row(tokens: list[Token], table: str, columns: set[str]) -> list[Token]:
    """Columns of the table, bare or after its name, as columns of o; excluded.<name> and calls stay."""
    out, i = [], 0
    while i < len(tokens):
        named = tokens[i][0] in ("word", "name") and _name(tokens[i])
        after = tokens[i + 1][1] if i + 1 < len(tokens) else ""
        if named and after == "." and named == table:
            i += 2
            continue
        if named and named in columns and after not in ("(", ".") and not (out and out[-1][1] == "."):
            out += [("word", "o"), ("op", ".")]
        out.append(tokens[i])
        i += 1
    return out
