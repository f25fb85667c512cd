"""Rewrites the dialect's statements into Spark SQL, token by token.

Strings, quoted names and comments are tokens of their own, so nothing inside
them is touched. Everything Spark already understands passes through.
"""

from __future__ import annotations

import datetime as dt
import re

from lodestar.functions.library import contains_sql, inline, literal, match_sql, rank_sql

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>->>|->|::|<>|!=|<=|>=|\|\||[-+*/%<>=(),.;?\[\]])|(?P<other>.)""",
    re.S,
)
TYPES = {
    "BOOLEAN": "BOOLEAN", "INT4": "INT", "INT8": "BIGINT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "TEXT": "STRING", "VARCHAR": "STRING",
    "TIMESTAMP": "TIMESTAMP_NTZ", "JSON": "STRING", "UUID": "STRING", "VECTOR": "ARRAY<FLOAT>", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "FLOAT": "FLOAT", "STRING": "STRING",
}
_RENAMED = {
    "LENGTH": "ls_length", "NATURAL_SORT": "ls_natural_sort", "FLOOR": "ls_floor", "CEIL": "ls_ceil", "GEN_RANDOM_UUID": "uuid", "NOW": "localtimestamp",
    "JSON_VALID": "ls_json_valid", "DATE_TRUNC": "ls_date_trunc",
}
_FRAMED = {"SUM", "AVG", "COUNT", "MIN", "MAX", "FIRST_VALUE", "LAST_VALUE"}
_RANKED = {"ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD", "PERCENT_RANK", "CUME_DIST"}
FIELDS = ("year", "month", "day", "hour", "minute", "second", "microsecond", "epoch")
_UNITS = {"year": 0, "month": 1, "week": 2, "day": 3, "hour": 4, "minute": 5, "second": 6}
_RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def tokenize(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


def value(x) -> str:
    """A bound value as a Spark SQL literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return f"{x}L" if -(2**63) < x < 2**63 and not -(2**31) <= x < 2**31 else str(x)
    if isinstance(x, float):
        return f"CAST('{x!r}' AS DOUBLE)"
    if isinstance(x, dt.datetime):
        return f"TIMESTAMP_NTZ'{x:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(x, (list, tuple)):
        return f"array({', '.join(f'CAST({float(v)!r} AS FLOAT)' for v in x)})"
    if isinstance(x, str):
        return literal(x)
    raise TypeError(f"cannot bind a {type(x).__name__}")


def unquote(token: str) -> str:
    return token[1:-1].replace(token[0] * 2, token[0])


def interval(text: str) -> str:
    """'1 month 3 days' as make_interval(...)."""
    parts = text.lower().split()
    if not parts or len(parts) % 2:
        raise ValueError(f"interval literal {text!r} is not a list of numbers and units")
    found = [0.0] * 7
    for n, unit in zip(parts[::2], parts[1::2]):
        unit = unit.rstrip("s") if unit not in ("s",) else "second"
        number = float(n)
        if unit in ("microsecond", "millisecond"):
            found[6] += number / (1e6 if unit == "microsecond" else 1e3)
        elif unit in _UNITS:
            if unit != "second" and number != int(number):
                raise ValueError(f"interval unit {unit} takes whole numbers")
            found[_UNITS[unit]] += number
        else:
            raise ValueError(f"unknown interval unit {unit!r}")
    return f"make_interval({', '.join(str(int(x)) for x in found[:6])}, CAST({found[6]:.6f} AS DECIMAL(18, 6)))"


def cast(x: str, kind: str) -> str:
    """CAST with the dialect's leniency: text gives its leading number, booleans 1 and 0, whole numbers no '.0'."""
    target = TYPES.get(kind.upper())
    if target is None:
        return f"CAST({x} AS {kind})"
    text = f"CAST({x} AS STRING)"
    if target in ("INT", "BIGINT"):
        return f"CASE typeof({x}) WHEN 'string' THEN CAST(ls_text_long({text}) AS {target}) ELSE CAST({x} AS {target}) END"
    if target in ("FLOAT", "DOUBLE"):
        return f"CASE typeof({x}) WHEN 'string' THEN CAST(ls_text_double({text}) AS {target}) ELSE CAST({x} AS {target}) END"
    if target == "BOOLEAN":
        return f"CASE typeof({x}) WHEN 'string' THEN ls_text_double({text}) != 0 WHEN 'boolean' THEN {text} = 'true' ELSE ls_text_double({text}) != 0 END"
    if kind.upper() == "UUID":
        return f"lower({text})"
    if target == "STRING":
        return f"CASE WHEN typeof({x}) IN ('boolean', 'double', 'float') THEN ls_plain_number({text}) ELSE {text} END"
    if target == "ARRAY<FLOAT>":
        return f"ls_vector({x})"
    return f"CAST({x} AS {target})"


def _path(step: str) -> str:
    """The path of one -> or ->> step: a quoted key or an array index."""
    if step.startswith("'"):
        key = unquote(step).replace("\\", "\\\\").replace('"', '\\"')
        return literal(f'$["{key}"]')
    return literal(f"$[{step}]")


class _Rewriter:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.t, self.i = tokens, 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def group(self) -> list[tuple[str, str]]:
        """The tokens inside the parentheses that begin here; moves past them."""
        assert self.peek() == "(", f"expected ( before {self.peek()!r}"
        depth, start = 0, self.i + 1
        while self.i < len(self.t):
            depth += (self.t[self.i][1] == "(") - (self.t[self.i][1] == ")")
            self.i += 1
            if not depth:
                return self.t[start : self.i - 1]
        raise ValueError("unbalanced parentheses")

    def run(self) -> str:
        out: list[str] = []
        while self.i < len(self.t):
            self.step(out)
        return " ".join(out).replace(" . ", ".")

    def primary(self, out: list[str]) -> str:
        """Takes the last operand off the output; function calls and casts are single pieces already."""
        take = [out.pop()]
        while out and (out[-1] == "." or take[0] == "."):
            take.insert(0, out.pop())
        return "".join(take)

    def step(self, out: list[str]) -> None:
        kind, text = self.t[self.i]
        upper = text.upper()
        if kind == "string":
            out.append(literal(unquote(text)))
            self.i += 1
            if out[-2:-1] and out[-2].upper() == "LIKE":
                out.append("ESCAPE '\\u0001'")
        elif kind == "name":
            out.append(f"`{unquote(text) if text[0] == chr(34) else text[1:-1]}`")
            self.i += 1
        elif text in ("->", "->>"):
            step = self.peek(1)
            self.i += 2
            operand = self.primary(out)
            out.append(f"{'ls_json_get' if text == '->' else 'ls_json_text'}({operand}, {_path(step)})")
        elif text == "::":
            target = self.peek(1)
            self.i += 2
            if self.peek() == "(":
                self.group()
            out.append(f"({cast(self.primary(out), target)})")
        elif text == "(":
            inner = self.group()
            out.append(f"({_Rewriter(inner).run()})")
        elif upper == "INTERVAL" and self.i + 1 < len(self.t) and self.t[self.i + 1][0] == "string":
            out.append(interval(unquote(self.peek(1))))
            self.i += 2
        elif upper == "NOT" and self.peek(1).upper() == "IN" and self.peek(2) == "(" and self.peek(3).upper() == "SELECT":
            self.i += 2
            inner = _Rewriter(self.group()).run()
            operand = self.primary(out)
            # nulls of the subquery are ignored and a null operand stays: an anti join on equality, never a nested loop
            out.append(f"(NOT EXISTS (SELECT 1 FROM ({inner}) AS _s(_v) WHERE _v = {operand}))")
        elif kind == "word" and self.peek(1) == "(" and not (out and out[-1] == "."):
            self.i += 1
            self.call(text, upper, out)
        else:
            out.append(text)
            self.i += 1

    def call(self, text: str, upper: str, out: list[str]) -> None:
        if upper in ("IN", "AS", "AND", "OR", "NOT", "WHERE", "ON", "FROM", "VALUES", "BY", "OVER", "USING", "SELECT", "THEN", "ELSE", "WHEN", "EXISTS", "UNION", "ALL", "HAVING", "SET", "ROLLUP", "CUBE", "SETS", "ANY", "JOIN"):
            out.append(text)
            return
        inner = self.group()
        parts = _split(inner)
        args = [_Rewriter(p).run() for p in parts]
        raw = [p[0][1] if len(p) == 1 and p[0][0] == "string" else None for p in parts]
        if upper == "CAST":
            at = max(i for i, t in enumerate(inner) if t[1].upper() == "AS")
            call = f"({cast(_Rewriter(inner[:at]).run(), inner[at + 1][1])})"
        elif upper in ("EXTRACT", "DATE_PART"):
            at = next((i for i, t in enumerate(inner) if t[1].upper() == "FROM"), None)
            field, rest = (inner[0][1], _Rewriter(inner[at + 1 :]).run()) if at else (unquote(raw[0]), args[1])
            if field.lower() not in FIELDS:
                raise ValueError(f"EXTRACT does not know {field!r}")
            call = f"ls_{field.lower()}({rest})"
        elif upper in ("SUBSTR", "SUBSTRING"):
            call = f"ls_substr({', '.join(args)})" if len(args) > 2 else f"ls_substr_from({', '.join(args)})"
        elif upper in ("TRIM", "LTRIM", "RTRIM") and len(args) <= 2 and not any(t[1].upper() == "FROM" for t in inner):
            call = f"ls_{upper.lower()}{'_of' if len(args) == 2 else ''}({', '.join(args)})"
        elif upper == "CONCAT":
            call = f"concat_ws('', {', '.join(f'CAST({a} AS STRING)' for a in args)})"
        elif upper == "TO_TIMESTAMP" and len(args) == 1:
            call = f"CAST({args[0]} AS TIMESTAMP_NTZ)"
        elif upper == "JSON_EXTRACT":
            call = f"ls_json_text({', '.join(args)})"
        elif upper in ("JSON_TYPE", "JSON_ARRAY_LENGTH"):
            call = f"ls_{upper.lower()}{'_at' if len(args) == 2 else ''}({', '.join(args)})"
        elif upper == "JSON_CONTAINS":
            call = (raw[1] is not None and contains_sql(args[0], unquote(raw[1]))) or f"ls_json_contains({', '.join(args)})"
        elif upper in ("MATCH", "TS_RANK") and len(args) == 2:
            if raw[1] is None:
                raise ValueError(f"{upper} takes a literal or bound query")
            call = f"({(match_sql if upper == 'MATCH' else rank_sql)(args[0], unquote(raw[1]))})"
        elif upper in ("VEC_L2", "VEC_COSINE"):
            wide = [f"CAST({f'ls_vector({a})' if r is not None else a} AS ARRAY<DOUBLE>)" for a, r in zip(args, raw)]
            call = f"ls_{upper.lower()}({', '.join(wide)})"
        elif upper in ("ARGON2ID_HASH", "ARGON2ID_VERIFY", "BCRYPT_HASH", "BCRYPT_VERIFY"):
            from lodestar.functions.passwords import sql_name

            call = f"{sql_name(upper)}({', '.join(args)})"
        else:
            call = f"{_RENAMED.get(upper, text)}({', '.join(args)})"
        if self.peek().upper() == "OVER" and self.peek(1) == "(":
            self.i += 1
            call = self.window(upper, call, args, self.group())
        out.append(call)

    def window(self, name: str, call: str, args: list[str], over: list[tuple[str, str]]) -> str:
        words = [t[1].upper() for t in over]
        ordered, framed = "ORDER" in words, "ROWS" in words or "RANGE" in words
        spec = _Rewriter(over).run()
        if name == "NTILE":
            by = spec[: spec.upper().index("ORDER BY")].strip() if ordered else spec
            spec = spec if ordered else f"{spec} ORDER BY 1"
            return f"CAST(floor((row_number() OVER ({spec}) - 1) * {args[0]} / count(*) OVER ({by})) + 1 AS BIGINT)"
        if name in _RANKED and not ordered:
            spec += " ORDER BY 1"
        if name == "NTH_VALUE" and not framed:
            spec += ("" if ordered else " ORDER BY 1") + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        elif name in _FRAMED and ordered and not framed:
            spec += f" {_RUNNING}"
        result = f"{call} OVER ({spec.strip()})"
        return f"CAST({result} AS BIGINT)" if name in ("ROW_NUMBER", "RANK", "DENSE_RANK") else result


def _split(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The comma-separated parts at the outer level."""
    out: list[list[tuple[str, str]]] = [[]]
    depth = 0
    for t in tokens:
        depth += (t[1] == "(") - (t[1] == ")")
        if t[1] == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def bind(tokens: list[tuple[str, str]], args) -> list[tuple[str, str]]:
    """Puts bound values in place of ?; strings stay strings, so MATCH sees them."""
    left, out = list(args or []), []
    for kind, text in tokens:
        if text == "?" and kind == "op":
            if not left:
                raise ValueError("fewer values than placeholders")
            x = left.pop(0)
            out.append(("string", "'" + x.replace("'", "''") + "'") if isinstance(x, str) else ("value", value(x)))
        else:
            out.append((kind, text))
    if left:
        raise ValueError("more values than placeholders")
    return out


def rewrite_tokens(tokens: list[tuple[str, str]]) -> str:
    return inline(_Rewriter(tokens).run())


def rewrite(sql: str, args=None) -> str:
    """A SELECT (or any expression) of the dialect as Spark SQL."""
    tokens = bind(tokenize(sql), args)
    while tokens and tokens[-1][1] == ";":
        tokens.pop()
    return rewrite_tokens(tokens)
