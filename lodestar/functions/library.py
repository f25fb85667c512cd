"""The dialect's scalar functions, each a native Spark SQL expression over its parameters.

`inline(sql)` writes their bodies into a statement, so they work in every
clause and cost nothing to set up; `register(spark)` makes them known to a
session by name instead. None runs Python except `ls_json_contains`, for
queries that differ by row.
"""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")

#: White space that TRIM takes off by default.
_BLANK = r"' \t\n\r'"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BIG = "1000000000"

#: name(parameters) -> (return type, body)
FUNCTIONS: dict[str, tuple[str, str]] = {
    # strings: lengths and positions count bytes
    "ls_length(s STRING)": ("BIGINT", "CAST(octet_length(s) AS BIGINT)"),
    "ls_substr(s STRING, p BIGINT, n BIGINT)": ("STRING", "make_valid_utf8(CAST(substring(CAST(s AS BINARY), CAST(greatest(p, 1) AS INT), CAST(greatest(n, 0) AS INT)) AS STRING))"),
    "ls_substr_from(s STRING, p BIGINT)": ("STRING", "make_valid_utf8(CAST(substring(CAST(s AS BINARY), CAST(greatest(p, 1) AS INT)) AS STRING))"),
    "ls_trim(s STRING)": ("STRING", f"trim(BOTH {_BLANK} FROM s)"),
    "ls_ltrim(s STRING)": ("STRING", f"trim(LEADING {_BLANK} FROM s)"),
    "ls_rtrim(s STRING)": ("STRING", f"trim(TRAILING {_BLANK} FROM s)"),
    "ls_trim_of(s STRING, c STRING)": ("STRING", "trim(BOTH c FROM s)"),
    "ls_ltrim_of(s STRING, c STRING)": ("STRING", "trim(LEADING c FROM s)"),
    "ls_rtrim_of(s STRING, c STRING)": ("STRING", "trim(TRAILING c FROM s)"),
    "ls_natural_sort(s STRING)": (
        "STRING",
        "array_join(transform(regexp_extract_all(s, '[0-9]+|[^0-9]+', 0), x -> if(x rlike '^[0-9]' AND length(x) < 20, lpad(x, 20, '0'), x)), '')",
    ),
    # numbers
    # whole numbers stay as they are, of any width
    "ls_floor(x ANY)": ("ANY", "CASE WHEN abs(x) >= 9007199254740992 THEN x ELSE x - pmod(x, 1) END"),
    "ls_ceil(x ANY)": ("ANY", "CASE WHEN abs(x) >= 9007199254740992 THEN x ELSE x + pmod(-x, 1) END"),
    # lenient casts of text: the leading number, else 0
    "ls_text_double(s STRING)": ("DOUBLE", r"CASE WHEN s IS NOT NULL THEN coalesce(try_cast(regexp_extract(trim(s), '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?', 0) AS DOUBLE), 0D) END"),
    "ls_text_long(s STRING)": (
        "BIGINT",
        r"CASE WHEN s IS NOT NULL THEN coalesce(try_cast(regexp_extract(trim(s), '^[+-]?[0-9]+', 0) AS BIGINT), try_cast(regexp_extract(trim(s), '^[+-]?\\.[0-9]+', 0) AS BIGINT), 0) END",
    ),
    "ls_plain_number(s STRING)": ("STRING", r"CASE s WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE regexp_replace(s, '\\.0$', '') END"),
    # timestamps
    "ls_date_trunc(u STRING, t TIMESTAMP_NTZ)": ("TIMESTAMP_NTZ", "CAST(date_trunc(u, t) AS TIMESTAMP_NTZ)"),
    "ls_year(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(extract(YEAR FROM t) AS BIGINT)"),
    "ls_month(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(extract(MONTH FROM t) AS BIGINT)"),
    "ls_day(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(extract(DAY FROM t) AS BIGINT)"),
    "ls_hour(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(extract(HOUR FROM t) AS BIGINT)"),
    "ls_minute(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(extract(MINUTE FROM t) AS BIGINT)"),
    "ls_second(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(floor(extract(SECOND FROM t)) AS BIGINT)"),
    "ls_microsecond(t TIMESTAMP_NTZ)": ("BIGINT", "CAST(extract(SECOND FROM t) * 1000000 AS BIGINT) % 1000000"),
    "ls_epoch(t TIMESTAMP_NTZ)": ("BIGINT", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t)"),
    # JSON text
    "ls_json_get(j STRING, p STRING)": ("STRING", "to_json(variant_get(parse_json(j), p))"),
    "ls_json_valid(j STRING)": ("BIGINT", "CASE WHEN j IS NOT NULL THEN CAST(try_parse_json(j) IS NOT NULL AS BIGINT) END"),
    "ls_json_array_length(j STRING)": ("BIGINT", "CAST(json_array_length(j) AS BIGINT)"),
    "ls_json_array_length_at(j STRING, p STRING)": ("BIGINT", "CAST(json_array_length(get_json_object(j, p)) AS BIGINT)"),
    # full text
    "ls_tokens(t STRING)": ("ARRAY<STRING>", rf"filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{Nd}}]+', 0), w -> NOT array_contains(array({_STOP}), w))"),
    # a text's tokens one after the other between blanks; no token holds a blank
    "ls_token_line(t STRING)": ("STRING", "concat(' ', array_join(ls_tokens(t), ' '), ' ')"),
    # vectors
    "ls_same_size(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("BOOLEAN", "CASE WHEN size(a) = size(b) THEN true ELSE CAST(raise_error(concat('vectors of ', size(a), ' and ', size(b), ' dimensions')) AS BOOLEAN) END"),
    "ls_vector(s STRING)": ("ARRAY<FLOAT>", "from_json(s, 'array<float>')"),
    "ls_vec_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) != size(b) THEN CAST(raise_error('vectors of different dimensions') AS DOUBLE) ELSE sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) END",
    ),
    "ls_vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) != size(b) THEN CAST(raise_error('vectors of different dimensions') AS DOUBLE) "
        "WHEN NOT exists(a, x -> x != 0) OR NOT exists(b, x -> x != 0) THEN CAST(raise_error('cosine distance of a zero vector') AS DOUBLE) "
        "ELSE 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END",
    ),
}

_JSON_KIND = (
    "CASE WHEN {v} IS NULL THEN NULL WHEN {s} = 'VOID' THEN 'null' WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array' "
    "WHEN {s} = 'STRING' THEN 'text' WHEN {s} = 'BOOLEAN' THEN to_json({v}) WHEN {s} = 'BIGINT' OR {s} LIKE 'DECIMAL(%,0)' THEN 'integer' ELSE 'real' END"
)


def _typed() -> dict[str, tuple[str, str]]:
    """JSON functions whose result depends on a value's kind."""
    whole, part = "parse_json(j)", "variant_get(parse_json(j), p)"
    kind = lambda v: _JSON_KIND.format(v=v, s=f"schema_of_variant({v})")
    return {
        "ls_json_type(j STRING)": ("STRING", kind(whole)),
        "ls_json_type_at(j STRING, p STRING)": ("STRING", kind(part)),
        # text as it is, numbers as text, booleans as 1 and 0, JSON null as NULL, containers as JSON text
        "ls_json_text(j STRING, p STRING)": (
            "STRING",
            f"CASE schema_of_variant({part}) WHEN 'BOOLEAN' THEN if(variant_get(parse_json(j), p, 'boolean'), '1', '0') WHEN 'VOID' THEN NULL ELSE variant_get(parse_json(j), p, 'string') END",
        ),
    }


def contains(document, query) -> bool:
    """Whether the JSON query is contained: objects by key, array members one to one (first fit), scalars by value with 1 = 1.0."""
    if isinstance(query, dict):
        return isinstance(document, dict) and all(k in document and contains(document[k], v) for k, v in query.items())
    if isinstance(query, list):
        if not isinstance(document, list):
            return False
        left = list(document)
        for q in query:
            for i, d in enumerate(left):
                if contains(d, q):
                    del left[i]
                    break
            else:
                return False
        return True
    if isinstance(document, (dict, list)) or isinstance(document, bool) != isinstance(query, bool):
        return False
    return document == query


def _json_contains(documents: pd.Series, queries: pd.Series) -> pd.Series:
    parsed: dict[str, object] = {}

    def one(d, q) -> bool:
        """A null or a text that is no JSON, on either side, gives false."""
        try:
            if d is None or q is None:
                return False
            if q not in parsed:
                parsed[q] = json.loads(q)
            return contains(json.loads(d), parsed[q])
        except ValueError:
            return False

    return pd.Series([one(d, q) for d, q in zip(documents, queries)], dtype=bool)


_WORDS = re.compile(r"""'(?:[^'\\]|\\.)*'|`[^`]*`|[A-Za-z_][A-Za-z0-9_]*|\S|\s+""", re.S)
_NUMBERS = {"BIGINT", "DOUBLE", "ARRAY<DOUBLE>"}


def _macros() -> dict[tuple[str, int], tuple[list[tuple[str, str]], str, list[str]]]:
    """(name, parameters) -> their names and types, the result's type, and the body's words with lambda variables no column is named like."""
    out = {}
    for head, (kind, body) in {**FUNCTIONS, **_typed()}.items():
        name, _, rest = head.partition("(")
        params = [tuple(p.strip().split(" ", 1)) for p in rest[:-1].split(",")]
        bound = set(re.findall(r"(\w+)\s*->", body)) | {x for pair in re.findall(r"\((\w+), (\w+)\)\s*->", body) for x in pair}
        out[name, len(params)] = (params, kind, [f"_l_{w}" if w in bound else w for w in _WORDS.findall(body)])
    return out


def inline(sql: str) -> str:
    """The statement with every ls_ function written out."""
    if not _MACROS:
        _MACROS.update(_macros())
    words, out, i = _WORDS.findall(sql), [], 0
    while i < len(words):
        j = i + 1
        while j < len(words) and words[j].isspace():
            j += 1
        if not words[i].startswith("ls_") or j >= len(words) or words[j] != "(":
            out.append(words[i])
            i += 1
            continue
        depth, args, j = 1, [[]], j + 1
        while depth:
            depth += (words[j] in "([") - (words[j] in ")]")
            if depth == 1 and words[j] == ",":
                args.append([])
            elif depth:
                args[-1].append(words[j])
            j += 1
        args = [inline("".join(a)).strip() for a in args]
        macro = _MACROS.get((words[i], len(args)))
        if macro is None:
            out.append(f"{words[i]}({', '.join(args)})")
        else:
            params, kind, body = macro
            given = {n: f"CAST({a} AS {t})" if t in _NUMBERS else f"({a})" for (n, t), a in zip(params, args)}
            text = inline("".join(given.get(w, w) if w.isidentifier() else w for w in body))
            out.append(f"CAST({text} AS {kind})" if kind in _NUMBERS else f"({text})")
        i = j
    return "".join(out)


_MACROS: dict = {}


def contains_sql(document: str, query: str) -> str | None:
    """JSON_CONTAINS for a literal query, as native tests of its parts; None where the query is no JSON."""
    names = (f"_v{i}" for i in range(1 << 30))

    def bound(value: str, test) -> str:
        """test(name) with the value bound to a name, so that it is computed once."""
        x = next(names)
        return f"transform(array({value}), {x} -> {test(x)})[0]"

    def fit(left: str, rest: list) -> str:
        """Members are given out one to one, each to the first that fits."""
        if not rest:
            return "true"
        x, j, k, y, i = (next(names) for _ in range(5))
        first = f"array_min(filter(transform({left}, ({x}, {j}) -> if({holds(x, rest[0])}, {j}, NULL)), {k} -> {k} IS NOT NULL))"
        left_over = lambda at: f"filter({left}, ({y}, {i}) -> {i} != {at})"
        return bound(first, lambda at: f"if({at} IS NULL, false, {bound(left_over(at), lambda more: fit(more, rest[1:]))})")

    def holds(v: str, q) -> str:
        kind = f"coalesce(schema_of_variant({v}), '')"
        if isinstance(q, dict):
            parts = [f"{kind} LIKE 'OBJECT%'"]
            for k, child in q.items():
                path = literal(f"$['{k}']" if '"' in k or "\\" in k else f'$["{k}"]')
                parts.append(bound(f"try_variant_get({v}, {path}, 'variant')", lambda x, child=child: f"({x} IS NOT NULL AND {holds(x, child)})"))
            return f"({' AND '.join(parts)})"
        if isinstance(q, list):
            members = f"try_variant_get({v}, '$', 'array<variant>')"
            return f"({kind} LIKE 'ARRAY%' AND {bound(members, lambda d: fit(d, q))})"
        if q is None:
            return f"({kind} = 'VOID')"
        if isinstance(q, bool):
            return f"({kind} = 'BOOLEAN' AND try_variant_get({v}, '$', 'boolean') = {str(q).lower()})"
        if isinstance(q, str):
            return f"({kind} = 'STRING' AND try_variant_get({v}, '$', 'string') = {literal(q)})"
        return f"(({kind} IN ('BIGINT', 'DOUBLE') OR {kind} LIKE 'DECIMAL%') AND try_variant_get({v}, '$', 'double') = {float(q)!r}D)"

    try:
        parsed = json.loads(query)
    except ValueError:
        return None
    return f"coalesce({bound(f'try_parse_json({document})', lambda v: f'({v} IS NOT NULL AND {holds(v, parsed)})')}, false)"


def register_python(spark: SparkSession) -> None:
    """The one function that runs in Python workers, which is sent to them by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.udf.register("ls_json_contains", F.pandas_udf(_json_contains, "boolean"))


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session by name; safe to call again."""
    for head, (kind, body) in {**FUNCTIONS, **_typed()}.items():
        if kind == "ANY":  # of the argument's own type: written out only
            continue
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    register_python(spark)


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(text: str) -> list[str]:
    """The full-text tokenizer, for query strings."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha() or c.isdecimal():
            word += c
        elif word:
            if word not in STOP_WORDS:
                out.append(word)
            word = ""
    return out


def parse_match(query: str) -> tuple[list[str], list[list[str]]] | None:
    """Plain terms and quoted phrases of a MATCH query; None where it is empty or a quote is open."""
    if query.count('"') % 2:
        return None
    terms: list[str] = []
    phrases: list[list[str]] = []
    for i, part in enumerate(query.split('"')):
        found = tokens(part)
        if i % 2:
            phrases += [found] if found else []
        else:
            terms += found
    return (terms, phrases) if terms or phrases else None


def _array(words: list[str]) -> str:
    return f"array({', '.join(map(literal, words))})" if words else "CAST(array() AS ARRAY<STRING>)"


def match_sql(document: str, query: str) -> str:
    """MATCH(document, query) as a Spark SQL condition that is never null.

    The text is cut to tokens once; terms and phrases are looked for in the
    line of all tokens, so the cost grows with the text alone.
    """
    parsed = parse_match(query)
    if parsed is None:
        return "false"
    terms, phrases = parsed
    wanted = [" ".join(p) for p in [[t] for t in dict.fromkeys(terms)] + phrases]
    tests = " AND ".join(f"contains(_d, {literal(f' {w} ')})" for w in wanted)
    return f"coalesce(exists(array(ls_token_line({document})), _d -> {tests}), false)"


def rank_sql(document: str, query: str) -> str:
    """TS_RANK(document, query): saturated term frequencies by coverage and length, phrase and proximity bonuses.

    One pass over the tokens, which are bound once, finds the counts of the
    terms, their last places and the smallest stretch that holds one of each:
    the stretch that ends at a token goes back to the earliest of the last places.
    """
    parsed = parse_match(query)
    if parsed is None:
        return "0D"
    terms, phrases = parsed
    q = list(dict.fromkeys([*terms, *(t for p in phrases for t in p)]))
    n = len(q)
    start = f"named_struct('i', 0, 'at', array_repeat(0, {n}), 'n', array_repeat(0, {n}), 'span', {_BIG})"
    place = f"array_position({_array(q)}, _t)"
    put = lambda what, value: f"transform(_s.{what}, (_x, _j) -> if(_j + 1 = {place}, {value}, _x))"
    step = (
        f"if({place} = 0, named_struct('i', _s.i + 1, 'at', _s.at, 'n', _s.n, 'span', _s.span), transform(array({put('at', '_s.i + 1')}), _at -> "
        f"named_struct('i', _s.i + 1, 'at', _at, 'n', {put('n', '_x + 1')}, 'span', if(array_min(_at) > 0, least(_s.span, _s.i + 2 - array_min(_at)), _s.span)))[0])"
    )
    each = [f"CAST(_f.n[{i}] AS DOUBLE)" for i in range(n)]
    hit = " + ".join(f"if({c} > 0, 1D, 0D)" for c in each)
    saturated = " + ".join(f"ln(1 + {c}) / (1 + ln(1 + {c}))" for c in each)
    cover = f"(({hit}) / {n}D)"
    score = f"(({saturated}) / {n}D) * (0.5D + 0.5D * {cover}) / sqrt(1D + greatest(_f.i - {n}, 0) / 20D)"
    for p in phrases:
        score += f" + if(contains(_line, {literal(' ' + ' '.join(p) + ' ')}), {0.25 * len(p) / n!r}D, 0D)"
    if n >= 2:
        score += f" + if(({hit}) = {n}, 0.2D * ({n}D / _f.span) * {cover}, 0D)"
    ranked = f"if(({hit}) = 0, 0D, {score})"
    if phrases:
        ranked = f"transform(array(concat(' ', array_join(_d, ' '), ' ')), _line -> {ranked})[0]"
    found = f"transform(array(aggregate(_d, {start}, (_s, _t) -> {step})), _f -> {ranked})[0]"
    return f"CASE WHEN {document} IS NULL THEN 0D ELSE transform(array(ls_tokens({document})), _d -> {found})[0] END"
