"""Merkle fingerprints of documents, in DataFrame functions only.

A text is cut into small paragraphs after line ends and sentence ends. A
stretch of over `WIDEST` characters without either is cut between two words
where the last letter of the one and the first of the other are of two given
classes, and what is still longer every `WIDEST` characters. Consecutive
paragraphs form a section that ends after a paragraph whose own hash says so,
so an edit moves no cut but its own.

Leaves are the hashes of the paragraphs, a branch is the hash of its leaves,
the root is the hash of the branches, all sha256 in full. A fingerprint is the
root, and each section's whole branch hash with the first digits of its
leaves: roots test equality, the root can be checked against the branches, and
branches and then leaves that differ tell where two texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import partitions, table

#: A section ends after a paragraph whose hash begins with one of these: one in eight, found by content.
CUTS = "01"
WIDEST = 160
#: Signs that end a line or a sentence, and those that end a word besides.
ENDS, WORD_ENDS = r"\n.!?。！？｡؟।…", r" \t\x0B\f\r,;:、，；："


def _every_fourth(rest: int) -> str:
    """Letters and digits up to U+00FF whose code leaves `rest` when divided by four."""
    return "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c % 4 == rest)


#: A long stretch is cut where a word that ends in LAST meets one that begins with FIRST.
LAST, FIRST = _every_fourth(1) + "а-зΑ-ηא-וا-ح", _every_fourth(3) + "п-тπ-τנ-פق-ن"
#: Digits shown of a leaf's hash; branches and roots are shown, and all are hashed, in full.
SHOWN = 16


def _hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _by_words(stretch: Column) -> Column:
    """A stretch without line ends, cut between words of the two classes, and by width where that leaves more."""
    marked = F.regexp_replace(stretch, rf"([{LAST}][{WORD_ENDS}]+)([{FIRST}])", "$1\n$2")
    return F.flatten(F.transform(F.split(marked, "\n"), lambda p: F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{WIDEST}}}"), F.lit(0))))


def _too_long(p: Column) -> Column:
    """The pieces of a paragraph of over WIDEST characters: cut up, and the signs that end it alone, where it is as long without them."""
    stretch = F.array(F.regexp_replace(p, rf"[{ENDS}]+\z", ""))
    signs = F.transform(stretch, lambda s: F.substring(p, F.length(s) + 1, F.length(p)))
    return F.transform(stretch, lambda s: F.when(F.length(s) > WIDEST, F.concat(_by_words(s), F.filter(signs, lambda e: e != ""))).otherwise(F.array(p)))[0]


def paragraphs(text: Column) -> Column:
    """The pieces of the text in order; together they are the whole text."""
    # a look at either side of a place takes Java less time than a match over everything that is no end sign
    found = F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?<=[{ENDS}])(?![{ENDS}])"), lambda p: p != "")
    return F.flatten(F.transform(found, lambda p: F.when(F.length(p) > WIDEST, _too_long(p)).otherwise(F.array(p))))


def sections(text: Column) -> Column:
    """'leaf,leaf,...' of each section in order, with whole hashes; none for an empty text."""
    marked = F.transform(paragraphs(text), lambda p: F.regexp_replace(_hash(p), rf"^([{CUTS}].*)$", "$1;"))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(marked, ","), ";,", ";"), ";$", "")
    return F.filter(F.split(joined, ";", -1), lambda s: s != "")


def fingerprint(text: Column) -> Column:
    """root|branch(leaf,leaf,...)|branch(...)...: equal exactly where the texts are equal (null counts as empty)."""
    shown = F.transform(sections(text), lambda s: F.concat(_hash(s), F.lit("("), F.regexp_replace(s, rf"([0-9a-f]{{{SHOWN}}})[0-9a-f]*", "$1"), F.lit(")")))
    return F.transform(F.array(shown), lambda x: F.concat(_hash(F.array_join(F.transform(x, lambda s: F.substring(s, 1, 64)), ",")), F.lit("|"), F.array_join(x, "|")))[0]


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def branches(print_: Column) -> Column:
    """The sections of a fingerprint, each with its branch and leaves."""
    return F.filter(F.split(print_, r"\|"), lambda s, i: (i > 0) & (s != ""))


def changed_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections of a that b has nowhere: where an edit lies."""
    return F.filter(F.transform(branches(a), lambda x, i: F.when(~F.array_contains(branches(b), x), i)), lambda i: i.isNotNull())


def _leaves(sections_: Column) -> Column:
    """The different leaves of some sections."""
    return F.array_distinct(F.flatten(F.transform(sections_, lambda s: F.split(F.regexp_extract(s, r"\((.*)\)", 1), ","))))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else the share of leaves in common, below 1.

    The trees are compared from the top: sections with the same branch count
    with all their leaves, and only those without a partner are opened and
    compared leaf by leaf.
    """
    pair = F.array(F.struct(branches(a).alias("x"), branches(b).alias("y")))
    opened = F.transform(
        pair,
        lambda p: F.struct(
            F.aggregate(F.array_intersect(p["x"], p["y"]), F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit("[(,]"))).alias("same"),
            _leaves(F.array_except(p["x"], p["y"])).alias("x"),
            _leaves(F.array_except(p["y"], p["x"])).alias("y"),
        ),
    )
    counted = F.transform(opened, lambda p: F.struct((p["same"] + F.size(F.array_intersect(p["x"], p["y"]))).alias("common"), (p["same"] + F.size(F.array_union(p["x"], p["y"]))).alias("all")))
    share = F.transform(counted, lambda p: F.when(p["all"] == 0, F.lit(0.0)).otherwise(p["common"].cast("double") / p["all"]))[0]
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.least(F.lit(1 - 1e-9), share))


def _listed(bounds: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The bounds' ids and hashes as two literals, each from one text: thousands of columns would take the driver longer than the rows."""
    return tuple(F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*bounds))


def _below(bounds: list[tuple[int, int]], k: Column, t: Column) -> Column:
    """How many of the sorted bounds are less than (k, t), by binary search over literals."""
    if not bounds:
        return F.lit(0)
    ks, ts = _listed(bounds)
    steps = len(bounds).bit_length()

    def step(at: Column, s: Column) -> Column:
        way = F.pow(F.lit(2), s).cast("int")
        b = F.try_element_at(ks, at + way)
        return at + F.when(b.isNotNull() & ((b < k) | ((b == k) & (F.try_element_at(ts, at + way) < t))), way).otherwise(0)

    return F.reduce(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), F.lit(0), step)


def with_next(docs: DataFrame, extra: dict[str, Column], groups_per_partition: int = 4, per_group: int = 20) -> DataFrame:
    """doc_id, text, the `extra` columns made of text, and next_text and next_<extra> of the row after it.

    The order is descending by doc_id and, for equal ones, by the text's hash
    and the text; null ids come last, and after the last row the first. Ids that
    are no integers follow the order of their hashes. Rows
    are dealt to ranges of (id, hash) between quantiles of a hash sample of
    about `per_group` keys for each of the ranges, whose number grows with the
    shuffle partitions; only those keys come to the driver, and they decide
    nothing but the ranges' sizes. A range also takes the first row of the one
    below it, found by that range's largest key. Only rows that are alike in
    id and text can crowd one range.
    """
    spark = docs.sparkSession
    names = list(extra)
    low = F.lit(-(2**63))
    kind = docs.schema["doc_id"].dataType
    number = kind.simpleString() in ("tinyint", "smallint", "int", "bigint")
    # ids that are no integers are dealt by their hash and ordered within equal hashes by themselves
    key = F.coalesce(F.col("doc_id").cast("long"), low) if number else F.when(F.col("doc_id").isNull(), low).otherwise(F.xxhash64("doc_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"_k": key, "_t": F.xxhash64("text")})
    keys = rows.select("_k", "_t")
    groups, count = groups_per_partition * partitions(spark), keys.count()
    if not count:
        return rows.select("doc_id", "text", *[e.alias(n) for n, e in extra.items()], F.lit("").alias("next_text"), *[F.lit("").alias(f"next_{n}") for n in names])
    share = min(1.0, groups * per_group / count)
    some = keys.filter(F.xxhash64("_k", "_t", F.lit(5)) / F.lit(2.0**64) + 0.5 <= share).distinct().orderBy("_k", "_t").collect()
    picked = [tuple(some[i * len(some) // groups]) for i in range(1, groups)] if some else []
    top = tuple(keys.agg(F.max(F.struct("_k", "_t"))).first()[0])
    cuts = sorted({p for p in picked if p < top})
    # a bound is the largest key of its range in this table, so that the row that carries it is there
    placed = rows.withColumn("_g", _below(cuts, F.col("_k"), F.col("_t")))
    # rows at a bound also serve the range above it; those with the largest key of all serve range 0 from below
    at_bound = F.lit(False)
    if cuts:
        ks, ts = (F.try_element_at(x, F.col("_g") + 1) for x in _listed(cuts))
        at_bound = F.coalesce((ks == F.col("_k")) & (ts == F.col("_t")), at_bound)
    copies = F.array_compact(
        F.array(
            F.struct(F.col("_g").alias("g"), F.lit(1).alias("own")),
            F.when(at_bound, F.struct((F.col("_g") + 1).alias("g"), F.lit(0).alias("own"))),
            F.when((F.col("_k") == F.lit(top[0])) & (F.col("_t") == F.lit(top[1])), F.struct(F.lit(0).alias("g"), F.lit(-1).alias("own"))),
        )
    )
    made = placed.withColumns(extra)
    spread = made.withColumn("_c", F.explode(copies)).select("doc_id", "text", *names, "_k", "_t", F.col("_c.g").alias("_g"), F.col("_c.own").alias("_own"))
    # own = 1 first; then the row from the range below; then the wrapped one, for range 0 alone
    order = [F.col("_own").desc(), F.col("_k").desc(), F.col("doc_id").desc(), F.col("_t").desc(), F.col("text").desc()]
    w = Window.partitionBy("_g").orderBy(*order)
    after = {f"next_{n}": F.lead(n).over(w) for n in ("text", *names)}
    return spread.withColumns(after).filter("_own = 1").select("doc_id", "text", *names, *after)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many, or all, of the next document. Null texts count as
    empty; equal texts have equal fingerprints, and equal empty ones likeness
    1; an empty text's likeness to another is 0. Repeated rows get a row each
    and follow one another. doc_id may have any type, and texts
    any length. Other columns are ignored; an empty table gives no rows.
    """
    rows = with_next(docs, {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    full = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("_edited"))
    both = full.withColumns({"edited_sha256": _hash(F.col("_edited")), "edited_fingerprint": fingerprint(F.col("_edited"))})
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the whole of documents."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op9_document_fingerprints": op9_document_fingerprints}


def _sql() -> str:
    ends, word_ends = ENDS.replace(r"\n", "\n"), WORD_ENDS.replace(r"\t", "\t").replace(r"\x0B", "\x0b").replace(r"\f", "\f").replace(r"\r", "\r")
    pieces = f"regexp_extract_all(t, '[^{ends}]{{0,{WIDEST}}}[{ends}]+|[^{ends}]+')"
    words = f"string_split(regexp_replace(p, '([{LAST}][{word_ends}]+)([{FIRST}])', '\\1' || chr(10) || '\\2', 'g'), chr(10))"
    wide = f"flatten(list_transform({words}, lambda q: regexp_extract_all(q, '(?s).{{1,{WIDEST}}}')))"
    cut = f"flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) > {WIDEST} AND NOT regexp_matches(p, '[{ends}]$') THEN {wide} ELSE [p] END))"
    marked = f"list_transform({cut}, lambda p: CASE WHEN sha256(p)[1] IN ({', '.join(repr(c) for c in CUTS)}) THEN sha256(p) || ';' ELSE sha256(p) || ',' END)"
    parts = f"list_filter(string_split(regexp_replace(array_to_string({marked}, ''), '[,;]$', ''), ';'), lambda s: s <> '')"
    branch = "list_transform(s, lambda x: sha256(x))"
    shown = rf"list_transform(s, lambda x: sha256(x) || '(' || regexp_replace(x, '([0-9a-f]{{{SHOWN}}})[0-9a-f]*', '\1', 'g') || ')')"
    fp = lambda src, cols: f"SELECT {cols}, sha256(array_to_string({branch}, ',')) || '|' || array_to_string({shown}, '|') AS fp, {shown} AS br FROM (SELECT *, {parts} AS s FROM {src})"
    leaves = r"list_distinct(flatten(list_transform({}, lambda x: string_split(regexp_extract(x, '\((.*)\)', 1), ','))))"
    but = "list_filter(list_distinct({}), lambda x: NOT list_contains({}, x))"
    x, y = leaves.format(but.format("a", "b")), leaves.format(but.format("b", "a"))
    same = "coalesce(list_sum(list_transform(list_intersect(a, b), lambda x: length(x) - length(replace(x, ',', '')) + 1)), 0)"
    share = f"({same} + len(list_intersect(x, y))) / CAST({same} + len(list_distinct(list_concat(x, y))) AS DOUBLE)"
    near = lambda a, b, fa, fb: f"(SELECT CASE WHEN {fa} = {fb} THEN 1.0::DOUBLE WHEN len(x) + len(y) + {same} = 0 THEN 0.0::DOUBLE ELSE least(1 - 1e-9::DOUBLE, {share}) END FROM (SELECT a, b, {x} AS x, {y} AS y FROM (SELECT {a} AS a, {b} AS b)))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({fp('d', 'doc_id, t')}),
o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(fp) OVER w, first_value(fp) OVER w) AS nfp, coalesce(lead(br) OVER w, first_value(br) OVER w) AS nbr FROM f WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, length(t) AS n, fp AS ofp, br AS obr, nfp, nbr, t[1:length(t) - length(t) // 2] || nt[1:length(t) // 2] AS t FROM o),
g AS ({fp('e', 'doc_id, n, ofp, obr, nfp, nbr, t')})
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(t) AS edited_sha256, ofp AS fingerprint, fp AS edited_fingerprint,
  {near('obr', 'br', 'ofp', 'fp')} AS near_edited, {near('obr', 'nbr', 'ofp', 'nfp')} AS near_next FROM g
"""


SQL = {"op9_document_fingerprints": _sql()}
