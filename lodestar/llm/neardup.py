"""Near-duplicate classes by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts makes each document's distinct word shingles, a
   fingerprint of the whole set, `bands` band keys over `bands * rows` minima
   and a sketch that keeps only the low two bits of every minimum.
2. Documents with equal sets form one class with a representative, so a hot
   group of copies is one row from here on.
3. Representatives that share a band key are compared on their sketches only
   (bit counts, corrected for chance agreement); those with an estimate within
   five standard deviations of the threshold are joined to clusters. Within a
   bucket a spanning forest is found, so pairs are never written out.
4. The shingle sets of each cluster's members meet once and are compared
   exactly; the links found (again a spanning forest) give the components.

In a bucket or cluster of over `block` members every member first meets one of
them, the centre. Those that are near it are linked to it and to each other by
that; only the others, the far ones, still have to meet all members. They do so
in units, pairs of blocks with far members on one side at least, so no group
has to fit one task, a large group of near copies costs no more than its size,
and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .store import Staged, partitions, table

U64 = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def minima(shingles: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each multiplicative hash's minimum over the set."""
    best = np.full(len(mult), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(best, (mult[:, None] * part[None, :]).min(axis=1), out=best)
    return (best >> U64(32)).astype(np.uint32)


def pack(low: np.ndarray) -> np.ndarray:
    """(n, k) values below 4, k a multiple of 32 -> (n, k / 32) words of two bits each."""
    w = low.astype(np.uint64).reshape(len(low), -1, 32)
    return (w << (np.arange(32, dtype=np.uint64) * U64(2))).sum(axis=2, dtype=np.uint64)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many two-bit values agree, for rows of packed words."""
    d = x ^ y
    d = (d | (d >> U64(1))) & U64(0x5555555555555555)
    return 32 * d.shape[-1] - np.bitwise_count(d).sum(axis=-1, dtype=np.int64)


def estimate(agree: np.ndarray, k: int) -> np.ndarray:
    """Jaccard estimate without the quarter of agreements that are chance."""
    return (agree / k - 0.25) / 0.75


def sketch_floor(similarity: float, k: int) -> float:
    p = similarity + (1 - similarity) / 4
    return similarity - 5 * (p * (1 - p) / k) ** 0.5 / 0.75


def _groups(frames, keys):
    """Runs of equal keys from frames sorted by them, also across frame borders; yields frames of whole groups."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        same = np.ones(len(frame), dtype=bool)
        for k in keys:
            same &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        cut = int(np.argmin(same[::-1])) if not same.all() else len(frame)
        rest = frame.iloc[len(frame) - cut :].reset_index(drop=True)
        if cut < len(frame):
            yield frame.iloc[: len(frame) - cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Spanning forest of a graph given by near(i, candidates) -> mask; each node is expanded once, against nodes not reached yet."""
    left = np.arange(n)
    out = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            left = left[~hit]
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def _bounds(frame: pd.DataFrame, keys) -> list[int]:
    new = np.zeros(len(frame), dtype=bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return [*np.flatnonzero(new).tolist(), len(frame)]


def _sketch_links(similarity: float, k: int):
    floor = sketch_floor(similarity, k)

    def run(frames):
        for frame in _groups(frames, ("key", "unit")):
            ids, size = frame["rep"].to_numpy(), frame["n"].to_numpy()
            sketch = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)
            a, b = [], []
            cuts = _bounds(frame, ("key", "unit"))
            lengths = np.diff(cuts)
            first = np.asarray(cuts[:-1])[lengths == 2]  # most buckets are pairs
            ok = (estimate(agreeing(sketch[first], sketch[first + 1]), k) >= floor) & (
                np.minimum(size[first], size[first + 1]) >= similarity * np.maximum(size[first], size[first + 1])
            )
            a += ids[first[ok]].tolist()
            b += ids[first[ok] + 1].tolist()
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x <= 2:
                    continue

                def near(i, others, x=x):
                    s, t = size[x + i], size[x + others]
                    return (estimate(agreeing(sketch[x + i][None], sketch[x + others]), k) >= floor) & (np.minimum(s, t) >= similarity * np.maximum(s, t))

                for i, j in _forest(y - x, near):
                    a.append(ids[x + i])
                    b.append(ids[x + j])
            if a:
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return run


def _exact_links(percent: int):
    def run(frames):
        for frame in _groups(frames, ("key", "unit")):
            ids = frame["rep"].to_numpy()
            cuts = _bounds(frame, ("key", "unit"))
            a, b = [], []
            for x, y in zip(cuts[:-1], cuts[1:]):
                sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"].iloc[x:y]]
                sizes = np.array([len(s) for s in sets])
                flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))

                def near(i, others):
                    fits = 100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])
                    out = np.zeros(len(others), dtype=bool)
                    own = sets[i]
                    for block in np.array_split(np.flatnonzero(fits), max(1, int(fits.sum()) // 512)):
                        if not len(block):
                            continue
                        o = others[block]
                        at = np.repeat(starts[o] - np.concatenate(([0], np.cumsum(sizes[o])[:-1])), sizes[o]) + np.arange(sizes[o].sum())
                        v = flat[at]
                        hit = own[np.minimum(np.searchsorted(own, v), len(own) - 1)] == v
                        common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[o])[:-1])))
                        out[block] = 100 * common >= percent * (sizes[i] + sizes[o] - common)
                    return out

                for i, j in _forest(y - x, near):
                    a.append(ids[x + i])
                    b.append(ids[x + j])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return run


def _sketch_near(similarity: float, k: int):
    """Marks the rows whose sketch is near that of their centre."""
    floor = sketch_floor(similarity, k)

    def run(frames):
        for frame in frames:
            own, centre = (np.frombuffer(b"".join(frame[c]), np.uint64).reshape(len(frame), -1) for c in ("sketch", "c_sketch"))
            s, t = frame["n"].to_numpy(), frame["c_n"].to_numpy()
            near = (estimate(agreeing(own, centre), k) >= floor) & (np.minimum(s, t) >= similarity * np.maximum(s, t)) if len(frame) else np.zeros(0, bool)
            yield frame.assign(near=near)

    return run


def _exact_near(percent: int):
    """Marks the rows whose shingle set is near that of their centre."""

    def run(frames):
        for frame in frames:
            near = []
            for own, centre in zip(frame["shingles"], frame["c_shingles"]):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(centre, np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                near.append(100 * common >= percent * (len(x) + len(y) - common))
            yield frame.drop(columns="c_shingles").assign(near=np.array(near, bool))

    return run


def _linked(rows: DataFrame, counts: DataFrame, compared: dict[str, str], near, links, block: int, staged: Staged) -> DataFrame:
    """(a, b) links of a spanning forest within each key.

    counts (key, blocks, centre) tells the groups of more than one block and
    the member that is their centre; `compared` names the columns by which rows
    are compared and what the centre's are called. Large groups are written
    with their marks first, so that Spark knows their size when it joins.
    """
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    large = staged.put(counts.filter("blocks > 1"))
    dealt = rows.select("key", "rep", *compared)
    small = dealt
    parts = []
    if large.head(1):
        small = dealt.join(large.select("key"), "key", "left_anti")
        centres = staged.put(dealt.join(large.select("key", F.col("centre").alias("rep")), ["key", "rep"]).select("key", F.col("rep").alias("c_rep"), *[F.col(c).alias(x) for c, x in compared.items()]))
        met = dealt.join(centres, "key")
        kinds = dict(met.dtypes)
        kept = ["key", "rep", "c_rep", *compared, *[x for x in compared.values() if x != "c_shingles"]]
        marked = staged.put(met.select("key", "rep", "c_rep", *compared, *compared.values()).mapInPandas(near, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", near boolean"))
        parts.append(marked.filter("near and rep != c_rep").select(F.col("rep").alias("a"), F.col("c_rep").alias("b")))
        size = F.ceil(F.count(F.lit(1)) / F.lit(block))
        sides = marked.groupBy("key", "near").agg(size.alias("blocks")).groupBy("key").agg(F.max(F.when(~F.col("near"), F.col("blocks"))).alias("far"), F.max(F.when(F.col("near"), F.col("blocks"))).alias("by"))
        sides = staged.put(sides.filter("far is not null"))
        own = F.when(F.col("near"), F.pmod(F.xxhash64("rep"), F.col("by"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("far")))
        fars, bys = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("far", "by"))
        # a unit is named by its far block and the other one, far blocks first
        of_far = F.concat(F.transform(fars, lambda j: F.least(j, own) * (F.col("far") + F.col("by")) + F.greatest(j, own)), F.transform(bys, lambda j: own * (F.col("far") + F.col("by")) + F.col("far") + j))
        of_near = F.transform(fars, lambda j: j * (F.col("far") + F.col("by")) + F.col("far") + own)
        left = marked.join(sides, "key").withColumn("unit", F.explode(F.when(F.col("near"), of_near).otherwise(of_far)))
        small = small.withColumn("unit", F.lit(-1).cast("long")).union(left.select("key", "rep", *compared, "unit"))
    else:
        small = small.withColumn("unit", F.lit(-1).cast("long"))
    met = small.repartition(n, "key", "unit").sortWithinPartitions("key", "unit").mapInPandas(links, "a binary, b binary")
    for p in parts:
        met = met.union(p)
    return met


def _classes(docs: DataFrame, words: int, percent: int, bands: int, rows: int, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Every row's id, hash and shingle set (id, th, doc_id, n, node), and the set's component (node, component)."""
    spark = docs.sparkSession
    staged = Staged(spark, "neardup")
    k = bands * rows
    assert k % 32 == 0, "bands * rows must be a multiple of 32"
    mult = _odd(k, 4321)

    def signatures(piece):
        out = []
        for s in tk.shingle_sets(piece.column("text"), words):
            if not len(s):
                out.append((0, None, None, None))
                continue
            m = minima(s, mult)
            keys = tk.combine([np.arange(bands, dtype=np.uint64), *m.reshape(bands, rows).T.astype(np.uint64)]).view(np.int64)
            node = np.array([s.sum(dtype=np.uint64) + U64(len(s)), tk.mix(s * U64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)]).tobytes()
            out.append((len(s), node, pack((m & np.uint32(3))[None])[0].tobytes(), keys))
        return dict(zip(("n", "node", "sketch", "keys"), zip(*out)))

    made = {"n": pa.int64(), "node": pa.binary(), "sketch": pa.binary(), "keys": pa.list_(pa.int64())}
    light = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull()).alias("id"), F.xxhash64("text").alias("th"), "text")
    signed = staged.put(tk.append(light, made, signatures, without=("text",)))
    sets = staged.put(signed.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("id").alias("id"), F.min("th").alias("th"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys")))
    banded = sets.select(F.col("node").alias("rep"), "n", "sketch", F.explode("keys").alias("key"))
    per_key = banded.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"), F.min("rep").alias("centre"))
    loose = _linked(banded, per_key, {"n": "c_n", "sketch": "c_sketch"}, _sketch_near(percent / 100, k), _sketch_links(percent / 100, k), block, staged)
    clusters = components(loose, staged).withColumnRenamed("node", "rep").withColumnRenamed("component", "key")

    def shingles(piece):
        return {"shingles": [s.tobytes() for s in tk.shingle_sets(piece.column("text"), words)]}

    # one text of each set in a cluster: a row that carries it, found by id and hash
    wanted = staged.put(clusters.join(signed.filter("n > 0").groupBy(F.col("node").alias("rep")).agg(F.min(F.struct("id", "th")).alias("at"), F.min("n").alias("n")), "rep").select("rep", "key", "n", "at.id", "at.th"))
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull()).alias("id"), F.xxhash64("text").alias("th"), "text")
    found = texts.join(wanted.hint("merge"), ["id", "th"]).select("rep", "key", "text")
    members = staged.put(tk.append(found, {"shingles": pa.binary()}, shingles, without=("text",)).dropDuplicates(["rep"]))
    weights = wanted.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") * 8 / F.lit(block_bytes))).alias("blocks"), F.min("rep").alias("centre"))
    exact = _linked(members, weights, {"shingles": "c_shingles"}, _exact_near(percent), _exact_links(percent), block, staged)
    linked = components(exact, staged)
    return signed, staged.put(sets.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 4,
    block: int = 1024,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Classes of documents linked by Jaccard similarity >= percent / 100 of their distinct `words`-word shingles.

    Input: doc_id (of any type that can be ordered) and text; other columns
    are ignored. Returns doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links, its own included) and kept (doc_id = component_id),
    one row for each input row.

    Null and empty texts and texts of white space have no shingles and no
    links, their component is their own. A text of fewer words than a shingle
    has one shingle, all of it. Texts may have any length. Rows are linked by
    their texts: of two texts under one doc_id each belongs to its own class,
    and equal rows to the same one. A null doc_id is never a component's, and
    is kept where its component has no other. An empty table gives no rows.

    A pair at the threshold is missed by all bands with probability
    (1 - s**rows)**bands, 3e-6 here, and by the sketch with 3e-7.
    """
    signed, classes = _classes(docs, words, percent, bands, rows, block, block_bytes)
    some = signed.filter("n > 0").select("doc_id", "n", "node").join(classes, "node")
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    met = some.join(least, "component").select("doc_id", "n", "component_id")
    out = met.union(signed.filter("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, block: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with one row of each class of near_duplicates, the one with the smallest doc_id (null last), then text hash.

    Decisions are by row: rows alike in doc_id and text become one, with the
    smallest values of the other columns, and another text under the same
    doc_id is judged on its own. Rows without shingles all stay.
    """
    spark = docs.sparkSession
    signed, classes = _classes(docs, words, percent, bands, rows, block, block_bytes)
    staged = Staged(spark, "kept")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "id")
    some = signed.filter("n > 0").join(classes, "node")
    first = some.groupBy("component").agg(F.min(order).alias("first"))
    judged = some.join(first, "component").select("id", "th", ((F.col("id") == F.col("first.id")) & (F.col("th") == F.col("first.th"))).alias("stays"))
    # rows alike in id and text are alike here
    fate = staged.put(judged.groupBy("id", "th").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("copies")))
    names = tk.fresh(docs.columns, "_id", "_th")
    keyed = docs.withColumns({names[0]: F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull()), names[1]: F.xxhash64("text")})
    named = lambda df: df.select(F.col("id").alias(names[0]), F.col("th").alias(names[1])).hint("merge")
    out = keyed.join(named(fate.filter("not stays or copies > 1")), names, "left_anti").select(*docs.columns)
    again = fate.filter("stays and copies > 1")
    if again.head(1):
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        alike = keyed.join(named(again), names, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *others)).alias("_least"))
        out = out.union(alike.select(*[F.col(f"_least.{c}").alias(c) if c in others else F.col(c) for c in docs.columns]))
    return out


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles, 100 * intersection >= 80 * union, over the whole of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = {"op10_minhash_neardup": op10_minhash_neardup}
SQL: dict[str, str] = {}
