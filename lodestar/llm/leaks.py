"""Benchmark decontamination with suffix arrays of the training text.

Each block of training texts is one shard. Its words become numbers of the
benchmark's vocabulary (0: not in it), and the suffixes that can match at all,
those whose first two words stand together in the benchmark, are sorted into
a sparse suffix array. Every benchmark suffix that begins with two words of the
shard is then located by binary search: its longest verbatim match and the
places of all matches of a whole window. Suffixes are sorted by their first
`window` words; matches of a whole window that follow each other are then
joined to their full length.
Shards are independent, so nothing is shuffled and the work grows with the
training text alone.

The benchmark travels with the task in blocks of a bounded size; a benchmark
of several blocks is searched block by block over the same texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Staged, table

U64 = np.uint64
SPAN = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("text_word", pa.int64()), ("words", pa.int64())])


class Suffixes:
    """One block of benchmark texts: its vocabulary and the numbers of its words, each suffix being a place in them, in the order of their first two words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.names = window, [i for i, _ in items]
        each = [tk.word_hashes([t], tk.ALNUM)[0] for _, t in items]
        length = np.array([len(e) for e in each], np.int64)
        self.vocabulary, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
        n = len(code)
        self.code = np.concatenate((code.astype(np.int32) + 1, np.zeros(window + 1, np.int32)))
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), length)
        first = np.cumsum(length) - length
        self.place = (np.arange(n) - first[self.item]).astype(np.int32)
        left = (length[self.item] - self.place).astype(np.int32)
        self.width = np.minimum(left, window)
        # a window is whole at every start with `window` words left, or is a shorter item itself
        self.whole = (left >= window) | ((self.place == 0) & (length[self.item] < window))
        self.v = len(self.vocabulary) + 1
        pair = self.pair_of(self.code[:n], np.where(self.width > 1, self.code[1 : n + 1], 0))
        self.order = np.argsort(pair, kind="stable").astype(np.int32)
        self.pairs, self.first = np.unique(pair[self.order], return_index=True)
        self.first = np.append(self.first, n)

    def pair_of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.astype(np.int64) * self.v + two

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def grid(self, at: np.ndarray) -> np.ndarray:
        """The first `window` words of the suffixes at these places; 0 after an item's end."""
        out = self.code[at[:, None] + np.arange(self.window)]
        out[np.arange(self.window) >= self.width[at][:, None]] = 0
        return out


#: Suffixes that are compared at a time, of either side.
_STEP = 1 << 16


def _keys(grid: np.ndarray) -> np.ndarray:
    """Rows of word numbers as fixed-length byte strings that compare in row order."""
    wide = np.ascontiguousarray(grid.astype(">u4"))
    return wide.view(f"S{4 * grid.shape[1]}").reshape(-1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the rows begin with alike."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def search(suffixes: Suffixes, texts) -> list[tuple[int, np.ndarray, list[int], np.ndarray, int]]:
    """Per text: words, hit mask, items with an occurring window, (item, item word, text word, words) of the matches that no longer one holds, longest match in words.

    The texts' suffixes are taken _STEP at a time; each step is one small
    suffix array, in which the benchmark's suffixes are located.
    """
    hashes, bounds = tk.word_hashes(texts, tk.ALNUM)
    w = suffixes.window
    code = suffixes.codes(hashes)
    n = len(code)
    del hashes
    out = [(int(m), np.zeros(int(m), bool), [], np.zeros((0, 4), np.int64), 0) for m in np.diff(bounds)]
    if not n or not len(suffixes.pairs):
        return out
    last = np.zeros(n + 1, bool)  # the last words of texts
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    best = np.zeros(len(out), np.int64)
    located = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    pad = np.concatenate((code, np.zeros(w, np.int32)))
    for a in range(0, n, _STEP):
        b = min(a + _STEP, n)
        # a suffix can match where its first two words stand together in the benchmark, or its first one ends an item
        one, two = pad[a:b], np.where(last[a:b], 0, pad[a + 1 : b + 1])
        spot = np.flatnonzero(one > 0)
        pair = np.concatenate((suffixes.pair_of(one[spot], two[spot]), suffixes.pair_of(one[spot], np.zeros(len(spot), np.int64))))
        known = np.minimum(np.searchsorted(suffixes.pairs, pair), len(suffixes.pairs) - 1)
        same = suffixes.pairs[known] == pair
        mask = same[: len(spot)] | same[len(spot) :]
        able = spot[mask]
        if not len(able):
            continue
        starts = a + able
        wanted = np.unique(known[same])
        end = bounds[np.searchsorted(bounds, starts, side="right")]
        grid = pad[starts[:, None] + np.arange(w)]
        grid[starts[:, None] + np.arange(w) >= end[:, None]] = 0
        order = np.lexsort(grid.T[::-1])
        starts, grid = starts[order], grid[order]
        array = _keys(grid)
        text = np.searchsorted(bounds, starts, side="right") - 1
        size = suffixes.first[wanted + 1] - suffixes.first[wanted]
        queries = suffixes.order[np.repeat(suffixes.first[wanted] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        for q in np.array_split(queries, -(-len(queries) // _STEP)):
            rows, width = suffixes.grid(q), suffixes.width[q]
            lo = np.searchsorted(array, _keys(rows), side="left")
            # the end of the range: the first suffix beyond every continuation of the window
            beyond = rows.astype(np.int64)
            beyond[np.arange(w) >= width[:, None]] = 0xFFFFFFFE
            hi = np.searchsorted(array, _keys(beyond), side="right")
            # a suffix's longest match stands next to its own place among the benchmark's, of which `same_as` has the words in order
            ranks = np.lexsort(rows.T[::-1])
            same_as = rows[ranks]
            spot = np.searchsorted(_keys(same_as), array)
            for near in (np.minimum(spot, len(q) - 1), np.maximum(spot - 1, 0)):
                np.maximum.at(best, text, _common(grid, same_as[near]))
            found = np.flatnonzero(suffixes.whole[q] & (hi > lo))
            size = (hi - lo)[found]
            located.append((np.repeat(q[found], size), starts[np.repeat(lo[found] - np.cumsum(size) + size, size) + np.arange(size.sum())]))
    which, at = (np.concatenate(x) for x in zip(*located))
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + suffixes.width[which], -1)
    hit = np.cumsum(delta)[:-1] > 0
    text = np.searchsorted(bounds, at, side="right") - 1
    spots = _extended(suffixes.item[which].astype(np.int64), suffixes.place[which].astype(np.int64), at, suffixes.width[which].astype(np.int64), text)
    owner = np.searchsorted(bounds, spots[:, 2], side="right") - 1
    by = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by], np.arange(len(out) + 1))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        mine = spots[by[cut[i] : cut[i + 1]]]
        mine[:, 2] -= a
        if len(mine):
            out[i] = (b - a, hit[a:b], np.unique(mine[:, 0]).tolist(), mine, max(int(best[i]), int(mine[:, 3].max())))
        else:
            out[i] = (b - a, hit[a:b], [], mine, int(best[i]))
    return out


def _extended(item: np.ndarray, place: np.ndarray, at: np.ndarray, width: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(item, item word, text word, words) of the maximal matches behind all located windows, sorted by item and diagonal.

    Windows of one match stand on one diagonal (text word - item word) at
    places one after the other, as every window of it is located. A run of
    them is one match, of its first window's start to its last one's end;
    beyond that no word agrees, or the next window would stand there too.
    """
    order = np.lexsort((place, at - place, item))
    item, place, at, width, text = item[order], place[order], at[order], width[order], text[order]
    first = np.ones(len(item), bool)
    first[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    a = np.flatnonzero(first)
    b = np.append(a[1:], len(item)) - 1 if len(a) else a
    return np.stack((item[a], place[a], at[a], at[b] + width[b] - at[a]), axis=1)


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in blocks of at most block_bytes of text (a longer item alone), read item by item."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        n = len(text.encode("utf-8", "replace"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 16 << 20) -> DataFrame:
    """Every column of docs, and what it shares with the benchmark.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and
    non-ASCII characters. A window is `window` consecutive words of an item,
    or a shorter item's whole text. Adds n_words, n_hit (words inside an
    occurrence of a window), items (sorted ids, as strings, of the items that
    have one), spans (item, item word and text word from 0, and words of every
    maximal match that holds a window), longest (words of the longest match of
    any benchmark suffix) and contaminated (n_hit > 0 and share * n_hit >=
    n_words).

    Null or wordless texts and items match nothing; an item without an id is
    ignored; an id with several texts counts as one item, repeated items as
    one. Repeated documents get a row each. Texts may have any length: their
    suffixes are sorted _STEP at a time. An empty benchmark hits nothing, an
    empty table gives no rows. The benchmark is sent to the tasks `block_bytes`
    at a time, and every block is a pass over docs. Columns of docs with the
    added names are replaced.
    """
    own = docs.drop("n_words", "n_hit", "items", "spans", "longest", "contaminated")
    (hits_,) = tk.fresh(own.columns, "_hits")
    added = {"n_words": pa.int64(), hits_: pa.binary(), "items": pa.list_(pa.string()), "spans": pa.list_(SPAN), "longest": pa.int64()}

    def scan(block: list[tuple[str, str]]):
        ready = []

        def make(piece):
            if not ready:  # once for each task
                ready.append(Suffixes(block, window))
            suffixes = ready[0]
            found = search(suffixes, piece.column("text"))
            spans = [[dict(zip(("item", "item_word", "text_word", "words"), (suffixes.names[j], *more))) for j, *more in r[3].tolist()] for r in found]
            if hits_ not in piece.schema.names:
                return {"n_words": [r[0] for r in found], hits_: [np.packbits(r[1]).tobytes() for r in found], "items": [sorted({suffixes.names[j] for j in r[2]}) for r in found], "spans": spans, "longest": [r[4] for r in found]}
            before = [piece.column(c).to_pylist() for c in (hits_, "items", "spans", "longest")]
            hits = [np.packbits(r[1]) | np.frombuffer(b, np.uint8) for r, b in zip(found, before[0])]
            return {
                "n_words": [r[0] for r in found],
                hits_: [h.tobytes() for h in hits],
                "items": [sorted({*old, *(suffixes.names[j] for j in r[2])}) for old, r in zip(before[1], found)],
                "spans": [old + new for old, new in zip(before[2], spans)],
                "longest": [max(old, r[4]) for old, r in zip(before[3], found)],
            }

        return make

    now, n, staged = own, 0, Staged(docs.sparkSession, "leaks")
    for block in _blocks(benchmark, block_bytes):
        n += 1
        now = tk.append(now if n == 1 else staged.put(now), added, scan(block))
    if not n:
        now = tk.append(now, added, scan([]))
    # bits past the text's last word are never set
    out = tk.append(now, {"n_hit": pa.int64()}, lambda piece: {"n_hit": [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in piece.column(hits_).to_pylist()]}, without=(hits_,))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: windows of 13 words, whole documents and benchmark."""
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}

SQL = {
    "op3_benchmark_decontamination": r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 13) AS k, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM w WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
hit AS (
  SELECT doc_id, i, k, item FROM (
    SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k) p
  JOIN win USING (k)
  WHERE array_to_string(list_slice(ws, i, i + k - 1), ' ') = win.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
