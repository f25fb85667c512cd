"""Removal of long repeated byte strings with Burrows-Wheeler transforms over shared regions.

A text's windows of `length` bytes are dealt out by content: every window
contains one anchor, the gram with the smallest hash in it, so equal windows
anywhere in the corpus have equal anchors. Consecutive windows with the same
anchor form a run, and only a run's hashes are shuffled:

1. a run that occurs more than once repeats with all its windows;
2. a run that is its anchor's only kind has no other windows to repeat;
3. the different runs of the other anchors meet, anchor by anchor, and a BWT
   with threshold-bounded interval expansion finds the repeated windows.
   Anchors with very many different runs are split by the windows' own hashes.

Hash counts are pre-aggregated before they are shuffled, no text is ever
compared with all others, and a text's own marks meet it in one join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .bwt import repeated_windows
from .neardup import _groups
from .store import Staged, partitions, table

U64 = np.uint64
_PLACE = 24


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (len(x) - w + 1 of them), in three passes over blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    ahead = np.minimum.accumulate(padded.reshape(-1, w), axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text index, start in text, windows, anchor hash, content hash) of all runs of the laid-out texts."""
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    if len(data) < length:
        return empty
    h, down = tk.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = tk.mix((h[gram:] - h[:-gram]) * down[at])
    place = U64((1 << _PLACE) - 1)
    # ties go to the rightmost gram, so that equal windows of one text never share a run
    ranked = (grams & ~place) | (place - (at.astype(np.uint64) & place))
    low = _window_minima(ranked, length - gram + 1)
    windows = len(data) - length + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    ok = np.arange(windows) + length <= offsets[1:][doc]
    new = np.ones(windows, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new & ok)
    stop = np.flatnonzero(np.concatenate((new[1:] | ~ok[1:], [True])) & ok) + 1
    anchor = grams[(place - (low[starts] & place)).astype(np.int64)]
    g, back = tk.prefix_hash(data, tk.BYTE_CODES_2, 0x2545F4914F6CDD1D)
    content = tk.slice_hash(g, back, starts, stop + length - 1)
    return doc[starts], starts - offsets[doc[starts]], stop - starts, anchor, content


def _parts(texts, length: int, limit: int):
    """(rows, bytes, offsets, starts of the parts) of groups of texts, about `limit` bytes each; a very long text is cut to overlapping parts, so that each of its windows starts in one."""
    data, offsets = tk.lay_out(texts)
    size = np.diff(offsets)
    long = np.append(np.flatnonzero(size > 2 * limit), len(size))
    i = 0
    while i < len(size):
        if size[i] > 2 * limit:
            for s in range(0, int(size[i]) - length + 1, limit):
                part = data[offsets[i] + s : min(offsets[i] + s + limit + length - 1, offsets[i + 1])]
                yield np.array([i]), part, np.array([0, len(part)]), np.array([s])
            i += 1
            continue
        j = max(i + 1, min(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, int(long[np.searchsorted(long, i)])))
        yield np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.zeros(j - i, np.int64)
        i = j


def _lay(raw) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), offsets


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 48, split: int = 4096, work_bytes: int = 1 << 20, as_text: bool = False) -> DataFrame:
    """Every column of docs, and what is left of the text without repeated strings of `length` bytes.

    A byte goes if some string of `length` bytes that covers it also starts
    anywhere else, in the same text or another one; this is judged on the
    input, so every copy goes. Texts count as UTF-8 bytes and matches never
    cross texts. Adds n_bytes, n_removed, n_spans (maximal removed runs), kept
    (binary; with as_text a string, without the parts of characters that a
    span's end has cut) and spans, an array of [start, end).

    A null text counts as empty. Repeated rows repeat each other, also under
    the same or a null doc_id, which may have any type. Texts may have any
    length. An empty table gives no rows. Columns of docs with the names above
    are replaced.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "repeats")
    own = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "spans")
    id_, th_ = F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull()), F.xxhash64(F.coalesce("text", F.lit("")))

    def cut(batches):
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_th"))
            for rows, data, offsets, begins in _parts(batch.column("text"), length, 1 << 20):
                doc, start, wins, anchor, content = runs_of(data, offsets, length, gram)
                row = rows[doc]
                values = (ids[row], th[row], begins[doc] + start, wins.astype(np.int32), anchor.view(np.int64), content.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["_id", "_th", "pos", "wins", "anchor", "content"])

    # a row is known by the hashes of its id and its text; as bytes a text is never decoded
    light = docs.select(id_.alias("_id"), th_.alias("_th"), F.col("text").cast("binary").alias("text"))
    runs = staged.put(light.mapInArrow(cut, "_id long, _th long, pos long, wins int, anchor long, content long"))

    mark = lambda df: df.select("_id", "_th", F.col("pos").alias("a"), (F.col("pos") + F.col("wins")).alias("b"))
    every_kind = staged.put(runs.groupBy("anchor", "content").agg(F.count("*").alias("n")))
    shared = staged.put(every_kind.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("times")).filter("times > 1").select("anchor", "kinds"))
    known = staged.put(every_kind.join(shared, "anchor"))
    # the one join of the runs: with how often each occurs and how many kinds its anchor has
    met = staged.put(runs.join(known, ["anchor", "content"]))
    staged.drop(runs)
    staged.drop(every_kind)
    # all windows of a run that occurs again repeat, whatever else its anchor has
    marks = [mark(met.filter("n > 1"))]
    # of each kind one place, whichever: the firsts of one group are of one row
    several, cols = met.filter("kinds > 1"), ("_id", "_th", "pos", "wins", "n", "kinds")
    one = several.filter("n > 1").groupBy("anchor", "content").agg(*[F.first(c).alias(c) for c in cols]).select("anchor", *cols)
    kinds = several.filter("n = 1").select("anchor", *cols).union(one)
    has_large = bool(shared.filter(F.col("kinds") > split).head(1))

    def bytes_of(chosen: DataFrame) -> DataFrame:
        """The runs of each text are listed on one row, which meets the text once."""
        lists = chosen.select("_id", "_th", F.struct("pos", "wins", "anchor", "n").alias("r")).groupBy("_id", "_th").agg(F.collect_list("r").alias("runs"))
        return lists.hint("merge").join(light, ["_id", "_th"])

    def take(frames):
        seen = set()
        for frame in frames:
            for i, th, runs, text in zip(frame["_id"], frame["_th"], frame["runs"], frame["text"]):
                if (i, th) in seen:  # repeated rows carry the same bytes
                    continue
                seen.add((i, th))
                yield pd.DataFrame([(i, th, r["pos"], r["anchor"], r["n"] > 1, text[r["pos"] : r["pos"] + r["wins"] + length - 1]) for r in runs], columns=["_id", "_th", "pos", "anchor", "known", "piece"])

    pieces = (
        bytes_of(kinds.filter(F.col("kinds") <= split))
        .mapInPandas(take, "_id long, _th long, pos long, anchor long, known boolean, piece binary")
        .repartition(partitions(spark), "anchor")
        .sortWithinPartitions("anchor")
    )

    def judge(frames):
        for frame in _groups(frames, ("anchor",)):
            size = np.cumsum(frame["piece"].str.len().to_numpy())
            new = np.ones(len(frame), dtype=bool)
            a = frame["anchor"].to_numpy()
            new[1:] = a[1:] != a[:-1]
            whole = np.maximum.accumulate(np.where(new, size, 0)) // work_bytes  # an anchor's pieces stay together
            for _, part in frame.groupby(whole, sort=False):
                found = repeated_windows([np.frombuffer(p, np.uint8) for p in part["piece"]], length)
                out = []
                for i, th, pos, known, m in zip(part["_id"], part["_th"], part["pos"], part["known"], found):
                    if not known and m.any():
                        e = np.flatnonzero(np.diff(np.concatenate(([False], m, [False])).astype(np.int8)))
                        out += [(i, th, pos + x, pos + y) for x, y in zip(e[::2].tolist(), e[1::2].tolist())]
                if out:
                    yield pd.DataFrame(out, columns=["_id", "_th", "a", "b"])

    marks.append(pieces.mapInPandas(judge, "_id long, _th long, a long, b long"))

    if has_large:

        def windows(frames):
            for part in take(frames):
                raw = [p for p in part["piece"]]
                data, offsets = _lay(raw)
                g, back = tk.prefix_hash(data)
                h, down = tk.prefix_hash(data, tk.BYTE_CODES_2, 0x2545F4914F6CDD1D)
                n = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(raw)), n)
                inside = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                s = offsets[row] + inside
                yield pd.DataFrame(
                    {
                        "_id": part["_id"].to_numpy()[row],
                        "_th": part["_th"].to_numpy()[row],
                        "a": part["pos"].to_numpy()[row] + inside,
                        "w1": tk.slice_hash(g, back, s, s + length).view(np.int64),
                        "w2": tk.slice_hash(h, down, s, s + length).view(np.int64),
                    }
                )

        every = staged.put(bytes_of(kinds.filter(F.col("kinds") > split)).mapInPandas(windows, "_id long, _th long, a long, w1 long, w2 long"))
        often = staged.put(every.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"))
        marks.append(every.join(often, ["w1", "w2"]).select("_id", "_th", "a", (F.col("a") + 1).alias("b")))

    rows = marks[0]
    for m in marks[1:]:
        rows = rows.union(m)
    # rows alike in id and text have the same marks: a set has them once, whatever the number of such rows
    i, t, m = tk.fresh(own.columns, "_i", "_t", "_m")
    lists = staged.put(rows.groupBy("_id", "_th").agg(F.collect_set(F.struct("a", "b")).alias(m)).withColumnsRenamed({"_id": i, "_th": t}))
    joined = own.join(lists.hint("merge"), (id_ == F.col(i)) & (th_ == F.col(t)), "left")

    def keep(piece):
        data, offsets = tk.lay_out(piece.column("text"))
        marks = piece.column(m)
        out = {"n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept": [], "spans": []}
        for i in range(len(marks)):
            raw = data[offsets[i] : offsets[i + 1]]
            gone, e = None, np.zeros(0, np.int64)
            if marks[i].is_valid:
                a, b = (np.asarray(x) for x in marks[i].values.flatten())
                delta = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(delta, a, 1)
                np.add.at(delta, b + length - 1, -1)
                gone = np.cumsum(delta)[:-1] > 0
                e = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = (raw if gone is None else raw[~gone]).tobytes()
            out["n_removed"].append(0 if gone is None else int(gone.sum()))
            out["n_spans"].append(len(e) // 2)
            out["kept"].append(kept.decode("utf-8", "ignore") if as_text else kept)
            out["spans"].append(e.reshape(-1, 2).tolist())
        return out

    added = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string() if as_text else pa.binary(), "spans": pa.list_(pa.list_(pa.int64()))}
    return tk.append(joined.select(*own.columns, m), added, keep, without=(m,))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: strings of 200 bytes, whole texts of documents."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
SQL: dict[str, str] = {}
