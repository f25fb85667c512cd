"""Byte-level text kernels shared by the corpus operators.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of the
batch are one numpy array, read from Arrow's own buffer without decoding, and
words, shingles and windows are found with whole-array operations, so no
Python loop runs per byte or per word. A word hash is 64 bits and depends on
the word's bytes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .store import small_batches

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_GROW = 1 << 16
#: Bytes that the kernels work on at a time; their temporaries take about 40 times as many.
CHUNK = 1 << 20


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


BYTE_CODES = _table(20240117)
BYTE_CODES_2 = _table(77003311)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+ : everything but ASCII white space belongs to a word.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, lower-case letters, all non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), _GROW)
            self.up, self.down = self._run(self.base, size), self._run(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, U64(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = {}


def powers(base: int) -> Powers:
    if base not in _POWERS:
        _POWERS[base] = Powers(base)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a copy)."""
    x = x.copy()
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def prefix_hash(data: np.ndarray, codes: np.ndarray = BYTE_CODES, base: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums H with H[j]-H[i] = sum of code[data[t]]*base**t for i<=t<j, and the inverse powers that make a slice's hash independent of where it stands."""
    up, down = powers(base).get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=out[1:])
    return out, down


def slice_hash(h: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end); the length is mixed in."""
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)


def lay_out(texts) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes end to end and the len(texts)+1 offsets, of an Arrow column or a list; null counts as empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([None if t is None else t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts], pa.binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "", texts.type))
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and the offsets of each text's words; a word never crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _long_run_hashes(data: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The word hashes of one text of any length, CHUNK bytes at a time; a word that goes on into the next chunk is carried over."""
    base, found, total, length = 0x5851F42D4C957F2D | 1, [], 0, 0
    close = lambda: mix(np.array([total + length * int(_MULT) & (1 << 64) - 1], np.uint64))
    for a in range(0, len(data), CHUNK):
        part = LOWER[data[a : a + CHUNK]]
        starts, ends, _ = words(part, np.array([0, len(part)]), member)
        h, down = prefix_hash(part)
        if length and not (len(starts) and starts[0] == 0):
            found.append(close())
            total = length = 0
        if len(starts) and length:  # the open word's next bytes
            total = (total + int(h[ends[0]]) * pow(base, length, 1 << 64)) & (1 << 64) - 1
            length += int(ends[0])
            if ends[0] == len(part):
                continue
            found.append(close())
            total, length, starts, ends = 0, 0, starts[1:], ends[1:]
        if len(ends) and ends[-1] == len(part):
            s = int(starts[-1])
            total, length = int(((h[-1:] - h[s : s + 1]) * down[s : s + 1])[0]), len(part) - s
            starts, ends = starts[:-1], ends[:-1]
        found.append(slice_hash(h, down, starts, ends))
    if length:
        found.append(close())
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_hashes(texts, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words of the texts, and each text's offsets into them."""
    data, offsets = lay_out(texts)
    if len(data) > 4 * CHUNK:
        each = [_long_run_hashes(data[a:b], member) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([np.zeros(0, np.uint64), *each]), np.concatenate(([0], np.cumsum([len(e) for e in each], dtype=np.int64)))
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, member)
    h, down = prefix_hash(data)
    return slice_hash(h, down, starts, ends), bounds


def parts(texts, rows: int = 512):
    """(text of each part, bytes, offsets) of groups of parts, at most CHUNK bytes and `rows` parts each.

    A part is a whole text, or a stretch of one of over CHUNK bytes, cut after
    its last line end or else white space, or in a word of over CHUNK / 2 bytes
    where a character ends.
    """
    data, offsets = lay_out(texts)
    cuts = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > CHUNK).tolist():
        a, end, own = int(offsets[i]), int(offsets[i + 1]), []
        while end - a > CHUNK:
            tail = data[a + CHUNK // 2 : a + CHUNK]
            for mask in (tail == 10, ~NON_SPACE[tail], (data[a + CHUNK // 2 + 1 : a + CHUNK + 1] & 0xC0) != 0x80):
                if mask.any():
                    a += CHUNK - int(np.argmax(mask[::-1]))
                    break
            else:
                a += CHUNK
            own.append(a)
        cuts.append(np.asarray(own, np.int64))
    offs = np.sort(np.concatenate(cuts), kind="stable")
    owner = np.searchsorted(offsets, offs[:-1], side="right") - 1
    empty = np.diff(offs) == 0
    if empty.any():  # empty texts share an offset: the k-th of them is the k-th text there
        owner[empty] = np.flatnonzero(np.diff(offsets) == 0)
    i = 0
    while i < len(owner):
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, side="right")) - 1), i + rows, len(owner))
        yield owner[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of equally long hash arrays, order-sensitive."""
    out = np.full(len(parts[0]), U64(0x243F6A8885A308D3) ^ U64(len(parts)), dtype=np.uint64)
    for p in parts:
        out = mix(out * U64(0xD6E8FEB86659FD93) + p)
    return out


def shingle_sets(texts, size: int, member: np.ndarray = NON_SPACE) -> list[np.ndarray]:
    """Each text's sorted distinct word shingles; fewer words than `size` make one shingle, none make none."""
    hashes, bounds = word_hashes(texts, member)
    n = len(hashes)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for a in range(0, len(full), CHUNK):
        b = min(a + CHUNK, len(full))
        full[a:b] = combine([hashes[a + i : b + i] for i in range(size)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            s = np.sort(full[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(combine([hashes[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fresh(columns, *names: str) -> list[str]:
    """Names for columns of our own that no column of a caller's table has."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def pieces(batches, limit: int = CHUNK, column: str = "text", rows: int = 2048):
    """Cuts Arrow batches so that a piece holds about `limit` bytes of text and `rows` rows at most; a long text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        long = size > limit
        group = np.cumsum(np.where(long, 0, size)) // limit + np.arange(len(size)) // rows
        # a long text parts the rows before and after it
        new = (np.diff(group) > 0) | long[1:] | long[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(size)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def append(docs: DataFrame, added: dict[str, pa.DataType], make, limit: int = CHUNK, without: tuple[str, ...] = (), rows: int = 2048) -> DataFrame:
    """docs with the columns of make(piece), a dict of values by name, in place of its own columns of these names and those of `without`.

    The other columns pass as Arrow arrays and are never converted, whatever
    their types and nulls.
    """
    names = [c for c in docs.columns if c not in added and c not in without]
    small_batches(docs.sparkSession)

    def run(batches):
        for piece in pieces(batches, limit, rows=rows):
            more = make(piece)
            columns = [piece.column(c) for c in names] + [pa.array(more[c], t) for c, t in added.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    kept = [StructField(f.name, f.dataType) for f in docs.schema.fields if f.name in names]
    return docs.mapInArrow(run, StructType(kept + [StructField(c, from_arrow_type(t)) for c, t in added.items()]))


def batches(frames, limit: int = CHUNK):
    """Like pieces, for pandas frames; a bounded sample of labelled rows is small enough for them."""
    for frame in frames:
        group = np.cumsum(frame["text"].str.len().fillna(0).to_numpy(dtype=np.int64)) // limit
        for _, part in frame.groupby(group, sort=True):
            yield part.reset_index(drop=True)
