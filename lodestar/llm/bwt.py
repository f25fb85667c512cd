"""Repeated substrings of at least a given length from a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of the text sorted by their first `depth` (or more) bytes, by prefix doubling; ties stand in any order."""
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key |= np.roll(text, -i).astype(np.uint64) << U64(56 - 8 * i)
    done = 8
    while True:
        order = np.argsort(key, kind="stable" if n < 64 else None)
        s = key[order]
        new = np.empty(n, dtype=np.uint64)
        new[0] = 0
        np.cumsum(s[1:] != s[:-1], out=new[1:])
        if done >= depth or int(new[-1]) == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = new
        key = rank * U64(n) + np.roll(rank, -done)
        done *= 2


def expand(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """bool per place of `order`: the common prefix with the place before is at least `depth`.

    Breadth-first backward extension: from the interval of all rotations, the
    intervals of every string w of length l are extended to those of cw. A
    right end that no shorter string has set gets the common prefix l, so the
    values come in increasing order; the search stops at `depth`, and the
    places still unset share `depth` bytes or more. An interval is taken up
    only when its right end is new, so each place is set once.
    """
    n = len(text)
    bwt = text[order - 1]
    back = np.empty(n, dtype=np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)  # LF mapping
    unset = np.ones(n + 1, dtype=bool)
    unset[0] = unset[n] = False
    left, right = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(depth):
        size = right - left
        at = np.repeat(left - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(left), dtype=np.int32), size)
        to = back[at]
        if level == 0:
            firsts = np.flatnonzero(np.bincount(text, minlength=256))
            ends = np.cumsum(np.bincount(text, minlength=256))[firsts]
            lefts = np.concatenate(([0], ends[:-1]))
        else:
            by = np.argsort(to)
            to, which, sym = to[by], which[by], bwt[at[by]]
            cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (which[1:] != which[:-1]) | (sym[1:] != sym[:-1]))
            lefts = to[np.concatenate(([0], cut + 1))]
            ends = to[np.concatenate((cut, [len(to) - 1]))] + 1
        new = unset[ends]
        left, right = lefts[new], ends[new]
        unset[right] = False
        if not len(left):
            break
    return unset[:n]


def repeated_windows(pieces: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each piece a mask of its len - length + 1 windows: whether the window stands at another place of the pieces too."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.concatenate([*pieces, np.zeros(1, np.uint8)])
    valid = np.zeros(len(text), dtype=bool)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for s, m in zip(starts.tolist(), sizes.tolist()):
        valid[s : s + max(0, m - length + 1)] = True
    order = suffix_order(text, length)
    shared = expand(text, order, length)
    ok = valid[order]
    group = np.cumsum(~shared) - 1
    often = np.bincount(group[ok], minlength=int(group[-1]) + 1) > 1
    hit = np.zeros(len(text), dtype=bool)
    hit[order[ok & often[group]]] = True
    return [hit[s : s + max(0, m - length + 1)] for s, m in zip(starts.tolist(), sizes.tolist())]
