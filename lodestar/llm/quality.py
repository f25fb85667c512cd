"""Quality by a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on the statistics of a bounded sample of
labelled rows, every path from a root becomes a conjunctive rule, a lasso
logistic regression keeps the few rules that matter, and those are compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import remainder, sample
from .store import Staged, table

STATS = (
    "chars", "words", "word_len", "long_words", "short_words", "upper", "digits", "punct", "symbols", "marks", "spaces",
    "non_ascii", "lines", "line_len", "repeat_lines", "repeat_words", "top_word", "stops", "ends", "entropy", "capital_words", "symbol_words",
)

def _named(statistic: str) -> str:
    """The statistic's column name, which no column of a caller's table is taken to have."""
    return f"_statistic_{statistic}"


_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 7
_CLASS[128:] = 8


_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
_ENDS = np.frombuffer(b".!?,;:", np.uint8)


def _counts(data: np.ndarray, offsets: np.ndarray):
    """Of each part: its bytes by value, seven sums over its words, and the hashes of its words and lines with their bounds."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    starts, ends, bounds = tk.words(data, offsets, tk.NON_SPACE)
    length = ends - starts
    lower = tk.LOWER[data]
    h, down = tk.prefix_hash(lower)
    caps = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    odd = np.concatenate(([0], np.cumsum(np.isin(_CLASS[data], (5, 6)))))
    last = lower[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    each = (np.ones(len(starts)), length, length > 12, length < 4, np.isin(last, _ENDS), (caps[ends] - caps[starts]) * 2 > length, odd[ends] > odd[starts])
    sums = np.zeros((n, len(each)))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for k, x in enumerate(each):
        sums[:, k] = np.bincount(owner, weights=x.astype(float), minlength=n)
    ls, le, lb = tk.words(data, offsets, _LINE)
    return hist, sums, tk.slice_hash(h, down, starts, ends), bounds, tk.slice_hash(h, down, ls, le), lb


def statistics(texts) -> np.ndarray:
    """One row of STATS for each text, from its whole bytes.

    A text of over tk.CHUNK bytes is counted part by part and its sums are
    added up, so no more than its word and line hashes is held at once; a word
    or line over a part's end counts as two.
    """
    n = len(texts)
    hist, sums, shares = np.zeros((n, 256)), np.zeros((n, 7)), np.zeros((n, 3))
    held: dict[int, tuple[list, list]] = {}

    def shares_of(words: np.ndarray, lines: np.ndarray) -> tuple[float, float, float]:
        _, c = np.unique(words, return_counts=True)
        return (1 - len(np.unique(lines)) / len(lines) if len(lines) else 0.0, 1 - len(c) / len(words) if len(words) else 0.0, c.max() / len(words) if len(words) else 0.0)

    for owner, data, offsets in tk.parts(texts):
        h, s, wh, wb, lh, lb = _counts(data, offsets)
        np.add.at(hist, owner, h)
        np.add.at(sums, owner, s)
        whole = data.nbytes <= tk.CHUNK and len(owner) > 1
        for k, i in enumerate(owner.tolist()):
            mine = wh[wb[k] : wb[k + 1]], lh[lb[k] : lb[k + 1]]
            if whole and i not in held and not (k + 1 == len(owner) or k == 0):
                shares[i] = shares_of(*mine)
            else:  # may go on in the next part
                words, lines = held.setdefault(i, ([], []))
                words.append(mine[0])
                lines.append(mine[1])
        for i in [i for i in held if i < owner[-1]]:
            shares[i] = shares_of(*(np.concatenate(x) for x in held.pop(i)))
    for i, x in held.items():
        shares[i] = shares_of(*(np.concatenate(y) for y in x))
    size = hist.sum(axis=1)
    kinds = np.stack([hist[:, _CLASS == k].sum(axis=1) for k in range(9)], axis=1)
    some, words, lines = np.maximum(size, 1), np.maximum(sums[:, 0], 1), hist[:, 10] + 1
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
    out = np.zeros((n, len(STATS)))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(sums[:, 0])
    out[:, 2], out[:, 3], out[:, 4] = (sums[:, k] / words for k in (1, 2, 3))
    out[:, 5], out[:, 6] = kinds[:, 2] / letters, kinds[:, 3] / some
    out[:, 7], out[:, 8], out[:, 9], out[:, 10], out[:, 11] = (kinds[:, k] / some for k in (4, 5, 6, 7, 8))
    out[:, 12], out[:, 13] = np.log1p(lines), np.log1p(size / lines)
    out[:, 14:17] = shares
    out[:, 17] = (hist[:, 46] + hist[:, 33] + hist[:, 63]) / words
    share = hist / some[:, None]
    out[:, 19] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    out[:, 18], out[:, 20], out[:, 21] = (sums[:, k] / words for k in (4, 5, 6))
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, sign, threshold): sign 1 means value > threshold, -1 value <= threshold."""

    terms: tuple[tuple[int, int, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, s, t in self.terms:
            hit &= (x[:, f] > t) if s > 0 else (x[:, f] <= t)
        return hit

    def column(self) -> Column:
        out = None
        for f, s, t in self.terms:
            value = F.col(_named(STATS[f]))
            c = value > F.lit(float(t)) if s > 0 else value <= F.lit(float(t))
            out = c if out is None else out & c
        return out


def _tree(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, terms: tuple, found: set, value: np.ndarray, leaf_rows: int) -> None:
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * leaf_rows:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < leaf_rows) | (len(rows) - ns < leaf_rows)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        value[rows] = -g / (h + 1)
        return
    f, k = best[1]
    low = bins[rows, f] <= k
    for part, sign in ((rows[low], -1), (rows[~low], 1)):
        more = (*terms, (f, sign, float(edges[f][k])))
        found.add(Rule(tuple(sorted(more))))
        _tree(bins, edges, grad, hess, part, depth - 1, more, found, value, leaf_rows)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int) -> list[Rule]:
    """Rules of the paths of gradient-boosted trees for the logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        value = np.zeros(len(y))
        _tree(bins, edges, p - y, p * (1 - p) + 1e-9, np.arange(len(y)), depth, (), found, value, max(5, len(y) // 200))
        score += 0.3 * value
    return sorted(found, key=lambda r: r.terms)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the intercept is free."""
    n, m = a.shape
    mean, scale = a.mean(axis=0), a.std(axis=0) + 1e-3
    z = (a - mean) / scale
    w, b = np.zeros(m), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    v = np.random.Generator(np.random.PCG64(1)).normal(size=m)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ vw + vb)))
        gw = vw - rate * (z.T @ (p - y) / n)
        nw = np.sign(gw) * np.maximum(np.abs(gw) - rate * penalty, 0)
        nb = vb - rate * (p - y).mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / scale, float(b - (w / scale * mean).sum())


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The fitted probability as one native expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002) -> RuleModel:
    if len(y) < 10 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel((), float(np.log(p / (1 - p))))
    rules = grow_rules(x, y, trees, depth)
    if not rules:
        return RuleModel((), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    on, keep = np.stack([r.on(x) for r in rules], axis=1).astype(float), []
    _, first = np.unique(on, axis=1, return_index=True)
    rules, on = [rules[i] for i in sorted(first)], on[:, sorted(first)]
    w, b = lasso(on, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(tuple((rules[i], float(w[i])) for i in keep), b)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Every column of docs, and the statistics of the whole text under the names in `_named`."""
    return tk.append(docs, dict.fromkeys(map(_named, STATS), pa.float64()), lambda piece: dict(zip(map(_named, STATS), statistics(piece.column("text")).T)))


def train(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> RuleModel:
    """Fits on at most `limit` labelled rows, whose statistics (not texts) come to the driver."""
    rows = with_statistics(sample(docs, labels, "quality", 3, 1, limit, Staged(docs.sparkSession, "quality"))).drop("text", "doc_id").toPandas()
    names = [_named(s) for s in STATS]
    rows = rows.sort_values([*names, "label"])
    return fit_rules(rows[names].to_numpy(), rows["label"].to_numpy(dtype=float))


def classify_quality(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> DataFrame:
    """Every column of docs but those named held_out, score and predicted, and these.

    score is the probability of label 1, predicted 1 from a score of 0.5 on.
    The model sees the text alone; null and empty texts are scored as texts
    without words, texts of any length by all their bytes (part by part above
    tk.CHUNK). Equal texts have equal scores, repeated rows a row each. An id
    with two different labels is no training row, and where more than `limit`
    rows are labelled those with the smallest hash of the id are taken. Without
    usable labels, or with only one value, the score is the smoothed share of
    1. An empty table gives no rows.
    """
    model = train(docs, labels, limit)
    own = docs.drop("held_out", "score", "predicted")
    rows = with_statistics(own).withColumn("score", model.score())
    return rows.select(*own.columns, (remainder(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the whole of documents, labels.quality outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
SQL: dict[str, str] = {}
