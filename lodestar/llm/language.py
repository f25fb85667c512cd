"""Language identification with error-correcting output codes.

Every language has a codeword; each bit has its own logistic classifier over
hashed byte n-grams of the whole text. A text gets the language whose codeword
has the least loss, every bit's loss being weighted by how well the bit was
learned, and is flagged as ambiguous where two codewords are about as near.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import remainder
from .store import Staged, table

DIM = 4096
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)


def ngrams(texts) -> np.ndarray:
    """Unit rows of the square roots of hashed 1-, 2- and 3-gram counts; anything but letters counts as one kind of space.

    A text of over tk.CHUNK bytes is counted part by part; its parts meet at white space.
    """
    out = np.zeros((len(texts), DIM), np.float32)
    for owner, data, offsets in tk.parts(texts, 128):
        n = len(owner)
        counts = np.zeros(n * DIM, np.float32)
        x = _FOLD[data]
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        code = np.zeros(len(x), np.uint32)
        for size in (1, 2, 3):
            m = len(x) - size + 1
            if m <= 0:
                break
            code = (code[:m] if size > 1 else np.zeros(m, np.uint32)) * np.uint32(257) + x[size - 1 :]
            inside = doc[size - 1 :] == doc[:m]
            blank = (x[:m] == 32) & (x[size - 1 :] == 32)
            ok = inside & ~blank
            h = ((code[ok] + np.uint32(size * 0x9E37)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
            counts += np.bincount(doc[:m][ok] * DIM + h, minlength=n * DIM)
        np.add.at(out, owner, counts.reshape(n, DIM))
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def lettered(texts) -> np.ndarray:
    """Whether each text has a letter of any script; only texts without an ASCII letter are decoded for it."""
    out = np.zeros(len(texts), bool)
    for owner, data, offsets in tk.parts(texts):
        sums = np.concatenate(([0], np.cumsum((_FOLD[data] < 128) & (_FOLD[data] != 32))))
        found = sums[offsets[1:]] > sums[offsets[:-1]]
        for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
            found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
        out[owner[found]] = True
    return out


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """n codewords of +-1 that lie far apart; of many random draws the one with the largest least distance."""
    bits = bits or max(15, 8 * int(np.ceil(np.log2(max(n, 2)))) - 1)
    rng, best = np.random.Generator(np.random.PCG64(11)), None
    for _ in range(200 if n <= 64 else 10):
        c = rng.choice([-1.0, 1.0], size=(n, bits))
        far = (c @ c.T - 2 * bits * np.eye(n)).max() if n > 1 else -bits
        flat = (np.abs(c.sum(axis=0)) == n).sum() if n > 1 else 0
        if best is None or (flat, far) < best[0]:
            best = ((flat, far), c)
    return best[1]


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float = 0.25

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the likelihood, and whether the second is near too."""
        f = x @ self.weight + self.bias
        loss = np.zeros((len(x), len(self.names)))
        for i, c in enumerate(self.code):
            loss[:, i] = (np.logaddexp(0, -c * f) * self.trust).sum(axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        near = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0) < self.margin
        return p.argmax(axis=1), top[:, -1], near


def fit(x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 150, penalty: float = 1e-5) -> LanguageModel:
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(names)).astype(float)
    row = (len(y) / (len(names) * np.maximum(share, 1)))[y].astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, t, rate = w.copy(), b.copy(), 1.0, 2.0
    for _ in range(steps):
        g = -target * row / (1 + np.exp(target * (x @ vw + vb))) / len(x)
        nw, nb = vw - rate * (x.T @ g + penalty * vw), vb - rate * g.sum(axis=0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + np.float32((t - 1) / nt) * (nw - w), nb + np.float32((t - 1) / nt) * (nb - b)
        w, b, t = nw, nb, nt
    right = ((x @ w + b) * target > 0).mean(axis=0)
    return LanguageModel(names, code, w, b, np.maximum(right - 0.5, 0.01) * 2)


def train(docs: DataFrame, per_language: int = 1000) -> LanguageModel | None:
    """Fits on at most `per_language` texts of each language (those with the smallest hash of doc_id), whose hashed n-grams come to the driver."""
    staged = Staged(docs.sparkSession, "language")
    given = docs.filter("lang is not null and text is not null and doc_id is not null").filter(remainder(4) != 2).select("doc_id", "lang", F.xxhash64("text").alias("_t"), "text")
    known = given.drop("text")
    counts = staged.put(known.groupBy("lang").agg(F.count("*").alias("_n")))
    # hashes are spread evenly: those under this share of their range leave about half as many rows again as are wanted, to be ranked
    under = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= (1.5 * per_language + 100) / F.col("_n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_t"))
    few = known.join(counts, "lang").filter(under).select("doc_id", "lang", "_t").distinct()
    picked = staged.put(few.withColumn("_r", rank).filter(F.col("_r") <= per_language).drop("_r"))
    chosen = staged.put(given.join(picked, ["doc_id", "lang", "_t"]).dropDuplicates(["doc_id", "lang", "_t"]).select("doc_id", "lang", "text"))

    def run(frames):
        for part in tk.batches(frames):
            yield pd.DataFrame({"lang": part["lang"], "x": [r.astype(np.float16).tobytes() for r in ngrams(part["text"])]})

    rows = chosen.mapInPandas(run, "lang string, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "x"])
    names = sorted(rows["lang"].unique())
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), DIM).astype(np.float32)
    return fit(x, np.searchsorted(names, rows["lang"].to_numpy()), names)


def identify_language(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """Every column of docs but those named here, and held_out, lang_pred, score, ambiguous.

    Texts that are null or have no letter get 'und', score 0 and ambiguous
    true, and so do all texts where nothing can be learned. Needs lang, which
    is used for training alone; rows without an id, a text or a lang are not
    learned from. Of two languages with equal loss the first by name is taken,
    and the row is flagged as ambiguous. Equal texts have equal predictions,
    repeated rows a row each; a text of any length counts whole. An empty table
    gives no rows.
    """
    model = train(docs, per_language)
    own = docs.drop("held_out", "lang_pred", "score", "ambiguous")

    def make(piece):
        texts = piece.column("text")
        found = np.array(["und"] * len(texts), dtype=object)
        score, near = np.zeros(len(texts)), np.ones(len(texts), bool)
        at = np.flatnonzero(lettered(texts)) if model is not None else []
        if len(at):
            best, score[at], near[at] = model.predict(ngrams(texts.take(pa.array(at))))
            found[at] = np.array(model.names, dtype=object)[best]
        return {"lang_pred": found, "score": score, "ambiguous": near}

    added = {"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_()}
    # a row has DIM counts: so many rows at a time
    return tk.append(own, added, make, rows=256).withColumn("held_out", remainder(4) == 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the whole of documents, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
