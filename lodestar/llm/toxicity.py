"""Toxicity of texts whose disguised words are first restored by a noisy-channel decoder.

Suspicious tokens (digits and signs among or after letters, letters doubled or
drawn out, words spelled with spaces or dots) are decoded with the Viterbi
algorithm: every character may stand for itself, for the letters it is used
for, or for nothing, a separator also for the end of a word, and a character
trigram model learned from the training texts picks the likeliest reading.
Tokens may have any length. Words and word beginnings that the labels tie to
toxicity then score the restored text, each as one independent cause; other
tokens are read as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import remainder, sample
from .store import Staged, table

U64 = np.uint64
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
SEPARATORS = " .-_*~'/\\,"
#: Costs in nats: a substitution, a drop of a sign, of a separator, of a repeated letter, a word's end at a separator.
SUBSTITUTE, DROP, SEPARATE, REPEAT, BREAK = 1.0, 4.0, 0.2, 0.4, 1.0
#: After so many characters, what all paths have read alike is put away; longer tokens are not cached.
PIECE, CACHED = 1024, 64
PREFIXES = (4, 5, 6, 7)

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in ".-_*~"]] = True


@lru_cache(1 << 16)
def _options(c: str, again: bool, inner: bool) -> list[tuple[str, float]]:
    """What a character may stand for, and the cost of each; `inner`: neither the first, nor after the last letter."""
    options: list[tuple[str, float]] = []
    if c.isalpha():
        options.append((c, 0.0))
    elif c in SEPARATORS:
        options.append(("", SEPARATE))
        options += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
    else:
        options += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        options.append(("", DROP if inner else 1.5))
    if again and c not in SEPARATORS:
        options.append(("", REPEAT))
    return options


@dataclass
class CharModel:
    """Trigram counts over words with two leading '^' and a final '$', with additive smoothing."""

    counts: dict[str, int]
    context: dict[str, int] = field(default_factory=dict)
    alphabet: int = 64
    cache: dict[str, str | None] = field(default_factory=dict)
    moves: dict[str, tuple[float, str]] = field(default_factory=dict)

    def __post_init__(self):
        for k, n in self.counts.items():
            self.context[k[:2]] = self.context.get(k[:2], 0) + n
        self.alphabet = max(2, len({k[2] for k in self.counts}))

    def cost(self, two: str, c: str) -> float:
        return log((self.context.get(two, 0) + 0.5 * self.alphabet) / (self.counts.get(two + c, 0) + 0.5))

    def move(self, three: str) -> tuple[float, str]:
        """What the last letter costs after the two before it, and the state it leads to."""
        out = self.cost(three[:2], three[2:]), three[-2:]
        if len(self.moves) < 200_000:
            self.moves[three] = out
        return out

    def decode(self, token: str) -> str:
        """The likeliest word or words behind a token; states are the last two letters read."""
        token = token.lower()
        tail = next((i for i in range(len(token) - 1, -1, -1) if token[i].isalpha()), -1)
        done: list[str] = []
        # a path is its cost and its last letter as [letter before, letter], shared with other paths
        paths: dict[str, tuple[float, list | None]] = {"^^": (0.0, None)}
        known = self.moves
        last = ""
        for i, c in enumerate(token):
            separator = c in SEPARATORS
            options = _options(c, last == c, 0 < i < tail)
            last = c
            step: dict[str, tuple[float, list | None]] = {}
            for two, (cost, read) in paths.items():
                for x, extra in options:
                    if x:
                        spent, key = known.get(two + x) or self.move(two + x)
                        now = cost + extra + spent
                        other = step.get(key)
                        if other is None or now < other[0]:
                            step[key] = (now, [read, x])
                    else:
                        now = cost + extra
                        other = step.get(two)
                        if other is None or now < other[0]:
                            step[two] = (now, read)
                if separator and two != "^^":
                    now = cost + BREAK + (known.get(two + "$") or self.move(two + "$"))[0]
                    if "^^" not in step or now < step["^^"][0]:
                        step["^^"] = (now, [read, " "])
            paths = step
            if i % PIECE == PIECE - 1:
                done += _settled([read for _, read in paths.values()])
        ends = [(cost + (known.get(two + "$") or self.move(two + "$"))[0], read) for two, (cost, read) in paths.items()]
        least = min((cost for cost, _ in ends), default=0.0)
        read = min((_unwound(read) for cost, read in ends if cost == least), default=[])
        return "".join(done + read).strip()

    def reading(self, token: str) -> str | None:
        """What a token was read as, or None where that is only its own words."""
        if token in self.cache:
            return self.cache[token]
        trimmed, out = _trim(token), None
        if len(trimmed) >= 3 and not trimmed.isdigit():
            word = self.decode(trimmed)
            if len(word) >= 3 and word.split() != "".join(c if c.isalpha() else " " for c in trimmed.lower()).split():
                out = word
        if len(token) <= CACHED and len(self.cache) < 200_000:
            self.cache[token] = out
        return out


def _unwound(read: list | None) -> list[str]:
    out = []
    while read is not None:
        read, x = read
        out.append(x)
    return out[::-1]


def _settled(ends: list) -> list[str]:
    """The letters that all paths share, which are taken off them."""
    if any(e is None for e in ends):
        return []
    first, node = [], ends[0]
    while node is not None:
        first.append(node)
        node = node[0]
    at = {id(n): k for k, n in enumerate(first)}
    deepest = 0
    for node in ends[1:]:
        while node is not None and id(node) not in at:
            node = node[0]
        if node is None:
            return []
        deepest = max(deepest, at[id(node)])
    out = _unwound(first[deepest])
    first[deepest][:] = [None, ""]
    return out


def suspicious(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of the tokens and spelled-out words to decode; data is lower-cased."""
    n = len(data)
    if n < 3:
        return []
    starts, ends, bounds = tk.words(data, offsets, tk.NON_SPACE)
    letter, leet = LETTER[data], _LEET[data]
    flag = np.zeros(n, bool)
    flag[:-1] |= leet[:-1] & letter[1:]
    flag[1:] |= letter[:-1] & leet[1:]
    flag[:-1] |= (data[:-1] == data[1:]) & letter[:-1] & (data[:-1] < 128)
    if n >= 5:
        sep = _SEP[data]
        flag[:-4] |= letter[:-4] & sep[1:-3] & letter[2:-2] & sep[3:-1] & letter[4:]
    total = np.concatenate(([0], np.cumsum(flag)))
    hit = total[ends] > total[starts]
    one = (ends - starts <= 2) & (letter[starts] | leet[starts]) & ~(letter[starts] & (ends - starts == 2) & letter[np.minimum(starts + 1, n - 1)] & (data[starts] < 128))
    out = []
    owner = np.searchsorted(bounds, np.arange(len(starts)), side="right") - 1
    run = np.flatnonzero(np.diff(np.concatenate(([False], one, [False])).astype(np.int8)))
    for a, b in zip(run[::2].tolist(), run[1::2].tolist()):
        while a < b:  # a run may go on into the next text
            stop = min(b, int(bounds[owner[a] + 1]))
            if stop - a >= 4:
                out.append((int(owner[a]), int(starts[a]), int(ends[stop - 1])))
            a = stop
    out += [(int(owner[i]), int(starts[i]), int(ends[i])) for i in np.flatnonzero(hit).tolist()]
    return out


def _trim(token: str) -> str:
    """Without signs at the end that stand for no letter, and with one leading sign at most."""
    while token and not (token[-1].isalpha() or token[-1].isdigit() or token[-1] in LEET):
        token = token[:-1]
    while len(token) > 1 and not token[0].isalpha() and not (token[0] in LEET and (token[1].isalpha() or token[1] in LEET)):
        token = token[1:]
    return token


def restored(model: CharModel, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str]]:
    """(text, words) for every decoded token that is more than the token's own words."""
    out = []
    for doc, a, b in suspicious(data, offsets):
        word = model.reading(data[a:b].tobytes().decode("utf-8", "ignore"))
        if word is not None:
            out.append((doc, word))
    return out


def restore(text: str, model: CharModel) -> str:
    """The text with its suspicious tokens replaced by what they were read as."""
    data, offsets = tk.lay_out([text])
    low = tk.LOWER[data]
    raw = data.tobytes()
    for _, a, b in sorted(suspicious(low, offsets), key=lambda s: -s[1]):
        word = model.reading(low[a:b].tobytes().decode("utf-8", "ignore"))
        if word is not None:
            raw = raw[:a] + word.encode() + raw[b:]
    return raw.decode("utf-8", "replace")


#: Bytes on either side of a word that tell one place of it from another.
AROUND = 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x kinds) hashes of whole words and of their beginnings in bytes (0: shorter), the hashes of what stands around the words, and the word offsets."""
    starts, ends, bounds = tk.words(data, offsets, LETTER)
    h, down = tk.prefix_hash(data)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = tk.slice_hash(h, down, starts, ends)
    size = ends - starts
    for j, k in enumerate(PREFIXES, 1):
        long = size > k
        s = starts[long]
        out[long, j] = tk.slice_hash(h, down, s, s + k) ^ U64(k)
    out[size < 3, 0] = 0
    around = tk.slice_hash(h, down, np.maximum(starts - AROUND, 0), starts) ^ (tk.slice_hash(h, down, ends, np.minimum(ends + AROUND, len(data))) >> U64(1))
    return out, around, bounds


def _all_features(data: np.ndarray, offsets: np.ndarray, model: CharModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part of each word, features, surroundings) of plain and restored words; a restored word's surroundings are its whole part. data is lower-cased."""
    plain, around, bounds = features(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    more = restored(model, data, offsets)
    if more:
        extra, _, spots = features(*((lambda d, o: (tk.LOWER[d], o))(*tk.lay_out([w for _, w in more]))))
        doc = np.repeat(np.array([d for d, _ in more]), np.diff(spots))
        h, down = tk.prefix_hash(data)
        owner = np.concatenate((owner, doc))
        plain = np.concatenate((plain, extra))
        around = np.concatenate((around, tk.slice_hash(h, down, offsets[doc], offsets[doc + 1])))
    return owner, plain, around


def _by_parts(texts, model: CharModel):
    """_all_features of groups of parts of the texts, with the text of each word; a long text is never held as words at once."""
    for text, data, offsets in tk.parts(texts):
        owner, feats, around = _all_features(tk.LOWER[data], offsets, model)
        yield text[owner], feats, around


@dataclass
class ToxicModel:
    """Features by hash, each with -ln(1 - p) for p, the share of toxic documents it adds to those of documents without any."""

    chars: CharModel
    keys: np.ndarray
    weight: np.ndarray
    base: float

    def __post_init__(self):
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.keys >> U64(48)).astype(np.int64)] = True

    def spoken(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of its strongest key) of every different word that has one."""
        owners, words, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for owner, feats, _ in _by_parts(texts, self.chars):
            best = np.full(len(feats), -1)
            for word, key in self.met(feats):
                better = (best[word] < 0) | (self.weight[key] > self.weight[best[word]])
                best[word[better]] = key[better]
            word = np.flatnonzero(best >= 0)
            owners.append(owner[word])
            words.append(feats[word, 0])
            keys.append(best[word])
        owner, word, key = np.concatenate(owners), np.concatenate(words), np.concatenate(keys)
        _, first = np.unique(np.stack((owner.astype(np.uint64), word)), axis=1, return_index=True)
        return owner[first], key[first]

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and how many different words spoke.

        A word speaks through the strongest of its features, a repeated one
        once, and each different word may be the one that makes the text
        toxic: 1 - (1 - base) * product of (1 - p).
        """
        doc, key = self.spoken(texts)
        n = len(texts)
        return 1 - (1 - self.base) * np.exp(-np.bincount(doc, weights=self.weight[key], minlength=n)), np.bincount(doc, minlength=n)

    def met(self, feats: np.ndarray):
        """(words, keys) for each kind of feature: which words have a feature that is a key."""
        for j in range(feats.shape[1] if len(self.keys) else 0):
            maybe = np.flatnonzero(self.quick[(feats[:, j] >> U64(48)).astype(np.int64)])
            v = feats[maybe, j]
            at = np.minimum(np.searchsorted(self.keys, v), len(self.keys) - 1)
            hit = self.keys[at] == v
            yield maybe[hit], at[hit]

    def places(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of the key, surroundings) of all places of the keys."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for owner, feats, around in _by_parts(texts, self.chars):
            out += [(owner[word], key, around[word]) for word, key in self.met(feats)]
        return tuple(np.concatenate(x) for x in zip(*out))


def _distinct(f: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((o, f))
    f, o = f[by], o[by]
    keep = np.ones(len(f), bool)
    keep[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
    return f[keep], o[keep]


def _gain(p: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log likelihood ratio of the share p / n against the rate of all texts."""
    share = p / np.maximum(n, 1)
    return p * np.log(np.maximum(share, 1e-12) / rate) + (n - p) * np.log(np.maximum(1 - share, 1e-12) / (1 - rate))


def train(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> ToxicModel:
    """Fits on all labelled rows outside the held-out third, or on at most `limit` if that is given.

    Character trigrams and the documents with and without a label that hold a
    feature are counted in Spark; the driver gets the trigrams, which grow with
    the different letters and not with the rows, and the features that pass. A feature is kept where chance
    would hardly give its share of toxic documents, over all features tried,
    even if texts count once where it stands in the same surroundings.
    """
    staged = Staged(docs.sparkSession, "toxic")
    rows = staged.put(sample(docs, labels, "toxic", 3, 1, limit, staged))

    def grams(frames):
        for part in tk.batches(frames):
            counts: dict[str, int] = {}
            for word, n in pd.Series(" ".join(t for t in part["text"] if t is not None).lower().split()).value_counts().items():
                if word.isalpha():
                    w = f"^^{word}$"
                    for i in range(len(w) - 2):
                        counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + n
            yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())}).astype({"gram": str, "n": np.int64})

    chars = CharModel(dict(sorted(rows.mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect())))

    def counted(frames):
        for part in tk.batches(frames):
            label, found = part["label"].to_numpy(), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for owner, feats, _ in _by_parts(part["text"], chars):
                for j in range(feats.shape[1]):
                    some = feats[:, j] > 0
                    found.append(_distinct(feats[some, j], owner[some]))
            # once for each text, in however many parts and kinds a feature stands
            f, o = _distinct(*(np.concatenate(x) for x in zip(*found)))
            y = label[o]
            key, inverse = np.unique(f, return_inverse=True)
            n = np.bincount(inverse, minlength=len(key))
            p = np.bincount(inverse, weights=y.astype(float), minlength=len(key))
            yield pd.DataFrame({"f": key.view(np.int64), "p": p.astype(np.int64), "n": n.astype(np.int64)})

    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    rate = (sizes.p + 0.5) / (sizes.n + 1)
    none = ToxicModel(chars, np.zeros(0, np.uint64), np.zeros(0), rate)
    if not sizes.n or sizes.p in (0, sizes.n):
        return none
    per = staged.put(rows.mapInPandas(counted, "f long, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    tried = per.count()
    share = F.col("p") / F.col("n")
    gain = F.col("p") * F.log(share / rate) + F.when(F.col("p") < F.col("n"), (F.col("n") - F.col("p")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    good = per.filter(share >= max(0.5, min(0.9, 2 * rate))).withColumn("gain", gain).filter(F.col("gain") > log(max(tried, 1) / 0.05))
    found = sorted((r.f & 0xFFFFFFFFFFFFFFFF, r.p, r.n) for r in good.select("f", "p", "n").collect())
    if not found:
        return none
    tries = ToxicModel(chars, np.array([f for f, _, _ in found], np.uint64), np.zeros(len(found)), rate)

    def present(frames):
        for part in tk.batches(frames):
            doc, k, around = tries.places(part["text"])
            yield pd.DataFrame({"k": k, "around": around.view(np.int64), "label": part["label"].to_numpy()[doc]}).drop_duplicates()

    # copies of a text, exact or not, would vouch for each other's words: so many different places speak, not so many texts
    met = rows.mapInPandas(present, "k int, around long, label int").groupBy("k", "label").agg(F.count_distinct("around").alias("n")).collect()
    places = np.zeros((len(found), 2))
    for r in met:
        places[r.k, r.label] = r.n
    n, p = np.array([x[2] for x in found], float), np.array([x[1] for x in found], float)
    p = np.minimum(p, places[:, 1])
    n = p + np.minimum(n - np.array([x[1] for x in found]), places[:, 0])
    keep = (_gain(p, n, rate) > log(max(tried, 1) / 0.05)) & (p > n / 2)
    likely = ((p + 2 * rate) / (n + 2))[keep]
    model = ToxicModel(chars, tries.keys[keep], likely, rate)

    def alone(frames):
        for part in tk.batches(frames):
            doc, k = model.spoken(part["text"])
            pairs = np.unique(np.stack((doc, k)), axis=1)
            count = np.bincount(pairs[0], minlength=len(part))
            single = np.full(len(part), -1)
            single[pairs[0]] = pairs[1]
            yield pd.DataFrame({"k": single, "label": part["label"]})[count <= 1]

    # what a feature is worth shows where it stands alone; few such texts leave it what it is worth among others
    met = {(r.k, r.label): r.n for r in rows.mapInPandas(alone, "k int, label int").groupBy("k", "label").agg(F.count("*").alias("n")).collect()}
    each = np.array([[met.get((k, y), 0) for y in (0, 1)] for k in range(-1, len(model.keys))], float)
    likely = (each[1:, 1] + 3 * likely) / (each[1:].sum(axis=1) + 3)
    model.base = (each[0, 1] + 0.5) / (each[0].sum() + 1)
    model.weight = -np.log1p(-np.clip((likely - model.base) / (1 - model.base), 1e-6, 0.999))
    model.chars.cache.clear()
    model.chars.moves.clear()
    return model


def classify_toxicity(docs: DataFrame, labels: DataFrame, limit: int | None = None, threshold: float = 0.7) -> DataFrame:
    """Every column of docs but those named here, and held_out, score, predicted, n_signals (different words that speak for label 1).

    Null and empty texts have no words and get the score of texts without a
    signal. Texts of any length are read whole, part by part above tk.CHUNK
    bytes. Equal texts have equal scores, repeated rows a row each; an id with
    two different labels is no training row. All other labelled rows outside the
    held-out third are learned from; only under a `limit` are those with the
    smallest hash of the id taken. Without
    usable labels the score is the smoothed share of label 1. An empty table
    gives no rows.
    """
    model = train(docs, labels, limit)

    def make(piece):
        score, spoke = model.score(piece.column("text"))
        return {"score": score, "n_signals": spoke}

    out = tk.append(docs.drop("held_out", "predicted"), {"score": pa.float64(), "n_signals": pa.int64()}, make)
    return out.withColumn("held_out", remainder(3) == 1).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the whole of documents, labels.toxic outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_signals")


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
