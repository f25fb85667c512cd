"""Work by parts, large groups, ids of other types, and repeated ids give what whole texts, small groups and plain ids give."""

import bisect
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import language, leaks, merkle, neardup, ngram_lm, quality, repeats, toxicity, urlrules
from lodestar.llm import textkit as tk
from tests.llm import brute

RNG = random.Random(5)
TEXTS = [None, "", "ab cd\n ef", "x" * 50, "", "".join(RNG.choice("ab cd\n é漢 ") for _ in range(3000)), "word " * 40, ""]


def test_parts_make_up_the_texts(monkeypatch):
    monkeypatch.setattr(tk, "CHUNK", 64)
    found = {}
    for owner, data, offsets in tk.parts(pa.array(TEXTS)):
        assert len(data) == offsets[-1] <= 64 or len(owner) == 1
        for k, i in enumerate(owner.tolist()):
            found[i] = found.get(i, b"") + data[offsets[k] : offsets[k + 1]].tobytes()
    assert [found[i].decode() for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_long_texts_by_parts(monkeypatch):
    """A chunk of a few bytes cuts every text; shingles, words and statistics stay the same."""
    texts = pa.array(TEXTS)
    kernels = lambda: (tk.shingle_sets(texts, 3), tk.word_hashes(texts, tk.ALNUM), quality.statistics(texts), language.lettered(texts), language.ngrams(texts))
    whole = kernels()
    monkeypatch.setattr(tk, "CHUNK", 64)
    parts = kernels()
    assert all(np.array_equal(a, b) for a, b in zip(whole[0], parts[0]))
    assert all(np.array_equal(a, b) for a, b in zip(whole[1], parts[1]))
    lines = quality.STATS.index("repeat_lines")
    assert np.allclose(np.delete(whole[2], lines, 1), np.delete(parts[2], lines, 1))
    assert np.array_equal(whole[3], parts[3]) and np.abs(whole[4] - parts[4]).max() < 0.02


def test_a_very_long_text_takes_bounded_memory():
    """A text of 32 MB in every kernel: what is held beside it is a few bytes a byte, or about 40 of a chunk."""
    import tracemalloc

    text = pa.array([" ".join(f"w{i * 7919 % 100003}" for i in range(4_600_000))])
    size = text.nbytes
    for kernel in (quality.statistics, language.ngrams, lambda t: tk.word_hashes(t, tk.NON_SPACE)):
        tracemalloc.start()
        kernel(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5 * size + 60 * tk.CHUNK, peak / size


def test_ngrams_across_windows_of_tokens(monkeypatch):
    """Whatever number of tokens is exploded at once, each place has the same n-grams."""
    part = pa.RecordBatch.from_pydict({"text": ["a b c d e f g", None, "", "h", "i j a b c"]})

    def all_of(tokens):
        monkeypatch.setattr(ngram_lm, "TOKENS", tokens)
        out = []
        for owner, place, skip, grams in ngram_lm._windows(part, 3):
            for i in range(len(owner)):
                out.append((owner[i], place[i], *(g[skip + i] for o, g in enumerate(grams, 1) if place[i] >= o - 1)))
        return out

    whole = all_of(1 << 17)
    assert [r[:2] for r in whole] == [(0, i) for i in range(7)] + [(3, 0)] + [(4, i) for i in range(5)]
    assert whole[2][4] == whole[12][4]  # a b c
    for tokens in (1, 2, 3, 5):
        assert all_of(tokens) == whole


def test_search_by_steps(monkeypatch):
    words = [f"w{i}" for i in range(300)]
    item = " ".join(words[20:80])
    texts = [" ".join(words[10:100]), " ".join(words), "w20 w21 w22 other", " ".join(words[100:]), ""]
    wide = leaks.search(leaks.Suffixes([("a", item), ("a", "w5 w6"), ("b", item)], 13), pa.array(texts))
    monkeypatch.setattr(leaks, "_STEP", 7)
    narrow = leaks.search(leaks.Suffixes([("a", item), ("a", "w5 w6"), ("b", item)], 13), pa.array(texts))
    for x, y in zip(wide, narrow):
        assert x[0] == y[0] and np.array_equal(x[1], y[1]) and x[2] == y[2] and sorted(x[3].tolist()) == sorted(y[3].tolist()) and x[4] == y[4]
    assert [r[4] for r in wide] == [60, 60, 3, 0, 0] and [int(r[1].sum()) for r in wide] == [60, 62, 0, 0, 0]


def test_items_with_several_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "a b"), ("x", "d e"), ("y", "zz")], "item_id string, text string")
    assert leaks.find_leaks(docs, bench, window=2).first()["items"] == ["x"]


@pytest.mark.parametrize("block", [4, 1024])
def test_large_groups_lose_no_link(spark, block):
    """Chains of texts that are near their neighbours only, groups of near copies, and texts apart, in blocks of four."""
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i % 7] + [f"u{i % 5}"])) for i in range(40)]
    rows += [(100 + i, " ".join(f"c{j}" for j in range(2 * i, 2 * i + 60))) for i in range(30)]
    rows += [(200 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(5)] + [(300, rows[0][1]), (301, rows[45][1])]
    RNG.shuffle(rows)
    want = brute.near_duplicates(rows, 3)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, bands=32, rows=2, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rows_are_judged_by_text(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, one, "p"), (5, one, "q"), (5, two, "r"), (9, two + " z", "t"), (9, two + " z", "s"), (None, one, "u"), (None, "only here it stands in full", "v"), (11, None, "w"), (11, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(3, one, "p"), (5, two, "r"), (None, "only here it stands in full", "v"), (11, None, "w"), (11, None, "w")], key=repr)
    twice = spark.createDataFrame([(9, one, "t"), (9, one, "s"), (9, one, "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in neardup.drop_near_duplicates(twice).collect()] == [(9, one, "s")]


def test_ids_of_other_types(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("doc_id", "text")
    named = docs.selectExpr("concat('d', lpad(doc_id, 9, '0')) AS doc_id", "text")
    plain = lambda df, *c: sorted(map(tuple, df.select("doc_id", *c).collect()))
    as_named = lambda rows: [(f"d{r[0]:09d}", *r[1:]) for r in rows]
    assert plain(repeats.remove_repeats(named), "n_removed", "n_spans") == as_named(plain(repeats.remove_repeats(docs), "n_removed", "n_spans"))
    assert plain(ngram_lm.score_documents(named), "n_tokens", "n_backoff") == as_named(plain(ngram_lm.score_documents(docs), "n_tokens", "n_backoff"))
    assert plain(neardup.near_duplicates(named), "n_shingles", "kept") == as_named(plain(neardup.near_duplicates(docs), "n_shingles", "kept"))
    assert plain(merkle.fingerprint_edits(named), "n_chars", "fingerprint") == as_named(plain(merkle.fingerprint_edits(docs), "n_chars", "fingerprint"))


def test_fingerprints_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in merkle.fingerprint_edits(docs).collect()}
    trees = {d: brute.tree(t) for d, t in rows}
    for (d, text), (after, follows) in zip(rows, rows[1:] + rows[:1]):
        half, o = len(text) // 2, got[d]
        edited = text[: len(text) - half] + follows[:half]
        root, branches = trees[d]
        assert o.fingerprint == "|".join([root, *(f"{b}({','.join(x[: merkle.SHOWN] for x in s)})" for b, s in branches)] if branches else [root, ""])
        assert o.edited_sha256 == brute.sha(edited.encode()) and o.edited_fingerprint.split("|")[0] == brute.tree(edited)[0]
        assert o.near_edited == pytest.approx(brute.likeness(trees[d], brute.tree(edited))) and o.near_next == pytest.approx(brute.likeness(trees[d], trees[after]))


def test_aliases_by_union_find(spark):
    """Chains, cycles and a hot canonical target, with rules on some of their members."""
    hosts = ["bad.net", "ok.com", "www.example.net", "example.com", "z.org"]
    paths = ["/en/", "/de/", "/fr/", "/"]
    pages, edges = [], []
    for i in range(300):
        url = f"http://{RNG.choice(hosts)}{RNG.choice(paths)}{i}"
        to = f"http://hub.com/{i % 3}" if i % 4 == 0 else f"http://chain.com/{i % 50}" if i % 4 == 1 else None
        pages.append((i, url, f'<link rel="canonical" href="{to}">' if to else None))
        edges += [(url, to)] if to else []
    for i in range(50):
        pages.append((1000 + i, f"http://chain.com/{i}", f'<link rel="canonical" href="http://chain.com/{(i + 10) % 50}">'))
        edges.append((f"http://chain.com/{i}", f"http://chain.com/{(i + 10) % 50}"))
    component, verdicts = brute.aliases(edges), {}
    for u, c in component.items():
        verdicts.setdefault(c, set()).add(brute.url(u, urlrules.RULES)[3])
    got = {r.page_id: r.verdict for r in urlrules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, url, _ in pages:
        own, others = brute.url(url, urlrules.RULES)[3], verdicts.get(component.get(url), set())
        assert got[i] == (own or ("allow" if "allow" in others else "block" if "block" in others else "allow"))


def test_spelled_words_of_any_length(spark):
    """A word that is spelled out many times over is read, however long its token is."""
    model = toxicity.CharModel({k: 50 for w in ("stupid", "people") for k in [f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)]})
    text = " ".join("stupid" * 30)
    assert "stupid" in toxicity.restore(text, model)


def test_paragraphs_take_little_more_than_one_look_at_every_sign(spark):
    """Cutting at the end signs takes not many times as long as finding them."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) + rng.choice(["", "", "", "", "", "", "", ".", "。", "!\n"]) for _ in range(2000)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8).cache()
    docs.count()

    def took(c):
        began = time.perf_counter()
        docs.select(c.alias("c")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    columns = F.regexp_replace("text", f"([{merkle.ENDS}]+)", "$1 "), merkle.paragraphs(F.col("text"))
    seen, cut = (min(took(c) for _ in range(5)) for c in columns)
    docs.unpersist()
    assert cut < 8 * seen + 0.2


def test_thousands_of_bounds(spark):
    """Every key meets the bound of bisection, and a plan for thousands of bounds is made at once."""
    rng = random.Random(3)
    bounds = sorted({(rng.randrange(-500, 500), rng.randrange(-(2**63), 2**63)) for _ in range(4000)})
    keys = rng.sample(bounds, 200) + [(rng.randrange(-600, 600), rng.randrange(-(2**63), 2**63)) for _ in range(200)]
    began = time.perf_counter()
    column = merkle._below(bounds, F.col("k"), F.col("t"))
    assert time.perf_counter() - began < 1
    got = spark.createDataFrame(keys, "k long, t long").select("k", "t", column.alias("n")).collect()
    assert [(r.k, r.t, r.n) for r in got] == [(*k, bisect.bisect_left(bounds, k)) for k in keys]


def test_stretches_at_the_widest(spark):
    """Stretches about WIDEST characters long, with and without signs after them, in characters of every length."""
    texts = [c * k + e + x for c in ("a", "é", "𝔘") for k in (159, 160, 161, 321) for e in ("", ".", "。.!", "." * 200) for x in ("", "b", "\n")]
    got = {r.text: r.p for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", merkle.paragraphs(F.col("text")).alias("p")).collect()}
    ends = merkle.ENDS.replace(r"\n", "\n")
    for t in texts:
        want = []
        for p in re.findall(rf"[^{ends}]{{0,160}}[{ends}]+|[^{ends}]+", t):
            want += [p[i : i + 160] for i in range(0, len(p), 160)] if len(p) > 160 and p[-1] not in ends else [p]
        assert got[t] == want
