"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.llm import labelled, language, leaks, merkle, mixing, neardup, ngram_lm, quality, repeats, toxicity, urlrules
from tests.llm import brute

BIG = 2**60 + 1
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
SAME = "alpha beta gamma delta " * 20
ROWS = [
    (1, None, "en", "a", dt.datetime(2024, 1, 1)), (2, "", None, None, None), (None, "no id here, but words enough to count as a text", "en", "a", None),
    (BIG, SAME, "de", "b", dt.datetime(2024, 1, 2)), (BIG, SAME, "de", "b", dt.datetime(2024, 1, 2)), (5, SAME, "de", "b", None), (6, " \n\t ", "fr", "c", None),
    (7, LONG, "en", "a", None), (8, "short", "en", "a", None), (9, "é ñ ü 漢字 … " * 30, "es", "a", None), (None, None, None, None, None), (-3, "...!!! 1234", "xx", "a", None),
]
#: Names that the operators use for their own columns.
CLASH = ("n_bytes", "kept", "spans", "n_hit", "items", "score", "predicted", "held_out", "lang_pred", "domain", "epoch", "n_tokens", "n", "key", "rep", "_id", "_th", "label", "chars", "component",
         "_a", "_b", "_i", "_t", "_m", "_d", "_l", "_s", "_lang", "_source", "_whole", "_last", "last", "whole", "_hits", "words", "lines", "_statistic_chars", "_statistic_words",
         "id", "th", "node", "unit", "near", "centre", "slice", "rest", "a", "b", "pos", "anchor", "fingerprint", "_k", "_g", "_own", "_c", "next_text", "ids", "batch", "gram", "limit", "budget")


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, seen timestamp")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, "x") for i in (1, 2, 5, 6, 7, 8, 9)] + [(None, 1, 1, "x"), (3, None, None, "x"), (8, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")


def key(r):
    return repr((r.doc_id is None, r.doc_id, r.text is None, r.text))


def matched(df):
    """Result rows in the order of ROWS, which they must have one for one."""
    got = df.collect()
    assert len(got) == len(ROWS)
    want = sorted(range(len(ROWS)), key=lambda i: repr((ROWS[i][0] is None, ROWS[i][0], ROWS[i][1] is None, ROWS[i][1])))
    out = [None] * len(ROWS)
    for i, r in zip(want, sorted(got, key=key)):
        assert (r.doc_id, r.text) == ROWS[i][:2]
        if "seen" in r:
            assert r.seen == ROWS[i][4] and r.source == ROWS[i][3]
        out[i] = r
    return out


def test_repeats(docs, none):
    rows = matched(repeats.remove_repeats(docs))
    for r, (size, gone, spans, kept) in zip(rows, brute.repeats([r[1] for r in ROWS])):
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (size, gone, spans, kept)
        assert sum(b - a for a, b in r.spans) == gone
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_settings(spark):
    """A long text in parts, an anchor with many runs, and the split of large anchors give the same."""
    noise = [f"{i:05d}" for i in range(400)]
    texts = [("ab" * 700) + noise[1] * 3, "x" * 900 + noise[2], "x" * 450 + noise[3] + "ab" * 300, "".join(noise), "".join(noise[50:300])] + [f"{n}{'common passage of some length ' * 3}{n}" for n in noise[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.repeats(texts, 50)
    for split in (4096, 1):
        got = {r.doc_id: r for r in repeats.remove_repeats(df, length=50, gram=12, split=split).collect()}
        assert [(got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) for i in range(len(texts))] == [w[1:] for w in want]


def test_parts():
    """Cut at any limit, every window starts in exactly one part."""
    import pyarrow as pa

    texts = pa.array(["a" * 30, None, "b" * 500, "", "c" * 77, "d" * 210, "e" * 5])
    for limit in (20, 64, 100, 1000):
        seen = set()
        for rows, data, offsets, begins in repeats._parts(texts, 10, limit):
            for r, a, b, s in zip(rows, offsets[:-1], offsets[1:], begins):
                for p in range(max(0, b - a - 9)):
                    assert (r, s + p) not in seen
                    seen.add((r, s + p))
        assert seen == {(i, p) for i, t in enumerate(texts.to_pylist()) for p in range(max(0, len(t or "") - 9))}


def test_leaks(spark, docs, none):
    items = [("i1", "Alpha BETA gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta"), ("i2", "short"), ("i3", None), (None, "short"), ("i4", "!!"), ("i5", " ".join(LONG.split()[100:140])), ("i2", "é ñ")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.leaks([r[1] for r in ROWS], items)
    for size in (16 << 20, 30):  # in one block, and block by block
        for r, (n, hit, found, bad) in zip(matched(leaks.find_leaks(docs, bench, block_bytes=size)), want):
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, found, bad)
    assert {(r.n_hit, r.contaminated) for r in leaks.find_leaks(docs, bench.limit(0)).collect()} == {(0, False)}
    assert leaks.find_leaks(none, bench).count() == 0


def test_leaks_full_length(spark):
    """Matches longer than a window are reported whole, with their places."""
    words = LONG.split()
    items = [("a", " ".join(words[:300])), ("b", " ".join(words[1000:1040])), ("c", "q r s")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(1, " ".join(["x", *words[50:250], "y", *words[1000:1040], *words[0:20]])), (2, "q r s q r s"), (3, " ".join(words[0:12])), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (16 << 20, 30):
        got = {r.doc_id: (sorted(map(tuple, r.spans)), r.longest) for r in leaks.find_leaks(df, bench, block_bytes=size).collect()}
        assert got == {1: ([("a", 0, 242, 20), ("a", 50, 1, 200), ("b", 0, 202, 40)], 200), 2: ([("c", 0, 0, 3), ("c", 0, 3, 3)], 3), 3: ([], 12), 4: ([], 0)}


def test_mixing(spark, docs, none):
    one = mixing.mix(docs, fraction=1.0, weights={}, max_epochs=1).collect()
    # every row fits once, those without a token too, but for leaves that have none at all
    some = [r for r in ROWS if any((r[2], r[3]) == (q[2], q[3]) and (q[1] or "").split() for q in ROWS)]
    assert sorted(map(key, one)) == sorted(repr((r[0] is None, r[0], r[1] is None, r[1])) for r in some)
    assert all(r.epoch == 0 and r.domain.startswith("domain") for r in one)
    assert mixing.mix(none).count() == 0
    more = mixing.mix(docs, fraction=2.5, max_epochs=3).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in more if r.doc_id == 7) <= 3


def test_budgets(spark):
    """Shortages go to siblings first and to the parent's siblings when a subtree is used up."""
    leaves = spark.createDataFrame([("x", "en", "s", 10), ("x", "de", "s", 100), ("y", "en", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, 200.0, {}, 1).collect()}
    assert got == {("x", "en"): 10.0, ("x", "de"): 90.0, ("y", "en"): 100.0}
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, 600.0, {("y",): 2.0}, 1).collect()}
    assert got == {("x", "en"): 10.0, ("x", "de"): 100.0, ("y", "en"): 490.0}


@pytest.mark.parametrize("least", [1, 2])
def test_scores(docs, none, least):
    got = sorted(ngram_lm.score_documents(docs, order=3, min_count=least).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(zip([r[0] for r in ROWS], brute.backoff([r[1] for r in ROWS], 3, least)), key=lambda r: (r[0] is None, r[0] or 0, r[1][0]))
    for r, (d, (n, steps, score)) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_backoff) == (d, n, steps)
        assert r.log_score is None if score is None else r.log_score == pytest.approx(score, rel=1e-9)
    assert ngram_lm.score_documents(none).count() == 0


@pytest.mark.parametrize("least", [1, 2])
def test_backing_off_is_only_prepared_where_it_can_happen(docs, monkeypatch, least):
    """Where every n-gram counts, no table of counts holds the n-gram that would be backed off to."""
    made, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema, *a, **k: made.append(schema) or real(self, run, schema, *a, **k))
    ngram_lm.score_documents(docs, order=3, min_count=least).collect()
    assert any("ctx" in str(s) for s in made) and any("suffix" in str(s) for s in made) == (least > 1)


def test_urls(spark):
    link = '<head><LINK rel="canonical" href="{}"></head>'
    pages = spark.createDataFrame(
        [
            (1, "http://bad.net/a", None, "x"), (2, "http://ok.org/b", link.format("http://bad.net/a"), "x"), (3, "https://x.org/fr/1", link.format("//c.com/z"), "x"), (4, "http://c.com/z#part", link.format("http://bad.net/q"), "x"),
            (5, None, link.format("http://bad.net/a"), "x"), (6, "no scheme", None, "x"), (7, "http://sub.EXAMPLE.net/en/q?x#y", None, "x"), (7, "http://sub.EXAMPLE.net/en/q?x#y", None, "x"), (None, "http://ok.org/b", None, "x"),
            (8, "http://r.com", '<meta http-equiv="refresh" content="0; url=http://ok.org/b">', "x"), (9, "http://alone.com/", "", "x"),
        ],
        "page_id long, url string, html string, host string",
    )
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages).collect()]
    assert sorted(out, key=repr) == sorted(
        [
            (1, "bad.net", "/a", "net/", "block"), (2, "ok.org", "/b", None, "block"), (3, "x.org", "/fr/1", "org/fr/", "allow"), (4, "c.com", "/z", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
            (7, "sub.example.net", "/en/q", "example.net/en/", "allow"), (7, "sub.example.net", "/en/q", "example.net/en/", "allow"), (None, "ok.org", "/b", None, "block"), (8, "r.com", "", None, "block"), (9, "alone.com", "/", None, "allow"),
        ],
        key=repr,
    )
    many = [*urlrules.RULES, *(("block", f"h{i}.example/") for i in range(300))]
    assert [tuple(r) for r in urlrules.judge_urls(pages, many).orderBy("page_id", "verdict").collect()] == [tuple(r) for r in urlrules.judge_urls(pages).orderBy("page_id", "verdict").collect()]
    assert urlrules.judge_urls(pages.limit(0)).count() == 0


def test_relative_links(spark):
    """Path-relative targets are resolved against the page's folder, queries against its path."""
    cases = [
        ("http://a.org/x/y?q=1", "page.html", "http://a.org/x/page.html"), ("http://a.org/x/y", "../z", "http://a.org/z"), ("http://a.org/x/y/", "./z/./w", "http://a.org/x/y/z/w"), ("http://a.org/x/y?q=1", "?p=1", "http://a.org/x/y?p=1"),
        ("http://a.org", "b", "http://a.org/b"), ("http://a.org/x/y", "../../../z", "http://a.org/z"), ("http://a.org/x/y/w", "..", "http://a.org/x/"), ("http://a.org/x?q=1", "#f", "http://a.org/x?q=1#f"), ("http://a.org/x", "mailto:a@b", None),
        ("http://a.org/x", "//B.com/c", "http://B.com/c"), ("http://a.org/x", "https://b.com/c?u=http://d", "http://b.com/c?u=http://d"), ("http://a.org/x/", "go?u=http://d/../e", "http://a.org/x/go?u=http://d/../e"), ("http://a.org/x", "/c", "http://a.org/c"), ("none", "c", None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "u string, t string")
    assert [r[0] for r in df.coalesce(1).select(urlrules.resolved(F.col("t"), F.col("u"))).collect()] == [c[2] for c in cases]
    link = '<link rel="canonical" href="{}">'
    pages = spark.createDataFrame([(1, "http://c.org/d/e", link.format("../bad")), (2, "http://c.org/bad", link.format("http://x.net/"))], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlrules.judge_urls(pages).collect()} == {1: "block", 2: "block"}


@pytest.mark.parametrize("op", [quality.classify_quality, toxicity.classify_toxicity])
def test_classifiers(docs, none, labels, op):
    rows = matched(op(docs, labels))
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out == (brute.remainder(r.doc_id, 3) == 1) for r in rows if r.doc_id is not None)
    assert op(none, labels).count() == 0
    assert {r.score for r in op(docs, labels.limit(0)).collect()} == {0.5}


def test_toxic_words_behind_disguises(spark):
    """Words that are learned plain are found behind signs, repetition and spacing."""
    plain = ["river", "stone", "cloud", "bread", "paper", "light", "green", "chair", "wheel", "grass"]
    text = lambda i, word: " ".join([plain[(i * 7 + j * j) % 10] for j in range(12)] + [word] * bool(word) + [plain[(i * 3 + j) % 10] for j in range(9)])
    docs = [(i, text(i, ("idiot", "moron", "stupid")[i % 3] if i % 4 == 0 else "")) for i in range(900)]
    new = [(5000 + i, text(i, w)) for i, w in enumerate(["1d10t", "m0r0n", "idiiiiot", "s t u p i d", "s.t.u.p.i.d", "st*upid", "IDIOT", "", "l1ght", "greeeen"])]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify_toxicity(spark.createDataFrame(docs + new, "doc_id long, text string"), labels).collect()}
    assert [got[d] for d, _ in new] == [1] * 7 + [0] * 3


def test_toxic_words_of_all_labelled_rows(spark):
    """A word that only stands in rows beyond the first 10,000 by the hash of the id, which once were all that was read."""
    ids = spark.range(16000).withColumnRenamed("id", "doc_id").filter(labelled.remainder(3) != 1)
    late = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[10_000:][::5]}
    assert len(late) > 50
    docs = [(i, f"note {i * 7919 % 10007} says {'grumbleword' if i in late else 'thanks'} to {i}") for i in range(16000)]
    labels = spark.createDataFrame([(i, int(i in late)) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    bad, good = model.score(["what a grumbleword here", "what a day here"])[0]
    assert bad >= 0.7 > good


def test_toxic_words_in_long_and_joined_disguises():
    """Spelled words are found beside single letters and at any length, and behind doubled letters and trailing signs."""
    counts: dict[str, int] = {}
    for word in ["stupid", "idiots", "moron", "river", "stone", "cloud", "letter", "will", "a", "hello", "class", "green"] * 50:
        w = f"^^{word}$"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 1
    model = toxicity.CharModel(counts)
    read = lambda text: toxicity.restore(text, model)
    assert read("a s t u p i d") == "a stupid"
    spelled = " ".join("riverstonecloud") + " " + " ".join("stupid")
    for times in (1, 3, 200):
        assert read(" ".join([spelled] * times)).split() == ["river", "stone", "cloud", "stupid"] * times
    assert read("-".join(["m0r0n"] * 40)).split() == ["moron"] * 40
    assert (read("stuupid"), read("moroon"), read("idiot$"), read("idiot$!")) == ("stupid", "moron", "idiots", "idiots")
    for own in ("letter", "will", "hello!", "class!!", "hello-class", "green)"):
        assert read(own) == own


def test_language(docs, none):
    rows = matched(language.identify_language(docs))
    for r, (_, text, *_) in zip(rows, ROWS):
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1
    assert language.identify_language(none).count() == 0


def test_fingerprints(docs, none):
    got = merkle.fingerprint_edits(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for i, (d, text) in enumerate(order):
        nxt, half = order[(i + 1) % len(order)][1], len(text) // 2
        want.append((d, len(text), brute.sha((text[: len(text) - half] + nxt[:half]).encode())))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert merkle.fingerprint_edits(none).count() == 0


def test_merkle_locates_edits(spark):
    text = "".join(f"Sentence number {i} stands here. " for i in range(200))
    edited = text.replace("number 120 stands", "number 120 stood")
    df = spark.createDataFrame([(text, edited)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = df.select(merkle.changed_sections(F.col("a"), F.col("b")).alias("at"), merkle.likeness(F.col("a"), F.col("b")).alias("near"), F.size(F.split("a", r"\|")).alias("n")).first()
    assert len(r["at"]) in (1, 2) and r.n > 10 and 0.95 < r.near < 1


def test_merkle_long_stretches(spark):
    """An edit at the front of a long stretch changes few leaves, and the paragraphs are the text."""
    plain = " ".join(f"w{i * 7919 % 10007}" for i in range(3000))
    cjk = "".join(chr(0x4E00 + i * i * 31 % 5000) + ("。" if i % 37 == 36 else "，" if i % 11 == 10 else "") for i in range(4000))
    pairs = [(plain, plain[:20] + "x" + plain[20:]), (plain, plain[:20] + plain[21:]), (cjk, cjk[:5] + "x" + cjk[5:])]
    df = spark.createDataFrame(pairs, "a string, b string")
    near = df.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b")).select(F.size(merkle.changed_sections(F.col("a"), F.col("b"))), merkle.likeness(F.col("a"), F.col("b")))
    for changed, like in near.collect():
        assert changed <= 2 and 0.95 < like < 1
    odd = [plain, cjk, "a" * 1000, "x" * 300 + "...\n\n" + "y z\r\u2028 " * 90 + "!", "", "\n", "." * 400, "é" * 161, "w " * 500]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", merkle.paragraphs(F.col("t")).alias("p")).collect()
    assert all("".join(r.p) == r.t and "" not in r.p for r in got)


def test_neardup(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    known = {d: t for d, t, *_ in ROWS if d is not None}
    want = brute.near_duplicates(list(known.items()), 5)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    assert neardup.near_duplicates(none).count() == 0


def test_neardup_blocks(spark):
    """Chains of edits, with groups split into blocks of any size, link alike."""
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i % 9] + [f"u{i // 9}"] * (i % 9))) for i in range(80)] + [(100 + i, " ".join(f"v{i}_{j}" for j in range(20))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: c for d, (_, c) in brute.near_duplicates(rows, 3).items()}
    for block in (2048, 4):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, words=3, block=block).collect()} == want
