"""The pipeline against the same stages in plain Python, after the classifier's own verdicts."""

import corpus_pipeline
from lodestar.llm import mixing, quality
from tests.llm import brute
from tests.oracle import connect


def test_pipeline(spark, sf_dir, docs):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    good = {r.doc_id for r in quality.op1_quality_classifier(spark, sf_dir).filter("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    classes = brute.near_duplicates([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r in rows if classes[r.doc_id][1] == r.doc_id]
    left = []
    for r, (_, gone, _, kept) in zip(rows, brute.repeats([r.text for r in rows])):
        text = kept.decode("utf-8", "ignore") if gone else r.text
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            left.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r for r, found in zip(left, brute.leaks([r[1] for r in left], bench)) if not found[3]]
    assert 0 < len(clean) < len(left) < docs.count()
    con = connect(sf_dir)
    con.execute("CREATE TABLE clean (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO clean VALUES (?, ?, ?, ?, ?)", clean)
    want = con.execute(mixing.mixing_sql("clean")).fetchall()
    texts = {r[0]: r for r in clean}
    assert sorted((r.doc_id, r.domain, r.n_tokens, r.epoch) for r in got) == sorted((d, dom, n, e) for d, dom, _, _, n, e in want)
    assert all((r.doc_id, r.text, r.lang, r.source, r.n_chars) == texts[r.doc_id] for r in got)


def test_stages_pass_rows_on(spark, sf_dir):
    """A stage works on all that it is given, returns the columns of documents, and takes an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
