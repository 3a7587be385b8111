"""The stages against plain versions, each on what the one before kept."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidewell.llm import mixing, quality  # noqa: E402
from tidewell.llm.common import settle, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        came = [r.doc_id for r in out.collect()]
        if k == 3:
            sure = {r.doc_id for r in mixing.mix(out, labels, corpus_pipeline.TARGETS, 1.05).where("rate >= 1").collect()}
        if k == 0:
            want = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
            assert all(not brute.base_rules(texts[i])[-1] for i in want)
        elif k == 1:
            want = {x[0] for x in brute.exact([(i, texts[i]) for i in came]).values()}
        elif k == 2:
            want = set(brute.near_copies([(i, texts[i]) for i in came]).values())
        out = settle(stage(spark, out, sf_dir), "test")
        if k < 3:
            assert {r.doc_id for r in out.collect()} == want
        if k < 4:
            assert out.columns == COLUMNS
        if k == 3:
            left = {r.doc_id for r in out.collect()}
            assert sure <= left <= set(came)
        if k == 4:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(came)
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def test_an_empty_table_runs_through(spark, sf_dir):
    out = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, out, sf_dir), "test")
    assert out.count() == 0


def test_the_mix_meets_its_targets(spark):
    """Expected totals meet the targets; copies are whole, so that what comes out does so within some documents' size."""
    sf_dir = "/root/testdata/sf0.01"
    docs = settle(corpus_pipeline.exact_dedup(spark, corpus_pipeline.quality_rules(spark, table(spark, sf_dir, "documents"), sf_dir), sf_dir), "test")
    rows = mixing.mix(docs, table(spark, sf_dir, "labels"), corpus_pipeline.TARGETS, 1.05).collect()
    tokens = np.array([[r.tokens * r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    rates, copies = np.array([r.rate for r in rows]), np.array([r.copies for r in rows])
    assert rows[0].missed <= mixing.MISS
    for weight, most in ((rates, 2 * mixing.MISS), (copies, 0.01)):
        total = weight @ tokens
        assert np.abs(total / total.sum() - corpus_pipeline.TARGETS).max() < most
    out = {r.doc_id: r.n for r in corpus_pipeline.mix_to_targets(spark, docs, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out == {r.doc_id: r.copies for r in rows if r.copies}


def test_stages_on_odd_rows(spark, sf_dir):
    """Null texts and ids, repeated rows, one doc_id with two texts, equal texts, a very long text, clashing names."""
    base = table(spark, sf_dir, "documents").limit(40).collect()
    long = max((r.text for r in base if r.text), key=len)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    rows += [rows[3], rows[3], (rows[3][0], rows[4][1], "x", "y", 1), (None, rows[5][1], None, None, None), (None, None, None, None, None), (None, long + " end", None, None, None), (rows[6][0], None, "x", "y", 0), (900, " ".join([long] * 40), None, None, None)]
    clash = "root first n text_hash wanted_id group cls place _posteriors".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(1).alias(c) for c in clash])
    key = lambda r: (r.doc_id, r.text)
    out = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert out.columns == docs.columns and all(r.text for r in out.collect())
    got = [key(r) for r in settle(corpus_pipeline.exact_dedup(spark, docs, sf_dir), "test").collect()]
    norm = [" ".join((t or "").split()) for _, t, *_ in rows]
    assert len(got) == len(set(norm))
    least = {n: min((i is None, i or 0) for (i, *_), m in zip(rows, norm, strict=True) if m == n) for n in norm}
    assert all((i is None, i or 0) == least[" ".join((t or "").split())] for i, t in got)
    near = [key(r) for r in settle(corpus_pipeline.simhash_dedup(spark, docs, sf_dir), "test").collect()]
    assert len(near) == len(set(brute.near_copies(list(enumerate(r[1] for r in rows))).values())) and len(set(near)) == len(near)
    mixed = settle(corpus_pipeline.mix_to_targets(spark, docs, sf_dir), "test")
    assert mixed.columns == docs.columns and {key(r) for r in mixed.collect()} <= {(i, t) for i, t, *_ in rows}
    assert corpus_pipeline.pack_sequences(spark, docs, sf_dir).agg(F.count_distinct("doc_id")).first()[0] == len({i for i, *_ in rows if i is not None})
