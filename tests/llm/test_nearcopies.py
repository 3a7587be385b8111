"""Near copies of 5-word Jaccard 4/5 or more against brute force, and the pipeline's stage on planted ones."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidewell.llm import nearcopies  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


wanted = brute.near_copies


def planted():
    rng = random.Random(3)
    rows, k = [], 0
    for size in (6, 30, 60, 120, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for edits in (0, 1, 2, max(2, size // 50), size // 25, size // 12):
                w = list(base)
                for e in range(edits):
                    w[rng.randrange(len(w))] = f"x{k}y{e}"
                rows.append((k, " ".join(w)))
                k += 1
    base = [f"c{i}" for i in range(300)]  # a cluster
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"z{i}"
        rows.append((k + i, " ".join(w)))
    k += 60
    return rows + [(k, ""), (k + 1, None), (k + 2, "one two"), (k + 3, "One  TWO"), (k + 4, " ".join(base).upper())]


def test_near_copies_against_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = wanted(rows)
    assert 50 < len(set(want.values())) < len(rows) - 100
    for sample, cell in ((nearcopies.SAMPLE, nearcopies.CELL), (nearcopies.SAMPLE, 8), (20, 4)):
        got = {r.doc_id: r.component_id for r in nearcopies.near_copies(df, sample=sample, cell=cell).collect()}
        assert got == want
    assert nearcopies.near_copies(df.limit(0)).count() == 0
    twice = spark.createDataFrame([*rows[:3], *rows[:3], (None, rows[0][1]), (None, "alone")], "doc_id long, text string")
    got = [(str(r.doc_id), r.component_id) for r in nearcopies.near_copies(twice).collect()]
    assert len(got) == 8 and {x[1] for x in got if x[0] == "None"} == {0, None}


def test_stage_drops_planted_near_copies(spark, sf_dir):
    """Copies of similarity 4/5 or more, of which the fingerprints differ in more than three bits."""
    rows = [(i, t, "en", "web", len(t or "")) for i, t in planted()]
    want = wanted([r[:2] for r in rows])
    far = [i for i, c in want.items() if i != c and (brute.fingerprint(rows[i][1]) ^ brute.fingerprint(rows[c][1])).bit_count() > 3]
    assert len(far) > 20
    left = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()}
    assert left == set(want.values())


def test_pairs_verified_grow_with_a_cluster_not_with_its_square(spark, monkeypatch):
    """One cluster in which some pairs are similar and most are not: each class is verified a bounded number of times."""
    rng = random.Random(5)
    base = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for e in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"z{i}y{e}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = nearcopies.frequent(df)
    sets = nearcopies.prefixes(df, known).cache()
    root = F.col("cls").alias("root")
    cells = nearcopies.met(nearcopies.cells_of(sets, known)).join(sets.select("cls", "parity").distinct(), "cls").select("cell", "cls", "n", "pos", root, "parity").cache()
    found = {nearcopies.class_of(s): set(s.tolist()) for s in (nearcopies.shingles(t)[0] for _, t in rows)}
    pairs = {(a, b) for a in found for b in found if a < b}
    similar = {(a, b) for a, b in pairs if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])}
    every = {tuple(r) for r in nearcopies.candidates(cells, None).collect()}
    assert 10 * len(found) < len(similar) < len(pairs) / 2
    assert similar <= every and len(every - similar) < len(similar)
    for turn in (0, 1):
        some = {tuple(r) for r in nearcopies.candidates(cells, turn).collect()}
        assert some <= every and len(some) <= nearcopies.PICKS * len(found)
        assert {x for p in some for x in p} == {x for p in every for x in p}
