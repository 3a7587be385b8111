"""Hot phrases and repeated doc_ids: results don't depend on where groups are cut."""

from __future__ import annotations

import random

import brute
import pytest
from test_llm_operators import prose, vocabulary

from tidewell.llm import language, substrings


@pytest.fixture(scope="module")
def phrased(spark):
    """Documents that all hold a phrase, a third of them with more of it, in surroundings of their own."""
    r = random.Random(21)
    words = vocabulary(21)
    phrase = "terms of use apply to all that is said on this page and on those that follow it"
    rows = []
    for i in range(150):
        cut = r.choice([phrase, phrase[: r.randint(20, 70)], phrase[r.randint(1, 12) :]])
        rows.append((i, f"{prose(r, words, r.randint(0, 20))} {cut}{r.choice([' ', '', '. '])}{prose(r, words, r.randint(0, 20))}"))
    rows += [(200 + i, "x" * n) for i, n in enumerate((49, 50, 51, 400))] + [(300, phrase * 3), (301, None), (302, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.mark.parametrize("hot", [1, 4, 40, 20_000])
def test_repeats_of_hot_anchors(phrased, hot):
    rows, docs = phrased
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, hot=hot, bucket_bytes=2_000).collect()}
    assert got == brute.repeats(rows)


def test_a_sample_of_repeated_ids_has_each_text_once(spark):
    r = random.Random(3)
    words = vocabulary(3)
    texts = [prose(r, words, 8).replace("\n", " ") for _ in range(6)]
    rows = [(1, texts[0], "aa")] * 300 + [(1, t, "bb") for t in texts[1:4]] + [(2, texts[4], "aa"), (None, texts[5], "aa"), (3, None, "aa"), (4, texts[5], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {k: sorted(v.split("\n")) for k, v in language.sample(df, most_docs=400).items()}
    assert got == {"aa": sorted([texts[0], texts[4]]), "bb": sorted(texts[1:4])}
    assert set(language.sample(df, most_docs=1)) == {"aa", "bb"}
