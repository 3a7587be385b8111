"""Corpus operators against plain versions, and on nulls, empty and long texts, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import harness  # noqa: E402

from tidewell.llm import archives, components, exact, language, lines, mixing, packing, quality, queries, shards, simhash, substrings, tokens  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = "norm n start bucket fp sig words keys value number component_id keep_id key flag data _posteriors tokens rate size blob kind".split()


def vocabulary(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(r: random.Random, words: list[str], n: int) -> str:
    out = [r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n)]
    return "".join(w + r.choice([" "] * 9 + ["\n"]) for w in out).strip()


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    r, words = random.Random(7), vocabulary(1)
    texts = [prose(r, words, r.randint(20, 200)) for _ in range(60)]
    passage = prose(r, vocabulary(2), 60)
    texts += [texts[3], texts[3].replace(" ", "  "), texts[4] + " tail", " ".join(texts[5].split()[:-1]), texts[6][:200] + passage + texts[6][200:], passage + texts[7], texts[8].upper()]
    texts += [None, "", " ", "\n\n", "a", "x" * 49, "x" * 50, "x" * 120, "the same line\n" * 40, "\u0000 nul \u0000", "tab\tand\r\nfeed\x0b", "日本語 テスト 文章\n" * 8, "é" * 60]
    texts += [prose(r, words, 9000), passage, passage]
    return [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Rows of a repeated doc_id, a null doc_id, repeated rows."""
    more = [*rows[:30], rows[2], rows[2], (3, "another text of a repeated id", "en", "s", 1), (None, rows[5][1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(more, DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 5 != 0), int(r[0] % 7 == 0)) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")


def test_quality_counts_and_verdicts(docs, empty, odd, labels, rows):
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(text)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(empty, labels).count() == 0 and quality.judge(odd, labels.limit(0)).count() == odd.count()
    assert {r.score for r in quality.judge(odd, labels.limit(0)).collect()} == {0.0}


def test_quality_score_is_the_mean_log_ratio(spark):
    good, bad = vocabulary(3, 60), vocabulary(4, 60)
    r = random.Random(0)
    texts = [prose(r, good if i % 4 else bad, 120) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labs = spark.createDataFrame([(i, 1, 0) for i in range(0, 40) if i % 4], "doc_id long, quality int, toxic int")
    ratio = quality.log_ratio(df, labs, buckets=1 << 12)
    b = [quality.ngram_buckets(*quality.coded(quality.words_of(t)), 1 << 12) for t in texts]
    raw = np.bincount(np.concatenate(b), minlength=1 << 12)
    target = np.bincount(np.concatenate([x for i, x in enumerate(b) if i % 4]), minlength=1 << 12)
    p = (raw + 1) / (raw.sum() + (1 << 12))
    assert np.allclose(ratio, np.log((target + 4096 * p) / (target.sum() + 4096)) - np.log(p))
    got = {x.doc_id: x for x in quality.judge(df, labs, buckets=1 << 12).collect()}
    assert all(abs(got[i].score - ratio[x].mean()) < 1e-9 for i, x in enumerate(b))
    assert all(got[i].kept == bool(i % 4) for i in range(40) if not got[i].base_failed)


def test_similar_lines(spark, docs, empty, odd, rows):
    want = brute.lines([r[:2] for r in rows])
    for few, block, cluster in ((lines.FEW, lines.BLOCK, lines.CLUSTER), (2, 4, lines.CLUSTER), (2, 4, 5)):
        got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in lines.similar_lines(docs, few=few, block=block, cluster=cluster).collect()}
        assert got == want
    assert lines.similar_lines(empty).count() == 0
    assert lines.similar_lines(odd).count() == sum(len((r.text or "").split("\n")) for r in odd.collect())
    texts = {r.doc_id: r.text for r in lines.without_similar_lines(docs).collect()}
    for i, text, *_ in rows:
        assert texts[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if not want[i, k][3]))


def test_variants_of_a_line_are_linked_without_pairs(spark):
    base = [f"w{j}" for j in range(20)]
    texts = [(i, " ".join(base[:k] + base[k + 1 :]) + f" v{i}") for i, k in enumerate([j % 20 for j in range(70)])]
    for cluster in (lines.CLUSTER, 30):
        got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in lines.similar_lines(spark.createDataFrame(texts, "doc_id long, text string"), few=8, block=16, cluster=cluster).collect()}
        assert got == brute.lines(texts)


def test_language_counts_phrases_and_tells_languages(spark, docs, empty, odd):
    words = {"aa": vocabulary(11, 80), "bb": vocabulary(12, 80)}
    r = random.Random(1)
    data = [(i, prose(r, words[k], r.randint(1, 400)), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, " 12 !?", "bb"), (902, prose(r, words["aa"], 5000), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    samples = language.sample(df.where(~language.held_out()))
    got = {x.doc_id: x for x in language.identify(df, samples).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    held = [x for x in data if x[2] and zlib.crc32(str(x[0]).encode()) % 5 == 0 and x[0] < 900]
    assert np.mean([got[i].lang_pred == k for i, _, k in held]) >= 0.95
    letter = language.letter_table()
    plain = {k: "".join(map(chr, language.symbols(t, letter))) for k, t in samples.items()}
    for i, t, _ in [*data[:20], data[-1]]:
        s = "".join(map(chr, language.symbols(t, letter)))
        assert got[i].phrases == brute.phrases(plain[got[i].lang_pred], s)
    assert len(data[-1][1]) > 10_000
    assert language.identify(empty, samples).count() == 0 and language.identify(odd, {}).where("lang_pred != 'und'").count() == 0
    assert language.identify(docs, samples).count() == docs.count()
    assert language.sample(empty) == {}


def test_suffix_automaton_holds_all_substrings():
    r = random.Random(3)
    codes = [r.randint(1, 3) for _ in range(200)]
    edges, states = language.automaton(codes)
    auto = language.Transitions(edges, 4)
    auto.prepare()
    table = auto.table.reshape(states, 4)
    text, subs = "".join(map(str, codes)), None
    subs = {text[i:j] for i in range(200) for j in range(i + 1, min(i + 9, 201))}
    for _ in range(500):
        s = [r.randint(1, 3) for _ in range(r.randint(1, 8))]
        state = 0
        for c in s:
            state = table[state, c]
            if not state:
                break
        assert bool(state) == ("".join(map(str, s)) in subs)


def test_language_of_many_letters(spark, monkeypatch):
    """Hundreds of letters, texts parsed side by side and one by one, dense and hashed tables: the language is that of brute force."""
    r = random.Random(8)
    letters = {"aa": [chr(0x4E00 + i) for i in range(600)], "bb": [chr(0x4E00 + i) for i in range(300, 900)]}
    words = {k: ["".join(r.choice(x) for _ in range(r.randint(1, 3))) for _ in range(900)] for k, x in letters.items()}
    samples = {k: " ".join(r.choice(w) for _ in range(1500)) for k, w in words.items()}
    data = [(i, " ".join(r.choice(words["ab"[i % 2] * 2]) for _ in range(r.choice([0, 3, 40, 200]))), None) for i in range(70)] + [(99, " ".join(r.choice(words["aa"]) for _ in range(4000)), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").coalesce(1)
    letter = language.letter_table()
    plain = {k: "".join(map(chr, language.symbols(t, letter))) for k, t in samples.items()}
    assert len(data[-1][1]) > 10_000 and len(set(plain["aa"])) > 400
    want = {}
    for i, t, _ in data:
        s = "".join(map(chr, language.symbols(t, letter)))
        n = {k: brute.phrases(p, s) for k, p in plain.items()}
        best = min(n, key=lambda k: (n[k] * np.log2(len(plain[k]) + 1), k))
        want[i] = (best, n[best]) if s.strip() else ("und", 0)
    assert {x.doc_id: (x.lang_pred, x.phrases) for x in language.identify(df, samples).collect()} == want
    model = language.Model(samples)
    codes = [model.codes[0][model.letters(language.symbols(t, letter))] for _, t, _ in data]
    lengths = np.array([len(c) for c in codes])
    for dense in (1 << 24, 0):
        monkeypatch.setattr(language, "DENSE", dense)
        auto = language.Transitions(*[language.automaton(model.codes[0][model.letters(language.symbols(samples["aa"], letter))].tolist())[0], model.automata[0].width])
        got = language.phrases(auto, np.concatenate(codes), np.cumsum(lengths) - lengths, lengths, 8)
        assert got.tolist() == [brute.phrases(plain["aa"], "".join(map(chr, language.symbols(t, letter)))) for _, t, _ in data]


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 300 + "</p>"
    pages = [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (1, "http://b c/\n", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "z" * 3_000_000), (8, "é", "ü\r\n\r\nWARC/1.1\r\n"), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("content", F.lit("c"))
    for version in (1, 2):
        got = archives.round_trip(df, version).collect()
        assert len(got) == len(pages)
        by = {r.page_id: r for r in got}
        for i, _, html in pages:
            b = (html or "").encode()
            assert (by[i].payload_bytes, by[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert {i: (by[i].record_type, by[i].refers_to) for i in (2, 5, 9, 4, 6, None)} == {2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), 4: ("response", None), 6: ("response", None), None: ("response", None)}
    assert archives.round_trip(df.limit(0)).count() == 0
    twice = df.where("page_id in (2, 5)").unionByName(df.where("page_id = 2"))
    assert sorted(r.record_type for r in archives.round_trip(twice).collect()) == ["response", "revisit", "revisit"]
    again = spark.createDataFrame([(4, "u", "short")] * 3, "page_id long, url string, html string").coalesce(1)
    warc = archives.convert(spark, archives.write_arc(again, str(tmp_path / "a")), str(tmp_path / "w"))
    assert len({r.record_id for r in archives.read_warc(spark, warc).collect()}) == 3


def test_arc_headers_and_lengths():
    one, two = archives.arc_record(1, "http://x/a", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody"), archives.arc_record(2, "http://x/b", "20240102030405", "image/png", b"\n\nraw")
    (r,) = archives.parse_arc(archives.arc_head(1) + b"\n" + one)
    assert (r["url"], r["date"], r["mime"], r["content"][-4:]) == ("http://x/a", "20240102030405", "text/html", b"body")
    (r,) = archives.parse_arc(archives.arc_head(2) + b"\n" + two + b"\n")
    assert (r["url"], r["mime"], r["status"], r["content"]) == ("http://x/b", "image/png", 200, b"\n\nraw")
    assert archives.iso("20240102030405") == "2024-01-02T03:04:05Z"
    for bad in (archives.arc_head(1) + b"\n" + one[:-1], archives.arc_head(2) + b"\n" + one, b"nonsense\n", one):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad))
    w = archives.warc_record("response", "urn:uuid:1", "u", "d", "0", b"block", "m", "00")
    with pytest.raises(ValueError):
        list(archives.parse_warc(w + b"\r\n"))


def test_mixing_meets_the_targets(spark, empty, odd, labels):
    r, words = random.Random(5), [vocabulary(21 + k, 200) for k in range(3)]

    def text(k):
        return " ".join([r.choice(words[k]) for _ in range(60)] + [r.choice(words[0]) for _ in range(20)])

    kinds = [(0, 0, 0, 0, 0, 0, 1, 2, 2, 2)[i % 10] for i in range(600)]
    df = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    labs = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i % 3], "doc_id long, quality int, toxic int")
    targets = (0.8, 0.1, 0.1)
    got = {x.doc_id: x for x in mixing.mix(df, labs, targets).collect()}
    names = [f"p_{d}" for d in mixing.DOMAINS]
    hit = np.mean([max(range(3), key=lambda k: got[i][names[k]]) == kinds[i] for i in range(0, 600, 3)])
    assert hit > 0.95
    t = np.array([[got[i].tokens * got[i][n] for n in names] for i in range(600)])
    rates = np.array([got[i].rate for i in range(600)])
    want = np.minimum(np.array(targets) / 0.8 * t[:, 0].sum(), t.sum(axis=0))
    want[0] = t[:, 0].sum()
    assert np.abs(rates @ t - want).max() < 1e-5 * t.sum() and rates.min() >= 0
    # the same fit in plain numpy
    p = np.array([[got[i][n] for n in names] for i in range(600)])
    tok, x = np.array([got[i].tokens for i in range(600)]), np.ones(600)
    whiten = np.linalg.inv((p * tok[:, None]).T @ p / t.sum() + 1e-3 * np.eye(3))
    for _ in range(mixing.ROUNDS):
        m = x @ t
        if np.abs(m - want).max() <= 1e-7 * t.sum():
            break
        x = np.maximum(0, x - p @ (whiten @ ((m - want) / t.sum())))
    assert np.allclose(x, rates, atol=1e-9)
    kept = mixing.keep(df.withColumn("tokens", F.lit(1)), labs)
    ids = {x.doc_id for x in kept.collect()}
    assert kept.columns == ["doc_id", "text", "tokens"] and all(i in ids for i, k in enumerate(kinds) if got[i].p_clean == 1)
    assert sum(i in ids for i, k in enumerate(kinds) if k == 2) < 10
    assert mixing.mix(empty, labs).count() == 0 and mixing.keep(empty, labs).count() == 0
    assert mixing.mix(odd, labs.limit(0)).count() == odd.count() and mixing.keep(odd, labels.limit(0)).count() > 0


def test_repeats_are_removed(spark, docs, empty, odd, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert got == brute.repeats([r[:2] for r in rows])
    kept = substrings.remove_repeats(docs, with_bytes=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)
    assert substrings.remove_repeats(empty).count() == 0
    again = substrings.remove_repeats(odd).collect()
    assert len(again) == odd.count() and sum(r.n_removed for r in again if r.doc_id == 2) == 0
    assert [r.n_removed for r in again if r.doc_id is None and r.n_bytes] == [len(rows[5][1].encode())]


def test_equal_strings_agree_with_sorting():
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(1, 3, 700), [0]]).astype(np.uint8)
    order, interval = substrings.equal_strings(text, 12)
    groups: dict[bytes, set[int]] = {}
    for at, k in zip(order.tolist(), interval.tolist(), strict=True):
        if at + 12 <= 700:
            groups.setdefault(text[at : at + 12].tobytes(), set()).add(k)
    assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_token_shards(spark, docs, empty, odd, rows, tmp_path):
    coder = tokens.encoder().tokenizer
    ids = [coder.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    want, at = {}, 0
    for (i, *_), x in zip(rows, ids, strict=True):
        want[i] = (at, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()))
        at += len(x)
    path = shards.write(docs, str(tmp_path / "s"), shard_ids=3_000, range_rows=20)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in shards.read(spark, path).collect()} == want
    found = shards.lookup(path, spark.createDataFrame([(4,), (77,), (123456,), (None,), (4,)], "doc_id long").withColumn("ids", F.lit(1))).collect()
    assert {r.doc_id: r.ids for r in found} == {4: ids[4], 77: ids[77]} and len(found) == 2
    assert shards.write_and_read(empty).count() == 0
    got = shards.write_and_read(odd).collect()
    assert len(got) == odd.count() and {r.start for r in got if r.doc_id is None} < {r.start for r in got}


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 5000, dtype=np.int64))
    blob = shards.write_shard(0, 0, 0, keys.tolist(), [1] * len(keys), np.arange(len(keys), dtype="<u2").tobytes(), 2)
    s = shards.Shard(blob)
    no = np.zeros(len(keys), dtype=bool)
    assert s.slots == len(keys) and (s.find(keys, no) == np.arange(len(keys))).all()
    assert (s.find(keys + 1, no) >= 0).mean() < 0.01
    with pytest.raises(ValueError):
        shards.Shard(b"x" * 200)


def test_exact_duplicates(spark, docs, empty, odd, rows):
    want = brute.exact([r[:2] for r in rows])
    got = exact.exact_duplicates(docs, hash_all=True).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want and all(r.kept == (r.doc_id == r.keep_id) for r in got)
    lazy = {r.doc_id: r for r in exact.exact_duplicates(docs, prefix=3, buckets=8).collect()}
    assert {i: (r.keep_id, r.group_size) for i, r in lazy.items()} == {i: x[:2] for i, x in want.items()}
    assert exact.exact_duplicates(empty).count() == 0
    again = exact.exact_duplicates(odd).collect()
    assert len(again) == odd.count() and [r.group_size for r in again if r.doc_id == 2] == [3] * 3
    assert [(r.keep_id, r.kept) for r in again if r.doc_id is None and r.keep_id is not None] == [(5, False)]


def test_simhash_components(spark, docs, empty, odd, rows):
    fps = [brute.fingerprint(r[1]) for r in rows]
    linked = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(fps))]
    lab = brute.closure(len(fps), linked)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], lab[i]) for i in range(len(fps))}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(odd).count() == odd.count()


def test_links_of_crowded_cells_are_complete(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(60)} | {r.getrandbits(64) for _ in range(300)})
    linked = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(fps))]
    want = brute.closure(len(fps), linked)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for cell in (simhash.CELL, 8):
        roots = {x.node: x.root for x in components.components(simhash.links(df, cell=cell)).collect()}
        groups: dict[int, set[int]] = {}
        for i, x in enumerate(signed):
            groups.setdefault(roots.get(x, x), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in range(len(fps)) if want[i] == k) for k in set(want))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and got[500] == got[501] != got[0] and len(got) == 203
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, docs, empty, odd, rows):
    coder = tokens.encoder().tokenizer
    ids = {r[0]: np.array(coder.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4") for r in rows}
    for size, window in ((1024, 50_000), (64, 10)):
        pieces = packing.pack(docs, size, window).collect()
        for r in pieces:
            assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        for i, x in ids.items():
            own = sorted((r.start, r.length) for r in pieces if r.doc_id == i)
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == len(x)
        shelves: dict[int, list] = {}
        for r in pieces:
            shelves.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in shelves.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= size
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd).agg(F.count_distinct("doc_id")).first()[0] == odd.select("doc_id").dropna().distinct().count()


def test_closest_fill_is_the_best_subset():
    r = random.Random(11)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        room = r.randint(1, 60)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        got = packing.closest_fill(counts, room)
        assert all(k <= counts[n] for n, k in got.items()) and sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
    lengths = [r.randint(1, 1023) for _ in range(3000)]
    bins = packing.fill(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(lengths[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= 1.02 * sum(lengths) / 1024 + 1


def test_encoder_agrees_with_the_tokenizer(rows):
    e = tokens.Encoder(memo=50)
    texts = [r[1] or "" for r in rows] + ["it's 's\n's", "a\x1cb c", " ", "a\n b", "foo!!\n##a!! b?* |", "<|endoftext|> x <|endoftext|>", "x　y z", "\nfoo", "é'll 12 3x ʘ. ʘ"]
    for t, data in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_have_the_rows_of_their_sql(spark, sf_dir, name):
    assert not harness.check(spark, name, queries.QUERIES[name], queries.SQL[name], sf_dir)
