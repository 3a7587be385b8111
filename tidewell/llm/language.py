"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of labelled text. A text is parsed against it
into phrases: each is the longest match from where the phrase before ended, and a character that the sample lacks is
a phrase of its own. The number of phrases times the logarithm of the sample's length, per character, estimates the
cross entropy; the language with the least wins.

The texts of a slice are parsed side by side, a character of each at a time; the longest few go on one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, slices

#: The sample: documents of a language at most, the least by a hash of doc_id. Their texts are learnt whole.
SAMPLE_DOCS = 64
#: Characters of a language's sample, about: a document that would go beyond them is passed over, unless it is the only one.
SAMPLE_CHARS = 30_000
#: Entries of a transition table that is stored with its gaps; a larger one is hashed.
DENSE = 1 << 24
#: Texts of a slice that are parsed side by side at least.
ABREAST = 48
UNKNOWN = "und"


def symbols(text: str, letter: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, with one 0x20 in place of each run of others than letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    points = np.where(letter[points], points, 0x20)
    return points[np.append(True, (points[1:] != 0x20) | (points[:-1] != 0x20))] if len(points) else points


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def automaton(codes: list[int]) -> tuple[list[dict[int, int]], int]:
    """(edges of each state, number of states) of the suffix automaton; state 0 is the start. Code 0 never matches."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return [{c: t for c, t in edges.items() if c} for edges in go], len(go)


class Transitions:
    """The edges of an automaton, for one text or for many at a time. Next state 0: there is no edge."""

    def __init__(self, edges: list[dict[int, int]], width: int):
        self.width, self.states = width, len(edges)
        self.keys = np.array([s * width + c for s, e in enumerate(edges) for c in e], dtype=np.int64)
        self.targets = np.array([t for e in edges for t in e.values()], dtype=np.int32)
        self.table = self.slots = self.one = None

    def _hashed(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def prepare(self) -> None:
        """Lay the table out, in the task that uses it."""
        if self.table is not None or self.slots is not None:
            return
        if self.states * self.width <= DENSE:
            self.table = np.zeros(self.states * self.width, dtype=np.int32)
            self.table[self.keys] = self.targets
            return
        self.bits = max(8, int(2 * len(self.keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        left = np.arange(len(self.keys))
        at = self._hashed(self.keys)
        while len(left):  # each round one key of those that want a free slot gets it
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = left[free]
            got = self.slots[at[left]] == left
            at[left[~got]] = (at[left[~got]] + 1) % len(self.slots)
            left = left[~got]
        self.values[at] = self.targets
        self.slots = np.where(self.slots >= 0, self.keys[self.slots], -1)

    def many(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        keys = state * self.width + codes
        if self.table is not None:
            return self.table[keys].astype(np.int64)
        out = np.zeros(len(keys), dtype=np.int64)
        left, at = np.arange(len(keys)), self._hashed(keys)
        while len(left):
            there = self.slots[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], (at[on] + 1) % len(self.slots)
        return out

    def phrases(self, state: int, codes: np.ndarray) -> int:
        """Phrases that end in the codes, or where they end, for one text."""
        if self.one is None:
            self.one = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))
        get, width, n = self.one.get, self.width, 0
        for c in codes.tolist():
            to = get(state * width + c, 0)
            if not to:
                n += state != 0  # a phrase ends before this character
                to = get(c, 0)
                n += to == 0  # unknown: a phrase of its own
            state = to
        return n + (state != 0)


class Model:
    """Languages in order of their names, each with its automaton and the length of its sample."""

    def __init__(self, samples: dict[str, str]):
        letter = letter_table()
        points = {lang: symbols(text, letter) for lang, text in sorted(samples.items())}
        points = {lang: p for lang, p in points.items() if (p != 0x20).any()}
        self.alphabet = np.unique(np.concatenate([np.zeros(0, dtype="<u4"), *points.values()])).astype(np.int64)
        self.langs = list(points)
        # each language numbers its own letters from 1; row: language, column: letter of the alphabet, the last one for others
        self.codes = np.zeros((len(points), len(self.alphabet) + 1), dtype=np.int64)
        self.automata = []
        for k, p in enumerate(points.values()):
            own = np.unique(p).astype(np.int64)
            self.codes[k, np.searchsorted(self.alphabet, own)] = np.arange(1, len(own) + 1)
            edges, _ = automaton(self.codes[k, np.searchsorted(self.alphabet, p.astype(np.int64))].tolist())
            self.automata.append(Transitions(edges, len(own) + 1))
        self.bits = np.array([np.log2(len(p) + 1) for p in points.values()])

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Places of code points in the alphabet, its size for others."""
        if not len(self.alphabet):
            return np.zeros(len(points), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points.astype(np.int64)), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet))


def phrases(auto: Transitions, codes: np.ndarray, start: np.ndarray, lengths: np.ndarray, abreast: int = ABREAST) -> np.ndarray:
    """Phrases of each text: text i has the codes from start[i] on, lengths[i] of them."""
    auto.prepare()
    order = np.argsort(-lengths, kind="stable")
    start, size = start[order], lengths[order]
    count, state = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    m, k = int((size > 0).sum()), 0
    while m >= abreast:
        for k in range(k, int(size[m - 1])):  # noqa: B020
            c = codes[start[:m] + k]
            to = auto.many(state[:m], c)
            missed = np.flatnonzero(to == 0)
            if len(missed):
                count[missed] += state[missed] != 0  # a phrase ends before this character
                again = auto.many(np.zeros(len(missed), dtype=np.int64), c[missed])
                count[missed] += again == 0  # unknown: a phrase of its own
                to[missed] = again
            state[:m] = to
        k = int(size[m - 1])
        left = int((size > k).sum())
        count[left:m] += state[left:m] != 0
        m = left
    for i in range(m):
        count[i] += auto.phrases(int(state[i]), codes[start[i] + k : start[i] + size[i]])
    out = np.zeros(len(order), dtype=np.int64)
    out[order] = count
    return out


def sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text by language: whole documents, up to most_docs of each language and about `chars` characters in all.

    The least documents by a hash of doc_id are looked at in that order; the first is always taken.
    """
    rows = only(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "n", "mark")
    known = rows.select("doc_id", "lang", F.char_length("text").alias("n"), F.xxhash64("text").alias("mark"))
    first = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most_docs).collect()
    picked: dict[tuple, int] = {}
    total: dict[str, int] = {}
    for r in sorted(first, key=lambda r: (r.lang, r.k)):
        if r.lang not in total or total[r.lang] + r.n <= chars:
            total[r.lang] = total.get(r.lang, 0) + r.n
            picked[r.doc_id, r.lang, r.mark] = r.k
    # a doc_id may be repeated without bound, with the same text or with others: a row for each text that was picked comes back
    ids, marks = sorted({i for i, _, _ in picked}), sorted({m for _, _, m in picked})
    chosen = rows.withColumn("mark", F.xxhash64("text")).where(F.col("doc_id").isin(ids) & F.col("mark").isin(marks))
    found = chosen.groupBy("doc_id", "lang", "mark").agg(F.min("text").alias("text")).collect()
    texts = {(r.lang, picked[r.doc_id, r.lang, r.mark]): r.text for r in found if (r.doc_id, r.lang, r.mark) in picked}
    out: dict[str, list[str]] = {}
    for lang, k in sorted(texts):
        out.setdefault(lang, []).append(texts[lang, k])
    return {lang: "\n".join(x) for lang, x in out.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """One row per row of docs: (doc_id, lang_pred, score, phrases).

    lang_pred is a language of the samples: the one with the least estimated cross entropy of the whole text, of equal
    ones the first by name; `und` if the text is null or has no letter, or if there are no samples. score is one less
    the ratio of that entropy to the next language's, from 0 to 1; 1 if there is one language only, 0 for `und`.
    phrases is how many the text was parsed into for that language. Texts of any length are parsed from end to end;
    repeated rows come back alike; further columns are ignored; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs, letter = model.langs, letter_table()
        for part in slices(batches, "text"):
            texts = [symbols(t or "", letter) for t in part.column(1).to_pylist()]
            spoken = [bool((t != 0x20).any()) for t in texts]
            lengths = np.array([len(t) if s else 0 for t, s in zip(texts, spoken, strict=True)], dtype=np.int64)
            places = model.letters(np.concatenate([t[:n] for t, n in zip(texts, lengths.tolist(), strict=True)]))
            start = np.cumsum(lengths) - lengths
            counts = np.zeros((len(langs), len(texts)), dtype=np.int64)
            for i, auto in enumerate(model.automata):
                counts[i] = phrases(auto, model.codes[i][places], start, lengths)
            out = []
            for k, (doc_id, s) in enumerate(zip(part.column(0).to_pylist(), spoken, strict=True)):
                if not s or not langs:
                    out.append((doc_id, UNKNOWN, 0.0, 0))
                    continue
                h = counts[:, k] * model.bits
                order = np.argsort(h, kind="stable")
                score = 1.0 if len(langs) == 1 else float(1 - h[order[0]] / h[order[1]])
                out.append((doc_id, langs[order[0]], score, int(counts[order[0], k])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.float64(), pa.int64()], strict=True)], names=["doc_id", "lang_pred", "score", "phrases"])

    return only(docs, "doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double, phrases long")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of doc_id as text is a multiple of `folds`; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))
