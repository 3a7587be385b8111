"""Quality rules: countable base rules, then a log-likelihood ratio of hashed word n-grams.

The raw corpus and the trusted target are two multinomials over hashed word unigrams and bigrams. A document's score
is the mean, over its n-grams, of log p(target) - log p(raw); a document stays if its score reaches the threshold.
Raw counts come from all documents. The target's come from a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, only, slices

SYMBOLS = "#*$%&|<>"
#: Hash buckets of the n-grams.
BUCKETS = 1 << 15
#: Labelled documents that the target is counted on, at most; the least by a hash of doc_id.
TARGET_DOCS = 20_000
#: A document with a lower mean log-likelihood ratio is rejected.
THRESHOLD = -0.08
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than U+0020 and U+0009 to U+000D, as UTF-8 (bytes.split cuts at exactly these)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def coded(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words, and the distinct words."""
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes, distinct


def repeated_words(codes: np.ndarray, n_distinct: int, width: int = 3) -> int:
    """Positions covered by windows of `width` words that are found twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    key = codes[:n].astype(np.int64)
    for k in range(1, width):
        if n_distinct < 1 << 20:
            key = key * n_distinct + codes[k : n + k]
        else:  # the products of three would not fit 64 bits
            key = np.unique(key, return_inverse=True)[1] * n_distinct + codes[k : n + k]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    seen: set[str] = set()
    n = 0
    for x in lines:
        if x in seen:
            n += bool(x.strip(SPACES))
        else:
            seen.add(x)
    return n


def ngram_buckets(codes: np.ndarray, distinct: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all unigrams and bigrams."""
    h = np.fromiter((zlib.crc32(w) for w in distinct), dtype=np.uint64, count=len(distinct))[codes]
    with np.errstate(over="ignore"):
        one = h * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) if len(h) > 1 else h[:0]
        mixed = np.concatenate([one, two ^ two >> np.uint64(29)]) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def counts(docs: DataFrame, target_ids: frozenset, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over those of the target.

    Each task sums its own documents first, so that it passes on a row for each bucket at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, trusted = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64), shared.value
        for part in slices(batches, "text"):
            found: dict[bool, list[np.ndarray]] = {True: [raw[:0]], False: [raw[:0]]}
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if words := words_of(text):
                    found[doc_id in trusted].append(ngram_buckets(*coded(words), buckets))
            ours = np.bincount(np.concatenate(found[True]), minlength=buckets)
            target += ours
            raw += ours + np.bincount(np.concatenate(found[False]), minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return only(docs, "doc_id", "text").mapInArrow(work, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCS) -> frozenset:
    """doc_ids of good, harmless labelled documents: all, or the `most` least by a hash of doc_id."""
    good = only(labels, "doc_id", "quality", "toxic").where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return frozenset(r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())


def log_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TARGET_DOCS, smoothing: float = 1.0) -> np.ndarray:
    """log p(target) - log p(raw) for each bucket; zeros if there are no trusted documents. At most `buckets` rows are collected.

    The target is smoothed towards the raw corpus: it gets `smoothing` further n-grams per bucket, dealt as in the raw corpus.
    """
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts(docs, trusted_ids(labels, most), buckets).toLocalIterator():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    prior = smoothing * buckets
    return np.log((target + prior * p) / (target.sum() + prior)) - np.log(p)


def _judged(text: str | None, ratio: np.ndarray, threshold: float) -> tuple:
    symbols = sum(map((text or "").count, SYMBOLS))
    words = words_of(text)
    if not words:
        return 0, 0, symbols, 0, 0, True, 0.0, False
    codes, distinct = coded(words)
    n, again = len(words), repeated_words(codes, len(distinct))
    score = float(ratio[ngram_buckets(codes, distinct, len(ratio))].mean())
    failed = n < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * n
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, symbols, repeated_lines(text), again, failed, score, not failed and score >= threshold


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, most: int = TARGET_DOCS) -> DataFrame:
    """One row per row of docs with its counts, its score and the verdict; columns as in SCHEMA.

    A null or empty text has no words, fails the base rules and scores 0. Whole texts are counted, very long ones too.
    Repeated rows are judged alike and each counts in the raw corpus. labels needs doc_id, quality and toxic; without
    trusted documents every score is 0. Further columns are ignored; no rows give none.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, buckets, most))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(i, *_judged(t, ratio.value, threshold)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True)], names=_NAMES
            )

    return only(docs, "doc_id", "text").mapInArrow(work, SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, most: int = TARGET_DOCS) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are; no text moves."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, buckets, most))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array([_judged(t, ratio.value, threshold)[-1] for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
