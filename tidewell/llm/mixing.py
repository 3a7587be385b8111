"""Soft-membership mixing: rates of documents that bring domains to target weights.

A classifier learnt from the labels table gives every document posteriors over the domains `clean`, `low` (quality 0)
and `toxic`. A document of t tokens then adds t * posterior to each domain's total. Nonnegative rates are fitted by
projected gradient least squares, so that the expected totals meet the targets: all rates begin at one; each round
sums the totals over the documents, and takes from each rate the whitened residual as the document's posteriors see
it, down to zero at the least. A rate depends on the posteriors alone, so that documents with the same posteriors
(kept in steps of 1/`GRID`) are summed once, and the rounds pass over those sums. Only the residuals, a number for
each domain and round, come to the driver.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, settle, slices

DOMAINS = ("clean", "low", "toxic")
#: Shares of the tokens after mixing.
TARGETS = (0.98, 0.02, 0.0)
#: Shares that can be met where clean documents have some tokens of the other domains by soft membership, and all their tokens are to stay.
WITHIN_REACH = (0.95, 0.03, 0.02)
#: Labelled documents that the classifier is fitted on at most, the least by a hash of doc_id.
SAMPLE = 20_000
#: Hash buckets of the words; a word counts once in a document.
BUCKETS = 1 << 18
#: A bucket speaks for or against a domain where its shares there and in the first domain differ by as many standard errors.
ERRORS = 8.0
#: Documents' worth of the overall share that smooths both.
LEAN = 50
GRID = 256
#: Rounds at most. The fit ends before, where the totals are met or a round moves next to no tokens any more.
ROUNDS = 40
#: A round that changes the rates by less than this share of all tokens finds the fit stationary.
STILL = 1e-6
#: Rounds after which the rates so far are stored with the sums, so that no round repeats all before it.
STORE = 8
#: A total that is further from its target than this share of all tokens is warned of.
MISS = 1e-3


def buckets_of(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of the text, and the buckets of its distinct words (A-Z lower-cased), as they are and without marks around them."""
    words = text.encode().lower().split() if text else []
    distinct = set(words)
    distinct |= {w.strip(b".,;:!?") for w in distinct}
    return len(words), np.unique(np.fromiter((zlib.crc32(w) for w in distinct), dtype=np.int64, count=len(distinct)) % buckets)


class Classifier:
    """Multinomial naive Bayes over a document's distinct hashed words; buckets whose difference may be chance are one class."""

    def __init__(self, documents: np.ndarray, seen: np.ndarray, errors: float = ERRORS):
        """documents: labelled documents of each domain; seen: those with each bucket, domain by bucket.

        A domain that no labelled document is of has no share in any; without labelled documents all have the same.
        """
        known = (documents > 0) | (documents.sum() == 0)
        self.prior = np.where(known, np.log((documents + 1) / (documents + 1)[known].sum()), -np.inf)
        weights = np.zeros(seen.shape)
        for k in range(1, len(documents)):  # each domain against the first
            n, m, a, b = documents[k], documents[0], seen[k].sum(), seen[0].sum()
            if not (n and m and a and b):
                continue
            overall = (seen[k] + seen[0]) / (n + m)
            error = np.sqrt(overall * (1 - overall) * (1 / n + 1 / m)) + 1e-12
            telling = np.abs(seen[k] / n - seen[0] / m) > errors * error  # test of two proportions
            # shares of all buckets that documents have; both lean on the common share by LEAN documents
            lean = LEAN * (a + b) / (n + m)
            common = lean * (seen[k] + seen[0] + 1e-9) / (a + b)
            ratio = np.log((seen[k] + common) / (a + lean)) - np.log((seen[0] + common) / (b + lean))
            # the other buckets are one class: where some buckets are more likely, the rest are less so
            rest = np.log((seen[k][~telling].sum() + 1) / (a + 1)) - np.log((seen[0][~telling].sum() + 1) / (b + 1))
            weights[k] = np.where(telling, ratio, rest)
        self.weights = np.ascontiguousarray(weights.T)

    def posteriors(self, buckets: np.ndarray) -> np.ndarray:
        z = self.prior + self.weights[buckets].sum(axis=0)
        p = np.exp(z - z.max())
        p /= p.sum()
        steps = np.floor(p * GRID)
        rest = int(GRID - steps.sum())
        steps[np.argsort(steps - p * GRID, kind="stable")[:rest]] += 1  # largest remainders, so that steps add up
        return steps / GRID


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, buckets: int = BUCKETS) -> Classifier:
    """Fit on the labelled documents among docs, up to `most`. Their counts, domains times buckets, come to the driver."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    rows = only(labels, "doc_id", "quality", "toxic").select("doc_id", domain.alias("k")).dropna().groupBy("doc_id").agg(F.max("k").alias("k"))
    of = {r.doc_id: r.k for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    shared, n_domains = docs.sparkSession.sparkContext.broadcast(of), len(DOMAINS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((n_domains, buckets + 1), dtype=np.int64)  # the last bucket counts the documents
        known = shared.value
        for part in slices(batches, "text"):
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                if (k := known.get(doc_id)) is not None:
                    seen[k, buckets_of(part.column(1)[i].as_py(), buckets)[1]] += 1
                    seen[k, buckets] += 1
        k, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(seen[k, b])], names=["k", "bucket", "n"])

    seen = np.zeros((n_domains, buckets + 1))
    counted = only(docs, "doc_id", "text").mapInArrow(work, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():
        seen[r.k, r.bucket] = r.n
    return Classifier(seen[:, buckets], seen[:, :buckets])


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, tokens, posteriors): words of the whole text, and the share of each domain in steps of 1/GRID."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = len(model.weights)
        for part in slices(batches, "text"):
            found = [buckets_of(t, buckets) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([model.posteriors(b).tolist() for _, b in found], pa.list_(pa.float64()))],
                names=["doc_id", "tokens", "posteriors"],
            )

    return only(docs, "doc_id", "text").mapInArrow(work, "doc_id long, tokens long, posteriors array<double>")


def _number_array(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def rate(posteriors: Column, steps: list[np.ndarray], start: Column | None = None) -> Column:
    """The rate after the given rounds: from `start` (one), less each round's step as the posteriors see it, never below zero."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    dot = lambda g: F.aggregate(F.zip_with(posteriors, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.array(*[_number_array(g) for g in steps]), start, lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def solve(members: DataFrame, targets: tuple[float, ...] = TARGETS, anchor: float = 1.0, rounds: int = ROUNDS, tolerance: float = 1e-7, still: float = STILL) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, expected totals, target totals) of the fit.

    The first domain is to keep `anchor` times its tokens, and sets the scale: the others get tokens by their weights,
    a scarce one by rates above one. The rounds go on until the totals are met or the rates stand still, so that what is
    missed then no rates can give (in the whitened measure). Totals that the rates can't meet, as of a domain without
    tokens, are warned of, and so is a fit that `rounds` ended. There are no more cells than steps of 1/GRID allow (33,153
    of three domains), so that a round is a small job however many documents there are.
    """
    n = len(targets)
    cells = settle(members.groupBy("posteriors").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("rate", F.lit(1.0)), "cells")
    p = [F.col("posteriors")[k] for k in range(n)]

    def totals(*columns: Column) -> np.ndarray:
        return np.array([x or 0.0 for x in cells.agg(*[F.sum(F.col("tokens") * c).alias(f"x{i}") for i, c in enumerate(columns)]).first()])

    first = totals(*p, *[p[i] * p[j] for i in range(n) for j in range(n)])
    have, inner = first[:n], first[n:].reshape(n, n)
    scale = have.sum()
    if not scale:
        return [], have, have
    w = np.array(targets) / sum(targets)
    want = w * anchor * have[0] / w[0]
    # a domain with next to no tokens must not make steps huge, nor a scarce one approach its total too slowly
    whiten = np.linalg.inv(inner / scale + np.diag(np.clip(have / scale / 8, 1e-6, 1e-3)))
    steps: list[np.ndarray] = []
    now, moved = have, 1.0
    while len(steps) < rounds and moved > still and np.abs(now - want).max() > tolerance * scale:
        steps.append(np.where(have > 0, whiten @ ((now - want) / scale), 0.0))
        since = steps[-((len(steps) - 1) % STORE + 1) :]
        before, r = (rate(F.col("posteriors"), some, F.col("rate")) for some in (since[:-1], since))
        *sums, change = totals(*[x * r for x in p], F.abs(r - before))
        now, moved = np.array(sums), change / scale
        if len(steps) % STORE == 0:
            cells = settle(cells.withColumn("rate", r), "cells")
    if moved > still and np.abs(now - want).max() > tolerance * scale:
        warnings.warn(f"the fit was ended by its {rounds} rounds: the last one moved {moved:.2g} of all tokens", stacklevel=2)
    if (missed := residual(now, want)) > MISS:
        share = [round(float(x), 4) for x in now / max(now.sum(), 1.0)]
        warnings.warn(f"the mix misses a target by {missed:.4f} of all tokens: shares {share} for {[round(float(x), 4) for x in w]}", stacklevel=2)
    return steps, now, want


def residual(now: np.ndarray, want: np.ndarray) -> float:
    """How far the worst domain's total is from its target, as a share of all tokens wanted."""
    return float(np.abs(now - want).max() / max(want.sum(), 1.0)) if len(want) else 0.0


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, anchor: float = 1.0, seed: int = 5) -> DataFrame:
    """One row per row of docs: (doc_id, tokens, p_clean, p_low, p_toxic, rate, copies, missed).

    copies is the rate rounded up or down by a hash of doc_id, so that its expectation is the rate. A null or empty
    text has no tokens and the posteriors of the priors; very long texts are read whole; repeated rows get the same
    copies each; rows with a null doc_id share one hash. Without labelled documents all posteriors are alike. missed
    is the same in all rows: how far the fit stays from its targets (see residual), zero if they are met. Targets that
    can't be met, as of a domain without tokens, or of none for a domain in which clean documents have a share, are
    warned of too. Further columns are ignored; no rows give none.
    """
    members = settle(memberships(docs, fit(docs, labels)), "members")
    steps, now, want = solve(members, targets, anchor)
    r = rate(F.col("posteriors"), steps)
    shares = [F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return members.select("doc_id", "tokens", *shares, r.alias("rate"), copies(r, seed).alias("copies"), F.lit(residual(now, want)).alias("missed"))


def copies(rate: Column, seed: int = 5) -> Column:
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def keep(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, anchor: float = 1.05) -> DataFrame:
    """The rows of docs, each as often as it has copies, all columns as they are.

    The anchor asks for a little more of the first domain than there is, so that its plain members have a rate of one
    or more and stay. The posteriors are computed anew where the rows are, so that no text moves.
    """
    model = fit(docs, labels)
    members = memberships(docs, model)
    steps, _, _ = solve(members, targets, anchor)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, name = docs.columns.index("text"), "_posteriors"
    while name in docs.columns:
        name += "_"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        buckets = len(classifier.weights)
        for part in slices(batches, "text"):
            p = [classifier.posteriors(buckets_of(t, buckets)[1]).tolist() for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.list_(pa.float64()))], names=[*part.schema.names, name])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(name, ArrayType(DoubleType()))
    found = docs.mapInArrow(work, schema)
    repeat = F.array_repeat(F.lit(0), copies(rate(F.col(f"`{name}`"), steps)).cast("int"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(repeat).alias(name)).drop(name)
