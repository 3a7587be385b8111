"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 4/5 or more, found exactly.

First SimHash: fingerprints of the same shingles are linked by the pivot tables, and links that hold on the whole sets
join most copies at once. Fingerprints of 64 bits can't do all of it: at that similarity they differ in up to a dozen
bits, and cells of equal blocks for such a radius have a few bits only and hold everything. So the other candidates
come from a prefix filter: under one order of all shingles, two sets of similarity 4/5 share one of the first n/5 + 1
shingles of each. The order puts shingles that a bounded sample of documents shows to be frequent last; it decides how
large cells get, never what is found. Each candidate is verified on the whole sets.

Equal sets are one class. Cells without a second class are dropped at once. In the others two classes are candidates if
their sizes, the places of the shared shingle, and `BITS` bits with the parity of the sets' hashes leave room for the
similarity: each shingle that only one of two sets has changes one bit. Each class is first verified against `PICKS` candidates
of other components, those that come first in as many orders, `ROUNDS` times, so that a large cluster becomes one component by a
number of pairs in proportion to its members, not to their square; then all candidates that are still in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, settle, slices
from .components import components
from .simhash import links as fingerprint_links
from .simhash import votes

#: Words of a shingle.
WIDTH = 5
#: Documents that show which shingles are frequent, about.
SAMPLE = 50_000
#: Shingles that are known to be frequent, at most.
FREQUENT = 1 << 20
#: Classes in a cell, about; a shingle with more is split into pairs of parts.
CELL = 4_096
#: Rounds in which each class is verified against so many candidates of other components.
ROUNDS, PICKS = 2, 4
#: Bits of a set's parity: a multiple of 64.
BITS = 512


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Sorted distinct 64-bit hashes of the text's shingles (A-Z lower-cased), and their fingerprint.

    A text of fewer words is one shingle, an empty one has none.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64), 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(width, len(words))
    starts = [0, *ends[: len(words) - k].tolist()]
    h = xxhash.xxh64_intdigest
    found = np.array([h(joined[i : j - 1], 42) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return np.unique(found), votes(found)


def class_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def parity(found: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the hashes are i modulo BITS."""
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def frequent(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that two or more documents of the sample have, and about how many of all documents have each."""
    n = docs.count()
    every = max(1, -(-n // sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shingles(t, width)[0] for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    chosen = only(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(every)) == 0).select("text")
    counted = chosen.mapInArrow(work, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, df = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy() * every
    order = np.argsort(h)
    return h[order], df[order]


def prefixes(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, cls, fp, n, parity, prefix): class, fingerprint, size and parity of each document's set, and the shingles it must share one of."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, df = shared.value
        for part in slices(batches, "text"):
            cls, fps, n, bits, first = [], [], [], [], []
            for text in part.column(2).to_pylist():
                s, fp = shingles(text, width)
                cls.append(class_of(s))
                fps.append(fp)
                n.append(len(s))
                bits.append(parity(s))
                if len(s) and len(h):
                    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    s = s[np.argsort(np.where(h[at] == s, df[at], 0), kind="stable")]
                first.append(s[: len(s) // 5 + 1].view(np.int64))
            offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(first)))
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            arrays = [part.column(0), part.column(1), pa.array(cls, pa.int64()), fp, pa.array(n, pa.int32()), pa.array(bits, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "cls", "fp", "n", "parity", "prefix"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, "doc_id long, text_hash long, cls long, fp long, n int, parity binary, prefix array<long>")


_CELL = "cell long, cls long, n int, pos int"
_NAMES = ["cell", "cls", "n", "pos"]
_NONE = np.int64((1 << 63) - 1)


def cells_of(rows: DataFrame, known: tuple[np.ndarray, np.ndarray], cell: int = CELL) -> DataFrame:
    """(cell, cls, n, pos): each set once for each shingle of its prefix, and once for each pair of parts where one is very frequent."""
    hot = known[1] > cell
    shared = rows.sparkSession.sparkContext.broadcast((known[0][hot], -(-2 * known[1][hot] // cell)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, parts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                lists = part.column(2)
                size = np.diff(lists.offsets.to_numpy())
                if not size.sum():
                    continue
                token = lists.flatten().to_numpy()
                cls, n = (np.repeat(part.column(i).to_numpy(), size) for i in (0, 1))
                pos = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                if len(h):
                    where = np.minimum(np.searchsorted(h, token.view(np.uint64)), len(h) - 1)
                    many = np.where(h[where] == token.view(np.uint64), parts[where], 1)
                    i = np.repeat(np.arange(len(token)), many)
                    other = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                    token, cls, n, pos, many = token[i], cls[i], n[i], pos[i], many[i]
                    own = cls % many
                    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        mixed = (token.view(np.uint64) ^ (pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                    token = np.where(many > 1, (mixed ^ mixed >> np.uint64(31)).view(np.int64), token)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, cls, n, pos)], names=_NAMES)

    return rows.select("cls", "n", "prefix").mapInArrow(work, _CELL)


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers; one of parities as rows of 64-bit numbers."""
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _by_cell(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole cells, of rows ordered by cell."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append([_numbers(batch.column(i)) for i in range(width)])
            size += batch.num_rows
        if size >= 100_000:
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(x[0], x[0][-1]))  # the last cell may go on
            held, size = [[c[cut:] for c in x]], size - cut
            if cut:
                yield [c[:cut] for c in x]
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell", "n", "cls")


def met(cells: DataFrame) -> DataFrame:
    """The rows of cells that two or more classes share, each class once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_cell(batches, 4):
            same = x[0][1:] == x[0][:-1]
            once = np.r_[True, ~(same & (x[1][1:] == x[1][:-1]))]
            x = [c[once] for c in x]
            same = x[0][1:] == x[0][:-1]
            several = np.r_[False, same] | np.r_[same, False]
            yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in x], names=_NAMES)

    return _sorted(cells).mapInArrow(work, _CELL)


def candidates(cells: DataFrame, turn: int | None) -> DataFrame:
    """(a, b): pairs of a cell's classes with different roots that may be similar: all, or for each class `PICKS` that change with the turn."""
    orders = None if turn is None else [class_of(np.array([turn, i])) for i in range(PICKS)]  # class numbers are hashes: an order for each mask

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_cell(batches, 6):
            starts = np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])
            several = np.minimum.reduceat(x[4], starts) != np.maximum.reduceat(x[4], starts)
            apart = np.repeat(several, np.diff(np.r_[starts, len(x[0])]))
            cell, cls, n, pos, root, bits = (c[apart] for c in x)
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            best = np.full((PICKS, len(cell)), _NONE)
            live, k = np.arange(len(cell) - 1), 1
            while len(live):
                live = live[live + k < len(cell)]
                live = live[(cell[live] == cell[live + k]) & (5 * n[live] >= 4 * n[live + k])]
                i, j = live, live + k
                # what two sets can share from the first shingle they share on
                good = (root[i] != root[j]) & (9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j]))
                i, j = i[good], j[good]
                # similar sets have a ninth of all shingles, at most, in one of them alone
                good = 9 * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
                i, j = i[good], j[good]
                if orders:
                    for order, least in zip(orders, best, strict=True):
                        least[i] = np.minimum(least[i], cls[j] ^ order)
                        least[j] = np.minimum(least[j], cls[i] ^ order)
                elif len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], names=["a", "b"])
                k += 1
            if orders:
                found = (best != _NONE).all(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (cls, *best)], names=["cls", *picks])

    picks = [f"pick{i}" for i in range(PICKS)]
    if not orders:
        return _sorted(cells).mapInArrow(work, "a long, b long").distinct()
    found = _sorted(cells).mapInArrow(work, ", ".join(f"{c} long" for c in ("cls", *picks))).groupBy("cls").agg(*[F.min(c).alias(c) for c in picks])
    other = F.explode(F.array(*[F.col(c).bitwiseXOR(F.lit(order)) for c, order in zip(picks, orders, strict=True)]))
    return found.select("cls", other.alias("other")).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have similarity 4/5 or more."""
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "wanted")
    named = settle(classes.join(wanted, "cls").select(F.col("least").alias("wanted_id")).distinct(), "wanted-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shingles(t, width)[0] for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["cls", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    texts = only(docs, "doc_id", "text").join(named, F.col("doc_id").cast("long").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    full = settle(texts.mapInArrow(sets, "cls long, found binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    one = pairs.join(full.select(F.col("cls").alias("a"), F.col("found").alias("x")), "a")
    two = one.join(full.select(F.col("cls").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y")
    return two.mapInArrow(compare, "a long, b long")


def by_fingerprint(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of classes that connect all whose fingerprints are linked; a pair need not be similar."""
    first = settle(classes.groupBy("fp").agg(F.min("cls").alias("first")), "fingerprints")
    same = classes.join(first, "fp").where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b"))
    found = settle(fingerprint_links(first.select("fp"), radius), "fingerprint-links")
    left, right = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    apart = found.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(apart).distinct()


def near_copies(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE, cell: int = CELL, radius: int = 3) -> DataFrame:
    """One row per row of docs: (doc_id, component_id, root, text_hash).

    Documents whose sets of shingles of `width` words have a Jaccard similarity of 4/5 or more are linked;
    component_id is the smallest doc_id that links reach, its own included, and root a number that only the component
    has. Null and empty texts have equal, empty sets and are linked. Repeated rows come back as often as they are
    there; a null doc_id is never a component's id unless all of the component's are null. Further columns are
    ignored; no rows give none. Shingles are compared by 64-bit hashes. `radius` is that of the fingerprints' links,
    which only save work: what they miss, the prefix filter finds.
    """
    known = frequent(docs, width, sample)
    rows = settle(prefixes(docs, known, width), "prefixes")
    classes = settle(rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("parity").alias("parity")), "classes")
    first = settle(by_fingerprint(classes, radius), "by-fingerprint")
    links = settle(verified(docs, classes, first, width), "fingerprint-copies")
    cells = settle(met(cells_of(rows, known, cell)), "cells")

    def rooted(roots: DataFrame) -> DataFrame:
        known_roots = classes.select("cls", "parity").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        return cells.join(known_roots, "cls").select("cell", "cls", "n", "pos", F.coalesce("root", "cls").alias("root"), "parity")

    for turn in (*range(ROUNDS), None):
        pairs = settle(candidates(rooted(settle(components(links), "near-roots")), turn).join(first, ["a", "b"], "left_anti"), "candidates")
        links = settle(links.unionByName(verified(docs, classes, pairs, width)), "near-links")
        first = settle(first.unionByName(pairs), "tried")
    roots = settle(components(links).withColumnRenamed("node", "cls"), "all-roots")
    rooted_classes = classes.join(roots, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = settle(rooted_classes.groupBy("root").agg(F.min("least").alias("component_id")), "near-least")
    named = settle(rooted_classes.join(least, "root").select("cls", "root", "component_id"), "near-named")
    return rows.select("doc_id", "text_hash", "cls").join(named, "cls", "left").select("doc_id", "component_id", "root", "text_hash")
