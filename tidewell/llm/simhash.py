"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in at most `radius` bits are linked; documents with linked fingerprints form components.
Equal fingerprints are one class. A class meets others in cells: the 64 bits are cut into blocks, and of `radius` or
fewer differing bits at least blocks - radius blocks are free, so linked classes agree in one of the choices of that
many blocks. In a cell the pivot table decides first: it holds each class's Hamming distances to reference
fingerprints, and by the triangle inequality a pair whose distances to any pivot differ by more than `radius` can't
be linked. Rows of a cell are ordered by their distance to the first pivot, so that only rows within `radius` of each
other there are looked at; the maximum difference over the other pivots discards most of the rest, and the survivors
are verified bit by bit. A cell yields a spanning forest of its links, never its pairs.

A cell with more than `CELL` classes is cut by the pivots themselves: rings of distances, each with what lies within
`radius` below it, so that linked classes meet in the ring of the one further out. Each pivot cuts a cell to a third or
so and repeats about half of its rows; as many pivots are used as the cell is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, settle, slices
from .components import components

#: Reference fingerprints of the table.
PIVOTS = 16
#: Classes in a cell, about; a cell with more is cut into rings.
CELL = 4_096
#: Bits of a ring, as a multiple of the radius.
RING = 2


def pivots(n: int = PIVOTS) -> np.ndarray:
    """n fixed reference fingerprints (splitmix64 of 1 to n)."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def votes(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of 64-bit hashes: a bit is set if it is in more than half of them."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of a text: see op9_simhash's contract."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(width, len(words))
    starts = [0, *ends[: len(words) - k].tolist()]
    h = xxhash.xxh64_intdigest
    return votes(np.array([h(joined[i : j - 1], 42) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


def blocks_for(classes: int, radius: int, most: int = 64) -> int:
    """The least number of blocks whose cells hold about `most` of so many classes, were these even."""
    for blocks in range(radius + 1, radius + 5):
        if classes >> (64 * (blocks - radius) // blocks) <= most:
            return blocks
    return radius + 4


def masks(blocks: int, radius: int) -> np.ndarray:
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    one = [sum(1 << b for b in range(i, j)) for i, j in zip(edges, edges[1:], strict=False)]
    return np.array([sum(x) for x in combinations(one, blocks - radius)], dtype=np.uint64)


def keyed(classes: DataFrame, blocks: int, radius: int, n_pivots: int) -> DataFrame:
    """(key, fp, table): each class once for each choice of blocks, with its row of the pivot table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, cut = pivots(n_pivots), masks(blocks, radius)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
            rows = pa.array([r.tobytes() for r in table], pa.binary())
            for i, mask in enumerate(cut):
                with np.errstate(over="ignore"):
                    key = ((fp & mask) + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), rows], names=["key", "fp", "pivot_row"])

    return classes.select("fp").mapInArrow(work, "key long, fp long, pivot_row binary")


def ringed(radius: int):
    """Rows (cell, fp, pivot_row, cuts) once for each combination of rings of the first `cuts` pivots that they belong to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = RING * radius
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                key, cuts = part.column(0).to_numpy().view(np.uint64), part.column(3).to_numpy()
                table = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(cuts), -1)
                row = np.arange(len(cuts))
                for c in range(int(cuts.max())):
                    d = table[row, c].astype(np.int64)
                    own, next_ring = d // width, (d + radius) // width
                    cut = cuts[row] > c
                    both = np.flatnonzero(cut & (next_ring != own))
                    ring = np.where(cut, own, -1)
                    row, key, ring = np.concatenate([row, row[both]]), np.concatenate([key, key[both]]), np.concatenate([ring, next_ring[both]])
                    with np.errstate(over="ignore"):
                        mixed = (key ^ (ring + 64 * c + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
                        mixed ^= mixed >> np.uint64(29)
                    key = np.where(ring >= 0, mixed, key)
                for i in range(0, len(row), 20_000):
                    r = pa.array(row[i : i + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 20_000].view(np.int64)), part.column(1).take(r), part.column(2).take(r), part.column(3).take(r)], names=["cell", "fp", "pivot_row", "cuts"])

    return work


def forest(cell: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links within cells; rows are ordered by cell, then by the table's first column."""
    n = len(fp)
    lab = np.arange(n)
    first = table[:, 0].astype(np.int16)
    live, k = np.arange(n - 1), 1
    while len(live):
        live = live[live + k < n]
        other = live + k
        near = (cell[live] == cell[other]) & (first[other] - first[live] <= radius)
        live, other = live[near], other[near]
        if len(live):
            i, j = live, other
            for c in range(1, table.shape[1], 4):  # most pairs go at the first columns
                d = np.abs(table[i, c : c + 4].astype(np.int16) - table[j, c : c + 4].astype(np.int16)).max(axis=1) <= radius
                i, j = i[d], j[d]
            same = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            i, j = i[same], j[same]
            while len(i):  # join the trees of the ends until no link joins two
                a, b = lab[i], lab[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = lab[lab]
                    if (up == lab).all():
                        break
                    lab = up
        k += 1
    child = np.flatnonzero(lab != np.arange(n))
    return fp[child], fp[lab[child]]


def links(classes: DataFrame, radius: int = 3, n_pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """(a, b): links between fingerprints such that linked fingerprints are connected; classes needs distinct, non-null fp."""
    blocks = blocks_for(classes.count(), radius)
    rows = settle(keyed(classes, blocks, radius, n_pivots), "keyed")
    # each pivot leaves about half of a cell's rows in one ring, repeated ones included
    cuts = F.least(F.ceil(F.log2(F.col("n") / cell)), F.lit(n_pivots)).cast("int")
    hot = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("key", cuts.alias("cuts")), "hot")
    cells = rows.join(hot, "key", "left").select(F.col("key").alias("cell"), "fp", "pivot_row", F.coalesce("cuts", F.lit(0)).alias("cuts"))
    if not hot.isEmpty():
        cells = cells.where("cuts = 0").unionByName(cells.where("cuts > 0").mapInArrow(ringed(radius), "cell long, fp long, pivot_row binary, cuts int"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            c, f, t = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = len(c) if last else int(np.searchsorted(c, c[-1]))  # the last cell may go on
            held, size = [(c[cut:], f[cut:], t[cut:])], len(c) - cut
            if cut:
                a, b = forest(c[:cut], f[:cut], t[:cut], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, n_pivots)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), table))
                size += batch.num_rows
                if size >= 50_000:
                    yield from done(False)
        if size:
            yield from done(True)

    ordered = cells.drop("cuts").repartition("cell").sortWithinPartitions("cell", F.substring("pivot_row", 1, 1))
    return ordered.mapInArrow(sweep, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: (doc_id, fp, component_id).

    fp is the SimHash of the text's shingles of `width` words as a signed long (see fingerprint); component_id is the
    smallest doc_id that links of at most `radius` bits reach, its own included. Null and empty texts have fingerprint
    zero and are linked like any other. Copies, also thousands of them, are one class. Repeated rows come back as
    often as they are there; a null doc_id is never a component's id unless all of the component's are null. Further
    columns are ignored; no rows give none.
    """
    rows = settle(fingerprints(docs, width), "fingerprints")
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = settle(components(links(classes, radius)).withColumnRenamed("node", "fp"), "roots")
    least = settle(roots.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "least")
    linked = settle(roots.join(least, "root").select("fp", "component_id"), "linked")
    named = settle(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")
