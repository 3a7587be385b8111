"""Packing token ids into training sequences by minimum bin slack.

Every document is cut into whole sequences and one remainder. Each task gathers the remainders of its partition in
windows and fills sequences from them: the longest remainder opens a sequence, and a subset-sum dynamic programme
over a bitset (bit s is set if some multiset of the remaining lengths sums to s) finds the lengths that come closest
to filling it. Backtracking through the programme's layers gives how many pieces of each length are taken.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices
from .tokens import crc, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def closest_fill(counts: dict[int, int], room: int, order: list[int] | None = None) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is the largest that is at most `room`.

    Lengths are taken up in descending order (or `order`); the programme ends as soon as `room` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []  # length, how many copies as one step, sums reachable before it
    for length in order or sorted(counts, reverse=True):
        left, step = min(counts.get(length, 0), room // length), 1
        while left > 0:
            n = min(step, left)
            grown = (reach | reach << (length * n)) & mask
            if grown != reach:
                layers.append((length, n, reach))
                reach = grown
            left -= n
            step *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, n, before in reversed(layers):
        if not before >> at & 1:
            taken[length] += n
            at -= length * n
    return dict(taken)


def fill(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of `lengths` by sequence, each of at most `size` in sum."""
    shelves: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        shelves[n].append(i)
    counts = {n: len(x) for n, x in shelves.items()}
    heap = [-n for n in counts]
    heapq.heapify(heap)
    out = []
    order = sorted(counts, reverse=True)
    while heap:
        if not counts.get(-heap[0]):
            order.remove(-heapq.heappop(heap))
            continue
        seed = -heap[0]
        counts[seed] -= 1
        take = [shelves[seed].pop()]
        if room := size - seed:
            # the length that alone fills the room comes first: then one step of the programme is enough
            first = [room] if counts.get(room) else []
            for n, k in closest_fill(counts, room, first or order).items():
                counts[n] -= k
                take += [shelves[n].pop() for _ in range(k)]
        out.append(take)
    return out


def pack(docs: DataFrame, size: int = 1024, window: int = 50_000, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    docs needs doc_id and text; further columns are ignored. A null or empty text has the one id 0, its end. A very
    long text is cut like any other; repeated rows are packed as often as they are there; a null doc_id stays null;
    no rows give none. Sequences never span tasks: each task leaves at most one poorly filled sequence for each
    `window` remainders. sequence_id is the partition's number times 2**33 and a count, as the rows of a partition
    are the same whenever the task runs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary).encode
        base = TaskContext.get().partitionId() << 33
        count = 0
        rows: list[list[int]] = []  # pieces that fill a sequence alone
        rest: list[tuple] = []

        def packed() -> Iterator[list]:
            nonlocal count
            for take in fill([r[2] for r in rest], size):
                at = 0
                for i in sorted(take):
                    yield [*rest[i], base + count, at]
                    at += rest[i][2]
                count += 1
            rest.clear()

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

        for part in slices(batches, "text", 1_000_000):
            ids = part.column(0).to_pylist()
            for doc_id, data in zip(ids, encode(part.column(1).to_pylist()), strict=True):
                data += b"\0\0\0\0"
                n = len(data) // 4
                for at in range(0, n, size):
                    piece = data[at * 4 : (at + size) * 4]
                    row = (doc_id, at, len(piece) // 4, crc(piece), n)
                    if row[2] == size:
                        rows.append([*row, base + count, 0])
                        count += 1
                    else:
                        rest.append(row)
            if len(rest) >= window:
                rows += packed()
            if rows:
                yield out(rows)
                rows = []
        rows += packed()
        for at in range(0, len(rows), 20_000):
            yield out(rows[at : at + 20_000])

    return only(docs, "doc_id", "text").mapInArrow(work, SCHEMA)
