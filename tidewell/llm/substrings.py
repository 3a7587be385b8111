"""Removal of byte strings that an earlier document has: suffix sorting, with matches of a minimum length.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

1. Anchors. Of the `GRAM`-byte grams inside each string of `length` bytes the one with the least hash is an anchor, so
   that equal strings have equal anchors at the same place. Anchors go to buckets by their hash, with a hash of the
   context: all strings of `length` bytes that hold the anchor lie in it.
   Each task settles the repeats of a context among its own documents, and sends on the smallest only, so that a
   passage that very many documents have sends a record for each task and context.
2. Buckets. Anchors of one document alone are dropped. A context that a smaller document has too settles itself: all
   of it goes. What is left, the first of each distinct context of an anchor, is at the edge of a match. A context and
   its place are known by 64 bits beside the 64 of the anchor: among a million contexts of one anchor two different
   ones are taken for equal with a chance of about 3 in 100 million.
3. Edges. The contexts' bytes are fetched from their documents, and meet by anchor. An anchor with more than `HOT`
   contexts is cut: a string around it holds one of two longer grams, and its contexts meet by either of these.
4. Intervals. The contexts of a bucket are suffix-sorted, and the lengths of common prefixes are derived by increasing
   value, breadth first: backward extension of the Burrows-Wheeler transform takes each boundary between rows at
   length l to boundaries at l + 1. It stops at the minimum length: rows without a boundary by then are in one
   interval of equal strings, and the smallest doc_id of an interval decides over the others.
5. Removal. The marks meet their documents, whose other bytes are kept.

Texts move only to a bucket of documents, and only those that have a match or share a number of `FLAGS` with one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, settle, slices

LENGTH, GRAM = 50, 20
#: Bytes of text to a bucket, about.
BUCKET_BYTES = 8_000_000
#: Contexts of an anchor that meet in one group at most, about.
HOT = 20_000
FLAGS = 1 << 20
#: Partitions that the buckets are dealt to at most.
PARTS = 20_000
NO_ID = np.iinfo(np.int64).max  # a null doc_id comes last
_ANCHOR = ("<u8", "<u8", "<i8", "<u4", "<u4")  # hash, context hash, doc_id, place, text check
_MARK = ("<i8", "<u4", "<u4", "<u4")  # doc_id, text check, from, to


def _pack(*arrays: np.ndarray) -> bytes:
    return len(arrays[0]).to_bytes(4, "little") + b"".join(a.tobytes() for a in arrays)


def _unpack(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for b in blobs:
        n, at = int.from_bytes(b[:4], "little"), 4
        for i, k in enumerate(kinds):
            a = np.frombuffer(b, k, n, at)
            at += a.nbytes
            out[i].append(a)
    return [np.concatenate(x) for x in out]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(29)


_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)  # a fixed number for each byte
_BASE, _POWERS = np.uint64(0xD1342543DE82EF95), {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _POWERS.get("n", 0) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", inverse)):
                x = np.full(n + 1, b, dtype=np.uint64)
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours (f is np.minimum or np.maximum)."""
    done = 1
    n = len(a)
    while done * 2 <= width:
        a = f(a[: len(a) - done], a[done:])
        done *= 2
    rest = width - done
    return f(a[: n - width + 1], a[rest : rest + n - width + 1])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, context hashes) of a document's anchors; none below `length` bytes."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], out=total[1:])
        grams = _mix((total[gram:] - total[: n + 1 - gram]) * down[: n + 1 - gram])
        width = length - gram + 1
        least = _sliding(grams, width, np.minimum)
        edge = np.zeros(width - 1, dtype=np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)  # the largest of the minima over a gram's strings
        at = np.flatnonzero(most == grams)
        start, end = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
        # the offset of the anchor in its context tells contexts apart that were cut at a text's beginning
        context = _mix((total[end] - total[start]) * down[start] + np.uint64(0x9E37) * (at - start).astype(np.uint64) + (end - at).astype(np.uint64))
    return at, grams[at], context


def check_of(data: bytes) -> int:
    """32 bits that tell apart the texts of a repeated doc_id."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little")


def equal_strings(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, number of the interval of each): suffixes of one interval share their first `length` bytes.

    text ends with a byte that no string of interest holds. Rows are sorted by 64 bytes (or more, for longer lengths).
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)  # equal keys may come in any order: what counts is decided within `length` bytes
    depth = 8
    while True:
        k = key[order]
        rank = np.zeros(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
        if depth >= length + 1 or int(rank.max()) == n:
            break
        key = rank << np.uint64(32)
        key[: n - depth] |= rank[depth:]
        order = np.argsort(key)
        depth *= 2
    row = np.empty(n, dtype=np.int64)
    row[order] = np.arange(n)
    # backward extension: the row of suffix i + 1 leads to that of suffix i, which has the transform's byte before it
    after = row[np.minimum(order + 1, n - 1)]
    first = text[order]
    boundary = np.concatenate([[True], first[1:] != first[:-1]])
    boundary[row[n - 1]] = True
    open_rows = np.flatnonzero(~boundary)
    low, high = np.minimum(after[open_rows - 1], after[open_rows]), np.maximum(after[open_rows - 1], after[open_rows])
    for _ in range(1, length):
        passed = np.cumsum(boundary)
        new = passed[high] != passed[low]
        if not new.any():
            break
        boundary[open_rows[new]] = True
        open_rows, low, high = open_rows[~new], low[~new], high[~new]
    return order, np.cumsum(boundary)


def earlier_strings(contexts: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the strings that a context of a smaller doc has too; bytes outside low to high don't count."""
    n, width = contexts.shape
    text = np.zeros((n, width + 1), dtype=np.uint8)
    text[:, :width] = contexts
    order, interval = equal_strings(text.reshape(-1), length)
    who, offset = order // (width + 1), order % (width + 1)
    whole = (offset >= low[who]) & (offset + length <= high[who])
    who, offset, interval = who[whole], offset[whole], interval[whole]
    if not len(who):
        return who, offset
    starts = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    least = np.repeat(np.minimum.reduceat(doc[who], starts), np.diff(np.append(starts, len(who))))
    later = doc[who] > least
    return who[later], offset[later]


def _texts(docs: DataFrame, doc_buckets: int) -> DataFrame:
    spread = F.xxhash64("doc_id")
    return only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        F.pmod(spread, F.lit(doc_buckets)).alias("bucket"), F.pmod(F.xxhash64(spread), F.lit(FLAGS)).alias("flag"),
    )


def _keys(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes if with_bytes.

    Texts are UTF-8 bytes, null counts as empty; matches never cross documents, and are judged on the input. Texts
    below `length` bytes lose nothing. Of exact copies all but the one with the smallest doc_id go. Rows of a repeated
    doc_id don't take from each other; a null doc_id comes after all others. Very long texts are read whole. Further
    columns are ignored; no rows give none.
    """
    volume = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(4, -(-volume // bucket_bytes))
    parts = min(buckets, PARTS)
    rows = _texts(docs, buckets)
    before, width = length - gram, 2 * length - gram

    def doc_buckets(doc: np.ndarray) -> np.ndarray:
        return (_mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def dealt(kind: int, cols: list[np.ndarray], to: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(to, kind="stable")
        cols, to = [c[order] for c in cols], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else []
        for a in range(0, max(len(cuts) - 1, 0), 64):
            spans = list(zip(cuts[a : a + 64], cuts[a + 1 : a + 65], strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(to[i]) for i, _ in spans], pa.int64()), pa.array([kind] * len(spans), pa.int32()), pa.array([_pack(*(c[i:j] for c in cols)) for i, j in spans], pa.binary())],
                names=["bucket", "kind", "blob"],
            )

    def covered(doc: np.ndarray, check: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Marks over the contexts of anchors."""
        a = at.astype(np.int64)
        return [doc, check, np.maximum(a - before, 0).astype(np.uint32), (a + length).astype(np.uint32)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def deal() -> Iterator[pa.RecordBatch]:
            h, c, doc, at, check = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, c ^ _mix(h)))
            h, c, doc, at, check = h[order], c[order], doc[order], at[order], check[order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])
            starts = np.flatnonzero(new)
            later = doc > np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
            if later.any():  # a smaller document of this task has the context: settled here, on the way to the documents' buckets
                yield from dealt(0, covered(doc[later], check[later], at[later]), doc_buckets(doc[later]))
                h, c, doc, at, check = (x[~later] for x in (h, c, doc, at, check))
            yield from dealt(2, [h, c, doc, at, check], (h >> np.uint64(8)) % np.uint64(buckets))

        for part in slices(batches, "data"):
            ids = _keys(part.column(0))
            for doc, value in zip(ids.tolist(), part.column(1), strict=True):
                data = value.as_py()
                at, h, c = anchors(data, length, gram)
                if len(at):
                    m = len(at)
                    held.append([h, c, np.full(m, doc, np.int64), at.astype(np.uint32), np.full(m, check_of(data), np.uint32)])
                    size += m
                    if size >= 1_000_000:
                        yield from deal()
                        size = 0
        if size:
            yield from deal()

    def by_bucket(work):
        """Run work(blobs) on each bucket of a partition that is sorted by bucket."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, blobs = None, []
            for b in batches:
                for bucket, blob in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1), strict=True):
                    if bucket != now and blobs:
                        yield from work(blobs)
                        blobs = []
                    now = bucket
                    blobs.append(blob.as_py())
            if blobs:
                yield from work(blobs)

        return run

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """sift() on the anchors of each bucket; marks that came with them go on to their documents' buckets."""

        def anchors_only() -> Iterator[pa.RecordBatch]:
            for b in batches:
                marks = pa.compute.equal(b.column(1), 0)
                ready.append(b.filter(marks))
                yield b.filter(pa.compute.invert(marks))

        ready: list[pa.RecordBatch] = []
        for out in by_bucket(sift)(anchors_only()):
            yield out
            yield from ready
            ready.clear()
        yield from ready

    def sift(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, c, doc, at, check = _unpack(blobs, _ANCHOR)
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        keep = np.repeat(several, sizes)
        if not keep.any():
            return
        order, h, doc = order[keep], h[keep], doc[keep]
        c, at, check = c[order], at[order], check[order]
        order = np.lexsort((doc, c, h))
        h, c, doc, at, check = h[order], c[order], doc[order], at[order], check[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        starts = np.flatnonzero(new_c)
        least = np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
        settled = doc > least
        contexts = np.bincount(np.cumsum(new_h) - 1, weights=new_c)[np.cumsum(new_h) - 1]
        asked = ~settled & (contexts > 1)  # more than one context has this anchor
        if settled.any():
            yield from dealt(0, covered(doc[settled], check[settled], at[settled]), doc_buckets(doc[settled]))
        if asked.any():
            a = at[asked]
            yield from dealt(1, [doc[asked], check[asked], a, (contexts[asked] > hot).astype(np.uint32)], doc_buckets(doc[asked]))

    schema = "bucket long, kind int, blob binary"
    dealt_anchors = rows.select("doc_id", "data").mapInArrow(find, schema)
    marks = settle(dealt_anchors.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(sifted, schema), "marks")

    def flags_of(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids = np.unique(_unpack(blobs, _MARK)[0])
        yield pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64())], names=["doc_id"])

    def flagged(marks: DataFrame, name: str) -> DataFrame:
        """Numbers of the documents that have marks; a document's marks are all in its bucket, so that it comes once."""
        ids = marks.select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(flags_of), "doc_id long")
        return settle(ids.select(F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(FLAGS)).alias("flag")).distinct(), name)

    def longer(h: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: np.ndarray) -> Iterator[np.ndarray]:
        """For either longer gram around the anchors h its hash; a context that doesn't hold it gets a number of its own."""
        half = before // 2
        for i, j in ((before - half, before + gram), (before, before + gram + (before - half))):
            k = _gram_hash(contexts[:, i:j]) ^ _mix(h)
            short = (low > i) | (high < j)
            alone = _mix(_gram_hash(contexts) ^ np.uint64(1 << 62))
            k[short] = alone[short]
            yield k

    def fetch(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x.as_py() for b in right for x in b.column(b.schema.get_field_index("blob"))]
        doc, check, at, many = _unpack(blobs, _MARK)
        order = np.lexsort((at, check, doc))
        doc, check, at, many = doc[order], check[order], at[order].astype(np.int64), many[order] > 0
        for part in left if len(doc) else ():
            ids = _keys(part.column(part.schema.get_field_index("doc_id")))
            out: list[list[np.ndarray]] = []
            for i, value in zip(ids.tolist(), part.column(part.schema.get_field_index("data")), strict=True):
                a, b = np.searchsorted(doc, [i, i + 1] if i != NO_ID else [i, i], side="left")
                b = len(doc) if i == NO_ID else b
                if a == b:
                    continue
                data = value.as_py()
                here = (check[a:b] == check_of(data)) & (at[a:b] + gram <= len(data))
                mine, cut = at[a:b][here], many[a:b][here]
                if not len(mine):
                    continue
                padded = np.frombuffer(bytes(before) + data + bytes(length), np.uint8)
                contexts = np.lib.stride_tricks.sliding_window_view(padded, width)[mine]
                low, high = np.maximum(before - mine, 0), np.minimum(len(data) - mine + before, width)
                grams = _mix(_gram_hash(contexts[:, before : before + gram]))
                cols = [grams, np.full(len(mine), i, np.int64), np.full(len(mine), check_of(data), np.uint32), mine.astype(np.uint32), low.astype(np.uint8), high.astype(np.uint8), contexts]
                out.append([c[~cut] for c in cols])
                for k in longer(grams, low, high, contexts) if cut.any() else ():  # of a hot anchor: by either longer gram
                    out.append([k[cut], *(c[cut] for c in cols[1:])])
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                to = ((cols[0] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
                yield from dealt(2, cols, to)

    def expand(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, doc, check, at, low, high = (x for x in _unpack(blobs, _EDGE))
        contexts = np.concatenate([np.frombuffer(b, np.uint8, offset=len(b) - int.from_bytes(b[:4], "little") * width) for b in blobs]).reshape(-1, width)
        # a string around the anchor holds one of two longer grams; those that no other context shares can't matter
        keep = np.zeros(len(h), dtype=bool)
        for k in longer(h, low, high, contexts):
            order = np.argsort(k)
            same = k[order][1:] == k[order][:-1]
            keep[order[1:][same]] = keep[order[:-1][same]] = True
        pick = np.flatnonzero(keep)
        pick = pick[np.argsort(h[pick], kind="stable")]
        out: list[list[np.ndarray]] = []
        a = 0
        while a < len(pick):
            b = min(a + 40_000, len(pick))
            while b < len(pick) and h[pick[b]] == h[pick[b - 1]]:  # an anchor's contexts stay together
                b += 1
            p = pick[a:b]
            a = b
            who, offset = earlier_strings(contexts[p], low[p].astype(np.int64), high[p].astype(np.int64), doc[p], length)
            if not len(who):
                continue
            who = p[who]
            start = at[who].astype(np.int64) - before + offset
            order = np.lexsort((start, check[who], doc[who]))
            who, start = who[order], start[order]
            apart = (doc[who][1:] != doc[who][:-1]) | (check[who][1:] != check[who][:-1]) | (start[1:] > start[:-1] + length)
            first = np.flatnonzero(np.concatenate([[True], apart]))
            last = np.append(first[1:] - 1, len(who) - 1)
            out.append([doc[who[first]], check[who[first]], start[first].astype(np.uint32), (start[last] + length).astype(np.uint32)])
        if out:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield from dealt(0, cols, doc_buckets(cols[0]))

    def removed(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, bytes]:
        edges = np.zeros(len(data) + 2, dtype=np.int32)
        np.add.at(edges, np.minimum(low, len(data)), 1)
        np.add.at(edges, np.minimum(high, len(data)), -1)
        gone = np.cumsum(edges)[: len(data)] > 0
        return int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_bytes
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def cut(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, check, low, high = _unpack([x.as_py() for b in right for x in b.column(b.schema.get_field_index("blob"))], _MARK)
        order = np.argsort(doc, kind="stable")
        doc, check, low, high = doc[order], check[order], low[order], high[order]
        for part in left:
            ids = part.column(part.schema.get_field_index("doc_id"))
            keys = _keys(ids)
            a, b = np.searchsorted(doc, keys, side="left"), np.searchsorted(doc, keys, side="right")
            out = []
            for doc_id, i, j, value in zip(ids.to_pylist(), a.tolist(), b.tolist(), part.column(part.schema.get_field_index("data")), strict=True):
                data = value.as_py()
                mine = check[i:j] == check_of(data) if i < j else slice(0)
                n, spans, kept = removed(data, low[i:j][mine].astype(np.int64), high[i:j][mine].astype(np.int64)) if i < j else (0, 0, data)
                out.append((doc_id, len(data), n, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def grouped(texts: DataFrame):
        # the marks' buckets are computed in numpy, so the texts' are too
        return texts.select("doc_id", "data", "bucket").groupBy("bucket")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = doc_buckets(_keys(b.column(0))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(to), b.column(3)], names=["doc_id", "data", "bucket", "flag"])

    def texts(flags: DataFrame, among: bool) -> DataFrame:
        how = "left_semi" if among else "left_anti"
        return rows.join(F.broadcast(flags), "flag", how).select("doc_id", "data", "bucket", "flag")

    def tables(work, empty: pa.Schema):
        """A cogrouped function from one over batches."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = list(work(iter(left.to_batches()), iter(right.to_batches())))
            return pa.Table.from_batches(out) if out else empty.empty_table()

        return run

    dealt_schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
    result_schema = pa.schema(list(zip(names, kinds, strict=True)))
    placed = "doc_id long, data binary, bucket long, flag long"
    asked = marks.where("kind = 1")
    contexts = grouped(texts(flagged(asked, "asked-flags"), True).mapInArrow(place, placed)).cogroup(asked.select("bucket", "blob").groupBy("bucket")).applyInArrow(tables(fetch, dealt_schema), schema)
    edges = settle(contexts.select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket(expand), schema), "edges")
    gone = marks.where("kind = 0").unionByName(edges)
    flags = flagged(gone, "flags")
    with_marks = grouped(texts(flags, True).mapInArrow(place, placed)).cogroup(gone.select("bucket", "blob").groupBy("bucket")).applyInArrow(tables(cut, result_schema), result)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            yield from cut(iter([b]), iter([]))

    return with_marks.unionByName(texts(flags, False).select("doc_id", "data").mapInArrow(whole, result))


_EDGE = ("<u8", "<i8", "<u4", "<u4", "<u1", "<u1")  # anchor, doc_id, text check, place, bytes of the context from, to


def _gram_hash(grams: np.ndarray) -> np.ndarray:
    """The hash of rows of bytes that anchors() has before mixing."""
    up, _ = _powers(grams.shape[1] + 1)
    with np.errstate(over="ignore"):
        return (_BYTES[grams] * up[: grams.shape[1]]).sum(axis=1, dtype=np.uint64)
