"""Token-id shards with a minimal perfect hash index.

A shard file holds the ids of consecutive documents, in ascending doc_id order, as raw little-endian integers, and in
front of them an index that takes a document key to its place in constant time:

    magic 8 bytes | header: 12 little-endian int64 | displacements int32[buckets] | fingerprints uint32[slots]
    | places uint32[slots] | keys int64[rows] | null flags uint8[rows] | ends int64[rows] | ids uint16 or uint32[...]

Header: range number, shard number in its range, ids before it in its range, rows, distinct keys (slots), buckets,
ids, bytes of an id, first key, last key, hash seed, 0. The hash is minimal and perfect over the distinct keys by
hash-and-displace: the larger buckets are placed first, each by the first displacement that sends its keys to free
slots. A slot stores a 32-bit fingerprint of its key, so that unknown keys are refused without reading the keys,
and the place of its first row; rows with the same key follow each other.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, scratch_path, slices
from .tokens import crc, encoder

MAGIC = b"TWSHARD1"
HEAD = "<12q"
#: Ranges that are summed up together.
BLOCK = 4_096
#: Keys that are looked up one by one at most.
MOST_KEYS = 10_000
NULL_KEY = np.uint64(0x9E3779B97F4A7C15)  # stands for a null key in the hash


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over uint64 keys (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _slots(h: np.ndarray, displacement, n: int) -> np.ndarray:
    """Slot of hashes under a displacement: two halves of the hash make an arithmetic progression that is mixed again."""
    return (mix(h + np.uint64(1) * np.asarray(displacement).astype(np.uint64), 7) % np.uint64(max(n, 1))).astype(np.int64)


def build_index(keys: np.ndarray, per_bucket: int = 4) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slot of each key) of a minimal perfect hash over distinct uint64 keys."""
    n = len(keys)
    buckets = max(1, (n + per_bucket - 1) // per_bucket)
    for seed in range(1, 100):
        h = mix(keys, seed)
        where = (h >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(where, kind="stable")
        starts = np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        taken = np.zeros(n, dtype=bool)
        displacements = np.zeros(buckets, dtype=np.int32)
        slots = np.zeros(n, dtype=np.int64)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            rows = order[starts[b] : starts[b + 1]]
            for base in range(0, max(4096, 64 * n), 256):
                got = _slots(h[rows][:, None], tries[None, :] + np.uint64(base), n)
                ok = ~taken[got].any(axis=0)
                if len(rows) > 1:
                    s = np.sort(got, axis=0)
                    ok &= (s[1:] != s[:-1]).all(axis=0)
                if ok.any():
                    k = int(np.argmax(ok))
                    displacements[b], slots[rows] = base + k, got[:, k]
                    taken[got[:, k]] = True
                    break
            else:
                break  # no displacement: another seed
        else:
            return seed, displacements, slots
        if taken.all():
            return seed, displacements, slots
    raise ValueError("no perfect hash found; are the keys distinct?")


def hash_keys(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.where(null, NULL_KEY, keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def write_shard(number: int, part: int, before: int, keys: list, lengths: list[int], payload: bytes, width: int) -> bytes:
    null = np.array([k is None for k in keys], dtype=bool)
    plain = np.array([0 if k is None else k for k in keys], dtype=np.int64)
    hashed = hash_keys(plain, null)
    distinct, first = np.unique(hashed, return_index=True)
    seed, displacements, slots = build_index(distinct)
    fingerprints = np.zeros(len(distinct), dtype=np.uint32)
    places = np.zeros(len(distinct), dtype=np.uint32)
    fingerprints[slots] = (mix(distinct, 1000) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    places[slots] = first
    ends = np.cumsum(np.array(lengths, dtype=np.int64))
    head = struct.pack(HEAD, number, part, before, len(keys), len(distinct), len(displacements), int(ends[-1]), width, int(plain[0]), int(plain[-1]), seed, 0)
    return b"".join([MAGIC, head, displacements.tobytes(), fingerprints.tobytes(), places.tobytes(), plain.tobytes(), null.astype(np.uint8).tobytes(), ends.tobytes(), payload])


class Shard:
    """Keyed access to one shard's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        h = struct.unpack_from(HEAD, data, 8)
        self.number, self.part, self.before, self.rows, self.slots, self.buckets, self.n_ids, self.width = h[:8]
        self.seed = h[10]
        at = 8 + struct.calcsize(HEAD)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.displacements, self.fingerprints, self.places = take("<i4", self.buckets), take("<u4", self.slots), take("<u4", self.slots)
        self.keys, self.null, self.ends = take("<i8", self.rows), take("u1", self.rows).astype(bool), take("<i8", self.rows)
        self.ids = take("<u2" if self.width == 2 else "<u4", self.n_ids)
        there = self.keys[~self.null]
        self.low, self.high = (int(there[0]), int(there[-1])) if len(there) else (0, -1)

    def find(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Place of the first row of each key, -1 for keys whose fingerprint isn't there."""
        hashed = hash_keys(keys, null)
        h = mix(hashed, self.seed)
        bucket = ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        slot = _slots(h, self.displacements[bucket], self.slots)
        same = self.fingerprints[slot] == (mix(hashed, 1000) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(same, self.places[slot].astype(np.int64), -1)

    def span(self, place: int) -> tuple[int, int]:
        return (int(self.ends[place - 1]) if place else 0), int(self.ends[place])


def write(docs: DataFrame, path: str, shard_ids: int = 2_000_000, range_rows: int = 20_000, vocabulary: str | None = None) -> str:
    """Encode every whole text, and write shards of about `shard_ids` ids in ascending doc_id order to `path`.

    docs needs doc_id and text; further columns are ignored. Null or empty texts have the one id 0, their end; a null
    doc_id comes first, as one key; rows with the same doc_id follow each other, ordered by text, in one shard or in
    neighbouring ones; a text longer than a shard gets a shard of its own; no rows give no shard. A shard is the one
    file of a folder whose name has its facts: range, place in the range, ids before it in the range, its ids, first and
    last key. So a listing of the folders is the table of all shards, and no file is read to find a key's. Texts are
    dealt by ranges of doc_id, about range_rows in each, and encoded after that, so that each text moves once and its
    ids never. The last byte of a file is a line feed.
    """
    rows = only(docs, "doc_id", "text")
    parts = max(1, rows.select("doc_id").count() // range_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        coder = encoder(vocabulary)
        size = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        keys: list = []
        lengths: list[int] = []
        payload: list[bytes] = []
        held = before = part = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, before, part
            plain = [k for k in keys if k is not None]
            name = "_".join(map(str, (number, part, before, held, plain[0] if plain else "", plain[-1] if plain else "")))
            data = write_shard(number, part, before, keys, lengths, b"".join(payload), size)
            before, part, held = before + held, part + 1, 0
            keys.clear(), lengths.clear(), payload.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["shard", "value"])

        for piece in slices(batches, "text", 1_000_000):
            for doc_id, data in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(data + b"\0\0\0\0", "<u4")
                if held and held + len(ids) > shard_ids:
                    yield shard()
                keys.append(doc_id)
                lengths.append(len(ids))
                payload.append(ids.astype("<u2").tobytes() if size == 2 else ids.tobytes())
                held += len(ids)
        if keys:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    blobs = rows.repartitionByRange(parts, order[0]).sortWithinPartitions(*order).mapInArrow(work, "shard string, value binary")
    blobs.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files if "shard" in files.columns else files.withColumn("shard", F.lit(None).cast("string"))  # no shard, no folder


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, number, part, before, n, low, high): the facts in the names of the shards' folders; a shard of null keys alone has no bounds."""
    facts = F.split("shard", "_")
    names = ("number", "part", "before", "n", "low", "high")
    return _files(spark, path).select("shard", *[facts[i].try_cast("long").alias(c) for i, c in enumerate(names)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    Each key of a shard is looked up through the index, its fingerprint is checked, and its ids are cut from the
    payload. start counts all ids of smaller doc_ids: those of earlier shards, summed up from the folders' names first
    within blocks of ranges, then over the blocks, plus those before it in the shard.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(blob.as_py())
                first = s.find(s.keys, s.null)
                if (first < 0).any():
                    raise ValueError("a key of the shard isn't in its index")
                seen: dict[int, int] = {}
                out = []
                for key, null, place in zip(s.keys.tolist(), s.null.tolist(), first.tolist(), strict=True):
                    k = seen.get(place, 0)  # rows with the same key follow each other
                    seen[place] = k + 1
                    i, j = s.span(place + k)
                    out.append((None if null else key, i, j - i, crc(s.ids[i:j].astype("<u4").tobytes())))
                for at in range(0, len(out), 20_000):
                    cols = [pa.array(c, pa.int64()) for c in zip(*out[at : at + 20_000], strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([shard] * len(cols[0]))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    found = manifest(spark, path).withColumn("block", F.floor(F.col("number") / BLOCK))
    w = Window.partitionBy("block").orderBy("number", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("block").agg(F.sum("n").alias("ids"))
    earlier = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK ranges
    bases = found.withColumn("_in", F.sum("n").over(w)).join(blocks.withColumn("_to", F.sum("ids").over(earlier)), "block")
    bases = bases.select("shard", (F.coalesce("_in", F.lit(0)) + F.coalesce("_to", F.lit(0))).alias("base"))
    rows = _files(spark, path).select("shard", "content").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    return rows.join(bases, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def lookup(path: str, keys: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """Ids of the given doc_ids: (doc_id, ids array<int>). Unknown keys give no row; null never matches.

    Up to `most` keys go to the driver, which picks the shards that may hold one by the bounds in their folders' names;
    only these files are read, and the index of each takes a key to its ids in constant time. More keys than that are
    a join: all shards are read, and their keys meet the wanted ones by hash.
    """
    spark = keys.sparkSession
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    some = sorted(r.doc_id for r in wanted.limit(most + 1).collect())
    if len(some) > most:
        return _all(spark, path).join(wanted, "doc_id", "left_semi")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Shard(content.as_py())
                k = np.array(some[bisect_left(some, s.low) : bisect_right(some, s.high)], dtype=np.int64)
                at = s.find(k, np.zeros(len(k), dtype=bool))
                ids, got = [], []
                for key, place in zip(k.tolist(), at.tolist(), strict=True):
                    while 0 <= place < s.rows and s.keys[place] == key and not s.null[place]:
                        i, j = s.span(place)
                        got.append(key)
                        ids.append(s.ids[i:j].astype(np.int32))
                        place += 1
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    held = F.exists(F.array(*map(F.lit, some)).cast("array<bigint>"), lambda k: k.between(F.col("low"), F.col("high")))
    names = [r.shard for r in manifest(spark, path).where(held).select("shard").collect()] if some else []  # two or so for each key at most
    return _files(spark, path).where(F.col("shard").isin(names)).select("content").mapInArrow(answer, "doc_id long, ids array<int>")


def _all(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document that has a doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Shard(content.as_py())
                for at in range(0, s.rows, 256):
                    place = [i for i in range(at, min(at + 256, s.rows)) if not s.null[i]]
                    ids = [s.ids[slice(*s.span(i))].astype(np.int32) for i in place]
                    yield pa.RecordBatch.from_arrays([pa.array(s.keys[place]), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _files(spark, path).select("content").mapInArrow(work, "doc_id long, ids array<int>")


def write_and_read(docs: DataFrame) -> DataFrame:
    return read(docs.sparkSession, write(docs, scratch_path(docs.sparkSession, "shards")))
