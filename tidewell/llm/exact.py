"""Exact copies by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Each level reads only what the level before has left. Between the levels a table of at most `buckets` numbers says
which lengths, or which (length, beginning) pairs, occur more than once; it is broadcast, as its size has that bound.
Two keys in one bucket only let a unique text through to the next level, where its own key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import normalised, only, settle


def _repeated(keys: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """Buckets of the keys that occur more than once."""
    return keys.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(bucket.alias("bucket")).distinct()


def exact_duplicates(docs: DataFrame, prefix: int = 64, buckets: int = 1 << 20, hash_all: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256, text_hash).

    Texts are equal when identical after each run of white space is replaced by one space; null counts as empty. Of
    equal texts the smallest doc_id stays; rows of a repeated doc_id with the same text stay or go together. A row
    whose doc_id is null stays only if all rows of its group have none. Very long texts are read whole where their
    length and beginning recur. Further columns are ignored; no rows give none. text_sha256 is null for texts that
    an earlier level has found unique, unless hash_all asks for the hashes of all. text_hash is of the text as it is; with
    doc_id it tells rows apart.
    """
    text = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), normalised().alias("norm"))
    size_bucket = F.pmod(F.col("n"), F.lit(buckets))
    sized = text.select("doc_id", "text_hash", "norm", F.length("norm").alias("n"))
    lengths = settle(_repeated(sized.select("n"), ["n"], size_bucket), "lengths")

    marked = sized.join(F.broadcast(lengths.select("bucket", F.lit(True).alias("length_recurs"))), size_bucket == F.col("bucket"), "left").drop("bucket")
    start = F.xxhash64(F.substring("norm", 1, prefix))
    pair_bucket = F.pmod(F.xxhash64("n", "start"), F.lit(buckets))
    pairs = settle(_repeated(marked.where("length_recurs").select("n", start.alias("start")), ["n", "start"], pair_bucket), "beginnings")

    survives = F.col("bucket").isNotNull() & F.col("length_recurs").isNotNull()
    full = F.sha2(F.col("norm").cast("binary"), 256)
    hashed = settle(
        marked.withColumn("start", start).join(F.broadcast(pairs), pair_bucket == F.col("bucket"), "left")
        .select("doc_id", "text_hash", survives.alias("survives"), (full if hash_all else F.when(survives, full)).alias("text_sha256")),
        "hashed",
    )
    groups = settle(
        hashed.where("survives").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
        "copies",
    )
    # both sides are stored tables, so that a group with a large share of the rows is split when the join runs
    found = hashed.where("survives").join(groups, "text_sha256", "left")
    alone = hashed.where("not survives").withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(None).cast("long")})
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.unionByName(alone).select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "text_hash"
    )
