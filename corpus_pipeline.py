"""The corpus pipeline: quality rules, exact copies, near copies, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads: all but the last the columns of documents,
further ones included. Null and empty texts fail the quality rules; the later stages take them as texts without words.
Rows of a repeated doc_id are documents of their own where their texts differ; a null doc_id is one like others, but
comes after all numbers where the smallest stays. Empty tables go through and give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import exact, mixing, nearcopies, packing, quality
from tidewell.llm.common import settle, table

#: Shares of clean, low and toxic tokens. The quality rules leave next to nothing of low quality to ask for. Toxic tokens
#: are counted by soft membership, in which clean documents have a share of about 0.3 %: less can't be had with them kept.
TARGETS = (0.996, 0.0, 0.004)


def _first_of_each(docs: DataFrame, found: DataFrame, group: Column) -> DataFrame:
    """The rows of docs that are the first of their group by doc_id (null last) and text; of repeated rows one stays.

    found has a row for each of docs with doc_id, text_hash and the group.
    """
    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", group.alias("group"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = rows.groupBy("group").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    wanted = settle(first.select(F.col("first.doc_id").alias("wanted_id"), F.col("first.text_hash").alias("wanted_hash"), (F.col("n") > 1).alias("several")), "firsts")
    same = lambda w: docs["doc_id"].cast("long").eqNullSafe(w["wanted_id"]) & (F.xxhash64(docs["text"]) == w["wanted_hash"])
    twice = settle(
        rows.join(wanted.where("several"), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))
        .groupBy("wanted_id", "wanted_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated-rows",
    )
    kept = docs.join(wanted, same(wanted), "left_semi")
    if twice.isEmpty():
        return kept
    names = [F.col(f"`{c}`") for c in docs.columns]
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*names))
    place = "place"
    while place in docs.columns:
        place += "_"
    repeated = docs.join(twice, same(twice), "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*names)
    return kept.join(twice, same(twice), "left_anti").unionByName(repeated)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the base rules and is more like the trusted documents than the corpus; repeated rows alike."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside."""
    found = exact.exact_duplicates(docs)
    return _first_of_each(docs, found, F.coalesce("text_sha256", F.hex("text_hash")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of 5-word Jaccard 4/5 or more connect; all texts without a word are one."""
    return _first_of_each(docs, nearcopies.near_copies(docs), F.col("root"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says, so that clean, low and toxic tokens come to TARGETS; clean documents stay."""
    return mixing.keep(docs, table(spark, sf_dir, "labels"), TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens; a row that comes twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]
#: Tokenisation and fingerprints can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
