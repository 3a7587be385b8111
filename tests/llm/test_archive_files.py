"""A key that many rows have, or none, doesn't fill one file."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F
from tidewell.llm import archives
from tidewell.llm.common import scratch_path


def test_a_hot_key_is_spread(spark):
    body = "x" * 1000
    rows = [(7, "http://a", body)] * 300 + [(None, "http://b", body + str(i)) for i in range(300)] + [(i + 100, "http://c", body) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    arc = archives.write_arc(df, scratch_path(spark, "arc"), file_bytes=100_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(arc)
    sizes = [len(archives.gunzip(r.content)) for r in files.collect()]
    assert len(sizes) >= 9 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    warc = archives.read_warc(spark, archives.convert(spark, arc, scratch_path(spark, "warc"))).collect()
    assert len(warc) == len({r.record_id for r in warc}) == 900
    first = [r for r in warc if r.key == 7 and r.record_type == "response"]
    assert len(first) == 1 and Counter(r.record_type for r in warc) == {"response": 301, "revisit": 599}
    assert {r.refers_to for r in warc if r.record_type == "revisit"} == {first[0].record_id}


def test_round_trip_of_a_hot_key(spark):
    df = spark.range(400).select(F.lit(3).cast("long").alias("page_id"), F.lit("http://a").alias("url"), F.lit("y" * 200).alias("html"))
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in archives.round_trip(df).collect())
    assert got == {(3, "response", None): 1, (3, "revisit", 3): 399}
