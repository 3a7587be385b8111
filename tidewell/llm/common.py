"""What the corpus operators share: reading tables, settled intermediate tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.shipping import ship

#: White space of the word definition: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Spark's and Java's regular expressions.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only a session in local mode, as in tests, may leave the setting out; it then gets a temporary folder of
    this machine. A cluster without the setting is refused, because its executors could not read each other's files.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewell-"))
    return f"{base.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"


#: Whether Spark drops the shuffle files of a statement when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back: lineage ends there, and lost executors cost no recomputation.

    The shuffle files behind the written table are of no more use, and go when it is written.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read any more: what came of it is settled itself."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice take about `most` bytes at most (one very long text may take more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; further columns of a table never reach an operator's inner names."""
    ship(docs.sparkSession)
    return docs.select(*[F.col(f"`{n}`") for n in names])


def normalised(text: str = "text"):
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE_RUN, " ")
